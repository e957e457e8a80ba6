"""Deep-shallow sorting of suffixes.

Suffixes are split by multikey quicksort, one byte at a time, down to a shallow
depth.  Those that still share a prefix there are likely to share a long one;
they are ordered by a blind trie, which compares each with one other only.
"""

from __future__ import annotations


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n if not x else n - (x.bit_length() + 7) // 8


def common_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[len(a) - n :], "big") ^ int.from_bytes(b[len(b) - n :], "big")
    return n if not x else ((x & -x).bit_length() - 1) // 8


def blind_order(suffixes: list[bytes], members: list[int]) -> list[int]:
    """Members in order, by a trie that keeps branching depths and single bytes, not the strings on its edges."""
    # a node is [depth, {byte: node}] or, for a leaf, the list of equal members; -1 is the end of a suffix
    root: list = [members[0]]
    byte = lambda s, d: s[d] if d < len(s) else -1
    inner = lambda node: len(node) == 2 and isinstance(node[1], dict)
    for m in members[1:]:
        s, node = suffixes[m], root
        while inner(node):
            node = node[1].get(byte(s, node[0])) or next(iter(node[1].values()))
        other = suffixes[node[0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node.append(m)
            continue
        parent, node = None, root
        while inner(node) and node[0] < depth:
            parent, node = node, node[1][byte(s, node[0])]
        if inner(node) and node[0] == depth:
            node[1][byte(s, depth)] = [m]
            continue
        split = [depth, {byte(other, depth): node, byte(s, depth): [m]}]
        if parent is None:
            root = split
        else:
            parent[1][byte(s, parent[0])] = split
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if inner(node):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(suffixes: list[bytes], depth: int = 0, shallow: int = 40) -> list[int]:
    """The order of suffixes that share their first ``depth`` bytes; equal ones stand side by side."""
    out: list[int] = []
    stack = [(list(range(len(suffixes))), depth)]
    while stack:
        members, d = stack.pop()
        if len(members) < 2:
            out += members
        elif d >= shallow:
            out += blind_order(suffixes, members)
        else:
            keys = [suffixes[m][d] if d < len(suffixes[m]) else -1 for m in members]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [m for m, k in zip(members, keys, strict=True) if k < pivot]
            same = [m for m, k in zip(members, keys, strict=True) if k == pivot]
            more = [m for m, k in zip(members, keys, strict=True) if k > pivot]
            stack.append((more, d))
            if pivot < 0:
                stack.append(([], d))
                # ended suffixes are equal
                stack.extend(([m], d) for m in reversed(same))
            else:
                stack.append((same, d + 1))
            stack.append((less, d))
    return out
