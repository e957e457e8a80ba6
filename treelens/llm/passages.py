"""Suffix-array dedup of passages: every byte inside a LENGTH-byte string that also starts earlier goes.

Only suffixes that can repeat are sorted.  Every string of LENGTH bytes is
known by its anchor, the SEED-byte substring in it with the least hash: equal
strings have equal anchors at equal places.  The strings of one anchor start
side by side; together they are a span.

1. Spans are dealt by the hash of their anchor.  Each batch of texts settles
   its own equal spans first, comparing their bytes, so that copies don't meet
   in thousands.  Anchors that are left with two spans or more are candidates.
2. The spans of candidates are fetched from their texts: a 128-bit BLAKE2
   digest of each one's bytes, and the bytes of the first of those that look
   equal.  Spans of one anchor with one digest are one leaf of the order; the
   leaves' suffixes from the anchor on are put in order by deep-shallow sorting,
   and in an interval of that order whose common prefixes are long enough,
   those equal before the anchor, too, are one string.  Spans that looked equal
   and have another digest are fetched once more, with their bytes.
3. Each text loses the bytes of all strings found not to be the first.

The leaves of an anchor with more than ``open_limit`` different spans are
salted: dealt string by string, so that no task holds them all.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_shuffles
from .suffix_sort import common_prefix, common_suffix, deep_shallow

LENGTH, SEED = 100, 32
#: Places at which an anchor can be in a string.
PLACES = LENGTH - SEED + 1
#: Bytes of text of one part, and bytes that are hashed at once.
PART_BYTES, AT_ONCE = 16_000_000, 1_000_000
#: Different spans of an anchor beyond which it is salted.
OPEN = 5_000
REPEATS, SPANS = 0, 1


def _tables(at_once: int):
    """A number for each byte, and the powers of an odd base and of its inverse modulo 2**64."""
    import numpy as np

    from .minhash import _mixed

    base = 0x9FB21C651E98DF25
    n = at_once + LENGTH + 1
    powers = [np.ones(n, np.uint64), np.ones(n, np.uint64)]
    for p, b in zip(powers, (base, pow(base, -1, 2**64)), strict=True):
        p[1:] = np.uint64(b)
        np.multiply.accumulate(p, out=p)
    return _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), *powers


class Spans:
    """The spans of texts."""

    def __init__(self, at_once: int = AT_ONCE):
        self.codes, self.powers, self.inverse = _tables(at_once)

    def of(self, data, starts, ends):
        """(which text, start, strings, place of the anchor, anchor hash, span hash) of the texts data[starts:ends]."""
        import numpy as np

        from .minhash import _mixed

        n = len(data)
        none = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)]
        if n < LENGTH:
            return none
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[data] * self.powers[:n], out=sums[1:])
        seeds = _mixed((sums[SEED:] - sums[: n - SEED + 1]) * self.inverse[: n - SEED + 1])
        # the least of each PLACES neighbours, leftmost of equals: 40 bits of hash, 24 of position
        ranked = (seeds >> np.uint64(24) << np.uint64(24)) | np.arange(len(seeds), dtype=np.uint64)
        blocks = -(-len(ranked) // PLACES)
        padded = np.full(blocks * PLACES, np.iinfo(np.uint64).max)
        padded[: len(ranked)] = ranked
        square = padded.reshape(blocks, PLACES)
        ahead = np.minimum.accumulate(square, axis=1).ravel()
        behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[: n - LENGTH + 1], ahead[PLACES - 1 : n - LENGTH + PLACES]) & np.uint64(0xFFFFFF)).astype(np.int64)
        valid = np.zeros(n - LENGTH + 2, np.int8)
        long = ends - starts >= LENGTH
        np.add.at(valid, starts[long], 1)
        np.add.at(valid, ends[long] - LENGTH + 1, -1)
        inside = np.cumsum(valid[:-1]) > 0
        at = np.flatnonzero(inside)
        if not len(at):
            return none
        head = np.flatnonzero(np.concatenate([[True], (np.diff(anchor[at]) != 0) | (np.diff(at) != 1)]))
        lo = at[head]
        count = np.diff(np.concatenate([head, [len(at)]]))
        place = anchor[lo]
        text = np.searchsorted(starts, lo, side="right") - 1
        whole = _mixed((sums[lo + count + LENGTH - 1] - sums[lo]) * self.inverse[lo] + count.astype(np.uint64))
        return text, lo - starts[text], count, place - lo, seeds[place], whole


def pack(**columns) -> bytes:
    """Arrays of one length; ids as differences."""
    import zstandard

    columns = {k: columns[k] for k in sorted(columns)}
    raw = []
    for k, v in columns.items():
        raw.append(_differences(v).tobytes() if k == "doc" else v.tobytes())
    return zstandard.compress(b"".join(raw), 1)


def _differences(v):
    import numpy as np

    return np.concatenate([v[:1], v[1:] - v[:-1]])


def unpack(blob: bytes, **types):
    import numpy as np
    import zstandard

    raw, types = zstandard.decompress(blob), {k: np.dtype(types[k]) for k in sorted(types)}
    n, at, out = len(raw) // sum(t.itemsize for t in types.values()), 0, {}
    for k, t in types.items():
        out[k] = np.frombuffer(raw, t, n, at)
        at += n * t.itemsize
    if "doc" in out:
        out["doc"] = np.cumsum(out["doc"])
    return out


REPEAT_TYPES = {"doc": "i8", "tag": "i8", "lo": "i4", "count": "u1"}
SPAN_TYPES = REPEAT_TYPES | {"place": "u1", "anchor": "u8", "span": "u8"}
#: many: how many spans its anchor has, 0 for one that all look equal to; first: whether it is the first of those that look equal.
OPEN_TYPES = REPEAT_TYPES | {"place": "u1", "anchor": "u8", "many": "u1", "first": "u1"}
ROWS = "kind int, part int, blob binary"


def _rows(kind: int, part, columns: dict, out: dict) -> None:
    """Adds a row for each part."""
    import numpy as np

    order = np.lexsort((columns["lo"], columns["doc"], part))
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        out["kind"].append(kind)
        out["part"].append(int(part[at[0]]))
        out["blob"].append(pack(**{k: v[at] for k, v in columns.items()}))


def _batch(out: dict) -> dict:
    return {"kind": pa.array(out["kind"], pa.int32()), "part": pa.array(out["part"], pa.int32()), "blob": pa.array(out["blob"], pa.binary())}


def _firsts(c: dict):
    """The order of spans by anchor, span and origin, and in that order: starts a span, and is another origin than its first."""
    import numpy as np

    order = np.lexsort((c["lo"], c["tag"], c["doc"], c["span"], c["anchor"]))
    s = {k: v[order] for k, v in c.items()}
    new = np.concatenate([[True], (np.diff(s["anchor"]) != 0) | (np.diff(s["span"]) != 0)])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    other = (s["doc"] != s["doc"][first]) | (s["tag"] != s["tag"][first]) | (s["lo"] != s["lo"][first])
    return s, new, other


def named(docs: DataFrame) -> DataFrame:
    """(doc, tag, text) of ``docs``: what a document is known by.

    tag tells texts of one id apart, and rows without an id, which come after
    all others, from any id there is: 62 bits of a hash of the text, and one
    more where the id is null.
    """
    text = F.coalesce("text", F.lit(""))
    nameless = F.col("doc_id").isNull()
    tag = F.shiftrightunsigned(F.xxhash64(text), 2) + F.when(nameless, F.lit(2**62)).otherwise(F.lit(0))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), tag.alias("tag"), text.alias("text"))


def _differ(data, a, b, size):
    """Whether data[a:a + size] and data[b:b + size] differ, for arrays of them."""
    import numpy as np

    ends = np.cumsum(size)
    at = np.arange(ends[-1]) - np.repeat(ends - size, size)
    unlike = data[np.repeat(a, size) + at] != data[np.repeat(b, size) + at]
    return np.add.reduceat(unlike, ends - size) > 0


def deal_spans(docs: DataFrame, parts: int, at_once: int = AT_ONCE) -> DataFrame:
    """Step 1, map side: rows of spans by anchor, and of repeats found within the batch by document; docs: (doc, tag, text)."""

    def settled(c: dict, data):
        """_firsts, by bytes: a span whose bytes are not those of the first with its hash gets another hash."""
        import numpy as np

        while True:
            s, new, other = _firsts(c)
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = np.flatnonzero(~new)
            unlike = again[_differ(data, s["at"][again], s["at"][first[again]], s["count"][again] + (LENGTH - 1))] if len(again) else again
            if not len(unlike):
                return s, new, other
            for i in unlike.tolist():
                span = data[s["at"][i] : s["at"][i] + int(s["count"][i]) + LENGTH - 1].tobytes()
                s["span"][i] = int.from_bytes(hashlib.blake2b(span, digest_size=8).digest(), "big")
            c = s

    def flush(spans, pending, out):
        import numpy as np

        sizes = np.array([len(b) for _, b, _, _ in pending])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(b for _, b, _, _ in pending), np.uint8)
        text, lo, count, place, anchor, span = spans.of(data, ends - sizes, ends)
        ids, tags, offsets = (np.array([p[i] for p in pending], np.int64) for i in (0, 2, 3))
        c = {"doc": ids[text], "tag": tags[text], "lo": (lo + offsets[text]).astype("i4"), "count": count, "place": place.astype("u1"), "anchor": anchor, "span": span, "at": lo + (ends - sizes)[text]}
        if not len(lo):
            return
        s, new, other = settled(c, data)
        s["count"] = s["count"].astype("u1")
        again = {k: s[k][other] for k in REPEAT_TYPES}
        _rows(REPEATS, (again["doc"] ^ again["tag"]) % parts, again, out)
        once = {k: s[k][new] for k in SPAN_TYPES}
        _rows(SPANS, (once["anchor"] % np.uint64(parts)).astype(np.int64), once, out)

    def work(batches):
        spans = Spans(at_once)
        for batch in batches:
            pending, size = [], 0
            for doc, tag, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = value.as_py().encode("utf-8", "surrogatepass")
                # a longer text comes in pieces that overlap by all but one byte of a string
                for at in range(0, max(1, len(text) - LENGTH + 1), at_once - LENGTH + 1):
                    piece = text[at : at + at_once]
                    if pending and size + len(piece) > at_once:
                        out = defaultdict(list)
                        flush(spans, pending, out)
                        yield pa.RecordBatch.from_pydict(_batch(out))
                        pending, size = [], 0
                    pending.append((doc, piece, tag, at))
                    size += len(piece)
            out = defaultdict(list)
            if pending:
                flush(spans, pending, out)
            yield pa.RecordBatch.from_pydict(_batch(out))

    return docs.mapInArrow(work, ROWS)


def settle_spans(spans: DataFrame, parts: int, open_limit: int) -> DataFrame:
    """Step 1, reduce side: the spans of candidates, by document."""

    def work(key, table):
        import numpy as np

        found = [unpack(b.as_py(), **SPAN_TYPES) for b in table["blob"]]
        c = {k: np.concatenate([f[k] for f in found]) for k in SPAN_TYPES}
        del found
        s, new, _ = _firsts(c)
        out = defaultdict(list)
        group = np.cumsum(np.concatenate([[True], np.diff(s["anchor"]) != 0])) - 1
        different = np.bincount(group, new)[group]
        # a span alone with its anchor can hold no string twice: one anchor has one place in it
        kept = np.bincount(group)[group] > 1
        own = {k: s[k][kept] for k in OPEN_TYPES if k not in ("many", "first")}
        own |= {"many": ((different > 1).astype("u1") + (different > open_limit))[kept].astype("u1"), "first": new[kept].astype("u1")}
        _rows(SPANS, (own["doc"] ^ own["tag"]) % parts, own, out)
        return pa.table(_batch(out))

    return spans.groupBy("part").applyInArrow(work, ROWS)


CONTEXTS = "part int, anchor long, doc long, tag long, lo int, count int, place int, digest binary, context binary"


def fetch(docs: DataFrame, opened: DataFrame, parts: int, whole: bool = False) -> DataFrame:
    """Step 2, map side: the digests of spans, and the bytes of the first of those that look equal, or with ``whole`` of all.

    They are dealt by anchor; different spans of salted anchors string by string.
    """

    def work(key, left, right):
        texts = {(doc, tag): text.as_py().encode("utf-8", "surrogatepass") for doc, tag, text in zip(left["doc"].to_pylist(), left["tag"].to_pylist(), left["text"], strict=True)}
        out = defaultdict(list)
        firsts: dict[bytes, tuple] = {}
        again = []

        def add(part, anchor, doc, tag, lo, count, place, digest, context):
            out["part"].append(part % parts)
            out["anchor"].append(anchor - (anchor >> 63 << 64))
            out["doc"].append(doc)
            out["tag"].append(tag)
            out["lo"].append(lo)
            out["count"].append(count)
            out["place"].append(place)
            out["digest"].append(digest)
            out["context"].append(context)

        for blob in right["blob"]:
            c = unpack(blob.as_py(), **OPEN_TYPES)
            for doc, tag, lo, count, place, anchor, many, first in zip(*(c[k].tolist() for k in ("doc", "tag", "lo", "count", "place", "anchor", "many", "first")), strict=True):
                span = texts[doc, tag][lo : lo + count + LENGTH - 1]
                add(anchor, anchor, doc, tag, lo, count, place, hashlib.blake2b(span, digest_size=16).digest(), span if whole or first and many == 1 else b"" if first and many == 2 else None)
                if first and many == 2 and not whole:
                    for at in range(count):
                        string = span[at : at + LENGTH]
                        earlier, later = sorted((firsts.get(string, (doc, tag, lo + at)), (doc, tag, lo + at)))
                        firsts[string] = earlier
                        if earlier != later:
                            again.append(later)
        # of strings of these texts only the first meets those of others; the rest are known to repeat
        for string, (doc, tag, at) in firsts.items():
            digest = hashlib.blake2b(string, digest_size=16).digest()
            own = int.from_bytes(digest[:8], "big")
            add(own, own, doc, tag, at, 1, 0, digest, string)
        for doc, tag, at in again:
            add(doc ^ tag, 0, doc, tag, at, 1, 0, None, None)
        types = {"part": pa.int32(), "anchor": pa.int64(), "doc": pa.int64(), "tag": pa.int64(), "lo": pa.int32(), "count": pa.int32(), "place": pa.int32(), "digest": pa.binary(), "context": pa.binary()}
        return pa.table({k: pa.array(out[k], t) for k, t in types.items()})

    return _by_doc(docs, parts).cogroup(opened.groupBy("part")).applyInArrow(work, CONTEXTS)


def _by_doc(docs: DataFrame, parts: int):
    return docs.withColumn("part", F.pmod(F.col("doc").bitwiseXOR(F.col("tag")), F.lit(parts)).cast("int")).groupBy("part")


def repeats_of_anchor(members: list[tuple]) -> list[tuple]:
    """(doc, tag, lo, count) of strings that start earlier in another span of one anchor.

    members: (doc, tag, lo, place, context).  A string j bytes before the
    anchor is told by j, the j bytes before and the LENGTH - j from it on.
    """
    members = sorted(members)
    before = [m[4][: m[3]] for m in members]
    after = [m[4][m[3] : m[3] + LENGTH] for m in members]
    least = [max(0, LENGTH - len(a)) for a in after]
    order = deep_shallow(after, SEED if members[0][3] or len(after[0]) < LENGTH else 0)
    shared = [0] + [common_prefix(after[x], after[y]) for x, y in zip(order, order[1:], strict=False)]
    near = [max(shared[k], shared[k + 1] if k + 1 < len(order) else 0) for k in range(len(order))]
    found = []
    # m is the smallest j at which a member may equal a neighbour in the order
    for j in range(max(LENGTH - max(near), min(least)), max(m[3] for m in members) + 1):
        firsts: dict[bytes, int] = {}
        group: list[list[int]] = []
        for k, i in enumerate(order):
            if not k or shared[k] < LENGTH - j:
                group.append([])
            if least[i] <= j <= members[i][3] and near[k] >= LENGTH - j:
                group[-1].append(i)
        for interval in group:
            if len(interval) < 2:
                continue
            firsts.clear()
            for i in sorted(interval):
                if firsts.setdefault(before[i][len(before[i]) - j :], i) != i:
                    doc, tag, lo, place, _ = members[i]
                    found.append((doc, tag, lo + place - j, 1))
    return found


def repeats_of_leaves(rows: list[tuple], found: list[tuple]) -> bool:
    """Adds the repeats among the spans (doc, tag, lo, count, place, digest, context) of one anchor to ``found``; whether they could be told.

    They can't where a span that looked equal to another has a digest of its
    own, and no bytes here to be sorted by.  Spans with empty bytes are salted:
    only those with one digest are told here, their strings have anchors of
    their own.
    """
    leaves: dict[bytes, tuple] = {}
    bytes_of: dict[bytes, bytes] = {}
    again = []
    for r in sorted(rows, key=lambda r: r[:3]):
        if r[5] is None or leaves.setdefault(r[5], r)[:3] != r[:3]:
            again.append(r[:4])
        if r[6] is not None:
            bytes_of[r[5]] = r[6]
    if len(leaves) > 1 and len(bytes_of) < len(leaves):
        return False
    found += again
    if len(leaves) > 1 and all(bytes_of.values()):
        found += repeats_of_anchor([(*r[:3], r[4], bytes_of[d]) for d, r in leaves.items()])
    return True


def settle_strings(contexts: DataFrame, parts: int) -> DataFrame:
    """Step 2, reduce side: repeats by document, and spans that are to be fetched with their bytes."""

    def work(key, table):
        import numpy as np

        order = np.argsort(table["anchor"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        anchors = table["anchor"].to_numpy()
        rows = list(zip(*(table[c].to_pylist() for c in ("doc", "tag", "lo", "count", "place", "digest", "context")), strict=True))
        cuts = [0, *(np.flatnonzero(np.diff(anchors)) + 1).tolist(), len(rows)]
        found, untold = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = rows[a:b]
            if not repeats_of_leaves(own, found):
                untold += [(*r[:5], int(anchors[a]) % 2**64, 1, 0) for r in own]
        out = defaultdict(list)
        for kind, members, types in ((REPEATS, found, REPEAT_TYPES), (SPANS, untold, OPEN_TYPES)):
            if members:
                names = ("doc", "tag", "lo", "count", "place", "anchor", "many", "first")[: len(members[0])]
                columns = {k: np.array(v, "u8" if k == "anchor" else "i8").astype(types[k]) for k, v in zip(names, zip(*members, strict=True), strict=True)}
                _rows(kind, (columns["doc"] ^ columns["tag"]) % parts, columns, out)
        return pa.table(_batch(out))

    return contexts.groupBy("part").applyInArrow(work, ROWS)


def without(text: bytes, los: list[int], counts: list[int]) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the maximal removed runs."""
    kept, removed, runs, at, end = [], 0, 0, 0, -1
    for lo, count in sorted(zip(los, counts, strict=True)):
        stop = lo + count + LENGTH - 1
        if lo > end:
            kept.append(text[max(at, 0) : lo])
            runs += 1
            removed += stop - lo
            end = stop
        elif stop > end:
            removed += stop - end
            end = stop
        at = end
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def passage_dedup(docs: DataFrame, part_bytes: int = PART_BYTES, open_limit: int = OPEN, with_kept: bool = False, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs`` (doc_id, text), and kept (binary) if asked for.

    Texts are UTF-8 bytes; a null text is empty.  A null doc_id comes after all
    others.  Rows that repeat a doc_id and a text are one document, and all of
    them lose the same bytes; with other texts they are ordered by a hash of
    the text.  Texts of fewer than LENGTH bytes lose nothing.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    docs = named(docs.select("doc_id", "text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = _prime(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes)))
    dealt = scratch.write(deal_spans(docs, parts, at_once), "dealt")
    opened = scratch.write(settle_spans(dealt.where(F.col("kind") == SPANS), parts, open_limit), "opened")
    repeats = scratch.write(dealt.where(F.col("kind") == REPEATS), "repeats", slim=True)
    scratch.drop("dealt")
    free_shuffles(spark)
    rounds = 0
    while not rounds or opened.head(1):
        strings = scratch.write(settle_strings(fetch(docs, opened, parts, whole=rounds > 0), parts), f"strings_{rounds}")
        free_shuffles(spark)
        repeats = repeats.unionByName(strings.where(F.col("kind") == REPEATS))
        opened, rounds = strings.where(F.col("kind") == SPANS), rounds + 1
    fields = [T.StructField("doc", T.LongType()), T.StructField("named", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    if with_kept:
        fields.append(T.StructField("kept", T.BinaryType()))

    def work(key, left, right):
        import numpy as np

        found = [unpack(b.as_py(), **REPEAT_TYPES) for b in right["blob"]]
        c = {k: np.concatenate([f[k] for f in found] or [np.zeros(0, t)]) for k, t in REPEAT_TYPES.items()}
        order = np.lexsort((c["lo"], c["tag"], c["doc"]))
        c = {k: v[order] for k, v in c.items()}
        first = np.flatnonzero(np.concatenate([[True], (np.diff(c["doc"]) != 0) | (np.diff(c["tag"]) != 0)])) if len(order) else []
        ends = [*first[1:], len(order)]
        place = {(int(c["doc"][a]), int(c["tag"][a])): (a, b) for a, b in zip(first, ends, strict=False)}
        out = defaultdict(list)
        for doc, tag, value in zip(left["doc"].to_pylist(), left["tag"].to_pylist(), left["text"], strict=True):
            text = value.as_py().encode("utf-8", "surrogatepass")
            a, b = place.get((doc, tag), (0, 0))
            kept, removed, runs = without(text, c["lo"][a:b].tolist(), c["count"][a:b].tolist())
            out["n_bytes"].append(len(text))
            out["n_removed"].append(removed)
            out["n_spans"].append(runs)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        columns = {"doc": left["doc"], "named": pa.array([tag < 2**62 for tag in left["tag"].to_pylist()], pa.bool_()), **{k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")}, "kept_sha256": pa.array(out["kept_sha256"], pa.string())}
        return pa.table(columns | ({"kept": pa.array(out["kept"], pa.binary())} if with_kept else {}))

    out = _by_doc(docs, parts).cogroup(repeats.groupBy("part")).applyInArrow(work, T.StructType(fields))
    return out.select(F.when(F.col("named"), F.col("doc")).cast(id_type).alias("doc_id"), *(f.name for f in fields[2:]))


def _prime(n: int) -> int:
    """The least prime from n on: ids that are all multiples of something still spread over the parts."""
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n
