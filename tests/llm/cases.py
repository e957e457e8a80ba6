"""Rows that every operator has to live with, and a small corpus with copies."""

import random
import re

SPACES = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "é É ß ſ K 季 😀"), (7, "a\n\nb\r\n\x0bc"), (8, "a\n\nb\r\n\x0bc"), (8, "a\n\nb\r\n\x0bc"),
    (8, "another text of a repeated id"), (None, "one"), (None, None), (9, "x" * 30_000), (10, "x" * 30_000), (11, "ab " * 9_000), (12, "▁ ▁▁  three   spaces"), (-5, "one"),
]


def corpus(n=120, seed=3, words=400):
    """Documents of invented words with exact copies, near copies, shared lines and shared passages."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstuéß") for _ in range(r.randint(1, 9))) for _ in range(words)]
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k)).capitalize() + "."
    common, passage = [sentence(8) for _ in range(4)], sentence(60)
    out = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.12:
            text = r.choice(out)[1]
        elif out and kind < 0.3:
            w = r.choice(out)[1].split(" ")
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w)
        else:
            lines = [sentence(r.randint(3, 40)) for _ in range(r.randint(1, 6))]
            if kind > 0.6:
                lines.insert(r.randrange(len(lines) + 1), r.choice(common))
            if kind > 0.8:
                lines.insert(r.randrange(len(lines) + 1), sentence(3) + " " + passage + " " + sentence(2))
            text = "\n".join(lines)
        out.append((i * 3, text))
    r.shuffle(out)
    return out


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate(LOWER)
