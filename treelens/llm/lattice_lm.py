"""Language-model scoring by the likelihood of a subword lattice.

The scores of an existing piece vocabulary weight every way to cut a word into
pieces; the forward recursion sums over all of them in log space, and gives the
word's marginal probability.  A document's score is the sum over its words and
its end: the marginal probability of its text.

The pieces' probabilities are those of their ranks, or are learned from the
words of the training documents: forward and backward sums give how often each
piece is expected in them (Baum and Welch), added up over all words once a
round; what the driver gets is one number a piece.

Counts of words in the training documents stand beside it: they give the base
score, and a second score whose lattices have one more arc, across the whole
word, P(word) = (count + distinct * marginal) / (tokens + distinct).  A third
one mixes that with the words that the document has had so far.

No worker holds the words of the corpus.  Each task reads its texts once, as
chunks of bounded size: the chunk's distinct words with their counts, and its
documents as places in that list.  Words of all chunks are summed up by an
aggregation, and each distinct word goes through the recursion once; joined
back to (chunk, place), the answers meet the chunk's documents.  What moves is
the words of chunks and places, never a text.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .pieces import BYTE, MARK, NORMAL

#: Bytes of text in a chunk, but for a longer text, and bytes that are cut into words at once.
CHUNK_BYTES, AT_ONCE = 24_000_000, 1_000_000
#: Pieces' probabilities from their ranks, which the vocabulary's scores are: 1 / (rank + SHIFT), as Zipf and Mandelbrot have it.
SHIFT = 2.7
#: Probability of the end of a text, and of all single bytes together.
END_MASS, BYTE_MASS = 0.002, 0.001
#: The end, among words: no word is empty.
END = b""
HELD_OUT = 10
#: Share of the ranks' probabilities in those that are learned: no piece is impossible.
PRIOR = 0.001
#: Characters of a text that are summed up without logs; a longer one is learned from in stretches of that, and scored in logs.
STRETCH, LEAST = 32, 1e-280
#: Share of the document's own earlier words in the third score, and tokens whose earlier places are counted at once.
CACHE, CACHED_AT_ONCE = 0.1, 500_000


class Lattice:
    def __init__(self, data: bytes, learned: list[float] | None = None):
        """``learned``: logs of the pieces' probabilities, as ``learn`` gives them, instead of those by rank."""
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        weights = {p.piece: 1 / (SHIFT - p.score) for p in proto.pieces if p.type == NORMAL}
        scale = (1 - END_MASS - BYTE_MASS) / sum(weights.values())
        self.logs = {p: math.log(w * scale) for p, w in weights.items()} if learned is None else dict(zip(weights, learned, strict=True))
        self.byte = math.log(BYTE_MASS / sum(p.type == BYTE for p in proto.pieces))
        self.automaton = ahocorasick.Automaton()
        self.numbers = ahocorasick.Automaton()
        for n, (p, log) in enumerate(self.logs.items()):
            self.automaton.add_word(p, (len(p), log))
            self.numbers.add_word(p, n)
        self.automaton.make_automaton()
        self.numbers.make_automaton()

    def known(self, text: str) -> float:
        """Log of the sum over all ways to cut a text of known characters."""
        alpha = [-math.inf] * (len(text) + 1)
        alpha[0] = 0.0
        for end, (n, log) in self.automaton.iter(text):
            new, old = alpha[end + 1 - n] + log, alpha[end + 1]
            if new > old:
                new, old = old, new
            alpha[end + 1] = old + math.log1p(math.exp(new - old)) if new > -math.inf else old
        return alpha[-1]

    def word(self, word: bytes) -> float:
        """Natural log of a word's marginal probability; a character without a piece is its bytes."""
        if word == END:
            return math.log(END_MASS)
        text = MARK + word.decode("utf-8", "surrogatepass")
        if all(c in self.logs for c in text):
            return self.known(text)
        total, run = 0.0, ""
        for c in text:
            if c in self.logs:
                run += c
                continue
            total += (self.known(run) if run else 0.0) + self.byte * len(c.encode("utf-8", "surrogatepass"))
            run = ""
        return total + (self.known(run) if run else 0.0)

    def words(self, words: list[bytes]) -> list[float]:
        """``word`` of each; those of common length go through the recursion side by side."""
        import numpy as np

        short = [n for n, w in enumerate(words) if w != END and len(w) < STRETCH]
        out = [0.0] * len(words)
        for n in set(range(len(words))).difference(short):
            out[n] = self.word(words[n])
        if short:
            sums = Arcs(self, [MARK + words[n].decode("utf-8", "surrogatepass") for n in short], self.byte).forward()[1]
            logs = np.log(np.maximum(sums, LEAST)).tolist()
            for n, enough, log in zip(short, (sums > LEAST).tolist(), logs, strict=True):
                out[n] = log if enough else self.word(words[n])
        return out

    def expected(self, words: list[bytes], counts: list[int]):
        """How often each piece, by number, is expected in words with their counts."""
        texts, weights = [], []
        for w, c in zip(words, counts, strict=True):
            if w != END:
                text = MARK + w.decode("utf-8", "surrogatepass")
                for at in range(0, len(text), STRETCH):
                    texts.append(text[at : at + STRETCH])
                    weights.append(c)
        return Arcs(self, texts, 0.0).expected(weights)


class Arcs:
    """All arcs of the lattices of short texts, which lie one behind the other and are gone through side by side, an end at a time."""

    def __init__(self, lattice: Lattice, texts: list[str], byte: float):
        """byte: log of what a byte of a character without a piece costs; it cancels out of what is expected."""
        from itertools import chain

        import numpy as np

        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "\n".join([*texts, ""])
        strange = set(joined) - lattice.logs.keys() - {"\n"}
        odd = []
        if strange:
            odd = [(n, byte * len(c.encode("utf-8", "surrogatepass"))) for n, c in enumerate(joined) if c in strange]
            # no piece has a line feed
            joined = joined.translate(dict.fromkeys(map(ord, strange), "\n"))
        found = np.fromiter(chain.from_iterable(lattice.numbers.iter(joined)), np.int64).reshape(-1, 2)
        logs, sizes = np.array(list(lattice.logs.values())), np.fromiter(map(len, lattice.logs), np.int64, len(lattice.logs))
        end = found[:, 0] + 1
        self.size, self.pieces = len(joined), len(logs)
        self.first = np.cumsum(lengths + 1) - lengths - 1
        self.last = self.first + lengths
        ends = np.concatenate([end, np.array([n + 1 for n, _ in odd], np.int64)])
        starts = np.concatenate([end - sizes[found[:, 1]], np.array([n for n, _ in odd], np.int64)])
        # a character without a piece counts as one piece more
        piece = np.concatenate([found[:, 1], np.full(len(odd), self.pieces)])
        weight = np.exp(np.concatenate([logs[found[:, 1]], np.array([log for _, log in odd])]))
        offset = ends - np.repeat(self.first, lengths + 1)[ends - 1]
        order = np.argsort(offset.astype(np.int16), kind="stable")
        self.starts, self.ends, self.piece, self.weight = starts[order], ends[order], piece[order], weight[order]
        bounds = np.searchsorted(offset[order], np.arange(1, lengths.max(initial=0) + 2))
        self.steps = [slice(a, b) for a, b in zip(bounds, bounds[1:], strict=False)]

    def forward(self):
        """Sums up to each place, and of each text as a whole."""
        import numpy as np

        alpha = np.zeros(self.size + 1)
        alpha[self.first] = 1.0
        for s in self.steps:
            np.add.at(alpha, self.ends[s], alpha[self.starts[s]] * self.weight[s])
        return alpha, alpha[self.last]

    def expected(self, counts: list[int]):
        import numpy as np

        alpha, sums = self.forward()
        beta, out = np.zeros(self.size + 1), np.zeros(self.pieces + 1)
        beta[self.last] = np.array(counts, float) / np.maximum(sums, LEAST)
        for s in reversed(self.steps):
            behind = self.weight[s] * beta[self.ends[s]]
            np.add.at(beta, self.starts[s], behind)
            out += np.bincount(self.piece[s], behind * alpha[self.starts[s]], self.pieces + 1)
        return out[:-1]


def learn(vocabulary: DataFrame, data: bytes, rounds: int) -> list[float] | None:
    """Logs of the pieces' probabilities after some rounds over all words (word, count) of training documents; None without a round."""
    import numpy as np

    ranks, learned = np.exp(np.array(list(Lattice(data).logs.values()))), None
    for _ in range(rounds):
        now = learned

        def expect(batches):
            lattice, total = Lattice(data, now), np.zeros(len(ranks))  # noqa: B023
            for batch in batches:
                total += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["piece", "n"])

        rows = vocabulary.where("count > 0").select("word", "count").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(ranks))
        counts[rows["piece"].to_numpy()] = rows["n"].to_numpy()
        share = counts / counts.sum() * ranks.sum() if counts.sum() else ranks
        # rounded, as sums come in any order
        learned = np.round(np.log((1 - PRIOR) * share + PRIOR * ranks), 9).tolist()
    return learned


def earlier(tokens, sizes):
    """Of each token of documents with these sizes: how often it was in its document before, and the tokens before it."""
    import numpy as np

    document = np.repeat(np.arange(len(sizes)), sizes)
    before = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((tokens, document))
    a, b = document[order], tokens[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    seen = np.empty(len(tokens), np.int64)
    seen[order] = np.arange(len(tokens)) - np.repeat(new, np.diff(np.append(new, len(tokens))))
    return seen, before


def cached(mixed, tokens, sizes):
    """Sums a document of log10 probabilities of words, each mixed with its share of the words before it."""
    import numpy as np

    out, at, first = np.empty(len(sizes)), 0, 0
    while first < len(sizes):
        stop = max(first + 1, first + int(np.searchsorted(np.cumsum(sizes[first:]), CACHED_AT_ONCE, "right")))
        own, n = sizes[first:stop], int(sizes[first:stop].sum())
        places = tokens[at : at + n]
        seen, before = earlier(places, own)
        log = mixed[places] + np.where(before > 0, math.log10(1 - CACHE), 0.0)
        again = np.flatnonzero(seen)
        log[again] = np.log10(10 ** log[again] + CACHE * seen[again] / before[again])
        out[first:stop] = np.add.reduceat(log, np.cumsum(own) - own)
        first, at = stop, at + n
    return out


GAP = re.compile(rb"[ \t-\r]")


def blocks(text: bytes):
    """Lists of a text's words, A-Z lower-cased.  Bytes split and lower just as the contract has it."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + AT_ONCE)
        stop = gap.start() if gap else len(text)
        yield text[at:stop].lower().split()
        at = stop


class Places(dict):
    """Words, numbered as they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Chunk:
    """The documents of a chunk: ids, held_out, tokens of each, and all of them as places in the list of words."""

    def __init__(self):
        self.places, self.ids, self.held, self.sizes, self.tokens, self.bytes = Places(), [], [], [], [], 0

    def add(self, doc_id, held_out: bool, text: bytes) -> None:
        import numpy as np

        own = [np.fromiter(map(self.places.__getitem__, words), np.uint32, len(words)) for words in blocks(text)]
        own.append(np.array([self.places[END]], np.uint32))
        self.ids.append(doc_id)
        self.held.append(held_out)
        self.sizes.append(sum(map(len, own)))
        self.tokens += own
        self.bytes += len(text)

    def row(self, number: int, id_type) -> pa.RecordBatch:
        """One row: number, words, counts in training documents, ids, held_out, sizes and the compressed places."""
        import numpy as np
        import zstandard

        every = np.concatenate(self.tokens)
        train = every[~np.repeat(np.array(self.held), self.sizes)]
        counts = np.bincount(train, minlength=len(self.places))
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        columns = {
            "chunk": pa.array([number], pa.int64()), "words": one(list(self.places), pa.binary()), "counts": one(counts, pa.int64()), "ids": one(self.ids, id_type),
            "held_out": one(self.held, pa.bool_()), "sizes": one(self.sizes, pa.int64()), "places": pa.array([zstandard.compress(every.tobytes(), 1)], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)


def lm_score(docs: DataFrame, model_path: str, chunk_bytes: int = CHUNK_BYTES, rounds: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score, cached_score of each row of ``docs`` (doc_id, text).

    score is the marginal of the lattice of pieces, whose probabilities go by
    rank, or are learned in so many ``rounds``; mixed_score that of lattices
    with the arcs of counted words, and cached_score takes a word by CACHE from
    the words before it in its document.  Documents with crc32(doc_id) mod 10 = 0 are held out;
    the others train.  A null doc_id counts as the empty string, which is held
    out; a null text is empty and has the end only.  Rows that repeat a doc_id
    count and are scored each.  Without any training token the mixed score is
    the lattice's.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    with open(model_path, "rb") as f:
        data = f.read()
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0
    id_type = docs.schema["doc_id"].dataType

    def cut(batches):
        from pyspark import TaskContext

        # tasks number their chunks apart from each other
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk()
        for batch in batches:
            own = batch.schema.field(0).type
            for doc_id, value, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = (value.as_py() or "").encode("utf-8", "surrogatepass")
                if chunk.ids and chunk.bytes + len(text) > chunk_bytes:
                    yield chunk.row(number, own)
                    chunk, number = Chunk(), number + 1
                chunk.add(doc_id, out, text)
        if chunk.ids:
            yield chunk.row(number, own)

    fields = [("chunk", T.LongType()), ("words", T.ArrayType(T.BinaryType())), ("counts", T.ArrayType(T.LongType())), ("ids", T.ArrayType(id_type)), ("held_out", T.ArrayType(T.BooleanType())), ("sizes", T.ArrayType(T.LongType())), ("places", T.BinaryType())]
    cuts = docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(cut, T.StructType([T.StructField(*f) for f in fields]))
    chunks = scratch.write(cuts, "chunks")

    summed = chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("count"))
    counted = scratch.write(summed, "vocabulary", slim=True)
    train, distinct = counted.agg(F.sum("count"), F.count_if(F.col("count") > 0)).first()
    train = train or 0
    learned = learn(counted, data, rounds)

    def marginals(batches):
        lattice = Lattice(data, learned)
        for batch in batches:
            logs = lattice.words(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())], names=["word", "count", "log"])

    vocabulary = counted.mapInArrow(marginals, "word binary, count long, log double")

    def score(key, left, right):
        import numpy as np
        import zstandard

        order = np.argsort(right["pos"].to_numpy())
        c, log = right["count"].to_numpy()[order], right["log"].to_numpy()[order]
        base = np.log10((c + 0.1) / (train + 0.1 * (distinct + 1)))
        alone = log / math.log(10)
        mixed = np.log10((c + distinct * np.exp(log)) / (train + distinct)) if train else alone
        # a marginal too small for a float is taken by its log
        mixed = np.where(np.isfinite(mixed), mixed, alone + math.log10(max(1, distinct) / max(1, train + distinct)))
        one = lambda name: left[name].combine_chunks().flatten()
        sizes = one("sizes").to_numpy()
        starts = np.cumsum(sizes) - sizes
        every = np.frombuffer(zstandard.decompress(left["places"][0].as_py()), np.uint32)
        out = {"doc_id": one("ids"), "held_out": one("held_out"), "n_tokens": pa.array(sizes), "n_known": pa.array(np.add.reduceat((c > 0)[every], starts, dtype=np.int64)), "train_tokens": pa.array(np.full(len(sizes), train, np.int64))}
        sums = {name: pa.array(np.add.reduceat(values[every], starts)) for name, values in (("base_score", base), ("score", alone), ("mixed_score", mixed))}
        return pa.table(out | sums | {"cached_score": pa.array(cached(mixed, every, sizes))})

    # both sides of the join are plain shuffles, so that Spark may divide a word that all chunks have
    asked = chunks.select(F.col("chunk").alias("asker"), F.posexplode("words").alias("pos", "word"))
    answers = asked.join(vocabulary.hint("merge"), "word").select("asker", "pos", "count", "log")
    fields = [T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "mixed_score", "cached_score"))]
    own = chunks.select("chunk", "ids", "held_out", "sizes", "places")
    return own.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(score, T.StructType(fields))
