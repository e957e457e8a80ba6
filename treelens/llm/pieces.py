"""Encoding and decoding with a BPE piece vocabulary, exactly as its library does, by backtracking.

The usual encoder merges pairs of the whole text in order of score.  This one
goes from left to right instead: it takes the longest piece at the current
position (found by an Aho-Corasick automaton), keeps it if it is compatible
with the piece before, and else tries the next shorter one.  Two pieces are
compatible if merging their joint characters gives these two again; a row of
pieces is the encoding just if every two neighbours are compatible.  Where no
piece fits, the last one is taken back and the position is cleared in a
bitfield, so that no position fails twice.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The mark that stands for a space in pieces.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: No piece goes on across the start of a run of MARK, nor across a line feed: texts, with spaces for MARK, fall into these.
SEGMENT = re.compile("\n| *[^ \n]+| +")
#: Encoded segments, and pairs of pieces, that a worker remembers, and the longest of the segments; a full memory is emptied.
MEMORY, MEMORY_LENGTH = 300_000, 48
#: Ids after which a worker hands on what it has encoded, so that its memory doesn't follow Spark's batches.
IDS_AT_ONCE = 250_000


class PieceModel(dict):
    """The vocabulary in the bytes of a model file; as a dict, the ids of segments met so far, as bytes of an array."""

    def __init__(self, data: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        super().__init__()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.name != "identity" or norm.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("needs a BPE model with byte fallback that leaves its input as it is")
        self.prefix = " " if norm.add_dummy_prefix else ""
        self.names = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.score):
            raise ValueError("has pieces that go across words or lines")
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.controls = {i for i, t in enumerate(self.types) if t == CONTROL}
        self.end = next(i for i, p in enumerate(proto.pieces) if p.piece == "</s>")
        self.texts = [str(i) for i in range(len(self.names))]
        self.surface = [self._surface(i) for i in range(len(self.names))]
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            self.automaton.add_word(p, (len(p) - 1, self.ids[p]))
        self.automaton.make_automaton()
        self.lengths = list(map(len, self.names))
        #: Of each piece the longest that is a proper prefix, or -1.
        self.shorter = [next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), -1) for p in self.names]
        #: Whether two ids fit, by first * number of pieces + second.
        self.pair: dict[int, bool] = {}
        self.characters = {p for p in self.score if len(p) == 1}
        if not self.characters.issuperset("".join(self.score)):
            raise ValueError("has pieces with characters that are no pieces")
        known = "".join(map(re.escape, self.characters))
        self.runs = re.compile(f"([{known}]+)|([^{known}]+)")

    def _surface(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.names[i][3:5], 16)])
        if self.types[i] == CONTROL:
            return b""
        return (" ⁇ " if self.types[i] == UNKNOWN else self.names[i].replace(MARK, " ")).encode()

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text of known characters, merged pair by pair: best score first, leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, last: int, piece: int) -> bool:
        """Whether merging gives these two again, or, with -1 for the last one, the piece alone."""
        if len(self.pair) >= MEMORY:
            self.pair.clear()
        parts = [self.names[i] for i in (last, piece) if i >= 0]
        found = self.pair[last * len(self.names) + piece] = self.merge("".join(parts)) == parts
        return found

    def backtrack(self, text: str) -> list[int]:
        """The ids of the pieces of a text of known characters."""
        longest = [-1] * len(text)
        for end, (back, i) in self.automaton.iter(text):
            longest[end - back] = i  # ends only rise, so that the last piece at a start is the longest
        size = len(text)
        alive = bytearray(b"\xff" * (size // 8 + 1))
        out: list[int] = []
        pairs, fits, shorter, lengths, width = self.pair, self.fits, self.shorter, self.lengths, len(self.names)
        last, pos, piece = -1, 0, longest[0]
        while pos < size:
            while piece >= 0:
                end = pos + lengths[piece]
                if alive[end >> 3] >> (end & 7) & 1:
                    if (known := pairs.get(last * width + piece)) is None:
                        known = fits(last, piece)
                    if known:
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                last, pos = piece, end
                piece = longest[pos] if pos < size else -1
            else:
                alive[pos >> 3] &= ~(1 << (pos & 7)) & 0xFF
                piece = out.pop()
                pos -= lengths[piece]
                last = out[-1] if out else -1
        return out

    def __missing__(self, segment: str) -> bytes:
        """The ids of a segment; characters without a piece become their bytes."""
        marked = segment.replace(" ", MARK)
        if self.characters.issuperset(marked):
            ids = self.backtrack(marked)
        else:
            ids = []
            for known, other in self.runs.findall(marked):
                ids += self.backtrack(known) if known else map(self.bytes.__getitem__, other.encode("utf-8", "surrogatepass"))
        found = array("i", ids).tobytes()
        if len(segment) <= MEMORY_LENGTH:
            if len(self) >= MEMORY:
                self.clear()
            self[segment] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids with the end id; the empty text has the end id only."""
        spaced = (self.prefix + text.replace(MARK, " ")) if text else ""
        ids = array("i", b"".join(map(self.__getitem__, SEGMENT.findall(spaced)))).tolist()
        ids.append(self.end)
        return ids

    def decode(self, ids) -> str:
        """The text of ids.  Control ids have none; one space at the start stands for the mark that encoding adds."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        if self.prefix and raw[:1] == b" " and not self._byte_first(ids):
            raw = raw[1:]
        try:
            if self.controls.isdisjoint(ids[:-1]):
                return raw.decode()
        except UnicodeDecodeError:
            pass
        # bytes on both sides of a control id don't make one character
        parts, start = [], 0
        for i in [*(k for k, x in enumerate(ids) if self.types[x] == CONTROL), len(ids)]:
            parts += self._one_by_one(b"".join(map(self.surface.__getitem__, ids[start:i])))
            start = i
        text = "".join(parts)
        return text[1:] if self.prefix and text[:1] == " " and not self._byte_first(ids) else text

    def _byte_first(self, ids) -> bool:
        return next((self.types[i] == BYTE for i in ids if self.types[i] != CONTROL), False)

    @staticmethod
    def _one_by_one(raw: bytes):
        """Each byte that starts no valid character becomes a replacement character."""
        i = 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    yield raw[i : i + n].decode()
                    i += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                yield "�"
                i += 1


_loaded: dict[str, PieceModel] = {}


def load(data: bytes) -> PieceModel:
    """The model of a worker, which outlives its tasks."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceModel(data)
    return _loaded[key]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def tokenize(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """``docs`` (doc_id, text and any others) as doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    A null text is encoded as the empty one.  Null and repeated doc_ids pass
    through.  Every row is encoded by itself, in batches that Arrow bounds by
    rows and bytes, so that there is no shuffle; what is encoded goes on after
    IDS_AT_ONCE ids, whatever the batch.  The vocabulary is read by the
    driver, and sent to the workers with the code (0.5 MB, whatever the data).
    """
    with open(model_path, "rb") as f:
        data = f.read()
    id_type = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def work(batches):
        model = load(data)
        for batch in batches:
            start, counts, shas, decoded, flat, total = 0, [], [], [], array("i"), 0
            for text in batch.column(1):
                ids = model.encode(text.as_py() or "")
                counts.append(len(ids))
                shas.append(hashlib.sha256(" ".join(map(model.texts.__getitem__, ids)).encode()).hexdigest())
                decoded.append(digest(model.decode(ids)))
                if with_ids:
                    flat.extend(ids)
                total += len(ids)
                if total < IDS_AT_ONCE and start + len(counts) < batch.num_rows:
                    continue
                arrays = [batch.column(0).slice(start, len(counts)), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
                    arrays.append(pa.ListArray.from_arrays(pa.array([0, *accumulate(counts)], pa.int32()), values))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])
                start, counts, shas, decoded, flat, total = start + len(counts), [], [], [], array("i"), 0

    return docs.select("doc_id", "text").mapInArrow(work, T.StructType(fields))
