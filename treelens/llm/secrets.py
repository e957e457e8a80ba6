"""Secret scans: three patterns, and strings in a sensitive context that zstandard can't predict.

Novelty: a candidate is a long token on the line of a sensitive word, a short
distance behind it.  The text on both sides of it is compressed with it and
without it, by a compressor primed with a dictionary of common identifiers;
what it adds, in bytes a character, is its novelty.  Names and words that the surrounding
code or the dictionary has add next to nothing; random keys add almost all of
their characters.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: One of these is in each match of ASSIGN; looked for in lower case, which is much faster.
STEMS = ("passw", "secret", "token", "api")
#: A sensitive word, a few signs that bind it to a value, and the value.
SENSITIVE = re.compile(
    r"""(?i:password|passwd|passphrase|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|signing[_-]?key|credentials?|authorization|bearer)["']?(?:\x20*(?:[:=]|=>)\x20*|\x20is\x20)["'(]{0,2}([A-Za-z0-9+/_.=~-]{12,})""",
    re.ASCII,
)
#: A sensitive stem anywhere in a name, and the tails that make it a longer name (_key, _value, Id, s).
STEM = re.compile(
    r"""(?:(?i:passw(?:or)?d|passphrase|passcode|pwd|secret|token|credential|authori[sz]ation|authentication|(?<![a-z])auth(?![a-z])|bearer"""
    r"""|(?:api|access|private|signing|signature|encryption|master|session|account|client|service|shared|storage|license|deploy|ssh|auth|app|host)\x20?key|[a-z0-9][_-]key)(?![a-z]{4})|(?<=[a-z0-9])Key(?![a-z]))"""
    r"""(?:(?i:s|[_-]?(?:key|value|id|token|secret|string|text|hash|data|base64|b64|hex|name|header|prod|dev|test))(?![a-z])|[0-9]{1,2}(?![A-Za-z0-9]))*+""",
    re.ASCII,
)
MORE_STEMS = ("passphrase", "passcode", "pwd", "key", "credential", "auth", "bearer")
#: Characters on the line, from the end of a stem's name, in which a long token starts.
DISTANCE, LONG = 48, 12
TOKEN = re.compile(r"[A-Za-z0-9+/_.=~-]{12,}", re.ASCII)
#: The name in name=value, which is one token by its characters.
NAME = re.compile(r"[_.~=-]*(?:[A-Za-z_][A-Za-z0-9_.-]{0,39}=+)?(?=[A-Za-z0-9+/_.~-])", re.ASCII)
SIGNS = re.compile(r"[+/_.=~-]+")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]|[0-9]+")
#: The identifier dictionary that primes the compressor.
IDENTIFIERS = (
    "password passwd secret token api_key apikey private_key access_key client_id client_secret authorization bearer credentials "
    "example_password your_password_here changeme_password placeholder_token your_api_key_here insert_token_here my_secret_value "
    "os.environ.get os.getenv process.env config.settings.get self.config request.headers response.json application/json "
    "get_token_from_vault load_credentials read_secret_from_file access_token_secret default_access_key_id refresh_token "
    "AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY GITHUB_TOKEN DATABASE_PASSWORD SECRET_KEY undefined null None true false "
    "0123456789 00000000000000000000 1234567890123456 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx"
).encode()
#: Characters of text on either side of a candidate that the compressor sees, without the candidate's own repeats.
CONTEXT = 2_048
#: Compressed bytes a character from which a candidate is reported.
NOVELTY = 0.6
#: From so many characters on zstandard shortens small alphabets without finding any match; so much of their entropy is asked for instead.
CODED, SHARE = 64, 0.95
ALPHABETS = ((re.compile(r"[0-9]+"), 10), (re.compile(r"[0-9A-F]+|[0-9a-f]+"), 16), (re.compile(r"[a-z]+|[A-Z]+"), 26))


def needed(token: str, threshold: float) -> float:
    """Compressed bytes a character from which a token is reported: ``threshold``, or less where its alphabet has no more."""
    if len(token) >= CODED:
        for alphabet, size in ALPHABETS:
            if alphabet.fullmatch(token):
                return min(threshold, SHARE * math.log2(size) / 8)
    return threshold


class Novelty:
    def __init__(self, identifiers: bytes = IDENTIFIERS, level: int = 9):
        import zstandard

        primed = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zstd = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False)

    def marginal(self, text: str, start: int, end: int) -> float:
        """Compressed bytes a character that text[start:end] adds to the text around it, behind the dictionary."""
        own = text[start:end]
        around = " ".join(side.replace(own, "") for side in (text[end : end + CONTEXT], text[max(0, start - CONTEXT) : start])).encode("utf-8", "surrogatepass")
        return (len(self.zstd.compress(around + own.encode())) - len(self.zstd.compress(around))) / max(1, end - start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, sorted; kinds by their number in KINDS."""
    low = text.lower()
    found = []
    if any(s in low for s in STEMS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def plain(token: str) -> bool:
    """Whether a token is words and short numbers: natural words and names are as new to zstandard as keys are."""
    if len(token) > 200:
        return False
    for part in SIGNS.split(token):
        found = WORDS.findall(part)
        if any(w.isdigit() for w in found) and (len(found) > 1 or len(part) > 4):
            return False
        if any(len(w) >= 24 or len(found) > 1 and len(w) < 3 for w in found):
            return False
    return True


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values bound to a sensitive word, and of long tokens near any sensitive stem before them on the line.

    A token that is ``plain`` is none.
    """
    found = {m.end(1): m.start(1) for m in SENSITIVE.finditer(text) if not plain(m[1])}
    near: dict[int, int] = {}
    last = 0  # the end of the last token, which many stems may be in or before
    for stem in STEM.finditer(text):
        at = after = stem.end()
        stop = text.find("\n", after, after + DISTANCE + LONG)
        while m := TOKEN.search(text, at, after + DISTANCE + LONG if stop < 0 else stop):
            start = m.start()
            at = last = last if m.end() <= last else TOKEN.match(text, start).end()
            start = NAME.match(text, start, at).end() if at - NAME.match(text, start, at).end() >= LONG else start
            if not plain(text[start:at]):
                near[at] = max(start, near.get(at, 0))
    return sorted((start, end) for end, start in (near | found).items())


def novel_spans(text: str, novelty: Novelty, threshold: float) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(s in low for s in STEMS + MORE_STEMS):
        return []
    return [(start, 3, end) for start, end in candidates(text) if novelty.marginal(text, start, end) >= needed(text[start:end], threshold)]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_scan(docs: DataFrame, threshold: float = NOVELTY, identifiers: bytes = IDENTIFIERS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of ``docs`` (doc_id, text).

    Offsets are code points, ends exclusive; assign spans cover the whole match,
    novel ones the value alone.  A null text has no span.  Null and repeated
    doc_ids pass through; other columns are ignored.  Each row is scanned whole
    and by itself, so that there is no shuffle.
    """
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]

    def work(batches):
        novelty = Novelty(identifiers)
        for batch in batches:
            counts, shas, spans = [[], [], []], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                for kind in range(3):
                    counts[kind].append(sum(s[1] == kind for s in base))
                shas.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(sorted(base + novel_spans(text, novelty, threshold))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(work, T.StructType(fields))
