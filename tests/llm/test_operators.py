import hashlib
import itertools
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
from cases import ODD, SPACES, corpus, lower, words
from conftest import SF_DIR
from pyspark.sql import functions as F

from treelens.llm import exact_dedup, lattice_lm, line_dedup, minhash, mixing, passages, pieces, quality, queries, secrets, sharding, suffix_sort

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode("utf-8", "surrogatepass")).hexdigest()
MODEL = queries.piece_model()
BOTH = [(i, t) for i, t in ODD if i not in (8, None)] + [(1000 + i, t) for i, t in corpus()]
CLASHING = "row string, tag long, h1 long, batch int, pos int, key string, part int, list string, block long, n long, lo int, word string, lang string, source string"


@pytest.fixture()
def docs(spark):
    """A table of (doc_id, text) rows, with more columns if asked for."""
    return lambda rows, more="": spark.createDataFrame(rows, "doc_id long, text string" + (f", {more}" if more else ""))


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_line_dedup", "op10_mixing"])
def test_query_equals_its_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def all_operators(docs, labels):
    yield "exact", exact_dedup.exact_dedup(docs)
    yield "lines", line_dedup.line_dedup(docs)
    yield "quality", quality.quality(docs, labels)
    yield "pieces", pieces.tokenize(docs, MODEL)
    yield "passages", passages.passage_dedup(docs)
    yield "shard", sharding.shard(docs)
    yield "near", minhash.near_dedup(docs)
    yield "secrets", secrets.secret_scan(docs)
    yield "lm", lattice_lm.lm_score(docs, MODEL)
    yield "mix", mixing.mix(docs)


def test_odd_rows_extra_columns_and_empty_tables(spark, docs):
    """Nulls, empty and long texts, repeated rows and clashing names: each row of the input has one in the output."""
    extra = [None] * len(CLASHING.split(","))
    labels = spark.createDataFrame([(4, 1), (None, 1), (7, None), (6, 0)], "doc_id long, quality int")
    for rows in (ODD, []):
        table = docs([(*r, *extra) for r in rows], CLASHING)
        for name, out in all_operators(table, labels.limit(0) if not rows else labels):
            assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in rows), name


def test_exact_dedup(docs, monkeypatch):
    rows = [*ODD, *corpus()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(SPACES, " ", t or "")].append(i)
    wanted = Counter()
    for t, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        wanted.update((i, least, len(ids), i == least, sha(t)) for i in ids)
    # 120 texts a block or so, one block a text, and both ways for the filter to meet its rows
    for bits, broadcast_blocks in ((exact_dedup.BITS, 4096), (exact_dedup.BITS, 0), (exact_dedup.BLOCK, 4096), (exact_dedup.BLOCK, 0)):
        monkeypatch.setattr(exact_dedup, "BITS", bits)
        got = exact_dedup.exact_dedup(docs(rows), broadcast_blocks=broadcast_blocks)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == wanted


def brute_lines(rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(-math.inf if i is None else i)
    out = []
    for i, t in rows:
        own = -math.inf if i is None else i
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or own == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(docs, batches):
    line = "A line that is long enough to count"
    rows = [*ODD, *corpus(), *((50 + i, f"{line}\n  {line.upper()}\t\nown {i}\n\n") for i in range(4)), (None, line), (60, line), (60, line)]
    got = line_dedup.line_dedup(docs(rows), batches=batches)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in got.collect()) == brute_lines(rows)


def brute_base(text):
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    covered = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("partitions", [4, 13])
def test_a_line_run_has_one_file_a_bucket(spark, docs, monkeypatch, partitions):
    """Whatever the number of shuffle partitions is, and though none are coalesced."""
    import glob

    made, write = [], line_dedup.LineRuns._write

    def counted(self, rows):
        name = write(self, rows)
        made.append(len(glob.glob(f"{self.scratch.base.removeprefix('file://')}/{name}/*.parquet")))
        return name

    monkeypatch.setattr(line_dedup.LineRuns, "_write", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, (str(partitions), "false"), strict=True):
            spark.conf.set(k, v)
        assert line_dedup.line_dedup(docs([*ODD, *corpus()])).count() == len(ODD) + 120
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(made) >= 3 and max(made) <= partitions and sum(made) > 0


def test_quality_base_measures(spark, docs):
    rows = [*BOTH, (2000, "a b c a b c d a b c " * 20), (2001, "x y\nx y\n \n \nx y"), (2002, "#$ <|> a&b " + "w " * 60)]
    labels = spark.createDataFrame([(i, 1) for i, _ in corpus()], "doc_id long, quality int")
    for r in quality.quality(docs(rows), labels, threshold=-0.04).collect():
        base = brute_base(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base, r.doc_id
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert r.kept == (not r.base_failed and r.score >= -0.04)


def test_quality_scores_are_mean_log_ratios(spark, docs):
    rows, good = corpus(40), {i for i, _ in corpus(40)[:10]}
    labels = spark.createDataFrame([(i, int(i in good)) for i, _ in rows], "doc_id long, quality int")
    buckets = 97
    grams = {}
    for i, t in rows:
        w = words(t)
        grams[i] = [(x,) for x in w] + list(zip(w, w[1:], strict=False))
    distinct = sorted(set(itertools.chain.from_iterable(grams.values())))
    one = spark.createDataFrame([g for g in distinct if len(g) == 1], "a string").selectExpr("a", "cast(pmod(xxhash64(a), 97) as int) as b").collect()
    two = spark.createDataFrame([g for g in distinct if len(g) == 2], "a string, c string").selectExpr("a", "c", "cast(pmod(xxhash64(a, c), 97) as int) as b").collect()
    bucket = {(r.a,): r.b for r in one} | {(r.a, r.c): r.b for r in two}
    raw, target = Counter(bucket[g] for v in grams.values() for g in v), Counter(bucket[g] for i in good for g in grams[i])
    n, m = sum(raw.values()), sum(target.values())
    p = {b: (raw[b] + 1) / (n + buckets) for b in range(buckets)}
    ratio = {b: math.log((target[b] + buckets * p[b]) / ((m + buckets) * p[b])) for b in range(buckets)}
    for r in quality.quality(docs(rows), labels, buckets=buckets, threshold=0.0).collect():
        g = grams[r.doc_id]
        assert r.score == pytest.approx(sum(ratio[bucket[x]] for x in g) / len(g), abs=1e-9)


def brute_quality(texts, labels, buckets=quality.BUCKETS):
    """The ids that the base rules and the ratio pass; Spark's hash of strings is xxh64, seeded with 42 or the hash before it."""
    import xxhash

    one = lambda w, seed=42: xxhash.xxh64_intdigest(w.encode(), seed)
    signed = lambda h: h - (h >> 63 << 64)
    order = lambda i: signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42))
    grams = {}
    for i, t in texts.items():
        w = words(t)
        grams[i] = [signed(one(x)) % buckets for x in w] + [signed(one(y, one(x))) % buckets for x, y in zip(w, w[1:], strict=False)]
    good = sorted((i for i, q in labels.items() if q == 1), key=order)
    trusted = [i for i in good if order(i) % 3][: quality.TRUSTED]
    fit = [i for i in good if not order(i) % 3][: quality.FITTED] + sorted((i for i, q in labels.items() if q == 0), key=order)[: quality.FITTED]
    raw, target = Counter(b for v in grams.values() for b in v), Counter(b for i in trusted for b in grams.get(i, ()))
    n, m = sum(raw.values()), sum(target.values())
    p = [(raw[b] + 1) / (n + buckets) for b in range(buckets)]
    ratio = [math.log((target[b] + buckets * p[b]) / ((m + buckets) * p[b])) for b in range(buckets)]
    score = {i: sum(ratio[b] for b in v) / max(1, len(v)) for i, v in grams.items()}
    known = sorted((score[i], labels[i]) for i in fit if i in grams and len(words(texts[i])) >= 50)
    cuts = [(known[0][0] - 1, -math.inf)] + [(a[0], (a[0] + b[0]) / 2) for a, b in zip(known, known[1:], strict=False) if a[0] < b[0]]
    bad, fine = [s for s, q in known if not q], [s for s, q in known if q]
    wrong = lambda cut: sum(s <= cut for s in fine) * len(bad) + sum(s > cut for s in bad) * len(fine)
    threshold = min(cuts, key=lambda c: (wrong(c[0]), c[0]))[1] if bad and fine else -math.inf
    return {i for i, t in texts.items() if (b := brute_base(t))[0] >= 50 and 2 * b[4] <= b[0] and score[i] >= threshold}


def test_fitted_threshold():
    assert quality.fitted_threshold([(0.1, 1), (0.3, 1), (-0.5, 0), (-0.1, 0)]) == 0.0
    assert quality.fitted_threshold([(0.1, 1), (0.1, 0), (0.3, 1), (-0.5, 0)]) == pytest.approx(-0.2)
    for scores in ([], [(1.0, 1)], [(1.0, 0), (2.0, 0)], [(1.0, 0), (1.0, 1)]):
        assert quality.fitted_threshold(scores) == -math.inf


def test_quality_tells_labelled_documents_apart(spark):
    judged = queries.op3_quality_rules(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").where("not base_failed")
    rates = {r.quality: r.rate for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("rate")).collect()}
    assert rates[1] >= 0.95 and rates.get(0, 0) <= 0.2


def test_pieces_equal_the_library(docs):
    import random

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(1)
    bits = ["a", "b", "the ", "ing", " ", "  ", "▁", "\n", "\t", "é", "ß", "季", "😀", "\0", "AKIA", "12", "=", "<s>", "</s>", "<0x0A>", "<unk>", "----", "tion", "​", "   ", "                 ", "aaaaaaa", "\r\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    rows = BOTH + [(5000 + i, t) for i, t in enumerate(texts)]
    got = by_id(pieces.tokenize(docs(rows), MODEL))
    for i, t in rows:
        ids = library.encode(t or "", add_bos=False, add_eos=True)
        assert got[i].ids == ids and got[i].n_tokens == len(ids), repr(t)[:200]
        assert got[i].ids_sha256 == sha(" ".join(map(str, ids))) and got[i].decoded_sha256 == sha(library.decode(ids))
    model = pieces.load(open(MODEL, "rb").read())
    for _ in range(1000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), 29871, 1, 2]) for _ in range(r.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_a_tokenizing_worker_holds_little(docs):
    """What a worker holds follows neither Spark's batches nor, beyond a bound in bytes, the distinct words it has met."""
    import sys

    import pyarrow as pa

    class Table:
        schema = docs([]).schema
        select = lambda self, *_: self
        mapInArrow = lambda self, work, _: work  # noqa: E731, N815

    texts = ["the " * (i % 600) for i in range(3_000)] + [None, "the " * 400_000, ""]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    for with_ids in (True, False):
        out = list(pieces.tokenize(Table(), MODEL, with_ids)([batch, batch.slice(0, 0), batch.slice(1, 2)]))
        assert all(sum(b["n_tokens"].to_pylist()) <= 300_000 or b["n_tokens"][-1].as_py() > 300_000 for b in out)
        rows = pa.Table.from_batches(out).to_pylist()
        model = pieces.load(open(MODEL, "rb").read())
        assert [r["doc_id"] for r in rows] == [*range(len(texts)), 1, 2]
        for r in rows:
            ids = model.encode(texts[r["doc_id"]] or "")
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(" ".join(map(str, ids))) and r.get("ids", ids) == ids
    model = pieces.PieceModel(open(MODEL, "rb").read())
    model.encode(" ".join(f"{i * 7919:x}" for i in range(20_000)))
    assert len(model) >= 20_000
    held = sys.getsizeof(model) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in model.items())
    assert held / len(model) * pieces.MEMORY < 60e6


def brute_passages(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(b[s : s + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


@pytest.mark.parametrize(("part_bytes", "open_limit", "at_once"), [(40_000, 5_000, passages.AT_ONCE), (7_000, 1, 1_000)])
def test_passages(docs, part_bytes, open_limit, at_once):
    """With pieces of 1,000 bytes most texts are longer than a piece, and an anchor with two spans is salted."""
    rows = [*BOTH, (3000, "abcdefghij" * 40), (3001, "z" + "abcdefghij" * 25 + "y"), (3002, "ab" * 49 + "c" + "ab" * 60), (3003, "")]
    got = by_id(passages.passage_dedup(docs(rows), part_bytes, open_limit, at_once=at_once))
    wanted = brute_passages(rows)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == wanted
    assert sum(w[1] for w in wanted.values()) > 10_000


def test_passages_of_repeated_and_null_ids(docs):
    """Rows of one id and one text are one document; texts of one id go by their hash; no id comes last, after the largest there is."""
    import random

    r = random.Random(5)
    line = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    a, b, c, d, e, big = line(150), line(150), line(150), line(300), line(130), 2**63 - 1
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (big, d), (None, d), (None, e), (None, e), (None, None), (8, b + c)]
    got = Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in passages.passage_dedup(docs(rows)).collect())
    whole, gone = lambda i, t: (i, len(t), 0, 0, sha(t)), lambda i, t: (i, len(t), len(t), 1, sha(""))
    assert got == Counter([whole(1, a), gone(5, a), whole(5, b), whole(7, c), whole(7, c), whole(big, d), gone(None, d), whole(None, e), whole(None, e), whole(None, ""), gone(8, b + c)])


def test_spans_that_only_look_equal():
    """Spans with one hash and other bytes are told apart by their digests, and fetched once more where their bytes are wanted."""
    row = lambda doc, digest, context=None: (doc, 0, 0, 1, 0, digest, context)
    x, y = b"x" * 100, b"y" * 100
    for rows, told, repeats in (
        ([row(1, b"x"), row(2, b"x")], True, [(2, 0, 0, 1)]), ([row(1, b"x"), row(2, b"y")], False, []), ([row(1, b"x", x), row(2, b"y", y)], True, []),
        ([row(1, b"x", x), row(2, b"y", y), row(3, b"z")], False, []), ([row(1, b"x", b""), row(2, b"y", b""), row(3, b"y")], True, [(3, 0, 0, 1)]),
    ):
        found = []
        assert passages.repeats_of_leaves(rows, found) is told and found == repeats
    import numpy as np

    data = np.frombuffer(b"abcdabceabcd", np.uint8)
    assert passages._differ(data, np.array([0, 0, 4]), np.array([4, 8, 0]), np.array([3, 4, 4])).tolist() == [False, False, True]


def test_suffix_order():
    import random

    r = random.Random(2)
    for _ in range(200):
        base = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(3)]
        found = [r.choice(base) + r.choice(base)[: r.randint(0, 9)] for _ in range(r.randint(0, 30))]
        for shallow in (0, 3, 40):
            order = suffix_sort.deep_shallow(found, 0, shallow)
            assert sorted(order) == list(range(len(found))) and [found[i] for i in order] == sorted(found)
    assert suffix_sort.common_prefix(b"abcx", b"abcy") == 3 and suffix_sort.common_suffix(b"xbc", b"aabc") == 2
    assert suffix_sort.common_prefix(b"", b"a") == 0 and suffix_sort.common_suffix(b"ab", b"ab") == 2


def jump(key, shards):
    b, j, key = -1, 0, key & (2**64 - 1)
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(docs):
    rows = [*ODD, *((i * 7919 - 2**40, "t") for i in range(300)), (2**63 - 1, "t"), (-(2**63), "t")]
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    slots = defaultdict(list)
    for r in sharding.shard(docs(rows), 16, parts=5).collect():
        assert (r.shard, r.grown_shard) == (jump(r.doc_id or 0, 16), jump(r.doc_id or 0, 17)) and r.law == "key"
        assert (r.size, r.text_crc32) in {(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts[r.doc_id]}
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_near(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_dedup(docs):
    text = " ".join(f"w{i}" for i in range(120))
    chain = [(4000 + i, " ".join(f"w{k}" for k in range(i * 6, 120 + i * 6))) for i in range(9)]  # each is like the next, the ends aren't
    rows = [*BOTH, *chain, (4100, text.upper()), (4101, text.replace("w60", "other")), (4102, "a b c"), (4103, "A\tb\nC"), (4104, "a b c d")]
    got = by_id(minhash.near_dedup(docs(rows)))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == brute_near(rows)


def test_near_dedup_of_a_large_group(docs):
    import random

    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(700):
        w = list(base)
        w[r.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = by_id(minhash.near_dedup(docs(rows)))
    assert {x.component_id for x in got.values()} == {0}


def test_secret_spans(docs):
    key = "Zx9fQ2pLm4Ty7Kd0aPqW3rTn"
    rows = [
        (1, f'é 😀 password="{key}" and PASSWORD : short, Api_Key=\'0123456789ab\''), (2, "AKIA" + "A" * 13 + " AKIA" + "B7" * 7 + "c"), (3, "deadbeefdeadbee deadbeefdeadbeef0 DEADBEEFDEADBEEF"),
        (4, None), (5, f"private_key: {key} and private_key: your_password_here"), (6, "secret\n=\nabcdefghijklmnop secreT=abcdefghijk=l ſecret=abcdefghijklmnop"), *((100 + i, t) for i, t in BOTH),
    ]
    got = by_id(secrets.secret_scan(docs(rows)))
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in rows:
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        shown = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(base)]
        counts = Counter(k for _, k, _ in base)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == (counts[0], counts[1], counts[2], sha(",".join(shown)))
        assert set(shown) <= set(filter(None, got[i].spans.split(",")))
    novel = [s for s in got[5].spans.split(",") if s.startswith("novel")]
    assert novel == [f"novel:13:{13 + len(key)}"]


@pytest.mark.parametrize("chunk_bytes", [30_000, 24_000_000])
def test_lm_scores_equal_brute_force(docs, chunk_bytes, monkeypatch):
    """Null and repeated ids count and are scored each; the lattice's sum is taken over all cuts, by a recursion of the test's own."""
    rows = [*ODD, *corpus(80), (1, "one"), (77, "hello hello Hello world " * 3_000), (None, "hello world")]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*words(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    lattice = lattice_lm.Lattice(open(MODEL, "rb").read())
    longest = max(map(len, lattice.logs))

    def marginal(word):
        if word is None:
            return math.log(lattice_lm.END_MASS)
        text, sums = "▁" + word, [1.0]
        if len(text) > 40 or any(c not in lattice.logs for c in text):
            return lattice.word(word.encode())
        for end in range(1, len(text) + 1):
            sums.append(sum(sums[k] * math.exp(lattice.logs[text[k:end]]) for k in range(max(0, end - longest), end) if text[k:end] in lattice.logs))
        return math.log(sums[-1])

    known = {w: marginal(w) for w in {w for _, t in rows for w in [*words(lower(t)), None]}}

    def wanted(i, t):
        tokens = [*words(lower(t)), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        mixed = sum(math.log10((counts[w] + v * math.exp(known[w])) / (n + v)) if counts[w] or known[w] > -700 else (known[w] / math.log(10) + math.log10(v / (n + v))) for w in tokens)
        return ("" if i is None else str(i), held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n), [base, sum(known[w] for w in tokens) / math.log(10), mixed]

    got = [(("" if r.doc_id is None else str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens), [r.base_score, r.score, r.mixed_score]) for r in lattice_lm.lm_score(docs(rows), MODEL, chunk_bytes=chunk_bytes).collect()]
    for (a, x), (b, y) in zip(sorted(got), sorted(wanted(*r) for r in rows), strict=True):
        assert a == b and x == pytest.approx(y, rel=1e-8)


def test_long_texts_are_cut_into_words_in_blocks(monkeypatch):
    monkeypatch.setattr(lattice_lm, "AT_ONCE", 7)
    for text in (b"", b" ", b"abcdefghijk", b"a bc  def\x0bghij klmnopqrstuvw x\ny ", b"ab cd " * 30):
        assert [w for block in lattice_lm.blocks(text) for w in block] == text.split()


def test_lattice_sums_over_all_cuts():
    lattice = lattice_lm.Lattice(open(MODEL, "rb").read())

    def total(text):
        if not text:
            return 1.0
        return sum(math.exp(lattice.logs[text[:n]]) * total(text[n:]) for n in range(1, len(text) + 1) if text[:n] in lattice.logs)

    for word in ("the", "station", "a", "é", "qwx", "tokens"):
        assert lattice.word(word.encode()) == pytest.approx(math.log(total("▁" + word)))
    assert lattice.word("a\U0001f9ffb".encode()) < lattice.word(b"ab")
    assert sum(map(math.exp, lattice.logs.values())) < 1


def test_learned_counts_beat_the_lattice_on_held_out_text(spark):
    row = queries.op9_lm_score(spark, SF_DIR).where("held_out").agg(F.sum("mixed_score"), F.sum("score")).first()
    assert row[0] > row[1]


def test_scores_of_held_out_text_are_near_the_base(spark):
    rows = queries.op9_lm_score(spark, SF_DIR).where("held_out").collect()
    assert len(rows) == sum(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    assert all(math.isfinite(r[c]) for r in rows for c in ("base_score", "score", "mixed_score", "lattice_score"))
    # base gives every new word the same, and a law over all words can't; by the ranks alone the sum was 2.08 times the base's
    base, score, alone = (sum(r[c] for r in rows) for c in ("base_score", "score", "lattice_score"))
    assert 1.25 * base < score and 1.35 * base < alone


def test_words_side_by_side_score_as_alone(monkeypatch):
    lattice = lattice_lm.Lattice(open(MODEL, "rb").read())
    odd = ["the", "a\U0001f9ffb", "\U0001f9ff" * 7, "x" * 31, "x" * 32, "x" * 5_000, "\x00", "\ud800", "\u00a0x\u2028y", "\u2581", "caf\u00e9###", "\U0001f9ff"]
    known = [b"", *(w.encode("utf-8", "surrogatepass") for w in odd)]
    for some in (known, known[:2], [b""], []):
        assert lattice.words(some) == pytest.approx([lattice.word(w) for w in some], rel=1e-9)
    monkeypatch.setattr(lattice_lm, "LEAST", 1e-3)
    assert lattice.words(known) == pytest.approx([lattice.word(w) for w in known], rel=1e-9)


def test_expected_pieces_are_those_of_all_cuts():
    lattice = lattice_lm.Lattice(open(MODEL, "rb").read())
    names = list(lattice.logs)

    def cuts(text):
        if not text:
            yield 1.0, []
        for n in range(1, len(text) + 1):
            if text[:n] in lattice.logs or len(text[0].encode()) == 4:
                for p, more in cuts(text[n:]):
                    yield p * math.exp(lattice.logs.get(text[:n], 0.0)), [text[:n], *more]

    wanted = Counter()
    for word, n in (("station", 3), ("the", 5), ("a\U0001f9ffb", 2)):
        every = [c for c in cuts("\u2581" + word) if all(x in lattice.logs or x == "\U0001f9ff" for x in c[1])]
        for p, own in every:
            for piece in own:
                wanted[piece] += n * p / sum(q for q, _ in every)
    del wanted["\U0001f9ff"]
    got = lattice.expected([b"station", b"", b"the", "a\U0001f9ffb".encode()], [3, 9, 5, 2])
    assert {names[i]: got[i] for i in got.nonzero()[0]} == pytest.approx(dict(wanted))


def test_cached_scores_count_the_words_before(monkeypatch):
    import numpy as np

    sizes, tokens = np.array([1, 6, 2, 5, 3]), np.array([0, 1, 2, 1, 1, 3, 0, 1, 0, 2, 2, 2, 2, 0, 1, 3, 0], np.uint32)
    mixed, wanted, at = np.array([-1.0, -2.0, -3.0, -500.0]), [], 0
    for n in sizes:
        own, total = tokens[at : at + n].tolist(), 0.0
        for k, w in enumerate(own):
            share = own[:k].count(w) / k if k else 0
            total += math.log10(0.9 * 10 ** mixed[w] + 0.1 * share) if share else mixed[w] + (math.log10(0.9) if k else 0)
        wanted.append(total)
        at += n
    for at_once in (1, 7, 500_000):
        monkeypatch.setattr(lattice_lm, "CACHED_AT_ONCE", at_once)
        assert lattice_lm.cached(mixed, tokens, sizes).tolist() == pytest.approx(wanted)


def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("web", "en", "src0", 1000), ("web", "en", "src1", 10), ("web", "de", "src2", 100), ("books", "en", "src5", 50)], "domain string, mix_lang string, mix_source string, tokens long")
    weights = {"domain": {"web": 1, "books": 1}, "lang": {"en": 1, "de": 1}, "source": {}}
    plan = {r.mix_source: r.leaf_budget for r in mixing.leaf_plan(leaves, 800, 1, weights).collect()}
    # books can use 50 of its 400, so web has 750; de can use 100 of its half, so en has 650; src1 can use 10
    assert plan == {"src5": 50, "src2": 100, "src1": 10, "src0": 640}


def test_mix_spends_each_leaf_in_whole_epochs_and_a_prefix(spark, docs):
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 6}") for i, t in corpus(200)] + [(None, None, None, None), (9999, "", "en", "src0")]
    out = mixing.mix(docs(rows, "lang string, source string"), max_epochs=3).collect()
    assert len(out) == len(rows)
    leaves = defaultdict(list)
    for r in out:
        leaves[r.domain, r.lang, r.source].append(r)
    for leaf in leaves.values():
        assert max(r.copies for r in leaf) - min(r.copies for r in leaf) <= 1
        spent, budget = sum(r.copies * r.n_tokens for r in leaf), leaf[0].leaf_budget
        assert spent <= budget and (budget - spent < max(r.n_tokens for r in leaf) or not budget)
    assert sum({k: v[0].leaf_budget for k, v in leaves.items()}.values()) <= sum(r.n_tokens for r in out)


def test_pipeline_equals_brute_force_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    data = {r.doc_id: r.asDict() for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    passed = brute_quality({i: d["text"] for i, d in data.items()}, labels)
    assert 0 < len(passed) < len(data)
    texts = {i: data[i]["text"] for i in passed}
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            holders[key(line)].add(i)
    cut = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or i == max(holders[key(x)])) for i, t in texts.items()}
    near = brute_near(list(cut.items()), corpus_pipeline.SIMILAR)
    kept = {i: t for i, t in cut.items() if near[i][2]}
    documents = pd.DataFrame([{**data[i], "text": t, "n_chars": len(t)} for i, t in kept.items()])  # noqa: F841
    copies = dict(duckdb.sql(f"SELECT doc_id, copies FROM ({mixing.ORACLE})").fetchall())
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    wanted = Counter({(i, json.dumps(library.encode(t, add_eos=True))): copies[i] for i, t in kept.items()})
    got = Counter((r.doc_id, json.dumps(r.ids)) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert got == +wanted
    assert columns == corpus_pipeline.STAGES[0][1](spark, docs, SF_DIR).columns


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
    assert "pipeline" in entry.queries()


def test_near_dedup_divides_large_blocks(spark, docs, monkeypatch):
    """Groups whose members are not all like their hub, in parts of a few documents."""
    import random

    r = random.Random(6)
    rows = []
    for g in range(3):
        base = [f"w{r.randrange(10**6)}" for _ in range(120)]
        for i in range(50):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(120)] = f"x{r.randrange(10**6)}"
            rows.append((100 * i + g, " ".join(w)))
    monkeypatch.setattr(minhash, "TASK_DOCS", 8)
    monkeypatch.setattr(minhash, "TASK_BYTES", 4_000)
    got = by_id(minhash.near_dedup(docs(rows)))
    wanted = brute_near(rows)
    assert {i: (x.n_shingles, x.component_id, x.kept) for i, x in got.items()} == wanted
    assert 3 < len({w[1] for w in wanted.values()}) < 100


def test_near_dedup_of_a_long_chain(docs, monkeypatch):
    """2,000 documents, each like the next only, are one component; no list has more than some twenty of them, and so no task has."""
    rows = [(i, " ".join(f"w{k}" for k in range(i * 6, 120 + i * 6))) for i in range(2_000)]
    made = []

    def parted(members, *args):
        made.append(members.count())
        return wanted(members, *args)

    wanted = minhash.parted
    monkeypatch.setattr(minhash, "parted", parted)
    got = minhash.near_dedup(docs(rows)).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
    # slim rows grow with the lists that a document is in, at most 17 of them
    assert made[0] <= 17 * len(rows) and made[1] <= made[0]


def test_secrets_in_common_forms(docs):
    key = "Zx9fQ2pLm4Ty7Kd0aPqW3rTnB8vHs1c"
    forms = [
        "Authorization: Bearer @", "Authorization: Basic @", "SECRET_KEY = '@'", "secret_key: @", "encryption_key=@", '"private_key_id": "@"', 'password := "@"', "TOKEN_VALUE=@", "pwd=@",
        "<password>@</password>", "bearer @", "token @", "the password for it is now @", "privateKey => '@'", '<add key="apiKey" value="@"/>', "curl -H 'X-Auth: @'", "client_secret_2 -> @", "secret token=@", "passwd\t@",
        "storage key @", "DB_PASSWORD_PROD=@", "session_key[0] = @",
    ]
    clean = ["the secret of photosynthesis and internationalisation", "a token\nof " + key, "token getAccessTokenFromStore", "monkey " + key, "secret " + "x " * 40 + key, "the keyboard_of " + key]
    got = by_id(secrets.secret_scan(docs(list(enumerate([f.replace("@", key) for f in forms] + clean)))))
    for i, form in enumerate(forms):
        assert f"novel:{form.index('@')}:{form.index('@') + len(key)}" in got[i].spans.split(","), form
    assert [got[len(forms) + i].spans for i in range(len(clean))] == [""] * len(clean)


def test_pipeline_stages_on_odd_rows(spark, docs, tmp_path):
    """Names that stages use themselves come through unchanged; null texts, repeats and empty tables are as the docstrings say."""
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    more = "kept_id long, kept_key long, copy long, kept string, score string, measures string, rest string, row string, copies string, `a.b` string, nameless boolean"
    extra = (1, 2, 3, "k", "s", "m", "r", "w", "c", "d", True)
    text = "\n".join(" ".join(f"w{i}of{k}" for k in range(10)) for i in range(9))
    rows = [(i, t, *extra, "en", "src1") for i, t in [*ODD, (50, text), (51, text + " more"), (50, text)]]
    for table in (docs(rows, more + ", lang string, source string"), docs([], more + ", lang string, source string")):
        whole = table.count() > 0
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == table.columns, name
            got = out.collect()
            assert all(tuple(r)[2:13] == extra for r in got), name
            ids = Counter(r.doc_id for r in got)
            if whole:
                wanted = {"quality_rules": {50, 51}, "line_dedup": {r[0] for r in rows}}.get(name)
                assert wanted is None or set(ids) == wanted, name
                assert name != "near_dedup" or ids[50] == 2 and 51 not in ids and {1, 2, 3} <= set(ids) and 5 not in ids
                assert name != "mixing" or {1, 2, 50, 51} <= set(ids)
            else:
                assert not got
        assert corpus_pipeline.token_ids(spark, table, str(tmp_path)).count() == table.count()


def test_novel_spans_tell_keys_from_look_alikes():
    """Shares over 600 planted keys, and 600 names, words and paths at the same places; a key that stands there twice is found twice."""
    import base64
    import random
    import string

    r, novelty = random.Random(12), secrets.Novelty()
    lines = ["private_key: {}", "Authorization: Bearer {}", "signing_key = '{}'", "export SESSION_KEY={}", '"credential": "{}"', "encryption_key => {}"]
    code = "def load(settings):\n    vault = settings.vault_client\n    return vault.read_secret(settings.region_name)\n" * 4
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits]
    key = lambda: "".join(r.choice(alphabets[r.randrange(3)]) for _ in range(r.randint(24, 64)))
    encoded = lambda: base64.b64encode(r.randbytes(r.randint(18, 40))).decode()
    names = "settings vault client region name load read secret service account default provider config handler request manager factory".split()
    like = lambda: r.choice([lambda: "_".join(r.choice(names) for _ in range(4)), lambda: ".".join(r.choice(names) for _ in range(4)), lambda: "".join(r.choice(names).capitalize() for _ in range(4)), lambda: "/".join(["", "etc", *(r.choice(names) for _ in range(3))]), lambda: "x" * r.randint(12, 40)])()
    found = lambda value: bool(secrets.novel_spans(code + r.choice(lines).format(value) + "\n" + code, novelty, secrets.NOVELTY))
    caught = sum(found(r.choice((key, encoded))()) for _ in range(600)) / 600
    false = sum(found(like()) for _ in range(600)) / 600
    print(f"keys found {caught:.3f}, look-alikes reported {false:.3f}")
    assert caught >= 0.98 and false <= 0.02
    twice = encoded()
    assert len(secrets.novel_spans(f"private_key: {twice}\n{code}signing_key: {twice}\n", novelty, secrets.NOVELTY)) == 2


def test_pipeline_stage_drops_near_duplicates_from_80_percent_on(spark, docs):
    """Four scattered words of 200 changed: 176 of 216 shingles are shared, 0.815; five: 171 of 221, 0.774."""
    import corpus_pipeline

    base = [f"w{i}" for i in range(200)]
    changed = lambda sign, places: " ".join(f"{sign}{i}" if i in places else w for i, w in enumerate(base))
    rows = [(5001, " ".join(base)), (5002, changed("x", (30, 70, 110, 150))), (5003, changed("y", (30, 60, 90, 120, 150))), *((9000 + i, t) for i, t in corpus(60))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if (w := words(lower(t)))}
    component = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((component[a], component[b]))
            component = {i: x if c == y else c for i, c in component.items()}
    wanted = {i for i, c in component.items() if c == i}
    assert {5001, 5003} <= wanted and 5002 not in wanted
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(rows), None).collect()} == wanted


@pytest.mark.parametrize("open_limit", [5_000, 1])
def test_passages_of_many_texts_without_an_id(docs, open_limit):
    """Each of 700 texts, two of which have equal 16-bit checksums by all odds, loses its own repeats only."""
    import random

    r = random.Random(8)
    line = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    shared = [line(150) for _ in range(40)]
    texts = list(dict.fromkeys(line(r.randint(0, 120)) + r.choice(shared) + line(r.randint(20, 200)) for _ in range(700)))
    assert len({zlib.crc32(t.encode()) & 0xFFFF for t in texts}) < len(texts)
    ordered = [x.text for x in passages.named(docs([(None, t) for t in texts])).orderBy("doc", "tag").collect()]
    wanted = Counter(brute_passages(list(enumerate(ordered))).values())
    rows = passages.passage_dedup(docs([(None, t) for t in texts]), 20_000, open_limit).collect()
    assert Counter((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows) == wanted


def test_near_dedup_of_rows_without_an_id(spark, docs):
    """Each is a document of its own: it neither goes with another one nor joins two that it is unlike."""
    import corpus_pipeline

    text = lambda sign, n=60: " ".join(f"{sign}{i}" for i in range(n))
    big = 2**63 - 1
    rows = [(1, text("a")), (2, text("b")), (None, text("a")), (None, text("b", 61)), (None, text("c")), (None, text("c").upper()), (None, text("d")), (None, text("d")), (big, text("e")), (None, text("e", 61)), (3, text("f"))]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(docs(rows)).collect())
    assert got == Counter({
        (1, 56, 1, True): 1, (2, 56, 2, True): 1, (None, 56, 1, False): 1, (None, 57, 2, False): 1, (None, 56, None, True): 3, (None, 56, None, False): 1,
        (big, 56, big, True): 1, (None, 57, big, False): 1, (3, 56, 3, True): 1,
    })
    stayed = [(r.doc_id, r.text.lower()) for r in corpus_pipeline.near_duplicates(spark, docs(rows), None).collect()]
    assert Counter(stayed) == Counter([(1, text("a")), (2, text("b")), (None, text("c")), (None, text("d")), (big, text("e")), (3, text("f"))])


def test_long_secrets_of_small_alphabets():
    import random

    r, novelty = random.Random(4), secrets.Novelty()
    found = lambda value: secrets.novel_spans(f"signing_key: {value}", novelty, secrets.NOVELTY)
    for alphabet in ("0123456789", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz"):
        for n in (64, 128, 256, 512, 1024, 4096):
            for _ in range(10):
                value = "".join(r.choice(alphabet) for _ in range(n))
                assert found(value) == [(13, 3, 13 + n)], (alphabet, n)
                assert not found("".join(r.choice(alphabet) for _ in range(8)) * (n // 4))
        assert not found(alphabet[:1] * 300)
