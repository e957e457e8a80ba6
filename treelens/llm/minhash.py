"""Near-duplicates by an inverted join on signature coordinates.

A document's shingles give a signature of COORDINATES MinHash values; each pair
of coordinate and value is a posting list.  Two documents whose shingle sets
are alike share at least MATCHES of their lists, but for one pair in a million
at the very threshold.  As lists are merged in order of their length, shortest
first, two such documents meet in the first COORDINATES - MATCHES + 1 lists of
both (prefix), and the longest MATCHES - 1 are never merged (skip).  Lists of
one document come first of all: most documents have no other and end here.

Each list has a hub, its smallest document.  Documents that collide with it on
MATCHES coordinates or more are confirmed against it on full shingle sets: a
group of near copies, however large, is settled so.  Lists whose documents are
then not all connected are open.  Within an open list the collisions of pairs
that are not connected yet are counted on signatures alone; a pair belongs to
the first of the prefix lists it shares, and is left if it is below the match
threshold.  Only documents with a pair that stays go on, list by list, with
their texts, and their pairs are confirmed but for those connected meanwhile.
What is too much for a task, by documents or by bytes, is divided into parts,
and every two parts of one list are one task.
Documents with equal sets are one throughout.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_shuffles
from .components import components

COORDINATES, MATCHES, WIDTH, PERCENT = 32, 16, 5, 85
#: Documents of a task that compares signatures, and bytes of text of a task that confirms pairs, about; what one hub or one list has is divided beyond.
TASK_DOCS, TASK_BYTES = 4_000, 1_000_000
#: Keys of texts without a doc_id start here.
NO_ID = 2**62
#: Words whose hashes a worker keeps; words hashed at once.
MEMORY, AT_ONCE = 200_000, 400_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMORY:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _seeds(n: int):
    import numpy as np

    return _mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts, hashes: WordHashes, width: int):
    """The sorted distinct shingle hashes of each text (an array of 64-bit numbers)."""
    import numpy as np

    factor = np.uint64(0x9FB21C651E98DF25)
    pending, size = [], 0

    def done():
        if not pending:
            return
        flat = np.concatenate([p for p in pending] + [np.zeros(width, np.uint64)])
        rolled = flat[: len(flat) - width].copy()
        for k in range(1, width):
            rolled = rolled * factor + flat[k : len(flat) - width + k]
        rolled = _mixed(rolled)
        at = 0
        for p in pending:
            n = len(p)
            if n >= width:
                yield np.unique(rolled[at : at + n - width + 1])
            elif n:
                h = np.uint64(n)
                for w in p:
                    h = h * factor + w
                yield _mixed(np.array([h], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += n

    with np.errstate(over="ignore"):
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            pending.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
            size += len(words)
            if size >= AT_ONCE:
                yield from done()
                pending, size = [], 0
        yield from done()


def signature(shingles, seeds):
    """The MinHash values of a set: for each coordinate the least of a multiply-and-add of all shingles."""
    import numpy as np

    n = len(seeds) // 2
    out = np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out[k] = (shingles * (seeds[2 * k] | np.uint64(1)) + seeds[2 * k + 1]).min()
    return out


def postings(sig):
    """One number for each pair of coordinate and value."""
    import numpy as np

    with np.errstate(over="ignore"):
        return _mixed(sig + np.arange(1, len(sig) + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).view(np.int64)


def key_of():
    """What a row is known by: its doc_id, or a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(NO_ID - 1).bitwiseOR(F.lit(NO_ID)))


def profiles(docs: DataFrame, width: int, coordinates: int) -> DataFrame:
    """(id, named, bytes, n_shingles, s1, s2, lists): the text's bytes, the set's hash in two halves, and its posting lists."""

    def work(batches):
        import numpy as np
        import xxhash

        hashes, seeds = WordHashes(), _seeds(coordinates)
        for batch in batches:
            n, halves, lists = [], [], []
            for s in shingle_sets((v.as_py() for v in batch.column(3)), hashes, width):
                n.append(len(s))
                halves.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                lists.append(postings(signature(s, seeds)) if len(s) else None)
            halves = np.array(halves, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(lists, pa.list_(pa.int64()))], names=["id", "named", "bytes", "n_shingles", "s1", "s2", "lists"])

    ids = docs.select(key_of().alias("id"), F.col("doc_id").isNotNull().alias("named"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "text")
    return ids.mapInArrow(work, "id long, named boolean, bytes long, n_shingles long, s1 long, s2 long, lists array<long>")


def alike(a, b, percent: int) -> bool:
    """Whether two sets are linked; those of too different sizes can't be."""
    import numpy as np

    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


class Signed:
    """Documents of one list, or of two of its parts: their pairs that belong to the list and may be links."""

    def __init__(self, labels, own, sigs, prefix, sizes, at: int, across: bool, matches: int, percent: int):
        """labels: what is connected; own: parts; at: the list's coordinate; across: whether only pairs of two parts count."""
        import numpy as np

        self.labels, self.own, self.sizes = (np.array(x, np.int64) for x in (labels, own, sizes))
        self.sigs, self.prefix = np.array(sigs, np.int64), np.array(prefix, bool)
        self.at, self.across, self.matches, self.percent = at, across, matches, percent

    def partners(self, i: int):
        """Those after i that collide with it often enough, not connected with it by label."""
        import numpy as np

        rest = slice(i + 1, None)
        same = self.sigs[rest] == self.sigs[i]
        found = (same.sum(axis=1) >= self.matches) & (self.labels[rest] != self.labels[i])
        # of the prefix lists that both are in, this one is the first
        found &= (same & self.prefix[rest] & self.prefix[i]).argmax(axis=1) == self.at
        less, more = np.minimum(self.sizes[rest], self.sizes[i]), np.maximum(self.sizes[rest], self.sizes[i])
        found &= 100 * less >= self.percent * more
        if self.across:
            found &= self.own[rest] != self.own[i]
        return np.flatnonzero(found) + i + 1

    def involved(self) -> list[int]:
        import numpy as np

        seen = np.zeros(len(self.labels), bool)
        for i in range(len(self.labels) - 1):
            found = self.partners(i)
            if len(found):
                seen[i] = seen[found] = True
        return np.flatnonzero(seen).tolist()

    def links(self, ids: list[int], sets: list) -> list[tuple[int, int]]:
        """(id, smallest id it is connected with) for all that are connected with another one."""
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i in range(len(ids) - 1):
            for j in self.partners(i).tolist():
                x, y = find(int(self.labels[i])), find(int(self.labels[j]))
                if x != y and alike(sets[i], sets[j], self.percent):
                    parent[max(x, y)] = min(x, y)
                    out.append((ids[i], ids[j]))
        return out


def of_lists(table):
    """(list, whether it is two parts, its rows) for each (list, i, j) of a task's table."""
    groups = defaultdict(list)
    for at, key in enumerate(zip(*(table[c].to_pylist() for c in ("list", "i", "j")), strict=True)):
        groups[key].append(at)
    for (number, i, j), rows in groups.items():
        part = table.take(pa.array(rows))
        yield number, i != j, part


def _signed(number: int, across: bool, part, matches: int, percent: int):
    sigs = part["lists"].to_pylist()
    return Signed(part["label"].to_pylist(), part["own"].to_pylist(), sigs, part["prefix"].to_pylist(), part["n_shingles"].to_pylist(), sigs[0].index(number), across, matches, percent)


MEMBER = "list long, s1 long, id long, label long, n_shingles long, bytes long, lists array<long>, prefix array<boolean>"


def collide(tasks: DataFrame, matches: int, percent: int) -> DataFrame:
    """MEMBER rows with a pair that may be a link, of rows dealt by ``parted``."""

    def work(key, table):
        found = []
        for number, across, part in of_lists(table):
            found.append(part.take(pa.array(_signed(number, across, part, matches, percent).involved(), pa.int64())))
        return pa.concat_tables(found).select([c.split()[0] for c in MEMBER.split(", ")])

    return tasks.groupBy("task").applyInArrow(work, MEMBER)


def confirm_hubs(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): the documents of groups (task, hub, salt, id, text) that are linked with their hub, whose own text is among them."""

    def work(key, table):
        hashes, members = WordHashes(), defaultdict(list)
        found = {"a": [], "b": []}
        ids, hubs, salts = (table[c].to_pylist() for c in ("id", "hub", "salt"))
        sets = list(shingle_sets((v.as_py() for v in table["text"]), hashes, width))
        for i in range(len(ids)):
            if len(sets[i]):
                members[hubs[i], salts[i]].append(i)
        for (hub, _), rows in members.items():
            own = [i for i in rows if ids[i] == hub]
            for i in rows:
                if ids[i] != hub and any(alike(sets[i], sets[k], percent) for k in own):
                    found["a"].append(ids[i])
                    found["b"].append(hub)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in found.items()})

    return pairs.groupBy("task").applyInArrow(work, "a long, b long")


def confirm_lists(tasks: DataFrame, width: int, matches: int, percent: int) -> DataFrame:
    """(a, b): linked documents of MEMBER rows with their texts, dealt by ``parted``."""

    def work(key, table):
        import numpy as np
        import xxhash

        hashes, found = WordHashes(), {"a": [], "b": []}
        for number, across, part in of_lists(table):
            sets = list(shingle_sets((v.as_py() for v in part["text"]), hashes, width))
            # a document can have several texts; a row has the signature of one
            own = [k for k, (s, s1) in enumerate(zip(sets, part["s1"].to_pylist(), strict=True)) if len(s) and np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0] == s1]
            if len(own) < 2:
                continue
            part, sets = part.take(pa.array(own)), [sets[k] for k in own]
            for a, b in _signed(number, across, part, matches, percent).links(part["id"].to_pylist(), sets):
                found["a"].append(a)
                found["b"].append(b)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in found.items()})

    return tasks.groupBy("task").applyInArrow(work, "a long, b long")


def parted(members: DataFrame, most: int, weight: str, scratch: Scratch, name: str) -> DataFrame:
    """MEMBER rows with the parts i, j of their list that a task has, their own part, and the task.

    A list of up to ``most`` in ``weight`` is one part.  Of a larger one every
    two parts meet, each with half of ``most``; documents with the list's
    commonest label have the first parts, and two of these never meet, as all
    in them are connected already.
    """
    labels = members.groupBy("list", "label").agg(F.sum(weight).alias("n"))
    sizes = labels.groupBy("list").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    half, large = most // 2, F.col("n") > most
    first = F.when(large, F.ceil(F.col("n_main") / half)).otherwise(0).cast("int")
    rest = F.when(large, F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("n_main")) / half))).otherwise(1).cast("int")
    # written, so that Spark may divide the documents of a large list in the join
    sizes = scratch.write(sizes.select("list", "main", "n", first.alias("first"), rest.alias("rest")), f"{name}_sizes", slim=True)
    total = sizes.agg(F.sum(F.col("n") * F.greatest(F.lit(1), F.col("first") + F.col("rest")))).first()[0] or 0
    own = members.join(sizes.hint("merge"), "list").withColumn("is_main", (F.col("label") == F.col("main")) & (F.col("first") > 0))
    h = F.xxhash64("s1")
    own = own.withColumn("own", F.when(F.col("is_main"), F.pmod(h, F.greatest("first", F.lit(1)))).otherwise(F.col("first") + F.pmod(h, F.col("rest"))).cast("int"))
    others = F.sequence(F.when(F.col("is_main"), F.col("first")).otherwise(0), F.col("first") + F.col("rest") - 1)
    both = own.withColumn("other", F.explode(others)).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    tasks = max(1, -(-total // most))
    return both.drop("main", "n", "first", "rest", "is_main", "other").withColumn("task", F.pmod(F.xxhash64("list", "i", "j"), F.lit(tasks)).cast("int"))


def near_dedup(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, coordinates: int = COORDINATES, matches: int = MATCHES, with_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text; other columns are ignored), and key_of() as key if asked for.

    Documents are linked if 100 * intersection >= ``percent`` * union of their
    sets of ``width``-word shingles; a text of fewer words is one shingle, and
    one without words (or null) has none and is linked with nothing.
    component_id is the smallest doc_id that links lead to.  A null doc_id is
    never the smallest; where all are null, component_id is null, and the text
    of the smallest hash is kept.  Rows that repeat a doc_id are one document
    with several texts; rows without one are one document if their texts are equal.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = scratch.write(profiles(docs, width, coordinates), "profiles")
    # equal sets are one document, known by its smallest id
    classes = scratch.write(rows.where("n_shingles > 0").groupBy("s1", "s2").agg(least_of("id", "named").alias("rep"), F.max("named").alias("named"), F.max("bytes").alias("bytes"), F.first("n_shingles").alias("n_shingles"), F.first("lists").alias("lists")), "classes", slim=True)
    posted = classes.select("rep", "s1", F.explode("lists").alias("list"))
    lengths = posted.groupBy("list").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    shared = scratch.write(posted.join(lengths.hint("merge"), "list"), "shared", slim=True)
    # lists of one document are the shortest: of the first lists, so many fewer are left
    order = Window.partitionBy("s1", "rep").orderBy("length", "list")
    whole = Window.partitionBy("s1", "rep")
    prefix = shared.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("n") - matches + 1)
    prefix = scratch.write(prefix.select("rep", "s1", "list"), "prefix", slim=True)
    heads = prefix.groupBy("list").agg(F.min(F.struct("rep", "s1")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = scratch.write(prefix.join(heads.select("list", "head.rep", "head.s1").toDF("list", "hub", "hub_s1").hint("merge"), "list"), "met", slim=True)
    scratch.drop("shared", "prefix")
    free_shuffles(spark)
    wanted = met.select(F.col("rep").alias("id")).distinct()
    own = docs.select(key_of().alias("id"), "text")
    texts = scratch.write(own.join(wanted.hint("merge"), "id"), "texts")

    # collisions with the hub are counted first; documents of one hub are divided by salt, and the hub's text goes to each part
    signed = classes.select("rep", "s1", "n_shingles", "bytes", "lists")
    pairs = met.where("rep <> hub").select("hub", "hub_s1", "rep", "s1").distinct().join(signed.hint("merge"), ["rep", "s1"])
    hubs = signed.select(F.col("rep").alias("hub"), F.col("s1").alias("hub_s1"), F.col("lists").alias("hub_lists"), F.col("n_shingles").alias("hub_n"), F.col("bytes").alias("hub_bytes"))
    pairs = pairs.join(hubs.hint("merge"), ["hub", "hub_s1"]).where(F.size(F.array_intersect("lists", "hub_lists")) >= matches)
    pairs = pairs.where(100 * F.least("n_shingles", "hub_n") >= percent * F.greatest("n_shingles", "hub_n"))
    pairs = scratch.write(pairs.groupBy("hub", F.col("rep").alias("id")).agg(F.max("bytes").alias("bytes"), F.max("hub_bytes").alias("hub_bytes")), "pairs", slim=True)
    salts = pairs.groupBy("hub").agg(F.ceil(F.sum("bytes") / TASK_BYTES).cast("int").alias("salts"), F.max("hub_bytes").alias("bytes"))
    salts = scratch.write(salts.where("salts > 0"), "salts", slim=True)
    members = pairs.join(salts.select("hub", "salts").hint("merge"), "hub").select("hub", "id", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    own = salts.select("hub", F.col("hub").alias("id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    total = (pairs.agg(F.sum("bytes")).first()[0] or 0) + (salts.agg(F.sum(F.col("salts") * F.col("bytes"))).first()[0] or 0)
    task = F.pmod(F.xxhash64("hub", "salt"), F.lit(max(1, -(-total // TASK_BYTES)))).cast("int")
    both = members.unionByName(own).withColumn("task", task)
    linked = scratch.write(confirm_hubs(both.join(texts.hint("merge"), "id"), width, percent), "hub_links", slim=True)
    labels = scratch.write(components(linked, scratch, "hub_stars"), "labels", slim=True)

    labelled = met.select("rep", "s1", "list").join(labels.select(F.col("node").alias("rep"), F.col("component")).hint("merge"), "rep", "left")
    labelled = scratch.write(labelled.select("rep", "s1", "list", F.coalesce("component", "rep").alias("label")), "labelled", slim=True)
    opened = labelled.groupBy("list").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("list")
    opened = scratch.write(labelled.join(opened.hint("merge"), "list"), "opened", slim=True)
    # which of a signature's coordinates are in its prefix, among those that are open
    marks = opened.groupBy("rep", "s1", "label").agg(F.collect_set("list").alias("open_lists")).join(signed.hint("merge"), ["rep", "s1"])
    marks = marks.withColumn("prefix", F.transform("lists", lambda x: F.array_contains("open_lists", x)))
    members = marks.select(F.explode("open_lists").alias("list"), "s1", F.col("rep").alias("id"), "label", "n_shingles", "bytes", "lists", "prefix")
    members = scratch.write(members.withColumn("one", F.lit(1)), "members")
    involved = scratch.write(collide(parted(members, TASK_DOCS, "one", scratch, "members").drop("one"), matches, percent).distinct(), "involved")
    own = texts.withColumnsRenamed({"id": "text_id"})
    more = parted(involved, TASK_BYTES, "bytes", scratch, "involved").join(own.hint("merge"), F.col("id") == F.col("text_id"))
    more = confirm_lists(more, width, matches, percent)
    linked = components(linked.union(more), scratch, "stars").select(F.col("node").alias("id"), "component")
    linked = scratch.write(linked, "linked", slim=True)
    scratch.drop("texts", "met", "pairs", "salts", "labelled", "opened", "members", "involved")

    if rows.where("not named").head(1):
        # keys are among the ids; of each component the smallest id stands for it, and a key only where there is none
        joined = classes.select(F.col("rep").alias("id"), "named").join(linked.hint("merge"), "id")
        names = joined.groupBy("component").agg(least_of("id", "named").alias("name"), F.max("named").alias("known"))
        linked = scratch.write(joined.join(names.hint("merge"), "component").select("id", F.col("name").alias("component"), "known"), "names", slim=True)
    else:
        linked = linked.withColumn("known", F.lit(True))
    reps = classes.select("s1", "s2", "rep", "named").join(linked.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    reps = scratch.write(reps.select("s1", "s2", F.coalesce("component", "rep").alias("component"), F.coalesce("known", "named").alias("known")), "reps", slim=True)
    out = rows.select("id", "named", "n_shingles", "s1", "s2").where("n_shingles > 0").join(reps.hint("merge"), ["s1", "s2"]).select("id", "named", "n_shingles", "component", "known")
    out = out.union(rows.where("n_shingles = 0").select("id", "named", "n_shingles", F.col("id").alias("component"), F.col("named").alias("known")))
    kept = (F.col("id") == F.col("component")) & (F.col("named") == F.col("known"))
    out = out.select(F.when(F.col("named"), F.col("id")).alias("doc_id"), "n_shingles", F.when(F.col("known"), F.col("component")).alias("component_id"), kept.alias("kept"), F.col("id").alias("key"))
    return out if with_key else out.drop("key")


def least_of(key: str, named: str):
    """The smallest doc_id of a group, or else its smallest key."""
    return F.coalesce(F.min(F.when(F.col(named), F.col(key))), F.min(key))
