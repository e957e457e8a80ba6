"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens goes down the tree domain, language, source.  Each node
deals its budget to its children by weight; a child that can't use its part
(its tokens times ``max_epochs``) leaves the rest to its siblings by weight,
and only what all of them can't use is left to the siblings of the node above.
A leaf spends its budget in epochs: whole ones first, then the token-prefix of
one more, in an order seeded by the epoch.  All amounts are whole tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

LEAF = ["domain", "mix_lang", "mix_source"]
#: Production parameters of the query: sources of each domain, and weights; what isn't named weighs 1.
DOMAINS = {"web": [f"src{i}" for i in range(5)], "books": [f"src{i}" for i in range(5, 10)], "code": [f"src{i}" for i in range(10, 15)], "reference": [f"src{i}" for i in range(15, 20)]}
WEIGHTS = {"domain": {"web": 50, "books": 20, "code": 15, "reference": 15, "other": 5}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 6}}
MAX_EPOCHS = 4
SEED = 17
#: Digits of the order's key that the parts of a leaf share: 256 parts of a leaf, and 4096 of one of these.
DIGITS = (2, 3)
#: Leaves beyond which the leaf table is joined by shuffle instead of broadcast.
BROADCAST_LEAVES = 100_000


def by_table(value: Column, pairs: dict, default) -> Column:
    found = F.lit(None)
    for k, v in pairs.items():
        found = F.when(value == k, F.lit(v)).otherwise(found)
    return F.coalesce(found, F.lit(default))


def domain_of(source: Column, domains: dict[str, list[str]] = DOMAINS) -> Column:
    return by_table(source, {s: d for d, sources in domains.items() for s in sources}, "other")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def deal(nodes: DataFrame, parent: list[str], node: str, budget: str) -> DataFrame:
    """Adds ``share``: the part of ``budget`` that each node gets among its siblings (cap, weight; whole numbers).

    In the order of cap/weight the nodes that are filled come first: those whose
    cap is within their part of what is left by the ones before.  The rest is
    dealt to the others by weight, rounded down at each running sum of weights,
    so that no token of it is lost.
    """
    siblings = Window.partitionBy(*parent)
    order = siblings.orderBy(F.col("cap") / F.col("weight"), node)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spent, used = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("cap", "weight"))
    full = F.col("cap") * (F.sum("weight").over(siblings) - used) <= (F.col(budget) - spent) * F.col("weight")
    shared = nodes.withColumn("full", full)
    open_weight = F.when(F.col("full"), 0).otherwise(F.col("weight"))
    left = F.col(budget) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(siblings), F.lit(0))
    upto = F.sum(open_weight).over(order.rowsBetween(Window.unboundedPreceding, 0))
    shared = shared.withColumn("left", left).withColumn("upto", upto).withColumn("open_weight", F.sum(open_weight).over(siblings))
    share = F.expr("(left * upto) div open_weight - (left * (upto - weight)) div open_weight")
    return shared.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(share)).drop("full", "left", "upto", "open_weight")


def leaf_plan(leaves: DataFrame, budget: int | None, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Leaves (LEAF, tokens) with budget, epochs (whole ones) and rest (tokens of one epoch more)."""
    tree = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    top = tree.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    total = Window.partitionBy(F.lit(0))
    asked = F.least(F.lit(budget).cast("long") if budget is not None else F.sum("tokens").over(total), F.sum("cap").over(total))
    top = top.select("domain", "cap", by_table(F.col("domain"), weights["domain"], 1).alias("weight"), asked.alias("total"))
    top = deal(top, ["total"], "domain", "total").select("domain", F.col("share").alias("domain_budget"))
    mid = tree.groupBy("domain", "mix_lang").agg(F.sum("cap").alias("cap")).withColumn("weight", by_table(F.col("mix_lang"), weights["lang"], 1)).join(top, "domain")
    mid = deal(mid, ["domain"], "mix_lang", "domain_budget").select("domain", "mix_lang", F.col("share").alias("lang_budget"))
    low = tree.withColumn("weight", by_table(F.col("mix_source"), weights["source"], 1)).join(mid, ["domain", "mix_lang"])
    low = deal(low, ["domain", "mix_lang"], "mix_source", "lang_budget")
    epochs = F.when(F.col("tokens") == 0, 1).otherwise(F.floor(F.col("share") / F.when(F.col("tokens") > 0, F.col("tokens")))).cast("long")
    low = low.select(*LEAF, "tokens", F.col("share").alias("leaf_budget"), epochs.alias("epochs"))
    return low.withColumn("rest", F.when(F.col("tokens") > 0, F.col("leaf_budget") - F.col("epochs") * F.col("tokens")).otherwise(0))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(docs: DataFrame, budget: int | None = None, max_epochs: int = MAX_EPOCHS, weights: dict = WEIGHTS, domains: dict = DOMAINS, seed: int = SEED) -> DataFrame:
    """``docs`` with domain, n_tokens, leaf_budget and copies (long): how many epochs take the document.

    Other columns pass through; input columns of these names are replaced.
    ``budget`` defaults to the tokens there are.  Null languages and sources
    are leaves of their own, named ''.  A null text has no token.  Documents of
    a leaf without any token are taken once.  Rows that repeat a doc_id stand
    next to each other in the order and count each.  No text shuffles, but for
    the rows of one part in a million of each leaf, in which the prefix ends:
    it is looked for in two steps, so that no task sums up more than 4096 parts.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    named = ["domain", "n_tokens", "leaf_budget", "copies"]
    docs = docs.drop(*named)
    source = F.coalesce(F.col("source"), F.lit(""))
    tagged = docs.select(F.struct("*").alias("row"), "doc_id", domain_of(source, domains).alias("domain"), F.coalesce("lang", F.lit("")).alias("mix_lang"), source.alias("mix_source"), n_tokens(F.col("text")).alias("n_tokens"))
    slim = scratch.write(tagged.drop("row"), "slim")
    leaves = slim.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    plan = scratch.write(leaf_plan(leaves, budget, max_epochs, weights), "plan", slim=True)
    hint = F.broadcast if plan.count() <= BROADCAST_LEAVES else (lambda x: x)

    key = order_key(seed, F.col("epochs"), F.col("doc_id"))
    part = F.substring("key", 1, sum(DIGITS))
    plan = plan.withColumns({"part": F.lit(""), "start": F.lit(0).cast("long")})
    for i, digits in enumerate(DIGITS):
        inside = slim.join(hint(plan), LEAF).withColumn("key", key).where(F.startswith("key", "part"))
        parts = inside.groupBy(*LEAF, F.substring("key", 1, sum(DIGITS[: i + 1])).alias("next")).agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"), F.max("start").alias("start"))
        upto = F.col("start") + F.sum("n").over(Window.partitionBy(*LEAF).orderBy("next").rowsBetween(Window.unboundedPreceding, 0))
        parts = parts.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        ends = parts.groupBy(*LEAF).agg(F.min_by(F.struct("next", (F.col("upto") - F.col("n")).alias("start")), "next").alias("end"))
        plan = plan.drop("part", "start").join(ends, LEAF, "left").select(*LEAF, "leaf_budget", "epochs", "rest", F.col("end.next").alias("part"), "end.start")
        plan = scratch.write(plan, f"ends_{i}", slim=True)

    dealt = tagged.join(hint(plan), LEAF).withColumn("key", key).withColumn("own", part)
    clear = dealt.where(~F.col("own").eqNullSafe(F.col("part")))
    clear = clear.withColumn("copies", F.col("epochs") + F.when(F.col("own") < F.col("part"), 1).otherwise(0))
    edge = dealt.where(F.col("own") == F.col("part"))
    prefix = Window.partitionBy(*LEAF).orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("copies", F.col("epochs") + F.when(F.col("start") + F.sum("n_tokens").over(prefix) <= F.col("rest"), 1).otherwise(0))
    both = clear.unionByName(edge)
    return both.select(*[F.col("row")[c].alias(c) for c in docs.columns], *[F.col(c).cast("long") if c != "domain" else F.col(c) for c in named])


def _sql_case(column: str, pairs: dict, default) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in pairs.items()) + f" ELSE {quote(default)} END"


def _sql_deal(name: str, source: str, parent: str, node: str, budget: str) -> str:
    return f"""
{name}_1 AS (SELECT *, cap * (sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER b, 0)) <= ({budget} - coalesce(sum(cap) OVER b, 0)) * weight AS filled
  FROM {source} WINDOW b AS (PARTITION BY {parent} ORDER BY cap / weight, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_2 AS (SELECT *, {budget} - coalesce(sum(cap) FILTER (filled) OVER (PARTITION BY {parent}), 0) AS remains, sum(weight) FILTER (NOT filled) OVER (PARTITION BY {parent}) AS open_weight,
  sum(weight) FILTER (NOT filled) OVER (PARTITION BY {parent} ORDER BY cap / weight, {node} ROWS UNBOUNDED PRECEDING) AS upto FROM {name}_1),
{name} AS (SELECT *, CASE WHEN filled THEN cap ELSE ((remains * upto) // open_weight - (remains * (upto - weight)) // open_weight)::BIGINT END AS share FROM {name}_2)"""


ORACLE = f"""
WITH d AS (SELECT doc_id, lang, source, {_sql_case("source", {s: d for d, sources in DOMAINS.items() for s in sources}, "other")} AS domain,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {MAX_EPOCHS} AS cap FROM d GROUP BY ALL),
n1 AS (SELECT domain, sum(cap)::BIGINT AS cap, {_sql_case("domain", WEIGHTS["domain"], 1)} AS weight, sum(sum(tokens)) OVER () ::BIGINT AS budget FROM leaves GROUP BY domain),
{_sql_deal("s1", "n1", "budget", "domain", "budget")},
n2 AS (SELECT domain, lang, sum(cap)::BIGINT AS cap, {_sql_case("lang", WEIGHTS["lang"], 1)} AS weight, any_value(share) AS budget FROM leaves JOIN (SELECT domain, share FROM s1) USING (domain) GROUP BY domain, lang),
{_sql_deal("s2", "n2", "domain", "lang", "budget")},
n3 AS (SELECT leaves.*, {_sql_case("source", WEIGHTS["source"], 1)} AS weight, share AS budget FROM leaves JOIN (SELECT domain, lang, share FROM s2) USING (domain, lang)),
{_sql_deal("s3", "n3", "domain, lang", "source", "budget")},
p AS (SELECT domain, lang, source, share AS leaf_budget, CASE WHEN tokens = 0 THEN 1 ELSE share // tokens END AS epochs, CASE WHEN tokens = 0 THEN -1 ELSE share % tokens END AS rest FROM s3),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || epochs || ':' || doc_id), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS copies, epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0 AS kept FROM o
"""
