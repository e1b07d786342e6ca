"""Mixing sources to target weights: budgets down a tree, token prefixes of seeded epochs.

The tree is domain, language, source. A node's capacity is the tokens below it times the
epochs allowed. A parent's budget goes to its children by weight; what a child cannot hold
goes to its siblings by weight. As a parent never gets more than its capacity, a shortage
reaches another branch only when all siblings are full: siblings come before ancestors.
Budgets round down to whole tokens at each level.

A leaf reads its documents epoch by epoch. An epoch's order is that of
md5(seed:epoch:doc_id), and the leaf takes the longest prefix of these epochs that fits its
budget. Only the last, partial epoch needs an order: hash ranges of about RANGE_ROWS rows
are summed first, and just the range in which the budget ends is sorted. A leaf with a
third of all rows is thus never gathered in one task.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.llm.shared import documents, sized, stored

RANGE_ROWS = 4096
LEVELS = ("domain", "lang", "source")

#: Targets of the registered query: weights among siblings, 1 where none is given.
DOMAIN_OF = "element_at(array('web', 'books', 'code', 'forum'), cast(crc32(coalesce(source, 'unknown')) % 4 + 1 as int))"
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"web": 4, "books": 3, "code": 2, "forum": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}
PERCENT, EPOCHS, SEED = 60, 2, 17


def words_in(text: Column) -> Column:
    """The number of whitespace-separated words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(nodes: DataFrame, parent: list[str], weight: Column, name: str) -> DataFrame:
    """Split ``budget`` of each parent among its rows: adds ``granted`` (whole tokens).

    nodes: the columns of ``parent``, ``name``, cap and budget. Children are full in the order of cap/weight;
    each full one leaves the rest of the budget to the weights of those that follow.
    """
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy("ratio", name)
    return (
        nodes.withColumn("w", weight.cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("rn", F.row_number().over(order))
        .withColumn("level", (F.col("budget") - F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)).cast("double")) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.coalesce("level", F.col("budget") / F.sum("w").over(group)))
        .withColumn("full", F.col("ratio") <= F.col("level"))
        .withColumn("end", F.min(F.when(~F.col("full"), F.struct("rn", "level"))).over(group))
        .withColumn("granted", F.when(F.col("end").isNull() | (F.col("rn") < F.col("end.rn")), F.col("cap")).otherwise(F.floor(F.col("w") * F.col("end.level"))).cast("long"))
        .drop("w", "ratio", "rn", "level", "full", "end")
    )


def weight_of(level: str, weights: Mapping[str, int]) -> Column:
    """Weights are whole numbers of at least 1."""
    if any(w < 1 for w in weights.values()):
        raise ValueError(f"weights of {level} must be at least 1")
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], percent: int, epochs: int) -> DataFrame:
    """leaves: domain, lang, source, available (tokens). Adds the leaf's budget."""
    nodes = leaves.withColumn("cap", F.col("available") * epochs)
    above = nodes.groupBy().agg(F.floor(F.sum("available") * percent / F.lit(100)).alias("want"), F.sum("cap").alias("most"))
    level = nodes.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(above.select(F.least("want", "most").alias("budget"))))
    keys: list[str] = []
    for name in LEVELS:
        if keys:
            parents = level.select(*keys, F.col("granted").alias("budget"))
            level = nodes.groupBy(*keys, name).agg(F.sum("cap").alias("cap")).join(parents, keys)
        level = fill(level, keys, weight_of(name, weights[name]), name)
        keys = [*keys, name]
    return leaves.join(level.select(*LEVELS, F.col("granted").alias("budget")), list(LEVELS))


def mix(docs: DataFrame, *, domain: str = DOMAIN_OF, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED, row: str | None = None) -> DataFrame:
    """Rows (doc_id, domain, lang, source, tokens, epoch), one for each time a document is read.

    percent: tokens wanted, of all tokens. Null texts and empty ones have no tokens and come
    with the prefix they fall into; null lang is the language ``und``, null source the source
    ``unknown``, a null doc_id hashes as the empty text. Repeated rows count each; ties of the
    order go by doc_id, then tokens. An empty table gives no rows. Other columns are ignored.
    row: a column that tells rows apart; it comes with the result and breaks the ties left.
    """
    own = [row] if row else []
    base = stored(
        docs.select("doc_id", F.expr(domain).alias("domain"), F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("source", F.lit("unknown")).alias("source"), words_in(F.col("text")).alias("tokens"), *own), "mix-rows"
    )
    leaves = stored(base.groupBy(*LEVELS).agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("n")), "mix-leaves")
    plan = leaf_budgets(leaves, weights, percent, epochs)
    plan = stored(
        plan.withColumn("whole", F.coalesce(F.floor(F.try_divide("budget", "available")), F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("available"))
        .withColumn("ranges", F.ceil(F.col("n") / RANGE_ROWS).cast("long")),
        "mix-plan",
    )
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = (
        base.join(sized(plan.select(*LEVELS, "whole", "rest", "ranges"), 100_000), list(LEVELS))
        .withColumn("key", key)
        .withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(2.0**32)).cast("long"))
    )
    per_leaf = Window.partitionBy(*LEVELS).orderBy("range")
    sums = rows.groupBy(*LEVELS, "range", "rest").agg(F.sum("tokens").alias("t")).withColumn("upto", F.sum("t").over(per_leaf))
    ends = stored(sums.where("upto > rest").groupBy(*LEVELS).agg(F.min("range").alias("last"), F.min_by(F.col("rest") - F.col("upto") + F.col("t"), "range").alias("room")), "mix-ends")
    cut = rows.join(sized(ends, 100_000), list(LEVELS), "left")
    columns = ["doc_id", *LEVELS, "tokens", "whole", *own]
    sure = cut.withColumn("more", F.col("last").isNull() | (F.col("range") < F.col("last"))).where("more or (whole > 0 and range > last)").select(*columns, "more")
    order = Window.partitionBy(*LEVELS).orderBy("key", "doc_id", "tokens", *own).rowsBetween(Window.unboundedPreceding, 0)
    edge = cut.where("range = last").withColumn("more", F.sum("tokens").over(order) <= F.col("room")).where("more or whole > 0").select(*columns, "more")
    taken = sure.union(edge).withColumn("reads", F.col("whole") + F.col("more").cast("long")).where("reads > 0")
    return taken.select("doc_id", *LEVELS, "tokens", F.explode(F.sequence(F.lit(1), F.least("reads", F.lit(epochs)).cast("int"))).alias("epoch"), *own)


def op8(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def _sql(percent: int, epochs: int, seed: int) -> str:
    def case(level: str) -> str:
        arms = " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in WEIGHTS[level].items())
        return f"CASE {arms} ELSE 1 END" if arms else "1"

    def level(name: str, parent: str, above: str) -> str:
        keys = f"{parent}, {name}" if parent else name
        by = f"PARTITION BY {parent}" if parent else ""
        budget = f"SELECT {parent}, granted AS budget FROM {above}" if parent else f"SELECT least((sum(available) * {percent}) // 100, sum(available) * {epochs}) AS budget FROM leaves"
        return f"""
{name}_0 AS (SELECT n.*, b.budget, CAST({case(name)} AS DOUBLE) AS w FROM (SELECT {keys}, CAST(sum(available * {epochs}) AS BIGINT) AS cap FROM leaves GROUP BY {keys}) n {f"JOIN ({budget}) b USING ({parent})" if parent else f"CROSS JOIN ({budget}) b"}),
{name}_1 AS (SELECT *, row_number() OVER o AS rn, (budget - coalesce(CAST(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM {name}_0 WINDOW o AS ({by} ORDER BY cap / w, {name})),
{name}_2 AS (SELECT *, min(CASE WHEN cap / w > lam THEN rn END) OVER ({by}) AS e FROM {name}_1),
{name}_3 AS (SELECT {keys}, CASE WHEN e IS NULL OR rn < e THEN cap ELSE CAST(floor(w * max(CASE WHEN rn = e THEN lam END) OVER ({by})) AS BIGINT) END AS granted FROM {name}_2)"""

    return f"""
WITH base AS (SELECT doc_id, list_extract(['web', 'books', 'code', 'forum'], CAST(CRC AS INT)) AS domain, lang, source, tokens FROM (
  SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(source, 'unknown') AS source, CASE coalesce(source, 'unknown') {" ".join(f"WHEN 'src{i}' THEN {_crc(f'src{i}') % 4 + 1}" for i in range(100))} WHEN 'unknown' THEN {_crc("unknown") % 4 + 1} END AS CRC,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents)),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS available FROM base GROUP BY ALL),
{level("domain", "", "")},{level("lang", "domain", "domain_3")},{level("source", "domain, lang", "lang_3")},
plan AS (SELECT *, CASE WHEN available > 0 THEN granted // available ELSE 0 END AS whole FROM leaves JOIN source_3 USING (domain, lang, source)),
ordered AS (SELECT b.*, whole, granted - whole * available AS rest, sum(tokens) OVER (PARTITION BY b.domain, b.lang, b.source ORDER BY md5('{seed}:' || (whole + 1) || ':' || doc_id), doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM base b JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(1, 1 + least({epochs}, whole + CAST(upto <= rest AS INT)))) AS INT) AS epoch FROM ordered"""


def _crc(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


ORACLE = _sql(PERCENT, EPOCHS, SEED)
