"""Hard negatives by norm-bucketed search.

Vectors become whole numbers, so that scores are exact inner products. Candidates are sorted by
norm and cut into buckets of about BUCKET_ROWS; queries are cut into blocks by what a vector's norm must be to
matter to them. By Cauchy-Schwarz no vector of a bucket scores more than the query's norm times the
bucket's largest: a pair of block and bucket is compared only if that reaches, for some query of it, the
lower limit of one of its windows and the score of its running k-th result. Buckets of the largest norms
go first, so that most queries have a k-th score when the rest is dealt out. Within a pair the bucket is gone through in
runs of falling norm, the k-th scores rise, and queries drop out as they can gain no more.

The search runs twice. First each anchor's nearest rows of its own label, its positives, are
found among buckets sorted by label and norm; then, for each positive, the best rows of other labels
whose score lies in a window below the positive's.

A pair returns at most k rows for each window of its queries, and a window's rows are cut to k before they are
shuffled. Nothing but the list of buckets and blocks, a few numbers each, is compared with each other as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.llm.shared import ROW, discard, sized, small_batches, stored, with_rows

#: Vectors in a bucket, queries in a block, about.
BUCKET_ROWS, BLOCK_ROWS = 8192, 2048
#: Vectors of a bucket, and queries, that are multiplied at a time.
RUN, QUERIES = 2048, 256
#: Share of the buckets, by falling norm, that the first round takes.
FIRST = 1 / 16
SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: The window below a positive's score, in percent of it.
WINDOW = (80, 100)
#: How a null vec_id is kept until the result: it comes last in ties.
NO_ID = np.iinfo(np.int64).max
FOUND = "query long, window int, row long, vec_id long, score long"


def numbers(vectors: DataFrame, label: str = "label", scale: int = SCALE) -> DataFrame:
    """Rows (ROW, vec_id, label, x, width, norm) of the vectors that take part: x are whole numbers, norm is rounded up.

    Rows with a null label, a null or empty vector, or a null or non-finite component take no part.
    """
    x = F.col("embedding").cast("array<double>")
    rows = with_rows(vectors).select(ROW, F.col("vec_id").cast("long").alias("vec_id"), F.expr(label).cast("long").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite)
    rows = rows.withColumn("x", F.transform("x", lambda v: F.floor(v * scale).cast("double")))
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    return rows.select("*", F.size("x").alias("width"), (F.sqrt(square) * (1 + 1e-12)).alias("norm"))


def _dealt(rows: DataFrame, name: str, each: int, *order) -> DataFrame:
    """A stored table of ``rows`` in ranges of about ``each``, with the number of the range as ``part``."""
    n = rows.count()
    if n <= each:
        return stored(rows.withColumn("part", F.lit(0)), name)
    return stored(rows.repartitionByRange(max(1, -(-n // each)), *order).withColumn("part", F.spark_partition_id()), name)


def buckets(rows: DataFrame, by_label: bool) -> DataFrame:
    """A stored table of the candidates in buckets: sorted by label first or not, then by falling norm, then by vec_id and place."""
    own = [F.col("label").asc()] if by_label else []
    return _dealt(rows, "negatives-buckets", BUCKET_ROWS, *own, F.desc("norm"), F.col("vec_id").asc_nulls_last(), F.col(ROW).asc())


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.values.to_numpy(zero_copy_only=False)
    at = column.offsets.to_numpy()
    return values[at[0] : at[-1]].astype(np.float64).reshape(len(column), -1)


def search_pair(q: dict, c: dict, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """Best k candidates of each query window, as arrays (query, window, row, vec_id, score).

    q: x, norm, label, row, and for each window (columns) low, high and kth, the score that k
    rows found before have at least; c: x, norm, label, row, vec_id.
    """
    n, windows = q["low"].shape
    score, ids, rows = np.full((n, windows, k), -np.inf), np.full((n, windows, k), NO_ID), np.full((n, windows, k), NO_ID)
    kth, last = q["kth"].copy(), np.full((n, windows), NO_ID)
    falling = np.lexsort((c["row"], c["vec_id"], -c["norm"]))
    for lo in range(0, len(falling), RUN):
        run = falling[lo : lo + RUN]
        most = c["norm"][run[0]]
        run = run[np.lexsort((c["row"][run], c["vec_id"][run]))]  # columns by id, so that a stable order of scores settles ties
        x, label, row, vec = (c[f][run] for f in ("x", "label", "row", "vec_id"))
        live = np.flatnonzero((np.maximum(q["low"], kth) <= (q["norm"] * most)[:, None] + 0.5).any(axis=1))
        for a in range(0, len(live), QUERIES):
            some = live[a : a + QUERIES]
            s = q["x"][some] @ x.T
            fits = (q["label"][some, None] == label) == same
            if same:
                fits &= q["row"][some, None] != row
            for w in range(windows):
                least, at = kth[some, w, None], last[some, w, None]
                hit = fits & (s >= q["low"][some, w, None]) & (s <= q["high"][some, w, None]) & ((s > least) | ((s == least) & (vec < at)))
                i = np.flatnonzero(hit.any(axis=1))
                if not len(i):
                    continue
                own = np.where(hit[i], s[i], -np.inf)
                best = np.argsort(-own, axis=1, kind="stable")[:, :k]
                m = some[i]
                both = [np.concatenate(z, axis=1) for z in ((score[m, w], np.take_along_axis(own, best, 1)), (ids[m, w], vec[best]), (rows[m, w], row[best]))]
                order = np.lexsort((both[2], both[1], -both[0]))[:, :k]
                score[m, w], ids[m, w], rows[m, w] = (np.take_along_axis(z, order, 1) for z in both)
                better = score[m, w, -1] > kth[m, w]
                kth[m[better], w] = score[m[better], w, -1]
                last[m, w] = np.where(score[m, w, -1] == kth[m, w], ids[m, w, -1], last[m, w])
    i, w, j = np.nonzero(score > -np.inf)
    return q["row"][i], w.astype(np.int32), rows[i, w, j], ids[i, w, j], score[i, w, j].astype(np.int64)


def search(queries: DataFrame, dealt: DataFrame, k: int, same: bool) -> DataFrame:
    """A stored table FOUND of the best ``k`` candidates in each window of each query: highest scores first, ties by vec_id, null ones last, then place.

    queries: ROW, x, width, norm, label and windows, an array of struct(low double, high double), the same number for each row.
    dealt: made by ``buckets``. same: candidates must have the query's label, and not be its row, or must have another label.
    """
    far = float("-inf")
    about = stored(dealt.groupBy("part", "width").agg(F.max("norm").alias("most"), F.min("label").alias("from"), F.max("label").alias("to")), "negatives-about")
    n = about.count()
    ranked = stored(about.withColumn("at", F.row_number().over(Window.orderBy(F.desc("most"), "part", "width"))), "negatives-order")  # a row a bucket
    early = F.col("at") <= max(1, round(FIRST * n))
    if same:  # each label's bucket of largest norms
        early = early | (F.row_number().over(Window.partitionBy("from", "width").orderBy(F.desc("most"), "part")) == 1)
    rounds = stored(ranked.withColumn("early", early), "negatives-rounds")
    found = None
    for now in (True, False):
        left = rounds.where(F.col("early") == now)
        if not left.limit(1).count():
            continue
        found_so_far = found
        asked = queries.withColumn("kth", F.transform("windows", lambda w: F.lit(far)))
        if found_so_far is not None:
            full = found_so_far.groupBy("query", "window").agg(F.min("score").cast("double").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
            full = stored(full.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "s"))).alias("full")), "negatives-kth")  # as many as a query has windows
            asked = queries.join(sized(full, 100_000), F.col(ROW) == F.col("query"), "left")
            asked = asked.withColumn("kth", F.transform("windows", lambda w, i: F.coalesce(F.try_element_at("full", i), F.lit(far)))).drop("query", "full")
        least = F.array_min(F.transform(F.arrays_zip("windows", "kth"), lambda z: F.greatest(z["windows"]["low"], z["kth"])))
        asked = asked.withColumn("need", F.coalesce(F.try_divide(least, F.col("norm")), F.lit(far)))
        # a query of norm zero scores 0 everywhere: it needs any bucket if 0 is enough
        asked = asked.withColumn("need", F.when(F.col("norm") == 0, F.when(least <= 0, far).otherwise(float("inf"))).otherwise(F.col("need")))
        own = [F.col("label").asc()] if same else []
        blocks = _dealt(asked, "negatives-blocks", BLOCK_ROWS, *own, F.desc("need"), F.col(ROW).asc())
        reach = stored(blocks.groupBy(F.col("part").alias("block"), F.col("width").alias("wide")).agg(F.min("need").alias("least"), F.min("label").alias("low_label"), F.max("label").alias("high_label")), "negatives-reach")
        meet = (F.col("wide") == F.col("width")) & (F.col("least") <= F.col("most") * (1 + 1e-9))
        if same:
            meet &= (F.col("low_label") <= F.col("to")) & (F.col("from") <= F.col("high_label"))
        pairs = stored(reach.join(left, meet).select("block", "part", "width").withColumn("pair", F.monotonically_increasing_id()), "negatives-pairs")
        zero = F.array().cast("array<double>")
        one = blocks.withColumnRenamed("part", "block").join(sized(pairs, 200_000), ["block", "width"])
        one = one.select("pair", F.lit(0).alias("side"), ROW, F.lit(None).cast("long").alias("vec_id"), "label", "norm", "x", F.col("windows.low").alias("low"), F.col("windows.high").alias("high"), "kth")
        two = dealt.join(sized(pairs, 200_000), ["part", "width"]).select("pair", F.lit(1).alias("side"), ROW, "vec_id", "label", "norm", "x", zero.alias("low"), zero.alias("high"), zero.alias("kth"))

        def compare(group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            side = group["side"].to_numpy()
            parts = [group.filter(pa.array(side == v)).combine_chunks() for v in (0, 1)]

            def arrays(t: pa.Table, lists: tuple[str, ...]) -> dict:
                out = {f: t[f].to_numpy() for f in ("norm", "label")} | {"row": t[ROW].to_numpy()}
                out["vec_id"] = t["vec_id"].fill_null(NO_ID).to_numpy()
                return out | {f: _matrix(t[f].chunk(0) if t[f].num_chunks else pa.array([], t[f].type)) for f in lists}

            q, c = arrays(parts[0], ("x", "low", "high", "kth")), arrays(parts[1], ("x",))
            return pa.table(dict(zip(("query", "window", "row", "vec_id", "score"), search_pair(q, c, k, same))))

        new = one.union(two).groupBy("pair").applyInArrow(compare, FOUND)
        new = new.union(found_so_far) if found_so_far is not None else new
        order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "vec_id", "row")
        found = stored(new.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place"), "negatives-found")
        discard(blocks, *([found_so_far] if found_so_far is not None else []))
    return found if found is not None else dealt.sparkSession.createDataFrame([], FOUND)


def mine(vectors: DataFrame, anchors: str = "vec_id % 100 = 0", *, label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives in ``vectors`` (vec_id, label, embedding).

    anchors: a condition on vec_id; label: an expression over the columns. An anchor's positives are the ``positives`` best other rows of its label;
    for each, the ``negatives`` best rows of other labels with low * positive_score <= 100 *
    negative_score <= high * positive_score are returned, where ``window`` is (low, high). Scores are inner products of the components
    times ``scale``, rounded down; they are exact below 2^53. Vectors of different lengths never meet. Rows with a null label, a null or
    empty vector, or a null or non-finite component take no part; those with a null vec_id come last in ties and
    are no anchors. Repeated rows are rows of their own, ties among them are alike. Anchors without a positive
    and positives without a negative give no rows, nor does an empty table. Other columns are ignored.
    """
    small_batches(vectors.sparkSession, 10_000)
    rows = stored(numbers(vectors, label, scale), "negatives-rows")
    asked = rows.where(anchors)
    free = F.array(F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    by_label = buckets(rows, True)
    near = search(asked.select(ROW, "x", "width", "norm", "label", free.alias("windows")), by_label, positives, True)
    discard(by_label)
    low, high = window
    limits = near.select("query", F.col("vec_id").alias("positive_id"), F.col("row").alias("positive_row"), F.col("score").alias("positive_score"))
    limits = limits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("positive_score"), "positive_id", "positive_row")) - 1)
    limits = stored(limits, "negatives-positives")
    # whole scores from ceil(low * p / 100) to floor(high * p / 100), in whole numbers
    least, most = -F.floor(-low * F.col("positive_score") / 100), F.floor(high * F.col("positive_score") / 100)
    ranges = limits.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", least.cast("double").alias("low"), most.cast("double").alias("high")))).alias("windows"))
    none = F.struct(F.lit(float("inf")).alias("low"), F.lit(float("-inf")).alias("high"))
    filled = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.try_element_at("windows", i), F.struct(F.lit(0).alias("rank"), none["low"].alias("low"), none["high"].alias("high"))))
    filled = F.transform(filled, lambda z: F.struct(z["low"].alias("low"), z["high"].alias("high")))
    wanted = asked.join(sized(stored(ranges, "negatives-windows"), 100_000), F.col(ROW) == F.col("query")).select(ROW, "x", "width", "norm", "label", filled.alias("windows"))
    by_norm = buckets(rows, False)
    hard = search(wanted, by_norm, negatives, False)
    discard(by_norm)
    names = asked.select(F.col(ROW).alias("anchor"), F.col("vec_id").alias("anchor_id"))
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "vec_id", "row")
    ranked = hard.withColumn("rank", F.row_number().over(order)).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    limits = limits.withColumnsRenamed({"query": "q", "rank": "w"})
    out = ranked.join(sized(limits, 100_000), (F.col("query") == F.col("q")) & (F.col("window") == F.col("w"))).join(sized(stored(names, "negatives-names"), 100_000), F.col("query") == F.col("anchor"))
    known = [F.when(F.col(c) != int(NO_ID), F.col(c)).alias(c) for c in ("positive_id", "negative_id")]
    return out.select("anchor_id", known[0], "rank", known[1], "positive_score", "negative_score")


def op11(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label="if(vec_id % 7 = 0, pmod(cast(label as long) + 1, 10), label)")


ORACLE = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS r FROM s WHERE same) WHERE r <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS INT) AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {WINDOW[0]} * p.score <= 100 * s.score AND 100 * s.score <= {WINDOW[1]} * p.score)
SELECT * FROM n WHERE rank <= {NEGATIVES}"""
