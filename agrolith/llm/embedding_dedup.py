"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Unit vectors are rotated to the axes of their covariance, largest variance first. Distinct
vectors are cut into slabs along the first axis and the slabs into blocks along the second,
all of about BLOCK_ROWS vectors; what is twice as large, as many vectors tie, is dealt by hash. Pairs of blocks are compared, one task a pair, tile by tile: the products
of the leading STEP axes are added up first, and a pair goes on to the next axes only while
its sum, plus the product of the two rests' norms, can reach the threshold. What is left
after the last axis is decided by the cosine of the given vectors in double precision. Two
blocks are never paired whose boxes over the BOX leading axes are further apart than any
pair above the threshold can be; the table of blocks is joined with itself by cells of the
first axis to find the others, so that nothing about blocks passes the driver.

A task returns for each of its vectors the number linked, and one edge to the least vector
it is joined with there; pairs themselves are not written out. Equal vectors are one vector
with a weight. Vectors of each length that occurs are compared with those of that length.
Work is that of all pairs of blocks that may hold a link, as the method has it, with most
of it in the leading axes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.llm.shared import components, discard, sized, stored

THRESHOLD = 0.95
BLOCK_ROWS = 4096
TILE = 1024
#: Pairs whose given vectors are multiplied at a time.
STRIP = 1 << 14
STEP = 8
#: Leading axes over which blocks have boxes.
BOX = 8
#: Beyond rounding of the partial sums; only pairs this near or nearer are decided exactly.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.values.to_numpy(zero_copy_only=False)
    at = column.offsets.to_numpy()
    return values[at[0] : at[-1]].astype(np.float64).reshape(len(column), -1)


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Of vectors of this length: axes of the second moments of the unit vectors, as columns; all rows count.

    Tasks return one width x width matrix each, which are summed by a tree of tasks.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = _matrix(b.column(0))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"])

    rows = vectors.select("embedding").mapInArrow(moments, "row int, sums array<double>").select("row", F.posexplode("sums").alias("col", "s")).groupBy("row", "col").agg(F.sum("s").alias("s")).collect()
    m = np.zeros((width, width))
    for r in rows:  # width squared
        m[r["row"], r["col"]] = r["s"]
    values, axes = np.linalg.eigh((m + m.T) / 2)
    return np.ascontiguousarray(axes[:, np.argsort(-values)])


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of ``n`` is joined with by the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def candidates(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each pair of tiles: pairs of rows of the rotated unit vectors ``x``, ``y`` that may reach the threshold, TILE squared at most."""
    width = x.shape[1]
    rest_x, rest_y = (np.sqrt(np.maximum(0, np.cumsum((z**2)[:, ::-1], axis=1)[:, ::-1])) for z in (x, y))
    rest_x, rest_y = (np.concatenate([z, np.zeros((len(z), 1))], axis=1) for z in (rest_x, rest_y))
    first = min(2 * STEP, width)
    for a in range(0, len(x), TILE):
        for b in range(a if same else 0, len(y), TILE):
            u, v = x[a : a + TILE], y[b : b + TILE]
            part = u[:, :first] @ v[:, :first].T
            bound = part + rest_x[a : a + TILE, first, None] * rest_y[None, b : b + TILE, first]
            i, j = np.nonzero(bound >= threshold - SLACK)
            if same and a == b:
                keep = i < j
                i, j = i[keep], j[keep]
            p = part[i, j]
            for k in range(first, width, STEP):
                if not len(i):
                    break
                e = min(width, k + STEP)
                p = p + np.einsum("ij,ij->i", u[i, k:e], v[j, k:e])
                keep = p + rest_x[a + i, e] * rest_y[b + j, e] >= threshold - SLACK
                i, j, p = i[keep], j[keep], p[keep]
            if len(i):
                yield i + a, j + b


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (vec_id, n_links, component_id), one for each row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty or zero, or hold null or non-finite components, are linked
    with nothing, others with those of their own length. Repeated rows are vectors of
    their own. A null vec_id has links but never names a component. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    sound = rows.where(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    kinds = stored(sound.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("kind", F.monotonically_increasing_id()), "vectors-kinds")
    widths = [r.d for r in kinds.select(F.size("embedding").alias("d")).distinct().collect()]
    if not widths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    tables = [_links(kinds.where(F.size("embedding") == d).select("kind", "copies", "embedding"), d, threshold) for d in sorted(widths)]
    found = reduce(DataFrame.union, tables)
    joined = components(found.select(F.col("kind").alias("a"), F.col("root").alias("b")), "vectors-components")
    totals = found.groupBy("kind").agg(F.sum("links").alias("links"))
    about = kinds.select("kind", "embedding", "rep", "copies").join(totals, "kind", "left").join(joined.select(F.col("node").alias("kind"), "component"), "kind", "left")
    about = stored(about.withColumn("component", F.coalesce("component", "kind")), "vectors-about")
    least = about.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = about.where("copies > 1 or links > 0").join(least, "component").select("embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    linked = stored(linked.withColumnRenamed("embedding", "same"), "vectors-linked")
    discard(kinds, about, *tables)
    out = rows.join(sized(linked, 50_000), F.col("embedding") == F.col("same"), "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def _blocks(turned: DataFrame, n: int) -> DataFrame:
    """``turned`` (kind, lead, ...) with the number of each row's block: slabs by the first axis, cut by the second."""
    blocks = max(1, -(-n // BLOCK_ROWS))
    slabs = max(1, round(blocks**0.5))
    each = -(-blocks // slabs)
    first, second = F.element_at("lead", 1), F.element_at("lead", F.least(F.lit(2), F.size("lead")))
    where = lambda x, cuts: F.size(F.filter(cuts, lambda c: c < x))
    cuts = turned.agg(F.percentile_approx(first, [i / slabs for i in range(1, slabs)], 20 * slabs)).first()[0] if slabs > 1 else []  # the root of the number of blocks
    slabbed = turned.withColumn("slab", where(first, F.array(*[F.lit(c) for c in cuts])) if slabs > 1 else F.lit(0))
    inner = slabbed.groupBy("slab").agg(F.percentile_approx(second, [i / each for i in range(1, each)] or [0.5], 20 * each).alias("cuts"))
    inner = stored(inner, "vectors-cuts")  # a row a slab
    cut = slabbed.join(sized(inner, 1000), "slab").withColumn("block", F.col("slab") * F.lit(each).cast("long") + (where(second, F.col("cuts")) if each > 1 else F.lit(0))).drop("cuts", "slab")
    # vectors that both axes tie stay in one block, however many: such blocks are dealt by hash
    large = stored(cut.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * BLOCK_ROWS).select(F.col("block").alias("of"), F.ceil(F.col("n") / BLOCK_ROWS).alias("pieces")), "vectors-large")
    piece = F.coalesce(F.pmod(F.xxhash64("kind"), F.col("pieces")), F.lit(0))
    return cut.join(sized(large, 100_000), F.col("block") == F.col("of"), "left").withColumn("block", F.col("block") * F.lit(1 << 24) + piece).drop("of", "pieces")


def _near(blocked: DataFrame, box: int, reach: float) -> DataFrame:
    """Pairs (block, pair, side) of blocks whose boxes are within ``reach``; both sides of a pair are rows."""
    ends = [f(F.element_at("lead", i)).alias(f"{name}{i}") for i in range(1, box + 1) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    boxes = stored(blocked.groupBy("block").agg(*ends), "vectors-boxes")
    cells = F.sequence(F.floor(F.col("lo1") / reach).cast("int"), F.floor(F.col("hi1") / reach).cast("int"))
    a = boxes.select("*", F.explode(cells).alias("cell"))
    b = boxes.select(*[F.col(c).alias(f"{c}_") for c in boxes.columns], F.explode(F.sequence(F.floor(F.col("lo1") / reach).cast("int") - 1, F.floor(F.col("hi1") / reach).cast("int") + 1)).alias("cell"))
    gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(f"hi{i}_"), F.col(f"lo{i}_") - F.col(f"hi{i}")), 2) for i in range(1, box + 1))
    pairs = a.join(b, "cell").where(F.col("block") <= F.col("block_")).where(gap <= reach**2).select("block", "block_").distinct()
    numbered = stored(pairs.withColumn("pair", F.monotonically_increasing_id()), "vectors-pairs")
    return stored(numbered.select("block", "pair", F.lit(0).alias("side")).union(numbered.where("block <> block_").select("block_", "pair", F.lit(1))), "vectors-near")


def _links(kinds: DataFrame, width: int, threshold: float) -> DataFrame:
    """A stored table (kind, links, root) of the vectors of one length that are linked, for each pair of blocks where they are."""
    axes = kinds.sparkSession.sparkContext.broadcast(principal_axes(kinds, width))
    box = min(BOX, width)

    @F.arrow_udf("array<double>")
    def lead(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            x = _matrix(column)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * box), pa.array((x @ axes.value[:, :box]).ravel()))

    turned = stored(kinds.withColumn("lead", lead("embedding")), "vectors-turned")
    blocked = stored(_blocks(turned, turned.count()), "vectors-blocks")
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    near = _near(blocked.select("block", "lead"), box, reach)
    dealt = blocked.select("kind", "copies", "embedding", "block").join(sized(near, 100_000), "block")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        raw = _matrix(group["embedding"].combine_chunks() if group["embedding"].num_chunks != 1 else group["embedding"].chunk(0))
        norm = np.linalg.norm(raw, axis=1)
        y = (raw / norm[:, None]) @ axes.value
        side = group["side"].to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(b)
        copies = group["copies"].to_numpy()
        links, root, every = np.zeros(len(raw)), np.arange(len(raw)), np.arange(len(raw))
        for p, q in candidates(y[a], y[a] if same else y[b], threshold, same):  # a tile's pairs are counted and joined, then forgotten
            p, q = a[p], a[q] if same else b[q]
            hit = np.concatenate([np.einsum("ij,ij->i", raw[p[lo : lo + STRIP]], raw[q[lo : lo + STRIP]]) / (norm[p[lo : lo + STRIP]] * norm[q[lo : lo + STRIP]]) >= threshold for lo in range(0, len(p), STRIP)])
            p, q = p[hit], q[hit]
            links += np.bincount(p, copies[q], len(raw)) + np.bincount(q, copies[p], len(raw))
            new = root[p] != root[q]
            if new.any():
                root = roots(len(raw), np.concatenate([every, p[new]]), np.concatenate([root, q[new]]))
        has = np.flatnonzero(links > 0)
        kind = group["kind"].to_numpy()
        return pa.table({"kind": pa.array(kind[has]), "links": pa.array(links[has].astype(np.int64)), "root": pa.array(kind[root[has]])})

    found = stored(dealt.select("kind", "copies", "embedding", "pair", "side").groupBy("pair").applyInArrow(compare, "kind long, links long, root long"), "vectors-links")
    discard(turned, blocked)
    return found


def op6(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE sound AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id"""
