"""Joins beyond equality: as of, by overlap, nearest and fuzzy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, on: list[str], time: str, columns: list[str], bucket: str = "year") -> DataFrame:
    """For each row of ``left`` the latest row of ``right`` of the same key at or before its time.

    Both sides become one table, sorted by key and time, in which the last right row is carried
    forward: work is that of a sort, however many rows a key has on both sides. The sort is done by
    key and ``bucket`` of time, so that a hot key goes to many tasks; a bucket begins with the
    last right row of those before it. Right rows that share key and time: the greatest struct of columns.
    """
    period = F.trunc(F.col(time).cast("date"), bucket).alias("__period")
    last = right.groupBy(*on, time).agg(F.max(F.struct(*columns)).alias("v")).select(*on, time, period, F.struct(F.col(time).alias("at"), "v").alias("__right"))
    tails = last.groupBy(*on, "__period").agg(F.max_by("__right", time).alias("__tail"))
    none = F.lit(None).cast(last.schema["__right"].dataType)
    periods = tails.unionByName(left.select(*on, period).distinct().withColumn("__tail", none)).groupBy(*on, "__period").agg(F.max("__tail").alias("__tail"))
    before = Window.partitionBy(*on).orderBy("__period").rowsBetween(Window.unboundedPreceding, -1)
    opening = periods.select(*on, "__period", F.last("__tail", ignorenulls=True).over(before).alias("__right")).where("__right is not null")
    rows = left.select(*on, time, period, F.lit(2).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__left"), none.alias("__right"))
    empty = F.lit(None).cast(rows.schema["__left"].dataType).alias("__left")
    both = rows.unionByName(last.select(*on, time, "__period", F.lit(1).alias("__side"), empty, "__right"))
    both = both.unionByName(opening.select(*on, F.lit(None).cast(rows.schema[time].dataType).alias(time), "__period", F.lit(0).alias("__side"), empty, "__right"))
    w = Window.partitionBy(*on, "__period").orderBy(F.col("__side") > 0, time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__right", F.last("__right", ignorenulls=True).over(w)).where("__side = 2")
    known = F.col(time).isNotNull()
    for c in on:
        known = known & F.col(c).isNotNull()
    at = F.when(known, F.col("__right"))
    return found.select(*[F.col(f"__left.{c}").alias(c) for c in left.columns], at["at"].alias("as_of"), *[at["v"][c].alias(c) for c in columns])


def previous_month(left: DataFrame, right: DataFrame, date: str, month: str, keys: list[str]) -> DataFrame:
    """Join the month before that of ``date``: monthly covariates are known only after the month ends."""
    return left.withColumn("__month", F.add_months(F.trunc(date, "MM"), -1)).join(right.withColumnRenamed(month, "__month"), [*keys, "__month"], "left").drop("__month")


def year_before(df: DataFrame, keys: list[str], year: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the value of the same keys a year before."""
    last = df.select(*keys, (F.col(year) + 1).alias(year), F.col(value).alias(name))
    return df.join(last, [*keys, year], "left")


def box_overlap(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes (id, x0, x1, y0, y1) that overlap, and each pair's share of all overlap of ``a``'s box.

    Boxes are dealt to the grid cells of size ``cell`` that they touch, so that the join is
    one of equality; a pair counts in the cell of its overlap's lower corner.
    """

    def dealt(d: DataFrame, p: str) -> DataFrame:
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
        return d.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "x0", "x1", "y0", "y1")], span("x0", "x1").alias("cx"), "y0", "y1").select("*", span("y0", "y1").alias("cy")).drop("y0", "y1")

    m = dealt(a, "a").join(dealt(b, "b"), ["cx", "cy"])
    lo_x, hi_x = F.greatest("a_x0", "b_x0"), F.least("a_x1", "b_x1")
    lo_y, hi_y = F.greatest("a_y0", "b_y0"), F.least("a_y1", "b_y1")
    m = m.where((hi_x > lo_x) & (hi_y > lo_y) & (F.col("cx") == F.floor(lo_x / cell)) & (F.col("cy") == F.floor(lo_y / cell)))
    pairs = m.select("a_id", "b_id", ((hi_x - lo_x) * (hi_y - lo_y)).alias("overlap"))
    total = pairs.groupBy("a_id").agg(F.sum("overlap").alias("__t"))
    return pairs.join(total, "a_id").select("a_id", "b_id", "overlap", (F.col("overlap") / F.col("__t")).alias("weight"))


def in_polygons(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """Rows (id, polygon): the least polygon that each of ``points`` (id, x, y) lies in; points in none are left out.

    edges: polygon, x1, y1, x2, y2, the sides of closed rings, holes too. Polygons are dealt to the
    squares of ``size`` that their boxes touch, so that the join is one of equality; a point
    lies inside if a ray to the right crosses an odd number of sides.
    """
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    boxes = edges.groupBy("polygon").agg(F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x9"), F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y9"))
    squares = boxes.select("*", span("x0", "x9").alias("cx")).select("*", span("y0", "y9").alias("cy"))
    at = points.select("id", "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    near = at.join(squares, ["cx", "cy"]).where("x between x0 and x9 and y between y0 and y9").select("id", "x", "y", "polygon")
    crosses = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    odd = near.join(edges, "polygon").groupBy("id", "polygon").agg((F.count_if(crosses) % 2).alias("odd"))
    return odd.where("odd = 1").groupBy("id").agg(F.min("polygon").alias("polygon"))


def nearest_cell(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Rows (id, cell, far): for each of ``points`` (id, x, y) the nearest of ``cells`` (cell, x, y), ties by the least cell.

    Both are dealt to squares of ``size``. A point meets the cells of the squares around it, which is a join of
    equality; it is done when the nearest of them is no further than the squares looked at reach, and
    looks twice as far otherwise. Points without any cell go on until the squares cover all cells.
    """
    square = lambda c: F.floor(F.col(c) / size)
    there = cells.select("cell", F.col("x").alias("u"), F.col("y").alias("v"), square("x").alias("cx"), square("y").alias("cy"))
    bounds = there.agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
    left, out, reach = points.where("x is not null and y is not null"), None, 1
    if bounds[0] is None:
        return points.select("id", F.lit(None).cast(cells.schema["cell"].dataType).alias("cell"), F.lit(None).cast("double").alias("far")).limit(0)
    while True:
        steps = F.sequence(F.lit(-reach), F.lit(reach))
        asked = left.select("*", square("x").alias("bx"), square("y").alias("by")).select("*", F.explode(steps).alias("dx")).select("*", F.explode(steps).alias("dy"))
        asked = asked.where((F.col("bx") + F.col("dx")).between(bounds[0], bounds[1]) & (F.col("by") + F.col("dy")).between(bounds[2], bounds[3]))
        met = asked.join(there, (F.col("bx") + F.col("dx") == F.col("cx")) & (F.col("by") + F.col("dy") == F.col("cy")))
        far = F.sqrt(F.pow(F.col("x") - F.col("u"), 2) + F.pow(F.col("y") - F.col("v"), 2))
        best = met.groupBy("id").agg(F.min(F.struct(far.alias("far"), "cell")).alias("m")).select("id", "m.cell", "m.far")
        edges = left.agg(F.min(square("x")), F.max(square("x")), F.min(square("y")), F.max(square("y"))).first()
        if edges[0] is None:
            return out if out is not None else best
        covers = reach >= max(bounds[1] - edges[0], edges[1] - bounds[0], bounds[3] - edges[2], edges[3] - bounds[2])
        done = best if covers else best.where(F.col("far") <= reach * size)
        out = done if out is None else out.union(done)
        if covers:
            return out
        left, reach = left.join(done.select("id"), "id", "left_anti"), 2 * reach


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon1 - lon2))
    return 6371.0 * F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))


def nearest(points: DataFrame, k: int = 8, floor_km: float = 25.0) -> DataFrame:
    """The ``k`` nearest other points (id, lat, lon) of each, with normalised inverse-distance weights.

    ``points`` is a registry of some hundreds of rows, 5,000 at most: the pairs are formed by a broadcast.
    """
    if points.limit(5001).count() > 5000:
        raise ValueError("more than 5,000 points; nearest_cell does not form all pairs")
    other = points.select(F.col("id").alias("neighbour"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    km = great_circle(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    pairs = points.join(F.broadcast(other), F.col("id") != F.col("neighbour")).select("id", "neighbour", km.alias("km"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("km", "neighbour"))
    w = 1 / F.greatest("km", F.lit(floor_km))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("weight", w / F.sum(w).over(Window.partitionBy("id")))


def normalised(name: Column) -> Column:
    """Upper case, letters only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(name), "[^A-Z]+", " "), " +", " "))


def fuzzy_names(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """Match (id, state, name) to (key, state, name): equal names of the state first, then those of the state that
    share enough words, then an equal name that just one key of all states has.

    Likeness is the number of shared words over the smaller number of words, at least
    ``least``; the greatest wins, then the least key. Candidates share a word, so that the join
    is one of equality. Names without letters match nothing.
    """
    words = lambda c: F.array_distinct(F.split(c, " "))
    a = left.select("id", F.col("state"), normalised(F.col("name")).alias("n")).where("n <> ''")
    b = right.select("key", F.col("state"), normalised(F.col("name")).alias("m")).where("m <> ''")
    exact = a.join(b, (a.state == b.state) & (a.n == b.m)).groupBy("id").agg(F.min("key").alias("key")).select("id", "key", F.lit(1.0).alias("likeness"))
    rest = a.join(exact, "id", "left_anti")
    shared = rest.select("id", "state", "n", F.explode(words(F.col("n"))).alias("w")).join(b.select("key", "state", "m", F.explode(words(F.col("m"))).alias("w")), ["state", "w"])
    scored = shared.groupBy("id", "key", "n", "m").agg(F.count(F.lit(1)).alias("k")).withColumn("likeness", F.col("k") / F.least(F.size(words(F.col("n"))), F.size(words(F.col("m")))))
    best = scored.where(F.col("likeness") >= least).groupBy("id").agg(F.max_by(F.struct("key", "likeness"), F.struct("likeness", -F.col("key"))).alias("b")).select("id", "b.key", "b.likeness")
    unique = b.groupBy("m").agg(F.min("key").alias("key"), F.countDistinct("key").alias("k")).where("k = 1")
    left_over = rest.join(best, "id", "left_anti").join(unique, F.col("n") == F.col("m")).select("id", "key", F.lit(1.0).alias("likeness"))
    return exact.union(best).union(left_over)
