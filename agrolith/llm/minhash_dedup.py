"""Near-duplicate documents by min-max hashing, confirmed on whole shingle sets.

Each permutation gives two signature values, the least and the greatest hash of the set, so
that PERMUTATIONS hash evaluations make a signature of twice that length. BANDS bands of
ROWS values each become bucket keys; a pair with a similarity of 0.85 shares no bucket with
a chance under 1e-6. Lower thresholds take WIDE bands: 30 of 4, which a pair of 0.80 misses with a
chance under 1e-6. One byte of each signature value makes the document's sketch: two sketches
agree in about as many places as the sets are similar, and a pair at the threshold agrees in
fewer than ``least_matches`` of them with a chance under 1e-7. Whole sets are made, shipped and
compared only for pairs that pass that.

1. Documents with equal sets form a class at once; its least doc_id stands for it.
2. In each bucket, all are compared with the bucket's least doc_id. The links found give
   components; a document linked with several buckets' first ones adds one edge of its own.
3. Buckets whose others still lie in two components or more are compared within, but for
   pairs that a component has joined already: their members are dealt into tiles of about
   TILE members and TILE_SHINGLES shingles, tiles of one large component aren't paired with
   each other, and a pair met in several buckets counts in the first. Sketches show which
   members of two tiles may be linked across components; the sets of just these are compared,
   and edges are returned that join their components as the links do, one less than the
   components joined at most. So no pair that shares a bucket is left unchecked unless it is
   linked by others, and no pairs within a group are written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolith.llm.kernels import give_back, grams, mix, text_bytes, word_hashes
from agrolith.llm.shared import ROW, components, discard, documents, keep_ids, one_of_each, sized, stored, with_rows

SHINGLE = 5
PERMUTATIONS, BANDS, ROWS = 60, 24, 5
#: Bands and values in each for thresholds below PERCENT.
WIDE = (30, 4)
PERCENT = 85
TILE = 64
#: Shingles of a tile, eight bytes each; a document with more has a tile of its own, or shares it with few.
TILE_SHINGLES = 1 << 18
SKETCH = 2 * PERMUTATIONS
_RNG = np.random.Generator(np.random.PCG64(7))
_A = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_SIGNATURE = "struct<d1: bigint, d2: bigint, n: bigint, bands: array<bigint>, sketch: binary>"


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each begins.

    A text of fewer words has its whole sequence as one shingle, a text of none has none.
    """
    h, at = word_hashes(column)
    g = grams(h, width)
    sets, n = [], np.zeros(len(column) + 1, np.int64)
    for i in range(len(column)):
        a, b = at[i], at[i + 1]
        if b - a >= width:
            s = np.sort(g[a : b - width + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            s = grams(h[a:b], int(b - a))
        else:
            continue
        sets.append(s)
        n[i + 1] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(n)


def least_matches(percent: int) -> int:
    """Sketches of sets with this similarity agree in fewer places than this with a chance under 1e-7."""
    p, chance, k = percent / 100, 0.0, 0
    while True:
        chance += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if chance > 1e-7:
            return k
        k += 1


def signatures(values: np.ndarray, at: np.ndarray, cut: tuple[int, int] = (BANDS, ROWS)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of non-empty sets: two digests of the set, its band keys and its sketch."""
    begins = at[:-1]
    m = mix(values)
    d1 = np.add.reduceat(m, begins)
    d2 = np.bitwise_xor.reduceat(mix(m + np.uint64(0x5851F42D4C957F2D)), begins)
    low, high = np.empty((PERMUTATIONS, len(begins)), np.uint64), np.empty((PERMUTATIONS, len(begins)), np.uint64)
    for p in range(PERMUTATIONS):
        v = values * _A[p]
        v += _B[p]
        low[p] = np.minimum.reduceat(v, begins)
        high[p] = np.maximum.reduceat(v, begins)
    both = np.concatenate([low, high])
    n_bands, n_rows = cut
    bands = np.empty((len(begins), n_bands), np.uint64)
    for b in range(n_bands):
        key = np.full(len(begins), b + 1, np.uint64)
        for r in range(n_rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + both[b * n_rows + r])
        bands[:, b] = key
    return d1, d2, bands, (both.T >> np.uint64(8)).astype(np.uint8)


def _runs(column: pa.Array, most: int) -> Iterator[pa.Array]:
    _, at = text_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield column.slice(lo, hi - lo)
        lo = hi


def signature(text: Column, cut: tuple[int, int] = (BANDS, ROWS)) -> Column:
    """struct(d1, d2, n, bands, sketch) of a text; n is the size of its set, bands and sketch are null if it is 0."""

    @F.arrow_udf(_SIGNATURE)
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
        for column in batches:
            parts = [pa.array([], kind)]
            for part in _runs(column, 512 << 10):
                values, at = shingle_sets(part)
                n = np.diff(at)
                some = np.flatnonzero(n)
                d = np.zeros((2, len(part)), np.uint64)
                keys, sketch = np.zeros((0, cut[0]), np.uint64), np.zeros((0, SKETCH), np.uint8)
                if len(some):
                    d[0, some], d[1, some], keys, sketch = signatures(values, np.concatenate([at[some], at[-1:]]), cut)
                ends = np.concatenate([[0], np.cumsum((n > 0) * cut[0])]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel()), mask=pa.array(n == 0))
                rows = np.full(len(part), None, object)
                rows[some] = [x.tobytes() for x in sketch]
                parts.append(pa.StructArray.from_arrays([pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), pa.array(n), bands, pa.array(rows, pa.binary())], fields=list(kind)))
            yield pa.concat_arrays(parts)
        give_back()

    return sign(text)


@F.arrow_udf(T.BinaryType())
def set_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The sorted shingle hashes of a text, eight bytes each."""
    for column in batches:
        out = []
        for part in _runs(column, 1 << 20):
            values, at = shingle_sets(part)
            out += [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.array(out, pa.binary())
    give_back()


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    i = np.searchsorted(y, x)
    i[i == len(y)] = 0
    return int(np.count_nonzero(y[i] == x)) if len(y) else 0


def _similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are similar enough, as a matrix; all shingles that two have in common are counted."""
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    several = times > 1
    place = np.cumsum(several) - 1
    keep = several[inverse]
    owner, inverse = owner[keep], place[inverse[keep]]
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    both = np.zeros((len(sets), len(sets)))
    step = 4096
    for lo in range(0, int(several.sum()), step):
        a, b = np.searchsorted(inverse, [lo, lo + step])
        has = np.zeros((len(sets), step), np.float32)
        has[owner[a:b], inverse[a:b] - lo] = 1
        both += has @ has.T
    return 100 * both >= percent * (size[:, None] + size[None, :] - both)


def _linked(percent: int):
    @F.arrow_udf("boolean")
    def linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            out = []
            for x, y in zip(a, b, strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = _shared(u, v)
                out.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.array(out, pa.bool_())
        give_back()

    return linked


def _matrix(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), SKETCH)


def _may_link(percent: int):
    """Whether two sketches agree often enough."""
    least = least_matches(percent)

    @F.arrow_udf("boolean")
    def may_link(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array((_matrix(a.to_pylist()) == _matrix(b.to_pylist())).sum(axis=1) >= least, pa.bool_())

    return may_link


def _tile_candidates(percent: int):
    """The members of two tiles (of one, if the other is null) that may be linked with one of another component.

    Tiles are arrays of struct(rep, comp, n, bands, sketch); pairs that share an earlier band are left to that.
    """
    least = least_matches(percent)

    @F.arrow_udf("array<struct<rep: bigint, comp: bigint, right: boolean>>")
    def candidates(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("rep", pa.int64()), ("comp", pa.int64()), ("right", pa.bool_())]))
        for keys, lefts, rights in batches:
            out = []
            for key, left, right in zip(keys, lefts, rights, strict=True):
                x = left.as_py()
                y = right.as_py() if right.is_valid else x
                (cx, nx, bx), (cy, ny, by) = (tuple(np.array([r[c] for r in z]) for c in ("comp", "n", "bands")) for z in (x, y))
                sx, sy = (_matrix([r["sketch"] for r in z]) for z in (x, y))
                hits = set()
                for i in range(len(x)):
                    fits = (cy != cx[i]) & (np.minimum(ny, nx[i]) * 100 >= np.maximum(ny, nx[i]) * percent)
                    if not right.is_valid:
                        fits[: i + 1] = False
                    j = np.flatnonzero(fits)
                    j = j[(sy[j] == sx[i]).sum(axis=1) >= least]
                    if len(j):
                        same = by[j] == bx[i]
                        j = j[bx[i][same.argmax(axis=1)] == key.as_py()]
                    if len(j):
                        hits.update([(x[i]["rep"], x[i]["comp"], False), *((y[k]["rep"], y[k]["comp"], right.is_valid) for k in j)])
                out.append([{"rep": r, "comp": c, "right": b} for r, c, b in sorted(hits)])
            yield pa.array(out, kind)
        give_back()

    return candidates


def _joined(percent: int):
    """Edges between components: of members, one or two arrays of struct(rep, comp, shingles), all are compared across components."""

    @F.arrow_udf("array<struct<a: bigint, b: bigint>>")
    def joined(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for lefts, rights in batches:
            for left, right in zip(lefts, rights, strict=True):
                members = [*left.as_py(), *(right.as_py() or [])]
                comps = np.array([m["comp"] for m in members])
                hit = _similar([np.frombuffer(m["shingles"], np.uint64) for m in members], percent) & (comps[:, None] != comps[None, :])
                label = {c: c for c in comps.tolist()}
                found = []
                for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(hit))), strict=True):
                    a, b = int(comps[i]), int(comps[j])
                    if label[a] != label[b]:
                        found.append({"a": a, "b": b})
                        old, new = label[a], label[b]
                        label = {c: new if v == old else v for c, v in label.items()}
                yield pa.array([found], kind)
        give_back()

    return joined


def _close(n: str, m: str, percent: int) -> Column:
    """Two sets of these sizes may reach the threshold."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs``.

    Texts that are null or without words have no shingles and aren't linked; texts of under
    five words have one. Rows with a null doc_id aren't linked and have a null component_id;
    rows that repeat a doc_id are one document in the links. An empty table gives no rows.
    Other columns, whatever their names, are ignored.
    """
    sig = stored(docs.select("doc_id", signature(F.col("text"), (BANDS, ROWS) if percent >= PERCENT else WIDE).alias("s")).select("doc_id", "s.*"), "minhash-signatures")
    named = sig.where("n > 0 and doc_id is not null")
    kinds = stored(named.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "minhash-kinds")
    ids = stored(sig.select("doc_id", "d1", "d2", "n"), "minhash-ids")
    discard(sig)
    entries = kinds.select("rep", F.explode("bands").alias("key"))
    multi = stored(entries.groupBy("key").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1"), "minhash-buckets")
    members = stored(entries.join(sized(multi), "key").where("rep <> first"), "minhash-members")
    discard(multi)

    about = kinds.select("rep", "n", "sketch")
    of_first = about.toDF("first", "first_n", "first_sketch")
    pairs = members.select("first", "rep").distinct().join(about, "rep").join(of_first, "first").where(_close("n", "first_n", percent))
    pairs = stored(pairs.where(_may_link(percent)("sketch", "first_sketch")).select("first", "rep"), "minhash-pairs")
    links = _confirmed(pairs, _sets(docs, pairs.select("rep").union(pairs.select("first"))), percent)
    # one edge for each rep, and for each two firsts that it joins
    firsts = links.groupBy("rep").agg(F.min("first").alias("least"), F.collect_set("first").alias("all"))
    edges = firsts.select("least", F.explode(F.concat(F.array("rep"), "all")).alias("b")).select(F.col("least").alias("a"), "b")
    comps = components(edges, "minhash-components")

    left = members.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    open_keys = stored(left.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("key"), "minhash-open")
    if not open_keys.isEmpty():
        joined = components(_within(docs, left, open_keys, kinds, percent), "minhash-joined").select(F.col("node").alias("component"), F.col("component").alias("whole"))
        # a node that no link had reached stands for itself
        alone = joined.select(F.col("component").alias("node"), F.col("whole").alias("component")).join(comps, "node", "left_anti")
        comps = stored(comps.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component")).union(alone), "minhash-components")
    discard(members, open_keys)

    known = kinds.select("d1", "d2", "n", "rep", "copies").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = stored(known.where("copies > 1 or component is not null").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component_id")), "minhash-known")
    discard(kinds)
    return ids.join(sized(known, 200_000), ["d1", "d2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """A stored table (rep, shingles) of the documents ``wanted`` (one column of ids, which may repeat)."""
    reps = stored(wanted.toDF("wanted").distinct(), "minhash-wanted")
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(sized(reps), F.col("rep") == F.col("wanted"), "left_semi")
    made = stored(texts.select("rep", set_bytes("text").alias("shingles")), "minhash-sets")
    out = made.where("length(shingles) > 0")  # after the write: a filter beside it would make each set twice, in a second worker
    out._scratch_path = made._scratch_path
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (first, rep) of ``pairs`` whose whole sets are similar enough, stored."""
    a, b = sets.select(F.col("rep").alias("first"), F.col("shingles").alias("x")), sets.select("rep", F.col("shingles").alias("y"))
    links = stored(pairs.join(b, "rep").join(a, "first").where(_linked(percent)("x", "y")).select("first", "rep"), "minhash-links")
    discard(sets)
    return links


def _within(docs: DataFrame, left: DataFrame, open_keys: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between components of the buckets ``open_keys`` that have linked members; see step 3 above."""
    rows = left.join(sized(open_keys), "key").join(kinds.select("rep", "n", "bands", "sketch"), "rep")
    rows = stored(rows.select("key", "rep", "comp", "n", "bands", "sketch"), "minhash-rows")
    groups = rows.groupBy("key", "comp").agg(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_SHINGLES).alias("size"))
    large = F.col("size") >= 1
    groups = stored(groups.withColumn("one", F.when(large, F.col("comp"))), "minhash-groups")
    small = groups.where("one is null").groupBy("key").agg(F.sum("size").alias("small"))
    many = F.ceil(F.when(F.col("one").isNotNull(), F.col("size")).otherwise(F.col("small")))
    deal = F.when(F.col("one").isNotNull(), F.xxhash64("rep")).otherwise(F.xxhash64("comp"))
    dealt = rows.join(groups, ["key", "comp"]).join(small, "key", "left")
    dealt = dealt.select("key", F.xxhash64("one", F.pmod(deal, many)).alias("tile"), "one", F.struct("rep", "comp", "n", "bands", "sketch").alias("row"))
    dealt = dealt.repartition("key", "tile")  # a hot bucket's tiles go to many tasks
    blocks = stored(dealt.groupBy("key", "tile").agg(F.first("one").alias("one"), F.collect_list("row").alias("rows")), "minhash-blocks")
    discard(rows, groups)
    tiles = blocks.select("key", "tile", "one")
    other = tiles.select("key", F.col("tile").alias("tile2"), F.col("one").alias("one2"))
    paired = tiles.join(other, "key").where("tile < tile2").where("one is null or one2 is null or one <> one2").select("key", "tile", "tile2")
    second = blocks.select("key", F.col("tile").alias("tile2"), F.col("rows").alias("rows2"))
    across = paired.join(blocks.select("key", "tile", "rows"), ["key", "tile"]).join(second, ["key", "tile2"]).select("key", "tile", "tile2", "rows", "rows2")
    inside = blocks.where("one is null").select("key", "tile", F.col("tile").alias("tile2"), "rows", F.lit(None).cast(second.schema["rows2"].dataType).alias("rows2"))
    found = inside.union(across).select("key", "tile", "tile2", F.explode(_tile_candidates(percent)("key", "rows", "rows2")).alias("m")).select("key", "tile", "tile2", "m.*")
    found = stored(found, "minhash-candidates")
    discard(blocks)
    sets = _sets(docs, found.select("rep"))
    need = found.select("key", F.when(F.col("right"), F.col("tile2")).otherwise(F.col("tile")).alias("tile"), "rep", "comp").distinct()
    need = need.join(sets, "rep").select("key", "tile", F.struct("rep", "comp", "shingles").alias("row")).repartition("key", "tile")
    rows = stored(need.groupBy("key", "tile").agg(F.collect_list("row").alias("rows")), "minhash-compared")
    discard(sets)
    pairs = found.select("key", "tile", "tile2").distinct()
    second = rows.select("key", F.col("tile").alias("tile2"), F.col("rows").alias("rows2"))
    met = pairs.join(rows, ["key", "tile"]).join(second, ["key", "tile2"]).select("rows", F.when(F.col("tile") != F.col("tile2"), F.col("rows2")).alias("rows2"))
    edges = stored(met.select(F.explode(_joined(percent)("rows", "rows2")).alias("e")).select("e.a", "e.b").distinct(), "minhash-edges")
    discard(found, rows)
    return edges


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without documents that are linked, over any steps, with one of a smaller doc_id."""
    dropped = stored(near_duplicates(docs, percent).where("doc_id <> component_id").select("doc_id"), "minhash-dropped")
    return keep_ids(docs, dropped)


def distinct_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id, however ids repeat or are null."""
    keyed = with_rows(docs)
    found = near_duplicates(keyed.select(F.col(ROW).alias("doc_id"), "text"), percent)
    found = stored(found.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("label")), "minhash-found")
    several = stored(found.where(F.col(ROW) != F.col("label")).select("label").distinct(), "minhash-several")
    return one_of_each(keyed, stored(found.join(sized(several), "label", "left_semi").select(ROW, "label"), "minhash-groups"), largest=False)


def op7(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: All pairs that share a shingle; for tables of some thousand documents.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS c FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, coalesce(c.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id"""
