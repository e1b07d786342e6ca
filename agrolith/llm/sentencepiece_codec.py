"""SentencePiece encoding and decoding; giant documents by a max-plus scan over chunks.

A text is a lattice whose nodes are vocabulary pieces (and single characters that the
vocabulary lacks) at their places. The public model is a BPE model, whose result is the one
path in which each two neighbours, encoded together, stay as they are: merges inside a
neighbouring pair run in the same order alone and in the whole text, so that a path is the
encoder's result if and only if no pair would merge across its border. The arcs thus weigh 0
(the pair stays) or minus infinity (it doesn't) and a path's weight is their max-plus sum.

A giant document is cut into chunks of ``chunk`` characters, wherever these fall. A boundary
state is the piece that covers or ends at the cut. Each chunk yields its transfer matrix
from states at its start to states at its end, independently of the others. The products of
these matrices are associative: runs of FAN chunks are combined in parallel, then runs of FAN
such runs, until FAN at most are left of each document. Their states follow from the
document's ends, and are handed down level by level to each chunk, which is then
backtraced independently. No piece goes on over a space after a non-space, so within a chunk
the text between its first and last such place has one path, and the library encodes it; the
matrix has rank one there. A document of one chunk has one start state and one end state.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.llm.kernels import give_back
from agrolith.llm.shared import documents, sized, stored

CHUNK = 32_768
#: Chunks, or runs of them, whose matrices one task combines.
FAN = 64
ROWS = 256
ENCODED = "struct<ids: array<int>, ids_crc32: bigint, round_trip: boolean>"
SPACES = " ▁"
#: No piece may hold it, so that what follows it is encoded as if it stood alone.
APART = "\n"
_models: dict[int, Codec] = {}


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """A BPE model, its lattice and the transfer matrices of chunks.

    The lattice of a document is that of a space and its text, as the library encodes it.
    Chunks are addressed by positions in ``text``, which holds the chunk with as many characters around
    it as the longest piece has. A state is (start, end) of a piece: start < cut <= end, or start = end = cut
    at the start of a document.
    """

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.sp.get_piece_size()
        normal = [i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        self.vocabulary = {self.sp.id_to_piece(i): i for i in normal}
        for p in self.vocabulary:
            if any(a != "▁" and b == "▁" for a, b in zip(p, p[1:], strict=False)):
                raise ValueError(f"the piece {p!r} goes on over a space; chunks need a model without such pieces")
        self.longest = max(map(len, self.vocabulary))
        if any(APART in p for p in self.vocabulary):
            raise ValueError("a piece holds a line feed, which is taken to stand apart")
        self._skip = len(self.sp.encode(APART))
        self._ids: dict[str, list[int]] = {}
        self._stays: dict[tuple[str, str], bool] = {}

    def ids(self, piece: str) -> list[int]:
        if piece not in self._ids:
            self._ids[piece] = self.raw(piece)
        return self._ids[piece]

    def raw(self, s: str) -> list[int]:
        """Ids of a part of a text, without the space that the library puts before a whole text."""
        return self.sp.encode(APART + s)[self._skip :]

    def is_node(self, s: str) -> bool:
        if len(s) == 1:
            return True  # in the vocabulary, or encoded as bytes
        return s.replace(" ", "▁") in self.vocabulary and len(self.ids(s)) == 1

    def stays(self, a: str, b: str) -> bool:
        if not a:
            return True
        if (a, b) not in self._stays:
            if len(self._stays) > 50_000:
                self._stays.clear()
            self._stays[a, b] = self.raw(a + b) == self.ids(a) + self.ids(b)
        return self._stays[a, b]

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Pieces that cover or end at ``cut``."""
        return [(s, e) for s in range(max(0, cut - self.longest), cut) for e in range(cut, min(len(text), s + self.longest) + 1) if self.is_node(text[s:e])]

    def walk(self, text: str, start: tuple[int, int], end: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """From the state ``start``: each state at ``end`` that a path of weight 0 reaches, with that path's pieces."""
        back: dict[tuple[int, int], tuple[int, int] | None] = {start: None}
        by_end: dict[int, list[tuple[int, int]]] = {start[1]: [start]}
        done = []
        while by_end:
            at = min(by_end)
            for node in by_end.pop(at):
                if at >= end:
                    done.append(node)
                    continue
                last = text[node[0] : node[1]]
                for e in range(at + 1, min(len(text), at + self.longest) + 1):
                    if (at, e) not in back and self.is_node(text[at:e]) and self.stays(last, text[at:e]):
                        back[at, e] = node
                        by_end.setdefault(e, []).append((at, e))
        out = {}
        for node in done:
            path, p = [], node
            while back[p] is not None:
                path.append(p)
                p = back[p]
            out[node] = path[::-1]
        return out

    @staticmethod
    def borders(text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and the last place in (lo, hi) where a space follows a non-space."""
        is_border = lambda i: text[i] in SPACES and text[i - 1] not in SPACES
        first = next((i for i in range(max(lo + 1, 1), hi) if is_border(i)), None)
        return None if first is None else (first, next(i for i in range(hi - 1, first - 1, -1) if is_border(i)))

    def transfer(self, text: str, lo: int, hi: int, first: bool, last: bool) -> list[list[int]]:
        """The chunk's matrix: [start, end, start', end'] of each pair of states joined by weight 0, relative to lo and hi."""
        begin = [(lo, lo)] if first else self.states(text, lo)
        stop = len(text) if last else hi
        sync = self.borders(text, lo, hi)
        rows = []
        if sync is None:
            for s in begin:
                rows += [[s[0] - lo, s[1] - lo, e[0] - hi, e[1] - hi] for e in self.walk(text, s, stop) if not last or e[1] == hi]
            return rows
        into = [s for s in begin if s[1] <= sync[0] and any(e[1] == sync[0] for e in self.walk(text, s, sync[0]))]
        ends = [e for e in self.walk(text, (sync[1], sync[1]), stop) if not last or e[1] == hi]
        return [[s[0] - lo, s[1] - lo, e[0] - hi, e[1] - hi] for s in into for e in ends]

    def backtrace(self, text: str, lo: int, hi: int, start: tuple[int, int], end: tuple[int, int]) -> list[int]:
        """Ids of the pieces that start in the chunk, between two of its states."""
        sync = self.borders(text, lo, hi)
        if sync is None:
            return [i for s, e in self.walk(text, start, end[1])[end] for i in self.ids(text[s:e])]
        head = next(p for e, p in self.walk(text, start, sync[0]).items() if e[1] == sync[0])
        tail = self.walk(text, (sync[1], sync[1]), end[1])[end] if end[1] > sync[1] else []
        ids = [i for s, e in head for i in self.ids(text[s:e])]
        ids += self.raw(text[sync[0] : sync[1]])
        return ids + [i for s, e in tail for i in self.ids(text[s:e])]


def product(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Max-plus product of two matrices over {0, -inf}, kept as the pairs that weigh 0; associative."""
    by: dict[tuple[int, int], list[list[int]]] = {}
    for r in b:
        by.setdefault((r[0], r[1]), []).append(r)
    return [list(x) for x in dict.fromkeys((r[0], r[1], q[2], q[3]) for r in a for q in by.get((r[2], r[3]), ()))]


def chain(matrices: list[list[list[int]]], ends: list[int] | None = None) -> list[list[int]]:
    """The states before and after each of a run of chunks on its one path.

    ends: the states before and after the run; without them it is a whole document.
    """
    if ends is not None:
        matrices = [*matrices[:-1], [r for r in matrices[-1] if r[2:] == ends[2:]]]
    after = [matrices[-1]]
    for m in matrices[-2::-1]:
        after.append(product(m, after[-1]))
    after.reverse()
    out, state = [], (0, 0) if ends is None else (ends[0], ends[1])
    for i, m in enumerate(matrices):
        good = {(r[0], r[1]) for r in after[i + 1]} if i + 1 < len(matrices) else None
        step = next(r for r in m if (r[0], r[1]) == state and (good is None or (r[2], r[3]) in good))
        out.append(step)
        state = (step[2], step[3])
    return out


def cut(text: str, chunk: int, around: int) -> Iterator[tuple[int, str, int, int, bool, bool]]:
    """Chunks (k, part, lo, hi, first, last) of a text; part holds the chunk, at lo to hi, and what is ``around`` it."""
    for k, at in enumerate(range(0, len(text), chunk)):
        begin, end = max(0, at - around), min(len(text), at + chunk)
        yield k, text[begin : min(len(text), end + around)], at - begin, end - begin, at == 0, end == len(text)


def _encoded(sp, texts: list[str], ids: list[list[int]], verify: bool) -> pa.Array:
    none = [None] * len(ids)
    crcs = [crc(np.array(x, "<i4")) for x in ids] if verify else none
    same = [a == b for a, b in zip(texts, sp.decode(ids, num_threads=1), strict=True)] if verify else none
    return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())], ["ids", "ids_crc32", "round_trip"])


def codec(proto: bytes) -> Codec:
    key = zlib.crc32(proto)
    if key not in _models:
        _models[key] = Codec(proto)
    return _models[key]


def _one_chunk(spark: SparkSession, proto: bytes, verify: bool):
    """Ids of texts of one chunk each: from the start state to the end state there is one path, the encoder's."""
    shared = spark.sparkContext.broadcast(proto)

    @F.arrow_udf(ENCODED)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sp = codec(shared.value).sp
        for texts in batches:  # results leave in small batches, so that few ids are held at once
            for lo in range(0, len(texts), ROWS):
                given = pc.fill_null(texts[lo : lo + ROWS], "").to_pylist()
                yield _encoded(sp, given, sp.encode(given, num_threads=1), verify)
        give_back()

    return encode


def decoder(spark: SparkSession, proto: bytes | None = None):
    """A function of a column of ids: their text."""
    shared = spark.sparkContext.broadcast(proto or model_bytes())

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sp = codec(shared.value).sp
        for ids in batches:
            for lo in range(0, len(ids), ROWS):
                yield pa.array(sp.decode([x or [] for x in ids[lo : lo + ROWS].to_pylist()], num_threads=1), pa.string())
        give_back()

    return decode


def _few(batches: Iterator[tuple[pa.Array, ...]], most: int = 16) -> Iterator[list[tuple]]:
    """The rows of the batches, a few chunks at a time."""
    for parts in batches:
        for lo in range(0, len(parts[0]), most):
            yield list(zip(*(p[lo : lo + most].to_pylist() for p in parts), strict=True))


def _checks(spark: SparkSession, proto: bytes):
    """A function of a giant's lattice text and ids: struct(ids_crc32, round_trip). One function, so that one worker a core serves a stage."""
    shared = spark.sparkContext.broadcast(proto)

    @F.arrow_udf("struct<ids_crc32: bigint, round_trip: boolean>")
    def check(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        sp = codec(shared.value).sp
        for rows in _few(batches):
            done = [(crc(np.array(ids, "<i4")), sp.decode(ids) == text[1:]) for text, ids in rows]
            yield pa.StructArray.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([r for _, r in done], pa.bool_())], ["ids_crc32", "round_trip"])
        give_back()

    return check


def _giants(docs: DataFrame, text: str, proto: bytes, chunk: int, fan: int) -> DataFrame:
    """Rows (giant, ids) of a stored table with the columns giant and ``text``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(proto)
    around = codec(proto).longest

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text is read once from its beginning to its end."""
        names = ["giant", "k", "part", "lo", "hi", "first", "last"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
        for batch in batches:
            for giant, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for row in cut(value.as_py(), chunk, around):
                    rows.append((giant, *row))
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        give_back()

    @F.arrow_udf("string")
    def transfer(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        c = codec(shared.value)
        for rows in _few(batches):
            yield pa.array([json.dumps(c.transfer(*row)) for row in rows], pa.string())

    @F.arrow_udf("string")
    def combine(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([json.dumps(reduce(product, map(json.loads, row))) for row in column.to_pylist()], pa.string())

    @F.arrow_udf("array<array<int>>")
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for matrices, ends in batches:
            yield pa.array([chain([json.loads(m) for m in row], e) for row, e in zip(matrices.to_pylist(), ends.to_pylist(), strict=True)], pa.list_(pa.list_(pa.int32())))

    @F.arrow_udf("array<int>")
    def backtrace(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        c = codec(shared.value)
        for rows in _few(batches):
            yield pa.array([c.backtrace(text_, lo, hi, (lo + path[0], lo + path[1]), (hi + path[2], hi + path[3])) for text_, lo, hi, path in rows], pa.list_(pa.int32()))
        give_back()

    made = docs.select("giant", text).mapInArrow(chunks, "giant long, k int, part string, lo int, hi int, first boolean, last boolean")
    pieces = stored(made.repartition(F.col("giant"), F.col("k")), "pieces-chunks")
    levels = [stored(pieces.select("giant", "k", transfer("part", "lo", "hi", "first", "last").alias("m")), "pieces-matrices")]
    most = levels[0].agg(F.max("k")).first()[0]
    above = F.floor(F.col("k") / fan).cast("int")
    runs = lambda level: level.groupBy("giant", above.alias("run")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("all"))  # noqa: E731  fan matrices at most
    while most >= fan:
        levels.append(stored(runs(levels[-1]).select("giant", F.col("run").alias("k"), combine("all").alias("m")), "pieces-matrices"))
        most //= fan
    states = None
    for level in levels[::-1]:
        run = runs(level)
        ends = run.withColumn("ends", F.lit(None).cast("array<int>")) if states is None else run.join(states.select("giant", F.col("k").alias("run"), F.col("path").alias("ends")), ["giant", "run"])
        found = ends.select("giant", "run", F.posexplode(scan("all", "ends")).alias("i", "path"))
        states = stored(found.select("giant", (F.col("run") * fan + F.col("i")).cast("int").alias("k"), "path"), "pieces-states")
    done = pieces.join(sized(states), ["giant", "k"]).select("giant", "k", backtrace("part", "lo", "hi", "path").alias("ids"))
    return done.groupBy("giant").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, columns: list[str] | None = None, text: str = "text", proto: bytes | None = None, chunk: int = CHUNK, fan: int = FAN, verify: bool = False) -> DataFrame:
    """The ``columns`` of each row (doc_id by default) with ``ids``, its text's piece ids.

    Null and empty texts have no ids. The ids are those of the library for the whole text,
    however long; ``columns`` may hold repeated rows and nulls but none of the names added. An
    empty table gives no rows. verify: decode the ids again, and add ids_crc32 and round_trip,
    which is false where a text holds what the model can't give back, as its sign for a space.
    """
    proto = proto or model_bytes()
    keep = columns or ["doc_id"]
    added = ["ids", "ids_crc32", "round_trip"] if verify else ["ids"]
    value = F.coalesce(F.col(text), F.lit(""))
    short = docs.where(F.length(value) <= chunk).select(*keep, _one_chunk(docs.sparkSession, proto, verify)(value).alias("__e")).select(*keep, *[f"__e.{c}" for c in added])
    giants = stored(docs.where(F.length(text) > chunk).select(*keep, F.concat(F.lit(" "), F.col(text)).alias("__text"), F.monotonically_increasing_id().alias("__giant")), "pieces-giants")
    if giants.isEmpty():
        return short
    ids = _giants(giants.select(F.col("__giant").alias("giant"), "__text"), "__text", proto, chunk, fan)
    whole = giants.join(ids.withColumnRenamed("giant", "__giant"), "__giant")
    if verify:
        whole = whole.withColumn("__e", _checks(docs.sparkSession, proto)("__text", "ids")).select("*", "__e.ids_crc32", "__e.round_trip")
    return short.unionByName(whole.select(*keep, *added))


def op4(spark, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_pieces, ids_crc32, round_trip): ids as little-endian 32-bit integers; round_trip: decoding gives the text."""
    rows = encode(documents(spark, sf_dir), verify=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids_crc32", "round_trip")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<i4"))


def ids_crc32():
    """A function of a column of ids: the unsigned crc32 of them as little-endian 32-bit integers."""

    @F.arrow_udf("bigint")
    def crcs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            column = pc.fill_null(column, [])
            at = column.offsets.to_numpy()
            flat = np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), dtype="<i4")
            yield pa.array([zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())

    return crcs
