"""Token ids as ORC: run-length encoded integers, row indexes and Bloom filters on doc_id.

Rows are dealt by ranges of doc_id and sorted within them, so that stripes and row groups
cover narrow id ranges: a reader prunes them by min/max and, for a single id, by the Bloom
filter, and reads the stripes it needs in parallel. Each row also holds its place in its
file (``file_start``, ids before it), from which the place among all ids follows by one sum
a file.

Byte-level BPE of this kind never joins a space to the character before it, nor a stop or
comma to a letter or digit before it. So a text is cut at these places and each distinct
piece is encoded once a worker, until its cache is full and starts anew; texts with runs
that a cut might part are encoded whole. The ids are the library's for the whole text.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agrolith.llm.kernels import give_back, text_bytes
from agrolith.llm.shared import documents, scratch, sized, stored

END = 0
CACHED = 3_000_000
CUTS = " \n.,"
_odd = re.compile(r"\s[ \n]|[\W_][.,]|\0")
#: Of bytes: 0 letters, digits and bytes of letters beyond ASCII, 1 white space, 2 stop and comma, 3 others.
_KIND = np.full(256, 3, np.uint8)
_KIND[[c for c in range(128) if chr(c).isalnum()] + list(range(128, 256))] = 0
_KIND[[c for c in range(128) if chr(c).isspace()]] = 1
_KIND[[ord("."), ord(",")]] = 2
_encoders: dict[int, Encoder] = {}

#: Options of the files; the stripe size bounds what a reader holds.
ORC = {"compression": "zstd", "orc.stripe.size": str(32 << 20), "orc.row.index.stride": "2000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.dictionary.key.threshold": "0"}


def tokenizer_json(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _divisible(texts: list[str]) -> np.ndarray:
    """Texts that may be cut before each space, line feed, full stop and comma.

    Not those where white space precedes a space or line feed, or what is neither letter nor
    digit precedes a stop or comma, as the encoder takes such runs together.
    """
    raw, at = text_bytes(pa.array(texts, pa.large_string()))
    bad = np.zeros(len(raw) + 1, np.int64)
    if len(raw) > 1:
        kind = _KIND[raw]
        now, before = kind[1:], kind[:-1]
        bad[1:-1] = ((now == 1) & (before == 1)) | ((now == 2) & (before != 0)) | (raw[1:] == 0)
    other = (raw >= 0xC4) | (raw == 0xC2)
    other[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    first = at[:-1][at[:-1] < len(raw)]
    bad[first] = (raw[first] == 0) if len(raw) else 0
    count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
    fine = count(bad[:-1]) == 0
    for i in np.flatnonzero(count(other) > 0):
        fine[i] = not _odd.search(texts[i])
    return fine


class _Pieces(dict):
    """Numbers of pieces in the order in which they were first asked for; ``fresh`` are those not yet encoded."""

    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.seen = 0

    def __missing__(self, piece: str) -> int:
        self[piece] = n = self.add(piece)
        return n

    def add(self, piece: str) -> int:
        self.fresh.append(piece)
        self.seen += 1
        return self.seen - 1


class Encoder:
    """Encodes texts with the library, each distinct piece between cuts once."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([self.tokenizer.id_to_token(i).startswith("Ġ") for i in range(size)])
        self._clear()

    def _clear(self) -> None:
        self.pieces = _Pieces()
        self.flat = np.zeros(1 << 16, np.int32)
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = self.known = 0

    def _append(self, which: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Give the pieces of these numbers their ids, of which they have ``n`` each."""
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[which] = self.used + np.cumsum(n) - n
        self.size[which] = n
        self.used += len(ids)

    def _learn(self) -> None:
        """Encode the fresh pieces. Those that begin with their only space are joined to one text, whose ids part
        where one starts with a space."""
        fresh = self.pieces.fresh
        more = self.known + len(fresh) - len(self.begin)
        if more > 0:
            more = np.zeros(max(more, len(self.begin)), np.int64)
            self.begin, self.size = np.concatenate([self.begin, more]), np.concatenate([self.size, more])
        plain = np.array([len(p) > 1 and p[0] == " " and not p[-1].isspace() and p.rfind(" ") == 0 for p in fresh], bool)
        joined, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        if len(joined):
            ids = np.array(self.tokenizer.encode("".join(map(fresh.__getitem__, joined.tolist())), add_special_tokens=False).ids, np.int32)
            first = np.flatnonzero(self.spaced[ids])
            if len(first) == len(joined) and first[0] == 0:
                self._append(self.known + joined, ids, np.diff(np.append(first, len(ids))))
            else:
                rest = np.arange(len(fresh))
        if len(rest):
            each = [e.ids for e in self.tokenizer.encode_batch(list(map(fresh.__getitem__, rest.tolist())), add_special_tokens=False)]
            n = np.fromiter(map(len, each), np.int64, len(each))
            self._append(self.known + rest, np.fromiter(chain.from_iterable(each), np.int32, int(n.sum())), n)
        self.known += len(fresh)
        fresh.clear()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and where each text's ids begin."""
        if self.known > CACHED or self.used > 16 * CACHED:
            self._clear()
        numbers, n = [], []
        get = self.pieces.__getitem__
        for t, fine in zip(texts, _divisible(texts).tolist(), strict=True):
            if fine:
                for c in CUTS:
                    t = t.replace(c, "\0" + c)
                p = t.split("\0")
                numbers.append(np.fromiter(map(get, p), np.int64, len(p)))
            else:
                numbers.append(np.array([self.pieces.add(t)], np.int64))
            n.append(len(numbers[-1]))
        self._learn()
        which = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        lo, size = self.begin[which], self.size[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        doc_ends = ends[np.cumsum(np.array(n, np.int64))] if n else np.zeros(0, np.int64)
        at = np.concatenate([[0], doc_ends + np.arange(1, len(n) + 1)])
        out = np.empty(int(at[-1]), np.int32)
        is_end = np.zeros(len(out), bool)
        is_end[at[1:] - 1] = True
        out[is_end] = END
        out[~is_end] = self.flat[np.arange(int(ends[-1])) + np.repeat(lo - ends[:-1], size)]
        return out, at


def encoder(spec: str) -> Encoder:
    key = zlib.crc32(spec.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def write(docs: DataFrame, path: str, spec: str | None = None) -> None:
    """Write rows (doc_id, file_start, n_tokens, ids) of ``docs`` in ascending doc_id order.

    Null texts count as empty; each document ends with END. A null doc_id comes first; rows
    that repeat a doc_id are in the order of their texts. Other columns are not read, and an
    empty table makes a file without rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec or tokenizer_json())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, before = encoder(shared.value), 0
        for batch in batches:
            for lo in range(0, len(batch), 128):
                part = batch.slice(lo, 128)
                flat, at = tool(pc.fill_null(part.column("text"), "").to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(at[:-1] + before), pa.array(np.diff(at)), ids], ["doc_id", "file_start", "n_tokens", "ids"])
                before += int(at[-1])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, "doc_id long, file_start long, n_tokens long, ids array<int>").write.options(**ORC).orc(path)


SCHEMA = "doc_id long, file_start long, n_tokens long, ids array<int>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, ids); start counts the ids of all documents before it."""
    rows = spark.read.schema(SCHEMA).orc(path).withColumn("file", F.col("_metadata.file_path"))
    files = rows.groupBy("file").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("held"))  # metadata columns only
    base = files.withColumn("base", F.coalesce(F.sum("held").over(Window.orderBy(F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = stored(base.select("file", "base"), "token-files")  # a row a file
    return rows.join(sized(base, 100_000), "file").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "ids")


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The ids of one document; stripes and row groups without it are skipped by their metadata."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id") == doc_id).select("doc_id", "ids")


def op10(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-orc")
    write(documents(spark, sf_dir), path)
    from agrolith.llm.sentencepiece_codec import ids_crc32

    rows = read(spark, path)
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.size("ids").cast("long").alias("n_tokens"), ids_crc32()("ids").alias("ids_crc32"))
