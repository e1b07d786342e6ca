"""WARC archives: written with segmented, chunked records, and read back by segment reassembly.

Writing: a page is a ``response`` record, or a ``revisit`` of the record that holds the same
payload. Payloads are framed by chunked transfer coding; blocks longer than a segment go on in
``continuation`` records, which name the first by WARC-Segment-Origin-ID, and of which the last
has WARC-Segment-Total-Length. Spark's text writer makes the files: a row is a record, the
record separator ends it, and lost tasks are committed again like those of any table.

Reading: Spark's text reader cuts archives, plain or gzip, at each line that begins a record,
so that plain ones are read in parallel too. Such a line may be part of a payload: a piece
shorter than its Content-Length takes the pieces after it, which one pass over the lengths of
that archive's pieces decides. Only records in segments are shuffled, by their origin identifier: they are put in
order, their numbers must run from 1 without a gap and their lengths must add up to the total.
Then the HTTP head is split off and chunked framing decoded.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.llm.shared import ROW, discard, scratch, sized, small_batches, stored, with_rows

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
#: Payloads of at least so many bytes are written once.
LEAST_BYTES = 0
RECORDS_A_FILE = 50_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What a record begins with, after the line end before it. No other character of it is a line end, so that a reader
#: that loses the thread at the end of its buffer still finds it.
MARK = "\nWARC/1."
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest(payload: Column) -> Column:
    """SHA-1 of a binary column in upper-case base32, 32 characters."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), *_BASE32)


def _urn(*key: Column) -> Column:
    h = F.md5(F.concat_ws(":", *[k.cast("string") for k in key]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[F.concat(F.substring(h, a, n), F.lit(end)) for a, n, end in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">"))])


def _address(url: Column) -> Column:
    """Control characters and spaces, which a header can't hold, as %XX."""
    safe = url
    for c in (*range(33), 127):
        safe = F.replace(safe, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), safe).otherwise(url)


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer coding in chunks of ``size`` bytes."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, with chunk extensions and trailers passed over; None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", size):
            return None
        n, at = int(size, 16), end + 2
        if not n:
            done = body.startswith(b"\r\n", at) or body.find(b"\r\n\r\n", at) >= 0
            return b"".join(parts) if done else None
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        parts.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> tuple[bytes, str | None]:
    """Of an HTTP response: the payload, and what was wrong. A body that is said to be chunked but isn't comes as it is."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return block, "no http head"
    if re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head):
        plain = unchunked(body)
        return (body, "not chunked") if plain is None else (plain, None)
    return body, None


def write(pages: DataFrame, path: str, *, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, least_bytes: int = LEAST_BYTES, compression: str = "gzip") -> None:
    """Write one record for each row (page_id, url, html) of ``pages``, in UTF-8; null html is empty.

    Of rows with equal payloads of ``least_bytes`` or more, equal meaning equal SHA-256, the one with the smallest page_id
    (null ones last, ties by place) is the response. A null page_id or url gives no such header. An empty table makes archives without records.
    Other columns aren't read. compression: of a whole archive, ``gzip`` or ``none``.
    """
    small_batches(pages.sparkSession)
    keyed = with_rows(pages).select(ROW, "page_id", "url", "html")
    salt = F.lit(uuid.uuid4().hex)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    facts = keyed.select(ROW, "page_id", payload.alias("payload")).where(F.octet_length("payload") >= least_bytes).select(ROW, "page_id", F.sha2("payload", 256).alias("same"))
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", ROW)).alias("first")
    groups = stored(facts.groupBy("same").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("same", F.col(f"first.{ROW}").alias("first_row")), "warc-groups")
    again = stored(facts.join(sized(groups), "same").where(F.col(ROW) != F.col("first_row")).select(F.col(ROW).alias("again"), "first_row"), "warc-again")

    @F.arrow_udf("array<binary>")
    def segments(html: pa.Array) -> pa.Array:
        out = []
        for text in html.cast(pa.binary()).to_pylist():
            block = HEAD + chunked(text, chunk_bytes)
            out.append([block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)])
        return pa.array(out, pa.list_(pa.binary()))

    rows = keyed.join(sized(again), F.col(ROW) == F.col("again"), "left")
    about = ["page_id", _address(F.col("url")).alias("url"), digest(payload).alias("digest")]
    whole = rows.where("again is null").select(ROW, *about, segments(F.coalesce("html", F.lit(""))).alias("blocks"))
    total = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.octet_length(b))
    parts = whole.select(ROW, "page_id", "url", "digest", total.alias("total"), F.size("blocks").alias("of"), F.posexplode("blocks").alias("at", "block"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    only = lambda when, value: F.when(when, value)
    is_first, segmented = F.col("at") == 0, F.col("of") > 1
    common = [line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", F.col("url"))]
    response = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(is_first, "response").otherwise("continuation")),
        line("WARC-Record-ID", F.when(is_first, _urn(salt, F.col(ROW))).otherwise(_urn(salt, F.col(ROW), F.col("at")))),
        *common,
        line("Page-Id", only(is_first, F.col("page_id"))),
        line("WARC-Payload-Digest", only(is_first, F.concat(F.lit("sha1:"), "digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), digest(F.col("block")))),
        line("WARC-Segment-Number", only(segmented, F.col("at") + 1)),
        line("WARC-Segment-Origin-ID", only(~is_first, _urn(salt, F.col(ROW)))),
        line("WARC-Segment-Total-Length", only(segmented & (F.col("at") == F.col("of") - 1), F.col("total"))),
        line("Content-Type", only(is_first, F.lit("application/http; msgtype=response"))),
        line("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
        F.col("block").cast("string"),
    )
    revisit = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.lit("revisit")),
        line("WARC-Record-ID", _urn(salt, F.col(ROW))),
        *common,
        line("Page-Id", F.col("page_id")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Refers-To", _urn(salt, F.col("first_row"))),
        line("WARC-Profile", F.lit(PROFILE)),
        line("Content-Length", F.lit(0)),
        F.lit("\r\n"),
    )
    records = parts.select(response.alias("value")).union(rows.where("again is not null").select("first_row", ROW, *about).select(revisit.alias("value")))
    records.write.option("compression", compression).option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)
    discard(groups, again)


def _field(name: str) -> Column:
    found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _owners(pieces: DataFrame) -> DataFrame:
    """Rows (file, start, n, owner_start, owner_n) of the pieces of records that a payload's own mark has cut; pieces is a stored table."""
    broken = pieces.where("length is null or octets - body_at < length").select(F.col("file").alias("broken")).distinct()
    numbers = pieces.join(sized(stored(broken, "warc-broken"), 100_000), F.col("file") == F.col("broken"), "left_semi").select("file", "start", "n", "octets", "body_at", "length")

    def walk(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["start", "n"])
        out, owner, missing = [], None, 0
        for r in table.itertuples(index=False):
            if owner is not None and missing > 0:
                missing -= len(MARK) + r.octets
                out.append((r.file, r.start, r.n, *owner))
                continue
            owner, missing = None, 0
            if not pd.isna(r.length):
                missing = int(r.length) - (r.octets - r.body_at)
                if missing > 0:
                    owner = (r.start, r.n)
                    out.append((r.file, r.start, r.n, *owner))
        return pd.DataFrame(out, columns=["file", "start", "n", "owner_start", "owner_n"])

    return stored(numbers.groupBy("file").applyInPandas(walk, "file string, start long, n long, owner_start long, owner_n long"), "warc-owners")


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """A stored table of what lies between two marks: file, start and n (its place), raw, octets, body_at (where its body begins) and length (its Content-Length)."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")]
    text = spark.read.schema("value string").option("lineSep", MARK).text(path).select("value", *place)
    head = F.substring_index("value", "\r\n\r\n", 1)
    rows = text.select("file", "start", "n", F.col("value").cast("binary").alias("raw"), F.octet_length("value").cast("long").alias("octets"), (F.octet_length(head) + 4).cast("long").alias("body_at"), head.alias("head"))
    rows = rows.withColumn("length", _field("Content-Length").try_cast("long")).withColumn("length", F.when(F.col("body_at") <= F.col("octets"), F.col("length")))
    return stored(rows.drop("head"), "warc-pieces", compression="zstd")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, head, block, whole), one for each record of the archives in ``path``; whole: the block is as long as its Content-Length."""
    pieces = pieces_of(spark, path)
    owners = _owners(pieces)
    single, merged = pieces.select("file", "raw", "body_at", "length"), None
    if owners.limit(1).count():  # else no payload has a mark in it
        owner = owners.select(F.col("file").alias("of"), F.col("start").alias("s"), F.col("n").alias("m"), "owner_start", "owner_n")
        met = (F.col("file") == F.col("of")) & (F.col("start") == F.col("s")) & (F.col("n") == F.col("m"))
        single = pieces.join(sized(owner, 100_000), met, "left_anti").select("file", "raw", "body_at", "length")
        parts = pieces.join(sized(owner, 100_000), met).groupBy("file", "owner_start", "owner_n").agg(F.sort_array(F.collect_list(F.struct("start", "n", "raw", "body_at", "length"))).alias("p"))
        joined = F.array_join(F.transform("p", lambda x: x["raw"].cast("string")), MARK).cast("binary")
        merged = parts.select("file", joined.alias("raw"), F.col("p")[0]["body_at"].alias("body_at"), F.col("p")[0]["length"].alias("length"))
    rows = single.unionByName(merged) if merged is not None else single
    block = F.substr("raw", F.col("body_at") + 1, F.col("length"))
    head = F.substr("raw", F.lit(1), F.col("body_at") - 4).cast("string")
    out = rows.where("length is not null").select("file", head.alias("head"), block.alias("block"), "length")
    return out.select("file", "head", "block", (F.octet_length("block") == F.col("length")).alias("whole"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all records but continuations: record_id, record_type, url, page_id, payload, payload_digest, refers_to, segments, problem.

    payload_digest is the computed one, for a record without a payload the one it names. problem is null,
    or one of ``truncated`` (a block shorter than its Content-Length), ``segment missing``
    (numbers with gaps, or no last one), ``wrong total length`` (these three have no payload),
    ``no http head``, ``not chunked`` (these two have the body as it is) and ``wrong digest``. A segment that repeats counts once.
    Continuations without their first record have its identifier and the type ``continuation``.
    Text before the first record of an archive, or without a readable Content-Length, is passed over. Archives without records give no rows.
    """
    small_batches(spark)
    fields = {
        "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "url": "WARC-Target-URI", "page_id": "Page-Id", "named": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
        "origin": "WARC-Segment-Origin-ID", "number": "WARC-Segment-Number", "total": "WARC-Segment-Total-Length", "content": "Content-Type",
    }
    rows = records(spark, path).select("block", "whole", *[_field(f).alias(c) for c, f in fields.items()])
    rows = rows.withColumn("number", F.col("number").try_cast("long")).withColumn("total", F.col("total").try_cast("long")).withColumn("record_type", F.lower("record_type"))
    names = ["record_id", "record_type", "url", "page_id", "named", "refers_to", "content"]
    single = rows.where("number is null").select(*names, "block", F.lit(1).alias("segments"), F.when(~F.col("whole"), "truncated").alias("problem"))
    parts = rows.where("number is not null").withColumn("key", F.coalesce("origin", "record_id")).withColumn("about", F.struct(*names)).repartition("key")  # both aggregates need no other shuffle
    parts = parts.groupBy("key", "number").agg(F.first(F.struct("block", "whole", "total", "about")).alias("s")).select("key", "number", "s.*")
    whole = parts.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("p"), F.min("whole").alias("whole"), F.max("total").alias("total"), F.max("number").alias("top"), F.min("number").alias("low"),
        F.max_by("total", "number").alias("ends"), F.min_by("about", "number").alias("about"), F.sum(F.octet_length("block")).alias("octets"), F.count(F.lit(1)).alias("segments"),
    )
    wrong = F.when(~F.col("whole"), "truncated").when((F.col("low") != 1) | (F.col("top") != F.col("segments")) | F.col("ends").isNull(), "segment missing").when(F.col("total") != F.col("octets"), "wrong total length")
    block = F.array_join(F.transform("p", lambda x: x["block"].cast("string")), "").cast("binary")
    joined = whole.select(F.col("key").alias("record_id"), *[f"about.{c}" for c in names[1:]], block.alias("block"), F.col("segments").cast("int").alias("segments"), wrong.alias("problem"))
    found = single.union(joined).where("record_type <> 'continuation' or problem is not null")

    @F.arrow_udf("struct<payload: binary, problem: string>")
    def decoded(block: pa.Array, http: pa.Array) -> pa.Array:
        out = [(b, None) if b is None or not h else payload_of(b) for b, h in zip(block.to_pylist(), http.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([p for p, _ in out], pa.binary()), pa.array([w for _, w in out], pa.string())], ["payload", "problem"])

    sound = F.when(F.col("problem").isNull() & (F.col("record_type") != "revisit"), F.col("block"))
    http = F.coalesce(F.lower("content").startswith("application/http"), F.lit(False))
    got = found.select(*names, "segments", "problem", decoded(sound, http).alias("d"))
    got = got.select(*names, "segments", F.col("d.payload").alias("payload"), F.coalesce("problem", "d.problem").alias("problem"))
    named = F.regexp_extract("named", r"(?i)^sha1:([A-Z2-7]{32})$", 1)
    got = got.withColumn("own", digest(F.col("payload"))).withColumn("named", F.when(named != "", F.upper(named)))
    return got.select("record_id", "record_type", "url", "page_id", "payload", F.coalesce("own", "named").alias("payload_digest"), "refers_to", "segments", F.coalesce("problem", F.when(F.col("own") != F.col("named"), "wrong digest")).alias("problem"))


def op12(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    facts = read(spark, path).select("record_id", "record_type", F.col("page_id").cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "refers_to")
    facts = stored(facts, "warc-facts")
    target = facts.where("record_type = 'response'").select(F.col("record_id").alias("first"), F.col("page_id").alias("first_page"), F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest"))
    revisits = facts.where("record_type = 'revisit'").join(target, F.col("refers_to") == F.col("first"), "left")
    same = F.when(F.col("payload_digest") == F.col("first_digest"), F.col("first_bytes"))
    out = revisits.select("page_id", same.alias("payload_bytes"), "payload_digest", "record_type", F.col("first_page").alias("refers_to"))
    return facts.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).union(out)


ORACLE = """
WITH h AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first, count(*) OVER (PARTITION BY coalesce(html, '')) AS n FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, CAST(10 * (i // 8) + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h"""
