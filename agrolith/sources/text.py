"""Text and CSV sources as DataFrames: explicit schemas, sentinels decoded to NULL, files read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Centre months of three-month season labels.
SEASONS = ["DJF", "JFM", "FMA", "MAM", "AMJ", "MJJ", "JJA", "JAS", "ASO", "SON", "OND", "NDJ"]


def decoded(x: Column, below: float = -900.0) -> Column:
    return F.when(x >= below, x)


def csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """One file or a glob, in one scan; only ``columns`` are parsed."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def csv_without_overlap(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """As ``csv``, with rows of equal keys once: overlapping files must not be summed twice. The last file's row stays."""
    df = csv(spark, path, schema).withColumn("__file", F.input_file_name())
    rest = [c for c in df.columns if c not in (*keys, "__file")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__file").alias("v")).select(*keys, "v.*")


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The last path of a glob by name; names carry run stamps. Listed by the file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(where)
    return max((f.getPath().toString() for f in found), default=None) if found is not None else None


def first_present(spark: SparkSession, patterns: list[str]) -> str | None:
    """The first glob that has files: preferred sources before their stand-ins."""
    return next((p for p in patterns if newest(spark, p)), None)


def optional(spark: SparkSession, pattern: str, schema: str) -> DataFrame | None:
    """None where the source is absent, so that its layer is dropped rather than made up."""
    return csv(spark, pattern, schema) if newest(spark, pattern) else None


def fields(lines: DataFrame) -> Column:
    return F.split(F.trim("value"), r"\s+")


def fixed_table(lines: DataFrame, names: list[str]) -> DataFrame:
    """Headerless columns parted by white space; lines with other numbers of fields, or words, are skipped."""
    x = lines.select(F.transform(fields(lines), lambda v: v.try_cast("double")).alias("f")).where(F.size("f") == len(names)).where(F.forall("f", lambda v: v.isNotNull()))
    return x.select(*[F.col("f")[i].alias(n) for i, n in enumerate(names)])


def dated_values(lines: DataFrame, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """``date,value`` lines below a header in prose; sentinels become NULL."""
    parts = F.split("value", ",")
    x = lines.select(F.try_to_timestamp(F.trim(F.try_element_at(parts, F.lit(1))), F.lit(fmt)).cast("date").alias("date"), F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double").alias("v"))
    return x.where("date is not null").select("date", decoded(F.col("v")).alias("value"))


def season_values(lines: DataFrame) -> DataFrame:
    """``DJF 1950 total anomaly`` lines: year, month (the season's centre), total, anomaly."""
    f = fields(lines)
    month = F.array_position(F.array(*[F.lit(s) for s in SEASONS]), f[0]).cast("int")
    x = lines.where(F.size(f) == 4).select(f[1].try_cast("int").alias("year"), month.alias("month"), f[2].try_cast("double").alias("total"), f[3].try_cast("double").alias("anomaly"))
    return x.where("month > 0 and year is not null")


def year_grid(lines: DataFrame, years: tuple[int, int] = (1800, 2200)) -> DataFrame:
    """``year v1 ... v12`` lines to rows (year, month, value); other lines are prose."""
    f = F.transform(fields(lines), lambda v: v.try_cast("double"))
    x = lines.select(f.alias("f")).where((F.size("f") == 13) & F.col("f")[0].between(*years))
    return x.select(F.col("f")[0].cast("int").alias("year"), F.posexplode(F.slice("f", 2, 12)).alias("i", "v")).select("year", (F.col("i") + 1).cast("int").alias("month"), decoded(F.col("v")).alias("value"))


def column_of(lines: DataFrame, year: int, month: int, value: int) -> DataFrame:
    """Columns by position, from 1; lines that don't parse are skipped."""
    f = fields(lines)
    x = lines.select(*[F.try_element_at(f, F.lit(i)).try_cast("double").alias(n) for n, i in (("year", year), ("month", month), ("v", value))])
    return x.where("year is not null and month between 1 and 12").select(F.col("year").cast("int"), F.col("month").cast("int"), decoded(F.col("v")).alias("value"))


def repaired_area(value: Column, unit: Column) -> Column:
    """Thousand hectares from reports whose value and unit slipped: a numeric unit beside the value 1000 is the value."""
    number = unit.try_cast("double")
    v = F.when((value.try_cast("double") == 1000) & number.isNotNull(), number).otherwise(value.try_cast("double"))
    return F.when(unit.rlike(r"(?i)^\s*ha\s*$"), v / 1000).otherwise(v)


def edge(spark: SparkSession, pattern: str, schema: str, date: str = "date") -> DataFrame:
    """The last day that the newest file of a glob holds; one row, empty if there is no file."""
    path = newest(spark, pattern)
    rows = csv(spark, path, schema, [date]) if path else spark.createDataFrame([], schema).select(date)
    return rows.agg(F.max(date).alias("edge")).where("edge is not null")


def tables_after_prose(spark: SparkSession, pattern: str, first_cell: str, schema: str, within: int = 15, name: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Tables that follow some lines of prose: (rows, files without a header).

    The header is the first of the ``within`` first lines whose first cell is ``first_cell`` in any case; releases differ
    in how many lines come before it. Rows are the lines below it, read as CSV by position as ``schema``, with file (its name, or ``name``),
    line (its number from 1) and as_of, the date in the file's name or null. A file is a report of some pages, read as a whole.
    Cells that aren't of their type are null, lines without a first cell are left out, and carriage returns don't count.
    """
    file = name if name is not None else F.element_at(F.split("_metadata.file_path", "/"), -1)
    whole = spark.read.text(pattern, wholetext=True).select(file.alias("file"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))
    cell = lambda line: F.lower(F.trim(F.regexp_replace(F.substring_index(line, ",", 1), '"', "")))
    at = F.array_position(F.transform(F.slice("lines", 1, within), cell), first_cell.lower())
    named = whole.select("file", F.to_date(F.regexp_extract("file", r"\d{4}-\d{2}-\d{2}", 0).try_cast("date")).alias("as_of"), "lines", at.alias("at"))
    below = named.where("at > 0").select("file", "as_of", "at", F.posexplode("lines").alias("n", "text")).where("n >= at")
    read = below.select("file", "as_of", (F.col("n") + 1).alias("line"), F.from_csv("text", schema, {"mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r"), cell(F.col("text")).alias("__first"))
    return read.where("__first <> ''").select("file", "line", "as_of", "r.*"), named.where("at = 0").select("file", "as_of")
