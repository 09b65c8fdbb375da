"""Files as tables: transcripts by line, coverage reports, digests of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrata.functions.events import at, readable


def transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: (path, line, text, event): every line of JSONL files with its number from 1; event is null where a line can't be read. Blank lines are left out.

    Files are read whole, as only that keeps numbers of lines; the work is spread by files.
    """
    f = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = f.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "text")).filter("trim(text) <> ''")
    return lines.select("path", (F.col("pos") + 1).alias("line"), "text", readable(F.col("text")).alias("event"))


def transcript_files(lines: DataFrame, directory: str) -> DataFrame:
    """SRC-22/23: transcripts whose first line was written in ``directory``, with their session: the first line's, else the file's name."""
    first = lines.groupBy("path").agg(F.min_by("event", "line").alias("first"), F.min_by(at(F.col("event"), "$.sessionId"), F.when(at(F.col("event"), "$.sessionId").isNotNull(), F.col("line"))).alias("named"))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return first.filter(at(F.col("first"), "$.cwd") == directory).select("path", F.coalesce("named", stem).alias("session_id"))


def coverage_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17: (file, line_rate) of a Cobertura report."""
    schema = "_filename string, `_line-rate` double, `_name` string"
    return spark.read.format("xml").option("rowTag", "class").schema(schema).load(path).select(F.col("_filename").alias("file"), F.col("_line-rate").alias("line_rate"))


def coverage_total(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17/19: per cent covered, statements and covered statements of a report; the rate stands in where counts are missing; 0 without both. A report that can't be read gives no row."""
    x = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"<coverage\b[^>]*>", 0).alias("tag")).filter("tag <> ''")
    attribute = lambda n: F.try_to_number(F.nullif(F.regexp_extract("tag", rf'\b{n}="([^"]*)"', 1), F.lit("")), F.lit("999999999.999999")).cast("double")
    valid, covered, rate = attribute("lines-valid"), attribute("lines-covered"), attribute("line-rate")
    percent = F.coalesce(F.try_divide(covered, valid), rate, F.lit(0.0)) * 100
    return x.select(percent.alias("percent"), F.coalesce(valid, F.lit(0)).cast("bigint").alias("statements"), F.coalesce(covered, F.lit(0)).cast("bigint").alias("covered"))


def coverage_database(spark: SparkSession, path: str) -> DataFrame:
    """SRC-18: (file, executed): executed lines of each file in a coverage database, whose bitmaps have bit k of byte b for line 8 b + k; contexts are united."""
    read = lambda t: spark.read.format("sqlite_table").option("path", path).option("table", t).load()
    byte = "cast(conv(hex(substring(numbits, i + 1, 1)), 16, 10) as int)"
    lines = F.expr(f"flatten(transform(sequence(0, length(numbits) - 1), i -> filter(transform(sequence(0, 7), k -> if(shiftright({byte}, k) & 1 = 1, 8 * i + k, -1)), x -> x >= 0)))")
    executed = read("line_bits").filter("length(numbits) > 0").select("file_id", F.explode(lines).alias("line")).distinct().groupBy("file_id").agg(F.count(F.lit(1)).alias("executed"))
    files = read("file").select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    return files.join(executed, "file_id", "left").select("file", F.coalesce("executed", F.lit(0)).alias("executed"))


def coverage(spark: SparkSession, xml: str | None, database: str | None, statements: DataFrame | None = None) -> DataFrame | None:
    """SRC-19: (percent, source) of the report if there is one, else of the database against the statement counts (file, statements), else None."""
    if xml is not None:
        return coverage_total(spark, xml).select("percent", F.lit("xml").alias("source"))
    if database is None or statements is None:
        return None
    d = statements.join(coverage_database(spark, database), "file", "left").agg(F.sum(F.least(F.coalesce("executed", F.lit(0)), "statements")).alias("e"), F.sum("statements").alias("s"))
    return d.select((F.coalesce(F.try_divide("e", "s"), F.lit(0.0)) * 100).alias("percent"), F.lit("database").alias("source"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """SRC-13: paths of ``new`` that ``old`` lacks or has with other content; removed ones aren't listed. Contents meet as digests."""
    digest = lambda d, n: d.select("path", F.sha2("content", 256).alias(n))
    return digest(new, "a").join(digest(old, "b"), "path", "left").filter("b is null or a <> b").select("path")


def tree_hash(files: DataFrame, *keys: str) -> DataFrame:
    """SF-07: one digest of all paths and contents of each tree, in order of paths; a tree's list of digests is a row of its own."""
    one = F.concat_ws(":", "path", F.sha2("content", 256))
    return files.groupBy(*keys).agg(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(one)), "|"), F.lit("|file_count:"), F.count(F.lit(1)).cast("string")), 256).alias("tree_hash"))
