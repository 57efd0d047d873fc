"""Landing folders to one raw table ``(source, file, raw)``.

A landing folder has one sub-folder per source. Whole folders are listed, never single files, and
only the requested sources are scanned. ``compact`` turns the many small files into a Parquet
table partitioned by source, which is what a large run should read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EXACT_GOLD, GOLD, PROMPT, RAW_FILES, SOURCES
from ..functions.text import strip


def _named(df: DataFrame, source: str) -> DataFrame:
    """Invalid UTF-8 is replaced, not rejected."""
    return df.select(
        F.lit(source).alias("source"),
        F.col("_metadata.file_name").alias("file"),
        F.make_valid_utf8("value").alias("raw"),
    )


def scan_source(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """One source's folder, one row per file."""
    return _named(spark.read.text(f"{folder}/{source}", wholetext=True), source)


def scan_fax(spark: SparkSession, folder: str) -> DataFrame:
    return scan_source(spark, folder, "fax")


def scan_hl7(spark: SparkSession, folder: str) -> DataFrame:
    return scan_source(spark, folder, "hl7v2")


def scan_fhir(spark: SparkSession, folder: str) -> DataFrame:
    return scan_source(spark, folder, "fhir_r4")


def scan_edi(spark: SparkSession, folder: str) -> DataFrame:
    return scan_source(spark, folder, "edi837")


def scan_webhook(spark: SparkSession, folder: str) -> DataFrame:
    return scan_source(spark, folder, "webhook")


def check_sources(sources: Iterable[str] | None) -> list[str]:
    wanted = list(sources or SOURCES)
    unknown = [s for s in wanted if s not in SOURCES]
    if unknown:
        raise ValueError(f"unknown sources: {unknown}")
    return wanted


def source_union(spark: SparkSession, folder: str, sources: Iterable[str] | None = None) -> DataFrame:
    """All requested sources in one table; the others are not even listed."""
    frames = [scan_source(spark, folder, s) for s in check_sources(sources)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def compact(raw: DataFrame, path: str, files_per_source: int | None = None) -> None:
    """Write the raw table as Parquet, partitioned by source.

    Without ``files_per_source`` the scan's own partitions are kept and nothing is shuffled.
    With it, rows spread over source and a file-name hash, so one dominant source still makes
    that many files instead of one.
    """
    if files_per_source:
        bucket = F.pmod(F.xxhash64("file"), F.lit(files_per_source))
        raw = raw.repartition(len(SOURCES) * files_per_source, "source", bucket)
    raw.write.mode("overwrite").partitionBy("source").parquet(path)


def read_compacted(spark: SparkSession, path: str, sources: Iterable[str] | None = None) -> DataFrame:
    """The filter is on the partition column, so other sources' files are pruned."""
    wanted = check_sources(sources)
    df = spark.read.schema(RAW_FILES).parquet(path)
    return df.where(F.col("source").isin(wanted)).select("source", "file", "raw")


def object_store_scan(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """Objects under any Hadoop path with bucket, key and size.

    The bytes are read only when ``with_content`` asks for them.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    url = F.col("path")
    rest = F.regexp_replace(url, r"^[a-z0-9]+:/*", "")
    out = df.select(
        F.substring_index(rest, "/", 1).alias("bucket"),
        F.regexp_replace(rest, r"^[^/]*/", "").alias("key"),
        F.substring_index(url, "/", -1).alias("file"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        *([F.col("content")] if with_content else []),
    )
    return out


def gold_scan(spark: SparkSession, path: str) -> DataFrame:
    """Labelled records, one JSON object per line; blank lines are skipped.

    List values of ``expected`` stay JSON text.
    """
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    return lines.select(F.from_json("value", GOLD).alias("g")).select("g.*")


def exact_gold_scan(spark: SparkSession, path: str) -> DataFrame:
    """Labelled normaliser inputs (``source_type, input, expected``)."""
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    return lines.select(F.from_json("value", EXACT_GOLD).alias("g")).select("g.*")


def prompts_from_text(files: DataFrame, text: str = "raw") -> DataFrame:
    """Prompt files' text to prompt rows; files that are not a usable prompt drop out."""
    from ..fixed import PROMPT_MAX_TOKENS, PROMPT_MODEL

    p = F.col("p")
    parsed = files.withColumn("p", F.from_json(text, PROMPT)).where(
        p["name"].isNotNull() & p["version"].isNotNull()
        & p["system"].isNotNull() & p["user_template"].isNotNull()
    )
    defaults = {
        "model": F.lit(PROMPT_MODEL), "max_tokens": F.lit(PROMPT_MAX_TOKENS),
        "temperature": F.lit(0.0),
    }
    cols = [
        (F.coalesce(p[f.name], defaults[f.name]) if f.name in defaults else p[f.name]).alias(f.name)
        for f in PROMPT.fields
    ]
    keep = [c for c in ("file",) if c in files.columns]
    return parsed.select(*keep, *cols)


def prompt_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Folder of ``*.json`` prompt files; ``file`` keeps the load order."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    named = files.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw"))
    return prompts_from_text(named)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core.

    The phases are heavy per row and never shuffle, so a table in a few small files would leave
    most cores idle. A scan that already has enough splits is returned as it is. With ``rows`` (for a
    scan of a few narrow columns) there are enough partitions that none has more than about that many,
    so a task takes as long for a large table as for a small one; the count reads the files' footers.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        wanted = max(wanted, -(-df.count() // rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
