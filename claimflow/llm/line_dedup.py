"""Line deduplication: range-partitioned hashes, streamed in order, answered with compressed bitmaps.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased; its hash is 128 bits of
SHA-256. Lines with a key long enough become rows (hash, document, position), written once. They are
range-partitioned by hash and sorted by (hash, document descending, position) inside a partition, so a
window walks each hash's rows in order: the first document met is the one that keeps the line, ranks
count the documents. Nothing but hash, id and position is shuffled, and what comes back per document is
a run-end-encoded bitmap of the lines that stay, not text. Only ``without_lines``, which applies the
bitmaps, moves each text once.

Hashes that hold many of the rows would make one range too long. Spark's frequent-items sketch
(``approx_top_k``) names at most ``HOT_KEYS`` candidates; their rows take another way to the same answer:
the largest document and the number of documents by hash, aggregated before the shuffle, and a broadcast
of at most ``HOT_KEYS`` rows. Which hashes go there changes the work only, never the result. All of it is
DataFrame operations and SQL functions.

Defined results: a null text counts as empty; an empty text is one empty line. Lines with the same key
in one document stand or fall together. Documents are ids: rows that repeat an id are one document, and
rows without an id are together one document that counts as smaller than all others. Repeated rows each
give their row. If every line of a document goes, an empty text is left. A text of any number of lines
is one row; its lines are exploded as a stream. An empty table gives an empty result. Only id and text
are read, so other columns do no harm whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimflow.llm.common import parallel, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
HOT_KEYS = 1024  # candidates for hot hashes, and rows of the table that is broadcast for them
TRACKED = 8192  # items a sketch follows
HOT_PART = 4  # a hash is hot from this part of a mean range on


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Lower-casing is the plain function where all characters are ASCII, which is quicker."""
    bare = F.trim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _twin(text: Column) -> Column:
    """Tells rows that share an id apart by their text; equal rows share it, and their bitmap."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _hot(rows: DataFrame) -> DataFrame:
    """At most HOT_KEYS short hashes that hold a good part of a mean range, one row each."""
    top = rows.agg(F.expr(f"approx_top_k(short, {HOT_KEYS}, {TRACKED})").alias("items"), F.count("*").alias("total"))
    least = F.greatest(F.lit(64), F.col("total") / (HOT_PART * parallel(rows)))
    items = top.select(F.explode("items").alias("item"), least.alias("least"))
    return items.where(F.col("item.count") >= F.col("least")).select(F.col("item.item").alias("short"))


def _streamed(rows: DataFrame, documents: int) -> DataFrame:
    """Rows to drop, by a walk over ranges of hashes sorted by document and position: all but the first document's."""
    ranged = rows.repartitionByRange(parallel(rows), "hash").sortWithinPartitions(
        F.col("hash"), F.desc_nulls_last("id"), "position")
    walk = Window.partitionBy("hash").orderBy(F.desc_nulls_last("id"))
    seen = ranged.withColumn("place", F.dense_rank().over(walk)).withColumn("documents", F.max("place").over(Window.partitionBy("hash")))
    return seen.where((F.col("documents") >= documents) & (F.col("place") > 1)).select("id", "twin", "position")


def _aggregated(rows: DataFrame, documents: int) -> DataFrame:
    """The same for hot hashes: documents counted before the shuffle, answers of HOT_KEYS rows at most broadcast."""
    counted = rows.groupBy("hash").agg(F.max("id").alias("top"), F.count_distinct(F.struct("id")).alias("documents"))
    counted = counted.where(F.col("documents") >= documents).select("hash", "top")
    lost = rows.join(F.broadcast(counted), "hash").where(~F.col("id").eqNullSafe(F.col("top")))
    return lost.select("id", "twin", "position")


def _run_ends(positions: Column) -> Column:
    """Ascending positions as ends of runs: of the first that stays, the first that goes, the next that stays ..."""
    edges = F.transform(positions, lambda x, i: F.array(
        F.when((i == 0) | (F.get(positions, i - 1) != x - 1), x),
        F.when(F.coalesce(F.get(positions, i + 1) != x + 1, F.lit(True)), x + 1)))
    return F.array_compact(F.flatten(edges))


def keep_bitmaps(df: DataFrame, min_chars: int = 20, documents: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id, twin, run_ends, n_dropped`` for documents that lose lines.

    ``run_ends`` is the keep bitmap, run-end encoded: lines up to its first number stay, up to the second
    go, up to the third stay, and so on; lines after the last run stay. ``twin`` tells rows that share an
    id apart. Keys of at least ``min_chars`` code points found in ``documents`` documents (2 at least) lose
    all lines but those of the largest document.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("twin", _twin(F.col("text")))
    cut = base.select("id", "twin", F.posexplode(lines(F.col("text"))).alias("position", "line"))
    keyed = cut.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    digest = F.unhex(F.substring(F.sha2(F.col("key").cast("binary"), 256), 1, 32))
    rows = stored(keyed.select("id", "twin", "position", digest.alias("hash")), "lines").withColumn("short", F.xxhash64("hash"))
    hot = F.broadcast(stored(_hot(rows), "hot-lines"))
    cold, warm = (rows.join(hot, "short", how).drop("short") for how in ("left_anti", "left_semi"))
    dropped = _streamed(cold, documents).unionByName(_aggregated(warm, documents))
    # Equal rows bring the same positions; a set holds them once, before the shuffle too.
    sets = dropped.groupBy("id", "twin").agg(F.array_sort(F.collect_set("position")).alias("positions"))
    return sets.select("id", "twin", _run_ends(F.col("positions")).alias("run_ends"),
                       F.size("positions").cast("long").alias("n_dropped"))


def without_lines(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_lines, n_dropped, kept_text`` per row: the bitmaps of ``keep_bitmaps`` applied to the texts."""
    base = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.withColumn("_twin", _twin(F.col("_text")))
    match = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_twin") == F.col("twin"))
    found = base.join(bitmaps, match, "left").withColumn("_lines", lines(F.col("_text")))
    found = found.withColumn("n_lines", F.size("_lines").cast("long"))
    ends = F.col("run_ends")
    lengths = F.zip_with(ends, F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(ends)), lambda b, a: b - a)
    stays = F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    # Both arrays are arguments, evaluated once: a slice for each run would copy all lines each time.
    kept = F.array_compact(F.zip_with("_lines", stays, lambda line, stay: F.when(F.coalesce(stay, F.lit(True)), line)))
    return found.select(
        F.col("_id").alias(id_col), "n_lines", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.when(ends.isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"))
