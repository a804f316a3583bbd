"""Lines that repeat across documents stay in the first document alone.

A line's key is its text without white space at the ends and with A-Z in lower case; two
64-bit hashes stand for it. One shuffle deals the lines by ranges of the hash and sorts them
by hash, document and position, so that a running window streams through each hash and meets
its first document first. A line of any later document is dropped.

Keys that hold a large share of all lines would fill one range. They are found beforehand by
Spark's frequent-items sketch, at most ``HOT_KEYS`` of them, and their first documents by a
grouping that combines before it shuffles; their lines are decided where they are read. The
sketch decides the way alone: a key is treated alike on either.

Nothing but hashes, ids and positions is shuffled. The result is a bitmap per document, kept
sparse: its 64-bit words that drop a line, by their place.

Results per row:

* a null or empty text is one empty line; short keys (``min_chars``) always stay;
* repeats within one document stay if it is the first to hold the key, else all go;
* rows that share a doc_id are one document: a key they share alone stays in all of them; the
  bitmap is per row of distinct (doc_id, text);
* a null doc_id comes after all others; rows without one are one document;
* an empty table gives an empty table; other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacart.llm.common import ASCII_SPACE, lower_ascii, shuffle_partitions, stored

HOT_KEYS = 100
#: Items that a frequent-items sketch tracks, and tasks that merge sketches first.
TRACKED = 1024
MERGERS = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(ASCII_SPACE)))


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """hash, doc (null ids as the largest), row (of the text) and at for each line that counts."""
    lines = docs.select(
        F.col("doc_id").alias("doc"),
        F.xxhash64("text").alias("row"),
        F.posexplode(lines_of(F.col("text"))).alias("at", "line"),
    ).withColumn("key", line_key(F.col("line")))
    return lines.where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("hash"),
        F.hash("key").alias("check"),
        "doc",
        "row",
        "at",
    )


def _hot_keys(lines: DataFrame) -> DataFrame:
    """At most ``HOT_KEYS`` hashes; any with over 1 % of the lines is among them. Sketches of a
    fixed size are merged in two steps."""
    parts = lines.groupBy(F.expr(f"spark_partition_id() % {MERGERS}").alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(hash, {TRACKED})").alias("sketch")
    )
    # Grouped by a constant, since the functions do not take the sketch of no rows.
    merged = parts.groupBy(F.lit("all")).agg(
        F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch")
    )
    return merged.select(
        F.explode(F.expr(f"approx_top_k_estimate(sketch, {HOT_KEYS})")).alias("top")
    ).select(F.col("top.item").alias("hash"))


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc, row and at of each line that goes."""
    lines = stored(_occurrences(docs, min_chars), "lines")
    hot = lines.join(F.broadcast(_hot_keys(lines)), "hash", "left_semi")
    hot_first = hot.groupBy("hash", "check").agg(
        F.min(F.struct(F.col("doc").isNull().alias("unknown"), "doc")).alias("first")
    )
    decided = lines.join(F.broadcast(hot_first), ["hash", "check"], "left")
    in_hot = decided.where("first IS NOT NULL")
    others = decided.where("first IS NULL").drop("first")

    ranges = others.repartitionByRange(shuffle_partitions(docs.sparkSession), "hash")
    stream = (
        Window.partitionBy("hash", "check")
        .orderBy(F.asc_nulls_last("doc"), "at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    streamed = ranges.withColumn("first", F.first(F.struct(F.lit(False), "doc")).over(stream))
    both = in_hot.select("doc", "row", "at", F.col("first.doc").alias("first")).union(
        streamed.select("doc", "row", "at", F.col("first.doc").alias("first"))
    )
    return both.where("NOT (doc <=> first)").select("doc", "row", "at")


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Per document that loses lines: doc, row (a hash of its text), n_dropped and ``keep``,
    the sorted words (word, bits) of its bitmap that drop a line; the i-th line stays if bit
    ``i % 64`` of word ``i / 64`` is set, or there is no such word."""
    bit = F.expr("shiftleft(1L, at % 64)")
    words = (
        dropped_lines(docs, min_chars)
        .repartition("doc", "row")
        .groupBy("doc", "row", F.expr("CAST(at DIV 64 AS INT)").alias("word"))
        .agg(F.bit_or(bit).alias("gone"))
    )
    return words.groupBy("doc", "row").agg(
        F.sum(F.bit_count("gone")).alias("n_dropped"),
        F.sort_array(
            F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))
        ).alias("keep"),
    )


def without_repeats(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``, which replace columns of
    these names."""
    added = ("kept_text", "n_lines", "n_dropped")
    mine = F.struct(*[docs[c] for c in docs.columns if c not in added]).alias("mine")
    keyed = docs.select(mine, F.xxhash64(docs["text"]).alias("row"))
    maps = keep_bitmaps(docs.select("doc_id", "text"), min_chars)
    joined = (
        keyed.alias("d")
        .join(
            maps.alias("m"),
            F.expr("d.mine.doc_id <=> m.doc AND d.row = m.row"),
            "left",
        )
        .select("mine", "n_dropped", F.map_from_entries("keep").alias("words"))
        .withColumn("lines", lines_of(F.col("mine.text")))
    )
    kept = F.expr(
        """
        CASE WHEN n_dropped IS NULL THEN coalesce(mine.text, '')
        ELSE array_join(filter(lines, (line, i) ->
            shiftright(coalesce(try_element_at(words, CAST(i DIV 64 AS INT)), -1L), i % 64) & 1L
            = 1L), '\n') END
        """
    )
    return joined.select(
        "mine.*",
        kept.alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )
