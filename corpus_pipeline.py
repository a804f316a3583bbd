"""From raw documents to token ids, in stages that are each stored before the next.

Each stage takes all that its predecessor kept, and but for the last returns the columns of
``documents``. Texts are shuffled by the stages that must bring a document and its verdict
together; models, weights and bitmaps are small beside them.

Results per row, beyond those that each operator states:

* ``documents`` may have further columns: they are dropped by the first stage;
* of rows that share an id one stays after the near duplicates, that with the first text;
* a document that lost all its lines stays, as an empty one;
* an empty table gives an empty table.

A stage is computed by whoever writes what it returns, so the stages that end in Python bound
the session's batches by bytes, unless it has a bound of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacart.llm import factor_machine, line_dedup, merge_replay, mixing, ngram_join
from stratacart.llm.common import keep_batches_small, stored, table
from stratacart.llm.queries import BYTE_RANKS, LEXICON, MIX

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The part of all tokens that the mixture keeps, whatever its cells are.
KEEP_SHARE = 0.66

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores one half or more."""
    keep_batches_small(spark)
    model = factor_machine.learn(docs, table(spark, sf_dir, "labels"))
    scored = factor_machine.score(docs.select(*COLUMNS), model, keep=COLUMNS)
    return scored.where("score >= 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has."""
    kept = line_dedup.without_repeats(docs.select(*COLUMNS), min_chars=10)
    text = F.col("kept_text")
    return kept.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    groups = ngram_join.near_duplicates(docs, width=5, percent=80)
    firsts = groups.where("doc_id = component_id").select("doc_id").distinct()
    once = Window.partitionBy("doc_id").orderBy("text")
    known = (
        docs.join(firsts, "doc_id")
        .withColumn("place", F.row_number().over(once))
        .where("place = 1")
        .select(*COLUMNS)
    )
    return known.union(docs.where("doc_id IS NULL").select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of ``KEEP_SHARE`` of the tokens, with raked shares of sources, languages and
    topics; what is too rare for its share is kept whole."""
    mixed = mixing.mixed(docs.select(*COLUMNS), LEXICON, **MIX, keep_share=KEEP_SHARE)
    return mixed.where("kept").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""
    keep_batches_small(spark)
    return merge_replay.encode_checked(docs, BYTE_RANKS, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL has no trained classifier.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the others are stored in the shared scratch folder."""
    docs = table(spark, sf_dir, "documents")
    *before, (_, last) = STAGES
    for _, stage in before:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return last(spark, docs, sf_dir)
