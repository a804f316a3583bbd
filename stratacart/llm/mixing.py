"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic. Starting from each cell's tokens,
weights are raked in turn so that the tokens of every source, then of every language, then of
every topic come to their target share, until no margin is further than ``TOLERANCE`` from it.
A document is kept with a probability that is the least of 1 and a multiple of its cell's
weight, by which ``keep_share`` of all tokens is kept in expectation. Cells at 1 are kept whole
and stay below their raked share, since nothing is repeated; the others keep their proportions.

Words are lower-cased runs of letters, marks and digits, and tokens runs of other than white
space, whatever parts them. The texts are read once: what is counted of them is stored.

A cell's weight is a product of one factor per source, language and topic. A source's factor
follows from the others in its own row, so a round is one Spark job over a row per source, while
the driver holds the table of languages by topics. If that has more than ``MAX_TABLE`` cells,
the factors are columns of the stored cells instead, and a round is a join and a sum for each.

Whether a document is kept depends on its id and the seed alone, so a task that runs again
decides alike.

Results per row:

* a null source, language or topic is a category like others; a null id is drawn as one;
* a null or empty text has no tokens; a source without any token is never kept;
* with ``keep_share`` beyond the tokens of all cells of a weight, those are kept whole;
* shares to the power 0 ask for equal shares, 1 for the corpus's own;
* repeated ids are drawn together; an empty table gives an empty table;
* the columns of the input stay; those with the name of an added one are replaced.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacart.llm.common import Steps

#: The largest error of a margin, as a part of its target, and when to give up reaching it:
#: margins that contradict each other, as of cells that do not exist, are never reached.
TOLERANCE = 1e-11
ROUNDS = 200
MAX_TABLE = 10_000
DRAW_BITS = 52
#: What parts words, and what a token is, in any script.
NOT_A_WORD = "[^\\p{L}\\p{M}\\p{N}]+"
RUN = "(?U)\\S+"

log = logging.getLogger(__name__)


def topic_of_words(text: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """The topic with most words in the text, the first by name among equals; ``other`` if
    there is none. The text is cut once, and what no topic has is left out first."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD)
    topics = {topic: [w.lower() for w in own] for topic, own in sorted(lexicon.items())}

    def among(found: Column, own: Sequence[str]) -> Column:
        return F.filter(found, lambda w: w.isin(list(own)))

    known = among(words, sorted(set().union(*topics.values())))

    def most(found: Column) -> Column:
        return F.array_max(
            F.array(
                *[
                    F.struct(
                        F.size(among(found, own)).alias("n"),
                        F.lit(-i).alias("order"),
                        F.lit(topic).alias("topic"),
                    )
                    for i, (topic, own) in enumerate(topics.items())
                ]
            )
        )

    # As an array of one, so that the words are found once for all topics.
    best = F.get(F.transform(F.array(known), most), F.lit(0))
    return F.get(
        F.transform(
            F.array(best), lambda m: F.when(m["n"] > 0, m["topic"]).otherwise(F.lit("other"))
        ),
        F.lit(0),
    )


def run_count(text: Column) -> Column:
    """Runs of other than white space in the text."""
    return F.regexp_count(text, F.lit(RUN)).cast("long")


def _targets(totals: Mapping, power: float) -> dict:
    """Shares in proportion to the totals to ``power``; nothing for categories without tokens."""
    raised = {k: float(v) ** power if v else 0.0 for k, v in totals.items()}
    whole = sum(raised.values())
    return {k: v / whole if whole else 0.0 for k, v in raised.items()}


def scale_of(weights: DataFrame, keep_share: float) -> float:
    """The multiple of ``weight`` whose probabilities, at most 1, keep ``keep_share`` of the
    tokens ``n`` in expectation.

    The kept tokens are concave and piecewise linear in the multiple, so Newton's steps from 0
    rise to it and end at its piece. A step is one sum over the cells, none of which is moved.
    """
    total = weights.agg(F.sum("n")).head()[0] or 0
    weight = F.col("weight")
    scale, before = 0.0, -1
    while True:
        capped = weight * F.lit(scale) >= 1.0
        found = (
            weights.where("n > 0 AND weight > 0")
            .agg(
                F.count(F.when(capped, True)).alias("cells"),
                F.sum(F.when(capped, F.col("n"))).alias("whole"),
                F.sum(F.when(~capped, F.col("n") * weight)).alias("free"),
                F.max(F.when(~capped, 1.0 / weight)).alias("last"),
            )
            .head()
        )
        if not found["free"] or found["cells"] == before:
            return scale
        before = found["cells"]
        wanted = (keep_share * total - (found["whole"] or 0)) / found["free"]
        # Where even the lightest cell is kept whole there is nothing more to keep.
        scale = max(scale, min(wanted, found["last"]))


def _error(reached: Mapping, shares: Mapping) -> float:
    """The largest difference of a reached total from its share, as a part of that."""
    return max((abs(reached[k] - v) / v for k, v in shares.items() if v), default=0.0)


def _raked_by_table(
    cells: DataFrame, pairs: list, powers: tuple[float, float, float], rounds: int, steps: Steps
) -> DataFrame:
    """source, lang, topic, n and weight, with the table of ``pairs`` in the driver."""
    source_power, lang_power, topic_power = powers
    pairs = sorted(pairs, key=lambda r: [(x is None, x or "") for x in (r["lang"], r["topic"])])
    place = {(r["lang"], r["topic"]): i for i, r in enumerate(pairs)}
    langs: dict = {}
    topics: dict = {}
    for r in pairs:
        langs[r["lang"]] = langs.get(r["lang"], 0) + r["n"]
        topics[r["topic"]] = topics.get(r["topic"], 0) + r["n"]
    lang_share, topic_share = _targets(langs, lang_power), _targets(topics, topic_power)
    by_lang, by_topic = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    # A row per source: its cells as (place in the table, tokens), and its target share. The
    # table goes by Arrow, since a list would start Python workers beside those of other steps.
    columns = zip(*([(*k, i) for k, i in place.items()] or [(None, None, 0)]), strict=True)
    kinds = {"p_lang": pa.string(), "p_topic": pa.string(), "place": pa.int32()}
    arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)]
    places = F.broadcast(
        cells.sparkSession.createDataFrame(pa.Table.from_arrays(arrays, names=list(kinds)))
    )
    tokens = F.col("n").cast("double").alias("n")
    rows = (
        cells.join(places, F.expr("lang <=> p_lang AND topic <=> p_topic"))
        .groupBy("source")
        .agg(
            F.sort_array(F.collect_list(F.struct("place", tokens))).alias("cells"),
            F.sum("n").cast("double").alias("total"),
        )
    )
    raised = F.when(F.col("total") > 0, F.pow("total", F.lit(source_power))).otherwise(0.0)
    rows = steps.store(rows.withColumn("raised", raised), "sources")
    whole = rows.agg(F.sum("raised")).head()[0] or 1.0

    def factored() -> DataFrame:
        """Rows with the factor of each source under the present factors of the others."""
        table = F.array(
            *[F.lit(by_lang[r["lang"]] * by_topic[r["topic"]]) for r in pairs] or [F.lit(0.0)]
        )
        reached = F.aggregate(
            "cells", F.lit(0.0), lambda total, x: total + x["n"] * F.get(table, x["place"])
        )
        return rows.withColumn("reached", reached).withColumn(
            "factor",
            F.when(F.col("reached") > 0, F.col("raised") / whole / F.col("reached")).otherwise(0.0),
        )

    def margins(sums: Mapping[int, float]) -> tuple[dict, dict]:
        found = dict.fromkeys(langs, 0.0), dict.fromkeys(topics, 0.0)
        for (lang, topic), i in place.items():
            reached = sums.get(i, 0.0) * by_lang[lang] * by_topic[topic]
            found[0][lang] += reached
            found[1][topic] += reached
        return found

    error = float("inf")
    for _ in range(rounds):
        sums = {
            r["place"]: r["mass"]
            for r in factored()
            .select("factor", F.explode("cells").alias("cell"))
            .groupBy(F.col("cell.place").alias("place"))
            .agg(F.sum(F.col("factor") * F.col("cell.n")).alias("mass"))
            .collect()
        }
        reached_langs, reached_topics = margins(sums)
        error = max(_error(reached_langs, lang_share), _error(reached_topics, topic_share))
        if error <= TOLERANCE:
            break
        for lang, share in lang_share.items():
            by_lang[lang] *= share / reached_langs[lang] if reached_langs[lang] else 0.0
        _, reached_topics = margins(sums)
        for topic, share in topic_share.items():
            by_topic[topic] *= share / reached_topics[topic] if reached_topics[topic] else 0.0
    _tell(error, rounds)
    weight = F.col("factor") * F.get(
        F.array(
            *[F.lit(by_lang[r["lang"]] * by_topic[r["topic"]]) for r in pairs] or [F.lit(0.0)]
        ),
        F.col("place"),
    )
    return (
        factored()
        .select("source", "factor", F.explode("cells").alias("cell"))
        .join(places, F.expr("cell.place = place"))
        .select(
            "source",
            F.col("p_lang").alias("lang"),
            F.col("p_topic").alias("topic"),
            weight.alias("weight"),
            "cell.n",
        )
    )


def _tell(error: float, rounds: int) -> None:
    if error > TOLERANCE and rounds >= ROUNDS:
        log.warning("after %d rounds a margin is off by %.1e of its target", rounds, error)


_MARGINS = ("source", "lang", "topic")


def _raked_by_joins(
    cells: DataFrame, powers: tuple[float, float, float], rounds: int, steps: Steps
) -> DataFrame:
    """The same with all factors in Spark, for any number of categories."""
    now = cells.withColumn("mass", F.col("n").cast("double"))

    def with_totals(df: DataFrame, name: str, value: str, total: str) -> DataFrame:
        sums = df.groupBy(F.col(name).alias("_name")).agg(F.sum(value).alias(total))
        return df.join(sums, F.col(name).eqNullSafe(F.col("_name"))).drop("_name")

    for name, power in zip(_MARGINS, powers, strict=True):
        totals = cells.groupBy(name).agg(F.sum("n").cast("double").alias("total"))
        raised = F.when(F.col("total") > 0, F.pow("total", F.lit(power))).otherwise(0.0)
        shares = totals.withColumn("raised", raised)
        whole = shares.agg(F.sum("raised")).head()[0] or 1.0
        share = shares.select(
            F.col(name).alias("_name"), (F.col("raised") / whole).alias(f"{name}_share")
        )
        now = now.join(share, F.col(name).eqNullSafe(F.col("_name"))).drop("_name")
    now = steps.store(now, "shares")

    def fitted(df: DataFrame, name: str) -> DataFrame:
        """``df`` with the margin reached."""
        df = with_totals(df, name, "mass", "_reached")
        share = F.col(f"{name}_share")
        mass = F.when(F.col("_reached") > 0, F.col("mass") * share / F.col("_reached"))
        return df.withColumn("mass", F.coalesce(mass, F.lit(0.0))).drop("_reached")

    now = steps.store(fitted(now, "source"), "round")
    error = float("inf")
    for _ in range(rounds):
        # The errors that languages and topics have while the sources are right.
        seen = with_totals(with_totals(now, "lang", "mass", "_l"), "topic", "mass", "_t")
        error = (
            seen.agg(
                F.max(
                    F.greatest(
                        *(
                            F.when(
                                F.col(f"{n}_share") > 0,
                                F.abs(F.col(t) - F.col(f"{n}_share")) / F.col(f"{n}_share"),
                            ).otherwise(0.0)
                            for n, t in (("lang", "_l"), ("topic", "_t"))
                        )
                    )
                )
            ).head()[0]
            or 0.0
        )
        if error <= TOLERANCE:
            break
        now = steps.store(reduce(fitted, ("lang", "topic", "source"), now), "round")
    _tell(error, rounds)
    weight = F.when(F.col("n") > 0, F.col("mass") / F.col("n")).otherwise(0.0)
    return now.select(
        "source", "lang", "topic", weight.alias("weight"), F.col("n").cast("double").alias("n")
    )


def raked_weights(
    cells: DataFrame,
    source_power: float,
    lang_power: float,
    topic_power: float,
    keep_share: float,
    rounds: int = ROUNDS,
    max_table: int = MAX_TABLE,
) -> DataFrame:
    """source, lang, topic and probability, from the tokens ``n`` of each cell."""
    steps = Steps(cells.sparkSession)
    cells = steps.store(cells, "cells")
    powers = (source_power, lang_power, topic_power)
    pairs = cells.groupBy("lang", "topic").agg(F.sum("n").alias("n")).limit(max_table + 1).collect()
    if len(pairs) > max_table:
        raked = _raked_by_joins(cells, powers, rounds, steps)
    else:
        raked = _raked_by_table(cells, pairs, powers, rounds, steps)
    named = steps.store(raked, "weights")
    scaled = F.least(F.lit(1.0), F.col("weight") * F.lit(scale_of(named, keep_share)))
    probability = F.when(F.col("n") > 0, scaled).otherwise(0.0)
    return named.select("source", "lang", "topic", probability.alias("probability"))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the key's text and the seed."""
    shown = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digits = F.substring(F.md5(shown.cast("binary")), 1, DRAW_BITS // 4)
    return F.conv(digits, 16, 10).cast("double") / float(1 << DRAW_BITS)


def mixed(
    docs: DataFrame,
    lexicon: Mapping[str, Sequence[str]],
    source_power: float,
    lang_power: float,
    topic_power: float,
    keep_share: float,
    seed: int = 0,
    key: str = "doc_id",
    text: str = "text",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` with topic, n_tokens, probability and kept; ``columns`` names those of its own
    that are wanted, since they are stored with what is counted."""
    added = ("topic", "n_tokens", "probability", "kept")
    wanted = [c for c in (docs.columns if columns is None else columns) if c not in added]
    needed = [docs[c] for c in ("source", "lang", key)]
    marked = Steps(docs.sparkSession).store(
        docs.select(
            F.struct(*[docs[c] for c in wanted]).alias("mine"),
            F.struct(*[c.alias(n) for c, n in zip(needed, ("source", "lang", "key"), strict=True)])
            .alias("by"),
            topic_of_words(docs[text], lexicon).alias("topic"),
            F.coalesce(run_count(docs[text]), F.lit(0)).alias("n_tokens"),
        ),
        "marked",
    )
    cells = marked.groupBy("by.source", "by.lang", "topic").agg(F.sum("n_tokens").alias("n"))
    weights = raked_weights(cells, source_power, lang_power, topic_power, keep_share).select(
        F.struct("source", "lang", "topic").alias("cell"), "probability"
    )
    # No hint: a row per cell, which Spark broadcasts if it is small and else splits hot keys.
    joined = marked.join(
        weights,
        F.expr("by.source <=> cell.source AND by.lang <=> cell.lang AND topic <=> cell.topic"),
        "left",
    )
    return joined.select(
        "mine.*",
        "topic",
        "n_tokens",
        "probability",
        (draw(F.col("by.key"), seed) < F.col("probability")).alias("kept"),
    )
