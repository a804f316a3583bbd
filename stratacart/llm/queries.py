"""The registered queries on text, each one operator with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from stratacart.llm import (
    factor_machine,
    fingerprints,
    grammar_output,
    lexical,
    licences,
    line_dedup,
    main_text,
    merge_replay,
    merkle,
    mixing,
    ngram_join,
    subspace_join,
    url_rules,
)
from stratacart.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


@query()
def op1_invertible_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


@query()
def op2_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace_join.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query()
def op3_repair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grammar_output.encode_to_files(docs, WORD_TOKENIZER, end_id=2)


#: Topics by words that stand for them in the four languages of the documents.
LEXICON = {
    "people": ["he", "you", "sie", "il", "nous", "los"],
    "place": ["in", "at", "from", "im", "auf", "sur", "en"],
    "time": ["was", "when", "wird", "est", "era"],
}
MIX = {"source_power": 0.7, "lang_power": 0.9, "topic_power": 0.9}


#: The part of all tokens that is kept.
KEEP_SHARE = 0.66
#: White space as Java's regular expressions know it in Unicode.
_SPACES = (
    r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def _among(words: list[str]) -> str:
    return f"len(list_filter(words, lambda w: w IN ({', '.join(map(repr, words))})))"


def _mixing_sql() -> str:
    counts = {t: _among(words) for t, words in sorted(LEXICON.items())}
    best = f"greatest({', '.join(counts.values())})"
    cases = " ".join(f"WHEN {n} = most THEN '{t}'" for t, n in counts.items())
    return f"""
    WITH RECURSIVE cut AS (
        SELECT *, string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+') AS words,
               len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACES}'), lambda x: x <> ''))
                   AS n_tokens
        FROM documents
    ), counted AS (
        SELECT *, {best} AS most FROM cut
    ), marked AS (
        SELECT doc_id, source, lang, n_tokens,
               CASE WHEN most = 0 THEN 'other' {cases} END AS topic
        FROM counted
    ), cells AS (
        SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM marked GROUP BY ALL
    ), totals AS (
        SELECT *, sum(n) OVER (PARTITION BY source) AS s, sum(n) OVER (PARTITION BY lang) AS l,
               sum(n) OVER (PARTITION BY topic) AS t
        FROM cells
    ), shares AS (
        SELECT source, lang, topic, n,
               pow(s, 0.7) / (SELECT sum(pow(x, 0.7)) FROM (SELECT sum(n) AS x FROM cells GROUP BY source)) AS s,
               pow(l, 0.9) / (SELECT sum(pow(x, 0.9)) FROM (SELECT sum(n) AS x FROM cells GROUP BY lang)) AS l,
               pow(t, 0.9) / (SELECT sum(pow(x, 0.9)) FROM (SELECT sum(n) AS x FROM cells GROUP BY topic)) AS t
        FROM totals
    ), raked AS (
        SELECT 0 AS step, *, n AS w FROM shares
        UNION ALL
        SELECT step + 1, source, lang, topic, n, s, l, t,
               w * t / sum(w) OVER (PARTITION BY topic) AS w
        FROM (
            SELECT * REPLACE (w * l / sum(w) OVER (PARTITION BY lang) AS w) FROM (
                SELECT * REPLACE (w * s / sum(w) OVER (PARTITION BY source) AS w)
                FROM raked WHERE step < 60
            )
        )
    ), last AS (
        SELECT source, lang, topic, n, w * s / sum(w) OVER (PARTITION BY source) / n AS w
        FROM raked WHERE step = 60 AND n > 0
    ), heaviest AS (
        SELECT *, row_number() OVER heavy AS pos, sum(n) OVER heavy - n AS whole,
               sum(n * w) OVER () - sum(n * w) OVER heavy + n * w AS free
        FROM last WINDOW heavy AS (ORDER BY w DESC, source, lang, topic ROWS UNBOUNDED PRECEDING)
    ), scale AS (
        SELECT coalesce(
            (SELECT arg_min(({KEEP_SHARE} * (SELECT sum(n) FROM cells) - whole) / free, pos)
             FROM heaviest
             WHERE ({KEEP_SHARE} * (SELECT sum(n) FROM cells) - whole) / free * w <= 1),
            (SELECT max(1 / w) FROM last)) AS c
    )
    SELECT doc_id, m.source, m.lang, m.topic, n_tokens,
           round(least(1.0, w * c), 9) AS probability,
           ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT
               / 4503599627370496.0 < least(1.0, w * c) AS kept
    FROM marked m CROSS JOIN scale JOIN last ON m.source IS NOT DISTINCT FROM last.source
        AND m.lang IS NOT DISTINCT FROM last.lang AND m.topic IS NOT DISTINCT FROM last.topic
    """


@query(_mixing_sql())
def op4_fitted_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ("doc_id", "source", "lang")
    mixture = mixing.mixed(docs, LEXICON, **MIX, keep_share=KEEP_SHARE, columns=columns)
    return mixture.withColumn("probability", F.round("probability", 9))


URL_RULES = [
    url_rules.Rule("allow", "com", "/"),
    url_rules.Rule("block", "example.com", "/en/"),
    url_rules.Rule("allow", "www.example.com", "/en/"),
    url_rules.Rule("block", "net", "/es/"),
    url_rules.Rule("block", "net", "/fr/"),
]


@query(
    """
    WITH parts AS (
        SELECT page_id, regexp_replace(coalesce(url, ''), '^.*?://', '', 's') AS rest,
               contains(coalesce(url, ''), '://') AS known
        FROM pages
    ), split AS (
        SELECT page_id,
               CASE WHEN known THEN translate(regexp_extract(rest, '^[^/?#]*'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
               CASE WHEN known THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
        FROM parts
    ), rules(verdict, host, path) AS (
        VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
               ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'),
               ('block', 'net', '/fr/')
    ), fits AS (
        SELECT s.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
               max_by(r.verdict, length(r.host || r.path)) AS verdict
        FROM split s JOIN rules r
          ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
        GROUP BY s.page_id
    )
    SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
    FROM split s LEFT JOIN fits f USING (page_id)
    """
)
def op5_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def _licence_sql() -> str:
    templates = ", ".join(
        f"('{name}', {licences.bigrams_of(body)!r})" for name, body in licences.NOTICES.items()
    )
    return rf"""
    WITH templates(name, bigrams) AS (VALUES {templates}),
    cut AS (
        SELECT doc_id, list_concat(
            string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)),
            list_filter(string_split(coalesce(text, ''), chr(10)),
                        lambda x: regexp_matches(x, '[.!?][ \t]'))) AS passages
        FROM documents
    ), numbered AS (
        SELECT doc_id, unnest(passages) AS passage, generate_subscripts(passages, 1) AS pos FROM cut
    ), split AS (
        SELECT doc_id, pos, list_filter(string_split_regex(translate(passage,
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS words
        FROM numbered
    ), paired AS (
        SELECT doc_id, pos, list_distinct(list_transform(range(1, len(words)),
            lambda i: words[i] || ' ' || words[i + 1])) AS bigrams
        FROM split WHERE len(words) > 1
    ), scored AS (
        SELECT doc_id, pos, name,
               2.0::DOUBLE * len(list_intersect(p.bigrams, t.bigrams))
                   / (len(p.bigrams) + len(t.bigrams)) AS dice
        FROM paired p, templates t
    ), hits AS (
        SELECT doc_id, pos, max(dice) AS dice, arg_min(name, (-dice, name)) AS name
        FROM scored WHERE dice * 100 >= 80 GROUP BY doc_id, pos
    )
    SELECT d.doc_id, arg_min(h.name, (-h.dice, h.name)) AS licence, max(h.dice) AS dice,
           count(h.pos) AS n_hits
    FROM documents d LEFT JOIN hits h USING (doc_id) GROUP BY d.doc_id
    """


@query(_licence_sql())
def op6_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.NOTICES, percent=80, bodies=licences.BODIES)


@query()
def op7_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merge_replay.token_digests(docs, BYTE_RANKS, public_tokenizers.PATTERN)


@query()
def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = factor_machine.learn(docs, table(spark, sf_dir, "labels"))
    return factor_machine.score(docs, model).select(
        "doc_id",
        factor_machine.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query()
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


@query(
    r"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents
    ), keyed AS (
        SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines
    ), judged AS (
        SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone
        FROM keyed
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
               AS kept_sha256
    FROM judged GROUP BY doc_id
    """
)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeats(table(spark, sf_dir, "documents"), min_chars=10)
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query()
def op11_tag_ratio_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


_TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query(
    f"""
    WITH wanted AS (
        SELECT item, item_id, term, count(*) AS repeats
        FROM (SELECT rowid_ AS item, item_id, unnest({_TERMS_SQL}) AS term
              FROM (SELECT *, row_number() OVER () AS rowid_ FROM benchmark))
        GROUP BY ALL
    ), cut AS (
        SELECT doc_id, {_TERMS_SQL} AS terms FROM documents
    ), whole AS (
        SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_all FROM cut WHERE len(terms) > 0
    ), counted AS (
        SELECT doc_id, len(terms)::BIGINT AS n, term, count(*)::BIGINT AS tf
        FROM (SELECT doc_id, terms, unnest(terms) AS term FROM cut)
        WHERE term IN (SELECT term FROM wanted)
        GROUP BY doc_id, len(terms), term
    ), weighted AS (
        SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
        FROM counted, whole GROUP BY term
    ), scored AS (
        SELECT item, item_id, doc_id,
               sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_all))))::BIGINT
                   AS score
        FROM wanted JOIN counted USING (term) JOIN weighted USING (term), whole
        GROUP BY item, item_id, doc_id
    )
    SELECT item_id, doc_id, score,
           row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank
    FROM scored WHERE score > 0 QUALIFY rank <= 20
    """
)
def op12_blocked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(
        table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=20
    )


#: crc32 of the decimal id: a step of eight bits for each of its characters.
_CRC32_SQL = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda v, bit: xor(v >> 1, (v & 1) * 3988292384))))"""


def _leaf_sql(n_chars: str) -> str:
    values = {"doc_id": "doc_id", "source": "source", "lang": "lang", "n_chars": n_chars, "text": "text"}
    marked = [f"coalesce(strlen(({v})::VARCHAR) || ':' || ({v})::VARCHAR, '-')" for v in values.values()]
    return f"sha256({' || '.join(marked)})"


@query(
    f"""
    WITH RECURSIVE hashed AS (
        SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
               CASE WHEN {_CRC32_SQL} % 7 = 0 THEN {_leaf_sql("n_chars + 1")}
                    ELSE {_leaf_sql("n_chars")} END AS other
        FROM documents
    ), leaves AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
        FROM hashed
    ), nodes AS (
        SELECT lang, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM leaves
        UNION ALL
        SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)),
               (any_value(n) + 1) // 2
        FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2
    ), subroots AS (
        SELECT lang, level AS levels, digest AS subroot,
               row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
        FROM nodes WHERE n = 1
    ), tops AS (
        SELECT 0 AS level, tree AS pos, subroot AS digest, (SELECT count(*) FROM subroots) AS n FROM subroots
        UNION ALL
        SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2
        FROM tops WHERE n > 1 GROUP BY level, pos // 2
    ), below AS (
        SELECT doc_id, lang, leaf, 0 AS level, pos, other AS folded, '' AS siblings, levels, tree, subroot
        FROM leaves JOIN subroots USING (lang)
        UNION ALL
        SELECT doc_id, w.lang, leaf, w.level + 1, w.pos // 2,
               sha256(CASE WHEN w.pos % 2 = 0 THEN folded || coalesce(digest, '')
                           ELSE digest || folded END),
               siblings || coalesce(digest, ''), levels, tree, subroot
        FROM below w LEFT JOIN nodes n
          ON n.lang = w.lang AND n.level = w.level AND n.pos = xor(w.pos, 1)
        WHERE w.level < w.levels
    ), above AS (
        SELECT doc_id, leaf, 0 AS level, tree AS pos, folded, siblings, subroot
        FROM below WHERE level = levels
        UNION ALL
        SELECT doc_id, leaf, w.level + 1, w.pos // 2,
               sha256(CASE WHEN w.pos % 2 = 0 THEN folded || coalesce(digest, '')
                           ELSE digest || folded END),
               siblings || coalesce(digest, ''), subroot
        FROM above w LEFT JOIN tops n ON n.level = w.level AND n.pos = xor(w.pos, 1)
        WHERE w.level < (SELECT max(level) FROM tops)
    )
    SELECT doc_id, leaf, subroot, r.digest AS root, sha256(siblings) AS proof_sha256,
           folded AS folded_root, folded = r.digest AS verified
    FROM above JOIN (SELECT digest, level AS top FROM tops WHERE n = 1) r ON level = top
    """
)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id has a checksum that 7 divides claim one character more than they have."""
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(struck, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2("siblings", 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
