"""The registered queries on the smallest test tables: against their SQL, or plainly computed."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter

import compare
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import test_fingerprints
import test_main_text
import test_ngram_join
import test_subspace_join
import tiktoken
from stratacart.llm.common import BATCH_BYTES, set_while
from stratacart.llm.fingerprints import edited_text
from stratacart.llm.queries import BYTE_RANKS, QUERIES, SQL, WORD_TOKENIZER
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF)


@pytest.fixture(scope="module")
def docs(duck):
    rows = duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    return [(i, t or "") for i, t in rows]


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    assert compare.difference(spark, duck, SF, QUERIES[name], SQL[name]) == ""


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_op1(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op1_invertible_sketch"](spark, SF).collect()}
    down = docs[::-1]
    for (i, text), (_, following) in zip(down, [*down[1:], down[0]], strict=True):
        edited = edited_text(text, following)
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (
            len(text),
            hashlib.sha256(edited.encode()).hexdigest(),
        )
        assert abs(r.near_edited - test_fingerprints.jaccard(text, edited)) < 1e-9
        assert abs(r.near_next - test_fingerprints.jaccard(text, following)) < 1e-9
    by_text: dict[str, set] = {}
    for i, text in docs:
        by_text.setdefault(text, set()).add(rows[i].fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())
    assert len(rows) == len(docs)


def test_op2(spark, duck):
    vectors = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    found = QUERIES["op2_subspace_join"](spark, SF).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in found)
    assert got == sorted(test_subspace_join.brute(vectors, 0.9))
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_op3(spark, docs):
    library = Tokenizer.from_file(WORD_TOKENIZER)
    expected, start = [], 0
    for i, text in docs:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    found = QUERIES["op3_repair_grammar"](spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == expected


def test_op7(spark, docs):
    with open(BYTE_RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    expected = []
    for i, text in docs:
        ids = library.encode_ordinary(text)
        shown = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        expected.append((i, len(ids), shown, hashlib.sha256(text.encode()).hexdigest()))
    found = QUERIES["op7_merge_replay"](spark, SF).collect()
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found)
    assert got == expected


def test_op8(spark, duck):
    found = {r.doc_id: r for r in QUERIES["op8_factorisation_machine"](spark, SF).collect()}
    labels = duck.execute("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL").fetchall()
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    right = [found[i].predicted == q for i, q in labels if found[i].held_out]
    assert len(right) > 20 and np.mean(right) > 0.9


def test_op9(spark, docs):
    found = QUERIES["op9_ngram_join"](spark, SF).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found)
    assert got == sorted(test_ngram_join.brute(docs, 4, 85))


def test_op11(spark, duck):
    pages = duck.execute("SELECT page_id, url, html FROM pages").fetchall()
    found = QUERIES["op11_tag_ratio_text"](spark, SF).collect()
    texts = [(i, u, test_main_text.expected(h)) for i, u, h in pages]
    assert sorted(map(tuple, found)) == sorted((i, u, t, len(t)) for i, u, t in texts)


def test_pipeline(spark, duck, docs, tmp_path):
    """Each stage on what the one before has kept."""
    found = {}
    now = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{len(found)}")
        now = spark.read.parquet(f"{tmp_path}/{len(found)}")
        found[name] = [r.asDict() for r in now.collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        assert set(found[name][0]) == set(corpus_pipeline.COLUMNS)
        assert all(r["n_chars"] == len(r["text"] or "") for r in found[name])
    texts = dict(docs)
    quality, lines, near, mixture, tokens = (found[n] for n in names)

    good = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    kept = {r["doc_id"] for r in quality}
    assert all(texts[r["doc_id"]] == (r["text"] or "") for r in quality)
    clean = [i for i, q in good.items() if q == 1]
    assert sum(i in kept for i in clean) > 0.97 * len(clean)
    assert sum(i in kept for i, q in good.items() if q == 0) < 0.1 * sum(
        q == 0 for q in good.values()
    )

    assert {r["doc_id"] for r in lines} == kept
    seen: dict[str, set] = {}
    for r in lines:
        for line in (r["text"] or "").split("\n"):
            if len(key := line.strip("\x20\x09\x0a\x0b\x0c\x0d").lower()) >= 10:
                seen.setdefault(key, set()).add(r["doc_id"])
    assert max(map(len, seen.values())) == 1

    groups = test_ngram_join.brute([(r["doc_id"], r["text"]) for r in lines], 5, 80)
    firsts = {c for i, _, c in groups}
    assert Counter(r["doc_id"] for r in near) == Counter(firsts)

    assert 0 < len(mixture) <= len(near) and {r["doc_id"] for r in mixture} <= firsts
    with open(BYTE_RANKS, "rb") as ranks_file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file)}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    by_id = {r["doc_id"]: r for r in tokens}
    assert set(by_id) == {r["doc_id"] for r in mixture}
    for r in mixture:
        own = by_id[r["doc_id"]]
        assert own["ids"] == library.encode_ordinary(r["text"] or "") and own["restored"]
        assert own["n_tokens"] == len(own["ids"])


def test_run_gives_the_last_stage(spark):
    result = corpus_pipeline.run(spark, SF)
    assert result.columns == ["doc_id", "n_tokens", "ids", "restored"]
    assert result.count() > 0


def test_stages_bound_the_batches_of_whoever_computes_them(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for own, after in ((None, BATCH_BYTES), ("9m", "9m")):
        with set_while(spark, {} if own is None else {name: own}):
            if own is None:
                spark.conf.unset(name)
            corpus_pipeline.tokens(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
            assert spark.conf.get(name) == after


def test_pipeline_takes_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, further columns; and no row at all."""
    rows = [
        (1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "a b c d e f", "en", "s", 11, "x"),
        (3, "a b c d e f", "en", "s", 11, "x"), (None, "no id here", "de", None, 10, "x"),
        (4, "word " * 30_000, "fr", "t", 150_000, "x"), (5, "A b c d e f", None, "s", 11, "x"),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept_text string"
    table = spark.createDataFrame(rows, kind)
    folder = str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    for n, part in enumerate((table, table.limit(0))):
        now = part
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, folder).write.parquet(f"{tmp_path}/{n}-{i}")
            now = spark.read.parquet(f"{tmp_path}/{n}-{i}")
        assert now.columns == ["doc_id", "n_tokens", "ids", "restored"]
    assert spark.read.parquet(f"{tmp_path}/0-0").count() == len(rows)
    third = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/0-2").collect()]
    # The second copy of 3 goes; 5 has lost its line to 3 and stays as an empty document.
    assert sorted(map(str, third)) == ["1", "2", "3", "4", "5", "None"]
    assert now.count() == 0
