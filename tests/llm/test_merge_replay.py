from __future__ import annotations

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from stratacart.llm import merge_replay
from stratacart.llm.merge_replay import (
    MergeReplay,
    encode_checked,
    encode_decode,
    token_digests,
)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def replay():
    with open(RANKS, "rb") as lines:
        return MergeReplay(lines, PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def odd_texts(n: int) -> list[str]:
    rng = random.Random(7)
    kinds = [
        lambda: chr(rng.randrange(1, 0x3000)),
        lambda: chr(rng.randrange(32, 127)),
        lambda: rng.choice("  \n\t\r\x1c\x1f\x85　 's'tabcABC012!!.."),
        lambda: rng.choice([" the", " and", "ing", "  ", " \n", "'ll"]),
    ]
    return ["".join(rng.choice(kinds)() for _ in range(rng.randrange(50))) for _ in range(n)]


def test_equals_the_library_on_odd_texts(replay, library):
    texts = [
        *odd_texts(2000), "", " ", "  a", "a  ", "^", "^a b", "it's 'S x", "a" * 3000, " " * 999,
        "\n" * 50, "!?" * 500, "aaaaab" * 300, "<|endoftext|> x",
    ]
    for text, packed in zip(texts, replay.encode(texts), strict=True):
        assert ids(packed) == library.encode_ordinary(text), repr(text)
        assert replay.decode(ids(packed)) == text.encode()


def test_what_is_remembered_changes_nothing(replay, monkeypatch):
    texts = odd_texts(300)
    first = list(replay.encode(texts))
    monkeypatch.setattr(merge_replay, "REMEMBERED", 10)
    assert [x for text in texts for x in replay.encode([text])] == first


def test_a_lower_rank_that_comes_up_goes_first():
    tokens = [*(bytes([b]) for b in range(256)), b"bc", b"abc", b"ab", b"cd", b"bcd"]
    lines = [base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)]
    ranks = {t: i for i, t in enumerate(tokens)}
    own = MergeReplay(lines, r".+")
    other = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    for word, packed in zip(words, own.encode(words), strict=True):
        assert ids(packed) == other.encode_ordinary(word)


def test_rows(spark, library):
    rows = [
        (1, "the cat  sat", 0), (2, None, 0), (3, "", 0), (None, "x", 0), (4, "the cat  sat", 0),
        (4, "the cat  sat", 0), (5, "ab " * 20_000, 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = sorted(encode_decode(docs, RANKS, PATTERN).collect(), key=str)
    expected = sorted(
        ((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows), key=str
    )
    assert sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in found if r.doc_id) == sorted(
        x for x in expected if x[0]
    )
    assert len(found) == len(rows)
    digests = {r.doc_id: r.n_tokens for r in token_digests(docs, RANKS, PATTERN).collect()}
    assert digests[2] == digests[3] == 0 and digests[5] == len(library.encode_ordinary(rows[-1][1]))
    assert token_digests(docs.limit(0), RANKS, PATTERN).collect() == []


def test_pieces_of_the_replay_change_nothing(library, monkeypatch):
    texts = odd_texts(300)
    for size in (1, 64, 1 << 20):
        monkeypatch.setattr(merge_replay, "REPLAY_BYTES", size)
        with open(RANKS, "rb") as lines:
            own = MergeReplay(lines, PATTERN)
        for text, packed in zip(texts, own.encode(texts), strict=True):
            assert ids(packed) == library.encode_ordinary(text)


def test_checked_ids(spark, library):
    texts = ["a b c", None, "", "é" * 1000, "a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(map(tuple, encode_checked(docs, RANKS, PATTERN).collect()))
    expected = [library.encode_ordinary(t or "") for t in texts]
    assert found == [(i, len(x), x, True) for i, x in enumerate(expected)]
    assert encode_checked(docs.limit(0), RANKS, PATTERN).count() == 0


class Counted:
    """A pattern that remembers the lengths of what it splits."""

    def __init__(self, pattern) -> None:
        self.pattern, self.sizes = pattern, []

    def findall(self, text: str) -> list[str]:
        self.sizes.append(len(text))
        return self.pattern.findall(text)


def test_new_pieces_are_split_together_and_known_ones_not_again(library):
    with open(RANKS, "rb") as lines:
        own = MergeReplay(lines, PATTERN)
    own.pattern = counted = Counted(own.pattern)
    words = [f"w{i:x}, x\n{i}." for i in range(3000)]
    texts = [" ".join(words[i : i + 100]) + "  \n" * (i % 3) for i in range(0, 3000, 100)] + ["a  b "]
    for _ in range(2):
        for text, packed in zip(texts, own.encode(texts), strict=True):
            assert ids(packed) == library.encode_ordinary(text)
    assert len(counted.sizes) < 3 * len(texts)
    assert sum(counted.sizes) <= sum(map(len, texts))


def test_short_words_get_the_ids_of_a_replay_rank_by_rank(replay):
    tokens = [*(bytes([b]) for b in range(256)), b"bc", b"abc", b"ab", b"cd", b"bcd", b"aa", b"da"]
    odd = MergeReplay([base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)], r".+")
    rng = random.Random(2)
    for own, letters in ((replay, "aeinorst é"), (replay, "ab"), (odd, "abcd")):
        words = {"".join(rng.choices(letters, k=rng.randrange(1, 40))).encode() for _ in range(500)}
        assert own._replay_short(sorted(words)) == own._replay_long(sorted(words))


def test_a_pattern_that_leaves_characters_out():
    lines = [base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)]
    own = MergeReplay(lines, r" ?[a-z]+")
    assert [ids(x) for x in own.encode(["ab 1c d!", " e!! f"])] == [[*b"abc d"], [*b" e f"]]
