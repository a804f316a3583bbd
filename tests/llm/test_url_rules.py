from __future__ import annotations

import random

import pytest
from stratacart.llm import url_rules
from stratacart.llm.queries import URL_RULES
from stratacart.llm.url_rules import DigestArray, Rule, judge, judge_by_join, pack


def brute(url: str | None, rules: list[Rule]) -> tuple:
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for rule in rules:
        fits = host == rule.host or host.endswith("." + rule.host)
        if fits and path.startswith(rule.path):
            if best is None or len(rule.text) > len(best.text):
                best = rule
    return host, path, best and best.text, best.verdict if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http:///x", "http://COM/", "http://com", "http://a.com?x://y/",
    "https://www.example.com/en/1", "https://m.Example.com/en/", "https://example.com/en",
    "https://notexample.com/en/1", "http://x.net/es/1", "http://net/fr/#a", "ftp://x.net/de/?q",
    "http://x.net/ES/1", "a://b://c.com/", "http://com/en/" + "z" * 70_000, "http://É.com/", "http://a..com/x",
    "x\ny://a.com/\nb", "http://x.com/es/", "http://.com/",
]


def test_equals_a_plain_scan(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS * 2)] + [(None, URLS[8], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    expected = sorted(str((i, *brute(u, URL_RULES))) for i, u, _ in rows)
    assert sorted(str(tuple(r)) for r in judge(pages, URL_RULES).collect()) == expected
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    joined = judge_by_join(pages, rules, [1, 4])
    assert sorted(str(tuple(r)) for r in joined.collect()) == expected
    assert judge(pages.limit(0), URL_RULES).collect() == []
    assert {r.verdict for r in judge(pages, []).collect()} == {"allow"}


def random_rules(n: int) -> list[Rule]:
    rng = random.Random(1)
    labels = ["a", "b", "c"]
    return [
        Rule(
            rng.choice(["allow", "block"]),
            ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))),
            "/" + "".join(rng.choice(["a/", "b"]) for _ in range(rng.randrange(3))),
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("collide", [False, True])
def test_collisions_decide_nothing(tmp_path, monkeypatch, collide):
    if collide:
        monkeypatch.setattr(url_rules.xxhash, "xxh64_intdigest", lambda text, seed: len(text) % 3)
    rules = list({(r.host, r.path): r for r in random_rules(60)}.values())
    file = tmp_path / "rules"
    file.write_bytes(pack(rules))
    array = DigestArray(str(file))
    rng = random.Random(2)
    for _ in range(300):
        host = ".".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5)))
        path = "/" + "".join(rng.choice(["a/", "b", "c"]) for _ in range(rng.randrange(4)))
        best = max(
            (r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)),
            key=lambda r: (len(r.text), len(r.host)), default=None,
        )
        ((rule, verdict),) = array.judge([host], [path])
        assert rule == (best and best.text)
        if best is None:
            assert verdict == "allow"


def test_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "MAX_BYTES", 10)
    with pytest.raises(ValueError, match="judge_by_join"):
        judge(spark.createDataFrame([(1, "x")], "page_id long, url string"), URL_RULES)
