"""URL rules in a sorted array of digests.

Each rule (host and path prefix, with a verdict) is a key: the 64-bit xxhash of its text. The
keys lie sorted in one file with the rules' full texts, which every executor maps into
memory. A URL's candidates are the host and its parent domains, each with those prefixes of
the path that are as long as some rule's path. All candidates of a batch are probed by one
vectorised binary search, and a hit counts only if the stored text equals the candidate, so
that a collision decides nothing.

Rules are an argument of the caller and the file's size is checked against ``MAX_BYTES``;
``judge_by_join`` settles any larger set by a join on the digest.

Results per row:

* host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
  then up to ``?``, ``#`` or the end; both empty without ``://`` and for a null url;
* the longest fitting rule decides, between equally long ones the longer host; without one
  the url is not in the array and its verdict is ``allow``;
* equal urls get equal rows; an empty table gives none; other columns are dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacart.llm.common import lower_ascii, on_workers
from stratacart.sources.files import write_bytes
from stratacart.sources.scratch import scratch_path

MAX_BYTES = 256 << 20
SEED = 42
_HEAD = struct.Struct("<QQQ")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def pack(rules: Iterable[Rule]) -> bytes:
    """The array as a file: a head, sorted keys, text offsets, verdicts, path lengths, texts."""
    unique = {(r.host, r.path): r for r in rules}
    digest = xxhash.xxh64_intdigest
    keyed = sorted((digest(r.text.encode(), SEED), r.text, r) for r in unique.values())
    texts = [text.encode() for _, text, _ in keyed]
    lengths = sorted({len(r.path) for _, _, r in keyed})
    parts = [
        _HEAD.pack(len(keyed), len(lengths), sum(map(len, texts))),
        np.array([key for key, _, _ in keyed], dtype="<u8").tobytes(),
        np.cumsum([0, *map(len, texts)]).astype("<u8").tobytes(),
        np.array(lengths, dtype="<u8").tobytes(),
        np.array([r.verdict == "block" for _, _, r in keyed], dtype="u1").tobytes(),
        b"".join(texts),
    ]
    return b"".join(parts)


class DigestArray:
    """A packed file, mapped into memory."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, dtype="u1", mode="r")
        n, n_lengths, n_text = _HEAD.unpack(raw[: _HEAD.size].tobytes())
        at = _HEAD.size

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(kind).itemsize
            out = raw[at : at + size].view(kind)
            at += size
            return out

        self.keys = take(n, "<u8")
        self.offsets = take(n + 1, "<u8")
        self.path_lengths = take(n_lengths, "<u8").tolist()
        self.blocks = take(n, "u1")
        self.texts = take(n_text, "u1")

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """The place of each candidate, -1 for those that are not stored."""
        digests = np.fromiter(
            (xxhash.xxh64_intdigest(c, SEED) for c in candidates), np.uint64, len(candidates)
        )
        out = np.full(len(candidates), -1, dtype=np.int64)
        low = np.searchsorted(self.keys, digests, side="left")
        high = np.searchsorted(self.keys, digests, side="right")
        for i in np.flatnonzero(high > low).tolist():
            for place in range(low[i], high[i]):  # more than one only where digests collide
                text = self.texts[int(self.offsets[place]) : int(self.offsets[place + 1])]
                if text.tobytes() == candidates[i]:
                    out[i] = place
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str]]:
        """(rule, verdict) of each url."""
        owners: list[int] = []
        candidates: list[bytes] = []
        for owner, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for text in candidate_rules(host, path, self.path_lengths):
                owners.append(owner)
                candidates.append(text.encode())
        found: list[tuple[str | None, str]] = [(None, "allow")] * len(hosts)
        for i in np.flatnonzero((places := self.find(candidates)) >= 0)[::-1].tolist():
            verdict = "block" if self.blocks[places[i]] else "allow"
            found[owners[i]] = (candidates[i].decode(), verdict)
        return found


def candidate_rules(host: str, path: str, path_lengths: list[int]) -> list[str]:
    """Texts of rules that would fit, the longest first."""
    labels = host.split(".") if host else []
    domains = [".".join(labels[i:]) for i in range(len(labels))]
    fitting = [d + path[:n] for d in domains for n in path_lengths if n <= len(path)]
    return sorted(fitting, key=len, reverse=True)


@lru_cache(maxsize=2)
def _array(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def ship(spark: SparkSession, packed: bytes) -> str:
    """Put the file in the shared folder and on every executor; returns its name."""
    if len(packed) > MAX_BYTES:
        raise ValueError(f"{len(packed)} bytes of rules: use judge_by_join")
    path = scratch_path(spark, "llm-url-rules")
    write_bytes(spark, path, packed)
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def judge(
    pages: DataFrame, rules: Iterable[Rule], key: str = "page_id", url: str = "url"
) -> DataFrame:
    """Key, host, path, rule and verdict of each row."""
    on_workers(pages.sparkSession)
    name = ship(pages.sparkSession, pack(rules))
    host, path = url_parts(F.col(url))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _array(name)
        for batch in batches:
            found = array.judge(batch["host"].to_pylist(), batch["path"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([rule for rule, _ in found], pa.string()),
                    pa.array([verdict for _, verdict in found], pa.string()),
                ],
                names=["key", "host", "path", "rule", "verdict"],
            )

    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    kind = rows.schema["key"].dataType.simpleString()
    judged = rows.mapInArrow(
        run, f"key {kind}, host string, path string, rule string, verdict string"
    )
    return judged.withColumnRenamed("key", key)


def judge_by_join(
    pages: DataFrame,
    rules: DataFrame,
    path_lengths: list[int],
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """As ``judge``, for a table of rules (verdict, host, path) of any size.

    Candidates are joined with the rules on digest and text; the longest hit of a url is
    found by a grouping, so distinct urls are judged once each.
    """
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    distinct = rows.select("host", "path").distinct().where("host <> ''")
    labels = F.split("host", r"\.")
    lengths = F.array(*[F.lit(n) for n in path_lengths])
    fitting = distinct.withColumn(
        "domain",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)),
                lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
            )
        ),
    ).withColumn("n", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))))
    candidates = fitting.withColumn(
        "text", F.concat("domain", F.expr("substring(path, 1, n)"))
    ).withColumn("digest", F.xxhash64("text"))
    stored = rules.select(
        F.concat("host", "path").alias("text"), F.col("verdict").alias("found")
    ).withColumn("digest", F.xxhash64("text"))
    best = (
        candidates.join(stored, ["digest", "text"])
        .groupBy("host", "path")
        .agg(
            F.max_by(
                F.struct("text", "found"), F.struct(F.length("text"), F.length("domain"))
            ).alias("hit")
        )
    )
    return rows.join(best, ["host", "path"], "left").select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("hit.text").alias("rule"),
        F.coalesce("hit.found", F.lit("allow")).alias("verdict"),
    )
