"""Token ids as files: Re-Pair grammars per shard, with random access to documents.

Documents are encoded where they are read, dealt by ranges of their id, and written in
ascending order. A shard holds the ids of consecutive documents. Within it, frequent pairs
of neighbours are replaced by new symbols, round after round, until no pair repeats often
enough. The shard's row keeps the rules, how many ids each rule's symbol expands to, the
compressed sequence, and where each document starts, so that one document is decoded by
expanding only the symbols that cover it.

The file format is Parquet, a row per shard:

* ``part``, ``shard``: the order of shards; ``n_ids``: ids in the shard
* ``doc_ids``: the documents in order (null last, ties by their ids)
* ``doc_starts``: of each document's first id, counted from the shard's start
* ``rules``: pairs of symbols, the i-th defining symbol ``base + i``; ``lengths``: the ids it
  expands to; ``base``: the first symbol that is not an id
* ``sequence``: the compressed symbols; ``step_starts``: for every 256th symbol the position
  at which its expansion starts

Results per row:

* a null or empty text has the end id alone;
* repeated ids or rows each stay a document; their order among themselves is by their ids;
* an empty table gives no shard and no row; other columns are dropped.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratacart.llm.common import on_workers, parts_of, quantiles, shuffle_partitions, slices
from stratacart.sources.scratch import scratch_path

#: A shard is closed once it has this many ids; a longer document is a shard by itself.
SHARD_IDS = 1 << 20
#: A pair is replaced while it occurs so often in its shard: a rule takes three numbers, and
#: each replacement saves one.
MIN_COUNT = 4
#: Bytes of text that are encoded together: the more, the fewer times a word is looked up.
BLOCK_BYTES = 16 << 20
#: Words and signs in the younger of the two dictionaries that a worker remembers, also for its
#: next tasks: some 80 MB each.
REMEMBERED = 600_000
#: Unknown pieces that the library gets as one text.
JOINED = 256
STEP = 256

FORMAT = (
    "part int, shard int, n_ids long, doc_ids array<long>, doc_starts array<long>, base int, "
    "rules binary, lengths binary, sequence binary, step_starts binary"
)


#: Signs that end a match of the library's pattern where a letter or digit of these stands before
#: them; ASCII composes with nothing before it, and the letters are as old as any table of them.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BEFORE_SIGNS = (
    r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{391}-\x{3A1}\x{3B1}-\x{3C9}"
    r"\x{410}-\x{44F}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}]\z"
)
#: The first character beyond the Latin letters that composing leaves as they are.
_PLAIN = "\u0250"


class WordEncoder:
    """The library's ids per piece of text between white space, each piece encoded once.

    The vocabulary drops white space and no rule of its file looks across it, so a text's ids
    are those of its pieces in turn. It lower-cases too, so pieces are remembered in lower
    case, but for texts that may hold the name of a special token. Signs behind a letter or digit
    are a match by themselves, and so are remembered by themselves. Words of small Latin letters,
    which are neither normalised nor parted, go to the library's model at once.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        #: The character that stands for a byte: itself where it can be seen.
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(0x100, 0x200))
        self.shown = [chr(b) if b in seen else chr(next(rest)) for b in range(0x100)]
        #: A piece that parts others when many are encoded as one text.
        (self.bar,) = np.frombuffer(self._plain(["|"])[0], "<u2").tolist()
        #: Words and signs met lately, and those before; what is met again moves to the former.
        self.pieces: dict[str, bytes] = {"": b""}
        self.earlier: dict[str, bytes] = {"": b""}

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u2").tobytes() for x in found]

    def _words(self, words: list[str]) -> None:
        """Learn words that normaliser and pattern leave whole, from the library's model, to
        which their bytes are shown as characters."""
        tokenize, shown = self.tokenizer.model.tokenize, self.shown
        ids: list[int] = []
        ends = [0]
        for word in words:
            if not word.isascii():
                word = "".join(map(shown.__getitem__, word.encode()))
            ids += [token.id for token in tokenize(word)]
            ends.append(2 * len(ids))
        packed = np.array(ids, dtype="<u2").tobytes()
        self.pieces.update(zip(words, (packed[a:b] for a, b in pairwise(ends)), strict=True))

    def _learn(self, pieces: list[str]) -> None:
        words = [
            x
            for x in pieces
            if x.isalpha() and x.islower() and (x.isascii() or max(x) < _PLAIN)
        ]
        self._words(words)
        pieces = [x for x in pieces if x not in self.pieces]
        simple = [x for x in pieces if "|" not in x]
        texts = [" | ".join(simple[i : i + JOINED]) for i in range(0, len(simple), JOINED)]
        for i, packed in enumerate(self._plain(texts)):
            ids = np.frombuffer(packed, "<u2")
            bars = np.flatnonzero(ids == self.bar)
            starts = [0, *(2 * bars + 2).tolist()]
            ends = [*(2 * bars).tolist(), len(packed)]
            own = simple[i * JOINED : (i + 1) * JOINED]
            self.pieces.update(
                zip(own, (packed[a:b] for a, b in zip(starts, ends, strict=True)), strict=True)
            )
        other = [x for x in pieces if "|" in x]
        self.pieces.update(zip(other, self._plain(other), strict=True))

    def _settled(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, learning those that are not known."""
        if len(self.pieces) > REMEMBERED:
            self.earlier, self.pieces = self.pieces, {}
        known, earlier = self.pieces, self.earlier
        found = list(map(known.get, pieces))
        places = [i for i, packed in enumerate(found) if packed is None]
        unknown = [x for i in places if (x := pieces[i]) not in earlier]
        known.update((x, earlier[x]) for i in places if (x := pieces[i]) in earlier)
        self._learn(unknown)
        for i in places:
            found[i] = known[pieces[i]]
        return found

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The 16-bit ids of all texts, without special tokens, and where each text's begin
        and the last one's end. Texts are cut, their pieces numbered and the ids laid out by
        Arrow; Python sees the distinct words and signs alone."""
        texts = pc.fill_null(texts, "")
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        lists = pc.ascii_split_whitespace(lower)
        numbered = lists.flatten().dictionary_encode()
        halves = _halves(numbered.dictionary).dictionary_encode()
        settled = self._settled(halves.dictionary.to_numpy(zero_copy_only=False).tolist())
        offsets, ids = _laid(pa.array(settled, pa.large_binary()).take(halves.indices))
        whole = _binary(offsets[::2], ids)
        offsets, ids = _laid(whole.take(numbered.indices))
        counts = np.asarray(pc.list_value_length(lists))
        edges = offsets[np.concatenate(([0], np.cumsum(counts)))] // 2
        return np.frombuffer(ids, "<u2", edges[-1]), edges

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 16-bit ids of each text, without special tokens."""
        ids, edges = self.encode_array(pa.array(texts, pa.string()))
        for a, b in pairwise(edges.tolist()):
            yield ids[a:b].tobytes()


def _halves(pieces: pa.Array) -> pa.Array:
    """Two strings for each piece: up to the signs at its end, and those, where the library
    parts them; else the whole piece and nothing. A piece that may hold the name of a special
    token stays whole."""
    stems = pc.ascii_rtrim(pieces, characters=_SIGNS)
    apart = pc.and_not(
        pc.match_substring_regex(stems, _BEFORE_SIGNS), pc.match_substring(pieces, "<|")
    )
    sizes = np.asarray(pc.binary_length(pieces), dtype=np.int64)
    ends = np.cumsum(sizes)
    offsets = np.zeros(2 * len(pieces) + 1, dtype=np.int64)
    kept = np.where(np.asarray(apart), np.asarray(pc.binary_length(stems)), sizes)
    offsets[1::2] = ends - sizes + kept
    offsets[2::2] = ends
    _, data = _laid(pieces.cast(pa.large_string()))
    return pa.LargeStringArray.from_buffers(2 * len(pieces), pa.py_buffer(offsets), data)


def _laid(values: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """The offsets of newly made strings with 64-bit offsets, and their bytes end to end."""
    _, offsets, data = values.buffers()
    if not len(values):
        return np.zeros(1, dtype=np.int64), pa.py_buffer(b"")
    return np.frombuffer(offsets, np.int64, len(values) + 1), data or pa.py_buffer(b"")


def _binary(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    kept = pa.py_buffer(np.ascontiguousarray(offsets))
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, kept, data])


@lru_cache(maxsize=2)
def _encoder(name: str) -> WordEncoder:
    # Spark runs a task per core already; the library's own threads would only wait for each other.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(SparkFiles.get(name))


def _frequent(
    sequence: np.ndarray, places: np.ndarray, top: int, min_count: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of symbols below ``top`` that begin at ``min_count`` or more of the ascending
    ``places``: their values in order, their counts, and their places pair by pair."""
    bits, place_bits = int(top).bit_length(), len(sequence).bit_length()
    firsts, lasts = sequence[places], sequence[places + 1]
    if 2 * bits + place_bits < 64:  # pair and place in one number, which sorts fastest
        packed = np.sort((firsts << bits | lasts) << place_bits | places)
        pairs, ordered = packed >> place_bits, packed & ((1 << place_bits) - 1)
    else:
        bits = 32
        pairs = firsts << bits | lasts
        order = np.argsort(pairs, kind="stable")
        pairs, ordered = pairs[order], places[order]
    edges = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    counts = np.diff(np.append(edges, len(pairs)))
    often = counts >= min_count
    values = pairs[edges[often]]
    values = values >> bits << 32 | values & ((1 << bits) - 1)
    return values, counts[often], ordered[np.repeat(often, counts)]


def pair_grammar(
    ids: np.ndarray, base: int, min_count: int = MIN_COUNT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (sequence, rules, lengths) for ids below ``base``.

    Each round takes the frequent pairs from the most frequent down and skips a pair whose
    first symbol ends, or whose last symbol begins, a pair taken in this round. Pairs taken
    overlap in runs of one symbol alone, where every other one is replaced, so a round replaces
    them all at once. Rounds end when no pair is frequent.

    A pair of symbols that were there before a round occurs no more often after it. So a round
    looks at the places beside the symbols of the last one and at those of the pairs that were
    frequent then; no frequent pair stands anywhere else.
    """
    sequence = ids.astype(np.int64)
    rules: list[np.ndarray] = []
    n_rules = 0
    places = np.arange(max(len(sequence) - 1, 0))
    while len(places):
        values, counts, ordered = _frequent(sequence, places, base + n_rules, min_count)
        if not len(values):
            break
        ranked = values[np.lexsort((values, -counts))]
        taken: list[int] = []
        firsts: set[int] = set()
        lasts: set[int] = set()
        pairs = zip(
            ranked.tolist(), (ranked >> 32).tolist(), (ranked & 0xFFFFFFFF).tolist(), strict=True
        )
        for value, a, b in pairs:
            if a not in lasts and b not in firsts and (a != b or a not in firsts):
                firsts.add(a)
                lasts.add(b)
                taken.append(value)
        chosen = np.array(sorted(taken), dtype=np.int64)
        new = np.full(len(values), -1, dtype=np.int64)
        new[np.searchsorted(values, chosen)] = np.arange(len(chosen))
        symbols = np.full(len(sequence), -1, dtype=np.int32)
        symbols[ordered] = np.repeat(new, counts)
        hits = np.flatnonzero(symbols >= 0)
        new_run = np.ones(len(hits), dtype=bool)
        new_run[1:] = np.diff(hits) != 1
        first = hits[new_run][np.cumsum(new_run) - 1]
        hits = hits[(hits - first) % 2 == 0]
        sequence[hits] = symbols[hits] + (base + n_rules)
        left = np.ones(len(sequence), dtype=bool)
        left[hits + 1] = False
        near = np.zeros(len(sequence), dtype=bool)
        near[ordered] = True
        near[hits] = True
        near[hits[hits > 0] - 1] = True
        sequence = sequence[left]
        places = np.flatnonzero(near[left][:-1])
        rules.append(chosen)
        n_rules += len(chosen)
    flat = np.concatenate(rules) if rules else np.zeros(0, dtype=np.int64)
    pairs = np.stack([flat >> 32, flat & 0xFFFFFFFF], axis=1).astype(np.int64)
    lengths = np.ones(base + n_rules, dtype=np.int64)
    start = base
    for chosen in rules:  # a round's rules use earlier symbols alone
        stop = start + len(chosen)
        lengths[start:stop] = lengths[chosen >> 32] + lengths[chosen & 0xFFFFFFFF]
        start = stop
    return sequence, pairs, lengths[base:]


class Grammar:
    """The rules of a shard, with the ids that each symbol stands for laid end to end."""

    def __init__(self, base: int, rules: np.ndarray, lengths: np.ndarray) -> None:
        self.sizes = np.concatenate((np.ones(base, dtype=np.int64), lengths))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.empty(self.sizes.sum(), dtype=np.uint32)
        self.ids[:base] = np.arange(base)
        # Both symbols of a rule are earlier ones; rules in a row that need none of themselves
        # are laid out at once.
        latest = rules.max(axis=1) if len(rules) else np.zeros(0, dtype=np.int64)
        done = 0
        while done < len(rules):
            late = np.flatnonzero(latest[done:] >= base + done)
            stop = done + int(late[0]) if len(late) else len(rules)
            at = int(self.starts[base + done])
            laid = self.expand(rules[done:stop].ravel())
            self.ids[at : at + len(laid)] = laid
            done = stop

    def expand(self, sequence: np.ndarray) -> np.ndarray:
        """The ids of a sequence of symbols."""
        sizes = self.sizes[sequence]
        ends = np.cumsum(sizes)
        shift = self.starts[sequence] - (ends - sizes)
        return self.ids[np.arange(sizes.sum()) + np.repeat(shift, sizes)]

    def read_range(
        self, start: int, stop: int, sequence: np.ndarray, steps: np.ndarray
    ) -> np.ndarray:
        """Ids ``start`` to ``stop`` of a shard, from the symbols that cover them alone."""
        first = max(int(np.searchsorted(steps, start, side="right")) - 1, 0)
        last = int(np.searchsorted(steps, stop, side="left"))
        window = sequence[first * STEP : last * STEP]
        sizes = self.sizes[window]
        ends = np.cumsum(sizes) + steps[first]
        low = int(np.searchsorted(ends, start, side="right"))
        high = int(np.searchsorted(ends, stop, side="left")) + 1
        offset = start - int(ends[low] - sizes[low])
        return self.expand(window[low:high])[offset : offset + stop - start]


def _shard(part: int, shard: int, doc_ids: list, packed: list[bytes], base: int) -> dict:
    ids = np.frombuffer(b"".join(packed), dtype="<u4")
    starts = np.cumsum([0, *(len(x) // 4 for x in packed)])[:-1]
    sequence, rules, lengths = pair_grammar(ids, base)
    sizes = np.ones(len(sequence), dtype=np.int64)
    composed = sequence >= base
    sizes[composed] = lengths[sequence[composed] - base]
    steps = np.concatenate(([0], np.cumsum(sizes)))[: len(sequence) : STEP]
    return {
        "part": part,
        "shard": shard,
        "n_ids": len(ids),
        "doc_ids": doc_ids,
        "doc_starts": starts.tolist(),
        "base": base,
        "rules": rules.astype("<u4").tobytes(),
        "lengths": lengths.astype("<u4").tobytes(),
        "sequence": sequence.astype("<u4").tobytes(),
        "step_starts": steps.astype("<u8").tobytes(),
    }


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    kinds = {
        "part": pa.int32(),
        "shard": pa.int32(),
        "n_ids": pa.int64(),
        "doc_ids": pa.list_(pa.int64()),
        "doc_starts": pa.list_(pa.int64()),
        "base": pa.int32(),
    }
    schema = pa.schema([(name, kinds.get(name, pa.binary())) for name in rows[0]])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode ``text`` by the tokenizer file and write the shards to ``path``.

    Ids are dealt by ranges of the key, two bytes each, so that texts are not shuffled.
    """
    spark = docs.sparkSession
    on_workers(spark)
    spark.sparkContext.addFile(tokenizer)
    name = tokenizer.rstrip("/").rpartition("/")[2]
    base = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    if base > 1 << 16:
        raise ValueError("ids are dealt as 16-bit numbers; the vocabulary is larger")
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    cuts = np.asarray(quantiles(rows, "doc_id", parts), dtype=np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        for batch in batches:
            for piece in slices(batch, "text", BLOCK_BYTES):
                ids, edges = encoder.encode_array(piece["text"])
                ended = np.insert(ids, edges[1:], end_id).astype("<u2")
                edges = 2 * (edges + np.arange(len(edges)))
                ids = pa.Array.from_buffers(
                    pa.binary(),
                    piece.num_rows,
                    [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(ended)],
                )
                part = parts_of(piece["doc_id"], cuts, unknown=parts)
                yield pa.RecordBatch.from_arrays(
                    [part, piece["doc_id"], ids], names=["part", "doc_id", "ids"]
                )

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, size = -1, 0, 0
        doc_ids: list = []
        packed: list[bytes] = []
        for batch in batches:
            for row_part, doc_id, ids in zip(
                *(batch[c].to_pylist() for c in ("part", "doc_id", "ids")), strict=True
            ):
                if packed and (row_part != part or size + len(ids) // 2 > SHARD_IDS):
                    yield _arrow([_shard(part, shard, doc_ids, packed, base)])
                    doc_ids, packed, size = [], [], 0
                    shard += 1
                if row_part != part:
                    part, shard = row_part, 0
                doc_ids.append(doc_id)
                packed.append(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                size += len(ids) // 2
        if packed:
            yield _arrow([_shard(part, shard, doc_ids, packed, base)])

    encoded = rows.mapInArrow(encode, "part int, doc_id long, ids binary")
    dealt = encoded.repartitionById(parts, F.col("part") % parts)
    ordered = dealt.sortWithinPartitions("part", "doc_id", "ids")
    ordered.mapInArrow(shards, FORMAT).write.parquet(path)


def _documents(row: dict) -> pa.RecordBatch:
    """The documents of a shard, each read by its own range."""
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)
    lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    sequence = np.frombuffer(row["sequence"], "<u4")
    steps = np.frombuffer(row["step_starts"], "<u8").astype(np.int64)
    grammar = Grammar(row["base"], rules, lengths)
    starts = row["doc_starts"]
    stops = [*starts[1:], row["n_ids"]]
    sums = [
        zlib.crc32(grammar.read_range(a, b, sequence, steps).astype("<u4").tobytes())
        for a, b in zip(starts, stops, strict=True)
    ]
    n = len(starts)
    columns = [
        pa.array([row["part"]] * n, pa.int32()),
        pa.array([row["shard"]] * n, pa.int32()),
        pa.array(row["doc_ids"], pa.int64()),
        pa.array(starts, pa.int64()),
        pa.array(np.subtract(stops, starts), pa.int64()),
        pa.array(sums, pa.int64()),
    ]
    names = ["part", "shard", "doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def read_documents(shards: DataFrame) -> DataFrame:
    """Documents from shard rows: part, shard, doc_id, start (within the shard), n_tokens and
    ids_crc32, from the symbols that cover each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                yield _documents(batch.slice(n, 1).to_pylist()[0])

    return shards.mapInArrow(
        run, "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start over all shards, n_tokens and ids_crc32, from the files at ``path``.

    Only the totals of the parts, as many as shuffle partitions, are summed by the driver;
    within a part its shards are.
    """
    on_workers(spark)
    shards = spark.read.parquet(path)
    totals = shards.select("part", "shard", "n_ids")
    parts = sorted((r["part"], r["n"]) for r in
                   totals.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts = accumulate((n for _, n in parts), initial=0)
    known = [(part, start) for (part, _), start in zip(parts, starts, strict=False)]
    begun = F.broadcast(spark.createDataFrame(known, "part int, part_start long"))
    order = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n_ids").over(order), F.lit(0))
    before = totals.withColumn("within", within).join(begun, "part")
    before = before.select(
        "part", "shard", (F.col("part_start") + F.col("within")).alias("before")
    )
    start = (F.col("before") + F.col("start")).alias("start")
    documents = read_documents(shards).join(before, ["part", "shard"])
    return documents.select("doc_id", start, "n_tokens", "ids_crc32")


def encode_to_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the shards to the scratch folder and return ``document_index`` of them."""
    path = scratch_path(docs.sparkSession, "llm-shards")
    write_shards(docs, tokenizer, path, end_id)
    return document_index(docs.sparkSession, path)
