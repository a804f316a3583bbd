"""Byte-level BPE by replaying the merges over a block of the corpus.

The distinct words of a block lie in one flat array of symbols. An inverted index leads
from the rank of each pair to the positions where it stands. Merges are applied in rank
order, and only the two neighbours of a merged pair enter the index anew. Words do not touch
each other, so a block gives each word the ids that a replay over the whole corpus would give
it, and blocks need no shuffle. Words that earlier blocks of the same task have settled are
looked up.

For short words the index has a window of ranks per entry, and windows are taken in order.
Within one, the lowest pair of every word is merged, all words at once, until none is left:
the order within each word is that of the ranks. Long words go rank by rank, each rank at all
its positions, in time that grows with their length alone.

Results per row:

* a null or empty text has no ids; its decoded text is empty;
* ids and decoded bytes depend on the text alone, so ties and repeated rows give equal rows;
* an empty table gives an empty table; columns other than the key and the text are dropped,
  and so may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stratacart.llm.common import on_workers, slices, thrifty

#: Bytes of text that are split into words together.
BLOCK_BYTES = 2 << 20
#: Bytes of distinct words that are replayed together: some 100 bytes of memory for each.
REPLAY_BYTES = 256 << 10
#: Bytes of the longest words that are short.
SHORT = 64
#: Settled words, and pieces, that a task remembers; beyond, it starts afresh.
REMEMBERED = 150_000
_KEY = 1 << 17
_MIX = np.int64(-7046029254386353131)
_RANK_BITS = 17


class PairRanks:
    """The ranks of many pairs at once: a hash table in arrays, with linear probing."""

    def __init__(self, merges: dict[int, int]) -> None:
        bits = max(4, (4 * len(merges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, -1, dtype=np.int32)
        keys = np.fromiter(merges.keys(), np.int64, len(merges))
        ranks = np.fromiter(merges.values(), np.int32, len(merges))
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.ranks[slots[placed]] = ranks[placed]
            keys, ranks = keys[~placed], ranks[~placed]
            slots = slots[~placed] + 1 & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX).view(np.uint64) >> self.shift).view(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Per pair of symbols its rank, -1 where they do not merge."""
        keys = left.astype(np.int64) * _KEY + right
        slots = self._slots(keys)
        there = self.keys[slots]
        found = np.where(there == keys, self.ranks[slots], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slots[open_] = slots[open_] + 1 & self.mask
            there = self.keys[slots[open_]]
            same = there == keys[open_]
            found[open_[same]] = self.ranks[slots[open_[same]]]
            open_ = open_[~same & (there >= 0)]
        return found


class MergeReplay:
    """Encoder and decoder for a rank file: lines of a base64 token and its rank."""

    def __init__(self, lines: Iterable[bytes], pattern: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.merges = {
            ranks[token[:cut]] * _KEY + ranks[token[cut:]]: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        #: The rank of a pair of bytes, -1 where they do not merge.
        self.byte_ranks = np.array(
            [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], dtype=np.int64
        )
        self.top = max(ranks.values())
        self.pair_ranks = PairRanks(self.merges)
        #: The window of the index that a rank belongs to.
        self.window = np.array([r.bit_length() for r in range(self.top + 1)], dtype=np.int8)
        #: Ids as little-endian 32-bit integers, of words and of pieces that a space leads.
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def forget(self) -> None:
        """Give back the memory, for what the worker does next."""
        self.words.clear()
        self.pieces.clear()

    def replay(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        coded = [word.encode() for word in words]
        long = [i for i, word in enumerate(coded) if len(word) > SHORT]
        if not long:
            return self._replay_short(coded)
        found = self._replay_short([word for word in coded if len(word) <= SHORT])
        for i, packed in zip(long, self._replay_long([coded[i] for i in long]), strict=True):
            found.insert(i, packed)
        return found

    def _replay_short(self, coded: list[bytes]) -> list[bytes]:
        if not coded:
            return []
        data = np.frombuffer(b"".join(coded), dtype=np.uint8)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        size = len(data)
        # A place behind the last, in no word, stands for what is before or behind all.
        word = np.append(np.repeat(np.arange(len(coded), dtype=np.int32), lengths), np.int32(-1))
        symbols = np.append(self.byte_ids[data], -1).astype(np.int32)
        after = np.arange(1, size + 2, dtype=np.int32)
        before = np.arange(-1, size, dtype=np.int32)
        rank_at = np.full(size + 1, -1, dtype=np.int32)  # of the pair that begins at a place
        rank_at[: size - 1] = self.byte_ranks[data[:-1].astype(np.int64) * 256 + data[1:]]
        rank_at[np.cumsum(lengths) - 1] = -1

        place_bits = size.bit_length()
        index: list[list[np.ndarray]] = [[] for _ in range(int(self.window[-1]) + 1)]

        def enter(places: np.ndarray) -> int:
            """Index the pairs that begin at the places; the lowest of their windows."""
            places = places[rank_at[places] >= 0]
            ranks = rank_at[places]
            keys = word[places].astype(np.int64) << _RANK_BITS | ranks
            keys = keys << place_bits | places
            windows = self.window[ranks]
            order = np.argsort(windows, kind="stable")
            keys, counts = keys[order], np.bincount(windows, minlength=len(index))
            ends = np.cumsum(counts)
            for w in np.flatnonzero(counts).tolist():
                index[w].append(keys[ends[w] - counts[w] : ends[w]])
            return int(windows.min()) if len(windows) else len(index)

        w = enter(np.arange(size))
        while w < len(index):
            if not index[w]:
                w += 1
                continue
            keys = np.sort(np.concatenate(index[w]))
            places = keys & ((1 << place_bits) - 1)
            ranks = (keys >> place_bits & ((1 << _RANK_BITS) - 1)).astype(np.int32)
            there = rank_at[places] == ranks  # else a neighbour was merged since
            keys, places, ranks = keys[there], places[there], ranks[there]
            own = keys >> (place_bits + _RANK_BITS)
            lowest = np.ones(len(own), dtype=bool)
            lowest[1:] = own[1:] != own[:-1]
            index[w] = [keys[~lowest]] if not lowest.all() else []
            i, rank = places[lowest], ranks[lowest]
            j, h = after[i], before[i]
            k = after[j]
            symbols[i], symbols[j] = rank, -1
            after[i], before[k] = k, i
            rank_at[i] = rank_at[j] = -1
            right = np.flatnonzero(word[k] == word[i])
            rank_at[i[right]] = self.pair_ranks.of(rank[right], symbols[k[right]])
            left = np.flatnonzero(word[h] == word[i])
            h = h[left]
            rank_at[h] = self.pair_ranks.of(symbols[h], rank[left])
            w = min(w, enter(np.concatenate((i[right], h))))
        alive = symbols >= 0
        packed = symbols[alive].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(word[alive], minlength=len(coded)))
        return [packed[a:b] for a, b in pairwise([0, *ends.tolist()])]

    def _replay_long(self, coded: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"\0".join(coded) + b"\0", dtype=np.uint8)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        ends = np.cumsum(lengths + 1) - 1  # where words end, with a symbol that pairs with none
        first = self.byte_ids[data]
        first[ends] = -1
        size = len(data)
        joined = self.byte_ranks[data[:-1].astype(np.int64) * 256 + data[1:]]
        joined[ends[:-1]] = -1
        joined[ends - 1] = -1
        places = np.flatnonzero(joined >= 0)
        places = places[np.argsort(joined[places], kind="stable")]
        index: list[list[int] | None] = [None] * (self.top + 1)
        present, starts = np.unique(joined[places], return_index=True)
        stops = [*starts[1:].tolist(), len(places)][: len(starts)]
        flat = places.tolist()
        for rank, start, stop in zip(present.tolist(), starts.tolist(), stops, strict=True):
            index[rank] = flat[start:stop]

        symbols = first.tolist()
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        rank_of = self.merges.get
        rank, top = 0, self.top
        while rank <= top:
            occurrences = index[rank]
            if occurrences is None:
                rank += 1
                continue
            index[rank] = None
            occurrences.sort()
            lowest = rank + 1
            for done, i in enumerate(occurrences, 1):
                left = symbols[i]
                if left < 0:
                    continue
                j = after[i]
                right = symbols[j]
                if right < 0 or rank_of(left * _KEY + right) != rank:
                    continue
                symbols[i] = rank
                symbols[j] = -2
                after[i] = k = after[j]
                before[k] = i
                h = before[i]
                if h >= 0:
                    x = symbols[h]
                    if x >= 0:
                        found = rank_of(x * _KEY + rank)
                        if found is not None:
                            if index[found] is None:
                                index[found] = [h]
                            else:
                                index[found].append(h)
                            if found < lowest:
                                lowest = found
                x = symbols[k]
                if x >= 0:
                    found = rank_of(rank * _KEY + x)
                    if found is not None:
                        if index[found] is None:
                            index[found] = [i]
                        else:
                            index[found].append(i)
                        if found < lowest:
                            lowest = found
                if lowest <= rank:  # a lower rank came up: it goes first, then the rest here
                    index[rank] = (index[rank] or []) + occurrences[done:]
                    break
            rank = lowest
        last = np.array(symbols, dtype=np.int64)
        alive = last >= 0
        kept = np.concatenate(([0], np.cumsum(alive)))
        packed = last[alive].astype("<u4").tobytes()
        begin = (4 * kept[ends - lengths]).tolist()
        end = (4 * kept[ends]).tolist()
        return [packed[a:b] for a, b in zip(begin, end, strict=True)]

    def learn(self, new: list[str]) -> None:
        """Settle distinct words that are not known yet."""
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        start = 0
        while start < len(new):
            below = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, below + REPLAY_BYTES, side="right")))
            together = new[start:stop]
            self.words.update(zip(together, self.replay(together), strict=True))
            start = stop

    def _split(self, pieces: list[str]) -> None:
        """Learn the pieces from the words that they consist of."""
        split = self.pattern.findall
        # No match goes from other characters on to a space, so pieces that a space leads
        # and none ends are split as one text.
        single = [x for x in pieces if x[0] != " " or x[-1].isspace()]
        joined = [x for x in pieces if x[0] == " " and not x[-1].isspace()]
        words = split("".join(joined))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        edges = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
        if ends[-1:].tolist() != edges[-1:].tolist():  # a pattern that leaves characters out
            single, joined, words, edges = [*single, *joined], [], [], edges[:0]
        parts = [split(x) for x in single]
        begun = sum(map(len, parts))
        stops = [*accumulate(map(len, parts)), *(begun + 1 + np.searchsorted(ends, edges)).tolist()]
        words = [*chain.from_iterable(parts), *words]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        numbered = pa.array(words, pa.large_string()).dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.words
        self.learn([x for x in distinct if x not in known])
        laid = pa.array([known[x] for x in distinct], pa.large_binary()).take(numbered.indices)
        offsets, data = _laid(laid)
        packed, cuts = data.to_pybytes(), offsets[np.array([0, *stops])].tolist()
        own = (packed[a:b] for a, b in pairwise(cuts))
        self.pieces.update(zip(chain(single, joined), own, strict=True))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The 32-bit ids of all texts, and where each text's begin and the last one's end.

        Texts are cut before spaces, but for those behind white space, where the pattern may
        look at what follows. Arrow numbers the pieces and lays out their ids; Python sees
        the distinct pieces alone.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        edges, pieces = _pieces(texts)
        numbered = pieces.dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        found = list(map(self.pieces.get, distinct))
        unknown = [i for i, packed in enumerate(found) if packed is None]
        self._split([distinct[i] for i in unknown])
        for i in unknown:
            found[i] = self.pieces[distinct[i]]
        offsets, ids = _laid(pa.array(found, pa.large_binary()).take(numbered.indices))
        edges = offsets[edges] // 4
        return np.frombuffer(ids, "<i4", edges[-1]), edges

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Per text its ids as little-endian 32-bit integers."""
        ids, edges = self.encode_array(pa.array(texts, pa.large_string()))
        for a, b in pairwise(edges.tolist()):
            yield ids[a:b].tobytes()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    @cached_property
    def token_bytes(self) -> pa.Array:
        return pa.array([self.tokens.get(i, b"") for i in range(self.top + 1)], pa.large_binary())

    @cached_property
    def shown(self) -> pa.Array:
        """Each id in decimal, and a space."""
        return pa.array([b"%d " % i for i in range(self.top + 1)], pa.large_binary())

    def decoded(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """The bytes that each text's ids stand for."""
        offsets, data = _laid(self.token_bytes.take(pa.array(ids)))
        kept = pa.py_buffer(np.ascontiguousarray(offsets[edges]))
        return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, kept, data])

    def texts_of(self, ids: np.ndarray, edges: np.ndarray) -> Iterator[memoryview]:
        """Each text's ids in decimal, joined by one space."""
        offsets, data = _laid(self.shown.take(pa.array(ids)))
        shown = memoryview(data)
        for a, b in pairwise(offsets[edges].tolist()):
            yield shown[a : max(a, b - 1)]


def _laid(values: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """The offsets of strings with 64-bit offsets, and the bytes that they count in."""
    _, offsets, data = values.buffers()
    if not len(values):
        return np.zeros(1, dtype=np.int64), pa.py_buffer(b"")
    kept = np.frombuffer(offsets, np.int64, len(values) + 1, 8 * values.offset)
    return kept, data or pa.py_buffer(b"")


def _pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The pieces of all texts, and the number of each text's first one and of the end."""
    offsets, data = _laid(texts)
    begin, end = int(offsets[0]), int(offsets[-1])
    laid = np.frombuffer(data, np.uint8, end)
    spaces = np.flatnonzero(laid[begin:end] == 0x20) + begin
    spaces = spaces[spaces > begin]
    last, last_but_one = laid[spaces - 1], laid[np.maximum(spaces - 2, 0)]
    # White space beyond ASCII has one of these bytes before its last one; so have some
    # letters, behind which texts then stay whole.
    wide = (last >= 0x80) & np.isin(last_but_one, [0xC2, 0x80, 0x81, 0x9A])
    cut = np.zeros(end - begin + 1, dtype=bool)
    cut[spaces[(last > 0x20) & ~wide] - begin] = True
    cut[offsets - begin] = True
    bounds = np.flatnonzero(cut) + begin
    pieces = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), data)
    return np.searchsorted(bounds, offsets), pieces


def _lists(ids: np.ndarray, edges: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))


@lru_cache(maxsize=2)
def _replay(name: str, pattern: str) -> MergeReplay:
    with open(SparkFiles.get(name), "rb") as lines:
        return MergeReplay(lines, pattern)


def encode_decode(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    text: str = "text",
    keep: tuple[str, ...] = (),
    key: str = "doc_id",
) -> DataFrame:
    """Encode each text by the rank file at the path ``ranks`` and decode the ids again.

    Returns key, the columns ``keep``, ``ids`` (array of int) and ``decoded`` (bytes). The
    rank file, of a fixed size, is shipped to each executor once.
    """

    def rows(
        replay: MergeReplay, ids: np.ndarray, edges: np.ndarray, texts: pa.Array
    ) -> list[pa.Array]:
        return [_lists(ids, edges), replay.decoded(ids, edges).cast(pa.binary())]

    columns = "ids array<int>, decoded binary"
    return _encoded(docs, ranks, pattern, text, (key, *keep), rows, columns)


def encode_checked(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    text: str = "text",
    keep: tuple[str, ...] = (),
    key: str = "doc_id",
) -> DataFrame:
    """Key, ``keep``, ``n_tokens``, ``ids`` and whether the ids decode to the text
    (``restored``), which the task that encodes finds out: no text leaves it."""

    def rows(
        replay: MergeReplay, ids: np.ndarray, edges: np.ndarray, texts: pa.Array
    ) -> list[pa.Array]:
        plain = pc.fill_null(texts, "").cast(pa.large_string()).cast(pa.large_binary())
        same = pc.equal(replay.decoded(ids, edges), plain)
        return [pa.array(np.diff(edges), pa.int64()), _lists(ids, edges), same]

    columns = "n_tokens long, ids array<int>, restored boolean"
    return _encoded(docs, ranks, pattern, text, (key, *keep), rows, columns)


def token_digests(
    docs: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Key, ``n_tokens`` and the SHA-256 digests ``ids_sha256`` of the decimal ids and
    ``decoded_sha256`` of the decoded bytes, taken in the task that encodes."""

    def rows(
        replay: MergeReplay, ids: np.ndarray, edges: np.ndarray, texts: pa.Array
    ) -> list[pa.Array]:
        offsets, data = _laid(replay.decoded(ids, edges))
        plain = memoryview(data)
        cuts = pairwise(offsets.tolist())
        return [
            pa.array(np.diff(edges), pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in replay.texts_of(ids, edges)]),
            pa.array([hashlib.sha256(plain[a:b]).hexdigest() for a, b in cuts]),
        ]

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, ranks, pattern, text, (key,), rows, columns)


def _encoded(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    text: str,
    keep: tuple[str, ...],
    rows: Callable[[MergeReplay, np.ndarray, np.ndarray, pa.Array], list[pa.Array]],
    columns: str,
) -> DataFrame:
    on_workers(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(ranks)
    name = ranks.rstrip("/").rpartition("/")[2]
    picked = docs.select(*dict.fromkeys([*keep, text]))
    result = StructType([*picked.select(*keep).schema, *StructType.fromDDL(columns)])
    schema = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _replay(name, pattern)
        for batch in batches:
            for part in slices(batch, text, BLOCK_BYTES):
                found = rows(replay, *replay.encode_array(part[text]), part[text])
                yield pa.RecordBatch.from_arrays([*(part[k] for k in keep), *found], schema=schema)
        replay.forget()

    return picked.mapInArrow(thrifty(run), result)
