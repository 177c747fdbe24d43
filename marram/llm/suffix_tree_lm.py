"""Language-model scoring with a probabilistic suffix tree.

Symbols are the bytes of the normalised text (A-Z lower-cased, one space between words) and an end
mark, so a text's probability is that of its sequence of words and end, with no unknown word. A
context of up to DEPTH bytes becomes a state if it is frequent enough and its next-symbol
distribution diverges from that of its longest proper suffix; every suffix of a state is a state.
Distributions are smoothed towards the suffix' distribution; a symbol without an edge of its own
takes its share of the suffix' probability. A position is scored in its longest suffix state.

Counts cover the whole training part, and contexts and edges seen LEAST_COUNT times count, whatever
the corpus' size, so the tree grows with it. Lengths up to SHORT, of which there are 256 ** SHORT
contexts at most, are built on the driver. For the longer ones each task merges its counts and sends
them, packed as sorted arrays, to the task that builds all contexts with the same last bytes, into a
table of slots.

Texts to be scored are packed into blocks. Each block sends its distinct grams to the tasks that hold
their slots, gets their logs back and adds them up by text, so texts are read once and no task holds
more than one part of the tree, however large it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import Batches, crc32_residue, lean, small_batches, stored, tidy

DEPTH = 7
#: Contexts and edges of the tree were seen this often at least.
LEAST_COUNT = 2
#: Lengths that every worker has in full. Longer contexts with the same SHORT + 1 last bytes lie together.
SHORT = 2
#: Slots of the longer contexts, training symbols for each part that one task builds from, and entries of the tree that a task scores grams against.
SLOTS, PART_SYMBOLS, PASS_ENTRIES = 4096, 3_000_000, 3_000_000
#: A context is kept if its divergence (nats) and its log-likelihood ratio reach these.
LEAST_DIVERGENCE, LEAST_RATIO = 0.005, 20.0
#: Sums over rows are of whole parts of this size, so that they are the same in any order.
EXACT = 1e9
#: Logs travel as whole parts of this size of a nat.
LOG_UNIT = 1 << 18
#: Symbols' worth of belief in the suffix' distribution.
PRIOR = 16.0
#: Words with this share of all words are looked up in a broadcast table (at most 1 / share); the rest are joined.
WORD_SHARE = 1e-6
#: Bytes of text that are counted and that are scored at once, and grams and words a task holds before it passes their counts on.
CHUNK_BYTES, SCORE_BYTES, HELD_GRAMS, HELD_WORDS = 1_500_000, 1_500_000, 4_000_000, 1_500_000
#: Symbols whose distinct grams are sent together; a longer text is a block of its own.
BLOCK_SYMBOLS = 12_000_000
#: Training symbols whose grams a task counts together.
PACK_SYMBOLS = 14_000_000
#: Symbols whose grams are sorted and looked up together, and that other steps pass through at a time, in little memory.
PIECE_SYMBOLS, LOOKUP_SYMBOLS, FEW_SYMBOLS = 1 << 21, 1 << 21, 1 << 18
#: Turns in which blocks get their logs, so that those of a part of them are on disk at a time, and blocks from which on there is more than one.
ROUNDS, ROUND_BLOCKS = 3, 12

END = b"\n"
_PAD = END * DEPTH
_U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def symbols_of(words: list[bytes]) -> bytes:
    return _PAD + b" ".join(words) + END


def keys_of(data: bytes | memoryview | pa.Buffer) -> np.ndarray:
    """The key (DEPTH context bytes, then the symbol) that starts at each byte."""
    return np.ndarray((max(0, len(data) - DEPTH),), dtype=">u8", buffer=data, strides=(1,)).astype(np.uint64)


def raw_of(data: bytes | memoryview | pa.Buffer) -> np.ndarray:
    """The bytes of the key that starts at each byte, as they lie: the symbol in the highest, then the context from near to far."""
    return np.ndarray((max(0, len(data) - DEPTH),), dtype="<u8", buffer=data, strides=(1,)).astype(np.uint64)


def near_first(keys: np.ndarray) -> np.ndarray:
    """Keys with the context's bytes from the nearest to the farthest, so that sorted ones with the same suffix lie together."""
    keys = keys.byteswap()
    return (keys << _U(8)) | (keys >> _U(56))


def far_first(keys: np.ndarray) -> np.ndarray:
    return ((keys >> _U(8)) | (keys << _U(56))).byteswap()


def between(lengths: np.ndarray) -> np.ndarray:
    """Of texts of so many symbols, laid one after the other, the keys that reach from one into the next."""
    ends = np.cumsum(lengths + DEPTH)[:-1] - DEPTH
    return (ends[:, None] + np.arange(DEPTH)).ravel()


def windows(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every position of the texts, and the number of positions of each."""
    symbols = [symbols_of(w) for w in texts]
    lengths = np.array([len(x) - DEPTH for x in symbols], dtype=np.int64)
    return np.delete(keys_of(b"".join(symbols)), between(lengths)), lengths


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts; sorts ``keys``."""
    keys.sort()
    new = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    return keys[starts], np.diff(starts, append=len(keys))


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


class Held:
    """Counts of keys, merged now and then so that about HELD_GRAMS are held at most."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        """Whether even merged counts are many, so that they should be passed on."""
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size <= HELD_GRAMS:
            return False
        self.parts = [_merge(self.parts)]
        self.size = len(self.parts[0][0])
        return self.size > HELD_GRAMS // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = _merge(self.parts)
        self.parts, self.size = [], 0
        return out


def _chunks(column: pa.Array, most: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Consecutive rows as word lists, about ``most`` bytes at a time, with the index of the first."""
    at = 0
    while at < len(column):
        first, group, size = at, [], 0
        while at < len(column) and (size < most or not group):
            text = column[at].as_py()
            group.append(words_of(text))
            size += len(text or "")
            at += 1
        yield first, group


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, g, n): words, with END counting the texts, and grams of SHORT + 1 bytes."""
    schema = pa.schema([("w", pa.binary()), ("g", pa.int64()), ("n", pa.int64())])

    def words_out() -> pa.RecordBatch:
        found = pa.chunked_array(words, pa.binary()).value_counts()
        return pa.RecordBatch.from_arrays([found.field("values"), pa.nulls(len(found), pa.int64()), found.field("counts")], schema=schema)

    short, words, texts = np.zeros(0, np.uint64), [], 0
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for _, group in _chunks(batch.column(0), CHUNK_BYTES):
            texts += len(group)
            words.append(pa.array(chain.from_iterable(group), pa.binary()))
            if sum(map(len, words)) > HELD_WORDS:
                yield words_out()
                words = []
            keys, n = _distinct((windows(group)[0] & _U((1 << 8 * (SHORT + 1)) - 1)).astype(np.uint32))
            short, counts = _merge([(short, counts), (keys.astype(np.uint64), n)])
    if words:
        yield words_out()
    if len(short):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(short), pa.binary()), pa.array(short.view(np.int64)), pa.array(counts)], schema=schema)
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.nulls(1, pa.int64()), pa.array([texts])], schema=schema)


def _each(keys: np.ndarray, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """What ``of`` says of sorted keys, the nearest first, which depends on their SHORT + 1 last bytes of context: such keys lie together."""
    last = keys >> _U(64 - 8 * (SHORT + 1))
    starts = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])
    return np.repeat(of(keys[starts]), np.diff(starts, append=len(keys)))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that builds a gram's contexts, by their last SHORT + 1 bytes."""
    last = (keys >> _U(8)) & _U((1 << 8 * (SHORT + 1)) - 1)
    return (((last * _U(0x9E3779B97F4A7C15)) >> _U(20)) % _U(parts)).astype(np.uint32)


def flat(values: np.ndarray) -> bytes:
    """Values byte by byte of all, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unflat(data: bytes, n: int, kind: np.dtype | type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, decompressed_size=size * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def squeezed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts, compressed: differences of keys and 32-bit counts, byte by byte of all."""
    planes = [np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T, counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T]
    return pa.compress(b"".join(np.ascontiguousarray(p).tobytes() for p in planes), codec="zstd", asbytes=True)


def unsqueezed(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=12 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    keys = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(keys, dtype=np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view(np.uint32).ravel().astype(np.int64)


def _pack(parts: int):
    """(part, n, grams): grams of DEPTH + 1 bytes, the nearest first, and how often a task saw them, squeezed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, size = np.empty(PACK_SYMBOLS, np.uint64), 0  # what is not filled takes no memory

        def out(all_keys: np.ndarray) -> pa.RecordBatch:
            keys, counts = _distinct(all_keys)
            part = _each(keys, lambda some: _part(far_first(some), parts))
            order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
            part, keys, counts = part[order], keys[order], counts[order]
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = np.r_[edges[1:], len(part)]
            packed = [squeezed(keys[x:y], counts[x:y]) for x, y in zip(edges, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[edges].astype(np.int32)), pa.array((ends - edges).astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "n", "grams"])

        for batch in batches:
            for _, group in _chunks(batch.column(0), CHUNK_BYTES):
                keys = near_first(windows(group)[0])
                if size + len(keys) > len(room) and size:
                    yield out(room[:size])
                    size = 0
                if len(keys) > len(room):
                    yield out(keys)
                    continue
                room[size : size + len(keys)] = keys
                size += len(keys)
        if size:
            yield out(room[:size])

    return run


class Table:
    """Open-addressing hash table from 64-bit keys to floats, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(max(1, len(keys)) * 2 - 1).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.values = np.zeros(1 << self.bits, dtype=np.float32)
        left = np.arange(len(keys))
        at = self.slot(keys)
        while len(left):
            free = self.keys[at] == np.iinfo(np.uint64).max
            self.keys[at[free]] = keys[left[free]]  # of several, the last stays
            rest = self.keys[at] != keys[left]
            self.values[at[~rest]] = values[left[~rest]]
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found) of each key."""
        at = self.slot(keys)
        there = self.keys[at]
        found = there == keys
        out = self.values[at]
        open_ = np.flatnonzero(~found & (there != np.iinfo(np.uint64).max))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = True
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there != np.iinfo(np.uint64).max)]
        return out, found


@dataclass
class SuffixTree:
    """root: log probabilities of 256 symbols. For each length: edges (context and symbol) and states (context)."""

    root: np.ndarray
    edges: list[Table]
    states: list[Table]

    def log_p(self, keys: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """Natural log probability of each key's symbol after its context's longest suffix state."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        for length in range(depth, 0, -1):
            if length > len(self.edges):
                continue
            own = keys[todo] & _U((1 << 8 * (length + 1)) - 1)
            value, found = self.edges[length - 1].find(own)
            out[todo[found]] += value[found]
            todo, own = todo[~found], own[~found]
            if not len(todo):
                return out
            value, found = self.states[length - 1].find(own >> _U(8))
            out[todo[found]] += value[found]
        out[todo] += self.root[(keys[todo] & _U(255)).astype(np.int64)]
        return out


def grow(tree: SuffixTree, edges: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, ...]]:
    """Adds the next lengths in full to ``tree``, from sorted edge keys with counts and context keys with counts.

    Returns edge keys, their logs, the edges' contexts, context keys, gamma and keep of each length.
    """
    # From short to long: each length is judged and smoothed against the full lengths below it.
    built: list[tuple[np.ndarray, ...]] = []
    for (e_keys, e_counts), (c_keys, c_counts) in zip(edges, contexts, strict=True):
        length = len(tree.edges) + 1
        of = np.searchsorted(c_keys, e_keys >> _U(8))
        known = (of < len(c_keys)) & (c_keys[np.minimum(of, max(len(c_keys) - 1, 0))] == e_keys >> _U(8)) if len(c_keys) else np.zeros(len(e_keys), bool)
        e_keys, e_counts, of = e_keys[known], e_counts[known].astype(float), of[known]
        below = np.exp(tree.log_p(e_keys & _U((1 << 8 * length) - 1), length - 1))
        n = c_counts.astype(float)
        smooth = (e_counts + PRIOR * below) / (n[of] + PRIOR)
        mass, mass_below, seen = (np.bincount(of, weights=w, minlength=len(n)) for w in (smooth, below, e_counts))
        rest, rest_below = np.maximum(n - seen, 0), np.maximum(1 - mass_below, 1e-12)
        kl = np.bincount(of, weights=e_counts * np.log(e_counts / n[of] / below), minlength=len(n)).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            kl += np.where(rest > 0, rest * np.log(rest / n / rest_below), 0)
        keep = (kl / n >= LEAST_DIVERGENCE) & (2 * kl >= LEAST_RATIO)
        gamma = np.log(np.maximum(1 - mass, 1e-12) / rest_below)
        built.append((e_keys, np.log(smooth), of, c_keys, gamma, keep))
        tree.edges.append(Table(e_keys, np.log(smooth)))
        tree.states.append(Table(c_keys, gamma))
    # From long to short: suffixes of states are states.
    for at in range(len(built) - 1, 0, -1):
        length = len(tree.edges) - len(built) + at
        kept = np.unique(built[at][3][built[at][5]] & _U((1 << 8 * length) - 1))
        built[at - 1][5][:] |= np.isin(built[at - 1][3], kept)
    return built


def _levels(keys: np.ndarray, counts: np.ndarray, longest: int, shortest: int, least: int) -> tuple[list, list]:
    """Edges and contexts of the lengths shortest to longest, seen ``least`` times, from the grams of the longest."""
    edges, contexts = [], []
    for length in range(longest, shortest - 1, -1):
        if len(keys):
            keys, counts = _merge([(keys & _U((1 << 8 * (length + 1)) - 1), counts)])
        above = _merge([(keys >> _U(8), counts)]) if len(keys) else (keys, counts)
        edges.append((keys[counts >= least], counts[counts >= least]))
        contexts.append((above[0][above[1] >= least], above[1][above[1] >= least]))
    return edges[::-1], contexts[::-1]


def _slot(contexts: np.ndarray) -> np.ndarray:
    """The slot of contexts that are longer than SHORT."""
    last = contexts & _U((1 << 8 * (SHORT + 1)) - 1)
    return (((last * _U(0x9E3779B1)) >> _U(16)) % _U(SLOTS)).astype(np.int32)


_PACKED = np.dtype([("length", "u1"), ("edge", "u1"), ("k", "<u8"), ("v", "<f4")])


def _entries(built: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """(slot, n, data): the kept edges and states of each slot, packed."""
    slots, found = [], []
    for length, (e_keys, logs, of, c_keys, gamma, keep) in enumerate(built, SHORT + 1):
        for edge, keys, values in ((1, e_keys[keep[of]], logs[keep[of]]), (0, c_keys[keep], gamma[keep])):
            own = np.empty(len(keys), _PACKED)
            own["length"], own["edge"], own["k"], own["v"] = length, edge, keys, values
            slots.append(_slot(keys >> _U(8) if edge else keys))
            found.append(own)
    order, spans = _by_part(np.concatenate(slots).astype(np.uint16))
    entries = np.concatenate(found)[order]
    for at in range(0, len(spans), 64):
        rows = [(slot, y - x, flat(entries[x:y])) for slot, x, y in spans[at : at + 64]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["slot", "n", "data"])


def _by_text(of: np.ndarray, words: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Texts in order, their distinct words, and how often each text has each."""
    found = words.dictionary_encode()
    kinds = max(1, len(found.dictionary))
    both, counts = _distinct(of.astype(np.uint64) * _U(kinds) + found.indices.to_numpy().astype(np.uint64))
    return (both // _U(kinds)).astype(np.int64), found.dictionary.take(pa.array((both % _U(kinds)).astype(np.int64))), pa.array(counts)


def _looked_up(known: Broadcast, n: int) -> Batches:
    """The first n columns of each row with word scores; after them, the symbols of up to BLOCK_SYMBOLS together as a row."""
    word_scores = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("rest", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))]
    of_block = [("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_known, worth = known.value
        symbols: list[bytes] = []
        ids: list[int] = []
        size = 0

        def block(fields: list[pa.Field]) -> pa.RecordBatch:
            data = b"".join(symbols)
            row = [ids[0], len(data), pa.Codec("zstd", compression_level=3).compress(data, asbytes=True), list(ids), [len(x) - DEPTH for x in symbols]]
            symbols.clear()
            ids.clear()
            none = [pa.nulls(1, f.type) for f in fields] + [pa.nulls(1, t) for _, t in word_scores]
            return pa.RecordBatch.from_arrays([*none, *[pa.array([x], t) for x, (_, t) in zip(row, of_block, strict=True)]], names=names)

        for batch in batches:
            fields = list(batch.schema)[:n]
            names = [f.name for f in fields] + [a for a, _ in word_scores + of_block]
            for first, group in _chunks(batch.column(n), SCORE_BYTES):
                lengths = np.array([len(words) + 1 for words in group])
                ends = np.r_[0, np.cumsum(lengths)[:-1]]
                flat_words = pa.array(chain.from_iterable([*words, END] for words in group), pa.binary())
                at = pc.index_in(flat_words, value_set=words_known)
                out = at.is_null().to_numpy(zero_copy_only=False)
                base = np.add.reduceat(np.where(out, 0.0, worth[at.fill_null(0).to_numpy()]), ends)
                hits = lengths - np.add.reduceat(out, ends, dtype=np.int64)
                of, rest, times = _by_text(np.repeat(np.arange(len(group)), lengths - hits), flat_words.filter(at.is_null()))
                offsets = pa.array(np.searchsorted(of, np.arange(len(group) + 1)), pa.int32())
                for words in group:
                    symbols.append(symbols_of(words))
                    size += len(symbols[-1])
                own = batch.slice(first, len(group)).columns[:n]
                ids += own[-1].to_pylist()
                columns = [pa.array(lengths), pa.array(hits), pa.array(base), *(pa.ListArray.from_arrays(offsets, x) for x in (rest, times))]
                yield pa.RecordBatch.from_arrays([*own, *columns, *[pa.nulls(len(group), t) for _, t in of_block]], names=names)
                if size >= BLOCK_SYMBOLS:
                    yield block(fields)
                    size = 0
        if size:
            yield block(fields)

    return run


#: What is sent to a part of the tree: its own entries, without a block, and the distinct grams of blocks.
_SENT = "part int, block long, n long, data binary"


def _by_part(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by part, in which equal ones stay as they are, and (part, start, end) in it."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    if not len(part):
        return order, []
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return order, list(zip(part[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True))


def _sent(rows: list[tuple[int, int | None, int, bytes]]) -> pa.RecordBatch:
    kinds = [("part", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[name for name, _ in kinds])


def _sent_entries(parts: np.ndarray) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.array(parts[batch.column(0).to_numpy()].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part, pa.nulls(len(batch), pa.int64()), *batch.columns[1:]], names=["part", "block", "n", "data"])

    return run


def _grams_of(data: memoryview, lengths: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """A block's distinct grams, the nearest byte first, and their order by part with its spans."""
    pieces, at, size = [], 0, len(data) - DEPTH
    skip = between(lengths)  # the keys there are no grams of a text, so any that is one
    while at < size:
        end = min(at + PIECE_SYMBOLS, size)
        keys = np.empty(end - at, np.uint64)
        for a in range(at, end, FEW_SYMBOLS):
            b = min(a + FEW_SYMBOLS, end)
            keys[a - at : b - at] = _turned(raw_of(data[a : b + DEPTH]))
        keys[skip[np.searchsorted(skip, at) : np.searchsorted(skip, end)] - at] = _turned(raw_of(data[: DEPTH + 1]))
        pieces.append(_unique(keys))
        at = end
    grams = _unique(np.concatenate(pieces)) if len(pieces) > 1 else pieces[0]
    return grams, *_by_part(_each(grams, lambda some: parts[_slot(far_first(some) >> _U(8))]))


def _turned(raw: np.ndarray) -> np.ndarray:
    """As ``near_first``, from ``raw_of``."""
    return (raw << _U(8)) | (raw >> _U(56))


def _unique(keys: np.ndarray) -> np.ndarray:
    """Distinct keys; sorts ``keys``."""
    keys.sort()
    return keys[np.r_[True, keys[1:] != keys[:-1]]]


def _sent_grams(parts: np.ndarray) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, data, lengths in zip(*(batch.column(c) for c in ("block", "n", "data", "lengths")), strict=True):
                grams, order, spans = _grams_of(memoryview(pa.decompress(data.as_buffer(), n.as_py(), codec="zstd")), lengths.values.to_numpy(), parts)
                grams = grams[order]
                for at in range(0, len(spans), 64):
                    yield _sent([(part, block.as_py(), y - x, flat(np.diff(grams[x:y], prepend=_U(0)))) for part, x, y in spans[at : at + 64]])

    return run


def _answered(short: Broadcast) -> Batches:
    """Logs of the grams sent to each part, in the order in which they came. A part's entries come before its grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[np.ndarray] = []
        asked: list[tuple[int, np.ndarray]] = []
        own, tree, size = None, None, 0

        def out() -> pa.RecordBatch:
            grams = _distinct(np.concatenate([g for _, g in asked]))[0]
            logs = np.rint(tree.log_p(far_first(grams)) * LOG_UNIT).astype(np.int32)
            return _sent([(own, block, len(g), flat(logs[np.searchsorted(grams, g)])) for block, g in asked]).select(["block", "part", "n", "data"])

        for batch in batches:
            for part, block, n, data in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "n", "data")), strict=True):
                if part != own:
                    if asked:
                        yield out()
                    own, tree, entries, asked, size = part, None, [], [], 0
                if block is None:
                    entries.append(unflat(data, n, _PACKED))
                    continue
                if tree is None:
                    tree = _grown(short.value, np.concatenate([np.empty(0, _PACKED), *entries]))
                    entries = []
                asked.append((block, np.cumsum(unflat(data, n, np.uint64), dtype=np.uint64)))
                size += n
                if size >= HELD_GRAMS // 2:
                    yield out()
                    asked, size = [], 0
        if asked:
            yield out()

    return run


def _grown(short: SuffixTree, entries: np.ndarray) -> SuffixTree:
    """``short`` with the longer contexts of these entries."""
    tree = SuffixTree(short.root, list(short.edges), list(short.states))
    for at in range(SHORT + 1, DEPTH + 1):
        for tables, kind in ((tree.edges, 1), (tree.states, 0)):
            own = entries[(entries["length"] == at) & (entries["edge"] == kind)]
            tables.append(Table(own["k"].copy(), own["v"].copy()))
    return tree


def _added_up(parts: np.ndarray) -> Batches:
    """(row_id, score) of a block's texts. A block's logs come before its symbols, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part, n, packed, ids, lengths in zip(*(batch.column(c) for c in ("part", "n", "data", "ids", "lengths")), strict=True):
                if part.is_valid:
                    held.append(unflat(packed.as_buffer(), n.as_py(), np.int32))
                    continue
                data, lengths = memoryview(pa.decompress(packed.as_buffer(), n.as_py(), codec="zstd")), lengths.values.to_numpy()
                grams, order, _ = _grams_of(data, lengths, parts)
                logs = np.empty(len(grams), dtype=np.int32)
                logs[order] = np.concatenate(held)
                held = []
                del order
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(_sums(data, lengths, grams, logs) / (LOG_UNIT * np.log(10)))], names=["row_id", "score"])

    return run


#: Times this, keys are spread over all their bits.
_SPREAD = _U(0x9E3779B97F4A7C15)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *map(np.arange, starts, ends)])


def _sums(data: memoryview, lengths: np.ndarray, grams: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """For each text of a block the sum of the logs of its grams.

    Positions and grams are sorted by the upper bits of a spread key, with their place in the lower
    bits, so that both come in the same order. The few grams that share those bits are looked up.
    """
    size, skip, starts = len(data) - DEPTH, between(lengths), np.r_[0, np.cumsum(lengths + DEPTH)[:-1]]
    most = min(size, LOOKUP_SYMBOLS)
    bits = _U(max(most, len(grams)).bit_length())
    low = (_U(1) << bits) - _U(1)
    own = (((grams >> _U(8)) | (grams << _U(56))) * _SPREAD & ~low) | np.arange(len(grams), dtype=np.uint64)
    own.sort()
    values = logs[(own & low).astype(np.int64)]
    own >>= bits
    marks = own  # of grams that share one, the first is found
    shared = np.unique(marks[1:][marks[1:] == marks[:-1]])
    sums = np.zeros(len(lengths), dtype=np.int64)
    for at in range(0, size, most):
        end = min(at + most, size)
        none = skip[np.searchsorted(skip, at) : np.searchsorted(skip, end)] - at
        keys = np.empty(end - at, np.uint64)
        for a in range(0, end - at, FEW_SYMBOLS):
            b = min(a + FEW_SYMBOLS, end - at)
            keys[a:b] = raw_of(data[at + a : at + b + DEPTH]) * _SPREAD & ~low | np.arange(a, b, dtype=np.uint64)
        keys[none] = raw_of(data[: DEPTH + 1]) * _SPREAD & ~low | none.astype(np.uint64)
        keys.sort()
        of = np.empty(end - at, dtype=np.int32)
        for a in range(0, end - at, FEW_SYMBOLS):
            place, own = keys[a : a + FEW_SYMBOLS] & low, keys[a : a + FEW_SYMBOLS] >> bits
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            here = slice(np.searchsorted(marks, own[0]), np.searchsorted(marks, own[-1], "right"))  # few, so that the search stays in the cache
            of[place.astype(np.int64)] = np.repeat(values[here][np.searchsorted(marks[here], own[first])], np.diff(first, append=len(own)))
        if len(shared):
            there = (keys[_ranges(np.searchsorted(keys, shared << bits), np.searchsorted(keys, (shared << bits) | low, "right"))] & low).astype(np.int64)
            exact = np.ndarray((end - at,), dtype="<u8", buffer=data[at : end + DEPTH], strides=(1,))[there].astype(np.uint64)
            of[there] = logs[np.minimum(np.searchsorted(grams, _turned(exact)), len(grams) - 1)]
        of[none] = 0
        a, b = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, end)
        sums[a:b] += np.add.reduceat(of, np.maximum(starts[a:b] - at, 0), dtype=np.int64)
    return sums


def _collect(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.toArrow()
    keys, counts = t.column(0).to_numpy().astype(np.int64).view(np.uint64), t.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


class Model:
    """Counts of a training corpus: a tree, and word counts as a bounded table and a DataFrame for the rest."""

    def __init__(self, training: DataFrame, text_col: str = "text", least_share: float = 0.0, word_share: float = WORD_SHARE):
        texts = small_batches(training.select(F.col(text_col).cast("string")))
        stats = stored(texts.mapInArrow(lean(_count), "w binary, g long, n long").groupBy("w", "g").agg(F.sum("n").alias("n")))
        self.words = stats.where("w IS NOT NULL").select("w", "n")
        self.tokens, self.types = self.words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        least = max(1, int(np.ceil(word_share * self.tokens)))
        t = self.words.where(F.col("n") >= least).toArrow()
        self.frequent = dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))
        self.others = self.words.where(F.col("n") < least)
        self.short, self.table, self.slots = self._build(texts, _collect(stats.where("g IS NOT NULL").select("g", "n")), least_share)

    def _build(self, texts: DataFrame, short_grams: tuple[np.ndarray, np.ndarray], least_share: float) -> tuple[SuffixTree, DataFrame, dict[int, int]]:
        """The tree of lengths up to SHORT, the table of the longer ones, and the number of its entries a slot."""
        keys, counts = short_grams
        total = int(counts.sum())
        least = max(LEAST_COUNT, int(np.ceil(least_share * total)))
        root = np.ones(256)
        np.add.at(root, (keys & _U(255)).astype(np.int64), counts)
        short = SuffixTree(np.log(root / root.sum()), [], [])
        grow(short, *_levels(keys, counts, SHORT, 1, least))
        shared = texts.sparkSession.sparkContext.broadcast(short)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, part = Held(), None

            def built() -> Iterator[pa.RecordBatch]:
                if held.size:
                    base = shared.value
                    tree = SuffixTree(base.root, list(base.edges), list(base.states))
                    yield from _entries(grow(tree, *_levels(*held.take(), DEPTH, SHORT + 1, least)))

            for batch in batches:
                for p, n, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if p != part:
                        yield from built()
                        part = p
                    keys, counts = unsqueezed(grams.as_py(), n)
                    held.add(far_first(keys), counts)
            yield from built()

        parts = self.parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_SYMBOLS))
        packed = texts.mapInArrow(lean(_pack(parts)), "part int, n int, grams binary").repartition(parts, "part").sortWithinPartitions("part")
        table = stored(packed.mapInArrow(lean(run), "slot int, n long, data binary"))
        return short, table, {r["slot"]: r["n"] for r in table.groupBy("slot").agg(F.sum("n").alias("n")).collect()}

    def passes(self) -> list[list[int]]:
        """Slots that a task scores grams against, of PASS_ENTRIES entries in all and fewer for a larger corpus, or one slot."""
        most = min(PASS_ENTRIES, -(-sum(self.slots.values()) // self.parts))
        out, size = [[]], 0
        for slot in range(SLOTS):
            own = self.slots.get(slot, 0)
            if out[-1] and size + own > most:
                out.append([])
                size = 0
            out[-1].append(slot)
            size += own
        return out

    def tree_of(self, slots: list[int]) -> SuffixTree:
        """The tree with the longer contexts of these consecutive slots only."""
        t = self.table.where(F.col("slot").between(slots[0], slots[-1])).select("n", "data").toArrow()
        return _grown(self.short, np.concatenate([np.empty(0, _PACKED), *(unflat(data, n, _PACKED) for n, data in zip(*(c.to_pylist() for c in t.columns), strict=True))]))

    @property
    def tree(self) -> SuffixTree:
        return self.tree_of([0, SLOTS - 1])

    def score(self, docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
        """carry columns with n_tokens, n_known, train_tokens, base_score, score for every row."""
        unit = -np.log10(self.tokens + self.types + 1)
        spark = docs.sparkSession
        tidy(spark)
        known = spark.sparkContext.broadcast((pa.array(self.frequent, pa.binary()), np.log10(np.array([*self.frequent.values(), 0]) + 1)))
        rows = docs.select(*carry, F.monotonically_increasing_id().alias("row_id"), F.col(text_col).cast("string").alias("__text"))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
        both = stored(small_batches(rows).mapInArrow(lean(_looked_up(known, len(carry) + 1)), f"{fields}, n_tokens long, n_known long, base double, rest array<binary>, times array<long>, block long, n long, data binary, ids array<long>, lengths array<long>"))
        known.destroy()
        scored, blocks = both.where("block IS NULL"), both.where("block IS NOT NULL")
        total = blocks.count()
        rounds = ROUNDS if total >= ROUND_BLOCKS else 1
        sums = None
        for k in range(rounds):
            own = stored(self._sums_of(blocks.where(F.pmod(F.hash("block"), F.lit(rounds)) == k), -(-total // rounds), rounds))
            tidy(spark)  # the round's grams and logs have been delivered
            sums = own if sums is None else sums.unionByName(own)
        rare = scored.select("row_id", F.inline(F.arrays_zip("rest", "times"))).toDF("row_id", "w", "k")
        worth = self.others.select("w", F.round(F.log10(F.col("n") + 1) * EXACT).cast("long").alias("worth"))
        more = rare.join(worth.hint("shuffle_hash"), "w").groupBy("row_id").agg(F.sum("k").alias("more"), (F.sum(F.col("k") * F.col("worth")) / EXACT).alias("add"))
        return scored.drop("rest", "times", "block", "n", "data", "ids", "lengths").join(sums, "row_id").join(more, "row_id", "left").select(
            *carry,
            "n_tokens",
            (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
            F.lit(self.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("add", F.lit(0.0)) + F.col("n_tokens") * F.lit(float(unit))).alias("base_score"),
            "score",
        )

    def _parts(self) -> np.ndarray:
        """The part of the tree in which each slot is."""
        return np.repeat(np.arange(len(parts := self.passes())), [len(p) for p in parts]).astype(np.uint16)

    def _sums_of(self, blocks: DataFrame, n_blocks: int, rounds: int) -> DataFrame:
        """(row_id, score) of the texts of these blocks, which meet the logs of their grams."""
        n = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * n_blocks)
        met = self._logs(blocks, rounds).withColumns({"ids": F.lit(None).cast("array<long>"), "lengths": F.lit(None).cast("array<long>")})
        met = met.unionByName(blocks.select("block", F.lit(None).cast("int").alias("part"), "n", "data", "ids", "lengths"))
        met = met.repartition(n, "block").sortWithinPartitions("block", F.col("part").asc_nulls_last())
        return met.select("block", "part", "n", "data", "ids", "lengths").mapInArrow(lean(_added_up(self._parts())), "row_id long, score double")

    def _logs(self, blocks: DataFrame, rounds: int) -> DataFrame:
        """(block, part, n, data): logs of a block's distinct grams in order, those of each part of the tree apart."""
        parts = self._parts()
        entries = self.table.mapInArrow(lean(_sent_entries(parts)), _SENT)
        grams = small_batches(blocks.select("block", "n", "data", "lengths")).mapInArrow(lean(_sent_grams(parts)), _SENT)
        n = -(-(int(parts[-1]) + 1) // rounds)
        sent = entries.unionByName(grams).repartition(n, "part").sortWithinPartitions("part", F.col("block").asc_nulls_first())
        shared = blocks.sparkSession.sparkContext.broadcast(self.short)
        return sent.mapInArrow(lean(_answered(shared)), "block long, part int, n long, data binary")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    Learned from the documents that are not held out. Defined cases: null text is empty and scores
    its end alone; a text of any length is learned from and scored whole; a null id counts as empty
    text for the split; repeated rows each give a row and count twice in training; with nothing to
    learn from every symbol has probability 1/256; an empty table gives no rows; other columns are
    ignored, whatever their names. Reruns agree to the last digit.
    """
    rows = docs.select("doc_id", "text", (crc32_residue(F.col("doc_id"), 7) == 2).alias("held_out"))
    return Model(rows.where("NOT held_out")).score(rows, ["doc_id", "held_out"])
