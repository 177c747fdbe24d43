"""Ranked lexical search by Block-Max WAND over an index of document shards.

A shard is a stretch of documents that one task indexes where it reads them, so no text and no
posting is shuffled. For each term of a shard its postings are cut into blocks of BLOCK; a block
keeps its first and last document, the largest impact of its postings, and these, as gaps and
counts in as few bytes as the block allows. Shards are searched in units. For each query a unit's
lists are first walked by their block borders alone: between two borders every list rests on one
block, or on none, and no document of that window can score more than the maxima of these blocks.
Windows under the bar (the k-th best score so far) are passed over, and a block that lies in
passed windows only is never decompressed. The bar rises as the sweep goes on through the unit's
documents, and is handed on to the next unit of the task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marram.llm.common import lean, quoted, small_batches, stored

#: Postings in a block; documents and bytes of text in a shard; documents and terms in a unit of shards.
BLOCK, SHARD_DOCS, SHARD_BYTES, UNIT_DOCS, UNIT_TERMS = 128, 16_384, 16 << 20, 65_536, 1 << 23

#: Queries and distinct terms that are searched together; what is beyond forms further batches.
BATCH_QUERIES, BATCH_TERMS = 1000, 200_000

#: Documents of live windows that are scored before the bar is looked at again, and those that open a sweep.
STRIDE, OPENING = 4096, 256

#: Fixed values of the contract: terms, in Java's pattern language.
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The same by bytes: what separates terms becomes a space, A-Z becomes lower case, bytes of other letters stay.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_DOCUMENT = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("length", "<u4")])
_POSTING = {(g, t): np.dtype([("gap", f"<u{g}"), ("tf", f"<u{t}")]) for g in (1, 2, 4) for t in (1, 2, 4)}

INDEX = "shard long, term binary, first int, last int, n int, impact long, gap_bytes byte, tf_bytes byte, data binary"
_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("n", pa.int32()), ("impact", pa.int64()), ("gap_bytes", pa.int8()), ("tf_bytes", pa.int8()), ("data", pa.binary())])


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def saturation(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of an impact that depends on the document, in 64-bit integers."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * length * n_docs) // n_terms))


def _bytes_for(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def _shard_rows(shard: int, ids: list, lengths: list[int], terms: list[pa.Array], counts: list[np.ndarray], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """A shard's row of documents (no term, their total length for an impact), then its blocks in order of term."""
    documents = np.zeros(len(ids), _DOCUMENT)
    documents["doc_id"], documents["known"], documents["length"] = [i or 0 for i in ids], [i is not None for i in ids], lengths
    coded = pa.chunked_array(terms).combine_chunks().dictionary_encode()
    order_of_terms = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order_of_terms), np.int64)
    place[order_of_terms] = np.arange(len(place))
    code = place[coded.indices.to_numpy()]
    order = np.argsort(code, kind="stable")
    code = code[order]
    doc = np.repeat(np.arange(len(ids)), [len(c) for c in counts])[order]
    tf = np.concatenate(counts)[order]
    new_term = np.diff(code, prepend=-1) != 0
    in_term = np.arange(len(code)) - np.flatnonzero(new_term)[np.cumsum(new_term) - 1]
    starts = np.flatnonzero(in_term % BLOCK == 0)
    sizes = np.diff(starts, append=len(code))
    gap = np.diff(doc, prepend=0)
    gap[starts] = 0
    impact = np.maximum.reduceat(saturation(tf, documents["length"].astype(np.int64)[doc], n_docs, n_terms), starts)
    gap_bytes, tf_bytes = _bytes_for(np.maximum.reduceat(gap, starts)), _bytes_for(np.maximum.reduceat(tf, starts))
    packed, of = [], []
    for (g, t), form in _POSTING.items():
        blocks = np.flatnonzero((gap_bytes == g) & (tf_bytes == t))
        if not len(blocks):
            continue
        inside = np.repeat((gap_bytes == g) & (tf_bytes == t), sizes)
        postings = np.empty(int(inside.sum()), form)
        postings["gap"], postings["tf"] = gap[inside], tf[inside]
        ends = np.concatenate([[0], np.cumsum(sizes[blocks] * form.itemsize)]).astype(np.int32)
        packed.append(pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer(ends), pa.py_buffer(postings.tobytes())]))
        of.append(blocks)
    data = pa.concat_arrays(packed).take(pa.array(np.argsort(np.concatenate(of))))
    head = [[shard], [None], [0], [len(ids) - 1], [len(ids)], [int(sum(lengths))], [0], [0], [documents.tobytes()]]
    body = [np.full(len(starts), shard), coded.dictionary.take(pa.array(order_of_terms[code[starts]])), doc[starts], doc[starts + sizes - 1], sizes, impact, gap_bytes, tf_bytes, data]
    columns = [pa.concat_arrays([pa.array(h, f.type), b if isinstance(b, pa.Array) else pa.array(b.astype(f.type.to_pandas_dtype()))]) for f, h, b in zip(_ARROW, head, body, strict=True)]
    return pa.record_batch(columns, schema=_ARROW)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, a stored table that can be kept: a row for each shard's documents and for each block.

    Two readings of the texts: one adds up documents and terms, which impacts depend on, one
    indexes. Every row with a term is indexed as a document of its own, rows that repeat an id or
    have none too; a null text has no terms. Memory of a task is bounded by one shard, and a text
    of more than SHARD_BYTES is a shard of its own.
    """
    rows = small_batches(docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text")))
    n = F.regexp_count("text", F.lit(TERMS))
    n_docs, n_terms = rows.select(n.alias("n")).where("n > 0").agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, size, parts = TaskContext.get().partitionId() << 32, 0, ([], [], [], [])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                counts = Counter(terms_of(text.as_py() or b""))
                if not counts:
                    continue
                if parts[0] and (len(parts[0]) == SHARD_DOCS or size + len(text.as_py()) > SHARD_BYTES):
                    yield _shard_rows(shard, *parts, n_docs, n_terms)
                    shard, size, parts = shard + 1, 0, ([], [], [], [])
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                for part, value in zip(parts, (doc_id, int(tf.sum()), pa.array(list(counts), pa.binary()), tf), strict=True):
                    part.append(value)
                size += len(text.as_py())
        if parts[0]:
            yield _shard_rows(shard, *parts, n_docs, n_terms)

    return stored(rows.mapInArrow(run, INDEX))


@dataclass
class Best:
    """A query's best documents so far, best first: scores, whether the id is known, ids."""

    k: int
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def bar(self) -> int:
        """What a document must score at least: an equal score may have the smaller id."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def take(self, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        scores, known, ids = np.concatenate([self.scores, scores]), np.concatenate([self.known, known]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, known, -scores))[: self.k]
        self.scores, self.known, self.ids = scores[order], known[order], ids[order]


class Unit:
    """The documents of some shards under one numbering, and the blocks of the batch's terms, by term and then by document."""

    def __init__(self, rows: pa.Table, n_docs: int, n_terms: int):
        is_block = pc.is_valid(rows["term"])
        shards = rows.filter(pc.invert(is_block)).sort_by("shard")
        documents = np.concatenate([np.frombuffer(d, _DOCUMENT) for d in shards["data"].to_pylist()])
        self.ids, self.known = documents["doc_id"], documents["known"].astype(np.int64)
        self.lengths = documents["length"].astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(shards["n"].to_numpy())])
        blocks = rows.filter(is_block).sort_by([("term", "ascending"), ("shard", "ascending"), ("first", "ascending")])
        offset = offsets[np.searchsorted(shards["shard"].to_numpy(), blocks["shard"].to_numpy())]
        self.first, self.end = blocks["first"].to_numpy() + offset, blocks["last"].to_numpy() + offset + 1
        self.impact, self.n = blocks["impact"].to_numpy(), blocks["n"].to_numpy().astype(np.int64)
        self.form = blocks["gap_bytes"].to_numpy().astype(np.int64) * 8 + blocks["tf_bytes"].to_numpy()
        self.data, self.totals = blocks["data"].combine_chunks(), (n_docs, n_terms)
        coded = blocks["term"].combine_chunks().dictionary_encode()
        ends = np.searchsorted(coded.indices.to_numpy(), np.arange(len(coded.dictionary)), "right")
        self.lists = {t: (int(a), int(b)) for t, a, b in zip(coded.dictionary.to_pylist(), np.concatenate([[0], ends])[: len(ends)], ends, strict=True)}
        self.opened = 0

    def open(self, blocks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the blocks' postings and their impacts, each by its block's weight."""
        self.opened += len(blocks)
        docs, impacts = [], []
        for form in np.unique(self.form[blocks]):
            some = self.form[blocks] == form
            here, sizes = blocks[some], self.n[blocks[some]]
            postings = np.frombuffer(b"".join(self.data.take(pa.array(here)).to_pylist()), _POSTING[form // 8, form % 8])
            walked = np.cumsum(postings["gap"].astype(np.int64))
            starts = np.cumsum(sizes) - sizes
            doc = walked + np.repeat(self.first[here] - walked[starts], sizes)
            docs.append(doc)
            impacts.append(np.repeat(weights[some], sizes) * saturation(postings["tf"].astype(np.int64), self.lengths[doc], *self.totals))
        return np.concatenate(docs), np.concatenate(impacts)

    def search(self, terms: list[tuple[bytes, int]], best: Best) -> None:
        """Take into ``best`` whatever of this unit's documents belongs there; ``terms`` have weights over 0."""
        lists = [(self.lists[t], w) for t, w in terms if t in self.lists]
        if not lists:
            return
        blocks = np.concatenate([np.arange(a, b) for (a, b), _ in lists])
        weights = np.repeat([w for _, w in lists], [b - a for (a, b), _ in lists])
        # Shallow moves: all lists' block borders, and what a document between two of them can score at most.
        borders = np.unique(np.concatenate([self.first[blocks], self.end[blocks]]))
        enters, leaves = np.searchsorted(borders, self.first[blocks]), np.searchsorted(borders, self.end[blocks])
        change = np.zeros(len(borders), np.int64)
        np.add.at(change, enters, weights * self.impact[blocks])
        np.subtract.at(change, leaves, weights * self.impact[blocks])
        ceiling, widths = np.cumsum(change)[:-1], np.diff(borders)
        scores, base = np.zeros(int(borders[-1] - borders[0]), np.int64), int(borders[0])
        closed, waiting = np.ones(len(blocks), bool), np.ones(len(widths), bool)

        def score(windows: np.ndarray) -> None:
            chosen = np.zeros(len(widths), bool)
            chosen[windows] = True
            waiting[windows] = False
            before = np.concatenate([[0], np.cumsum(chosen)])
            needed = closed & (before[leaves] > before[enters])
            closed[needed] = False
            if needed.any():
                docs, impacts = self.open(blocks[needed], weights[needed])
                np.add.at(scores, docs - base, impacts)
            able = np.flatnonzero(np.repeat(chosen, widths) & (scores >= best.bar))
            if len(able):
                found = able + base
                best.take(scores[able], self.known[found], self.ids[found])

        if len(best.scores) < best.k:
            # The most promising windows give the sweep a bar to start with.
            promising = np.argsort(-ceiling, kind="stable")
            score(promising[: np.searchsorted(np.cumsum(widths[promising]), OPENING) + 1])
        while len(live := np.flatnonzero(waiting & (ceiling >= best.bar))):
            score(live[: np.searchsorted(np.cumsum(widths[live]), STRIDE) + 1])


@dataclass
class Batch:
    """Queries that are searched together: (item id, its terms with their counts)."""

    items: list[tuple[int | None, Counter]] = field(default_factory=list)
    terms: set[bytes] = field(default_factory=set)


def _batches(items: DataFrame) -> Iterator[Batch]:
    """Batches of bounded size, read one partition of ``items`` at a time."""
    batch = Batch()
    for row in items.toLocalIterator():
        counts = Counter(terms_of((row["text"] or "").encode()))
        if batch.items and (len(batch.items) == BATCH_QUERIES or len(batch.terms | counts.keys()) > BATCH_TERMS):
            yield batch
            batch = Batch()
        batch.items.append((row["item_id"], counts))
        batch.terms |= counts.keys()
    if batch.items:
        yield batch


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


RESULT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def _search_batch(index: DataFrame, batch: Batch, k: int, n_docs: int, n_terms: int) -> DataFrame:
    spark = index.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(bytearray(t),) for t in sorted(batch.terms)], "term binary"))  # BATCH_TERMS rows at most, but for one query's own
    blocks = index.join(wanted, "term")
    df = {bytes(r["term"]): r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    weights = {t: w for t, n in df.items() if (w := weight(n_docs, n)) > 0}
    queries = [(item_id, [(t, c * weights[t]) for t, c in sorted(counts.items()) if t in weights]) for item_id, counts in batch.items]
    units = max(1, math.ceil(n_docs / UNIT_DOCS), math.ceil(n_terms / UNIT_TERMS))
    rows = blocks.select(index.columns).unionByName(index.where("term IS NULL"))
    rows = rows.withColumn("unit", F.pmod(F.xxhash64("shard"), F.lit(units))).repartition(units, "unit").sortWithinPartitions("unit")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]

        def search(held: list[pa.RecordBatch]) -> None:
            unit = Unit(pa.Table.from_batches(held), n_docs, n_terms)
            for (_, terms), found in zip(queries, best, strict=True):
                unit.search(terms, found)

        held, now = [], None
        for batch in batches:
            of = batch.column("unit").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and of[a] != now:
                    search(held)
                    held = []
                now = of[a]
                held.append(batch.slice(a, b - a))
        if held:
            search(held)
        for q, ((item_id, _), found) in enumerate(zip(queries, best, strict=True)):
            if n := len(found.scores):
                ids = pa.array(found.ids, mask=found.known == 0)
                yield pa.record_batch([pa.array([q] * n), pa.array([item_id] * n, pa.int64()), ids, pa.array(found.scores)], ["query", "item_id", "doc_id", "score"])

    found = small_batches(rows).mapInArrow(run, "query long, item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(index: DataFrame, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents of the index with a score over 0.

    Items are searched in batches whose number of queries and terms is bounded; the driver holds one
    batch at a time. Defined cases: a null or empty item has no results; items that repeat an id are
    ranked each by itself; equal scores go by ascending id, null first; documents that repeat an id
    are listed each; an empty index or table of items gives no rows; texts are read whole.
    """
    spark = index.sparkSession
    n_docs, n_terms = index.where("term IS NULL").agg(F.sum("n"), F.sum("impact")).first()
    if not n_docs:
        return spark.createDataFrame([], RESULT)
    items = items.select(quoted(id_col).cast("long").alias("item_id"), quoted(text_col).alias("text"))
    results, last = [], None
    for batch in _batches(items):
        if last is not None:
            results.append(stored(last))
        last = _search_batch(index, batch, k, n_docs, n_terms)
    if last is not None:
        results.append(last if not results else stored(last))
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], RESULT)


def ranked_search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Index ``docs`` and rank them for every item."""
    return search(build_index(docs), items, k)
