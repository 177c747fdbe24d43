"""Exact top-k inner-product search on an impact-ordered, score-at-a-time index.

Vectors are integers. The index keeps rows in shards; in a shard every dimension has posting
segments, one per quantised impact (size of the component). A query processes the segments from
the highest impact, times its own component, down, adding to one accumulator a row. What is left
of a row's score is at most (norm of the row's unprocessed part) * (norm of the query over the
same dimensions), by Cauchy-Schwarz; a row whose accumulator plus that cannot reach the bar, the
k-th best score that is sure by now, is proven out and its later postings are passed over. When
few rows are left, or the last step is done, those left are rescored exactly. Integers beyond what
doubles multiply safely are held with a power of two taken off, a shard and a query block each with
its own, and rescored whole. Nothing is dropped
without that proof. The bar starts from exact scores against one shard, whose rows are candidates
too. The opening step runs as matrix products for a block of queries, the later ones by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.llm.common import small_batches, stored

#: Components of a shard and rows at most, queries of a block, impact levels of a shard, and shards of a unit on average.
SHARD_CELLS, SHARD_ROWS, QUERY_ROWS, LEVELS, UNIT_SHARDS = 1 << 18, 4096, 256, 8, 8
#: Shares of a shard's postings that a query has come through after each step, each followed by proofs, until this many rows are left: rescoring them costs less than another step.
SHARES, RESCORE = (0.35, 0.5, 0.6, 0.7, 0.85), 64
SCALE = 256.0
_EXACT = float(1 << 53)
#: Bits that integers of a block keep before a power of two is taken off: products of sums of their squares stay inside doubles.
BITS = 230


def whole_vector(vector: Column) -> Column:
    """The components as doubles; null where the vector is null or holds null, NaN or infinity."""
    double = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), double)


def matrix(rows: list[list[float]], width: int) -> tuple[np.ndarray, int]:
    """floor(256 * x) of the rows as one matrix of doubles and a shift: integers are the doubles times 2 ** shift, exactly. Shorter rows are filled up with zeros."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    # A double is at most 2 ** 1024, and 256 times one that large is whole already.
    shift = max(0, int(np.frexp(np.abs(out).max(initial=0))[1]) + 8 - BITS)
    small = np.abs(out) < 2.0**45
    whole = np.where(small, np.floor(np.where(small, out, 0.0) * SCALE) / SCALE, out)
    return np.ldexp(whole, 8 - shift), shift


def exact_scores(rows: np.ndarray, queries: np.ndarray, shifts: tuple[int, int] = (0, 0)) -> list[int]:
    """Integer products of paired rows, exact at any size."""
    if not rows.size:
        return [0] * len(rows)
    most = float(np.abs(rows).max()) * float(np.abs(queries).max()) * rows.shape[1]
    if most < _EXACT and not any(shifts):
        return (rows * queries).sum(axis=1).astype(np.int64).tolist()

    def whole(values: np.ndarray, shift: int) -> np.ndarray:
        ratios = np.frompyfunc(lambda x: x.as_integer_ratio(), 1, 1)(values)
        return np.frompyfunc(lambda r: (r[0] << shift) // r[1], 1, 1)(ratios)

    return (whole(rows, shifts[0]) * whole(queries, shifts[1])).sum(axis=1).tolist()


def packed_matrix(m: np.ndarray, shift: int) -> tuple[str, bytes]:
    """The smallest kind of number that holds a matrix, and its bytes."""
    top = float(np.abs(m).max(initial=0))
    kind = "<f8" if shift else "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return kind, m.astype(kind).tobytes()


def sort_key(score: int) -> bytes:
    """Bytes that compare as the scores do, whatever their sizes: a sign, the length, and the digits (inverted below zero)."""
    size = abs(score)
    digits = size.to_bytes((size.bit_length() + 7) // 8, "big")
    body = len(digits).to_bytes(4, "big") + digits
    return b"\1" + body if score >= 0 else b"\0" + bytes(255 - b for b in body)


class Shard:
    """Impact levels of some rows, and how many postings each segment (level, dimension) has."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, shift: int = 0):
        self.ids, self.rows, self.shift = ids, rows, shift
        size = np.abs(rows)
        # Level edges are quantiles of the impacts: segments hold about as many postings each.
        inside = np.quantile(size, np.linspace(1, 0, LEVELS + 1)[1:-1]) if size.size else np.zeros(0)
        edges = np.unique(inside)[::-1]
        self.level = np.searchsorted(-edges, -size, side="right").astype(np.int8) if size.size else np.zeros(size.shape, np.int8)
        self.width = rows.shape[1]
        self.tops = np.concatenate(([size.max(initial=0)], edges))
        self.postings = np.array([((self.level == v) & (rows != 0)).sum(axis=0) for v in range(len(self.tops))])
        self.square = (rows**2).sum(axis=1)


class Best:
    """The k best (score, id) of a query so far; ties go to the smaller id."""

    def __init__(self, k: int, bar: float = -np.inf):
        self.k, self.rows, self.sure = k, [], bar

    @property
    def bar(self) -> float:
        """A score under which a row cannot enter."""
        return self.under(0)

    def under(self, shift: int) -> float:
        """The bar in units of 2 ** shift."""
        sure = math.ldexp(self.sure, -shift) if math.isfinite(self.sure) else self.sure
        if len(self.rows) < self.k:
            return sure
        last = self.rows[-1][0] >> shift
        return max(sure, float(last) if last.bit_length() < 1000 else -math.inf)

    def add(self, scores: list[int], ids: np.ndarray) -> None:
        self.rows = sorted([*self.rows, *zip(scores, ids.tolist(), strict=True)], key=lambda r: (-r[0], r[1]))[: self.k]


def search_shard(shard: Shard, q_ids: np.ndarray, queries: np.ndarray, bests: list[Best], shift: int = 0) -> int:
    """Bring the bests of a block of queries up to date with the rows of a shard; the number of postings that took.

    ``shift`` is the queries'; bounds are kept in units of both shifts.
    """
    shifts = (shard.shift, shift)
    n, levels = len(shard.ids), len(shard.tops)
    # Sums of up to that size are exact in single precision, or in double; beyond it, slack covers rounding.
    top = float(shard.square.max(initial=0)) + float((queries**2).sum(axis=1).max(initial=0))
    kind, loose = (np.float32, 1e-6) if top < 1 << 24 else (np.float64, 1e-12)
    slack = 1e-3 if top < 1 << 24 else 0.5 if top < _EXACT else 1e-12 * top
    rows, q, tops = shard.rows.astype(kind), queries.astype(kind), shard.tops.astype(kind)
    size, q_square = np.abs(q), q**2
    reach = (tops[None, :, None] * size[:, None, :]).reshape(len(q), -1)
    order = np.argsort(-reach, axis=1, kind="stable")
    done = np.cumsum(shard.postings.ravel()[order], axis=1)
    ends = [np.take_along_axis(reach, np.take_along_axis(order, np.argmax(done >= share * done[:, -1:], axis=1)[:, None], 1), 1)[:, 0] if reach.size else np.zeros(len(q), kind) for share in SHARES]

    def room(row_left: np.ndarray, query_left: np.ndarray) -> np.ndarray:
        return np.sqrt((np.maximum(row_left, 0) + slack) * (np.maximum(query_left, 0) + slack)) * kind(1 + loose) + kind(slack)

    def bar_of(low: np.ndarray, best: Best, bar: float) -> float:
        return max(bar, float(np.partition(low, len(low) - best.k)[len(low) - best.k])) if len(low) >= best.k else bar

    taken = (reach >= ends[0][:, None]).astype(kind)
    segments = np.concatenate([np.where(shard.level == v, rows, kind(0)) for v in range(levels)], axis=1)
    mine = taken * np.tile(q, (1, levels))
    acc = segments @ mine.T
    row_left = shard.square.astype(kind)[:, None] - segments**2 @ taken.T
    query_left = q_square.sum(axis=1)[None, :] - (segments != 0).astype(kind) @ (mine**2).T
    work = int((taken @ shard.postings.ravel().astype(np.float64)).sum())
    space = room(row_left, query_left)
    high, low = acc + space, acc - space
    others = shard.ids[:, None] != q_ids[None, :]
    for j, best in enumerate(bests):
        at = np.flatnonzero(others[:, j])
        bar = bar_of(low[at, j], best, best.under(sum(shifts)))
        at = at[high[at, j] >= bar]
        own, left, q_left = acc[at, j], row_left[at, j], query_left[at, j]
        for before, end in zip(ends, ends[1:]):
            if len(at) <= RESCORE:
                break
            part = rows[at]
            reached = tops[shard.level[at]] * size[j][None, :]
            now = (reached < before[j]) & (reached >= end[j]) & (part != 0)
            part = np.where(now, part, kind(0))
            work += int(now.sum())
            own = own + part @ q[j]
            left = left - np.einsum("ij,ij->i", part, part)
            q_left = q_left - now.astype(kind) @ q_square[j]
            space = room(left, q_left)
            bar = bar_of(own - space, best, bar)
            stay = own + space >= bar
            at, own, left, q_left = at[stay], own[stay], left[stay], q_left[stay]
        work += int((shard.rows[at] != 0).sum())
        best.add(exact_scores(shard.rows[at], np.broadcast_to(queries[j], (len(at), shard.width)), shifts), shard.ids[at])
    return work


def _packed(most: int, cells: int):
    """Rows (id, vector) as blocks of at most that many rows and components (but one row at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[list[float]] = []
        width = 0

        def block() -> pa.RecordBatch:
            m, shift = matrix(rows, width)
            kind, data = packed_matrix(m, shift)
            columns = [pa.array([len(ids)], pa.int64()), pa.array([width], pa.int64()), pa.array([shift], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([kind]), pa.array([data], pa.binary())]
            ids.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["n", "width", "shift", "ids", "kind", "data"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (len(ids) == most or (len(ids) + 1) * max(width, len(v)) > cells):
                    yield block()
                    width = 0
                width = max(width, len(v))
                ids.append(i)
                rows.append(v)
        if ids:
            yield block()

    return run


_BLOCK = "n long, width long, shift long, ids binary, kind string, data binary"


def _unpack(r: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["data"], dtype=r["kind"]).reshape(r["n"], r["width"]).astype(np.float64)


def _widened(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))) if rows.shape[1] < width else rows


def _with_bars(sample: dict | None, k: int):
    """Adds to each query block the k-th best score of its queries among the sample's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s_ids, s_rows = _unpack(sample) if sample else (np.zeros(0, np.int64), np.zeros((0, 0)))
        for batch in batches:
            bars = []
            for r in batch.to_pylist():
                ids, rows = _unpack(r)
                width = max(rows.shape[1], s_rows.shape[1])
                queries, others = _widened(rows, width), _widened(s_rows, width)
                found = queries @ others.T
                found[ids[:, None] == s_ids[None, :]] = -np.inf
                top = np.partition(found, len(s_ids) - k, axis=1)[:, len(s_ids) - k] if len(s_ids) >= k else np.full(len(ids), -np.inf)
                # Products are rounded where they are beyond 53 bits; the bar gives way by more than that.
                most = float(np.abs(queries).max(initial=0)) * float(np.abs(others).max(initial=0)) * max(1, width)
                sure = top - (0.0 if most < _EXACT else 1e-12 * most)
                # Where a power of two is taken off, there is no bar to start from.
                bars.append((np.full(len(ids), -np.inf) if r["shift"] or (sample and sample["shift"]) else sure).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bars, pa.binary())], names=[*batch.schema.names, "bars"])

    return run


#: The range of 64-bit integers.
LONGS = (-(2**63), 2**63 - 1)


def _search(k: int):
    """Rows of a partition sorted by (unit, query): a unit's shards come first and are held, its query blocks stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, shards = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}
                if r["unit"] != unit:
                    unit, shards = r["unit"], []
                ids, rows = _unpack(r)
                if not r["query"]:
                    shards.append(Shard(ids, rows, r["shift"]))
                    continue
                bests = [Best(k, float(bar)) for bar in np.frombuffer(r["bars"])]
                for at, s in enumerate(shards):
                    width = max(s.width, rows.shape[1])
                    if s.width < width:
                        s = shards[at] = Shard(s.ids, _widened(s.rows, width), s.shift)
                    search_shard(s, ids, _widened(rows, width), bests, r["shift"])
                out = [(q, i_, max(min(s_, LONGS[1]), LONGS[0]), str(s_), sort_key(s_)) for q, best in zip(ids.tolist(), bests, strict=True) for s_, i_ in best.rows]
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["query_id", "vec_id", "score", "exact_score", "place"])

    return run


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The index as a table of shards (n, width, ids, kind, data); it can be written and searched again later."""
    return _rows(vectors, id_col, vector_col).mapInArrow(_packed(SHARD_ROWS, SHARD_CELLS), _BLOCK)


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = small_batches(vectors).select(F.col(id_col).cast("long").alias("vec_id"), whole_vector(F.col(vector_col)).alias("v"))
    return rows.where("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v"))


def search(index: DataFrame, queries: DataFrame, k: int = 5, sample: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score, exact_score: the k best rows of an index for each query (vec_id, v).

    Shards are dealt to units of about UNIT_SHARDS, so a task holds a bounded part of the index; the
    query blocks are copied to each unit and stream through it one by one, however many there are.
    """
    count = index.count()
    units = max(1, -(-count // UNIT_SHARDS), min(index.sparkSession.sparkContext.defaultParallelism, count))
    shards = index.select(F.pmod(F.xxhash64("ids"), F.lit(units)).alias("unit"), F.lit(False).alias("query"), *_BLOCK.replace(",", "").split()[::2], F.lit(None).cast("binary").alias("bars"))
    blocks = queries.mapInArrow(_packed(QUERY_ROWS, SHARD_CELLS), _BLOCK).mapInArrow(_with_bars(sample, k), _BLOCK + ", bars binary")
    blocks = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(units - 1).cast("long"))).alias("unit"), F.lit(True).alias("query"), "n", "width", "shift", "ids", "kind", "data", "bars")
    met = shards.unionByName(blocks).repartition(units, "unit").sortWithinPartitions("unit", "query")
    found = small_batches(met).mapInArrow(_search(k), "query_id long, vec_id long, score long, exact_score string, place binary")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("place"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "exact_score")


def top_k(vectors: DataFrame, query_ids: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, exact_score: the k best rows of each query, every row but the query's own.

    query_ids: a condition on the column ``vec_id`` that tells the queries. Defined cases: rows with
    a null id or vector, or with null or non-finite components, take no part; shorter vectors are
    filled up with zeros; rows that repeat an id count once, with the smallest of their vectors;
    ties go to the smaller id; fewer than k candidates are all returned; an empty table gives no
    rows; other columns are ignored. Scores are exact integers at any size and ranked as such;
    score is held to 64 bits, exact_score has all digits (a string), for any finite components.
    A row is one value, however wide; shards and query blocks hold a bounded number of components.
    """
    index = stored(build_index(vectors, id_col, vector_col))
    rows = _rows(vectors, id_col, vector_col)
    largest = index.agg(F.max(F.struct("n", F.xxhash64("ids").alias("h")))).first()[0]
    sample = index.where(F.xxhash64("ids") == largest["h"]).first().asDict() if largest else None
    return search(index, rows.where(query_ids), k, sample)
