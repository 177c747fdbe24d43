"""Near-duplicate detection with SuperMinHash.

1. Each text becomes the set of its distinct 5-word shingles. A shingle is its 64-bit hash: two
   shingles of a corpus' pair of texts share one with a probability of about 1e-19 a pair of shingles.
   Texts with the same set form a class, which is represented by its smallest id, so exact copies
   cost one row.
2. SuperMinHash: element i has a pseudorandom permutation of the m places, drawn step by step; in
   step j it offers place p_i(j) the value j + r_ij. Places keep their smallest value. When every
   place of a set holds a value under j + 1, later steps cannot change it and the set stops, for
   sets over m elements after a step or two.
3. Banding: rows of the signature make bucket keys. Members of a bucket are candidates of one
   pivot, its smallest id; the pairs that look alike best are verified on the full sets.
4. Verified links are merged by union-find. In buckets that still hold several components, pairs
   across components are compared by signature, in blocks that split large buckets; pairs that may
   reach the threshold tie their documents into loose groups, and within these such pairs are
   verified on full sets, again block by block. So no pair that shares a bucket goes unjudged, and
   no step gives a row for each pair of a group. A bucket of very many open rows is divided
   first, by the rarest values in its rows' signatures, so that the same pairs are judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marram.llm.common import cut, fresh, last_stored, lean, scratch, small_batches, spread_join, stored, tidy
from marram.llm.components import components

WORDS_A_SHINGLE = 5
PLACES, ROWS = 128, 4
BANDS = PLACES // ROWS
#: Similarity of links, in hundredths.
LEAST_PERCENT = 75
#: Signatures that agree on less cannot belong to a link, but for 4.4 standard deviations of the estimate.
LEAST_ESTIMATE = LEAST_PERCENT / 100 - 4.4 * (LEAST_PERCENT / 100 * (1 - LEAST_PERCENT / 100) / PLACES) ** 0.5
#: Pivots a member is verified against at first; what they leave open is settled across components.
FIRST_PIVOTS = 2
#: Rows of a bucket that are compared at once, against as many, and rows from which a bucket is divided by rare places: until there, blocks copy fewer rows.
BLOCK = 8192
REBAND = BLOCK * BANDS
#: Where full sets are at hand, as many rows, of as many shingles (8 bytes each), and pairs that one copy of a pivot's set serves.
SET_BLOCK, SET_SHINGLES, PIVOT_PAIRS = 512, 2_000_000, 2000
#: Shingles that go through the permutation table at once.
ELEMENTS = 50_000
#: Rows up to which a hot class, pivot, bucket or group is no burden for one task.
FEW_ROWS = 200_000
#: Places of the hashed semi-join that is broadcast ahead of an exact join.
FILTER_PLACES = 1 << 20

_U = np.uint64
_STEP, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; fewer than five words make one shingle, none make none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WORDS_A_SHINGLE, len(words))
    n = len(words) - width + 1
    out = np.full(n, _U(width), dtype=np.uint64)
    for k in range(width):
        out = mixed(out * _STEP + hashes[k : k + n])
    return np.unique(out)


def superminhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures (sets x places); values of step j lie in [j, j + 1) * 2^32. Empty sets keep the largest value."""
    table = np.full((len(sets), places), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = table.reshape(-1)
    at = 0
    while at < len(sets):
        group, size = [], 0
        while at < len(sets) and (size + len(sets[at]) <= ELEMENTS or not group):
            group.append(at)
            size += len(sets[at])
            at += 1
        # A set over ELEMENTS is a group of its own and goes through in parts; each lowers the same row.
        all_x = np.concatenate([sets[i] for i in group])
        all_owner = np.repeat(np.array(group, dtype=np.int64), [len(sets[i]) for i in group])
        for part in range(0, len(all_x), ELEMENTS):
            x, owner = all_x[part : part + ELEMENTS], all_owner[part : part + ELEMENTS]
            order = np.tile(np.arange(places, dtype=np.int16), (len(x), 1))
            live = np.arange(len(x))
            for j in range(places):
                drawn = mixed(x[live] + _U((j + 1) * int(_STEP) % (1 << 64)))
                k = j + ((drawn >> _U(32)) * _U(places - j) >> _U(32)).astype(np.int64)
                place = order[live, k]
                order[live, k] = order[live, j]
                np.minimum.at(flat, owner[live] * places + place, (_U(j) << _U(32)) | (drawn & _U(0xFFFFFFFF)))
                owners = np.unique(owner[live])
                open_ = owners[table[owners].max(axis=1) >= _U(j + 1) << _U(32)]
                if not len(open_):
                    break
                if len(open_) < len(owners):
                    live = live[np.isin(owner[live], open_)]
    return table


def band_keys(table: np.ndarray) -> np.ndarray:
    """Bucket keys (sets x bands) as signed integers; the low five bits tell the band."""
    keys = np.zeros((len(table), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        keys = mixed(keys * _STEP + table[:, r::ROWS][:, :BANDS])
    return ((keys & ~_U(31)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_key", "n_shingles", "d1", "d2", "sig", "bands"]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [shingle_set(x.as_py()) for x in part.column(1)]
            digests = np.array([xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets], dtype=object)
            halves = np.array([[d >> 64, d & 0xFFFFFFFFFFFFFFFF] for d in digests], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            table = superminhash(sets)
            small = (table & _U(0xFF)).astype(np.uint8)
            keys = band_keys(table)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    pa.array([row.tobytes() for row in small], pa.binary()),
                    pa.array([row if len(s) else [] for row, s in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
                ],
                names=names,
            )
    _HASHES.clear()  # a worker outlives its task, and other stages need the memory


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, d1, d2 (digest of the set), sig binary, bands array<long> for every row."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return small_batches(rows).mapInArrow(lean(_sign), "doc_id long, text_key long, n_shingles long, d1 long, d2 long, sig binary, bands array<long>")


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def estimate(agree: np.ndarray) -> np.ndarray:
    """Similarity from the share of signature bytes that agree; unequal values agree once in 256."""
    return (agree - 1 / 256) / (1 - 1 / 256)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        similar = estimate((_bytes(batch.column(2)) == _bytes(batch.column(3))).mean(axis=1))
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar, pa.float64())], names=["a", "b", "similar"])
        yield out.filter(pa.array(similar >= LEAST_ESTIMATE))


def sizes_allow(n: str = "n", m: str = "m"):
    return 100 * F.least(n, m) >= LEAST_PERCENT * F.greatest(n, m)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())], names=["id", "members"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from rows (b, unit, member, id, members) that are sorted by unit, a pivot's own set before its members'."""
    at, pivot = None, np.zeros(0, np.uint64)
    for batch in batches:
        links: list[tuple[int, int]] = []
        for i in range(batch.num_rows):
            b, unit, member, a = (batch.column(c)[i].as_py() for c in range(4))
            own = np.frombuffer(batch.column(4)[i].as_py(), dtype=np.uint64)
            if not member:
                at, pivot = (b, unit), own.copy()
            elif at == (b, unit) and similar_sets(own, pivot):
                links.append((a, b))
        a, b = zip(*links, strict=True) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def full_sets(wanted: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, members binary) of the wanted nodes (id). texts: doc_id, text, text_key of all rows; reps tells each node's row.

    Texts are first thinned by a hashed semi-join of at most FILTER_PLACES broadcast rows, so that
    hardly more than the texts in question are shuffled; the join that follows is exact.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_PLACES)).cast("int")
    of = wanted.join(reps.select("id", "doc_id", "text_key"), "id")
    places = of.select(place("doc_id").alias("place")).distinct()
    thinned = texts.join(F.broadcast(places), place("doc_id") == places["place"], "left_semi")
    met = thinned.join(of, ["doc_id", "text_key"]).groupBy("doc_id", "text_key", "id").agg(F.first("text").alias("text"))
    return stored(met.select("id", "text").mapInArrow(lean(_sets), "id long, members binary"))


def verify(pairs: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet the threshold.

    A pivot b with many pairs is copied to one unit per PIVOT_PAIRS of them; in a unit its set is
    there once and the members' sets stream by it.
    """
    pairs = cut(pairs)
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), texts, reps)
    pivots = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("rows")).withColumn("units", F.ceil(F.col("rows") / PIVOT_PAIRS))
    dealt = spread_join(pairs, pivots, ["b"], "rows", pairs.count(), FEW_ROWS)
    members = dealt.select("b", F.pmod(F.xxhash64("a"), F.col("units")).alias("unit"), F.lit(True).alias("member"), F.col("a").alias("id"))
    heads = pivots.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)).alias("unit"), F.lit(False).alias("member"), F.col("b").alias("id"))
    units = members.unionByName(heads).join(sets, "id").select("b", "unit", "member", "id", "members")
    return units.repartition("b", "unit").sortWithinPartitions("b", "unit", "member").mapInArrow(lean(_linked), "a long, b long")


class Forest:
    """Union-find over ids, with path halving."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether this was news."""
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _by_unit(judge, schema: pa.Schema):
    """A mapInArrow function over rows sorted by (key, lo, hi): calls judge(table, start, end, both) for each run, where both tells that lo = hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def out(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            key, lo, hi = (t.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            links: list[tuple[int, int]] = []
            for s, e in zip(np.r_[0, edges], np.r_[edges, len(key)], strict=True):
                links += judge(t.slice(int(s), int(e - s)), bool(lo[s] == hi[s]))
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not t.num_rows:
                continue
            key, lo, hi = (t.column(i).to_numpy() for i in range(3))
            other = np.flatnonzero((key != key[-1]) | (lo != lo[-1]) | (hi != hi[-1]))
            cut_at = int(other[-1]) + 1 if len(other) else 0
            rest = t.slice(cut_at)
            if cut_at:
                yield out(t.slice(0, cut_at))
        if rest is not None and rest.num_rows:
            yield out(rest)

    return run


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _candidates(t: pa.Table, both: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows it may link to) of a unit (key, lo, hi, own, id, component, n, sig): other component, sizes and signature allow it."""
    lo, own, comp, n = (t.column(i).to_numpy() for i in (1, 3, 5, 6))
    sig = _bytes(t.column(7))
    one = np.arange(len(own)) if both else np.flatnonzero(own == lo[0])
    two = one if both else np.flatnonzero(own != lo[0])
    for k, x in enumerate(one):
        rest = two[k + 1 :] if both else two
        near = rest[(comp[rest] != comp[x]) & (100 * np.minimum(n[rest], n[x]) >= LEAST_PERCENT * np.maximum(n[rest], n[x]))]
        if len(near):
            near = near[estimate((sig[near] == sig[x]).mean(axis=1)) >= LEAST_ESTIMATE]
            if len(near):
                yield int(x), near


def _loosely_linked(t: pa.Table, both: bool) -> list[tuple[int, int]]:
    """A spanning forest of a unit's candidate pairs."""
    ids, forest, out = t.column(4).to_numpy(), Forest(), []
    for x, near in _candidates(t, both):
        out += [(int(ids[x]), int(ids[y])) for y in near if forest.join(int(ids[x]), int(ids[y]))]
    return out


def _surely_linked(t: pa.Table, both: bool) -> list[tuple[int, int]]:
    """Links of a unit, verified on full sets (last column); pairs that links or components already join are passed over."""
    ids, comp, forest, out = t.column(4).to_numpy(), t.column(5).to_numpy(), Forest(), []
    sets = [np.frombuffer(v, dtype=np.uint64) for v in t.column(8).to_pylist()]
    for x, near in _candidates(t, both):
        for y in near:
            if forest.find(int(comp[x])) != forest.find(int(comp[y])) and similar_sets(sets[x], sets[y]):
                forest.join(int(comp[x]), int(comp[y]))
                out.append((int(ids[x]), int(ids[y])))
    return out


def similar_sets(p: np.ndarray, q: np.ndarray) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= LEAST_PERCENT * (len(p) + len(q) - both)


def _units(rows: DataFrame, others: list[str], tail: list[str]) -> DataFrame:
    """rows (key, own, id, component, n, sig, ...) copied to each unit (key, lo, hi) that own shares with the blocks in ``others`` (from, to), sorted."""
    other = F.explode(F.sequence(F.col(others[0]), F.col(others[1]))).alias("other")
    units = rows.select("*", other).select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "component", "n", "sig", *tail)
    return units.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")


def _spread(blocks: str):
    return F.pmod(F.xxhash64("id"), F.greatest(F.col(blocks), F.lit(1))).cast("int")


def least_agreeing() -> int:
    """Places in which two signatures agree at least, if they may belong to a link."""
    return next(n for n in range(PLACES + 1) if estimate(n / PLACES) >= LEAST_ESTIMATE)


def _by_rare_places(rows: DataFrame) -> DataFrame:
    """rows (bk, id, component, sig) as (bk, id, component) in one bucket for each of the rarest (place, value) of their signatures.

    In any one order of all (place, value), two signatures that agree in n of PLACES places have one
    of them in common among the first PLACES - n + 1 of each. So every pair of a bucket that may
    belong to a link meets again, and values that many rows share, which come last, bring few together.
    """
    kept = PLACES - least_agreeing() + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(PLACES * 256, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                counts += np.bincount((_bytes(batch.column(0)) + np.arange(PLACES) * 256).ravel(), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["token", "n"])

    counted = rows.select("sig").mapInArrow(lean(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy("n", "token").select("token").toArrow()
    rank = np.empty(PLACES * 256, dtype=np.int32)
    rank[counted.column(0).to_numpy()] = np.arange(PLACES * 256, dtype=np.int32)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ranks = rank[_bytes(batch.column(3)) + np.arange(PLACES) * 256]
                first = np.sort(ranks, axis=1)[:, :kept]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * kept), pa.array(first.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["bk", "id", "component", "rare"])

    found = small_batches(rows.select("bk", "id", "component", "sig")).mapInArrow(lean(rarest), "bk long, id long, component long, rare array<int>")
    return found.select("bk", "id", "component", F.explode("rare").alias("rare")).select(F.xxhash64("bk", "rare").alias("bk"), "id", "component")


def _loose_links(labelled: DataFrame, reps: DataFrame, again: bool = True) -> DataFrame:
    """Links (a, b) that tie the candidate pairs across components in the buckets of labelled (bk, id, component)."""
    open_ = cut(labelled.groupBy("bk").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("rows")).where("c1 <> c2").drop("c1", "c2"))
    huge, more = open_.where(F.col("rows") > REBAND), None
    if again and not huge.isEmpty():
        # REBAND bounds the number of these buckets to a small part of all rows.
        twice = stored(labelled.join(F.broadcast(huge.select("bk")), "bk", "left_semi").join(reps.select("id", "sig"), "id"))
        more = _loose_links(stored(_by_rare_places(twice)), reps, False)
        open_ = open_.where(F.col("rows") <= REBAND)
    total = open_.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    last = F.ceil(F.col("rows") / BLOCK).cast("int")
    blocks = open_.select("bk", "rows", last.alias("blocks"), F.lit(0).alias("from"), (last - 1).alias("to"))
    rows = spread_join(labelled, blocks, ["bk"], "rows", total, FEW_ROWS).withColumn("own", _spread("blocks")).withColumnRenamed("bk", "key")
    rows = rows.join(reps.select("id", F.col("n_shingles").alias("n"), "sig"), "id")
    links = _units(rows, ["from", "to"], []).mapInArrow(lean(_by_unit(_loosely_linked, _PAIR)), "a long, b long")
    return links if more is None else links.unionByName(more)


def loose_groups(members: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, component) of groups within which every candidate pair across ``labels`` lies.

    members: bk, id. A bucket of more than BLOCK rows is split by hashed id into blocks, and every
    pair of blocks is a unit of its own: no task holds more than two blocks of a bucket. Units give
    spanning forests only, so a bucket of n alike rows gives about n rows a unit, not n squared. A
    bucket of more than REBAND rows is divided first: each row goes to one bucket for each of the 54
    rarest places of its signature, so the rows that move are proportional to its size. Candidate
    pairs all meet there, so the links' groups are those that blocks of the whole bucket would give.
    """
    labelled = stored(members.join(labels, "id", "left").select("bk", "id", F.coalesce("component", "id").alias("component")))
    groups = components(_loose_links(labelled, reps))
    tidy(members.sparkSession)
    return groups


def links_across(groups: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (a, b) between different labels within ``groups`` (id, component).

    A group's rows of its most frequent label are compared with its other rows only, those with
    each other too; both sides are dealt to blocks of about SET_BLOCK rows and SET_SHINGLES shingles
    at most, and pairs of blocks are units. A unit has each row's full set once, however many pairs
    it checks.
    """
    g = groups.select("id", F.col("component").alias("key")).join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    g = cut(g.join(reps.select("id", F.col("n_shingles").alias("n"), "sig"), "id"))
    each = g.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    most = F.max(F.struct("rows", "component", "shingles"))
    sizes = each.groupBy("key").agg(most.alias("main"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles")).where("rows > main.rows")
    parts = lambda rows, shingles: F.greatest(F.ceil(rows / SET_BLOCK), F.ceil(shingles / SET_SHINGLES)).cast("int")
    small = parts(F.col("rows") - F.col("main.rows"), F.col("shingles") - F.col("main.shingles"))
    sizes = cut(sizes.select("key", "rows", F.col("main.component").alias("main"), small.alias("small"), parts(F.col("main.rows"), F.col("main.shingles")).alias("large")))
    total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    is_main = F.col("component") == F.col("main")
    rows = spread_join(g, sizes, ["key"], "rows", total, FEW_ROWS).withColumn("own", F.when(is_main, F.col("small") + _spread("large")).otherwise(_spread("small")))
    rows = rows.withColumn("from", F.lit(0)).withColumn("to", F.when(is_main, F.col("small") - 1).otherwise(F.col("small") + F.col("large") - 1))
    rows = rows.join(full_sets(g.select("id").distinct(), texts, reps), "id")
    return _units(rows, ["from", "to"], ["members"]).mapInArrow(lean(_by_unit(_surely_linked, _PAIR)), "a long, b long")


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key (64-bit hash of the text), n_shingles, d1, d2, component_id for every row.

    Nodes are classes of equal sets, numbered as they were stored, so two texts of one id are two nodes.
    """
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    rows = stored(signatures(docs, id_col, text_col))
    shingled = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = cut(shingled.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows")))
    reps = stored(shingled.join(classes, ["d1", "d2", "doc_id"]).dropDuplicates(["d1", "d2", "doc_id"]).withColumn("id", F.monotonically_increasing_id()))
    placed = reps.select("id", F.explode("bands").alias("bk"))
    shared = cut(placed.groupBy("bk").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("pivot")).where("rows > 1"))
    members = stored(spread_join(placed, shared, ["bk"], "rows", shared.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], FEW_ROWS).select("bk", "id", "pivot"))
    stars = stored(members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct())
    pivots = stars.groupBy("b").agg(F.count(F.lit(1)).alias("rows")).join(reps.select(F.col("id").alias("b"), F.col("n_shingles").alias("m"), F.col("sig").alias("y")), "b")
    with_a = stars.join(reps.select(F.col("id").alias("a"), F.col("n_shingles").alias("n"), F.col("sig").alias("x")), "a")
    alike = spread_join(with_a, cut(pivots), ["b"], "rows", stars.count(), FEW_ROWS).where(sizes_allow()).select("a", "b", "x", "y").mapInArrow(lean(_alike), "a long, b long, similar double")
    best = alike.withColumn("turn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similar"), "b"))).where(F.col("turn") <= FIRST_PIVOTS)
    links = cut(verify(best.select("a", "b"), texts, reps))
    tidy(docs.sparkSession)
    labels = components(links)
    tidy(docs.sparkSession)
    more = cut(links_across(loose_groups(members.select("bk", "id"), labels, reps), labels, reps, texts))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    tidy(docs.sparkSession)
    of_node = cut(reps.select("d1", "d2", "id", "doc_id", "rows").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")))
    least = cut(of_node.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("nodes")))
    of_class = spread_join(of_node.select("d1", "d2", "rows", "component"), least, ["component"], "nodes", of_node.count(), FEW_ROWS).select("d1", "d2", "rows", "component_id")
    names = ["doc_id", "text_key", "n_shingles", "d1", "d2"]
    found = spread_join(shingled.select(*names), cut(of_class), ["d1", "d2"], "rows", classes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], FEW_ROWS)
    others = rows.where("doc_id IS NULL OR n_shingles = 0").select(*names, F.col("doc_id").alias("component_id"))
    return found.select(*names, "component_id").unionByName(others)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Defined cases: a text without words (or null) has no shingles and no links and is kept; a row
    with null id takes no part, has a null component and is kept; rows that repeat an id are judged
    each by its own text; a text of any length is shingled whole; an empty table gives no rows;
    other columns are ignored, whatever their names. Two texts at the threshold miss each other in
    all 32 bands with a probability of 5e-6 at most.
    """
    found = _judged(docs, id_col, text_col)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, columns unchanged.

    Defined cases as for ``near_dedup``. Rows that repeat an id go or stay each by its own text; of
    those that repeat an id and a shingle set, one text stays, and rows that repeat a text with it.
    Helper columns avoid the names of ``docs``.
    """
    tidy(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        found = stored(_judged(docs, "doc_id", "text").where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "text_key", "d1", "d2", "component_id"))
        keep.append(last_stored())
    of_id, of_key = fresh(docs.columns, "of_id", "of_key")
    gone = found.where("doc_id <> component_id").select("doc_id", "text_key")
    set_of = ["doc_id", "d1", "d2"]
    stay = found.where("doc_id = component_id").select(*set_of, "text_key")
    tied = stay.groupBy(*set_of).agg(F.min("text_key").alias("first"), F.max("text_key").alias("last")).where("first <> last")
    also = stay.join(tied, set_of).where("text_key <> first").select("doc_id", "text_key")
    gone = gone.unionByName(also).distinct().toDF(of_id, of_key)
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col(of_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(of_key)), "left_anti")
