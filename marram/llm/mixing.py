"""Mixing of sources to target weights.

Each source's documents are laid end to end in words and cut into blocks of fixed length. A
source's target fixes how many words it gives; its blocks are dealt to output shards by
multinomial draws without overdrawing any source (the draws of a shard are taken from what the
sources still owe), slots map to block indices by a pseudorandom permutation for each source and
pass, and slots and blocks meet in a join by index.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, floor, inf, lgamma, log, log1p, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.llm.common import WORDS, cut, fresh, lean, quoted, small_batches, tidy

#: Weights of the sources in code-point order, repeating, and the cap on repeats.
WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
BLOCK_WORDS = 256
#: Slots of an output shard (a million words), and shards whose draws one task makes.
SHARD_SLOTS, TASK_SHARDS = 4096, 256
#: Documents that are laid end to end in one window partition, on average.
STREAM_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def targets(sizes: list[int], weights: list[float], passes: int = MOST_PASSES) -> list[float]:
    """Share the sum of sizes by weight; none gets over ``passes`` times its size, the excess is shared again."""
    total, got, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        share = left / sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if weights[i] * share > passes * sizes[i]]
        if not over:
            for i in open_:
                got[i] = weights[i] * share
            break
        for i in over:
            got[i] = float(passes * sizes[i])
            left -= got[i]
            open_.discard(i)
    return got


def plan_slots(size: int, target: float, block: int = BLOCK_WORDS) -> tuple[int, int]:
    """(slots, words of the last slot): whole passes first, then part of a pass, whose last slot is cut to the word."""
    words = min(round(target), MOST_PASSES * size)
    if not words:
        return 0, 0
    blocks = -(-size // block)
    passes, rest = divmod(words, size)
    slots = passes * blocks + -(-rest // block)
    return slots, (rest - 1) % block + 1 if rest else block


def _stirling_rest(n: float) -> float:
    """log(n!) less Stirling's formula, to double precision."""
    if n < 16:
        return lgamma(n + 1) - (n + 0.5) * log(n) + n - 0.5 * log(2 * pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: float, mean: float) -> float:
    """x * log(x / mean) + mean - x, without cancellation where the two are close."""
    d = (x - mean) / mean
    if abs(d) < 0.1:
        out, power, k = 0.0, d * d, 2
        while abs(power) > 1e-18 * max(abs(out), 1e-300):
            out += power / (k * (k - 1)) * (1 if k % 2 == 0 else -1)
            power *= d
            k += 1
        return mean * out
    return (x * log(x / mean) if x else 0.0) + mean - x


def _log_binomial(x: int, n: int, p: float) -> float:
    """Log of the binomial probability by saddle-point expansion: its error does not grow with n."""
    if x == 0:
        return n * log1p(-p) if p < 1 else (0.0 if n == 0 else -inf)
    if x == n:
        return n * log(p)
    core = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return core + 0.5 * log(n / (2 * pi * x * (n - x)))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n slots drawn without replacement from good + bad are good: one law at every size.

    Rejection by the ratio of uniforms around the mode; the hat is that of Stadlober for
    hypergeometric tails. The probabilities need no logarithm of a large factorial.
    """
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    p = n / total
    log_p = lambda x: _log_binomial(x, good, p) + _log_binomial(n - x, bad, p)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    at_mode = log_p(mode)
    spread = sqrt((total - n) * (good / total) * (bad / total) * n / (total - 1) + 0.5)
    centre, width = n * (good / total) + 0.5, 2 * sqrt(2 / exp(1)) * spread + 3 - 2 * sqrt(3 / exp(1))
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        x = centre + width * (v - 0.5) / u
        if low <= x < high + 1:
            k = floor(x)
            if 2 * log(u) <= log_p(k) - at_mode:
                return k


def draw(rng: np.random.Generator, owed: list[int], n: int) -> list[int]:
    """n slots drawn without replacement from what the sources owe, one source after the other."""
    out, left, rest = [0] * len(owed), n, sum(owed)
    for i, have in enumerate(owed):
        rest -= have
        if not left:
            break
        out[i] = left if not rest else hypergeometric(rng, have, rest, left) if have else 0
        left -= out[i]
    return out


def dealt(owed: list[int], given: list[int], first: int, last: int, per_shard: int, stop: int, seed: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """The shards first to last - 1, which share ``owed``, as runs of at most ``stop`` shards: (first, last, owed, given before).

    The urn is halved by shards again and again; each half's draw has a seed of its own, so runs
    can be dealt further by different tasks and give what one task would have given.
    """
    if last - first <= stop:
        yield first, last, owed, given
        return
    middle = (first + last) // 2
    part = draw(np.random.default_rng([seed, first, last]), owed, min(sum(owed), (middle - first) * per_shard))
    yield from dealt(part, given, first, middle, per_shard, stop, seed)
    yield from dealt([a - b for a, b in zip(owed, part, strict=True)], [a + b for a, b in zip(given, part, strict=True)], middle, last, per_shard, stop, seed)


_PLAN = pa.schema([("source", pa.string()), ("source_size", pa.int64()), ("blocks", pa.int64()), ("target", pa.float64()), ("last_slot", pa.int64()), ("last_words", pa.int64()), ("first_shard", pa.int64()), ("end_shard", pa.int64()), ("place", pa.int64()), ("first_slot", pa.int64()), ("slots", pa.int64())])
_DDL = "source string, source_size long, blocks long, target double, last_slot long, last_words long, first_shard long, end_shard long, place long, first_slot long, slots long"


def plan(sources: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS, task_shards: int = TASK_SHARDS) -> DataFrame:
    """One row per source and run of shards, from (source, source_size): what the run takes of the source.

    Runs in one task over one row a source. The draws are multivariate hypergeometric: multinomial
    counts of a shard given that all shards together meet every source's number of slots. Here the
    urn is split down to runs of ``task_shards`` shards; ``shares`` splits on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(s.as_py(), z.as_py()) for b in batches for s, z in zip(b.column(0), b.column(1), strict=True)]
        rows.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
        if not rows:
            return
        sizes = [r[1] for r in rows]
        wanted = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
        planned = [plan_slots(z, t) for z, t in zip(sizes, wanted, strict=True)]
        owed = [p[0] for p in planned]
        shards = max(1, ceil(sum(owed) / shard_slots))
        for first, end, own, given in dealt(owed, [0] * len(owed), 0, shards, shard_slots, task_shards, seed):
            some = [i for i, k in enumerate(own) if k or not first]
            columns = zip(*[(*rows[i], -(-sizes[i] // BLOCK_WORDS), wanted[i], planned[i][0] - 1, planned[i][1], first, end, i, given[i], own[i]) for i in some], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PLAN, strict=True)], schema=_PLAN)

    return sources.select("source", "source_size").coalesce(1).mapInArrow(run, _DDL)


def shares(planned: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The plan with its runs split into single shards: first_shard is the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda r: r["place"])
            first, end = held[0]["first_shard"], held[0]["end_shard"]
            for shard, _, own, given in dealt([r["slots"] for r in held], [r["first_slot"] for r in held], first, end, shard_slots, 1, seed):
                yield pa.RecordBatch.from_pylist([r | {"first_shard": shard, "end_shard": shard + 1, "first_slot": g, "slots": k} for r, g, k in zip(held, given, own, strict=True) if k], schema=_PLAN)

        for batch in batches:
            for r in batch.to_pylist():
                if held and r["first_shard"] != held[0]["first_shard"]:
                    yield from out()
                    held.clear()
                held.append(r)
        if held:
            yield from out()

    return planned.where("slots > 0").repartition("first_shard").sortWithinPartitions("first_shard", "place").mapInArrow(run, _DDL)


def permuted(source: str | None, passes: np.ndarray, at: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Index of each position in its pass' permutation of range(n): a 4-round Feistel network that walks its cycle back into range."""
    if not len(at):
        return at
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    name = b"\0" if source is None else b"\1" + source.encode("utf-8", "surrogatepass")
    keys = np.array([[xxhash.xxh3_64_intdigest(name, (seed * 1_000_003 + p * 31 + r) % (1 << 64)) for r in range(4)] for p in range(int(passes.max()) + 1)], dtype=np.uint64)[passes]
    x = at.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            f = (right ^ keys[todo, r]) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def slots(planned: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per slot of the mix: shard, source, slot, block_index, words (how many of its block count)."""
    spread = shares(planned, seed, shard_slots).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(slots - 1) div 4096"))).alias("part"))
    spread = spread.select("source", "source_size", "blocks", F.col("first_shard").alias("shard"), "last_slot", "last_words", (F.col("first_slot") + F.col("part") * 4096).alias("first"), F.least(F.lit(4096).cast("long"), F.col("slots") - F.col("part") * 4096).alias("n")).repartition("source", "first")
    names = ["shard", "source", "slot", "block_index", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                slot = np.arange(r["first"], r["first"] + r["n"])
                # The short block at a source's end closes each pass, so part of a pass is exact to the word.
                index, whole = slot % r["blocks"], r["source_size"] // BLOCK_WORDS
                inner = index < whole
                index[inner] = permuted(r["source"], (slot // r["blocks"])[inner], index[inner], whole, seed)
                words = np.where(slot == r["last_slot"], r["last_words"], BLOCK_WORDS)
                n = len(slot)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["shard"], np.int64)), pa.array([r["source"]] * n, pa.string()), pa.array(slot), pa.array(index), pa.array(words)], names=names)

    return spread.mapInArrow(run, "shard long, source string, slot long, block_index long, words long")


#: What tells documents apart: rows tied in id, source and size are numbered by ``copy``.
KEY = ("doc_id", "source", "size", "copy")


def _join(left: DataFrame, right: DataFrame, names: tuple[str, ...] = KEY, how: str = "inner") -> DataFrame:
    """Join on equal columns, where null equals null."""
    other = right.select([F.col(c).alias(f"of_{c}") if c in names else F.col(c) for c in right.columns])
    match = F.lit(True)
    for name in names:
        match &= F.col(name).eqNullSafe(F.col(f"of_{name}"))
    return left.join(other, match, how).drop(*[f"of_{name}" for name in names])


def laid_out(sizes: DataFrame) -> DataFrame:
    """KEY columns and start: each document's first word within its source.

    Prefix sums in two levels: within streams of a source dealt by hashed row, and over a source's
    streams, of which there is one per STREAM_ROWS rows; so no source is summed up in one task.
    """
    n = sizes.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / STREAM_ROWS).cast("int").alias("streams"))
    dealt_out = _join(sizes, n, ("source",)).select(*KEY, F.pmod(F.xxhash64("doc_id", "size", "copy"), F.col("streams")).cast("int").alias("stream"))
    heads = dealt_out.groupBy("source", "stream").agg(F.sum("size").alias("words"))
    heads = heads.select("source", "stream", (F.sum("words").over(Window.partitionBy("source").orderBy("stream")) - F.col("words")).alias("offset"))
    rows = dealt_out.withColumn("within", F.sum("size").over(Window.partitionBy("source", "stream").orderBy("doc_id", "size", "copy")) - F.col("size"))
    return _join(rows, heads, ("source", "stream")).select(*KEY, (F.col("within") + F.col("offset")).alias("start"))


class Mix:
    """sizes, plan and pieces of one mix; ``pieces`` is the mix itself."""

    def __init__(self, docs: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
        # Ties are counted before anything is shuffled, so one that fills a third of the table is a few rows.
        ties = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
        self.sizes = cut(ties.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")))
        self.plan = cut(plan(self.sizes.groupBy("source").agg(F.sum("size").alias("source_size")), seed, shard_slots))
        self.seed, self.shard_slots = seed, shard_slots

    def pieces(self) -> DataFrame:
        """shard, slot, KEY, from_word, n_words: what each slot takes of each document."""
        taken = slots(self.plan, self.seed, self.shard_slots).hint("merge")  # it grows with the corpus, whatever its estimate
        docs = laid_out(self.sizes).where("size > 0")
        span = F.sequence(F.expr(f"start div {BLOCK_WORDS}"), F.expr(f"(start + size - 1) div {BLOCK_WORDS}"))
        parts = docs.select(*KEY, "start", F.explode(span).alias("block_index"))
        met = _join(parts, taken, ("source", "block_index"))
        low = F.greatest(F.col("start"), F.col("block_index") * BLOCK_WORDS)
        high = F.least(F.col("start") + F.col("size"), F.col("block_index") * BLOCK_WORDS + F.col("words"))
        return met.select("shard", "slot", *KEY, (low - F.col("start")).alias("from_word"), (high - low).alias("n_words")).where("n_words > 0")

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken, source for every row."""
        words = self.pieces().groupBy(*KEY).agg(F.sum("n_words").alias("taken"))
        of = self.plan.where("first_shard = 0").select("source", "source_size", "target")
        rows = _join(_join(self.sizes, of, ("source",)), words, how="left")
        return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for every row of ``docs``.

    Defined cases: null text has size 0 and gives nothing; a null source is a source of its own,
    after all others; sources without words have target 0; rows that repeat an id are documents of
    their own; a text of any length is counted whole and laid over as many blocks as it takes; an
    empty table gives no rows; other columns are ignored, whatever their names. Reruns agree: every
    draw is seeded and rows are ordered by id, size and number of the tie.
    """
    return Mix(docs, seed).taken()


_SPACED = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: what is taken of a document once, twice or thrice.

    A document comes back as up to three rows: the n-th holds, in order, the words that are taken n
    times at least, each with the white space after it. So the rows hold exactly the words taken.
    Defined cases as for ``mix``; documents without words do not come back, rows tied in id, source
    and size are told apart by their texts, and helper columns avoid the names of ``docs``.
    """
    names = docs.columns
    tidy(docs.sparkSession)
    made = Mix(docs, seed)
    uses = made.pieces().groupBy(*KEY).agg(F.collect_list(F.struct("from_word", "n_words")).alias("uses"))
    size, copy, of_id, of_source, of_size, of_copy, spans = fresh(names, "size", "copy", "of_id", "of_source", "of_size", "of_copy", "uses")
    of = uses.toDF(of_id, of_source, of_size, of_copy, spans)
    rows = docs.withColumn(size, word_count(F.col("text")))
    tie = Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text"), "text")
    alone = made.sizes.where("copy > 1").limit(1).isEmpty()
    rows = rows.withColumn(copy, F.lit(1).cast("long") if alone else F.row_number().over(tie).cast("long"))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & F.col("source").cast("string").eqNullSafe(F.col(of_source)) & (F.col(size) == F.col(of_size)) & (F.col(copy) == F.col(of_copy))
    joined = rows.join(of, match).select(*map(quoted, names), spans)
    return small_batches(joined).mapInArrow(lean(_take(names.index("text"), len(names))), docs.schema)


def _take(text_at: int, n: int):
    import re

    spaced = re.compile(_SPACED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, texts = [], []
            for row, (text, uses) in enumerate(zip(batch.column(text_at), batch.column(n), strict=True)):
                words = spaced.findall(text.as_py())
                depth = np.zeros(len(words) + 1, dtype=np.int64)
                for u in uses.as_py():
                    depth[u["from_word"]] += 1
                    depth[u["from_word"] + u["n_words"]] -= 1
                depth = np.cumsum(depth)[:-1]
                for level in range(1, int(depth.max(initial=0)) + 1):
                    index.append(row)
                    texts.append("".join(words[i] for i in np.flatnonzero(depth >= level)))
            taken = batch.select(range(n)).take(pa.array(index, pa.int64()))
            yield taken.set_column(text_at, batch.schema.field(text_at), pa.array(texts, batch.schema.field(text_at).type))

    return run
