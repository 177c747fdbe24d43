"""Passes over tracks that are longer than a task: an entity's rows in order, cut into pieces.

A piece is named by the global rank of its first row, so that pieces of one entity follow each
other at a fixed distance.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.operators.banded import border_system, natural_band, solve_pairs
from marram.operators.ranks import ranked
from marram.session import Workspace

#: Rows of an entity that one task takes in one piece; a longer entity is cut into pieces of so many.
TASK_ROWS, PIECE_ROWS = 1_000_000, 100_000


def same(by: list[str], suffix: str) -> Column:
    """Equality of keys with their copies under another name, null being equal to null."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(c + suffix)) for c in by])


def split_by_length(rows: DataFrame, by: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of entities with ``most`` rows at most, and of the longer ones, which are few; None if there are none."""
    long = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).drop("__n")
    if not long.take(1):
        return rows, None
    long = long.withColumnsRenamed({c: f"{c}__long" for c in by})
    return rows.join(long, same(by, "__long"), "left_anti"), rows.join(long, same(by, "__long"), "left_semi")


def in_pieces(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """``rows`` with __rank (of all rows), __start and __n (their entity's first rank and length)."""
    numbered = ranked(rows, [*by, *order], "__rank")
    spans = numbered.groupBy(*by).agg(F.min("__rank").alias("__start"), F.count(F.lit(1)).alias("__n")).withColumnsRenamed({c: f"{c}__of" for c in by})
    return numbered.join(spans, same(by, "__of")).drop(*[f"{c}__of" for c in by])


Far = Callable[[np.ndarray, np.ndarray], np.ndarray]
Jumps = Callable[[Far, np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]]


def flagged_in_pieces(df: DataFrame, by: list[str], order: list[str], values: list[str], far: Far, jumps: Jumps, size: int = PIECE_ROWS) -> DataFrame:
    """``df`` with ``flagged``, as one pass over each entity's rows would give it.

    Each piece first runs as if its own first row were good, which yields its last good row. If that
    first row is near the last good row of the piece before, the run was the true one. Only pieces
    whose first row is not are run again, from that row, round after round until no piece's last
    good row changes; a round reads the pieces in doubt alone.
    """
    work = Workspace(df.sparkSession)
    piece = F.col("__start") + F.floor((F.col("__rank") - F.col("__start")) / size).cast("long") * size
    rows = work.keep(in_pieces(df, by, order, size).withColumn("__piece", piece))
    slim = rows.select("__piece", "__rank", (F.col("__piece") == F.col("__start")).alias("__head"), F.array(*[F.col(c).cast("double") for c in values]).alias("__v"))
    stack = lambda a: np.stack(a.to_list()).astype(float)

    def last_good(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = stack(pdf.sort_values("__rank")["__v"])
        entry = pdf["entry"].iloc[0] if "entry" in pdf and pdf["entry"].iloc[0] is not None else None
        _, good = jumps(far, v, None if entry is None else np.asarray(entry, float))
        return pd.DataFrame({"__piece": [key[0]], "head": [bool(pdf["__head"].iloc[0])], "first": [v[0].tolist()], "ran": [entry], "last": [good.tolist()]})

    schema = "__piece long, head boolean, first array<double>, ran array<double>, last array<double>"

    def doubted(batches):
        for pdf in batches:
            entry = [b if b is not None and far(np.asarray(f, float)[None], np.asarray(b, float))[0] else None for f, b in zip(pdf["first"], pdf["before"], strict=True)]
            yield pdf.assign(entry=pd.Series(entry, index=pdf.index, dtype=object))

    state, told = work.keep(slim.groupBy("__piece").applyInPandas(last_good, schema)), None
    while True:
        work.drop_all_but(rows, state)
        before = state.select((F.col("__piece") + size).alias("__piece"), F.lit(False).alias("head"), F.col("last").alias("before"))
        # An entity's first piece has none before it: what lies ``size`` ranks earlier is another entity's.
        told = work.keep(state.join(before, ["__piece", "head"], "left").mapInPandas(doubted, f"{schema}, before array<double>, entry array<double>"))
        again = told.where(~F.col("entry").eqNullSafe(F.col("ran"))).select("__piece", "entry")
        if not again.take(1):
            break
        redone = slim.join(again, "__piece").groupBy("__piece").applyInPandas(last_good, schema)
        state = work.keep(state.join(again, "__piece", "left_anti").unionByName(redone))
    work.drop(state)
    following = told.where("NOT head").select((F.col("__piece") - size).alias("__piece"), F.col("first").alias("__next"))
    whole = rows.join(told.select("__piece", F.col("entry").alias("__entry")), "__piece").join(following, "__piece", "left")
    names = df.columns

    def flags(table: pa.Table) -> pa.Table:
        table = table.sort_by("__rank")
        v = np.stack([table[c].to_numpy().astype(float) for c in values], axis=1)
        entry, after = table["__entry"][0].as_py(), table["__next"][0].as_py()
        bad, good = jumps(far, v, None if entry is None else np.array(entry))
        flagged = bad.copy()
        flagged[:-1] |= bad[1:]
        flagged[-1] |= after is not None and bool(far(np.array([after]), good)[0])
        return table.select(names).append_column("flagged", pa.array(flagged))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return whole.groupBy("__piece").applyInArrow(flags, f"{fields}, flagged boolean")


def splines_in_segments(knots: DataFrame, by: list[str], on: str, values: list[str], smooth: float, size: int = PIECE_ROWS) -> DataFrame:
    """Each entity's smoothing spline at its knots, one row a time: by, on, ``values`` (levels) and their second derivatives ``<value>__curve``.

    The second derivatives solve a five-diagonal system. Where two segments meet, the last unknown
    of one and the first of the next part the inner ones of both, so each segment reduces its rows
    to the two pairs at its ends; the pairs' system, one row a segment, is solved by entity; then
    every segment solves for its inner unknowns between pairs that are known.
    """
    work = Workspace(knots.sparkSession)
    rows = in_pieces(knots.select(*by, on, *[F.col(c).cast("double").alias(c) for c in values]), by, [on], size)
    r = F.col("__rank") - F.col("__start")
    segment = F.least(F.floor(r / size), F.greatest(F.floor(F.col("__n") / size) - 1, F.lit(0))).cast("long")
    end = F.when(segment == F.greatest(F.floor(F.col("__n") / size) - 1, F.lit(0)), F.col("__n")).otherwise((segment + 1) * size)
    # Two rows beyond each end of a segment take part in its coefficients.
    homes = F.array_compact(F.array(segment, F.when((r - segment * size < 2) & (segment > 0), segment - 1), F.when((end - r <= 2) & (end < F.col("__n")), segment + 1)))
    rows = work.keep(rows.select("*", r.alias("__r"), segment.alias("__own"), F.explode(homes).alias("__segment")))
    lam, m = (1 - smooth) / max(smooth, 1e-15), len(values)

    def band(pdf: pd.DataFrame):
        pdf = pdf.sort_values("__r", ignore_index=True)
        own = (pdf["__own"] == pdf["__segment"]).to_numpy()
        at, n = pdf["__r"].to_numpy(), int(pdf["__n"].iloc[0])
        return pdf, own, natural_band(at, pdf[on].to_numpy(float), pdf[values].to_numpy(float), int(at[own][0]), int(at[own][-1]) + 1, n, lam)

    def reduce_segment(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s, g = border_system(band(pdf)[2])
        return pd.DataFrame({"__start": [key[0]], "__segment": [key[1]], "s": [s.ravel().tolist()], "g": [g.ravel().tolist()]})

    reduced = work.keep(rows.groupBy("__start", "__segment").applyInPandas(reduce_segment, "__start long, __segment long, s array<double>, g array<double>"))

    def solve_borders(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__segment")
        pairs = solve_pairs(np.stack(pdf["s"].to_list()).reshape(-1, 4, 4), np.stack(pdf["g"].to_list()).reshape(-1, 4, m))
        return pd.DataFrame({"__start": key[0], "__segment": pdf["__segment"], "pairs": [p.ravel().tolist() for p in pairs]})

    borders = work.keep(reduced.groupBy("__start").applyInPandas(solve_borders, "__start long, __segment long, pairs array<double>"))
    kinds = {f.name: f.dataType.simpleString() for f in knots.schema.fields}
    curves = [f"{c}__curve" for c in values]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own, found = band(pdf)
        level, curve = found.solved(np.array(pdf["pairs"].iloc[0], float).reshape(4, m))
        out = pdf.loc[own, [*by, on]].reset_index(drop=True)
        out[values], out[curves] = level, curve
        return out

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, on]) + "".join(f", `{c}` double" for c in [*values, *curves])
    return rows.join(borders, ["__start", "__segment"]).groupBy("__start", "__segment").applyInPandas(finish, fields)
