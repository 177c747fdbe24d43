"""Secret scan with corpus-wide ownership frequency.

One pass over whole texts finds candidate spans and hashes their values. The hashes are then
counted over distinct repositories and owners of the whole corpus: a value that several owners
have, or two owners in many repositories, is a copied example; one that a single owner has, in
however many repositories, and that looks drawn at random is a live-looking credential. Only hashes, positions and ids are shuffled, never text or secrets.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import cut, small_batches, spread_join, stored

#: Kinds in the order that breaks ties of equal starts; ``live`` are spans that this method adds.
KINDS = ("assign", "access", "hex", "live")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Unlabelled strings that may be credentials: long enough, of the letters that keys are written in; beside ``=`` as in ``NAME=value`` and query strings.
_LOOSE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])", re.ASCII)
#: A piece of a path that is a plain word.
_PLAIN = re.compile(r"[a-z_-]{2,}", re.ASCII)

ASSIGN_LEAST, ACCESS_LEAST = 6, 20


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str, bits: float = 3.5) -> bool:
    """Digits and letters of both kinds mixed, and hardly a repeated character."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= bits


def looks_like_path(value: str) -> bool:
    """Three pieces between slashes or more, at least half of them plain words: pieces of a random string are not."""
    pieces = [p for p in value.split("/") if p]
    return len(pieces) >= 3 and 2 * sum(_PLAIN.fullmatch(p) is not None for p in pieces) >= len(pieces)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind index, value) of the base rules, in code points; spans of one kind don't overlap."""
    out = []
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                out.append((m.start(), m.end(), 0, m[2]))
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def loose_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking strings outside every base span."""
    out, taken, k = [], sorted((b[0], b[1]) for b in base), 0
    for m in _LOOSE.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if not (k < len(taken) and taken[k][0] < m.end()) and looks_random(m[0]) and not looks_like_path(m[0]):
            out.append((m.start(), m.end(), 3, m[0]))
    return out


_SPAN = "start long, stop long, kind int, digest binary, random boolean"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source") -> DataFrame:
    """One row per document: row_id, doc_id, repo, owner, spans array<struct<start, stop, kind, digest, random>>.

    Without repo_col every document is a repository of its own.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(repo_col or id_col).cast("string").alias("repo"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(text_col).cast("string").alias("text"),
    )
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32()), ("digest", pa.binary()), ("random", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(3):
                text = x.as_py() or ""
                base = base_spans(text)
                found.append([{"start": s, "stop": e, "kind": k, "digest": hashlib.sha256(v.encode()).digest()[:16], "random": looks_random(v, 3.0)} for s, e, k, v in base + loose_spans(text, base)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, spans_type)], names=["doc_id", "repo", "owner", "spans"])

    scanned = small_batches(rows).mapInArrow(run, f"doc_id long, repo string, owner string, spans array<struct<{_SPAN.replace(' ', ':').replace(',:', ',')}>>")
    return scanned.withColumn("row_id", F.monotonically_increasing_id())


def ownership(found: DataFrame) -> DataFrame:
    """digest, rows, n_repos, n_owners over the whole corpus, from exploded candidates (digest, repo, owner).

    Distinct counts have a partial step before each shuffle, so a value that fills a third of the
    corpus arrives as a few rows from every task.
    """
    return found.groupBy("digest").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(F.coalesce("repo", F.lit(""))).alias("n_repos"),
        F.count_distinct(F.coalesce("owner", F.lit(""))).alias("n_owners"),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source", copied_owners: int = 3, copied_repos: int = 20) -> DataFrame:
    """One row per document: row_id, doc_id, spans array<struct<start, stop, kind, verdict, n_repos>>.

    verdict is ``copied`` for values of copied_owners or more distinct owners, and of two owners in
    copied_repos or more distinct repositories; ``live`` for random-looking values of a single owner;
    else ``plain``. Loose candidates stay only where they are live; base spans stay always. Defined
    cases: null text is empty; a text is scanned whole and a value may be of any length; a null owner
    counts as one owner of that name (empty); repeated rows each give a row and count once as a
    repository; a null id stays null; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    rows = stored(candidates(docs, id_col, text_col, repo_col, owner_col))
    each = rows.select("row_id", "repo", "owner", F.explode("spans").alias("s")).select("row_id", "repo", "owner", "s.*")
    counts = cut(ownership(each))
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    copied = (F.col("n_owners") >= copied_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= copied_repos))
    verdict = F.when(copied, "copied").when(F.col("random") & (F.col("n_owners") == 1), "live").otherwise("plain")
    judged = (
        spread_join(each, counts, ["digest"], "rows", total)
        .withColumn("verdict", verdict)
        .where((F.col("kind") < 3) | (F.col("verdict") == "live"))
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "verdict", "n_repos"))).alias("spans"))
    )
    return rows.select("row_id", "doc_id").join(judged, "row_id", "left").select("row_id", "doc_id", F.coalesce("spans", F.array().cast(judged.schema["spans"].dataType)).alias("spans"))


def with_digests(scanned: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    of_verdict = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return scanned.select(
        "doc_id",
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(said(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        of_verdict("live").alias("n_live"),
        of_verdict("copied").alias("n_copied"),
    )
