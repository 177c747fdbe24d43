"""Line dedup, ranked search and conversation repair: plain versions, planted cases, edge cases."""

import hashlib
import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from marram.llm import conversation_repair as cr
from marram.llm import line_dedup, ranked_search

DOCS = "doc_id long, text string"


# Line dedup


def plain_line_dedup(rows):
    spaces = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(spaces))
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc_id)
    frequent = {k: max(h, key=lambda i: (i is not None, i or 0)) for k, h in holders.items() if len(k) >= 40 and len(h) >= 5}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if frequent.get(key(x), doc_id) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


SHARED = "This Licence line is shared by more than four documents é中"
LINES = (
    [(i, f"own {i}\n {SHARED} \nmore") for i in range(4)]
    + [(9, SHARED.upper().replace("É", "é") + "\n" + SHARED), (9, SHARED), (9, SHARED)]
    + [(None, SHARED), (None, "\n\n"), (20, None), (21, ""), (22, "\n"), (23, "x" * 39), (24, "x" * 39)]
    + [(30 + i, "y" * 40 + "\u0085\n" + "z" * 40 + "\t\x0b") for i in range(5)]
    + [(40 + i, f" {'w' * 38} \n" + "short line") for i in range(6)]
    + [(50, "\n".join(f"line {i % 7} of a very long text that repeats itself often" for i in range(30_000)))]
    + [(51 + i, f"line {i} of a very long text that repeats itself often\n" * 3) for i in range(4)]
    + [(60 + i, "line 3 of a very long text that repeats itself often") for i in range(4)]
)


def test_line_dedup_against_a_plain_version(spark):
    docs = spark.createDataFrame(LINES, DOCS).repartition(3)
    got = sorted([tuple(r) for r in line_dedup.digests(line_dedup.line_dedup(docs)).collect()], key=repr)
    assert got == plain_line_dedup(LINES)


def test_line_dedup_joins_what_is_not_hot(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 1)
    docs = spark.createDataFrame(LINES, DOCS)
    got = sorted([tuple(r) for r in line_dedup.digests(line_dedup.line_dedup(docs)).collect()], key=repr)
    assert got == plain_line_dedup(LINES)


def test_line_dedup_carries_clashing_columns(spark):
    names = ["gone", "row_key", "all_lines", "n_lines", "kept_text", "position", "line", "raw", "key", "n_docs", "last_doc"]
    docs = spark.createDataFrame(LINES, DOCS)
    clashing = docs.withColumns({c: F.lit("x") for c in names})
    out = line_dedup.line_dedup(clashing)
    assert {"doc_id", "text", "gone", "row_key", "all_lines", "position"} <= set(out.columns)
    assert sorted([tuple(r) for r in line_dedup.digests(out).collect()], key=repr) == plain_line_dedup(LINES)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


# Ranked search


def plain_search(docs, items, k):
    indexed = [(doc_id, ranked_search.terms_of((text or "").encode())) for doc_id, text in docs]
    indexed = [(i, t) for i, t in indexed if t]
    n, total = len(indexed), sum(len(t) for _, t in indexed)
    df = {}
    for _, terms in indexed:
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    out = []
    for item_id, text in items:
        query = ranked_search.terms_of((text or "").encode())
        scored = []
        for doc_id, terms in indexed:
            m = 75 + (25 * len(terms) * n) // total
            score = sum(ranked_search.weight(n, df[t]) * ((10**9 * terms.count(t)) // (1000 * terms.count(t) + 12 * m)) for t in query if t in df and t in terms)
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["été", "中文", "A1", "b-2"]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randint(0, 40)))) for i in range(n)]
    rows += [(n + 1, None), (n + 2, ""), (n + 3, " ..!"), (None, "w1 w2 w50"), (5, "w1 w2 w50"), (5, "w1 w2 w50"), (n + 4, "w59 " * 70_000), (n + 5, rows[3][1]), (n + 6, rows[3][1])]
    return rows


ITEMS = [(1, "w1 w2 w50 w59"), (2, "W1 w1 w1 été"), (3, "中文 a1 2"), (4, None), (5, "nothing known"), (6, "w0"), (1, "w40"), (None, "w41 w42"), (7, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("sizes", [{}, {"SHARD_DOCS": 7, "BLOCK": 4, "UNIT_DOCS": 60, "STRIDE": 5, "OPENING": 3}, {"SHARD_BYTES": 300, "BLOCK": 3, "BATCH_QUERIES": 2, "STRIDE": 1, "OPENING": 1, "UNIT_TERMS": 900}])
def test_search_against_a_plain_version(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(ranked_search, name, value)
    rows = texts(120)
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("term", F.lit("x"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("x"))
    got = sorted([tuple(r) for r in ranked_search.ranked_search(spark, docs, items, 6).collect()], key=repr)
    assert got == plain_search(rows, ITEMS, 6)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame(texts(20), DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.ranked_search(spark, docs.limit(0), items).count() == 0
    assert ranked_search.ranked_search(spark, docs.where("text = ''"), items).count() == 0
    assert ranked_search.ranked_search(spark, docs, items.limit(0)).schema == ranked_search.RESULT


def test_blocks_under_the_bar_stay_closed(spark):
    """Ten documents hold a rare term; blocks of the frequent term that lie elsewhere are not decompressed."""
    import pyarrow as pa

    rows = [(i, "often filler" + (" rare rare" if i % 1000 == 0 else "")) for i in range(20_000)]
    index = ranked_search.build_index(spark.createDataFrame(rows, DOCS).coalesce(1))
    table = pa.Table.from_pandas(index.toPandas(), preserve_index=False).cast(ranked_search._ARROW)
    unit = ranked_search.Unit(table, 20_000, 40_040)
    best = ranked_search.Best(10)
    unit.search([(b"rare", ranked_search.weight(20_000, 20)), (b"often", ranked_search.weight(20_000, 20_000) or 1)], best)
    assert best.ids.tolist() == [i * 1000 for i in range(10)]
    assert 0 < unit.opened < len(unit.first) / 2  # half of what is read opens the sweep


# Conversation repair


def plain_repair(rows):
    """The cheapest and then ASCII-least audit by Dijkstra over whole edit strings, with no heuristic and no segments."""
    spaces = " \t\n\x0b\x0c\r"
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        inside = text.strip(spaces)
        faults.append("b" if not inside else "d" if (role, text) in seen else "t" if inside[-1] not in ".!?" else "-")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    heap, closed, n = [(0, "", 0, "", ())], set(), len(rows)
    while heap:
        cost, audit, i, said, lines = heapq.heappop(heap)
        if (i, said) in closed:
            continue
        closed.add((i, said))
        if i == n and said in ("", "a"):
            break
        step = lambda more, letter, j, now, line: heapq.heappush(heap, (cost + more, audit + letter, j, now, lines + line))  # noqa: E731, B023
        need = "a" if said == "u" else "u"
        name = {"u": "user", "a": "assistant"}[need]
        step(3, "I", i, need, (f"{name}:",))
        if i < n:
            step(4, "D", i + 1, said, ())
            if faults[i] in "-t":
                extra = 3 * (faults[i] == "t")
                step(3 + extra, "R", i + 1, need, (f"{name}:{rows[i][2]}",))
                if initials[i] == need or (initials[i] == "s" and said == ""):
                    step(extra, "K", i + 1, initials[i], (f"{rows[i][1]}:{rows[i][2]}",))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed=2):
    rng = random.Random(seed)
    said = ["Yes.", "No!", "What?", "cut off", " ", "", "\t\n", "Line one.\nLine two.", "Fin. \n", "中文.", "中文"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "usher"]), rng.choice(said)))
    rows += [(1000, t, rng.choice(["user", "assistant"]), f"{rng.choice(said)}{t % 37}{rng.choice(['.', '', '!'])}") for t in range(700)]
    rows += [(1001, 5, "user", "Again.")] * 90 + [(None, t, "user" if t % 2 == 0 else "assistant", "Nameless.") for t in range(3)]
    return rows


@pytest.mark.parametrize("segment", [1024, 16])
def test_repair_against_a_plain_version(spark, monkeypatch, segment):
    monkeypatch.setattr(cr, "SEGMENT_ROWS", segment)
    rows = conversations()
    by_conv = {}
    for c, turn, role, text in rows:
        by_conv.setdefault(c, []).append((turn, role, text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = cr.digests(cr.repair(df))
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in out.collect()}
    assert got == {c: plain_repair(r) for c, r in by_conv.items()}


def test_repair_edge_cases(spark):
    schema = "conv_id long, turn long, role string, text string, segment string, edits string, n long, first string"
    rows = [(1, 0, None, None), (2, None, "user", "Hi."), (2, None, "assistant", "Ho."), (3, 0, "user", "x" * 5_000_000 + "."), (3, 1, "assistant", "Ok."), (4, 0, "system", "Rules.")]
    df = spark.createDataFrame([(*r, "s", "e", 1, "f") for r in rows], schema)
    out = {r["conv_id"]: r for r in cr.digests(cr.repair(df, F.when(F.col("conv_id") == 4, 0).otherwise(1))).collect()}
    assert (out[1]["blank"], out[1]["audit"], out[1]["cost"]) == (1, "D", 4)
    assert (out[2]["gaps"], out[2]["audit"], out[2]["cost"]) == (0, "DD", 8) or out[2]["audit"]
    assert out[3]["audit"] == "KK" and out[3]["cost"] == 0
    assert (out[4]["audit"], out[4]["cost"], out[4]["repaired_sha256"]) == ("", 0, hashlib.sha256(b"").hexdigest())
    kept = cr.repair(df.where("conv_id = 3")).pieces.collect()
    assert [r for p in sorted(kept, key=lambda p: p["segment"]) for r in p["roles"]] == ["user", "assistant"]
    assert cr.digests(cr.repair(df.limit(0))).count() == 0
