"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
from fractions import Fraction

import pytest
import corpus_pipeline
from pyspark.sql import functions as F

from marram.llm import bpe, chat_format, exact_dedup, language_id, mixing, near_dedup, secret_scan, suffix_tree_lm, topk_search, url_filter
from marram.llm.vocabulary import default_vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x" for i in range(60_000))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", None, 3),
    (4, "one two three four five six seven", "en", "a", 1),
    (4, "one two three four five six seven", "en", "a", 1),
    (5, "one  two\tthree four five six seven", "de", "b", 1),
    (6, LONG, "en", "b", 1),
    (7, "password: hunter22 12345", "fr", "c", 1),
    (None, "ein zwei drei vier fünf", "de", "b", 1),
    (8, "12 34 ...", "de", "b", 1),
]
CLASHES = ["size", "row_id", "digest", "keep_id", "kept", "id", "component", "n", "key", "held_out", "lang_pred", "score", "spans", "owner", "repo", "start", "stream", "taken", "w", "g", "h", "copy", "bk", "sig", "ids", "__text", "gone_id", "uses", "of_id", "__size", "__copy", "of_key", "sha", "rows", "bar", "text_key", "d1", "component_id", "n_shingles", "copies", "of_source", "turn", "n_tokens", "round_trip", "decoded"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


OPERATORS = {
    "secret_scan": lambda d: secret_scan.with_digests(secret_scan.scan(d)),
    "near_dedup": near_dedup.near_dedup,
    "mixing": mixing.mix,
    "exact_dedup": exact_dedup.exact_dedup,
    "lm": suffix_tree_lm.score_documents,
    "bpe": lambda d: bpe.encode_digests(d, default_vocabulary()),
    "language_id": language_id.identify,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each_and_clashing_columns_change_nothing(name, docs, clashing, empty):
    run = OPERATORS[name]
    plain = sorted(map(repr, run(docs).collect()))
    assert len(plain) == len(ROWS)
    assert sorted(map(repr, run(clashing).collect())) == plain
    assert run(empty).count() == 0


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", STAGES)
def test_stages_take_clashing_columns_and_empty_tables(name, spark, docs, clashing, empty):
    stage = STAGES[name]
    plain = stage(spark, docs, "")
    got = stage(spark, clashing, "")
    if name != corpus_pipeline.STAGES[-1][0]:
        assert plain.columns == docs.columns and got.columns == clashing.columns
    rows = sorted(map(repr, plain.collect()))
    assert sorted(map(repr, got.select(plain.columns).collect())) == rows and rows
    assert stage(spark, empty, "").count() == 0


def test_near_dedup_judges_rows_that_repeat_an_id_by_their_texts(spark):
    one, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, one), (2, one + " more"), (2, other), (3, other.upper()), (3, "all by itself here now")]
    stay = near_dedup.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in stay) == sorted([(1, one), (2, other), (3, "all by itself here now")])
    rows = [(1, one), (1, one.upper()), (1, other)]
    stay = near_dedup.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(stay) == 2 and other in {r["text"] for r in stay}


def test_exact_dedup_keeps_one_of_tied_rows(docs):
    rows = exact_dedup.exact_dedup(docs).collect()
    of = lambda i: [r for r in rows if r["doc_id"] == i]
    assert [r["kept"] for r in of(4)].count(True) == 1 and of(4)[0]["group_size"] == 3
    assert of(5)[0]["keep_id"] == 4 and not of(5)[0]["kept"]
    assert of(2)[0]["keep_id"] == 1 and of(2)[0]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert of(3)[0]["keep_id"] == 3
    assert of(None)[0]["kept"]
    stay = exact_dedup.without_copies(docs)
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in stay.collect()) == [0, 1, 3, 4, 6, 7, 8]


def test_index_takes_batches_and_repeats(spark, docs):
    index = exact_dedup.DigestIndex(spark, "batches_index", 3)
    try:
        first = exact_dedup.digests(docs.where("doc_id < 5"))
        index.add(first)
        n = index.table().count()
        index.add(first)
        assert index.table().count() == n == 3
        everything = exact_dedup.digests(docs)
        plan = index.new(everything)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "LeftAnti" in plan
        index.add(everything)
        assert index.table().count() == everything.select("digest").distinct().count()
        with index.locked(), pytest.raises(RuntimeError):
            index.add(first)
        index.add(first)
    finally:
        index.drop()


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_batches_come_in_order_of_ids_and_change_nothing(docs, batches):
    rows = exact_dedup.digests(docs)
    parts = [[r["doc_id"] for r in b.collect()] for b in exact_dedup.in_batches(rows, batches)]
    assert sorted(i or 0 for p in parts for i in p) == sorted(r["doc_id"] or 0 for r in rows.collect())
    known = [[i for i in p if i is not None] for p in parts if p]
    assert all(max(a) < min(b) for a, b in zip(known, known[1:]) if a and b) and None not in [i for p in parts[:-1] for i in p]
    got = exact_dedup.exact_dedup(docs, batches=batches)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, exact_dedup.exact_dedup(docs).collect()))


def test_near_dedup_defined_cases(docs):
    rows = near_dedup.near_dedup(docs).collect()
    assert {(r["doc_id"], r["n_shingles"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(1, 0), (2, 0), (3, 0)}
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert {(r["component_id"], r["kept"]) for r in rows if r["doc_id"] == 5} == {(4, False)}
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    assert {r["n_shingles"] for r in rows if r["doc_id"] == 8} == {1}
    assert sorted(r["doc_id"] or 0 for r in near_dedup.without_near_copies(docs).collect()) == [0, 1, 2, 3, 4, 4, 6, 7, 8]


def test_mixing_defined_cases(docs):
    rows = mixing.mix(docs).collect()
    assert {r["source"] for r in rows} == {None, "a", "b", "c"}
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    assert all(abs(t - target) <= 1 for t, target in by.values()), by
    assert sorted(map(repr, mixing.mix(docs.repartition(3)).collect())) == sorted(map(repr, rows))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = sum(len(r["text"].split()) for r in out.collect())
    assert words == sum(r["taken"] for r in rows)


def test_language_defined_cases(docs):
    rows = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3, 8))
    assert language_id.with_language(docs).columns == docs.columns
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_topk_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.5]), (7, []), (None, [1.0, 1.0]), (50, [-1.0, 0.25]), (8, [1e6, 1e6])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("v", "n", "ids", "unit", "score", "rank")})
    out = topk_search.top_k(v, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()
    first = [(r["vec_id"], r["score"]) for r in out if r["query_id"] == 0]
    big = spark.createDataFrame([(0, [2.0**70, 1.0]), (1, [2.0**50, 0.0]), (2, [2.0**50, 1.0]), (3, [2.0**50 + 2.0, 0.0]), (4, [-(2.0**50), 0.0])], "vec_id long, embedding array<double>")
    exact = topk_search.top_k(big.where("vec_id > 0").unionByName(big.where("vec_id = 0").withColumn("embedding", F.array(F.lit(2.0**30), F.lit(1.0)))), F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [(r["vec_id"], int(r["exact_score"])) for r in exact] == [(3, 2**16 * (2**80 + 2**31)), (2, 2**16 * (2**80 + 1)), (1, 2**96), (4, -(2**96))]
    assert [r["score"] for r in exact] == [2**63 - 1] * 3 + [-(2**63)]
    assert first == [(8, 256_000_000 * 384), (1, 256 * 256 + 128 * 128), (6, 128 * 256), (7, 0), (50, -256 * 256 + 64 * 128)]
    assert topk_search.top_k(v.where("false"), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_topk_of_the_largest_finite_components(spark):
    vectors = {0: [1.7e308, -3.5], 50: [0.3, 1e-300], 1: [1e307, 2.0], 2: [1e307, 1.0], 3: [-1e307, 0.0], 4: [0.5, 0.25], 5: [2.0**45 + 0.5, -0.001], 6: [5e-324, -5e-324], 7: [7.1e305, 1e200], 8: [1e150, -1e150]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"], int(r["exact_score"])) for r in topk_search.top_k(df, F.col("vec_id") % 50 == 0, 6).collect()}
    whole = {i: [Fraction(x) * 256 // 1 for x in v] for i, v in vectors.items()}
    for q in (0, 50):
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:6]
        assert [got[q, k] for k in range(1, 7)] == [(i, max(min(-s, 2**63 - 1), -(2**63)), -s) for s, i in scores]
    assert [topk_search.sort_key(a) for a in sorted([0, -1, 1, 255, 256, -256, -255, 10**400, -(10**400)])] == sorted(topk_search.sort_key(a) for a in [0, -1, 1, 255, 256, -256, -255, 10**400, -(10**400)])


def test_url_filter_defined_cases(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "HTTP://A.Example.COM/en/7?x#y", "<p>a b</p>"), (4, "x://b.com/en/", None), (5, "x://net/de/8", None), (6, "x://q.example.net/de/81", ""), (6, "x://q.example.net/de/81", ""), (None, "x://org#f", None), (7, "x://netx/de/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "word", "place")})
    out = url_filter.judge(pages).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert len(out) == len(rows)
    assert got[1][:3] == got[2][:3] == ("", "", None)
    assert got[3] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[4] == ("b.com", "/en/", "com/en/", "block")
    assert got[5] == ("net", "/de/8", "net/de/", "allow")
    assert got[6] == ("q.example.net", "/de/81", "example.net/de/8", "block")
    assert got[None][:3] == ("org", "", None) and got[7][2] is None
    assert url_filter.judge(pages.where("false")).count() == 0


def test_chat_defined_cases(spark):
    rows = [(1, 2, "assistant", "b"), (1, 0, "user", None), (1, 1, "user", "x</s>[SEP]&lt;"), (2, None, None, "q"), (2, 0, "assistant", ""), (2, 1, "assistant", "z[/INST]"), (None, 0, "r]o<le", "t"), (3, 0, "user", "tie"), (3, 0, "user", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("turns", "formatted", "blocks", "t")})
    parsed = {r["conv_id"]: [(b["role"], list(b["texts"])) for b in r["blocks"]] for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    assert parsed == {1: [("user", ["", "x</s>[SEP]&lt;"]), ("assistant", ["b"])], 2: [("", ["q"]), ("assistant", ["", "z[/INST]"])], None: [("r]o<le", ["t"])], 3: [("user", ["tie", "tie"])]}
    out = {r["conv_id"]: r for r in chat_format.digests(chat_format.read_back(chat_format.format_chats(turns))).collect()}
    assert out[2]["n_turns"] == 3 and out[2]["loss_chars"] == 8 and out[2]["loss_sha256"] == hashlib.sha256(b"z[/INST]").hexdigest()
    assert out[3]["loss_chars"] == 0
    assert chat_format.format_chats(turns.where("false")).count() == 0
