"""The whole job, where an earlier version did less: no bars that rise with the corpus, no caps."""

import numpy as np
from pyspark.sql import functions as F

from marram.llm import language_id, secret_scan, suffix_tree_lm, url_filter


def test_lm_keeps_what_is_seen_a_few_times_in_a_large_corpus(spark, monkeypatch):
    filler = "the quick brown fox jumps over the lazy dog and runs away " * 400
    docs = spark.range(340).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 6, "say qzxjvkw now").when(F.col("id") < 46, "k bcdefx").when(F.col("id") < 86, "m bcdefy").otherwise(F.lit(filler)).alias("text"))
    model = suffix_tree_lm.Model(docs)
    key = lambda b: np.array([int.from_bytes(b, "big")], dtype=np.uint64)
    # Six of six million symbols, and a context that reaches into the word before.
    assert model.tree.log_p(key(b"zxjvk" + b"w"))[0] > np.log(0.2)
    assert model.tree.log_p(key(b"k bcdef" + b"x"))[0] > np.log(0.7) and model.tree.log_p(key(b"k bcdef" + b"y"))[0] < np.log(0.2)
    whole = {r["doc_id"]: r["score"] for r in model.score(docs, ["doc_id"]).collect()}
    monkeypatch.setattr(suffix_tree_lm, "PASS_ENTRIES", sum(model.slots.values()) // 3)
    assert len(model.passes()) > 2
    parts = {r["doc_id"]: r["score"] for r in model.score(docs, ["doc_id"]).collect()}
    assert len(parts) == 340 and all(abs(parts[i] - whole[i]) < 1e-6 * abs(whole[i]) for i in whole)


def test_secret_scan_finds_long_unlabelled_keys(spark):
    key = "".join("aZ3bY7cX1dW9eV5fU2gT"[i * 7 % 20] + "kP4mQ8nR6"[i * i % 9] for i in range(200))
    rows = [(1, f"see {key} here", "a"), (2, f"see {key[:300]}== and {key[:200]} here", "b")]
    out = {r["doc_id"]: r for r in secret_scan.with_digests(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert len(key) == 400 and out[1]["spans"] == "live:4:404"
    assert out[2]["spans"] == "live:4:306,live:311:511"


def test_language_filter_drops_foreign_texts_and_junk(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    foreign = ["Het weer is vandaag erg mooi en wij gaan naar het strand met de kinderen", "Tämä on suomenkielinen lause jossa kerrotaan päivän säästä ja uutisista", "这是一个中文句子", "Это русское предложение о погоде", "Αυτή είναι μια πρόταση", "zxq vbnk qwrt pldf xkcd jjkw"]
    own = spark.createDataFrame([(10**9 + 5 * i, t, None) for i, t in enumerate(foreign)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(own)
    stay = {r["doc_id"] for r in language_id.with_language(both).select("doc_id").collect()}
    lettered = [r["doc_id"] for r in docs.collect() if language_id.has_letter(r["text"])]
    assert not any(i >= 10**9 for i in stay)
    assert len(stay) >= 0.98 * len(lettered)


def test_url_lexicon_keeps_rare_words_of_hosts(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    pages = spark.createDataFrame([(f"cheap pills {long} " * 3 + "the and of " * 100_000, "x.com"), ("", f"cheappills{long}.cheap.org")], "html string, host string")
    parts = pages.select(F.explode(F.split("host", r"\.")).alias("part"))
    split = {r["part"]: r["words"] for r in url_filter.segmented(parts, *url_filter.word_counts(pages, "html")).collect()}
    assert split["cheappills" + long] == ["cheap", "pills", long] and split["x"] == ["x"]


def test_lm_reads_texts_once_however_large_the_tree(spark, small_dir, monkeypatch):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").where("n_chars < 3000").limit(100).select("doc_id", "text")
    docs = spark.createDataFrame([*docs.collect(), (-1, None), (-2, "é "), (-3, "Never-seen never-seen")], docs.schema)
    model = suffix_tree_lm.Model(docs.where("doc_id > 0"), word_share=0.01)
    assert len(model.frequent) < model.types
    texts = {r["doc_id"]: suffix_tree_lm.words_of(r["text"]) for r in docs.collect()}
    counts = {r["w"]: r["n"] for r in model.words.collect()}
    monkeypatch.setattr(suffix_tree_lm, "PASS_ENTRIES", sum(model.slots.values()) // 20)
    assert len(model.passes()) > 10
    stored_tables = []
    monkeypatch.setattr(suffix_tree_lm, "stored", lambda df, keep=suffix_tree_lm.stored: stored_tables.append(df) or keep(df))
    rows = model.score(docs, ["doc_id"]).collect()
    assert len(stored_tables) == 2 and len(rows) == len(texts)  # texts as blocks, scores: no more with more parts
    whole = model.tree
    for r in rows:
        words = texts[r["doc_id"]]
        keys, _ = suffix_tree_lm.windows([words])
        assert abs(r["score"] - whole.log_p(keys).sum() / np.log(10)) < 2e-6 * len(keys)
        known = [counts.get(w, 0) for w in [*words, b"\n"]]
        assert (r["n_tokens"], r["n_known"]) == (len(known), sum(n > 0 for n in known))
        assert abs(r["base_score"] - sum(np.log10((n + 1) / (model.tokens + model.types + 1)) for n in known)) < 1e-6


def test_lm_blocks_of_one_text_give_the_same_scores(spark, monkeypatch):
    texts = ["a rose is a rose", "", "is a rose", "x" * 300, "the end"] * 5
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    data = b"".join(suffix_tree_lm.symbols_of(suffix_tree_lm.words_of(t)) for t in texts)
    parts = (np.arange(suffix_tree_lm.SLOTS) % 7).astype(np.uint16)
    grams, order, spans = suffix_tree_lm._grams_of(memoryview(data), lengths, parts)
    keys, counted = suffix_tree_lm.windows([suffix_tree_lm.words_of(t) for t in texts])
    assert (counted == lengths).all() and set(suffix_tree_lm.far_first(grams).tolist()) == set(keys.tolist())
    assert sorted(order.tolist()) == list(range(len(grams))) and spans[-1][2] == len(grams)
    logs = np.arange(len(grams), dtype=np.int32)
    sums = suffix_tree_lm._sums(memoryview(data), lengths, grams, logs)
    monkeypatch.setattr(suffix_tree_lm, "PIECE_SYMBOLS", 10)
    monkeypatch.setattr(suffix_tree_lm, "LOOKUP_SYMBOLS", 10)
    again = suffix_tree_lm._grams_of(memoryview(data), lengths, parts)
    assert (again[0] == grams).all() and (suffix_tree_lm._sums(memoryview(data), lengths, grams, logs) == sums).all()


def test_lm_blocks_get_their_logs_in_turns(spark, small_dir, monkeypatch):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").where("n_chars < 3000").limit(60).select("doc_id", "text").repartition(9)
    model = suffix_tree_lm.Model(docs)
    whole = {r["doc_id"]: r["score"] for r in model.score(docs, ["doc_id"]).collect()}
    monkeypatch.setattr(suffix_tree_lm, "ROUND_BLOCKS", 2)
    turns, sums_of = [], model._sums_of

    def noted(blocks, *rest):
        turns.append({r["block"] for r in blocks.select("block").collect()})
        return sums_of(blocks, *rest)

    monkeypatch.setattr(model, "_sums_of", noted)
    assert {r["doc_id"]: r["score"] for r in model.score(docs, ["doc_id"]).collect()} == whole
    # No turn has all the blocks on disk, and each block has one turn.
    assert len(turns) == suffix_tree_lm.ROUNDS and sum(map(len, turns)) == len(set.union(*turns)) > max(map(len, turns))


def test_lm_sums_are_exact_where_grams_share_a_mark(monkeypatch):
    texts = [bytes(t).split() for t in np.random.default_rng(1).integers(97, 123, (40, 500), dtype=np.uint8)]
    data, lengths = b"".join(map(suffix_tree_lm.symbols_of, texts)), np.array([len(suffix_tree_lm.symbols_of(t)) - 7 for t in texts])
    grams, _, _ = suffix_tree_lm._grams_of(memoryview(data), lengths, np.zeros(suffix_tree_lm.SLOTS, np.uint16))
    logs = -np.arange(len(grams), dtype=np.int32) ** 2 % 999_983
    keys = suffix_tree_lm.near_first(suffix_tree_lm.windows(texts)[0])
    exact = np.add.reduceat(logs[np.searchsorted(grams, keys)].astype(np.int64), np.r_[0, np.cumsum(lengths)[:-1]])
    for spread in (suffix_tree_lm._SPREAD, np.uint64(1 << 40 | 1), np.uint64(1)):  # the last ones spread next to nothing, so most grams share
        monkeypatch.setattr(suffix_tree_lm, "_SPREAD", spread)
        for most in (1 << 21, 777):
            monkeypatch.setattr(suffix_tree_lm, "LOOKUP_SYMBOLS", most)
            monkeypatch.setattr(suffix_tree_lm, "FEW_SYMBOLS", most // 3)
            assert (suffix_tree_lm._sums(memoryview(data), lengths, grams, logs) == exact).all()


def test_lm_part_of_the_tree_without_entries_gives_none():
    none = np.zeros(0, np.uint64)
    empty = (none, np.zeros(0), np.zeros(0, np.int64), none, np.zeros(0), np.zeros(0, bool))
    assert list(suffix_tree_lm._entries([empty] * 5)) == []
