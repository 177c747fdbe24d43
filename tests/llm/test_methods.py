"""The methods' own output against plain versions written from their definitions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marram.llm import bpe, chat_format, language_id, mixing, near_dedup, queries, secret_scan, suffix_tree_lm, topk_search, url_filter
from marram.llm.components import components
from marram.llm.vocabulary import default_vocabulary
from tests.llm.test_brute_force import brute_groups


# op1


def test_topk_passes_over_most_postings():
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids = rows["vec_id"].to_numpy()
    m, _ = topk_search.matrix(rows["embedding"].to_pylist(), 64)
    shard = topk_search.Shard(ids, m)
    asked = np.flatnonzero(ids % 50 == 0)
    bests = [topk_search.Best(5) for _ in asked]
    work = topk_search.search_shard(shard, ids[asked], m[asked], bests)
    scores = m[asked] @ m.T
    for best, q, own in zip(bests, asked, scores, strict=True):
        want = sorted(((int(s), int(i)) for s, i in zip(own, ids, strict=True) if i != ids[q]), key=lambda r: (-r[0], r[1]))[:5]
        assert best.rows == want
    # Without a bar from other rows: 61 % of the postings of these vectors, which have no clusters.
    assert work < 0.65 * len(asked) * (m != 0).sum()
    again = [topk_search.Best(5, float(b.bar)) for b in bests]
    assert topk_search.search_shard(shard, ids[asked], m[asked], again) < 0.5 * len(asked) * (m != 0).sum()
    assert [b.rows for b in again] == [b.rows for b in bests]


# op2


def test_secret_verdicts(spark):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789+/_-"))
    keys = ["".join(rng.choice(letters, int(rng.integers(20, 60)))) for _ in range(40)]
    rows = []
    for i in range(400):
        k = int(rng.integers(0, len(keys) - 4)) if i % 4 else 39
        owner = [f"o{k}", f"o{k}" if i % 5 else f"p{k}", ["a", "b", None, "c"][i % 3]][k % 3 if k != 39 else 1]
        rows.append((i, f"words {'token = ' if i % 2 else ''}{keys[k]} here", owner))
    owners, repos, found = defaultdict(set), defaultdict(set), {}
    for i, text, owner in rows:
        base = secret_scan.base_spans(text)
        found[i] = [(s, k, e, v, 3.0) for s, e, k, v in base]
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", text):
            if not any(s < m.end() and m.start() < e for s, e, _, _ in base):
                found[i].append((m.start(), 3, m.end(), m[0], 3.5))
    random = lambda v, bits: any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values()) >= bits
    for i, _, owner in rows:
        found[i] = [f for f in found[i] if f[1] < 3 or random(f[3], 3.5)]
        for f in found[i]:
            owners[f[3]].add(owner or "")
            repos[f[3]].add(i)
    want = {}
    for i, _, _ in rows:
        want[i] = []
        for s, k, e, v, _ in sorted(found[i]):
            n, r = len(owners[v]), len(repos[v])
            verdict = "copied" if n >= 3 or (n == 2 and r >= 20) else "live" if n == 1 and random(v, 3.0) else "plain"
            if k < 3 or verdict == "live":
                want[i].append((s, k, e, verdict, r))
    got = {r["doc_id"]: [(s["start"], s["kind"], s["stop"], s["verdict"], s["n_repos"]) for s in r["spans"]] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == want
    assert {v for spans in want.values() for *_, v, _ in spans} == {"copied", "live", "plain"}


# op3


def test_huge_buckets_are_banded_again(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows, shared = [], [f"s{k}" for k in range(60)]
    for i in range(60):  # half of each text is common to all, so that many buckets hold most rows
        own = [f"u{i}_{k}" for k in range(45)]
        rows.append((2 * i, " ".join(shared + own)))
        own[int(rng.integers(0, 45))] = "changed"
        rows.append((2 * i + 1, " ".join(shared + own)))
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "REBAND", 8)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 4)
    monkeypatch.setattr(near_dedup, "SET_SHINGLES", 500)
    monkeypatch.setattr(near_dedup, "PIVOT_PAIRS", 3)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_a_huge_bucket_moves_rows_in_proportion(spark):
    """Blocks copy a row to rows / BLOCK units, and from REBAND rows on to one bucket a band: never more than BANDS times."""
    assert near_dedup.REBAND <= near_dedup.BLOCK * near_dedup.BANDS
    rng = np.random.default_rng(4)
    n = 50_000
    ids = spark.range(n).select(F.col("id"))
    labelled = ids.select(F.lit(7).cast("long").alias("bk"), "id", F.col("id").alias("component"))
    bands = [int(b) for b in rng.integers(1, 2**60, 1)]
    reps = ids.select("id", F.lit(100).cast("long").alias("n_shingles"), F.unhex(F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2(F.concat(F.col("id"), F.lit("x")), 512))).alias("sig"), F.array(F.lit(7).cast("long"), F.lit(bands[0]).cast("long"), F.xxhash64("id")).alias("bands"))
    links = near_dedup._loose_links(labelled, reps)
    assert links.count() == 0
    copies = near_dedup._units(labelled.withColumnRenamed("bk", "key").withColumn("n", F.lit(1)).withColumn("sig", F.lit(b"")).withColumn("own", F.pmod("id", F.lit(7)).cast("int")).withColumn("from", F.lit(0)).withColumn("to", F.lit(-(-n // near_dedup.BLOCK) - 1)), ["from", "to"], []).count()
    assert copies <= near_dedup.BANDS * n


def test_dividing_a_huge_bucket_leaves_the_candidate_pairs_as_they_are(spark, monkeypatch):
    """Pairs that share one bucket alone, and look alike in as few places as a link may, meet however many rows the bucket has."""
    rng = np.random.default_rng(5)
    least = near_dedup.least_agreeing()
    assert near_dedup.estimate((least - 1) / near_dedup.PLACES) < near_dedup.LEAST_ESTIMATE <= near_dedup.estimate(least / near_dedup.PLACES)
    common = rng.integers(0, 256, near_dedup.PLACES, dtype=np.uint8)
    rows = []
    for k in range(40):
        own = np.where(np.arange(near_dedup.PLACES) < 50, common, rng.integers(0, 256, near_dedup.PLACES, dtype=np.uint8))
        other, differ = own.copy(), rng.permutation(near_dedup.PLACES)[: near_dedup.PLACES - least + k % 2]
        other[differ] += np.uint8(1)
        rows += [(2 * k, 100, own.tobytes(), [7, 1000 + 2 * k]), (2 * k + 1, 100, other.tobytes(), [7, 1001 + 2 * k])]
    reps = spark.createDataFrame([(i, n, bytearray(sig), bands) for i, n, sig, bands in rows], "id long, n_shingles long, sig binary, bands array<long>")
    labelled = reps.select(F.lit(7).cast("long").alias("bk"), "id", F.col("id").alias("component"))
    groups = lambda: sorted(map(tuple, components(near_dedup._loose_links(labelled, reps)).collect()))
    whole = groups()
    assert len(whole) == 40
    monkeypatch.setattr(near_dedup, "REBAND", 8)
    assert groups() == whole


# op4


@pytest.mark.parametrize("good,bad,n", [(30, 50, 20), (9 * 10**8, 10**8, 10**6), (10**9, 2 * 10**9, 10**8), (10**12, 10**13, 10**10)])
def test_the_urn_follows_one_law_at_every_size(good, bad, n):
    rng = np.random.default_rng(5)
    drawn = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(4000)], dtype=float)
    total = good + bad
    sd = math.sqrt(n * good / total * bad / total * (total - n) / (total - 1))
    assert abs(drawn.mean() - n * good / total) < 4 * sd / math.sqrt(len(drawn))
    assert abs(drawn.std() / sd - 1) < 0.05


def test_the_urn_is_exact():
    rng = np.random.default_rng(6)
    drawn = np.bincount([mixing.hypergeometric(rng, 6, 5, 4) for _ in range(50_000)], minlength=5) / 50_000
    want = [math.comb(6, k) * math.comb(5, 4 - k) / math.comb(11, 4) for k in range(5)]
    assert np.abs(drawn - want).max() < 0.012


def test_runs_of_shards_are_dealt_as_by_one_task():
    owed = [1000, 0, 7, 2500, 123]
    one = [(a, b, o, g) for a, b, o, g in mixing.dealt(owed, [0] * 5, 0, 91, 40, 1, 3)]
    split = [x for a, b, o, g in mixing.dealt(owed, [0] * 5, 0, 91, 40, 10, 3) for x in mixing.dealt(o, g, a, b, 40, 1, 3)]
    assert one == split and [a for a, *_ in one] == list(range(91))
    assert [sum(o[i] for _, _, o, _ in one) for i in range(5)] == owed
    assert all(sum(o) == 40 for _, _, o, _ in one[:90])
    for i in range(5):
        assert [g[i] for *_, g in one] == [sum(o[i] for _, _, o, _ in one[:k]) for k in range(91)]


def test_taken_words_by_a_plain_walk(spark, small_dir, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 50)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    for rows in (docs, docs.unionByName(docs.where("doc_id % 3 = 0")).withColumn("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")))):
        got = Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in mixing.mix(rows).collect())
        held = [(r["doc_id"], r["source"], len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))) for r in rows.collect()]
        by = defaultdict(list)
        for r in held:
            by[r[1]].append(r)
        names = sorted(by, key=lambda s: (s is None, s or ""))
        sizes = [sum(r[2] for r in by[s]) for s in names]
        want = Counter()
        for source, size, target in zip(names, sizes, mixing.targets(sizes, [1 + i % 3 for i in range(len(names))]), strict=True):
            words = [0] * size  # how often the mix takes each word of the source
            slots, last = mixing.plan_slots(size, target)
            blocks, whole = -(-size // 256), size // 256
            for slot in range(slots):
                index = slot % blocks
                if index < whole:
                    index = int(mixing.permuted(source, np.array([slot // blocks]), np.array([index]), whole)[0])
                for w in range(index * 256, min(size, index * 256 + (last if slot == slots - 1 else 256))):
                    words[w] += 1
            at = 0
            for r in sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
                want[(*r, sum(words[at : at + r[2]]))] += 1
                at += r[2]
        assert got == want


# op6


def plain_tree(texts):
    """log p of each text by the definition, with dictionaries of byte strings."""
    depth, least, prior = 7, 2, 16.0
    counts = [Counter() for _ in range(depth + 1)]  # edges by context length
    data = [b"\n" * depth + b" ".join((t or "").encode().lower().split()) + b"\n" for t in texts]
    for d in data:
        for i in range(depth, len(d)):
            for length in range(depth + 1):
                counts[length][d[i - length : i + 1]] += 1
    root = {s: counts[0][bytes([s])] + 1 for s in range(256)}
    n = sum(root.values())
    root = {s: v / n for s, v in root.items()}
    edges, gamma, kept = [{}], [{}], [set()]

    def p(context, symbol, longest, only_kept=False):
        for length in range(longest, 0, -1):
            c = context[len(context) - length :]
            if c in gamma[length] and (not only_kept or length <= 2 or c in kept[length]):
                if c + symbol in edges[length]:
                    return edges[length][c + symbol]
                return gamma[length][c] * p(context, symbol, length - 1, only_kept)
        return root[symbol[0]]

    for length in range(1, depth + 1):
        of = Counter()
        for e, k in counts[length].items():
            of[e[:-1]] += k
        known = {c for c, k in of.items() if k >= least}
        seen, below = defaultdict(dict), defaultdict(dict)
        for e, k in counts[length].items():
            if k >= least and e[:-1] in known:
                seen[e[:-1]][e] = k
                below[e[:-1]][e] = p(e[1:-1], e[-1:], length - 1)
        edges.append({})
        gamma.append({})
        kept.append(set())
        for c in known:
            total, mass, under = of[c], 0.0, sum(below[c].values())
            for e, k in seen[c].items():
                edges[length][e] = (k + prior * below[c][e]) / (total + prior)
                mass += edges[length][e]
            rest, rest_under = total - sum(seen[c].values()), max(1 - under, 1e-12)
            gamma[length][c] = max(1 - mass, 1e-12) / rest_under
            kl = sum(k * math.log(k / total / below[c][e]) for e, k in seen[c].items()) + (rest * math.log(rest / total / rest_under) if rest else 0)
            if kl / total >= 0.005 and 2 * kl >= 20:
                kept[length].add(c)
    for length in range(depth, 3, -1):
        kept[length - 1] |= {c[1:] for c in kept[length]}
    return lambda text: sum(math.log10(p(d[i - depth : i], d[i : i + 1], depth, True)) for d in [b"\n" * depth + b" ".join((text or "").encode().lower().split()) + b"\n"] for i in range(depth, len(d)))


def test_tree_scores_by_the_definition(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").where("n_chars < 3000").limit(60)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    rows = docs.collect()
    score = plain_tree([r["text"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2])
    got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score_documents(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]] == pytest.approx(score(r["text"]), rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_squeezed_grams_come_back(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    counts = rng.integers(1, 2**32, len(keys)).astype(np.int64)
    k, c = suffix_tree_lm.unsqueezed(suffix_tree_lm.squeezed(keys, counts), len(keys))
    assert (k == keys).all() and (c == counts).all()


def test_lm_reruns_agree_to_the_last_digit(spark, small_dir, monkeypatch):
    monkeypatch.setattr(suffix_tree_lm, "WORD_SHARE", 0.01)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    own = lambda d: sorted((r["doc_id"], r["base_score"], r["score"]) for r in suffix_tree_lm.score_documents(d).collect())
    assert own(docs) == own(docs.repartition(7))


# op7


def plain_verdicts(pages):
    """(page_id, verdict) by the definition: lexicon, best split of every part, naive Bayes on the tokens."""
    words = Counter()
    for _, _, html in pages:
        words.update(re.findall(r"[^\W\d_]+", re.sub(r"(?s)<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>", " ", html or "").lower()))
    total = sum(words.values())
    log_p, unknown = {w: math.log(n / total) for w, n in words.items() if n >= 2}, -math.log(total + 1) - 1

    def split(part):
        best = {0: (0.0, [])}
        for end in range(1, len(part) + 1):
            found = []
            for start in range(end):
                piece = part[start:end]
                costs = [unknown * (0.1 + 0.9 * len(piece))] + ([log_p[piece]] if piece in log_p else [])
                found.append((best[start][0] + max(costs), -start, start))
            top = max(f[0] for f in found)
            _, _, start = max((f for f in found if f[0] > top - 1e-9), key=lambda f: f[1])
            best[end] = (top, best[start][1] + [part[start:end]])
        return best[len(part)][0], best[len(part)][1]

    def cost(words_):
        return sum(max([unknown * (0.1 + 0.9 * len(w))] + ([log_p[w]] if w in log_p else [])) for w in words_)

    return split, cost


def test_url_splits_are_the_likeliest(spark, small_dir):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()]
    split, cost = plain_verdicts(pages)
    frame = spark.read.parquet(f"{small_dir}/pages.parquet")
    hosts = {re.match(r"(?s).*?://([^/?#]*)", u)[1].lower() for _, u, _ in pages if u and "://" in u}
    parts = {p for h in hosts for p in url_filter.host_parts(h)} | {"thehostnews", "cheapxqzt", "a1b2"}
    made = spark.createDataFrame([(p,) for p in sorted(parts)], "part string")
    got = {r["part"]: r["words"] for r in url_filter.segmented(made, *url_filter.word_counts(frame, "html")).collect()}
    assert set(got) == parts
    for part, words in got.items():
        assert "".join(words) == part and cost(words) == pytest.approx(split(part)[0], abs=1e-6)


def test_url_verdicts_by_plain_naive_bayes(spark, small_dir):
    frame = spark.read.parquet(f"{small_dir}/pages.parquet")
    own = url_filter.judge(frame).collect()
    pages = [(r["page_id"], r["url"], r["html"]) for r in frame.collect()]
    parts = {p for r in own for p in url_filter.host_parts(r["host"])}
    made = spark.createDataFrame([(p,) for p in sorted(parts)], "part string")
    split = {r["part"]: r["words"] for r in url_filter.segmented(made, *url_filter.word_counts(frame, "html")).collect()}

    def tokens(host, path):
        labels = [x for x in host.split(".") if x]
        out = ["h." + labels[-1]] if labels else []
        out += ["h:" + w for x in labels[:-1] for p in re.findall(r"[^\W_]+", x) for w in split[p]]
        return out + [f"p:#{len(p)}" if p.isdigit() else "p:" + p for p in re.findall(r"[^\W_]+", path.lower())]

    counts, rows = {"allow": Counter(), "block": Counter()}, Counter()
    for r in own:
        if r["rule"]:
            counts[r["verdict"]].update(tokens(r["host"], r["path"]))
            rows[r["verdict"]] += 1
    used = set(counts["allow"]) | set(counts["block"])
    log = lambda t, v: math.log((counts[v][t] + 1) / (sum(counts[v].values()) + len(used)))
    assert len(own) == len(pages) and any(not r["rule"] for r in own)
    for r in own:
        margin = math.log((rows["block"] + 1) / (rows["allow"] + 1)) + sum(log(t, "block") - log(t, "allow") for t in tokens(r["host"], r["path"]) if t in used)
        assert r["margin"] == pytest.approx(margin, abs=1e-9)
        if not r["rule"] and abs(margin) > 1e-9:
            assert r["verdict"] == ("block" if margin > 0 else "allow")


def test_very_long_urls(spark):
    rows = [(1, "x://" + "ab" * 3000 + ".com/en/" + "p/" * 50_000, "ab ba ab"), (2, "x://" + "a." * 5000 + "net/de/", "ab")]
    out = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1]["verdict"] == "block" and out[2]["verdict"] == "allow" and len(out[1]["path"]) == 100_004


# op8


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": None}, {"added_tokens": [{"id": 0, "content": "x", "lstrip": True}]}])
def test_bpe_refuses_files_that_ask_for_more(change):
    spec = {"model": {"type": "BPE", "vocab": {}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "decoder": {"type": "ByteLevel"}}
    bpe.refuse_unknown(spec)
    with pytest.raises(ValueError):
        bpe.refuse_unknown(spec | change)
    bpe.known_vocabulary(default_vocabulary())


# op9


def test_the_loss_mask_covers_each_text_of_the_role_once(spark):
    rows = [(c, t, ["user", "assistant", "assistant", "sys"][(c * 7 + t * t) % 4], f"é<{c}> & t{t} [x]" * (t % 3)) for c in range(20) for t in range(c % 9 + 1)]
    for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        want = [x for c, _, role, x in rows if c == r["conv_id"] and role == "assistant"]
        back = [r["formatted"][s["start"] : s["stop"]].replace("&#93;", "]").replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&") for s in r["loss_mask"]]
        assert back == want


def test_a_very_long_conversation(spark):
    turns = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.concat(F.lit("w<"), F.col("id").cast("string")), 20).alias("text"))
    long = spark.createDataFrame([(2, 0, "assistant", "long & " * 300_000)], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat_format.digests(chat_format.read_back(chat_format.format_chats(turns.unionByName(long)))).collect()}
    assert out[1]["n_turns"] == 3000 and out[1]["loss_chars"] == sum(20 * len(f"w<{i}") for i in range(3000) if i % 3)
    assert out[2]["loss_chars"] == 2_100_000


# op10


def test_language_scores_by_a_plain_kernel(spark, small_dir):
    docs = [r for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect() if r["text"] and r["lang"]][:90]
    places = [language_id.presence(r["text"]) for r in docs]
    train, test = list(range(60)), list(range(60, len(docs)))
    langs = [docs[i]["lang"] for i in train]
    model = language_id.fit([language_id.packed(places[i]) for i in train], langs, landmarks=24)
    sets = [set(p.tolist()) for p in places]
    kernel = lambda a, b: len(sets[a] & sets[b]) / math.sqrt(max(len(sets[a]), 1) * max(len(sets[b]), 1))
    names = sorted(set(langs))
    own = {c: [i for i in train if langs[i] == c] for c in names}
    marks = [i for turn in range(60) for c in names for i in own[c][turn : turn + 1]][:24]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    root = vectors[:, values > 1e-6 * values[-1]] / np.sqrt(values[values > 1e-6 * values[-1]])
    features = np.array([[kernel(i, b) for b in marks] for i in train]) @ root
    weight = np.array([1 / len(own[c]) for c in langs])[:, None]
    wanted = np.array([[1.0 if c == n else -1.0 for n in names] for c in langs])
    solved = np.linalg.solve(features.T @ (weight * features) + language_id.RIDGE * np.eye(features.shape[1]) / 60, features.T @ (weight * wanted))
    want = np.array([[kernel(i, b) for b in marks] for i in test]) @ root @ solved
    assert np.abs(model.scores([places[i] for i in test]) - want).max() < 2e-3
    assert model.languages == names


def test_every_language_is_learned(spark):
    """More languages than landmarks and than any former bound: each has its own letters and is told apart."""
    rows = [(i * 3 + k, f"{chr(0x4E00 + 7 * i)}{chr(0x4E01 + 7 * i)}{chr(0x4E02 + 7 * i)} " * (k + 2), f"l{i:04d}") for i in range(620) for k in range(3)]
    labelled = spark.createDataFrame([(lang, text, i) for i, text, lang in rows], "lang string, text string, key long")
    model = language_id.learn(labelled)
    assert len(model.languages) == 620
    values = model.scores([language_id.presence(t) for _, t, _ in rows[::3]])
    right = np.mean([model.languages[int(v.argmax())] == r[2] for v, r in zip(values, rows[::3], strict=True)])
    assert right > 0.95


def test_packed_places_come_back():
    for n in (0, 5, 6143, 6144, 100_000):
        places = np.sort(np.random.default_rng(n).choice(3 << 16, n, replace=False)).astype(np.int32)
        assert (language_id.unpacked(language_id.packed(places)) == places).all() and len(language_id.packed(places)) <= 24_577


# helpers


def test_scratch_removes_what_it_stored(spark):
    from marram.llm import common

    with common.scratch(spark) as keep:
        gone = common.stored(spark.range(3))
        gone_at = common.last_stored()
        stays = common.stored(gone.where("id > 0"))
        keep.append(common.last_stored())
    assert stays.count() == 2 and gone_at not in common._STORED
    path = spark._jvm.org.apache.hadoop.fs.Path(gone_at)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    common.discard(spark, keep)


def test_spread_join_equals_join(spark):
    from marram.llm import common

    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.max("id").alias("m"))
    got = common.spread_join(rows, table, ["k"], "rows", 5000)
    want = rows.join(table.drop("rows"), "k")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
