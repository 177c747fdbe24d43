"""Inputs that are long in one place: host labels, broken mark-up, conversations; and credentials beside an equals sign."""

import random
import re
import time

from marram.llm import chat_format, secret_scan, url_filter


def test_markup_is_cut_as_by_its_patterns_in_linear_time():
    pattern = re.compile(r"<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>", re.DOTALL)
    rng = random.Random(1)
    pieces = ["<", "<", ">", "<script>", "</script>", "<style ", "</style>", "a", "b ", "scripts", "<scripts>"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 12)))
        assert url_filter.without_markup(text) == pattern.sub(" ", text)
    began = time.time()
    for text in ("<" * 1_000_000, "<script>" * 120_000, "<a <" * 250_000):
        url_filter.without_markup(text)
    assert time.time() - began < 10


def test_a_long_label_meets_the_words_in_it(spark):
    rng = random.Random(2)
    label = "cheap" + "".join(rng.choices("qxz", k=20_000)) + "pills"
    rows = [(1, f"https://{label}.com/x", f"{label} {label} cheap cheap pills pills"), (2, "https://cheapqpills.net/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pieces = spark.createDataFrame([(7, label)], "at long, part string").mapInArrow(url_filter._pieces([1, 5, len(label)]), "at long, hash long")
    assert pieces.count() <= 2 * len(label)
    out = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert out[1]["host"] == f"{label}.com" and len(out) == 2
    parts = spark.createDataFrame([(label,), ("cheapqpills",)], "part string")
    split = {r["part"]: r["words"] for r in url_filter.segmented(parts, *url_filter.word_counts(pages, "html")).collect()}
    assert split[label] == [label] and split["cheapqpills"] == ["cheap", "q", "pills"]


def test_a_very_long_conversation(spark):
    n = 100_000
    turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('text <', id, '> é') AS text")
    began = time.time()
    chats = chat_format.format_chats(turns)
    row = chat_format.digests(chat_format.read_back(chats)).first()
    assert time.time() - began < 60 and row["n_turns"] == n
    said = [f"text <{i}> é" for i in range(n) if i % 3]
    assert row["loss_chars"] == sum(map(len, said))
    made = chats.first()
    assert [made["formatted"][s["start"] : s["stop"]] for s in made["loss_mask"][:3]] == [s.replace("<", "&lt;") for s in said[:3]]


def test_candidates_beside_an_equals_sign():
    key = "tR7xQ2mN9vKp4LzW8sYb3HcD"
    for text in (f"AUTH={key}", f"export DB_PW={key}", f"https://h/x?sig={key}", f"{key}=x", f"a={key}&b=1", f"sig={key}=="):
        assert [s[3].rstrip("=") for s in secret_scan.loose_spans(text, secret_scan.base_spans(text))] == [key], text
    for text in ("/usr/lib/python3/dist-packages/Numpy4/core", "x=" + "a" * 30, "PATH=/opt/tools/bin/v2/share/Doc9/more"):
        assert secret_scan.loose_spans(text, secret_scan.base_spans(text)) == []
