"""URL filter: host rules first, then naive Bayes on words segmented out of hosts and paths.

Concatenated host names are split by a unigram Viterbi search over a lexicon counted on the
corpus' own pages; each distinct part of a host meets the words that lie in it by a join, so no
task holds the lexicon. The tokens are judged by multinomial naive Bayes, learned from the URLs
that the rules decide; counts are kept by token and joined with the tokens of every URL.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.llm.common import ascii_lower, cut, small_batches, spread_join, stored

#: The rules of the contract, as (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: A lexicon word was seen this often at least, and lies in some host.
LEAST_COUNT = 2
#: Log odds are summed in this type, so that sums are the same in any order.
EXACT = "decimal(38,15)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct<rule, verdict>, or null. A rule holds for its host and all subdomains."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = None
    for verdict, h, p in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


@dataclass
class Segmenter:
    """Unigram Viterbi over log probabilities; unknown pieces cost by their length."""

    log_p: dict[str, float]
    unknown: float

    def __post_init__(self):
        self.lengths = sorted({len(w) for w in self.log_p}, reverse=True)

    def split(self, name: str) -> list[str]:
        """The likeliest words of a name; ties go to the longer last word. Linear in the name's length for a given set of word lengths."""
        n = len(name)
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        open_, start = -math.inf, 0  # the unknown piece, of any length, that is best so far, and its start
        for end in range(1, n + 1):
            own = best[end - 1] - self.unknown * 0.9 * (end - 1)
            if own > open_ + 1e-12:
                open_, start = own, end - 1
            best[end], back[end] = open_ + self.unknown * (0.1 + 0.9 * end), start
            for length in self.lengths:
                if length <= end and (p := self.log_p.get(name[end - length : end])) is not None:
                    score = best[end - length] + p
                    if score > best[end] + 1e-12 or (score > best[end] - 1e-12 and end - length < back[end]):
                        best[end], back[end] = score, end - length
        out, end = [], n
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]


_ALNUM = re.compile(r"[^\W_]+")


def host_parts(host: str) -> list[str]:
    """The letter and digit runs of a host's labels but the last."""
    return [part for label in [x for x in host.split(".") if x][:-1] for part in _ALNUM.findall(label)]


def host_tokens(host: str, words_of: dict[str, list[str]]) -> list[str]:
    """Segmented host words, marked h:, after the last label, marked h. ."""
    labels = [x for x in host.split(".") if x]
    return ["h." + x for x in labels[-1:]] + ["h:" + w for part in host_parts(host) for w in words_of[part]]


def path_tokens(path: str) -> list[str]:
    """Path words, marked p:, digits as their number of digits."""
    return [f"p:#{len(part)}" if part.isdigit() else "p:" + part for part in _ALNUM.findall(path.lower())]


_OPENS, _CLOSES = re.compile(r"<(?:script|style)\b"), re.compile(r"</(?:script|style)>")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Distinct words that a task holds before it passes its counts on.
HELD_WORDS = 200_000


def without_markup(html: str) -> str:
    """Tags, and scripts and styles with what is in them, as one space each; what is never closed stays. One walk, linear in the page."""
    out, at, closed = [], 0, 0  # ``closed``: end of the next closing mark of a script or style, -1 if there is none
    while (i := html.find("<", at)) >= 0:
        out.append(html[at:i])
        end = -1
        if closed >= 0 and (m := _OPENS.match(html, i)):
            if closed < m.end() + 8:  # the shortest closing mark has 8 characters
                c = _CLOSES.search(html, m.end())
                closed = c.end() if c else -1
            end = closed
        if end < 0:
            end = html.find(">", i) + 1
            if not end:
                at = i
                break
        out.append(" ")
        at = end
    return "".join([*out, html[at:]])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each task; the empty word has the number of all words."""

    def out(words: Counter) -> pa.RecordBatch:
        words[""] = sum(words.values())
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    words: Counter = Counter()
    for batch in batches:
        for x in batch.column(0):
            plain = without_markup(x.as_py() or "").lower()
            words.update(_LETTERS.findall(plain))
            if len(words) > HELD_WORDS:
                yield out(words)
                words = Counter()
    yield out(words)


#: An odd number and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(text: str, length: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hashes of every run of ``length`` characters, modulo 2^64, from ``sums`` of the whole text."""
    sums = prefix_sums(text) if sums is None else sums
    n = len(sums) - length
    return ((sums[length:] - sums[:n]) * _powers(_INVERSE, n) * np.uint64(2 * length + 1)).view(np.int64)


def prefix_sums(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(_BASE, len(codes)), dtype=np.uint64)])


def _pieces(lengths: list[int]):
    """(at, hash): for each part, named by its row, the hashes of its runs of letters that are as long as some word.

    A row is 16 bytes, and there are as many as the part has letters for each length that occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for letters in _LETTERS.findall(x):
                    sums = prefix_sums(letters)
                    for length in lengths:
                        if length > len(letters):
                            break
                        found = np.unique(window_hashes(letters, length, sums))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), at)), pa.array(found)], names=["at", "hash"])

    return run


def _hashed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [int(window_hashes(w, len(w))[0]) for w in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), *batch.columns], names=["hash", "word", "n"])


def word_counts(texts: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """(word, n) of the words of letters in the texts, mark-up cut out, counted over all rows and seen LEAST_COUNT times; and the number of all."""
    counts = small_batches(texts.select(F.col(text_col).cast("string"))).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts)
    total = counts.where("word = ''").agg(F.sum("n")).first()[0] or 0
    return counts.where((F.col("word") != "") & (F.col("n") >= LEAST_COUNT)), total


def segmented(parts: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(part, words array<string>) of the distinct parts of hosts, each split with the probabilities of the words that lie in it."""
    # As many lengths as words can have; a corpus of n letters has fewer than the root of 2 n.
    lengths = sorted(r["length"] for r in words.select(F.char_length("word").alias("length")).distinct().collect())
    parts = stored(parts.select("part").distinct().withColumn("at", F.monotonically_increasing_id()).select("at", "part"))
    pieces = stored(parts.mapInArrow(_pieces(lengths), "at long, hash long").distinct())
    # Two words of one hash both come along; the search looks words up by their letters, so the wrong one is never found.
    hashed = words.select("word", "n").mapInArrow(_hashed_words, "hash long, word string, n long")
    known = cut(pieces.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")).join(hashed, "hash"))
    met = spread_join(pieces, known, ["hash"], "rows", known.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    within = met.groupBy("at").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    unknown = -math.log(total + 1) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [Segmenter({w["word"]: math.log(w["n"] / total) for w in known or ()}, unknown).split(part) for part, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(split, pa.list_(pa.string()))], names=["part", "words"])

    return parts.join(within, "at", "left").select("part", "known").mapInArrow(run, "part string, words array<string>")


def _host_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(set(host_parts(x))) for x in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["host", "parts"])


def _host_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [host_tokens(h, {w["part"]: w["words"] for w in words or ()}) for h, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.list_(pa.string()))], names=["host", "rows", "tokens"])


def _path_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([path_tokens(p) for p in batch.column(4).to_pylist()], pa.list_(pa.string()))], names=[*batch.schema.names, "of_path"])


def tokenised(ruled: DataFrame, pages: DataFrame, html_col: str) -> DataFrame:
    """``ruled`` (page_id, rule, ruled, host, path) with row_id and tokens array<string>.

    Hosts are segmented once each; the rows of a host that a third of all pages share meet its
    tokens by a broadcast.
    """
    hosts = cut(ruled.groupBy("host").agg(F.count(F.lit(1)).alias("rows")))
    parts = stored(hosts.select("host").mapInArrow(_host_parts, "host string, parts array<string>"))
    each = parts.select("host", F.explode("parts").alias("part"))
    split = stored(segmented(each, *word_counts(pages, html_col)))
    of_host = each.join(split, "part").groupBy("host").agg(F.collect_list(F.struct("part", "words")).alias("words"))
    of_host = cut(hosts.join(of_host, "host", "left").select("host", "words", "rows").mapInArrow(_host_tokens, "host string, rows long, tokens array<string>"))
    rows = stored(ruled.mapInArrow(_path_tokens, "page_id long, rule string, ruled string, host string, path string, of_path array<string>").withColumn("row_id", F.monotonically_increasing_id()))
    total = hosts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return spread_join(rows, of_host, ["host"], "rows", total).withColumn("tokens", F.concat("tokens", "of_path")).drop("of_path")


def train(tokens: DataFrame, labels: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, float]:
    """Multinomial naive Bayes from (ruled, token) and one row of (ruled) a page: (token, odds, rows) and the prior's log odds of block.

    Counts cover every labelled row. rows is how often a token occurs in all URLs; tokens of no
    labelled URL have no odds.
    """
    counts = cut(tokens.groupBy("token").agg(F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block"), F.count(F.lit(1)).alias("rows")))
    seen = counts.where("allow + block > 0")
    allow, block, used = seen.agg(F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0)), F.count(F.lit(1))).first()
    log_p = lambda c, n: F.log((F.col(c) + alpha) / F.lit(float(n + alpha * max(1, used))))
    n_allow, n_block = labels.agg(F.count_if(F.col("ruled") == "allow"), F.count_if(F.col("ruled") == "block")).first()
    return seen.select("token", (log_p("block", block) - log_p("allow", allow)).cast(EXACT).alias("odds"), "rows"), math.log((n_block + 1) / (n_allow + 1))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, margin for every row.

    verdict is the rule's, else ``block`` where naive Bayes has a margin over 0 (a tie allows).
    Defined cases: a null url, or one without ``://``, has empty host and path; urls and pages are
    read whole, however long; repeated rows each give a row; a null id stays null; without a single
    rule match everything else is allowed or blocked by the prior alone, which then is even and
    allows; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    hit = urls.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    ruled = hit.select("page_id", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled"), "host", "path")
    rows = stored(tokenised(ruled, pages, html_col))
    each = rows.select("row_id", "ruled", F.explode("tokens").alias("token"))
    odds, prior = train(each, rows)
    met = spread_join(each, odds, ["token"], "rows", odds.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    sums = met.groupBy("row_id").agg(F.sum("odds").alias("sum"))
    scored = rows.join(sums, "row_id", "left").withColumn("margin", F.lit(prior) + F.coalesce(F.col("sum").cast("double"), F.lit(0.0)))
    verdict = F.coalesce("ruled", F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "margin")
