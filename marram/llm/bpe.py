"""Byte-level BPE by a prefix-sharing trie.

For every prefix of a word the encoding is determined by its last token: it is the encoding of
the prefix without that token, then the token. Of the tokens that end a prefix exactly one may
follow the last token of the rest (a pair may follow when merging the two tokens' own bytes gives
back that pair). So distinct words go into a trie, and one depth-first walk sets the last token
of each node from its ancestors; words that share a prefix share the work for it.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import lean, small_batches

#: The word pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Encoded words that a Python worker keeps between batches, in two generations, and pairs of tokens that it has judged; they bound memory and leave results as they are.
CACHE_WORDS, CACHE_PAIRS = 100_000, 250_000


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies, by rule: printable bytes stand for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def refuse_unknown(spec: dict) -> None:
    """Raises where a vocabulary file asks for more than byte-level BPE, which would be encoded wrongly."""
    model, before, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    asks = {
        "a normalizer": spec.get("normalizer"),
        "a model other than BPE": model.get("type", "BPE") != "BPE",
        "dropout": model.get("dropout"),
        "a word affix": model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"),
        "byte fallback": model.get("byte_fallback"),
        "whole words before merges": model.get("ignore_merges"),
        "another pre-tokenizer": before.get("type") != "ByteLevel" or not before.get("use_regex", True),
        "a leading space": before.get("add_prefix_space"),
        "another decoder": (spec.get("decoder") or {}).get("type") != "ByteLevel",
        "added tokens that match partly or stretch over spaces": any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added),
    }
    if found := [name for name, asked in asks.items() if asked]:
        raise ValueError(f"the vocabulary file asks for {', '.join(found)}, which this encoder does not do")


class TrieBpe:
    """Encoder and decoder for one vocabulary file (its text, not its path, so that tasks need no file)."""

    def __init__(self, vocabulary_json: str):
        spec = json.loads(vocabulary_json)
        refuse_unknown(spec)
        letters = byte_letters()
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in word) for word, i in spec["model"]["vocab"].items() if all(c in letters for c in word)}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = {k: v for k, v in added.items() if k}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
            self.id_of.pop(text.encode(), None)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        plain = {w: i for w, i in spec["model"]["vocab"].items()}
        for rank, (a, b) in enumerate(merges):
            pair = plain[a], plain[b]
            self.rank[pair] = rank
            self.parts.setdefault(plain[a + b], (*pair, rank))
        self.longest = max(map(len, self.id_of))
        self.one_way = len(self.parts) == len(merges)  # else a token has several ways to be made
        self.byte_token = [self.id_of[bytes([b])] for b in range(256)]
        self.merged = {pair: plain[a + b] for pair, (a, b) in zip(self.rank, merges, strict=True)}
        self.find = regex.compile(PATTERN)
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.may_follow: dict[tuple[int, int], bool] = {}
        self.encoded: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, tokens: list[int]) -> list[int]:
        """Plain BPE on a short token list: the leftmost pair of the lowest rank merges first."""
        tokens = list(tokens)
        while len(tokens) > 1:
            best = min(range(len(tokens) - 1), key=lambda i: self.rank.get((tokens[i], tokens[i + 1]), 1 << 60))
            pair = tokens[best], tokens[best + 1]
            if pair not in self.rank:
                break
            tokens[best : best + 2] = [self.merged[pair]]
        return tokens

    def follows(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens encode to these two tokens."""
        pair = left, right
        known = self.may_follow.get(pair)
        if known is None:
            if len(self.may_follow) > CACHE_PAIRS:
                self.may_follow.clear()
            known = self.may_follow[pair] = self.apart(left, right) if self.one_way else self.merge([self.byte_token[b] for b in self.bytes_of[left] + self.bytes_of[right]]) == [left, right]
        return known

    def apart(self, left: int, right: int) -> bool:
        """``follows`` by undoing merges, latest first.

        The tokens stay apart unless, at some moment, the two pieces that meet at the border make a
        pair that ranks before the next merge of either. Of equal ranks the left one goes first.
        """
        rank, parts, before = self.rank, self.parts, 1 << 60
        while True:
            if rank.get((left, right), before) < before:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[2] > b[2]:
                before, left = a[2], a[1]
            else:
                before, right = b[2] + 1, b[0]

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Token ids of distinct words.

        Sorted words are their trie in depth-first order: going from one word to the next pops the
        states below their common prefix and pushes one state per new node. A state is the last
        token of its prefix and the depth where the rest of the encoding ends.
        """
        found: dict[bytes, list[int]] = {}
        last: list[int] = []
        rest: list[int] = []
        before = b""
        token_of, follows, longest, known = self.id_of.get, self.follows, self.longest, self.may_follow.get
        for word in sorted(words):
            common, most = 0, min(len(word), len(before))
            while common < most and word[common] == before[common]:
                common += 1
            del last[common:], rest[common:]
            for end in range(common + 1, len(word) + 1):
                # The one that fits is unique, so the order of trials is free: short tokens come first.
                for start in range(end - 1, max(-1, end - longest - 1), -1):
                    token = token_of(word[start:end])
                    if token is None:
                        continue
                    if start:
                        fits = known((last[start - 1], token))
                        if fits is None:
                            fits = follows(last[start - 1], token)
                    else:
                        fits = self.whole(token)
                    if fits:
                        break
                last.append(token)
                rest.append(start)
            ids, at = [], len(word)
            while at:
                ids.append(last[at - 1])
                at = rest[at - 1]
            found[word] = ids[::-1]
            before = word
        return found

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes encode to it alone."""
        pair = -1, token
        known = self.may_follow.get(pair)
        if known is None:
            known = self.may_follow[pair] = self.merge([self.byte_token[b] for b in self.bytes_of[token]]) == [token]
        return known

    def words(self, text: str) -> list[str]:
        """Words of a text; strings of added tokens come as they are, marked by a leading NUL NUL."""
        if self.split_added is None or not any(t in text for t in self.added):
            return self.find.findall(text)
        out: list[str] = []
        for piece in self.split_added.split(text):
            if piece in self.added:
                out.append("\0\0" + piece)
            else:
                out += self.find.findall(piece)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.words(t) for t in texts]
        words = set().union(*split)
        if len(self.encoded) > CACHE_WORDS:
            self.older, self.encoded = self.encoded, {}
        now, older = self.encoded, self.older
        fresh = []
        for w in words - now.keys():
            if w in older:
                now[w] = older[w]
            elif w.startswith("\0\0") and w[2:] in self.added:
                now[w] = self.added[w[2:]].to_bytes(4, "little")
            else:
                fresh.append(w)
        plain = {w.encode("utf-8", "surrogatepass"): w for w in fresh}
        for raw, ids in self.encode_words(plain).items():
            now[plain[raw]] = array("I", ids).tobytes()
        get = now.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become replacement characters, as the library does."""
        ids = memoryview(packed).cast("I") if packed else ()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_READY: dict[str, TrieBpe] = {}


def encoder(vocabulary_json: str) -> TrieBpe:
    """One encoder per Python worker and vocabulary, so that its word cache outlives a task."""
    key = hashlib.sha256(vocabulary_json.encode()).hexdigest()
    if key not in _READY:
        _READY.clear()
        _READY[key] = TrieBpe(vocabulary_json)
    return _READY[key]


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text, read on the driver; its size is that of a public vocabulary, a few MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def known_vocabulary(path: str) -> str:
    """The file's text, after a look at the driver whether this encoder can do what it asks for."""
    text = read_vocabulary(path)
    refuse_unknown(json.loads(text))
    return text


#: Texts are taken in groups of so many characters, to bound what a worker holds besides its batch.
GROUP_CHARS = 2_000_000


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, ``carry`` columns, ids binary (little-endian unsigned 32-bit), n_tokens long, round_trip boolean, decoded string for every row.

    round_trip tells whether decoding the ids gives the text back. Strings of the vocabulary's added
    tokens count as those tokens. A null text counts as empty and encodes to no ids; repeated rows
    each give a row; a null id stays null; an empty table gives no rows; other columns are ignored.
    Words are not truncated, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known_vocabulary(vocabulary_path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(carry or []), F.col(text_col).cast("string").alias("__text"))
    n = len(rows.columns) - 1
    names = [*rows.columns[:n], "ids", "n_tokens", "round_trip", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        for batch in batches:
            texts = batch.column(n)
            start = 0
            while start < len(texts):
                group, size = [], 0
                while start + len(group) < len(texts) and (size < GROUP_CHARS or not group):
                    group.append(texts[start + len(group)].as_py() or "")
                    size += len(group[-1])
                packed = bpe.encode_batch(group)
                decoded = [bpe.decode(p) for p in packed]
                made = [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([d == t for d, t in zip(decoded, group, strict=True)], pa.bool_()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(group)).columns[:n], *made], names=names)
                start += len(group)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return small_batches(rows).mapInArrow(lean(run), f"{fields}, ids binary, n_tokens long, round_trip boolean, decoded string")


def encode_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode`` with its ids and decoded text as digests, taken where they are made.

    Defined cases as for ``encode``.

    Only digests leave the Python worker, so nothing of the corpus' size is copied back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        sha = hashlib.sha256
        for batch in batches:
            texts = batch.column(1)
            n_tokens, of_ids, of_text, group, size = [], [], [], [], 0

            def flush() -> None:
                for p in bpe.encode_batch(group):
                    n_tokens.append(len(p) // 4)
                    of_ids.append(sha(p).hexdigest())
                    of_text.append(sha(bpe.decode(p).encode()).hexdigest())
                group.clear()

            for x in texts:
                group.append(x.as_py() or "")
                size += len(group[-1])
                if size >= GROUP_CHARS:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
