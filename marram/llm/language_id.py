"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (lengths 1 to 3, blended spectrum)
that both contain, over the root of the numbers that each contains. N-grams are hashed to 2^16
places a length. Landmarks and training rows are a bounded sample; Nystroem features and one
ridge regression per language are solved on the driver, and, the kernel being linear in presence
bits, the landmarks fold into one weight matrix of places x languages, by which batches of
presence rows are multiplied. Every language with a labelled row is learned. The score is evidence: a text that shares nothing with the landmarks,
or that no language claims over the others, has 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marram.llm.common import crc32_residue, fresh, lean, quoted, small_batches

LENGTHS = (1, 2, 3)
PLACES = 1 << 16
#: Bounds of the sample that is fitted on: rows of each language, rows in all, and how far each language's share of those may fall. Every language is learned and every row is scored.
TRAIN_PER_LANG, TRAIN_ROWS, LEAST_PER_LANG = 400, 4_000, 10
#: Landmarks, and how many of them each language has at least.
LANDMARKS, LANDMARKS_PER_LANG = 256, 2
RIDGE = 1e-2
#: One in so many sampled rows is not fitted on and sets the least score: so much of the score that this share of them miss. Texts in no learned language have hardly any score.
WITHHELD, LEAST_OF, MISSED = 5, 0.1, 0.01
#: Rows multiplied at once in scoring, and places folded at once in fitting.
BLOCK, FOLD_PLACES = 256, 4096


def presence(text: str) -> np.ndarray:
    """Sorted places of the n-grams that the whole text contains, lower-cased."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    seen = np.zeros(len(LENGTHS) * PLACES, dtype=bool)
    key = codes
    for i, n in enumerate(LENGTHS):
        if n > 1:
            key = key[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if not len(key):
            break
        hashed = key * np.uint64(0xD6E8FEB86659FD93)
        seen[(hashed >> np.uint64(48)).astype(np.int64) + i * PLACES] = True
    return np.flatnonzero(seen).astype(np.int32)


def packed(places: np.ndarray) -> bytes:
    """Places as 32-bit numbers or as a bitmap, whichever is shorter: 24 KB at most, however long the text."""
    if len(places) * 4 < len(LENGTHS) * PLACES // 8:
        return b"n" + places.tobytes()
    bits = np.zeros(len(LENGTHS) * PLACES, dtype=bool)
    bits[places] = True
    return b"b" + np.packbits(bits).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"n":
        return np.frombuffer(data, dtype=np.int32, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=1))).astype(np.int32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model:
    """weights: places x languages; languages sorted; least: texts that score under it are in none of them."""

    def __init__(self, languages: list[str], weights: np.ndarray, least: float = 0.0):
        self.languages, self.weights, self.least = languages, weights, least

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Decision values of a block of presence rows: their 0/1 matrix times the weights, then normalised."""
        out = np.zeros((len(rows), len(self.languages)))
        sizes = np.array([len(r) for r in rows])
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
            picked = self.weights[np.concatenate([rows[i] for i in full])]
            out[full] = np.add.reduceat(picked, starts, axis=0) / np.sqrt(sizes[full])[:, None]
        return out


def evidence(values: np.ndarray) -> float:
    """0..1: the best decision value, or half its lead over the runner-up where that is less."""
    top = np.sort(values)
    lead = (top[-1] - top[-2]) / 2 if len(top) > 1 else top[-1]
    return float(min(1.0, max(0.0, min(top[-1], lead))))


def _kernel(rows: list[bytes], places: np.ndarray, starts: np.ndarray, marks: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Kernel of rows and n landmarks, whose presence is given by place: marks and values[starts[p] : starts[p + 1]] are those of places[p]."""
    out = np.zeros((len(rows), n))
    lengths = np.diff(starts)
    for i, row in enumerate(map(unpacked, rows)):
        at = np.searchsorted(places, row)
        at = at[(at < len(places)) & (places[np.minimum(at, len(places) - 1)] == row)] if len(places) else at[:0]
        long = lengths[at]
        if long.sum():
            inside = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long) + np.repeat(starts[at], long)
            out[i] = np.bincount(marks[inside], values[inside], n) / np.sqrt(len(row))
    return out


def fit(rows: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nystroem features of packed rows on landmarks spread over the languages, then one-versus-rest kernel ridge regression."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((len(LENGTHS) * PLACES, 0), dtype=np.float32))
    # Landmarks alternate between the languages, so that each has its share.
    by_lang: dict[str, list[int]] = {c: [] for c in languages}
    for i, c in enumerate(langs):
        by_lang[c].append(i)
    order = [i for turn in range(max(map(len, by_lang.values()))) for c in languages for i in by_lang[c][turn : turn + 1]]
    chosen = order[: max(landmarks, LANDMARKS_PER_LANG * len(languages))]
    held = [unpacked(rows[i]) for i in chosen]
    sizes = np.array([len(h) for h in held])
    by_place = np.argsort(place := np.concatenate(held), kind="stable")
    marks = np.repeat(np.arange(len(chosen), dtype=np.int32), sizes)[by_place]
    values = (1 / np.sqrt(np.maximum(sizes, 1)))[marks]
    places, starts = np.unique(place[by_place], return_index=True)
    starts = np.append(starts, len(by_place))
    kernel = _kernel(rows, places, starts, marks, values, len(chosen))
    eigen, vectors = np.linalg.eigh((k := kernel[chosen]) * 0.5 + k.T * 0.5)
    good = eigen > 1e-6 * eigen[-1] if eigen[-1] > 0 else eigen > 0
    root = vectors[:, good] / np.sqrt(eigen[good])
    features = kernel @ root
    wanted = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Rows weigh so that each language counts alike.
    weight = np.array([1 / len(by_lang[c]) for c in langs])[:, None]
    solved = np.linalg.solve(features.T @ (weight * features) + ridge * np.eye(features.shape[1]) / len(langs), features.T @ (weight * wanted)) if features.shape[1] else np.zeros((0, len(languages)))
    dual = (root @ solved).astype(np.float32)
    weights = np.zeros((len(LENGTHS) * PLACES, len(languages)), dtype=np.float32)
    for at in range(0, len(places), FOLD_PLACES):
        some = slice(int(starts[at]), int(starts[min(at + FOLD_PLACES, len(places))]))
        parts = dual[marks[some]] * values[some, None].astype(np.float32)
        weights[places[at : at + FOLD_PLACES]] = np.add.reduceat(parts, starts[at : min(at + FOLD_PLACES, len(places))] - some.start, axis=0)
    return Model(languages, weights)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(presence(x.as_py())) for x in batch.column(1)], pa.binary())], names=["lang", "places"])


def learn(labelled: DataFrame, per_lang: int = TRAIN_PER_LANG, most: int = TRAIN_ROWS) -> Model:
    """Fit on a bounded sample of ``labelled`` (lang, text, key): per language the rows of smallest hashed key.

    A first pass counts the languages; a hash threshold then leaves about twice as many rows of each
    as are taken, so the text that is shuffled is bounded whatever the corpus. A language gives
    per_lang rows, or most / (number of languages) where that is less, but LEAST_PER_LANG in any
    case; the driver gets 24 KB a row at most. What it holds grows with the number of languages only.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.pmod(F.xxhash64("key"), F.lit(1 << 40)))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return fit([], [])
    take = max(LEAST_PER_LANG, min(per_lang, most // len(counts)))
    bars = rows.sparkSession.createDataFrame([(r["lang"], min(1 << 40, (2 * take + 100) * (1 << 40) // r["n"])) for r in counts], "lang string, bar long")
    rows = rows.join(F.broadcast(bars), "lang").where("h < bar")
    picked = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("n") <= take).select("lang", "text")
    found = small_batches(picked).mapInArrow(lean(_features), "lang string, places binary").collect()
    # In an order that has nothing to do with the texts' length: the first of each language are landmarks.
    found = sorted(((r["lang"], bytes(r["places"])) for r in found if len(r["places"]) > 1), key=lambda x: (x[0], crc32(x[1]), x[1]))
    rows, langs = [p for _, p in found], [c for c, _ in found]
    turn: Counter = Counter()
    fitted, withheld = [], []
    for i, c in enumerate(langs):
        turn[c] += 1
        (fitted if turn[c] % WITHHELD else withheld).append(i)
    model = fit([rows[i] for i in fitted], [langs[i] for i in fitted])
    right = []
    for at in range(0, len(withheld), BLOCK):
        some = withheld[at : at + BLOCK]
        values = model.scores([unpacked(rows[i]) for i in some])
        right += [evidence(v) for v, i in zip(values, some, strict=True) if model.languages[int(v.argmax())] == langs[i]]
    model.least = LEAST_OF * float(np.quantile(right, MISSED)) if right else 0.0
    return model


def predict(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``carry`` columns of every row, with the predicted language and the score in 0..1 under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 * 2^16 floats a language
    n = len(carry)
    at = carry.index(text_col) if text_col in carry else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            preds, scores = [], []
            texts = iter(batch.column(at))
            while block := [x.as_py() for x in islice(texts, BLOCK)]:
                known = [has_letter(t) for t in block]
                values = m.scores([presence(t) if ok else np.zeros(0, np.int32) for t, ok in zip(block, known, strict=True)])
                for ok, row in zip(known, values, strict=True):
                    if not ok or not len(row):
                        preds.append("und")
                        scores.append(0.0)
                    else:
                        best = int(row.argmax())
                        preds.append(m.languages[best])
                        scores.append(evidence(row))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*carry, *names])

    own = [quoted(c) for c in carry]
    rows = docs.select(*own) if at < n else docs.select(*own, F.col(text_col).cast("string").alias(fresh(carry, "text")[0]))
    schema = T.StructType([*rows.schema.fields[:n], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return small_batches(rows).mapInArrow(lean(run), schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """lang, text, key of the documents that may be learned from."""
    return docs.where(crc32_residue(F.col("doc_id"), 5) != 0).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").alias("key"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learned from those not held out.

    Defined cases: null text, or text without a letter, is ``und`` with score 0, as is every text
    when no row has a language; a text is read whole, however long; repeated rows each give a row; a
    null id counts as empty text for the split; ties go to the language first in order; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select("doc_id", "text", (crc32_residue(F.col("doc_id"), 5) == 0).alias("held_out"))
    return predict(rows, learn(training_rows(docs)), ["doc_id", "held_out"])


def with_language(docs: DataFrame, least: float | None = None) -> DataFrame:
    """The rows of ``docs`` in a recognised language, columns unchanged; ``und``, scores of 0 and scores under ``least`` (the model's) go.

    Defined cases as for ``identify``; repeated rows go or stay together, and helper columns avoid
    the names of ``docs``.
    """
    names = docs.columns
    model = learn(training_rows(docs))
    lang, score = fresh(names, "lang_pred", "score")
    least = model.least if least is None else least
    judged = predict(docs, model, names, names=(lang, score))
    return judged.where((F.col(lang) != "und") & (F.col(score) > 0) & (F.col(score) >= least)).select(*map(quoted, names))
