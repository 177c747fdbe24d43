"""Line deduplication: lines that many documents share stay in one of them.

Texts are exploded into lines, whose normalised keys are hashed (128 bits); distinct documents are
counted per hash, with partial sums before each shuffle, and lines over the threshold are dropped.
Positions of dropped lines are gathered by text and each text is put together from what is left,
in order. Before that last join no text moves: only hashes, ids and positions do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.llm.common import HOT_KEYS, ascii_lower, fresh, quoted, stored

#: Keys of at least so many code points, in at least so many documents.
LEAST_CHARS, LEAST_DOCS = 40, 5

_SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(_SPACES)))


def _lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(doc_id: Column, text: Column) -> Column:
    """Rows with one key have the same id and text, and so the same lines to drop."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))))


def long_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """row_key, doc_id, position and line (hash of the key): a row for each line whose key has ``least_chars`` or more."""
    doc_id, text = quoted(id_col), quoted(text_col)
    # The key is made before lines are exploded, or every line would carry its whole text to it.
    rows = docs.select(_row_key(doc_id, text).alias("row_key"), doc_id.alias("doc_id"), _lines_of(text).alias("lines"))
    exploded = rows.select("row_key", "doc_id", F.posexplode("lines").alias("position", "raw"))
    # A key is not longer than its line, so short lines go before they are normalised.
    keyed = exploded.where(F.char_length("raw") >= least_chars).withColumn("key", line_key(F.col("raw")))
    return keyed.where(F.char_length("key") >= least_chars).select("row_key", "doc_id", "position", F.unhex(F.md5("key")).alias("line"))


def frequent_lines(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """line, n_docs (distinct ids, null counting as one), last_doc (the largest id, null the smallest) of lines over the threshold."""
    return lines.select("line", "doc_id").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")).where(F.col("n_docs") >= least_docs)


def dropped_positions(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """row_key and the positions of its lines that go: one row per text that loses any.

    The HOT_KEYS most frequent lines are broadcast, so their rows stay where they are; any other
    line has less than 1 / HOT_KEYS of all rows and is joined by its hash.
    """
    hot = frequent.orderBy(F.desc("n_docs"), "line").limit(HOT_KEYS).select("line", "last_doc")
    cold = frequent.join(F.broadcast(hot.select("line")), "line", "left_anti").select("line", "last_doc")
    rest = lines.join(F.broadcast(hot.select("line")), "line", "left_anti")
    found = lines.join(F.broadcast(hot), "line").unionByName(rest.join(cold, "line"))
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return gone.groupBy("row_key").agg(F.collect_set("position").alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text; a column of such a name gives way.

    Keys of ``least_chars`` code points or more that ``least_docs`` documents or more hold lose all
    their lines but those in the largest id that holds them. Defined cases: a null or empty text is
    one empty line; a text is read whole, however many lines it has; rows that share an id, null
    too, are one document when documents are counted, and each keeps or loses its own lines; null
    is the smallest id; a line that stays in a document stays there as often as it is there; an
    empty table gives no rows; other columns, whatever their names, are carried along.
    """
    lines = stored(long_lines(docs, id_col, text_col, least_chars))
    frequent = stored(frequent_lines(lines, least_docs))
    gone, key, all_lines = fresh(docs.columns, "gone", "row_key", "all_lines")
    drops = dropped_positions(lines, frequent).select(F.col("row_key").alias(key), F.col("gone").alias(gone))
    rows = docs.withColumn(key, _row_key(quoted(id_col), quoted(text_col))).join(drops, key, "left")
    rows = rows.withColumn(all_lines, _lines_of(quoted(text_col)))
    parts = F.col(all_lines)
    # array_except hashes, so a text with very many lines takes linear time.
    stays = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)), lambda i: F.get(parts, i))
    kept = F.when(F.col(gone).isNull(), F.coalesce(quoted(text_col), F.lit(""))).otherwise(F.array_join(stays, "\n"))
    carried = [quoted(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    n_dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    return rows.select(*carried, F.size(parts).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), kept.alias("kept_text"))


def digests(deduplicated: DataFrame) -> DataFrame:
    """The contract's columns from ``line_dedup``."""
    return deduplicated.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
