"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest
before anything is shuffled by content, anti-joined with the index by a sort-merge join on the
bucket key, and what is new is appended. Text itself never moves: only 32-byte digests do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.llm.common import SPACES, cut, fresh, quoted, shared_folder, spread_join, tidy

#: Batches in which a whole table is added to an index, and digests of the index that one bucket should hold.
BATCHES, BUCKET_DIGESTS = 3, 4_000_000


def normalised(text: Column) -> Column:
    """Text with every run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (digest, id) with ``copies``, the number of rows that carry the two."""
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))
        .groupBy("digest", "doc_id")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


class DigestIndex:
    """A digest table that outlives its session's queries.

    name: table name in the session catalog (its files lie in the warehouse).
    buckets: fixed at creation; choose it so that one bucket of the final index fits a task.
    Columns: digest binary, keep_id long (the id that stays), batch string.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _lock_file(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(self.spark)}/../{self.name}.lock")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    @contextmanager
    def locked(self) -> Iterator[None]:
        """One writer at a time: a file beside the checkpoint folders marks the index as being written."""
        files, where = self._lock_file()
        files.mkdirs(where.getParent())
        if not files.createNewFile(where):
            raise RuntimeError(f"{self.name} is being written; if its writer has died, call unlock()")
        try:
            yield
        finally:
            files.delete(where, False)

    def unlock(self) -> None:
        """Take away the mark of a writer that died."""
        files, where = self._lock_file()
        files.delete(where, False)

    def new(self, batch_digests: DataFrame) -> DataFrame:
        """(digest, keep_id) of the digests that the index lacks, each with its smallest id (nulls last)."""
        winners = batch_digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        if self.exists():
            winners = winners.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        return winners

    def add(self, batch_digests: DataFrame, batch: str | None = None) -> None:
        """Append the digests the index lacks.

        A digest that an earlier batch holds keeps that batch's id. Adding the same batch twice
        changes nothing, so a failed run can simply be repeated.
        """
        with self.locked():
            (
                self.new(batch_digests)
                .withColumn("batch", F.lit(batch or uuid.uuid4().hex))
                .repartition(self.buckets, "digest")
                .write.bucketBy(self.buckets, "digest")
                .sortBy("digest")
                .mode("append")
                .saveAsTable(self.name)
            )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def in_batches(batch_digests: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """The rows in ranges of ascending doc_id, about as many in each, null ids last; an id lies in one range."""
    edges = batch_digests.select(F.percentile_approx("doc_id", F.array(*[F.lit((i + 1) / batches) for i in range(batches - 1)]), F.lit(1000))).first()[0] if batches > 1 else None
    edges = sorted(set(edges or []))
    doc_id = F.col("doc_id")
    lows, highs = [None, *edges], [*edges, None]
    inside = [(F.lit(True) if low is None else doc_id > low) & (F.lit(True) if high is None else doc_id <= high) for low, high in zip(lows, highs, strict=True)]
    inside[-1] = inside[-1] | doc_id.isNull()
    return [batch_digests.where(c) for c in inside]


def assign(batch_digests: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    group_size counts the batch's rows. Of rows that share text and doc_id exactly one is kept.
    A hot digest meets one index row only, which is broadcast; the others are joined by digest.
    """
    sizes = batch_digests.groupBy("digest").agg(F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("rows"))
    groups = cut(sizes.join(index.table().select("digest", "keep_id"), "digest"))
    return (
        spread_join(batch_digests, groups, ["digest"], "rows", groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("turn"))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, batches: int = BATCHES) -> DataFrame:
    """Deduplicate ``docs`` against a fresh index, batch by batch; see ``assign`` for the result.

    Each batch is anti-joined with what the index holds and its new digests are appended; batches
    come in order of doc_id, so the smallest id of a text stays. Defined cases: null text counts as
    empty and groups with other empty texts; a null id loses to any other id; a text is hashed
    whole, however long; rows that repeat an id and a text count as copies; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    own = cut(digests(docs, id_col, text_col))
    wanted = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // BUCKET_DIGESTS))
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", wanted)
    try:
        for i, batch in enumerate(in_batches(own, batches)):
            index.add(batch, str(i))
        return cut(assign(own, index))
    finally:
        index.drop()


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged; of fully tied rows one stays.

    Defined cases as for ``exact_dedup``; helper columns avoid the names of ``docs``.
    """
    names = docs.columns
    of_id, sha = fresh(names, "of_id", "sha")
    tidy(docs.sparkSession)
    found = exact_dedup(docs)
    tidy(docs.sparkSession)
    dropped = found.groupBy("doc_id").agg(F.count_if("kept").alias("stay"), F.count(F.lit(1)).alias("all_rows")).where("stay < all_rows")
    is_it = F.col("doc_id").eqNullSafe(F.col(of_id))
    kept = docs.join(dropped.where("stay = 0").select(F.col("doc_id").alias(of_id)), is_it, "left_anti")
    tied = cut(dropped.where("stay > 0").select(F.col("doc_id").alias(of_id)))
    if tied.isEmpty():
        return kept
    # Rows that share an id: one of each text stays, if that id won the text.
    wins = found.where("kept").select(F.col("doc_id").alias(of_id), F.col("text_sha256").alias(sha + "_"))
    again = kept.join(tied, is_it, "left_semi").withColumn(sha, F.sha2(normalised(F.col("text")), 256))
    again = again.join(wins, is_it & (F.col(sha) == F.col(sha + "_")), "left_semi")
    return kept.join(tied, is_it, "left_anti").unionByName(again.dropDuplicates(["doc_id", sha]).select(*map(quoted, names)))
