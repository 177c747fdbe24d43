"""A voxel map that is kept between runs and added to, frame by frame, without folding old frames again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.operators.voxels import CELL, Occupancy, composed, fold_triples


class KeptMap:
    """Clamped folds as (s, lo, hi) triples, one a cell and batch, in a table bucketed and sorted by cell.

    folder: where its files lie, shared by driver and executors; what is there already is opened.
    buckets: as many as give a task's worth of cells each; fixed when the map is made. A batch adds
    its own triples, so adding costs what the batch holds. Reading composes a cell's triples bucket by
    bucket, with no shuffle. ``compact`` leaves one triple a cell. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, c: Occupancy, buckets: int = 64, chunk: int = 64):
        self.spark, self.folder, self.c, self.buckets, self.chunk = spark, folder.rstrip("/"), c, buckets, chunk
        self.name = "kept_map_" + "".join(ch if ch.isalnum() else "_" for ch in self.folder)

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _versions(self) -> list[int]:
        files, where = self._fs(self.folder)
        if not files.exists(where):
            return []
        names = [s.getPath().getName() for s in files.listStatus(where)]
        done = [n for n in names if n.startswith("v") and files.exists(self._fs(f"{self.folder}/{n}/_SUCCESS")[1])]
        return sorted(int(n[1:]) for n in done)

    def _table(self, version: int) -> str:
        """The version's name in the catalog, where it is entered if this session has not seen it."""
        name = f"{self.name}_v{version}"
        if not self.spark.catalog.tableExists(name):
            cells = ", ".join(f"{k} BIGINT" for k in CELL)
            self.spark.sql(f"CREATE TABLE {name} ({cells}, batch BIGINT, s DOUBLE, lo DOUBLE, hi DOUBLE) USING parquet CLUSTERED BY ({', '.join(CELL)}) SORTED BY ({', '.join(CELL)}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/v{version}'")
        return name

    def _write(self, triples: DataFrame, version: int) -> None:
        rows = triples.select(*[F.col(k).cast("long").alias(k) for k in CELL], F.col("batch").cast("long").alias("batch"), "s", "lo", "hi")
        writer = rows.repartition(self.buckets, *CELL).write.format("parquet").bucketBy(self.buckets, *CELL).sortBy(*CELL).mode("append")
        name = f"{self.name}_v{version}"
        if self.spark.catalog.tableExists(name) or version in self._versions():
            writer.saveAsTable(self._table(version))
        else:
            writer.option("path", f"{self.folder}/v{version}").saveAsTable(name)

    def triples(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.table(self._table(versions[-1])) if versions else None

    def add(self, evidence: DataFrame, batch: int, order: str = "frame", value: str = "value") -> bool:
        """Take in a batch's frames (frame, ix, iy, iz, value, summed by frame and cell), which come after those of smaller batches.

        A batch that is there already is left as it is, so a run that failed can be repeated; False then.
        """
        there = self.triples()
        last = None if there is None else there.agg(F.max("batch")).first()[0]
        if last is not None and batch <= last:
            return False
        versions = self._versions()
        self._write(fold_triples(evidence, list(CELL), order, value, self.c, self.chunk).withColumn("batch", F.lit(batch)), versions[-1] if versions else 0)
        return True

    def cells(self) -> DataFrame:
        """ix, iy, iz, l of the map."""
        there = self.triples()
        if there is None:
            return self.spark.createDataFrame([], ", ".join(f"{k} long" for k in CELL) + ", l double")
        return composed(there, list(CELL), "batch").select(*CELL, F.greatest("lo", F.least("hi", "s")).alias("l"))

    def compact(self) -> None:
        """One triple a cell, in a new version; the old one is removed when the new one is there."""
        versions = self._versions()
        if not versions:
            return
        there = self.triples()
        last = there.agg(F.max("batch")).first()[0]
        self._write(composed(there, list(CELL), "batch").withColumn("batch", F.lit(last)), versions[-1] + 1)
        for v in versions:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_v{v}")
            files, where = self._fs(f"{self.folder}/v{v}")
            files.delete(where, True)
