"""Maps as binary octree files.

Cells are named by their Morton code, which interleaves the bits of the three indices. From the
cells up, a level's nodes are grouped eight by eight: a parent of eight equal leaves is a leaf
itself, any other is an inner node with two bits for each child. Inner nodes in depth-first order
are sorted by (code of their first cell, depth), so ranges of that order are packed where they lie
and follow each other in the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.operators.voxels import CELL
from marram.session import Workspace

#: Fixed values of the format: depth of the tree, the index of its middle, and the two bits of a child.
DEPTH, MIDDLE = 16, 32_768
FREE, OCCUPIED, INNER = 1, 2, 3
HEADER = "# Octomap OcTree binary file\n# (feel free to add / change comments, but leave the first line as it is!)\n#\nid OcTree\nsize {size}\nres {resolution:g}\ndata\n"

#: Bytes of one row of packed nodes.
CHUNK_BYTES = 1 << 20


def _spread(bits: Column) -> Column:
    """Bits of an index, two free places after each."""
    for shift, mask in ((16, 0x0000FF0000FF), (8, 0x00F00F00F00F), (4, 0x0C30C30C30C3), (2, 0x249249249249)):
        bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
    return bits


def morton(x: Column, y: Column, z: Column) -> Column:
    """Code of a cell: bits of x, y and z by turns, x lowest."""
    key = lambda c: _spread((c + MIDDLE).cast("long"))
    return key(x).bitwiseOR(F.shiftleft(key(y), 1)).bitwiseOR(F.shiftleft(key(z), 2))


def inner_nodes(cells: DataFrame, work: Workspace, threshold: float = 0.0) -> DataFrame:
    """depth, code, first (code of the node's first cell), children (16 bits), n: a row for each inner node of the pruned tree.

    A cell is occupied if its l reaches ``threshold``, else free; null and NaN are unknown. Equal
    cells must not come twice. A cell outside the tree is an error.
    """
    known = cells.where(F.col("l").isNotNull() & ~F.isnan("l"))
    outside = known.where(~F.greatest(*CELL).between(-MIDDLE, MIDDLE - 1) | ~F.least(*CELL).between(-MIDDLE, MIDDLE - 1))
    if outside.take(1):
        raise ValueError(f"a cell lies more than {MIDDLE} cells from the middle of the tree")
    level = known.select(morton(*[F.col(c) for c in CELL]).alias("code"), F.when(F.col("l") >= threshold, OCCUPIED).otherwise(FREE).alias("kind"))
    inner = None
    for depth in range(DEPTH - 1, -1, -1):
        bits = F.sum(F.expr("shiftleft(kind, cast(2 * (code & 7) as int))")).cast("int")
        grouped = level.groupBy(F.shiftright("code", 3).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high"), bits.alias("children"))
        leaf = (F.col("n") == 8) & (F.col("low") == F.col("high")) & (F.col("high") < INNER)
        # The root is written as an inner node unless all space is one leaf, which no map is.
        parents = work.keep(grouped.select("code", F.when(leaf, F.col("high")).otherwise(INNER).alias("kind"), "children", "n"))
        found = parents.where(F.col("kind") == INNER).select(F.lit(depth).alias("depth"), "code", F.shiftleft("code", 3 * (DEPTH - depth)).alias("first"), "children", "n")
        inner = found if inner is None else inner.unionByName(found)
        level = parents.select("code", "kind")
    return inner


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two bytes a node, in order, in rows of bounded size numbered within the task's range."""
    from pyspark import TaskContext

    part, n, held = TaskContext.get().partitionId(), 0, bytearray()
    emit = lambda data: pa.record_batch([pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([bytes(data)])], ["part", "n", "data"])
    for batch in batches:
        held += batch.column(0).to_numpy().astype("<u2").tobytes()
        if len(held) >= CHUNK_BYTES:
            yield emit(held)
            n, held = n + 1, bytearray()
    if held:
        yield emit(held)


def packed(nodes: DataFrame) -> DataFrame:
    """part, n, data: the nodes' bytes, which follow each other by part and n."""
    order = ["first", "depth"]
    return nodes.repartitionByRange(*order).sortWithinPartitions(*order).select("children").mapInArrow(_packed, "part int, n int, data binary")


def write_octree(cells: DataFrame, path: str, resolution: float, threshold: float = 0.0) -> int:
    """Write a map (ix, iy, iz, l) as a binary octree; its number of nodes.

    The cells are read only, so a map can be classified before or after. The file is one stream, so
    one process writes it: the driver, a chunk of CHUNK_BYTES or so at a time.
    """
    spark = cells.sparkSession
    work = Workspace(spark)
    nodes = inner_nodes(cells, work, threshold)
    size = nodes.agg(F.sum("n")).first()[0]
    chunks = work.keep(packed(nodes))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(HEADER.format(size=size + 1 if size else 0, resolution=resolution).encode()))
        parts = [r["part"] for r in chunks.select("part").distinct().orderBy("part").collect()]
        for part in parts:
            for row in chunks.where(F.col("part") == part).orderBy("n").toLocalIterator():
                out.write(bytearray(row["data"]))
    finally:
        out.close()
        work.drop_all_but()
    return size + 1 if size else 0
