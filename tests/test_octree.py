"""The octree file against a plain recursive writer."""

import numpy as np
import pytest

from marram.sources import octree

RNG = np.random.default_rng(4)


def plain_file(cells, resolution):
    """Header and nodes from nested dictionaries, written depth first."""
    root = {}
    for x, y, z, l in cells:  # noqa: E741
        node = root
        for bit in range(15, -1, -1):
            child = sum((((v + 32768) >> bit) & 1) << k for k, v in enumerate((x, y, z)))
            if bit:
                node = node.setdefault(child, {})
            else:
                node[child] = l >= 0

    def pruned(node):
        for k, child in node.items():
            if isinstance(child, dict):
                node[k] = pruned(child)
        values = list(node.values())
        return values[0] if len(values) == 8 and all(isinstance(v, bool) for v in values) and len(set(values)) == 1 else node

    def size(node):
        return 1 + sum(size(c) for c in node.values()) if isinstance(node, dict) else 1

    def write(node, out):
        bits = 0
        for k, child in node.items():
            bits |= (3 if isinstance(child, dict) else 2 if child else 1) << (2 * k)
        out += bits.to_bytes(2, "little")
        for k in range(8):
            if isinstance(node.get(k), dict):
                write(node[k], out)

    root = pruned(root) if root else root
    out = bytearray()
    if root:
        write(root, out)
    head = f"# Octomap OcTree binary file\n# (feel free to add / change comments, but leave the first line as it is!)\n#\nid OcTree\nsize {size(root) if root else 0}\nres {resolution:g}\ndata\n"
    return head.encode() + bytes(out)


SOLID = [(x, y, z, 1.0) for x in range(-4, 4) for y in range(-4, 4) for z in range(-8, 0)]
MAPS = {
    "one cell": [(0, 0, 0, 0.0)],
    "scattered": [(*map(int, k), float(l)) for k, l in {tuple(RNG.integers(-300, 300, 3)): l for l in RNG.normal(size=400)}.items()],
    "blocks that merge over levels": SOLID + [(20, 3, 3, -1.0), (32767, -32768, 32767, 2.0)],
    "a block with one other cell": [(*c[:3], -1.0 if c[:3] == (1, 1, -3) else 1.0) for c in SOLID],
    "none": [],
}


@pytest.mark.parametrize("name", MAPS)
def test_file_equals_a_plain_writers(spark, tmp_path, name, monkeypatch):
    monkeypatch.setattr(octree, "CHUNK_BYTES", 64)
    rows = MAPS[name]
    cells = spark.createDataFrame(rows, "ix long, iy long, iz long, l double").repartition(5)
    octree.write_octree(cells, str(tmp_path / "map.bt"), 0.1)
    assert (tmp_path / "map.bt").read_bytes() == plain_file(rows, 0.1)


def test_unknown_cells_stay_out_and_cells_outside_are_refused(spark, tmp_path):
    schema = "ix long, iy long, iz long, l double"
    octree.write_octree(spark.createDataFrame([(0, 0, 0, None), (1, 0, 0, float("nan")), (5, 5, 5, 1.0)], schema), str(tmp_path / "a.bt"), 0.25)
    assert (tmp_path / "a.bt").read_bytes() == plain_file([(5, 5, 5, 1.0)], 0.25)
    with pytest.raises(ValueError):
        octree.write_octree(spark.createDataFrame([(40_000, 0, 0, 1.0)], schema), str(tmp_path / "b.bt"), 0.1)
