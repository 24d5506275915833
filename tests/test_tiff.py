import numpy as np
import pytest

from quadrille.plans.grids import cells
from quadrille.plans.meta import GridMeta
from quadrille.sources import tiff


def test_round_trip_and_slices(spark, tmp_path):
    meta, uri = GridMeta(5, 4, 20), f"file://{tmp_path}/t"
    grid = cells(spark, meta).selectExpr("z", "x", "y", "z * 100 + x * 10 + y as v")
    assert tiff.save(grid, meta, uri, slab=8) == 3
    assert tiff.info(uri) == (meta, "uint16")
    got = tiff.read(spark, uri)
    assert got.count() == meta.pixels and got.where("v <> z * 100 + x * 10 + y").count() == 0
    part = got.where("z >= 6 and z < 9")
    assert sorted({r["z"] for r in part.collect()}) == [6, 7, 8]
    reader = tiff.TiffReader(uri)
    assert [*reader.pushFilters([tiff.GreaterThanOrEqual(("z",), 6), tiff.LessThan(("z",), 9), tiff.EqualTo(("x",), 1)])] == [tiff.EqualTo(("x",), 1)]
    assert sorted(z for p in reader.partitions() for z in p.z) == [6, 7, 8]


@pytest.mark.parametrize("kind", ["uint8", "uint16", "float32"])
def test_kinds(tmp_path, kind):
    a = np.arange(2 * 3 * 7).reshape(2, 3, 7).astype(kind)
    path = tmp_path / "a.tif"
    path.write_bytes(tiff.encode(a))
    with open(path, "rb") as f:
        found = tiff.pages(f)
        assert all(np.array_equal(tiff.array(f, p), a[i]) for i, p in enumerate(found)) and found[0].kind == kind


def test_rejects(spark, tmp_path):
    (tmp_path / "b.tif").write_bytes(b"nothing at all")
    with pytest.raises(ValueError):
        tiff.info(f"file://{tmp_path}/b.tif")
    with pytest.raises(Exception, match="range"):
        tiff.save(cells(spark, GridMeta(3)).selectExpr("z", "x", "y", "-5 as v"), GridMeta(3), f"file://{tmp_path}/n")


@pytest.mark.parametrize("kind", ["uint8", "uint16", "float32"])
@pytest.mark.parametrize("compression", ["none", "deflate"])
@pytest.mark.parametrize("large", [False, True])
def test_layouts_and_compressions(tmp_path, kind, compression, large):
    a = (np.arange(3 * 5 * 8).reshape(3, 5, 8) % 97).astype(kind)
    (tmp_path / "a.tif").write_bytes(tiff.encode(a, 7, compression, large))
    with open(tmp_path / "a.tif", "rb") as f:
        found = tiff.pages(f)
        assert found[0].description == "z=7" and all(np.array_equal(tiff.array(f, p), a[i]) for i, p in enumerate(found))


def lzw(data):
    """The plain way: strings grow in a table, codes widen one entry early."""
    table, width, bits, now = {bytes([i]): i for i in range(256)}, 9, [], b""
    emit = lambda code, w: bits.extend(code >> (w - 1 - i) & 1 for i in range(w))
    emit(256, 9)
    size = 258
    for c in data:
        if now + bytes([c]) in table:
            now += bytes([c])
            continue
        emit(table[now], width)
        table[now + bytes([c])] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4095:
            emit(256, width)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        now = bytes([c])
    if now:
        emit(table[now], width)
        width = 9 if size + 1 < 512 else 10 if size + 1 < 1024 else 11 if size + 1 < 2048 else 12
    emit(257, width)
    return np.packbits(bits).tobytes()


def test_packed_strips():
    r = np.random.default_rng(4)
    for n, top in ((0, 3), (1, 3), (700, 3), (5000, 256), (20000, 7)):
        data = r.integers(0, top, n, dtype=np.uint8).tobytes()
        assert tiff.unlzw(lzw(data)) == data, (n, top)
    assert tiff.unpackbits(bytes([2, 1, 2, 3, 254, 9, 128, 0, 5])) == bytes([1, 2, 3, 9, 9, 9, 5])


def test_compressed_slabs(spark, tmp_path):
    meta, uri = GridMeta(6, 5, 9), f"file://{tmp_path}/c"
    grid = cells(spark, meta).selectExpr("z", "x", "y", "z * 100 + x * 10 + y as v")
    assert tiff.save(grid, meta, uri, slab=4, compression="deflate") == 3
    assert tiff.read(spark, uri).where("v = z * 100 + x * 10 + y").count() == meta.pixels
