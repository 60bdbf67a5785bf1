import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.sources import readers, sinks, synthetic


def test_fasta_round_trip(spark, tmp_path):
    rows = [("one", "ACGT" * 50), ("two", "A"), ("three words", "G" * 80)]
    sinks.fasta(spark.createDataFrame(rows, schemas.SEQUENCE), f"{tmp_path}/f")
    assert sorted(map(tuple, readers.fasta(spark, f"{tmp_path}/f").collect())) == sorted(rows)
    (tmp_path / "hand.fa").write_text(">a\nAC\n\nGT \n>b\nTT\n")
    assert sorted(map(tuple, readers.fasta(spark, f"{tmp_path}/hand.fa").collect())) == [("a", "ACGT"), ("b", "TT")]


def test_delimited_text_with_nan(spark, tmp_path):
    rows = [(1, 0, math.nan, 0.5, 0.1, 0.2), (2, 1, 1.5, 0.25, 0.1, 0.2)]
    truth = spark.createDataFrame(rows, schemas.PLANET_TRUTH)
    sinks.tsv(truth, f"{tmp_path}/t")
    back = {r.star_id: r for r in readers.tsv(spark, f"{tmp_path}/t", schemas.PLANET_TRUTH).collect()}
    assert math.isnan(back[1].period) and back[2].period == 1.5
    sinks.bls_csv(spark.createDataFrame([(1, 1 / 3, 0.1, 0.2, 1e-5, 12.3456789)], schemas.BLS_RESULT), f"{tmp_path}/b")
    lines = [x for p in (tmp_path / "b").glob("*.csv") for x in p.read_text().split("\n")]
    assert [x for x in lines if x.startswith("1,")] == ["1,0.3333333333,0.1000000000,0.2000000000,1.0000000000e-05,12.345679"]


def test_json_map_and_batches(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"read000001": [5, 9], "read000002": [0, 4]}))
    assert sorted(map(tuple, readers.json_map(spark, f"{tmp_path}/w.json").collect())) == [("read000001", 5, 9), ("read000002", 0, 4)]
    (tmp_path / "b.json").write_text(json.dumps([[3, 1], [2], []]))
    assert sorted(map(tuple, readers.batch_list(spark, f"{tmp_path}/b.json").collect())) == [(0, 0, 3), (0, 1, 1), (1, 0, 2)]
    assert readers.batch_list(spark, f"{tmp_path}/b.json", 1).count() == 1
    with pytest.raises(Exception, match="no batch 3"):
        readers.batch_list(spark, f"{tmp_path}/b.json", 3).collect()
    sinks.batch_plan(spark.createDataFrame([(0, 1, 7), (0, 0, 5), (1, 2, 6)], "batch int, position int, idx int"), f"{tmp_path}/plan")
    assert sorted(map(str, (json.loads(x) for p in (tmp_path / "plan").glob("*.json") for x in p.read_text().split()))) == ["{'batch': 0, 'idx': [5, 7]}", "{'batch': 1, 'idx': [6]}"]


def test_npz_and_npy(spark, tmp_path):
    flux = np.arange(12.0).reshape(3, 4)
    np.savez(tmp_path / "c.npz", time=np.arange(4.0), flux=flux, flux_err=flux * 0 + 1)
    got = readers.lightcurves_npz(spark, f"{tmp_path}/c.npz", 2)
    assert got.count() == 8 and got.agg(F.sum("flux")).first()[0] == flux[:2].sum()
    np.save(tmp_path / "m.npy", flux.astype(np.float32))
    readers.register(spark)
    rows = spark.read.format("npy").option("rows_per_task", 2).load(f"{tmp_path}/m.npy")
    assert rows.rdd.getNumPartitions() == 2 and [r.v for r in rows.orderBy("i").collect()] == flux.tolist()


def test_json_lines_append_and_metrics(spark, tmp_path):
    row = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 1, "fits", "shuffled")], schemas.PROFILE)
    sinks.json_lines(row, f"{tmp_path}/p", fresh=True)
    sinks.json_lines(row, f"{tmp_path}/p")
    assert readers.profile_log(spark, f"{tmp_path}/p").count() == 2
    sinks.json_lines(row, f"{tmp_path}/p", fresh=True)
    assert readers.profile_log(spark, f"{tmp_path}/p").count() == 1
    found = sinks.with_metrics(spark.range(10), f"{tmp_path}/m", n=F.count("*"), top=F.max("id"))
    assert found == {"n": 10, "top": 9} and spark.read.parquet(f"{tmp_path}/m").count() == 10
    sinks.arrays(spark.range(10).withColumn("g", F.col("id") % 2), f"{tmp_path}/a", ("g",), ("id",))
    sinks.append(spark.range(3), f"{tmp_path}/q")
    sinks.append(spark.range(3), f"{tmp_path}/q")
    assert spark.read.parquet(f"{tmp_path}/q").count() == 6 and spark.read.parquet(f"{tmp_path}/a").count() == 10


def test_constructors(spark):
    assert [r.v for r in synthetic.linspace(spark, 1.0, 3.0, 5).orderBy("id").collect()] == [1.0, 1.5, 2.0, 2.5, 3.0]
    assert synthetic.matrix(spark, 2, 3).agg(F.sum("v")).first()[0] == 15.0 and synthetic.matrix(spark, 2, 3, 1.0).agg(F.sum("v")).first()[0] == 6.0
    assert synthetic.random_matrix(spark, 4, 4).where("v < 0 or v >= 1").count() == 0
    blobs = synthetic.blobs(spark, 3000, ((0, 0), (50, 0)))
    assert {round(r.m) for r in blobs.groupBy("centre").agg(F.avg("x").alias("m")).collect()} == {0, 50}


def fits_file(path, images):
    """A primary header without data and an image extension for each array."""

    def block(cards):
        text = "".join(c.ljust(80) for c in [*cards, "END"])
        return text.ljust(-(-len(text) // 2880) * 2880).encode()

    out = block(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0"])
    for k, (image, bits, kind) in enumerate(images):
        ny, nx = image.shape
        cards = ["XTENSION= 'IMAGE   '", f"BITPIX  = {bits:20d} / bits", "NAXIS   =                    2", f"NAXIS1  = {nx:20d}", f"NAXIS2  = {ny:20d}", f"CCDID   = '{k // 3 + 1}-2     '", "QUADID  = 'F       '"]
        data = image.astype(kind).tobytes()
        out += block(cards) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")
    path.write_bytes(out)


def test_fits_and_parquet_exposures(spark, tmp_path):
    from quern.sources.exposures import FitsExposure, ParquetExposure

    planes = [np.arange(12.0).reshape(3, 4) + 100 * k for k in range(6)]
    fits_file(tmp_path / "e.fits", [(p, -32, ">f4") if k % 3 < 2 else (p, 16, ">i2") for k, p in enumerate(planes)])
    exposure = FitsExposure(spark, f"{tmp_path}/e.fits")
    assert sorted((r.det_num, r.det_id, r.nx, r.ny) for r in exposure.detectors().collect()) == [(0, "1-2.F", 4, 3), (1, "2-2.F", 4, 3)]
    ParquetExposure.write(exposure, f"{tmp_path}/p")
    for source in (exposure, ParquetExposure(spark, f"{tmp_path}/p")):
        got = {(r.y, r.x): (r.sci, r.rms, r.flg) for r in source.pixels(1).collect()}
        assert got == {(y, x): tuple(planes[3 + k][y, x] for k in range(3)) for y in range(3) for x in range(4)}
        assert source.pixels().count() == 24
    with pytest.raises(Exception, match="offset"):
        spark.read.format("fits").option("offset", -1).load(f"{tmp_path}/e.fits").collect()


def test_implementations_are_checked_and_timed(spark):
    from quern.operators import linalg
    from quern.operators.distribution import Implementations

    a = spark.range(30).select((F.col("id") % 5).alias("i"), F.expr("id div 5").alias("k"), F.col("id").alias("v"))
    b = spark.range(30).select(F.expr("id div 5").alias("k"), (F.col("id") % 5).alias("j"), F.col("id").alias("v"))
    kinds = Implementations("join", ("i", "j"), "v")
    kinds.add("join", linalg.matmul)
    kinds.add("blocks", lambda x, y: linalg.block_matmul(x, y, (5, 6, 5), 4))
    kinds.add("wrong", lambda x, y: linalg.matmul(x, y).withColumn("v", F.col("v") + 1))
    assert kinds.validate("blocks", a, b) and not kinds.validate("wrong", a, b)
    assert set(kinds.benchmark(a, b, names=["join"])) == {"join"}
    seen = kinds.profile(a, b, names=["join", "blocks"])
    assert seen.calls == {"join": 1, "blocks": 1} and seen.rows["join"] == seen.rows["blocks"] > 0
    with pytest.raises(KeyError):
        kinds.run("nothing", a, b)
    with pytest.raises(TypeError):
        kinds.add("text", "not a function")


def grid(spark, shape, seed=0):
    values = np.random.default_rng(seed).normal(size=shape).astype(np.float32)
    rows = [(*map(int, i), float(values[i])) for i in np.ndindex(*shape)]
    return values, spark.createDataFrame(rows, ", ".join(f"d{k} long" for k in range(len(shape))) + ", v double").repartition(3)


def test_array_files_are_filled_in_place(spark, tmp_path):
    from quern.sources import gridfiles

    values, rows = grid(spark, (7, 5, 3))
    dims = ("d0", "d1", "d2")
    gridfiles.npy(rows, f"{tmp_path}/a.npy", dims, "v", values.shape)
    assert np.array_equal(np.load(tmp_path / "a.npy"), values)
    gridfiles.npz({"a": (rows, dims, "v", values.shape), "b": (rows.limit(0), dims, "v", (2, 0, 1))}, f"{tmp_path}/n.npz")
    with np.load(tmp_path / "n.npz") as back:
        assert sorted(back) == ["a", "b"] and np.array_equal(back["a"], values) and back["b"].shape == (2, 0, 1)
    for part in (rows.where("d0 < 3"), rows.where("d0 >= 3")):  # frame by frame into one file
        gridfiles.memmap(part, f"{tmp_path}/m.dat", dims, "v", values.shape)
    assert np.array_equal(np.memmap(tmp_path / "m.dat", "<f4", "r", shape=values.shape), values)


def test_netcdf_round_trip_and_hyperslabs(spark, tmp_path):
    from quern.sources import gridfiles

    values, rows = grid(spark, (9, 4, 3))
    rows = rows.select("d0", "d1", "d2", "v", (F.col("v") * 2).alias("w")).withColumnsRenamed({"d0": "time", "d1": "lat", "d2": "lon"})
    path = f"{tmp_path}/c.nc"
    gridfiles.netcdf(rows, path, {"time": 9, "lat": 4, "lon": 3}, {"v": {"units": "K", "valid_min": 1.5}, "w": {"flag": [1, 2]}}, {"lat": [45.0, 46.0, 47.0, 48.0]}, {"title": "a grid"})
    header = gridfiles.read_header(path)
    assert header.dims == {"time": 9, "lat": 4, "lon": 3} and header.attributes == {"title": "a grid"}
    assert header.variables["v"].attributes == {"units": "K", "valid_min": 1.5} and header.variables["w"].attributes == {"flag": [1, 2]}
    back = gridfiles.read_netcdf(spark, path, ["v"])
    assert back.columns == ["time", "lat", "lon", "v"] and back.count() == values.size
    part = gridfiles.read_netcdf(spark, path, ["v", "w"], time="2:5", lat="1", lon="0:2")
    want = [(t, 1, x, float(values[t, 1, x]), float(np.float32(2 * values[t, 1, x]))) for t in range(2, 5) for x in range(2)]
    assert sorted(map(tuple, part.collect())) == want
    assert sorted(map(tuple, gridfiles.read_netcdf(spark, path, ["lat"]).select("lat_index", "lat").collect())) == [(0, 45.0), (1, 46.0), (2, 47.0), (3, 48.0)]
    with pytest.raises(Exception, match="different dimensions"):
        gridfiles.read_netcdf(spark, path, ["v", "lat"]).count()
    (tmp_path / "x.nc").write_bytes(b"no such file")
    with pytest.raises(Exception, match="classic"):
        gridfiles.read_netcdf(spark, f"{tmp_path}/x.nc", ["v"]).count()


def test_netcdf_files_by_hand(spark, tmp_path):
    """Bytes as the format's description has them: 32-bit offsets, and records of two variables."""
    import struct

    from quern.sources import gridfiles

    word = lambda *n: struct.pack(f">{len(n)}i", *n)
    dims = word(10, 2) + word(1) + b"t\0\0\0" + word(0) + word(1) + b"x\0\0\0" + word(3)
    def variable(name, begin, kind, size, ids):
        return word(1) + name + b"\0\0\0" + word(len(ids), *ids) + word(0, 0) + word(kind, size, begin)
    build = lambda at: b"CDF\1" + word(2) + dims + word(0, 0) + word(11, 3) + variable(b"a", at, 3, 8, (0, 1)) + variable(b"b", at + 8, 5, 4, (0,)) + variable(b"c", at - 12, 4, 12, (1,))
    at = len(build(0)) + 12
    records = b"".join(struct.pack(">3h2x", *(10 * t + x for x in range(3))) + struct.pack(">f", t + 0.5) for t in range(2))
    (tmp_path / "h.nc").write_bytes(build(at) + word(7, 8, 9) + records)
    read = lambda *names: sorted(map(tuple, gridfiles.read_netcdf(spark, f"{tmp_path}/h.nc", names).collect()))
    assert read("a") == [(t, x, 10.0 * t + x) for t in range(2) for x in range(3)]
    assert read("b") == [(0, 0.5), (1, 1.5)] and read("c") == [(0, 7.0), (1, 8.0), (2, 9.0)]


def test_climate_indices_from_netcdf(spark, tmp_path):
    from quern.plans import climate
    from quern.sources import gridfiles

    days = synthetic.climate(spark, 2, 2, 2)
    gridfiles.netcdf(days, f"{tmp_path}/c.nc", {"day": 730, "lat_i": 2, "lon_j": 2}, {"tasmax": {"units": "K"}, "pr": {"units": "mm d-1"}}, kind=6)
    back = gridfiles.read_netcdf(spark, f"{tmp_path}/c.nc", ["tasmax", "pr"])
    rows = lambda df: sorted(tuple(map(float, r)) for r in climate.indices_by_cell(df).collect())
    assert rows(back.select(F.col("day").cast("int"), F.col("lat_i").cast("int"), F.col("lon_j").cast("int"), "tasmax", "pr")) == rows(days)


def test_hdf5_round_trip(spark, tmp_path):
    from quern.sources import hdf5

    for shape, chunk in (((7, 5), (3, 2)), ((300,), (2,)), ((4, 3, 2), (4, 3, 2))):
        values, rows = grid(spark, shape)
        dims = [f"d{k}" for k in range(len(shape))]
        hdf5.hdf5(rows, f"{tmp_path}/a.h5", "x", dims, "v", shape, chunk, attributes={"units": "K", "scale": 0.5, "levels": [1, 2, 3]})
        file = hdf5.Reader(f"{tmp_path}/a.h5")
        found = file.dataset("x")
        assert (found.shape, found.chunk, found.dtype) == (shape, chunk, np.dtype("<f4")) and found.attributes == {"units": "K", "scale": 0.5, "levels": [1, 2, 3]}
        back = hdf5.read_hdf5(spark, f"{tmp_path}/a.h5", "x").collect()
        got = np.zeros(shape, np.float32)
        for r in back:
            got[tuple(r[:-1])] = r[-1]
        assert len(back) == values.size and np.array_equal(got, values)
    hdf5.hdf5(rows.limit(0), f"{tmp_path}/e.h5", "x", dims, "v", (4, 3, 2), (4, 3, 2))
    assert hdf5.read_hdf5(spark, f"{tmp_path}/e.h5", "x").count() == 0
    with pytest.raises(KeyError):
        file.dataset("y")
    (tmp_path / "x.h5").write_bytes(b"\0" * 200)
    with pytest.raises(ValueError, match="no HDF5"):
        hdf5.Reader(f"{tmp_path}/x.h5")


def test_hdf5_bytes(tmp_path):
    """Fixed parts of the format, byte by byte, and a contiguous, shuffled and big-endian dataset put together by hand."""
    import struct
    import zlib

    from quern.sources import hdf5

    out = hdf5.Writer(f"{tmp_path}/g.h5")
    space, kind = hdf5._space_message((2, 3)), hdf5._type_message(np.dtype(">i2"))
    assert space == bytes([1, 2, 0, 0, 0, 0, 0, 0]) + struct.pack("<QQ", 2, 3)
    assert hdf5._type_message(np.dtype("<f8")) == bytes([0x11, 0x20, 0x3F, 0, 8, 0, 0, 0, 0, 0, 64, 0, 52, 11, 0, 52, 0xFF, 3, 0, 0])
    data = np.arange(6, dtype=">i2")
    flat = out._header([(1, space), (3, kind), (8, struct.pack("<BBQQ", 3, 1, out._put(data.tobytes()), 12))])
    wide = np.arange(4, dtype="<f4")
    shuffled = zlib.compress(wide.view(np.uint8).reshape(4, 4).T.tobytes())
    tree = out._tree([((0,), len(shuffled), out._put(shuffled))], (4,))
    filters = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHI4x", 2, 0, 1, 1, 4) + struct.pack("<HH2xHI4x", 1, 0, 1, 6)
    mixed = out._header([(1, hdf5._space_message((4,))), (3, hdf5._type_message(np.dtype("<f4"))), (8, struct.pack("<BBBQII", 3, 2, 2, tree, 4, 4)), (11, filters)])
    inner = out.group({"mixed": mixed})
    out.close(out.group({"flat": flat, "inner": inner, **{f"m{i:03d}": flat for i in range(100)}}))
    raw = (tmp_path / "g.h5").read_bytes()
    assert raw[:8] == b"\x89HDF\r\n\x1a\n" and raw[13:15] == b"\x08\x08" and struct.unpack_from("<Q", raw, 40)[0] == len(raw)
    file = hdf5.Reader(f"{tmp_path}/g.h5")
    assert len(file.members(file.root)) == 102
    for name, want in (("flat", data.reshape(2, 3)), ("inner/mixed", wide), ("m077", data.reshape(2, 3))):
        d = file.dataset(name)
        assert np.array_equal(np.concatenate([file.values(d, *c) for c in file.chunks(d)]), want)


def test_hdf5_exposures(spark, tmp_path):
    from quern.sources.exposures import FitsExposure, Hdf5Exposure

    planes = [np.arange(12.0).reshape(3, 4) + 100 * k for k in range(6)]
    fits_file(tmp_path / "e.fits", [(p, -32, ">f4") if k % 3 < 2 else (p, 16, ">i2") for k, p in enumerate(planes)])
    source = FitsExposure(spark, f"{tmp_path}/e.fits")
    Hdf5Exposure.write(source, f"{tmp_path}/e.h5", chunk=(2, 3))
    back = Hdf5Exposure(spark, f"{tmp_path}/e.h5")
    same = lambda df: sorted(map(tuple, df.select("det_num", "y", "x", "sci", "rms", "flg").collect()))
    assert same(back.pixels()) == same(source.pixels()) and same(back.pixels(1)) == same(source.pixels(1)) and back.pixels(7).count() == 0
    about = lambda s: sorted((r.det_num, r.det_id, r.nx, r.ny, r.header["CCDID"]) for r in s.detectors().collect())
    assert about(back) == about(source)


def test_drawings(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 2).alias("s"), (F.col("id") / 100).alias("x"), F.sin(F.col("id") / 300).alias("y"))
    sinks.plot(rows, f"{tmp_path}/p.svg", "x", "y", "s")
    text = (tmp_path / "p.svg").read_text()
    assert text.count("<polyline") == 2 and len(text) < 20_000
    sinks.plot(rows.limit(0), f"{tmp_path}/e.svg", "x", "y")
    with pytest.raises(ValueError):
        sinks.plot(rows.withColumn("s", F.floor("x")), f"{tmp_path}/m.svg", "x", "y", "s")


def test_command_line(spark, sf_dir, tmp_path, monkeypatch, capsys):
    from quern import __main__ as cli

    monkeypatch.setenv("SLURM_CPUS_PER_TASK", "many")
    monkeypatch.delenv("BENCH_CPUS", raising=False)
    assert cli.parsed(["ring_shift"]).cpus == -1 and cli.parsed(["x", "--cpus", "3"]).cpus == 3
    assert cli.main(["list"]) == 0 and "ring_shift" in capsys.readouterr().out and cli.main(["nothing"]) == 2
    assert cli.main(["ring_shift", sf_dir, "--out", f"{tmp_path}/o"]) == 0 and spark.read.parquet(f"{tmp_path}/o").count() == 25


@pytest.mark.parametrize("form", ["npy", "memmap", "netcdf", "npz", "hdf5"])
def test_a_failed_write_changes_nothing(spark, tmp_path, form):
    """One task fails after others have written: the file is what it was, and nothing lies beside it."""
    from quern.sources import gridfiles, hdf5

    good = spark.range(64, numPartitions=8).select(F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    bad = good.withColumn("v", F.when(F.col("i") == 63, F.raise_error(F.lit("lost")).cast("double")).otherwise(-F.col("v")))
    path = f"{tmp_path}/x.{form}"
    write = {
        "npy": lambda df: gridfiles.npy(df, path, ["i"], "v", (64,)),
        "memmap": lambda df: gridfiles.memmap(df, path, ["i"], "v", (64,)),
        "netcdf": lambda df: gridfiles.netcdf(df, path, {"i": 64}, {"v": {}}),
        "npz": lambda df: gridfiles.npz({"a": (df, ["i"], "v", (64,))}, path),
        "hdf5": lambda df: hdf5.hdf5(df, path, "a", ["i"], "v", (64,), (5,)),
    }[form]
    write(good)
    before = (tmp_path / f"x.{form}").read_bytes()
    with pytest.raises(Exception, match="lost"):
        write(bad)
    assert (tmp_path / f"x.{form}").read_bytes() == before and [p.name for p in tmp_path.iterdir()] == [f"x.{form}"]
    write(good.limit(3).withColumn("v", F.col("v") + 100))
    assert (tmp_path / f"x.{form}").read_bytes() != before
