"""Plans against NumPy versions of the same definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import aggregates, scalar
from quern.operators import iterate, linalg, pairwise, relational, spatial, stencil, windows
from quern.operators.kernels import lattice as kernel
from quern.plans import alignment, builder, climate, lattice, stamps, trajectory, transit
from quern.sources import synthetic

from .test_kernels import align_by_cells, path_score


def test_running_median(spark):
    rng = np.random.default_rng(0)
    t, y = np.sort(rng.uniform(0, 10, 150)), rng.normal(size=150)
    frame = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(t, y, strict=True)], "g int, t double, y double")
    got = [r.trend for r in windows.running_median(frame, ["g"], "t", "y", 0.25).orderBy("t").collect()]
    assert np.allclose(got, [np.median(y[(t >= x - 0.25) & (t <= x + 0.25)]) for x in t])


def test_running_median_of_long_series_in_spans(spark, monkeypatch):
    rng = np.random.default_rng(1)
    t = np.concatenate((np.sort(rng.uniform(-30, 60, 400)), np.arange(-4, 4, 0.25)))  # many exactly half a width apart, and on borders of spans
    y = rng.normal(size=len(t))
    rows = [(0, float(a), float(b)) for a, b in zip(t, y, strict=True)] + [(1, None, 2.0), (1, None, 4.0), (1, 1.0, 5.0)]
    for frames in (1, 3, 64):
        monkeypatch.setattr(windows, "FRAMES", frames)
        got = windows.running_median(spark.createDataFrame(rows, "g int, t double, y double"), ["g"], "t", "y", 0.25).collect()
        assert len(got) == len(rows) and sorted(r.trend for r in got if r.g) == [3.0, 3.0, 5.0]
        want = {(float(a), float(b)): np.median(y[(t >= a - 0.25) & (t <= a + 0.25)]) for a, b in zip(t, y, strict=True)}
        assert all(r.trend == pytest.approx(want[r.t, r.y]) for r in got if not r.g)


def test_histogram_edges_like_numpy(spark):
    for edges in (np.linspace(0, 1.2, 241), np.array([0.0, 0.1, 0.5, 0.7, 2.0])):
        values = np.concatenate((edges, np.nextafter(edges, 9), np.nextafter(edges, -9), np.random.default_rng(1).uniform(-0.1, 1.4, 500)))
        frame = spark.createDataFrame([(float(v),) for v in values], "v double")
        got = [r.n for r in aggregates.histogram(frame, "v", [float(e) for e in edges]).orderBy("bin").collect()]
        assert got == np.histogram(values, bins=edges)[0].tolist()


def particles(spark, n, box, seed=0, frames=2):
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(0, box, (frames, n, 3))
    rows = [(f, i, *map(float, xyz[f, i])) for f in range(frames) for i in range(n)]
    return xyz, spark.createDataFrame(rows, "frame int, id int, x double, y double, z double")


@pytest.mark.parametrize(("box", "cutoff"), [(2.288, 1.2), (5.0, 0.7), (3.0, 1.0)])
def test_cell_join_finds_each_pair_once(spark, box, cutoff):
    xyz, points = particles(spark, 90, box)
    got = sorted((r.frame, r.a, r.b) for r in spatial.close_pairs(points, (box,) * 3, cutoff, ("frame",)).collect())
    both = sorted((r.frame, r.a, r.b) for r in spatial.cell_join(points, points, (box,) * 3, cutoff, ("frame",)).where("a < b").collect())
    want = []
    for f in range(2):
        d = xyz[f, :, None] - xyz[f, None]
        d -= box * np.round(d / box)
        i, j = np.nonzero(np.triu((d**2).sum(2) <= cutoff**2, 1))
        want += [(f, int(a), int(b)) for a, b in zip(i, j, strict=True)]
    assert got == both == sorted(want)


def test_hydrogen_bonds_like_loops(spark):
    traj, topology, roles = synthetic.trajectory(spark, 6, 60, 2, 1.6)
    box = 1.6
    xyz = {(r.frame, r.atom): np.array([r.x, r.y, r.z], np.float64) for r in traj.collect()}
    of = {role: sorted(r.atom for r in roles.where(F.col("role") == role).collect()) for role in ("donor", "acceptor", "hydrogen")}
    image = lambda d: d - box * np.round(d / box)
    want = {}
    for f in range(2):
        n = 0
        for d in of["donor"]:
            for a in of["acceptor"]:
                r = np.linalg.norm(image(xyz[f, d] - xyz[f, a]))
                if a == d or not 1e-6 < r < 0.35:
                    continue
                for h in (d + 1, d + 2):
                    if h in of["hydrogen"]:
                        u, v = image(xyz[f, d] - xyz[f, h]), image(xyz[f, a] - xyz[f, h])
                        if min(np.linalg.norm(u), np.linalg.norm(v)) >= 1e-6 and u @ v <= np.cos(np.radians(150)) * np.linalg.norm(u) * np.linalg.norm(v):
                            n += 1
                            break
        want[f] = n
    assert {r.frame: r.hbonds for r in trajectory.bond_counts(traj, roles, (box,) * 3).collect()} == want and sum(want.values()) > 0


def test_hydrogens_on_their_donor_or_acceptor_make_no_bond(spark):
    roles = spark.createDataFrame([(0, "donor"), (1, "hydrogen"), (2, "hydrogen"), (3, "acceptor")], "atom int, role string")
    for hydrogens, n in ((((1.0, 1.0, 1.0), (1.0, 1.0, 1.0)), 0), (((1.3, 1.0, 1.0), (1.0, 1.0, 1.0)), 0), (((1.0, 1.0, 1.0), (1.1, 1.0, 1.0)), 1), (((1.0, 1.1, 1.0), (0.9, 1.0, 1.0)), 0)):
        atoms = [(0, 0, 1.0, 1.0, 1.0), *[(0, i + 1, *h) for i, h in enumerate(hydrogens)], (0, 3, 1.3, 1.0, 1.0)]
        frame = spark.createDataFrame(atoms, "frame int, atom int, x double, y double, z double")
        assert trajectory.bond_counts(frame, roles, (3.0,) * 3).first()["hbonds"] == n


def test_deviation_after_the_best_fit(spark):
    rng = np.random.default_rng(2)
    first = rng.normal(size=(9, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    frames = [first, first @ turn + 4.0, first * [1, 1, -1], first + 0.1 * rng.normal(size=first.shape)]
    rows = [(f, i, *map(float, p)) for f, x in enumerate(frames) for i, p in enumerate(x)]
    traj = spark.createDataFrame(rows, "frame int, atom int, x double, y double, z double")
    got = {r.frame: r.rmsd for r in trajectory.deviation(traj, traj.select("atom")).collect()}
    a = first - first.mean(0)
    for f, x in enumerate(frames):
        b = x - x.mean(0)
        u, s, v = np.linalg.svd(b.T @ a)
        s[2] *= np.sign(np.linalg.det(u @ v))
        assert got[f] == pytest.approx(np.sqrt(max(0.0, ((a**2).sum() + (b**2).sum() - 2 * s.sum()) / 9)), abs=1e-7)
    assert got[1] < 1e-6 and got[2] > 0.1
    spread = {r.atom: r.rmsf for r in trajectory.fluctuation(traj).collect()}
    want = np.sqrt(np.stack(frames).var(0).sum(1))
    assert np.allclose([spread[i] for i in range(9)], want)


def test_surface_of_lone_and_touching_spheres(spark):
    atoms = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 0.1), (1, 3.0, 3.0, 3.0, 0.2), (2, 3.0, 3.0, 3.2, 0.2), (3, 3.0, 3.0, 3.05, 0.01)], "id int, x double, y double, z double, radius double")
    got = {r.id: r.area for r in trajectory.surface(atoms, (5.0,) * 3, 0.14, 400).collect()}
    assert got[0] == pytest.approx(4 * np.pi * 0.24**2) and got[3] == 0.0
    # a sphere loses the cap beyond the plane half way
    assert got[1] == pytest.approx(2 * np.pi * 0.34 * (0.34 + 0.1), rel=0.02) and got[1] == pytest.approx(got[2], rel=0.02)


def test_sites_keep_off_what_is_there(spark):
    box = (2.0,) * 3
    taken = spark.createDataFrame([(0, 1.0, 1.0, 1.0)], "id int, x double, y double, z double")
    lattice_sites = builder.sites(spark, 6, 2.0, 0.05, 5)
    free = builder.free_sites(lattice_sites, taken, box, 150, 0.4, 9).collect()
    assert lattice_sites.count() == 216 and len(free) == len({r.id for r in free}) == 150
    assert all(np.linalg.norm(np.array([r.x, r.y, r.z]) - 1.0) >= 0.4 for r in free)


def test_relaxation_moves_apart_and_draws_bonds(spark):
    atoms = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, 1.1, 1.0, 1.0), (2, 2.0, 2.0, 2.0), (3, 2.0, 2.0, 2.5), (4, 0.01, 2.9, 0.01), (5, 2.99, 2.9, 2.99)], "id int, x double, y double, z double")
    bonds = spark.createDataFrame([(2, 3, 0.3)], "a int, b int, length double")
    got = {r.id: np.array([r.x, r.y, r.z]) for r in builder.relax(atoms, bonds, (3.0,) * 3, 3).collect()}
    image = lambda a, b: np.linalg.norm((d := got[a] - got[b]) - 3.0 * np.round(d / 3.0))
    assert image(0, 1) > 0.15 and 0.3 < image(2, 3) < 0.4 and image(4, 5) > 0.05
    assert np.allclose(got[0] + got[1], [2.1, 2.0, 2.0])  # forces of a pair cancel


def test_pair_distribution(spark):
    traj, topology, _ = synthetic.trajectory(spark, 6, 80, 3, 2.4)
    found = trajectory.pair_distribution(traj, topology, (2.4,) * 3).orderBy("bin").collect()
    oxygens = {r.atom for r in topology.where("type = 1").collect()}
    rows = [r for r in traj.collect() if r.atom in oxygens]
    hist = np.zeros(240, int)
    for f in range(3):
        x = np.array([[r.x, r.y, r.z] for r in rows if r.frame == f], np.float64)
        d = x[:, None] - x[None]
        d -= 2.4 * np.round(d / 2.4)
        hist += np.histogram(np.sqrt((d**2).sum(2))[np.triu_indices(len(x), 1)], bins=np.append(np.arange(240) * (1.2 / 240), 1.2))[0]
    assert [r.hist for r in found] == hist.tolist()
    shell = 4 / 3 * np.pi * (((np.arange(240) + 1) * 0.005) ** 3 - (np.arange(240) * 0.005) ** 3)
    assert np.allclose([r.g for r in found], hist / (shell * (80 * 79 / 2) / 2.4**3 * 3))
    q = {r.frame: r.q for r in trajectory.native_contacts(traj, topology, (2.4,) * 3).collect()}
    assert q[0] == 1.0 and set(q) == {0, 1, 2}


def test_light_curves_are_recovered(spark):
    curves, truth = synthetic.light_curves(spark, 4, 1500)
    found = transit.search(curves, 400)
    assert tuple(transit.recovery(found, truth).first()) == (2, 0, 0, 2)


def test_reads_align_like_cells_and_find_their_origin(spark):
    reads, places, genome, truth = synthetic.reads(spark, 25, 40, 120, 5000)
    found = {r.read: r for r in alignment.align_reads(reads, places, genome).collect()}
    whole, at = genome.first().seq, {r.name: r for r in places.collect()}
    for r in reads.collect():
        score, i, j = align_by_cells(r.seq, whole[at[r.name].start : at[r.name].stop])
        assert (found[r.name].score, found[r.name].query_end, found[r.name].target_end) == (score, i, at[r.name].start + j)
    near = alignment.plausibility(alignment.align_reads(reads, places, genome), truth).first()
    assert near["near"] > 0.9


def test_climate_kernel_equals_plan(spark):
    table = synthetic.climate(spark, 3, 2, 2)
    for wanted in (climate.INDICES, ("cdd",), ("tx90p", "gdd")):
        a, b = ([tuple(r) for r in f(table, wanted).orderBy(*climate.YEAR).collect()] for f in (climate.indices, climate.indices_by_cell))
        assert np.allclose(a, b, equal_nan=True, rtol=1e-12)
    with pytest.raises(ValueError):
        climate.indices(table, ("frost",))
    # years with gaps are for the plan; the kernel takes whole ones
    gap = table.where("day <> 400 or lat_i = 0")
    assert climate.indices(gap).count() == 12
    for broken in (gap, table.where("day < 1000"), table.unionByName(table.limit(1)), table.where("day >= 365")):
        with pytest.raises(Exception, match="whole years"):
            climate.indices_by_cell(broken).count()


@pytest.mark.parametrize(("case", "reynolds"), [("cylinder", 60.0), ("cavity", 50.0)])
def test_lattice_plan_equals_kernel(spark, case, reynolds):
    nx, ny = 16, 12
    got = lattice.run(spark, case, nx, ny, 3, reynolds).orderBy("x", "y").collect()
    want = kernel.simulate(case, nx, ny, 3, reynolds)
    for name in ("ux", "uy", "rho"):
        assert np.allclose([r[name] for r in got], want[name].ravel(), rtol=0, atol=1e-12)


def test_stamps_are_filled_beyond_the_edge(spark):
    catalog = spark.createDataFrame([(1, 2.2, 3.0), (2, 50.0, 50.0), (3, 9.9, 9.9)], "id int, x double, y double")
    detectors = spark.createDataFrame([(0, 0, 0, 10, 10), (1, 5, 5, 10, 10)], "det_num int, x0 int, y0 int, nx int, ny int")
    pixels = spark.createDataFrame([(d, y, x, 100 * d + 10 * y + x, 0) for d in (0, 1) for y in range(10) for x in range(10)], "det_num int, y int, x int, sci int, flg int")
    got = {(r.id, r.sy, r.sx): (r.det_num, r.sci, r.flg, r.rms) for r in stamps.stamps(catalog, detectors, pixels, 4).collect()}
    assert {k[0] for k in got} == {1, 3} and len(got) == 32
    assert got[1, 0, 0] == (0, 10, 0, None) and got[1, 2, 2] == (0, 32, 0, None)
    assert got[3, 3, 3] == (0, 0, 1, None) and got[3, 0, 0] == (0, 88, 0, None)


def test_stencils(spark):
    rng = np.random.default_rng(0)
    u = rng.normal(size=(7, 5))
    grid = spark.createDataFrame([(r, c, float(u[r, c])) for r in range(7) for c in range(5)], "r long, c long, v double")
    as_array = lambda df: np.array([r.v for r in df.orderBy("r", "c").collect()]).reshape(7, 5)
    for edge in (0.0, 3.0):
        p = np.pad(u, 1, constant_values=edge)
        laplace = p[2:, 1:-1] + p[:-2, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2] - 4 * u
        assert np.allclose(as_array(stencil.laplacian(grid, edge, (7, 5))), laplace)
        assert np.allclose(as_array(stencil.heat_step(grid, 0.1, edge, (7, 5))), u + 0.1 * laplace)
    smooth = u
    for _ in range(3):
        smooth = (smooth + sum(np.roll(smooth, s, a) for s in (1, -1) for a in (0, 1))) / 5
    assert np.allclose(as_array(stencil.smooth(grid, (7, 5))), smooth)
    assert np.allclose(as_array(stencil.roll(grid, 2, -1, (7, 5))), np.roll(u, (2, -1), (0, 1)))
    with pytest.raises(ValueError):
        stencil.laplacian(grid, 1.0)
    assert stencil.profile(grid, "r", 3).count() == 5


def test_kmeans_policies_for_empty_clusters(spark):
    points = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (10.0, 0.0)], "x double, y double")
    start = [(0.0, 0.0), (9.0, 0.0), (500.0, 500.0)]
    assert iterate.kmeans(points, start, ("x", "y")) == [[0.5, 0.0], [10.0, 0.0], [500.0, 500.0]]
    assert iterate.kmeans(points, start, ("x", "y"), max_steps=1, empty="zero")[2] == [0.0, 0.0]
    assert np.isnan(iterate.kmeans(points, start, ("x", "y"), max_steps=1, empty="nan")[2]).all()


def test_matrices(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-5, 5, (9, 7)), rng.integers(-5, 5, (7, 6))
    rel = lambda m, i, j: spark.createDataFrame([(r, c, int(m[r, c])) for r in range(m.shape[0]) for c in range(m.shape[1])], f"{i} long, {j} long, v long")
    dense = lambda df, shape: np.array([[{(r.i, r.j): r.v for r in df.collect()}.get((i, j), 0) for j in range(shape[1])] for i in range(shape[0])])
    assert (dense(linalg.matmul(rel(a, "i", "k"), rel(b, "k", "j")), (9, 6)) == a @ b).all()
    assert (dense(linalg.block_matmul(rel(a, "i", "k"), rel(b, "k", "j"), (9, 7, 6), 4), (9, 6)) == a @ b).all()
    vectors = spark.createDataFrame([(list(map(float, row)),) for row in a], "v array<double>")
    assert np.allclose(linalg.gram_dense(vectors, "v"), a.T @ a)
    assert linalg.gram_dense(vectors.limit(0), "v").shape == (0, 0) and np.isnan(linalg.condition_number(np.zeros((0, 0)), 0))
    with pytest.raises(ValueError):
        linalg.check_shapes(3, 4)
    with pytest.raises(Exception, match="outside 0..7"):
        linalg.block_matmul(rel(a, "i", "k"), rel(b, "k", "j"), (8, 7, 6), 4).count()


def test_one_large_system(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(25, 25))
    m = m @ m.T + 25 * np.eye(25)
    b = rng.normal(size=25)
    cells = spark.createDataFrame([(i, k, float(m[i, k])) for i in range(25) for k in range(25)], "i long, k long, v double")
    right = spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "i long, v double")
    got = [r.v for r in linalg.solve_large(cells, right).orderBy("i").collect()]
    assert np.allclose(got, np.linalg.solve(m, b), rtol=1e-8)
    assert linalg.solve_large(cells, right.withColumn("v", F.lit(0.0))).where("v <> 0").count() == 0
    with pytest.raises(RuntimeError):
        linalg.solve_large(cells, right, most=2)


def test_jobs_beside_the_caller(spark):
    from quern.operators.background import Background, Profile, gather

    profile = Profile()

    @profile
    def rows(n):
        return spark.range(n)

    with Background(spark, 2) as jobs:
        kept, held = jobs.persist(spark.range(50))
        assert gather([jobs.submit(lambda n=n: rows(n).count()) for n in (3, 4)]) == [3, 4] and held.result() == 50
        kept.unpersist()
        failing = jobs.submit(lambda: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            gather([failing])
    found = profile.table(spark).first()
    assert (found["name"], found.calls, found.rows) == ("rows", 2, 7) and profile.rate("rows", 100.0) > 0


def test_functions_of_a_native_library(spark):
    from quern.functions.foreign import foreign

    rows = spark.createDataFrame([(8.0, 3.0), (None, 1.0), (-27.0, None), (4.0, 3.0)], "x double, y double")
    got = rows.select(foreign("m", "cbrt")("x").alias("c"), foreign("m", "hypot", 2)("x", "y").alias("h")).collect()
    assert got[1].c is None and [got[i].c for i in (0, 2, 3)] == pytest.approx([2.0, -3.0, 4 ** (1 / 3)]) and got[3].h == 5.0 and got[1].h is None and got[2].h is None


def test_throttled_tasks(spark):
    from quern.operators import distribution

    found = distribution.tasks(spark, 10, lambda i: i * i, at_once=2)
    assert found.rdd.getNumPartitions() == 2 and sorted(map(tuple, found.collect())) == [(i, float(i * i)) for i in range(10)]


def test_gravity_by_blocks_equals_loops(spark):
    rng = np.random.default_rng(3)
    x, y, m = rng.uniform(0, 9, (3, 70))
    x[5], y[5] = x[6], y[6]  # two at one place
    bodies = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(zip(x, y, m, strict=True))], "id int, x double, y double, m double")
    dx, dy = x[None] - x[:, None], y[None] - y[:, None]
    pull = 2.0 * m[:, None] * m[None] / (dx**2 + dy**2 + 0.01) ** 1.5
    for block in (7, 1000):
        got = linalg.gravity(bodies, 2.0, 0.1, block).orderBy("id").collect()
        assert np.allclose([r.fx for r in got], (pull * dx).sum(1)) and np.allclose([r.fy for r in got], (pull * dy).sum(1))


def test_block_distances_near_zero(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(40, 8))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = np.concatenate((a[:20] + 1e-7 * rng.normal(size=(20, 8)), a[20:]))
    d = pairwise._distances(a, b)
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert np.allclose(d, want, rtol=1e-9, atol=1e-15) and (np.diag(d)[20:] == 0).all()


def test_forms_of_distance_agree(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(12, 5)), rng.normal(size=(4, 5))
    rel = lambda m, i, v: spark.createDataFrame([(k, list(map(float, row))) for k, row in enumerate(m)], f"{i} long, {v} array<double>")
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    for form in ("broadcast", "norms", "einsum", "mapped"):
        got = {(r.id, r.other_id): r.distance for r in pairwise.against_few(rel(x, "id", "v"), rel(y, "other_id", "w"), form).collect()}
        assert np.allclose([[got[i, j] for j in range(4)] for i in range(12)], want)
    assert {r.id: r.nearest for r in pairwise.nearest(rel(x, "id", "v"), rel(y, "other_id", "w")).collect()} == dict(enumerate(want.argmin(1).tolist()))


def test_strict_lookup_fails_on_a_missing_key(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert relational.lookup(left, right, ["k"]).count() == 1
    with pytest.raises(Exception, match="no match"):
        relational.lookup(left, right, ["k"], strict=True).collect()


def test_scalar_corner_cases(spark):
    row = spark.range(1).select(
        scalar.minimum_image(F.lit(1.25), 0.5).alias("even"),
        scalar.phase_bin(F.lit(-0.1), 1.0, 200).alias("bin"),
        scalar.update_at(F.array(F.lit(1), F.lit(2)), 1, F.lit(9)).alias("set"),
        scalar.add_at(F.array(F.lit(1), F.lit(2)), 0, F.lit(9)).alias("add"),
        scalar.nan_to_zero(F.lit(float("nan"))).alias("nan"),
        scalar.finite(F.lit(float("inf"))).alias("inf"),
        scalar.allclose(F.lit(1.0), F.lit(1.0 + 1e-9)).alias("close"),
        scalar.central_difference(lambda x: scalar.polynomial(x, (1.0, 3.0, 2.0)), F.lit(2.0)).alias("slope"),
        scalar.detector_number(F.lit("7-1.E")).alias("unknown"),
        scalar.fused_chain(F.lit(-1.5)).alias("outside"),
    ).first()
    assert row["even"] == 0.25 and row["bin"] == 180 and row["set"] == [1, 9] and row["add"] == [10, 2]
    assert row["nan"] == 0.0 and row["inf"] is False and row["close"] is True and row["slope"] == pytest.approx(7.0, abs=1e-4)
    assert row["unknown"] is None and np.isnan(row["outside"])
    with pytest.raises(Exception, match="no such detector"):
        spark.range(1).select(scalar.ccd_name(F.lit(36))).collect()


def test_hash_uniform_is_uniform_and_stable(spark):
    draw = lambda parts: [r.u for r in spark.range(0, 20_000, 1, parts).select("id", scalar.uniform(1, F.col("id")).alias("u")).orderBy("id").collect()]
    one = draw(3)
    assert one == draw(7) and abs(np.mean(one) - 0.5) < 0.01 and 0 <= min(one) and max(one) < 1


def test_validators_tell_good_from_bad(spark):
    from quern.operators import validate

    cells = lattice.run(spark, "cavity", 16, 12, 3, 50.0)
    assert validate.lattice_physics(cells).first()["ok"]
    broken = cells.withColumn("ux", F.when(F.col("solid"), F.lit(0.1)).otherwise(F.col("ux")))
    assert not validate.lattice_physics(broken).first()["ok"]
    a = spark.createDataFrame([(1, 1.0, float("nan")), (2, 2.0, 3.0)], "k int, tx90p double, gdd double")
    b = spark.createDataFrame([(1, 1.0 + 1e-10, float("nan")), (3, 2.0, 3.0)], "k int, tx90p double, gdd double")
    found = {r["value"]: r for r in validate.regression(a, b, ["k"], ["tx90p", "gdd"]).collect()}
    assert (found["tx90p"].missing, found["tx90p"].extra, found["tx90p"].compared, found["tx90p"].differing, found["tx90p"].ok) == (1, 1, 1, 0, False)
    assert all(r.ok for r in validate.regression(a, a, ["k"], ["tx90p", "gdd"]).collect())
    far = a.withColumn("tx90p", F.col("tx90p") + 1e-6)
    assert {r["value"]: r.differing for r in validate.regression(a, far, ["k"], ["tx90p", "gdd"]).collect()} == {"tx90p": 2, "gdd": 0}
    assert validate.predicted_bytes(10, 20, 3) == 4800


def test_scatter_keeps_rows_in_ranges(spark):
    from quern.operators import distribution

    parts = distribution.scatter(spark.range(103).orderBy(F.desc("id")), 4, "id").withColumn("p", F.spark_partition_id())
    ranges = sorted((r.lo, r.hi) for r in parts.groupBy("p").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert distribution.placement(parts).agg(F.sum("rows")).first()[0] == 103


def test_blocks_wrap_round(spark):
    rng = np.random.default_rng(0)
    s = rng.integers(0, 9, 12).astype(float)
    frame = spark.createDataFrame([("a", i, float(x), 1.0) for i, x in enumerate(s)], "g string, bin int, s double, r double")
    got = {(r.start, r.width): (r.s, r.r) for r in windows.circular_blocks(frame, ["g"], 12, (1, 4, 11)).collect()}
    assert got == {(i, w): (sum(s[(i + k) % 12] for k in range(w)), float(w)) for i in range(12) for w in (1, 4, 11)}


def test_batches_like_array_split(spark):
    for n, k in ((30, 7), (5, 8), (103, 10)):
        got = relational.batches(spark.range(n), k, "id").orderBy("position").collect()
        want = [b for b, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
        assert [r.position for r in got] == list(range(n)) and [r.batch for r in got] == want


def test_positions_of_equal_and_null_keys_are_spread(spark):
    rows = spark.range(3000).select(F.lit(None).cast("string").alias("k"), "id")
    got = relational.positions(rows, "k").select("position", "__total").collect()
    assert sorted(r.position for r in got) == list(range(3000)) and {r["__total"] for r in got} == {3000}
    words = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "k string")
    assert [(r.k, r.batch) for r in relational.batches(words, 2, "k").orderBy("position").collect()] == [(None, 0), ("a", 0), ("a", 0), ("b", 1), ("c", 1)]
    assert relational.batches(words.limit(0), 3, "k").count() == 0


def test_texts_with_a_common_run_of_words_are_aligned(spark):
    from .test_kernels import align_by_cells, path_score as by_cells

    queries = [(1, "one two three four five six seven eight nine"), (2, "too short"), (3, None)]
    targets = [(10, "zero one two three four five six seven eight ten"), (11, "eight seven six five four three two one"), (12, "x one  two three four five six seven eight nine y"), (13, None)]
    found = alignment.align_seeded(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(targets, "target_id int, target string")).collect()
    texts = dict(targets)
    assert {(r.query_id, r.target_id): (r.score, r.query_end, r.target_end) for r in found} == {(1, t): by_cells(queries[0][1], texts[t]) for t in (10, 12)}


def test_paths_of_items_in_documents(spark, sf_dir):
    """Every path has the score that the alignment without paths says, and most items stand there letter by letter."""
    from quern.plans.q_pipelines import text_alignment, text_paths

    items = {r.item_id: r.text.lower() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    texts = {r.doc_id: r.text.lower() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ends = {(r.item_id, r.doc_id): (r.score, r.query_end, r.target_end) for r in text_alignment(spark, sf_dir).collect()}
    found = text_paths(spark, sf_dir).collect()
    assert len(found) == len(ends) > 0
    for r in found:
        query, target = (x.encode() for x in (items[r.item_id], texts[r.doc_id]))
        assert path_score(r.steps, query, target, r.query_start, r.target_start) == ends[r.item_id, r.doc_id] == (r.score, r.query_end, r.target_end)


def test_indefinite_systems_are_told_at_once(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 1, -1.0)], "i long, k long, v double")
    with pytest.raises(ValueError, match="positive definite"):
        linalg.solve_large(cells, spark.createDataFrame([(0, 1.0), (1, 1.0)], "i long, v double"))


def clustered(spark, n, box, seed=3):
    """Points of which half lie in a corner of a hundredth of the box, so that radii differ from place to place."""
    rng = np.random.default_rng(seed)
    xyz = np.concatenate((rng.uniform(0, box, (n // 2, 3)), rng.uniform(0, box / 100, (n - n // 2, 3))))
    d = xyz[:, None] - xyz[None]
    d -= box * np.round(d / box)
    return (d * d).sum(2), spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(xyz)], "frame int, id int, x double, y double, z double")


def test_points_are_not_broadcast(spark):
    """A table of points is small on disk, but not its copies in cells: no side of a join by cells passes the driver."""
    _, points = particles(spark, 50, 5.0)
    for found in (spatial.close_pairs(points, (5.0,) * 3, 0.7, ("frame",)), spatial.cell_join(points, points, (5.0,) * 3, 0.7, ("frame",))):
        assert found.count() >= 0 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_histogram_of_pairs_broadcasts_no_points(spark):
    r2, points = clustered(spark, 200, 5.0)
    found = spatial.pair_histogram(points, (5.0,) * 3, [0.0, 0.3, 0.6, 0.9, 1.2], ("frame",))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [frame" in plan
    assert [r.n for r in found.orderBy("bin").collect()] == np.histogram(np.sqrt(r2[np.triu_indices(200, 1)]), [0.0, 0.3, 0.6, 0.9, 1.2])[0].tolist()


def test_nearest_partner_looks_further_only_for_what_is_left(spark, monkeypatch):
    r2, points = clustered(spark, 400, 5.0)
    sizes, join = [], spatial.cell_join
    monkeypatch.setattr(spatial, "cell_join", lambda left, *a: (sizes.append(left.count()), join(left, *a))[1])
    got = {r.a: (r.partner, r.r2) for r in spatial.nearest_partner(points, (5.0,) * 3, 0.9, ("frame",)).collect()}
    assert sizes[0] == 400 and 0 < sizes[-1] <= 200
    np.fill_diagonal(r2, np.inf)
    want = {i: int(r2[i].argmin()) for i in range(400) if r2[i].min() <= 0.81}
    assert {a: b for a, (b, _) in got.items()} == want and all(d == pytest.approx(r2[a, b]) for a, (b, d) in got.items())


def test_clashes_are_sought_in_rounds(spark, monkeypatch):
    r2, points = clustered(spark, 400, 5.0)
    sizes, join = [], spatial.cell_join
    monkeypatch.setattr(spatial, "cell_join", lambda left, *a: (sizes.append(left.count()), join(left, *a))[1])
    sites, others = points.where("id % 2 = 0"), points.where("id % 2 = 1")
    for cutoff in (0.25, 0.9):
        got = {r.id for r in spatial.without_clashes(sites, others, (5.0,) * 3, cutoff).collect()}
        assert got == {i for i in range(0, 400, 2) if r2[i, 1::2].min() >= cutoff**2}
    assert sizes[0] == 200 and 0 < sizes[-1] <= 100


def test_blocks_grow_with_the_table_up_to_a_limit(spark, monkeypatch):
    """A vector goes to so many pairs of blocks, however many vectors there are; tiles and blocks don't change the sums."""
    assert [pairwise._blocks(n, pairwise.block_size(n)) for n in (100, 2000, 20_000, 600_000, 1 << 20)] == [1, 4, 16, 16, 16]
    rng = np.random.default_rng(2)
    rows = [(i, list(map(float, rng.normal(size=6))), i % 3) for i in range(90)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = sorted(map(tuple, pairwise.distance_stats(vectors).collect()))
    monkeypatch.setattr(pairwise, "_blocks", lambda n, block: 3)
    assert sorted(map(tuple, pairwise.distance_stats(vectors).collect())) == want and sum(r[2] for r in want) == 90 * 89 // 2


def test_points_of_a_small_file_are_not_broadcast(spark, sf_dir, tmp_path):
    """A file's size is known to the planner, unlike that of rows from Python: neither it nor AQE may take it for small enough to broadcast."""
    from quern.plans.q_joins import pair_histogram

    r2, points = clustered(spark, 200, 5.0)
    points.write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    args = (5.0,) * 3, 1.2, ("frame",)
    for found in (pair_histogram(spark, sf_dir), spatial.close_pairs(points, *args), spatial.cell_join(points, points, *args)):
        rows, plan = found.collect(), found._jdf.queryExecution().executedPlan().toString()
        assert rows and "Final Plan" in plan and "SortMergeJoin [frame" in plan and "BroadcastHashJoin [frame" not in plan
    found = spatial.pair_histogram(points, (5.0,) * 3, [0.0, 0.3, 0.6, 0.9, 1.2], ("frame",))
    assert [r.n for r in found.orderBy("bin").collect()] == np.histogram(np.sqrt(r2[np.triu_indices(200, 1)]), [0.0, 0.3, 0.6, 0.9, 1.2])[0].tolist()
