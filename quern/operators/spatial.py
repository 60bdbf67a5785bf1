"""Range joins by cells, nearest partners and footprints (survey J07-J10, J16, J23-J25, F12, T08)."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import histogram
from ..functions.scalar import minimum_image
from .checkpoints import use_checkpoints

AXES = ("x", "y", "z")


def _cell(coordinate: Column, box: float, n: int) -> Column:
    return F.least(F.floor(F.pmod(coordinate, F.lit(box)) / F.lit(box) * n), F.lit(n - 1)).cast("int")


def n_cells(box: float, cutoff: float) -> int:
    """At least three cells along an axis, or the 27 neighbours would repeat."""
    return max(3, int(box / cutoff))


#: A cell's neighbours, and the half of them that has one of each opposite pair and the cell itself.
NEIGHBOURS = tuple(itertools.product((-1, 0, 1), repeat=3))
HALF = tuple(o for o in NEIGHBOURS if o >= (0, 0, 0))


def _meet(left: DataFrame, right: DataFrame, box: Sequence[float], cutoff: float, by: Sequence[str], key: str, offsets: Sequence[tuple[int, ...]], same_set: bool, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs within cutoff. carry: columns of the right side, which isn't replicated, that go along, so that no join has to bring them back."""
    n = [n_cells(b, cutoff) for b in box]
    near = F.explode(F.array(*[F.struct(*[F.lit(o).alias(f"o{a}") for a, o in zip(AXES, offset, strict=True)]) for offset in offsets]))
    a = left.select(*by, F.col(key).alias("a"), *[F.col(c).cast("double").alias(f"a{c}") for c in AXES], near.alias("o"))
    home = F.lit(True)
    for c in AXES:
        home = home & (F.col(f"o.o{c}") == 0)
    a = a.select(*by, "a", *[f"a{c}" for c in AXES], home.alias("home"), *[F.pmod(_cell(F.col(f"a{c}"), box[i], n[i]) + F.col(f"o.o{c}"), F.lit(n[i])).alias(f"c{c}") for i, c in enumerate(AXES)])
    b = right.select(*by, F.col(key).alias("b"), *carry, *[F.col(c).cast("double").alias(f"b{c}") for c in AXES])
    b = b.select("*", *[_cell(F.col(f"b{c}"), box[i], n[i]).alias(f"c{c}") for i, c in enumerate(AXES)])
    d = [minimum_image(F.col(f"a{c}") - F.col(f"b{c}"), box[i]) for i, c in enumerate(AXES)]
    # never broadcast: a table of points is small on disk, and its copies in cells are not
    pairs = a.join(b.hint("merge"), [*by, *[f"c{c}" for c in AXES]])
    if same_set:
        pairs = pairs.where(~F.col("home") | (F.col("a") < F.col("b")))
    return pairs.select(*by, "a", "b", *carry, *[x.alias(f"d{c}") for x, c in zip(d, AXES, strict=True)]).withColumn("r2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).where(F.col("r2") <= cutoff * cutoff)


def cell_join(left: DataFrame, right: DataFrame, box: Sequence[float], cutoff: float, by: Sequence[str] = (), key: str = "id", carry: Sequence[str] = ()) -> DataFrame:
    """Pairs (by..., a, b, carry..., dx, dy, dz, r2) of a left and a right point within cutoff in a periodic box.

    Each left point goes to its 27 neighbouring cells, a right point to its own, and an equi-join on
    (by, cell) meets each pair once; the exact distance decides. The join sorts both sides, so neither passes the driver, and
    dense cells are split by AQE's skew join.
    """
    return _meet(left, right, box, cutoff, by, key, NEIGHBOURS, False, carry)


def close_pairs(points: DataFrame, box: Sequence[float], cutoff: float, by: Sequence[str] = (), key: str = "id") -> DataFrame:
    """Unordered pairs (by..., a, b, r2), a < b, of one set of points: of two neighbouring cells one goes to the other."""
    pairs = _meet(points, points, box, cutoff, by, key, HALF, True)
    return pairs.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "r2")


def pair_histogram(points: DataFrame, box: Sequence[float], edges: Sequence[float], by: Sequence[str] = (), key: str = "id") -> DataFrame:
    """(bin, n) of the pair distances up to the last edge."""
    pairs = close_pairs(points, box, edges[-1], by, key).withColumn("r", F.sqrt("r2"))
    return histogram(pairs, "r", edges)


def contacts(points: DataFrame, box: Sequence[float], cutoff: float, by: Sequence[str], key: str = "id") -> DataFrame:
    """Contacts a < b strictly within cutoff."""
    return close_pairs(points, box, cutoff, by, key).where(F.col("r2") < cutoff * cutoff).select(*by, "a", "b")


def native_fraction(found: DataFrame, frames: DataFrame, frame: str, native_frame: int) -> DataFrame:
    """Q: the share of the native frame's contacts that each frame keeps; frames without any are kept as 0."""
    native = found.where(F.col(frame) == native_frame).select("a", "b")
    total = native.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    kept = found.join(native, ["a", "b"]).groupBy(frame).agg(F.count("*").alias("kept"))
    return frames.select(frame).distinct().join(kept, frame, "left").crossJoin(F.broadcast(total)).select(frame, (F.coalesce("kept", F.lit(0)) / F.col("total")).alias("q"))


#: A cell of the first round of a search holds so many points at most, if RADII halvings of the cutoff get there.
CELL_POINTS, RADII = 12, 10


def radii(points: DataFrame, box: Sequence[float], cutoff: float, by: Sequence[str] = ()) -> list[float]:
    """Radii to search in turn, each twice the one before, up to the cutoff: the first one's fullest cell holds CELL_POINTS points or few more."""
    found = [cutoff]
    while len(found) <= RADII:
        cells = [_cell(F.col(c).cast("double"), b, n_cells(b, found[0])) for c, b in zip(AXES, box, strict=True)]
        fullest = points.groupBy(*by, *cells).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if (fullest or 0) <= CELL_POINTS:
            break
        found.insert(0, found[0] / 2)
    return found


def nearest_partner(points: DataFrame, box: Sequence[float], cutoff: float, by: Sequence[str] = (), key: str = "id") -> DataFrame:
    """The nearest other point within cutoff, the lesser id on ties.

    Points that have one within a small radius are done, and only the others look further, so the pairs that are compared
    grow with the points, not with the square of their density.
    """
    use_checkpoints(points.sparkSession)
    left, rounds = points, []
    for radius in radii(points, box, cutoff, by):
        pairs = cell_join(left, points, box, radius, by, key).where("a <> b")
        rounds.append(pairs.groupBy(*by, "a").agg(F.min(F.struct("r2", "b")).alias("least")).checkpoint())
        left = left.join(rounds[-1].select(*by, F.col("a").alias(key)).hint("merge"), [*by, key], "left_anti").checkpoint()
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, rounds).select(*by, "a", F.col("least.b").alias("partner"), F.col("least.r2").alias("r2"))


def without_clashes(sites: DataFrame, others: DataFrame, box: Sequence[float], cutoff: float, key: str = "id") -> DataFrame:
    """Sites with no other point nearer than cutoff. Sites that clash within a small radius are out, and only the others look further."""
    use_checkpoints(sites.sparkSession)
    left = sites
    for radius in radii(others, box, cutoff):
        near = cell_join(left, others, box, radius, (), key).where(F.col("r2") < cutoff * cutoff).select(F.col("a").alias(key)).distinct()
        left = left.join(near.hint("merge"), key, "left_anti").checkpoint()
        if left.isEmpty():
            break
    return left


def first_footprint(points: DataFrame, footprints: DataFrame, order: str, edge: float = 0.0) -> DataFrame:
    """Each point (id, x, y) with the first footprint (order, x0, y0, nx, ny) that holds it, edge pixels off; null if none does.

    Footprints are cut into tiles of the largest footprint's size, so the join is an equi-join on tiles and
    each point meets a handful of footprints.
    """
    size = footprints.agg(F.max("nx").alias("nx"), F.max("ny").alias("ny")).first()
    tx, ty = float(size["nx"] or 1), float(size["ny"] or 1)
    corner = lambda c, d, t: F.explode(F.sequence(F.floor(F.col(c) / t), F.floor((F.col(c) + F.col(d)) / t)))
    tiled = footprints.withColumn("tx", corner("x0", "nx", tx)).withColumn("ty", corner("y0", "ny", ty))
    held = points.withColumn("tx", F.floor(F.col("x") / tx)).withColumn("ty", F.floor(F.col("y") / ty))
    x, y = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    inside = (x > edge) & (x <= F.col("nx") - edge) & (y > edge) & (y <= F.col("ny") - edge)
    found = held.join(tiled, ["tx", "ty"]).where(inside).groupBy("id").agg(F.min(order).alias(order))
    return points.select("id").join(found, "id", "left")


def hydrogen_bonds(atoms: DataFrame, roles: DataFrame, box: Sequence[float], frame: str = "frame", cutoff: float = 0.35, min_angle_cos: float = -0.8660254037844387, least: float = 1e-6) -> DataFrame:
    """(frame, donor, acceptor), once for each pair with a hydrogen in line.

    Donor and acceptor are nearer than cutoff and further than least; a hydrogen is one of the two atoms after the donor,
    further than least from both; the cosine of the angle donor - hydrogen - acceptor is at most that of 150 degrees.
    Acceptors go to the donors near them, which hold the arms to their hydrogens, so atoms are joined by number once, and by cells once.
    An atom has one place in a frame.
    """
    is_a = lambda role: F.max(F.col("role") == role).alias(role)
    marked = atoms.join(roles.groupBy(F.col("atom").alias("id")).agg(*[is_a(r) for r in ("donor", "acceptor", "hydrogen")]), "id")
    at = F.struct(*[F.col(c).cast("double").alias(c) for c in AXES])
    arms = marked.where("hydrogen").select(frame, F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), "id", at.alias("h")).withColumn("id", F.col("id") - F.col("k"))
    ends = arms.groupBy(frame, "id").agg(*[F.max(F.when(F.col("k") == k, F.col("h"))).alias(f"h{k}") for k in (1, 2)])
    donors = marked.where("donor").join(ends, [frame, "id"])
    names = [f"arm{k}_{c}" for k in (1, 2) for c in AXES]
    arm = {f"arm{k}_{c}": minimum_image(F.col(f"h{k}.{c}") - F.col(c).cast("double"), box[i]) for k in (1, 2) for i, c in enumerate(AXES)}
    pairs = cell_join(marked.where("acceptor"), donors.withColumns(arm), box, cutoff, (frame,), carry=names)
    pairs = pairs.where((F.col("r2") < cutoff * cutoff) & (F.col("r2") > least * least) & (F.col("a") != F.col("b")))

    def in_line(k: int) -> Column:
        # from the hydrogen: the donor lies at -arm, the acceptor at d - arm, d being acceptor less donor; no hydrogen there: null
        arm = {c: F.col(f"arm{k}_{c}") for c in AXES}
        to = {c: minimum_image(F.col(f"d{c}") - arm[c], box[i]) for i, c in enumerate(AXES)}
        dot = sum((arm[c] * to[c] for c in AXES), F.lit(0.0))
        near, far = (F.sqrt(sum((v * v for v in x), F.lit(0.0))) for x in (arm.values(), to.values()))
        return F.coalesce((near >= least) & (far >= least) & (-dot <= F.lit(min_angle_cos) * near * far), F.lit(False))

    return pairs.where(in_line(1) | in_line(2)).select(frame, F.col("b").alias("donor"), F.col("a").alias("acceptor"))
