"""Element-wise maps as Column -> Column builders; all are generated code, none is a UDF (survey P01-P46, X01-X11)."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- arithmetic and activation


def scale(x: Column, factor: float) -> Column:
    return x * F.lit(factor)


def shift(x: Column, by: float) -> Column:
    return x + F.lit(by)


def exp_plus_sin(x: Column) -> Column:
    return F.exp(x) + F.sin(x)


def wave(x: Column) -> Column:
    """sin(x) cos(x^2) + exp(-x^2)."""
    return F.sin(x) * F.cos(x * x) + F.exp(-(x * x))


def damped_sine(x: Column) -> Column:
    return F.sin(x) * F.exp(-(x * x))


def square_above(x: Column, threshold: float) -> Column:
    """x^2 where x exceeds the threshold, else 0."""
    return F.when(x > threshold, x * x).otherwise(F.lit(0.0))


def squared_error(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


def hypotenuse(x: Column, y: Column) -> Column:
    return F.hypot(x, y)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def axpy(x: Column, y: Column, a: float = 2.0) -> Column:
    return x * a + y


def root_square_plus_one(x: Column) -> Column:
    return F.sqrt(x * x + 1.0)


def sine_squared(x: Column) -> Column:
    return F.sin(x) * F.sin(x)


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Horner's rule, highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def polynomial_derivative(coefficients: Sequence[float]) -> list[float]:
    """Coefficients of the derivative: exact differentiation, the plan-time form of grad."""
    n = len(coefficients) - 1
    return [c * (n - i) for i, c in enumerate(coefficients[:-1])] or [0.0]


def central_difference(f: Callable[[Column], Column], x: Column, h: float = 1e-6) -> Column:
    return (f(x + h) - f(x - h)) / (2 * h)


def fused_chain(x: Column) -> Column:
    """tan(x^x) + sqrt(x^x) + acos of the product of sine, cosine and exp(-x); NaN outside the domains, as in IEEE arithmetic."""
    p = F.pow(x, x)
    return F.tan(p) + F.sqrt(p) + F.acos(F.sin(x) * F.cos(x) * F.exp(-x))


# ---- distances


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def array_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


# ---- rounding, clipping, folding


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def positive_part(x: Column, above: float) -> Column:
    return F.greatest(x - F.lit(above), F.lit(0.0))


def minimum_image(d: Column, box: float) -> Column:
    """A difference in a periodic box: d - box * rint(d / box), halves to even."""
    return d - F.lit(box) * F.rint(d / F.lit(box))


def phase_bin(t: Column, period: Column | float, bins: int) -> Column:
    """int((t / period mod 1) * bins), kept inside [0, bins - 1]; the remainder is that of floored division."""
    period = F.lit(period) if isinstance(period, (int, float)) else period
    return F.least(F.greatest((F.pmod(t / period, F.lit(1.0)) * bins).cast("int"), F.lit(0)), F.lit(bins - 1))


def decade(age: Column) -> Column:
    return (F.floor(age / 10) * 10).cast("long")


def majority(mean_vote: Column) -> Column:
    """The rounded mean of 0/1 votes, halves to even."""
    return F.rint(mean_vote).cast("int")


def allclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))


def nan_to_zero(x: Column) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


# ---- coordinates, calendars, indexes


def unit_sphere(ra_deg: Column, dec_deg: Column) -> tuple[Column, Column, Column]:
    ra, dec = F.radians(ra_deg), F.radians(dec_deg)
    return F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec)


def day_of_year(day: Column) -> Column:
    return (day % 365).cast("int")


def year_of(day: Column) -> Column:
    return F.floor(day / 365).cast("int")


def flat_index(i: Column, j: Column, n_columns: int) -> Column:
    return i.cast("long") * n_columns + j


def unflatten(k: Column, n_columns: int) -> tuple[Column, Column]:
    return F.floor(k / n_columns).cast("long"), F.pmod(k, F.lit(n_columns)).cast("long")


def update_at(values: Column, index: int, value: Column) -> Column:
    """A copy of the array with one element replaced."""
    return F.transform(values, lambda x, i: F.when(i == index, value).otherwise(x))


def add_at(values: Column, index: int, value: Column) -> Column:
    return F.transform(values, lambda x, i: F.when(i == index, x + value).otherwise(x))


def is_prime(n: Column) -> Column:
    """Trial division up to the square root."""
    divisors = F.sequence(F.lit(2).cast("long"), F.greatest(F.lit(2).cast("long"), F.floor(F.sqrt(n.cast("double"))).cast("long")))
    return (n > 1) & ((n < 4) | ~F.exists(divisors, lambda d: n % d == 0))


def escape_step(cx: Column, cy: Column, limit: int) -> Column:
    """Mandelbrot: the last iteration before |z| exceeds 2, limit - 1 if it never does within the limit."""
    zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"), F.lit(0).alias("n"), F.lit(False).alias("out"))

    def step(z: Column, i: Column) -> Column:
        re, im = z["re"] * z["re"] - z["im"] * z["im"] + cx, z["re"] * z["im"] * 2.0 + cy
        out = re * re + im * im > 4.0
        return F.when(z["out"], z).otherwise(F.struct(re.alias("re"), im.alias("im"), i.alias("n"), out.alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(limit - 1)), zero, step)["n"]


# ---- detector names and headers

QUADRANTS = "EFGH"


def ccd_name(k: Column) -> Column:
    """0..35 as row-column, both from 1."""
    bad = F.raise_error(F.concat(F.lit("no such detector: "), k.cast("string"))).cast("string")
    return F.when((k >= 0) & (k < 36), F.concat((F.floor(k / 6) + 1).cast("string"), F.lit("-"), (k % 6 + 1).cast("string"))).otherwise(bad)


def quadrant_name(k: Column) -> Column:
    """0..143 as row-column.quadrant."""
    return F.concat(ccd_name(F.floor(k / 4).cast("int")), F.lit("."), F.substring(F.lit(QUADRANTS), (k % 4 + 1).cast("int"), F.lit(1)))


def detector_number(name: Column) -> Column:
    """The inverse of quadrant_name, and of ccd_name where there is no quadrant; null for other names."""
    row, column, quadrant = (F.regexp_extract(name, r"^([1-6])-([1-6])(?:\.([EFGH]))?$", i) for i in (1, 2, 3))
    ccd = (row.cast("int") - 1) * 6 + column.cast("int") - 1
    return F.when(row == "", None).when(quadrant == "", ccd).otherwise(ccd * 4 + F.instr(F.lit(QUADRANTS), quadrant) - 1)


def header_name(header: Column) -> Column:
    """CCDID.QUADID, or CCDID alone where there is no quadrant."""
    return F.concat_ws(".", F.try_element_at(header, F.lit("CCDID")), F.try_element_at(header, F.lit("QUADID")))


def padded_header(header: Column, width: int = 8) -> Column:
    return F.transform_values(header, lambda k, v: F.when(F.length(v) < width, F.rpad(v, width, " ")).otherwise(v))


# ---- random numbers that do not depend on partitions

#: A prime, whose residues are squared, and what is added.
MODULUS, FACTOR, ADDED = 2147483647, 48271, (40692, 69621)


def uniform(seed: int, *keys: Column) -> Column:
    """In (0, 1), from integer keys by integer arithmetic alone: the same row gives the same number anywhere, in SQL too (uniform_sql)."""
    h = F.lit(seed).cast("long")
    for key in keys:
        h = (h * FACTOR + F.pmod(key.cast("long"), F.lit(MODULUS)) * 16807 + 11) % MODULUS
    for add in ADDED:
        h = (h * h + add) % MODULUS
    return (h + 1).cast("double") / F.lit(float(MODULUS + 2))


def uniform_sql(seed: int, *keys: str) -> str:
    """uniform() of expressions that are not negative, as text for any SQL."""
    h = f"CAST({seed} AS BIGINT)"
    for key in keys:
        h = f"(({h} * {FACTOR} + CAST({key} AS BIGINT) % {MODULUS} * 16807 + 11) % {MODULUS})"
    for add in ADDED:
        h = f"(({h} * {h} + {add}) % {MODULUS})"
    return f"(CAST({h} + 1 AS DOUBLE) / CAST({MODULUS + 2} AS DOUBLE))"


def with_uniforms_sql(source: str, draws: Mapping[str, tuple[int, Sequence[str]]]) -> str:
    """source, a query, with a column of uniform(seed, *keys) for each draw; in steps, so that no expression grows large."""
    first = []
    for name, (seed, keys) in draws.items():
        h = f"CAST({seed} AS BIGINT)"
        for key in keys:
            h = f"(({h} * {FACTOR} + CAST({key} AS BIGINT) % {MODULUS} * 16807 + 11) % {MODULUS})"
        first.append(f"{h} AS {name}_0")
    query = f"SELECT *, {', '.join(first)} FROM ({source}) AS d0"
    for i, add in enumerate(ADDED):
        query = f"SELECT *, {', '.join(f'({n}_{i} * {n}_{i} + {add}) % {MODULUS} AS {n}_{i + 1}' for n in draws)} FROM ({query}) AS d{i + 1}"
    return f"SELECT *, {', '.join(f'CAST({n}_{len(ADDED)} + 1 AS DOUBLE) / CAST({MODULUS + 2} AS DOUBLE) AS {n}' for n in draws)} FROM ({query}) AS d9"


def standard_normal_sql(seed: int, *keys: str) -> str:
    u, v = uniform_sql(seed, *keys), uniform_sql(seed + 1, *keys)
    return f"(sqrt(CAST(-2.0 AS DOUBLE) * ln(CAST(1.0 AS DOUBLE) - {u})) * cos(CAST({2 * math.pi!r} AS DOUBLE) * {v}))"


def standard_normal(seed: int, *keys: Column) -> Column:
    u, v = uniform(seed, *keys), uniform(seed + 1, *keys)
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)


# ---- lattice directions

#: The nine directions of the D2Q9 lattice, their weights and opposites.
DIRECTIONS = ((0, 0), (1, 0), (0, 1), (-1, 0), (0, -1), (1, 1), (-1, 1), (-1, -1), (1, -1))
LATTICE_WEIGHTS = (4 / 9, 1 / 9, 1 / 9, 1 / 9, 1 / 9, 1 / 36, 1 / 36, 1 / 36, 1 / 36)
OPPOSITE = (0, 3, 4, 1, 2, 7, 8, 5, 6)


def equilibrium(rho: Column, ux: Column, uy: Column) -> list[Column]:
    """w rho (1 + cu + cu^2 / 2 - 3 u^2 / 2) for each direction, cu = 3 c.u."""
    out = []
    for (cx, cy), w in zip(DIRECTIONS, LATTICE_WEIGHTS, strict=True):
        cu = F.lit(3.0) * (ux * float(cx) + uy * float(cy))
        out.append(F.lit(w) * rho * (F.lit(1.0) + cu + F.lit(0.5) * cu * cu - F.lit(1.5) * (ux * ux + uy * uy)))
    return out


def moments(f: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Density and velocity of nine populations."""
    rho = sum(f[1:], f[0])
    ux = sum((f[i] * float(c[0]) for i, c in enumerate(DIRECTIONS) if c[0]), F.lit(0.0)) / rho
    uy = sum((f[i] * float(c[1]) for i, c in enumerate(DIRECTIONS) if c[1]), F.lit(0.0)) / rho
    return rho, ux, uy
