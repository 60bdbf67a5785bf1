"""SQL twins of the domain pipelines: the same fixtures and analyses as text for another engine."""

from __future__ import annotations

import math
from collections.abc import Sequence

from ..functions.scalar import DIRECTIONS, LATTICE_WEIGHTS, OPPOSITE
from ..operators.kernels import lattice as kernel
from ..sources import synthetic
from ..sources.synthetic import double


def with_trajectory(chain: int, waters: int, frames: int, box: float) -> str:
    """CTEs traj, topology, roles, and bonds (frame, donor, acceptor)."""
    made = synthetic.trajectory_text(chain, waters, frames, box)
    image = lambda e: f"(({e}) - {double(box)} * round_even(({e}) / {double(box)}, 0))"
    apart = lambda a, b: [image(f"{a}.{c}::DOUBLE - {b}.{c}::DOUBLE") for c in "xyz"]
    to = [image(f"d{c} + a{c}") for c in "xyz"]
    norm = lambda v: "sqrt(" + " + ".join(f"{x} * {x}" for x in v) + ")"
    return f"""
traj AS MATERIALIZED ({made["traj"]}), topology AS MATERIALIZED ({made["topology"]}), roles AS MATERIALIZED ({made["roles"]}),
far AS (SELECT d.frame, d.atom AS donor, a.atom AS acceptor, {", ".join(f"{x} AS d{c}" for x, c in zip(apart("d", "a"), "xyz", strict=True))}
        FROM traj d JOIN traj a ON a.frame = d.frame AND a.atom <> d.atom
        WHERE d.atom IN (SELECT atom FROM roles WHERE role = 'donor') AND a.atom IN (SELECT atom FROM roles WHERE role = 'acceptor')),
near AS (SELECT * FROM far WHERE dx * dx + dy * dy + dz * dz < 0.35e0 * 0.35e0 AND dx * dx + dy * dy + dz * dz > 1e-12),
arms AS (SELECT d.frame, d.atom AS donor, {", ".join(f"{x} AS a{c}" for x, c in zip(apart("h", "d"), "xyz", strict=True))}
         FROM traj d JOIN traj h ON h.frame = d.frame AND h.atom IN (d.atom + 1, d.atom + 2) WHERE h.atom IN (SELECT atom FROM roles WHERE role = 'hydrogen')),
lines AS (SELECT frame, donor, acceptor, ax, ay, az, {", ".join(f"{x} AS t{c}" for x, c in zip(to, "xyz", strict=True))} FROM near JOIN arms USING (frame, donor)),
bonds AS (SELECT DISTINCT frame, donor, acceptor FROM lines WHERE {norm(["ax", "ay", "az"])} >= 1e-6 AND {norm(["tx", "ty", "tz"])} >= 1e-6
          AND ax * tx + ay * ty + az * tz <= -0.8660254037844387e0 * {norm(["ax", "ay", "az"])} * {norm(["tx", "ty", "tz"])})"""


def with_pairs(box: float, kind: int, cutoff: float, name: str = "pairs") -> str:
    """A CTE (frame, a, b, r2) of pairs of atoms of a type within cutoff, after with_trajectory."""
    d = [f"((a.{c}::DOUBLE - b.{c}::DOUBLE) - {double(box)} * round_even((a.{c}::DOUBLE - b.{c}::DOUBLE) / {double(box)}, 0))" for c in "xyz"]
    r2 = " + ".join(f"{x} * {x}" for x in d)
    only = f"(SELECT traj.* FROM traj JOIN topology USING (atom) WHERE type = {kind})"
    return f"{name} AS (SELECT * FROM (SELECT a.frame, a.atom AS a, b.atom AS b, {r2} AS r2 FROM {only} a JOIN {only} b ON a.frame = b.frame AND a.atom < b.atom) WHERE r2 <= {double(cutoff * cutoff)})"


def distribution(box: float, waters: int, frames: int, r_max: float = 1.2, bins: int = 240) -> str:
    """CTEs up to gr (bin, r, hist, g), after with_trajectory."""
    step = r_max / bins
    edges = f"edges AS (SELECT range AS bin, range * {double(step)} AS low, CASE WHEN range = {bins - 1} THEN {double(r_max)} ELSE (range + 1) * {double(step)} END AS high FROM range({bins}))"
    hist = f"hist AS (SELECT e.bin, count(r2) AS n FROM edges e LEFT JOIN pairs ON sqrt(r2) >= low AND (sqrt(r2) < high OR (e.bin = {bins - 1} AND sqrt(r2) <= high)) GROUP BY e.bin)"
    low, high = f"(bin * {double(step)})", f"((bin + 1) * {double(step)})"
    ideal = f"({double(4.0 / 3.0 * math.pi)} * ({high} * {high} * {high} - {low} * {low} * {low}) * ({waters} * ({waters} - 1) / 2.0) / {double(box**3)} * {frames})"
    return f"{with_pairs(box, 1, r_max)}, {edges}, {hist}, gr AS (SELECT bin, (bin + 0.5) * {double(step)} AS r, n AS hist, n / {ideal} AS g FROM hist)"


def contacts(box: float, cutoff: float = 0.8) -> str:
    """CTEs up to q (frame, q), after with_trajectory."""
    return f"""{with_pairs(box, 0, cutoff, "folded")}, kept AS (SELECT * FROM folded WHERE r2 < {double(cutoff * cutoff)}),
q AS (SELECT f.frame, count(n.a) / greatest((SELECT count(*) FROM kept WHERE frame = 0), 1)::DOUBLE AS q
      FROM (SELECT DISTINCT frame FROM traj) f LEFT JOIN kept k ON k.frame = f.frame LEFT JOIN (SELECT a, b FROM kept WHERE frame = 0) n ON n.a = k.a AND n.b = k.b GROUP BY f.frame)"""


def box_search(stars: int, points: int, periods: int, detrend: bool = True, curves: str = "SELECT * FROM made") -> str:
    """CTEs from made, the generated curves, and curves, a query on them, up to spectrum (star_id, period, power, depth), the best block of each trial period."""
    flat = "flux / quantile_cont(flux, 0.5) OVER (PARTITION BY star_id ORDER BY t RANGE BETWEEN 0.25 PRECEDING AND 0.25 FOLLOWING)" if detrend else "flux"
    step = (1.0 / 12.0 - 2.0) / (periods - 1)
    return f"""
made AS MATERIALIZED ({synthetic.light_curves_text(stars, points)}), curves AS MATERIALIZED ({curves}), flat AS (SELECT star_id, t, {flat} AS y, 1 / (flux_err * flux_err) AS v FROM curves),
sums AS (SELECT star_id, sum(v) AS v, sum(v * y) / sum(v) AS mean FROM flat GROUP BY star_id),
w AS MATERIALIZED (SELECT star_id, t, f.v / s.v AS w, f.v / s.v * (y - mean) AS x FROM flat f JOIN sums s USING (star_id)),
trials AS (SELECT range AS k, 1 / (range * {double(step)} + 2e0) AS period FROM range({periods})),
found AS (SELECT star_id, k, least(floor(((t / period) % 1e0) * 200)::INT, 199) AS bin, sum(x) AS s, sum(w) AS r FROM w CROSS JOIN trials GROUP BY 1, 2, 3),
filled AS (SELECT a.star_id, a.k, a.bin, coalesce(f.s, 0e0) AS s, coalesce(f.r, 0e0) AS r
           FROM (SELECT star_id, k, range::INT AS bin FROM (SELECT DISTINCT star_id FROM w) CROSS JOIN trials CROSS JOIN range(224)) a
           LEFT JOIN found f ON f.star_id = a.star_id AND f.k = a.k AND f.bin = a.bin % 200),
upto AS MATERIALIZED (SELECT star_id, k, bin, sum(s) OVER u AS s, sum(r) OVER u AS r FROM filled WINDOW u AS (PARTITION BY star_id, k ORDER BY bin)),
blocks AS (SELECT e.star_id, e.k, e.s - coalesce(b.s, 0e0) AS s, e.r - coalesce(b.r, 0e0) AS r
           FROM (SELECT star_id, k, bin, width.range AS width, s, r FROM upto CROSS JOIN range(2, 25) width WHERE bin - width.range + 1 BETWEEN 0 AND 199) e
           LEFT JOIN upto b ON b.star_id = e.star_id AND b.k = e.k AND b.bin = e.bin - e.width),
spectrum AS MATERIALIZED (SELECT star_id, period, max(s * s / (r * (1 - r))) AS power, arg_max(-s / (r * (1 - r)), s * s / (r * (1 - r))) AS depth
             FROM blocks JOIN trials USING (k) WHERE r > 1e-15 AND r < 1 - 1e-15 GROUP BY star_id, period)"""


SEARCH = """
mid AS (SELECT star_id, median(power) AS m FROM spectrum GROUP BY star_id), mad AS (SELECT star_id, median(abs(power - m)) AS mad FROM spectrum JOIN mid USING (star_id) GROUP BY star_id),
best AS (SELECT star_id, arg_max(period, power) AS period, arg_max(depth, power) AS depth, (max(power) - any_value(m)) / (1.4826 * any_value(mad)) AS sde
         FROM spectrum JOIN mid USING (star_id) JOIN mad USING (star_id) GROUP BY star_id)"""


def lattice_steps(case: str, nx: int, ny: int, steps: int, reynolds: float, u0: float = 0.05) -> str:
    """The lattice after some steps, a few CTEs a step."""
    omega = kernel.relaxation(kernel.masks(case, max(nx, 10), ny)[2], reynolds, u0)
    edge = f"y = 0 OR y = {ny - 1}"
    if case == "cylinder":
        r = max(3, ny // 9)
        solid, lid, driven = f"((x - {nx // 5}) * (x - {nx // 5}) + (y - {ny // 2}) * (y - {ny // 2}) < {r * r} OR {edge})", "false", "x = 0"
        start = f"{double(u0)} * (1 + 1e-4 * sin({double(2 * math.pi)} * y / {ny - 1}))"
    else:
        solid, lid, driven, start = f"(x = 0 OR x = {nx - 1} OR {edge})", f"y = {ny - 1}", f"y = {ny - 1}", "0e0"
    f = [f"f{i}" for i in range(9)]

    def feq(rho: str, ux: str, uy: str) -> list[str]:
        cu = [f"(3e0 * ({ux} * {cx} + {uy} * {cy}))" for cx, cy in DIRECTIONS]
        return [f"{double(w)} * {rho} * (1e0 + {c} + 0.5e0 * {c} * {c} - 1.5e0 * ({ux} * {ux} + {uy} * {uy}))" for c, w in zip(cu, LATTICE_WEIGHTS, strict=True)]

    along = lambda k: " + ".join(f"f{i} * {c[k]}" for i, c in enumerate(DIRECTIONS) if c[k])
    parts = [
        f"g AS (SELECT i.range AS x, j.range AS y FROM range({nx}) i CROSS JOIN range({ny}) j)",
        f"s AS (SELECT x, y, CASE WHEN {solid} THEN 0e0 ELSE {start} END AS ux, 0e0 AS uy FROM g)",
        "c0 AS (SELECT x, y, " + ", ".join(f"{e} AS {n}" for e, n in zip(feq("1e0", "ux", "uy"), f, strict=True)) + " FROM s)",
    ]
    for k in range(steps):
        parts.append(f"a{k} AS (SELECT *, {' + '.join(f)} AS rho, ({solid}) AND NOT ({lid}) AS bounce, {driven} AS driven FROM c{k})")
        parts.append(
            f"b{k} AS (SELECT x, y, {', '.join(f)}, bounce, driven, CASE WHEN driven THEN 1e0 ELSE rho END AS rho, CASE WHEN bounce THEN 0e0 WHEN driven THEN {double(u0)} ELSE ({along(0)}) / rho END AS ux, "
            f"CASE WHEN bounce OR driven THEN 0e0 ELSE ({along(1)}) / rho END AS uy FROM a{k})"
        )
        parts.append(f"e{k} AS (SELECT *, {', '.join(f'{e} AS e{i}' for i, e in enumerate(feq('rho', 'ux', 'uy')))} FROM b{k})")
        parts.append(f"d{k} AS MATERIALIZED (SELECT x, y, bounce, {', '.join(f'CASE WHEN driven THEN e{i} ELSE f{i} END AS f{i}, e{i}' for i in range(9))} FROM e{k})")
        sent = []
        for i, (cx, cy) in enumerate(DIRECTIONS):
            value = f"CASE WHEN bounce THEN f{OPPOSITE[i]} ELSE f{i} - {double(omega)} * (f{i} - e{i}) END"
            x, y = f"(x + {cx} + {nx}) % {nx}", f"(y + {cy} + {ny}) % {ny}"
            out = case == "cylinder" and i in kernel.OUTFLOW
            sent.append(f"SELECT {x} AS x, {y} AS y, {i} AS i, {value} AS v FROM d{k}" + (f" WHERE {x} <> {nx - 1}" if out else ""))
            if out:
                sent.append(f"SELECT {nx - 1} AS x, {y} AS y, {i} AS i, {value} AS v FROM d{k} WHERE {x} = {nx - 2}")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT x, y, {', '.join(f'max(CASE WHEN i = {i} THEN v END) AS f{i}' for i in range(9))} FROM ({' UNION ALL '.join(sent)}) GROUP BY x, y)")
    rho = " + ".join(f)
    last = f"SELECT x, y, {solid} AS solid, {rho} AS rho, ({along(0)}) / ({rho}) AS ux, ({along(1)}) / ({rho}) AS uy FROM c{steps}"
    wall = lambda c: f"round(CASE WHEN solid THEN 0e0 ELSE {c} END, 9) + 0e0 AS {c}"
    return f"WITH {', '.join(parts)} SELECT x, y, {wall('ux')}, {wall('uy')}, round(rho, 9) AS rho, solid FROM ({last})"


def local_alignment(pairs: str, keys: Sequence[str]) -> str:
    """(keys..., score, query_end, target_end) of pairs (keys..., q, t): a row of the matrix a step of the recursion."""
    held = ", ".join(keys)
    return f"""
WITH RECURSIVE p AS ({pairs}),
r AS (SELECT {held}, q, t, 0 AS i, list_transform(range(length(t) + 1), lambda k: 0) AS h, list_transform(range(length(t)), lambda k: 0) AS e, 0 AS score, 0 AS qe, 0 AS te FROM p
  UNION ALL
  SELECT {held}, q, t, i + 1, list_concat([0], h2), e2, greatest(score, list_max(h2)), CASE WHEN list_max(h2) > score THEN i + 1 ELSE qe END, CASE WHEN list_max(h2) > score THEN list_position(h2, list_max(h2)) ELSE te END
  FROM (SELECT *, list_transform(range(1, length(t) + 1), lambda j: greatest(h1[j], coalesce(list_max(list_transform(range(1, j), lambda k: h1[k] - 4 - (j - 1 - k))), 0))) AS h2
    FROM (SELECT *, list_transform(range(1, length(t) + 1), lambda j: greatest(h[j] + CASE WHEN substr(t, j::INT, 1) = substr(q, i + 1, 1) THEN 2 ELSE -1 END, e2[j])) AS h1
      FROM (SELECT *, list_transform(range(1, length(t) + 1), lambda j: greatest(e[j] - 1, h[j + 1] - 4, 0)) AS e2 FROM r WHERE i < length(q)))))
SELECT {held}, score::INT AS score, qe::INT AS query_end, te::INT AS target_end FROM r WHERE i = length(q)
"""
