"""Writers in the formats of the readers, and drawings (survey K01-K11); array files are in gridfiles and hdf5."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def formatted_csv(df: DataFrame, path: str, formats: dict[str, str], sep: str = ",") -> None:
    """Columns with a printf format are written as it says."""
    df.select(*[F.format_string(formats[c], F.col(c)).alias(c) if c in formats else F.col(c) for c in df.columns]).write.option("header", True).option("sep", sep).csv(path)


def bls_csv(found: DataFrame, path: str) -> None:
    formatted_csv(found, path, {"period": "%.10f", "t0": "%.10f", "duration": "%.10f", "depth": "%.10e", "sde": "%.6f"})


def tsv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("sep", "\t").csv(path)


def fasta(sequences: DataFrame, path: str, width: int = 80) -> None:
    """(name, seq) with lines of so many letters."""
    body = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    sequences.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), body)).write.text(path)


def arrays(df: DataFrame, path: str, by: tuple[str, ...] = (), order: tuple[str, ...] = (), codec: str = "zstd") -> None:
    """Chunked, compressed columns: files by `by`, rows within them in order, so that readers skip row groups."""
    (df.sortWithinPartitions(*order) if order else df).write.partitionBy(*by).option("compression", codec).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def json_lines(df: DataFrame, path: str, fresh: bool = False) -> None:
    """Append rows as JSON lines; fresh deletes what was there."""
    df.write.mode("overwrite" if fresh else "append").json(path)


def batch_plan(batches: DataFrame, path: str) -> None:
    """(batch, position, idx) as one JSON line a batch, its indexes in order."""
    kept = F.array_sort(F.collect_list(F.struct("position", "idx")))
    batches.groupBy("batch").agg(F.transform(kept, lambda x: x["idx"]).alias("idx")).write.json(path)


def with_metrics(df: DataFrame, path: str, **metrics) -> dict:  # noqa: ANN003
    """Write df as Parquet and return the metrics, counted on the way; they are also JSON in the folder's name.json neighbour."""
    seen = Observation("metrics")
    df.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.parquet(path)
    found = seen.get
    df.sparkSession.createDataFrame([(json.dumps(found, default=str),)], "value string").coalesce(1).write.text(f"{path}.metrics")
    return found


#: Pixels of a drawing and its margin.
WIDTH, HEIGHT, MARGIN = 640, 400, 40


def plot(df: DataFrame, path: str, x: str, y: str, series: str | None = None, bins: int = 200) -> None:
    """Lines of the mean of y by x as an SVG file, one for each series (at most 20).

    x is cut into `bins` even bins where the rows are, so a drawing needs that many points a line, however many rows there are.
    """
    by = F.col(series).cast("string") if series else F.lit("")
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), by.alias("s")).where("x is not null and y is not null")
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    if low is None:
        low = high = 0.0
    at = F.least(F.floor((F.col("x") - low) / max(high - low, 1e-300) * bins), F.lit(bins - 1))
    names = [r["s"] for r in rows.select("s").distinct().orderBy("s").limit(21).collect()]
    if len(names) > 20:
        raise ValueError("more than 20 series")
    points = rows.groupBy("s", at.alias("b")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).orderBy("s", "x").collect()
    bottom, top = min((p["y"] for p in points), default=0.0), max((p["y"] for p in points), default=0.0)
    px = lambda v: MARGIN + (v - low) / max(high - low, 1e-300) * (WIDTH - 2 * MARGIN)
    py = lambda v: HEIGHT - MARGIN - (v - bottom) / max(top - bottom, 1e-300) * (HEIGHT - 2 * MARGIN)
    text = lambda a, b, t: f'<text x="{a:.0f}" y="{b:.0f}" font-size="12">{html.escape(str(t))}</text>'
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}">', f'<rect x="{MARGIN}" y="{MARGIN}" width="{WIDTH - 2 * MARGIN}" height="{HEIGHT - 2 * MARGIN}" fill="none" stroke="grey"/>']
    for k, name in enumerate(names):
        line = " ".join(f"{px(p['x']):.1f},{py(p['y']):.1f}" for p in points if p["s"] == name)
        colour = f"hsl({k * 137 % 360},60%,40%)"
        parts.append(f'<polyline points="{line}" fill="none" stroke="{colour}"/>')
        parts.append(f'<g fill="{colour}">{text(WIDTH - MARGIN + 2, MARGIN + 14 * (k + 1), name)}</g>')
    parts += [text(MARGIN, HEIGHT - 20, f"{low:g}"), text(WIDTH - MARGIN - 40, HEIGHT - 20, f"{high:g}"), text(2, HEIGHT - MARGIN, f"{bottom:g}"), text(2, MARGIN, f"{top:g}"), text(WIDTH / 2, HEIGHT - 6, x), text(2, 20, y), "</svg>"]
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(parts))
