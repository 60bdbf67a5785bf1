"""Reproducible shuffle into shards: a Feistel permutation of global row numbers, walked back into range."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import numbered, table

ROUNDS = 6


def digest(*values: Column | int) -> Column:
    """60 bits of the MD5 of the values' text, as a long: a hash that any engine has."""
    text = F.concat_ws(":", *[F.coalesce(v.cast("string"), F.lit("")) if isinstance(v, Column) else F.lit(str(v)) for v in values])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _scramble(left: Column, right: Column, a: Column, b: Column, seed: int, step: Callable[[Column, str], Column]) -> tuple[Column, Column]:
    """ROUNDS rounds over Z_a x Z_b. Each adds a hash of one half to the other, so each is a bijection."""
    for i in range(ROUNDS):
        if i % 2 == 0:
            left = step(F.pmod(left + F.pmod(digest(seed, i, right), a), a), f"l{i}")
        else:
            right = step(F.pmod(right + F.pmod(digest(seed, i, left), b), b), f"r{i}")
    return left, right


def permuted(df: DataFrame, row: str, total: str, out: str, seed: int = 0) -> DataFrame:
    """Add out, a permutation of [0, total) applied to the row number in column row.

    The domain is a x b with a = ceil(sqrt(total)) and b = ceil(total / a), so that less than
    a values lie outside [0, total). Such a value is permuted again until it falls inside
    (cycle walking): two walks are generated code, and the one row in `total` or so that needs
    more goes on in a bounded loop; a cycle holds at most a outside values, so it always ends.
    """
    held = df.columns
    a = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col(total).cast("double")))).cast("long")
    df = df.withColumn("__a", a)
    df = df.withColumn("__b", F.greatest(F.lit(1), F.ceil(F.col(total).cast("double") / F.col("__a"))).cast("long"))
    a, b, n = F.col("__a"), F.col("__b"), F.col(total)
    df = df.withColumn("__x", F.col(row).cast("long"))
    for walk in range(2):
        started = F.col("__x")

        def step(value: Column, name: str, walk: int = walk) -> Column:
            nonlocal df
            df = df.withColumn(f"__{walk}{name}", value)
            return F.col(f"__{walk}{name}")

        left, right = _scramble(step(F.expr("__x div __b"), "l"), step(F.pmod(started, b), "r"), a, b, seed, step)
        again = left * b + right
        df = df.withColumn("__x", again if not walk else F.when(started < n, started).otherwise(again))

    def further(x: Column, _: Column) -> Column:
        left, right = _scramble(F.floor(x / b).cast("long"), F.pmod(x, b), a, b, seed, lambda value, name: value)
        return F.when(x < n, x).otherwise(left * b + right)

    walked = F.when(F.col("__x") < n, F.col("__x")).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), a), F.col("__x"), further))
    return df.withColumn(out, walked).select(*held, out)


def assign_shards(docs: DataFrame, shards: int, seed: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """Give every row a shard and a slot by the law `rows`: shard sizes differ by one row at most.

    A row's global number is its place in the order (hash, doc_id, CRC, size): rows are sorted by ranges of it and
    written, and the ranges' counts, one each, give the offsets. Equal rows are dealt to ranges like any others, so a third
    of all rows may be equal. The order depends on the rows alone, not on files or partitions, so the shuffle is
    reproducible. The permuted number p gives shard p mod shards and slot p div shards, with no look-up table.

    Only the id, the CRC and the size are shuffled, and the columns named in carry.
    Null text counts as empty; a null doc_id is a value like any other; equal rows get a slot each;
    an empty table gives no rows; other columns, whatever their names, don't matter.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.col(c).alias(f"__carry_{c}") for c in carry],
    )
    order = [digest(F.col("doc_id"), F.col("text_crc32"), F.col("size")), "doc_id", "text_crc32", "size"]
    rows = numbered(slim, order, "__row", "__total", "shard-order")
    placed = permuted(rows, "__row", "__total", "__at", seed)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("__at", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"__at div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"__carry_{c}").alias(c) for c in carry],
    )


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """Write the shards as files shard=k, rows in slot order; each shard is dealt to tasks by runs of slots."""
    placed = assign_shards(docs, shards, seed, carry=("text",)).drop("law", "grown_shard")
    chunk = F.expr("slot div 1000000")
    placed.repartition("shard", chunk).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 40)


_MD5 = "('0x' || substr(md5({}), 1, 15))::BIGINT"


def _round_sql(x: str, source: str, seed: int) -> str:
    """source with x permuted once."""
    query = f"SELECT * EXCLUDE ({x}), {x} // b AS l, {x} % b AS r FROM {source}"
    for i in range(ROUNDS):
        one, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        h = _MD5.format(f"'{seed}:{i}:' || {other}")
        query = f"SELECT * REPLACE (({one} + {h} % {size}) % {size} AS {one}) FROM ({query})"
    return f"SELECT * EXCLUDE (l, r), l * b + r AS {x} FROM ({query})"


def shards_sql(shards: int, seed: int = 0) -> str:
    """SQL of assign_shards(documents, shards, seed); CRC-32 by its table of 256 words."""
    return f"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT range::BIGINT AS i FROM range(256)))),
digits AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS c FROM documents),
bytes AS (SELECT doc_id, size, list_transform(range(1, len(c) // 2 + 1), lambda i: ((instr('0123456789ABCDEF', c[2 * i - 1]) - 1) * 16 + instr('0123456789ABCDEF', c[2 * i]) - 1)::BIGINT) AS bytes FROM digits),
docs AS MATERIALIZED (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes CROSS JOIN tab),
total AS (SELECT n, a, greatest(1, ceil(n / a))::BIGINT AS b FROM (SELECT count(*) AS n, greatest(1, ceil(sqrt(count(*))))::BIGINT AS a FROM docs)),
rows AS MATERIALIZED (SELECT docs.*, n, a, b, row_number() OVER (ORDER BY {_MD5.format("coalesce(doc_id::VARCHAR, '') || ':' || text_crc32 || ':' || size")}, doc_id NULLS FIRST, text_crc32, size) - 1 AS p FROM docs CROSS JOIN total),
walk AS ({_round_sql("p", "rows", seed)} UNION ALL {_round_sql("p", "(SELECT * FROM walk WHERE p >= n)", seed)})
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {shards})::INTEGER AS shard, p // {shards} AS slot, NULL::INTEGER AS grown_shard FROM walk WHERE p < n
"""


OP5_SQL = shards_sql(40)
