"""Sharding by a Feistel permutation of global row numbers (native: DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Fixed values of the round function: 31-bit multipliers that fit a signed 64-bit product.
M1, M2, MASK = 1_640_531_527, 1_540_483_477, 2**31 - 1
ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """Keys by a linear congruential rule, the same for any engine."""
    out, x = [], seed
    for _ in range(rounds):
        x = (x * 1_103_515_245 + 12_345) & MASK
        out.append(x)
    return out


def domain(rows: int) -> tuple[int, int]:
    """Sides a * b >= rows of the smallest near-square grid."""
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def _scramble(x: Column, key: Column) -> Column:
    low = (x % F.lit(MASK + 1) * F.lit(M1) + F.shiftright(x, 31) * F.lit(97) + key).bitwiseAND(F.lit(MASK))
    y = low.bitwiseXOR(F.shiftright(low, 15))
    z = (y * F.lit(M2)).bitwiseAND(F.lit(MASK))
    return z.bitwiseXOR(F.shiftright(z, 13))


def feistel(x: Column, a: int, b: int, keys: list[int]) -> Column:
    """A permutation of 0 .. a*b-1: left in [0, a), right in [0, b), changed in turn by modular addition."""
    rounds = F.array(*[F.struct(F.lit(i % 2).alias("odd"), F.lit(k).cast("long").alias("k")) for i, k in enumerate(keys)])
    start = F.struct(((x - x % F.lit(b)) / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).alias("r"))

    def step(s: Column, k: Column) -> Column:
        left = F.when(k["odd"] == 0, (s["l"] + _scramble(s["r"], k["k"])) % F.lit(a)).otherwise(s["l"])
        right = F.when(k["odd"] == 1, (s["r"] + _scramble(s["l"], k["k"])) % F.lit(b)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(rounds, start, step, lambda s: s["l"] * F.lit(b) + s["r"])


def number_rows(df: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """df with _n, the rank of each row in the given total order from 0, and the number of rows.

    One range-partitioned sort; ranks inside a partition come from the sorted stream and are moved by
    the sizes of the partitions before it. Only one count per partition is gathered.
    """
    placed = df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = scratch.write(placed.withColumn("_p", F.shiftright("_m", 33)), "sorted")
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_c")).orderBy("_p").collect()
    at, first = 0, []
    for row in sizes:
        first.append((row["_p"], at))
        at += row["_c"]
    offsets = df.sparkSession.createDataFrame(first, "_q long, _o long")
    numbered = placed.join(offsets, F.col("_p") == F.col("_q"))  # a row per partition of the sort
    local = F.col("_m").bitwiseAND(F.lit(2**33 - 1))
    return numbered.withColumn("_n", local + F.col("_o")).drop("_m", "_p", "_q", "_o"), at


def shard(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard of every row; the text itself never moves.

    Rows are numbered in the order of (id, crc, size), the number goes through a keyed permutation of
    0 .. rows-1 (Feistel rounds on the smallest grid that holds all rows; a number that leaves the range
    goes through again until it is back), and its image p is both places: shard p % shards, slot
    p // shards. So shard sizes differ by one row at most, slots have no gap, and `place` finds any row's
    shard and slot from its number alone. The law is "rows"; grown_shard is null.

    Null text has size 1 and crc32 0; a null id sorts first. Rows equal in id, size and crc are told apart
    by their order only, which does not change the result as a set. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    rows, total = number_rows(slim, ["_id", "text_crc32", "size"], scratch)
    placed = place(rows, total, seed, scratch)
    return placed.select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_x") % shards).cast("int").alias("shard"),
        ((F.col("_x") - F.col("_x") % shards) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def place(rows: DataFrame, total: int, seed: int, scratch: Scratch, steps: int = 3) -> DataFrame:
    """rows with _x, the permuted place of row number _n among total rows."""
    a, b = domain(total)
    keys = round_keys(seed)
    once = lambda c: feistel(c, a, b, keys)
    again = lambda df: df.withColumn("_x", F.when(F.col("_x") >= total, once(F.col("_x"))).otherwise(F.col("_x")))
    out = rows.withColumn("_x", once(F.col("_n")))
    for _ in range(steps):
        out = again(out)
    out = scratch.write(out, "placed")
    while total and not out.filter(F.col("_x") >= total).isEmpty():  # a walk ends after a*b - total steps at most
        for _ in range(steps):
            out = again(out)
        out = scratch.write(out, "placed")
    return out


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same permutation as chained selects; the walk is a recursion over numbers still out of range."""
    f = lambda x, k: (
        f"(SELECT xor(((xor(w, w >> 15)) * {M2}) & {MASK}, (((xor(w, w >> 15)) * {M2}) & {MASK}) >> 13) FROM (SELECT (({x} % {MASK + 1}) * {M1} + ({x} >> 31) * 97 + {k}) & {MASK} AS w))"
    )
    rounds, frm = "", "start"
    for i, k in enumerate(round_keys(42)):
        cols = f"(l + {f('r', k)}) % a AS l, r" if i % 2 == 0 else f"l, (r + {f('l', k)}) % b AS r"
        rounds += f", r{i} AS (SELECT y, {cols}, b FROM (SELECT p.y, p.l, p.r, p.a, p.b FROM {frm} p))".replace(", b FROM", ", a, b FROM", 1)
        frm = f"r{i}"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, coalesce(text, '') AS t FROM documents),
n AS (SELECT count(*) AS total, greatest(1, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1) AS a FROM documents),
g AS (SELECT total, a, greatest(1, (total + a - 1) // a) AS b FROM n),
start AS (SELECT v.y, v.y // g.b AS l, v.y % g.b AS r, g.a, g.b FROM g, (SELECT unnest(range((SELECT a * b FROM g))) AS y) v)
{rounds},
image AS (SELECT y, l * b + r AS x FROM {frm}),
num AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS y FROM d),
walk AS (SELECT num.y, image.x FROM num JOIN image ON num.y = image.y
  UNION ALL SELECT walk.y, image.x FROM walk JOIN image ON walk.x = image.y WHERE walk.x >= (SELECT total FROM g))
SELECT doc_id, size, NULL::BIGINT AS text_crc32, 'rows' AS law, (walk.x % 8)::INT AS shard, walk.x // 8 AS slot, NULL::INT AS grown_shard
FROM num JOIN walk ON num.y = walk.y AND walk.x < (SELECT total FROM g)
"""


#: DuckDB has no crc32, so the driver gets no SQL for op2; the tests compare every other column with this.
OP2_SQL_WITHOUT_CRC = _sql()
