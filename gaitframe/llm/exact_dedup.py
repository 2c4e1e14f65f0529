"""Exact dedup by content-defined chunk recipes (native: DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, spaced

#: A chunk has LEAST bytes at least and ends behind the first byte that hashes low; MOST more bound it.
LEAST, MOST = 384, 4096
#: A quarter of every sixteen byte values, but none that opens a character: in any script some letters end chunks.
CUT = "[" + "".join(f"\\x{b:02x}" for b in range(0xC0) if (b * 5 + (b >> 4) * 3) % 4 == 0) + "]"


def chunks(text: Column, least: int = LEAST, most: int = MOST, cut: str = CUT) -> Column:
    """Content-defined chunks of the text's UTF-8 bytes, one character (below U+0100) a byte; together they are all of them."""
    pattern = f"(?s).{{{least},{most}}}?{cut}|.{{1,{least + most}}}"
    return F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(pattern), F.lit(0))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_key: Callable[[Column], Column] = F.xxhash64,
    least: int = LEAST,
    most: int = MOST,
) -> DataFrame:
    """docs' ids with keep_id, group_size, kept and text_sha256 of the normalised text, one row per input row.

    Texts are equal when identical after each run of ASCII white space became one space. A text is a
    recipe: the ordered identifiers of its chunks. Every distinct chunk is moved once, and its bytes
    decide: where chunks of different bytes share a key, each gets a variant number of its own, so that
    an identifier (key, variant) stands for exactly one string. Recipes, not texts, are then compared.

    Null text counts as empty. An empty text has the empty recipe, so all empty texts are one group.
    Null ids sort last: a group of null ids only has keep_id null and all its rows kept. Rows that repeat
    an id with an equal text are counted in group_size, and each of them is kept if its id is. A long text
    is a long recipe. An empty table gives an empty result. Columns of docs beyond id and text are ignored
    whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "dedup")
    base = docs.select(F.col(id_col).alias("_id"), spaced(F.col(text_col)).alias("_t"))
    parts = base.withColumn("_c", chunks(F.col("_t"), least, most))
    entries = parts.select("_id", "_t", F.posexplode("_c").alias("_p", "_b"))
    store = entries.select(chunk_key(F.col("_b")).alias("_k"), "_b").distinct()
    clash = store.groupBy("_k").agg(F.count("*").alias("_n")).filter("_n > 1")
    # Keys that stand for more than one string: none, or about n^2 / 2^65 of n chunks.
    clash = scratch.write(clash.select("_k"), "clash")
    recipes = parts.select(
        "_id",
        F.sha2(F.col("_t").cast("binary"), 256).alias("text_sha256"),
        F.transform("_c", lambda c: chunk_key(c)).alias("_r"),
        *([] if clash.isEmpty() else ["_t"]),
    )
    if not clash.isEmpty():
        hit = store.join(clash, "_k", "left_semi")
        order = F.row_number().over(_by_key())
        variant = scratch.write(hit.select("_k", "_b", order.alias("_v")).filter("_v > 1"), "variants")
        odd = (
            entries.withColumn("_k", chunk_key(F.col("_b")))
            .join(variant, ["_k", "_b"])
            .groupBy("_id", "_t")
            .agg(F.array_sort(F.collect_set(F.struct("_p", "_v"))).alias("_odd"))
            .withColumnRenamed("_id", "_oid")
            .withColumnRenamed("_t", "_ot")
        )
        recipes = (
            recipes.join(odd, F.col("_id").eqNullSafe(F.col("_oid")) & (F.col("_t") == F.col("_ot")), "left")
            .withColumn("_r", F.struct("_r", "_odd"))
            .select("_id", "text_sha256", "_r")
        )
    groups = recipes.groupBy("_r").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
    more = groups.filter("group_size > 1").select(F.col("_r").alias("_g"), "keep_id", "group_size")
    out = recipes.join(more, F.col("_r").eqNullSafe(F.col("_g")), "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def _by_key():
    return Window.partitionBy("_k").orderBy("_b")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts: the smallest id, null ids last.

    Rows go by id and text, null-safe, so another row of the same id stays. Of rows that repeat both, the
    first in the order of text and then of the other columns stays. Null and empty texts are one group;
    columns may have any names that do not begin with _gaitframe. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    groups = exact_dedup(docs, id_col, text_col).filter("group_size > 1").groupBy(F.col(id_col).alias("_gaitframe_id"), F.col("text_sha256").alias("_gaitframe_text"), F.col("kept").alias("_gaitframe_kept"))
    groups = scratch.write(groups.agg(F.count("*").alias("_gaitframe_n")), "groups")
    names = docs.columns
    rows = docs.withColumn("_gaitframe_sha", F.sha2(spaced(F.col(text_col)).cast("binary"), 256))
    same = (F.col("_gaitframe_sha") == F.col("_gaitframe_text")) & F.col(id_col).eqNullSafe(F.col("_gaitframe_id"))
    once = rows.join(groups.filter("NOT _gaitframe_kept OR _gaitframe_n > 1"), same, "left_anti").select(names)
    repeats = groups.filter("_gaitframe_kept AND _gaitframe_n > 1")
    if repeats.isEmpty():
        return once
    order = Window.partitionBy("_gaitframe_sha").orderBy(text_col, *[c for c in names if c != text_col])
    first = rows.join(repeats, same, "left_semi").withColumn("_gaitframe_first", F.row_number().over(order)).filter("_gaitframe_first = 1")
    return once.unionByName(first.select(names))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """exact_dedup of all documents."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.n) AS text_sha256
FROM t JOIN g ON t.n = g.n
"""
