"""Line dedup by the number of distinct sites a line appears on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, row_key

#: A line on this many sites is boilerplate. LG_K registers (log2) of a sketch; its relative error is about
#: 1.04 / sqrt(2^LG_K), and lines within three times that of the threshold are counted exactly.
MIN_SITES, LG_K = 8, 12


def line_spread(lines: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """_h of the lines (_h, _site) that appear on at least min_sites sites.

    Tables that a join needs on one side are written, so that the rows of a very common line can be split.
    """
    # A line cannot be on more sites than it has occurrences.
    often = scratch.write(lines.groupBy("_h").count().filter(F.col("count") >= min_sites).select("_h"), "often")
    some = scratch.write(lines.join(often, "_h", "left_semi"), "some")
    spread = some.groupBy("_h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(lg_k))).alias("_e"))
    spread = scratch.write(spread, "spread")
    error = 3 * 1.04 / 2 ** (lg_k / 2)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    near = spread.filter(F.col("_e").between(low, high)).select("_h")
    exact = some.distinct().join(near, "_h", "left_semi").groupBy("_h").count().filter(F.col("count") >= min_sites).select("_h")
    return spread.filter(F.col("_e") > high).select("_h").union(exact)


def line_dedup(
    docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", lg_k: int = LG_K
) -> DataFrame:
    """id, n_lines, n_removed and kept (the remaining lines joined by newlines) of every row.

    A line is what stands between newlines, with ASCII white space around it left out for the comparison.
    It is removed everywhere when it appears on at least min_sites sites; blank lines always stay. Sites
    are counted by sketches that merge by aggregation; lines near the threshold are counted exactly.

    Null text has no line and stays null in kept; an empty text has one blank line. Rows without a site
    (null) are cleaned but count for no site. Lines on equally many sites are all treated alike. A long text
    is one row with a long list of lines. Rows that repeat an id are separate; null ids are allowed. Other
    columns are ignored whatever their names. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(row_key(id_col, text_col).alias("_r"), F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(site_col).cast("string").alias("_site"))
    split = F.split(F.coalesce("_t", F.lit("")), "\n", -1)
    bare = F.regexp_replace(F.col("_line"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    lines = rows.select("_r", "_site", F.posexplode(split).alias("_p", "_line")).withColumn("_b", bare).filter("_b != ''")
    lines = lines.select("_r", "_site", "_p", F.xxhash64("_b").alias("_h"))
    spread = scratch.write(line_spread(lines.filter("_site IS NOT NULL").select("_h", "_site"), scratch, min_sites, lg_k), "boilerplate")
    hits = lines.join(spread, "_h", "left_semi").groupBy("_r").agg(F.collect_set("_p").alias("_gone")).withColumnRenamed("_r", "_q")
    out = rows.join(hits, F.col("_r") == F.col("_q"), "left")
    # Set difference of line numbers takes time in proportion to the lines, however many are removed.
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.coalesce("_gone", F.array().cast("array<int>")))
    return out.withColumn("_lines", split).select(
        F.col("_id").alias(id_col),
        F.when(F.col("_t").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
        F.when(F.col("_gone").isNull(), F.col("_t")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")).alias("kept"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
b AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k FROM l),
s AS (SELECT k FROM b WHERE k != '' GROUP BY k HAVING count(DISTINCT source) >= 8),
m AS (SELECT b.*, s.k IS NOT NULL AS gone FROM b LEFT JOIN s ON b.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
