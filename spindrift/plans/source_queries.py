"""Study folders, published tables and digest trees on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merkle
from ..sources import published, study_files
from ..sources.store import new_folder
from .tables import table


def study_folder(spark, d):
    """Documents as a folder with one run a language, read back by the data source: files are only opened in the two runs asked for."""
    root = new_folder(spark, "study")
    table(spark, d, "documents").select("lang", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("lang").text(root)
    files = study_files.study_files(spark, root.removeprefix("file://")).filter("run IN ('lang=de', 'lang=en') AND path LIKE '%/part-%'")
    lines = F.length(F.regexp_replace(F.col("content").cast("string"), "[^\n]", "")).cast("long")
    return files.groupBy("run").agg(F.sum("bytes").alias("bytes"), F.sum(lines).alias("lines"), F.bool_and(F.sha2("content", 256) == F.col("sha256")).alias("intact"))


def published_table(spark, d):
    """Orders written once, read back against their digest, and counted."""
    path = new_folder(spark, "published")
    digest = published.publish(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    rows = published.published(spark, path, digest)
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def digest_tree(spark, d):
    """Every node above the rows of lineitem, in the order of their digests."""
    cells = table(spark, d, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("c"))
    levels = merkle.tree(cells.select(F.sha2("c", 256).alias("h")), ["h"], "h", 256)
    out = levels[1].withColumn("level", F.lit(1))
    for i, nodes in enumerate(levels[2:], 2):
        out = out.unionByName(nodes.withColumn("level", F.lit(i)))
    return out.select("level", "at", "digest")


QUERIES = {f.__name__: f for f in (study_folder, published_table, digest_tree)}

_NODES = ", ".join(f"t{i + 1} AS (SELECT i // 256 AS i, sha256(string_agg(h, chr(10) ORDER BY i)) AS h FROM t{i} GROUP BY 1)" for i in range(4))
ORACLE_SQL = {
    "study_folder": "SELECT 'lang=' || lang AS run, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, CAST(sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) AS BIGINT) AS lines, true AS intact FROM documents WHERE lang IN ('de', 'en') GROUP BY lang",
    "published_table": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "digest_tree": f"WITH t0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS i, h FROM (SELECT sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS h FROM lineitem)), {_NODES} SELECT level, CAST(i AS BIGINT) AS at, h AS digest FROM (" + " UNION ALL ".join(f"SELECT {k} AS level, i, h FROM t{k} WHERE (SELECT count(*) FROM t{k - 1}) > 1" for k in range(1, 5)) + ")",
}
