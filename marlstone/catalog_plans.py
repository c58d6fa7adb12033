"""Queries of the budget search, the comment lexer and the variant language, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.catalog import _query
from marlstone.functions import variants
from marlstone.operators import lexer
from marlstone.plans import sweep_plan
from marlstone.session import table


def _encoded(cell: dict) -> dict:
    """A stand-in encoder: the size falls as the level grows."""
    return {"size_bytes": int(cell["price"]) // cell["level"]}


@_query("""WITH p AS (SELECT p_partkey, CAST(floor(p_retailprice * 100) AS BIGINT) AS price, p_size * 400 AS budget FROM part), l AS (SELECT unnest(range(1, 52)) AS level),
b AS (SELECT p_partkey, any_value(price) AS price, min(level) FILTER (price // level <= budget) AS best FROM p, l GROUP BY p_partkey)
SELECT p_partkey, CAST(coalesce(best, 51) AS INTEGER) AS level, price // coalesce(best, 51) AS size_bytes, best IS NOT NULL AS fits FROM b""")
def top6_budget_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_retailprice") * 100).alias("price"), (F.col("p_size") * 400).cast("long").alias("budget"))
    return sweep_plan.search_budget(pictures, ["p_partkey"], "budget", _encoded)


@_query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(translate(html, '<>', '/*'), '(?s)"(?:\\.|[^"\\])*(?:"|\\?\z)|''(?:\\.|[^''\\])*(?:''|\\?\z)|//[^\n]*|/\*.*?(?:\*/|\z)')) AS c FROM pages)
SELECT page_id, c AS comment, count(*) AS n FROM t WHERE c[1] = '/' GROUP BY ALL""")
def src31_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("html", F.translate("html", "<>", "/*"))
    return lexer.comments(pages, "page_id", "html", 500).groupBy("page_id", "comment").agg(F.count(F.lit(1)).alias("n"))


@_query("""WITH t AS (SELECT p_partkey, p_size AS s, p_partkey % 4 AS k, CASE WHEN p_size % 3 = 0 THEN '+qg16' ELSE '' END AS q FROM part),
v AS (SELECT *, CASE k WHEN 0 THEN 'map' || s WHEN 1 THEN 'cli:preset' || s WHEN 2 THEN 'psy:' || s || ':aq=p' || s ELSE CASE WHEN s % 5 = 0 THEN 'psy:' || s || ':x' ELSE 'psy:' || s || ':0.5' END END AS body FROM t),
g AS (SELECT p_partkey, s, k, q, body, unnest([0.5, 1.25]) AS strength, (k = 3 AND s % 5 = 0) AS bad FROM v)
SELECT p_partkey, replace(replace(replace(body, 'cli:', ''), CASE WHEN k > 1 THEN ':' ELSE '~' END, '_'), CASE WHEN k > 1 THEN '=' ELSE '~' END, '') || q || CASE strength WHEN 0.5 THEN '_s050' ELSE '_s125' END AS variant, strength::DOUBLE AS strength,
  CASE WHEN bad THEN NULL WHEN k = 0 THEN 'map' WHEN k = 1 THEN 'cli' ELSE 'psy' END AS kind, CASE WHEN k = 0 THEN 'map' || s END AS map, CASE k WHEN 1 THEN 'preset' || s WHEN 2 THEN 'p' || s END AS preset,
  CASE WHEN k > 1 AND NOT bad THEN s::DOUBLE END AS psy_rd, CASE WHEN bad THEN NULL WHEN k = 2 THEN 0.0 WHEN k = 3 THEN 0.5 END::DOUBLE AS psy_rdoq, CASE WHEN NOT bad THEN CASE WHEN q = '' THEN 32 ELSE 16 END END::INTEGER AS group_edge,
  CASE WHEN bad THEN 6 + len(s::VARCHAR) END::INTEGER AS fault FROM g""")
def fn32_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    body = F.when(k == 0, F.concat(F.lit("map"), s)).when(k == 1, F.concat(F.lit("cli:preset"), s)).when(k == 2, F.concat(F.lit("psy:"), s, F.lit(":aq=p"), s)).otherwise(F.concat(F.lit("psy:"), s, F.when(F.col("p_size") % 5 == 0, ":x").otherwise(":0.5")))
    tokens = table(spark, sf_dir, "part").select("p_partkey", F.concat(body, F.when(F.col("p_size") % 3 == 0, "+qg16").otherwise("")).alias("token"))
    return variants.expand_variants(tokens, "token", [0.5, 1.25]).drop("token")


@_query("""WITH a AS (SELECT o_orderkey, o_orderstatus AS s, o_custkey % 3 AS c, o_orderpriority AS p FROM orders)
SELECT o_orderkey, s AS status, CASE WHEN c = 0 THEN NULL WHEN c = 1 THEN p ELSE 'late=r' END AS priority, CASE WHEN c = 0 THEN 2 END::INTEGER AS fault FROM a WHERE c <> 0 UNION ALL SELECT o_orderkey, NULL, NULL, 2 FROM a WHERE c = 0""")
def fn31_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey") % 3
    text = F.concat(F.lit("STATUS=x, STATUS="), F.col("o_orderstatus"), F.when(c == 0, F.lit(", =")).when(c == 1, F.concat(F.lit(",PRIORITY ="), F.col("o_orderpriority"))).otherwise(F.lit(", PRIORITY=late=r,,")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", variants.assignments(text).alias("a"))
    return rows.select("o_orderkey", F.col("a.settings")["STATUS"].alias("status"), F.col("a.settings")["PRIORITY"].alias("priority"), F.when(F.col("a.fault") > 0, F.lit(2)).alias("fault"))
