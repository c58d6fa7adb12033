"""Every query of the measurement side with its SQL.

The tables at hand are business tables, so each query applies an operator to columns that
have the shape it needs: orders stand in for encode runs, lines for candidates, vectors
of 64 numbers for 8x8 blocks, events for cells of a grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import blocks8, scalars
from marlstone.operators import blocks, grid, sweep
from marlstone.session import table

FLAGSHIP = "agg1_variant_summary"
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@_query("""SELECT l_returnflag, l_linestatus, count(*) AS n_runs, round(avg(l_quantity), 6) AS mean_l_quantity,
  round(avg(l_extendedprice), 6) AS mean_l_extendedprice, round(avg(l_discount), 6) AS mean_l_discount FROM lineitem GROUP BY ALL""")
def agg1_variant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.variant_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount"])


@_query("""WITH u AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME metric VALUE value)
SELECT l_returnflag, metric, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value,
  CASE WHEN metric IN ('l_quantity', 'l_extendedprice') THEN min(value) ELSE max(value) END AS worst_value, count(value) AS n FROM u GROUP BY l_returnflag, metric""")
def agg3_metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    better = {"l_quantity": True, "l_extendedprice": True, "l_discount": False, "l_tax": False}
    return sweep.metric_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], better)


@_query("""SELECT o_custkey, min(o_totalprice) AS min_size, max(o_totalprice) AS max_size,
  round(max(o_totalprice) / greatest(min(o_totalprice), 1), 6) AS ratio, count(*) AS n FROM orders GROUP BY ALL""")
def agg4_size_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.size_spread(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice")


@_query("""WITH p AS (SELECT l.o_custkey, l.o_orderkey AS lid, l.o_totalprice AS left_size, r.o_orderkey AS rid, r.o_totalprice AS right_size,
  row_number() OVER (PARTITION BY l.o_orderkey ORDER BY abs(l.o_totalprice - r.o_totalprice), r.o_orderkey) AS k
  FROM orders l JOIN orders r ON l.o_custkey = r.o_custkey WHERE l.o_orderstatus = 'F' AND r.o_orderstatus <> 'F')
SELECT o_custkey, lid, left_size, rid, right_size, round((left_size - right_size) / greatest(right_size, 1e-9) * 100, 6) AS size_delta_pct FROM p WHERE k = 1""")
def j1_nearest_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return sweep.nearest_size(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"), ["o_custkey"], "o_totalprice", "o_orderkey", "o_orderkey")


def _part_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("rate", F.col("p_size").cast("double"))
    return rows.groupBy("p_brand", "rate").agg(F.round(F.avg("p_retailprice"), 4).alias("quality"))


@_query("""WITH c AS (SELECT p_brand, p_size::DOUBLE AS rate, round(avg(p_retailprice), 4) AS quality FROM part GROUP BY ALL),
s AS (SELECT *, lead(rate) OVER w AS r1, lead(quality) OVER w AS q1 FROM c WINDOW w AS (PARTITION BY p_brand ORDER BY rate)),
p AS (SELECT DISTINCT p_brand, rate + 0.5 AS rate FROM c)
SELECT p.p_brand, p.rate, round(s.quality + (s.q1 - s.quality) * (ln(p.rate) - ln(s.rate)) / (ln(s.r1) - ln(s.rate)), 6) AS at_rate
FROM p LEFT JOIN s ON p.p_brand = s.p_brand AND p.rate > s.rate AND p.rate < s.r1""")
def j2_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = _part_curve(spark, sf_dir)
    return sweep.interpolate(curve.select("p_brand", (F.col("rate") + 0.5).alias("rate")), curve, ["p_brand"], "rate", "quality")


def _bd_sql(curves: str, pairs: str) -> str:
    """BD-rate by orthogonal polynomials: of curves (curve, q, r) and pairs (a, b) with whatever names them.

    The cubic that fits log rates over quality is built from four polynomials that are
    orthogonal on the curve's own points (three-term recurrence), in qualities moved to -1 ... 1.
    """
    return f"""c0 AS (SELECT curve, q, log10(r) AS y, count(*) OVER w AS n, min(q) OVER w AS lo, max(q) OVER w AS hi FROM ({curves}) WINDOW w AS (PARTITION BY curve)),
c1 AS (SELECT *, (2 * q - lo - hi) / (hi - lo) AS x FROM c0 WHERE n >= 4 AND hi > lo),
s1 AS (SELECT *, avg(x) OVER (PARTITION BY curve) AS a1 FROM c1),
s2 AS (SELECT *, x - a1 AS p1 FROM s1),
s3 AS (SELECT *, sum(x * p1 * p1) OVER w / sum(p1 * p1) OVER w AS a2, sum(p1 * p1) OVER w / n AS b2 FROM s2 WINDOW w AS (PARTITION BY curve)),
s4 AS (SELECT *, (x - a2) * p1 - b2 AS p2 FROM s3),
s5 AS (SELECT *, sum(x * p2 * p2) OVER w / nullif(sum(p2 * p2) OVER w, 0) AS a3, sum(p2 * p2) OVER w / sum(p1 * p1) OVER w AS b3 FROM s4 WINDOW w AS (PARTITION BY curve)),
s6 AS (SELECT *, (x - a3) * p2 - b3 * p1 AS p3 FROM s5),
f AS (SELECT curve, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, any_value(a1) AS a1, any_value(a2) AS a2, any_value(b2) AS b2, any_value(a3) AS a3, any_value(b3) AS b3,
  avg(y) AS k0, sum(y * p1) / sum(p1 * p1) AS k1, sum(y * p2) / nullif(sum(p2 * p2), 0) AS k2, sum(y * p3) / nullif(sum(p3 * p3), 0) AS k3 FROM s6 GROUP BY curve),
m AS (SELECT z.*, a.lo AS alo, a.hi AS ahi, b.lo AS blo, b.hi AS bhi, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM ({pairs}) z LEFT JOIN f a ON a.curve = z.a LEFT JOIN f b ON b.curve = z.b),
g AS (SELECT unnest([-0.906179845938664, -0.538469310105683, 0.0, 0.538469310105683, 0.906179845938664]) AS t, unnest([0.236926885056189, 0.478628670499366, 0.568888888888889, 0.478628670499366, 0.236926885056189]) AS w),
v AS (SELECT m.*, g.w, (lo + hi) / 2 + (hi - lo) / 2 * t AS pos FROM m, g),
e AS (SELECT v.*, f.curve = v.a AS is_a, (2 * pos - f.lo - f.hi) / (f.hi - f.lo) AS x, f.* EXCLUDE (curve, n, lo, hi) FROM v JOIN f ON f.curve IN (v.a, v.b)),
d AS (SELECT a, b, sum(CASE WHEN is_a THEN -1 ELSE 1 END * w / 2 * (k0 + k1 * (x - a1) + k2 * ((x - a2) * (x - a1) - b2) + k3 * ((x - a3) * ((x - a2) * (x - a1) - b2) - b3 * (x - a1)))) AS apart FROM e GROUP BY a, b)"""


@_query(f"""WITH c AS (SELECT p_brand AS curve, p_size::DOUBLE AS r, round(avg(p_retailprice), 4) AS q FROM part GROUP BY ALL), {_bd_sql("SELECT * FROM c", "SELECT DISTINCT 'Brand#11' AS a, curve AS b FROM c WHERE curve <> 'Brand#11' AND EXISTS (SELECT 1 FROM c WHERE curve = 'Brand#11')")}
SELECT m.b AS p_brand, round(CASE WHEN m.hi > m.lo THEN (10 ** apart - 1) * 100 END, 6) AS bd_rate_pct FROM m LEFT JOIN d USING (a, b)""")
def agg40_bd_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = _part_curve(spark, sf_dir).withColumn("one", F.lit(1))
    return sweep.bd_rate(curve, ["one"], "p_brand", "Brand#11", "rate", "quality").select("p_brand", F.round("bd_rate_pct", 6).alias("bd_rate_pct"))


@_query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def j5_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid_ = table(spark, sf_dir, "customer").select("c_custkey")
    return sweep.pending(grid_, table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@_query("""SELECT n_nationkey, m.o_orderstatus, q.qp FROM nation, (SELECT DISTINCT o_orderstatus FROM orders) m, (SELECT unnest([22, 27, 32, 37]) AS qp) q""")
def src32_sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    qps = spark.range(4).select((F.col("id") * 5 + 22).cast("int").alias("qp"))
    return sweep.sweep_grid(table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "orders").select("o_orderstatus").distinct(), qps)


@_query("""WITH e AS (SELECT event_type, CAST(round(value) AS INTEGER) % 9 - 4 AS o FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS qgs, min(o) AS min_dqp, round(avg(o), 6) AS mean_dqp, max(o) AS max_dqp, count(*) FILTER (o < 0) AS below_base_qgs,
  count(*) FILTER (o = 0) AS at_base_qgs, count(*) FILTER (o > 0) AS above_base_qgs, round(count(*) FILTER (o < 0) * 100.0 / count(*), 6) AS below_base_pct,
  round(count(*) FILTER (o > 0) * 100.0 / count(*), 6) AS above_base_pct FROM e GROUP BY ALL""")
def agg5_offset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").where("value IS NOT NULL").withColumn("o", F.round("value").cast("int") % 9 - 4)
    return sweep.offset_stats(cells, ["event_type"], "o")


@_query("SELECT event_type, min(value) AS min_s, round(avg(value), 6) AS mean_s, median(value) AS median_s, count(value) AS n FROM events GROUP BY ALL")
def agg6_timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.timing_summary(table(spark, sf_dir, "events"), "event_type", "value")


@_query("SELECT source, count(DISTINCT sha256(text)) = 1 AS identical, count(*) AS n FROM documents GROUP BY ALL")
def agg46_same_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("digest", F.sha2("text", 256))
    return sweep.same_bytes(docs, ["source"], "digest")


@_query("""SELECT l_partkey, coalesce(min(l_quantity) FILTER (l_extendedprice <= 20000), 51.0) AS level FROM lineitem GROUP BY ALL""")
def top6_best_under_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.best_under_budget(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity", "l_extendedprice", F.lit(20000), 51.0)


@_query("""WITH n AS (SELECT p_brand, p_partkey, p_retailprice, min(p_retailprice) OVER (PARTITION BY p_brand) AS best FROM part),
r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rank FROM n WHERE p_retailprice < best * 1.25)
SELECT p_brand, p_partkey, p_retailprice, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def top2_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.shortlist(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", "p_partkey", 1.25, 8)


@_query("""SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text""")
def set1_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.first_per_key(table(spark, sf_dir, "documents").select("text", "doc_id"), ["text"], ["doc_id"])


#: Line numbers repeat in an order, so a line's place also takes its part and supplier.
_PLACE = "l_linenumber * 1000000000000 + l_partkey * 10000 + l_suppkey % 10000"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("pos", F.expr(_PLACE.replace("1000000000000", "1000000000000L")))


_WINNERS = f"""i AS (SELECT *, {_PLACE} AS pos FROM lineitem), w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, pos) AS place,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS listed FROM i),
d AS (SELECT l_orderkey, max(least(listed, 6)) FILTER (place = 1) AS winner_rank, max(l_extendedprice) FILTER (place = 1) AS best_cost,
  coalesce(min(l_extendedprice) FILTER (place > 1), max(l_extendedprice) FILTER (place = 1)) AS runner_up_cost, count(*) AS n_candidates FROM w GROUP BY ALL)"""


def _winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.winner_ranks(_lines(spark, sf_dir), ["l_orderkey"], "l_extendedprice", "pos")


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderstatus")
    return _winners(spark, sf_dir).join(orders, "l_orderkey")


@_query(f"WITH {_WINNERS} SELECT l_orderkey, CAST(winner_rank AS INTEGER) AS winner_rank, best_cost, runner_up_cost, n_candidates FROM d")
def win1_winner_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _winners(spark, sf_dir)


@_query(f"""WITH {_WINNERS} SELECT o_orderpriority, count(*) AS decisions, {', '.join(f"count(*) FILTER (winner_rank = {r}) AS rank{r}{'plus' if r == 6 else ''}" for r in range(1, 7))}
FROM d JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def agg31_rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.rank_table(_kinds(spark, sf_dir), "o_orderpriority")


@_query(f"""WITH {_WINNERS} SELECT o_orderpriority, o_orderstatus, n_candidates, CASE grouping(o_orderstatus) WHEN 0 THEN 'o_orderstatus' ELSE 'n_candidates' END AS dimension, count(*) AS decisions, round(avg(winner_rank), 6) AS mean_rank
FROM d JOIN orders ON o_orderkey = l_orderkey GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority, n_candidates))""")
def agg34_rank_crosstabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.rank_crosstabs(_kinds(spark, sf_dir), "o_orderpriority", ["o_orderstatus", "n_candidates"])


@_query(f"""WITH {_WINNERS} SELECT o_orderpriority, CASE WHEN m < 0.02 THEN 0 WHEN m < 0.05 THEN 1 WHEN m < 0.1 THEN 2 WHEN m < 0.25 THEN 3 WHEN m < 0.5 THEN 4 ELSE 5 END AS bucket,
  count(*) AS decisions, CAST(sum(n_candidates) AS BIGINT) AS weight FROM (SELECT *, (runner_up_cost - best_cost) / best_cost AS m FROM d WHERE best_cost > 0) JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def agg30_margin_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.margin_table(_kinds(spark, sf_dir), "o_orderpriority", F.col("n_candidates"))


@_query(f"""WITH i AS (SELECT *, {_PLACE} AS pos FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, pos) AS a,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, pos) AS b FROM i)
SELECT l_orderkey, max(pos) FILTER (a = 1) <> max(pos) FILTER (b = 1) AS flipped FROM r GROUP BY ALL""")
def win2_winner_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.winner_flips(_lines(spark, sf_dir), ["l_orderkey"], "l_extendedprice", "l_quantity", "pos")


@_query("""WITH g AS (SELECT *, CASE WHEN l_returnflag = 'R' AND l_extendedprice > 0 THEN l_quantity / l_extendedprice END AS gain FROM lineitem)
SELECT bucket, count(*) AS n, round(count(*) FILTER (l_returnflag = 'R') * 100.0 / count(*), 6) AS split_pct, round(coalesce(median(gain), 0), 6) AS median_gain,
  round(count(*) FILTER (gain < 0.0005) * 100.0 / count(*), 6) AS flip_0, round(count(*) FILTER (gain < 0.001) * 100.0 / count(*), 6) AS flip_1
FROM (SELECT *, l_linenumber AS bucket FROM g) GROUP BY ALL""")
def agg7_split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("bucket"), (F.col("l_returnflag") == "R").cast("int").alias("winner_split"), F.col("l_quantity").alias("split_won_by"), F.col("l_extendedprice").alias("leaf_cost")
    )
    return blocks.split_table(rows, ["bucket"], (0.0005, 0.001))


@_query("""WITH s AS (SELECT l_returnflag, l_linenumber, sum(l_quantity) AS area FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linenumber, area, round(area * 100 / sum(area) OVER (PARTITION BY l_returnflag), 6) AS share_pct FROM s""")
def agg8_class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.class_shares(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber", F.col("l_quantity"))


@_query("""SELECT quality, count(*) AS n, count(*) FILTER (toxic = 0) AS n_0, count(*) FILTER (toxic = 1) AS n_1,
  round(count(*) FILTER (toxic = 0) * 100.0 / count(*), 6) AS pct_0, round(count(*) FILTER (toxic = 1) * 100.0 / count(*), 6) AS pct_1 FROM labels GROUP BY ALL""")
def agg11_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.confusion(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


@_query("SELECT l_returnflag, round(sum(l_discount) / sum(l_quantity), 6) AS discount_per_unit, round(sum(l_tax) / sum(l_quantity), 6) AS tax_per_unit FROM lineitem GROUP BY ALL")
def agg12_ratio_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = {"discount_per_unit": ("l_discount", "l_quantity"), "tax_per_unit": ("l_tax", "l_quantity")}
    return blocks.ratio_of_sums(table(spark, sf_dir, "lineitem"), ["l_returnflag"], pairs)


@_query("""WITH g AS (SELECT cx, cy FROM (SELECT unnest(range(0, 8)) AS cx), (SELECT unnest(range(0, 8)) AS cy)),
s AS (SELECT l_partkey % 512 // 64 AS cx, l_suppkey % 512 // 64 AS cy, sum(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL)
SELECT cx, cy, CAST(coalesce(l_linenumber, 0) AS BIGINT) AS l_linenumber FROM g LEFT JOIN s USING (cx, cy)""")
def agg10_dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 512).alias("x"), (F.col("l_suppkey") % 512).alias("y"), "l_linenumber")
    cells = spark.range(64).select((F.col("id") % 8).alias("cx"), F.floor(F.col("id") / 8).alias("cy"))
    return blocks.dense_cells(rows, cells, "x", "y", 64, ["l_linenumber"])


@_query("SELECT event_type, CAST(sum(user_id) AS BIGINT) AS amount, round(sum(user_id) * 100 / sum(sum(user_id)) OVER (), 6) AS share_pct FROM events GROUP BY event_type")
def agg28_stage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.stage_shares(table(spark, sf_dir, "events"), "event_type", "user_id")


_CELLS = "c AS (SELECT event_type, user_id % 40 AS cx, hour(ts) AS cy, CAST(sum(event_id) AS BIGINT) AS v FROM events GROUP BY ALL)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 40).alias("cx"), F.hour("ts").cast("long").alias("cy"), "event_id")
    return rows.groupBy("event_type", "cx", "cy").agg(F.sum("event_id").alias("v"))


@_query(f"""WITH {_CELLS} SELECT a.event_type, a.cx, a.cy, a.v, CAST(sum(b.v) // count(b.v) AS BIGINT) AS around FROM c a LEFT JOIN c b
ON a.event_type = b.event_type AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND (a.cx <> b.cx OR a.cy <> b.cy) GROUP BY ALL""")
def j16_neighbour_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.neighbour_mean(_cells(spark, sf_dir), ["event_type"], "cx", "cy", "v")


@_query("""WITH c AS (SELECT user_id % 40 AS cx, hour(ts) AS cy, max(event_id) AS v FROM events GROUP BY ALL),
b AS (SELECT l_orderkey, l_linenumber, l_partkey % 1250 AS x, l_suppkey % 740 AS y, l_linenumber * 8 AS size FROM lineitem)
SELECT l_orderkey, l_linenumber, max(v) AS v, count(*) AS cells FROM b JOIN c ON cx BETWEEN x // 32 AND (x + size - 1) // 32 AND cy BETWEEN y // 32 AND (y + size - 1) // 32 GROUP BY ALL""")
def j15_overlap_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells_max(spark, sf_dir)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1250).alias("x"), (F.col("l_suppkey") % 740).alias("y"), (F.col("l_linenumber") * 8).alias("size"))
    return grid.overlap_max(rows, cells, ["l_orderkey", "l_linenumber"], "x", "y", "size", 32, "v")


def _cells_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("cx"), F.hour("ts").cast("long").alias("cy"), "event_id")
    return rows.groupBy("cx", "cy").agg(F.max("event_id").alias("v"))


_SAMPLES = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x * 100) AS BIGINT)) AS s FROM embeddings)"


@_query(f"""WITH {_SAMPLES}, m AS (SELECT vec_id, label, list_sum(s) // len(s) AS mean, list_sum(list_transform(s, lambda x: x * x)) // len(s) AS sq, list_sum(s) AS t, len(s) AS n FROM e)
SELECT vec_id, label, CAST(trunc(t / n) AS BIGINT) AS mean, CAST(sq - trunc(t / n) * trunc(t / n) AS BIGINT) AS variance FROM m""")
def agg17_cell_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # In the precision of the table, as the SQL has it: 0.29 of 32 bits gives 29, and 28 in 64.
    samples = F.transform("embedding", lambda x: F.floor(x * F.lit(100).cast("float")))
    return table(spark, sf_dir, "embeddings").withColumn("s", samples).withColumns(grid.cell_statistics(F.col("s"))).select("vec_id", "label", "mean", "variance")


@_query("""SELECT l_returnflag, round(min(log2(1 + l_quantity)), 6) AS min_log, round(avg(log2(1 + l_quantity)), 6) AS mean_log, round(max(log2(1 + l_quantity)), 6) AS max_log, count(*) AS cells FROM lineitem GROUP BY ALL""")
def agg18_frame_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.frame_statistics(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@_query("""WITH m AS (SELECT o_orderkey, o_orderpriority, o_totalprice, avg(log2(1 + o_totalprice)) OVER (PARTITION BY o_orderpriority) AS a FROM orders)
SELECT o_orderkey, o_orderpriority, CAST(least(greatest(round(log2(1 + o_totalprice) - a), -6), 6) AS INTEGER) AS "offset" FROM m""")
def fn2_variance_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.variance_offsets(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderkey", "o_orderpriority", "offset")


@_query("""WITH w AS (SELECT p_partkey, p_brand, p_retailprice AS x, min(p_retailprice) OVER (PARTITION BY p_brand) AS lo, max(p_retailprice) OVER (PARTITION BY p_brand) AS hi FROM part)
SELECT p_partkey, round(CASE WHEN hi = lo THEN 0 ELSE (x - lo) / (hi - lo) END, 6) AS position FROM w""")
def win6_rank_in_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.rank_in_frame(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice").select("p_partkey", F.round("position", 6).alias("position"))


_PAIRS = "p AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS a, list_transform(b.embedding, lambda x: x::DOUBLE) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    return rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


@_query(f"""WITH {_PAIRS}, s AS (SELECT vec_id, list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p)
SELECT vec_id, round(d, 6) AS ssd, round(10 * log10(255 * 255 / (d / 64)), 6) AS psnr FROM s""")
def agg41_block_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _block_pairs(spark, sf_dir)
    return pairs.select("vec_id", F.round(blocks8.ssd(F.col("a"), F.col("b")), 6).alias("ssd"), F.round(blocks8.block_psnr(F.col("a"), F.col("b")), 6).alias("psnr"))


@_query(f"""WITH {_PAIRS}, s AS (SELECT vec_id, list_avg(a) AS mx, list_avg(b) AS my, list_var_pop(a) AS vx, list_var_pop(b) AS vy,
  list_avg(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) AS xy FROM p)
SELECT vec_id, round((2 * mx * my + 6.5025) * (2 * (xy - mx * my) + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225)), 6) AS ssim FROM s""")
def agg43_block_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block_pairs(spark, sf_dir).select("vec_id", F.round(blocks8.ssim8("a", "b"), 6).alias("ssim"))


@_query(f"""WITH {_PAIRS}, k AS (SELECT unnest(range(64)) AS k),
h AS (SELECT vec_id, k // 8 AS u, k % 8 AS v, list_sum(list_transform(range(64), lambda i: (a[i + 1] - b[i + 1]) * CASE WHEN (bit_count((i // 8) & (k // 8)) + bit_count((i % 8) & (k % 8))) % 2 = 0 THEN 1 ELSE -1 END)) AS c FROM p, k)
SELECT vec_id, round(sum(abs(c)) / 4, 6) AS satd FROM h GROUP BY ALL""")
def k19_satd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block_pairs(spark, sf_dir).select("vec_id", F.round(blocks8.satd8("a", "b"), 6).alias("satd"))


@_query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def snk19_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


_NO_SUFFIX = r"regexp_replace(url, '([^/])\.[^./]+$', '\1')"


@_query(f"SELECT page_id, regexp_replace({_NO_SUFFIX}, '[^A-Za-z0-9_.-]+', '_', 'g') AS stem, regexp_replace({_NO_SUFFIX}, '[^\\p{{L}}\\p{{N}}._-]', '_', 'g') AS stem_each FROM pages")
def fn28_safe_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.safe_stem(F.col("url")).alias("stem"), scalars.safe_stem_each(F.col("url")).alias("stem_each"))


@_query("""SELECT o_orderkey, round(round(o_totalprice * 8 / 1000, 8), 6) AS bpp, CAST(greatest(round(o_totalprice * 1000 / 8), 1) AS BIGINT) AS budget,
  CASE WHEN o_totalprice < 20 THEN 'smooth' WHEN o_totalprice > 200 THEN 'textured' ELSE 'mid' END AS texture FROM orders""")
def prj1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(scalars.bits_per_pixel(price, F.lit(1000)), 6).alias("bpp"), scalars.budget_bytes(price, F.lit(1000)).alias("budget"), scalars.texture_class(price).alias("texture"))


@_query("""SELECT p_partkey, round(0.57 * pow(2, (p_size - 12) / 3.0), 6) AS rd_lambda, round(pow(2, p_size / 6.0 - 2), 6) AS sad_lambda,
  CASE WHEN p_size < 30 THEN p_size WHEN p_size >= 43 THEN p_size - 6 ELSE [29,30,31,32,33,33,34,34,35,35,36,36,37][p_size - 29] END AS chroma_qp,
  CASE WHEN p_size = 0 THEN 'PLANAR' WHEN p_size = 1 THEN 'DC' WHEN p_size <= 34 THEN 'ANG' || p_size ELSE '?' || p_size END AS mode FROM part""")
def fn15_quantiser_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(scalars.rd_lambda(size), 6).alias("rd_lambda"), F.round(scalars.sad_lambda(size), 6).alias("sad_lambda"), scalars.chroma_qp(size).alias("chroma_qp"), scalars.mode_name(size).alias("mode"))


import marlstone.catalog_cells  # noqa: E402, F401  (adds its queries)
import marlstone.catalog_pictures  # noqa: E402, F401
import marlstone.catalog_boxes  # noqa: E402, F401
import marlstone.catalog_plans  # noqa: E402, F401
