"""Queries of cell offsets, search reports and predicates, with their SQL.

As in ``catalog``, business columns stand in: parts are cells (the price is a variance,
the size chroma activity, the brand a picture), lines are search events, orders are runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.catalog import _bd_sql, _query
from marlstone.functions import offsets, scalars
from marlstone.operators import blocks, grid, ledger, sweep
from marlstone.session import table
from marlstone.sources import results


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", "p_brand", (F.floor("p_retailprice") % 300).cast("int").alias("v"), F.col("p_size").cast("int").alias("c"))


_CELLS = "cells AS (SELECT p_partkey, p_brand, CAST(floor(p_retailprice) AS INTEGER) % 300 AS v, p_size AS c FROM part)"
_FRAME = f"""{_CELLS}, k AS (SELECT *, log2(1 + v) AS lv, log2(1 + v) + 0.35 * log2(1 + c) AS act, pow(256.0 * v + 64.0 * c + 1, 0.1) AS q, ln(1.0 + v) AS nat FROM cells),
f AS (SELECT p_brand, avg(act) AS a, min(lv) AS lo, max(lv) AS hi, avg(q) AS qa, avg(q * q) AS q2, avg(nat) AS ln_mean FROM k GROUP BY p_brand),
j AS (SELECT k.*, a, lo, hi, qa, qa - 0.5 * (q2 - 11) / qa AS fin, ln_mean FROM k JOIN f USING (p_brand))"""


def _offset_query(name: str, mode: str, strength: float, clamp: int, raw: str, low: int | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return grid.cell_offsets(_cells(spark, sf_dir), ["p_brand"], "v", "c", mode, strength, clamp).select("p_partkey", "offset")

    run.__name__ = name
    _query(f"WITH {_FRAME} SELECT p_partkey, CAST(greatest(least(round(round({raw}, 9)), {clamp}), {-clamp if low is None else low}) AS INTEGER) AS \"offset\" FROM j")(run)


_offset_query("fn3_chroma_offsets", "chroma", 0.35, 2, "0.35 * (act - a)")
_offset_query("fn4_positive_offsets", "positive", 0.0, 8, "1 + 7 * CASE WHEN hi - lo <= 1.1920929e-07 THEN 0 ELSE (lv - lo) / (hi - lo) END", 1)
_offset_query("fn5_energy_offsets", "autovar", 1.0, 6, "qa * (q - fin)")
_offset_query("fn5_energy_offsets_biased", "autovar_biased", 1.0, 6, "qa * (q - fin) + (1 - 11 / (q * q))")
_offset_query("fn7_measured_offsets", "measured", 1.0, 4, "nat - ln_mean")


@_query(f"WITH {_CELLS} SELECT p_partkey, round(pow(256.0 * v + 64.0 * c + 1, 0.1), 6) AS root, round(log2(1 + v) + 0.35 * log2(1 + c), 6) AS activity FROM cells")
def fn6_energy_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = F.col("v"), F.col("c")
    return _cells(spark, sf_dir).select("p_partkey", F.round(offsets.energy_root(v, c, 64.0), 6).alias("root"), F.round(offsets.activity(v, c), 6).alias("activity"))


@_query(f"WITH {_FRAME} SELECT DISTINCT p_brand, round(a, 6) AS mean_activity, round(qa, 6) AS avg_adj, round(fin, 6) AS avg_adj_final FROM j")
def agg18_frame_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.frame_reference(_cells(spark, sf_dir), ["p_brand"], "v", "c")
    return out.select("p_brand", *[F.round(x, 6).alias(x) for x in ("mean_activity", "avg_adj", "avg_adj_final")])


@_query(f"WITH {_CELLS} SELECT p_partkey, CAST(round(1 + (1 - least(v, 256) / 256.0) * 7) AS INTEGER) AS \"offset\" FROM cells")
def fn1_importance_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("p_partkey", scalars.importance_offset(F.col("v")).alias("offset"))


_SIGNALS = "s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS energy, l_quantity AS bits, l_extendedprice * l_discount AS sse FROM lineitem)"


@_query(f"""WITH {_SIGNALS} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sse + 0.57 * pow(2, (32 - 12) / 3.0) * bits, 4) AS rd, round(bits / (1 + sse), 6) AS bits_per_sse, energy FROM s""")
def fn8_two_pass_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    e, b, s = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_extendedprice") * F.col("l_discount")
    signal = lambda name: offsets.two_pass_signal(name, e, b, s, 32)
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(signal("rd"), 4).alias("rd"), F.round(signal("bits_per_sse"), 6).alias("bits_per_sse"), signal("").alias("energy"))


_REGIONS = f"""{_CELLS}, m AS (SELECT p_partkey, p_brand, v, c, c * 3 % 97 AS edge, v * 7 % 200 AS entropy, v * 11 % 256 AS dominance, v * 5 % 256 AS aligned, c % 11 AS noise FROM cells),
r AS (SELECT *, CASE WHEN edge >= 64 AND entropy < 110 AND aligned >= 160 AND noise < 7 THEN 'text_like' WHEN edge >= 38 AND dominance >= 128 THEN 'directional_edge' WHEN noise >= 7 AND v < 64 THEN 'noisy'
  WHEN v >= 64 AND entropy >= 150 THEN 'texture' WHEN v < 12 AND edge < 13 THEN 'flat' WHEN edge < 26 THEN 'gradient' WHEN c >= 96 THEN 'chroma_critical' ELSE 'texture' END AS region FROM m)"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = F.col("v"), F.col("c")
    made = {"edge": c * 3 % 97, "entropy": v * 7 % 200, "dominance": v * 11 % 256, "aligned": v * 5 % 256, "noise": c % 11}
    rows = _cells(spark, sf_dir).withColumns(made)
    return rows.withColumn("region", offsets.region_class(v, *[F.col(x) for x in ("edge", "entropy", "dominance", "aligned", "noise", "c")]))


@_query(f"""WITH {_REGIONS} SELECT p_partkey, region, CAST(greatest(least(edge // 2 + greatest(entropy, aligned) + CASE WHEN region IN ('directional_edge', 'text_like') THEN 96 WHEN region = 'texture' THEN 32 ELSE 0 END
  - CASE WHEN noise >= 7 THEN 96 ELSE 0 END, 256), 0) AS INTEGER) AS importance FROM r""")
def cls4_region_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _regions(spark, sf_dir)
    return rows.select("p_partkey", "region", offsets.importance(*[F.col(x) for x in ("edge", "entropy", "aligned", "noise", "region")]).alias("importance"))


_CLASSES = ["flat", "gradient", "text_like", "directional_edge", "texture", "noisy", "chroma_critical"]


@_query(f"WITH {_REGIONS} SELECT p_brand, {', '.join(f'''count(*) FILTER (region = '{c}') AS n_{c}''' for c in _CLASSES)} FROM r GROUP BY ALL")
def agg20_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.histogram(_regions(spark, sf_dir), ["p_brand"], "region", _CLASSES)


@_query("""WITH d AS (SELECT l_orderkey, count(*) AS pu, 100.0 * count(*) FILTER (l_returnflag = 'N') / count(*) AS ang, 100.0 * count(*) FILTER (l_linestatus = 'O') / count(*) AS tu4, avg(l_quantity) / 10 AS m, avg(l_discount) AS nz, avg(l_tax) * 5000 AS e FROM lineitem GROUP BY ALL),
s AS (SELECT *, (pu > 8)::INT + (pu > 16)::INT + (ang > 60)::INT + (tu4 > 20)::INT + (tu4 > 40)::INT + (round(m, 9) < 3.4)::INT + (round(m, 9) < 3.0)::INT + (round(nz, 9) > 0.08)::INT + (round(nz, 9) > 0.22)::INT + (round(e, 9) > 80)::INT + (round(e, 9) > 300)::INT AS score FROM d),
c AS (SELECT l_orderkey, CASE WHEN score <= 2 THEN 'smooth' WHEN score >= 6 THEN 'texture' ELSE 'mid' END AS decision, CASE WHEN pu < 3 THEN 'smooth' WHEN pu > 5 THEN 'textured' ELSE 'mid' END AS source FROM s)
SELECT l_orderkey, decision, CASE source WHEN 'smooth' THEN -2 WHEN 'textured' THEN 2 ELSE 0 END + CASE decision WHEN 'smooth' THEN -1 WHEN 'texture' THEN 1 ELSE 0 END AS "offset" FROM c""")
def cls3_decision_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, pct = F.count(F.lit(1)), lambda c: F.count_if(c) * 100.0 / F.count(F.lit(1))
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        n.alias("pu"), pct(F.col("l_returnflag") == "N").alias("ang"), pct(F.col("l_linestatus") == "O").alias("tu4"),
        F.round(F.avg("l_quantity") / 10, 9).alias("m"), F.round(F.avg("l_discount"), 9).alias("nz"), F.round(F.avg("l_tax") * 5000, 9).alias("e"),
    )
    f = f.withColumn("decision", offsets.decision_class(*[F.col(x) for x in ("pu", "ang", "tu4", "m", "nz", "e")]))
    source = F.when(F.col("pu") < 3, "smooth").when(F.col("pu") > 5, "textured").otherwise("mid")
    return f.select("l_orderkey", "decision", offsets.signal_offset(source, F.col("decision")).alias("offset"))


@_query("SELECT p_partkey, CASE WHEN p_size BETWEEN 2 AND 9 THEN 'H' WHEN p_size BETWEEN 10 AND 25 THEN 'D' WHEN p_size BETWEEN 26 AND 34 THEN 'V' END AS family, CAST(greatest(least(p_size - 2, 4), 0) AS INTEGER) AS bucket FROM part")
def cls5_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.angular_family(F.col("p_size")).alias("family"), scalars.size_bucket(F.col("p_size")).cast("int").alias("bucket"))


@_query(r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'bpg' WHEN regexp_matches(lower(f), '[^/]\.hei[cf]$') THEN 'heic' ELSE 'bpg' END AS container
FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.HEIC' WHEN 1 THEN '.heif' WHEN 2 THEN '.bpg' ELSE '' END AS f FROM pages)""")
def cls10_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    output = F.concat("url", F.when(i % 4 == 0, ".HEIC").when(i % 4 == 1, ".heif").when(i % 4 == 2, ".bpg").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", offsets.container(F.when(i % 3 == 0, "bpg").otherwise("auto"), output).alias("container"))


@_query(f"WITH {_CELLS} SELECT p_partkey, CAST(greatest(least(round_even(v / 32.0 - 4.5, 0) + 1, 4), -4) AS INTEGER) AS \"offset\" FROM cells")
def fn13_map_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("p_partkey", offsets.map_offset(F.col("v") / 32.0 - 4.5, 1, 4).alias("offset"))


@_query("SELECT o_custkey, round(var_pop(o_totalprice), 2) AS variance FROM orders GROUP BY ALL")
def fn14_population_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.var_pop("o_totalprice"), 2).alias("variance"))


# Reports.
_LINES = "i AS (SELECT *, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS INTEGER) % 3 AS plane, CAST(l_suppkey % 4 + 2 AS INTEGER) AS lg FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns({"q": F.col("l_quantity").cast("long"), "plane": F.col("l_linenumber") % 3, "lg": (F.col("l_suppkey") % 4 + 2).cast("int")})


@_query(f"""WITH {_LINES} SELECT l_returnflag, coalesce(sum(q) FILTER (plane = 0), 0)::BIGINT AS luma_q, coalesce(sum(q) FILTER (plane <> 0), 0)::BIGINT AS chroma_q,
  round(coalesce(sum(q) FILTER (plane = 0), 0) * 100.0 / sum(q), 6) AS luma_q_pct FROM i GROUP BY ALL""")
def agg13_plane_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.plane_totals(_lines(spark, sf_dir), ["l_returnflag"], "plane", ["q"])


@_query(f"WITH {_LINES} SELECT l_returnflag, lg, count(*) AS n FROM i GROUP BY ALL")
def agg14_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.histogram(_lines(spark, sf_dir), ["l_returnflag"], "lg")


@_query(f"WITH {_LINES} SELECT l_linestatus, lg, count(*) AS n, sum(q)::BIGINT AS sum_q, round(sum(q) / sum(pow(4, lg)), 6) AS q_per_px FROM i GROUP BY ALL")
def agg15_size_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.size_dump(_lines(spark, sf_dir), ["l_linestatus"], "lg", ["q"])


@_query(f"WITH {_LINES} SELECT l_returnflag, l_partkey // 32 AS cx, l_suppkey // 32 AS cy, sum(abs(q - 25))::BIGINT AS energy, sum(l_linenumber)::BIGINT AS bits FROM i GROUP BY ALL")
def agg21_cell_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.cell_sums(_lines(spark, sf_dir), ["l_returnflag"], "l_partkey", "l_suppkey", 32, {"energy": F.abs(F.col("q") - 25), "bits": F.col("l_linenumber").cast("long")})


@_query(f"WITH {_LINES} SELECT l_returnflag, l_partkey // 32 AS cx, l_suppkey // 32 AS cy, sum((q - l_linenumber) * (q - l_linenumber))::BIGINT AS sse FROM i GROUP BY ALL")
def agg22_cell_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.squared_error(_lines(spark, sf_dir), ["l_returnflag"], "l_partkey", "l_suppkey", 32, "q", "l_linenumber")


@_query(f"""WITH {_LINES} SELECT CASE grouping(l_returnflag) WHEN 0 THEN 'l_returnflag' ELSE CASE grouping(plane) WHEN 0 THEN 'plane' ELSE 'lg' END END AS dimension,
  CASE grouping(l_returnflag) WHEN 0 THEN l_returnflag ELSE CASE grouping(plane) WHEN 0 THEN plane::VARCHAR ELSE lg::VARCHAR END END AS value, count(*) AS n, count(*) FILTER (q > 25) AS large
FROM i GROUP BY GROUPING SETS ((l_returnflag), (plane), (lg))""")
def agg24_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.grouped_counts(_lines(spark, sf_dir), ["l_returnflag", "plane", "lg"], {"large": F.col("q") > 25})


@_query(f"""WITH {_LINES} SELECT l_returnflag, count(*) AS n, sum(q)::BIGINT AS total, coalesce(sum(q) FILTER (plane = 0), 0)::BIGINT AS sum_0, coalesce(sum(q) FILTER (plane = 1), 0)::BIGINT AS sum_1,
  coalesce(sum(q) FILTER (plane = 2), 0)::BIGINT AS sum_2 FROM i GROUP BY ALL""")
def agg25_work_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.work_histograms(_lines(spark, sf_dir), "l_returnflag", "plane", [0, 1, 2], "q")


@_query(f"""WITH {_LINES}, a AS (SELECT least(l_linenumber, 4)::VARCHAR AS children, l_returnflag AS region, lg::VARCHAR AS log2_size,
  (CASE WHEN l_discount < 0.02 THEN 0 WHEN l_discount < 0.05 THEN 1 WHEN l_discount < 0.1 THEN 2 WHEN l_discount < 0.25 THEN 3 WHEN l_discount < 0.5 THEN 4 ELSE 5 END)::VARCHAR AS margin_bucket FROM i),
u AS (UNPIVOT a ON children, region, log2_size, margin_bucket INTO NAME dimension VALUE value) SELECT dimension, value, count(*) AS n FROM u GROUP BY ALL""")
def agg26_split_aborts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.split_aborts(_lines(spark, sf_dir), "l_linenumber", "l_returnflag", "lg", "l_discount")


@_query(f"""WITH {_LINES}, d AS (SELECT l_returnflag, CASE WHEN plane = 0 THEN NULL ELSE q > 25 END AS nb, lg > 3 AS sp FROM i)
SELECT l_returnflag, count(nb) AS seen, count(*) FILTER (NOT nb) AS leaf, count(*) FILTER (nb) AS split, count(*) FILTER (nb = sp) AS matches FROM d GROUP BY ALL""")
def agg27_neighbour_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumns({"nb": F.when(F.col("plane") != 0, F.col("q") > 25), "sp": F.col("lg") > 3})
    return ledger.neighbour_prior(rows, ["l_returnflag"], "nb", "sp")


@_query(f"""WITH {_LINES} SELECT lg, sum(q)::BIGINT AS work, round(sum(q) * 100.0 / (SELECT sum(q) FROM i), 6) AS work_pct, coalesce((SELECT count(*) FROM part p WHERE p.p_size % 4 + 2 = lg), 0) AS cells FROM i GROUP BY ALL""")
def agg32_region_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").select((F.col("p_size") % 4 + 2).cast("int").alias("lg"))
    return ledger.region_table(_lines(spark, sf_dir), "lg", "q", cells)


@_query(f"""WITH {_LINES} SELECT l_returnflag, coalesce(sum(q) FILTER (lg = 2), 0)::BIGINT AS size_2, coalesce(sum(q) FILTER (lg = 3), 0)::BIGINT AS size_3, coalesce(sum(q) FILTER (lg = 4), 0)::BIGINT AS size_4,
  coalesce(sum(q) FILTER (lg = 5), 0)::BIGINT AS size_5 FROM i GROUP BY ALL""")
def agg33_region_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.region_by_size(_lines(spark, sf_dir), "l_returnflag", "lg", [2, 3, 4, 5], "q")


@_query(f"""WITH {_LINES}, d AS (SELECT l_returnflag, CASE WHEN plane <> 0 THEN q > 25 END AS flipped FROM i)
SELECT l_returnflag, count(flipped) AS known, round(coalesce(avg(flipped::INT) * 100, 0), 6) AS flip_pct FROM d GROUP BY ALL""")
def agg35_flip_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.flip_share(_lines(spark, sf_dir).withColumn("flipped", F.when(F.col("plane") != 0, F.col("q") > 25)), ["l_returnflag"])


@_query(f"""WITH {_LINES} SELECT l_returnflag, count(*) AS decisions, count(*) FILTER (plane = 0 AND NOT q > 25) AS lost, coalesce(sum(q) FILTER (plane = 0 AND NOT q > 25), 0)::BIGINT AS lost_work FROM i GROUP BY ALL""")
def agg36_split_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumns({"built": F.col("plane") == 0, "won": F.col("q") > 25})
    return ledger.split_waste(rows, "l_returnflag", "built", "won", "q")


@_query(f"""WITH {_LINES}, s AS (SELECT l_suppkey, sum(q) AS b, count(*) FILTER (plane = 0) AS luma FROM i WHERE lg > 2 GROUP BY ALL)
SELECT s_suppkey AS l_suppkey, round(coalesce(b, 0) / 8, 6) AS bytes, coalesce(luma, 0) AS luma FROM supplier LEFT JOIN s ON l_suppkey = s_suppkey""")
def agg37_heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    return ledger.heat_map(_lines(spark, sf_dir).where("lg > 2"), units, "l_suppkey", "q", {"luma": F.col("plane") == 0})


@_query("SELECT event_id, event_type, (SELECT greatest(count(*) - 100, 0) FROM events) AS truncated FROM events ORDER BY event_id LIMIT 100")
def agg39_events_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.first_events(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], 100)


@_query("SELECT c_nationkey, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean_c_acctbal FROM customer GROUP BY ALL")
def agg45_size_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.size_groups(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", ["c_acctbal"])


@_query("""WITH b AS (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT o_orderkey, o_custkey, s AS baseline_s FROM orders LEFT JOIN b USING (o_custkey)""")
def j18_first_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").withColumn("c_time", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    return ledger.first_baseline(runs, ["o_custkey"], ["o_orderkey"], "c_time").select("o_orderkey", "o_custkey", "baseline_s")


@_query("""WITH l AS (SELECT o_orderstatus, CAST(row_number() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS p, CAST(count(*) OVER () AS INTEGER) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders))
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN p ELSE n - 1 - p END AS turn FROM orders JOIN l USING (o_orderstatus)""")
def win7_alternate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.alternate_order(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus").select("o_orderkey", "turn")


@_query("""SELECT o_orderkey, o_totalprice * 8 / greatest(o_custkey, 1) AS bpp, o_totalprice * 1e6 / greatest(o_custkey, 1) AS bytes_per_mp, o_totalprice / greatest(o_orderkey, 1) AS trials FROM orders""")
def prj2_derived_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.derived_rates(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey", {"trials": ("o_totalprice", "o_orderkey")}).select("o_orderkey", "bpp", "bytes_per_mp", "trials")


@_query("""SELECT p_partkey, CAST((p_partkey * p_size + 2 * CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN ((p_partkey + 1) // 2) * ((p_size + 1) // 2) WHEN 2 THEN ((p_partkey + 1) // 2) * p_size ELSE p_partkey * p_size END) * 2
  + p_partkey * p_size * 4 + p_partkey * p_size // 8 AS BIGINT) AS bytes FROM part""")
def prj7_memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    chroma = F.when(k % 4 == 0, "gray").when(k % 4 == 1, "420").when(k % 4 == 2, "422").otherwise("444")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.memory_estimate(k, F.col("p_size"), chroma).alias("bytes"))


@_query("""SELECT p_partkey, CASE WHEN p_size <= 0 THEN 'empty' WHEN p_size > 40 THEN 'height' WHEN p_partkey * p_size > 20000 THEN 'pixels' WHEN p_retailprice > 1500 THEN 'memory' END AS reason,
  CASE WHEN p_size % 7 = 0 THEN 'animation' WHEN p_size % 5 = 0 THEN 'alpha' WHEN p_size % 3 = 0 THEN 'mpeg2 chroma siting' END AS unsupported FROM part WHERE p_partkey >= 10 AND p_partkey < 1010 AND p_size >= 3 AND p_size < 1003""")
def flt4_limits_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").where((k >= 10) & (k < 1010)).where(ledger.in_window(k - 7, s, 3, 3, 1000))
    reason = ledger.limit_reason(k, s, F.col("p_retailprice"), most_height=40, most_pixels=20_000, most_memory=1500)
    siting = F.when(s % 3 == 0, "mpeg2").otherwise("jpeg")
    return rows.select("p_partkey", reason.alias("reason"), ledger.unsupported_reason(s % 7 == 0, s % 5 == 0, siting).alias("unsupported"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber % 3 = 0")
def flt2_luma_of_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("plane") == 0))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@_query("""SELECT vec_id, vec_id % 3 <> 0 AS gray, len(list_filter(embedding, lambda x: x > 0)) > 0 AS nonopaque FROM embeddings""")
def flt7_gray_and_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = F.col("embedding"), F.col("vec_id")
    other = F.when(i % 3 == 0, F.transform(e, lambda x: x + 1)).otherwise(e)
    alpha = F.transform(e, lambda x: F.when(x > 0, F.lit(254)).otherwise(F.lit(255)))
    return table(spark, sf_dir, "embeddings").select("vec_id", ledger.is_gray(e, e, other).alias("gray"), ledger.has_nonopaque(alpha).alias("nonopaque"))


@_query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""")
def fn29_csv_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ledger.csv_field(F.col("text")).alias("field"))


@_query("SELECT c_nationkey AS variant, c_mktsegment AS setting FROM customer UNION ALL SELECT s_nationkey, NULL FROM supplier")
def set2_union_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("variant"), F.col("c_mktsegment").alias("setting"))
    return ledger.union_variants(a, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("variant")))


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top9_first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey", "o_totalprice")


@_query(f"WITH {_CELLS} SELECT p_partkey, round(-10 * log10((6 * pow(10, -(30.0 + c / 10.0) / 10) + pow(10, -(35.0 + c / 10.0) / 10) + pow(10, -(36.0 + v / 50.0) / 10)) / 8), 6) AS psnr, round(0.4 * (-10 * log10(greatest(1 - v / 300.0, 1e-6))) + 0.6 * least(30.0 + c, 99), 6) AS blend FROM cells")
def agg42_blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = F.col("v"), F.col("c")
    psnr = scalars.blended_psnr(F.lit(30.0) + c / 10, F.lit(35.0) + c / 10, F.lit(36.0) + v / 50)
    return _cells(spark, sf_dir).select("p_partkey", F.round(psnr, 6).alias("psnr"), F.round(scalars.blended_quality(v / 300, F.lit(30.0) + c, 0.4), 6).alias("blend"))


@_query(f"WITH {_CELLS} SELECT p_partkey, round(CASE WHEN v = 5 THEN 35.0 ELSE 30 + 10 * greatest(least((ln(1.0 + c) - ln(5.0)) / (ln(5.0 + abs(v - 5)) - ln(5.0)), 1), 0) END, 6) AS quality FROM cells")
def fn9_log_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.lit(5.0) + F.abs(F.col("v") - 5)
    return _cells(spark, sf_dir).select("p_partkey", F.round(scalars.interpolate_log_rate(F.lit(1.0) + F.col("c"), F.lit(5.0), F.lit(30.0), end, F.lit(40.0)), 6).alias("quality"))


@_query(f"WITH {_CELLS} SELECT p_partkey, CAST((v % 256 * 2126 + c * 7152 + v * c % 256 * 722 + 5000) // 10000 AS INTEGER) AS luma709, round((v % 256 * 0.299 + c * 0.587 + v * c % 256 * 0.114)::DOUBLE, 6) AS luma601 FROM cells")
def fn23_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = F.col("v") % 256, F.col("c"), F.col("v") * F.col("c") % 256
    return _cells(spark, sf_dir).select("p_partkey", scalars.luma_bt709(r, g, b).alias("luma709"), F.round(scalars.luma_bt601(r, g, b), 6).alias("luma601"))


@_query("SELECT p_partkey, CASE WHEN p_size % 4 IN (1, 3) THEN p_size ELSE p_partkey END AS w, CASE WHEN p_size % 4 IN (1, 3) THEN p_partkey ELSE p_size END AS h FROM part")
def fn27_transformed_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.when(F.col("p_size") % 4 == 1, F.array(F.lit("rot90"))).when(F.col("p_size") % 4 == 3, F.array(F.lit("mirror"), F.lit("rot270"))).otherwise(F.array(F.lit("rot90"), F.lit("rot270")))
    size = scalars.transformed_size(F.col("p_partkey"), F.col("p_size").cast("long"), turns)
    return table(spark, sf_dir, "part").select("p_partkey", size["w"].alias("w"), size["h"].alias("h"))


@_query("""SELECT c_nationkey, sum(c_custkey)::BIGINT AS c_custkey, [sum(c_custkey % 2)::BIGINT, sum(c_custkey % 3)::BIGINT] AS h FROM customer GROUP BY ALL""")
def agg16_merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("h", F.array(F.col("c_custkey") % 2, F.col("c_custkey") % 3))
    return blocks.merge_counters(rows, ["c_nationkey"], ["c_custkey"], ["h"])


@_query("""WITH a AS (SELECT l_partkey * 8 AS x, l_suppkey * 8 AS y, CAST(l_linenumber % 3 + 3 AS INTEGER) AS lg, l_returnflag AS f FROM lineitem), s AS (
SELECT f, cx, cy, arg_max(lg, y * 1000000000000 + x * 100 + lg) AS lg FROM (SELECT f, y, x, lg, unnest(range(CAST(ceil((x - 8) / 16.0) AS BIGINT), CAST(ceil((x + pow(2, lg) - 8) / 16.0) AS BIGINT))) AS cx, q.cy FROM a,
  LATERAL (SELECT unnest(range(CAST(ceil((y - 8) / 16.0) AS BIGINT), CAST(ceil((y + pow(2, lg) - 8) / 16.0) AS BIGINT))) AS cy) q) GROUP BY ALL)
SELECT a.cx, a.cy, a.lg AS size_a, b.lg AS size_b FROM s a JOIN s b USING (cx, cy) WHERE a.f = 'A' AND b.f = 'R'""")
def j12_size_map_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 8).alias("x"), (F.col("l_suppkey") * 8).alias("y"), (F.col("l_linenumber") % 3 + 3).cast("int").alias("lg"), "l_returnflag")
    return grid.size_map_pairs(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"), [], "x", "y", "lg")


@_query("""WITH b AS (SELECT p_partkey, p_partkey % (SELECT count(*) FROM embeddings) AS image, CAST(p_size % 8 AS INTEGER) AS x, CAST(p_partkey % 8 AS INTEGER) AS y, 4 AS size FROM part),
m AS (SELECT vec_id, embedding[k]::DOUBLE AS v, (k - 1) % 8 AS px, (k - 1) // 8 AS py FROM embeddings, (SELECT unnest(range(1, 65)) AS k))
SELECT p_partkey, round(var_pop(v), 6) AS variance FROM b JOIN m ON vec_id = image AND px >= x AND px < x + size AND py >= y AND py < y + size GROUP BY p_partkey""")
def j6_block_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    count = table(spark, sf_dir, "embeddings").count()
    rows = table(spark, sf_dir, "part").select("p_partkey", (k % count).alias("image"), (F.col("p_size") % 8).cast("int").alias("x"), (k % 8).cast("int").alias("y"), F.lit(4).alias("size"))
    pictures = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("embedding", lambda v: v.cast("double")).alias("samples"))
    return grid.block_variances(rows, pictures, "image", "x", "y", "size").where("variance IS NOT NULL").select("p_partkey", F.round("variance", 6).alias("variance"))


_RUNS = "c AS (SELECT substr(p_brand, 7, 1) || '-' || substr(p_brand, 8, 1) AS curve, substr(p_brand, 7, 1) AS encoder, p_size::DOUBLE AS r, round(avg(p_retailprice), 4) AS q FROM part GROUP BY ALL)"


@_query(f"""WITH {_RUNS}, k AS (SELECT curve, encoder, count(*) AS n FROM c GROUP BY ALL), {_bd_sql("SELECT curve, q, r FROM c", "SELECT b.curve AS a, a.curve AS b, least(a.n, b.n) AS points FROM k a, k b WHERE a.encoder <> '1' AND b.encoder = '1'")}
SELECT 'all' AS image, m.b AS test, m.a AS ref, points, 'quality' AS metric, round(CASE WHEN m.hi > m.lo THEN (10 ** apart - 1) * 100 END, 6) AS bd_rate_pct FROM m LEFT JOIN d USING (a, b)""")
def j3_bd_rate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumns({"encoder": F.substring("p_brand", 7, 1), "setting": F.substring("p_brand", 8, 1), "rate": F.col("p_size").cast("double")})
    curve = rows.groupBy("encoder", "setting", "rate").agg(F.round(F.avg("p_retailprice"), 4).alias("quality")).withColumn("image", F.lit("all"))
    out = sweep.bd_rate_pairs(curve, ["image"], "encoder", "setting", "1", "rate", ["quality"])
    return out.withColumn("bd_rate_pct", F.round("bd_rate_pct", 6))


@_query("""WITH m AS (SELECT o_orderkey, o_orderpriority, o_totalprice, avg(log2(1 + o_totalprice)) OVER (PARTITION BY o_orderpriority) AS a FROM orders)
SELECT o_orderkey, CAST(greatest(least(round(-2.0 * (log2(1 + o_totalprice) - a)), 6), -6) AS INTEGER) AS "offset" FROM m""")
def fn2_variance_offsets_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.variance_offsets(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 2.0, 6, perceptual=False).select("o_orderkey", "offset")


@_query(f"""WITH {_CELLS} SELECT p_partkey, round(pow(256.0 * v + CASE p_partkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 64.0 WHEN 2 THEN 128.0 ELSE 256.0 END * c + 1, 0.1), 6) AS root FROM cells""")
def fn6_energy_root_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    fmt = F.when(k == 0, "gray").when(k == 1, "420").when(k == 2, "422").when(k == 3, "444")
    return _cells(spark, sf_dir).select("p_partkey", F.round(offsets.energy_root(F.col("v"), F.col("c"), offsets.chroma_weight(fmt)), 6).alias("root"))


@_query("""WITH g AS (SELECT p_partkey % 9 AS cx, p_partkey // 9 % 7 AS cy, max(p_size) AS o FROM part GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o AS "offset" FROM lineitem LEFT JOIN g ON cx = least(l_partkey % 400 // 32, 8) AND cy = least(l_suppkey * 3 // 32, 6)""")
def j17_offset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    cells = part.groupBy((F.col("p_partkey") % 9).alias("cx"), (F.floor(F.col("p_partkey") / 9) % 7).alias("cy")).agg(F.max("p_size").alias("offset"))
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 400).alias("x"), (F.col("l_suppkey") * 3).alias("y"))
    return grid.clamped_lookup(points, cells, "x", "y", 32, 9, 7, "offset").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "offset")


@_query("""WITH b AS (SELECT p_partkey, [p_partkey % 7, p_size % 5, p_partkey % 3, p_size] AS b FROM part), t AS (SELECT p_partkey, b, list_sum(b) AS t FROM b)
SELECT p_partkey, CAST(CASE WHEN t = 0 THEN 0 ELSE round(-list_sum(list_transform(b, lambda x: CASE WHEN x > 0 THEN x / t * log2(x / t) ELSE 0 END)) / 2 * 256) END AS INTEGER) AS entropy FROM t""")
def fn12_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.entropy_q8(F.array(k % 7, s % 5, k % 3, s)).alias("entropy"))


@_query("""WITH l AS (SELECT c_custkey AS line, c_nationkey * 40 AS x, c_custkey % 300 AS y, CAST(floor(c_acctbal) AS INTEGER) % 30 AS o, c_custkey % 11 = 0 AS bad FROM customer),
p AS (SELECT line, least(x // 32, 19) AS cx, least(y // 32, 5) AS cy, greatest(least(o, 12), -12) AS o FROM l WHERE NOT bad AND line % 13 <> 0)
SELECT cx, cy, CAST(arg_max(o, line) AS INTEGER) AS "offset" FROM p GROUP BY ALL""")
def src30_offset_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o = F.col("c_custkey"), F.floor("c_acctbal").cast("int") % 30
    line = F.concat_ws(",", F.col("c_nationkey") * 40, k % 300, F.when(k % 11 == 0, F.lit("none")).otherwise(o.cast("string")))
    text = F.when(k % 13 == 0, F.concat(F.lit("# "), line)).when(k % 5 == 0, F.concat(F.replace(line, F.lit(","), F.lit("  ")), F.lit(" # why"))).otherwise(line)
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line"), text.alias("value"))
    return grid.parse_offsets(lines, 32, 20, 6)


@_query("""SELECT o_orderkey, o_custkey::DOUBLE AS waits, CASE WHEN o_orderkey % 3 > 0 THEN round(o_totalprice, 2) END AS total_us FROM orders""")
def src27_counters_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.format_string("%.2f", F.round("o_totalprice", 2))
    text = F.concat(F.lit("[run] waits="), F.col("o_custkey"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(", total_us : "), price)).otherwise(F.lit(" subtotal_us=7")))
    return results.counters_from_text(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("value")), ["waits", "total_us"])


@_query("""WITH n AS (SELECT p_partkey, ['off', 'LEGACY', 'autovar', 'two-pass', 'nothing'][p_size % 5 + 1] AS name FROM part)
SELECT p_partkey, CASE name WHEN 'off' THEN 'off' WHEN 'LEGACY' THEN 'legacy_shrink' WHEN 'autovar' THEN 'auto_variance' WHEN 'two-pass' THEN 'two_pass_measured' END AS mode,
  CASE name WHEN 'off' THEN 0.0 WHEN 'LEGACY' THEN 0.0 WHEN 'autovar' THEN 1.0 WHEN 'two-pass' THEN 1.0 END::DOUBLE AS strength, CASE name WHEN 'off' THEN 2 WHEN 'LEGACY' THEN 8 WHEN 'autovar' THEN 6 WHEN 'two-pass' THEN 4 END::INTEGER AS clamp FROM n""")
def fn10_preset_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("off", "LEGACY", "autovar", "two-pass", "nothing")))
    found = table(spark, sf_dir, "part").select("p_partkey", offsets.preset_of(F.get(names, F.col("p_size") % 5)).alias("p"))
    return found.select("p_partkey", "p.mode", "p.strength", "p.clamp")
