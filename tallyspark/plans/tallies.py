"""Schedule tallies over ``lineitem``, ``part`` and ``orders``.

A line item is a schedule row: its part's size snapped to a standard diameter, its quantity and its
price as a length in mm.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import calc as C
from tallyspark.functions import text as T
from tallyspark.operators import tally as Y
from tallyspark.operators.rules import Rule, findings, first_and_more
from tallyspark.sources.tables import table

SIZES_SQL = "[6, 8, 10, 12, 16, 20, 25, 32]"
SNAP_SQL = f"""CASE WHEN list_min(list_transform({SIZES_SQL}, lambda s: abs(p_size - s))) <= 2
    THEN list_min(list_filter({SIZES_SQL}, lambda s: abs(p_size - s) = list_min(list_transform({SIZES_SQL}, lambda z: abs(p_size - z))))) END"""
SCHED = f"""WITH sched AS (SELECT {SNAP_SQL} AS dia, p_brand AS panel, l_quantity AS qty, l_extendedprice AS len_mm, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
    CAST({SNAP_SQL} AS DOUBLE) * CAST({SNAP_SQL} AS DOUBLE) / 162.0::DOUBLE * l_extendedprice / 1000 AS wt FROM lineitem JOIN part ON l_partkey = p_partkey) """


def sched(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    dia = C.snap_diameter(F.col("p_size"))
    rows = rows.withColumns({"dia": dia, "panel": F.col("p_brand"), "qty": F.col("l_quantity"), "len_mm": F.col("l_extendedprice")})
    return rows.withColumn("wt", C.bar_weight(F.col("dia").cast("double"), F.col("len_mm")))


def sched_by_dia(spark, sf_dir):
    out = Y.tally(sched(spark, sf_dir), "dia", {"sum_qty": F.col("qty"), "sum_len": F.col("len_mm"), "sum_wt": F.col("wt")}, "n_rows")
    return out.select("dia", F.round("sum_qty", 2).alias("sum_qty"), F.round("sum_len", 2).alias("sum_len"), F.round("sum_wt", 2).alias("sum_wt"), "n_rows")


def sched_rollup_panel(spark, sf_dir):
    out = Y.rollup_totals(sched(spark, sf_dir), ["panel"], {"sum_wt": F.col("wt"), "sum_qty": F.col("qty")})
    return out.select("panel", F.round("sum_wt", 2).alias("sum_wt"), F.round("sum_qty", 2).alias("sum_qty"))


def sched_rollup_dia(spark, sf_dir):
    rows = sched(spark, sf_dir).where("dia is not null")
    out = Y.rollup_totals(rows, ["dia"], {"sum_wt": F.col("wt")}, "ALL")
    return out.select("dia", F.round("sum_wt", 2).alias("sum_wt"))


def census_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    return Y.census(rows, [["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus"]], ["l_returnflag", "l_linestatus"])


def status_cube(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("long").alias("grouping_id"), F.count(F.lit(1)).alias("n"))


def _two_sides(spark, sf_dir):
    left = Y.tally(table(spark, sf_dir, "lineitem"), "l_orderkey", {"line_price": F.col("l_extendedprice"), "line_qty": F.col("l_quantity")}).withColumnRenamed("l_orderkey", "orderkey")
    right = Y.tally(table(spark, sf_dir, "orders"), "o_orderkey", {"order_price": F.col("o_totalprice")}).withColumnRenamed("o_orderkey", "orderkey")
    return Y.full_outer(left, right, "orderkey")


def tally_full_outer(spark, sf_dir):
    return _two_sides(spark, sf_dir).select("orderkey", F.round("line_price", 2).alias("line_price"), F.round("line_qty", 2).alias("line_qty"), F.round("order_price", 2).alias("order_price"))


def tally_tolerance(spark, sf_dir):
    out = Y.compare(_two_sides(spark, sf_dir), "line_price", "order_price", 4.0, 0.25)
    return out.select("orderkey", F.round("delta", 2).alias("delta"), "ok", "status")


def _official(spark, sf_dir):
    rows = sched(spark, sf_dir)
    found = Y.tally(rows.where("l_linenumber <= 4 and dia <> 6"), "dia", {"recon": F.col("wt")})
    official = Y.tally(rows.where("dia <> 32"), "dia", {"official": F.col("wt")})
    return Y.full_outer(found, official, "dia")


def tally_official_pct(spark, sf_dir):
    out = _official(spark, sf_dir)
    gap = F.col("recon") - F.col("official")
    return out.select(T.diameter_label(F.col("dia")).alias("label"), F.round("recon", 2).alias("recon"), F.round("official", 2).alias("official"), F.round(gap, 2).alias("gap"), F.round(C.percent(F.col("recon"), F.col("official")), 4).alias("pct"), F.when((F.col("official") == 0) & (F.col("recon") > 0), "extra").when(F.col("official") == 0, "-").otherwise(Y.status(gap)).alias("status"))


def report_recheck(spark, sf_dir):
    rows = sched(spark, sf_dir).where("dia is not null")
    # the printed report states its rows in whole tonnes
    both = rows.groupBy("panel", "dia").agg(F.sum("wt").alias("computed"), (F.round(F.sum("wt") / 1000, 0) * 1000).alias("printed"))
    return both.select("panel", "dia", Y.report_status(F.round("printed", 2), F.round("computed", 2)).alias("status"))


def row_arith_check(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    unit = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 0)
    total = unit * F.col("l_quantity")
    ok = C.near(total, F.col("l_extendedprice"), 4.0) & C.near(F.col("l_discount") + F.col("l_tax"), F.lit(0.08), 0.05)
    return rows.groupBy("l_returnflag").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_bad"), F.count(F.lit(1)).alias("n_rows"))


def grand_total_check(spark, sf_dir):
    rows = sched(spark, sf_dir).where("dia is not null").select("panel", "dia", "wt")
    summary = rows.where("panel <> 'Brand#3'").groupBy("panel").agg((F.sum("wt") * 1.002).alias("wt")).withColumn("dia", F.lit(None).cast("int"))
    grand = Y.grand_total(rows, summary, "panel", "wt")
    by_panel = rows.groupBy("panel").agg(F.sum("wt").alias("dia_sum"))
    both = by_panel.join(grand, "panel")
    return both.select("panel", F.round("wt", 2).alias("grand"), C.near(F.col("dia_sum"), F.col("wt"), 0.15, 0.01).alias("ok"))


def conf_split(spark, sf_dir):
    out = Y.confidence_split(sched(spark, sf_dir).where("dia is not null"), "dia", F.col("wt"), F.col("l_returnflag").isin("R", "A"))
    return out.select("dia", *(F.round(c, 2).alias(c) for c in ("low_wt", "high_wt", "total_wt")))


def conf_flag(spark, sf_dir):
    rows = sched(spark, sf_dir).where("dia is not null")
    official = rows.groupBy("panel").agg((F.sum("wt") * F.when(F.length("panel") > 7, 1.02).otherwise(1.2)).alias("official"))
    split = Y.confidence_split(rows, "panel", F.col("wt"), F.col("l_returnflag").isin("R", "A")).join(official, "panel")
    return Y.suspicious_matches(split, "official").select("panel", F.round("total_wt", 2).alias("total_wt"))


def notes_set(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("notes"))


def top_freq_50(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "l_partkey").limit(50)


def first_20_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("text")).distinct()
    return rows.orderBy("text").limit(20)


def overflow_report(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return first_and_more(rows, "c_nationkey", "c_custkey", 5)


def need_by_key(spark, sf_dir):
    rows = sched(spark, sf_dir).where("dia is not null")
    return rows.groupBy("dia").agg(F.round(F.sum(F.col("wt") * F.col("qty")), 0).alias("need_kg"), F.max("qty").alias("max_qty"))


def fragment_limits(spark, sf_dir):
    rows = sched(spark, sf_dir).where("dia is not null")
    bent = F.when(F.col("l_linenumber") > 3, F.col("len_mm"))
    return rows.groupBy("dia").agg(F.round(F.max(bent) * 1.15, 4).alias("ceiling"), F.round(F.min("len_mm") * 0.5, 4).alias("floor"), F.bool_or(F.col("l_linestatus") == "F").alias("dowel_only"))


def median_consensus(spark, sf_dir):
    out = Y.consensus_median(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return out.select("l_suppkey", F.round("consensus", 4).alias("consensus"), "n_agreeing")


def weighted_mean_dia(spark, sf_dir):
    rows = sched(spark, sf_dir).where("dia is not null")
    return rows.groupBy("panel").agg(F.round(F.sum(F.col("dia") * F.col("len_mm")) / F.sum("len_mm"), 6).alias("mean_dia"))


def two_level_max_sum(spark, sf_dir):
    rows = sched(spark, sf_dir)
    inner = rows.groupBy("panel", "l_returnflag", "l_linestatus").agg(F.sum("qty").alias("s"))
    return inner.groupBy("panel").agg(F.max("s").alias("true_count"))


def report_status_counts(spark, sf_dir):
    out = Y.compare(_two_sides(spark, sf_dir), "line_price", "order_price", 4.0, 0.25)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def best_source_per_group(spark, sf_dir):
    counts = sched(spark, sf_dir).groupBy("panel", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("panel").agg(F.min(F.struct((-F.col("n")).alias("less"), "l_suppkey")).alias("b"))
    return best.select("panel", F.col("b.l_suppkey").alias("suppkey"), (-F.col("b.less")).alias("n"))


def viewer_totals(spark, sf_dir):
    rows = sched(spark, sf_dir).where("dia is not null")
    measured = F.col("l_linestatus") == "F"
    return rows.groupBy("panel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("len_mm"), 2).alias("len_mm"), F.round(100.0 * F.count_if(measured) / F.count(F.lit(1)), 4).alias("pct_measured"))


def predicted_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("text")).agg(F.count(F.lit(1)).alias("instances"), F.max("p_size").alias("per_run"))
    return rows.select("text", "instances", (F.col("instances") * F.col("per_run")).alias("predicted"))


def rules_findings(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    rules = [
        Rule("price_low", "ERROR", F.col("o_totalprice") < 2000),
        Rule("price_high", "WARN", F.col("o_totalprice") > 450000),
        Rule("late_open", "WARN", (F.col("o_orderstatus") == "O") & (F.year("o_orderdate") < 1996)),
    ]
    return findings(rows, rules, "o_orderkey")


QUERIES = {f.__name__: f for f in (sched_by_dia, sched_rollup_panel, sched_rollup_dia, census_sets, status_cube, tally_full_outer, tally_tolerance, tally_official_pct, report_recheck, row_arith_check, grand_total_check, conf_split, conf_flag, notes_set, top_freq_50, first_20_distinct, overflow_report, need_by_key, fragment_limits, median_consensus, weighted_mean_dia, two_level_max_sum, report_status_counts, best_source_per_group, viewer_totals, predicted_rows, rules_findings)}

TWO = """WITH l AS (SELECT l_orderkey AS k, SUM(l_extendedprice) AS line_price, SUM(l_quantity) AS line_qty FROM lineitem GROUP BY 1),
    o AS (SELECT o_orderkey AS k, SUM(o_totalprice) AS order_price FROM orders GROUP BY 1),
    two AS (SELECT COALESCE(l.k, o.k) AS orderkey, COALESCE(line_price, 0) AS line_price, COALESCE(line_qty, 0) AS line_qty, COALESCE(order_price, 0) AS order_price FROM l FULL JOIN o ON l.k = o.k),
    cmp AS (SELECT orderkey, line_price - order_price AS delta, abs(line_price - order_price) <= GREATEST(4.0::DOUBLE, 0.25::DOUBLE * GREATEST(abs(line_price), abs(order_price))) AS ok FROM two)
"""
OFFICIAL = SCHED + """, f AS (SELECT dia, SUM(wt) AS recon FROM sched WHERE l_linenumber <= 4 AND dia <> 6 GROUP BY 1), o AS (SELECT dia, SUM(wt) AS official FROM sched WHERE dia <> 32 GROUP BY 1),
    both_ AS (SELECT COALESCE(f.dia, o.dia) AS dia, COALESCE(recon, 0) AS recon, COALESCE(official, 0) AS official FROM f FULL JOIN o ON f.dia = o.dia) """

ORACLES = {
    "sched_by_dia": SCHED + "SELECT dia, ROUND(SUM(qty), 2) AS sum_qty, ROUND(SUM(len_mm), 2) AS sum_len, ROUND(SUM(wt), 2) AS sum_wt, COUNT(*) AS n_rows FROM sched WHERE dia IS NOT NULL GROUP BY dia",
    "sched_rollup_panel": SCHED + "SELECT CASE WHEN GROUPING(panel) = 1 THEN 'TOTAL' ELSE panel END AS panel, ROUND(SUM(wt), 2) AS sum_wt, ROUND(SUM(qty), 2) AS sum_qty FROM sched GROUP BY ROLLUP(panel)",
    "sched_rollup_dia": SCHED + "SELECT CASE WHEN GROUPING(dia) = 1 THEN 'ALL' ELSE CAST(dia AS VARCHAR) END AS dia, ROUND(SUM(wt), 2) AS sum_wt FROM sched WHERE dia IS NOT NULL GROUP BY ROLLUP(dia)",
    "census_sets": "SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus) AS grouping_id, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))",
    "status_cube": "SELECT o_orderstatus, o_orderpriority, GROUPING(o_orderstatus, o_orderpriority) AS grouping_id, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "tally_full_outer": TWO + "SELECT orderkey, ROUND(line_price, 2) AS line_price, ROUND(line_qty, 2) AS line_qty, ROUND(order_price, 2) AS order_price FROM two",
    "tally_tolerance": TWO + "SELECT orderkey, ROUND(delta, 2) AS delta, ok, CASE WHEN ok THEN 'OK' WHEN delta < 0 THEN 'SHORT' WHEN delta > 0 THEN 'OVER' ELSE 'OK' END AS status FROM cmp",
    "tally_official_pct": OFFICIAL + "SELECT 'T' || dia AS label, ROUND(recon, 2) AS recon, ROUND(official, 2) AS official, ROUND(recon - official, 2) AS gap, CASE WHEN official <> 0 THEN ROUND(100.0 * recon / official, 4) END AS pct, CASE WHEN official = 0 AND recon > 0 THEN 'extra' WHEN official = 0 THEN '-' WHEN recon < official THEN 'SHORT' WHEN recon > official THEN 'OVER' ELSE 'OK' END AS status FROM both_",
    "report_recheck": SCHED + """, c AS (SELECT panel, dia, SUM(wt) AS computed FROM sched WHERE dia IS NOT NULL GROUP BY 1, 2), p AS (SELECT panel, dia, ROUND(computed / 1000, 0) * 1000 AS printed FROM c)
        SELECT c.panel, c.dia, CASE WHEN printed IS NULL THEN 'MISSING_IN_REPORT' WHEN abs(ROUND(printed, 2) - ROUND(computed, 2)) <= GREATEST(0.02::DOUBLE, 0.005::DOUBLE * GREATEST(abs(ROUND(printed, 2)), abs(ROUND(computed, 2)))) THEN 'OK' ELSE 'MISMATCH' END AS status FROM c LEFT JOIN p ON c.panel = p.panel AND c.dia = p.dia""",
    "row_arith_check": """WITH r AS (SELECT *, abs(ROUND(l_extendedprice / l_quantity, 0) * l_quantity - l_extendedprice) <= 4.0 AND abs(l_discount + l_tax - 0.08::DOUBLE) <= 0.05::DOUBLE AS ok FROM lineitem)
        SELECT l_returnflag, COUNT(*) FILTER (WHERE ok) AS n_ok, COUNT(*) FILTER (WHERE NOT ok) AS n_bad, COUNT(*) AS n_rows FROM r GROUP BY 1""",
    "grand_total_check": SCHED + """, r AS (SELECT panel, SUM(wt) AS s FROM sched WHERE dia IS NOT NULL GROUP BY 1), g AS (SELECT panel, s, CASE WHEN panel <> 'Brand#3' THEN s * 1.002::DOUBLE ELSE s END AS wt FROM r)
        SELECT panel, ROUND(wt, 2) AS grand, abs(s - wt) <= GREATEST(0.15::DOUBLE, 0.01::DOUBLE * GREATEST(abs(s), abs(wt))) AS ok FROM g""",
    "conf_split": SCHED + "SELECT dia, ROUND(COALESCE(SUM(wt) FILTER (WHERE l_returnflag IN ('R','A')), 0), 2) AS low_wt, ROUND(COALESCE(SUM(wt) FILTER (WHERE l_returnflag NOT IN ('R','A')), 0), 2) AS high_wt, ROUND(SUM(wt), 2) AS total_wt FROM sched WHERE dia IS NOT NULL GROUP BY dia",
    "conf_flag": SCHED + """, s AS (SELECT panel, SUM(wt) AS total_wt, SUM(wt) FILTER (WHERE l_returnflag IN ('R','A')) AS low_wt, SUM(wt) * CASE WHEN length(panel) > 7 THEN 1.02::DOUBLE ELSE 1.2::DOUBLE END AS official FROM sched WHERE dia IS NOT NULL GROUP BY panel)
        SELECT panel, ROUND(total_wt, 2) AS total_wt FROM s WHERE 100.0 * total_wt / official BETWEEN 96 AND 104 AND low_wt / total_wt >= 0.5""",
    "notes_set": "SELECT o_custkey, COUNT(*) AS n, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS notes FROM orders GROUP BY 1",
    "top_freq_50": "SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 50",
    "first_20_distinct": "SELECT DISTINCT p_name AS text FROM part ORDER BY 1 LIMIT 20",
    "overflow_report": "SELECT c_nationkey, array_to_string(list_transform(k[1:5], lambda x: CAST(x AS VARCHAR)), ', ') || CASE WHEN len(k) > 5 THEN ' +' || (len(k) - 5) || ' more' ELSE '' END AS shown FROM (SELECT c_nationkey, list_sort(list(c_custkey)) AS k FROM customer GROUP BY 1)",
    "need_by_key": SCHED + "SELECT dia, ROUND(SUM(wt * qty), 0) AS need_kg, MAX(qty) AS max_qty FROM sched WHERE dia IS NOT NULL GROUP BY dia",
    "fragment_limits": SCHED + "SELECT dia, ROUND(MAX(len_mm) FILTER (WHERE l_linenumber > 3) * 1.15::DOUBLE, 4) AS ceiling, ROUND(MIN(len_mm) * 0.5::DOUBLE, 4) AS floor, bool_or(l_linestatus = 'F') AS dowel_only FROM sched WHERE dia IS NOT NULL GROUP BY dia",
    "median_consensus": """WITH m AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem GROUP BY 1), j AS (SELECT l.l_suppkey, l_extendedprice AS v, m, abs(l_extendedprice - m) <= 0.2::DOUBLE * abs(m) AS close FROM lineitem l JOIN m ON l.l_suppkey = m.l_suppkey)
        SELECT l_suppkey, ROUND(CASE WHEN COUNT(*) FILTER (WHERE close) >= 2 THEN quantile_cont(v, 0.5) FILTER (WHERE close) ELSE MAX(m) END, 4) AS consensus, COUNT(*) FILTER (WHERE close) AS n_agreeing FROM j GROUP BY 1""",
    "weighted_mean_dia": SCHED + "SELECT panel, ROUND(SUM(dia * len_mm) / SUM(len_mm), 6) AS mean_dia FROM sched WHERE dia IS NOT NULL GROUP BY panel",
    "two_level_max_sum": SCHED + "SELECT panel, MAX(s) AS true_count FROM (SELECT panel, l_returnflag, l_linestatus, SUM(qty) AS s FROM sched GROUP BY ALL) GROUP BY panel",
    "report_status_counts": TWO + "SELECT CASE WHEN ok THEN 'OK' WHEN delta < 0 THEN 'SHORT' WHEN delta > 0 THEN 'OVER' ELSE 'OK' END AS status, COUNT(*) AS n FROM cmp GROUP BY 1",
    "best_source_per_group": SCHED + ", c AS (SELECT panel, l_suppkey, COUNT(*) AS n FROM sched GROUP BY 1, 2) SELECT panel, l_suppkey AS suppkey, n FROM (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY n DESC, l_suppkey) AS rn FROM c) WHERE rn = 1",
    "viewer_totals": SCHED + "SELECT panel, COUNT(*) AS n, ROUND(SUM(len_mm), 2) AS len_mm, ROUND(100.0::DOUBLE * COUNT(*) FILTER (WHERE l_linestatus = 'F') / COUNT(*), 4) AS pct_measured FROM sched WHERE dia IS NOT NULL GROUP BY panel",
    "predicted_rows": "SELECT p_name AS text, COUNT(*) AS instances, COUNT(*) * MAX(p_size) AS predicted FROM part GROUP BY 1",
    "rules_findings": """SELECT o_orderkey, 'price_low' AS rule, 'ERROR' AS severity, 'price_low' AS message FROM orders WHERE o_totalprice < 2000
        UNION ALL SELECT o_orderkey, 'price_high', 'WARN', 'price_high' FROM orders WHERE o_totalprice > 450000
        UNION ALL SELECT o_orderkey, 'late_open', 'WARN', 'late_open' FROM orders WHERE o_orderstatus = 'O' AND year(o_orderdate) < 1996""",
}
