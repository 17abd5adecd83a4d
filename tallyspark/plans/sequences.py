"""Clusters, merges, caps and deduplication over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.operators import budget as B
from tallyspark.operators import dedupe as D
from tallyspark.operators import islands as I
from tallyspark.operators.running import exact_medians
from tallyspark.plans.tallies import SCHED, sched
from tallyspark.sources.tables import table


def _seconds(df):
    return F.unix_seconds(df["ts"].cast("timestamp"))


def _intervals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = _seconds(e)
    return e.select("user_id", at.alias("lo"), (at + F.col("value").cast("long") * 300).alias("hi"))


def interval_merge(spark, sf_dir):
    return I.merge_intervals(_intervals(spark, sf_dir), ["user_id"], gap=600)


def interval_subtract(spark, sf_dir):
    rows = _intervals(spark, sf_dir).withColumn("odd", F.col("lo") % 2 == 1)
    a, b = (rows.where(c).drop("odd") for c in (~F.col("odd"), F.col("odd")))
    return I.subtract_intervals(a, b, ["user_id"], least=60)


def interval_intersect(spark, sf_dir):
    rows = _intervals(spark, sf_dir)
    a, b = (I.merge_intervals(rows.where(c), ["user_id"]).drop("n") for c in (F.col("lo") % 2 == 0, F.col("lo") % 2 == 1))
    return I.intersect_intervals(a, b, ["user_id"], least=60)


def adjacency_cluster(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = I.adjacency_clusters(e.select("user_id", "event_id", _seconds(e).alias("at")), ["user_id"], "at", 7200, ["event_id"])
    return out.groupBy("user_id", "cluster").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n")).withColumn("cluster", F.col("cluster").cast("long"))


def anchor_cluster(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = I.anchor_clusters(e.select("user_id", _seconds(e).alias("at")), ["user_id"], "at", 86400)
    return out.withColumn("anchor", F.col("anchor").cast("long"))


def mode_gap(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(e["ts"].cast("timestamp")) - F.lag(F.unix_micros(e["ts"].cast("timestamp"))).over(order)
    steps = e.select("user_id", (F.bround(gap / 6e7 / 5, 0) * 5).cast("long").alias("gap")).where("gap between 20 and 600")
    return I.mode_with_ties(steps, ["user_id"], "gap")


def family_spacing(spark, sf_dir):
    rows = sched(spark, sf_dir).where("dia is not null")
    order = Window.partitionBy("panel", "dia").orderBy("len_mm", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    gaps = rows.withColumn("gap", F.col("len_mm") - F.lag("len_mm").over(order)).where((F.col("gap") > 20) & (F.col("gap") < 600))
    rounded = gaps.withColumn("gap", (F.bround(F.col("gap") / 5, 0) * 5).cast("long"))
    return I.mode_with_ties(rounded, ["panel", "dia"], "gap")


def budget_cap(spark, sf_dir):
    rows = sched(spark, sf_dir).where("dia is not null").withColumn("units", F.col("qty").cast("long"))
    limit = rows.groupBy("dia").agg(F.floor(F.sum("units") * 0.4).alias("budget"))
    kept = B.suffix_cap(rows.join(limit, "dia"), ["dia"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "len_mm"], "units", "budget")
    return kept.groupBy("dia").agg(F.count(F.lit(1)).alias("kept"), F.sum("units").alias("units"))


def rank_cut_edges(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("cap", F.lit(9))
    score = -F.least(F.col("p_size"), F.lit(50) - F.col("p_size"))
    return B.keep_outermost(part, ["p_brand"], score, F.col("cap"), ["p_partkey"]).select("p_brand", "p_partkey", "p_size")


def shortfall_expand(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("have"))
    rows = table(spark, sf_dir, "orders").join(have, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = rows.select("o_orderkey", F.coalesce("have", F.lit(0)).alias("have"), (F.col("o_orderkey") % 6).alias("wanted"))
    return B.expand_shortfall(rows, "wanted", "have").select("o_orderkey", "unit_no")


def distribute_divmod(spark, sf_dir):
    parts = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("parts"))
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    rows = table(spark, sf_dir, "supplier").join(parts, "s_nationkey").withColumn("i", F.row_number().over(order) - 1)
    return rows.select("s_suppkey", B.distribute(F.lit(1000), F.col("parts"), F.col("i")).cast("long").alias("units"))


def first_per_key_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = F.trim(F.regexp_replace(F.lower("text"), "[ \\n\\t]+", " "))
    return D.first_per_key(docs, [F.sha2(key.cast("binary"), 256)], ["doc_id"]).select("doc_id", "source")


def undersized_drop(spark, sf_dir):
    rows = sched(spark, sf_dir).where("dia is not null")
    floor = rows.where("l_linenumber <= 3").groupBy("dia").agg(F.min("len_mm").alias("least"))
    kept = rows.join(floor, "dia", "left").where(F.col("least").isNull() | (F.col("len_mm") >= 20 * F.col("least")))
    return kept.groupBy("dia").agg(F.count(F.lit(1)).alias("kept"))


def default_depth(spark, sf_dir):
    """A missing value filled from its family's median if the family has three, else the plane's, else the centre."""
    rows = sched(spark, sf_dir).where("dia is not null").select("panel", "dia", "l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "F", F.col("len_mm")).alias("z"))
    family = exact_medians(rows, ["panel", "dia"], "z", "fam").where("n >= 30").drop("n")
    plane = exact_medians(rows, ["panel"], "z", "plane").drop("n")
    out = rows.join(family, ["panel", "dia"], "left").join(plane, "panel", "left")
    filled = out.withColumns({"z2": F.coalesce("z", "fam", "plane", F.lit(0.0)), "z_src": F.when(F.col("z").isNotNull(), "section").when(F.col("fam").isNotNull(), "family").when(F.col("plane").isNotNull(), "plane-snap").otherwise("default")})
    return filled.groupBy("z_src").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z2"), 1).alias("z_sum"))


def depth_fractions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("f", F.col("l_quantity") / 50)
    front, back, every = F.avg(F.when(F.col("f") < 0.5, F.col("f"))), F.avg(F.when(F.col("f") >= 0.5, F.col("f"))), F.avg("f")
    out = rows.groupBy("l_suppkey").agg(F.coalesce(front, every).alias("front"), F.coalesce(back, every).alias("back"))
    return out.select("l_suppkey", F.round("front", 6).alias("front"), F.round("back", 6).alias("back"))


QUERIES = {f.__name__: f for f in (interval_merge, interval_subtract, interval_intersect, adjacency_cluster, anchor_cluster, mode_gap, family_spacing, budget_cap, rank_cut_edges, shortfall_expand, distribute_divmod, first_per_key_dedupe, undersized_drop, default_depth, depth_fractions)}

IV = "WITH iv AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS lo, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) + CAST(trunc(value) AS BIGINT) * 300 AS hi FROM events) "


def _merged(source: str, gap: int) -> str:
    return f"""SELECT user_id, MIN(lo) AS lo, MAX(hi) AS hi, COUNT(*) AS n FROM (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT *, CASE WHEN MAX(hi) OVER w IS NULL OR lo > MAX(hi) OVER w + {gap} THEN 1 ELSE 0 END AS fresh FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) GROUP BY user_id, island"""


ORACLES = {
    "interval_merge": IV + _merged("iv", 600),
    "interval_intersect": IV + f""", a AS ({_merged('(SELECT * FROM iv WHERE lo % 2 = 0)', 0)}), b AS ({_merged('(SELECT * FROM iv WHERE lo % 2 = 1)', 0)})
        SELECT a.user_id, GREATEST(a.lo, b.lo) AS lo, LEAST(a.hi, b.hi) AS hi FROM a JOIN b ON a.user_id = b.user_id AND LEAST(a.hi, b.hi) - GREATEST(a.lo, b.lo) > 60""",
    "interval_subtract": IV + f""", a AS ({_merged('(SELECT * FROM iv WHERE lo % 2 = 0)', 0)}), b AS ({_merged('(SELECT * FROM iv WHERE lo % 2 = 1 AND hi > lo)', 0)}),
        gaps AS (SELECT user_id, hi AS lo, lead(lo) OVER (PARTITION BY user_id ORDER BY lo) AS hi FROM b UNION ALL SELECT user_id, NULL, MIN(lo) FROM b GROUP BY 1),
        g AS (SELECT user_id, COALESCE(lo, -9000000000) AS lo, COALESCE(hi, 9000000000) AS hi FROM gaps UNION ALL SELECT DISTINCT user_id, -9000000000, 9000000000 FROM a WHERE user_id NOT IN (SELECT user_id FROM b))
        SELECT a.user_id, GREATEST(a.lo, g.lo) AS lo, LEAST(a.hi, g.hi) AS hi FROM a JOIN g ON a.user_id = g.user_id AND LEAST(a.hi, g.hi) - GREATEST(a.lo, g.lo) > 60""",
    "adjacency_cluster": IV + """SELECT user_id, CAST(cluster AS BIGINT) AS cluster, MIN(tm) AS lo, MAX(tm) AS hi, COUNT(*) AS n FROM (SELECT *, SUM(f) OVER (PARTITION BY user_id ORDER BY tm, event_id ROWS UNBOUNDED PRECEDING) AS cluster
        FROM (SELECT *, CASE WHEN lag(tm) OVER w IS NULL OR tm - lag(tm) OVER w > 7200 THEN 1 ELSE 0 END AS f FROM (SELECT user_id, event_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS tm FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY tm, event_id))) GROUP BY 1, 2""",
    "anchor_cluster": """WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
        walk AS (SELECT user_id, rn, tm AS anchor FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, CASE WHEN e.tm - w.anchor > 86400 THEN e.tm ELSE w.anchor END FROM walk w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
        SELECT user_id, anchor, COUNT(*) AS n FROM walk GROUP BY 1, 2""",
    "mode_gap": """WITH g AS (SELECT user_id, CAST(round_even((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 60000000.0::DOUBLE / 5, 0) * 5 AS BIGINT) AS gap FROM events),
        c AS (SELECT user_id, gap, COUNT(*) AS n FROM g WHERE gap BETWEEN 20 AND 600 GROUP BY 1, 2) SELECT user_id, gap AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, gap) AS rn FROM c) WHERE rn = 1""",
    "family_spacing": SCHED + """, g AS (SELECT panel, dia, len_mm - lag(len_mm) OVER (PARTITION BY panel, dia ORDER BY len_mm, l_orderkey, l_linenumber, l_suppkey, l_partkey) AS gap FROM sched WHERE dia IS NOT NULL),
        c AS (SELECT panel, dia, CAST(round_even(gap / 5, 0) * 5 AS BIGINT) AS gap, COUNT(*) AS n FROM g WHERE gap > 20 AND gap < 600 GROUP BY 1, 2, 3) SELECT panel, dia, gap AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY panel, dia ORDER BY n DESC, gap) AS rn FROM c) WHERE rn = 1""",
    "budget_cap": SCHED + """, r AS (SELECT dia, CAST(qty AS BIGINT) AS units, SUM(CAST(qty AS BIGINT)) OVER (PARTITION BY dia ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, len_mm ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
        floor(SUM(CAST(qty AS BIGINT)) OVER (PARTITION BY dia) * 0.4::DOUBLE) AS budget FROM sched WHERE dia IS NOT NULL) SELECT dia, COUNT(*) AS kept, CAST(SUM(units) AS BIGINT) AS units FROM r WHERE rest <= budget GROUP BY dia""",
    "rank_cut_edges": "SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY LEAST(p_size, 50 - p_size), p_partkey) AS rn FROM part) WHERE rn <= 4",
    "shortfall_expand": "WITH h AS (SELECT l_orderkey, COUNT(*) AS have FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey, COALESCE(have, 0) AS have, o_orderkey % 6 AS wanted FROM orders LEFT JOIN h ON o_orderkey = l_orderkey) SELECT o_orderkey, unnest(range(1, wanted - have + 1)) AS unit_no FROM r WHERE wanted > have",
    "distribute_divmod": "SELECT s_suppkey, CAST(1000 // n + CASE WHEN i < 1000 % n THEN 1 ELSE 0 END AS BIGINT) AS units FROM (SELECT s_suppkey, COUNT(*) OVER (PARTITION BY s_nationkey) AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier)",
    "first_per_key_dedupe": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '[ \\n\\t]+', ' ', 'g')) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
    "undersized_drop": SCHED + ", f AS (SELECT dia, MIN(len_mm) AS least FROM sched WHERE dia IS NOT NULL AND l_linenumber <= 3 GROUP BY 1) SELECT s.dia, COUNT(*) AS kept FROM sched s LEFT JOIN f ON s.dia = f.dia WHERE s.dia IS NOT NULL AND (least IS NULL OR len_mm >= 20 * least) GROUP BY 1",
    "default_depth": SCHED + """, r AS (SELECT panel, dia, CASE WHEN l_linestatus = 'F' THEN len_mm END AS z FROM sched WHERE dia IS NOT NULL), fam AS (SELECT panel, dia, quantile_cont(z, 0.5) AS fam FROM r WHERE z IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 30),
        pl AS (SELECT panel, quantile_cont(z, 0.5) AS plane FROM r WHERE z IS NOT NULL GROUP BY 1), j AS (SELECT r.z, fam, plane FROM r LEFT JOIN fam ON r.panel = fam.panel AND r.dia = fam.dia LEFT JOIN pl ON r.panel = pl.panel)
        SELECT CASE WHEN z IS NOT NULL THEN 'section' WHEN fam IS NOT NULL THEN 'family' WHEN plane IS NOT NULL THEN 'plane-snap' ELSE 'default' END AS z_src, COUNT(*) AS n, ROUND(SUM(COALESCE(z, fam, plane, 0)), 1) AS z_sum FROM j GROUP BY 1""",
    "depth_fractions": """SELECT l_suppkey, ROUND(COALESCE(AVG(l_quantity / 50) FILTER (WHERE l_quantity / 50 < 0.5), AVG(l_quantity / 50)), 6) AS front,
        ROUND(COALESCE(AVG(l_quantity / 50) FILTER (WHERE l_quantity / 50 >= 0.5), AVG(l_quantity / 50)), 6) AS back FROM lineitem GROUP BY 1""",
}
