"""Joins, matching, set operations and vector lookups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import calc as C
from tallyspark.operators import match as M
from tallyspark.plans.tallies import SCHED, sched
from tallyspark.sources.tables import table


def whitelist_semi(spark, sf_dir):
    allowed = table(spark, sf_dir, "part").where("p_size between 24 and 34").select(C.snap_diameter(F.col("p_size")).alias("dia")).distinct()
    rows = sched(spark, sf_dir).join(allowed, "dia", "left_semi")
    return rows.groupBy("dia").agg(F.count(F.lit(1)).alias("n"))


def phantom_anti(spark, sf_dir):
    official = sched(spark, sf_dir).where("l_linenumber = 1 and dia > 10").select("dia").distinct()
    mesh = sched(spark, sf_dir).where("l_returnflag in ('A', 'N') and dia is not null")
    return mesh.join(official, "dia", "left_anti").groupBy("dia").agg(F.count(F.lit(1)).alias("n"))


def sibling_gap_fill(spark, sf_dir):
    """Rows of each panel's longest sibling whose diameter the panel's own rows lack."""
    rows = sched(spark, sf_dir).where("dia is not null").select("panel", "l_suppkey", "dia", "len_mm")
    counts = rows.groupBy("panel", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    best = M.priority_pick(counts, ["panel"], [F.col("n").desc(), F.col("l_suppkey")]).select("panel", "l_suppkey")
    own = rows.where("l_suppkey = 5").select("panel", "dia").distinct()
    return rows.join(best, ["panel", "l_suppkey"]).join(own, ["panel", "dia"], "left_anti").groupBy("panel", "dia").agg(F.count(F.lit(1)).alias("n"))


def nearest_with_threshold(spark, sf_dir):
    """Every twentieth vector against all vectors but itself."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    gallery = e.select(F.col("vec_id").alias("g"), F.col("embedding").alias("gv"))
    out = M.nearest_within(queries, gallery, "q", "g", C.vector_distance(F.col("qv"), F.col("gv")), 1.2, F.col("q") != F.col("g"))
    return out.select("q", "match_id", F.round("distance", 6).alias("distance"))


def radius_count(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.unix_seconds(e["ts"].cast("timestamp")) / 3600.0
    left = e.where("event_type = 'signup'").select(F.col("event_id").alias("call"), F.col("user_id").alias("k"), at.alias("x"), F.col("value").alias("y"))
    right = e.where("event_type <> 'signup'").select(F.col("event_id").alias("bar"), F.col("user_id").alias("k"), at.alias("x"), F.col("value").alias("y"))
    out = M.radius_count(left, right, ["k"], "call", ("x", "y"), "bar", ("x", "y"), 20.0)
    return out.select("call", "found", F.round("nearest", 6).alias("nearest"))


def band_join_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.unix_seconds(e["ts"].cast("timestamp"))
    a = e.where("event_type = 'purchase'").select("user_id", at.alias("t1"), F.col("event_id").alias("e1"))
    b = e.where("event_type = 'view'").select("user_id", at.alias("t2"), F.col("event_id").alias("e2"))
    return M.band_join(a, b, ["user_id"], "t1", "t2", 3600).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def first_box_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).cast("double").alias("x"), F.col("value").alias("y"))
    boxes = spark.range(8).select(F.col("id").cast("int").alias("box_idx"), (F.col("id") * 6).alias("bx0"), (F.col("id") * 6 + 9).alias("bx1"), (F.col("id") * 5).alias("by0"), (F.col("id") * 5 + 25).alias("by1"))
    return M.first_box(e, boxes, "event_id", "x", "y", 0.5)


def nearest_column(spark, sf_dir):
    xs = F.array(*map(F.lit, (2.0, 11.0, 19.0, 33.0, 47.0)))
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", M.nearest_column(F.col("p_size").cast("double"), xs, 5.0).alias("column"))


def probe_lookup(spark, sf_dir):
    """Sizes looked up in a table that has values at every fourth size only."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").alias("bucket"))
    depth = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") * 4).alias("bucket"), F.col("p_partkey").alias("z"))
    return M.probe_lookup(rows, depth, ["p_brand"], "bucket", "z", "p_partkey").select("p_partkey", "z")


def near_dup_pairs(spark, sf_dir):
    """Pairs of vectors of one label whose distance is below 1.3, as counts."""
    return M.close_pair_counts(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 1.3)


def registry_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select("c_custkey", F.coalesce("n_name", F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string"))).alias("name"), F.col("n_name").isNull().alias("auto_registered"))


def label_evidence(spark, sf_dir):
    """Labels with three or more distinct fragments nearby."""
    part = table(spark, sf_dir, "part")
    a = part.where("p_partkey % 11 = 0").select("p_brand", F.col("p_partkey").alias("label_id"), F.col("p_size").cast("double").alias("x1"))
    b = part.where("p_partkey % 11 <> 0").select("p_brand", F.col("p_partkey").alias("frag_id"), F.col("p_size").cast("double").alias("x2"))
    return M.band_join(a, b, ["p_brand"], "x1", "x2", 1.0).groupBy("label_id").agg(F.count_distinct("frag_id").alias("n")).where("n >= 3")


def companion_views(spark, sf_dir):
    views = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("ents"), F.sum("p_size").alias("width"), F.avg("p_retailprice").alias("height"))
    best = views.agg(F.max_by(F.struct("width", "height", "ents"), F.struct("ents", "p_brand")).alias("m"))
    w, h, e = (best.select(f"m.{c}").scalar() for c in ("width", "height", "ents"))
    out = views.where((F.abs(F.col("height") - h) <= 0.02 * h) & F.col("width").between(w * 0.25, w * 1.5) & (F.col("ents") >= 0.3 * e))
    return out.select("p_brand", "ents", "width")


def set_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return a.union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


def set_bag_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def set_except(spark, sf_dir):
    """Documents without a label."""
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"))
    return a.subtract(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k")))


def set_intersect(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return a.intersect(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


def subset_test(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_linenumber").alias("have"))
    return rows.select("l_suppkey", (F.size(F.array_except(F.array(*map(F.lit, range(1, 8))), "have")) == 0).alias("has_all"))


def greedy_first_fit(spark, sf_dir):
    rows, items = _schedule(spark, sf_dir), _items(spark, sf_dir)
    return M.first_fit(rows, items, ["panel"], "row_id", "item_id")


def greedy_nearest_fill(spark, sf_dir):
    return M.nearest_fill(_schedule(spark, sf_dir), _items(spark, sf_dir), ["panel"], "row_id", "item_id")


def greedy_best_fit(spark, sf_dir):
    return M.best_fit(_schedule(spark, sf_dir), _items(spark, sf_dir), ["panel"], "row_id", "item_id")


def greedy_nearest_claim(spark, sf_dir):
    rows = sched(spark, sf_dir).select("panel", F.col("l_orderkey").alias("k"), F.col("len_mm").alias("x"), (F.col("qty") * 1000).alias("y"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i"), "l_returnflag")
    once = rows.groupBy("panel", "i").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min("l_returnflag").alias("flag"))
    labels = once.where("flag = 'A'").select("panel", F.col("i").alias("label_id"), F.col("i").alias("seq"), "x", "y")
    return M.nearest_claim(labels, once.where("flag = 'N'").select("panel", F.col("i").alias("point_id"), "x", "y"), ["panel"], "label_id", "point_id")


def _schedule(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where("p_partkey % 7 = 0").select(F.col("p_brand").alias("panel"), F.col("p_partkey").alias("row_id"), F.col("p_partkey").alias("seq"), F.col("p_retailprice").alias("length"), (F.col("p_size") % 5 + 1).alias("qty"))


def _items(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where("p_partkey % 7 <> 0").select(F.col("p_brand").alias("panel"), F.col("p_partkey").alias("item_id"), F.col("p_retailprice").alias("length"))


QUERIES = {f.__name__: f for f in (whitelist_semi, phantom_anti, sibling_gap_fill, nearest_with_threshold, radius_count, band_join_counts, first_box_lookup, nearest_column, probe_lookup, near_dup_pairs, registry_lookup, label_evidence, companion_views, set_union, set_bag_union, set_except, set_intersect, subset_test, greedy_first_fit, greedy_nearest_fill, greedy_best_fit, greedy_nearest_claim)}

_XY = "SELECT event_id, user_id AS k, floor(epoch_us(ts) / 1000000.0) / 3600.0::DOUBLE AS x, value AS y FROM events"
_DIST = "sqrt(list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
# Greedy matching as recursion: one step a row (or an item), which carries what is still free.
_ROWS = "s AS (SELECT p_brand AS panel, p_partkey AS row_id, p_retailprice AS len, p_size % 5 + 1 AS qty, row_number() OVER (PARTITION BY p_brand ORDER BY {}) AS i FROM part WHERE p_partkey % 7 = 0)"
_ITEMS = "items AS (SELECT p_brand AS panel, list({{'len': p_retailprice, 'id': p_partkey}} ORDER BY {}) AS items FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1)"
_TAKING = """, f AS (SELECT panel, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS row_id, items AS free, CAST([] AS BIGINT[]) AS took FROM items
        UNION ALL SELECT panel, i, row_id, list_filter(free, lambda x: NOT list_contains(took, x.id)), took FROM (SELECT f.panel, s.i, s.row_id, f.free, {} AS took FROM f JOIN s ON s.panel = f.panel AND s.i = f.i + 1))
        SELECT row_id, unnest(took) AS item_id FROM f WHERE i > 0"""
ORACLES = {
    "greedy_first_fit": f"WITH RECURSIVE {_ROWS.format('p_partkey')}, {_ITEMS.format('p_retailprice, p_partkey')}" + _TAKING.format("list_transform(list_filter(f.free, lambda x: abs(x.len - s.len) <= GREATEST(30.0::DOUBLE, 0.08::DOUBLE * s.len))[1:s.qty], lambda x: x.id)"),
    "greedy_nearest_fill": f"WITH RECURSIVE {_ROWS.format('p_retailprice DESC, p_partkey')}, {_ITEMS.format('p_partkey')}"
    + _TAKING.format("list_transform(list_sort(list_transform(list_filter(f.free, lambda x: abs(x.len - s.len) <= GREATEST(80.0::DOUBLE, 0.15::DOUBLE * s.len)), lambda x: {{'d': abs(x.len - s.len), 'id': x.id}}))[1:s.qty], lambda x: x.id)").replace("{{", "{").replace("}}", "}"),
    "greedy_best_fit": f"""WITH RECURSIVE {_ROWS.format('p_partkey')}, rows_ AS (SELECT panel, list({{'id': row_id, 'len': len}} ORDER BY i) AS rows_, list(CAST(qty AS BIGINT) ORDER BY i) AS room FROM s GROUP BY 1),
        it AS (SELECT p_brand AS panel, p_partkey AS id, p_retailprice AS len, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS i, COUNT(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_partkey % 7 <> 0),
        steps AS (SELECT panel, id, len, i, 1 AS units, 0.75::DOUBLE AS low, 1.30::DOUBLE AS high FROM it UNION ALL SELECT panel, id, len, i + n, 2, 1.75::DOUBLE, 2.45::DOUBLE FROM it),
        f AS (SELECT panel, CAST(0 AS BIGINT) AS i, room, CAST([] AS BIGINT[]) AS done, CAST(NULL AS BIGINT) AS item_id, CAST(NULL AS BIGINT) AS k, 0 AS units FROM rows_
        UNION ALL SELECT panel, i, CASE WHEN k IS NULL THEN room ELSE list_transform(room, lambda r, j: CASE WHEN j = k THEN r - units ELSE r END) END, CASE WHEN k IS NULL THEN done ELSE list_append(done, id) END, id, k, units
            FROM (SELECT f.panel, t.i, f.room, f.done, t.id, t.units, CASE WHEN NOT list_contains(f.done, t.id) THEN list_min(list_filter(list_transform(r.rows_, lambda x, j: CASE WHEN x.len > 0 AND f.room[j] >= t.units AND t.len / x.len BETWEEN t.low AND t.high THEN {{'e': abs(t.len / (t.units * x.len) - 1), 'k': CAST(j AS BIGINT)}} END), lambda x: x IS NOT NULL)).k END AS k
            FROM f JOIN steps t ON t.panel = f.panel AND t.i = f.i + 1 JOIN rows_ r ON r.panel = f.panel))
        SELECT r.rows_[f.k].id AS row_id, item_id, CAST(units AS BIGINT) AS units FROM f JOIN rows_ r ON r.panel = f.panel WHERE k IS NOT NULL""",
    "greedy_nearest_claim": SCHED.replace("WITH", "WITH RECURSIVE", 1) + """, once AS (SELECT panel, l_orderkey * 8 + l_linenumber AS i, MIN(len_mm) AS x, MIN(qty * 1000) AS y, MIN(l_returnflag) AS flag FROM sched GROUP BY 1, 2),
        s AS (SELECT panel, i AS label_id, x, y, row_number() OVER (PARTITION BY panel ORDER BY i) AS n FROM once WHERE flag = 'A'),
        near AS (SELECT s.panel, s.n, s.label_id, list({'d': sqrt((o.x - s.x) * (o.x - s.x) + (o.y - s.y) * (o.y - s.y)), 'id': o.i} ORDER BY sqrt((o.x - s.x) * (o.x - s.x) + (o.y - s.y) * (o.y - s.y)), o.i) AS fits
            FROM s JOIN once o ON o.panel = s.panel AND o.flag = 'N' AND sqrt((o.x - s.x) * (o.x - s.x) + (o.y - s.y) * (o.y - s.y)) <= 250 GROUP BY 1, 2, 3),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY n) AS step FROM near),
        f AS (SELECT panel, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS label_id, CAST(NULL AS BIGINT) AS point_id, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT panel FROM near)
        UNION ALL SELECT panel, step, label_id, p, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END FROM (SELECT f.panel, o.step, o.label_id, f.used, list_filter(o.fits, lambda x: NOT list_contains(f.used, x.id))[1].id AS p FROM f JOIN ordered o ON o.panel = f.panel AND o.step = f.step + 1))
        SELECT label_id, point_id FROM f WHERE point_id IS NOT NULL""",
    "whitelist_semi": SCHED + f", a AS (SELECT DISTINCT {SCHED.split('SELECT ')[1].split(' AS dia')[0]} AS dia FROM part WHERE p_size BETWEEN 24 AND 34) SELECT dia, COUNT(*) AS n FROM sched WHERE dia IN (SELECT dia FROM a WHERE dia IS NOT NULL) GROUP BY 1",
    "phantom_anti": SCHED + "SELECT dia, COUNT(*) AS n FROM sched WHERE l_returnflag IN ('A','N') AND dia IS NOT NULL AND dia NOT IN (SELECT dia FROM sched WHERE l_linenumber = 1 AND dia > 10) GROUP BY 1",
    "sibling_gap_fill": SCHED + """, r AS (SELECT * FROM sched WHERE dia IS NOT NULL), c AS (SELECT panel, l_suppkey, COUNT(*) AS n FROM r GROUP BY 1, 2), b AS (SELECT panel, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY n DESC, l_suppkey) AS rn FROM c) WHERE rn = 1)
        SELECT r.panel, r.dia, COUNT(*) AS n FROM r JOIN b ON r.panel = b.panel AND r.l_suppkey = b.l_suppkey WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.l_suppkey = 5 AND o.panel = r.panel AND o.dia = r.dia) GROUP BY 1, 2""",
    "nearest_with_threshold": f"""WITH p AS (SELECT q.vec_id AS q, g.vec_id AS g, {_DIST.format(a='q.embedding', b='g.embedding')} AS d FROM embeddings q, embeddings g WHERE q.vec_id % 20 = 0 AND g.vec_id <> q.vec_id),
        b AS (SELECT q, g, d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, g) AS rn FROM p) WHERE rn = 1) SELECT q, CASE WHEN d < 1.2 THEN g END AS match_id, CASE WHEN d < 1.2 THEN ROUND(d, 6) END AS distance FROM b""",
    "radius_count": f"""WITH e AS ({_XY}), t AS (SELECT event_id, event_type FROM events), l AS (SELECT e.* FROM e JOIN t USING (event_id) WHERE event_type = 'signup'), r AS (SELECT e.* FROM e JOIN t USING (event_id) WHERE event_type <> 'signup')
        SELECT l.event_id AS call, COUNT(DISTINCT r.event_id) AS found, ROUND(MIN(sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y))), 6) AS nearest FROM l LEFT JOIN r ON l.k = r.k AND sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) <= 20 GROUP BY 1""",
    "band_join_counts": "WITH e AS (SELECT user_id, event_type, floor(epoch_us(ts) / 1000000.0) AS s FROM events) SELECT a.user_id, COUNT(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND abs(a.s - b.s) <= 3600 GROUP BY 1",
    "first_box_lookup": "SELECT event_id, COALESCE(MIN(b.i), -1) AS box_idx FROM events e LEFT JOIN (SELECT CAST(i AS INT) AS i FROM range(8) t(i)) b ON CAST(user_id % 50 AS DOUBLE) BETWEEN i * 6 - 0.5 AND i * 6 + 9.5 AND value BETWEEN i * 5 - 0.5 AND i * 5 + 25.5 GROUP BY 1",
    "nearest_column": "WITH c AS (SELECT p_partkey, x.i, abs(p_size - x.v) AS d FROM part, (VALUES (0, 2.0), (1, 11.0), (2, 19.0), (3, 33.0), (4, 47.0)) x(i, v)) SELECT p_partkey, CASE WHEN MIN(d) <= 5 THEN arg_min(i, d + i * 1e-6) END AS \"column\" FROM c GROUP BY 1",
    "probe_lookup": """WITH d AS (SELECT p_brand, p_size * 4 AS p_size, MIN(p_partkey) AS z FROM part GROUP BY 1, 2), t AS (SELECT p.p_partkey, z, o.r FROM part p, (VALUES (0, 0), (1, -1), (2, 1), (3, -2), (4, 2)) o(r, off) JOIN d ON d.p_brand = p.p_brand AND d.p_size = p.p_size + o.off)
        SELECT p.p_partkey, b.z FROM part p LEFT JOIN (SELECT p_partkey, arg_min(z, r) AS z FROM t GROUP BY 1) b ON p.p_partkey = b.p_partkey""",
    "near_dup_pairs": f"SELECT a.label, COUNT(*) AS n FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_DIST.format(a='a.embedding', b='b.embedding')} < 1.3 GROUP BY 1",
    "registry_lookup": "SELECT c_custkey, COALESCE(n_name, 'nation-' || c_nationkey) AS name, n_name IS NULL AS auto_registered FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "label_evidence": "SELECT a.p_partkey AS label_id, COUNT(DISTINCT b.p_partkey) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey % 11 = 0 AND b.p_partkey % 11 <> 0 AND abs(a.p_size - b.p_size) <= 1 GROUP BY 1 HAVING COUNT(DISTINCT b.p_partkey) >= 3",
    "companion_views": """WITH v AS (SELECT p_brand, COUNT(*) AS ents, CAST(SUM(p_size) AS BIGINT) AS width, AVG(p_retailprice) AS height FROM part GROUP BY 1), m AS (SELECT width AS w, height AS h, ents AS e FROM v ORDER BY ents DESC, p_brand DESC LIMIT 1)
        SELECT p_brand, ents, width FROM v, m WHERE abs(height - h) <= 0.02::DOUBLE * h AND width BETWEEN w * 0.25 AND w * 1.5 AND ents >= 0.3 * e""",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_bag_union": "SELECT k, COUNT(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1",
    "set_except": "SELECT doc_id AS k FROM documents EXCEPT SELECT doc_id FROM labels",
    "set_intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders",
    "subset_test": "SELECT l_suppkey, COUNT(DISTINCT l_linenumber) FILTER (WHERE l_linenumber BETWEEN 1 AND 7) = 7 AS has_all FROM lineitem GROUP BY 1",
}
