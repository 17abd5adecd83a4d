import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.operators import budget, dedupe, islands, match, rules, tally
from tallyspark.operators.attendance import daily_rows, debounce
from tallyspark.operators.components import connected_components

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


@SLOW
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.integers(0, 9)), min_size=1, max_size=40), st.integers(0, 5))
def test_merge_intervals(spark, items, gap):
    df = spark.createDataFrame([(k, a, a + n) for k, a, n in items], "k long, lo long, hi long")
    want = []
    for k in {k for k, *_ in items}:
        spans = sorted((a, a + n) for x, a, n in items if x == k)
        merged = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= merged[-1][1] + gap:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want += [(k, *m) for m in merged]
    once = islands.merge_intervals(df, ["k"], gap=gap)
    assert sorted((r.k, r.lo, r.hi) for r in once.collect()) == sorted(want)
    assert islands.merge_intervals(once.drop("n"), ["k"], gap=gap).count() == len(want)  # nothing left to merge


@SLOW
@given(st.lists(st.integers(0, 40), min_size=1, max_size=30), st.integers(1, 6))
def test_anchor_and_adjacency_differ(spark, values, gap):
    df = spark.createDataFrame([(1, float(v)) for v in values], "k long, v double")
    anchors = []
    for v in sorted(values):
        if not anchors or v - anchors[-1][0] > gap:
            anchors.append([v, 0])
        anchors[-1][1] += 1
    assert sorted((r.anchor, r.n) for r in islands.anchor_clusters(df, ["k"], "v", gap).collect()) == sorted(map(tuple, anchors))
    runs = sorted(values)
    expected = 1 + sum(b - a > gap for a, b in zip(runs, runs[1:], strict=False))
    assert islands.adjacency_clusters(df, ["k"], "v", gap).agg(F.max("cluster")).first()[0] == expected


@SLOW
@given(st.lists(st.integers(0, 20), min_size=1, max_size=25), st.integers(0, 120))
def test_suffix_cap_is_the_loop(spark, weights, limit):
    df = spark.createDataFrame([(1, i, w, limit) for i, w in enumerate(weights)], "k long, i long, w long, b long")
    kept, rest = list(enumerate(weights)), sum(weights)
    while kept and rest > limit:
        rest -= kept.pop(0)[1]
    assert sorted(r.i for r in budget.suffix_cap(df, ["k"], ["i"], "w", "b").collect()) == [i for i, _ in kept]


@SLOW
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in root} and len(got) == len(root)


def test_long_path_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long")
    assert connected_components(edges).where("component = 0").count() == 301


def test_interval_subtraction(spark):
    a = spark.createDataFrame([(1, 0, 10), (1, 5, 20), (2, 0, 5)], "k long, lo long, hi long")
    b = spark.createDataFrame([(1, 3, 6), (1, 15, 30)], "k long, lo long, hi long")
    assert sorted(map(tuple, islands.subtract_intervals(a, b, ["k"]).collect())) == [(1, 0, 3), (1, 6, 15), (2, 0, 5)]
    assert sorted(map(tuple, islands.intersect_intervals(a, b, ["k"]).collect())) == [(1, 3, 6), (1, 5, 6), (1, 15, 20)]


def test_upsert_follows_arrival(spark):
    rows = [(1, "in", "2024-01-01 09:00:00", 5), (1, "in", "2024-01-01 08:00:00", 6), (1, "out", "2024-01-01 17:00:00", 7), (1, "out", "2024-01-01 16:00:00", 8), (2, "out", "2024-01-01 10:00:00", 9)]
    gate = spark.createDataFrame(rows, "employee_id long, mode string, ts string, seq long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.employee_id: (r.in_time, r.out_time) for r in daily_rows(gate, 0).collect()}
    assert got == {1: ("09:00:00", "16:00:00"), 2: (None, "10:00:00")}


def test_debounce_is_anchored(spark):
    random.seed(2)
    rows = [(k, i, random.randint(0, 400)) for i, k in enumerate(random.choices((1, 2), k=80))]
    gate = spark.createDataFrame(rows, "employee_id long, seq long, s long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    want, last = [], {}
    for k, i, s in rows:
        if k not in last or s - last[k] > 20:
            last[k] = s
            want.append((k, i))
    assert sorted((r.employee_id, r.seq) for r in debounce(gate, 20).collect()) == sorted(want)


def fit_data(spark, seed):
    rng = random.Random(seed)
    rows = [(p, i, i, float(rng.randint(100, 900)), rng.randint(0, 3)) for i, p in enumerate("aab" * 3)]
    items = [(p, 100 + i, float(rng.randint(80, 950))) for i, p in enumerate("abab" * 5 + "c")]
    return rows, items, spark.createDataFrame(rows, "panel string, row_id long, seq long, length double, qty long"), spark.createDataFrame(items, "panel string, item_id long, length double")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_matches(spark, seed):
    rows, items, left, right = fit_data(spark, seed)
    want, used = set(), set()
    for p, i, _, n, q in rows:
        for _, x, m in sorted((t for t in items if t[0] == p), key=lambda t: (t[2], t[1])):
            if q and x not in used and abs(m - n) <= max(30, 0.08 * n):
                used.add(x)
                want.add((i, x))
                q -= 1
    assert {tuple(r) for r in match.first_fit(left, right, ["panel"], "row_id", "item_id").collect()} == want
    want, used = set(), set()
    for p, i, _, n, q in sorted(rows, key=lambda r: (-r[3], r[1])):
        for _, x in sorted((abs(m - n), x) for o, x, m in items if o == p and x not in used and abs(m - n) <= max(80, 0.15 * n))[:q]:
            used.add(x)
            want.add((i, x))
    assert {tuple(r) for r in match.nearest_fill(left, right, ["panel"], "row_id", "item_id").collect()} == want
    room, want, taken = {r[1]: r[4] for r in rows}, set(), set()
    for units, low, high in ((1, 0.75, 1.30), (2, 1.75, 2.45)):
        for p, x, m in sorted(items, key=lambda t: (-t[2], t[1])):
            fits = [(abs(m / (units * n) - 1), i) for o, i, _, n, _ in rows if o == p and room[i] >= units and low <= m / n <= high]
            if x not in taken and fits:
                i = min(fits)[1]
                room[i] -= units
                taken.add(x)
                want.add((i, x, units))
    assert {tuple(r) for r in match.best_fit(left, right, ["panel"], "row_id", "item_id").collect()} == want


def test_one_key_is_matched_in_many_runs(spark):
    rows = spark.createDataFrame([("p", i, i, 1000.0 * i, 2) for i in range(1, 40)], "panel string, row_id long, seq long, length double, qty long")
    items = spark.createDataFrame([("p", i, 1000.0 * (i // 3) + i % 3) for i in range(120)], "panel string, item_id long, length double")
    left, right = match._runs(rows, items, ["panel"], F.col("length") - 30, F.col("length") + 30, F.col("length"))
    assert left.select("__run").distinct().count() == 39 and right.columns == ["panel", "__run", "item_id", "length"]
    claims = match.first_fit(rows, items, ["panel"], "row_id", "item_id", 30.0, 0.0).collect()
    assert {tuple(r) for r in claims} == {(i, 3 * i + k) for i in range(1, 40) for k in (0, 1)}


def test_nearest_claim(spark):
    labels = spark.createDataFrame([("p", 1, 1, 0.0, 0.0), ("p", 2, 2, 1.0, 0.0), ("p", 3, 3, 900.0, 0.0)], "panel string, label_id long, seq long, x double, y double")
    points = spark.createDataFrame([("p", 10, 2.0, 0.0), ("p", 11, 100.0, 0.0)], "panel string, point_id long, x double, y double")
    assert sorted(map(tuple, match.nearest_claim(labels, points, ["panel"], "label_id", "point_id").collect())) == [(1, 10), (2, 11)]


def test_range_joins(spark):
    rng = random.Random(4)
    a = [(i % 2, i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(40)]
    b = [(i % 2, i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(60)]
    left = spark.createDataFrame(a, "k long, l long, x double, y double")
    right = spark.createDataFrame(b, "k long, r long, x double, y double")
    got = {r.l: (r.found, r.nearest) for r in match.radius_count(left, right, ["k"], "l", ("x", "y"), "r", ("x", "y"), 12.0).collect()}
    for k, i, x, y in a:
        d = [((x - u) ** 2 + (y - v) ** 2) ** 0.5 for o, _, u, v in b if o == k]
        inside = [e for e in d if e <= 12]
        assert got[i] == (len(inside), pytest.approx(min(inside)) if inside else None)
    pairs = match.band_join(left.select("k", "l", F.col("x").alias("x1")), right.select("k", "r", F.col("x").alias("x2")), ["k"], "x1", "x2", 3.0)
    assert {(r.l, r.r) for r in pairs.collect()} == {(i, j) for k, i, x, _ in a for o, j, u, _ in b if k == o and abs(x - u) <= 3}


def test_near_duplicates_compare_with_kept(spark):
    rows = [(1, i, float(x), 0.0, float(x) + 100, 0.0, 100.0) for i, x in enumerate((0, 4, 8, 12))] + [(1, 9, 100.0, 0.0, 0.0, 0.0, 100.0)]
    df = spark.createDataFrame(rows, "k long, seq long, x0 double, y0 double, x1 double, y1 double, length double")
    assert sorted(r.seq for r in dedupe.near_duplicates(df, ["k"], "seq").collect()) == [0, 2]


def test_first_per_key_leaves_the_rest(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "a", False), (4, "a", False), (5, None, True), (6, None, True)], "i long, k string, raw boolean")
    assert sorted(r.i for r in dedupe.first_per_key(df, ["k"], ["i"], F.col("raw")).collect()) == [1, 3, 4, 5]


def test_tallies_keep_both_sides(spark):
    a = spark.createDataFrame([(8, 1.0), (8, 2.0), (None, 9.0), (12, None)], "dia int, x double")
    b = spark.createDataFrame([(8, 3.0), (16, 4.0)], "dia int, y double")
    both = tally.full_outer(tally.tally(a, "dia", {"x": F.col("x")}), tally.tally(b, "dia", {"y": F.col("y")}), "dia")
    assert sorted(map(tuple, both.collect())) == [(8, 3.0, 3.0), (12, 0.0, 0.0), (16, 0.0, 4.0)]
    status = {r.dia: r.status for r in tally.compare(both, "x", "y", 0.1).collect()}
    assert status == {8: "OK", 12: "OK", 16: "SHORT"}
    labels = both.select(tally.percent_label(F.col("x"), F.col("y")).alias("p")).collect()
    assert sorted(r.p for r in labels) == ["-", "0%", "100%"]


def test_grand_total_prefers_the_summary(spark):
    rows = spark.createDataFrame([("p", 8, 1.0), ("p", 8, 2.0), ("q", 8, 5.0)], "panel string, dia int, wt double")
    summary = spark.createDataFrame([("p", None, 3.5), ("p", 8, 3.0)], "panel string, dia int, wt double")
    assert sorted(map(tuple, tally.grand_total(rows, summary, "panel", "wt").collect())) == [("p", 3.5), ("q", 5.0)]


def test_rules_and_quarantine(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "i long, v long")
    checks = [rules.Rule("negative", "ERROR", F.col("v") < 0), rules.Rule("missing", "WARN", F.col("v").isNull())]
    assert sorted((r.i, r.rule) for r in rules.findings(df, checks, "i").collect()) == [(2, "missing"), (3, "negative")]
    good, bad = rules.quarantine(df, checks)
    assert [r.i for r in good.collect()] == [1] and sorted(r.i for r in bad.collect()) == [2, 3]


def test_shortfall_and_distribution(spark):
    df = spark.createDataFrame([(1, 3, 1), (2, 1, 5)], "i long, want long, have long")
    assert sorted((r.i, r.unit_no) for r in budget.expand_shortfall(df, "want", "have").collect()) == [(1, 1), (1, 2)]
    with pytest.raises(Exception, match="shortfall over"):
        budget.expand_shortfall(df, "want", "have", most=1).collect()
    units = [r.u for r in spark.range(4).select(budget.distribute(F.lit(10), F.lit(4), F.col("id")).alias("u")).collect()]
    assert units == [3, 3, 2, 2]


def test_one_sided_keys(spark):
    a, b = (spark.createDataFrame(r, "k long, v double") for r in ([(1, 5.0), (1, 5.0), (2, 1.0)], [(1, 10.0), (3, 4.0)]))
    both = tally.full_outer(tally.tally(a, "k", {"x": F.col("v")}), tally.tally(b, "k", {"y": F.col("v")}), "k")
    assert sorted(map(tuple, both.collect())) == [(1, 10.0, 10.0), (2, 1.0, 0.0), (3, 0.0, 4.0)]
    assert {r.k: r.status for r in tally.compare(both, "x", "y", 0.1).collect()} == {1: "OK", 2: "OVER", 3: "SHORT"}


def test_nearest_in_blocks(spark):
    points = spark.createDataFrame([(i, float(i * i)) for i in range(30)], "g long, x double")
    queries = points.where("g % 10 = 0").select(F.col("g").alias("q"), F.col("x").alias("qx"))
    for blocks in ((1, 1), (7, 3)):
        got = match.nearest_within(queries, points, "q", "g", F.abs(F.col("qx") - F.col("x")), 30.0, F.col("q") != F.col("g"), blocks).collect()
        assert sorted(map(tuple, got)) == [(0, 1, 1.0), (10, 9, 19.0), (20, None, None)]
    lone = match.nearest_within(queries.where("q = 0"), points.where("g = 0"), "q", "g", F.abs(F.col("qx") - F.col("x")), 30.0, F.col("q") != F.col("g")).collect()
    assert list(map(tuple, lone)) == [(0, None, None)]


def test_first_and_more(spark):
    rows = spark.createDataFrame([("a", i) for i in range(12, 0, -1)] + [("b", 3), ("b", None), ("c", None), (None, 1)], "k string, v long")
    got = {r.k: r.shown for r in rules.first_and_more(rows, "k", "v", 5).collect()}
    assert got == {"a": "1, 2, 3, 4, 5 +7 more", "b": "3", "c": "", None: "1"}


def test_running_sums_spread_a_key(spark, monkeypatch):
    from tallyspark.operators import running

    dealt, plain = [], running.materialize
    monkeypatch.setattr(running, "materialize", lambda df, label: dealt.append(plain(df, label)) or dealt[-1])
    rng = random.Random(5)
    rows = [("hot", i, rng.randint(0, 9)) for i in range(3000)] + [("b", 1, 4), ("b", 2, None), (None, 1, 3), (None, 2, 5)]
    rng.shuffle(rows)
    got = running.running_sum(spark.createDataFrame(rows, "k string, i long, w long"), ["k"], [F.desc("i")], F.col("w"), "s", 8).collect()
    sums, want = {}, {}
    for k, i, w in sorted(rows, key=lambda r: -r[1]):
        sums[k] = want[k, i] = sums.get(k, 0) + (w or 0)
    assert {(r.k, r.i): r.s for r in got} == want and {r.k: r.s_all for r in got} == sums
    assert dealt[0].where("k = 'hot'").select("__part").distinct().count() > 4


def test_exact_medians(spark):
    from tallyspark.operators.running import exact_medians

    rows = [("a", float(v)) for v in (5, 1, 9, 2)] + [("b", 3.0), ("b", None), ("c", None)] + [("d", 7.0)] * 5
    got = {r.k: (r.m, r.n) for r in exact_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m", 3).collect()}
    assert got == {"a": (3.5, 4), "b": (3.0, 1), "d": (7.0, 5)}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_are_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(1, i, *(float(rng.randint(0, 25)) for _ in range(4)), float(rng.randint(95, 105))) for i in range(150)]
    kept = []
    for _, i, x0, y0, x1, y1, n in rows:
        far = lambda a, b, c, d: math.hypot(a - c, b - d) >= 6
        if all((far(x0, y0, a, b) or far(x1, y1, c, d)) and (far(x0, y0, c, d) or far(x1, y1, a, b)) or abs(n - m) > 0.05 * max(n, m) for _, a, b, c, d, m in kept):
            kept.append((i, x0, y0, x1, y1, n))
    df = spark.createDataFrame(rows, "k long, i long, x0 double, y0 double, x1 double, y1 double, length double")
    assert sorted(r.i for r in dedupe.near_duplicates(df, ["k"], "i").collect()) == [r[0] for r in kept]


def test_scratch_is_cleared(spark, tmp_path):
    from pathlib import Path

    from tallyspark import session

    there = lambda df: Path(df._tallyspark_path.removeprefix("file://")).exists()
    outside = session.materialize(spark.range(3), "outside")
    with session.scratch_cleared(spark) as keep:
        gone, kept = session.materialize(spark.range(4), "gone"), keep(session.materialize(spark.range(5), "kept"))
        assert there(gone)
    assert not there(gone) and there(outside) and kept.count() == 5
    with pytest.raises(ValueError), session.scratch_cleared(spark):
        gone = session.materialize(spark.range(4), "gone")
        raise ValueError
    assert not there(gone) and there(kept)


def test_shared_folder(spark):
    from types import SimpleNamespace as Fake

    from tallyspark.session import shared_dir

    def session(master, conf=None, checkpoint=None):
        context = Fake(getConf=lambda: {"spark.checkpoint.dir": conf} if conf else {}, getCheckpointDir=lambda: checkpoint, master=master)
        kept = {}
        return Fake(sparkContext=context, conf=Fake(get=kept.get, set=kept.__setitem__))

    assert shared_dir(session("spark://x", "hdfs://a/b/")) == "hdfs://a/b" and shared_dir(session("spark://x", None, "hdfs://c")) == "hdfs://c"
    for master in ("spark://x", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
    own = session("local[2]")
    assert shared_dir(own) == shared_dir(own) and shared_dir(own).startswith("file://")
