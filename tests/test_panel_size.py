"""Panel and pair operators against plain searches, and on groups in which comparing all with all does not end in time."""

import math
import random
import time
from collections import Counter

import duckdb

from tallyspark.operators import match as M
from tallyspark.operators import panel as P
from tallyspark.operators import synthesis as Z
from tallyspark.plans import panels

BARS = "panel string, bar_id long, pos double, bz double, dia double"
DIAGONALS = "bar_id long, dia double, x0 double, z0 double, x1 double, z1 double"
LINKS = "panel string, link_id long, x0 double, x1 double, z double"
SEGMENTS = "panel string, seg_id long, angle_bin int, offset double, lo double, hi double"
ARCS = "panel string, arc_id long, x double, y double, radius double, start double"


def ids(df):
    return sorted(r.bar_id for r in df.collect())


def plain_arcs(rows):
    rows, used, out = sorted(rows, key=lambda r: (r[4], r[1])), set(), []
    for _, i, x, y, radius, start in rows:
        fits = [(r - radius, j) for _, j, u, v, r, s in rows if j != i and j not in used and 5 <= r - radius <= 34 and math.hypot(u - x, v - y) <= 2 and abs((s - start + 180) % 360 - 180) <= 15]
        if i not in used and fits:
            used |= {i, min(fits)[1]}
            out.append((i, min(fits)[1]))
    return sorted(out)


def found_arcs(spark, rows):
    return sorted((r.a, r.b) for r in P.pair_arcs(spark.createDataFrame(rows, ARCS), ["panel"]).collect())


def test_arcs_take_the_partners_of_a_plain_search(spark):
    draw = random.Random(1)
    whole = [("A", i, float(draw.randrange(4)), float(draw.randrange(3)), float(draw.randrange(60)), float(draw.randrange(0, 360, 5))) for i in range(400)]
    uneven = [("A", i, draw.uniform(0, 4), draw.uniform(0, 4), draw.uniform(0, 90), draw.uniform(0, 360)) for i in range(400)]
    for rows in (whole, uneven, []):
        assert found_arcs(spark, rows) == plain_arcs(rows)


def test_arcs_of_a_large_panel(spark):
    rows = [("A", i, float(i % 9), float(i // 7 % 5), float(i * 7 % 300), float(i * 11 % 90)) for i in range(12000)]
    start = time.time()
    assert len(found_arcs(spark, rows)) > 5000
    assert time.time() - start < 30  # was 144 million comparisons in Python


PIECES = "panel string, piece_id long, x0 double, y0 double, x1 double, y1 double, dia double, length double"


def plain_chains(rows):
    rows, out = {r[1]: r[2:] for r in sorted(rows, key=lambda r: r[1])}, []
    free = dict.fromkeys(rows)
    while free:
        seed = next(iter(free))
        del free[seed]
        chain, (x0, y0, x1, y1, dia, _) = [seed], rows[seed]
        for side, end in ((1, (x1, y1)), (0, (x0, y0))):
            while True:
                both = [(i, near, far) for i in free if abs(rows[i][4] - dia) <= 1.9 for near, far in ((rows[i][:2], rows[i][2:4]), (rows[i][2:4], rows[i][:2]))]
                fits = [(math.hypot(near[0] - end[0], near[1] - end[1]), i, far) for i, near, far in both]
                best = min((f for f in fits if f[0] <= 4), default=None)
                if best is None:
                    break
                _, i, end = best
                del free[i]
                chain = [*chain, i] if side else [i, *chain]
        out.append(chain)
    return sorted(out)


def found_chains(spark, rows):
    return sorted(list(r.pieces) for r in P.chain_pieces(spark.createDataFrame(rows, PIECES), ["panel"]).collect())


def test_chains_are_those_of_a_plain_search(spark):
    draw = random.Random(2)
    for wide, whole in ((30, True), (30, False), (300, True), (3, False)):
        at = (lambda: float(draw.randrange(wide))) if whole else (lambda: draw.uniform(0, wide))
        rows = [("A", i, at(), at(), at(), at(), 8.0 + draw.randrange(4), 1.0 + i) for i in range(150)]
        assert found_chains(spark, rows) == plain_chains(rows)


def test_chains_of_a_large_panel(spark):
    rows = [("A", i, float(i * 7 % 60), float(i * 11 % 50), float(i * 7 % 60 + i // 7 % 20 + 5), float(i * 11 % 50 + i % 5), float(i // 7 % 4 + 8), 10.0) for i in range(12000)]
    start = time.time()
    assert sum(map(len, found_chains(spark, rows))) == 12000
    assert time.time() - start < 30  # every step compared all free pieces


def test_mirror_images_in_crowds(spark):
    draw = random.Random(5)

    def plain(rows):
        images = [(i, d, 1000 - x1, z0, 1000 - x0, z1) for i, d, x0, z0, x1, z1 in rows]
        return sorted(m[0] for m in images if not any(abs(m[1] - o[1]) <= 0.5 and all(abs(m[k] - o[k]) <= 250 for k in (2, 3, 4, 5)) for o in rows))

    for span in (1000, 4000, 20000):
        rows = [(i, 8.0 + draw.randrange(5) / 2, draw.uniform(-span, span), float(draw.randrange(span)), draw.uniform(-span, span), float(draw.randrange(span))) for i in range(300)]
        rows += [(300, 8.0, -500.0, 250.0, 1500.0, 0.0), (301, 8.5, -250.0, 0.0, 1750.0, 250.0)]
        assert ids(P.mirror_missing(spark.createDataFrame(rows, DIAGONALS), 1000.0)) == plain(rows)
    crowd = [(i, 8.0, 400.0 + i % 100, 0.0, 500.0 + i % 100, 10.0) for i in range(20000)]
    start = time.time()
    assert ids(P.mirror_missing(spark.createDataFrame([*crowd, (20000, 12.0, 0.0, 0.0, 100.0, 10.0)], DIAGONALS), 1000.0)) == [20000]
    assert time.time() - start < 30  # every match of every image was joined


def test_clashes_with_bars_at_few_places(spark):
    draw = random.Random(4)
    links = [("A", i, float(draw.randrange(80)), float(draw.randrange(80, 120)), float(draw.randrange(30))) for i in range(20000)]
    mesh = [("A", i, float(i % 40 * 3), float(i % 40), float(draw.randrange(1, 9))) for i in range(20000)]
    start = time.time()
    got = {r.link_id: r.offset for r in P.clashes(spark.createDataFrame(links, LINKS), spark.createDataFrame(mesh, BARS), ["panel"]).collect()}
    assert time.time() - start < 30  # every bar at a place was met
    for _, i, x0, x1, z in links[:20]:
        met = [(b + d - z, z - b + d) for _, _, p, b, d in mesh if x0 <= p <= x1 and abs(z - b) < d]
        up, down = (max(m[k] for m in met) if met else None for k in (0, 1))
        assert (i in got) == bool(met) and got.get(i) == (None if not met or up == down else up if up < down else -down)


def test_rail_pairs_spread_over_tasks(spark):
    draw = random.Random(3)
    rows = [("A", i, i % 2, draw.uniform(-100, 100) if i % 3 else float(draw.randrange(100)), float(draw.randrange(100)), float(draw.randrange(100, 200))) for i in range(300)]
    pairs = P.rail_candidates(spark.createDataFrame(rows, SEGMENTS), ["panel"])
    want = [(a[1], b[1], b[3] - a[3], max(a[4], b[4]), min(a[5], b[5])) for a in rows for b in rows if a[2] == b[2] and 5 <= b[3] - a[3] <= 34 and min(a[5], b[5]) - max(a[4], b[4]) >= 30]
    assert sorted((r.a, r.b, r.gap, r.lo, r.hi) for r in pairs.collect()) == sorted(want)
    assert pairs.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism  # was put together to one by its few bytes


def test_close_pairs_are_those_of_a_plain_search(spark):
    draw = random.Random(6)
    rows = [(i // 2, i % 3, [draw.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    rows += [(1000, 0, None), (1001, 0, []), (1002, 0, [float("nan")] * 4), (1003, 0, [1.0, None, 1.0, 1.0]), (1004, 9, [0.0]), (None, 0, [0.0] * 4), (1005, None, [0.0] * 4), (1006, 7, [0.0, 0.0]), (1007, 7, [1.5, 0.0]), (1008, 7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    held = [tuple(r) for r in df.collect()]

    def far(a, b):
        return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))

    good = [r for r in held if r[0] is not None and r[1] is not None and r[2] and all(x is not None and math.isfinite(x) for x in r[2])]
    want = Counter(a[1] for a in good for b in good if a[1] == b[1] and len(a[2]) == len(b[2]) and a[0] < b[0] and far(a[2], b[2]) < 1.5)
    for block in (40, 2048):
        assert {r.label: r.n for r in M.close_pair_counts(df, "label", "vec_id", "embedding", 1.5, block).collect()} == want


def test_close_pairs_of_a_large_label(spark):
    rows = spark.range(12000).selectExpr("id as vec_id", "1 as label", "transform(sequence(1, 32), k -> float(sin(id * k))) as embedding")
    start = time.time()
    assert M.close_pair_counts(rows, "label", "vec_id", "embedding", 9.0).first().n > 0
    assert time.time() - start < 30  # 72 million distances were expressions


def test_claims_are_those_of_all_pairs(spark):
    draw = random.Random(7)
    rows = [("A", i, i % 2, float(draw.randrange(200)), float(x := draw.randrange(300)), float(x + draw.randrange(20, 400))) for i in range(300)]
    segments = spark.createDataFrame([*rows, ("A", 300, None, 1.0, 0.0, 99.0), ("A", 301, 0, None, 0.0, 99.0)], SEGMENTS)
    want = sorted(map(tuple, P.claim_rails(P.rail_candidates(segments, ["panel"]), ["panel", "angle_bin"]).collect()))
    for at_once in (100, 500_000):
        assert sorted(map(tuple, P.claim_segments(segments, ["panel"], at_once=at_once).collect())) == want


def test_claimed_rails_makes_no_table_of_pairs(spark, sf_dir):
    plan = panels.claimed_rails(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # the pairs of a panel grow with the square of its segments


DEPTH_BARS = "panel string, bar_id long, role string, radius double, coord double"
MARKS = "panel string, role string, r double, c double, z double, section string"


def plain_depths(bars, marks):
    hits, out = {}, []
    for panel, i, role, radius, coord in bars:
        for p, ro, r, c, z, section in marks:
            if (p, ro) == (panel, role) and abs(c - coord) <= 40 and abs(r - radius) <= 0.5:
                hits.setdefault(i, []).append((z, abs(c - coord), section))
    for i, found in hits.items():
        runs = []
        for z, off, section in sorted(found, key=lambda h: h[0]):
            if not runs or z - runs[-1][-1][0] > 8:
                runs.append([])
            runs[-1].append((z, off, section))
        best = min(runs, key=lambda run: (min(h[1] for h in run), run[0][0]))
        sure = len({h[2] for h in best}) > 1 or min(h[1] for h in best) <= 15
        out.append((i, round(sum(h[0] for h in best) / len(best), 6), "section" if sure else "section-weak"))
    return sorted(out)


def found_depths(spark, bars, marks):
    out = P.depth_lookup(spark.createDataFrame(bars, DEPTH_BARS), spark.createDataFrame(marks, MARKS), ["panel"])
    return sorted((r.bar_id, round(r.z, 6), r.z_src) for r in out.collect())


def test_depths_are_those_of_a_plain_search(spark):
    draw = random.Random(4)
    # few places, so bars and circles are alike; bars 0 to 19 lie at several places, some twice at one
    whole = [(draw.choice("AB"), i % 180, draw.choice("hv"), float(draw.randrange(4, 7)), float(draw.randrange(0, 600, 50))) for i in range(200)]
    circles = [(draw.choice("AB"), draw.choice("hv"), float(draw.randrange(4, 7)), float(draw.randrange(0, 600, 9)), float(draw.randrange(0, 200, 4)), draw.choice("xyz")) for _ in range(300)]
    uneven = [("A", i, "h", draw.uniform(4, 6), draw.uniform(0, 900)) for i in range(100)]
    loose = [("A", "h", draw.uniform(4, 6), draw.uniform(0, 900), draw.uniform(0, 400), draw.choice("xyz")) for _ in range(200)]
    for bars, marks in ((whole + whole[:5], circles + circles[:50]), (uneven, loose), (whole, []), ([], circles)):
        got, want = found_depths(spark, bars, marks), plain_depths(bars, marks)
        assert [r[::2] for r in got] == [r[::2] for r in want]
        assert all(math.isclose(a[1], b[1], abs_tol=2e-6) for a, b in zip(got, want, strict=True))


def test_depths_of_circles_without_one(spark):
    bars = [("A", 1, "h", 4.0, 100.0), ("A", 2, "h", 4.0, 200.0), ("A", 3, "v", None, 100.0), (None, 4, "h", 4.0, 100.0), ("A", None, "h", 4.0, 200.0)]
    marks = [("A", "h", 4.0, 130.0, None, "x"), ("A", "h", 4.0, 130.0, None, "y"), ("A", "h", 4.0, 210.0, None, "x"), ("A", "h", 4.0, 205.0, 50.0, "x"), (None, "h", 4.0, 100.0, 9.0, "x")]
    out = P.depth_lookup(spark.createDataFrame(bars, DEPTH_BARS), spark.createDataFrame(marks, MARKS), ["panel"])
    assert {r.bar_id: (r.z, r.z_src) for r in out.collect()} == {1: (None, "section-weak"), 2: (50.0, "section"), None: (50.0, "section")}


def test_depths_of_a_large_panel(spark):
    bars = spark.range(80_000).selectExpr("'A' AS panel", "id AS bar_id", "'h' AS role", "4D AS radius", "CAST(id * 5 % 600 AS DOUBLE) AS coord")
    marks = spark.range(80_000).selectExpr("'A' AS panel", "'h' AS role", "4D AS r", "CAST(id * 11 % 600 AS DOUBLE) AS c", "CAST(id % 50 * 4 AS DOUBLE) AS z", "CAST(id % 3 AS STRING) AS section")
    start = time.time()
    assert P.depth_lookup(bars, marks, ["panel"]).where("z_src = 'section' AND z >= 0").count() == 80_000
    assert time.time() - start < 30  # was a sort of about 800 million hits


def test_section_depths_of_parts_without_size(spark, sf_dir, tmp_path):
    duck = duckdb.connect(config={"threads": 1})
    duck.execute(f"CREATE TABLE part AS SELECT * REPLACE (CASE WHEN p_partkey % 5 > 0 THEN p_size END AS p_size) FROM '{sf_dir}/part.parquet'")
    duck.execute(f"COPY part TO '{tmp_path}/part.parquet'")
    want = duck.execute(panels.ORACLES["section_depths"]).fetchall()
    assert want and Counter(map(tuple, panels.section_depths(spark, str(tmp_path)).collect())) == Counter(want)


DASHES = "panel string, angle_bin int, offset double, lo double, hi double"


def plain_lines(rows):
    groups, out = {}, []
    for panel, angle, offset, lo, hi in sorted(rows):
        rails = groups.setdefault((panel, angle), [])
        if not rails or offset - rails[-1][-1][0] > 40:
            rails.append([])
        rails[-1].append((offset, lo, hi))
    for group, rails in groups.items():
        for rail in rails:
            runs = []
            for lo, hi in sorted(d[1:] for d in rail):
                if not runs or lo > runs[-1][1] + 60:
                    runs.append([lo, hi])
                runs[-1][1] = max(runs[-1][1], hi)
            out += [(*group, round(sum(d[0] for d in rail) / len(rail), 6), lo, hi) for lo, hi in runs if hi - lo >= 300]
    return sorted(out)


def test_equal_dashes_share_their_line(spark):
    draw = random.Random(8)
    rows = []
    for _ in range(300):  # several hundred rails; a line may begin with any number of equal dashes or offsets
        lo = float(draw.randrange(0, 5000, 50))
        rows += [(draw.choice("AB"), draw.randrange(3), float(draw.randrange(0, 9000, 9)), lo, lo + draw.randrange(300, 400, 50))] * draw.randrange(1, 5)
    rows += [(p, a, o, lo + 500, hi + 400) for p, a, o, lo, hi in rows[::2]]
    want = plain_lines(rows)
    assert len(want) > 100
    for parts in (1, 7):
        draw.shuffle(rows)
        got = Z.dashed_lines(spark.createDataFrame(rows, DASHES).repartition(parts), gap=60.0, least=300.0, same=40.0)
        assert sorted((r.panel, r.angle_bin, round(r.offset, 6), r.lo, r.hi) for r in got.collect()) == want
