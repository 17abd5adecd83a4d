"""Panel queries: views, rails, sections, passes against a schedule, and layouts, over ``part``.

A part stands for a drawn item: its brand is the panel, its key gives whole-numbered places, its size the
diameter and its price the length.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import calc as C
from tallyspark.functions import text as T
from tallyspark.operators import bends as B
from tallyspark.operators import panel as P
from tallyspark.operators import synthesis as Z
from tallyspark.operators.dedupe import near_duplicates
from tallyspark.operators.rules import Rule, findings, quarantine
from tallyspark.plans.tallies import SNAP_SQL
from tallyspark.sources.tables import table

def key():
    return F.col("p_partkey")


def size():
    return F.col("p_size")


def parts(spark, sf_dir, **columns):
    """(panel, id, and ``columns``) of every part."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("panel"), key().alias("id"), *(c.alias(n) for n, c in columns.items()))


def boxes(spark, sf_dir):
    x, y = (key() * 7 % 900).cast("double"), (key() * 13 % 700).cast("double")
    return parts(spark, sf_dir, x0=x, y0=y, x1=x + size(), y1=y + key() % 11 + 5, size=size())


def view_members(spark, sf_dir):
    return P.view_components(boxes(spark, sf_dir), ["panel"], "id", inflate=6.0, cell=25.0)


def _views(spark, sf_dir):
    joined = boxes(spark, sf_dir).join(view_members(spark, sf_dir), ["panel", "id"])
    ends = (F.min(c).alias(c) for c in ("x0", "y0")), (F.max(c).alias(c) for c in ("x1", "y1"))
    return joined.groupBy("panel", "view").agg(*ends[0], *ends[1], F.count(F.lit(1)).alias("n"), F.bool_or(F.col("size") > 30).alias("has_outline"))


def largest_views(spark, sf_dir):
    return P.largest_view(_views(spark, sf_dir), ["panel"])


def elevation_views(spark, sf_dir):
    return P.elevation_candidates(_views(spark, sf_dir), ["panel"], least=20.0).select("panel", "view", "n")


def box_components(spark, sf_dir):
    return B.overlap_components(boxes(spark, sf_dir), ["panel"], "id", gap=12.0)


def box_extents(spark, sf_dir):
    """The common box and the count of every panel's items, and which way it is longer."""
    out = boxes(spark, sf_dir).groupBy("panel").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("orientation", C.box_orientation(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))


def _segments(spark, sf_dir):
    lo = (size() * 10).cast("double")
    return parts(spark, sf_dir, angle_bin=(key() % 4).cast("int"), offset=(key() * 3 % 500).cast("double"), lo=lo, hi=lo + 60 + key() % 90).withColumnRenamed("id", "seg_id")


def rail_pairs(spark, sf_dir):
    return P.rail_candidates(_segments(spark, sf_dir), ["panel"])


def claimed_rails(spark, sf_dir):
    """Rail pairs in order of length, each with the ranges that no longer pair has claimed."""
    return P.claim_segments(_segments(spark, sf_dir), ["panel"])


def reconciled_bars(spark, sf_dir):
    """Bars after all passes against the schedule."""
    marks = _marks(spark, sf_dir).select("panel", "dia", "mark", "qty", "length", F.when(F.col("qty") % 2 == 0, "17A").otherwise("00").alias("shape"), F.array(F.col("length") / 2, F.col("most").cast("double")).alias("segments"))
    bars = _bars(spark, sf_dir).withColumns({"chord": F.col("kg") * 20, "seq": F.col("bar_id"), "length": F.col("length") + F.col("bar_id") % 3})
    counts = parts(spark, sf_dir).groupBy("panel").agg(F.count(F.lit(1)).alias("n"))
    panels = counts.select("panel", (F.col("n") % 3 * 200 + 100).alias("width"), F.lit(100).alias("thickness"), F.lit(1300).alias("height"))
    official = marks.where("mark <> 'ECONOMY'").select("panel", "dia")
    out = P.reconcile(bars, marks, official, panels)
    return out.select("panel", "bar_id", "mark", "dia", "kind", "z_src", F.round("length", 6).alias("length"), F.round("kg", 6).alias("kg"))


def chained_bars(spark, sf_dir):
    """Bars chained end to end from pieces."""
    x, y = (key() * 7 % 60).cast("double"), (key() * 11 % 50).cast("double")
    pieces = parts(spark, sf_dir, x0=x, y0=y, x1=x + size() % 20 + 5, y1=y + key() % 5, dia=(size() % 4 + 8).cast("double"), length=(size() + 10).cast("double")).withColumnRenamed("id", "piece_id")
    out = P.chain_pieces(pieces, ["panel"])
    return out.select("panel", "chain_id", F.array_join("pieces", ",").alias("pieces"), "length", F.round("dia", 6).alias("dia"))


def section_depths(spark, sf_dir):
    """Depths of bars from circles of sections."""
    role = F.when(key() % 2 == 0, "horizontal").otherwise("vertical")
    bars = parts(spark, sf_dir, role=role, radius=(size() % 3 + 4).cast("double"), coord=(key() * 5 % 600).cast("double")).withColumnRenamed("id", "bar_id")
    marks = parts(spark, sf_dir, role=F.when(size() % 2 == 0, "horizontal").when(size().isNotNull(), "vertical"), r=(key() % 3 + 4).cast("double"), c=(key() * 11 % 600).cast("double"), z=(size() * 4).cast("double"), section=key() % 3)
    out = P.depth_lookup(bars, marks, ["panel"])
    return out.select("bar_id", F.round("z", 6).alias("z"), "z_src")


def detail_labels(spark, sf_dir):
    """Labels without a bar nearby that a detail view shows."""
    place = {"x": (key() * 17 % 9000).cast("double"), "y": (key() * 29 % 7000).cast("double")}
    all_parts = parts(spark, sf_dir, **place, length=size().cast("double"), kind=key() % 3)
    labels = all_parts.where("kind = 0").select("panel", F.col("id").alias("label_id"), F.col("x").alias("lx"), F.col("y").alias("ly"), "length")
    bars = all_parts.where("kind = 1").select("panel", F.col("x").alias("bx"), F.col("y").alias("by"))
    details = all_parts.where("kind = 2").select("panel", F.col("x").alias("dx"), F.col("y").alias("dy"), F.col("length").alias("dlength"))
    return P.detail_evidence(labels, bars, details, ["panel"], clear=600.0, reach=900.0).select("panel", "label_id")


def link_clashes(spark, sf_dir):
    x = (key() * 7 % 900).cast("double")
    links = parts(spark, sf_dir, x0=x, x1=x + size(), z=(key() % 90).cast("double")).withColumnRenamed("id", "link_id")
    mesh = parts(spark, sf_dir, pos=(key() * 13 % 900).cast("double"), bz=(key() * 3 % 90).cast("double"), dia=(size() % 9 + 4).cast("double")).withColumnRenamed("id", "bar_id")
    return P.clashes(links, mesh, ["panel"])


def sleeves(spark, sf_dir):
    arcs = parts(spark, sf_dir, x=(key() % 4).cast("double"), y=(key() % 3).cast("double"), radius=(size() % 5 + 1).cast("double"), start=(key() * 37 % 360).cast("double"), end=(key() * 53 % 360).cast("double"))
    return P.sleeve_coverage(arcs, ["panel"], least=400.0)


def mesh_family_rows(spark, sf_dir):
    bars = parts(spark, sf_dir, kind=F.col("p_type"), dia=(size() % 3 * 4 + 8).cast("int"), z=(key() * 7 % 60).cast("double"), pos=(key() * 31 % 2000).cast("double")).withColumnRenamed("id", "bar_id")
    return P.mesh_families(bars)


def _marks(spark, sf_dir):
    """Marks of a panel and diameter: one for each type of part."""
    rows = parts(spark, sf_dir, dia=C.snap_diameter(size()), mark=F.col("p_type"), price=F.col("p_retailprice"), size=size()).where("dia is not null")
    return rows.groupBy("panel", "dia", "mark").agg(F.count(F.lit(1)).alias("qty"), F.round(F.max("price"), 0).alias("length"), F.max("size").alias("most"))


def _bars(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("v-mesh", "shape", "face-dowel"))), (key() % 3).cast("int") + 1)
    z_src = F.when(key() % 5 == 0, "synthesized").when(key() % 5 < 3, "default").otherwise("section")
    rows = parts(spark, sf_dir, dia=C.snap_diameter(size()), kind=kind, z_src=z_src, length=F.round(F.col("p_retailprice"), 0), kg=size().cast("double"), full_span=key() % 2 == 0)
    return rows.where("dia is not null").withColumnRenamed("id", "bar_id")


def dowels_dropped(spark, sf_dir):
    marks = _marks(spark, sf_dir).withColumn("shape", F.when(F.col("qty") % 2 == 0, "17A").otherwise("00"))
    return P.drop_unscheduled_dowels(_bars(spark, sf_dir), marks).select("bar_id", "kind")


def ties_dropped(spark, sf_dir):
    marks = _marks(spark, sf_dir).withColumn("segments", F.array(F.col("length") / 2, F.col("most").cast("double")))
    counts = parts(spark, sf_dir).groupBy("panel").agg(F.count(F.lit(1)).alias("n"))
    panels = counts.select("panel", (F.col("n") % 3 * 200 + 100).alias("width"), F.lit(100).alias("thickness"), F.lit(1300).alias("height"))
    return P.drop_unclaimed_ties(_bars(spark, sf_dir), marks, panels).select("bar_id", "z_src")


def counted_calibration(spark, sf_dir):
    found = _bars(spark, sf_dir).where("kind = 'shape'").groupBy("panel", "dia").agg(F.count(F.lit(1)).alias("n"))
    marks = _marks(spark, sf_dir).join(found, ["panel", "dia"]).withColumn("qty", F.when(F.col("qty") % 2 == 0, F.col("n")).otherwise(F.lit(0)))
    out = P.calibrate_by_count(_bars(spark, sf_dir), marks.drop("n"), "shape")
    return out.select("bar_id", F.round("length", 6).alias("length"), F.round("kg", 6).alias("kg"), "z_src")


def uniform_calibration(spark, sf_dir):
    """Shapes of even length set to the one mark that asks for as many of about another length."""
    bars = _bars(spark, sf_dir).withColumn("length", F.col("dia") * 100.0 + F.col("bar_id") % 3)
    found = bars.where("kind = 'shape'").groupBy("panel", "dia").agg(F.count(F.lit(1)).alias("n"))
    marks = _marks(spark, sf_dir).join(found, ["panel", "dia"]).select("panel", "dia", "mark", F.when(F.length("mark") % 2 == 0, F.col("n")).otherwise(0).alias("qty"), (F.col("dia") * 100.0 + F.col("most") * F.length("mark") * 5).alias("length"))
    out = P.calibrate_uniform(bars, marks)
    return out.select("bar_id", F.round("length", 6).alias("length"), F.round("kg", 6).alias("kg"), "z_src")


def synthesized_bars(spark, sf_dir):
    marks = _marks(spark, sf_dir)
    found = marks.where("most % 2 = 0").select("panel", "mark", "dia", F.floor(F.col("qty") / 2).alias("n"))
    evidence = marks.where("length(mark) > 6")
    return P.synthesize_missing(marks, found, evidence).select("panel", "mark", "dia", "copy_no", "length", F.round("kg", 6).alias("kg"), "z_src")


def missing_on_grid(spark, sf_dir):
    marks = _marks(spark, sf_dir).withColumn("found", F.floor(F.col("qty") / 3))
    return B.lay_out_missing(marks).select("panel", "mark", "dia", "copy_no", "x", "y", F.round("kg", 6).alias("kg"), "z_src")


def mirror_gaps(spark, sf_dir):
    x, z = (key() * 97 % 2900).cast("double"), (key() * 41 % 900).cast("double")
    diagonals = table(spark, sf_dir, "part").select(key().alias("bar_id"), (size() % 4 + 8).cast("double").alias("dia"), x.alias("x0"), z.alias("z0"), (x + 100).alias("x1"), (z + size()).alias("z1"))
    return P.mirror_missing(diagonals, 3000.0, within=60.0).select("bar_id", "x0", "x1")


def hairpins(spark, sf_dir):
    legs = F.array(size() * 10.0, key() % 300 + 1.0, size() * 9.0 + key() % 100)
    return table(spark, sf_dir, "part").select("p_partkey", P.is_hairpin(F.when(key() % 9 == 0, F.slice(legs, 1, 2)).otherwise(legs)).alias("hairpin"))


def leg_fits(spark, sf_dir):
    segments = F.array(*(F.lit(float(v)) for v in (400, 900, 250)))
    a, b, c = F.lit(400.0) + key() % 60, F.lit(900.0) - size() * 3, F.lit(250.0) + size() % 30
    legs = F.element_at(F.array(F.array(a, b, c), F.array(c, b, a), F.array(a, b), F.array(b, c), F.array(c, b), F.array(a)), (key() % 6).cast("int") + 1)
    return table(spark, sf_dir, "part").select("p_partkey", B.legs_match(legs, segments).alias("fit"))


def even_runs(spark, sf_dir):
    items = parts(spark, sf_dir, pos=(key() * 3 % 400 * 10).cast("double"))
    return B.icon_runs(items, ["panel"], 50.0, least=3, stretch=2.0, slack=0.6)


def text_rows(spark, sf_dir):
    """Bars of pitch and count texts over their extents."""
    lo = (key() % 50).cast("double")
    texts = table(spark, sf_dir, "part").select(key().alias("text_id"), size().alias("dia"), F.when(key() % 3 > 0, (size() + 10).cast("double")).alias("pitch"), lo.alias("lo"), (lo + key() % 400).alias("hi"), F.when(key() % 3 == 0, size() % 6).alias("count"))
    return B.rows_from_texts(texts).select("text_id", "dia", "bar_no", F.round("pos", 6).alias("pos"))


def predicted_counts(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select(F.col("p_name").alias("text"), (size() * 100.0).alias("extent"), (F.length("p_name") * 10.0).alias("pitch"))
    return B.predicted_tally(texts)


def section_roles(spark, sf_dir):
    role = B.section_role((size() * 20).cast("double"), F.lit(500.0), (key() % 10 * 100 + 300).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", role.alias("role"))


def classified_sections(spark, sf_dir):
    """Which views are sections, and of which side; panels of every fourth brand have thick walls only."""
    thick = F.when(F.length("p_brand") == 7, 480 + size() % 9 * 30).otherwise(F.when(key() % 9 == 0, 290).otherwise(80 + size() % 50))
    long = F.element_at(F.array(F.lit(1000) - size(), F.lit(1500) + size() * 3, F.lit(700) + key() % 40, F.lit(1000) + key() % 60), (key() % 4).cast("int") + 1)
    x, y = (key() * 37 % 900 - 100).cast("double"), (key() * 53 % 1500 - 100).cast("double")
    flat = size() % 2 == 0
    walls = parts(spark, sf_dir, x0=x, y0=y, x1=x + F.when(flat, long).otherwise(thick), y1=y + F.when(flat, thick).otherwise(long)).withColumnRenamed("id", "view")
    sizes = {"width": 1000.0, "height": 1600.0, "ex0": 0.0, "ey0": 0.0, "ex1": 1000.0, "ey1": 1600.0}
    panels = parts(spark, sf_dir).select("panel").distinct().withColumns({k: F.lit(v) for k, v in sizes.items()})
    return Z.classify_sections(walls, panels).withColumnRenamed("along_x", "is_along_x")


def _uprights(spark, sf_dir):
    lo = (key() * 7 % 900).cast("double")
    return parts(spark, sf_dir, x=(key() * 61 % 1500).cast("double"), z=F.when(size() % 2 == 0, 30.0).otherwise(130.0), dia=(size() % 3 * 4 + 8).cast("int"), lo=lo, hi=lo + 400 + size() * 30)


def _panel_heights(spark, sf_dir):
    return parts(spark, sf_dir).select("panel").distinct().withColumn("height", F.lit(2600.0))


def tie_rows(spark, sf_dir):
    """Ties round neighbouring main bars, by the panel's tie callouts."""
    label = F.concat(F.lit("T"), (size() % 2 * 4 + 6).cast("string"), F.when(key() % 3 == 0, " Ties").otherwise(""), F.lit(" @ "), (key() % 2 * 50 + 100).cast("string"), F.lit("mm"))
    said = parts(spark, sf_dir, c=T.bar_pitch(label)).where("c.kind = 'tie'").select("panel", "c.dia", "c.pitch")
    return Z.tie_stacks(_uprights(spark, sf_dir), said, _panel_heights(spark, sf_dir), reach=60.0)


def hairpin_rows(spark, sf_dir):
    """Hairpins at the ends of bars that both faces share, where no folded bar is."""
    label = F.concat(F.lit("T"), (size() % 2 * 4 + 8).cast("string"), F.lit(" UBAR @ 100mm"))
    said = parts(spark, sf_dir, c=T.bar_pitch(label)).select("panel", "c.dia", "c.pitch")
    bars = _uprights(spark, sf_dir).withColumn("x", F.col("x") % 40 * 30)
    folded = parts(spark, sf_dir, ux=(key() * 61 % 1500).cast("double"), uy=(key() * 7 % 2600).cast("double"), kind=F.col("p_type")).where("kind = 'PROMO'").drop("id", "kind")
    return Z.edge_hairpins(bars, said, folded, _panel_heights(spark, sf_dir))


def hooks_in_rows(spark, sf_dir):
    """Hooks along the rows of icons, as long as the detail views show them."""
    icons = parts(spark, sf_dir, axis=F.when(size() % 2 == 0, "v").otherwise("h"), coord=(key() % 3).cast("double"), pos=(key() * 7 % 130 * 50).cast("double"))
    label = F.concat(F.lit("T"), (size() % 2 * 4 + 8).cast("string"), F.lit(" Hook @ "), (key() % 2 * 50 + 100).cast("string"), F.lit("mm"))
    said = parts(spark, sf_dir, c=T.bar_pitch(label)).select("panel", "c.dia", "c.pitch")
    details = parts(spark, sf_dir, dia=(size() % 3 * 4 + 8).cast("int"), length=(size() * 10).cast("double")).where(F.length("panel") > 7)
    out = Z.hook_rows(icons.drop("id"), details, said, least=3)
    return out.withColumn("length", F.round("length", 6))


def dashed_diagonals(spark, sf_dir):
    lo = (key() * 11 % 5000).cast("double")
    dashes = parts(spark, sf_dir, angle_bin=(key() % 3).cast("int"), offset=(key() * 19 % 3000).cast("double"), lo=lo, hi=lo + 150 + size() * 4)
    out = Z.dashed_lines(dashes)
    return out.withColumn("offset", F.round("offset", 6))


def folded_places(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", B.reflect((key() * 7 - 900).cast("double"), size().cast("double") + 10).alias("place"))


def insert_families(spark, sf_dir):
    out = B.block_families(table(spark, sf_dir, "part").select(F.col("p_name").alias("family"), key().alias("insert_id"), (key() * 7 % 900).cast("double").alias("x"), (size() * 9).cast("double").alias("y")))
    return out.select("family", "copies", F.round("avg_spacing", 6).alias("avg_spacing"), "x0", "x1", F.element_at("ids", 1).alias("first_id"))


def panel_sanity(spark, sf_dir):
    """Findings on panels whose facts are gathered from their bars."""
    bars = parts(spark, sf_dir, length=F.col("p_retailprice") * 2, kg=size() / 10.0, z_low=(key() % 30 - 11).cast("double"), z_high=(key() % 200).cast("double"))
    panels = bars.groupBy("panel").agg(F.count(F.lit(1)).alias("n")).select(F.col("panel").alias("name"), (F.col("n") % 7 * 300.0).alias("width"), (F.col("n") % 5 * 400.0 + 600).alias("height"), (F.col("n") % 3 * 60.0 + 120).alias("thickness"), (F.col("n") % 7 * 0.05).alias("volume"))
    return findings(P.panel_facts(panels, bars), P.sanity_rules(), "name").select("name", "rule", "severity")


def quarantined(spark, sf_dir):
    rules = [Rule("cheap", "WARN", F.col("p_retailprice") < 950), Rule("odd", "ERROR", size() % 2 == 1), Rule("long", "WARN", F.length("p_name") > 10)]
    good, bad = quarantine(table(spark, sf_dir, "part"), rules)
    return good.select("p_partkey", F.lit("").alias("broken")).unionByName(bad.select("p_partkey", F.array_join("broken_rules", "+").alias("broken")))


def path_functions(spark, sf_dir):
    """Directions, offsets, arcs and straightened paths of one row per part."""
    x, y = size().cast("double"), (key() % 17 + 2).cast("double")
    points = F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ((F.lit(0.0), F.lit(0.0)), (x, F.lit(0.0)), (x * 2, F.when(key() % 2 == 0, F.lit(0.0)).otherwise(y)), (x * 2, y * 3))))
    angle = C.canonical_angle(F.lit(0.0), F.lit(0.0), x - 25, y)
    arc = C.arc_points(x, y, F.lit(10.0), y * 10, x * 10, 4)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(angle, 6).alias("angle"), F.abs(F.round(C.normal_offset(x - 20, y, angle), 6)).alias("distance"), F.abs(F.round(C.along(x, y, angle), 6)).alias("along"),
        F.size(arc).alias("arc_n"), F.round(F.element_at(arc, 3)["x"], 6).alias("arc_x"), F.round(F.element_at(arc, -1)["y"], 6).alias("arc_y"),
        F.size(C.drop_collinear(points)).alias("corners"),
    )


def rounding_modes(spark, sf_dir):
    """Half-even, floor and half-up rounding, and array and map forms of a row."""
    v = (key() % 40 - 20) / 4.0
    items = F.array(key() % 5, size() % 3, key() % 5, size() % 7)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.bround(v, 0).cast("long").alias("half_even"), F.floor(v).alias("down"), F.floor(v + 0.5).alias("half_up"),
        F.array_join(F.array_sort(F.array_distinct(items)), ",").alias("sorted_set"), F.array_min(items).alias("least"), F.array_join(F.reverse(F.slice(items, 2, 2)), ",").alias("reversed"),
        F.array_join(F.transform(F.arrays_zip(items.alias("a"), F.reverse(items).alias("b")), lambda p: p["a"] * 10 + p["b"]), ",").alias("zipped"),
        F.coalesce(F.try_element_at(F.create_map(F.lit(1), F.lit("one"), F.lit(2), F.lit("two")), (size() % 4).cast("int")), F.lit("none")).alias("looked_up"),
    )


def wall_clock_instants(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    clock = F.format_string("%02d:%02d:00", (F.col("o_orderkey") % 24).cast("int"), (F.col("o_orderkey") % 60).cast("int"))
    at = C.to_instant(F.col("o_orderdate").cast("date"), clock)
    return rows.select("o_orderkey", at.cast("string").alias("instant"), C.business_day(at).cast("string").alias("day"))


def label_texts(spark, sf_dir):
    """Diameters that a text mentions, its location words, its report label, and the bytes of a data URL."""
    text = F.concat(F.lit("T"), size().cast("string"), F.lit(" and T"), (key() % 4 * 4 + 8).cast("string"), F.lit("; XT9 T"), size().cast("string"))
    cells = F.array(F.element_at(F.array(*map(F.lit, ("WALL", "wall A", "Mould", "FACE", "OPENING"))), (key() % 5).cast("int") + 1), F.concat(F.lit("- "), size().cast("string"), F.lit(" mm")), F.col("p_name"))
    url = F.concat(F.when(key() % 3 > 0, "data:text/plain;base64,").otherwise("none "), F.base64(F.col("p_name").cast("binary")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(T.diameters(text), ",").alias("diameters"), T.locations(cells).alias("locations"), T.diameter_label(F.when(key() % 7 > 0, size().cast("double"))).alias("label"), T.data_url_bytes(url).cast("string").alias("decoded"),
    )


def corner_filters(spark, sf_dir):
    """Paths with any, and with all, of their corners inside a box, and layers by prefix."""
    points = F.array(*(F.struct((key() * a % 100).cast("double").alias("x"), (key() * b % 80).cast("double").alias("y")) for a, b in ((3, 7), (11, 5), (17, 19))))
    layer = F.concat(F.upper(F.substring("p_type", 1, 3)), F.lit("-"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", P.any_inside(points, 20.0, 20.0, 60.0, 60.0, 5.0).alias("any_inside"), P.all_inside(points, 10.0, 10.0, 90.0, 70.0).alias("all_inside"), P.on_layers(layer, ["ECO-Brand#2"], ["STA", "MED-"]).alias("wanted"),
    )


def near_duplicate_segments(spark, sf_dir):
    x, y = (key() * 7 % 60).cast("double"), (key() * 3 % 40).cast("double")
    rows = parts(spark, sf_dir, x0=x, y0=y, x1=x + 100, y1=y, length=F.lit(100.0) + size() % 4)
    return near_duplicates(rows, ["panel"], "id").select("panel", "id")


def arc_partners(spark, sf_dir):
    """Concentric arcs one bar apart."""
    arcs = parts(spark, sf_dir, x=(key() % 9).cast("double"), y=(size() % 5).cast("double"), radius=(key() * 7 % 300).cast("double"), start=(key() * 11 % 90).cast("double")).withColumnRenamed("id", "arc_id")
    return P.pair_arcs(arcs, ["panel"])


def bridged_stubs(spark, sf_dir):
    stubs = parts(spark, sf_dir, side=F.when(key() % 2 == 0, "lo").otherwise("hi"), pos=(key() * 13 % 400).cast("double"), dia=(size() % 5 + 8).cast("double")).withColumnRenamed("id", "stub_id")
    return B.bridge_stubs(stubs, ["panel"])


def attached_legs(spark, sf_dir):
    place = parts(spark, sf_dir, x=(key() * 17 % 300).cast("double"), y=(size() * 3).cast("double"))
    dowels = place.where(F.col("id") % 3 == 0).withColumnRenamed("id", "dowel_id")
    ends = place.where(F.col("id") % 3 > 0).select("panel", F.col("id").alias("leg_id"), F.col("x").alias("ex"), F.col("y").alias("ey"))
    return B.attach_legs(dowels, ends, ["panel"])


def folded_copies(spark, sf_dir):
    profile = F.when(key() % 3 == 0, F.array(size() * 1.0, key() % 50 * 1.0)).otherwise(F.array(size() * 1.0, key() % 40 * 1.0, size() * 2.0))
    return B.fold_copies(parts(spark, sf_dir, profile=profile).withColumnRenamed("id", "bar_id"), ["panel"])


def two_leg_marks(spark, sf_dir):
    all_parts = parts(spark, sf_dir, length=(key() * 7 % 400 + 100).cast("double"), seg1=(size() * 9 + 50).cast("double"), qty=size() % 3)
    marks = all_parts.where(F.col("id") % 9 == 0).select("panel", F.col("id").alias("row_id"), F.col("id").alias("seq"), F.col("length").alias("seg0"), "seg1", "qty")
    return B.match_two_legs(marks, all_parts.where(F.col("id") % 9 > 0).select("panel", F.col("id").alias("frag_id"), "length"), ["panel"])


def mark_counts(spark, sf_dir):
    """What marks count to when instances near another of their view are one, and views show the same bars."""
    rows = parts(spark, sf_dir, mark=F.col("p_type"), dia=(size() % 2).cast("int"), view=F.when(key() % 5 > 0, key() % 5), seq=key(), x=(key() * 37 % 2000).cast("double"), y=(size() * 10).cast("double"), count=(size() % 4 + 1).cast("long"))
    return P.mark_true_count(rows.drop("id"))


def sorted_bar_list(spark, sf_dir):
    """The bar list by length, then weight, longest first, with its place in that order, and in the print order."""
    from pyspark.sql import Window

    rows = _bars(spark, sf_dir).select("panel", "bar_id", "dia", "length", "kg")
    at = F.row_number().over(Window.partitionBy("panel").orderBy(F.desc("length"), F.desc("kg"), "bar_id"))
    printed = F.row_number().over(Window.partitionBy("panel").orderBy("dia", F.desc("length"), "bar_id"))
    return rows.withColumns({"place": at, "print_place": printed}).select("panel", "bar_id", "place", "print_place")


def deficit_report(spark, sf_dir):
    """Panels by what they lack against the schedule, the most first."""
    from pyspark.sql import Window

    need = _marks(spark, sf_dir).groupBy("panel").agg(F.sum(F.col("qty") * F.col("most")).alias("need"))
    have = _bars(spark, sf_dir).where("z_src <> 'default'").groupBy("panel").agg(F.sum("kg").cast("long").alias("have"))
    gap = (F.col("need") - F.coalesce("have", F.lit(0))).alias("deficit")
    rows = need.join(have, "panel", "left").select("panel", gap)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("deficit"), "panel"))).orderBy("place")


QUERIES = {f.__name__: f for f in (view_members, largest_views, elevation_views, box_components, box_extents, rail_pairs, claimed_rails, chained_bars, reconciled_bars, section_depths, detail_labels, link_clashes, sleeves, mesh_family_rows, dowels_dropped, ties_dropped, counted_calibration, uniform_calibration, synthesized_bars, missing_on_grid, mirror_gaps, hairpins, leg_fits, even_runs, text_rows, predicted_counts, section_roles, classified_sections, tie_rows, hairpin_rows, hooks_in_rows, dashed_diagonals, folded_places, insert_families, panel_sanity, quarantined, path_functions, rounding_modes, wall_clock_instants, label_texts, corner_filters, near_duplicate_segments, arc_partners, bridged_stubs, attached_legs, folded_copies, two_leg_marks, mark_counts, sorted_bar_list, deficit_report)}

_BOXES = "boxes AS (SELECT p_brand AS panel, p_partkey AS id, CAST(p_partkey * 7 % 900 AS DOUBLE) AS x0, CAST(p_partkey * 13 % 700 AS DOUBLE) AS y0, CAST(p_partkey * 7 % 900 + p_size AS DOUBLE) AS x1, CAST(p_partkey * 13 % 700 + p_partkey % 11 + 5 AS DOUBLE) AS y1, p_size AS size FROM part)"
_MEMBERS = f"""WITH RECURSIVE {_BOXES},
    cells AS (SELECT panel, id, cx, unnest(range(CAST(floor((y0 - 6) / 25) AS BIGINT), CAST(floor((y1 + 6) / 25) AS BIGINT) + 1)) AS cy FROM (SELECT *, unnest(range(CAST(floor((x0 - 6) / 25) AS BIGINT), CAST(floor((x1 + 6) / 25) AS BIGINT) + 1)) AS cx FROM boxes)),
    near AS (SELECT DISTINCT a.id AS a, b.id AS b FROM cells a JOIN cells b ON a.panel = b.panel AND a.cx = b.cx AND a.cy = b.cy),
    reach AS (SELECT id AS a, id AS b FROM boxes UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
    members AS (SELECT boxes.panel, boxes.id, MIN(b) AS view FROM boxes JOIN reach ON a = id GROUP BY 1, 2),
    views AS (SELECT m.panel, view, MIN(x0) AS x0, MIN(y0) AS y0, MAX(x1) AS x1, MAX(y1) AS y1, COUNT(*) AS n, bool_or(size > 30) AS has_outline FROM members m JOIN boxes USING (id) GROUP BY 1, 2) """
_PARTS = f"""marks AS (SELECT p_brand AS panel, dia, p_type AS mark, COUNT(*) AS qty, ROUND(MAX(p_retailprice), 0) AS length, MAX(p_size) AS most FROM (SELECT *, {SNAP_SQL} AS dia FROM part) WHERE dia IS NOT NULL GROUP BY 1, 2, 3),
    bars AS (SELECT p_brand AS panel, p_partkey AS bar_id, dia, CASE p_partkey % 3 WHEN 0 THEN 'v-mesh' WHEN 1 THEN 'shape' ELSE 'face-dowel' END AS kind, CASE WHEN p_partkey % 5 = 0 THEN 'synthesized' WHEN p_partkey % 5 < 3 THEN 'default' ELSE 'section' END AS z_src,
        ROUND(p_retailprice, 0) AS length, CAST(p_size AS DOUBLE) AS kg, p_partkey % 2 = 0 AS full_span FROM (SELECT *, {SNAP_SQL} AS dia FROM part) WHERE dia IS NOT NULL)"""
_KG = "CAST(dia AS DOUBLE) * CAST(dia AS DOUBLE) / 162.0::DOUBLE * {} / 1000"
_RAILS = """WITH s AS (SELECT p_brand AS panel, p_partkey AS id, CAST(p_partkey % 4 AS INT) AS angle_bin, CAST(p_partkey * 3 % 500 AS DOUBLE) AS o, p_size * 10.0::DOUBLE AS lo, p_size * 10.0::DOUBLE + 60 + p_partkey % 90 AS hi FROM part),
    rails AS (SELECT a.panel, a.angle_bin, a.id AS a, b.id AS b, b.o - a.o AS gap, GREATEST(a.lo, b.lo) AS lo, LEAST(a.hi, b.hi) AS hi FROM s a JOIN s b ON a.panel = b.panel AND a.angle_bin = b.angle_bin AND b.o - a.o BETWEEN 5 AND 34 WHERE LEAST(a.hi, b.hi) - GREATEST(a.lo, b.lo) >= 30) """
_UPRIGHTS = "WITH up AS (SELECT p_brand AS panel, CAST(p_partkey * 61 % 1500 AS DOUBLE) AS x, CASE WHEN p_size % 2 = 0 THEN 30.0::DOUBLE ELSE 130.0::DOUBLE END AS z, CAST(p_size % 3 * 4 + 8 AS INT) AS dia, CAST(p_partkey * 7 % 900 AS DOUBLE) AS lo, CAST(p_partkey * 7 % 900 + 400 + p_size * 30 AS DOUBLE) AS hi FROM part)"
ORACLES = {
    "view_members": _MEMBERS + "SELECT * FROM members",
    "largest_views": _MEMBERS + "SELECT panel, view, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY (x1 - x0) * (y1 - y0) DESC, view) AS rn FROM views) WHERE rn = 1",
    "elevation_views": _MEMBERS + "SELECT panel, view, n FROM (SELECT *, MAX(n) OVER (PARTITION BY panel) AS most FROM views) WHERE n >= 0.3 * most AND has_outline AND LEAST(x1 - x0, y1 - y0) >= 20",
    "box_components": f"""WITH RECURSIVE {_BOXES}, near AS (SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.panel = b.panel AND a.x0 <= b.x1 + 12 AND b.x0 <= a.x1 + 12 AND a.y0 <= b.y1 + 12 AND b.y0 <= a.y1 + 12),
        reach AS (SELECT id AS a, id AS b FROM boxes UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a) SELECT panel, id, MIN(b) AS component FROM boxes JOIN reach ON a = id GROUP BY 1, 2""",
    "box_extents": f"WITH {_BOXES}, e AS (SELECT panel, MIN(x0) AS x0, MIN(y0) AS y0, MAX(x1) AS x1, MAX(y1) AS y1, COUNT(*) AS n FROM boxes GROUP BY 1) SELECT *, CASE WHEN x1 - x0 > 2 * (y1 - y0) THEN 'Horizontal' WHEN y1 - y0 > 2 * (x1 - x0) THEN 'Vertical' ELSE 'Other' END AS orientation FROM e",
    "rail_pairs": _RAILS + "SELECT * FROM rails",
    "claimed_rails": _RAILS.replace("WITH", "WITH RECURSIVE", 1) + """, c AS (SELECT *, row_number() OVER (PARTITION BY panel, angle_bin ORDER BY hi - lo DESC, gap, a, b) AS n FROM rails),
        f AS (SELECT DISTINCT panel, angle_bin, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS gap, CAST([] AS STRUCT(lo DOUBLE, hi DOUBLE)[]) AS pieces, CAST([] AS STRUCT(rail BIGINT, lo DOUBLE, hi DOUBLE)[]) AS taken FROM c
        UNION ALL SELECT panel, angle_bin, n, a, b, gap, pieces, list_concat(taken, list_concat(list_transform(pieces, lambda p: {'rail': a, 'lo': p.lo, 'hi': p.hi}), list_transform(pieces, lambda p: {'rail': b, 'lo': p.lo, 'hi': p.hi})))
            FROM (SELECT *, list_filter(list_transform(list_filter(list_distinct(list_concat([lo], list_transform(own, lambda s: s.hi))), lambda p: p >= lo AND p < hi AND len(list_filter(own, lambda s: s.lo <= p AND p < s.hi)) = 0), lambda p: {'lo': p, 'hi': list_min(list_concat([hi], list_filter(list_transform(own, lambda s: s.lo), lambda q: q > p)))}), lambda x: x.hi - x.lo >= 30) AS pieces
                FROM (SELECT f.panel, f.angle_bin, c.n, c.a, c.b, c.gap, c.lo, c.hi, f.taken, list_filter(f.taken, lambda t: t.rail = c.a OR t.rail = c.b) AS own FROM f JOIN c ON c.panel = f.panel AND c.angle_bin = f.angle_bin AND c.n = f.n + 1)))
        SELECT panel, angle_bin, a, b, gap, p.lo AS lo, p.hi AS hi FROM (SELECT *, unnest(pieces) AS p FROM f WHERE n > 0)""",
    "chained_bars": """WITH RECURSIVE p AS (SELECT p_brand AS panel, p_partkey AS id, CAST(p_partkey * 7 % 60 AS DOUBLE) AS x0, CAST(p_partkey * 11 % 50 AS DOUBLE) AS y0, CAST(p_partkey * 7 % 60 + p_size % 20 + 5 AS DOUBLE) AS x1, CAST(p_partkey * 11 % 50 + p_partkey % 5 AS DOUBLE) AS y1, p_size % 4 + 8.0::DOUBLE AS dia, p_size + 10.0::DOUBLE AS len FROM part),
        f AS (SELECT panel, CAST(0 AS BIGINT) AS n, 'new' AS act, list({'id': id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'dia': dia, 'len': len} ORDER BY id) AS free, CAST([] AS BIGINT[]) AS chain, 1 AS side, 0.0::DOUBLE AS ax, 0.0::DOUBLE AS ay, 0.0::DOUBLE AS bx, 0.0::DOUBLE AS by_, 0.0::DOUBLE AS sdia, 0.0::DOUBLE AS total, 0.0::DOUBLE AS weighed FROM p GROUP BY 1
        UNION ALL SELECT panel, n + 1,
            CASE WHEN act = 'new' THEN 'grow' WHEN best IS NOT NULL THEN 'grow' WHEN side = 1 THEN 'grow' ELSE 'new' END,
            CASE WHEN act = 'new' THEN free[2:] WHEN best IS NOT NULL THEN list_filter(free, lambda r: r.id <> best.id) ELSE free END,
            CASE WHEN act = 'new' THEN [free[1].id] WHEN best IS NULL THEN chain WHEN side = 1 THEN list_append(chain, best.id) ELSE list_prepend(best.id, chain) END,
            CASE WHEN act = 'new' THEN 1 WHEN best IS NULL AND side = 1 THEN 0 ELSE side END,
            CASE WHEN act = 'new' THEN free[1].x0 WHEN best IS NOT NULL AND side = 0 THEN best.fx ELSE ax END, CASE WHEN act = 'new' THEN free[1].y0 WHEN best IS NOT NULL AND side = 0 THEN best.fy ELSE ay END,
            CASE WHEN act = 'new' THEN free[1].x1 WHEN best IS NOT NULL AND side = 1 THEN best.fx ELSE bx END, CASE WHEN act = 'new' THEN free[1].y1 WHEN best IS NOT NULL AND side = 1 THEN best.fy ELSE by_ END,
            CASE WHEN act = 'new' THEN free[1].dia ELSE sdia END, CASE WHEN act = 'new' THEN free[1].len WHEN best IS NOT NULL THEN total + best.len ELSE total END, CASE WHEN act = 'new' THEN free[1].len * free[1].dia WHEN best IS NOT NULL THEN weighed + best.len * best.dia ELSE weighed END
            FROM (SELECT *, CASE WHEN act = 'grow' THEN list_min(list_filter(list_concat(list_transform(list_filter(free, lambda r: abs(r.dia - sdia) <= 1.9), lambda r: {'d': sqrt((r.x0 - ex) * (r.x0 - ex) + (r.y0 - ey) * (r.y0 - ey)), 'id': r.id, 'fx': r.x1, 'fy': r.y1, 'len': r.len, 'dia': r.dia}),
                list_transform(list_filter(free, lambda r: abs(r.dia - sdia) <= 1.9), lambda r: {'d': sqrt((r.x1 - ex) * (r.x1 - ex) + (r.y1 - ey) * (r.y1 - ey)), 'id': r.id, 'fx': r.x0, 'fy': r.y0, 'len': r.len, 'dia': r.dia})), lambda c: c.d <= 4)) END AS best
                FROM (SELECT *, CASE WHEN side = 1 THEN bx ELSE ax END AS ex, CASE WHEN side = 1 THEN by_ ELSE ay END AS ey FROM f WHERE act = 'grow' OR len(free) > 0)))
        SELECT panel, list_min(chain) AS chain_id, array_to_string(chain, ',') AS pieces, total AS length, ROUND(weighed / total, 6) AS dia FROM f WHERE act = 'new' AND n > 0""",
    "reconciled_bars": f"""WITH {_PARTS},
        b0 AS (SELECT panel, bar_id, dia, kind, z_src, length + bar_id % 3 AS length, kg, full_span, kg * 20 AS chord FROM bars), o AS (SELECT DISTINCT panel, dia FROM marks WHERE mark <> 'ECONOMY'),
        b1 AS (SELECT * FROM b0 b WHERE NOT (kind = 'v-mesh' AND z_src <> 'synthesized' AND EXISTS (SELECT 1 FROM o WHERE o.panel = b.panel) AND NOT EXISTS (SELECT 1 FROM o WHERE o.panel = b.panel AND o.dia = b.dia))),
        dow AS (SELECT panel, dia, bool_or(qty % 2 = 0) AS d FROM marks GROUP BY 1, 2), b2 AS (SELECT b1.* FROM b1 LEFT JOIN dow USING (panel, dia) WHERE NOT (kind = 'face-dowel' AND NOT COALESCE(d, TRUE))),
        fl AS (SELECT panel, dia, MIN(GREATEST(length / 2, most)) AS least FROM marks GROUP BY 1, 2), b3 AS (SELECT b2.* FROM b2 LEFT JOIN fl USING (panel, dia) WHERE NOT COALESCE(kind = 'v-mesh' AND chord < 0.5::DOUBLE * least, FALSE)),
        n AS (SELECT p_brand AS panel, COUNT(*) % 3 * 200 + 100 AS width FROM part GROUP BY 1), w AS (SELECT panel, dia, unnest([length, length / 2, CAST(most AS DOUBLE)]) AS want FROM marks),
        b4 AS (SELECT * FROM b3 b WHERE NOT (full_span AND z_src = 'default' AND EXISTS (SELECT 1 FROM n WHERE n.panel = b.panel AND 1300 >= 4 * width) AND NOT EXISTS (SELECT 1 FROM w WHERE w.panel = b.panel AND w.dia = b.dia AND abs(b.length - want) <= GREATEST(30.0::DOUBLE, 0.08::DOUBLE * b.length)))),
        c5 AS (SELECT panel, dia, MAX(m.length) AS len FROM marks m JOIN (SELECT panel, dia, COUNT(*) AS n FROM b4 WHERE kind = 'shape' GROUP BY 1, 2) USING (panel, dia) WHERE qty = n GROUP BY 1, 2 HAVING COUNT(*) = 1),
        b5 AS (SELECT panel, bar_id, dia, kind, CASE WHEN hit THEN 'calibrated' ELSE z_src END AS z_src, CASE WHEN hit THEN len ELSE length END AS length, CASE WHEN hit THEN {_KG.format('len')} ELSE kg END AS kg FROM (SELECT b4.*, len, kind = 'shape' AND len IS NOT NULL AS hit FROM b4 LEFT JOIN c5 USING (panel, dia))),
        need AS (SELECT panel, dia, SUM({_KG.format('length')} * qty) AS need FROM marks GROUP BY 1, 2), oth AS (SELECT panel, dia, SUM(kg) AS other FROM b5 WHERE NOT (kind IN ('v-mesh', 'h-mesh') AND z_src <> 'section') GROUP BY 1, 2),
        r6 AS (SELECT b5.*, need, COALESCE(other, 0) AS other, kind IN ('v-mesh', 'h-mesh') AND z_src <> 'section' AS cand FROM b5 LEFT JOIN need USING (panel, dia) LEFT JOIN oth USING (panel, dia)),
        b6 AS (SELECT * FROM (SELECT *, SUM(kg) OVER (PARTITION BY panel, dia, cand ORDER BY bar_id DESC) AS rest FROM r6) WHERE NOT cand OR need IS NULL OR rest <= need - other + 1e-9),
        have AS (SELECT panel, dia, CAST(COUNT(*) AS BIGINT) AS have FROM b6 GROUP BY 1, 2), m7 AS (SELECT m.*, COALESCE(have, 0) AS have, COALESCE(SUM(qty) OVER (PARTITION BY m.panel, m.dia ORDER BY mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM marks m LEFT JOIN have USING (panel, dia)),
        s7 AS (SELECT panel, mark, dia, length, unnest(range(0, CAST(qty - GREATEST(0, LEAST(qty, have - before)) AS BIGINT))) AS i FROM m7)
        SELECT panel, bar_id, CAST(NULL AS VARCHAR) AS mark, dia, kind, z_src, ROUND(length, 6) AS length, ROUND(kg, 6) AS kg FROM b6 UNION ALL SELECT panel, NULL, mark, dia, 'shape', 'synthesized', ROUND(length, 6), ROUND({_KG.format('length')}, 6) FROM s7""",
    "section_depths": """WITH b AS (SELECT p_brand AS panel, p_partkey AS bar_id, p_partkey % 2 = 0 AS role, p_size % 3 + 4 AS radius, p_partkey * 5 % 600 AS coord FROM part),
        m AS (SELECT p_brand AS panel, p_size % 2 = 0 AS role, p_partkey % 3 + 4 AS r, p_partkey * 11 % 600 AS c, p_size * 4 AS z, p_partkey % 3 AS section FROM part),
        h AS (SELECT bar_id, z, section, abs(c - coord) AS off FROM b JOIN m USING (panel, role) WHERE abs(c - coord) <= 40 AND abs(r - radius) <= 0.5),
        f AS (SELECT *, CASE WHEN z - LAG(z) OVER (PARTITION BY bar_id ORDER BY z) <= 8 THEN 0 ELSE 1 END AS new FROM h), g AS (SELECT *, SUM(new) OVER (PARTITION BY bar_id ORDER BY z ROWS UNBOUNDED PRECEDING) AS run FROM f),
        s AS (SELECT bar_id, run, AVG(z) AS z, MIN(off) AS off, COUNT(DISTINCT section) AS n FROM g GROUP BY 1, 2)
        SELECT bar_id, ROUND(z, 6) AS z, CASE WHEN n >= 2 OR off <= 15 THEN 'section' ELSE 'section-weak' END AS z_src FROM (SELECT *, row_number() OVER (PARTITION BY bar_id ORDER BY off, run) AS rn FROM s) WHERE rn = 1""",
    "detail_labels": """WITH p AS (SELECT p_brand AS panel, p_partkey AS id, p_partkey * 17 % 9000 AS x, p_partkey * 29 % 7000 AS y, p_size AS n, p_partkey % 3 AS kind FROM part)
        SELECT panel, id AS label_id FROM p l WHERE kind = 0 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.kind = 1 AND b.panel = l.panel AND (b.x - l.x) * (b.x - l.x) + (b.y - l.y) * (b.y - l.y) <= 360000)
        AND EXISTS (SELECT 1 FROM p d WHERE d.kind = 2 AND d.panel = l.panel AND (d.x - l.x) * (d.x - l.x) + (d.y - l.y) * (d.y - l.y) <= 810000 AND abs(d.n - l.n) <= 0.3::DOUBLE * l.n)""",
    "link_clashes": """WITH l AS (SELECT p_brand AS panel, p_partkey AS link_id, p_partkey * 7 % 900 AS x0, p_partkey * 7 % 900 + p_size AS x1, p_partkey % 90 AS z FROM part), m AS (SELECT p_brand AS panel, p_partkey * 13 % 900 AS pos, p_partkey * 3 % 90 AS bz, p_size % 9 + 4 AS dia FROM part),
        s AS (SELECT link_id, CAST(MAX(bz + dia - z) AS DOUBLE) AS up, CAST(MAX(z - bz + dia) AS DOUBLE) AS down FROM l JOIN m ON l.panel = m.panel AND pos BETWEEN x0 AND x1 AND abs(z - bz) < dia GROUP BY 1) SELECT link_id, CASE WHEN up < down THEN up WHEN down < up THEN -down END AS "offset" FROM s""",
    "sleeves": """WITH a AS (SELECT p_brand AS panel, CAST(p_partkey % 4 AS DOUBLE) AS x, CAST(p_partkey % 3 AS DOUBLE) AS y, CAST(p_size % 5 + 1 AS DOUBLE) AS radius, ((p_partkey * 53 % 360 - p_partkey * 37 % 360) % 360 + 360) % 360 AS d FROM part)
        SELECT panel, x, y, radius, CAST(SUM(CASE WHEN d = 0 THEN 360 ELSE d END) AS DOUBLE) AS sweep FROM a GROUP BY 1, 2, 3, 4 HAVING SUM(CASE WHEN d = 0 THEN 360 ELSE d END) >= 400""",
    "mesh_family_rows": """WITH RECURSIVE b AS (SELECT p_brand AS panel, p_type AS kind, CAST(p_size % 3 * 4 + 8 AS INT) AS dia, CAST(p_partkey * 7 % 60 AS DOUBLE) AS z, CAST(p_partkey * 31 % 2000 AS DOUBLE) AS pos, p_partkey AS id FROM part),
        anchors AS (SELECT panel, kind, dia, MIN(z) AS a FROM b GROUP BY 1, 2, 3 UNION ALL SELECT a.panel, a.kind, a.dia, (SELECT MIN(z) FROM b WHERE b.panel = a.panel AND b.kind = a.kind AND b.dia = a.dia AND z > a + 8) FROM anchors a WHERE a.a IS NOT NULL),
        g AS (SELECT b.*, a, pos - LAG(pos) OVER (PARTITION BY panel, kind, dia, a ORDER BY pos, id) AS gap FROM b JOIN anchors USING (panel, kind, dia) WHERE z BETWEEN a AND a + 8),
        m AS (SELECT panel, kind, dia, a, round_even(gap / 5, 0) * 5 AS s, COUNT(*) AS n FROM g WHERE gap > 20 AND gap < 600 GROUP BY ALL),
        best AS (SELECT panel, kind, dia, a, s FROM (SELECT *, row_number() OVER (PARTITION BY panel, kind, dia, a ORDER BY n DESC, s) AS rn FROM m) WHERE rn = 1)
        SELECT c.panel, c.kind, c.dia, c.a AS z, c.n, s AS spacing FROM (SELECT panel, kind, dia, a, COUNT(*) AS n FROM g GROUP BY ALL HAVING COUNT(*) >= 2) c LEFT JOIN best USING (panel, kind, dia, a)""",
    "dowels_dropped": f"WITH {_PARTS}, f AS (SELECT panel, dia, bool_or(qty % 2 = 0) AS dowel FROM marks GROUP BY 1, 2) SELECT bar_id, kind FROM bars LEFT JOIN f USING (panel, dia) WHERE NOT (kind = 'face-dowel' AND NOT COALESCE(dowel, TRUE))",
    "ties_dropped": f"""WITH {_PARTS}, n AS (SELECT p_brand AS panel, COUNT(*) % 3 * 200 + 100 AS width FROM part GROUP BY 1), w AS (SELECT panel, dia, unnest([length, length / 2, CAST(most AS DOUBLE)]) AS want FROM marks)
        SELECT bar_id, z_src FROM bars b WHERE NOT (full_span AND z_src = 'default' AND EXISTS (SELECT 1 FROM n WHERE n.panel = b.panel AND 1300 >= 4 * width) AND NOT EXISTS (SELECT 1 FROM w WHERE w.panel = b.panel AND w.dia = b.dia AND abs(b.length - want) <= GREATEST(30.0::DOUBLE, 0.08::DOUBLE * b.length)))""",
    "counted_calibration": f"""WITH {_PARTS}, n AS (SELECT panel, dia, COUNT(*) AS n FROM bars WHERE kind = 'shape' GROUP BY 1, 2), f AS (SELECT panel, dia, MAX(length) AS len FROM marks JOIN n USING (panel, dia) WHERE qty % 2 = 0 GROUP BY 1, 2 HAVING COUNT(*) = 1)
        SELECT bar_id, ROUND(CASE WHEN hit THEN len ELSE length END, 6) AS length, ROUND(CASE WHEN hit THEN {_KG.format('len')} ELSE kg END, 6) AS kg, CASE WHEN hit THEN 'calibrated' ELSE z_src END AS z_src FROM (SELECT bars.*, len, kind = 'shape' AND len IS NOT NULL AS hit FROM bars LEFT JOIN f USING (panel, dia))""",
    "uniform_calibration": f"""WITH {_PARTS}, b AS (SELECT panel, bar_id, dia, kind, z_src, kg, dia * 100.0::DOUBLE + bar_id % 3 AS length FROM bars), n AS (SELECT panel, dia, COUNT(*) AS n, MIN(length) AS lo, MAX(length) AS hi FROM b WHERE kind = 'shape' GROUP BY 1, 2),
        m AS (SELECT panel, dia, mark, CASE WHEN length(mark) % 2 = 0 THEN n ELSE 0 END AS qty, dia * 100.0::DOUBLE + most * length(mark) * 5 AS len, n, lo, hi FROM marks JOIN n USING (panel, dia)),
        g AS (SELECT * FROM m WHERE qty = n AND hi - lo <= 0.05::DOUBLE * hi AND NOT abs(hi - len) <= 0.05::DOUBLE * GREATEST(hi, len) AND NOT EXISTS (SELECT 1 FROM m o WHERE o.panel = m.panel AND o.dia = m.dia AND o.mark <> m.mark AND abs(o.len - m.len) <= 0.10::DOUBLE * m.len)),
        f AS (SELECT panel, dia, arg_min(len, mark) AS len FROM g GROUP BY 1, 2)
        SELECT bar_id, ROUND(CASE WHEN hit THEN len ELSE length END, 6) AS length, ROUND(CASE WHEN hit THEN {_KG.format('len')} ELSE kg END, 6) AS kg, CASE WHEN hit THEN 'calibrated' ELSE z_src END AS z_src FROM (SELECT b.*, len, kind = 'shape' AND len IS NOT NULL AS hit FROM b LEFT JOIN f USING (panel, dia))""",
    "synthesized_bars": f"""WITH {_PARTS} SELECT panel, mark, dia, CAST(unnest(range(1, qty - CASE WHEN most % 2 = 0 THEN qty // 2 ELSE 0 END + 1)) AS INT) AS copy_no, length, ROUND({_KG.format('length')}, 6) AS kg, 'synthesized' AS z_src FROM marks WHERE length(mark) > 6""",
    "missing_on_grid": f"""WITH {_PARTS}, r AS (SELECT *, CAST(unnest(range(0, qty - qty // 3)) AS INT) AS copy_no FROM marks) SELECT panel, mark, dia, copy_no, copy_no % 4 * 500.0::DOUBLE AS x, copy_no // 4 * 300.0::DOUBLE AS y, ROUND({_KG.format('length')}, 6) AS kg, 'synthesized' AS z_src FROM r""",
    "mirror_gaps": """WITH d AS (SELECT p_partkey AS id, p_size % 4 + 8 AS dia, p_partkey * 97 % 2900 AS x0, p_partkey * 41 % 900 AS z0, p_partkey * 97 % 2900 + 100 AS x1, p_partkey * 41 % 900 + p_size AS z1 FROM part), i AS (SELECT id, dia, 3000 - x1 AS x0, z0, 3000 - x0 AS x1, z1 FROM d)
        SELECT id AS bar_id, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1 FROM i WHERE NOT EXISTS (SELECT 1 FROM d WHERE abs(d.x0 - i.x0) <= 60 AND abs(d.x1 - i.x1) <= 60 AND abs(d.z0 - i.z0) <= 60 AND abs(d.z1 - i.z1) <= 60 AND abs(d.dia - i.dia) <= 0.5)""",
    "hairpins": "SELECT p_partkey, p_partkey % 9 <> 0 AND abs(a - c) <= 0.3::DOUBLE * GREATEST(a, c) AND b < LEAST(a, c) AS hairpin FROM (SELECT p_partkey, p_size * 10.0::DOUBLE AS a, p_partkey % 300 + 1.0::DOUBLE AS b, p_size * 9.0::DOUBLE + p_partkey % 100 AS c FROM part)",
    "leg_fits": """WITH p AS (SELECT p_partkey AS k, p_partkey % 6 AS f, 400.0::DOUBLE + p_partkey % 60 AS a, 900.0::DOUBLE - p_size * 3 AS b, 250.0::DOUBLE + p_size % 30 AS c FROM part),
        l AS (SELECT k, CASE f WHEN 0 THEN [a, b, c] WHEN 1 THEN [c, b, a] WHEN 2 THEN [a, b] WHEN 3 THEN [b, c] WHEN 4 THEN [c, b] ELSE [a] END AS legs FROM p),
        w AS (SELECT * FROM (VALUES (1, [400.0::DOUBLE, 900, 250]), (2, [250.0::DOUBLE, 900, 400]), (3, [900.0::DOUBLE, 250]), (4, [400.0::DOUBLE, 900]), (5, [250.0::DOUBLE, 900]), (6, [900.0::DOUBLE, 400])) t(o, want)),
        h AS (SELECT k, MIN(o) AS o FROM l JOIN w ON len(legs) = len(want) AND list_bool_and(list_transform(list_zip(legs, want), lambda z: abs(z[1] - z[2]) <= GREATEST(15.0::DOUBLE, 0.10::DOUBLE * z[2]))) GROUP BY 1)
        SELECT l.k AS p_partkey, CASE WHEN o = 1 THEN 'forward' WHEN o = 2 THEN 'reverse' WHEN o > 2 THEN 'trimmed' END AS fit FROM l LEFT JOIN h ON l.k = h.k""",
    "even_runs": """WITH p AS (SELECT p_brand AS panel, p_partkey * 3 % 400 * 10.0::DOUBLE AS pos FROM part), g AS (SELECT *, pos - LAG(pos) OVER (PARTITION BY panel ORDER BY pos) AS gap FROM p), n AS (SELECT *, CASE WHEN gap <= 100 THEN 0 ELSE 1 END AS new FROM g),
        r AS (SELECT *, CAST(SUM(new) OVER (PARTITION BY panel ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM n), s AS (SELECT panel, run, MIN(pos) AS lo, MAX(pos) AS hi, COUNT(*) AS n, quantile_cont(gap, 0.5) FILTER (WHERE new = 0) AS gap FROM r GROUP BY 1, 2) SELECT * FROM s WHERE n >= 3 AND abs(gap - 50) <= 30""",
    "text_rows": """WITH t AS (SELECT p_partkey AS id, p_size AS dia, CASE WHEN p_partkey % 3 > 0 THEN p_size + 10.0::DOUBLE END AS pitch, CAST(p_partkey % 50 AS DOUBLE) AS lo, CAST(p_partkey % 400 AS DOUBLE) AS ext, CASE WHEN p_partkey % 3 = 0 THEN p_size % 6 END AS c FROM part),
        n AS (SELECT *, COALESCE(c, CAST(floor(ext / pitch) + 1 AS BIGINT)) AS n, CASE WHEN c IS NOT NULL THEN CASE WHEN c > 1 THEN ext / (c - 1) WHEN c < 1 THEN -ext ELSE 0 END ELSE pitch END AS step FROM t)
        SELECT id AS text_id, dia, CAST(i AS INT) AS bar_no, ROUND(lo + i * step, 6) AS pos FROM (SELECT *, unnest(range(0, n)) AS i FROM n WHERE n > 0)""",
    "predicted_counts": "SELECT p_name AS text, COUNT(*) AS instances, CAST(MAX(floor(p_size * 100.0::DOUBLE / (length(p_name) * 10.0::DOUBLE)) + 1) AS BIGINT) AS per_run, CAST(COUNT(*) * MAX(floor(p_size * 100.0::DOUBLE / (length(p_name) * 10.0::DOUBLE)) + 1) AS BIGINT) AS count FROM part GROUP BY 1",
    "section_roles": "WITH p AS (SELECT p_partkey, abs(p_size * 20 - 500) AS a, abs(p_size * 20 - h) AS b, h FROM (SELECT *, p_partkey % 10 * 100 + 300 AS h FROM part)) SELECT p_partkey, CASE WHEN a <= 0.08::DOUBLE * 500 AND (b > 0.08::DOUBLE * h OR a <= b) THEN 'horizontal' WHEN b <= 0.08::DOUBLE * h THEN 'vertical' END AS role FROM p",
    "classified_sections": """WITH t AS (SELECT p_brand AS panel, p_partkey AS view, CASE WHEN length(p_brand) = 7 THEN 480 + p_size % 9 * 30 WHEN p_partkey % 9 = 0 THEN 290 ELSE 80 + p_size % 50 END AS t, CASE p_partkey % 4 WHEN 0 THEN 1000 - p_size WHEN 1 THEN 1500 + p_size * 3 WHEN 2 THEN 700 + p_partkey % 40 ELSE 1000 + p_partkey % 60 END AS l,
            p_size % 2 = 0 AS flat, CAST(p_partkey * 37 % 900 - 100 AS DOUBLE) AS x0, CAST(p_partkey * 53 % 1500 - 100 AS DOUBLE) AS y0 FROM part),
        b AS (SELECT panel, view, x0, y0, x0 + CASE WHEN flat THEN l ELSE t END AS x1, y0 + CASE WHEN flat THEN t ELSE l END AS y1 FROM t), r AS (SELECT *, LEAST(x1 - x0, y1 - y0) AS thickness, GREATEST(x1 - x0, y1 - y0) AS l, x1 - x0 >= y1 - y0 AS ax FROM b),
        u AS (SELECT panel, quantile_cont(thickness, 0.5) AS usual FROM r WHERE thickness <= 500 GROUP BY 1), m AS (SELECT panel, quantile_cont(thickness, 0.5) AS middle FROM r GROUP BY 1),
        s AS (SELECT panel, quantile_cont(thickness, 0.5) AS shared FROM r JOIN m USING (panel) WHERE abs(thickness - middle) <= 0.2::DOUBLE * middle GROUP BY 1 HAVING COUNT(*) >= 2),
        k AS (SELECT r.*, COALESCE(usual, shared) AS c, abs(l - 1000) < 80 AS across, abs(l - 1600) < 128 AS up FROM r LEFT JOIN u USING (panel) LEFT JOIN s USING (panel) WHERE thickness <= 500 OR usual IS NULL AND shared IS NOT NULL),
        o AS (SELECT *, CASE WHEN across THEN 'horizontal' WHEN up THEN 'vertical' WHEN NOT ax AND y0 >= -50 AND y1 <= 1650 THEN 'vertical' WHEN ax AND x0 >= -50 AND x1 <= 1050 THEN 'horizontal' END AS role FROM k WHERE c IS NULL OR abs(thickness - c) <= 0.3::DOUBLE * c)
        SELECT panel, view, role, thickness, ax AS is_along_x, CASE WHEN across OR up THEN CASE WHEN ax THEN x0 ELSE y0 END ELSE 0.0::DOUBLE END AS origin FROM o WHERE role IS NOT NULL""",
    "tie_rows": _UPRIGHTS.replace("WITH", "WITH RECURSIVE", 1) + """, said AS (SELECT p_brand AS panel, CAST(p_size % 2 * 4 + 6 AS INT) AS d, CAST(p_partkey % 2 * 50 + 100 AS INT) AS p, COUNT(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2, 3),
        best AS (SELECT panel, d, p, n FROM (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY n DESC, d, p) AS rn FROM said) WHERE rn = 1), main AS (SELECT u.panel, x, lo, hi FROM up u JOIN best USING (panel) WHERE dia >= 12 AND dia > d),
        g AS (SELECT *, CASE WHEN lo <= MAX(hi) OVER (PARTITION BY panel, x ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM main), i AS (SELECT *, SUM(new) OVER (PARTITION BY panel, x ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isle FROM g),
        spans AS (SELECT panel, x, MIN(lo) AS lo, MAX(hi) AS hi FROM i GROUP BY panel, x, isle), xs AS (SELECT panel, x, LEAD(x) OVER (PARTITION BY panel ORDER BY x) AS x2 FROM (SELECT DISTINCT panel, x FROM spans)),
        runs AS (SELECT xs.panel, xs.x, x2, GREATEST(a.lo, b.lo) AS lo, LEAST(a.hi, b.hi) AS hi, d, p, n FROM xs JOIN spans a ON a.panel = xs.panel AND a.x = xs.x JOIN spans b ON b.panel = xs.panel AND b.x = x2 JOIN best ON best.panel = xs.panel WHERE x2 - xs.x <= 60 AND LEAST(a.hi, b.hi) - GREATEST(a.lo, b.lo) > 2 * p),
        pairs AS (SELECT panel, x, x2, n, row_number() OVER (PARTITION BY panel ORDER BY SUM(hi - lo) DESC, x) AS i FROM runs GROUP BY 1, 2, 3, 4),
        f AS (SELECT DISTINCT panel, CAST(0 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS x2, FALSE AS ok, CAST([] AS DOUBLE[]) AS used FROM pairs
        UNION ALL SELECT panel, i, x, x2, ok, CASE WHEN ok THEN list_concat(used, [x, x2]) ELSE used END FROM (SELECT f.panel, s.i, s.x, s.x2, f.used, len(f.used) < 2 * s.n AND NOT list_contains(f.used, s.x) AND NOT list_contains(f.used, s.x2) AS ok FROM f JOIN pairs s ON s.panel = f.panel AND s.i = f.i + 1)),
        held AS (SELECT r.panel, r.x, r.x2, d, p, GREATEST(lo, 30) AS lo, LEAST(hi, 2570) AS hi FROM runs r JOIN f ON f.panel = r.panel AND f.x = r.x AND f.x2 = r.x2 AND ok)
        SELECT panel, x - 30 AS x_lo, x2 + 30 AS x_hi, lo + unnest(range(0, CAST(GREATEST(floor((hi - lo) / p) + 1, 1) AS BIGINT))) * p AS y, d AS dia FROM held""",
    "hairpin_rows": _UPRIGHTS + """, best AS (SELECT panel, d FROM (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY n DESC, d) AS rn FROM (SELECT p_brand AS panel, p_size % 2 * 4 + 8 AS d, COUNT(*) AS n FROM part GROUP BY 1, 2)) WHERE rn = 1),
        own AS (SELECT u.panel, x % 40 * 30 AS x, z, lo, hi, dia FROM up u JOIN best USING (panel) WHERE dia = d), g AS (SELECT *, CASE WHEN lo <= MAX(hi) OVER (PARTITION BY panel, x, z ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 THEN 0 ELSE 1 END AS new FROM own),
        i AS (SELECT *, SUM(new) OVER (PARTITION BY panel, x, z ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isle FROM g), spans AS (SELECT panel, x, z, MIN(lo) AS lo, MAX(hi) AS hi FROM i GROUP BY panel, x, z, isle),
        runs AS (SELECT a.panel, a.x, GREATEST(a.lo, b.lo) AS lo, LEAST(a.hi, b.hi) AS hi FROM spans a JOIN spans b ON a.panel = b.panel AND a.x = b.x AND a.z = 30 AND b.z = 130 WHERE LEAST(a.hi, b.hi) > GREATEST(a.lo, b.lo)),
        ends AS (SELECT panel, x, lo AS e, 1 AS turn FROM runs UNION ALL SELECT panel, x, hi, -1 FROM runs), y AS (SELECT *, LEAST(GREATEST(e, 30), 2570) AS y FROM ends WHERE e BETWEEN 0 AND 2600), d AS (SELECT panel, MAX(dia) AS dia FROM own GROUP BY 1),
        u AS (SELECT p_brand AS panel, p_partkey * 61 % 1500 AS ux, p_partkey * 7 % 2600 AS uy FROM part WHERE p_type = 'PROMO')
        SELECT y.panel, x, y, turn, dia FROM y JOIN d USING (panel) WHERE y + 400 * turn BETWEEN 0 AND 2600 AND NOT EXISTS (SELECT 1 FROM u WHERE u.panel = y.panel AND abs(x - ux) < 120 AND abs(e - uy) < 200)""",
    "hooks_in_rows": """WITH best AS (SELECT panel, d, p FROM (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY n DESC, d, p) AS rn FROM (SELECT p_brand AS panel, CAST(p_size % 2 * 4 + 8 AS INT) AS d, p_partkey % 2 * 50 + 100 AS p, COUNT(*) AS n FROM part GROUP BY 1, 2, 3)) WHERE rn = 1),
        unit AS (SELECT p_brand AS panel, AVG(p_size * 10.0::DOUBLE) AS length FROM part JOIN best ON panel = p_brand WHERE p_size % 3 * 4 + 8 = d AND length(p_brand) > 7 GROUP BY 1),
        i AS (SELECT p_brand AS panel, CASE WHEN p_size % 2 = 0 THEN 'v' ELSE 'h' END AS axis, CAST(p_partkey % 3 AS DOUBLE) AS coord, p_partkey * 7 % 130 * 50.0::DOUBLE AS pos, d, p, length FROM part JOIN best ON best.panel = p_brand JOIN unit ON unit.panel = p_brand),
        g AS (SELECT *, pos - LAG(pos) OVER (PARTITION BY panel, axis, coord ORDER BY pos) AS gap FROM i), n AS (SELECT *, CASE WHEN gap <= 1.4::DOUBLE * p THEN 0 ELSE 1 END AS new FROM g), r AS (SELECT *, SUM(new) OVER (PARTITION BY panel, axis, coord ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM n),
        s AS (SELECT panel, axis, coord, run, d, p, length, MIN(pos) AS lo, MAX(pos) AS hi, COUNT(*) AS n, quantile_cont(gap, 0.5) FILTER (WHERE new = 0) AS step FROM r GROUP BY ALL),
        e AS (SELECT *, unnest(range(0, CAST(round_even((hi - lo) / p, 0) AS BIGINT) + 1)) AS k FROM s WHERE n >= 3 AND abs(step - p) <= 0.3::DOUBLE * p)
        SELECT panel, axis, coord, lo + k * p AS pos, ROUND(length, 6) AS length, d AS dia FROM e WHERE lo + k * p <= hi + 1""",
    "dashed_diagonals": """WITH d AS (SELECT p_brand AS panel, CAST(p_partkey % 3 AS INT) AS angle_bin, CAST(p_partkey * 19 % 3000 AS DOUBLE) AS o, CAST(p_partkey * 11 % 5000 AS DOUBLE) AS lo, CAST(p_partkey * 11 % 5000 + 150 + p_size * 4 AS DOUBLE) AS hi FROM part),
        a AS (SELECT *, CASE WHEN o - LAG(o) OVER (PARTITION BY panel, angle_bin ORDER BY o) <= 40 THEN 0 ELSE 1 END AS new FROM d), b AS (SELECT panel, angle_bin, o, lo, hi, SUM(new) OVER (PARTITION BY panel, angle_bin ORDER BY o ROWS UNBOUNDED PRECEDING) AS rail FROM a),
        m AS (SELECT panel, angle_bin, rail, AVG(o) AS o FROM b GROUP BY 1, 2, 3), g AS (SELECT *, CASE WHEN lo <= MAX(hi) OVER (PARTITION BY panel, angle_bin, rail ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 60 THEN 0 ELSE 1 END AS n2 FROM b),
        i AS (SELECT *, SUM(n2) OVER (PARTITION BY panel, angle_bin, rail ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isle FROM g), l AS (SELECT panel, angle_bin, rail, MIN(lo) AS lo, MAX(hi) AS hi FROM i GROUP BY panel, angle_bin, rail, isle HAVING MAX(hi) - MIN(lo) >= 300)
        SELECT panel, angle_bin, ROUND(o, 6) AS "offset", lo, hi FROM l JOIN m USING (panel, angle_bin, rail)""",
    "folded_places": "SELECT p_partkey, CASE WHEN a > size THEN 2 * size - a ELSE a END AS place FROM (SELECT p_partkey, size, ((v % (2 * size)) + 2 * size) % (2 * size) AS a FROM (SELECT p_partkey, CAST(p_partkey * 7 - 900 AS DOUBLE) AS v, p_size + 10.0::DOUBLE AS size FROM part))",
    "insert_families": """WITH f AS (SELECT p_name AS family, COUNT(*) AS copies, CAST(MIN(p_partkey * 7 % 900) AS DOUBLE) AS x0, CAST(MAX(p_partkey * 7 % 900) AS DOUBLE) AS x1, MIN(p_size * 9) AS y0, MAX(p_size * 9) AS y1, MIN(p_partkey) AS first_id FROM part GROUP BY 1)
        SELECT family, copies, CASE WHEN copies > 1 THEN ROUND(GREATEST(x1 - x0, y1 - y0) / (copies - 1), 6) END AS avg_spacing, x0, x1, first_id FROM f""",
    "panel_sanity": """WITH b AS (SELECT p_brand AS name, COUNT(*) AS n, SUM(p_size / 10.0::DOUBLE) AS kg, MIN(p_partkey % 30 - 11) AS zl, MAX(p_partkey % 200) AS zh, list(p_retailprice * 2) AS lens FROM part GROUP BY 1),
        f AS (SELECT *, n % 7 * 300.0::DOUBLE AS w, n % 5 * 400.0::DOUBLE + 600 AS h, n % 3 * 60.0::DOUBLE + 120 AS t, n % 7 * 0.05::DOUBLE AS v FROM b)
        SELECT name, 'degenerate' AS rule, 'ERROR' AS severity FROM f WHERE w <= 0 OR h <= 0 OR t <= 0 UNION ALL SELECT name, 'depth out of panel', 'ERROR' FROM f WHERE zl < -10 OR zh > t + 10
        UNION ALL SELECT name, 'steel ratio', 'WARN' FROM f WHERE v >= 0.01 AND NOT kg / v BETWEEN 20 AND 400 UNION ALL SELECT name, 'long bars', 'WARN' FROM f WHERE len(list_filter(lens, lambda x: x > 1.5 * sqrt(w * w + h * h + t * t))) > 0""",
    "quarantined": "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_retailprice < 950 THEN 'cheap' END, CASE WHEN p_size % 2 = 1 THEN 'odd' END, CASE WHEN length(p_name) > 10 THEN 'long' END], lambda x: x IS NOT NULL), '+') AS broken FROM part",
    "path_functions": """WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_partkey % 17 + 2.0::DOUBLE AS y FROM part), a AS (SELECT *, atan2(y, x - 25) AS angle, CASE WHEN x * 10 = y * 10 THEN 360.0::DOUBLE ELSE ((x * 10 - y * 10) % 360 + 360) % 360 END AS s0 FROM p),
        s AS (SELECT *, CASE WHEN s0 = 0 THEN 360.0::DOUBLE ELSE s0 END AS sweep FROM a)
        SELECT p_partkey, ROUND(angle, 6) AS angle, abs(ROUND(y * cos(angle) - (x - 20) * sin(angle), 6)) AS distance, abs(ROUND(x * cos(angle) + y * sin(angle), 6)) AS along, 5 AS arc_n, ROUND(x + 10 * cos(radians(y * 10 + sweep / 2)), 6) AS arc_x, ROUND(y + 10 * sin(radians(y * 10 + sweep)), 6) AS arc_y,
        CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 4 END AS corners FROM s""",
    "rounding_modes": """WITH p AS (SELECT *, (p_partkey % 40 - 20) / 4.0::DOUBLE AS v, [p_partkey % 5, p_size % 3, p_partkey % 5, p_size % 7] AS i FROM part)
        SELECT p_partkey, CAST(round_even(v, 0) AS BIGINT) AS half_even, CAST(floor(v) AS BIGINT) AS down, CAST(floor(v + 0.5::DOUBLE) AS BIGINT) AS half_up, array_to_string(list_sort(list_distinct(i)), ',') AS sorted_set, list_min(i) AS least, array_to_string([i[3], i[2]], ',') AS reversed,
        array_to_string([i[1] * 10 + i[4], i[2] * 10 + i[3], i[3] * 10 + i[2], i[4] * 10 + i[1]], ',') AS zipped, CASE p_size % 4 WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'none' END AS looked_up FROM p""",
    "wall_clock_instants": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + INTERVAL (o_orderkey % 24) HOUR + INTERVAL (o_orderkey % 60) MINUTE - INTERVAL 330 MINUTE AS i FROM orders) SELECT o_orderkey, strftime(i, '%Y-%m-%d %H:%M:%S') AS instant, CAST(d AS VARCHAR) AS day FROM o""",
    "label_texts": """WITH p AS (SELECT *, p_partkey % 4 * 4 + 8 AS d, CASE p_partkey % 5 WHEN 0 THEN 'WALL ' WHEN 2 THEN 'Mould ' WHEN 3 THEN 'FACE ' ELSE '' END AS loc FROM part)
        SELECT p_partkey, CASE WHEN p_size = d THEN CAST(d AS VARCHAR) ELSE LEAST(p_size, d) || ',' || GREATEST(p_size, d) END AS diameters, loc || '- ' || p_size || ' mm' AS locations, CASE WHEN p_partkey % 7 > 0 THEN 'T' || p_size ELSE '-' END AS label, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS decoded FROM p""",
    "corner_filters": """WITH p AS (SELECT p_partkey AS k, upper(substr(p_type, 1, 3)) || '-' || p_brand AS layer, [{'x': p_partkey * 3 % 100, 'y': p_partkey * 7 % 80}, {'x': p_partkey * 11 % 100, 'y': p_partkey * 5 % 80}, {'x': p_partkey * 17 % 100, 'y': p_partkey * 19 % 80}] AS c FROM part)
        SELECT k AS p_partkey, len(list_filter(c, lambda q: q.x BETWEEN 15 AND 65 AND q.y BETWEEN 15 AND 65)) > 0 AS any_inside, len(list_filter(c, lambda q: q.x BETWEEN 10 AND 90 AND q.y BETWEEN 10 AND 70)) = 3 AS all_inside, layer = 'ECO-Brand#2' OR starts_with(layer, 'STA') OR starts_with(layer, 'MED-') AS wanted FROM p""",
    "near_duplicate_segments": """WITH RECURSIVE s AS (SELECT p_brand AS panel, p_partkey AS id, p_partkey * 7 % 60 AS x, p_partkey * 3 % 40 AS y, 100.0::DOUBLE + p_size % 4 AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
        k AS (SELECT panel, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id BIGINT, x BIGINT, y BIGINT, n DOUBLE)[]) AS kept FROM (SELECT DISTINCT panel FROM s)
        UNION ALL SELECT k.panel, s.i, CASE WHEN len(list_filter(kept, lambda o: sqrt((o.x - s.x) * (o.x - s.x) + (o.y - s.y) * (o.y - s.y)) < 6 AND abs(o.n - s.n) <= 0.05::DOUBLE * GREATEST(o.n, s.n))) > 0 THEN kept ELSE list_append(kept, {'id': s.id, 'x': s.x, 'y': s.y, 'n': s.n}) END FROM k JOIN s ON s.panel = k.panel AND s.i = k.i + 1)
        SELECT panel, unnest(kept).id AS id FROM (SELECT panel, arg_max(kept, i) AS kept FROM k GROUP BY 1)""",
    "arc_partners": """WITH RECURSIVE a AS (SELECT p_brand AS panel, p_partkey AS id, p_partkey % 9 AS x, p_size % 5 AS y, p_partkey * 7 % 300 AS r, p_partkey * 11 % 90 AS t, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey * 7 % 300, p_partkey) AS i FROM part),
        fits AS (SELECT a.panel, a.i, a.id, list({'gap': b.r - a.r, 'id': b.id} ORDER BY b.r - a.r, b.id) AS fits FROM a JOIN a b ON a.panel = b.panel AND a.id <> b.id AND b.r - a.r BETWEEN 5 AND 34 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4 AND abs((b.t - a.t + 540) % 360 - 180) <= 15 GROUP BY 1, 2, 3),
        s AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY i) AS n FROM fits),
        f AS (SELECT DISTINCT panel, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST([] AS BIGINT[]) AS used FROM s
        UNION ALL SELECT panel, n, id, p, CASE WHEN p IS NULL THEN used ELSE list_concat(used, [id, p]) END FROM (SELECT f.panel, s.n, s.id, f.used, CASE WHEN NOT list_contains(f.used, s.id) THEN list_filter(s.fits, lambda x: NOT list_contains(f.used, x.id))[1].id END AS p FROM f JOIN s ON s.panel = f.panel AND s.n = f.n + 1))
        SELECT panel, a, b FROM f WHERE b IS NOT NULL""",
    "bridged_stubs": """WITH RECURSIVE a AS (SELECT p_brand AS panel, p_partkey AS id, p_partkey % 2 = 0 AS lo, p_partkey * 13 % 400 AS pos, p_size % 5 + 8 AS dia FROM part),
        fits AS (SELECT a.panel, a.id, a.pos, list({'d': abs(b.pos - a.pos), 'id': b.id} ORDER BY abs(b.pos - a.pos), b.id) AS fits FROM a JOIN a b ON a.panel = b.panel AND a.lo AND NOT b.lo AND abs(b.pos - a.pos) <= 6 AND abs(b.dia - a.dia) < 2.5 GROUP BY 1, 2, 3),
        s AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY pos, id) AS n FROM fits),
        f AS (SELECT DISTINCT panel, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST([] AS BIGINT[]) AS used FROM s
        UNION ALL SELECT panel, n, id, p, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END FROM (SELECT f.panel, s.n, s.id, f.used, list_filter(s.fits, lambda x: NOT list_contains(f.used, x.id))[1].id AS p FROM f JOIN s ON s.panel = f.panel AND s.n = f.n + 1))
        SELECT panel, a AS lo_id, b AS hi_id FROM f WHERE b IS NOT NULL""",
    "attached_legs": """WITH RECURSIVE a AS (SELECT p_brand AS panel, p_partkey AS id, p_partkey * 17 % 300 AS x, p_size * 3 AS y FROM part),
        fits AS (SELECT a.panel, a.id, list({'d': sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 'id': b.id} ORDER BY sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), b.id) AS fits FROM a JOIN a b ON a.panel = b.panel AND a.id % 3 = 0 AND b.id % 3 > 0 AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) < 900 GROUP BY 1, 2),
        s AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY id) AS n FROM fits),
        f AS (SELECT DISTINCT panel, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST([] AS BIGINT[]) AS used FROM s
        UNION ALL SELECT panel, n, id, p, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END FROM (SELECT f.panel, s.n, s.id, f.used, list_filter(s.fits, lambda x: NOT list_contains(f.used, x.id))[1].id AS p FROM f JOIN s ON s.panel = f.panel AND s.n = f.n + 1))
        SELECT a AS dowel_id, b AS leg_id FROM f WHERE b IS NOT NULL""",
    "folded_copies": """WITH RECURSIVE a AS (SELECT p_brand AS panel, p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN [p_size, p_partkey % 50] ELSE [p_size, p_partkey % 40, p_size * 2] END AS v FROM part),
        fits AS (SELECT a.panel, a.id, list(b.id ORDER BY b.id) AS fits FROM a JOIN a b ON a.panel = b.panel AND a.id < b.id AND len(a.v) = len(b.v) AND list_bool_and(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]) <= 10)) GROUP BY 1, 2),
        s AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY id) AS n FROM fits),
        f AS (SELECT DISTINCT panel, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST([] AS BIGINT[]) AS used FROM s
        UNION ALL SELECT panel, n, id, p, CASE WHEN p IS NULL THEN used ELSE list_concat(used, [id, p]) END FROM (SELECT f.panel, s.n, s.id, f.used, CASE WHEN NOT list_contains(f.used, s.id) THEN list_filter(s.fits, lambda x: NOT list_contains(f.used, x))[1] END AS p FROM f JOIN s ON s.panel = f.panel AND s.n = f.n + 1))
        SELECT panel, a, b FROM f WHERE b IS NOT NULL""",
    "two_leg_marks": """WITH RECURSIVE p AS (SELECT p_brand AS panel, p_partkey AS id, p_partkey * 7 % 400 + 100.0::DOUBLE AS len, p_size * 9 + 50.0::DOUBLE AS seg1, p_size % 3 AS qty FROM part),
        units AS (SELECT panel, id, len AS seg0, seg1, unnest(range(0, qty)) AS u FROM p WHERE id % 9 = 0), s AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY id, u) AS n FROM units),
        f AS (SELECT panel, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, list({'len': len, 'id': id} ORDER BY id) AS free FROM p WHERE id % 9 > 0 GROUP BY 1
        UNION ALL SELECT panel, n, id, a, b, CASE WHEN b IS NULL THEN free ELSE list_filter(free, lambda x: x.id <> a AND x.id <> b) END FROM (SELECT *, list_min(list_transform(list_filter(free, lambda x: x.id <> a AND abs(x.len - seg1) <= GREATEST(10.0::DOUBLE, 0.05::DOUBLE * seg1)), lambda x: {'d': abs(x.len - seg1), 'id': x.id})).id AS b
            FROM (SELECT f.panel, s.n, s.id, f.free, s.seg1, list_min(list_transform(list_filter(f.free, lambda x: abs(x.len - s.seg0) <= GREATEST(10.0::DOUBLE, 0.05::DOUBLE * s.seg0)), lambda x: {'d': abs(x.len - s.seg0), 'id': x.id})).id AS a FROM f JOIN s ON s.panel = f.panel AND s.n = f.n + 1)))
        SELECT id AS row_id, a, b FROM f WHERE b IS NOT NULL""",
    "mark_counts": """WITH RECURSIVE p AS (SELECT p_brand AS panel, p_type AS mark, CAST(p_size % 2 AS INT) AS dia, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 5 END AS view, p_partkey AS id, p_partkey * 37 % 2000 AS x, p_size * 10 AS y, p_size % 4 + 1 AS c FROM part),
        s AS (SELECT *, row_number() OVER (PARTITION BY panel, mark, dia, view ORDER BY id) AS n FROM p WHERE view IS NOT NULL),
        f AS (SELECT DISTINCT panel, mark, dia, view, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS total, CAST([] AS STRUCT(x BIGINT, y BIGINT)[]) AS taken FROM s
        UNION ALL SELECT f.panel, f.mark, f.dia, f.view, s.n, CASE WHEN len(list_filter(taken, lambda t: sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y)) <= 500)) = 0 THEN total + s.c ELSE total END, CASE WHEN len(list_filter(taken, lambda t: sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y)) <= 500)) = 0 THEN list_append(taken, {'x': s.x, 'y': s.y}) ELSE taken END
            FROM f JOIN s ON s.panel = f.panel AND s.mark = f.mark AND s.dia = f.dia AND s.view = f.view AND s.n = f.n + 1),
        t AS (SELECT panel, mark, dia, MAX(total) AS total FROM f GROUP BY ALL UNION ALL SELECT panel, mark, dia, c FROM p WHERE view IS NULL) SELECT panel, mark, dia, CAST(MAX(total) AS BIGINT) AS true_count FROM t GROUP BY 1, 2, 3""",
    "sorted_bar_list": f"WITH {_PARTS} SELECT panel, bar_id, CAST(row_number() OVER (PARTITION BY panel ORDER BY length DESC, kg DESC, bar_id) AS INT) AS place, CAST(row_number() OVER (PARTITION BY panel ORDER BY dia, length DESC, bar_id) AS INT) AS print_place FROM bars",
    "deficit_report": f"""WITH {_PARTS}, n AS (SELECT panel, CAST(SUM(qty * most) AS BIGINT) AS need FROM marks GROUP BY 1), h AS (SELECT panel, CAST(SUM(kg) AS BIGINT) AS have FROM bars WHERE z_src <> 'default' GROUP BY 1), d AS (SELECT panel, need - COALESCE(have, 0) AS deficit FROM n LEFT JOIN h USING (panel))
        SELECT panel, deficit, CAST(row_number() OVER (ORDER BY deficit DESC, panel) AS INT) AS place FROM d""",
}
