"""What drawings say without drawing it: section views placed in the panel, and bars that only a text asks for.

All but the claim of tie stacks is joins, windows and sweeps; what a text asks for is ``synthesized``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.calc import count_by_pitch
from tallyspark.operators.islands import merge_intervals
from tallyspark.operators.match import band_join
from tallyspark.operators.running import exact_medians


def classify_sections(walls: DataFrame, panels: DataFrame, fit: float = 0.08, thick: float = 0.5, agree: float = 0.2, reject: float = 0.3, margin: float = 50.0) -> DataFrame:
    """(panel, view, role, thickness, along_x, origin) of the views that are sections of their panel.

    ``walls`` (panel, view, x0, y0, x1, y1) holds the wall box of each view, ``panels`` (panel, width, height,
    ex0, ey0, ex1, ey1) the panel and the box of its elevation. The short side of a wall is a reading of the
    thickness: the median of the readings up to ``thick`` of the panel's shorter side is the consensus, or,
    where all are beyond, that of the readings within ``agree`` of their median if two or more are. Views
    whose reading is over ``reject`` from the consensus are no sections. The long side says which side of the
    panel is cut, within ``fit``; of others the place beside the elevation does, within ``margin``.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = walls.join(panels, "panel").withColumns({"thickness": F.least(w, h), "long": F.greatest(w, h), "along_x": w >= h})
    rows = rows.withColumn("wide", F.col("thickness") > thick * F.least("width", "height"))
    usual = exact_medians(rows.where("not wide"), ["panel"], "thickness", "usual").drop("n")
    middle = exact_medians(rows, ["panel"], "thickness", "middle").drop("n")
    near = rows.join(middle, "panel").where(F.abs(F.col("thickness") - F.col("middle")) <= agree * F.col("middle"))
    shared = exact_medians(near, ["panel"], "thickness", "shared").where("n >= 2").drop("n")
    known = rows.join(usual, "panel", "left").join(shared, "panel", "left")
    consensus = F.coalesce("usual", "shared")
    trusted = (~F.col("wide") | (F.col("usual").isNull() & F.col("shared").isNotNull())) & F.coalesce(F.abs(F.col("thickness") - consensus) <= reject * consensus, F.lit(True))
    across, up = F.abs(F.col("long") - F.col("width")) < fit * F.col("width"), F.abs(F.col("long") - F.col("height")) < fit * F.col("height")
    beside = (F.col("ey0") - margin <= F.col("y0")) & (F.col("y1") <= F.col("ey1") + margin)
    below = (F.col("ex0") - margin <= F.col("x0")) & (F.col("x1") <= F.col("ex1") + margin)
    role = F.when(across, "horizontal").when(up, "vertical").when(~F.col("along_x") & beside, "vertical").when(F.col("along_x") & below, "horizontal")
    own, shown = F.when(F.col("along_x"), F.col("x0")).otherwise(F.col("y0")), F.when(F.col("along_x"), F.col("ex0")).otherwise(F.col("ey0"))
    placed = known.where(trusted).withColumns({"role": role, "origin": F.when(across | up, own).otherwise(shown)})
    return placed.where("role is not null").select("panel", "view", "role", "thickness", "along_x", "origin")


def usual_callout(callouts: DataFrame) -> DataFrame:
    """(panel, callout_dia, pitch, copies): each panel's most frequent (dia, pitch), the least of equals."""
    counts = callouts.groupBy("panel", "dia", "pitch").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("panel").agg(F.min(F.struct((-F.col("n")).alias("less"), "dia", "pitch")).alias("b"))
    return best.select("panel", F.col("b.dia").alias("callout_dia"), F.col("b.pitch").alias("pitch"), (-F.col("b.less")).alias("copies"))


def tie_stacks(bars: DataFrame, callouts: DataFrame, panels: DataFrame, reach: float = 160.0, least_dia: float = 12.0, cover: float = 30.0) -> DataFrame:
    """(panel, x_lo, x_hi, y, dia): ties round pairs of neighbouring main bars, as the panel's most frequent tie
    callout (panel, dia, pitch) asks for, one stack a copy of it.

    Main bars (panel, x, dia, lo, hi) are upright, of ``least_dia`` or more and thicker than the tie. A pair
    at most ``reach`` apart carries ties where both bars run together for over two pitches. Pairs are
    claimed by the length they carry, the longest first, and a bar belongs to one stack.
    """
    main = bars.join(usual_callout(callouts), "panel").where((F.col("dia") >= least_dia) & (F.col("dia") > F.col("callout_dia")))
    main = main.select("panel", F.bround("x", 0).alias("x"), "lo", "hi", "callout_dia", "pitch", "copies")
    spans = merge_intervals(main, ["panel", "x"], gap=1.0).drop("n")
    facts = main.select("panel", "callout_dia", "pitch", "copies").distinct()
    following = F.lead("x").over(Window.partitionBy("panel").orderBy("x"))
    pairs = spans.select("panel", "x").distinct().withColumn("x2", following).where(F.col("x2") - F.col("x") <= reach)
    other = spans.select("panel", F.col("x").alias("x2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    runs = pairs.join(spans, ["panel", "x"]).join(other, ["panel", "x2"]).join(facts, "panel")
    runs = runs.withColumns({"lo": F.greatest("lo", "lo2"), "hi": F.least("hi", "hi2")}).where(F.col("hi") - F.col("lo") > 2 * F.col("pitch"))
    carried = runs.groupBy("panel", "x", "x2", "copies").agg(F.sum(F.col("hi") - F.col("lo")).alias("length"))

    def claim(group: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for r in group.sort_values(["length", "x"], ascending=[False, True]).itertuples():
            if len(out) < r.copies and not taken & {r.x, r.x2}:
                taken |= {r.x, r.x2}
                out.append((r.panel, r.x, r.x2))
        return pd.DataFrame(out, columns=["panel", "x", "x2"])

    stacks = carried.groupBy("panel").applyInPandas(claim, "panel string, x double, x2 double")
    held = runs.join(stacks, ["panel", "x", "x2"]).join(panels, "panel")
    held = held.withColumns({"lo": F.greatest("lo", F.lit(cover)), "hi": F.least("hi", F.col("height") - cover)})
    count = F.greatest(count_by_pitch(F.col("hi") - F.col("lo"), F.col("pitch")), F.lit(1)).cast("int")
    each = held.withColumn("k", F.explode(F.sequence(F.lit(0), count - 1)))
    return each.select("panel", (F.col("x") - cover).alias("x_lo"), (F.col("x2") + cover).alias("x_hi"), (F.col("lo") + F.col("k") * F.col("pitch")).alias("y"), F.col("callout_dia").alias("dia"))


def shared_spans(planes: DataFrame, keys: Sequence[str], plane: str) -> DataFrame:
    """(keys, lo, hi) where all of a key's planes, two or more, have an interval: a sweep over the ends."""
    count = planes.groupBy(*keys).agg(F.count_distinct(plane).alias("n")).where("n >= 2")
    ends = planes.select(*keys, F.col("lo").alias("at"), F.lit(1).alias("d")).unionByName(planes.select(*keys, F.col("hi").alias("at"), F.lit(-1).alias("d")))
    steps = ends.groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(*keys).orderBy("at")
    swept = steps.withColumns({"open": F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("at").over(order)})
    return swept.join(count, list(keys)).where("open = n and next > at").select(*keys, F.col("at").alias("lo"), F.col("next").alias("hi"))


def edge_hairpins(bars: DataFrame, callouts: DataFrame, folded: DataFrame, panels: DataFrame, cover: float = 30.0, leg: float = 400.0, clear: tuple[float, float] = (120.0, 200.0)) -> DataFrame:
    """(panel, x, y, turn, dia): hairpins that close the ends of upright bars seen on both faces.

    Bars (panel, x, z, dia, lo, hi) of the most frequent u-bar callout's diameter are joined to runs per place
    and face; where all faces run together, either end inside the panel gets a hairpin, with legs of ``leg``
    that point into the run (``turn`` 1 up, -1 down) and fit the panel (panel, height), unless a folded bar
    (panel, ux, uy) is already there.
    """
    own = bars.join(usual_callout(callouts), "panel").where(F.col("dia") == F.col("callout_dia"))
    own = own.select("panel", F.bround("x", 0).alias("x"), F.bround("z", 0).alias("z"), "lo", "hi", "dia")
    dias = own.groupBy("panel").agg(F.max("dia").alias("dia"))
    runs = shared_spans(merge_intervals(own, ["panel", "x", "z"], gap=5.0), ["panel", "x"], "z")
    ends = runs.select("panel", "x", F.explode(F.array(F.struct(F.col("lo").alias("end"), F.lit(1).alias("turn")), F.struct(F.col("hi").alias("end"), F.lit(-1).alias("turn")))).alias("e")).select("panel", "x", "e.end", "e.turn")
    placed = ends.join(panels, "panel").withColumn("y", F.least(F.greatest("end", F.lit(cover)), F.col("height") - cover))
    tip = F.col("y") + leg * F.col("turn")
    fits = placed.where((F.col("end") >= 0) & (F.col("end") <= F.col("height")) & (tip >= 0) & (tip <= F.col("height")))
    near = band_join(fits, folded, ["panel"], "x", "ux", clear[0]).where((F.abs(F.col("x") - F.col("ux")) < clear[0]) & (F.abs(F.col("end") - F.col("uy")) < clear[1]))
    taken = near.select("panel", "x", "end", "turn").distinct()
    return fits.join(taken, ["panel", "x", "end", "turn"], "left_anti").join(dias, "panel").select("panel", "x", "y", "turn", "dia")


def hook_rows(icons: DataFrame, details: DataFrame, callouts: DataFrame, least: int = 5) -> DataFrame:
    """(panel, axis, coord, pos, length, dia): hooks where the panel's icons stand in even rows.

    Icons (panel, axis, coord, pos) give places only; the length is the mean of the detail view's hooks
    (panel, dia, length) of the callout's diameter, and panels without such a detail get none. Rows of
    ``least`` icons or more at about the callout's pitch are filled at that pitch from end to end.
    """
    asked = usual_callout(callouts)
    unit = details.join(asked, "panel").where(F.col("dia") == F.col("callout_dia")).groupBy("panel").agg(F.avg("length").alias("length"))
    rows = icons.join(asked, "panel").join(unit.where("length > 0"), "panel")
    order = Window.partitionBy("panel", "axis", "coord").orderBy("pos")
    gap = F.col("pos") - F.lag("pos").over(order)
    rows = rows.withColumn("gap", gap).withColumn("new", F.when(F.col("gap") <= 1.4 * F.col("pitch"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    keys = ["panel", "axis", "coord", "run"]
    runs = rows.groupBy(*keys, "pitch", "length", "callout_dia").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    gaps = exact_medians(rows.where("new = 0"), keys, "gap", "step").drop("n")
    even = runs.join(gaps, keys).where(F.abs(F.col("step") - F.col("pitch")) <= 0.3 * F.col("pitch"))
    count = F.greatest(F.bround((F.col("hi") - F.col("lo")) / F.col("pitch"), 0).cast("int"), F.lit(0))
    made = even.withColumn("k", F.explode(F.sequence(F.lit(0), count))).withColumn("pos", F.col("lo") + F.col("k") * F.col("pitch"))
    return made.where(F.col("pos") <= F.col("hi") + 1).select("panel", "axis", "coord", "pos", "length", F.col("callout_dia").alias("dia"))


def dashed_lines(dashes: DataFrame, gap: float = 60.0, least: float = 300.0, same: float = 40.0) -> DataFrame:
    """(panel, angle_bin, offset, lo, hi): lines drawn as dashes (panel, angle_bin, offset, lo, hi), put together.

    Dashes of one direction whose offsets follow each other within ``same`` are one line, however its rail
    jitters, or the two rails of one bar; along it, dashes at most ``gap`` apart join. Lines shorter than
    ``least`` go. The offset is the mean of the line's dashes.
    """
    order = Window.partitionBy("panel", "angle_bin").orderBy("offset")
    step = F.col("offset") - F.lag("offset").over(order)
    rails = dashes.withColumn("new", F.when(step <= same, 0).otherwise(1)).withColumn("rail", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    middle = rails.groupBy("panel", "angle_bin", "rail").agg(F.avg("offset").alias("offset"))
    lines = merge_intervals(rails, ["panel", "angle_bin", "rail"], gap=gap).where(F.col("hi") - F.col("lo") >= least)
    return lines.join(middle, ["panel", "angle_bin", "rail"]).select("panel", "angle_bin", "offset", "lo", "hi")
