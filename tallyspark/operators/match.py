"""Joins by tolerance, distance and greedy assignment.

Range joins go through buckets of the tolerance's width, so they are equi-joins on a bucket and its
neighbours. Greedy matching depends on order; a key is cut into runs that cannot meet, and each run is
matched as one group, on input sorted by an explicit sequence.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str, within: float, how: str = "inner") -> DataFrame:
    """Pairs with equal keys and values at most ``within`` (over 0) apart; but for keys, no column
    name may be on both sides."""
    a = left.withColumn("__cell", F.floor(F.col(left_value) / within))
    around = F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col(right_value) / within) + d)
    b = right.withColumns({f"__{k}": F.col(k) for k in keys}).withColumn("__other", F.explode(around)).drop(*keys)
    on = (F.col("__cell") == F.col("__other")) & (F.abs(F.col(left_value) - F.col(right_value)) <= within)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return a.join(b, on, how).drop("__cell", "__other", *(f"__{k}" for k in keys))


def ahead_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str, low: float, high: float) -> DataFrame:
    """Pairs with equal keys whose right value is ``low`` to ``high`` (over ``low``) above the left one; but for
    keys, no column name may be on both sides. Cells are a quarter of that range, as all rows of the cells
    that it touches are compared."""
    step = (high - low) / 4
    at = lambda c: F.floor(c / step)
    v = F.col(right_value)
    a = left.withColumn("__cell", at(F.col(left_value)))
    b = right.withColumns({f"__{k}": F.col(k) for k in keys}).withColumn("__other", F.explode(F.sequence(at(v - high - step / 1000), at(v - low + step / 1000)))).drop(*keys)
    on = (F.col("__cell") == F.col("__other")) & (v - F.col(left_value)).between(low, high)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    # few bytes make very many pairs, so partitions must not be put together by their bytes
    session = left.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    a, b = a.repartition(parts, *keys, "__cell"), b.repartition(parts, *(f"__{k}" for k in keys), "__other")
    return a.join(b, on).drop("__cell", "__other", *(f"__{k}" for k in keys))


def radius_count(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, left_xy: tuple[str, str], right_id: str, right_xy: tuple[str, str], radius: float) -> DataFrame:
    """Per left row: found (distinct right ids within ``radius``) and nearest (their least distance,
    null if none). Right rows may be several points of one id."""
    (lx, ly), (rx, ry) = left_xy, right_xy
    cell = lambda c, d=0: F.floor(F.col(c) / radius) + d
    a = left.withColumns({"__cx": cell(lx), "__cy": cell(ly)})
    moves = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    b = right.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(right_id).alias("__id"), F.col(rx).alias("__rx"), F.col(ry).alias("__ry"), F.explode(moves).alias("__d"))
    b = b.withColumns({"__ox": F.floor(F.col("__rx") / radius) + F.col("__d.i"), "__oy": F.floor(F.col("__ry") / radius) + F.col("__d.j")})
    distance = F.sqrt((F.col(lx) - F.col("__rx")) ** 2 + (F.col(ly) - F.col("__ry")) ** 2)
    on = (F.col("__cx") == F.col("__ox")) & (F.col("__cy") == F.col("__oy")) & (distance <= radius)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    pairs = a.join(b, on, "left").withColumn("__dist", F.when(F.col("__id").isNotNull(), distance))
    return pairs.groupBy(*left.columns).agg(F.count_distinct("__id").alias("found"), F.min("__dist").alias("nearest"))


def nearest_within(queries: DataFrame, gallery: DataFrame, query_id: str, gallery_id: str, distance: Column, limit: float, where: Column | None = None, blocks: tuple[int, int] = (64, 4)) -> DataFrame:
    """Per query: the gallery row of least distance, the smallest id of equally near ones; null and
    no distance unless it is below ``limit``, also where no row is left to compare. ``distance`` is over the
    columns of both sides, as is ``where``, which rows may be compared.

    Every query meets the whole gallery, in blocks: gallery rows are dealt to the first number of
    blocks and queries to the second, each side goes to every block of the other, and an equi-join
    on the pair of blocks compares them. A block's best match per query is kept by a combining aggregate.
    """
    many, few = blocks
    left = queries.withColumn("__qb", F.pmod(F.xxhash64(query_id), F.lit(few))).withColumn("__gb", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    right = gallery.withColumn("__gb2", F.pmod(F.xxhash64(gallery_id), F.lit(many))).withColumn("__qb2", F.explode(F.sequence(F.lit(0), F.lit(few - 1))))
    met = (F.col("__qb") == F.col("__qb2")) & (F.col("__gb") == F.col("__gb2"))
    pairs = left.join(right, met if where is None else met & where).withColumn("__d", distance)
    best = pairs.groupBy(query_id).agg(F.min(F.struct(F.col("__d").alias("d"), F.col(gallery_id).alias("id"))).alias("b"))
    hit = F.col("b.d") < limit
    matched = best.select(F.col(query_id).alias("__q"), F.when(hit, F.col("b.id")).alias("match_id"), F.when(hit, F.col("b.d")).alias("distance"))
    return queries.select(query_id).join(matched, F.col(query_id).eqNullSafe(F.col("__q")), "left").drop("__q")


def close_pair_counts(df: DataFrame, key: str, item: str, vector: str, below: float, block: int = 2048) -> DataFrame:
    """(key, n): the pairs of rows of a key, of different items, whose vectors are less than ``below`` apart; keys
    without one are left out. Vectors that are null or empty or hold null or non-finite components are near none.

    Every pair is compared, as blocks of about ``block`` rows against each other. Distances come from matrix
    products; those too near the limit for their rounding are computed anew, component by component.
    """
    good = F.coalesce(F.forall(vector, lambda x: F.abs(x.cast("double")) < float("inf")), F.lit(False)) & (F.size(vector) > 0)
    rows = df.where(good & F.col(key).isNotNull() & F.col(item).isNotNull()).select(F.col(key).alias("__key"), F.xxhash64(item).alias("__hash"), F.col(item).alias("__item"), F.col(vector).cast("array<double>").alias("__v"), F.size(vector).alias("__dim"))
    sizes = rows.groupBy(F.col("__key").alias("__k"), F.col("__dim").alias("__d")).agg(F.ceil(F.count(F.lit(1)) / block).alias("__blocks"))
    # by the hash of the item, so that rows of one item are in one block
    dealt = rows.join(sizes, (F.col("__key") == F.col("__k")) & (F.col("__dim") == F.col("__d"))).withColumn("__mine", F.pmod("__hash", "__blocks"))
    met = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    met = met.select("__key", "__dim", F.least("__mine", "__other").alias("__p"), F.greatest("__mine", "__other").alias("__q"), "__mine", "__item", "__v")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first, last = group["__p"].iloc[0], group["__q"].iloc[0]
        one, two = (group[group["__mine"] == at] for at in (first, last))
        count = 0
        if len(one) and len(two):
            a, b = (np.stack(side["__v"].to_numpy()) for side in (one, two))
            squares_a, squares_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
            items_a, items_b = one["__item"].to_numpy(), two["__item"].to_numpy()
            for i in range(0, len(a), 512):
                part, scale = slice(i, i + 512), squares_a[i : i + 512, None] + squares_b[None, :]
                squared = scale - 2 * (a[part] @ b.T)
                unsure = 1e-14 * a.shape[1] * (scale + below * below)
                allowed = np.ones(squared.shape, dtype=bool)
                if first == last:
                    allowed = np.arange(i, i + len(squared))[:, None] < np.arange(len(b))[None, :]
                    allowed &= items_a[part, None] != items_b[None, :]
                sure = (squared < below * below - unsure) & (below > 0)
                count += int(np.count_nonzero(sure & allowed))
                at, to = np.nonzero(~sure & ~(squared >= below * below + unsure) & allowed)
                total = np.zeros(len(at))
                for x, y in zip(a[part].T, b.T, strict=True):
                    total = total + (x[at] - y[to]) * (x[at] - y[to])
                count += int(np.count_nonzero(np.sqrt(total) < below))
        return pd.DataFrame({"__key": [group["__key"].iloc[0]], "n": [count]})

    counts = met.groupBy("__key", "__dim", "__p", "__q").applyInPandas(run, f"__key {dict(df.dtypes)[key]}, n long")
    return counts.groupBy(F.col("__key").alias(key)).agg(F.sum("n").alias("n")).where("n > 0")


def first_box(points: DataFrame, boxes: DataFrame, point_id: str, x: str, y: str, margin: float = 0.0) -> DataFrame:
    """(point_id, box_idx): the first box (box_idx, bx0, by0, bx1, by1) that holds the point when
    grown by ``margin``; -1 if none does. Points meet boxes in cells as large as boxes are on average."""
    grown = boxes.select("box_idx", *((F.col(c) - margin).alias(c) for c in ("bx0", "by0")), *((F.col(c) + margin).alias(c) for c in ("bx1", "by1"))).where("bx0 <= bx1 and by0 <= by1")
    size = grown.agg(F.avg(F.col("bx1") - F.col("bx0")), F.avg(F.col("by1") - F.col("by0"))).first()
    wide, high = (float(v) if v else 1.0 for v in size)
    cells = grown.withColumn("__cx", F.explode(F.sequence(F.floor(F.col("bx0") / wide), F.floor(F.col("bx1") / wide)))).withColumn("__cy", F.explode(F.sequence(F.floor(F.col("by0") / high), F.floor(F.col("by1") / high))))
    placed = points.withColumns({"__px": F.floor(F.col(x) / wide), "__py": F.floor(F.col(y) / high)})
    inside = (F.col("__px") == F.col("__cx")) & (F.col("__py") == F.col("__cy")) & F.col(x).between(F.col("bx0"), F.col("bx1")) & F.col(y).between(F.col("by0"), F.col("by1"))
    return placed.join(cells, inside, "left").groupBy(point_id).agg(F.coalesce(F.min("box_idx"), F.lit(-1)).alias("box_idx"))


def nearest_column(x: Column, columns: Column, cutoff: float | None = None) -> Column:
    """Index from 0 of the nearest value of an array; the first of equals; null beyond ``cutoff``."""
    best = F.array_min(F.transform(columns, lambda c, i: F.struct(F.abs(c - x).alias("off"), i.alias("at"))))
    return best["at"] if cutoff is None else F.when(best["off"] <= cutoff, best["at"])


def probe_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: str, value: str, left_id: str, offsets: Sequence[int] = (0, -1, 1, -2, 2)) -> DataFrame:
    """Per left row the right ``value`` in its bucket, else in the first neighbour bucket that has one,
    in the order of ``offsets``; of several in a bucket the least."""
    tries = F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(o).alias("off")) for i, o in enumerate(offsets))))
    a = left.withColumn("__try", tries).withColumn("__bucket", F.col(bucket) + F.col("__try.off"))
    b = right.groupBy(*keys, F.col(bucket).alias("__bucket")).agg(F.min(value).alias("__value"))
    found = a.join(b, [*keys, "__bucket"]).groupBy(left_id).agg(F.min(F.struct("__try.rank", "__value")).alias("__best"))
    return left.join(found, left_id, "left").withColumn(value, F.col("__best.__value")).drop("__best")


def claims_schema(row_id: str, item_id: str) -> str:
    return f"{row_id} long, {item_id} long"


def _runs(rows: DataFrame, items: DataFrame, keys: Sequence[str], low: Column, high: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__run``: a row may take items whose ``at`` lies from ``low`` to ``high``, and rows and
    items of different runs cannot meet, so a key's runs are matched apart. Along a key the ranges are
    merged as they come in order, without comparing any two."""
    mine, theirs = ([c for c in df.columns if c not in keys] for df in (rows, items))
    none = F.lit(None).cast(rows.select(F.struct(*mine)).schema[0].dataType)
    a = rows.select(*keys, low.cast("double").alias("__lo"), high.cast("double").alias("__hi"), F.lit(0).alias("__side"), F.struct(*mine).alias("__row"))
    b = items.select(*keys, at.cast("double").alias("__lo"), at.cast("double").alias("__hi"), F.lit(1).alias("__side"), F.struct(*theirs).alias("__item"))
    both = a.withColumn("__item", F.lit(None).cast(b.schema["__item"].dataType)).unionByName(b.withColumn("__row", none))
    order = Window.partitionBy(*keys).orderBy("__lo", "__side")
    fresh = F.when(F.col("__lo") <= F.max("__hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    marked = both.withColumn("__fresh", fresh).withColumn("__run", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def side(i: int, name: str, columns: list[str]) -> DataFrame:
        # under columns of its own, as both sides come from one table
        own = marked.where(F.col("__side") == i)
        return own.select(*(F.col(c).alias(c) for c in (*keys, "__run")), *(F.col(f"{name}.{c}").alias(c) for c in columns))

    return side(0, "__row", mine), side(1, "__item", theirs)


def _matched(rows: DataFrame, items: DataFrame, keys: Sequence[str], run, schema: str) -> DataFrame:
    by = [*keys, "__run"]
    return rows.groupBy(*by).cogroup(items.groupBy(*by)).applyInPandas(run, schema)


def first_fit(rows: DataFrame, items: DataFrame, keys: Sequence[str], row_id: str, item_id: str, absolute: float = 30.0, relative: float = 0.08) -> DataFrame:
    """(row_id, item_id) claims: rows (row_id, seq, length, qty) in their order take the shortest
    unused items (item_id, length) within max(absolute, relative * length), ``qty`` at most."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["length", item_id], kind="stable")
        ids, lengths = right[item_id].tolist(), right["length"].tolist()
        used, out = [False] * len(ids), []
        for r in left.sort_values(["seq", row_id], kind="stable").itertuples():
            room, tolerance = int(r.qty), max(absolute, relative * r.length)
            for i in _reach(lengths, r.length, tolerance):
                if not room:
                    break
                if not used[i] and abs(lengths[i] - r.length) <= tolerance:
                    used[i] = True
                    room -= 1
                    out.append((getattr(r, row_id), ids[i]))
        return pd.DataFrame(out, columns=[row_id, item_id])

    slack = F.greatest(F.lit(absolute), relative * F.col("length"))
    left, right = _runs(rows, items, keys, *_around("length", slack), F.col("length"))
    return _matched(left, right, keys, run, claims_schema(row_id, item_id))


def _around(column: str, slack: Column) -> tuple[Column, Column]:
    """A range that surely holds what lies within ``slack``; a thousandth more, for rounding."""
    return F.col(column) - 1.001 * slack, F.col(column) + 1.001 * slack


def _reach(values: list[float], middle: float, slack: float) -> range:
    """Where a sorted list may hold values within ``slack`` of ``middle``."""
    return range(bisect.bisect_left(values, middle - 1.001 * slack), bisect.bisect_right(values, middle + 1.001 * slack))


def nearest_fill(rows: DataFrame, items: DataFrame, keys: Sequence[str], row_id: str, item_id: str, absolute: float = 80.0, relative: float = 0.15) -> DataFrame:
    """(row_id, item_id) claims: the longest row first takes its ``qty`` nearest unused items within
    max(absolute, relative * length)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["length", item_id], kind="stable")
        ids, lengths = right[item_id].tolist(), right["length"].tolist()
        used, out = [False] * len(ids), []
        for r in left.sort_values(["length", row_id], ascending=[False, True], kind="stable").itertuples():
            tolerance = max(absolute, relative * r.length)
            fits = ((abs(lengths[i] - r.length), ids[i], i) for i in _reach(lengths, r.length, tolerance) if not used[i])
            for _, _, i in heapq.nsmallest(int(r.qty), (f for f in fits if f[0] <= tolerance)):
                used[i] = True
                out.append((getattr(r, row_id), ids[i]))
        return pd.DataFrame(out, columns=[row_id, item_id])

    slack = F.greatest(F.lit(absolute), relative * F.col("length"))
    left, right = _runs(rows, items, keys, *_around("length", slack), F.col("length"))
    return _matched(left, right, keys, run, claims_schema(row_id, item_id))


def best_fit(rows: DataFrame, items: DataFrame, keys: Sequence[str], row_id: str, item_id: str, passes: Sequence[tuple[int, float, float]] = ((1, 0.75, 1.30), (2, 1.75, 2.45))) -> DataFrame:
    """(row_id, item_id, units) claims: items, longest first, go to the row of least relative error
    that still has capacity; each pass (units, low, high) accepts length ratios in its range."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["seq", row_id], kind="stable")
        ids, lengths, room = left[row_id].tolist(), left["length"].tolist(), left["qty"].astype(int).tolist()
        by_length = sorted((m, k) for k, m in enumerate(lengths) if m > 0)
        sizes = [m for m, _ in by_length]
        waiting = [(n, i) for i, n in sorted(zip(right[item_id], right["length"], strict=True), key=lambda x: (-x[1], x[0]))]
        out = []
        for units, low, high in passes:
            rest = []
            for n, i in waiting:
                near = by_length[bisect.bisect_left(sizes, n / high * 0.999) : bisect.bisect_right(sizes, n / low * 1.001)]
                fits = [(abs(n / (units * m) - 1), k) for m, k in near if room[k] >= units and low <= n / m <= high]
                if fits:
                    k = min(fits)[1]
                    room[k] -= units
                    out.append((ids[k], i, units))
                else:
                    rest.append((n, i))
            waiting = rest
        return pd.DataFrame(out, columns=[row_id, item_id, "units"])

    length = F.col("length")
    left, right = _runs(rows, items, keys, length * min(p[1] for p in passes) * 0.999, length * max(p[2] for p in passes) * 1.001, length)
    return _matched(left, right, keys, run, claims_schema(row_id, item_id) + ", units long")


def nearest_claim(labels: DataFrame, points: DataFrame, keys: Sequence[str], label_id: str, point_id: str, within: float = 250.0) -> DataFrame:
    """(label_id, point_id) pairs: labels (label_id, seq, x, y) in order take the nearest unused point
    (point_id, x, y) within ``within``; of equally near ones the first by id."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("x", kind="stable")
        ids, xs, ys = right[point_id].tolist(), right["x"].tolist(), right["y"].tolist()
        used, out = [False] * len(ids), []
        for r in left.sort_values(["seq", label_id], kind="stable").itertuples():
            fits = ((((xs[i] - r.x) ** 2 + (ys[i] - r.y) ** 2) ** 0.5, ids[i], i) for i in _reach(xs, r.x, within) if not used[i])
            best = min((f for f in fits if f[0] <= within), default=None)
            if best:
                used[best[2]] = True
                out.append((getattr(r, label_id), best[1]))
        return pd.DataFrame(out, columns=[label_id, point_id])

    left, right = _runs(labels, points, keys, *_around("x", F.lit(within)), F.col("x"))
    return _matched(left, right, keys, run, claims_schema(label_id, point_id))


def priority_pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by a composite priority."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
