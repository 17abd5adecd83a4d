"""First-wins deduplication by signature, and near-duplicates against what was kept."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[Column | str], seq: Sequence[str], where: Column | None = None) -> DataFrame:
    """The first row of each key by ``seq``; rows outside ``where`` are all kept."""
    eligible = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    # rows that are kept anyway need no partner: their own order number deals them out
    own = F.when(~eligible, F.xxhash64(*seq))
    rank = F.row_number().over(Window.partitionBy(own, *keys).orderBy(*seq))
    return df.withColumn("__rank", rank).where(~eligible | (F.col("__rank") == 1)).drop("__rank")


def line_signature(x0: str, y0: str, x1: str, y1: str, digits: int = 1) -> list[Column]:
    """A key of a segment that does not depend on which end comes first."""
    a = F.struct(F.bround(x0, digits).alias("x"), F.bround(y0, digits).alias("y"))
    b = F.struct(F.bround(x1, digits).alias("x"), F.bround(y1, digits).alias("y"))
    return [F.least(a, b), F.greatest(a, b)]


def near_duplicates(df: DataFrame, keys: Sequence[str], seq: str, ends: Sequence[str] = ("x0", "y0", "x1", "y1"), length: str = "length", within: float = 6.0, relative: float = 0.05) -> DataFrame:
    """Rows that stay when each row goes that lies within ``within`` of a kept one at both ends, in
    either order, with a length within ``relative``. Sequential per key: nearness is not transitive. Kept
    rows are looked up by the cells of their ends, so a row is compared with its neighbours only."""
    out = df.schema

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        cells: dict[tuple, list[tuple]] = {}
        good = []
        at = lambda x, y: (math.floor(x / within), math.floor(y / within))
        for i, x0, y0, x1, y1, n in group.sort_values(seq, kind="stable")[[*ends, length]].itertuples(index=True):
            cx, cy = at(x0, y0)
            near = (o for a in (cx - 1, cx, cx + 1) for b in (cy - 1, cy, cy + 1) for o in cells.get((a, b), ()))
            if any(math.hypot(x0 - a, y0 - b) < within and math.hypot(x1 - c, y1 - d) < within and abs(n - m) <= relative * max(n, m) for a, b, c, d, m in near):
                continue
            # by either end first, as the order of ends does not matter
            cells.setdefault(at(x0, y0), []).append((x0, y0, x1, y1, n))
            cells.setdefault(at(x1, y1), []).append((x1, y1, x0, y0, n))
            good.append(i)
        return group.loc[good]

    return df.groupBy(*keys).applyInPandas(keep, out)
