"""SimHash near-duplicates: segment-popcount cells, a grid range-join, exact verification.

A 64-bit fingerprint is embedded as the popcounts of its 16 four-bit segments. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints, so fingerprints
that differ in at most two bits are at most two apart on the grid, and some grid cell lies within
one of both. The range-join is therefore an equi-join on cells: each fingerprint goes to its own
cell and the at most 32 cells one step away. Cells that hold a single fingerprint are dropped.

Survivors are verified exactly without listing pairs: within a cell, two fingerprints differ in at
most two bits if and only if they share a midpoint, a 64-bit word at most one bit from either, whose
popcounts are that cell. Everything on a midpoint is linked to the least fingerprint on it, so a
group of any size costs a bounded number of rows per fingerprint and no link between different
fingerprints is lost from the components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, map_rows, materialize
from tallyspark.operators.components import connected_components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2


def fingerprint(text: str | None, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of one text; null and word-less texts give zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    if len(words) <= width:
        pieces = [joined]
    else:
        pieces = [joined[a:b] for a, b in zip(starts, ends[width - 1 :], strict=False)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, seed) for p in pieces], dtype=np.uint64)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounds the unpacked bits of a very long text
        part = hashes[at : at + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (total * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprints(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, th, fp): th is the hash of the text, fp the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"], "th": b["th"], "fp": fps})

    return map_rows(df, id_column, {"th": F.xxhash64(text_column), "text": F.col(text_column)}, run, "th long, fp long", rows=500)


def _popcounts(fp: Column) -> Column:
    """Packed popcounts of the 16 nibbles, each in its own nibble."""

    low = F.lit(0x1111111111111111).cast("long")
    return sum((F.shiftrightunsigned(fp, n).bitwiseAND(low) for n in (1, 2, 3)), fp.bitwiseAND(low))


def _cells(v: Column) -> Column:
    out = [v]
    for s in range(16):
        n = F.shiftrightunsigned(v, 4 * s).bitwiseAND(F.lit(15).cast("long"))
        step = F.lit(1 << (4 * s)).cast("long")
        out += [F.when(n < 4, v + step), F.when(n > 0, v - step)]
    return F.array_compact(F.array(*out))


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Edges (src, dst) among the distinct longs ``fp`` whose components are those of all pairs
    that differ in at most two bits."""
    placed = fps.select("fp", F.explode(_cells(_popcounts(F.col("fp")))).alias("cell"))
    shared = materialize(
        placed.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b").select("cell"), "cells"
    )
    near = placed.join(shared, "cell")
    d = F.col("cell") - _popcounts(F.col("fp"))
    size = F.abs(d)
    flips = []
    for b in range(4):
        bit = F.shiftleft(size, b)
        is_set = F.col("fp").bitwiseAND(bit) != 0
        flips.append(F.when(is_set == (d < 0), F.col("fp").bitwiseXOR(bit)))
    middle = F.when(d == 0, F.array(F.col("fp"))).otherwise(F.array_compact(F.array(*flips)))
    members = materialize(near.select("fp", F.explode(middle).alias("mid")), "mids")
    hubs = materialize(
        members.groupBy("mid").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).where("hub != top").select("mid", "hub"),
        "hubs",
    )
    edges = materialize(
        members.join(hubs, "mid")
        .where((F.col("fp") != F.col("hub")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= MAX_BITS))
        .select(F.col("fp").alias("src"), F.col("hub").alias("dst"))
        .distinct(),
        "edges",
    )
    for t in (shared, members, hubs):
        discard(t)
    return edges


def simhash_components(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Words are the runs of characters other than ASCII white space of the text with A-Z in lower
    case; three-word shingles, repeats included, vote on each bit by XXH64 with seed 42. Texts of
    one or two words have one shingle, null and word-less texts the fingerprint zero, which links
    as any other. ``component_id`` is the smallest id reachable; null ids take part, never name a
    component, and a component of null ids only has a null one. Repeated rows stay rows of their
    own. Other input columns are ignored.
    """
    return _grouped(df, id_column, text_column).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, th, fp, label, component_id) of every row; label tells components of one name apart."""
    prints = materialize(with_fingerprints(df, id_column, text_column), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "fps")
    edges = link_fingerprints(distinct.select("fp"))
    linked = materialize(connected_components(edges), "cc-out")
    labelled = distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("label")
    )
    named = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    names = materialize(labelled.join(named, "label").select("fp", "label", "component_id"), "names")
    discard(edges)
    return prints.join(names, "fp").select("id", "th", "fp", "label", "component_id")


def simhash_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group: that of the least id, of several with that id the one whose text has the
    least hash, and of rows that repeat both any one. All columns stay, whatever their names."""
    groups = _grouped(df, id_column, text_column)
    least = groups.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "th")).alias("k"))
    chosen = groups.select("label", "id", "th").join(least.select(F.col("label").alias("of"), "k"), F.col("label") == F.col("of"))
    same = F.col("id").eqNullSafe(F.col("k.id")) & (F.col("th") == F.col("k.th"))
    kept = materialize(chosen.where(same).groupBy("label", "id", "th").agg(F.count(F.lit(1)).alias("n")), "kept")
    th = F.xxhash64(text_column)

    def among(keys: DataFrame) -> DataFrame:
        return df.join(keys, df[id_column].eqNullSafe(keys["id"]) & (th == keys["th"]), "left_semi")

    repeated = among(kept.where("n > 1"))
    row = F.any_value(F.struct(*(repeated[c] for c in repeated.columns))).alias("row")
    once = repeated.groupBy(repeated[id_column], th).agg(row).select("row.*")
    return among(kept.where("n = 1")).unionByName(once)
