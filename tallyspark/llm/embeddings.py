"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the
nearest of the signed basis vectors, the coordinate of largest size with its sign. ``width`` hashes
make a bucket, and each vector is also put into the ``PROBES - 1`` buckets it missed by least. There are as
many independent tables of buckets as a pair at the threshold needs, by the rate at which drawn pairs
collide, to be missed with a chance of ``MISS`` only. Vectors that share any bucket are compared
in double precision.

Equal vectors are one node with a multiplicity. A bucket of more than ``BLOCK`` nodes is cut into
blocks, and each pair of blocks is a unit of work, so no task gathers a large bucket. A unit emits
counts and a spanning forest, never pairs; a pair that meets in several buckets counts in the least.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, map_rows, materialize, small_batches
from tallyspark.operators.components import connected_components

THRESHOLD = 0.9
PROBES = 4
MISS = 0.002
MOST_TABLES = 64
RATE_PAIRS = 400
RATE_TABLES = 4
BUCKET_TARGET = 64
BLOCK = 512
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def rotated_size(dim: int) -> int:
    """Coordinates after padding: a power of two, and enough that random signs make many rotations."""
    return 1 << max(6, (dim - 1).bit_length())


class CrossPolytope:
    """Buckets of unit vectors: ``keys`` gives (n, tables * probes) signed 64-bit bucket numbers."""

    def __init__(self, dim: int, width: int, tables: int = 8, probes: int = PROBES, seed: int = SEED):
        self.size = rotated_size(dim)
        self.dim, self.width, self.tables = dim, width, tables
        self.choices = self.probes = probes
        self.signs = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], size=(tables, width, 3, self.size))

    def keys(self, units: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(units), self.size))
        padded[:, : self.dim] = units
        out = np.zeros((len(units), self.tables * self.probes), dtype=np.int64)
        base = 2 * self.size
        for t in range(self.tables):
            choices, losses = [], []
            for w in range(self.width):
                y = padded
                for s in self.signs[t, w]:
                    y = hadamard(y * s)
                size = np.abs(y)
                best = np.argsort(-size, axis=1, kind="stable")[:, : self.choices]
                sign = np.take_along_axis(y, best, 1) < 0
                choices.append(best * 2 + sign)
                top = np.take_along_axis(size, best, 1)
                losses.append(top[:, :1] - top)
            # the bucket itself, then the single changes of one hash that cost least
            options = np.concatenate([np.zeros((len(units), 1)), *(x[:, 1:] for x in losses)], axis=1)
            order = np.argsort(options, axis=1, kind="stable")[:, : self.probes]
            first = np.stack([c[:, 0] for c in choices], axis=1)
            for p in range(self.probes):
                chosen = first.copy()
                at = order[:, p] - 1
                for w in range(self.width):
                    own = (at >= w * (self.choices - 1)) & (at < (w + 1) * (self.choices - 1))
                    chosen[own, w] = choices[w][own, at[own] - w * (self.choices - 1) + 1]
                key = np.full(len(units), t, dtype=np.int64)
                for w in range(self.width):
                    key = key * base + chosen[:, w]
                out[:, t * self.probes + p] = key
        return out


def _units(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(len(vectors), -1)
    largest = np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very large or small values in range
    x = x / largest
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, key, vec): vec holds the doubles of a vector that can link, key its digest; both null else."""

    def one(v):
        if v is None or len(v) == 0:
            return None
        x = np.array([np.nan if c is None else c for c in v], dtype=np.float64)
        return (x + 0.0).tobytes() if np.isfinite(x).all() and x.any() else None

    def run(batches):
        for b in batches:
            vec = [one(v) for v in b["v"]]
            yield pd.DataFrame({"id": b["id"], "key": [v and hashlib.blake2b(v, digest_size=16).hexdigest() for v in vec], "vec": vec})

    return map_rows(df, id_column, {"v": F.col(vector_column).cast("array<double>")}, run, "key string, vec binary", rows=2000)


def _runs(batches, by: list[str]):
    """Groups of a stream of frames sorted by ``by``: (values, frame)."""
    held = None
    for b in batches:
        held = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(held):
            continue
        last = (held[by] == held[by].iloc[-1]).all(axis=1).to_numpy()
        split = len(held) - int(last[::-1].argmin() if not last.all() else len(held))
        if split:
            for value, part in held.iloc[:split].groupby(by, sort=False):
                yield value, part
            held = held.iloc[split:].reset_index(drop=True)
    if held is not None and len(held):
        for value, part in held.groupby(by, sort=False):
            yield value, part


def _common_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least key that each row of ``a`` shares with the same row of ``b``."""
    out = np.empty(len(a), dtype=np.int64)
    top = np.iinfo(np.int64).max
    for i in range(0, len(a), 8192):
        same = (a[i : i + 8192, :, None] == b[i : i + 8192, None, :]).any(axis=2)
        out[i : i + 8192] = np.where(same, a[i : i + 8192], top).min(axis=1)
    return out


def hash_width(nodes: int, dim: int) -> int:
    """Hashes per bucket so that chance puts about ``BUCKET_TARGET`` nodes into one."""
    base = 2 * rotated_size(dim)
    most = max(1, int(62 / math.log2(base)) - 1)
    return min(most, max(1, math.ceil(math.log(max(nodes * PROBES / BUCKET_TARGET, 1.0)) / math.log(base))))


@functools.lru_cache(maxsize=64)
def collision_rate(dim: int, width: int, threshold: float = THRESHOLD) -> float:
    """How often one table's probes bring a pair of exactly ``threshold`` together, measured on drawn pairs."""
    rng = np.random.default_rng([SEED, dim, width])
    x, z = rng.normal(size=(2, RATE_PAIRS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * z
    hasher = CrossPolytope(dim, width, RATE_TABLES, seed=SEED + 1)
    a, b = (hasher.keys(v).reshape(RATE_PAIRS, RATE_TABLES, 1, -1) for v in (x, y))
    return float((a.swapaxes(2, 3) == b).any(axis=(2, 3)).mean())


def tables_for(width: int, dim: int, threshold: float = THRESHOLD) -> int:
    """Tables that let a pair at the threshold be missed with a chance of ``MISS`` at most."""
    rate = collision_rate(dim, width, threshold)
    return max(2, math.ceil(math.log(MISS) / math.log1p(-min(rate, 0.999)))) if rate else 1 << 30


def shape_for(nodes: int, dim: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(width, tables): the width for that many vectors, or the largest below it that does not need more than
    ``MOST_TABLES`` tables; narrower hashes make fuller buckets, never fewer finds."""
    width = hash_width(nodes, dim)
    while width > 1 and tables_for(width, dim, threshold) > MOST_TABLES:
        width -= 1
    return width, tables_for(width, dim, threshold)


def link_vectors(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, links, hub) rows for nodes (node, vec, n): links adds up to the number of other
    vectors, copies included, at ``threshold`` or more; (node, hub) rows are edges that connect them."""
    facts = nodes.groupBy(F.length("vec").alias("bytes")).agg(F.count(F.lit(1)).alias("n")).collect()
    hashers = {r["bytes"]: CrossPolytope(r["bytes"] // 8, *shape_for(r["n"], r["bytes"] // 8, threshold)) for r in facts}

    def place(batches):
        for b in batches:
            for size, part in b.groupby(b["vec"].map(len), sort=False):
                keys = np.sort(hashers[size].keys(_units(list(part["vec"]))), axis=1)
                new = np.c_[np.ones(len(keys), bool), keys[:, 1:] != keys[:, :-1]]
                at, _ = np.nonzero(new)
                yield pd.DataFrame({"size": size, "key": keys[new], "node": part["node"].to_numpy()[at]})

    # vectors stay behind: only what shares a bucket with another gets its vector again
    placed = small_batches(nodes, 2000).mapInPandas(place, "size int, key long, node long")
    placed = materialize(placed, "buckets")
    full = materialize(placed.groupBy("size", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")), "full-buckets")
    met = placed.join(full, ["size", "key"]).join(nodes, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    units = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "size", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "vec"
    )
    by = ["size", "key", "i", "j"]

    def verify(batches):
        out = []
        for (size, key, i, j), part in _runs(batches, by):
            x = _units(list(part["vec"]))
            node, n = part["node"].to_numpy(), part["n"].to_numpy()
            cos = x @ x.T
            upper = np.triu(np.ones(cos.shape, dtype=bool), 1)
            if i != j:
                own = part["own"].to_numpy()
                upper &= own[:, None] != own[None, :]
            a, b = np.nonzero((cos >= threshold) & upper)
            if not len(a):
                continue
            used = np.unique(np.r_[a, b])
            keys = np.zeros((len(x), hashers[size].tables * hashers[size].probes), dtype=np.int64)
            keys[used] = hashers[size].keys(x[used])
            first = _common_least(keys[a], keys[b]) == key
            a, b = a[first], b[first]
            if not len(a):
                continue
            links = np.bincount(a, weights=n[b], minlength=len(x)) + np.bincount(b, weights=n[a], minlength=len(x))
            hub = _spanning(len(x), a, b)
            keep = links > 0
            out.append(pd.DataFrame({"node": node[keep], "links": links[keep].astype(np.int64), "hub": node[hub[keep]]}))
            if sum(map(len, out)) > 20_000:
                yield pd.concat(out, ignore_index=True)
                out = []
        if out:
            yield pd.concat(out, ignore_index=True)

    dealt = units.repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInPandas(verify, "node long, links long, hub long")


def _spanning(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each, by rounds of taking the neighbours' least."""
    root = np.arange(count)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def cosine_components(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as
    do vectors of different lengths. Equal vectors always link. Null ids take part but never name a
    component. Repeated rows count as vectors of their own. Hashing may miss a link, with a chance
    that the tests bound; what it finds is exact. Other input columns are ignored.
    """
    rows = materialize(_rows(df, id_column, vector_column), "vectors")
    nodes = materialize(
        rows.where("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.any_value("vec").alias("vec")).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    found = materialize(link_vectors(nodes.select("node", "vec", "n"), threshold), "links")
    linked = materialize(connected_components(found.where("node != hub"), "node", "hub").withColumnRenamed("node", "cc_node"), "cc-out")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labelled = nodes.select("key", "node", "least", "n").join(linked, F.col("node") == F.col("cc_node"), "left").withColumn("label", F.coalesce("component", "node"))
    names = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    facts = materialize(
        labelled.join(names, "label").join(counts, "node", "left").select(F.col("key").alias("fact_key"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id"),
        "facts",
    )
    discard(found)
    out = rows.select("id", "key").join(facts, F.col("key") == F.col("fact_key"), "left")
    alone = F.col("key").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
