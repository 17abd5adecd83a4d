"""Mixture-controlled packing by deficit round-robin over source queues.

Documents are dealt to shards by a hash of id, text and input partition, so every shard holds every source about as
the corpus does, however large a source is. Within a shard each source is a queue of tokens, whatever the
number of sources. A source that fills whole windows in a shard has its share of the corpus; smaller ones
are dealt round-robin inside the share that is left to them, each by its tokens in the shard. A
window of ``WINDOW_SEQUENCES`` sequences is filled by giving each source its share of the window
plus the deficit it carries; a source whose queue runs short keeps the difference as its deficit for
the next window, and the others fill its place. When a shard can no longer fill windows to their
proportions, its remaining tokens and its deficits are carried to a second round, in which the rests
of many shards are pooled and packed to the end, starting from the sum of their deficits.

Sequences hold ``LENGTH`` tokens. Each pool's last tokens become sequences whose lengths are
descending powers of two, which need no padding, so nothing is padded at all.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import bpe
from tallyspark.llm.common import materialize, small_batches

LENGTH = 1024
WINDOW_SEQUENCES = 16
SHARD_BYTES = 8_000_000
POOL_TOKENS = 4_000_000
SLACK = 0.05
SEPARATOR = 0
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(maxsize=2)
def fast_encoder(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizers file as an encoder of the same ids: in such a file
    a token's id is its rank."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of = {c: b for b, c in enumerate(bpe.byte_letters())}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(path: str, text: str | None) -> np.ndarray:
    """Ids of a text, then the separator. Texts with characters whose class depends on Unicode
    tables are encoded over the library's own splitting."""
    if bpe.UNSAFE.search(text or ""):
        return np.append(bpe.tokenizer(path).encode_batch([text])[0], np.array([SEPARATOR], "<u4"))
    ids = fast_encoder(path).encode(text or "", allowed_special="all")
    return np.array([*ids, SEPARATOR], dtype="<u4")


def allocate(left: np.ndarray, share: np.ndarray, owed: np.ndarray, window: int, slack: float) -> np.ndarray | None:
    """Tokens each source gives to the next window of ``window`` tokens, or None if the sources that
    still have tokens could only fill it by going over their shares by more than ``slack``."""
    want = np.maximum(share * window + owed, 0.0)
    take = np.minimum(np.floor(want), left).astype(np.int64)
    over = int(take.sum()) - window
    while over > 0:  # deficits asked for more than the window: cut the least owed first
        order = np.argsort(owed, kind="stable")
        for i in order:
            cut = min(int(take[i]), over)
            take[i] -= cut
            over -= cut
    missing = -over
    rest = left - take
    if missing > min(int(rest.sum()), len(left) + slack * window) and missing > len(left):
        return None
    if missing > rest.sum():
        return None
    order = np.argsort(-(want - take) * (rest > 0) - 1e-9 * rest, kind="stable")
    # what rounding down left over goes out one by one, the rest to those furthest behind
    rounded = order[(rest[order] > 0) & (want[order] > take[order])][:missing]
    take[rounded] += 1
    rest[rounded] -= 1
    missing -= len(rounded)
    for i in order if missing else ():
        more = min(int(rest[i]), missing)
        take[i] += more
        missing -= more
        if not missing:
            break
    return take


def plan(totals: np.ndarray, share: np.ndarray, owed: np.ndarray, window: int, to_the_end: bool) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """(slices, taken, owed): slices (source, from, to) of the queues in packed order, what was taken
    of each queue, and the deficits left. Deficits add up to zero."""
    slices: list[tuple[int, int, int]] = []
    at, owed = np.zeros(len(totals), dtype=np.int64), owed.astype(float).copy()
    while (left := totals - at).any():
        size = min(window, int(left.sum())) if to_the_end else window
        take = allocate(left, share, owed, size, size if to_the_end else SLACK)
        if take is None:
            if not to_the_end:
                break
            take = left if int(left.sum()) <= size else np.minimum(left, np.maximum(0, size - (np.cumsum(left) - left)))
        for i in np.argsort(-owed, kind="stable"):
            if take[i]:
                slices.append((int(i), int(at[i]), int(at[i] + take[i])))
        at += take
        owed += share * int(take.sum()) - take
    return slices, at, owed


def sequence_ends(total: int, length: int = LENGTH) -> np.ndarray:
    """Where sequences end in a run of ``total`` tokens: full ones, then descending powers of two."""
    full = total // length * length
    ends = list(range(length, full + 1, length))
    rest, at = total - full, full
    for bit in range(length.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return np.array(ends, dtype=np.int64)


class Queues:
    """Token queues of the sources of one shard or pool: pieces of documents in a set order."""

    def __init__(self, sources: list[str], own: list[str], pieces: list[np.ndarray]):
        self.sources = sources
        at = {s: i for i, s in enumerate(sources)}
        of = np.array([at[s] for s in own], dtype=np.int64)
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.rows, self.ends, self.ids = [], [], []
        for i in range(len(sources)):
            rows = np.flatnonzero(of == i)
            self.rows.append(rows)
            self.ends.append(np.cumsum(size[rows]))
            self.ids.append(np.concatenate([pieces[r] for r in rows]) if len(rows) else np.zeros(0, "<u4"))
        self.totals = np.array([len(x) for x in self.ids], dtype=np.int64)

    def cut(self, slices: list[tuple[int, int, int]]) -> pd.DataFrame:
        """(row, skip, length, ids_crc32, sequence, offset) of every piece of the packed slices."""
        if not slices:
            return pd.DataFrame({k: np.zeros(0, np.int64) for k in ("row", "skip", "length", "ids_crc32", "sequence", "offset")})
        source, begin, stop = (np.array(x, dtype=np.int64) for x in zip(*slices, strict=True))
        to = np.cumsum(stop - begin)
        base = to - (stop - begin)
        ids = np.concatenate([self.ids[i][a:b] for i, a, b in slices])
        cuts = [base, ends := sequence_ends(int(to[-1]))]
        for i in range(len(self.sources)):
            own = np.flatnonzero(source == i)
            if len(own):
                inside = self.ends[i]
                slot = np.searchsorted(stop[own], inside, side="left")
                good = slot < len(own)
                slot, inside = own[slot[good]], inside[good]
                cuts.append(base[slot] + inside - begin[slot])
        cuts = np.unique(np.concatenate(cuts))
        first, last = cuts[:-1], cuts[1:]
        if not len(first) or first[0] != 0:
            first, last = np.r_[0, first], np.r_[cuts[:1], last]
        slot = np.searchsorted(to, first, side="right")
        place = begin[slot] + first - base[slot]
        row, skip = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for i in range(len(self.sources)):
            own = np.flatnonzero(source[slot] == i)
            if len(own):
                doc = np.searchsorted(self.ends[i], place[own], side="right")
                row[own] = self.rows[i][doc]
                skip[own] = place[own] - np.r_[0, self.ends[i]][doc]
        sequence = np.searchsorted(ends, first, side="right")
        view = memoryview(np.ascontiguousarray(ids)).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        return pd.DataFrame({"row": row, "skip": skip, "length": last - first, "ids_crc32": crc, "sequence": sequence, "offset": first - np.r_[0, ends][sequence]})

    def rest(self, taken: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(row, skip, ids) of what lies behind ``taken`` in the queues."""
        out = []
        for i, rows in enumerate(self.rows):
            starts = np.r_[0, self.ends[i]]
            for k in range(int(np.searchsorted(self.ends[i], taken[i], side="right")), len(rows)):
                a = max(int(starts[k]), int(taken[i]))
                out.append((int(rows[k]), a - int(starts[k]), self.ids[i][a : int(self.ends[i][k])].tobytes()))
        return out


def window_shares(tokens: np.ndarray, weight: np.ndarray, window: int, fixed: bool) -> np.ndarray:
    """Each queue's share of a window, from its tokens here and its part of the corpus. With ``fixed``, that
    of a stated mixture, the parts stand as they are; what absent sources miss is not given to others."""
    if fixed:
        return weight
    large = weight * tokens.sum() >= window
    share = np.where(large, weight, 0.0)
    small = np.where(large, 0.0, tokens)
    if small.sum():
        return share + max(0.0, 1.0 - share.sum()) * small / small.sum()
    return share / share.sum() if share.sum() else share


def _weights(docs: DataFrame, targets: dict[str, float] | None) -> tuple[DataFrame, int]:
    """((of, weight) rows of sources, bytes of all texts). Without ``targets`` a source's weight is its part of
    the corpus' UTF-8 bytes."""
    sums = materialize(docs.groupBy("source").agg(F.sum(F.octet_length("text") + 1).alias("n")), "pack-sources")
    total = int(sums.agg(F.sum("n")).first()[0] or 0)
    if targets is None:
        return sums.select(F.col("source").alias("of"), (F.col("n") / max(total, 1)).alias("weight")), total
    whole = float(sum(targets.values())) or 1.0
    return docs.sparkSession.createDataFrame([(s, float(w) / whole) for s, w in targets.items()], "of string, weight double"), total


def pack(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    path: str | None = None,
    targets: dict[str, float] | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids by the vocabulary at ``path``, then id 0; null and empty texts are the
    separator alone. Every id lies in exactly one piece. A null source is a source of its own; with
    ``targets`` (source -> weight), sources it does not name have weight 0 and are packed as filling.
    Each pool's last windows hold what is left, in whatever proportions. Null ids and repeated rows are packed like any other; an empty table gives no row.
    """
    path = path or public_tokenizers.path(bpe.BYTE_VOCABULARY)
    docs = df.select(F.col(id_column).cast("string").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.coalesce(F.col(source_column).cast("string"), F.lit("\0null")).alias("source"))
    weights, total = _weights(docs, targets)
    named = {} if targets is None else {s: w / (sum(targets.values()) or 1.0) for s, w in targets.items()}
    shards = max(1, -(-total // SHARD_BYTES))
    window = LENGTH * WINDOW_SEQUENCES

    def queued(sources: pd.Series, weight: pd.Series, ids: list[np.ndarray], owed: dict[str, float]) -> tuple[Queues, np.ndarray, np.ndarray]:
        """The queues with their shares of a window and what they are owed at the start."""
        parts = dict(zip(sources, weight, strict=True))
        queues = Queues(sorted({*parts, *named, *owed}), sources.tolist(), ids)
        part = np.array([named[s] if s in named else parts.get(s, 0.0) for s in queues.sources])
        start = np.array([owed.get(s, 0.0) for s in queues.sources])
        return queues, window_shares(queues.totals, part, window, bool(named)), start

    def first_round(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"], na_position="first", kind="stable").reset_index(drop=True)
        ids = [encode(path, t) for t in group["text"]]
        queues, share, start = queued(group["source"], group["weight"], ids, {})
        slices, taken, owed = plan(queues.totals, share, start, window, to_the_end=False)
        shard = int(group["shard"].iloc[0])
        done = queues.cut(slices)
        sizes = np.array([len(x) for x in ids])
        doc, owner, weight = group["doc_id"], group["source"].to_numpy(), group["weight"].to_numpy()
        out = pd.DataFrame(
            {
                "doc_id": doc.take(done["row"]).reset_index(drop=True), "start": done["skip"], "length": done["length"], "ids_crc32": done["ids_crc32"],
                "doc_tokens": sizes[done["row"]], "sequence_id": (np.int64(shard) << 32) + done["sequence"], "offset": done["offset"],
                "kind": 0, "shard": shard, "source": None, "ids": None, "owed": 0.0, "weight": 0.0,
            }
        )
        left = queues.rest(taken)
        rows = [r for r, _, _ in left]
        rest = pd.DataFrame(
            {
                "doc_id": doc.take(rows).reset_index(drop=True), "start": [s for _, s, _ in left], "length": [len(x) // 4 for _, _, x in left], "ids_crc32": 0,
                "doc_tokens": sizes[rows] if rows else np.zeros(0, np.int64), "sequence_id": 0, "offset": 0,
                "kind": 1, "shard": shard, "source": [owner[r] for r in rows], "ids": [x for _, _, x in left], "owed": 0.0, "weight": weight[rows] if rows else np.zeros(0),
            }
        )
        debt = pd.DataFrame({"doc_id": [None] * len(owed), "start": 0, "length": 0, "ids_crc32": 0, "doc_tokens": 0, "sequence_id": 0, "offset": 0, "kind": 2, "shard": shard, "source": queues.sources, "ids": None, "owed": owed, "weight": 0.0})
        return pd.concat([out, rest, debt[debt["owed"] != 0]], ignore_index=True)[columns]

    schema = PIECES + ", kind int, shard long, source string, ids binary, owed double, weight double"
    columns = [c.split()[0] for c in schema.split(", ")]
    # the input partition spreads rows that repeat an id and a text
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(shards)))
    dealt = dealt.join(weights, F.col("source") == F.col("of"), "left").select("doc_id", "text", "source", "shard", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    one = materialize(dealt.groupBy("shard").applyInPandas(first_round, schema), "pack-one")

    tokens = one.where("kind = 1").agg(F.sum("length")).first()[0] or 0
    pools = max(1, -(-int(tokens) // POOL_TOKENS))

    def second_round(group: pd.DataFrame) -> pd.DataFrame:
        owed_rows, group = group[group["kind"] == 2], group[group["kind"] == 1]
        owed = owed_rows.groupby("source")["owed"].sum().to_dict()
        group = group.sort_values(["shard", "doc_id", "start", "ids"], na_position="first", kind="stable").reset_index(drop=True)
        ids = [np.frombuffer(x, "<u4") for x in group["ids"]]
        queues, share, start = queued(group["source"], group["weight"], ids, owed)
        slices, _, _ = plan(queues.totals, share, start, window, to_the_end=True)
        done = queues.cut(slices)
        row = done["row"].to_numpy()
        pool = int(owed_rows["pool"].iloc[0]) if len(owed_rows) else int(group["pool"].iloc[0])
        return pd.DataFrame(
            {
                "doc_id": group["doc_id"].take(row).reset_index(drop=True), "start": group["start"].to_numpy()[row] + done["skip"], "length": done["length"], "ids_crc32": done["ids_crc32"],
                "doc_tokens": group["doc_tokens"].to_numpy()[row], "sequence_id": ((np.int64(1) << 30) + pool << 32) + done["sequence"].astype(np.int64), "offset": done["offset"],
            }
        )

    small_batches(one)
    two = one.where("kind > 0").withColumn("pool", F.col("shard") % pools).groupBy("pool").applyInPandas(second_round, PIECES)
    packed = one.where("kind = 0").select(*[c.split()[0] for c in PIECES.split(", ")]).unionByName(two)
    return packed.withColumn("doc_id", F.col("doc_id").cast(dict(df.dtypes)[id_column]))
