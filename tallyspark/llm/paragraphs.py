"""Substring dedup: paragraph MinHash banding, exact verification, removals clustered by components.

A passage of more than 50 words that also stands in another document is a repeat. Two kinds of
paragraph find them, so that line ends do not matter:

* every run of ``MIN_WORDS`` words, wherever it starts, also across lines. Such paragraphs overlap, and
  the MinHash rows of neighbours are mostly the same, so a text has about one distinct band key for
  every dozen words. Equal paragraphs always have equal keys: paragraphs whose key occurs in two texts
  are candidates, and those that are equal word for word (128-bit hash) are repeats.
* every line of ``MIN_WORDS`` words or more. ``BANDS`` bands of ``ROWS`` rows find a pair of similarity
  0.8 with a chance above 0.996, and colliding lines are verified by the exact Jaccard similarity of
  their five-word shingles, so edited paragraphs are found too.

Lines are verified in two rounds. First every line of a bucket is compared with the bucket's least
one, which settles nearly all of a large group in as many comparisons as it has members. Buckets that
still hold lines of several components are then compared in full, in blocks that emit a spanning
forest rather than pairs; pairs already connected are skipped.

Each repeat (equal runs, or a component of lines) stays in the first document that has it, by id and
then by hash of the text, as often as it occurs there; overlapping runs and lines of any other document are
joined to spans, which are removed. Documents of equal text are worked on once: all but the first
are repeats from their first word to their last. A repeat within one document alone is none.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, fresh, map_rows, materialize, slices, small_batches
from tallyspark.llm.embeddings import _runs
from tallyspark.operators.components import connected_components

MIN_WORDS = 51
SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS = 8
ROWS = 3
RUN_ROWS = 2
BLOCK = 256
SLICE_WORDS = 500_000
SLICE_CHARS = 1_000_000
_RNG = np.random.default_rng(11)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MULTIPLY = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
# whether a code point is white space; the last entry stands for all beyond
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])


def text_hash(column: str) -> Column:
    """128 bits that tell texts apart; null for null."""
    return F.unhex(F.md5(F.col(column).cast("binary")))


def words_of(paragraph: str) -> list[str]:
    return paragraph.lower().split()


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Five-word shingles; a shorter paragraph is its own only shingle."""
    return {tuple(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))}


def jaccard(a: set, b: set) -> float:
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) if a or b else 1.0


@functools.lru_cache(maxsize=4)
def _powers(multiplier: int, count: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(count - 1, multiplier, dtype=np.uint64)])


class Words:
    """The words of some texts in a row: their code point spans in the texts joined by line ends, and in
    ``first`` and ``sizes`` where the words of each text begin and how many they are."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        lengths = np.array([len(t) for t in texts])
        self.begin = np.cumsum(lengths + 1) - lengths - 1
        self.codes = self._codes(joined)
        self.starts, self.stops = self._bounds(self.codes)
        low = joined.lower()
        # a few characters become two in lower case; words stay words
        self.low = self.codes if low == joined else self._codes(low)
        self.low_bounds = (self.starts, self.stops) if len(low) == len(joined) else self._bounds(self.low)
        self.first = np.searchsorted(self.starts, self.begin)
        self.sizes = np.diff(np.r_[self.first, len(self.starts)])

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")

    @staticmethod
    def _bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = ~_SPACE[np.minimum(codes, len(_SPACE) - 1)]
        edge = np.diff(np.r_[np.int8(0), inside.view(np.int8), np.int8(0)])
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def hashes(self, multiplier: np.uint64) -> np.ndarray:
        """64-bit hashes of the words in lower case."""
        starts, stops = self.low_bounds
        sizes = stops - starts
        if not len(sizes):
            return np.zeros(0, dtype=np.uint64)
        chars = self.low[~_SPACE[np.minimum(self.low, len(_SPACE) - 1)]].astype(np.uint64)
        at = np.cumsum(sizes) - sizes
        power = _powers(int(multiplier), 1 << int(sizes.max()).bit_length())
        h = np.add.reduceat((chars + np.uint64(1)) * power[np.arange(len(chars)) - np.repeat(at, sizes)], at)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """32-bit hashes of the shingles that begin at each word, whatever text they run into."""
    h = np.zeros(max(0, len(hashes) - SHINGLE_WORDS + 1), dtype=np.uint64)
    for i in range(SHINGLE_WORDS):
        h = h * _GOLDEN + hashes[i : i + len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def _folded(key: np.ndarray, least: np.ndarray) -> np.ndarray:
    key = (key ^ least.astype(np.uint64)) * _GOLDEN
    return key ^ (key >> np.uint64(31))


def min_hashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) bucket keys from word hashes of paragraphs that begin at ``starts``."""
    low = shingle_hashes(hashes)
    # a shingle that runs into the next paragraph is none of its own
    ends = np.r_[starts[1:], len(hashes)]
    inside = np.ones(len(low), dtype=bool)
    for back in range(1, SHINGLE_WORDS):
        at = ends - back
        inside[at[at < len(low)]] = False
    low = low[inside]
    begin = np.r_[0, np.cumsum(ends - starts - SHINGLE_WORDS + 1)[:-1]]
    out = np.zeros((len(starts), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, dtype=np.uint64)
        for i in range(band * ROWS, band * ROWS + ROWS):
            key = _folded(key, np.minimum.reduceat((low ^ _XOR[i]) * _MULTIPLY[i], begin))
        out[:, band] = key
    return out.view(np.int64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def run_keys(hashes: np.ndarray) -> np.ndarray:
    """The band key of the run of MIN_WORDS words that begins at each word."""
    out = np.zeros(max(0, len(hashes) - MIN_WORDS + 1), dtype=np.uint64)
    for at in range(0, len(out), SLICE_WORDS):  # bounds what a very long text takes
        low = shingle_hashes(hashes[at : at + SLICE_WORDS + MIN_WORDS - 1])
        key = out[at : at + SLICE_WORDS]
        for i in range(RUN_ROWS):
            key[:] = _folded(key, _sliding_min((low ^ _XOR[i]) * _MULTIPLY[i], MIN_WORDS - SHINGLE_WORDS + 1))
    return out.view(np.int64)


def run_hashes(hashes: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    """A 64-bit hash of the run of MIN_WORDS words that begins at each word."""
    size = max(0, len(hashes) - MIN_WORDS + 1)
    out, at, width, part, power = np.zeros(size, dtype=np.uint64), 0, 1, hashes * multiplier, int(multiplier)
    while size and at < MIN_WORDS:  # parts of 1, 2, 4 ... words, those of MIN_WORDS' binary digits put together
        if MIN_WORDS & width:
            out = out * np.uint64(power) + part[at : at + size]
            at += width
        if MIN_WORDS >= 2 * width:
            part = part[: len(part) - width] * np.uint64(power) + part[width:]
            power = power * power % (1 << 64)
        width *= 2
    out ^= out >> np.uint64(32)
    return (out * _GOLDEN).view(np.int64)


def paragraph_table(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, th, pos, start, stop, ph, bands): one row with pos -1 for every text of MIN_WORDS words or more,
    whose bands are the distinct keys of its runs, and one for every such line, with its line number and
    bucket keys. start and stop are code points, of a text from its first word to its last; ph is the
    hash of the words and th that of the whole text."""

    def run(batches):
        for b in batches:
            long = b[b["text"].str.len() >= 2 * MIN_WORDS - 1]
            for a, z in slices(long["text"].str.len().tolist(), SLICE_CHARS):
                yield table(long.iloc[a:z])

    def table(part: pd.DataFrame) -> pd.DataFrame:
        words = Words(part["text"].tolist())
        hashes = words.hashes(_GOLDEN)
        keys = run_keys(hashes)
        own = np.flatnonzero(words.sizes >= MIN_WORDS)
        begin, first, size = words.begin[own], words.first[own], words.sizes[own]
        whole = pd.DataFrame({"at": own, "pos": -1, "start": words.starts[first] - begin, "stop": words.stops[first + size - 1] - begin, "ph": 0})
        whole["bands"] = [np.unique(keys[a:z]) for a, z in zip(first.tolist(), (first + size - MIN_WORDS + 1).tolist(), strict=True)]

        ends = np.r_[np.flatnonzero(words.codes == 10), len(words.codes)]
        starts = np.r_[0, ends[:-1] + 1]
        a, z = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
        many = np.flatnonzero(z - a >= MIN_WORDS)
        at = np.searchsorted(words.begin, starts[many], side="right") - 1
        begin = words.begin[at]
        lines = pd.DataFrame({"at": at, "pos": many - np.searchsorted(starts, begin), "start": starts[many] - begin, "stop": ends[many] - begin})
        a, size = a[many], (z - a)[many]
        place = np.cumsum(size) - size
        taken = hashes[np.arange(size.sum()) - np.repeat(place - a, size)]
        if len(many):
            # of one line: the sum of its word hashes by powers of a multiplier
            power = _powers(int(_OTHER), 1 << int(size.max()).bit_length())
            ph = np.add.reduceat(taken * power[np.arange(len(taken)) - np.repeat(place, size)], place)
            lines["ph"] = ((ph ^ (ph >> np.uint64(32))) * _GOLDEN).view(np.int64)
            lines["bands"] = list(min_hashes(taken, place))
        out = pd.concat([whole, lines], ignore_index=True) if len(many) else whole
        for c in ("id", "th"):
            out[c] = part[c].take(out["at"]).to_numpy()
        return out[["id", "th", "pos", "start", "stop", "ph", "bands"]]

    columns = {"th": text_hash(text_column), "text": F.col(text_column)}
    return map_rows(df, id_column, columns, run, "th binary, pos int, start int, stop int, ph long, bands array<long>", rows=300)


def number_texts(paras: DataFrame) -> DataFrame:
    """(th, id, t, start, stop): the first id of each text, its extent, and a number that orders texts by (id, th), null ids last."""
    owner = F.min(F.struct(F.col("id").isNull().alias("no"), "id")).alias("o")
    owners = paras.where("pos = -1").groupBy("th").agg(owner, F.any_value("start").alias("start"), F.any_value("stop").alias("stop"))
    return owners.select("th", "o.no", "o.id", "start", "stop").orderBy("no", "id", "th").select("th", "id", F.monotonically_increasing_id().alias("t"), "start", "stop")


def candidate_words(df: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Reads the texts of ``wanted`` (t, id, th, keys, lines) once more. Rows with a line have the hash of
    its words in ``a``; the others are the runs whose key is among ``keys``: their 128-bit hash (a, b),
    text and code point span."""
    kind = dict(df.dtypes)[id_column]
    texts = df.select(F.col(id_column).alias("id"), text_hash(text_column).alias("th"), F.col(text_column).alias("text"))
    w = wanted.select("t", F.col("id").cast(kind).alias("w_id"), F.col("th").alias("w_th"), "keys", "lines")
    found = texts.join(w, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).select("t", "text", "keys", "lines")

    def run(batches):
        for b in batches:
            said = [(t, x["ph"], text.split("\n")[x["pos"]]) for t, text, lines in zip(b["t"], b["text"], b["lines"], strict=True) if lines is not None for x in lines]
            if said:
                t, ph, line = zip(*said, strict=True)
                yield pd.DataFrame({"a": ph, "b": 0, "t": t, "start": 0, "stop": 0, "line": line})
            hot = b[b["keys"].notna()]
            for i, j in slices(hot["text"].str.len().tolist(), SLICE_CHARS):
                yield runs(hot.iloc[i:j])

    def runs(part: pd.DataFrame) -> pd.DataFrame:
        words = Words(part["text"].tolist())
        hashes = words.hashes(_GOLDEN)
        keys = run_keys(hashes)
        places = [a + np.flatnonzero(np.isin(keys[a : a + n - MIN_WORDS + 1], own)) for a, n, own in zip(words.first.tolist(), words.sizes.tolist(), part["keys"], strict=True)]
        of = np.repeat(np.arange(len(part)), [len(p) for p in places])
        p = np.concatenate(places).astype(np.int64)
        begin = words.begin[of]
        a, b = run_hashes(hashes, _GOLDEN)[p], run_hashes(words.hashes(_OTHER), _OTHER)[p]
        return pd.DataFrame({"a": a, "b": b, "t": part["t"].to_numpy()[of], "start": words.starts[p] - begin, "stop": words.stops[p + MIN_WORDS - 1] - begin, "line": None})

    return small_batches(found, 300).mapInPandas(run, "a long, b long, t long, start int, stop int, line string")


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The distinct 64-bit hashes of each line's shingles, sorted; lines must have SHINGLE_WORDS words or more."""
    out = []
    for a, z in slices([len(x) for x in lines], SLICE_CHARS):
        words = Words(lines[a:z])
        hashes = words.hashes(_GOLDEN)
        h = np.zeros(len(hashes) - SHINGLE_WORDS + 1, dtype=np.uint64)
        for i in range(SHINGLE_WORDS):
            h = h * _OTHER + hashes[i : i + len(h)]
        h ^= h >> np.uint64(32)
        h *= _GOLDEN
        out += [np.unique(h[i : i + n - SHINGLE_WORDS + 1]) for i, n in zip(words.first.tolist(), words.sizes.tolist(), strict=True)]
    return out


def similar_pairs(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets, which must not be empty, are similar: their intersections as products of matrices over
    the elements that several of them hold, a share of all elements at a time."""
    count = len(sets)
    size = np.array([len(x) for x in sets], dtype=np.float64)
    flat, of = np.concatenate(sets), np.repeat(np.arange(count), size.astype(np.int64))
    common = np.zeros((count, count), dtype=np.float32)
    parts = 1 + len(flat) // 1_000_000
    for part in range(parts):
        own = flat % np.uint64(parts) == np.uint64(part)
        _, column, held = np.unique(flat[own], return_inverse=True, return_counts=True)
        shared = held[column] > 1
        row, column = of[own][shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            i, j = np.searchsorted(column, [at, at + 8192])
            marks = np.zeros((count, 8192), dtype=np.float32)
            marks[row[i:j], column[i:j] - at] = 1
            common += marks @ marks.T
    common = common.astype(np.float64)
    np.fill_diagonal(common, size)
    return common / (size[:, None] + size[None, :] - common) >= threshold


def link_lines(members: DataFrame, lines_of: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) of the line hashes that near-duplicate another. ``members`` (key, hub, ph) holds
    the buckets of several lines with the least of each, ``lines_of`` (ph, line) the lines."""

    def check(batches):
        for b in batches:
            own, hubs = shingle_sets(b["line"].tolist()), shingle_sets(b["hub_line"].tolist())
            shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(own, hubs, strict=True)])
            every = np.array([len(x) + len(y) for x, y in zip(own, hubs, strict=True)]) - shared
            yield b.loc[shared / np.maximum(every, 1) >= threshold, ["ph", "hub"]]

    pairs = members.where("ph != hub").select("ph", "hub").distinct()
    with_lines = pairs.join(lines_of, "ph").join(lines_of.select(F.col("ph").alias("hub"), F.col("line").alias("hub_line")), "hub")
    small_batches(with_lines, 2000)
    first = materialize(with_lines.select("ph", "hub", "line", "hub_line").mapInPandas(check, "ph long, hub long"), "edges")
    labels = materialize(connected_components(first, "ph", "hub"), "cc-first")

    # buckets that hold several components, each set of members once
    named = materialize(members.join(labels, F.col("ph") == F.col("node"), "left").select("key", "ph", F.coalesce("component", "ph").alias("label")), "named")
    open_keys = (
        named.groupBy("key")
        .agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("a"), F.max("label").alias("b"), F.bit_xor(F.xxhash64("ph")).alias("x"), F.bit_xor(F.xxhash64("ph", F.lit(1))).alias("y"))
        .where("m > 2 and a != b")
    )
    open_keys = open_keys.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    open_keys = materialize(open_keys, "open")
    units = (
        named.join(open_keys, "key")
        .join(lines_of, "ph")
        .withColumn("own", F.pmod(F.xxhash64("ph"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "ph", "label", "line")
    )
    by = ["key", "i", "j"]

    def compare(batches):
        for (_, i, j), part in _runs(batches, by):
            label, ph = part["label"].to_numpy(), part["ph"].to_numpy()
            good = similar_pairs(shingle_sets(part["line"].tolist()), threshold)
            good &= label[:, None] != label[None, :]
            if i != j:
                own = part["own"].to_numpy()
                good &= own[:, None] != own[None, :]
            root: dict[int, int] = {}

            def find(x, root=root):
                while x in root:
                    x = root[x]
                return x

            edges = []
            for a, b in zip(*(k.tolist() for k in np.nonzero(np.tril(good))), strict=True):
                if (x := find(int(label[a]))) != (y := find(int(label[b]))):
                    root[max(x, y)] = min(x, y)
                    edges.append((ph[a], ph[b]))
            if edges:
                yield pd.DataFrame(edges, columns=["ph", "hub"])

    more = materialize(units.repartition(*by).sortWithinPartitions(*by).mapInPandas(compare, "ph long, hub long"), "edges")
    every = first.unionByName(more).unionByName(labels.select(F.col("node").alias("ph"), F.col("component").alias("hub")))
    out = materialize(connected_components(every, "ph", "hub"), "cc-out")
    for t in (labels, named, open_keys, first, more):
        discard(t)
    return out


def joined_spans(cut: DataFrame) -> DataFrame:
    """(t, spans) of the possibly overlapping (t, start, stop): the disjoint spans they cover, in order."""
    order = Window.partitionBy("t").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = cut.select("t", "start", "stop", F.when(F.col("start") <= reach, 0).otherwise(1).alias("new"))
    islands = begins.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("t", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def repeated_passages(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per distinct text of MIN_WORDS words or more: th (its MD5), owner (its first id), start and stop
    (from its first word to its last), spans to remove from the owner's text, and component_id, the least
    owner reachable over shared passages. Any other row of that text is a repeat from start to stop.

    Null ids come last. Rows that repeat an id and a text are one document and fare alike.
    """
    paras = materialize(paragraph_table(df, id_column, text_column), "paras")
    texts = materialize(number_texts(paras), "texts")
    owner = texts.select(F.col("th").alias("o_th"), F.col("id").alias("o_id"), "t")
    of_owners = paras.join(owner, (F.col("th") == F.col("o_th")) & F.col("id").eqNullSafe(F.col("o_id")))
    numbered = materialize(of_owners.select("t", "pos", "start", "stop", "ph", "bands"), "numbered")
    discard(paras)

    lines = numbered.where("pos >= 0")
    bands = lines.select("ph", F.explode("bands").alias("key"))
    full = materialize(bands.groupBy("key").agg(F.min("ph").alias("hub"), F.max("ph").alias("top")).where("hub != top").select("key", "hub"), "buckets")
    members = materialize(bands.join(full, "key").select("key", "hub", "ph").distinct(), "members")
    # one place where each colliding line stands
    place = lines.join(members.select("ph").distinct(), "ph", "left_semi").groupBy("ph").agg(F.min(F.struct("t", "pos")).alias("at"))
    places = place.groupBy(F.col("at.t").alias("t")).agg(F.collect_list(F.struct("ph", F.col("at.pos").alias("pos"))).alias("lines"))

    keys = numbered.where("pos = -1").select("t", F.explode("bands").alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo != hi").select("key"), "shared")
    hot = keys.join(shared, "key").groupBy("t").agg(F.collect_set("key").alias("keys"))
    wanted = materialize(texts.join(hot.join(places, "t", "full"), "t").select("t", "id", "th", "keys", "lines"), "wanted")
    found = materialize(candidate_words(df, wanted, id_column, text_column), "found")
    lines_of = materialize(found.where("line is not null").groupBy(F.col("a").alias("ph")).agg(F.any_value("line").alias("line")), "lines")
    linked = link_lines(members, lines_of, threshold)

    first = F.min("t").alias("lo"), F.max("t").alias("hi")
    labelled = lines.join(linked, F.col("ph") == F.col("node"), "left").select("t", "start", "stop", F.coalesce("component", "ph").alias("label"))
    labelled = materialize(labelled, "labelled")
    classes = materialize(labelled.groupBy("label").agg(*first).where("lo != hi").select("label", "lo"), "classes")
    runs = found.where("line is null").select("a", "b", "t", "start", "stop")
    equal = materialize(runs.groupBy("a", "b").agg(*first).where("lo != hi").select("a", "b", "lo"), "equal")
    columns = "t", "start", "stop", "lo"
    cut = labelled.join(classes, "label").where("t != lo").select(*columns).unionByName(runs.join(equal, ["a", "b"]).where("t != lo").select(*columns))
    cut = materialize(cut, "cut")
    for t in (full, members, shared, wanted, found, lines_of, linked, labelled, classes, equal, numbered):
        discard(t)
    linked = connected_components(cut.select("t", "lo").distinct(), "t", "lo")
    linked = materialize(linked.join(texts.select(F.col("t").alias("component"), F.col("id").alias("component_id")), "component").select(F.col("node").alias("t"), "component_id"), "cc-out")
    out = texts.join(joined_spans(cut), "t", "left").join(linked, "t", "left")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    out = materialize(out.select("th", F.col("id").alias("owner"), "start", "stop", F.coalesce("spans", none).alias("spans"), F.coalesce("component_id", "id").alias("component_id")), "passages")
    for t in (cut, linked, texts):
        discard(t)
    return out


def _spans(own_id: Column, owner: Column, spans: Column, start: Column, stop: Column) -> Column:
    return F.when(own_id.eqNullSafe(owner), spans).otherwise(F.array(F.struct(start.alias("start"), stop.alias("stop"))))


def dedup_documents(df: DataFrame) -> DataFrame:
    """Per document: doc_id, n_removed, removed_chars, removed (``start:stop`` code point spans,
    comma-joined) and component_id, the smallest doc_id reachable over shared passages, itself
    included. Null texts and those of fewer than MIN_WORDS words have none. Other columns are ignored."""
    facts = repeated_passages(df)
    docs = df.select("doc_id", text_hash("text").alias("doc_th"))
    out = docs.join(facts, F.col("doc_th") == F.col("th"), "left")
    spans = F.when(F.col("th").isNull(), F.array().cast("array<struct<start:int,stop:int>>"))
    spans = spans.otherwise(_spans(F.col("doc_id"), F.col("owner"), F.col("spans"), F.col("start"), F.col("stop")))
    out = out.select("doc_id", spans.alias("spans"), F.when(F.col("th").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.select(
        "doc_id",
        F.size("spans").cast("long").alias("n_removed"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("removed_chars"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",").alias("removed"),
        "component_id",
    )


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``df`` with the removed spans, and one white space after each, cut from its texts. No row goes,
    and all columns stay, whatever their names."""
    names = {c: fresh(df, c) for c in ("th", "owner", "start", "stop", "spans", "component_id")}
    facts = repeated_passages(df, id_column, text_column).withColumnsRenamed(names)
    th, owner, start, stop, spans, _ = (F.col(n) for n in names.values())
    joined = df.join(facts, text_hash(text_column) == th, "left")
    text = F.col(text_column)
    # the kept pieces lie between the end of one span and the start of the next
    cuts = _spans(F.col(id_column), owner, spans, start, stop)
    begins = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda s: s["stop"] + F.when(F.substring(text, s["stop"] + 1, F.lit(1)).rlike(r"^\s"), 1).otherwise(0)))
    ends = F.concat(F.transform(cuts, lambda s: s["start"]), F.array(F.length(text)))
    kept = F.array_join(F.zip_with(begins, ends, lambda a, z: F.substring(text, a + 1, F.greatest(z - a, F.lit(0)))), "")
    changed = th.isNotNull() & (F.size(cuts) > 0)
    return joined.withColumn(text_column, F.when(changed, kept).otherwise(text)).select(*df.columns)


def brute_force(texts: dict, threshold: float = THRESHOLD) -> dict:
    """{id: set of code point positions to remove} of a few documents, for tests: all runs of MIN_WORDS
    words by their words, and all pairs of such lines, with neither bands nor hashes."""
    gone: dict = {k: set() for k in texts}
    runs: dict[str, list[tuple]] = {}
    lines = []
    for key in sorted(texts):
        text = texts[key] or ""
        at = [m.span() for m in re.finditer(r"\S+", text)]
        words = words_of(text)
        for i in range(len(words) - MIN_WORDS + 1):
            runs.setdefault(" ".join(words[i : i + MIN_WORDS]), []).append((key, at[i][0], at[i + MIN_WORDS - 1][1]))
        start = 0
        for line in text.split("\n"):
            if len(w := words_of(line)) >= MIN_WORDS:
                lines.append((key, start, start + len(line), shingles(w), " ".join(w)))
            start += len(line) + 1
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            if lines[a][4] == lines[b][4] or jaccard(lines[a][3], lines[b][3]) >= threshold:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = list(runs.values())
    groups += [[lines[i][:3] for i in range(len(lines)) if find(i) == r] for r in {find(i) for i in range(len(lines))}]
    for group in groups:
        keeper = min(key for key, _, _ in group)
        for key, start, stop in group:
            if key != keeper:
                gone[key].update(range(start, stop))
    return gone
