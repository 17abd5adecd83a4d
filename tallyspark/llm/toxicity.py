"""Toxicity scores: a Levenshtein automaton walked through a lexicon trie, and context windows.

The lexicon is learned from labelled rows: words, and stems that many words begin with, found in
toxic texts far more often than in clean ones. Its trie is intersected with the Levenshtein
automaton of each word by a walk over sets of (trie node, errors); the sets are numbered and their
transitions kept, so the walk is a deterministic automaton that grows as words need it and leaves
most words after a few letters. Words within one edit of a long term match as misspellings, unless
clean texts use them.

Each hit counts by the term's log-odds, less for a misspelling and less where its window of words
looks like quotation or report rather than abuse. A logistic model of a few such features, fitted on
the same rows, gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, fold, map_rows, materialize, small_batches
from tallyspark.llm.langid import bounded_sample

SAMPLE_ROWS = 20_000
MIN_STEM = 3
MAX_STEM = 12
FUZZY_LEAST = 5
# What a misspelled hit counts of the exact one: enough that one alone is caught, less than it is sure.
MISSPELT = 0.85
WINDOW = 6
MEMO_WORDS = 100_000
# Digits read as the letters they stand for in disguised spellings.
_DIGITS = str.maketrans("013457", "oieast")
_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = "\"“”«»„‟"
# Words that report what someone said, and words that turn on the reader.
REPORTING = frozenset("said says say wrote writes quote quoted called term word slur dit écrit mot sagte schrieb wort dijo escribió palabra".split())
DIRECTED = frozenset("you your yours ur u du dich dein tu te toi vous ton tú ti usted eres".split())


class Trie:
    """Lexicon trie whose nodes are numbers; an entry is a whole word or a stem."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.word: dict[int, tuple[str, float]] = {}
        self.stem: dict[int, tuple[str, float]] = {}
        for table, ends in ((words, self.word), (stems, self.stem)):
            for term, weight in table.items():
                at = 0
                for c in term:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                    at = self.next[at][c]
                ends[at] = (term, weight)


class LexiconAutomaton:
    """Levenshtein automaton of at most one edit, intersected with a trie, determinised as it is used.

    ``match(word)`` is (term, weight, errors) of the best entry, or None: fewest errors first, then
    the longest term. Misspellings count for whole words of at least ``FUZZY_LEAST`` letters only.
    """

    def __init__(self, trie: Trie):
        self.trie = trie
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.stem_hit: list[tuple | None] = []
        self.word_hit: list[tuple | None] = []
        self.start = self._number(self._closed({(0, 0)}))

    def _closed(self, states: set) -> frozenset:
        """With the states one skipped lexicon letter away."""
        more = {(n, e + 1) for a, e in states if e < 1 for n in self.trie.next[a].values()}
        least: dict[int, int] = {}
        for a, e in states | more:
            least[a] = min(e, least.get(a, e))
        return frozenset(least.items())

    def _number(self, states: frozenset) -> int:
        if states not in self.number:
            self.number[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            stems = [(*self.trie.stem[a], 0) for a, e in states if e == 0 and a in self.trie.stem]
            words = [(*self.trie.word[a], e) for a, e in states if a in self.trie.word and (e == 0 or len(self.trie.word[a][0]) >= FUZZY_LEAST)]
            best = lambda hits: min(hits, key=lambda h: (h[2], -len(h[0]), h[0]), default=None)
            self.stem_hit.append(best(stems))
            self.word_hit.append(best(words))
        return self.number[states]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for a, e in self.sets[state]:
            children = self.trie.next[a]
            if c in children:
                out.add((children[c], e))
            if e < 1:
                out.add((a, e + 1))  # an extra letter in the text
                out.update((n, e + 1) for k, n in children.items() if k != c)  # another letter
        to = self._number(self._closed(out)) if out else -1
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[str, float, int] | None:
        at, stem = self.start, None
        for c in word:
            to = self.moves[at].get(c)
            at = self._move(at, c) if to is None else to
            if at < 0:
                return stem
            stem = self.stem_hit[at] or stem
        whole = self.word_hit[at]
        return whole if whole and (not stem or whole[2] == 0) else stem or whole


@dataclass
class ToxicityModel:
    words: dict[str, float]
    stems: dict[str, float]
    clean: frozenset = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.array([-4.0, 2.0, 0.5, 1.0, 0.5]))


class Scorer:
    """A model with its automaton and a bounded memo of word matches."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.automaton = LexiconAutomaton(Trie(model.words, model.stems))
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[str, float, int]] = {}

    def _look_up(self, words: set[str]) -> set[str]:
        new = words - self.seen
        if len(self.seen) + len(new) > MEMO_WORDS:
            self.seen, self.hits, new = set(), {}, words
        for w in new:
            hit = self.automaton.match(w)
            if hit and not (hit[2] and w in self.model.clean):
                self.hits[w] = hit
        self.seen |= new
        return words & self.hits.keys()

    def features(self, text: str | None) -> np.ndarray:
        """bias, strongest hit, log of summed hits, distinct terms, share of hits among words."""
        low = (text or "").lower().translate(_DIGITS)
        found = _WORD.findall(low)
        toxic = self._look_up(set(found))
        if not toxic:
            return np.array([1.0, 0.0, 0.0, 0.0, 0.0])
        places = [m for m in _WORD.finditer(low) if m.group() in toxic]
        total, strongest, terms = 0.0, 0.0, set()
        for m in places:
            term, weight, errors = self.hits[m.group()]
            value = weight * (MISSPELT if errors else 1.0) * self._context(low, m.start(), m.end())
            total += value
            strongest = max(strongest, value)
            terms.add(term)
        return np.array([1.0, strongest / 5, math.log1p(total) / 3, min(len(terms), 5) / 5, min(1.0, 20 * len(places) / len(found))])

    @staticmethod
    def _context(low: str, start: int, end: int) -> float:
        """1 for plain use, more where the window turns on the reader, less where it quotes or reports."""
        before, after = low[max(0, start - 60) : start], low[end : end + 60]
        near = set(_WORD.findall(before)[-WINDOW:]) | set(_WORD.findall(after)[:WINDOW])
        quoted = any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES)
        factor = 1.0
        if quoted:
            factor *= 0.6
        if near & REPORTING:
            factor *= 0.75
        if near & DIRECTED and not quoted:
            factor *= 1.15
        return factor

    def score(self, text: str | None) -> float:
        z = float(self.features(text) @ self.model.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _stems_of(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(MIN_STEM), F.least(F.length(word), F.lit(MAX_STEM))), lambda k: F.substring(word, F.lit(1), k))


def _terms(sample: DataFrame) -> tuple[dict, dict, frozenset]:
    """Words, stems and clean look-alikes of a (text, label) sample."""
    low = F.translate(F.lower("text"), "013457", "oieast")
    rows = sample.select("label", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"(\p{L}+)"), F.lit(1)))).alias("word"))
    size = sample.groupBy("label").count().toPandas().set_index("label")["count"]
    n1, n0 = int(size.get(1, 0)), int(size.get(0, 0))
    words = materialize(rows.groupBy("word").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("texts")), "tox-words")
    # a text counts once for each stem, however many of its words begin with it
    long_words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"(\p{L}{3,})"), F.lit(1)))
    begun = F.array_distinct(F.flatten(F.transform(long_words, _stems_of)))
    keyed = sample.select("label", F.explode(begun).alias("word"))
    starts = materialize(keyed.groupBy("word").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("texts")), "tox-stems")
    base = (n1 + 0.5) / (n1 + n0 + 1)

    def strong(table: DataFrame) -> dict[str, float]:
        tried = table.where("texts > 2").count()
        clean, share = F.col("texts") - F.col("toxic"), F.col("toxic") / F.col("texts")
        odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((clean + 0.5) / (n0 + 1))
        # log-likelihood of the term's share against the base rate; of all candidates that were
        # tried, about one should pass by chance
        kl = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
        rows = (
            table.where((F.col("texts") > 2) & (share > base))
            .select("word", odds.alias("odds"), (F.col("texts") * kl).alias("evidence"))
            .where((F.col("odds") > 2.0) & (F.col("evidence") > math.log(max(tried, 2))))
            .toPandas()  # words of the sample, so bounded by it
        )
        return dict(zip(rows["word"], rows["odds"].clip(upper=9.0), strict=True))

    term, stem = strong(words), strong(starts)
    # A stem stands only where no shorter one does, and where words beyond it carry the evidence.
    stem = {s: v for s, v in stem.items() if not any(s[:k] in stem for k in range(MIN_STEM, len(s)))}
    whole = {}
    for s in list(stem):
        inside = [w for w in term if w.startswith(s)]
        if len(inside) == 1:  # one word makes it: the word is the term, not its beginning
            whole[inside[0]] = term[inside[0]]
            del stem[s]
    clean: set[str] = set()
    if term or stem:
        automaton = LexiconAutomaton(Trie(term, stem))

        def near(batches):
            for b in batches:
                keep = [bool((h := automaton.match(w)) and h[2]) for w in b["word"]]
                yield b[keep]

        # look-alikes that clean texts use about as often as chance would have it
        seen = words.where(F.col("texts") - F.col("toxic") >= F.greatest(F.lit(1), F.col("toxic") / 2)).select("word")
        clean = set(seen.mapInPandas(near, "word string").toPandas()["word"])  # again words of the sample
    discard(words)
    discard(starts)
    return term, stem, frozenset(clean)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> np.ndarray:
    """Newton steps of a ridge logistic regression; the bias is penalised too, but little."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = ridge / 10
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model from (id, text, label) rows with labels 0 and 1, of which it takes a hash sample of
    about ``sample_rows``. Null texts and labels teach nothing. Without rows of both labels the
    lexicon stays empty and every score is low."""
    rows = labelled.where("text is not null and label in (0, 1)")
    sample = bounded_sample(rows, F.col("id"), sample_rows)
    # equal texts of one label are one piece of evidence: of each such group the smallest id teaches
    sample = materialize(sample.withColumn("row", F.monotonically_increasing_id()), "tox-rows")
    copies = sample.groupBy(F.xxhash64("text").alias("th"), "label").agg(F.min(F.struct("id", "row")).alias("f"))
    sample = materialize(sample.join(copies.select("f.row"), "row", "left_semi"), "tox-sample")
    words, stems, clean = _terms(sample)
    model = ToxicityModel(words, stems, clean)

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            f = np.stack([scorer.features(t) for t in b["text"]]) if len(b) else np.zeros((0, 5))
            yield pd.DataFrame({**{f"f{i}": f[:, i] for i in range(5)}, "label": b["label"].to_numpy(dtype=float)})

    # five numbers a sampled row, so bounded by sample_rows
    table = small_batches(sample).mapInPandas(run, ", ".join(f"f{i} double" for i in range(5)) + ", label double").toPandas()
    discard(sample)
    if table["label"].nunique() == 2:
        model.weights = _logistic(table[[f"f{i}" for i in range(5)]].to_numpy(), table["label"].to_numpy())
    return model


def score(df: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) per row; null and empty texts get the score of a text without hits."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "score": [scorer.score(t) for t in b["text"]]})

    return map_rows(df, id_column, {"text": F.col(text_column)}, run, "score double", rows=500)


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, label) of the labelled documents that may be learned from: crc32(doc_id) mod 5 is
    not 0. A document labelled more than once counts with its largest label."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    return docs.where(fold("doc_id", 5) != 0).select("doc_id", "text").join(known, "doc_id").select(F.col("doc_id").alias("id"), "text", "label")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = score(docs, fit(labelled_rows(docs, labels)))
    return out.select(
        F.col("id").alias("doc_id"),
        F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay, null texts stay."""
    model = fit(labelled_rows(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for part in texts:
            yield pd.Series([scorer.score(t) for t in part], dtype="float64")

    return small_batches(docs, 500).where(scored("text") < 0.5)
