"""Language identification, word first with back-off to shorter character n-grams.

A known word scores its log frequency in each language. An unseen word is scored by its character
n-grams of the longest order any of which is known, trying the orders from long to short. Scores of
a text's words add up; the language with the largest sum wins and a softmax of the mean gap to it
gives the confidence.

Counts are gathered in the JVM from a bounded sample of labelled rows and reach the executors as
tables of bounded size: about the ``MAX_WORDS`` most frequent words and ``MAX_GRAMS`` most frequent n-grams
a language and order; of entries that tie with the last, a hash draws as many as there is room for.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, fold, map_rows, materialize, slices

SAMPLE_ROWS = 20_000
MAX_WORDS = 20_000
MAX_GRAMS = 4_000
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
MEMO_WORDS = 400_000


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` at most, chosen by a hash of ``key``; all if there are fewer."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * rows / total))


class ScoreTable:
    """A row of scores for each entry, kept as one matrix."""

    def __init__(self, at: dict[str, int], rows: np.ndarray):
        self.at, self.rows = at, rows

    def __contains__(self, entry: str) -> bool:
        return entry in self.at

    def __getitem__(self, entry: str) -> np.ndarray:
        return self.rows[self.at[entry]]

    def __iter__(self):
        return iter(self.at)

    def __len__(self) -> int:
        return len(self.at)


class LanguageModel:
    """Log frequencies of words and n-grams per language, as plain tables."""

    def __init__(self, words: pd.DataFrame, grams: pd.DataFrame):
        self.languages = sorted(set(words["lang"]) | set(grams["lang"]))
        at = {g: i for i, g in enumerate(self.languages)}
        n = max(len(at), 1)
        self.words = self._table(words["lang"].map(at), words["word"], words["n"], n)
        self.grams = {}
        for k in ORDERS:
            own = grams[grams["word"].str.len() == k]
            self.grams[k] = self._table(own["lang"].map(at), own["word"], own["n"], n)

    @staticmethod
    def _table(lang, key, count, n: int) -> ScoreTable:
        names = {w: i for i, w in enumerate(dict.fromkeys(key))}
        counts = np.zeros((len(names), n))
        if len(names):
            np.add.at(counts, (key.map(names).to_numpy(), lang.to_numpy()), count.to_numpy(dtype=float))
        # a count below one for what a language lacks: absence speaks, but less than presence
        logs = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * (len(names) + 1)))
        return ScoreTable(names, logs.astype(np.float32))

    def score(self, word: str) -> np.ndarray:
        if word in self.words:
            return self.words[word]
        for k in ORDERS:
            table = self.grams[k]
            text = f"^{word}$" if k > 1 else word
            found = [table[g] for g in (text[i : i + k] for i in range(len(text) - k + 1)) if g in table]
            if found:
                return sum(found[1:], found[0]) / len(found)
        return np.zeros(max(len(self.languages), 1), dtype=np.float32)


def _grams_of(text: Column, k: int) -> Column:
    size = F.length(text)
    starts = F.when(size >= k, F.sequence(F.lit(1), size - (k - 1)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(k)))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> LanguageModel:
    """A model of the non-null ``lang`` values of ``labelled``, from about ``sample_rows`` of its rows."""
    rows = labelled.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).where("lang is not null and text is not null")
    sample = bounded_sample(rows, F.col("id"), sample_rows)
    tokens = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    counts = materialize(sample.select("lang", tokens.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "lang-words")

    def top(table: DataFrame, by: list[str], most: int) -> pd.DataFrame:
        """About the ``most`` most frequent entries of each group: of those that tie with the last, a share by hash."""
        sizes = table.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("m")).toPandas().sort_values([*by, "n"], ascending=[True] * len(by) + [False])
        if sizes.empty:
            return pd.DataFrame(columns=["lang", "word", "n"], dtype=object)
        sizes["room"] = most - (sizes.groupby(by)["m"].cumsum() - sizes["m"])
        last = sizes[sizes["room"] > 0].groupby(by).tail(1)
        keys = F.concat_ws("\0", *by)

        def of_group(values) -> Column:
            return F.create_map(*(x for row, v in zip(last[by].astype(str).agg("\0".join, axis=1), values, strict=True) for x in (F.lit(row), F.lit(v))))[keys]

        least, share = of_group(last["n"].astype(int).tolist()), of_group((last["room"] / last["m"]).clip(upper=1.0).tolist())
        drawn = F.pmod(F.xxhash64("word", F.lit("tie")), F.lit(1_000_000)) < share * 1_000_000
        return table.where((F.col("n") > least) | ((F.col("n") == least) & drawn)).select("lang", "word", "n").toPandas()

    # a word of one document may be a name or a slip; two or more sightings make it known
    words = top(counts.where("n > 1"), ["lang"], MAX_WORDS)
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    grams = []
    for k in ORDERS:
        text = marked if k > 1 else F.col("word")
        grams.append(counts.select("lang", F.explode(_grams_of(text, k)).alias("word"), "n"))
    table = grams[0]
    for g in grams[1:]:
        table = table.unionByName(g)
    table = table.groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("k", F.length("word"))
    model = LanguageModel(words, top(table, ["lang", "k"], MAX_GRAMS))
    discard(counts)
    return model


class WordScores:
    """Scores of the words seen so far as rows of one matrix; emptied when it grows large."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, max(len(self.model.languages), 1)), dtype=np.float32)

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """Summed scores of each word list; lists must not be empty."""
        if len(self.index) > MEMO_WORDS:
            self.clear()
        new = list(set(chain.from_iterable(texts)).difference(self.index))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, np.stack([self.model.score(w) for w in new])])
        sizes = np.array([len(t) for t in texts])
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(sizes.sum()))
        return np.add.reduceat(self.rows[at].astype(np.float64), np.cumsum(sizes) - sizes, axis=0)


def _lettered(words: list[str]) -> bool:
    """Whether a letter is among them: fractions and raised digits make words too."""
    return any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)


def predict_texts(words: WordScores, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and confidence of each text."""
    languages = words.model.languages
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    for a, b in slices([len(t or "") for t in texts], 1_000_000):
        split = {i: found for i in range(a, b) if languages and _lettered(found := _WORD.findall((texts[i] or "").lower()))}
        if not split:
            continue
        sizes = np.array([len(w) for w in split.values()])
        mean = words.sums(list(split.values())) / sizes[:, None]
        gap = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(sizes, 20)[:, None])
        best = mean.argmax(axis=1)
        sure = gap[np.arange(len(gap)), best] / gap.sum(axis=1)
        for i, k, x in zip(split, best.tolist(), sure.tolist(), strict=True):
            langs[i], scores[i] = languages[k], x
    return langs, scores


def identify(df: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row: ``und`` and 0 where the text is null, empty or has no letter."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        words = WordScores(shared.value)
        for b in batches:
            langs, scores = predict_texts(words, list(b["text"]))
            yield pd.DataFrame({"id": b["id"], "lang_pred": langs, "score": scores})

    return map_rows(df, id_column, {"text": F.col(text_column)}, run, "lang_pred string, score double")


def identify_documents(df: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Documents whose crc32(doc_id) mod 4 is 2 are
    held out of fitting; a null doc_id is never held out and, having no fold, never learned from."""
    model = fit(df.where(fold("doc_id", 4) != 2))
    out = identify(df, model)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
