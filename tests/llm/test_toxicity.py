import itertools
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import toxicity as T

random.seed(3)
CLEAN = ["".join(random.choice("abcdefgh") for _ in range(random.randint(3, 8))) for _ in range(300)]
TERMS = ["grumbolt", "snarfle", "wibbler"]


def edits(word):
    """Every word one edit away, by definition."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}


def corpus(n=600):
    rows, labels = [], []
    for i in range(n):
        words = [random.choice(CLEAN) for _ in range(random.randint(20, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(random.randint(1, 3)):
                words.insert(random.randrange(len(words)), random.choice(TERMS))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def frames(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(frames):
    return T.fit(T.labelled_rows(*frames))


def test_automaton_accepts_exactly_one_edit():
    automaton = T.LexiconAutomaton(T.Trie({t: 1.0 for t in TERMS}, {}))
    near = {w for t in TERMS for w in edits(t)}
    for w in near:
        assert automaton.match(w)[2] == (0 if w in TERMS else 1)
    far = {w for w in itertools.chain(CLEAN, ("grumbo", "grumboltxx", "gxumbxlt", "", "s")) if w not in near}
    assert all(automaton.match(w) is None for w in far)


def test_stems_match_beginnings():
    automaton = T.LexiconAutomaton(T.Trie({"idle": 1.0}, {"grum": 2.0}))
    assert automaton.match("grumbling") == ("grum", 2.0, 0) and automaton.match("grm") is None
    assert automaton.match("idle") == ("idle", 1.0, 0) and automaton.match("ide") is None  # short words match exactly


def test_learns_terms_and_catches_misspellings(model):
    assert set(TERMS) <= set(model.words) | {t for t in TERMS if any(t.startswith(s) for s in model.stems)}
    scorer = T.Scorer(model)
    text = "abc def bcd " * 5
    assert scorer.score(text + "you grumbolt") > 0.5 > scorer.score(text)
    assert all(0.5 < scorer.score(text + w) < scorer.score(text + "grumbolt") for w in ("grumboltt", "grumbot", "grumbelt"))
    assert scorer.score(text + "gr0mbolt wibb1er") > 0.5
    assert scorer.score(text + "GRUMBOLT!!!") > 0.5
    assert scorer.score(None) == scorer.score("") < 0.5


def test_quotation_scores_lower_than_abuse(model):
    scorer = T.Scorer(model)
    abuse, quote = "abc def you grumbolt abc def", 'he said the word "grumbolt" abc def'
    assert scorer.features(quote)[1] < scorer.features(abuse)[1]


def test_held_out_accuracy(frames):
    labels = {r.doc_id: r.toxic for r in frames[1].collect()}
    rows = T.score_documents(*frames).collect()
    assert {r.doc_id: r.held_out for r in rows} == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in labels}
    held = [r for r in rows if r.held_out]
    assert len(held) > 80 and sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_labels_teach_nothing(frames, spark):
    docs, labels = frames
    flipped = spark.createDataFrame([(r.doc_id, r.quality, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.toxic) for r in labels.collect()], labels.schema)
    key = lambda rows: sorted((r.doc_id, r.score) for r in rows)
    assert key(T.score_documents(docs, labels).collect()) == key(T.score_documents(docs, flipped).collect())


def test_texts_that_share_their_ends_all_teach(spark):
    # one banner before and one licence behind every text; of equal texts with one label one teaches
    rows, labels = corpus(240)
    banner, licence = "all rights to this page are reserved by its owners and printers " * 2, " to be used under the terms of the licence that comes with it " * 2
    rows = [(i, banner + text + licence) for i, text in rows]
    docs = spark.createDataFrame(rows + [(1000 + i, text) for i, text in rows if i % 6 == 0], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(1000 + i, 1, t) for i, _, t in labels if i % 6 == 0], "doc_id long, quality int, toxic int")
    both, once = T.fit(T.labelled_rows(docs, known).withColumn("id", F.col("id") % 1000)), T.fit(T.labelled_rows(docs, known).dropDuplicates(["text"]))
    assert set(TERMS) <= set(both.words) | {t for t in TERMS if any(t.startswith(s) for s in both.stems)}
    assert both.words == once.words and both.stems == once.stems


def test_equal_texts_of_either_label_teach(spark):
    rows = spark.createDataFrame([(i, f"plain words {i}" if i % 2 else f"snarfle words {i // 4 * 4}", int(i % 4 == 0)) for i in range(200)], "id long, text string, label int")
    words = T.fit(rows).words
    assert "snarfle" not in words  # as many clean texts as toxic ones hold it


def test_odd_rows(odd_docs, no_docs, frames, spark):
    none = frames[1].where("false")
    rows = T.score_documents(odd_docs, none).collect()
    assert len(rows) == odd_docs.count() and all(r.predicted == 0 for r in rows)
    assert T.score_documents(no_docs, frames[1]).collect() == []
    odd_labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 0, 1), (2, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert T.score_documents(odd_docs, odd_labels).count() == odd_docs.count()
    kept = T.reject_toxic(odd_docs, none)
    assert kept.schema == odd_docs.schema and kept.count() == odd_docs.count()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_match(model, word):
    """The best lexicon entry of a word by edit distances to every entry."""
    stems = [(0, -len(s), s, v) for s, v in model.stems.items() if word.startswith(s)]
    words = [(d, -len(t), t, v) for t, v in model.words.items() if (d := distance(word, t)) == 0 or (d == 1 and len(t) >= T.FUZZY_LEAST)]
    best = min(words, default=None)
    if best and stems and best[0]:
        best = None
    best = best or min(stems, default=None) or min(words, default=None)
    return best and (best[2], best[3], best[0])


def plain_score(model, text):
    low = (text or "").lower().translate(T._DIGITS)
    found = list(T._WORD.finditer(low))
    total = strongest = hits = 0
    terms = set()
    for m in found:
        hit = plain_match(model, m.group())
        if hit is None or (hit[2] and m.group() in model.clean):
            continue
        value = hit[1] * (T.MISSPELT if hit[2] else 1) * T.Scorer._context(low, m.start(), m.end())
        total, strongest, hits = total + value, max(strongest, value), hits + 1
        terms.add(hit[0])
    f = [1, strongest / 5, math.log1p(total) / 3, min(len(terms), 5) / 5, min(1, 20 * hits / len(found)) if hits else 0]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(f, model.weights, strict=True))))))


def test_scores_equal_plain_search(frames, model):
    rows = T.score(frames[0], model).collect()
    texts = {r.doc_id: r.text for r in frames[0].collect()}
    sample = [r for r in rows if r.id % 4 == 0]
    assert len(sample) > 50 and all(abs(r.score - plain_score(model, texts[r.id])) < 1e-9 for r in sample)
