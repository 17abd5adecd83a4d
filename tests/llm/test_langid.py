import math
import random
import re
import zlib
from collections import Counter

import pytest

from tallyspark.llm import langid as L

random.seed(5)
SOUNDS = {"aa": "ka lo mi tu ra".split(), "bb": "sch ung ver ich ter".split(), "cc": "eau ois que tre lle".split()}


def text(lang, n=25):
    return " ".join("".join(random.choice(SOUNDS[lang]) for _ in range(random.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(lang), lang) for i, lang in enumerate(random.choice(list(SOUNDS)) for _ in range(400))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = L.identify_documents(docs).collect()
    assert {r.doc_id: r.held_out for r in rows} == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in truth}
    held = [r for r in rows if r.held_out]
    assert len(held) > 60 and all(r.lang_pred == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_unseen_words_back_off(docs):
    model = L.fit(docs)
    assert "schverichungterung" not in model.words
    assert L.predict_texts(L.WordScores(model), ["schverichungterung", "tretreoisqueeauois"])[0] == ["bb", "cc"]
    assert L.predict_texts(L.WordScores(model), ["½ ² 12 _", "x²"])[0] == ["und", L.predict_texts(L.WordScores(model), ["x²"])[0][0]]
    # nothing known, not even a letter: no opinion, but a learned language is named
    assert L.predict_texts(L.WordScores(model), ["ж"])[0][0] in SOUNDS


def test_known_words_come_first(docs):
    model = L.fit(docs)
    word = next(iter(model.words))
    assert (model.score(word) == model.words[word]).all()


def test_held_out_labels_teach_nothing(docs, spark):
    flipped = spark.createDataFrame([(r.doc_id, r.text, "zz" if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 else r.lang) for r in docs.collect()], docs.schema)
    key = lambda rows: sorted((r.doc_id, r.lang_pred, r.score) for r in rows)
    assert key(L.identify_documents(docs).collect()) == key(L.identify_documents(flipped).collect())


def test_odd_rows(odd_docs, no_docs):
    rows = L.identify_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert L.identify_documents(no_docs).collect() == []
    assert {r.lang_pred for r in L.identify_documents(odd_docs.where("doc_id is null")).collect()} == {"und"}  # nothing to learn from


def plain_model(rows):
    """(languages, words, grams) as log frequencies, counted by hand from (text, lang)."""
    langs = sorted({lang for _, lang in rows})
    counts = {lang: Counter(w for t, own in rows if own == lang for w in re.findall(r"[^\W\d_]+", t.lower())) for lang in langs}

    def logs(tables):
        known = set().union(*tables.values())
        whole = {lang: sum(tables[lang].values()) for lang in langs}
        return {w: [math.log((tables[lang][w] + 0.1) / (whole[lang] + 0.1 * (len(known) + 1))) for lang in langs] for w in known}

    words = logs({lang: Counter({w: n for w, n in c.items() if n > 1}) for lang, c in counts.items()})
    grams = {}
    for k in L.ORDERS:
        tables = {lang: Counter() for lang in langs}
        for lang, c in counts.items():
            for w, n in c.items():
                form = f"^{w}$" if k > 1 else w
                for i in range(len(form) - k + 1):
                    tables[lang][form[i : i + k]] += n
        grams[k] = logs(tables)
    return langs, words, grams


def plain_predict(model, text):
    langs, words, grams = model
    found = re.findall(r"[^\W\d_]+", text.lower())
    total = [0.0] * len(langs)
    for w in found:
        scores = words.get(w)
        for k in L.ORDERS if scores is None else ():
            form = f"^{w}$" if k > 1 else w
            known = [grams[k][g] for i in range(len(form) - k + 1) if (g := form[i : i + k]) in grams[k]]
            if known:
                scores = [sum(x) / len(known) for x in zip(*known, strict=True)]
                break
        total = [a + b for a, b in zip(total, scores or [0.0] * len(langs), strict=True)]
    mean = [x / len(found) for x in total]
    odds = [math.exp((x - max(mean)) * min(len(found), 20)) for x in mean]
    return langs[mean.index(max(mean))], max(odds) / sum(odds)


def test_scores_equal_plain_counts(docs):
    rows = docs.collect()
    model = plain_model([(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2])
    texts = {r.doc_id: r.text for r in rows}
    for r in L.identify_documents(docs).collect():
        lang, score = plain_predict(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def test_languages_of_tied_counts_keep_words(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_WORDS", 20)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows = [(i, f"{w} {w}", "many") for i, w in enumerate(words)] + [(1000, "often often often rare rare", "few")]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = set(model.words) & set(words)
    assert {"often", "rare"} <= set(model.words) and 5 < len(kept) < 50
    assert L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).words.at.keys() == model.words.at.keys()
