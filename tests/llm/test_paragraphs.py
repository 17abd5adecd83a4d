import random

import numpy as np

from tallyspark.llm import paragraphs as P

random.seed(7)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 7))) for _ in range(400)]


def passage(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def edited(text, n):
    words = text.split()
    for _ in range(n):
        words[random.randrange(len(words))] = "zz" + random.choice(WORDS)
    return " ".join(words)


def positions(row):
    out = set()
    for s in filter(None, row.removed.split(",")):
        out.update(range(*map(int, s.split(":"))))
    return out


def corpus(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)


def wrapped(text, width):
    words = text.split()
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_passages_inside_and_across_lines(spark):
    # passages of 51 to 200 words inside longer lines, wrapped anew, at line ends and as lines of their own
    shared = {i: passage(n) for i, n in enumerate((51, 52, 60, 75, 90, 120, 160, 200))}
    texts = {}
    for i in range(160):
        before, after = passage(random.randint(1, 90)), passage(random.randint(1, 90))
        s = shared[i % 8]
        forms = (f"{before} {s} {after}", f"{before}\n{wrapped(s, 7)}\n{after}", f"{before} {wrapped(s, 13)} {after}", f"{before} {s}\n{after}", f"{before}\n{s.upper()}\n{after}")
        texts[i] = forms[i // 8 % 5] if i % 3 else f"{before}\n{passage(40)}\n{after}"
    short = passage(45)
    texts |= {1000 + i: f"{passage(30)} {short} {passage(30)}" for i in range(20)}
    want = P.brute_force(texts)
    rows = {r.doc_id: r for r in P.dedup_documents(corpus(spark, texts)).collect()}
    assert {k: positions(r) for k, r in rows.items()} == want
    for k, s in shared.items():
        holders = sorted(i for i in range(160) if i % 3 and i % 8 == k)
        assert {rows[i].component_id for i in holders} == {holders[0]}
        assert rows[holders[0]].n_removed == 0 and all(len(positions(rows[i])) >= len(s) - 20 for i in holders[1:])
    assert all(r.n_removed == 0 and r.component_id == k for k, r in rows.items() if k >= 1000 or k % 3 == 0)
    # what is left holds no passage twice
    cut = {r.doc_id: r.text for r in P.remove_repeats(corpus(spark, texts)).collect()}
    seen = {}
    for k, text in cut.items():
        words = P.words_of(text)
        for i in range(len(words) - P.MIN_WORDS + 1):
            assert seen.setdefault(" ".join(words[i : i + P.MIN_WORDS]), k) == k


def test_planted_lines(spark):
    shared = [passage(n) for n in (51, 60, 90, 200, 25)]
    texts = {}
    for i in range(60):
        lines = [passage(random.randint(3, 60)) for _ in range(3)]
        if i % 2:
            s = random.choice(shared)
            lines.insert(random.randrange(4), s if i % 4 == 1 else edited(s, len(s.split()) // 60))
        if i % 9 == 0:
            lines += ["Licensed under the Apache License, Version 2.0."]
        texts[i] = "\n".join(lines)
    rows = P.dedup_documents(corpus(spark, texts)).collect()
    assert {r.doc_id: positions(r) for r in rows} == P.brute_force(texts)
    clean = [r for r in rows if r.doc_id % 2 == 0]
    assert all(r.n_removed == 0 and r.component_id == r.doc_id for r in clean)


def test_large_group_of_near_copies(spark, monkeypatch):
    # variants of one passage, some linked through others only; blocks of eight force the block pairs
    monkeypatch.setattr(P, "BLOCK", 8)
    base = passage(80)
    texts = {i: edited(base, random.choice((0, 1, 1, 2, 3, 4))) for i in range(80)}
    texts |= {1000 + i: passage(60) for i in range(20)}
    got = P.dedup_documents(corpus(spark, texts)).collect()
    assert {r.doc_id: positions(r) for r in got} == P.brute_force(texts)


def test_similar_pairs_are_exact():
    base = passage(70)
    lines = [base, *(edited(base, i % 4) for i in range(40)), passage(60), passage(5), base, passage(20_000), "the " * 300]
    plain, sets = [P.shingles(P.words_of(t)) for t in lines], P.shingle_sets(lines)
    assert [len(x) for x in sets] == [len(x) for x in plain]
    got = P.similar_pairs(sets, 0.8)
    assert all(got[a, b] == (P.jaccard(plain[a], plain[b]) >= 0.8) for a in range(len(lines)) for b in range(len(lines)))
    many = [np.unique(np.random.default_rng(i // 2).integers(0, 1 << 63, 400_000 + i % 2, dtype=np.uint64)) for i in range(6)]
    assert (P.similar_pairs(many, 0.8) == np.kron(np.eye(3), np.ones((2, 2))).astype(bool)).all()


def test_recall_of_banding():
    hit = trials = 0
    for _ in range(400):
        a = [random.choice(WORDS) for _ in range(60)]
        b = list(a)
        b[random.randrange(5, 55)] = "changed"
        if P.jaccard(P.shingles(a), P.shingles(b)) < 0.8:
            continue
        trials += 1
        hashes = np.array([hash(w) & (2**64 - 1) for w in a + b], dtype=np.uint64)
        keys = P.min_hashes(hashes, np.array([0, 60]))
        hit += bool((keys[0] == keys[1]).any())
    assert trials > 300 and hit / trials > 0.98


def test_words_of_texts():
    texts = ["", " a  Bc\u00a0d\u3000e\x1cf \n", "İI ΑΣ\u2003Σ\t x", "\n\n", "😀 a", "one"]
    words = P.Words(texts)
    hashes = words.hashes(P._GOLDEN)
    joined = "\n".join(texts)
    assert [joined[a:z] for a, z in zip(words.starts, words.stops, strict=True)] == joined.split()
    assert words.sizes.tolist() == [len(t.split()) for t in texts]
    assert [joined[b : b + len(t)] for b, t in zip(words.begin, texts, strict=True)] == texts
    low = [w for t in texts for w in P.words_of(t)]
    seen = {}
    assert len(low) == len(hashes) and all(seen.setdefault(w, h) == h for w, h in zip(low, hashes.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen) and len(P.Words(["", " "]).hashes(P._OTHER)) == 0


def test_runs_against_plain_hashes(monkeypatch):
    monkeypatch.setattr(P, "SLICE_WORDS", 40)
    words = [random.choice(WORDS) for _ in range(300)] + ["the"] * 100
    hashes = P.Words([" ".join(words)]).hashes(P._GOLDEN)
    low = P.shingle_hashes(hashes)
    keys, pairs = P.run_keys(hashes), list(zip(P.run_hashes(hashes, P._GOLDEN), P.run_hashes(hashes, P._OTHER), strict=True))
    size = len(words) - P.MIN_WORDS + 1
    assert len(keys) == len(pairs) == size
    for i in range(size):
        key = np.zeros(1, dtype=np.uint64)
        for r in range(P.RUN_ROWS):
            key = P._folded(key, ((low[i : i + P.MIN_WORDS - P.SHINGLE_WORDS + 1] ^ P._XOR[r]) * P._MULTIPLY[r]).min(keepdims=True))
        assert key.view(np.int64)[0] == keys[i]
    runs = [tuple(words[i : i + P.MIN_WORDS]) for i in range(size)]
    assert len(set(runs)) == len(set(pairs)) == len(set(zip(runs, pairs, strict=True)))
    assert len(P.run_keys(hashes[: P.MIN_WORDS - 1])) == len(P.run_hashes(hashes[:3], P._OTHER)) == 0


def test_driver_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = P.dedup_documents(docs).collect()
    assert {r.doc_id: positions(r) for r in rows} == P.brute_force(texts)


def test_odd_rows(odd_docs, no_docs, spark):
    rows = P.dedup_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and P.dedup_documents(no_docs).collect() == []
    same = passage(60)
    docs = spark.createDataFrame([(None, same), (3, same), (3, same), (2, f"{same}\n{same}"), (None, None)], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.component_id or -1, r.n_removed) for r in P.dedup_documents(docs).collect())
    assert rows == [(-1, -1, 0), (-1, 2, 1), (2, 2, 0), (3, 2, 1), (3, 2, 1)]
    nameless = spark.createDataFrame([(None, f"{same} a"), (None, f"b {same}")], "doc_id long, text string")
    assert sorted(r.n_removed for r in P.dedup_documents(nameless).collect()) == [0, 1]


def test_long_text_and_periodic_words(spark):
    long = passage(120_000)
    some = " ".join(long.split()[70_000:70_300])
    texts = {1: "the " * 5000, 2: "of the " * 400 + passage(80), 3: passage(70) + " the" * 90, 4: long, 5: f"{passage(20)} {some}"}
    rows = P.dedup_documents(corpus(spark, texts)).collect()
    assert {r.doc_id: positions(r) for r in rows} == P.brute_force(texts)


NAMES = "th owner start stop spans component_id id t a b text_ th_ doc_th key keys lines line lo".split()


def test_removal_cuts_spans(spark):
    same, other = passage(60), passage(40)
    data = [(1, f"a\n{same}\nb"), (2, f"c\n{same}\nd\n"), (3, f" {same} "), (4, None), (5, f"{other} {same} y"), (6, "z")]
    docs = spark.createDataFrame([(*r, *NAMES) for r in data], f"doc_id long, text string, {', '.join(f'{n} string' for n in NAMES)}")
    out = P.remove_repeats(docs)
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"a\n{same}\nb", 2: "c\nd\n", 3: "", 4: None, 5: f"{other} y", 6: "z"}
    assert out.columns == docs.columns and all(r.th == "th" and r.spans == "spans" for r in out.collect())
    assert P.remove_repeats(docs.where("false")).collect() == []
