import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import bpe, packing

PATH = public_tokenizers.path(bpe.BYTE_VOCABULARY)


def check(rows, docs):
    """Every id in one piece, sequences gapless and full or a power of two."""
    library = Tokenizer.from_file(PATH)
    want = {}
    for key, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.setdefault(key, []).append(ids)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for key, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, want[key]))
        for p in pieces:
            fits = [x for x in want[key] if len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32]
            assert fits and p.length > 0
        if len(want[key]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at
                at += p.length
            assert at == len(want[key][0])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.LENGTH and at & (at - 1) == 0


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_many_shards_and_pools(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BYTES", 100_000)
    monkeypatch.setattr(packing, "POOL_TOKENS", 20_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs).collect()
    assert len({r.sequence_id >> 32 for r in rows}) > 3
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd_docs, no_docs):
    check(packing.pack(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert packing.pack(no_docs).collect() == []


def test_windows_keep_the_mixture():
    share = np.array([0.5, 0.3, 0.2])
    totals = np.array([500_000, 300_000, 200_000])
    slices, taken, owed = packing.plan(totals, share, np.zeros(3), 16_384, to_the_end=False)
    given_by = np.zeros(3)
    for i, a, b in slices:
        given_by[i] += b - a
        if given_by.sum() % 16_384 == 0:
            assert np.abs(given_by - share * given_by.sum()).max() < 1
    assert abs(owed.sum()) < 1e-6 and (taken == given_by).all()


def test_a_short_source_is_owed_and_paid_back():
    share = np.array([0.5, 0.5])
    slices, taken, owed = packing.plan(np.array([20_000, 9_000]), share, np.array([-2000.0, 2000.0]), 1024, to_the_end=True)
    assert taken.tolist() == [20_000, 9_000]
    first = {i: b - a for i, a, b in slices[:2]}
    assert first.get(1, 0) > first.get(0, 0)  # what it carried in deficit comes first
    assert abs(owed.sum()) < 1e-6


def test_targets_by_weight(spark):
    docs = spark.createDataFrame([(i, "word " * 3000, "a" if i % 2 else "b", 1) for i in range(40)], "doc_id long, text string, source string, shard int")
    rows = packing.pack(docs, targets={"a": 3, "b": 1}).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    windows = {}
    for r in rows:
        if r.sequence_id < 1 << 62:
            w = windows.setdefault(r.sequence_id // packing.WINDOW_SEQUENCES, [0, 0])
            w[r.doc_id % 2] += r.length
    assert windows and all(abs(b / (a + b) - 0.75) < 0.01 for a, b in windows.values())


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 5000))
def test_sequence_ends(total):
    ends = packing.sequence_ends(total)
    sizes = np.diff(np.r_[0, ends])
    assert sizes.sum() == total and all(s & (s - 1) == 0 and 0 < s <= 1024 for s in sizes.tolist())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=5), st.integers(0, 2**32 - 1))
def test_plans_take_everything_once(totals, seed):
    rng = np.random.default_rng(seed)
    share = rng.dirichlet(np.ones(len(totals)))
    owed = rng.normal(0, 200, len(totals))
    slices, taken, _ = packing.plan(np.array(totals), share, owed - owed.mean(), 1024, to_the_end=True)
    assert taken.tolist() == totals
    at = [0] * len(totals)
    for i, a, b in slices:
        assert a == at[i] and b > a
        at[i] = b


def test_shares_of_a_window():
    tokens, part = np.array([800, 150, 50, 0]), np.array([0.7, 0.01, 0.02, 0.27])
    assert packing.window_shares(tokens, part, 500, fixed=True) is part
    assert np.allclose(packing.window_shares(tokens, part, 500, fixed=False), [0.7, 0.225, 0.075, 0])
    assert np.allclose(packing.window_shares(tokens, part, 100, fixed=False), [0.7, 0.0225, 0.0075, 0.27])
    assert np.allclose(packing.window_shares(np.zeros(2), np.zeros(2), 100, fixed=False), 0)


def test_many_sources_keep_their_proportions(spark, monkeypatch):
    # two large sources and 1,200 small ones, which together hold most of the tokens
    monkeypatch.setattr(packing, "SHARD_BYTES", 2_000_000)
    large = [(i, "word " * 1000, "a" if i % 5 > 1 else "b", 1.0) for i in range(400)]
    small = [(1000 + i, "word " * 800, f"s{i % 1200}", 1.0) for i in range(1250)]
    docs = spark.createDataFrame([*large, *small], "doc_id long, text string, source string, weight double").repartition(4)
    rows = packing.pack(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    of = {r.doc_id: min(r.source, "s") for r in docs.collect()}
    windows = {}
    for r in rows:
        if r.sequence_id < 1 << 62:
            w = windows.setdefault(r.sequence_id // packing.WINDOW_SEQUENCES, {"a": 0, "b": 0, "s": 0})
            w[of[r.doc_id]] += r.length
    total = 400 * 1001 + 1250 * 801
    assert len(windows) > 20
    for w in windows.values():
        whole = sum(w.values())
        assert abs(w["a"] / whole - 240 * 1001 / total) < 0.01 and abs(w["b"] / whole - 160 * 1001 / total) < 0.01


def test_pools_stay_small(spark, monkeypatch):
    # at any size a pool gathers about POOL_TOKENS tokens, and a shard its bytes
    monkeypatch.setattr(packing, "SHARD_BYTES", 40_000)
    monkeypatch.setattr(packing, "POOL_TOKENS", 15_000)
    sizes = {}
    for n in (600, 2400):
        docs = spark.createDataFrame([(i, "word " * (20 + i * 37 % 500), f"s{i * i % 11}") for i in range(n)], "doc_id long, text string, source string").repartition(4)
        held = {}
        for r in packing.pack(docs).collect():
            held[r.sequence_id >> 32] = held.get(r.sequence_id >> 32, 0) + r.length
        pools = [v for k, v in held.items() if k >= 1 << 30]
        sizes[n] = (len(pools), max(pools))
    assert sizes[2400][0] > 2 * sizes[600][0] > 4 and max(v for _, v in sizes.values()) < 3 * 15_000
