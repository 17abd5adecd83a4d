import numpy as np
import xxhash

from tallyspark.llm import simhash


def brute(rows):
    """component ids by comparing all pairs of fingerprints."""
    fps = [simhash.fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return [(k, f"{fps[i]:016x}", least[find(i)]) for i, (k, _) in enumerate(rows)]


def by_bits(text):
    """The definition, one shingle and one bit at a time."""
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x1c", "\0").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_follows_the_definition():
    for text in ("", None, "A", "a B", "Ab c d", "x y z x y z x", "É à b c d e F"):
        assert simhash.fingerprint(text) == by_bits(text)


def test_matches_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, simhash.simhash_components(docs).collect()))
    assert got == sorted(brute(rows))


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(3)
    values = []
    for _ in range(40):
        x = int(rng.integers(0, 1 << 63)) * 2 + 1
        a, b, c = rng.choice(64, 3, replace=False)
        values += [x, x ^ (1 << int(a)), x ^ (1 << int(a)) ^ (1 << int(b)), x ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c))]
    values += [0, 1, 3, 1 << 63, (1 << 64) - 1]
    signed = sorted({v - (1 << 64) if v >= 1 << 63 else v for v in values})
    edges = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    assert all((a ^ b).bit_count() <= 2 if (a ^ b) >= 0 else ((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in edges)

    def components(pairs):
        root = {v: v for v in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for v in signed:
            groups.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, groups.values()))

    every = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert components(edges) == components(every)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(map(tuple, simhash.simhash_components(odd_docs).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    assert simhash.simhash_components(no_docs).collect() == []


def test_dedup_keeps_one_of_each_group(odd_docs):
    kept = simhash.simhash_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    # ids 1 (whose row stands twice), 3 (no words), 6 and the last one name their components
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 2**60 + 1]


def test_dedup_decides_by_row(spark):
    a, b, c, d = ("one two three four five", "six seven eight nine ten", "red green blue black white", "north south east west up")
    # id 5 stands with two texts, of which b is document 1's; id 7 with two forms of one text
    rows = [(1, b), (5, a), (5, b), (6, a), (7, c), (7, c.upper()), (None, d), (None, d), (None, d.upper()), (None, a)]
    kept = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in kept) == [(0, d), (1, b), (5, a), (7, c)]


def test_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e", "x", "y")] * 5 + [(2, "f g h i j", "x", "y"), (None, "k l m n o", "x", "y"), (None, "k l m n o", "x", "y")]
    kept = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string, id string, th string").repartition(3))
    assert sorted(map(str, kept.collect())) == sorted(map(str, {spark.createDataFrame([r], kept.schema).first() for r in rows}))
