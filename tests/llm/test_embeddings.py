import numpy as np
import pytest

from tallyspark.llm import embeddings as E


def brute(rows, threshold=0.9):
    n = len(rows)
    good = []
    for _, v in rows:
        x = None if not v or any(c is None for c in v) else np.array(v, dtype=float)
        good.append(None if x is None or not np.isfinite(x).all() or not x.any() else x / np.abs(x).max())
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if good[a] is None or good[b] is None or len(good[a]) != len(good[b]):
                continue
            if good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    out = []
    for i, (k, _) in enumerate(rows):
        least = min((x for x in groups[find(i)] if x is not None), default=None)
        out.append((k, links[i], least, k == least))
    return sorted(out, key=repr)


def clusters(seed, groups, size, dim=64):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        c = rng.normal(size=dim)
        out += [c + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.3, 0.33]) for _ in range(size)]
    return out + list(rng.normal(size=(200, dim)))


@pytest.mark.parametrize("block", [512, 16])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    vectors = clusters(1, 12, 12) + [np.ones(64)] * 40
    rows = [(i * 3 + 1, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, E.cosine_components(df).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("dim", [2, 3, 8, 64, 128, 768])
@pytest.mark.parametrize("nodes", [100, 10**5, 10**8, 10**11])
def test_recall_at_the_threshold(dim, nodes):
    width, tables = E.shape_for(nodes, dim)
    assert tables <= E.MOST_TABLES and 1 <= width <= E.hash_width(nodes, dim)
    rng = np.random.default_rng(width)
    x = rng.normal(size=(500 if dim < 300 else 200, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * z
    hasher = E.CrossPolytope(dim, width, tables)
    a, b = hasher.keys(x), hasher.keys(y)
    assert np.mean([np.isin(p, q).any() for p, q in zip(a, b, strict=True)]) > 0.97


def test_transform_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 32))
    y = E.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(E.hadamard(y), x)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (None, [3.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
        (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (10, [1e-300, 0.0]), (11, [1e300, 1e298]), (None, None), (None, [0.0, 1.0]), (12, [-0.0, 5.0]),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, key string, node int")
    assert sorted(map(tuple, E.cosine_components(df).collect()), key=repr) == brute(rows)
    assert E.cosine_components(df.where("false")).collect() == []


def test_driver_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, E.cosine_components(df).collect()), key=repr) == brute(rows)
