import numpy as np
from pyspark.sql import functions as F

from quillon.llm import embedding_dedup as ed

SF = "/root/testdata/sf0.001"


def brute(rows):
    """(n_links, component) of each (id, label, vector) from all pairs."""
    ids, root, links = [r[0] for r in rows], {}, {}
    ok = {}
    for i, lab, x in rows:
        root[i], links[i] = i, 0
        v = None if x is None or any(c is None for c in x) else np.array(x, np.float64)
        if lab is not None and v is not None and len(v) and np.isfinite(v).all() and v.any():
            ok[i] = (lab, v)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if a in ok and b in ok and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]):
                x, y = ok[a][1], ok[b][1]
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in ids}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect() if r.kept == (r.vec_id == r.component_id)}


def test_table(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(ed.op3_pca_tiles(spark, SF)) == brute(rows)


def test_clusters_and_edges(spark):
    r = np.random.default_rng(8)
    rows, n = [], 0
    for _ in range(12):
        base = r.normal(size=16)
        for _ in range(25):
            rows.append((n := n + 1, int(r.integers(0, 2)), (base + r.normal(size=16) * 0.12).astype(np.float32).tolist()))
    rows += [(n + 1, 0, rows[0][2]), (n + 2, rows[0][1], rows[0][2]), (n + 3, rows[0][1], [2 * c for c in rows[0][2]]), (n + 4, None, rows[0][2]), (n + 5, 0, None), (n + 6, 0, []), (n + 7, 0, [0.0] * 16)]
    rows += [(n + 8, 0, [float("nan")] + [1.0] * 15), (n + 9, 0, [None] + [1.0] * 15), (n + 10, 1, [1.0, 0.0]), (n + 11, 1, [1.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("id", F.lit(0)).withColumn("x", F.lit(0))
    assert got(ed.near_vectors(df)) == brute(rows)
    assert ed.near_vectors(df.limit(0)).count() == 0


def test_more_lengths_than_64(spark):
    r = np.random.default_rng(10)
    rows = []
    for d in range(1, 101):
        x = r.normal(size=d)
        rows += [(len(rows), d % 3, x.tolist()), (len(rows) + 1, d % 3, (x * 1.5 + 1e-4).tolist()), (len(rows) + 2, d % 3, r.normal(size=d).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert got(ed.near_vectors(df)) == brute(rows)


def test_bounds_lose_nothing():
    r = np.random.default_rng(9)
    a = r.normal(size=(60, 40))
    b = np.concatenate([a[:30] + r.normal(size=(30, 40)) * 0.15, r.normal(size=(30, 40))])
    a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b))
    i, j = ed.reaching(a, b, 0.9)
    assert set(zip(*np.nonzero(a @ b.T >= 0.9))) <= set(zip(i, j)) and len(i) <= (a @ b.T >= 0.9 - 1e-6).sum()


def test_crowded_cell_is_cut_into_parts(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=24)
    x = base + r.normal(size=(2200, 24)) * np.linspace(0.35, 0.02, 24)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    links = near.sum(axis=1) - 1
    df = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got = {row.vec_id: row for row in ed.near_vectors(df).collect()}
    assert [got[k].n_links for k in range(len(x))] == links.tolist()
    root = np.arange(len(x))
    while True:
        new = np.array([root[near[k]].min() for k in range(len(x))])
        if (new == root).all():
            break
        root = new
    assert [got[k].component_id for k in range(len(x))] == root.tolist()


def test_null_ids_and_ties(spark):
    rows = [(None, 1, [1.0, 0.0, 0.0]), (4, 1, [2.0, 0.0, 0.0]), (None, 1, [0.0, 1.0, 0.0]), (5, 1, [0.0, 0.0, 1.0]), (5, 1, [0.0, 0.0, 1.0])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in ed.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect())
    assert got == [(0, 0, 0), (0, 1, 4), (4, 1, 4), (5, 1, 5), (5, 1, 5)]
