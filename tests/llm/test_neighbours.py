import numpy as np

from weftdocs.llm import neighbours as N


def clustered(n, rng):
    base = rng.normal(size=(n, 32))
    near = base[: n // 4] + 0.15 * rng.normal(size=(n // 4, 32))
    x = np.concatenate([base, near, near[: n // 8] + 0.1 * rng.normal(size=(n // 8, 32))])
    return x * rng.uniform(0.5, 2, size=(len(x), 1))


def truth(ids, x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in sorted(range(len(x)), key=lambda j: (-s[i, j], ids[j]))[:k]:
            if s[i, j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def test_recall_over_cells_and_shards(spark):
    rng = np.random.default_rng(3)
    x = clustered(800, rng).astype("f4")
    d = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<float>")
    want = truth(list(range(len(x))), x.astype("f8"), 5, 0.85)
    got = {(r.id_a, r.id_b) for r in N.top_pairs(d, "id", "v", cell=150).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_edges(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [float("inf"), 0.0, 0.0]), (8, []), (9, [1.0, 0.0]), (10, [1.0, None, 0.0]), (11, e)]
    d = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("*", "id AS cell")
    assert sorted((r.id_a, r.id_b) for r in N.top_pairs(d, "id", "v").collect()) == [(1, 2), (1, 11), (2, 11)]
    assert N.top_pairs(d.limit(0), "id", "v").count() == 0 and N.top_pairs(d.filter("id = 1"), "id", "v").count() == 0


def test_many_copies_stay_whole(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.95, 0.3])]
    d = spark.createDataFrame(rows, "id long, v array<float>")
    got = {(r.id_a, r.id_b) for r in N.top_pairs(d, "id", "v").collect()}
    assert got == {(a, b) for b in range(40) for a in range(min(b, 6)) if a < 5 or b < 6 and a < b and a < 5} | {(a, b) for b in range(6) for a in range(b)} - {(5, 5)} | {(a, 100) for a in range(5)}


def test_hot_cell_is_split_again(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    hot = centre + 0.08 * rng.normal(size=(500, 16))  # a third of the rows lie close together without being copies
    x = np.concatenate([hot, rng.normal(size=(1000, 16))]).astype("f4")
    d = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<float>")
    tree, large = N.grown(N.unit(d, "id", "v").select("id", "v"), 100, 4)
    assert len(tree) > 1 and max(large.values(), default=0) < 300  # of 500 and more before
    want = truth(list(range(len(x))), x.astype("f8"), 5, 0.85)
    got = {(r.id_a, r.id_b) for r in N.top_pairs(d, "id", "v", cell=100).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_what_centres_cannot_part_is_sharded(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = (np.ones(8) + 0.03 * rng.normal(size=(300, 8))).astype("f4")
    d = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<float>")
    monkeypatch.setattr(N, "LEVELS", 0)
    tree, large = N.grown(N.unit(d, "id", "v").select("id", "v"), 20, 4)
    assert not tree and large == {-8: 300}
    want = truth(list(range(len(x))), x.astype("f8"), 5, 0.85)
    got = {(r.id_a, r.id_b) for r in N.top_pairs(d, "id", "v", cell=20).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_lengths_are_searched_apart_and_scaled_copies_are_copies(spark):
    rows = [(1, [1.0, 0.1]), (2, [1.0, 0.2]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.1, 0.0]), (5, [3.0, 0.3, 0.0])]
    d = spark.createDataFrame(rows, "id long, v array<float>")
    assert sorted((r.id_a, r.id_b) for r in N.top_pairs(d, "id", "v").collect()) == [(1, 2), (3, 4), (3, 5), (4, 5)]
    assert N.unit(d, "id", "v").filter("id > 3").select("h1", "h2").distinct().count() == 1
