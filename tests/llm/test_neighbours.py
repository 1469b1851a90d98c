import numpy as np

from noticeflow.llm import neighbours


def brute(rows, q, k):
    own = {i: np.array(v) for i, v in rows}
    scored = sorted((-float((np.array(q[1]) * v).sum()), i) for i, v in own.items() if i != q[0] and len(v) == len(q[1]))
    return [i for _, i in scored[:k]]


def test_recall_ties_and_bad_rows(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 900)] + 0.6 * rng.normal(size=(900, 16))
    x *= rng.uniform(0.5, 2.0, (900, 1))
    x[100:160] = x[100]  # a hot vector
    good = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None] + [1.0] * 15), (2004, [float("nan")] * 16),
           (2005, [float("inf")] + [0.0] * 15), (None, good[3][1]), good[7], (3000, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "l") for i, v in good + bad],
                                  "vec_id long, embedding array<float>, score string")
    got = neighbours.nearest(table, table.where("vec_id % 20 = 0"), k=10, shard_rows=300).collect()
    assert {r["query_id"] for r in got} == set(range(0, 900, 20))
    own, hits = dict(good), 0
    for q in range(0, 900, 20):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        for r in mine:
            exact = (np.array(own[q], float) * np.array(own[r["vec_id"]], float)).sum()
            assert np.isclose(r["score"], exact, rtol=1e-12)
        hits += len({r["vec_id"] for r in mine} & set(brute(good, (q, own[q]), 10)))
    assert hits >= 0.95 * 10 * 45


def test_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5])],
                                  "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, table.where("vec_id % 20 = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [
        (0, 1, 20, 1.0), (0, 2, 3, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 0.5)]
    assert neighbours.nearest(table.where("false"), table).collect() == []


def test_pruning_keeps_an_edge_that_no_kept_one_covers():
    points = np.array([[0.0, 0.0], [1.0, 0.0], [1.1, 0.0], [0.0, 2.0]])
    kept = neighbours.prune(points, np.array([0]), np.array([[1, 2, 3, 1, -1, 0]]), 3, 1.2)
    assert kept.tolist() == [[1, 3, -1]]
