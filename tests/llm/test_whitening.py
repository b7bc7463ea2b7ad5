import numpy as np
import pytest

from corpusmill.llm import whitening as wh


def brute(vectors, components=16):
    """x, n, sums and the covariance's eigenpairs of a list of float vectors, in whole numbers as far as they go."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    c = ((fit * n - sums).astype(float)) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:components]
    return x, n, sums, e[order], v[:, order], e.sum()


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(6, 6)) * np.array([2, 1.5, 1, 0.7, 0.4, 0.2])
    rows = [(i, [float(np.float32(c)) for c in v], 1) for i, v in enumerate(rng.normal(size=(700, 6)) @ mix)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(400)]  # a hot vector
    rows += [(None, rows[1][1], 1), (5, rows[5][1], 1), (5, rows[5][1], 1)]
    bad = [(2000, None, 1), (2001, [1.0] * 5 + [None], 1), (2002, [float("nan")] * 6, 1), (2003, [float("inf")] + [0.0] * 5, 1), (2004, [], 1), (2005, [1.0, 2.0], 1), (2006, [1e30] * 6, 1)]
    return rows, spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, x int").repartition(7)


def test_against_brute_force(table):
    rows, df = table
    got = wh.whiten_embeddings(df).collect()
    x, n, sums, e, v, whole = brute([r[1] for r in rows])
    assert len(got) == 6 * len(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = None
    for (i, _, _), xs in zip(rows, x):
        want = np.array([(n * a - s) / n for a, s in zip(xs, sums)], float) @ v / np.sqrt(e)
        dev = sum((n * a - s) ** 2 for a, s in zip(xs, sums))
        for c in range(1, 7):
            for r in by[i][c]:
                assert r.n == n and r.deviation == dev
                assert r.explained == pytest.approx(e[c - 1] / whole, rel=1e-9)
                assert r.identity_error < 1e-9
        mine = np.array([by[i][c][0].whitened for c in range(1, 7)])
        signs = np.sign(mine * want) if signs is None else signs
        assert np.allclose(mine, signs * want, atol=1e-8)


def test_partitions_do_not_matter(table):
    _, df = table
    a = {(r.vec_id, r.component): r.whitened for r in wh.whiten_embeddings(df).collect()}
    b = {(r.vec_id, r.component): r.whitened for r in wh.whiten_embeddings(df.repartition(1)).collect()}
    for c in range(1, 7):
        keys = [k for k in a if k[1] == c]
        s = 1 if a[keys[0]] * b[keys[0]] > 0 else -1
        assert all(a[k] == pytest.approx(s * b[k], abs=1e-9) for k in keys)


def test_small_and_flat_tables(spark, table):
    _, df = table
    assert wh.whiten_embeddings(df.limit(0)).collect() == []
    assert wh.whiten_embeddings(df.where("vec_id >= 2000")).where("vec_id <> 2006").count() in (0, 2)
    one = wh.whiten_embeddings(spark.createDataFrame([(1, [0.5, 0.25])] * 3, "vec_id int, embedding array<double>")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, 1, 0, None, 0.0, 0.0) for _ in range(3) for c in (1, 2)]
    line = wh.whiten_embeddings(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(4)], "vec_id int, embedding array<double>")).collect()
    assert {r.component: r.explained for r in line} == {1: pytest.approx(1), 2: 0.0} and all(r.whitened is None for r in line if r.component == 2)


def test_merge_is_chan(table):
    rows, _ = table
    x = np.array([[int(np.floor(64 * c)) + 10**12 for c in r[1]] for r in rows])
    a, b, whole = wh.moments(x[:300]), wh.moments(x[300:]), wh.moments(x)
    m = wh.merge(a, b)
    assert (m.n, m.sums) == (whole.n, whole.sums) and np.allclose(m.scatter, whole.scatter, rtol=1e-13)


def test_deviation_at_the_border():
    x = np.array([[0, 0], [3_037_000_499, 0], [3_037_000_500, 0], [2**50, 5]])
    want = [sum(int(a) ** 2 for a in r) for r in x]
    assert wh.deviations(x, 1, [0, 0]).to_pylist() == [v if v < 2**63 else None for v in want]
