import numpy as np
from pyspark.sql import functions as F

from terrainframe.llm import whitening as wh


def brute(vectors):
    """n, S and V of the distinct x-vectors, by whole numbers of any size."""
    xs = {i: tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for i, v in vectors.items()}
    fit = sorted(set(xs.values()))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[n * a - b for a, b in zip(x, s, strict=True)] for x in fit], object)
    v = np.array([[float(e) / float(n) ** 3 for e in row] for row in c.T.dot(c)])
    return xs, n, s, v


def rows_of(spark, vectors):
    return spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")


def test_against_whole_numbers(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(20, 20))
    vectors = {i: (rng.normal(size=20) @ mix).tolist() for i in range(400)}
    vectors |= {1000 + i: vectors[3] for i in range(200)}
    df = rows_of(spark, vectors).repartition(5).selectExpr("*", "1 AS n", "2 AS _x", "3 AS whitening", "4 AS place", "5 AS c0")
    out = {r.vec_id: r for r in wh.whiten(df).collect()}
    xs, n, s, v = brute(vectors)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    assert n == 400 and set(out) == set(vectors)
    sign = None
    for i, x in xs.items():
        w = out[i].whitening
        assert w.n == n and w.deviation == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        want = (np.array([a - b / n for a, b in zip(x, s, strict=True)]) @ axes) / np.sqrt(values)
        sign = np.sign(want * np.array(w.whitened)) if sign is None else sign
        assert np.allclose(np.array(w.whitened) * sign, want, atol=1e-8)
        assert np.allclose(w.explained, values / np.trace(v), rtol=1e-9)
        assert w.identity_error < 1e-9
    assert (out[3]["n"], out[3]["_x"], out[3]["c0"]) == (1, 2, 5)


def test_odd_vectors(spark):
    bad = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0, 2.0, 3.0])]
    good = [(10, [0.5, 1.0]), (11, [0.25, -1.0]), (None, [-0.5, 1.0]), (11, [0.25, -1.0])]
    out = wh.whiten(spark.createDataFrame(bad + good, "vec_id long, embedding array<double>")).collect()
    assert sorted(str(r.vec_id) for r in out) == ["10", "11", "11", "None"] and {r.whitening.n for r in out} == {3}
    assert wh.whiten(spark.createDataFrame(bad[:5], "vec_id long, embedding array<double>")).count() == 0
    empty = wh.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.select("whitening.whitened", "whitening.n").count() == 0


def test_constant_dimensions_and_one_vector(spark):
    flat = wh.whiten(spark.createDataFrame([(i, [float(i), 7.0, float(i)]) for i in range(9)], "vec_id long, embedding array<double>")).collect()
    assert all(r.whitening.whitened[1:] == [None, None] and r.whitening.whitened[0] is not None for r in flat)
    assert abs(flat[0].whitening.explained[0] - 1) < 1e-12 and flat[0].whitening.identity_error < 1e-9
    one = wh.whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")).first().whitening
    assert (one.n, one.deviation, one.whitened, one.identity_error) == (1, 0, [None, None], None)


def test_entries_far_apart_stay_exact(spark):
    vectors = {1: [1e9, -1.0], 2: [-1e9, 1e30], 3: [3.0, 2.5], 4: [1e9, -1.0]}
    out = {r.vec_id: r.whitening for r in wh.whiten(rows_of(spark, vectors)).collect()}
    xs, n, s, _ = brute({i: [min(c, float(wh.MOST)) for c in v] for i, v in vectors.items()})
    for i, x in xs.items():
        want = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        assert out[i].deviation == (want if want < 1 << 63 else None)
    fit = wh.usable(rows_of(spark, vectors), "embedding").select("_x").distinct()
    means = [(2 * t + n) // (2 * n) for t in s]
    y = [[a - m for a, m in zip(x, means, strict=True)] for x in set(xs.values())]
    assert wh.summed(fit, wh.squares(2, means), 3) == [sum(a * a for a, _ in y), sum((a + b) ** 2 for a, b in y), sum(b * b for _, b in y)]


def test_no_python_objects_beyond_the_dimensions(spark):
    """A task gives d * (d + 1) / 2 sums, whatever its rows."""
    df = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(*[F.rand(k) for k in range(6)]).alias("embedding"))
    fit = wh.usable(df, "embedding").select("_x").repartition(3)
    parts = fit.mapInArrow(wh.squares(6, [1_000_030] * 6), "place int, value string")
    assert parts.count() == 3 * 21
