import random

from pyspark.sql import functions as F

from terrainframe.functions.quantiles import exact_quantiles


def test_same_as_sorting(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), None if rng.random() < 0.1 else rng.choice([rng.random(), round(rng.random(), 1), -1.0])) for _ in range(30_000)] + [("only", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    names = {"p0": 0.0, "p33": 1 / 3, "p50": 0.5, "p95": 0.95, "p100": 1.0}

    def want(values, q):
        x = sorted(v for v in values if v is not None)
        at = (len(x) - 1) * q
        return x[int(at)] + (at - int(at)) * (x[min(len(x) - 1, int(at) + 1)] - x[int(at)])

    got = {r.k: r for r in exact_quantiles(df, "v", names, ["k"]).collect()}
    for k in ("a", "b", None, "only"):
        assert all(abs(got[k][n] - want([v for g, v in rows if g == k], q)) < 1e-12 for n, q in names.items())
    whole = exact_quantiles(df, "v", names).first()
    assert all(abs(whole[n] - want([v for _, v in rows], q)) < 1e-12 for n, q in names.items())
    spark_own = df.agg(F.percentile("v", 0.95)).first()[0]
    assert whole.p95 == spark_own
