import random

from worklens.operators.ranks import nearest_ranks

Q = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99}


def test_ranks_equal_sorted_lists(spark):
    rng = random.Random(1)
    groups = {
        "hot": [round(rng.lognormvariate(3, 2), 3) for _ in range(20_000)],
        "same": [5.0] * 3000,
        "signed": [rng.uniform(-1e-3, 1e-3) for _ in range(500)] + [0.0, -5.0, 1e9],
        "one": [7.25],
        "close": [1.0 + i * 2.0**-50 for i in range(300)],
        "few": [3.0, 1.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    got = {r["g"]: r for r in nearest_ranks(df, ["g"], "v", Q, min_rows=1).collect()}
    for g, values in groups.items():
        ordered = sorted(values)
        assert [got[g][n] for n in Q] == [ordered[int(len(ordered) * q)] for q in Q.values()], g
    kept = {r["g"] for r in nearest_ranks(df, ["g"], "v", Q, min_rows=3).collect()}
    assert kept == set(groups) - {"one", "few"}


def test_cells_are_read_once(spark):
    df = spark.range(1000).selectExpr("id % 7 AS g", "CAST(id AS double) AS v")
    out = nearest_ranks(df, ["g"], "v", Q)
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
