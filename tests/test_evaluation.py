import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from worklens import schemas
from worklens.functions import retrieval
from worklens.operators import evaluation, listings, recommend, report
from worklens.sources.tables import read_golden_set

T0 = datetime(2026, 1, 1)


@pytest.fixture
def pairs(spark):
    def make(*rows):
        return spark.createDataFrame([("q", *r) for r in rows], schemas.GOLDEN_SET)
    return make


def test_reciprocal_rank_cases(pairs):
    df = pairs((["a", "b", "c"], ["a"]), (["a", "b", "c"], ["b", "z"]), (["a"], ["z"]), ([], ["z"]), (None, ["z"]),
               (["x", None], [None]))
    rr = retrieval.reciprocal_rank(F.col("retrieved"), F.col("relevant"))
    assert [r[0] for r in df.select(rr).collect()] == [1.0, 0.5, 0.0, 0.0, 0.0, 0.5]


def test_precision_and_recall_denominators(pairs):
    df = pairs((["a", "a", "b"], ["a", "c", "c", "d"]), ([], ["a"]), (["a"], []))
    rows = evaluation.scored(df, k=2).collect()
    assert [r["precision_at_k"] for r in rows] == [0.5, 0.0, 0.0]
    assert [r["recall_at_k"] for r in rows] == [0.25, 0.0, None]


def test_golden_set_file_and_metrics(spark, tmp_path):
    path = tmp_path / "golden.json"
    path.write_text(json.dumps([
        {"query": "1", "retrieved": ["d1", "d2", "d3"], "relevant": ["d1"]},
        {"query": "2", "retrieved": ["d2", "d3", "d4"], "relevant": ["d2", "d3"]},
        {"query": "3", "retrieved": ["d5", "d6", "d7"], "relevant": ["d5"]},
    ], indent=1))
    (m,) = evaluation.rag_metrics(read_golden_set(spark, str(path))).collect()
    assert (m["mrr"], m["recall_at_10"], m["test_count"]) == (1.0, 1.0, 3)
    assert m["precision_at_10"] == pytest.approx(4 / 9)
    missing = read_golden_set(spark, str(tmp_path / "none.json"))
    (r,) = evaluation.rag_result(missing, F.lit(T0)).collect()
    assert r["rag_mrr"] == 0.0 and r["test_count"] is None and "No dataset available" in r["metrics"]


def test_slo_check_is_strict_and_passes_without_data(spark):
    empty = spark.createDataFrame([], schemas.WORKLOAD_SNAPSHOT)
    (r,) = evaluation.slo_result(empty, F.lit(T0)).collect()
    assert r["slo_passed"] is True and r["slo_violations"] == "{}" and r["p95_latency_ms"] == 0.0
    metrics = spark.createDataFrame([(500.0, 1000.5, 0.001, 1, 0)],
                                    "avg_p95_latency double, avg_p99_latency double, avg_error_rate double, total_queries long, total_errors long")
    (c,) = evaluation.slo_check(metrics).collect()
    assert c["slo_passed"] is False and list(c["violations"]) == ["p99_latency"]
    assert c["violations"]["p99_latency"]["threshold"] == 1000.0


def test_result_rows_fit_the_table(spark):
    empty = spark.createDataFrame([], schemas.WORKLOAD_SNAPSHOT)
    golden = spark.createDataFrame([("q", ["a"], ["a"])], schemas.GOLDEN_SET)
    rows = schemas.conform(evaluation.evaluate_all(golden, empty, F.lit(T0)), schemas.EVAL_RESULT).collect()
    assert {r["eval_type"] for r in rows} == {"rag_accuracy", "slo_check"}
    assert all(r["environment"] == "production" for r in rows)


def test_reports_without_data(spark):
    empty = spark.createDataFrame([], schemas.WORKLOAD_SNAPSHOT)
    (r,) = report.analysis_report(empty, spark.createDataFrame([], schemas.EVAL_RESULT), F.lit(T0), ["indexes"]).collect()
    assert "Date: 2026-01-01T00:00:00" in r["report"] and report.NO_WORKLOAD in r["report"]
    assert report.NO_RESULTS in r["report"] and r["report"].endswith("## Focus Areas\n\n- indexes\n\n")


def test_response_parsing(spark):
    texts = ['Sure: {"title": "T", "risk_level": "low", "expected_effects": {"latency_improvement_percent": 25}} done',
             "no json here", '{"title": 1}', "{broken}", '{"expected_effects": null}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    rows = recommend.parse_responses(df, F.lit(T0), "m", "v").orderBy("i").collect()
    assert [r["reject_reason"] for r in rows] == [None, "no JSON object", "bad title", "not JSON", "bad expected_effects"]
    ok = rows[0]
    assert (ok["title"], ok["risk_level"], ok["priority"], ok["recommendation_type"]) == ("T", "low", "medium", "config_tuning")
    assert ok["expected_latency_improvement_percent"] == 25.0 and ok["recommendation_id"].startswith("rec-")


def test_unique_key_ignores_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), (None, 1), (None, 1)], "k string, n int")
    assert [(r["k"], r["copies"]) for r in listings.unique_key_violations(df, ["k", "n"]).collect()] == [("a", 2)]


def test_long_scores_join_no_sides_and_nulls_match_nothing(spark):
    """Both sides used to be held and sorted in one task to be joined."""
    got = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, None, 3), (None, 5, 1), (2, 4, None), (2, 4, 9), (3, 1, 1), (3, 1, 2)], "q long, item long, rank int")
    want = spark.createDataFrame([(1, 8), (1, 8), (1, None), (None, 5), (2, 4), (4, 1), (3, 1)], "q long, item long")
    out = evaluation.scored_long(got, want, "q", k=3)
    rows = {r["q"]: tuple(r)[1:] for r in out.collect()}
    assert rows == {
        1: (0.5, 1 / 3, 1 / 3), None: (0.0, 0.0, 0.0), 2: (1 / 9, 0.0, 0.0), 3: (1.0, 0.5, 1.0), 4: (0.0, 0.0, 0.0),
    }
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
