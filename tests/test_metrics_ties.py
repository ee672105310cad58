"""Ranks of models hold when averages differ in their last bit only."""

from quillpanel.operators import metrics


def test_tied_models_share_a_rank(spark):
    rows = [("a", 0.1 + 0.2, 0.5), ("b", 0.3, 0.7), ("c", 0.1, 0.6)]
    found = {r["model"]: r["average_rank"] for r in metrics.model_ranking(spark.createDataFrame(rows, "model string, x double, y double"), {"x": True, "y": True}).collect()}
    assert found == {"a": (1.5 + 3) / 2, "b": (1.5 + 1) / 2, "c": (3 + 2) / 2}
