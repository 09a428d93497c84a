"""Review panels: work that must not gather in one task."""

import hashlib

import pytest
from pyspark.sql import functions as F

from provenlake.operators import panel
from provenlake.plans import review, samples


@pytest.mark.parametrize("digits,parents", [(1, 1000), (4, 1000), (0, 1000), (1, 3), (1, 9000)])
def test_audit_sample_is_counted_out(spark, monkeypatch, digits, parents):
    """The lowest draws, however many share their first digits, without a sort of all in one task."""
    monkeypatch.setattr(panel, "DIGITS", digits)
    silver = spark.range(700).select(F.col("id").alias("parent_id"), F.lit("supported").alias("verdict")).repartition(3)
    found = panel.audit_sample(silver, parents, "p")
    lowest = sorted(range(700), key=lambda k: hashlib.sha256(f"p:audit:{k}".encode()).hexdigest())
    assert sorted(r.parent_id for r in found.collect()) == sorted(lowest[: max(2, round(parents * 0.2))])
    assert "Limit" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert panel.audit_sample(silver.limit(0), parents, "p").count() == 0


def test_rows_of_orders_are_dealt_out(spark, monkeypatch):
    """Tables of orders come in as many parts as their rows ask for, whatever their bytes."""
    monkeypatch.setattr(samples, "ROWS_A_TASK", 500)
    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/lineitem.parquet").count()
    (votes,) = review._rows(spark, data, review.VOTES)
    assert votes.rdd.getNumPartitions() == -(-rows // 500) > 4
