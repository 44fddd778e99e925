"""How the work is dealt over tasks."""

import math

from pyspark.sql import functions as F

from cliploom.operators import selection
from cliploom.plans import adapters


def test_lines_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    before = sorted(map(str, adapters.segments(spark, sf_dir).collect()))
    monkeypatch.setattr(adapters, "TASK_LINES", 100)
    rows = adapters.segments(spark, sf_dir)
    n = math.ceil(adapters.table(spark, sf_dir, "lineitem").count() / 100)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert f", {n}), REPARTITION_BY_NUM" in plan
    # Lines aren't grouped by order and supplier before they are dealt.
    assert "hashpartitioning(l_orderkey" in plan and not any("hashpartitioning" in x and "l_suppkey" in x for x in plan.splitlines())
    assert sorted(map(str, rows.collect())) == before


def test_drained_gathers_no_assets(spark):
    rows = spark.range(300).select(F.floor(F.col("id") / 3).alias("asset_id"), "id", (F.lit(3) - F.col("id") % 3).cast("int").alias("target_rank"))
    found = selection.drained(rows, 50.0, 1000)
    assert "windowspecdefinition(asset_id" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.asset_id, r.target_rank, r.status) for r in found.orderBy("run_rank").collect()]
    assert got == [(a, k, "pending" if 3 * a + k <= 150 else "over_budget") for a in range(100) for k in (1, 2, 3)]
    assert selection.drained(rows.where("false")).count() == 0
