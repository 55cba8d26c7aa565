"""Physical-plan shape: what must not appear at scale."""

from riskspark.functions import scorecard as SC
from riskspark.operators import decide as D
from riskspark.operators import evaluate as EV
from riskspark.plans import catalog as C


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_plan_is_narrow(spark, sf_small):
    base = spark.read.parquet(f"{sf_small}/orders.parquet").selectExpr(
        "o_orderkey AS application_id", "o_totalprice AS revenue", "o_totalprice / 3 AS loan_amnt",
        "700 AS fico_n", "0.2 AS dti_n", "5 AS emp_length_numeric")
    plan = _plan(D.decisions(base, C.scaler(spark, sf_small), SC.COEFFICIENTS, SC.INTERCEPT))
    assert "Exchange" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
    assert "WholeStageCodegen" in plan or "*(" in plan


def test_auc_plan_has_no_global_window(spark, sf_small):
    scored = C.scored(spark, sf_small)
    plan = _plan(EV.cumulative_table(scored))
    # every Window is partitioned (by group, or group + bucket): no SinglePartition exchange
    assert "SinglePartition" not in plan


def test_loans_scan_prunes_columns(spark, sf_small):
    plan = C.loans(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan  # only l_orderkey, l_quantity are read from lineitem
    assert "BroadcastHashJoin" in plan  # nation (25 rows by definition) is broadcast
