"""Cached name-based expressions give the same results on different DataFrames."""

from pyspark.sql import functions as F

from notewise.functions.exprcache import cached
from notewise.operators.waterfall import waterfall

SCHEMA = "fees DOUBLE, principal DOUBLE, badDebtFunds DOUBLE, profits DOUBLE, " \
         "unitPayment DOUBLE, amountRepayed DOUBLE"


def test_same_object_reused_and_results_equal(spark):
    a = cached(("t", 1), lambda: F.col("x") + 1)
    assert cached(("t", 1), lambda: F.col("x") + 2) is a
    d1 = spark.createDataFrame([(1,)], "x INT").select(a.alias("y"))
    d2 = spark.createDataFrame([(5,)], "x INT").select(a.alias("y"))
    assert (d1.first()["y"], d2.first()["y"]) == (2, 6)


def test_waterfall_on_two_frames(spark):
    one = spark.createDataFrame([(3.0, 75.0, 5.0, 18.14, 10.0, 6.0)], SCHEMA)
    two = spark.createDataFrame([(3.0, 75.0, 5.0, 18.14, 10.0, 80.0)], SCHEMA)
    r1, r2 = waterfall(one).first(), waterfall(two).first()
    assert (r1["principalReceived"], r1["nextPrincipalPayment"]) == (3.0, 10.0)
    assert (r2["badDebtFundsReceived"], r2["nextProfitsPayment"]) == (2.0, 7.0)
