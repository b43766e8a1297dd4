"""A loan ledger derived from the TPC-H-style test tables.

The test tables hold no ledger, so one is derived: every order is a note, every line an
instalment. Amounts are integer cents (exact in every engine), published as DECIMAL(18,4).

Per line, with ``n`` = lines of the order and ``rate`` in basis points:
``tot = round(l_extendedprice*100)``, ``interest = floor(tot*rate*(n+1)/240000)``,
``fees = floor(tot*150*(n+1)/240000)``; paid when ``l_linestatus = 'F'``.

Plan shape: lines per order come from a partial aggregate (no window over a possibly hot
order) and are joined to orders on the order key and then to customers on the customer
key, so the order-level side reaches the join with the lines through its own shuffle on
the order key. Both inputs of that join are then plain shuffles, which is what AQE's
skew-join rule needs to split an order holding a large share of all lines (the other side
has one row per order). Orders and customers grow with the data, so they are never
broadcast: with estimate-based broadcast off (``session.RECOMMENDED``) the joins are
sort-merge joins at every scale, lineitem is shuffled once, and the note aggregate
downstream reuses that partitioning on the order key. The grade dimension is a fixed
10-row table and is broadcast by an explicit hint.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.sources.dims import grade_dim
from notewise.sources.schema import MONEY, ledger_columns

# Fixed parameters of the derivation (integers: basis points and divisors).
BASE_RATE_BP = 600
RATE_STEP_BP = 100
RATE_CYCLE = 7
FEE_BP = 150
FAULTY_FEE_BP = 1500
INTEREST_DIVISOR = 240000.0
CENT = Decimal("0.01")

# Fault injection for the data-quality fixture: rule -> order-key divisor.
FAULTS = {
    "unknown_grade": 97,
    "negative_profits": 89,
    "zero_unit_payment": 83,
    "zero_rate": 79,
    "duplicate_loan": 73,
}


def _read(spark: SparkSession, sf_dir: str, name: str, cols: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def _money(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") * F.lit(CENT)).cast(MONEY)


def _hit(key: Column, rule: str) -> Column:
    return (key % F.lit(FAULTS[rule])) == 0


def derive_ledger(spark: SparkSession, sf_dir: str, faulty: bool = False) -> DataFrame:
    """19-column normalised ledger from lineitem, orders and customer at ``sf_dir``.

    ``faulty=True`` injects one data-quality fault per rule (unknown grade, negative
    profits, zero unit payment, zero rate, one loanID under two companies).
    """
    lines = _read(spark, sf_dir, "lineitem",
                  ["l_orderkey", "l_extendedprice", "l_shipdate", "l_linestatus"])
    orders = _read(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    customers = _read(spark, sf_dir, "customer", ["c_custkey", "c_name"])

    lines_per_order = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    loans = (
        orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        .join(lines_per_order, "l_orderkey")
        .join(customers, F.col("o_custkey") == customers["c_custkey"])
        .select("l_orderkey", "c_name", "n")
    )
    grades = F.broadcast(grade_dim(spark))
    key = F.col("l_orderkey")
    joined = (
        lines.join(loans, "l_orderkey")
        .join(grades, (key % 10).cast("int") == grades["gradeOrder"])
    )

    rate_bp = F.round(F.col("badDebtRate") * 100).cast("bigint") + BASE_RATE_BP + RATE_STEP_BP * (key % RATE_CYCLE)
    tot = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    fee_bp = F.lit(FEE_BP)
    grade = F.col("grade")
    company = F.col("c_name")
    if faulty:
        grade = F.when(_hit(key, "unknown_grade"), F.lit("Z")).otherwise(grade)
        fee_bp = F.when(_hit(key, "negative_profits"), F.lit(FAULTY_FEE_BP)).otherwise(fee_bp)
        tot = F.when(_hit(key, "zero_unit_payment"), F.lit(0).cast("bigint")).otherwise(tot)
        rate_bp = F.when(_hit(key, "zero_rate"), F.lit(0).cast("bigint")).otherwise(rate_bp)
        company = F.when(
            _hit(key, "duplicate_loan") & (F.col("l_linestatus") == "O"),
            F.concat(company, F.lit(" (2)")),
        ).otherwise(company)

    staged = joined.select(
        key.alias("loanID"),
        company.alias("company"),
        grade.alias("grade"),
        rate_bp.alias("rate_bp"),
        tot.alias("tot"),
        fee_bp.alias("fee_bp"),
        F.col("n"),
        F.col("l_shipdate").cast("date").alias("dueDate"),
        (F.col("l_linestatus") == "F").alias("paid"),
    )
    growth = F.col("n") + 1
    interest = F.floor(F.col("tot") * F.col("rate_bp") * growth / F.lit(INTEREST_DIVISOR))
    fees = F.floor(F.col("tot") * F.col("fee_bp") * growth / F.lit(INTEREST_DIVISOR))
    cents = staged.select(
        "loanID", "company", "grade", "dueDate", "paid",
        (F.col("rate_bp") / F.lit(100.0)).alias("interestRate"),
        F.col("tot"),
        interest.alias("interest"),
        fees.alias("fee"),
    )
    paid = F.col("paid")
    zero = F.lit(0).cast("bigint")
    interest_paid = F.when(paid, F.col("interest")).otherwise(zero)
    principal = F.col("tot") - F.col("interest")
    principal_paid = F.when(paid, principal).otherwise(zero)
    total_paid = F.when(paid, F.col("tot")).otherwise(zero)
    out = cents.select(
        F.lit("Scheduled").alias("paymentType"),
        F.col("loanID"),
        F.col("company"),
        F.concat(F.lit("Loan "), F.col("loanID").cast("string")).alias("loanName"),
        F.col("interestRate"),
        F.col("grade"),
        _money(F.col("interest")).alias("interestScheduled"),
        _money(principal).alias("principalScheduled"),
        _money(F.col("tot")).alias("totalScheduled"),
        _money(F.col("interest") - interest_paid).alias("interestOwed"),
        _money(principal - principal_paid).alias("principalOwed"),
        _money(F.col("tot") - total_paid).alias("totalOwed"),
        _money(interest_paid).alias("interestPaid"),
        _money(principal_paid).alias("principalPaid"),
        _money(total_paid).alias("totalPaid"),
        _money(F.col("fee")).alias("fees"),
        F.col("dueDate"),
        F.when(paid, F.col("dueDate")).alias("datePaid"),
        F.when(paid, F.lit("Paid")).otherwise(F.lit("Scheduled")).alias("status"),
    )
    assert out.columns == ledger_columns()
    return out


def edge_ledger(ledger: DataFrame) -> DataFrame:
    """The derived ledger with amounts that only careful sums survive: missing scheduled
    totals, fees below a cent, and negative fees ending on half a cent."""
    key, fees, money = F.col("loanID"), F.col("fees"), lambda x: F.lit(Decimal(x)).cast(MONEY)
    return ledger.withColumns({
        "totalScheduled": F.when((key % 71 == 0) & (F.col("status") == "Scheduled"), F.lit(None).cast(MONEY))
        .otherwise(F.col("totalScheduled")),
        "fees": F.when(key % 67 == 0, money("0.004"))
        .when(key % 61 == 0, (-fees - money("0.005")).cast(MONEY)).otherwise(fees),
    })


# Columns set to null in the ledger with missing values: column -> order-key divisor.
NULLS = {"fees": 59, "interestScheduled": 53, "totalScheduled": 47, "dueDate": 43, "grade": 41, "loanID": 37}


def null_ledger(ledger: DataFrame) -> DataFrame:
    """The derived ledger with nulls: one column for every divisor of ``NULLS`` (all lines of
    the order), and no paid amount on paid lines of every 31st order."""
    key = F.col("loanID")
    blank = {c: F.when(key % n == 0, F.lit(None)).otherwise(F.col(c)).alias(c) for c, n in NULLS.items()}
    blank["totalPaid"] = F.when((key % 31 == 0) & F.col("datePaid").isNotNull(), F.lit(None)).otherwise(
        F.col("totalPaid")).alias("totalPaid")
    return ledger.select([blank.get(c, F.col(c)) for c in ledger.columns])
