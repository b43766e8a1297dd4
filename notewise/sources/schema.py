"""Ledger schema, column-title normalisation and the fixed dimensions.

The ledger is one row per scheduled instalment of a note (loan). Money columns are
``DECIMAL(18,4)``: amounts keep fractions of a cent until they have been summed, and the
sums are exact; dates are ``DATE``.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY_SCALE = 4
MONEY = T.DecimalType(18, MONEY_SCALE)

# --- Fixed values that must equal the reference's -------------------------------------
# Ledger CSV titles in file order, with the reference's column type family.
LEDGER_TITLES = [
    ("Payment Type", "string"),
    ("Loan Id", "id"),
    ("Company", "string"),
    ("Loan Name", "string"),
    ("Interest Rate", "rate"),
    ("Risk Band", "string"),
    ("Interest Scheduled", "money"),
    ("Principal Scheduled", "money"),
    ("Total Scheduled", "money"),
    ("Interest Owed", "money"),
    ("Principal Owed", "money"),
    ("Total Owed", "money"),
    ("Interest Paid", "money"),
    ("Principal Paid", "money"),
    ("Total Paid", "money"),
    ("Fees Paid to Loop", "money"),
    ("Due Date", "date"),
    ("Date Paid", "date"),
    ("Status", "string"),
]
# Titles whose column name is not given by the camel-case rule.
TITLE_OVERRIDES = {
    "Fees Paid to Loop": "fees",
    "Risk Band": "grade",
    "Loan Id": "loanID",
}
# Risk grade -> annual bad-debt rate in percent, in display order.
GRADE_BAD_DEBT_RATES = [
    ("A+", 0.56),
    ("A", 1.83),
    ("B+", 3.05),
    ("B", 4.32),
    ("C+", 5.46),
    ("C", 6.25),
    ("D+", 7.11),
    ("D", 8.00),
    ("E+", 8.84),
    ("E", 9.64),
]
# Waterfall categories in payment order.
WATERFALL_CATEGORIES = ["fees", "principal", "badDebtFunds", "profits"]
# Progress-chart series: (column, display name, legend group), in chart order.
PROGRESS_SERIES = [
    ("feesPaid", "Fees Paid", "Fees"),
    ("nextFeesPayment", "Next Fee Payment", "Fees"),
    ("feesOutstanding", "Fees Outstanding", "Fees"),
    ("principalReceived", "Principal Received", "Principal"),
    ("nextPrincipalPayment", "Next Principal Payment", "Principal"),
    ("principalOutstanding", "Principal Outstanding", "Principal"),
    ("badDebtFundsReceived", "Bad Debt Funds Received", "Bad Debt Funds"),
    ("nextBadDebtFundsPayment", "Next Bad Debt Funds Payment", "Bad Debt Funds"),
    ("badDebtFundsOutstanding", "Bad Debt Funds Outstanding", "Bad Debt Funds"),
    ("profitsReceived", "Profits Received", "Profits"),
    ("nextProfitsPayment", "Next Profit Payment", "Profits"),
    ("profitsOutstanding", "Profits Outstanding", "Profits"),
]
# Funds-allocation bar components, in stacking order.
FUNDS_COMPONENTS = ["Funds Available", "Bad Debt Funds", "Principal Outstanding"]
# --------------------------------------------------------------------------------------

NOTE_KEYS = ["loanID", "company", "loanName", "interestRate", "grade"]

_TYPE_OF = {
    "string": T.StringType(),
    "id": T.LongType(),
    "rate": T.DoubleType(),
    "money": MONEY,
    "date": T.DateType(),
}


def column_name(title: str) -> str:
    """Column name for a CSV title: first character lower-cased, spaces removed."""
    if title in TITLE_OVERRIDES:
        return TITLE_OVERRIDES[title]
    squeezed = title.replace(" ", "")
    return squeezed[:1].lower() + squeezed[1:]


def title_map() -> dict[str, str]:
    """CSV title -> ledger column name for all 19 titles."""
    return {title: column_name(title) for title, _ in LEDGER_TITLES}


def ledger_columns() -> list[str]:
    return [column_name(t) for t, _ in LEDGER_TITLES]


def ledger_schema() -> T.StructType:
    """Schema of the normalised ledger (camel-case column names)."""
    return T.StructType(
        [T.StructField(column_name(t), _TYPE_OF[k], True) for t, k in LEDGER_TITLES]
    )


def received_column(category: str) -> str:
    return "feesPaid" if category == "fees" else f"{category}Received"


def next_column(category: str) -> str:
    return f"next{category[:1].upper()}{category[1:]}Payment"


def outstanding_column(category: str) -> str:
    return f"{category}Outstanding"


def waterfall_columns(categories=WATERFALL_CATEGORIES) -> list[str]:
    out = []
    for c in categories:
        out += [received_column(c), next_column(c), outstanding_column(c)]
    return out
