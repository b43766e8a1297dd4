"""notewise: loan-portfolio analytics as lazy Spark DataFrame operators.

Pipeline: ledger (one row per scheduled instalment) -> notes (one row per loan) ->
payment waterfall -> portfolio KPIs and chart-ready datasets, plus data-quality reports.
Every operator is DataFrame -> DataFrame, built from native Spark expressions.
"""

from notewise.sources.dims import grade_dim
from notewise.sources.ledger import normalise_titles, read_ledger, to_titles, write_ledger
from notewise.sources.derived import derive_ledger
from notewise.operators.notes import (
    apply_transactions,
    loan_transactions,
    note_summary,
    paid_instalments,
    rebuild_notes,
)
from notewise.operators.waterfall import analyze_notes, note_progress, waterfall
from notewise.operators.metrics import portfolio_kpis, weighted_avg

__all__ = [
    "grade_dim",
    "read_ledger",
    "write_ledger",
    "normalise_titles",
    "to_titles",
    "derive_ledger",
    "paid_instalments",
    "note_summary",
    "loan_transactions",
    "apply_transactions",
    "rebuild_notes",
    "waterfall",
    "note_progress",
    "analyze_notes",
    "portfolio_kpis",
    "weighted_avg",
]
