"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Plain SQL over the pre-registered test tables. Grades, rates, titles, categories and series
are written out here as literals, and the formulas are stated anew, so that a wrong value or
formula in the operators cannot repeat itself in the check. Only the parameters of the
registered queries and of the derived ledger are shared.
"""

from __future__ import annotations

from notewise.plans import portfolio as P
from notewise.sources.derived import (
    BASE_RATE_BP, FAULTS, FAULTY_FEE_BP, FEE_BP, INTEREST_DIVISOR, RATE_CYCLE, RATE_STEP_BP,
)

# --- Fixed values that must equal the reference's -------------------------------------
GRADES = [("A+", 0.56), ("A", 1.83), ("B+", 3.05), ("B", 4.32), ("C+", 5.46), ("C", 6.25),
          ("D+", 7.11), ("D", 8.00), ("E+", 8.84), ("E", 9.64)]
# Category -> received, next and outstanding column, in payment order.
CATEGORIES = {
    "fees": ("feesPaid", "nextFeesPayment", "feesOutstanding"),
    "principal": ("principalReceived", "nextPrincipalPayment", "principalOutstanding"),
    "badDebtFunds": ("badDebtFundsReceived", "nextBadDebtFundsPayment", "badDebtFundsOutstanding"),
    "profits": ("profitsReceived", "nextProfitsPayment", "profitsOutstanding"),
}
SERIES = [
    ("feesPaid", "Fees Paid", "Fees"), ("nextFeesPayment", "Next Fee Payment", "Fees"),
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
FUNDS = ["Funds Available", "Bad Debt Funds", "Principal Outstanding"]
TITLES = {
    "Payment Type": "paymentType", "Loan Id": "loanID", "Company": "company", "Loan Name": "loanName",
    "Interest Rate": "interestRate", "Risk Band": "grade", "Interest Scheduled": "interestScheduled",
    "Principal Scheduled": "principalScheduled", "Total Scheduled": "totalScheduled", "Interest Owed": "interestOwed",
    "Principal Owed": "principalOwed", "Total Owed": "totalOwed", "Interest Paid": "interestPaid",
    "Principal Paid": "principalPaid", "Total Paid": "totalPaid", "Fees Paid to Loop": "fees", "Due Date": "dueDate",
    "Date Paid": "datePaid", "Status": "status",
}
# --------------------------------------------------------------------------------------

LEDGER_COLS = ", ".join(TITLES.values())
WATERFALL_COLS = ", ".join(c for columns in CATEGORIES.values() for c in columns)
NOTE_COLS = ("loanID, company, loanName, interestRate, grade, cyclesTotal, principal, fees, "
             "profits, unitPayment, startDate, cyclesRemaining, badDebtFunds, amountRepayed")
KEYS = "loanID, company, loanName, interestRate, grade"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def units(x: str) -> str:
    return f"CAST(round(({x}) * 100) AS BIGINT)"


def from_units(x: str) -> str:
    return f"(CAST(({x}) AS DOUBLE) / 100.0)"


def min2(a: str, b: str) -> str:
    return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END)"


def max2(a: str, b: str) -> str:
    return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END)"


def clamp(x: str, lo: str, hi: str) -> str:
    return (f"(CASE WHEN {x} IS NOT NULL AND {lo} IS NOT NULL AND {hi} IS NOT NULL "
            f"THEN greatest({lo}, least({x}, {hi})) END)")


def grades_cte() -> str:
    rows = ", ".join(f"({i}, {_q(g)}, {r!r})" for i, (g, r) in enumerate(GRADES))
    return ("grades AS (SELECT CAST(o AS INTEGER) AS gradeOrder, g AS grade, "
            f"CAST(r AS DOUBLE) AS badDebtRate FROM (VALUES {rows}) t(o, g, r))")


EDGE = """
    CASE WHEN loanID % 71 = 0 AND status = 'Scheduled' THEN NULL ELSE totalScheduled END AS totalScheduled,
    CAST(CASE WHEN loanID % 67 = 0 THEN 0.004 WHEN loanID % 61 = 0 THEN -fees - 0.005 ELSE fees END
         AS DECIMAL(18,4)) AS fees"""
NULLED = """
    CASE WHEN loanID % 59 <> 0 THEN fees END AS fees,
    CASE WHEN loanID % 53 <> 0 THEN interestScheduled END AS interestScheduled,
    CASE WHEN loanID % 47 <> 0 THEN totalScheduled END AS totalScheduled,
    CASE WHEN loanID % 43 <> 0 THEN dueDate END AS dueDate,
    CASE WHEN loanID % 41 <> 0 THEN grade END AS grade,
    CASE WHEN loanID % 37 <> 0 THEN loanID END AS loanID,
    CASE WHEN loanID % 31 = 0 AND datePaid IS NOT NULL THEN NULL ELSE totalPaid END AS totalPaid"""


def ledger_ctes(faulty: bool = False, replace: str = "") -> str:
    """CTEs lpo, base, staged, cents, derived and ledger (the 19-column derived ledger, with
    the columns of ``replace`` changed)."""
    k = "k"
    grade, company = "grade", "c_name"
    rate_bp = (f"CAST(round(badDebtRate * 100) AS BIGINT) + {BASE_RATE_BP} "
               f"+ {RATE_STEP_BP} * ({k} % {RATE_CYCLE})")
    tot = "CAST(round(l_extendedprice * 100) AS BIGINT)"
    fee_bp = str(FEE_BP)
    if faulty:
        hit = lambda rule: f"({k} % {FAULTS[rule]} = 0)"
        grade = f"CASE WHEN {hit('unknown_grade')} THEN 'Z' ELSE grade END"
        fee_bp = f"CASE WHEN {hit('negative_profits')} THEN {FAULTY_FEE_BP} ELSE {FEE_BP} END"
        tot = f"CASE WHEN {hit('zero_unit_payment')} THEN CAST(0 AS BIGINT) ELSE {tot} END"
        rate_bp = f"CASE WHEN {hit('zero_rate')} THEN CAST(0 AS BIGINT) ELSE {rate_bp} END"
        company = (f"CASE WHEN {hit('duplicate_loan')} AND l_linestatus = 'O' "
                   f"THEN c_name || ' (2)' ELSE c_name END")
    money = lambda x: f"CAST(CAST(({x}) AS DOUBLE) / 100.0 AS DECIMAL(18,4))"
    div = f"CAST({INTEREST_DIVISOR} AS DOUBLE)"
    return f"""
lpo AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT l.l_orderkey AS k, c.c_name, g.grade, g.badDebtRate, l.l_extendedprice,
         l.l_linestatus, lpo.n, CAST(l.l_shipdate AS DATE) AS dueDate
  FROM lineitem l
  JOIN lpo ON lpo.l_orderkey = l.l_orderkey
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN grades g ON g.gradeOrder = CAST(l.l_orderkey % 10 AS INTEGER)
),
staged AS (
  SELECT k AS loanID, {company} AS company, {grade} AS grade, {rate_bp} AS rate_bp,
         {tot} AS tot, {fee_bp} AS fee_bp, n, dueDate, l_linestatus = 'F' AS paid
  FROM base
),
cents AS (
  SELECT loanID, company, grade, dueDate, paid,
         CAST(rate_bp AS DOUBLE) / 100.0 AS interestRate, tot,
         CAST(floor(CAST(tot * rate_bp * (n + 1) AS DOUBLE) / {div}) AS BIGINT) AS interest,
         CAST(floor(CAST(tot * fee_bp * (n + 1) AS DOUBLE) / {div}) AS BIGINT) AS fee
  FROM staged
),
cents2 AS (
  SELECT *, CASE WHEN paid THEN interest ELSE 0 END AS ip,
         CASE WHEN paid THEN tot - interest ELSE 0 END AS pp,
         CASE WHEN paid THEN tot ELSE 0 END AS tp
  FROM cents
),
derived AS (
  SELECT 'Scheduled' AS paymentType, loanID, company,
         'Loan ' || CAST(loanID AS VARCHAR) AS loanName, interestRate, grade,
         {money('interest')} AS interestScheduled,
         {money('tot - interest')} AS principalScheduled,
         {money('tot')} AS totalScheduled,
         {money('interest - ip')} AS interestOwed,
         {money('tot - interest - pp')} AS principalOwed,
         {money('tot - tp')} AS totalOwed,
         {money('ip')} AS interestPaid,
         {money('pp')} AS principalPaid,
         {money('tp')} AS totalPaid,
         {money('fee')} AS fees,
         dueDate,
         CASE WHEN paid THEN dueDate END AS datePaid,
         CASE WHEN paid THEN 'Paid' ELSE 'Scheduled' END AS status
  FROM cents2
),
ledger AS (SELECT *{f" REPLACE ({replace})" if replace else ""} FROM derived)"""


def notes_ctes(as_of: dict[str, str] | None = None) -> str:
    """CTEs nagg, nfin, nfin2, notes0 (note summary), notes (payments applied)."""
    extra = ""
    for name, cond in (as_of or {}).items():
        extra += (f",\n    CAST(round(coalesce(sum(totalPaid) FILTER (WHERE datePaid IS NOT NULL AND {cond}), 0), 2)"
                  f" AS DOUBLE) AS {name}_repaid")
    i = "(interestRate / 1200.0)"
    r = "(badDebtRate / 1200.0)"
    return f"""
nagg AS (
  SELECT {KEYS},
    count(*) AS cyclesTotal,
    CAST(round(sum(fees), 2) AS DOUBLE) AS fees,
    CAST(round(sum(interestScheduled) - sum(fees), 2) AS DOUBLE) AS grossProfits,
    round(CAST(sum(totalScheduled) * 100 AS DOUBLE) / nullif(count(totalScheduled), 0), 0) / 100.0 AS unitPayment,
    min(dueDate) AS firstDueDate,
    CAST(round(coalesce(sum(totalPaid) FILTER (WHERE datePaid IS NOT NULL), 0), 2) AS DOUBLE) AS paidAmount,
    count(*) FILTER (WHERE datePaid IS NOT NULL) AS paidCount{extra}
  FROM ledger GROUP BY {KEYS}
),
nfin AS (
  SELECT a.*, g.badDebtRate,
    round(CASE WHEN {i} = 0 THEN unitPayment * cyclesTotal
          ELSE unitPayment / {i} * (1.0 - 1.0 / power(1.0 + {i}, cyclesTotal)) END, 0) AS principal
  FROM nagg a LEFT JOIN grades g ON a.grade = g.grade
),
nfin2 AS (
  SELECT *,
    round(CASE WHEN {r} = 0 THEN 0.0
          ELSE principal * ((cyclesTotal * {r}) / (1.0 - power(1.0 + {r}, -cyclesTotal)) - 1.0) END, 2)
      AS badDebtFunds
  FROM nfin
),
notes0 AS (
  SELECT {KEYS}, cyclesTotal, principal, fees, round(grossProfits - badDebtFunds, 2) AS profits,
    unitPayment, CAST(firstDueDate - INTERVAL 1 MONTH AS DATE) AS startDate,
    cyclesTotal AS cyclesRemaining, badDebtFunds, 0.0::DOUBLE AS amountRepayed
  FROM nfin2
),
notes AS (
  SELECT {KEYS}, cyclesTotal, principal, fees, round(grossProfits - badDebtFunds, 2) AS profits,
    unitPayment, CAST(firstDueDate - INTERVAL 1 MONTH AS DATE) AS startDate,
    cyclesTotal - paidCount AS cyclesRemaining, badDebtFunds, paidAmount AS amountRepayed
    {''.join(f', {n}_repaid' for n in (as_of or {}))}
  FROM nfin2
)"""


def waterfall_ctes(src: str, name: str, paid: str = "amountRepayed", suffix: str = "",
                   cap: bool = False) -> str:
    cats = list(CATEGORIES)
    stage = [f"{units(paid)} AS _a{suffix}", f"{units('unitPayment')} AS _u{suffix}"]
    for n, c in enumerate(cats):
        stage.append(f"{units(c)} AS _c{n}{suffix}")
    prefixes = ["CAST(0 AS BIGINT) AS _p0" + suffix]
    for n in range(1, len(cats)):
        prefixes.append(" + ".join(f"_c{j}{suffix}" for j in range(n)) + f" AS _p{n}{suffix}")
    a, u = f"_a{suffix}", f"_u{suffix}"
    outs = []
    for n, c in enumerate(cats):
        cc, p = f"_c{n}{suffix}", f"_p{n}{suffix}"
        rel = f"({a} - {p})"
        rec = clamp(rel, "0", cc)
        if cap:
            nxt = max2("0", f"({min2(f'({a} + {u})', f'({p} + {cc})')} - {max2(a, p)})")
        else:
            nxt = (f"(CASE WHEN {rel} < 0 THEN {clamp(f'({u} + {rel})', '0', u)} "
                   f"ELSE {min2(clamp(f'({cc} - {rel})', '0', cc), u)} END)")
        out = clamp(f"({cc} - ({rel} + {u}))", "0", cc)
        outs += [f"{from_units(rec)} AS {CATEGORIES[c][0]}{suffix}",
                 f"{from_units(nxt)} AS {CATEGORIES[c][1]}{suffix}",
                 f"{from_units(out)} AS {CATEGORIES[c][2]}{suffix}"]
    drop = [f"_a{suffix}", f"_u{suffix}"] + [f"_c{n}{suffix}" for n in range(len(cats))] + \
           [f"_p{n}{suffix}" for n in range(len(cats))]
    return f"""
{name}_s1 AS (SELECT *, {', '.join(stage)} FROM {src}),
{name}_s2 AS (SELECT *, {', '.join(prefixes)} FROM {name}_s1),
{name} AS (SELECT * EXCLUDE ({', '.join(drop)}), {', '.join(outs)} FROM {name}_s2)"""


def analyzed_ctes(cap: bool = False) -> str:
    owed = f"({units('nextPrincipalPayment')} + {units('principalOutstanding')})"
    b = units("unitPayment")
    ceil = (f"(CASE WHEN {b} <> 0 THEN CAST(({owed} - {owed} % {b}) / {b} AS BIGINT) + "
            f"(CASE WHEN {owed} % {b} <> 0 AND (({owed} > 0) = ({b} > 0)) THEN 1 ELSE 0 END) END)")
    return waterfall_ctes("notes", "wf", cap=cap) + f""",
analyzed AS (
  SELECT *, CAST({ceil} AS INTEGER) AS monthsToBreakeven, cyclesRemaining = 0 AS completed
  FROM wf
)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts)


def base(faulty: bool = False, as_of=None, replace: str = "") -> str:
    return with_(grades_cte(), ledger_ctes(faulty, replace), notes_ctes(as_of))


def full(faulty: bool = False) -> str:
    return with_(grades_cte(), ledger_ctes(faulty), notes_ctes(), analyzed_ctes())


ANALYZED_COLS = NOTE_COLS + ", " + WATERFALL_COLS + ", monthsToBreakeven, completed"


def growth(e: str, rem: str | None) -> str:
    elapsed = "cyclesTotal" if rem is None else f"(cyclesTotal - {rem})"
    return (f"(CASE WHEN {elapsed} = 0 THEN 1.0 ELSE "
            f"power(({e}) / nullif(principal, 0) + 1.0, 12.0 / {elapsed}) END)")


CUR = growth("badDebtFundsReceived + profitsReceived", "cyclesRemaining")
PROJ = growth("profitsReceived + nextProfitsPayment + profitsOutstanding", None)


def money_sum(x: str) -> str:
    return from_units(f"coalesce(sum({units(x)}), 0)")


def roi(growth_sql: str) -> str:
    """Mean growth of the notes that have one, each counted by its share of their principal."""
    have = f"FILTER (WHERE {growth_sql} IS NOT NULL AND principal IS NOT NULL)"
    return f"round((sum({growth_sql} * principal) {have} / nullif(sum(principal) {have}, 0) - 1.0) * 100, 4)"


LACKING = f"(badDebtFundsReceived IS NULL OR profitsReceived IS NULL OR principal IS NULL OR {CUR} IS NULL OR {PROJ} IS NULL)"


def kpi_exprs(funds: float | None) -> dict[str, str]:
    out = {
        "notes": "count(*)",
        "notesExcluded": f"count(*) FILTER (WHERE {LACKING})",
        "principalExcluded": money_sum(f"CASE WHEN {LACKING} THEN principal END"),
        "totalEarnings": from_units(
            f"coalesce(sum({units('badDebtFundsReceived')} + {units('profitsReceived')}), 0)"),
        "currentRoi": roi(CUR),
        "netRoi": roi(PROJ),
        "diversification": "round(max(principal) / nullif(sum(principal), 0) * 100, 4)",
    }
    if funds is not None:
        f = f"CAST({funds!r} AS DOUBLE)"
        out["fundsRemaining"] = f"round({f} - {money_sum('principalOutstanding')}, 2)"
        out["fundsUninvested"] = f"round({f} - {money_sum('principal')}, 2)"
    return out


def kpi(name: str, funds: float | None = None) -> str:
    return f"{full()} SELECT {kpi_exprs(funds)[name]} AS {name} FROM analyzed"


def kpis(faulty: bool = False, by: str = "", rollup: bool = False) -> str:
    columns = ", ".join(f"{e} AS {n}" for n, e in kpi_exprs(P.TOTAL_FUNDS).items())
    if rollup:
        return f"{full(faulty)} SELECT {by}, grouping_id({by}) AS totalLevel, {columns} FROM analyzed GROUP BY ROLLUP ({by})"
    return (f"{full(faulty)} SELECT {by + ', ' if by else ''}{columns} FROM analyzed" + (f" GROUP BY {by}" if by else ""))


def kpi_text() -> str:
    money = lambda c: f"'$' || printf('%,.2f', {c}) AS {c}"
    percent = lambda c: f"printf('%.1f', round({c}, 1)) || '%' AS {c}"
    return (f"SELECT grade, notes, notesExcluded, {money('principalExcluded')}, {money('totalEarnings')}, "
            f"{percent('currentRoi')}, {percent('netRoi')}, {percent('diversification')}, {money('fundsRemaining')}, "
            f"{money('fundsUninvested')} FROM ({kpis(by='grade')})")


def series_sql(grade: str | None) -> str:
    where = "" if grade is None else f" WHERE grade = {_q(grade)}"
    parts = []
    for n, (col, nm, grp) in enumerate(SERIES):
        amt = f"round({col}, 2)"
        hover = (f"CASE WHEN {amt} = 0 THEN '' ELSE '$' || "
                 f"regexp_replace(printf('%.2f', {amt}), '(\\.[0-9])0$', '\\1') END")
        parts.append(f"SELECT loanID, company, grade, {n} AS seriesOrder, {_q(col)} AS series, "
                     f"{_q(nm)} AS seriesName, {_q(grp)} AS seriesGroup, {amt} AS amount, "
                     f"{hover} AS hoverText FROM analyzed{where}")
    return full() + " " + " UNION ALL ".join(parts)


def funds_sql(funds: float) -> str:
    f = f"CAST({funds!r} AS DOUBLE)"
    po = f"round({money_sum('CASE WHEN NOT completed THEN principalOutstanding END')}, 2)"
    bdf = money_sum("CASE WHEN NOT completed THEN badDebtFundsReceived END")
    amounts = {FUNDS[0]: f"round({f} - po - bdf, 2)", FUNDS[1]: "bdf", FUNDS[2]: "po"}
    rows = " UNION ALL ".join(
        f"SELECT {n} AS sortOrder, {_q(c)} AS component, {amounts[c]} AS amount FROM tot"
        for n, c in enumerate(FUNDS))
    return (full() + f", tot AS (SELECT {po} AS po, {bdf} AS bdf FROM analyzed),"
            f" long AS ({rows}) SELECT *, CASE WHEN amount <= 0 THEN '' ELSE "
            f"'$' || printf('%,.2f', amount) || chr(10) || component END AS label FROM long")


def timeframe_sql(as_of: str, timeframe: str) -> str:
    from notewise.operators.timeframe import timeframe_bounds
    start, end = timeframe_bounds(as_of, timeframe)
    conds = {"end": f"datePaid <= DATE '{end.isoformat()}'"}
    if start is not None:
        conds["start"] = f"datePaid <= DATE '{start.isoformat()}'"
    parts = [grades_cte(), ledger_ctes(), notes_ctes(conds),
             waterfall_ctes("notes", "wfe", paid="end_repaid", suffix="_end")]
    src = "wfe"
    if start is not None:
        parts.append(waterfall_ctes("wfe", "wfs", paid="start_repaid", suffix="_start"))
        src = "wfs"
        e_start = money_sum("badDebtFundsReceived_start + profitsReceived_start")
        p_start = f"DATE '{start.isoformat()}'"
    else:
        e_start = "0.0::DOUBLE"
        p_start = "CAST(NULL AS DATE)"
    e_end = money_sum("badDebtFundsReceived_end + profitsReceived_end")
    return (with_(*parts) + f", agg AS (SELECT {e_start} AS earningsAtStart, {e_end} AS earningsAtEnd"
            f" FROM {src}) SELECT {p_start} AS periodStart, DATE '{end.isoformat()}' AS periodEnd,"
            " earningsAtStart, earningsAtEnd, round(earningsAtEnd - earningsAtStart, 2) AS earnings"
            " FROM agg")


def period_sql(period: str, by: str = "", faulty: bool = False) -> str:
    """Every note's waterfall at the end of every period, from payments up to that day."""
    months = {"month": 1, "quarter": 3}[period]
    b, on = (f"{by}, ", f"AND coalesce(p.{by}, '') = coalesce(t.{by}, '')") if by else ("", "")
    return with_(grades_cte(), ledger_ctes(faulty), notes_ctes(), f"""
ends AS (
  SELECT start, CAST(start + INTERVAL {months} MONTH - INTERVAL 1 DAY AS DATE) AS periodEnd
  FROM (SELECT CAST(unnest(generate_series(min(date_trunc('{period}', datePaid)), max(date_trunc('{period}', datePaid)),
                                           INTERVAL {months} MONTH)) AS DATE) AS start FROM ledger)),
moments AS (SELECT periodEnd FROM ends UNION SELECT CAST(min(start) - INTERVAL 1 DAY AS DATE) FROM ends),
paid AS (
  SELECT {KEYS}, periodEnd, round(sum(totalPaid), 2)::DOUBLE AS repaid
  FROM ledger JOIN moments ON datePaid <= periodEnd GROUP BY ALL),
at_end AS (
  SELECT n.* REPLACE (coalesce(p.repaid, 0.0) AS amountRepayed), m.periodEnd
  FROM notes n CROSS JOIN moments m LEFT JOIN paid p
    ON p.loanID = n.loanID AND p.company = n.company AND p.loanName = n.loanName AND p.interestRate = n.interestRate
   AND p.grade = n.grade AND p.periodEnd = m.periodEnd)""", waterfall_ctes("at_end", "wf")) + f""",
totals AS (
  SELECT {b}periodEnd, {money_sum('badDebtFundsReceived + profitsReceived')} AS total FROM wf GROUP BY ALL),
payers AS (
  SELECT {b}CAST(date_trunc('{period}', datePaid) + INTERVAL {months} MONTH - INTERVAL 1 DAY AS DATE) AS periodEnd,
         count(DISTINCT (loanID, company)) AS paying,
         count(DISTINCT (loanID, company)) FILTER (grade NOT IN ({', '.join(_q(g) for g, _ in GRADES)})) AS lacking
  FROM ledger WHERE datePaid IS NOT NULL GROUP BY ALL),
steps AS (
  SELECT *, lag(periodEnd) OVER (PARTITION BY {by or 1} ORDER BY periodEnd) AS before,
         lag(total) OVER (PARTITION BY {by or 1} ORDER BY periodEnd) AS total_before FROM totals)
SELECT {'t.' + by + ', ' if by else ''}before AS periodStart, t.periodEnd, coalesce(paying, 0) AS notesPaid, coalesce(lacking, 0) AS notesExcluded,
       total_before AS earningsAtStart, total AS earningsAtEnd, round(total - total_before, 2) AS earnings
FROM steps t LEFT JOIN payers p ON p.periodEnd = t.periodEnd {on} WHERE before IS NOT NULL"""


def dq_sql() -> str:
    known = ", ".join(_q(g) for g, _ in GRADES)
    rules = {
        "unknown_grade": f"coalesce(grade NOT IN ({known}), true)",
        "negative_fees": "fees < 0",
        "negative_principal": "principal < 0",
        "negative_bad_debt_funds": "badDebtFunds < 0",
        "negative_profits": "profits < 0",
        "negative_unit_payment": "unitPayment < 0",
        "zero_unit_payment": "coalesce(unitPayment = 0, true)",
        "zero_rate": "coalesce(interestRate = 0, true)",
        "zero_principal": "coalesce(principal = 0, true)",
    }
    parts = [f"SELECT {_q(n)} AS rule, count(*) FILTER (WHERE {p}) AS violations FROM notes0"
             for n, p in rules.items()]
    parts.append("SELECT 'duplicate_loan' AS rule, count(*) AS violations FROM "
                 "(SELECT loanID FROM notes0 GROUP BY loanID HAVING count(*) > 1)")
    return base(faulty=True) + " " + " UNION ALL ".join(parts)


def dq_ledger_sql(ctes: str, source: str, corrupt: str = "") -> str:
    rules = {f"null_{c}": f"{c} IS NULL" for c in (
        "loanID", "grade", "interestRate", "totalScheduled", "interestScheduled", "fees", "dueDate")}
    rules["null_paid_amount"] = "datePaid IS NOT NULL AND totalPaid IS NULL"
    if corrupt:
        rules["corrupt_row"] = corrupt
    return ctes + " " + " UNION ALL ".join(
        f"SELECT {_q(n)} AS rule, count(*) FILTER (WHERE {p}) AS violations FROM {source}" for n, p in rules.items())


def transactions_sql(ctes: str, paid: str = "datePaid IS NOT NULL", notes: str = "true") -> str:
    return (f"{ctes}, txn AS (SELECT loanID, CAST(round(sum(totalPaid), 2) AS DOUBLE) AS totalPaid, "
            f"count(*) AS numPayments FROM ledger WHERE {paid} GROUP BY loanID) "
            f"SELECT {', '.join('n.' + k for k in KEYS.split(', '))}, cyclesTotal, principal, fees, profits, unitPayment, "
            "startDate, cyclesRemaining - coalesce(numPayments, 0) AS cyclesRemaining, badDebtFunds, "
            "amountRepayed + coalesce(t.totalPaid, 0.0) AS amountRepayed "
            f"FROM notes0 n LEFT JOIN txn t ON n.loanID = t.loanID WHERE {notes}")


def oracle_sql() -> dict[str, str]:
    led = with_(grades_cte(), ledger_ctes())
    cols = LEDGER_COLS
    b = base()
    a = full()
    top_order = ("feesPaid ASC NULLS FIRST, principal ASC NULLS FIRST, "
                 "principalOutstanding DESC NULLS LAST, interestRate ASC NULLS FIRST, "
                 "cyclesTotal ASC NULLS FIRST, loanID ASC NULLS FIRST")
    wf_cols = NOTE_COLS + ", " + WATERFALL_COLS
    corrupt = (f"{led}, read AS (SELECT * REPLACE (CASE WHEN loanID % 29 <> 0 THEN dueDate END AS dueDate, "
               "CASE WHEN loanID % 23 <> 0 THEN totalPaid END AS totalPaid) FROM ledger)")
    return {
        "ledger": f"{led} SELECT {cols} FROM ledger",
        "ledger_renamed": f"{led} SELECT {cols} FROM ledger",
        "grade_dim": (f"{led} SELECT g.gradeOrder, g.grade, g.badDebtRate, "
                      "count(l.grade) AS instalments FROM grades g LEFT JOIN ledger l "
                      "ON l.grade = g.grade GROUP BY g.gradeOrder, g.grade, g.badDebtRate"),
        "paid_instalments": f"{led} SELECT {cols} FROM ledger WHERE datePaid IS NOT NULL",
        "note_summary": f"{b} SELECT {NOTE_COLS} FROM notes0",
        "note_principal": f"{b} SELECT loanID, unitPayment, interestRate, cyclesTotal, principal FROM notes0",
        "note_bad_debt": f"{b} SELECT loanID, grade, principal, cyclesTotal, badDebtFunds, profits FROM notes0",
        "loan_transactions": (f"{led} SELECT loanID, CAST(round(sum(totalPaid), 2) AS DOUBLE) AS totalPaid, "
                              "count(*) AS numPayments FROM ledger WHERE datePaid IS NOT NULL "
                              "GROUP BY loanID"),
        "notes_with_transactions": transactions_sql(b),
        "rebuild_notes": f"{b} SELECT {NOTE_COLS} FROM notes",
        "waterfall": f"{a} SELECT {wf_cols} FROM wf",
        "note_progress": (f"{a} SELECT loanID, cyclesRemaining, nextPrincipalPayment, "
                          "principalOutstanding, unitPayment, monthsToBreakeven, completed FROM analyzed"),
        "open_notes": f"{a} SELECT {ANALYZED_COLS} FROM analyzed WHERE NOT completed",
        "notes_ordered": (f"{a} SELECT {ANALYZED_COLS} FROM analyzed ORDER BY principal ASC NULLS FIRST, "
                          "interestRate ASC NULLS FIRST, loanID ASC NULLS FIRST"),
        "notes_top_k": f"{a} SELECT {ANALYZED_COLS} FROM analyzed ORDER BY {top_order} LIMIT {P.TOP_K}",
        "notes_preview": f"{a} SELECT {ANALYZED_COLS} FROM analyzed ORDER BY loanID LIMIT {P.PREVIEW_ROWS}",
        "note_annualized_return": (f"{a} SELECT loanID, principal, cyclesTotal, cyclesRemaining, "
                                   f"round({CUR}, 8) AS currentGrowth, round({PROJ}, 8) AS projectedGrowth "
                                   "FROM analyzed"),
        "weighted_avg_rate": (f"{b} SELECT round(sum(interestRate * principal) / sum(principal), 6) "
                              "AS weightedAvgRate FROM notes0"),
        "kpi_total_earnings": kpi("totalEarnings"),
        "kpi_current_roi": kpi("currentRoi"),
        "kpi_net_roi": kpi("netRoi"),
        "kpi_diversification": kpi("diversification"),
        "kpi_funds_remaining": kpi("fundsRemaining", P.TOTAL_FUNDS),
        "kpi_funds_uninvested": kpi("fundsUninvested", P.TOTAL_FUNDS),
        "portfolio_kpis": kpis(by="grade"),
        "portfolio_kpis_total": kpis(),
        "portfolio_kpis_rollup": kpis(faulty=True, by="grade, completed", rollup=True),
        "portfolio_kpis_faulty": kpis(faulty=True),
        "portfolio_kpis_text": kpi_text(),
        "funds_allocation": funds_sql(P.TOTAL_FUNDS),
        "grade_distribution": (f"{b} SELECT g.gradeOrder, g.grade, coalesce(sum(n.principal), 0.0) "
                               "AS principal FROM grades g LEFT JOIN notes0 n ON n.grade = g.grade "
                               "GROUP BY g.gradeOrder, g.grade"),
        "progress_series": series_sql(None),
        "progress_by_grade": series_sql(P.PROGRESS_GRADE),
        "progress_annotations": (f"{a} SELECT loanID, company, principal - 2 AS position, "
                                 "CASE WHEN monthsToBreakeven > 0 THEN CAST(monthsToBreakeven AS VARCHAR) "
                                 "ELSE '' END AS label FROM analyzed"),
        "earnings_timeframe": timeframe_sql(P.TIMEFRAME_AS_OF, P.TIMEFRAME),
        "earnings_timeframe_month": timeframe_sql(P.TIMEFRAME_AS_OF, "month"),
        "earnings_timeframe_all": timeframe_sql(P.TIMEFRAME_AS_OF, "all"),
        "earnings_by_month": period_sql("month"),
        "earnings_by_quarter_and_grade": period_sql("quarter", "grade", faulty=True),
        "dq_report": dq_sql(),
        "analyzed_notes_stream": f"{a} SELECT {ANALYZED_COLS} FROM analyzed",
        "portfolio_kpis_stream": kpis(faulty=True, by="grade"),
        "stored_notes": transactions_sql(b, f"year(datePaid) <= {max(P.STORE_YEARS)}", f"n.loanID % {P.STORE_GAP} <> 0"),
        "stored_notes_log": (f"{led} SELECT CAST(year(datePaid) AS VARCHAR) AS batchId, count(*) AS payments, "
                             "CAST(sum(totalPaid) AS DOUBLE) AS amount, "
                             f"count(*) FILTER (WHERE loanID % {P.STORE_GAP} = 0) AS unmatchedPayments "
                             f"FROM ledger WHERE year(datePaid) <= {max(P.STORE_YEARS)} GROUP BY ALL"),
        "ledger_csv": f"""{led} SELECT * REPLACE ('The "Best", ' || company AS company) FROM ledger""",
        "ledger_csv_inferred": f"""{led} SELECT * REPLACE ('The "Best", ' || company AS company) FROM ledger""",
        "ledger_folder": (f"""{led} SELECT * REPLACE ('The "Best", ' || company AS company, """
                          "CASE WHEN loanID % 3 <> 2 THEN status END AS status) FROM ledger"),
        "ledger_quarantine": (f"{led} SELECT CASE WHEN loanID % 29 = 0 OR loanID % 23 = 0 THEN 'bad' ELSE 'good' END AS quality, "
                              "count(*) AS rows, count(DISTINCT loanID) AS loans, CAST(sum(totalScheduled) AS DOUBLE) AS scheduled "
                              "FROM ledger GROUP BY ALL"),
        "bucketed_notes": transactions_sql(b),
        "notes_positions": (f"{a} SELECT {KEYS}, principal, row_number() OVER (ORDER BY principal ASC NULLS FIRST, "
                            "interestRate ASC NULLS FIRST, loanID ASC NULLS FIRST) - 1 AS position FROM analyzed"),
        "ledger_titled": f"{led} SELECT " + ", ".join(f'{c} AS "{t}"' for t, c in TITLES.items()) + " FROM ledger",
        "dq_corrupt": dq_ledger_sql(corrupt, "read", "loanID % 29 = 0 OR loanID % 23 = 0"),
        "dq_ledger_report": dq_ledger_sql(with_(grades_cte(), ledger_ctes(replace=NULLED)), "ledger"),
        "note_summary_edge": f"{base(replace=EDGE)} SELECT {NOTE_COLS} FROM notes0",
        "rebuild_notes_nulls": f"{base(replace=NULLED)} SELECT {NOTE_COLS} FROM notes",
        "notes_with_transactions_nulls": transactions_sql(base(replace=NULLED)),
        "grade_distribution_faulty": (
            f"{base(faulty=True)} SELECT coalesce(g.gradeOrder, 10) AS gradeOrder, coalesce(g.grade, 'other') AS grade, "
            "coalesce(sum(n.principal), 0.0) AS principal FROM grades g FULL JOIN notes0 n ON n.grade = g.grade "
            "GROUP BY ALL"),
    }
