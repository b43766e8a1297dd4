"""The ledger file as its users write it: quotes, line breaks, reordered titles, bad fields."""

import pytest
from pyspark.errors import PySparkException

from notewise.operators.quality import dq_ledger_report
from notewise.sources.derived import derive_ledger
from notewise.sources.ledger import read_ledger, write_ledger
from notewise.sources.schema import LEDGER_TITLES, column_name, ledger_schema

TITLES = [t for t, _ in LEDGER_TITLES]
GOOD = {
    "Payment Type": "Scheduled", "Loan Id": "7", "Company": '"Joe ""The"" Co, Ltd"', "Loan Name": "Loan 7",
    "Interest Rate": "12.5", "Risk Band": "B", "Interest Scheduled": "1.00", "Principal Scheduled": "9.00",
    "Total Scheduled": "10.00", "Interest Owed": "0", "Principal Owed": "0", "Total Owed": "0", "Interest Paid": "0",
    "Principal Paid": "0", "Total Paid": "10.00", "Fees Paid to Loop": "0.15", "Due Date": "2019-01-15",
    "Date Paid": "2019-01-20", "Status": "Paid",
}


def _file(tmp_path, rows, titles=TITLES):
    path = tmp_path / "ledger.csv"
    path.write_text(",".join(titles) + "\n" + "\n".join(",".join((GOOD | r)[t] for t in titles) for r in rows) + "\n")
    return str(path)


def test_doubled_quotes_and_commas(spark, tmp_path):
    assert read_ledger(spark, _file(tmp_path, [{}])).first()["company"] == 'Joe "The" Co, Ltd'


def test_line_break_inside_quotes_is_an_option(spark, tmp_path):
    path = _file(tmp_path, [{"Company": '"two\nlines"'}, {}])
    rows = read_ledger(spark, path, multi_line=True).collect()
    assert [r["company"] for r in rows] == ["two\nlines", 'Joe "The" Co, Ltd'] and all(r["loanID"] == 7 for r in rows)
    with pytest.raises(PySparkException):  # without it the broken rows are not passed over
        read_ledger(spark, path).collect()


def test_columns_are_found_by_title(spark, tmp_path):
    row = read_ledger(spark, _file(tmp_path, [{}], titles=TITLES[::-1])).first()
    assert float(row["totalPaid"]) == 10.0 and float(row["fees"]) == 0.15 and row["status"] == "Paid"


def test_a_missing_title_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="fees"):
        read_ledger(spark, _file(tmp_path, [{}], titles=[t for t in TITLES if t != "Fees Paid to Loop"]))


def test_bad_fields_fail_by_default_and_are_named_on_request(spark, tmp_path):
    path = _file(tmp_path, [{}, {"Date Paid": "01/20/2019"}, {"Total Paid": "ten", "Date Paid": ""}])
    with pytest.raises(PySparkException, match="datePaid=01/20/2019|totalPaid=ten"):
        read_ledger(spark, path).collect()
    kept = read_ledger(spark, path, on_bad="keep")
    assert sorted(r["_corrupt_record"] or "" for r in kept.collect()) == ["", "datePaid=01/20/2019", "totalPaid=ten"]
    assert dict(dq_ledger_report(kept).collect())["corrupt_row"] == 2
    both = read_ledger(spark, path, date_format=["yyyy-MM-dd", "MM/dd/yyyy"], on_bad="keep")
    assert both.where("_corrupt_record is not null").count() == 1
    assert both.where("datePaid = date'2019-01-20'").count() == 2


def test_inferred_types_are_the_ledgers(spark, tmp_path):
    df = read_ledger(spark, _file(tmp_path, [{}]), infer_schema=True)
    assert df.dtypes == [(f.name, f.dataType.simpleString()) for f in ledger_schema().fields]
    row = df.first()
    assert str(row["datePaid"]) == "2019-01-20" and float(row["fees"]) == 0.15


def test_json_by_title(spark, tmp_path):
    path = str(tmp_path / "json")
    spark.createDataFrame([tuple(GOOD[t].strip('"') for t in TITLES)], TITLES).write.json(path)
    row = read_ledger(spark, path, fmt="json").first()
    assert row["loanID"] == 7 and str(row["dueDate"]) == "2019-01-15" and float(row["totalPaid"]) == 10.0
    assert [column_name(t) for t in TITLES] == read_ledger(spark, path, fmt="json").columns


def test_parse_stays_generated_and_reads_each_field_once(spark, sf_small, tmp_path):
    """A lambda in the trace would run every row interpreted, and a second parse doubles the work."""
    path = str(tmp_path / "csv")
    write_ledger(derive_ledger(spark, sf_small).where("loanID < 100"), path, fmt="csv")
    for bad in ("fail", "keep"):
        plan = read_ledger(spark, path, on_bad=bad)._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and plan.count("gettimestamp(") == 2, plan
