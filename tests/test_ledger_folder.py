"""A folder of ledger files with different headers, and the quarantine of bad rows."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from notewise.operators.quality import dq_ledger_report, quarantine, read_quarantined
from notewise.sources.ledger import CORRUPT, read_ledger
from notewise.sources.ledgerfolder import file_headers, layouts, read_ledger_folder
from notewise.sources.schema import ledger_schema
from test_ledger_dialect import GOOD, TITLES


def _write(path, rows, titles=TITLES):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    lines = [titles, *[[(GOOD | r).get(t, "x") for t in titles] for r in rows]]
    with open(path, "w") as f:
        f.write("".join(",".join(line) + "\n" for line in lines))


@pytest.fixture()
def folder(tmp_path):
    root = str(tmp_path / "in")
    _write(f"{root}/2018 [a].csv", [{"Loan Id": "1"}, {"Loan Id": "2"}])
    _write(f"{root}/100%20.csv", [{"Loan Id": "3"}])
    _write(f"{root}/later/b.csv", [{"Loan Id": "4", "Total Paid": "7.00"}], TITLES[::-1])
    _write(f"{root}/later/c+d.csv", [{"Loan Id": "5"}], [t for t in TITLES if t != "Status"] + ["Remark"])
    _write(f"{root}/later/none.csv", [])
    open(f"{root}/later/empty.csv", "w").close()
    return root


def test_every_file_is_read_by_its_own_header(spark, folder):
    got = read_ledger_folder(spark, folder, optional=["status"])
    assert got.columns == [f.name for f in ledger_schema().fields]
    rows = {r["loanID"]: r for r in got.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5] and got.count() == 5
    assert float(rows[4]["totalPaid"]) == 7.0 and rows[5]["status"] is None
    assert all(rows[i]["status"] == "Paid" and rows[i]["company"] == 'Joe "The" Co, Ltd' for i in (1, 2, 3, 4))


def test_one_layout_per_header(spark, folder):
    assert sorted(len(files) for _, files in layouts(spark, folder)) == [1, 1, 3]
    assert file_headers(spark, folder).count() == 5  # the empty file has none


def test_headers_of_files_cut_into_many_splits(spark, tmp_path):
    path = str(tmp_path / "in" / "big.csv")
    _write(path, [{"Loan Id": str(i)} for i in range(2000)])
    _write(str(tmp_path / "in" / "other.csv"), [{"Loan Id": "9000"}], TITLES[::-1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        assert {h for h, _ in layouts(spark, str(tmp_path / "in"))} == {",".join(TITLES), ",".join(TITLES[::-1])}
        assert read_ledger_folder(spark, str(tmp_path / "in")).select("loanID").distinct().count() == 2001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_missing_titles_and_bad_fields_are_not_passed_over(spark, folder, tmp_path):
    with pytest.raises(ValueError, match="status"):
        read_ledger_folder(spark, folder)
    _write(f"{folder}/bad.csv", [{"Total Paid": "ten"}], TITLES[::-1])
    with pytest.raises(PySparkException, match="totalPaid=ten"):
        read_ledger_folder(spark, folder, optional=["status"]).collect()
    kept = read_ledger_folder(spark, folder, optional=["status"], on_bad="keep")
    assert [r[CORRUPT] for r in kept.where(F.col(CORRUPT).isNotNull()).collect()] == ["totalPaid=ten"]
    os.makedirs(tmp_path / "nothing")
    open(tmp_path / "nothing" / "empty.csv", "w").close()
    with pytest.raises(ValueError, match="no ledger file"):
        read_ledger_folder(spark, str(tmp_path / "nothing"))


def test_quarantine_parts_rows_in_one_read(spark, tmp_path):
    path, out = str(tmp_path / "in" / "l.csv"), str(tmp_path / "out")
    _write(path, [{"Loan Id": "1"}, {"Loan Id": "2", "Total Paid": "ten"}, {"Loan Id": "", "Due Date": "soon"}, {"Loan Id": "4"}])
    ledger = read_ledger(spark, path, on_bad="keep")
    seen = quarantine(ledger, out)
    good, bad = read_quarantined(spark, out, "good"), read_quarantined(spark, out, "bad")
    assert good.columns == [f.name for f in ledger_schema().fields]
    assert sorted(r["loanID"] for r in good.collect()) == [1, 4]
    assert sorted(r[CORRUPT] for r in bad.collect()) == ["dueDate=soon", "totalPaid=ten"]
    report = {r["rule"]: r["violations"] for r in dq_ledger_report(ledger).collect()}
    assert seen == {"rows": 4, **report}


def test_quarantine_without_bad_rows_or_without_rows(spark, tmp_path):
    for name, rows in (("clean", [{}]), ("none", [])):
        path, out = str(tmp_path / name / "l.csv"), str(tmp_path / f"{name}-out")
        _write(path, rows)
        seen = quarantine(read_ledger(spark, path, on_bad="keep"), out)
        assert seen["rows"] == len(rows) and seen["corrupt_row"] == 0
        if rows:
            assert read_quarantined(spark, out, "good").count() == 1
            assert read_quarantined(spark, out, "bad").isEmpty()
