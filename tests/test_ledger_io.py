"""CSV / parquet ledger reading, title normalisation and the corrupt-record path."""

from notewise.operators.quality import dq_corrupt_rows
from notewise.sources.ledger import normalise_titles, read_ledger, to_titles, write_ledger
from notewise.sources.schema import LEDGER_TITLES, column_name, ledger_columns, title_map

HEADER = ",".join(t for t, _ in LEDGER_TITLES)


def _row(loan, paid_date, total_paid="10.00", amount="10.00", grade="B"):
    return (f"Scheduled,{loan},Acme,Loan {loan},12.5,{grade},1.00,9.00,{amount},0,0,0,0,0,"
            f"{total_paid},0.15,2019-01-15,{paid_date},Paid")


def _write(tmp_path, lines):
    p = tmp_path / "ledger.csv"
    p.write_text(HEADER + "\n" + "\n".join(lines) + "\n")
    return str(p)


def test_title_rule_for_all_titles():
    names = title_map()
    assert len(names) == 19
    assert names["Fees Paid to Loop"] == "fees"
    assert names["Risk Band"] == "grade"
    assert names["Loan Id"] == "loanID"
    assert names["Payment Type"] == "paymentType"
    assert names["Date Paid"] == "datePaid"
    assert column_name("Total Scheduled") == "totalScheduled"
    assert ledger_columns()[0] == "paymentType" and len(set(ledger_columns())) == 19


def test_csv_read_fixed_schema_and_empty_date_is_null(spark, tmp_path):
    path = _write(tmp_path, [_row(1, "2019-01-20"), _row(1, "")])
    df = read_ledger(spark, path)
    assert df.columns == ledger_columns()
    rows = df.orderBy("datePaid").collect()
    assert rows[0]["datePaid"] is None
    assert str(rows[1]["datePaid"]) == "2019-01-20"
    assert dict(df.dtypes)["totalPaid"] == "decimal(18,4)"
    assert dict(df.dtypes)["loanID"] == "bigint"


def test_csv_corrupt_rows_are_kept_aside(spark, tmp_path):
    path = _write(tmp_path, [_row(1, "2019-01-20"), _row(2, "", amount="ten")])
    df = read_ledger(spark, path, keep_corrupt=True).cache()
    bad = dq_corrupt_rows(df).collect()
    assert len(bad) == 1 and bad[0]["loanID"] == 2
    assert df.count() == 2


def test_csv_infer_schema_option(spark, tmp_path):
    path = _write(tmp_path, [_row(1, "2019-01-20")])
    df = read_ledger(spark, path, infer_schema=True)
    assert df.columns == ledger_columns()


def test_round_trip_titles(spark, sf_small):
    from notewise.sources.derived import derive_ledger

    led = derive_ledger(spark, sf_small)
    titled = to_titles(led)
    assert titled.columns == [t for t, _ in LEDGER_TITLES]
    assert normalise_titles(titled).columns == led.columns


def test_csv_and_parquet_sinks_round_trip(spark, sf_small, tmp_path):
    from notewise.sources.derived import derive_ledger

    led = derive_ledger(spark, sf_small).filter("loanID < 200")
    write_ledger(led, str(tmp_path / "csv"), fmt="csv")
    write_ledger(led, str(tmp_path / "pq"), fmt="parquet", partition_by=["grade"])
    back_csv = read_ledger(spark, str(tmp_path / "csv"))
    back_pq = read_ledger(spark, str(tmp_path / "pq"), fmt="parquet")
    assert back_csv.exceptAll(led).count() == 0 and led.exceptAll(back_csv).count() == 0
    assert back_pq.exceptAll(led).count() == 0 and led.exceptAll(back_pq).count() == 0
