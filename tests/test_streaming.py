"""The incremental (streaming) notes equal the batch notes, and replays are harmless."""

import pytest
from pyspark.sql import functions as F

from notewise.plans.portfolio import QUERIES, analyzed_notes
from notewise.sources.derived import derive_ledger
from notewise.streaming.payments import latest_notes, start_note_stream, stream_session


def test_stream_equals_batch_and_replay_is_idempotent(spark, sf_small, tmp_path):
    ledger = derive_ledger(spark, sf_small)
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    ledger.repartitionByRange(3, "dueDate").write.parquet(src)
    q = start_note_stream(spark, src, out, checkpoint=ck, max_files_per_trigger=1)
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 3
    expected = analyzed_notes(ledger)
    got = latest_notes(spark, out)
    assert sorted(got.columns) == sorted(expected.columns)
    got = got.select(*expected.columns)
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0
    # the first batch saw only part of the payments: an older version differs
    first = spark.read.parquet(out).filter(F.col("batchId") == 0)
    assert first.count() > 0
    # restarting on the same checkpoint processes nothing new and changes nothing
    q2 = start_note_stream(spark, src, out, checkpoint=ck, max_files_per_trigger=1)
    q2.awaitTermination()
    assert sum(p["numInputRows"] for p in q2.recentProgress) == 0
    again = latest_notes(spark, out).select(*expected.columns)
    assert again.exceptAll(expected).count() == 0


def test_csv_stream_source(spark, sf_small, tmp_path):
    from notewise.sources.ledger import write_ledger

    ledger = derive_ledger(spark, sf_small).filter("loanID < 500")
    write_ledger(ledger.coalesce(1), str(tmp_path / "csv"), fmt="csv")
    q = start_note_stream(spark, str(tmp_path / "csv"), str(tmp_path / "out"), fmt="csv",
                          checkpoint=str(tmp_path / "ck"))
    q.awaitTermination()
    got = latest_notes(spark, str(tmp_path / "out"))
    assert got.count() == analyzed_notes(ledger).count()


def test_stream_in_a_session_without_settings(spark, sf_small, tmp_path):
    """A caller that never applied the recommended settings."""
    plain = spark.newSession()
    assert plain.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
    ledger = derive_ledger(plain, sf_small).filter("loanID < 500")
    ledger.write.parquet(str(tmp_path / "src"))
    start_note_stream(plain, str(tmp_path / "src"), str(tmp_path / "out"), checkpoint=str(tmp_path / "ck")).awaitTermination()
    assert latest_notes(plain, str(tmp_path / "out")).count() == analyzed_notes(ledger).count() > 0
    assert plain.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None


@pytest.mark.parametrize("name", ["analyzed_notes_stream", "portfolio_kpis_stream"])
def test_query_in_a_session_that_sets_no_shuffle_partitions(spark, sf_small, name):
    """A cluster's session as it comes: even the number of shuffle partitions is Spark's default."""
    plain = spark.newSession()
    plain.conf.unset("spark.sql.shuffle.partitions")
    assert plain.conf.get("spark.sql.shuffle.partitions", None) is None
    rows = lambda s: sorted(map(str, QUERIES[name](s, sf_small).collect()))
    assert rows(plain) == rows(spark) != []
    assert plain.conf.get("spark.sql.shuffle.partitions", None) is None


def test_the_stream_takes_the_partitions_of_the_session(spark):
    """Those given, else those set, else Spark's default of 200."""
    of = lambda s, n=None: stream_session(s, n).conf.get("spark.sql.shuffle.partitions")
    plain = spark.newSession()
    plain.conf.unset("spark.sql.shuffle.partitions")
    assert (of(plain), of(plain, 3)) == ("200", "3")
    plain.conf.set("spark.sql.shuffle.partitions", "7")
    assert (of(plain), of(plain, 3)) == ("7", "3")
