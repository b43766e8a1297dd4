"""Session helpers: recommended settings never override explicit ones; checkpoint folder."""

from notewise.session import RECOMMENDED, checkpoint_dir, configure


def test_configure_keeps_explicit_settings(spark):
    # local_session sets the time zone explicitly; configure must not touch it
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    configure(spark)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == RECOMMENDED[
        "spark.sql.autoBroadcastJoinThreshold"]
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_checkpoint_dir_reads_the_session(spark):
    path = checkpoint_dir(spark)
    assert path and spark.conf.get("spark.checkpoint.dir") == path
    assert checkpoint_dir(spark) == path
