"""Display text is a separate, last step; numbers stay numbers."""

from notewise.functions.fmt import money_text, percent_text, short_amount_text


def test_text_formats(spark):
    df = spark.createDataFrame([(1234567.5, 12.34, 12.5), (0.0, 0.0, 12.0)], "m DOUBLE, p DOUBLE, a DOUBLE")
    rows = df.select(money_text("m").alias("m"), percent_text("p").alias("p"),
                     short_amount_text("a").alias("a")).collect()
    assert (rows[0]["m"], rows[0]["p"], rows[0]["a"]) == ("$1,234,567.50", "12.3%", "12.5")
    assert (rows[1]["m"], rows[1]["p"], rows[1]["a"]) == ("$0.00", "0.0%", "12.0")
