"""Consensus of forecasts that several institutions publish and renew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consensus(reports: DataFrame, months: int) -> DataFrame:
    """(date, code, mean, std, n): at each month's start, over the newest report of each institution of the last ``months`` months.

    ``reports`` has (code, institution, pub_date, value).  A report is dealt to the month starts that it
    serves until a newer one of its institution does, at most ``months``, after the reports of a code have met, so that reports rather than
    their months are exchanged.  Of reports of one time the greatest value counts.
    """
    first = F.add_months(F.trunc("pub_date", "month"), 1)
    known = reports.filter("pub_date is not null and value is not null").withColumn("_from", first).repartition("code")
    newest = known.groupBy("code", "institution", "_from").agg(F.max_by("value", F.struct("pub_date", "value")).alias("value"))
    until = F.lead("_from").over(Window.partitionBy("code", "institution").orderBy("_from"))
    # Null after the last: least skips it.
    last = F.least(F.add_months("_from", months - 1), F.add_months(until, -1))
    served = newest.withColumn("_last", last).select("code", "value", F.explode(F.sequence("_from", "_last", F.expr("interval 1 month"))).alias("date"))
    return served.groupBy("date", "code").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("n"))


def revisions(consensus_: DataFrame, months: int) -> DataFrame:
    """Adds ``change``, the consensus against that of so many months before, and ``dispersion``."""
    month = F.year("date") * 12 + F.month("date")
    w = Window.partitionBy("code").orderBy(month).rangeBetween(-months, -months)
    return consensus_.withColumn("change", F.try_divide(F.col("mean"), F.max("mean").over(w)) - 1).withColumn("dispersion", F.try_divide(F.col("std"), F.abs("mean")))
