"""Dates as they are written."""

import pytest
from pyspark.sql import functions as F

from loamframe.functions import times

READ = {
    "2020-06-05": "2020-06-05 00:00:00", "20200605": "2020-06-05 00:00:00", "2020/06/05": "2020-06-05 00:00:00", "June 5 2020": "2020-06-05 00:00:00",
    "june 5th, 2020": "2020-06-05 00:00:00", "5 Jun 2020": "2020-06-05 00:00:00", "5-Jun-2020": "2020-06-05 00:00:00", "Fri, 5 Jun 2020 10:11:12 GMT": "2020-06-05 10:11:12",
    "6/5/2020": "2020-06-05 00:00:00", "25/12/2020": "2020-12-25 00:00:00", "20200605T101112Z": "2020-06-05 10:11:12", "20200605101112": "2020-06-05 10:11:12",
    "2020/6/5 3:04 PM": "2020-06-05 15:04:00", "2020-06-05T10:00:00-05:00": "2020-06-05 15:00:00", "2020/06/05 10:00 +0200": "2020-06-05 08:00:00",
    "12 AM": None, "June": None, "5 Jun": None, "13/13/2020": None, "2020/02/30": None, "free text": None, "2020-06-05 and more": None, "": None, None: None,
    " 2020.06.05 ": "2020-06-05 00:00:00", "Dec 31, 1999 12:00 am": "1999-12-31 00:00:00", "20201305": None,
}


def test_written_dates(spark):
    df = spark.createDataFrame([(t,) for t in READ], "t string")
    got = {r["t"]: r["m"] for r in df.select("t", F.date_format(times.to_utc(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("m")).collect()}
    assert got == READ


@pytest.mark.parametrize("value", ["20200605", "June 5 2020"])
def test_moment_of_a_map(spark, value):
    df = spark.createDataFrame([({"note": "free text", "seen": value},)], "m map<string,string>")
    assert df.select(F.date_format(times.datetime_from_map(F.col("m")), "yyyy-MM-dd")).first()[0] == "2020-06-05"
