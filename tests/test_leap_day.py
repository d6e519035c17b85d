"""A day that the default year lacks."""

import datetime

from tabloom import queries as q


def test_leap_day_is_kept_as_null(spark, tmp_path):
    days = [(1, datetime.date(1996, 2, 29)), (2, datetime.date(1996, 2, 28)), (3, datetime.date(1995, 3, 1))]
    spark.createDataFrame(days, "o_orderkey long, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r.d for r in q.QUERIES["parse_date_default_year"](spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: datetime.datetime(1990, 2, 28), 3: datetime.datetime(1990, 3, 1)}
