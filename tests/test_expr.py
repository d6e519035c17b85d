import pytest
from pyspark.sql import functions as F

from tabloom.functions import expr

ROWS = [(1, "3", "yes", "North Bay", None, [1, 2]), (2, "10", "no", "south", "", []), (3, "x", None, "North", " ", None)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id long, n string, flag string, `home team` string, note string, items array<int>")


def holds(df, source, **o):
    return [r.id for r in df.where(expr.condition(df, source, **o)).orderBy("id").collect()]


@pytest.mark.parametrize(
    ("source", "ids"),
    [
        ("n <= 3", [1]), ("n >= 3", [1, 2]), ("n != 3", [2, 3]), ("n == '3'", [1]), ("flag != 'yes'", [2, 3]), ("flag is null", [3]), ("flag is not null", [1, 2]),
        ("note is empty", [1, 2, 3]), ("note is not empty", []), ("home team contains 'north'", [1, 3]), ("home team contains 'bay' or 'sou'", [1, 2]), ("Home Team startswith 'North'", [1, 3]),
        ("`home team` endswith 'Bay'", [1]), ("home team like 'North%'", [1, 3]), ("home team not like 'North%'", [2]), ("id in [1, 3]", [1, 3]), ("flag in ('yes', 'no')", [1, 2]), ("flag not in ['yes']", [2, 3]),
        ("not (id == 2)", [1, 3]), ("id > 1 and flag == 'no' or id == 3", [2, 3]), ("(id > 1) & ~(id == 3)", [2]), ("home team.str.contains('north', case=False, na=False)", [1, 3]), ("home team.str.contains('north')", []),
        ("flag == 'yes and no'", []), ("id > -1", [1, 2, 3]), ("n > 2.5", [1, 2]), ("n = id", []),
    ],
)
def test_conditions(df, source, ids):
    assert holds(df, source) == ids


def test_precedence(df):
    assert holds(df, "id == 1 and flag == 'no' or id == 3") == [3]
    assert holds(df, "id == 3 and flag == 'no' or id == 3", precedence="or_first") == [3]
    assert holds(df, "id == 1 or id == 3 and flag == 'yes'", precedence="or_first") == [1]


@pytest.mark.parametrize("source", ["nothing == 1", "id ==", "id == 1 extra", "id ? 1", "", "__import__('os')", "id.str.upper('x')"])
def test_unreadable_conditions(df, source):
    with pytest.raises(expr.ExpressionError):
        expr.condition(df, source)


def values(df, source):
    return [r.x for r in df.orderBy("id").select(expr.arithmetic(df, source).alias("x")).collect()]


def test_arithmetic(df):
    assert values(df, "id * 2 + 1") == [3, 5, 7]
    assert values(df, "n / id") == [3, 5, None]
    assert values(df, "-id % 3") == [2, 1, 0]
    assert values(df, "id / (id - 1)") == [None, 2, 1.5]
    assert values(df, "2 ** id ** 2 - 1") == [1, 15, 511]
    assert values(df, "len(home team)") == [9, 5, 5]
    assert values(df, "len(items)") == [2, 0, None]
    assert values(df, "id >= 2 & n > 5") == [False, True, None]
    assert values(df, "round(id / 3, 2)") == [0.33, 0.67, 1.0]
    for bad in ("df['id'] + 1", "id +", "open('x')", "id; 1"):
        with pytest.raises(expr.ExpressionError):
            expr.arithmetic(df, bad)


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-29 10:11:00",), ("none",)], "d string").withColumn("t", F.col("d").try_cast("timestamp_ntz"))
    for name, want in (("year", 2024), ("month", 2), ("day", 29), ("hour", 10), ("minute", 11), ("dayofweek", 3), ("weekday", 3)):
        assert [r[0] for r in df.select(expr.arithmetic(df, f"{name}(d)")).collect()] == [want, None]
        assert [r[0] for r in df.select(expr.arithmetic(df, f"{name.upper()}(t)")).collect()] == [want, None]


def test_values(df):
    assert expr.value(df, True)[1] == "bool" and expr.value(df, 2)[1] == "number" and expr.value(df, None)[1] == "null"
    assert expr.value(df, "n")[1] == "text" and expr.value(df, "id * 2")[1] == "number" and expr.value(df, "int(n)")[1] == "number" and expr.value(df, "plain - text")[1] == "text"
    assert [r[0] for r in df.orderBy("id").select(expr.value(df, "int(n)")[0]).collect()] == [3, 10, None]
