import pytest
from pyspark.sql import functions as F

from tabloom.functions import names
from tabloom.functions import text as tx


def test_names():
    assert names.snake([" A b!", "a_b", "A B", "é"]) == ["a_b", "a_b_1", "a_b_2", ""]
    assert names.sql_names(["_row_id", "1st", "a b", "A-B", "!!"]) == ["row_id", "col_1st", "a_b", "A_B_2", "col"]
    assert names.unique(["a", "A", "a_1", "a"]) == ["a", "A_2", "a_1", "a_3"]
    assert names.header(["Gold", "Gold", "x", "x", "x", "", ""]) == ["Gold", "Gold_name", "x", "x_value", "x_2", "column_6", "_value"]
    assert names.table_name("2 b") == "t_2_b" and names.table_name("") == "t"


def test_resolvers():
    cols = ["Home Team", "score ", "School name", "points_total"]
    assert names.strict("home team", cols) == "Home Team" and names.strict("score", cols) is None
    assert names.fuzzy("score", cols) == "score " and names.fuzzy("points", cols) == "points_total" and names.fuzzy("no such", cols) is None
    assert names.meant("home_team", cols) == "Home Team" and names.meant("school", cols) == "School name"


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("s", "n"), [(" 12 ", 12.0), ("12d", None), ("nan", None), ("1e3", 1000.0), ("-3.5", -3.5), ("1,2", None), ("", None), (".5", 0.5), ("5.", 5.0), (None, None)])
def test_number(spark, s, n):
    assert one(spark, tx.number(F.lit(s).cast("string"))) == n


def test_patterns(spark):
    assert one(spark, tx.group(F.lit("a12b"), r"(?P<digits>\d+)(x)?", 1)) == "12"
    assert one(spark, tx.group(F.lit("a12b"), r"(?P<digits>\d+)(x)?", 2)) is None
    assert one(spark, tx.group(F.lit("ab"), r"a(c*)b", 1)) == ""
    assert one(spark, tx.group(F.lit("ab"), r"z(c)", 1)) is None
    assert one(spark, tx.group(F.lit("ab"), r"(a)", 2)) is None
    assert one(spark, F.regexp_replace(F.lit("x-y"), tx.java(r"(?P<a>x)-(y)"), tx.replacement(r"\2\\ $\g<a>", r"(?P<a>x)-(y)"))) == "y\\ $x"
    assert one(spark, tx.strip(F.lit("  a b\t　"))) == "a b"
    assert one(spark, tx.title(F.lit("o'neil mc-x 3rd élan"))) == "O'Neil Mc-X 3Rd Élan"
    with pytest.raises(tx.PatternError):
        tx.java("(")
