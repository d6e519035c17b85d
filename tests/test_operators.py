"""Each operator on small tables with nulls, empty texts, Unicode and no rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from tabloom.operators import OPERATORS, Context, OperatorError, apply, get, register_op
from tabloom.position import POS, filled, numbered, with_position


def table(spark, schema, *rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, {POS} long")
    return df


def got(df, *cols):
    cols = cols or [c for c in df.columns if c != POS]
    order = [POS] if POS in df.columns else []
    return [tuple(r[c] for c in cols) for r in (df.orderBy(*order) if order else df).collect()]


def test_all_are_there():
    assert len(OPERATORS) >= 43
    assert get("project").name == "select" and get("filter").name == "filter_rows" and get("os") is None


def test_names(spark):
    df = table(spark, "`A b` string, `c!` string", ("1", "2"))
    assert apply(df, "clean_column_names").columns == ["a_b", "c", POS]
    assert apply(df, "rename", col_map={"a B": "x", "c!": "A b"}).columns == ["x", "A b", POS]
    assert apply(df, "rename", mapping={"A": "x"}, resolver="fuzzy").columns[0] == "x"
    assert apply(df, "rename", col_map={"A b": "c!"}).columns == ["c!", POS]
    assert apply(df, "select", cols=["c!", "none"], ctx=Context("lenient")).columns == ["c!", POS]
    assert apply(df, "select", cols=["none"], ctx=Context("lenient")).columns == df.columns
    assert apply(df, "select", cols=["c!"], action="drop").columns == ["A b", POS]
    with pytest.raises(OperatorError):
        apply(df, "select", cols=["none"])
    assert got(apply(df, "add_row_id")) == [(1, "1", "2")]
    assert got(apply(df, "keep_raw_snapshot", sidecar_cols={"A b": "c!"})) == [("1", "1")]
    assert got(apply(df, "keep_raw_snapshot", sidecar_cols=[{"A b": "c!"}, "c!"])) == [("1", "2", "2")]
    assert got(apply(df, "copy_and_replace", col="A b", out="k", replacements={"1": "one"}), "k") == [("one",)]
    assert got(apply(df, "derive_columns", columns_map={"A b": "z"}, add_constant_col={"col_name": "k", "value": 7})) == [("1", "2", 7)]


def test_text(spark):
    df = table(spark, "a string, b string", (" x  Y ", None), (None, "q"))
    assert got(apply(df, "trim_whitespace", cols=["a"], out="t"), "t") == [("x  Y",), (None,)]
    assert got(apply(df, "sanitize_text", col="a", case="lower"), "a_normalized") == [(" x y ",), (None,)]
    assert got(apply(df, "clean_text", col="a", operations=["strip", "upper", "none"]), "a") == [("X  Y",), (None,)]
    assert got(apply(df, "combine_columns", cols=["a", "b"], out="c", sep="-"), "c") == [(" x  Y ",), ("q",)]
    assert got(apply(df, "combine_columns", cols=["a", "b"], out="c", sep="-", null_policy="text"), "c")[1] == ("nan-q",)
    assert got(apply(df, "combine_columns", cols=["none"], out="c"), "c") == [("",), ("",)]
    assert got(apply(df, "replace_string", col=["a", "b"], pattern=r"[a-z]", replacement="$"), "a", "b") == [(" $  Y ", None), (None, "$")]


def test_regex(spark):
    df = table(spark, "s string", ("1,234 of 5",), ("none",), (None,))
    assert got(apply(df, "extract_regex", col="s", pattern=r"(\d+) of (\d+)", out_groups=["a", "b"]), "a", "b") == [("234", "5"), (None, None), (None, None)]
    assert got(apply(df, "extract_regex", col="s", pattern=r"(\d+) of (\d+)", out_groups=["a", "b"], mode="best"), "a", "b") == [("1,234", "5"), (None, None), (None, None)]
    assert got(apply(df, "extract_regex", col="s", pattern="(zzz)", out_groups=["a"], mode="best"), "a") == [("1,234 of 5",), ("none",), (None,)]
    assert got(apply(df, "extract_regex", column="s", patterns=[{"regex": r"(\d),", "out_col": "a", "type": "int", "default": 0}]), "a") == [(1,), (0,), (0,)]
    dms = table(spark, "c string", ("40°26′46″N 79°58′56″W",), ("1°2'3\"S / 4°5'E",))
    eight = ["lat_deg", "lat_min", "lat_sec", "lat_dir", "lon_deg", "lon_min", "lon_sec", "lon_dir"]
    assert got(apply(dms.limit(1), "extract_regex", col="c", pattern="(x)", out_groups=eight, mode="best"), *eight) == [("40", "26", "46", "N", "79", "58", "56", "W")]
    assert got(apply(dms.offset(1), "extract_regex", col="c", pattern="(x)", out_groups=eight, mode="best"), *eight) == [("1", "2", "3", "S", "4", "5", "1°2'3\"S / 4°5'E", "E")]
    four = table(spark, "c string", ("40.5°N  79.25°W",), ("none",))
    assert got(apply(four, "extract_regex", col="c", pattern="(x)", out_groups=["lat", "ns", "lon", "ew"], mode="best"), "lat", "ns", "lon", "ew") == [("40.5", "N", "79.25", "W"), (None,) * 4]
    # four groups for two outputs: none is told which, so each is the source
    assert got(apply(four, "extract_regex", col="c", pattern="(x)", out_groups=["lat", "lon"], mode="best"), "lat", "lon") == [("40.5°N  79.25°W",) * 2, ("none",) * 2]
    # names that only hold such a word are no coordinates
    assert got(apply(table(spark, "c string", ("1.5, 2.5 A7 B8",)), "extract_regex", col="c", pattern=r"A(\d) B(\d)", out_groups=["plate", "slate"], mode="best"), "plate", "slate") == [("7", "8")]
    votes = table(spark, "c string", ("46,153 votes",), ("12 votes",))
    assert got(apply(votes, "extract_regex", col="c", pattern="(x)", out_groups=["votes"], mode="best"), "votes") == [("46,153",), ("12",)]
    ends = table(spark, "c string", ("46,153–14,747",), ("5 - 7",))
    assert got(apply(ends, "extract_regex", col="c", pattern="(x)", out_groups=["yes", "no"], mode="best"), "yes", "no") == [("46,153", "14,747"), (None, None)]
    named = table(spark, "c string", ("a1b2",))
    assert got(apply(named, "extract_regex", col="c", pattern="(?P<m>[0-9])b(?P<n>[0-9])", out_groups=["n", "z"], mode="best"), "n", "z") == [("2", "a1b2")]
    assert got(apply(df, "parse_pattern", col="s", pattern=r"of (\d)", output_cols=["n", "m"], type_map={"n": "float"}), "n", "m")[0] == (5.0, None)
    assert got(apply(df, "extract_structured_data", col="s", out_cols=["a"], patterns=["of"]), "a") == [(None,)] * 3
    assert apply(df, "extract_structured_data", col="s", out_cols=["a"], patterns=[], ctx=Context("lenient")).columns == df.columns
    assert got(apply(df, "extract_and_flag", col="s", pattern="of (.)", out_extracted="e", out_flag="f"), "e", "f") == [("5", True), (None, False), (None, False)]
    assert got(apply(df, "extract_and_flag", col="s", pattern="of", out_extracted="e", out_flag="f"), "e", "f")[0] == (None, False)


def test_numbers(spark):
    df = table(spark, "s string", (" $1,234.50 ",), ("12 %",), ("54.43 m",), ("$10%",), (None,), ("-3",))
    assert got(apply(df, "parse_number", col="s", out_value="v", out_unit="u"), "v", "u") == [(1234.5, "$"), (12.0, "%"), (None, None), (10.0, "$"), (None, None), (-3.0, None)]
    assert got(apply(df, "parse_number", col="s", out_value="v", pattern=r"(\d+)"), "v") == [(1234.0,), (12.0,), (54.0,), (10.0,), (None,), (3.0,)]
    assert got(apply(df, "parse_number", cols=["s"], out_value_suffix="_n"), "s_n")[1] == (12.0,)
    df = table(spark, "a string, n long", ("x", 1), ("y", 2), (None, None))
    assert got(apply(df, "map_values", col="a", mapping={"x": "X", "y": None}), "a") == [("X",), ("y",), (None,)]
    assert got(apply(df, "map_values", col="n", mapping={"1": 10}), "n") == [(10,), (2,), (None,)]
    assert got(apply(df, "replace_value", col="a", mapping={"x": "y", "y": "z"}), "a") == [("z",), ("z",), (None,)]
    assert got(apply(df, "replace_value", col="n", old=1, new=5, out="m"), "m") == [(5,), (2,), (None,)]
    assert got(apply(df, "replace_value", col="a", old_value=None, new_value="none"), "a") == [("x",), ("y",), ("none",)]
    df = table(spark, "s string", ("1",), ("1.5",), ("False",), ("",), (None,))
    assert got(apply(df, "cast_column", col="s", dtype="int"), "s") == [(1,), (None,), (None,), (None,), (None,)]
    assert got(apply(df, "cast_column", col="s", dtype="bool"), "s") == [(True,), (None,), (False,), (False,), (None,)]
    assert got(apply(df, "cast_column", col="s", dtype="bool", python_truthiness=True), "s") == [(True,), (True,), (True,), (False,), (False,)]
    assert apply(df, "cast_column", col="s", dtype="decimal", ctx=Context("lenient")).schema["s"].dataType.simpleString() == "string"
    df = table(spark, "x double", (0.0,), (1.0,), (2.0,), (9.0,), (None,))
    assert got(apply(df, "bin_numeric", col="x", bins=[0, 1, 2], labels=["a", "b"], out="b"), "b") == [("a",), ("a",), ("b",), (None,), (None,)]
    assert got(apply(df, "bin_numeric", col="x", bins=3, labels=["a", "b", "c"], out="b"), "b") == [("a",), ("a",), ("a",), ("c",), (None,)]
    df = table(spark, "k string", ("b",), ("a",), (None,))
    out = apply(df, "one_hot", col="k")
    assert out.columns == ["k", POS, "k_a", "k_b"] and got(out, "k_a", "k_b") == [(False, True), (True, False), (False, False)]
    assert got(apply(df, "derive_math", out="x", expr="nothing + 1", ctx=Context("lenient")), "x") == [(None,)] * 3


def test_dates(spark):
    d = datetime.datetime
    df = table(spark, "s string", ("September 11, 2001",), ("11 Sept 2001 (age 32)",), ("1/2/2003",), ("2004-05-06",), ("March 3",), ("none",), (None,), ("May 2nd, 1999; 22 years ago",))
    out = apply(df, "parse_date_text", col="s", out_date="d", out_parts=["year", "month_num", "day_of_week"])
    assert got(out, "d") == [(d(2001, 9, 11),), (d(2001, 9, 11),), (d(2003, 1, 2),), (d(2004, 5, 6),), (None,), (None,), (None,), (d(1999, 5, 2),)]
    assert got(out, "s_year", "s_month_num", "s_day_of_week")[0] == (2001, 9, "Tuesday")
    assert got(apply(df, "parse_date_text", col="s", out="d", infer_year=True), "d")[4] == (d(2001, 3, 3),)
    assert got(apply(df, "parse_date_text", col="s", out="d", default_year=1980), "d")[4] == (d(1980, 3, 3),)
    assert got(apply(df, "parse_date_text", col="s", out="d", default_year=1980), "d")[0] == (d(1980, 9, 11),)
    df = table(spark, "s string", ("1999/00",), ("1994/1995",), ("2001",), (None,))
    assert got(apply(df, "expand_year_range", col="s"), "year") == [("1999",), ("1900",), ("1994",), ("1995",), ("2001",), (None,)]


def test_conditional(spark):
    df = table(spark, "n long, s string", (1, "a"), (5, "b"), (None, None))
    cases = [{"if": "n > 0", "then": "some"}, {"if": "n > 4", "then": "many"}]
    assert got(apply(df, "derive_conditional", out="x", cases=cases, default="none"), "x") == [("some",), ("many",), ("none",)]
    assert got(apply(df, "derive_conditional", out="x", conditions=[{"condition": "n > 4", "value": 1}], default="s"), "x") == [("a",), ("1",), (None,)]
    assert got(apply(df, "derive_conditional", out="x", conditions=[{"if": "n > 4", "then": True}], default=False), "x") == [(False,), (True,), (False,)]
    assert got(apply(df, "derive_conditional", out="x", conditions=[{"if": "bad > 4", "then": True}], default=False, ctx=Context("lenient")), "x") == [(False,)] * 3
    assert got(apply(df, "filter_rows", condition="s != 'a'"), "n") == [(5,), (None,)]
    assert got(apply(df, "filter_rows", exclude="n > 0"), "n") == [(None,)]
    assert len(got(apply(df, "filter_rows", condition="oops ==", ctx=Context("lenient")))) == 3


def test_reshape(spark):
    df = table(spark, "k long, s string", (1, "a, b and c"), (2, ""), (3, None))
    out = apply(df, "split_multi_value", col="s", separators=[",", " and "], value_out="v", order_out="o", count_out="n")
    assert sorted(got(out, "k", "v", "o", "n"), key=str) == sorted([(1, "a", 1, 3), (1, "b", 2, 3), (1, "c", 3, 3), (2, "", 1, 1), (3, None, None, 0)], key=str)
    assert got(apply(df, "split_multi_value", col="s", value_out="v", explode=False), "v") == [(["a", "b and c"],), ([""],), (None,)]
    assert got(apply(df, "explode_entities", col="s", pattern=r",\s*|\sand\s", out="e"), "k", "e")[:3] == [(1, "a"), (1, "b"), (1, "c")]
    lists = apply(df, "explode_entities", col="s", sep=",", out="e", explode=False)
    assert got(apply(lists, "explode_column", col="e"), "k", "e") == [(1, "a"), (1, "b and c"), (2, ""), (3, None)]
    assert apply(df, "explode_column", col="s").columns == df.columns
    wide = apply(spark.createDataFrame([(1, "x", 5), (1, "y", 6), (2, "x", 7)], "k long, n string, v long"), "pivot_wider", index="k", names_from="n", values_from="v")
    assert sorted(got(wide)) == [(1, 5, 6), (2, 7, None)]
    with pytest.raises(OperatorError):
        apply(spark.createDataFrame([(1, "x", 5), (1, "x", 6)], "k long, n string, v long"), "pivot_wider", index="k", names_from="n", values_from="v")
    long = apply(wide, "pivot_longer", cols=["x", "y"], index=["k"], names_to="n", values_to="v")
    assert sorted(got(long), key=str) == sorted([(1, "x", 5), (1, "y", 6), (2, "x", 7), (2, "y", None)], key=str)
    out = apply(df, "union_tables", tables_to_union=["a", "b"], all_steps=[{"step_id": "a", "writes": ["k"]}, {"step_id": "b", "writes": ["s"]}], column_mapping={"s": "t"})
    assert out.columns == ["k", "t"] and out.count() == 6


def test_missing(spark):
    df = table(spark, "n double, s string", (None, " "), (2.0, "a"), (None, None), (4.0, "a"), (6.0, "b"))
    assert got(apply(df, "fillna_static", col=["n"], value=0), "n")[0] == (0.0,)
    assert got(apply(df, "fillna_static", col="s", value=None), "s")[2] == (None,)
    assert got(apply(df, "fillna_dynamic", col="n", method="median"), "n") == [(4.0,), (2.0,), (4.0,), (4.0,), (6.0,)]
    assert got(apply(df, "fillna_dynamic", col="s", method="mode"), "s")[2] == ("a",)
    assert got(apply(df, "fillna_dynamic", col="n", method="bfill"), "n") == [(2.0,), (2.0,), (4.0,), (4.0,), (6.0,)]
    assert got(apply(df, "forward_fill", col="s"), "s") == [(None,), ("a",), ("a",), ("a",), ("b",)]
    assert got(apply(df, "fill_down", col="s"), "s") == [(" ",), ("a",), ("a",), ("a",), ("b",)]
    df = table(spark, "k long, v long", (1, 1), (None, 2), (1, 3), (None, 4), (5, 5))
    assert got(apply(df, "deduplicate_rows", keys=["k"]), "v") == [(1,), (2,), (5,)]
    assert got(apply(df, "deduplicate_rows", subset="k", keep="last"), "v") == [(3,), (4,), (5,)]
    assert got(apply(df, "deduplicate_rows", keys=["k"], keep=False), "v") == [(5,)]
    assert got(apply(df, "sort", by="k", ascending=False), "v") == [(5,), (1,), (3,), (2,), (4,)]
    assert got(apply(df, "sort", by=["k", "v"], ascending=[True, False]), "v") == [(3,), (1,), (5,), (4,), (2,)]


def test_large_tables_are_ordered_by_bucket(spark):
    df = spark.range(0, 50, 1, 5).select(F.col("id").alias("v"), (F.col("id") * (1 << 18) + 7).alias(POS)).withColumn("x", F.when(F.col("v") % 9 == 4, F.col("v")))
    assert [r.n for r in numbered(df, "n", small=0).orderBy("v").collect()] == list(range(1, 51))
    for back in (False, True):
        a = [r.x for r in filled(df, {"x": F.col("x")}, backward=back, small=0).orderBy("v").collect()]
        b = [r.x for r in filled(df, {"x": F.col("x")}, backward=back).orderBy("v").collect()]
        assert a == b
    assert [r.v for r in with_position(df, ["v"]).orderBy(POS).collect()] == list(range(50))


def test_domain(spark):
    df = table(spark, "s string, o string", ("6-4 3–6 7-6(3)", "Winner"), ("RET", "x"), (None, "x"), ("none", "x"), ("6-0, 6-1", "x"))
    out = apply(df, "parse_tennis_score", score_col="s", outcome_col="o", writes=["is_default_score", "total_sets_played", "player_sets_won", "opponent_sets_won", "total_games_played", "player_won_first_set", "player_won_in_straight_sets", "other"])
    assert got(out)[0][2:] == (False, 3, 2, 1, 32, True, False, None)
    assert got(out)[1][2:] == (True, None, None, None, None, None, None, None)
    assert got(out)[2][2:4] == (None, None) and got(out)[3][2:4] == (False, None) and got(out)[4][8] is True
    df = table(spark, "n long, s string", *[(n, "born 1 May 1990 (age 30)") for n in (-1, 0, 1, 2, 3, 4, 25, 29, 49, 97, 7919, None)])
    assert [x[0] for x in got(apply(df, "custom", name="is_prime_number", col="n", out="p"), "p")] == [False, False, False, True, True, False, False, True, False, True, True, None]
    out = apply(df, "custom", name="extract_birth_date_and_age", col="s", date_pattern=r"born (.+?) \(", age_pattern=r"age (\d+)", writes=["d", "a"])
    assert got(out, "d", "a")[0] == ("1 May 1990", "30")
    assert got(apply(df, "custom", name="extract_regex_groups", col="s", pattern=r"(?P<d>\d+)", writes=["d", "none"]), "d", "none")[0] == ("1", None)
    ctx = Context("lenient")
    assert got(apply(df, "custom", ctx=ctx, code_hint="df['x'] = 1", writes=["x"]), "x")[0] == (None,) and ctx.notes
    assert got(apply(df, "custom", description="lowercase and trim", reads=["s"], writes=["x"]), "x")[0] == ("born 1 may 1990 (age 30)",)
    register_op("double_it", lambda df, col: df.withColumn(col, F.col(col) * 2))
    try:
        assert got(apply(df, "double_it", col="n"), "n")[3] == (4,)
    finally:
        del OPERATORS["double_it"]


def test_no_rows(spark):
    df = table(spark, "a string, n double")
    for name, p in (("add_row_id", {}), ("extract_regex", {"col": "a", "pattern": "(x)", "out_groups": ["o"], "mode": "best"}), ("one_hot", {"col": "a"}), ("bin_numeric", {"col": "n", "bins": 3}), ("fillna_dynamic", {"col": "n"}), ("forward_fill", {"col": "a"}), ("deduplicate_rows", {"keys": ["a"]}), ("sort", {"by": "a"}), ("parse_date_text", {"col": "a", "infer_year": True}), ("split_multi_value", {"col": "a"})):
        assert apply(df, name, **p).count() == 0, name


def test_hot_path_stays_in_the_jvm(spark):
    df = table(spark, "s string", ("$5",))
    out = apply(apply(apply(df, "parse_number", col="s", out_value="v"), "derive_conditional", out="c", conditions=[{"if": "v > 3", "then": "x"}], default="y"), "derive_math", out="m", expr="v * 2")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and plan.count("Project") <= 2
