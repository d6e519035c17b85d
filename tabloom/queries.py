"""The registered queries of the table operators, and their SQL.

The driver tables have no nulls, so queries about them make some, alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import qa
from .functions import expr
from .functions import score as sc
from .functions import text as tx
from .operators import apply
from .plans import execute
from .position import POS, filled, numbered, with_position
from .profile import has_year, issues, stats_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, read) as a query of its name, with the SQL that gives the same rows."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# names and projection


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS _row_id, n_nationkey, n_name FROM nation")
def add_row_id(spark, read):
    return apply(with_position(read("nation").select("n_nationkey", "n_name"), ["n_nationkey"]), "add_row_id").drop(POS)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS n, o_orderkey FROM orders")
def row_numbers_by_bucket(spark, read):
    """The numbering that large tables get, range of positions by range of positions."""
    df = read("orders").select("o_orderkey", F.col("o_orderkey").alias(POS))
    return numbered(df, "n", small=0).drop(POS)


@query("SELECT c_mktsegment AS segment, c_name AS name, c_custkey AS id FROM customer")
def rename_select_reorder(spark, read):
    df = apply(read("customer"), "rename", col_map={"C_NAME": "name", "c_mktsegment": "segment"}, resolver="fuzzy")
    df = apply(df, "rename", mapping={"c_custkey": "id"})
    return apply(apply(df, "select", cols=["id", "name", "segment", "c_acctbal"]), "reorder_columns", order=["segment", "name", "id"])


@query("SELECT r_regionkey, r_name AS r_name_1, r_regionkey AS r_name FROM region")
def clean_column_names(spark, read):
    r = read("region")
    return apply(r.select("r_regionkey", F.col("r_regionkey").alias(" R  Name"), F.col("r_name").alias("R Name!")), "clean_column_names")


@query("SELECT r_regionkey, r_name AS region, 'x' AS source, CASE WHEN r_name = 'ASIA' THEN 'A' WHEN r_name = 'EUROPE' THEN 'E' ELSE r_name END AS short, r_name AS region_raw FROM region")
def derive_copy_snapshot(spark, read):
    df = apply(read("region"), "derive_columns", columns_map={"r_name": "region", "none": "x"}, add_constant_col={"col_name": "source", "value": "x"})
    df = apply(df, "copy_and_replace", col="region", out="short", replacements={"ASIA": "A", "EUROPE": "E"})
    return apply(df, "keep_raw_snapshot", sidecar_cols=["region"])


# text


@query("SELECT p_partkey, p_name AS trimmed, upper(p_name) AS p_upper, lower(p_type) AS cleaned FROM part")
def trim_sanitize_clean(spark, read):
    p = read("part")
    df = p.select("p_partkey", F.concat(F.lit(" \t"), "p_name", F.lit("\u00a0\n")).alias("trimmed"), F.regexp_replace("p_name", " ", "  ").alias("p_upper"), F.concat("p_type", F.lit("  ")).alias("cleaned"))
    df = apply(df, "trim_whitespace", cols=["trimmed"])
    df = apply(df, "sanitize_text", cols=["p_upper"], case="upper")
    return apply(df, "clean_text", col="cleaned", operations=["strip", "lower"])


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || '-X 3Rd' AS t FROM part")
def title_case(spark, read):
    return apply(read("part").select("p_partkey", F.concat("p_name", F.lit("-x 3rd")).alias("t")), "sanitize_text", cols=["t"], case="title")


@query("SELECT n_nationkey, n_name || ' / ' || n_regionkey AS both, coalesce(nullif(n_name, 'FRANCE'), 'nan') || '|' || n_regionkey AS as_text FROM nation")
def combine_columns(spark, read):
    df = apply(read("nation"), "combine_columns", cols=["n_name", "n_regionkey", "none"], out="both", sep=" / ")
    df = df.withColumn("n_name", F.nullif("n_name", F.lit("FRANCE")))
    return apply(df, "combine_columns", cols=["n_name", "n_regionkey"], out="as_text", sep="|", null_policy="text").select("n_nationkey", "both", "as_text")


@query("SELECT o_orderkey, regexp_replace(o_orderpriority, '(\\d)-(.+)', '\\2 (\\1)', 'g') AS p, replace(o_orderpriority, '-', '$1') AS plain FROM orders")
def replace_string(spark, read):
    df = read("orders").select("o_orderkey", "o_orderpriority")
    df = apply(df, "replace_string", col="o_orderpriority", pattern=r"(?P<n>\d)-(.+)", replacement=r"\2 (\g<n>)", out="p")
    return apply(df, "replace_string", col="o_orderpriority", pattern="-", replacement="$1", regex=False, out="plain").drop("o_orderpriority")


@query(
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus IN ('O', 'F') THEN 'C' ELSE o_orderstatus END AS chained,"
    " CASE WHEN o_orderpriority = '5-LOW' THEN 'LOW' ELSE o_orderpriority END AS one FROM orders"
)
def map_and_replace_values(spark, read):
    df = read("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    df = apply(df, "map_values", col="o_orderstatus", mapping={"O": "open", "F": "done", "P": None}, out="status")
    df = apply(df, "replace_value", col="o_orderstatus", mapping={"O": "F", "F": "C"}, out="chained")
    return apply(df, "replace_value", col="o_orderpriority", old_value="5-LOW", new_value="LOW", out="one").drop("o_orderstatus", "o_orderpriority")


@query("SELECT p_partkey, 'name of ' || p_partkey AS p_name FROM part")
def map_values_large(spark, read):
    """A mapping too large for an expression is joined."""
    df = read("part").select("p_partkey", F.col("p_partkey").cast("string").alias("p_name"))
    n = read("part").count()
    return apply(df, "map_values", col="p_name", mapping={str(i): f"name of {i}" for i in range(n + 10)})


# regular expressions


@query("SELECT o_orderkey, nullif(regexp_extract(o_orderpriority, '^(\\d)-(.+)$', 1), '') AS num, nullif(regexp_extract(o_orderpriority, '^(\\d)-(.+)$', 2), '') AS name FROM orders")
def extract_regex(spark, read):
    df = read("orders").select("o_orderkey", "o_orderpriority")
    return apply(df, "extract_regex", col="o_orderpriority", pattern=r"^(\d)-(.+)$", out_groups=["num", "name"]).drop("o_orderpriority")


@query(
    "SELECT p_partkey, regexp_extract(p_brand, '#(\\d)', 1)::BIGINT AS brand, CASE WHEN regexp_matches(p_name, '^small (\\w+)') THEN regexp_extract(p_name, '^small (\\w+)', 1) ELSE 'none' END AS small,"
    " nullif(regexp_extract(p_brand, '#(\\d+)', 1), '') AS p_brand_extracted, nullif(regexp_extract(p_type, '#(\\d+)', 1), '') AS p_type_extracted FROM part"
)
def extract_regex_modes(spark, read):
    df = read("part").select("p_partkey", "p_brand", "p_name", "p_type")
    df = apply(df, "extract_regex", col="p_brand", patterns=[{"regex": r"#(\d)", "out_col": "brand", "type": "int"}])
    df = apply(df, "extract_regex", col="p_name", patterns=[{"regex": r"^small (\w+)", "out_col": "small", "default": "none"}])
    df = apply(df, "extract_regex", col=["p_brand", "p_type"], pattern=r"#(\d+)")
    return df.drop("p_brand", "p_name", "p_type")


@query("SELECT event_id, '1,' || user_id AS first, event_id::VARCHAR AS second FROM events")
def extract_regex_best(spark, read):
    """The attempt that most rows match: digits with commas among them."""
    df = read("events").select("event_id", F.concat(F.lit("1,"), "user_id", F.lit(" of "), "event_id").alias("s"))
    return apply(df, "extract_regex", col="s", pattern=r"(\d+) of (\d+)", out_groups=["first", "second"], mode="best").drop("s")


@query("SELECT o_orderkey, format('{:,}', o_custkey * 1000 + o_orderkey % 1000) AS votes FROM orders")
def extract_regex_votes(spark, read):
    """One output for votes: the first number, with its commas."""
    df = read("orders").select("o_orderkey", F.concat(F.format_number(F.col("o_custkey") * 1000 + F.col("o_orderkey") % 1000, 0), F.lit(" votes")).alias("s"))
    return apply(df, "extract_regex", col="s", pattern="(none of this)", out_groups=["votes"], mode="best").drop("s")


@query("SELECT o_orderkey, format('{:,}', o_custkey * 1000) AS yes, o_orderkey::VARCHAR AS no FROM orders")
def extract_regex_vote_pairs(spark, read):
    df = read("orders").select("o_orderkey", F.concat(F.format_number(F.col("o_custkey") * 1000, 0), F.lit("\u2013"), "o_orderkey").alias("s"))
    return apply(df, "extract_regex", col="s", pattern="(none of this)", out_groups=["yes", "no"], mode="best").drop("s")


_DEGREES = "SELECT c_custkey, (c_custkey % 90)::VARCHAR AS lat_deg, (c_custkey % 60)::VARCHAR AS lat_min, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 59)::VARCHAR END AS lat_sec, CASE WHEN c_custkey % 2 = 0 THEN 'N' ELSE 'S' END AS lat_dir, (c_custkey % 180)::VARCHAR AS lon_deg, (c_custkey % 58)::VARCHAR AS lon_min, (c_custkey % 57)::VARCHAR AS lon_sec, 'W' AS lon_dir FROM customer"


def _coordinates(read, between: str):
    k = F.col("c_custkey")
    seconds = F.when(k % 3 > 0, F.concat(k % 59, F.lit("\u2033"))).otherwise("")
    shown = F.concat(k % 90, F.lit("\u00b0"), k % 60, F.lit("\u2032"), seconds, F.when(k % 2 == 0, "N").otherwise("S"), F.lit(between), k % 180, F.lit("\u00b0"), k % 58, F.lit("'"), k % 57, F.lit('"W'))
    names = ["lat_deg", "lat_min", "lat_sec", "lat_dir", "lon_deg", "lon_min", "lon_sec", "lon_dir"]
    return apply(read("customer").select("c_custkey", shown.alias("s")), "extract_regex", col="s", pattern="(none of this)", out_groups=names, mode="best").drop("s")


@query(_DEGREES)
def extract_regex_degrees(spark, read):
    """Eight outputs: degrees, minutes, seconds (where there are any) and directions."""
    return _coordinates(read, " ")


@query(_DEGREES)
def extract_regex_degrees_slash(spark, read):
    return _coordinates(read, " / ")


@query("SELECT c_custkey, (c_custkey % 90) || '.5' AS lat, 'S' AS ns, (c_custkey % 180)::VARCHAR AS lon, 'E' AS ew, (c_custkey % 90) || '.5\u00b0S ' || (c_custkey % 180) || '\u00b0E' AS latitude FROM customer")
def extract_regex_decimal_degrees(spark, read):
    """Four outputs take the four groups; fewer cannot tell which, and get the source."""
    k = F.col("c_custkey")
    df = read("customer").select("c_custkey", F.concat(k % 90, F.lit(".5\u00b0S "), k % 180, F.lit("\u00b0E")).alias("s"))
    df = apply(df, "extract_regex", col="s", pattern="(none of this)", out_groups=["lat", "ns", "lon", "ew"], mode="best")
    return apply(df, "extract_regex", col="s", pattern="(none of this)", out_groups=["latitude"], mode="best").drop("s")


@query("SELECT c_custkey, nullif(regexp_extract(c_name, '(\\w+)#0*(\\d+)', 1), '') AS kind, regexp_extract(c_name, '(\\w+)#0*(\\d+)', 2)::BIGINT AS num, nullif(regexp_extract(c_name, '#(\\d+)', 1), '') AS digits, regexp_extract(c_name, '(\\d)$', 1) AS last, regexp_matches(c_name, '(7)$') AS seven FROM customer")
def parse_pattern_structured_flag(spark, read):
    df = read("customer").select("c_custkey", "c_name")
    df = apply(df, "parse_pattern", col="c_name", pattern=r"(\w+)#0*(\d+)", output_cols=["kind", "num"], type_map={"num": "int"})
    df = apply(df, "extract_structured_data", col="c_name", out_cols=["digits"], patterns=[r"#(\d+)"])
    df = apply(df, "extract_pattern", col="c_name", pattern=r"(\d)$", capture_groups=["last"])
    return apply(df, "extract_and_flag", col="c_name", pattern="(7)$", out_extracted="e", out_flag="seven").drop("c_name", "e")


# numbers


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE round(value, 2) END AS v, CASE event_id % 4 WHEN 0 THEN '$' WHEN 1 THEN '%' END AS u FROM events"
)
def parse_number(spark, read):
    v = F.round("value", 2)
    shown = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" $"), F.format_number(v, 2))).when(F.col("event_id") % 4 == 1, F.concat(v.cast("decimal(20,2)").cast("string"), F.lit("%"))).when(F.col("event_id") % 4 == 2, v.cast("decimal(20,2)").cast("string")).otherwise(F.concat(v.cast("string"), F.lit(" m")))
    df = read("events").select("event_id", shown.alias("s"))
    return apply(df, "parse_number", col="s", out_value="v", out_unit="u").drop("s")


@query("SELECT event_id, regexp_extract(props, '(\\d+)', 1)::BIGINT AS k, CASE WHEN value = floor(value) THEN value::BIGINT END AS whole, event_id::VARCHAR AS t, event_id % 2 = 1 AS b FROM events")
def cast_column(spark, read):
    df = read("events").select("event_id", F.regexp_extract("props", r"(\d+)", 1).alias("k"), F.col("value").alias("whole"), F.when(F.col("event_id") % 2 == 1, "Yes").otherwise("no").alias("b"))
    df = apply(apply(df, "cast_column", col="k", dtype="integer"), "cast_column", col="whole", dtype="int")
    return apply(apply(df, "cast_column", col="event_id", dtype="string", out="t"), "cast_column", col="b", dtype="boolean")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) / l_quantity AS unit, (l_partkey % 7)::DOUBLE AS m, year(l_shipdate)::DOUBLE AS y, (isodow(l_shipdate) - 1)::DOUBLE AS w, length(l_returnflag)::DOUBLE AS n, l_quantity ** 2 > 400 AS big FROM lineitem"
)
def derive_math(spark, read):
    df = read("lineitem")
    for out, e in (("unit", "l_extendedprice * (1 - l_discount) / l_quantity"), ("m", "l_partkey % 7"), ("y", "year(l_shipdate)"), ("w", "weekday(l_shipdate)"), ("n", "len(l_returnflag)"), ("big", "l_quantity ** 2 > 400")):
        df = apply(df, "derive_math", out=out, expr=e)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "unit", "m", "y", "w", "n", "big")


@query("SELECT p_partkey, CASE WHEN p_size >= 1 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 30 THEN 'mid' WHEN p_size > 30 AND p_size <= 40 THEN 'large' END AS bin FROM part")
def bin_numeric(spark, read):
    return apply(read("part").select("p_partkey", "p_size"), "bin_numeric", col="p_size", bins=[1, 10, 30, 40], labels=["small", "mid", "large"], out="bin").drop("p_size")


@query("WITH r AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, 'b' || (CASE WHEN p_retailprice <= lo THEN 0 ELSE least(ceil((p_retailprice - lo) / ((hi - lo) / 4)) - 1, 3) END)::INT AS bin FROM part, r")
def bin_numeric_equal_width(spark, read):
    """As many bins of equal width as are asked for, between the least and the greatest value."""
    return apply(read("part").select("p_partkey", "p_retailprice"), "bin_numeric", col="p_retailprice", bins=4, labels=["b0", "b1", "b2", "b3"], out="bin").drop("p_retailprice")


@query("SELECT o_orderkey, o_orderstatus = 'F' AS s_F, o_orderstatus = 'O' AS s_O, o_orderstatus = 'P' AS s_P FROM orders")
def one_hot(spark, read):
    df = apply(read("orders").select("o_orderkey", "o_orderstatus"), "one_hot", col="o_orderstatus", prefix="s")
    for x in "FOP":  # a value no row has has no column
        df = df if f"s_{x}" in df.columns else df.withColumn(f"s_{x}", F.lit(False))
    return df.select("o_orderkey", "s_F", "s_O", "s_P")


# dates


@query("SELECT o_orderkey, date_trunc('day', o_orderdate) AS d, year(o_orderdate) AS s_year, month(o_orderdate) AS s_month, day(o_orderdate) AS s_day, dayname(o_orderdate) AS s_day_of_week FROM orders")
def parse_date_text(spark, read):
    """Three ways to write a date, one of them with an age behind."""
    d = F.col("o_orderdate")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "MMMM d, yyyy")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.date_format(d, "d MMM yyyy"), F.lit(" (age 30)"))).otherwise(F.date_format(d, "yyyy-MM-dd"))
    df = read("orders").select("o_orderkey", shown.alias("s"))
    return apply(df, "parse_date_text", col="s", formats=["%B %d, %Y"], out_date="d", out_parts=["year", "month", "day", "day_of_week"]).drop("s")


@query("SELECT o_orderkey, CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL ELSE make_timestamp(1990, month(o_orderdate), day(o_orderdate), 0, 0, 0.0) END AS d FROM orders")
def parse_date_default_year(spark, read):
    """All orders; a day that the default year lacks is null."""
    df = read("orders").select("o_orderkey", F.date_format("o_orderdate", "MMMM d").alias("s"))
    return apply(df, "parse_date_text", col="s", out_date="d", default_year=1990).drop("s")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL WHEN o_orderkey % 2 = 0 THEN make_timestamp(CASE WHEN o_orderkey % 4 = 0 THEN 1955 ELSE 1990 END, month(o_orderdate), day(o_orderdate), 0, 0, 0.0) WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL ELSE make_timestamp(1990, month(o_orderdate), day(o_orderdate), 0, 0, 0.0) END AS d FROM orders")
def parse_date_infer_year(spark, read):
    """Dates without a year take the year of another text of their row, else the commonest of their column."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    day = F.date_format(d, "MMMM d")
    own = F.when(k % 2 == 0, day).when(day == "February 29", "none").otherwise(F.concat(day, F.lit(", 1990")))
    df = read("orders").select("o_orderkey", own.alias("s"), F.when(k % 4 == 0, "season of 1955").alias("note"))
    return apply(df, "parse_date_text", col="s", out_date="d", infer_year=True).drop("s", "note")


@query("SELECT o_orderkey, unnest(CASE o_orderkey % 4 WHEN 0 THEN [year(o_orderdate)::VARCHAR, (year(o_orderdate) // 100 * 100 + (year(o_orderdate) + 1) % 100)::VARCHAR] WHEN 2 THEN [year(o_orderdate)::VARCHAR, (year(o_orderdate) + 1)::VARCHAR] ELSE [year(o_orderdate)::VARCHAR] END) AS season FROM orders")
def expand_year_range(spark, read):
    y = F.year("o_orderdate")
    s = F.when(F.col("o_orderkey") % 4 == 0, F.concat(y, F.lit("/"), F.substring((y + 1).cast("string"), 3, 2))).when(F.col("o_orderkey") % 4 == 2, F.concat(y, F.lit("/"), y + 1)).otherwise(y.cast("string"))
    return apply(read("orders").select("o_orderkey", s.alias("s")), "expand_year_range", col="s", out="season").drop("s")


# conditions


@query(
    "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%urgent%' OR o_orderpriority ILIKE '%high%' THEN 'fast' WHEN o_totalprice > 150000 AND NOT o_orderstatus = 'F' THEN 'rich' ELSE 'plain' END AS c,"
    " CASE WHEN o_orderstatus IN ('O', 'P') THEN o_totalprice ELSE 0 END AS open_value FROM orders"
)
def derive_conditional(spark, read):
    cases = [{"if": "o_totalprice > 150000 and not o_orderstatus = 'F'", "then": "rich"}, {"condition": "o_orderpriority contains 'high'", "value": "fast"}]
    df = apply(read("orders"), "derive_conditional", out="c", conditions=cases, default="plain")
    return apply(df, "derive_conditional", out="open_value", cases=[{"if": "o_orderstatus in ['O', 'P']", "then": "o_totalprice"}], default=0).select("o_orderkey", "c", "open_value")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'blank' WHEN contains(p_name, 'ring') THEN 'ring' ELSE 'other' END AS c FROM part")
def derive_conditional_forms(spark, read):
    """Cases in the words of plans: emptiness, and tests as of a data frame's text column."""
    df = read("part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).otherwise(" ").alias("label"))
    cases = [{"if": "label.str.contains('ring', na=False)", "then": "ring"}, {"if": "label is empty", "then": "blank"}]
    return apply(df, "derive_conditional", out="c", conditions=cases, default="other").drop("label")


@query("SELECT o_orderkey, (o_orderstatus = 'F' AND (o_totalprice > 100000 OR o_custkey < 50)) AS f FROM orders")
def condition_or_first(spark, read):
    """The precedence in which ``or`` binds tighter than ``and``."""
    df = read("orders")
    return df.select("o_orderkey", expr.condition(df, "o_orderstatus == 'F' and o_totalprice > 100000 or o_custkey < 50", "or_first").alias("f"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20.5 AND l_returnflag <> 'N' AND NOT (l_linestatus = 'O' AND l_discount > 0.05)")
def filter_rows(spark, read):
    df = apply(read("lineitem"), "filter_rows", condition="l_quantity >= 10 and l_quantity <= 20.5 and l_returnflag != 'N'", exclude="l_linestatus == 'O' & l_discount > 0.05")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# cells, shapes, unions


@query("SELECT p_partkey, w AS word, i AS place, n FROM (SELECT p_partkey, unnest(l) AS w, generate_subscripts(l, 1) AS i, len(l) AS n FROM (SELECT p_partkey, string_split_regex(p_name || '; x,' || p_type, ' |; |,') AS l FROM part))")
def split_multi_value(spark, read):
    df = read("part").select("p_partkey", F.concat("p_name", F.lit("; x,"), "p_type").alias("s"))
    return apply(df, "split_multi_value", col="s", separators=["; ", " ", ","], value_out="word", order_out="place", count_out="n").select("p_partkey", "word", F.col("place").cast("long").alias("place"), F.col("n").cast("long").alias("n"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS e FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 5 = 0")
def explode_entities(spark, read):
    df = read("part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("s"))
    df = apply(df, "explode_entities", col="s", pattern=r"\s+", out="e", explode=False)
    return apply(df.drop("s"), "explode_column", col="e")


@query("SELECT year(o_orderdate) AS y, sum(CASE WHEN o_orderstatus = 'F' THEN 1 END)::BIGINT AS F, sum(CASE WHEN o_orderstatus = 'O' THEN 1 END)::BIGINT AS O, sum(CASE WHEN o_orderstatus = 'P' THEN 1 END)::BIGINT AS P FROM orders GROUP BY 1")
def pivot_wider(spark, read):
    df = read("orders").groupBy(F.year("o_orderdate").alias("y"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return apply(df, "pivot_wider", index=["y"], names_from="o_orderstatus", values_from="n")


@query("SELECT s_suppkey, 'nation' AS what, s_nationkey::DOUBLE AS v FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier")
def pivot_longer(spark, read):
    df = read("supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), "s_name")
    return apply(df, "pivot_longer", id_vars=["s_suppkey"], cols=["nation", "balance"], names_to="what", values_to="v")


@query("SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT NULL, c_mktsegment, c_acctbal FROM customer")
def union_tables(spark, read):
    steps = [{"step_id": "a", "writes": ["c_custkey", "c_name"]}, {"step_id": "b", "writes": ["c_mktsegment", "c_acctbal"]}]
    return apply(read("customer"), "union_tables", tables_to_union=["a", "b"], column_mapping={"c_custkey": "id", "c_name": "name", "c_mktsegment": "name", "c_acctbal": "balance"}, all_steps=steps)


# missing values, repeats, order

_HOLES = "SELECT event_id, user_id, CASE WHEN event_id % 7 < 3 THEN NULL ELSE value END AS v, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS t FROM events"


def _holes(read):
    return read("events").select("event_id", "user_id", F.when(F.col("event_id") % 7 >= 3, F.col("value")).alias("v"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("t"))


@query(f"WITH h AS ({_HOLES}) SELECT event_id, coalesce(v, -1) AS v, coalesce(t, 'none') AS t FROM h")
def fillna_static(spark, read):
    return apply(apply(_holes(read), "fillna_static", col="v", value=-1), "fillna_static", col="t", value="none").drop("user_id")


@query(f"WITH h AS ({_HOLES}) SELECT event_id, coalesce(v, (SELECT median(v) FROM h)) AS v, round(coalesce(v, (SELECT avg(v) FROM h)), 6) AS m, coalesce(t, (SELECT t FROM h WHERE t IS NOT NULL GROUP BY t ORDER BY count(*) DESC, t LIMIT 1)) AS t FROM h")
def fillna_dynamic(spark, read):
    df = apply(_holes(read).withColumn("m", F.col("v")), "fillna_dynamic", col="v", method="median")
    df = apply(apply(df, "fillna_dynamic", col="m", method="mean"), "fillna_dynamic", col="t", method="mode")
    return df.select("event_id", "v", F.round("m", 6).alias("m"), "t")


@query(
    f"WITH h AS ({_HOLES}) SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v, last_value(t IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS t, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM h"
)
def fill_in_order(spark, read):
    df = with_position(_holes(read).withColumn("b", F.col("v")), ["event_id"])
    df = apply(apply(df, "fill_down", col="v"), "forward_fill", col="t")
    return apply(df, "fillna_dynamic", col="b", method="bfill").drop("user_id", POS)


@query(f"WITH h AS ({_HOLES}) SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM h")
def fill_by_bucket(spark, read):
    """The fill that large tables get: what a range of positions hands on is one row."""
    df = _holes(read).select("event_id", "v", (F.col("event_id") * (1 << 14)).alias(POS))
    return filled(df, {"v": F.col("v")}, small=0).drop(POS)


@query(
    "SELECT 'first' AS keep, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1 UNION ALL SELECT 'last', event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1"
    " UNION ALL SELECT 'none', event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE n = 1"
)
def deduplicate_rows(spark, read):
    df = with_position(read("events").select("event_id", "user_id", "event_type"), ["event_id"])
    parts = [apply(df, "deduplicate_rows", keys=["user_id", "event_type"], keep=k).select(F.lit(n).alias("keep"), "event_id") for k, n in (("first", "first"), ("last", "last"), (False, "none"))]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_top(spark, read):
    return apply(read("orders").select("o_orderkey", "o_custkey", "o_totalprice"), "sort", by=["o_totalprice", "o_orderkey"], ascending=[False, True], limit=25)


# domains

_TENNIS = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'RET' ELSE (o_orderkey % 8) || '-' || (o_custkey % 8) || ' 6' || chr(8211) || '4(3), ' || (o_custkey % 7) || '-6' END AS s FROM orders"


@query(
    f"WITH t AS ({_TENNIS}), g AS (SELECT o_orderkey, s, list_transform(regexp_extract_all(s, '(\\d+)[-\u2013\u2014]\\d+', 1), lambda x: x::INT) AS a, list_transform(regexp_extract_all(s, '\\d+[-\u2013\u2014](\\d+)', 1), lambda x: x::INT) AS b FROM t)"
    " SELECT o_orderkey, s = 'RET' AS is_default_score, CASE WHEN s <> 'RET' THEN len(a) END AS total_sets_played, CASE WHEN s <> 'RET' THEN (a[1] > b[1])::INT + (a[2] > b[2])::INT + (a[3] > b[3])::INT END AS player_sets_won, CASE WHEN s <> 'RET' THEN (list_sum(a) + list_sum(b))::INT END AS total_games_played, CASE WHEN s <> 'RET' THEN a[1] > b[1] END AS player_won_first_set, CASE WHEN s <> 'RET' THEN a[1] > b[1] AND a[2] > b[2] AND a[3] > b[3] END AS player_won_in_straight_sets FROM g"
)
def parse_tennis_score(spark, read):
    s = F.when(F.col("o_orderkey") % 11 == 0, "RET").otherwise(F.concat(F.col("o_orderkey") % 8, F.lit("-"), F.col("o_custkey") % 8, F.lit(" 6\u20134(3), "), F.col("o_custkey") % 7, F.lit("-6")))
    names = ["is_default_score", "total_sets_played", "player_sets_won", "total_games_played", "player_won_first_set", "player_won_in_straight_sets"]
    df = apply(read("orders").select("o_orderkey", s.alias("s"), F.lit("Winner").alias("w")), "parse_tennis_score", score_col="s", outcome_col="w", writes=names)
    return df.select("o_orderkey", "is_default_score", *[F.col(c).cast("int").alias(c) for c in names[1:4]], *names[4:])


@query("SELECT p_partkey, p_partkey > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 1000) t(d) WHERE d * d <= p_partkey AND p_partkey % d = 0) AS prime FROM part")
def custom_is_prime(spark, read):
    return apply(read("part").select("p_partkey"), "custom", name="is_prime_number", col="p_partkey", out="prime")


@query("SELECT c_custkey, nullif(regexp_extract(s, '^(\\S+ \\d+, \\d{4})', 1), '') AS born, nullif(regexp_extract(s, 'age (\\d+)', 1), '') AS age, regexp_extract(s, '(\\w+) \\d+, (\\d{4})', 1) AS mon, regexp_extract(s, '(\\w+) \\d+, (\\d{4})', 2) AS yr FROM (SELECT c_custkey, 'March ' || (c_custkey % 28 + 1) || ', ' || (1950 + c_custkey % 50) || ' (age ' || (20 + c_custkey % 40) || ')' AS s FROM customer)")
def custom_extractors(spark, read):
    k = F.col("c_custkey")
    s = F.concat(F.lit("March "), k % 28 + 1, F.lit(", "), k % 50 + 1950, F.lit(" (age "), k % 40 + 20, F.lit(")"))
    df = read("customer").select("c_custkey", s.alias("s"))
    df = apply(df, "custom", name="extract_birth_date_and_age", col="s", date_pattern=r"^(\S+ \d+, \d{4})", age_pattern=r"age (\d+)", writes=["born", "age"])
    return apply(df, "custom", name="extract_regex_groups", col="s", pattern=r"(?P<mon>\w+) \d+, (?P<yr>\d{4})", writes=["mon", "yr"]).drop("s")


# profile, issues, scores


@query(
    "SELECT 'o_orderkey' AS \"column\", count(DISTINCT o_orderkey) AS n_unique, 0::BIGINT AS n_missing FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT nullif(o_orderstatus, 'P')), count(*) FILTER (o_orderstatus = 'P') FROM orders"
)
def profile(spark, read):
    return stats_table(read("orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus")))


@query("SELECT name, avg(regexp_matches(v, '\\b(19|20)\\d{2}\\b')::INT) >= 0.3 AS year FROM (SELECT 'dates' AS name, strftime(o_orderdate, '%B %-d, %Y') AS v FROM orders UNION ALL SELECT 'keys', '#' || o_orderkey FROM orders UNION ALL SELECT 'prices', 'EUR ' || floor(o_totalprice / 100)::BIGINT FROM orders UNION ALL SELECT 'some', CASE WHEN o_orderkey % 10 < 3 THEN 'in ' || year(o_orderdate) ELSE 'none' END FROM orders) GROUP BY name")
def has_year_share(spark, read):
    """Columns that mostly, hardly ever and now and then hold a year."""
    k = F.col("o_orderkey")
    df = read("orders").select(
        F.date_format("o_orderdate", "MMMM d, yyyy").alias("dates"), F.concat(F.lit("#"), k).alias("keys"), F.concat(F.lit("EUR "), F.floor(F.col("o_totalprice") / 100)).alias("prices"), F.when(k % 10 < 3, F.concat(F.lit("in "), F.year("o_orderdate"))).otherwise("none").alias("some")
    )
    return spark.createDataFrame(sorted(has_year(df, df.columns).items()), "name string, year boolean")


@query(
    "WITH q AS (SELECT conv_id * 100 + turn AS k, conv_id || '.' || turn AS qid, CASE WHEN turn = 1 THEN ' ' ELSE role || ' side' END AS r FROM conversations), g AS (SELECT r AS description, min(k) AS k, list(qid ORDER BY k) AS blocking, list_sort(list_distinct(flatten(list([split_part(qid, '.', 2)])))) AS cols FROM q WHERE trim(r) <> '' GROUP BY r)"
    " SELECT 'iss_' || lpad((row_number() OVER (ORDER BY k))::VARCHAR, 3, '0') AS issue_id, description, len(cols)::INT AS n_cols, len(blocking)::INT AS n_questions, blocking[1] AS first_question FROM g"
)
def issues_of_questions(spark, read):
    c = read("conversations")
    qid = F.concat("conv_id", F.lit("."), "turn")
    df = c.select(qid.alias("qid"), F.array(F.col("turn").cast("string")).alias("depends_on"), F.when(F.col("turn") == 1, " ").otherwise(F.concat("role", F.lit(" side"))).alias("failure_reason"), (F.col("conv_id") * 100 + F.col("turn")).alias("k"))
    df = with_position(df, ["k"]).drop("k")
    return issues(df).select("issue_id", "description", F.size("cols").alias("n_cols"), F.size("blocking_questions").alias("n_questions"), F.col("blocking_questions")[0].alias("first_question"))


#: The words that scores take for others, as a map in DuckDB.
_SAME_WORDS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in {**sc.SHORT_MONTHS, **sc.ORDINALS, **sc.ROMANS, **sc.TRUTH}.items()) + "}"


@query(
    r"WITH t AS (SELECT doc_id, text, regexp_replace(regexp_replace(lower(text), '^\s+', ''), '\s+$', '') AS t FROM documents),"
    r" d AS (SELECT doc_id, text, CASE WHEN regexp_full_match(t, '\d{4}-\d{2}-\d{2}') AND TRY_CAST(t[6:7] AS INT) BETWEEN 1 AND 12 THEN TRY_CAST(t[9:10] AS INT) || ' ' || lower(monthname(make_date(2000, TRY_CAST(t[6:7] AS INT), 1))) || ' ' || t[1:4] ELSE t END AS t FROM t),"
    r" n AS (SELECT doc_id, text, regexp_replace(replace(t, ',', ''), '^([+-]?\d+)\.0+$', '\1') AS t FROM d),"
    rf" w AS (SELECT doc_id, text, array_to_string(list_transform(regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+'), lambda x: coalesce({_SAME_WORDS}[x], x)), '') AS t FROM n),"
    r" m AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[@;|]', ' ', 'g'), '\s*%\s*', ' percent ', 'g'), '\$\s*', '', 'g'), '\s*°([cf]($|[^\p{L}\p{M}\p{Nd}\p{Pc}]))?', '\1', 'g') AS t FROM w),"
    r" a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t, CASE WHEN regexp_full_match(trim(replace(text, ',', '')), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN TRY_CAST(replace(text, ',', '') AS DOUBLE) END AS v FROM m),"
    " b AS (SELECT doc_id, t, v, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS s FROM a),"
    " p AS (SELECT x.doc_id, x.t, y.t AS u, x.v, y.v AS z, len(x.s) + len(y.s) AS n, len(list_intersect(x.s, y.s)) AS common FROM b x LEFT JOIN b y ON y.doc_id = x.doc_id + 1)"
    " SELECT doc_id, round(CASE WHEN t IS NULL OR u IS NULL THEN NULL WHEN t = u THEN 1.0 WHEN abs(v - z) < 0.01 THEN 1.0 WHEN common = 0 THEN 0.0 ELSE 2.0 * common / n END, 9)::DOUBLE AS f1 FROM p"
)
def score_token_f1(spark, read):
    """Every document's whole text against the whole text of the next one; the last has none, and no score."""
    d = read("documents").select("doc_id", sc.forms(F.col("text")).alias("form"))
    # each text meets two others but is normalised once, so its form goes to both instead of into a join
    sides = F.array(*[F.struct(at.alias("doc_id"), F.lit(own).alias("own"), "form") for at, own in ((F.col("doc_id"), True), (F.col("doc_id") - 1, False))])
    rows = d.select(F.inline(sides)).where("own OR doc_id IS NOT NULL")
    met = rows.withColumn("others", F.collect_list(F.when(~F.col("own"), F.col("form"))).over(Window.partitionBy("doc_id"))).where("own")
    pairs = met.select("doc_id", F.col("form").alias("own"), F.explode_outer("others").alias("other"))
    return pairs.select("doc_id", F.round(sc.forms_f1(F.col("own"), F.col("other")), 9).alias("f1"))


@query(
    "WITH a AS (SELECT o_orderkey, lower(monthname(o_orderdate)) AS m, day(o_orderdate) AS d, year(o_orderdate) AS y, o_orderkey % 6 AS k, o_custkey AS c FROM orders)"
    " SELECT o_orderkey, CASE k WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN c % 2 = 0 WHEN 4 THEN true ELSE false END AS exact_match,"
    " CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN CASE WHEN c % 2 = 0 THEN 1.0 ELSE 0.0 END WHEN 4 THEN 1.0 ELSE 0.5 END::DOUBLE AS f1 FROM a"
)
def score_exact(spark, read):
    """Answers in other words: dates, numbers that are near, several targets, yes and no, holding all targets, half of the words."""
    o, k, c, d = read("orders"), F.col("o_orderkey") % 6, F.col("o_custkey"), F.col("o_orderdate")
    said = (
        F.when(k == 0, F.concat(F.lit("Answer: '"), F.date_format(d, "yyyy-MM-dd"), F.lit("'")))
        .when(k == 1, F.concat(c, F.lit(".004")))
        .when(k == 2, F.concat(F.lit("The answer is red; "), F.format_number(c, 1)))
        .when(k == 3, "yes")
        .when(k == 4, F.concat(F.lit("both "), c, F.lit(" and the 1st")))
        .otherwise("red cat")
    )
    targets = (
        F.when(k == 0, F.array(F.date_format(d, "d MMM yyyy")))
        .when(k == 1, F.array(F.concat(c, F.lit(".0"))))
        .when(k == 2, F.array(F.lit("red"), c.cast("string")))
        .when(k == 3, F.array(F.when(c % 2 == 0, "True").otherwise("No")))
        .when(k == 4, F.array(F.lit("First"), c.cast("string")))
        .otherwise(F.array(F.lit("blue dog"), F.lit("red dog")))
    )
    return sc.score_table(o.select("o_orderkey", said.alias("predicted"), targets.alias("targets"))).select("o_orderkey", "exact_match", "f1")


@query("WITH q AS (SELECT o_orderkey, o_orderstatus = 'F' AS e, CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderstatus = 'O' THEN 0.5 ELSE 0.0 END AS f, o_orderpriority AS p FROM orders) SELECT p AS table_id, count(*) AS n, count(*) FILTER (e) AS exact, round(100 * avg(e::INT), 1) AS exact_percent, round(avg(f), 4) AS mean_f1 FROM q GROUP BY p")
def score_summary(spark, read):
    """Scores by table: answers with all, half and none of the words asked for."""
    o = read("orders")
    said = F.when(F.col("o_orderstatus") == "F", "red cat").when(F.col("o_orderstatus") == "O", "red dog").otherwise("none")
    df = sc.score_table(o.select(F.col("o_orderpriority").alias("table_id"), said.alias("predicted"), F.array(F.lit("red cat")).alias("targets")))
    return qa.summary(df)


# sources


@query("SELECT n_regionkey::VARCHAR AS table_id, (dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS row, c AS col, ['key', 'name', 'name_value'][c + 1] AS name, CASE c WHEN 0 THEN n_nationkey::VARCHAR WHEN 1 THEN n_name ELSE 'of ' || n_regionkey END AS value FROM nation, (VALUES (0), (1), (2)) v(c)")
def markdown_cells(spark, read):
    """A corpus of markdown tables with a title, a rule, a header twice and cells over two lines, parsed in tasks."""
    n = read("nation")
    line = F.concat(F.lit("| "), "n_nationkey", F.lit(" | "), "n_name", F.lit(" | of\n"), "n_regionkey", F.lit(" |"))
    rows = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("rows"))
    from .sources.markdown import explode_tables

    return explode_tables(rows.select(F.col("n_regionkey").alias("table_id"), F.concat(F.lit("# nations\n| key | name | name |\n|---|:-:|---|\n"), "rows").alias("markdown")))


@query("SELECT r_regionkey::VARCHAR AS table_id, i::INT AS row, name, CASE name WHEN 'row_level_0' THEN 'line ' || i WHEN 'A / x' THEN r_name ELSE (r_regionkey * 10 + i)::VARCHAR END AS value FROM region, (VALUES (0), (1)) t(i), (VALUES ('row_level_0'), ('A / x'), ('B')) c(name)")
def hierarchical_cells(spark, read):
    """A corpus of tables with trees as headers, flattened in tasks."""
    from .sources.hierarchical import explode_tables

    top = '{"name": "root", "children_dict": [{"name": "A", "children_dict": [{"name": "x", "line_idx": 0}]}, {"name": "B", "line_idx": 1}]}'
    left = '{"name": "root", "children_dict": [{"name": "line 0", "line_idx": 0}, {"name": "line 1", "line_idx": 1}]}'
    lines = [F.concat(F.lit('[{"value": "'), "r_name", F.lit('"}, {"value": '), F.col("r_regionkey") * 10 + i, F.lit('}, {"value": "no path"}]')) for i in (0, 1)]
    content = F.concat(F.lit(f'{{"top_root": {top}, "left_root": {left}, "data": ['), lines[0], F.lit(", "), lines[1], F.lit("]}"))
    return explode_tables(read("region").select(F.col("r_regionkey").alias("table_id"), content.alias("content")))


@query("SELECT s_suppkey AS col_1st_key, s_nationkey::BIGINT AS nation_text, s_acctbal AS balance, s_name AS s_name, s_name AS S_Name_2 FROM supplier")
def sql_ready_table(spark, read):
    """Plain names, texts of numbers as numbers, and no column without values."""
    from .plans.finalize import sql_ready

    df = read("supplier").select(F.col("s_suppkey").alias("1st key"), F.col("s_nationkey").cast("string").alias("nation/text"), F.col("s_acctbal").cast("string").alias("balance"), "s_name", F.col("s_name").alias("S Name"), F.lit(None).cast("string").alias("empty"))
    return sql_ready(df)


# questions in SQL


def sql_query(name: str, table: str, engine: str, oracle: str):
    def run(spark, sf_dir):
        for t in table.split():
            qa.register(spark.read.parquet(f"{sf_dir}/{t}.parquet"), t)
        return spark.sql(qa.spark_sql(engine))

    QUERIES[name], SQL[name] = run, oracle


for _name, _tables, _text in (
    ("sql_count_filter", "lineitem", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25"),
    ("sql_extreme_row", "orders", 'SELECT "o_orderkey", o_totalprice FROM orders ORDER BY "o_totalprice" DESC, o_orderkey LIMIT 1'),
    ("sql_group_having", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10"),
    ("sql_distinct_aggregate", "orders", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, min(o_orderdate) AS first_day FROM orders GROUP BY o_orderstatus"),
    ("sql_window_rank", "orders", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders"),
    ("sql_cte_self_join", "orders", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 250000) SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM big a JOIN big b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey"),
    ("sql_set_operations", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier UNION SELECT -1 EXCEPT SELECT 3"),
    ("sql_semi_anti", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    ("sql_join_aggregate", "customer orders nation", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM nation JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name"),
    ("sql_grouping_sets", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
):
    sql_query(_name, _tables, _text, _text)
sql_query("sql_like_any_case", "part", "SELECT p_partkey FROM part WHERE p_name LIKE '%SMALL%' AND \"p_type\" NOT LIKE 'X%'", "SELECT p_partkey FROM part WHERE p_name ILIKE '%SMALL%' AND p_type NOT ILIKE 'X%'")


@query("SELECT o.a AS question, o.b AS answer FROM (SELECT 'n' AS a, count(*)::VARCHAR AS b FROM orders UNION ALL SELECT 'row', (SELECT o_orderkey || ' | ' || o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1) UNION ALL SELECT 'list', (SELECT string_agg(n_name, ', ' ORDER BY n_name) FROM (SELECT n_name FROM nation ORDER BY n_name LIMIT 10)) UNION ALL SELECT 'none', 'EMPTY') o")
def sql_answers(spark, read):
    """Answers as texts: a value, a row, the first ten rows, nothing."""
    o, n = read("orders"), read("nation")
    rows = [("n", qa.answer(o, "orders", "SELECT count(*) FROM orders;")[0]), ("row", qa.answer(o, "orders", 'SELECT "o_orderkey", o_orderstatus FROM orders ORDER BY 1 LIMIT 1')[0])]
    rows += [("list", qa.answer(n, "nation", "SELECT n_name FROM nation ORDER BY n_name")[0]), ("none", qa.answer(n, "nation", "SELECT n_name FROM nation WHERE n_nationkey < 0")[0])]
    return spark.createDataFrame(rows, "question string, answer string")


# whole plans

PLAN = {
    "table_id": "orders",
    "strategy": "priorities as number and name, urgency, year",
    "steps": [
        {"step_id": "s1", "op": "extract_regex", "reads": ["o_orderpriority"], "writes": ["prio_num", "prio_name"], "params": {"col": "o_orderpriority", "pattern": r"^(\d)-(.+)$", "out_groups": ["prio_num", "prio_name"]}},
        {"step_id": "s2", "op": "cast_column", "reads": ["prio_num"], "writes": ["prio_num"], "params": {"col": "prio_num", "dtype": "integer"}},
        {"step_id": "s3", "op": "derive_conditional", "reads": ["prio_num"], "writes": ["is_urgent"], "params": {"out": "is_urgent", "conditions": [{"if": "prio_num <= 2", "then": True}], "default": False}},
        {"step_id": "s4", "op": "derive_math", "reads": ["o_orderdate"], "writes": ["order_year"], "params": {"expr": "year(o_orderdate)"}},
        {"step_id": "s5", "op": "keep_raw_snapshot", "reads": ["o_orderpriority"], "writes": [], "params": {"sidecar_cols": ["o_orderpriority"]}},
    ],
    "final_output": {"primary_key": ["o_orderkey"], "columns": [{"name": n, "role": r} for n, r in (("o_orderkey", "canonical"), ("prio_num", "derived"), ("prio_name", "derived"), ("is_urgent", "derived"), ("order_year", "derived"), ("o_totalprice", "canonical"), ("o_orderpriority", "raw_snapshot"))]},
}

PLANNED = "SELECT o_orderkey, regexp_extract(o_orderpriority, '^(\\d)-(.+)$', 1)::BIGINT AS prio_num, regexp_extract(o_orderpriority, '^(\\d)-(.+)$', 2) AS prio_name, regexp_extract(o_orderpriority, '^(\\d)-(.+)$', 1)::BIGINT <= 2 AS is_urgent, year(o_orderdate)::DOUBLE AS order_year, o_totalprice FROM orders"


@query(PLANNED)
def plan_table(spark, read):
    return execute(read("orders"), PLAN, mode="strict", order_by=["o_orderkey"])[0]


@query(f"SELECT prio_name, is_urgent, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM ({PLANNED}) GROUP BY prio_name, is_urgent")
def plan_end_to_end(spark, read):
    """A plan over orders, and a question in SQL over what it gives."""
    df, _ = execute(read("orders"), PLAN, mode="strict", order_by=["o_orderkey"])
    view = qa.register(df, "orders planned")
    return spark.sql(qa.spark_sql(f'SELECT "prio_name", is_urgent, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {view} GROUP BY prio_name, is_urgent'))


from . import queries_files, queries_plans  # noqa: E402, F401  they register theirs


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["plan_end_to_end"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
