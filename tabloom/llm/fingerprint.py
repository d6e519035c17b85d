"""Merkle fingerprints of documents, in DataFrame functions only.

A text is a tree: sections (parted by an empty line), paragraphs (lines), and leaves of at
most ``LEAF`` code points of a paragraph. A node's digest is the MD5 of its children's;
a leaf's, that of its text. The fingerprint is ``root|sections|paragraphs|leaves``: the
whole root, and the first eight hex digits of every other node, sections and paragraphs
with the number of their children. Roots tell whether texts are equal; where they differ,
the sections, paragraphs and leaves that differ say where.

Edge cases: a null text is an empty one; an empty text has one empty paragraph without
leaves; equal texts have equal fingerprints; the likeness of equal fingerprints is 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

LEAF, DIGITS = 64, 8


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """The DataFrame with the fingerprint of a text column (without nulls) as one more column.

    Each level of the tree is a projection of its own, from the leaves up, so that no
    node is digested twice.
    """
    kept = [F.col(f"`{x}`") for x in df.columns]
    leaves, paragraphs, sections = (c.fresh(df, x) for x in ("__leaves", "__paragraphs", "__sections"))

    def short(d: Column) -> Column:
        return F.substring(d, 1, DIGITS)

    def counted(digest: Column, children: Column) -> Column:
        return F.concat(short(digest), F.lit("x"), F.size(children).cast("string"))

    def leaf(p: Column) -> Column:
        return F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{LEAF}}}"), F.lit(0)), F.md5)

    def digest(children: Column) -> Column:
        return F.md5(F.concat_ws("", children))

    df = df.select(*kept, F.transform(F.split(F.col(text), "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaf)).alias(leaves))
    df = df.select(*kept, leaves, F.transform(leaves, lambda s: F.transform(s, digest)).alias(paragraphs))
    df = df.select(*kept, leaves, paragraphs, F.transform(paragraphs, digest).alias(sections))
    parts = [
        digest(F.col(sections)),
        F.concat_ws(" ", F.zip_with(sections, paragraphs, counted)),
        F.concat_ws(" ", F.zip_with(F.flatten(paragraphs), F.flatten(leaves), counted)),
        F.concat_ws(" ", F.transform(F.flatten(F.flatten(leaves)), short)),
    ]
    return df.select(*kept, F.concat_ws("|", *parts).alias(name))


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """The documents with the fingerprint of their text; a null text counts as an empty one."""
    own = c.fresh(docs, "__text")
    return with_fingerprint(docs.withColumn(own, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), own, name).drop(own)


def _nodes(fp: Column, level: int) -> Column:
    part = F.split_part(fp, F.lit("|"), F.lit(level + 1))
    return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, " "))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal leaves of two fingerprints (Dice's coefficient of their distinct leaves), 0 to 1."""
    x, y = F.array_distinct(_nodes(a, 3)), F.array_distinct(_nodes(b, 3))
    total = F.size(x) + F.size(y)
    return F.when(a == b, 1.0).when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def differing(a: Column, b: Column, level: int = 2) -> Column:
    """Places (from 0) at which the sections (level 1) or paragraphs (2) or leaves (3) of two fingerprints differ."""
    x, y = _nodes(a, level), _nodes(b, level)
    places = F.when(F.greatest(F.size(x), F.size(y)) > 0, F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(a == b, F.array().cast("array<int>")).otherwise(F.filter(places, lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i))))


def successors(keys: DataFrame, by: list[str], parts: int) -> DataFrame:
    """Each distinct row of ``keys`` with the one that follows it in ascending order, as ``next_*``; the first follows the last.

    Only the keys are sorted: by range, then within each range. The first key of each
    range, one row a range, tells the last key of the range before what follows it.
    """
    ranged = keys.select(*by).distinct().repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()).checkpoint()
    key = F.struct(*by)
    w = Window.partitionBy("__part").orderBy(*by)
    within = ranged.select("*", F.lead(key).over(w).alias("__next"))
    firsts = ranged.groupBy("__part").agg(F.min(key).alias("__first"))
    everyone = Window.orderBy("__part")
    after = firsts.select("__part", F.coalesce(F.lead("__first").over(everyone), F.first("__first").over(everyone)).alias("__after"))
    out = within.join(after, "__part")
    following = F.coalesce("__next", "__after")
    return out.select(*by, *[following[x].alias(f"next_{x}") for x in by])


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text.

    The edited text has its last floor(n/4) code points replaced by as many of the first
    of the next document (or all it has). Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next and edited_paragraphs (places
    that differ from the edited text). Documents are ordered by id, a null id first; rows
    of one id by a hash of their texts; equal rows count as one in that order.
    """
    spark = c.prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.lit(-(1 << 63))
    # both joins take these very columns by these very keys, so texts and fingerprints are shuffled once
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), none).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = with_fingerprint(own, "text", "fingerprint")
    # of each document: which one comes before it, and how many code points that one takes
    pairs = successors(own.select("k", "h", (F.length("text") / 4).cast("long").alias("take")), ["k", "h", "take"], c.partitions(spark))
    before = pairs.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("to_k"), F.col("h").alias("to_h"), "take")
    sent = rows.join(before, ["k", "h"]).select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.expr("left(text, cast(take as int))").alias("head"), F.col("fingerprint").alias("next_fingerprint"))
    sent = sent.groupBy("k", "h").agg(F.first("head").alias("head"), F.first("next_fingerprint").alias("next_fingerprint"))
    n = F.length("text")
    doc_id = F.when(F.col("k") != none, F.col("k")).cast(docs.schema[id_col].dataType).alias("doc_id")
    out = rows.join(sent, ["k", "h"]).select(doc_id, n.cast("long").alias("n_chars"), F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.col("head")).alias("edited"), "fingerprint", "next_fingerprint")
    out = with_fingerprint(out, "edited", "edited_fingerprint").select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "next_fingerprint")
    a, b = F.col("fingerprint"), F.col("edited_fingerprint")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(a, b).alias("near_edited"), likeness(a, F.col("next_fingerprint")).alias("near_next"), differing(a, b).alias("edited_paragraphs"))


_SQL_FINGERPRINT = f"""
  SELECT *, md5(array_to_string(list_transform(sections, lambda s: md5(array_to_string(list_transform(s, lambda p: p.digest), ''))), '')) || '|' ||
    array_to_string(list_transform(sections, lambda s: md5(array_to_string(list_transform(s, lambda p: p.digest), ''))[1:{DIGITS}] || 'x' || len(s)), ' ') || '|' ||
    array_to_string(list_transform(flatten(sections), lambda p: p.digest[1:{DIGITS}] || 'x' || len(p.leaves)), ' ') || '|' ||
    array_to_string(list_transform(flatten(list_transform(flatten(sections), lambda p: p.leaves)), lambda x: x[1:{DIGITS}]), ' ') AS fp
  FROM (SELECT *, list_transform(string_split(t, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
    lambda p: {{'digest': md5(array_to_string(list_transform(regexp_extract_all(p, '(?s).{{1,{LEAF}}}'), lambda x: md5(x)), '')), 'leaves': list_transform(regexp_extract_all(p, '(?s).{{1,{LEAF}}}'), lambda x: md5(x))}})) AS sections FROM texts)
"""

#: What the query returns, for DuckDB (distinct ids without nulls).
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following FROM d WINDOW w AS (ORDER BY doc_id)),
e AS (SELECT doc_id, n, text, left(text, n - n // 4) || left(following, n // 4) AS edited, following FROM n),
texts AS (SELECT doc_id, 0 AS kind, text AS t FROM e UNION ALL SELECT doc_id, 1, edited FROM e UNION ALL SELECT doc_id, 2, following FROM e),
f AS ({_SQL_FINGERPRINT}),
g AS (SELECT doc_id, kind, fp, list_distinct(list_filter(string_split(string_split(fp, '|')[4], ' '), lambda x: x <> '')) AS leaves FROM f)
SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
  CASE WHEN a.fp = b.fp THEN 1.0 WHEN len(a.leaves) + len(b.leaves) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a.leaves, b.leaves)) / (len(a.leaves) + len(b.leaves)) END::DOUBLE AS near_edited,
  CASE WHEN a.fp = x.fp THEN 1.0 WHEN len(a.leaves) + len(x.leaves) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a.leaves, x.leaves)) / (len(a.leaves) + len(x.leaves)) END::DOUBLE AS near_next
FROM e JOIN g a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN g b ON b.doc_id = e.doc_id AND b.kind = 1 JOIN g x ON x.doc_id = e.doc_id AND x.kind = 2
"""
