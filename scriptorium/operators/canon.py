"""Canonical facets, and the projection of joined rows to catalogue rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import vocab


def tokens_of(raw: str | Column) -> Column:
    """Parts at commas if there is a comma, else at white space; stripped, empty ones dropped."""
    r = F.coalesce(T._col(raw), F.lit(""))
    parts = F.when(F.contains(r, F.lit(",")), F.split(r, ",")).otherwise(F.split(r, r"(?U)\s+"))
    return F.filter(F.transform(parts, T.strip), lambda x: x != "")


def people(raw: str | Column, known: Sequence[str] = vocab.CAST, misspelt: Mapping[str, str] = vocab.MISSPELT) -> Column:
    """(actors, roles): misspellings mapped first; known names once each in order of appearance, all others as roles."""
    fixed = tokens_of(raw)
    if misspelt:
        table = F.create_map(*[F.lit(x) for kv in misspelt.items() for x in kv])
        fixed = F.transform(fixed, lambda x: F.coalesce(F.try_element_at(table, x), x))
    names = F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")
    return F.struct(F.array_distinct(F.filter(fixed, lambda x: F.array_contains(names, x))).alias("actors"), F.filter(fixed, lambda x: ~F.array_contains(names, x)).alias("roles"))


def place(raw: str | Column, known: Sequence[str] = vocab.PLACES, other: str = vocab.OTHER_PLACE) -> Column:
    """A known value, or the other bucket."""
    c = T.clean(raw)
    return F.when(c.isin(list(known)), c).otherwise(other)


def languages(raw: str | Column) -> Column:
    """Parts at commas and plus signs, stripped, once each in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.replace(F.coalesce(T._col(raw), F.lit("")), F.lit("+"), F.lit(",")), ","), T.strip), lambda x: x != ""))


def roles_text(raw_roles: str | Column, roles: str | Column) -> Column:
    """Curated roles and rejected names, joined."""
    return F.array_join(F.filter(F.concat(F.array(T.clean(raw_roles)), T._col(roles)), lambda x: x != ""), ", ")


def catalogue(joined: DataFrame, known: Sequence[str] = vocab.CAST, misspelt: Mapping[str, str] = vocab.MISSPELT) -> DataFrame:
    """Catalogue rows of curated rows joined with metadata."""
    who, n = people("main_actors", known, misspelt), lambda c: F.expr(f"cast(try_cast({c} as double) as bigint)")
    return joined.withColumn("_who", who).select(
        F.coalesce("video_id", F.lit("")).alias("id"), F.coalesce("video_id", F.lit("")).alias("videoId"), T.episode_number("titles").alias("seq"),
        T.clean("titles").alias("title"), T.watch_url("video_id").alias("url"), T.thumbnail_url("video_id").alias("thumbnail"),
        T.clean("text").alias("text"), T.split_lines("text").alias("lines"), T.clean("text_common").alias("textCommon"),
        F.col("_who.actors").alias("actors"), T.clean("main_actors").alias("actorsRaw"), roles_text("roles_names", "_who.roles").alias("rolesNames"),
        place("location").alias("location"), languages("languages").alias("languages"), T.clean("lighting").alias("lighting"),
        n("duration_sec").cast("int").alias("durationSec"), n("view_count").alias("viewCount"), T.date_text("upload_date").alias("uploadDate"),
        F.expr("cast(array() as array<struct<startSec:double,endSec:double,text:string>>)").alias("segments"),
    )


def unmapped(rows: DataFrame, known: Sequence[str] = vocab.CAST, column: str = "rolesNames", top: int = 15) -> DataFrame:
    """The most frequent tokens that are not known names."""
    t = rows.select(F.explode(F.split(column, ", ")).alias("token")).where((F.col("token") != "") & ~F.col("token").isin(list(known)))
    return t.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(top)


def coverage(rows: DataFrame) -> DataFrame:
    """Rows, rows with text, rows with actors."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("text") != "").alias("with_text"), F.count_if(F.size("actors") > 0).alias("with_actors"))
