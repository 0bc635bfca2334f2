"""Readers with explicit schemas, and the projection of API items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators.transcripts import CAPTION_SCHEMA

CURATED = "links string, titles string, text string, text_common string, main_actors string, roles_names string, location string, languages string, lighting string, main_actors_count string"
#: Columns of the metadata table, in order. Fixed values.
METADATA = (
    "video_id canonical_url original_url title uploader channel_id duration_sec upload_date view_count like_count dislike_count comment_count availability "
    "yt_declared_language categories tags subs_manual_langs auto_caption_source_lang has_auto_captions caption_available has_chapters chapters_count chapters_json description source fetched_at fetch_error"
).split()
ITEM = "id string, snippet struct<title:string,channelTitle:string,channelId:string,publishedAt:string,defaultLanguage:string,defaultAudioLanguage:string,categoryId:string,tags:array<string>,description:string>, contentDetails struct<duration:string,caption:string>, statistics struct<viewCount:string,likeCount:string,commentCount:string>, status struct<privacyStatus:string>"


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, quotes doubled inside quotes, and line breaks inside fields."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def curated(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, CURATED)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata table as text columns; select the few that a plan needs and only those are parsed."""
    return csv(spark, path, ", ".join(f"{c} string" for c in METADATA))


def captions(spark: SparkSession, path: str) -> DataFrame:
    """All caption files of a folder, with `file`, in one distributed read."""
    return spark.read.schema(CAPTION_SCHEMA).json(path, multiLine=True, pathGlobFilter="*.json3").withColumn("file", F.col("_metadata.file_name"))


def summaries(spark: SparkSession, path: str, schema: str, pattern: str = "*summary__*.json") -> DataFrame:
    """All summaries of a folder, found by name, with `file`."""
    return spark.read.schema(schema).json(path, multiLine=True, pathGlobFilter=pattern).withColumn("file", F.col("_metadata.file_name"))


def items(spark: SparkSession, path: str) -> DataFrame:
    """Landed API answers, one item a line."""
    return spark.read.schema(ITEM).json(path)


def by_id(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


def number(c: str) -> Column:
    """A number, 0 for anything else."""
    return F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(0.0))


def item_rows(found: DataFrame, original_url: str | Column = "") -> DataFrame:
    """API items as metadata rows."""
    whole = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")).cast("bigint")
    url = F.lit(original_url) if isinstance(original_url, str) else original_url
    none, blank = F.lit(None).cast("string"), F.lit("")
    values = {
        "video_id": F.col("id"), "canonical_url": T.watch_url("id"), "original_url": url, "title": F.col("snippet.title"), "uploader": F.col("snippet.channelTitle"), "channel_id": F.col("snippet.channelId"),
        "duration_sec": T.iso_seconds("contentDetails.duration"), "upload_date": T.iso_day("snippet.publishedAt"), "view_count": whole("statistics.viewCount"), "like_count": whole("statistics.likeCount"), "dislike_count": none,
        "comment_count": whole("statistics.commentCount"), "availability": F.col("status.privacyStatus"), "yt_declared_language": F.coalesce(F.nullif("snippet.defaultLanguage", blank), "snippet.defaultAudioLanguage"),
        "categories": F.to_json(F.array_compact(F.array(F.nullif("snippet.categoryId", blank)))), "tags": F.substring(F.to_json(F.coalesce("snippet.tags", F.array().cast("array<string>"))), 1, 5000),
        "caption_available": F.lower(F.coalesce("contentDetails.caption", blank)) == "true", "description": F.substring(F.coalesce("snippet.description", blank), 1, 1000), "source": F.lit("api"),
        "fetched_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"),
    }
    return found.select(*[values.get(c, blank).alias(c) for c in METADATA])


def error_rows(failed: DataFrame, key: str, error: str, original_url: str = "") -> DataFrame:
    """Metadata rows for failed ids: a few fixed values, the error, and nulls."""
    values = {"video_id": F.col(key), "canonical_url": T.watch_url(key), "original_url": F.lit(original_url), "categories": F.lit("[]"), "tags": F.lit("[]"), "source": F.lit("api"), "fetched_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "fetch_error": F.col(error)}
    blank = "subs_manual_langs auto_caption_source_lang has_auto_captions caption_available has_chapters chapters_count chapters_json description".split()
    return failed.select(*[values.get(c, F.lit("") if c in blank else F.lit(None).cast("string")).alias(c) for c in METADATA])


def caption_languages(files: DataFrame, file: str = "file") -> DataFrame:
    """Distinct languages of caption files, in order."""
    return files.select(T.caption_file(file)["lang"].alias("lang")).where("lang <> ''").distinct().orderBy("lang")


def served_log(spark: SparkSession, path: str, kinds: Sequence[str] = (), since: str | None = None, until: str | None = None, session: str | None = None, sketch: str | None = None) -> DataFrame:
    """Events of a clustered log by type, time (from `since` up to before `until`), session and sketch; all of these reach the scan."""
    rows = spark.read.parquet(path)
    if kinds:
        rows = rows.where(F.col("type").isin(list(kinds)))
    for c, value in (("session_id", session), ("sketch_id", sketch)):
        if value is not None:
            rows = rows.where(F.col(c) == value)
    if since:
        rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    return rows.where(F.col("ts") < F.lit(until).cast("timestamp")) if until else rows
