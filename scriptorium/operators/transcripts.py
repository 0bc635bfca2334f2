"""Transcripts, speech-to-text accounts, and quizzes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import vocab

CAPTION_SCHEMA = "events array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string,tOffsetMs:bigint>>>>"
RUN_SCHEMA = "full_text string, segments array<struct<start_sec:double,end_sec:double,text:string>>"


def flatten_events(events: str | Column) -> Column:
    """Caption events as (start, end, text): segments joined and stripped, blank ones dropped, seconds rounded to three places, no duration as 0."""
    e = F.col(events) if isinstance(events, str) else events
    seconds = lambda ms: F.bround(ms / 1000.0, 3)
    start = lambda x: F.coalesce(x["tStartMs"], F.lit(0))
    flat = F.transform(e, lambda x: F.struct(seconds(start(x)).alias("start"), seconds(start(x) + F.coalesce(x["dDurationMs"], F.lit(0))).alias("end"), T.strip(F.array_join(F.transform(F.coalesce(x["segs"], F.array().cast("array<struct<utf8:string,tOffsetMs:bigint>>")), lambda s: F.coalesce(s["utf8"], F.lit(""))), "")).alias("text")))
    return F.filter(F.coalesce(flat, F.array().cast("array<struct<start:double,end:double,text:string>>")), lambda x: x["text"] != "")


def flatten(captions: DataFrame, file: str, titles: DataFrame | None = None) -> DataFrame:
    """Flat transcripts of caption files with `events`; the duration is the last event's end."""
    named = captions.withColumn("_f", T.caption_file(file)).withColumn("events", flatten_events("events"))
    out = named.select(F.col("_f.video_id").alias("video_id"), F.col("_f.seq").alias("seq"), F.col("_f.lang").alias("source_lang"), F.size("events").alias("n_events"), F.coalesce(F.try_element_at("events", F.lit(-1))["end"], F.lit(0.0)).alias("duration_sec"), F.array_join(F.transform("events", lambda x: x["text"]), "\n").alias("full_text"), "events")
    if titles is None:
        return out.withColumn("title", F.lit(""))
    return out.join(titles.select("video_id", "title"), "video_id", "left").withColumn("title", F.coalesce("title", F.lit("")))


def caption_totals(transcripts: DataFrame) -> DataFrame:
    """Files, events and characters by language."""
    return transcripts.groupBy("source_lang").agg(F.count("*").alias("files"), F.sum("n_events").alias("events"), F.sum(F.length("full_text")).alias("chars"))


def join_turns(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Turns of a conversation joined in order, with their number and the length of the whole. One conversation's turns are one group by nature."""
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("t")).select(key, F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x[text]), "\n").alias("full_text"))


def parse_runs(raw: DataFrame, column: str) -> DataFrame:
    """Model answers as JSON; a broken one keeps its raw text and says so."""
    parsed = raw.withColumn("parsed", F.from_json(column, RUN_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.withColumn("parse_error", F.when(F.col("parsed._bad").isNotNull() | F.col("parsed").isNull(), "not JSON of the asked form"))


def cost(tokens_in: str | Column, tokens_out: str | Column, price_in: str | Column, price_out: str | Column) -> Column:
    """Dollars for tokens at prices of a million."""
    c = T._col
    return c(tokens_in) / 1e6 * c(price_in) + c(tokens_out) / 1e6 * c(price_out)


def price_table(spark, prices: Mapping[str, tuple[float, float]] = vocab.TOKEN_PRICES) -> DataFrame:
    return spark.createDataFrame([(m, a, b) for m, (a, b) in prices.items()], "model string, price_in double, price_out double")


def run_totals(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """By model: runs, seconds, tokens and dollars. Runs have model, audio_sec, gen_sec, tokens_in and tokens_out."""
    t = runs.groupBy("model").agg(F.count("*").alias("n"), F.sum("audio_sec").alias("audio_sec"), F.sum("gen_sec").alias("gen_sec"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return t.join(prices, "model").withColumn("cost_usd", cost("tokens_in", "tokens_out", "price_in", "price_out"))


def extrapolate(totals: DataFrame, hours: float = vocab.ARCHIVE_HOURS) -> DataFrame:
    """Million tokens, dollars and serial minutes for so many hours of audio, in proportion."""
    k = F.lit(hours * 3600) / F.col("audio_sec")
    m_in, m_out = F.col("tokens_in") * k / 1e6, F.col("tokens_out") * k / 1e6
    return totals.select("model", m_in.alias("m_tokens_in"), m_out.alias("m_tokens_out"), (m_in * F.col("price_in") + m_out * F.col("price_out")).alias("full_cost_usd"), (F.col("gen_sec") * k / 60).alias("wall_min"))


def stars(fraction: str | Column) -> Column:
    """3 from 0.9, 2 from 0.8, 1 from 0.7."""
    f = T._col(fraction)
    return F.when(f >= 0.9, 3).when(f >= 0.8, 2).when(f >= 0.7, 1).otherwise(0)


def quiz_progress(attempts: DataFrame, user: str, level: str, fraction: str, pass_at: Column | float = 0.7) -> DataFrame:
    """Best fraction, stars, passed and unlocked of each user's levels; a level is open if the one before it in order is passed, the first always."""
    best = attempts.groupBy(user, level).agg(F.max(fraction).alias("best"))
    passed = F.col("best") >= pass_at
    order = Window.partitionBy(user).orderBy(level)
    return best.withColumns({"stars": stars("best"), "passed": passed}).withColumn("unlocked", F.coalesce(F.lag("passed").over(order), F.lit(True)))
