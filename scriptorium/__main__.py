"""Command line: build an archive, search it, list what is left to fetch, or sum up what runs cost."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from scriptorium.operators import relational, transcripts
from scriptorium.plans.archive import Archive
from scriptorium.plans.session import session
from scriptorium.sources import readers

#: What a run's summary says of it.
RUNS = "model string, audio_sec double, gen_sec double, tokens_in long, tokens_out long"


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="scriptorium", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="curated and metadata CSV files to an indexed table")
    build.add_argument("--input", required=True)
    build.add_argument("--metadata", required=True)
    build.add_argument("--output", required=True)
    find = sub.add_parser("search", help="ranked rows of an indexed table")
    find.add_argument("query")
    find.add_argument("--input", required=True)
    find.add_argument("--sort", default="views", choices=["views", "newest", "random"])
    find.add_argument("--limit", type=int, default=10)
    left = sub.add_parser("todo", help="curated rows that no successful metadata row serves")
    left.add_argument("--input", required=True)
    left.add_argument("--metadata", required=True)
    left.add_argument("--limit", type=int)
    left.add_argument("--picks", nargs="*", default=[], help="ids or sequence numbers")
    costs = sub.add_parser("costs", help="tokens and dollars of speech-to-text runs, and of the whole archive at that rate")
    costs.add_argument("--input", required=True, help="a folder of run summaries")
    costs.add_argument("--model", help="only runs of this model")
    a = p.parse_args(args)
    spark = session()
    if a.command == "build":
        Archive.build(spark, a.input, a.metadata).save(a.output)
    elif a.command == "search":
        Archive.open(spark, a.input).search(a.query, a.sort).select("id", "title", "viewCount", "score").limit(a.limit).show(a.limit, truncate=60)
    elif a.command == "costs":
        runs = readers.summaries(spark, a.input, RUNS)
        totals = transcripts.run_totals(runs if a.model is None else runs.where(F.col("model") == a.model), transcripts.price_table(spark))
        totals.join(transcripts.extrapolate(totals), "model").show(truncate=False)
    else:
        from scriptorium.functions import text as T

        rows = readers.curated(spark, a.input).withColumn("video_id", T.video_id_by_host("links")).where("video_id is not null").dropDuplicates(["video_id"]).withColumn("seq", T.episode_number("titles"))
        relational.todo(relational.picks(rows, a.picks, "video_id", "seq"), relational.succeeded(readers.metadata(spark, a.metadata), "fetch_error"), "video_id", "video_id", a.limit).select("video_id", "links").show(a.limit or 20, truncate=False)


if __name__ == "__main__":
    main()
