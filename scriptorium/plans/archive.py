"""The archive as one object: build it from the curated and fetched tables, keep its index, and ask it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import vocab
from scriptorium.operators import canon, discover, kin, relational, search, stats
from scriptorium.operators.gram_index import GramIndex
from scriptorium.sources import readers, writers


class Archive:
    """Catalogue rows with their search index. Rows are catalogue rows; save() keeps them with the index and its words' grams, which open() reads again."""

    def __init__(self, rows: DataFrame, pattern: str = vocab.ARCHIVE_WORD, suffixes: Sequence[str] = vocab.NAME_SUFFIXES, other: str = vocab.OTHER_PLACE, words: GramIndex | None = None):
        self.words = words
        self.indexed = rows if "combined" in rows.columns else search.index(rows)
        self.pattern, self.suffixes, self.other = pattern, suffixes, other

    @classmethod
    def build(cls, spark: SparkSession, curated: str, metadata: str, known: Sequence[str] = vocab.CAST, misspelt: Mapping[str, str] = vocab.MISSPELT) -> Archive:
        """From two CSV files; a curated row without a video id fails the build."""
        rows = relational.checked_key(readers.curated(spark, curated), T.video_id("links"), "video_id")
        fetched = readers.metadata(spark, metadata)
        return cls(canon.catalogue(relational.enrich(rows, fetched, "video_id", ["duration_sec", "view_count", "upload_date"]), known, misspelt))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Archive:
        return cls(spark.read.parquet(f"{path}/rows"), words=GramIndex(spark, f"{path}/words"))

    def save(self, path: str) -> Archive:
        self.indexed.write.mode("errorifexists").parquet(f"{path}/rows")
        GramIndex.build(search.word_index(self.indexed.sparkSession.read.parquet(f"{path}/rows"), "id"), f"{path}/words", "id")
        return Archive.open(self.indexed.sparkSession, path)

    @property
    def rows(self) -> DataFrame:
        return self.indexed.drop("fields", "combined")

    @property
    def bridge(self) -> DataFrame:
        return self.indexed.select("id", F.explode(F.array_distinct("actors")).alias("actor"))

    def search(self, query: str, sort: str = "views", page: int | None = None, seed: int | None = None, **facets) -> DataFrame:
        """Ranked rows; facets as in search.filters()."""
        found = search.search(self.indexed, query, search.filters(**facets), sort, seed=seed, words=self.words)
        return found if page is None else search.page(found, page)

    def by_id(self, key: str) -> DataFrame:
        return readers.by_id(self.rows, "id", key)

    def facet_counts(self) -> DataFrame:
        """Counts over all rows, whatever is filtered."""
        return stats.facet_counts(self.indexed, {"location": F.array("location"), "actor": F.array_distinct("actors"), "language": F.array_distinct("languages")})

    def find_by_name(self, name: str) -> DataFrame:
        spoken = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("textCommon", F.lit("")))
        return discover.find_by_name(self.rows, name, "viewCount", "id", F.array_join("actors", " "), F.col("rolesNames"), spoken, "lines", "text", "textCommon", self.suffixes, self.pattern)

    def related(self, key: str, limit: int = 6) -> DataFrame:
        return discover.related(self.rows, self.bridge, key, "id", "actor", "location", "viewCount", self.other, limit)

    def related_every(self, limit: int = 6) -> DataFrame:
        """The related rows of all rows, with their rank."""
        return kin.related_every(self.rows, self.bridge, "id", "actor", "location", "viewCount", self.other, limit)

    def actor_names(self) -> DataFrame:
        return discover.actor_names(self.bridge, "actor")

    def rows_of_actor(self, name: str) -> DataFrame:
        return discover.rows_of_actor(self.rows, "actors", name).orderBy(F.coalesce("viewCount", F.lit(0)).desc(), "id")

    def co_stars(self, name: str, top: int | None = 8) -> DataFrame:
        return discover.co_stars(self.bridge, name, "id", "actor", top)

    def actor_profile(self, name: str) -> dict[str, DataFrame]:
        own = discover.rows_of_actor(self.rows, "actors", name)
        return {"totals": discover.actor_profile(self.rows, self.bridge, name, "id", "actor", "viewCount"), "coStars": self.co_stars(name), "catchphrases": discover.catchphrases(own.withColumn("ord", F.coalesce("seq", F.lit(2**31 - 1))), "textCommon", "ord"), "rows": self.rows_of_actor(name)}

    def stats(self, leads: Sequence[str] = vocab.LEADS, candidates: Sequence[str] = vocab.CANDIDATES) -> dict[str, DataFrame]:
        """All sections. A caller that reads many of them may persist `rows` before and release them after, as export() does."""
        return stats.build_stats(self.rows, leads, candidates, self.pattern, self.other)

    def phrase_tiles(self, phrases: DataFrame) -> DataFrame:
        """The most viewed row for each phrase of topPhrases."""
        said = self.rows.withColumn("_said", F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("textCommon", F.lit("")))))
        return discover.phrase_tiles(phrases, "phrase", said, "_said", "id", "viewCount")

    def export(self, rows_path: str, stats_path: str) -> None:
        """Rows as JSON lines, statistics as one JSON document."""
        self.rows.persist()
        try:
            writers.json_lines(self.rows, rows_path)
            writers.json_document(self.stats(), stats_path)
        finally:
            self.rows.unpersist()
