"""A kept index for typo-tolerant search: inverted lists of positional grams over distinct words, and of rows over words."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.distance import characters, substring_distance

#: Folders that grams and words are dealt into, and lengths of grams.
BUCKETS, SIZES = 64, (1, 2)


def _bucket(c: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.col(c).cast("binary")), F.lit(buckets)).cast("int").alias("bucket")


def grams(words: DataFrame, size: int) -> DataFrame:
    """(word, n, gram, at): each word's grams, one row for each place from 0."""
    # A match looks ahead at a gram and takes one character, so a word is read once.
    cut = F.regexp_extract_all(F.col("word"), F.lit(f"(?s)(?=({'.' * size}))."), F.lit(1))
    return words.select("word", F.length("word").alias("n"), F.posexplode_outer(cut).alias("at", "gram")).where("gram is not null")


class GramIndex:
    """The index under a folder: `grams` by length and bucket of the gram, `words` by bucket of the word, each sorted within its files.

    A search reads the lists of the query's grams only. A part of a word that k edits turn into a query of n characters has
    at least n - q + 1 - k q of the query's grams of q characters, shifted against each other by k places at most; words with
    as many are compared exactly, and the rows of those that are near come from the words' own buckets. No search reads all words.
    """

    def __init__(self, spark: SparkSession, home: str, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.home, self.key, self.buckets = spark, home, key, buckets

    @classmethod
    def build(cls, words: DataFrame, home: str, key: str, buckets: int = BUCKETS) -> GramIndex:
        """From distinct (word, key) rows, written once."""
        index = cls(words.sparkSession, home, key, buckets)
        rows = words.select("word", key, _bucket("word", buckets))
        # Files of a bucket by size, so that a frequent word's or gram's list may have many.
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{home}/words")
        # The vocabulary is small beside its grams, so its rows are dealt to all tasks before they are cut.
        parts = int(index.spark.conf.get("spark.sql.shuffle.partitions"))
        index.spark.read.parquet(f"{home}/words").select("word").distinct().repartition(parts, "word").write.parquet(f"{home}/vocabulary")
        vocabulary = index.spark.read.schema("word string").parquet(f"{home}/vocabulary")
        every = None
        for size in SIZES:
            part = grams(vocabulary, size).select(F.lit(size).alias("size"), _bucket("gram", buckets), "gram", "word", "n", "at")
            every = part if every is None else every.unionByName(part)
        every.hint("rebalance", "size", "bucket").sortWithinPartitions("size", "bucket", "gram", "n").write.partitionBy("size", "bucket").parquet(f"{home}/grams")
        return index

    def lists(self, query: str, size: int) -> DataFrame:
        """The inverted lists of a query's grams."""
        own = sorted({query[i : i + size] for i in range(len(query) - size + 1)})
        at = sorted({crc32(g.encode()) % self.buckets for g in own})
        return self.spark.read.parquet(f"{self.home}/grams").where((F.col("size") == size) & F.col("bucket").isin(at) & F.col("gram").isin(own))

    def candidates(self, query: str, edits: int) -> DataFrame:
        """Words that pass the count of grams."""
        n = len(query)
        size = max((q for q in SIZES if n >= q * (edits + 1)), default=0)
        if not size:
            raise ValueError(f"{edits} edits of {n} characters leave no gram")
        need = n - size + 1 - edits * size
        places: dict[str, list[int]] = {}
        for i in range(n - size + 1):
            places.setdefault(query[i : i + size], []).append(i)
        own = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for g, at in places.items() for x in (g, at)])
        met = F.transform(F.element_at(own, F.col("gram")), lambda i: F.struct((F.col("at") - i).alias("shift"), i.alias("place")))
        pairs = self.lists(query, size).where(F.col("n") >= n - edits).select("word", met.alias("met")).groupBy("word").agg(F.flatten(F.collect_list("met")).alias("met"))  # bounded by the word's length

        def together(p: Column) -> Column:
            near = F.filter("met", lambda x: (x["shift"] >= p["shift"]) & (x["shift"] <= p["shift"] + edits))
            return F.size(F.array_distinct(F.transform(near, lambda x: x["place"]))) >= need

        # The word hangs on the list, so that no test of it moves to before the grams of a word have met.
        return pairs.where((F.size("met") >= need) & F.exists("met", together)).select(F.when(F.size("met") >= need, F.col("word")).alias("word"))

    def near(self, query: str, most: float) -> DataFrame:
        """(word, near): words with a part whose distance to the query is at most a share of its length."""
        n = len(query)
        d = substring_distance("word", query) / F.lit(float(n))
        return self.candidates(query, int(most * n)).withColumn("near", d).where(F.col("near") <= most)

    def rows(self, query: str, most: float) -> DataFrame:
        """(key, near): the least distance of a row's near words."""
        near = self.near(query, most).select("word", "near", _bucket("word", self.buckets))
        words = self.spark.read.parquet(f"{self.home}/words")
        return words.join(near, ["bucket", "word"]).groupBy(self.key).agg(F.min("near").alias("near"))
