"""Corpus pipeline: toxicity, near duplicates, secrets, mixing and BPE over whole documents.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents. Null and empty texts pass every stage but the draw like others, whole texts of any
length are worked on, repeated rows become one in the second stage, an empty table gives an empty result, and columns beside
those of documents, whatever their names, pass through all stages but the last. `run` writes each stage's rows to the shared folder and reads them back, so that a
lost executor costs no more than the stage at hand, and deletes them once its result is kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, mixing, partenum, secrets_crf, toxicity
from scriptorium.llm.common import checkpoint_dir, checkpointed, crc_mod, discard, fresh, split_by, table
from scriptorium.llm.queries import labelled, tokenizer_path

#: Near duplicates: five words a shingle and a similarity of 0.8.
RULE = partenum.Rule(words=5, percent=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; learnt from the labelled rows outside of the held-out fold."""
    return toxicity.keep_clean(docs, toxicity.fit(labelled(docs.where(crc_mod("doc_id", 4) != 2), table(spark, sf_dir, "labels"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones: that with the least id, of these that with the least class of its text. Rows are told
    apart by id and text, so rows that share an id, or have none, are judged one by one. Rows without words stay; of rows equal in id and text one stays."""
    found = partenum.join(docs, RULE, classes=True)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    best = found.where("node is not null").groupBy("component").agg(F.min(order).alias("best"))
    rows = found.join(best, "component", "left").withColumn("stays", F.col("node").isNull() | (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.node") == F.col("node"))))
    # Ids of which some row goes, or which several rows have; the rows of all others stay where they are.
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    special = checkpointed(ids.select("doc_id"))
    node = fresh(docs, "_node")
    lost = checkpointed(rows.where("not stays").select(F.col("doc_id").alias(f"{node}_id"), F.col("node").alias(node)).distinct())
    sure, rest = split_by(docs.where("doc_id is not null"), special)
    judged = partenum.with_class(rest.unionByName(docs.where("doc_id is null")), RULE, node).join(lost.withColumnRenamed(node, f"{node}_lost"), F.col("doc_id").cast("long").eqNullSafe(F.col(f"{node}_id")) & (F.col(node) == F.col(f"{node}_lost")), "left_anti")
    kept = judged.dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    discard(found)
    return sure.unionByName(kept)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span replaced by a mask, n_chars set anew."""
    return secrets_crf.redact(docs, secrets_crf.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the calibrated sample draws. A row's own columns travel as one, so that none is taken for one that the sample adds."""
    held = docs.select(F.struct("*").alias("row"), "doc_id", "source", "lang", "text")
    return mixing.sample(held).where("mix_kept").select("row.*")


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the digest of the text that the ids decode to."""
    return bpe.encode_digest(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_bpe),
]

#: Trained trees, fields and hashed draws have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over documents."""
    docs, home = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{home}/{k}")
            docs = spark.read.parquet(f"{home}/{k}")
    result = checkpointed(docs)
    docs.kept_at = home
    discard(docs)
    return result
