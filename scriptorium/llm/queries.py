"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, hilbert_zones, html_blocks, iblt, langid, lsh_forest, merkle, mixing, partenum, pst, relative_lz, secrets_crf, toxicity
from scriptorium.llm import queries_sql as sql
from scriptorium.llm.common import crc_mod, discard, table


def tokenizer_path(spark: SparkSession) -> str:
    """The vocabulary file: spark.scriptorium.tokenizer, else the installed public one."""
    found = spark.conf.get("spark.scriptorium.tokenizer", None)
    if found:
        return found
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secrets_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets_crf.scan(docs, secrets_crf.fit(docs))


def op2_ipf_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.sample(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_probability").alias("probability"), F.col("mix_weight").alias("weight"), F.col("mix_kept").alias("kept"))


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op4_string_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    return langid.predict(docs, langid.fit(docs.where("not held_out")))


def op5_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    return toxicity.score(docs, toxicity.fit(labelled(docs.where("not held_out"), table(spark, sf_dir, "labels"))))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic of the documents that have a label; of several labels the largest."""
    return docs.select("doc_id", "text").join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")


def op6_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op7_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, words, *sizes = pst.train(docs.where(crc_mod("doc_id", 5) != 1))
    scored = pst.score(docs, model, words, *sizes)
    discard(model.tables, words)
    return scored


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path(spark))


def op9_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.join(table(spark, sf_dir, "documents"), partenum.Rule(words=4, percent=85))


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_hilbert_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_zones.cluster(table(spark, sf_dir, "embeddings")).drop("compared")


def op12_merkle_octopus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op13_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_lz.dedup(table(spark, sf_dir, "documents"), width=13)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_secrets_crf, op2_ipf_mixing, op3_html_blocks, op4_string_kernel_langid, op5_toxicity_trees, op6_iblt_fingerprints, op7_suffix_tree_lm,
        op8_bpe_automaton, op9_partenum_join, op10_lsh_forest, op11_hilbert_zones, op12_merkle_octopus, op13_relative_lz,
    )
    return {f.__name__: f for f in every}


_OP9_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM w),
 n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS x FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
 g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.doc_id WHERE r.c < g.b)
 SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say what the operator does; the others are tested against brute force in tests/llm."""
    return {"op9_partenum_join": _OP9_SQL, "op11_hilbert_zones": sql.clusters(), "op12_merkle_octopus": sql.merkle(), "op13_relative_lz": sql.substrings()}
