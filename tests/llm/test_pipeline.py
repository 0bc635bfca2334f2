"""The pipeline against a plain version of each stage, and that the rest stands without this subpackage."""

import hashlib
import os
import shutil
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import mixing, partenum, secrets_crf, toxicity
from scriptorium.llm.common import crc_mod
from scriptorium.llm.queries import labelled, oracle_sql, queries

from test_llm_operators import brute_components

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_data
def test_pipeline_equals_a_plain_version(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(labelled(docs.where(crc_mod("doc_id", 4) != 2), spark.read.parquet(f"{SF}/labels.parquet")))
    marks = toxicity.Marks(model.lexicon)
    rows = {r.doc_id: r for r in docs.collect()}
    clean = [(i, r.text) for i, r in sorted(rows.items()) if toxicity._scores(model, [r.text], marks)[0] < toxicity.THRESHOLD]
    groups = brute_components(clean, corpus_pipeline.RULE)
    kept = [(i, t) for i, t in clean if groups[i][1] == i]
    kept_df = spark.createDataFrame([(i, t, rows[i].lang, rows[i].source, rows[i].n_chars) for i, t in kept], docs.schema)
    scanner, redacted = secrets_crf.Scanner(secrets_crf.fit(kept_df)), []
    for i, t in kept:
        end, out = 0, ""
        for a, _, z in scanner(t)[1]:
            if a >= end:
                out += t[end:a] + "[SECRET]"
            end = max(end, z)
        redacted.append((i, out + t[end:]))
    # Cells, weights and draws from the formulas; only the hash is Spark's.
    plain = spark.createDataFrame([(i, t, rows[i].lang, rows[i].source, len(t)) for i, t in redacted], docs.schema)
    cells = Counter()
    place = {}
    for r in plain.select("doc_id", "source", "lang", "text", mixing.topic().alias("topic"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h")).collect():
        place[r.doc_id] = ((r.source, r.lang, r.topic), ((r.h & (2**64 - 1)) >> 11) / 2**53)
        cells[r.source, r.lang, r.topic] += len(r.text.split())
    import numpy as np

    keys, tokens = list(cells), np.array(list(cells.values()), float)
    goals = [mixing.targets_of({v: sum(t for k, t in cells.items() if k[d] == v) for v in {k[d] for k in keys}}, None, mixing.TEMPER) for d in range(3)]
    f = mixing.rake(keys, tokens, goals) / np.maximum(tokens, 1)
    f = dict(zip(keys, np.where(tokens > 0, f, 1) * mixing.calibrate(tokens, np.where(tokens > 0, f, 1), mixing.BUDGET * tokens.sum())))
    theirs = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = {}
    for i, t in redacted:
        cell, draw = place[i]
        if draw < min(1, f[cell]):
            ids = theirs.encode(t, add_special_tokens=False).ids
            want[i] = (ids, hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < len(redacted) < len(clean) < len(rows)


def test_stages_handle_odd_rows(spark, odd, nothing, tmp_path):
    spark.createDataFrame([(5, 1, 0), (6, 1, 0), (6, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (odd, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = stage(spark, docs, str(tmp_path)).cache()
            docs.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == before
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, "")
    assert kept.where("doc_id = 6").count() == 1 and kept.where("doc_id is null").count() == 1 and kept.count() == 9


def test_own_columns_of_any_name_keep_their_values(spark, tmp_path):
    names = ["_h", "_may", "_bucket", "_place", "_bits", "_met", "_node", "mix_source", "mix_topic", "mix_kept", "node", "component", "row", "stays", "h"]
    rows = [(i, f"some words of text number {i} that nobody else has {i * 7}", "en", "s", 60) for i in range(30)] + [(7, "another text under seven", "en", "s", 3), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, *(f"{n}{k}" for n in names)) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    every = {tuple(r[n] for n in names) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        got = [tuple(r[n] for n in names) for r in out.collect()]
        assert out.columns == docs.columns and set(got) <= every and len(got) == len(set(got)) and len(got) > 15


def test_rows_are_judged_and_not_ids(docs_of):
    a, b = "one two three four five six seven eight nine ten", "other words that have nothing in common with the first ones at all"
    rows = [(1, a), (2, a), (2, b), (3, b), (None, a), (None, a), (None, "only here " * 9), (None, "only here " * 9), (4, ""), (4, ""), (None, ""), (5, b)]
    kept = corpus_pipeline.drop_near_duplicates(None, docs_of(rows), "")
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, a), (2, b), (0, "only here " * 9), (4, ""), (0, "")])


def test_run_deletes_what_it_wrote(spark, docs_of, tmp_path):
    from scriptorium.llm.common import checkpoint_dir

    docs_of([(i, f"text of number {i} and {i * 3} more words") for i in range(12)], extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = corpus_pipeline.run(spark, str(tmp_path)).count()
    home = checkpoint_dir(spark).removeprefix("file:")
    assert before > 0 and not [d for d in os.listdir(home) if d.startswith("pipeline-")]


@needs_data
def test_sql_gives_the_same_rows(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in oracle_sql().items():
        got, want = queries()[name](spark, SF).toPandas(), con.sql(sql).df()
        assert sorted(map(tuple, got[want.columns].itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))


@needs_data
def test_queries_run_on_the_smallest_tables(spark):
    counts = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages", "embeddings")}
    of = {"op3": "pages", "op11": "embeddings"}
    for name, q in queries().items():
        n = q(spark, SF).count()
        assert n == counts[of.get(name.split("_")[0], "documents")] or name.startswith("op10")


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_the_rest_stands_alone(tmp_path, also):
    """Without the two folders, with or without the pipeline: the entry imports, and the rest's quick tests pass."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", *also))
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "r")}
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_exact' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "tests/test_text.py", "-x", "-q", "-p", "no:cacheprovider"], cwd=tmp_path / "r", check=True, env=env)


def test_a_broken_import_inside_is_an_error(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    os.remove(tmp_path / "r" / "scriptorium" / "llm" / "bpe.py")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path / "r", env={**os.environ, "PYTHONPATH": str(tmp_path / "r")}, capture_output=True)
    assert done.returncode and b"bpe" in done.stderr


def test_nothing_else_imports_this_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "scriptorium")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as h:
                    assert "scriptorium.llm" not in h.read()
