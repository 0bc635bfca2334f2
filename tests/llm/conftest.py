import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Columns that clash with names that operators use inside.
EXTRA = {"h": 1, "uid": 2, "range": 3, "node": 4, "score": 5, "factor": 6, "mix_topic": 7, "group": 8, "key": 9, "held_out": 10, "fields": 11}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=True):
    """(doc_id, text) or (doc_id, text, lang, source) as documents with clashing extra columns."""
    full = [(r[0], r[1], *(r[2:4] or ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
    if not extra:
        return spark.createDataFrame(full, SCHEMA)
    return spark.createDataFrame([(*r, *EXTRA.values()) for r in full], SCHEMA + "".join(f", `{c}` int" for c in EXTRA))


@pytest.fixture
def docs_of(spark):
    return lambda rows, extra=True: frame(spark, rows, extra)


LONG = "the quick brown fox jumps over it. " * 30_000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "x"), (6, "same text here, twice."), (6, "same text here, twice."), (None, "no id here"), (7, None, None, None), (8, "\x00 ퟿ é 😀 <|endoftext|>")]


@pytest.fixture
def odd(docs_of):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    return docs_of(ODD)


@pytest.fixture
def nothing(docs_of):
    return docs_of([])
