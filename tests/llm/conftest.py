from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, h string, key int, doc string"


@pytest.fixture(scope="session")
def make(spark):
    """A ``documents`` table of (doc_id, text[, source, lang]) rows, with extra columns of clashing names."""

    def table(rows):
        full = []
        for r in rows:
            doc_id, text, source, lang = (*r, *("s", "en")[len(r) - 2 :])[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text), "x", None, 7, "y"))
        return spark.createDataFrame(full, SCHEMA)

    return table


LONG = "Long words go on and on. " * 40_000

#: Null text, null id, empty, blank, one very long, repeated rows, equal texts, ties.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (6, "two words"), (6, "two words"), (None, "no id here"), (None, None),
    (7, LONG), (8, "Ünïcödé ÄÖÜ 東京 🎉 line\nsecond line\r\nthird"), (9, "a b c d e f g"), (10, "A b C d e f G"), (11, "x" * 3000),
]


@pytest.fixture(scope="session")
def odd(make):
    return make([(i, t, None if k % 4 == 0 else "s", None if k % 3 == 0 else "en") for k, (i, t) in enumerate(ODD)])


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
