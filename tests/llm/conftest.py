import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and long texts, repeated rows, ties, surrogates and odd characters.
ROWS = [
    (1, "The licence: licensed under CC BY-NC 4.0. Write to a.b@mail.example.com or +1 (555) 010-9999 now", "en", "s1", 90),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, "card 4539 1488 0343 6467 and 10.0.0.255, not 10.0.0.256; all rights reserved. 😀 naïve ÉCOLE", "en", "s2", 80),
    (4, "card 4539 1488 0343 6467 and 10.0.0.255, not 10.0.0.256; all rights reserved. 😀 naïve ÉCOLE", "en", "s2", 80),
    (5, "GNU General Public License, version 3; cc\tby cc by", "fr", None, 50),
    (6, "word " * 30_000 + "end\x00 of\nit", "de", "s2", 150_010),
    (7, "x" * 20_000 + "@" + "y" * 5_000 + "." + "1" * 3_000, "de", "s3", 28_000),
    (8, "   \n\t ", "en", "s3", 6),
    (9, "one two three four five six seven eight nine ten", "en", "s4", 48),
    (10, "one two three four five six seven eight nine ten", "en", "s4", 48),
    (None, "one two three four five six seven eight nine eleven", "en", "s4", 51),
    (12, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 +123", "en", "s1", 30),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every edge case, and a column whose name clashes with names used inside."""
    return spark.createDataFrame([(*r, "extra") for r in ROWS], DOCS + ", score string").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def rows():
    return ROWS
