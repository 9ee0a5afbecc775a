import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from (doc_id, text, lang, source) rows, shorter ones filled with nulls."""

    def make(rows, partitions=3):
        full = []
        for r in rows:
            i, t, lang, source = (*r, None, None, None)[:4]
            full.append((i, t, lang, source, None if t is None else len(t)))
        return spark.createDataFrame(full, COLUMNS).repartition(partitions)

    return make


#: Rows that every operator has to take: nulls, blanks, odd white space, code points of 2 to 4 bytes, a long text, repeats.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "é中😀 \x1c\x85 a\x00b"),
    (6, "word " * 30000),
    (6, "word " * 30000),
    (7, "one"),
    (None, "null id"),
    (None, None),
    (8, "\n\n\nx\n"),
]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def empty(documents, spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows beside columns that operators add themselves, or that differ in case only."""
    from pyspark.sql import functions as F

    names = ["TEXT", "Doc_ID", "score", "shard", "slot", "bucket", "kept", "size", "digest", "n_lines", "mix_repeat", "sequence_id", "offset", "_group", "_hash"]
    return odd.select("*", *[F.lit(7).alias(n) for n in names])
