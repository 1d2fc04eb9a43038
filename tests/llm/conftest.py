from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Real rows, and the odd ones: nulls, empties, copies, one very long text."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = "word " * 3000 + " ".join(f"tok{k % 700}" for k in range(60_000))
    odd = [
        (100_001, None, "en", "src1", None), (100_002, "", None, None, 0), (100_003, " \n\t ", "en", "src1", 4), (100_004, long, "en", "src0", len(long)),
        (100_005, "same text again and again here", "en", "src2", 30), (100_005, "same text again and again here", "en", "src2", 30), (None, "a row without an id at all", "en", "src3", 26),
        (100_006, "İstanbul 'S ☃ <|endoftext|> \u0085x", "tr", "src 9", 20),
    ]
    return base.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(odd, SCHEMA)).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
