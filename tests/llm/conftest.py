import pytest

from pollgauge.llm.registry import ship

SF = "/root/testdata/sf0.01"
DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside.
CLASHES = ("key", "fp", "words", "kept", "row", "v", "id", "guess", "path", "payload", "n", "__n", "shard", "language", "score", "conv")


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    return ship(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Build documents from (doc_id, text[, lang, source]), with extra columns whose names operators use too."""

    def build(rows, clashes=True):
        full = [(*r, *("en", "s0")[len(r) - 2:], None) for r in rows]
        extra = ", ".join(f"`{c}` string" for c in CLASHES)
        if not clashes:
            return spark.createDataFrame(full, DOCUMENT)
        return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in full], f"{DOCUMENT}, {extra}")

    return build


@pytest.fixture(scope="session")
def sf_texts():
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
