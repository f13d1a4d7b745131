import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (id, text) pairs or whole rows; ``clash`` adds columns named like inner ones."""

    def make(rows, clash=False):
        full = [r if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
        table = spark.createDataFrame(full, DOCS)
        if clash:
            from pyspark.sql import functions as F

            for name in ("words", "rank", "size", "unit", "shard", "kept", "bucket", "tokens", "set_id", "stratum", "score"):
                table = table.withColumn(name, F.lit(1))
        return table

    return make
