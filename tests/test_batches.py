"""Arrow batches are bounded for every query and operator that hands texts to Python (F2, F4, F6 to F9)."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graticule.operators import chunking, scoring
from graticule.operators.batches import BATCH_BYTES, bound_batches
from graticule.sources.tables import table

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    held = spark.conf.get(KEY)
    spark.conf.set(KEY, str(1 << 30))
    yield spark
    spark.conf.set(KEY, held)


def test_long_texts_come_in_several_batches(unbounded, sf_dir):
    @F.pandas_udf("long")
    def characters(text: pd.Series) -> pd.Series:
        return pd.Series([int(text.str.len().sum())] * len(text))

    table(unbounded, sf_dir, "documents")
    rows = unbounded.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 19).alias("text"))
    assert rows.select(characters("text").alias("n")).agg(F.max("n")).first()[0] <= BATCH_BYTES + (1 << 19)


@pytest.mark.parametrize("use", [lambda rows: chunking.chunk_pages(rows), lambda rows: scoring.term_counts(rows, "page_id", "markdown")])
def test_operators_bound_their_batches(unbounded, use):
    use(unbounded.createDataFrame([("d", 1, "t", "p", "# a\n\nb")], "doc_id string, page_id long, doc_title string, page_title string, markdown string"))
    assert int(unbounded.conf.get(KEY)) == BATCH_BYTES
    unbounded.conf.set(KEY, "1000")
    bound_batches(unbounded)
    assert unbounded.conf.get(KEY) == "1000"
