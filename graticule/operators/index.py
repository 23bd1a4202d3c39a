"""The corpus index: lengths, postings, document frequencies, statistics and vectors as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.functions.text import token_count, tokens
from graticule.operators import scoring

#: Rows up to which a measured frame is broadcast; beyond that the join is a shuffle join.
BROADCAST_ROWS = 200_000
#: Terms up to which a stored index is read by a filter on the terms.
PUSHED_TERMS = 2_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the frame has at most `limit` rows (counted here), else the frame as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def lengths(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, length) of the chunks that have a token; chunks without one are in no index."""
    return chunks.select(key, token_count(F.col(text)).alias("length")).where("length > 0")


def corpus_stats(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """One row: number of chunks and of tokens, and the mean length to six decimals (as it is stored)."""
    found = lengths(chunks, key, text)
    return found.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("length").alias("total_tokens")).select(
        "n_chunks", F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), F.round(F.col("total_tokens") / F.col("n_chunks"), 6).alias("avgdl")
    )


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, length). With `terms`, only those terms' postings.

    A chunk is one row, so its terms are counted in the task that reads it and no token is exchanged. With `terms`, the others
    are dropped before they are counted.
    """
    if terms is None:
        return scoring.term_counts(chunks, key, text)
    found = chunks.select(key, tokens(F.col(text)).alias("_tokens"))
    each = found.select(key, F.size("_tokens").cast("long").alias("length"), F.explode("_tokens").alias("term"))
    each = each.join(small(terms.select("term")), "term", "left_semi")
    return each.groupBy(key, "term", "length").agg(F.count(F.lit(1)).alias("tf")).select(key, "term", "tf", "length")


def document_frequency(posted: DataFrame) -> DataFrame:
    """(term, df)."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5) + 1)."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


# Names of an index's facts, in order.
META = ["version", "created_at", "n_chunks", "avgdl", "embeddings_enabled", "embedding_model_id", "embedding_dim", "embedding_max_chars", "embedding_batch_size", "summary_enabled", "summary_model_id", "summary_units", "summary_avgdl", "summary_max_input_chars", "summary_max_output_tokens", "summary_unit_max_tokens", "chunk_max_chars_part", "chunk_max_chars_section", "chunk_max_chars_topic", "chunk_granularity_scheme"]


def meta(chunks: DataFrame, settings: dict[str, str], vectors: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """(key, value) of an index's facts as text: what is counted here, the rest from `settings` (unset ones are empty)."""
    spark = chunks.sparkSession
    one, two = (corpus_stats(x).first() if x is not None else None for x in (chunks, summaries))
    dim = vectors.agg(F.max(F.size("vector"))).first()[0] if vectors is not None else None
    counted = {
        "n_chunks": str(one["n_chunks"]),
        "avgdl": f"{one['avgdl'] or 0:.6f}",
        "embeddings_enabled": "1" if vectors is not None else "0",
        "embedding_dim": str(dim or 0),
        "summary_enabled": "1" if two and two["n_chunks"] else "0",
        "summary_units": str(two["n_chunks"] if two else 0),
        "summary_avgdl": f"{two['avgdl']:.6f}" if two and two["n_chunks"] else "0",
        "chunk_granularity_scheme": "topic/section/part",
    }
    return spark.createDataFrame([(k, counted.get(k, str(settings.get(k, "")))) for k in META], "key string, value string")


def l2_normalize(vector: Column) -> Column:
    """A vector at unit length in single precision; a zero vector stays."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(wide, lambda x: (x / F.when(norm == 0, F.lit(1.0)).otherwise(norm)).cast("float"))


@dataclass(frozen=True)
class CorpusIndex:
    """An index as tables. `chunks` has chunk_id, doc_id, page_id and text at least."""

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    vectors: DataFrame | None = None

    @staticmethod
    def build(chunks: DataFrame, vectors: DataFrame | None = None) -> CorpusIndex:
        posted = postings(chunks)
        return CorpusIndex(chunks, posted, document_frequency(posted), corpus_stats(chunks), vectors)

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """Postings of these terms. Stored postings lie in order of their terms, so a few terms are read by their place."""
        wanted = terms.limit(PUSHED_TERMS + 1).collect()  # bounded by the limit
        if len(wanted) <= PUSHED_TERMS:
            return self.postings.where(F.col("term").isin([r["term"] for r in wanted]))
        return self.postings.join(small(terms), "term", "left_semi")

    def tables(self) -> dict[str, DataFrame]:
        named = {"chunks": self.chunks, "postings": self.postings, "terms": self.terms, "meta": self.stats}
        return named | ({"embeddings": self.vectors} if self.vectors is not None else {})

    def save(self, path: str) -> None:
        """Write every table under a folder and commit them together: a reader has the old index until all of the new one is there."""
        from graticule.operators.store import Store

        store = Store(self.chunks.sparkSession, path)
        before = store.snapshot()
        tables = self.tables()
        tables["postings"] = tables["postings"].repartitionByRange("term").sortWithinPartitions("term")
        store.commit([store.write(tables)], before)

    @staticmethod
    def load(spark: SparkSession, path: str, embeddings: bool = False) -> CorpusIndex:
        """The index as last committed; it stays the same while a new one is written."""
        from graticule.operators.store import Store

        store = Store(spark, path)
        held = store.snapshot()
        read = lambda name: store.table(name, held)
        return CorpusIndex(read("chunks"), read("postings"), read("terms"), read("meta"), read("embeddings") if embeddings else None)

    def ready(self) -> bool:
        """Whether there is anything to search."""
        return bool(self.chunks.limit(1).count())

    def summary_ready(self, summaries: DataFrame | None) -> bool:
        """Whether there is a summary with a token to route by."""
        return summaries is not None and bool(lengths(summaries).limit(1).count())

    def embeddings_ready(self) -> bool:
        """Whether there are vectors, all of one dimension."""
        if self.vectors is None:
            return False
        least, most = self.vectors.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
        return bool(least) and least == most
