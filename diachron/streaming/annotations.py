"""Incremental maintenance: new papers are annotated as they arrive, and yearly edges grow with them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import annotate as ann
from ..operators import lexicon as lex
from ..operators import network as net
from ..sources.papers import text_unit
from ..storage import Scratch


def annotate_batch(papers: DataFrame, dictionary: DataFrame, longest: int = ann.MAX_TOKENS, store: Scratch | None = None) -> DataFrame:
    """``arxiv_id, phrases, n_phrases, year`` of a batch of papers."""
    toks = lex.tokens(papers.select("arxiv_id", text_unit().alias("text")))
    found = ann.collected(ann.absorb(ann.longest_match(toks, dictionary, longest, store)))
    return found.join(papers.select(F.col("arxiv_id").alias("doc"), "year"), "doc").select(F.col("doc").alias("arxiv_id"), "phrases", "n_phrases", "year")


def follow(papers: DataFrame, dictionary: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the annotations and edge counts of every micro-batch under ``path``.

    Each batch writes to folders named by its number and overwrites them, so a batch that is run
    again after a failure leaves one copy. Edge counts of batches add up, as a paper is in one.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        store = Scratch(batch.sparkSession, "batch")
        rows = annotate_batch(batch, dictionary, store=store).persist()
        rows.write.mode("overwrite").parquet(f"{path}/annotations/batch={number}")
        postings = rows.select("year", F.col("arxiv_id").alias("doc"), F.explode("phrases").alias("phrase"))
        net.edges(postings).write.mode("overwrite").parquet(f"{path}/edges/batch={number}")
        store.close()
        rows.unpersist()
        batch.unpersist()

    return papers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edges(batches: DataFrame) -> DataFrame:
    """Yearly edges from the per-batch counts."""
    return batches.groupBy("year", "a", "b").agg(F.sum("w").alias("w"))
