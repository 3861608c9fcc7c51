"""Incremental chunking and indexing of a growing folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill import schema
from corpusmill.plans.build import Embedder, vector_rows
from corpusmill.sources import buckettable, vectortable


def chunk_stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of a chunk store folder as a stream."""
    return spark.readStream.schema(schema.CHUNK).parquet(path)


def index_stream(
    chunks: DataFrame, root: str, embed: Embedder, model: str, checkpoint: str, build: str,
    after: Callable[[int], None] | None = None, buckets: int = buckettable.BUCKETS,
) -> StreamingQuery:
    """Upsert arriving chunks into the bucketed vector table below ``root``; stops when the backlog is done.

    ``build`` names the state of the chunk store that arrives and is kept with every row. A batch replaces rows
    of the sources it brings only if they come from another build, so a source whose chunks arrive in
    several batches stays whole. Only buckets of the batch's ids and sources are rewritten. The version is named after the build and
    the batch: a batch repeated after a failure finds its version complete and only publishes it, or writes it again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        fresh = vector_rows(batch, embed, model, build).withColumn("_seq", F.monotonically_increasing_id())
        same = F.coalesce(vectortable.metadata_field("build"), F.lit("")) == build
        buckettable.change(
            batch.sparkSession, root, f"v-{build}-{number:08d}", fresh, gone=batch.select("source").distinct(), keep=same, buckets=buckets
        )
        if after:
            after(number)

    return chunks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
