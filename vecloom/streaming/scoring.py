"""Scoring of streams against a stored database: an extension, stateless, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecloom.operators.knn import nearest
from vecloom.sources.store import VectorDB


def score_stream(vectors: DataFrame, db: VectorDB, out: str, checkpoint: str, id_col: str = "idx", vector_col: str = "embedding", once: bool = False) -> StreamingQuery:
    """Writes (query_id, id, distance) of every arriving vector's best match to Parquet under out/batch=N.

    A batch that is run again after a failure replaces its own folder, so every row is written once.
    """

    def score(batch: DataFrame, number: int) -> None:
        best = nearest(batch, db.vectors, db.metric, query_id=id_col, base_id="idx", query_vector=vector_col, dim=db.dim)
        best.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = vectors.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
