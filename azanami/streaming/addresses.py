"""Address resolution of a stream: each micro-batch goes through the batch plan, with the tables as they stand.

An addition for feeds; the batch plan keeps no state between addresses, so none is needed here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from azanami.plans.engine import GeoEngine


def geocode_stream(engine: GeoEngine, addresses: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start resolving a stream of (id, address) to Parquet at ``out``; a batch that is run again replaces its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        engine.geocode(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = addresses.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
