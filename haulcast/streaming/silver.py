"""The row-wise Silver cleaning over a stream of Bronze order lines.

It keeps no state, so the batch functions serve unchanged and nothing needs a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from haulcast.operators.silver import ORDER_RULES, add_order_flags
from haulcast.sources.quality import keep_valid


def start_silver(bronze_orders: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append cleaned order lines to Parquet until the source has nothing new."""
    silver = add_order_flags(keep_valid(bronze_orders, ORDER_RULES))
    writer = silver.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
