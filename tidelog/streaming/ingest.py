"""Continuous ingest: every micro-batch becomes one put. A late row has a lower seq and loses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.table import Table


def ingest(stream: DataFrame, table: Table, checkpoint: str, order_by: str | None = None, delete_col: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a table. `order_by` says which row of a key is last in a batch (else the
    batch's last one); rows where `delete_col` is true are deletes. A batch that is run again after a failure puts the same rows again,
    under a higher seq: the visible rows are the same."""

    def one(df: DataFrame, batch_id: int) -> None:
        if delete_col is None:
            table.put_all(df, order_by)
        else:
            table.apply_all(df, delete_col, order_by)
        table.flush()

    w = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
