"""Staged transactions as a stream of files: each micro-batch is enriched and appended like a daily load, with the stream's batch number as batch id."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import load
from ..schemas import TABLES
from ..sources.warehouse import Warehouse


def start(spark: SparkSession, folder: str, w: Warehouse, checkpoint: str, first_batch: int = 1, clock: Callable[[], datetime] = datetime.now) -> StreamingQuery:
    """Follow a folder of Parquet files of staged transactions until what is there now has been loaded."""

    def each(rows: DataFrame, number: int) -> None:
        batch_id, run_ts = first_batch + number, F.lit(clock()).cast("timestamp_ntz")
        # A batch that is delivered again finds what the first delivery wrote: each table in one append for all dates, or not at all.
        t = {n: w[n] for n in ("dim_account", "dim_customer", "dim_exchange_rates")} | {"stg_transactions": rows}
        facts = w["fact_transaction"]
        dates = [r.load_date for r in rows.select("load_date").distinct().collect()]
        if dates and all(load.rejected(w, d, batch_id).isEmpty() for d in dates):
            w.append("stg_transaction_errors", reduce(DataFrame.unionByName, [load.rejects(t, d, batch_id) for d in dates]))
        if dates and all(load.loaded(t | {"fact_transaction": facts}, d, batch_id).isEmpty() for d in dates):
            w.append("fact_transaction", reduce(DataFrame.unionByName, [load.enriched(t, d, batch_id, run_ts) for d in dates]), run_ts)

    stream = spark.readStream.schema(TABLES["stg_transactions"].schema).parquet(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
