"""Ingestion: landed request files to stored rows, once each."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store
from ..sources import otlp_json

SIGNALS = ("traces", "logs", "metrics")


def start(store: Store, signal: str, landing: str, checkpoint: str, once: bool = False, interval: str = "1 second") -> StreamingQuery:
    """Stream a folder of request lines into the store.

    A batch is a write under the name of its number: its rows are seen with
    the commit that has the name, so a batch that is run again after a crash,
    wherever that came, is there exactly once.
    """
    def batch(df, number: int) -> None:
        df = df.persist()
        try:
            if not df.isEmpty():
                store.write(signal, df, tag=f"{signal}-{number}")
        finally:
            df.unpersist()

    writer = otlp_json.stream(store.spark, landing, signal).writeStream.queryName(f"ingest-{signal}").option("checkpointLocation", checkpoint).foreachBatch(batch)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
    store.queries.append(query)
    return query


def start_ingest(store: Store, landing: str, checkpoint: str, once: bool = False, interval: str = "1 second") -> list[StreamingQuery]:
    """One stream per signal, from landing/<signal>."""
    out = []
    for signal in SIGNALS:
        store.folder.fs.mkdirs(store.folder.jvm.org.apache.hadoop.fs.Path(f"{landing}/{signal}"))
        out.append(start(store, signal, f"{landing}/{signal}", f"{checkpoint}/{signal}", once, interval))
    return out
