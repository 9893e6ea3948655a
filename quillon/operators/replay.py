"""Framed logs into a store, from where the last replay ended."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import framed_log, otlp_binary, otlp_json
from .store import Store

HEAD_BYTES = 8


def replay(store: Store, signal: str, path: str, tenant: str | None = None) -> dict[str, int]:
    """Write the envelopes of all records that were not replayed before; the offsets reached, by file.

    The payload of a record is one envelope in protobuf form; bad checksums
    and malformed payloads are skipped, a cut-off end is looked at again next
    time.  Offsets are recorded in the commit that shows the rows, so a replay
    that is run again after a crash repeats nothing.
    """
    mark = f"replay:{path.rstrip('/')}:"
    before = {k.removeprefix(mark): v for k, v in store.manifest(signal).snapshot().marks.items() if k.startswith(mark)}
    found = framed_log.tolerant(store.spark, path, before)
    ends = found.groupBy("path").agg(F.max(F.col("offset") + HEAD_BYTES + F.octet_length("payload")).alias("end"))
    reached = {r.path: r.end for r in ends.collect()}  # a row for each file
    if reached:
        # what was appended since is left to the next replay
        upto = store.spark.createDataFrame(list(reached.items()), "path string, end bigint")
        now = found.join(F.broadcast(upto), "path").where(F.col("offset") < F.col("end"))
        store.write(signal, otlp_json.envelopes(otlp_binary.lines(now, signal), signal), tenant, marks={mark + k: v for k, v in reached.items()})
    return before | reached
