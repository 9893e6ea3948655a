"""python -m quillon COMMAND

serve [CONFIG]   ingest what lands, answer over HTTP, and sweep every few hours
sweep [CONFIG]   retention and compaction, once; may run beside serve
dump DIR         framed log records: place, size, and the first service and number of spans of trace payloads
send DIR         land one trace request with one span
"""

from __future__ import annotations

import json
import secrets
import sys
import time
from datetime import date

from .config import load
from .operators.maintenance import start_sweeps, sweep
from .operators.store import Store
from .server import serve
from .session import session
from .sources import framed_log
from .streaming.ingest import start_ingest


def main(args: list[str]) -> int:
    if not args or args[0] not in ("serve", "sweep", "dump", "send"):
        print(__doc__)
        return 2
    if args[0] == "dump":
        n = 0
        for n, r in enumerate(framed_log.summary(session(), args[1]).orderBy("path", "offset").toLocalIterator(), 1):
            print(r.path, r.offset, r.bytes, r.service, r.spans, sep="\t")
        print(f"{n} records")
        return 0
    if args[0] == "send":
        now = time.time_ns()
        span = {"traceId": secrets.token_hex(16), "spanId": secrets.token_hex(8), "name": "test-span", "kind": 1, "startTimeUnixNano": str(now), "endTimeUnixNano": str(now + 1_000_000)}
        resource = {"attributes": [{"key": "service.name", "value": {"stringValue": "test-service"}}]}
        session().createDataFrame([(json.dumps({"resourceSpans": [{"resource": resource, "scopeSpans": [{"spans": [span]}]}]}),)], "value string").coalesce(1).write.mode("append").text(args[1])
        return 0
    config = load(args[1] if len(args) > 1 else None)
    with Store(session(), config.data_dir, config.resolver) as store:
        if args[0] == "sweep":
            print(sweep(store, date.today(), config.retention_days))
            return 0
        start_ingest(store, config.landing_dir, f"{config.data_dir}/_checkpoints", interval=config.batch_interval)
        sweeps = start_sweeps(store, config.retention_days, config.sweep_hours * 3600)
        server = serve(store, config.http_address)
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            server.shutdown()
        finally:
            sweeps.set()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
