"""Retention, compaction, and the loop that runs them."""

from __future__ import annotations

import logging
import math
import threading
from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import functions as F

from ..schema import SIGNALS, stored
from .manifest import Conflict, Snapshot
from .store import ORDER, PLACE, Store, place_of

RETENTION_DAYS = 7
#: Files are merged up to about this size, where a partition has more files than it needs.
TARGET_BYTES = 256 << 20


def expire(store: Store, today: date, days: int = RETENTION_DAYS) -> list[str]:
    """Take partitions out that came in before ``today`` less the retention; returns them.  No data is read."""
    cutoff, gone = (today - timedelta(days=days)).isoformat(), set()
    for signal in SIGNALS:
        old = [d for d in store.manifest(signal).snapshot().live if place_of(d)[1] < cutoff]
        if old:
            store.manifest(signal).commit(remove=old)
            gone |= {f"{signal}/{d.partition('/')[2]}" for d in old}
    return sorted(gone)


def fragmented(state: Snapshot, target: int = TARGET_BYTES, since: str | None = None) -> dict[tuple[str, str], tuple[list[str], int]]:
    """(tenant, day): directories and files they need, of partitions with more files than that.

    From the manifest alone.  A partition of several files may have twice as
    many as it needs, as ranges are never quite even.
    """
    by: dict[tuple[str, str], list] = {}
    for d, (files, size) in state.live.items():
        if since is None or place_of(d)[1] >= since:
            at = by.setdefault(place_of(d), [[], 0, 0])
            at[0].append(d)
            at[1] += files
            at[2] += size
    need = {p: max(1, math.ceil(size / target)) for p, (_, _, size) in by.items()}
    return {p: (dirs, need[p]) for p, (dirs, files, _) in by.items() if files > need[p] * (1 + (need[p] > 1))}


def compact(store: Store, signal: str, target: int = TARGET_BYTES, since: str | None = None, before_commit: Callable[[], object] | None = None) -> int:
    """Rewrite fragmented partitions into sorted files of about ``target`` bytes; the rows stay the same.

    A partition that fits into a file is one; a larger one is cut into ranges
    of service and time, so that a read of either still skips files.  Rows
    that are appended meanwhile stay beside them.  How many partitions.
    """
    state = store.manifest(signal).snapshot()
    todo = fragmented(state, target, since)
    if not todo:
        return 0
    old = [d for dirs, _ in todo.values() for d in dirs]
    rows = store._frame(signal, stored(signal), old)
    wide = {p: need for p, (_, need) in todo.items() if need > 1}
    in_wide = F.coalesce(F.array_contains(F.lit([f"{t}/{d}" for t, d in wide]), F.concat_ws("/", "tenant_id", F.col("ingest_date").cast("string"))), F.lit(False)) if wide else F.lit(False)
    out = rows.where(~in_wide).repartition(max(1, len(todo) - len(wide)), *PLACE)
    if wide:
        ranges = rows.where(in_wide).repartitionByRange(sum(wide.values()), *PLACE, *ORDER[signal])
        out = ranges if len(wide) == len(todo) else out.union(ranges)
    add = store.put(signal, out.sortWithinPartitions(*PLACE, *ORDER[signal]), PLACE)
    if before_commit:  # what others do meanwhile, for tests
        before_commit()
    store.manifest(signal).commit(add, remove=old)
    return len(todo)


def sweep(store: Store, today: date, days: int = RETENTION_DAYS, grace: float = 3600.0) -> dict[str, int]:
    """One round: retention, then compaction, then directories and commits that nobody needs any more.

    A compaction that another commit crossed is left to the next round.
    """
    done = {"expired": len(expire(store, today, days)), "compacted": 0}
    for signal in SIGNALS:
        try:
            done["compacted"] += compact(store, signal)
        except Conflict:
            logging.getLogger(__name__).info("compaction of %s was crossed", signal)
    done["deleted"] = store.vacuum(grace)
    done["forgotten"] = store.forget_versions()
    return done


def start_sweeps(store: Store, days: int = RETENTION_DAYS, every: float = 6 * 3600.0) -> threading.Event:
    """Sweep in a thread of its own, again and again, until the returned event is set.  A round that fails is logged."""
    stop = threading.Event()

    def loop() -> None:
        while not stop.wait(every):
            try:
                sweep(store, datetime.now(timezone.utc).date(), days)
            except Exception:
                logging.getLogger(__name__).exception("sweep failed")

    threading.Thread(target=loop, name="sweeps", daemon=True).start()
    return stop
