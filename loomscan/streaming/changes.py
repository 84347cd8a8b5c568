"""Change feed of a stream of snapshots: each app's last findings are kept as state and compared with the next scan."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "app_id long, scan_id long, new int, resolved int, late boolean"
#: State of a bucket of apps: each app's id, the time of its last scan (epoch microseconds) and what that found.
HELD = "apps array<string>, at array<long>, fingerprints array<array<string>>"
#: Buckets that apps are dealt to by hash. Calling Python for a group costs far more than an app's few scans, so a call takes a
#: bucket. A checkpoint holds as long as this number.
BUCKETS = 8192


def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Repeated findings count as often as they occur; an app's first scan has no changes; a scan older than the one
    held is late, and changes nothing."""
    last = {app: (at, found) for app, at, found in zip(*state.get, strict=True)} if state.exists else {}
    whole = lambda v: None if v is None else int(v)
    rows = [(whole(at), whole(scan_id), app, found) for b in batches for at, scan_id, app, found in zip(b["at"], b["scan_id"], b["app_id"], b["fingerprints"], strict=True)]
    rows.sort(key=lambda row: (row[0] is None, row[0] or 0, row[1] is None, row[1] or 0))
    out = []
    for at, scan_id, app, found in rows:
        found = [] if found is None else list(found)
        before_at, held = last.get(app, (None, None))
        if before_at is not None and at is not None and at < before_at:
            out.append((whole(app), scan_id, 0, 0, True))
            continue
        before, now = set(found if held is None else held), set(found)
        out.append((whole(app), scan_id, sum(f not in before for f in found), sum(f not in now for f in held or ()), False))
        last[app] = at, found
    state.update((list(last), [at for at, _ in last.values()], [found for _, found in last.values()]))
    columns = zip(*out, strict=True) if out else [()] * 5
    yield pd.DataFrame({n: pd.Series(c, dtype=t) for n, t, c in zip(("app_id", "scan_id", "new", "resolved", "late"), ("Int64", "Int64", "int32", "int32", "bool"), columns, strict=True)})


def change_stream(scans: DataFrame) -> DataFrame:
    """One row a scan from (app_id, scan_id, scanned_at timestamp, fingerprints array<string>); state is one scan an app."""
    text = lambda c: c.cast("string")  # noqa: E731  # pandas would make floats of numbers beside nulls
    own = scans.select(F.pmod(F.xxhash64("app_id"), F.lit(BUCKETS)).alias("bucket"), text(F.col("app_id")).alias("app_id"), text(F.col("scan_id")).alias("scan_id"), text(F.unix_micros("scanned_at")).alias("at"), "fingerprints")
    return own.groupBy("bucket").applyInPandasWithState(step, CHANGE, HELD, "append", GroupStateTimeout.NoTimeout)
