"""Events that come late to the stream stay."""

import os
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from tessera.plans import stream_queries


def test_late_events_are_kept(spark, tmp_path):
    # three batches of files, the newest events first, over 300 days; a batch's watermark counts in the next but one
    for i in range(30):
        ids = list(range(10 * i, 10 * i + 10))
        ts = [datetime(2024, 6, 1) - timedelta(days=10 * i, hours=k) for k in range(10)]
        rows = {"event_id": ids, "ts": pa.array(ts, pa.timestamp("us")), "user_id": ids, "event_type": ["view"] * 10, "value": [1.0] * 10, "props": ["{}"] * 10}
        pq.write_table(pa.table(rows), path := tmp_path / f"events{i:02}.parquet")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    found = stream_queries.stream_dedupe(spark, f"file://{tmp_path}").collect()
    assert sorted(r.event_id for r in found) == list(range(300))
