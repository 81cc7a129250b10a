"""The streaming trailing detector against the batch rule, with shuffled and late files."""

from datetime import datetime, timedelta

import numpy as np

from sensorspark.session import prepare, scratch_path
from sensorspark.streaming import stream

START = datetime(2025, 1, 1)
DDL = "timestamp timestamp, entity string, x double"


def batch(rows, window=5, threshold=1.0):
    """Flags of every row against the ``window`` rows of its entity before it."""
    out = {}
    for entity in {e for _, e, _ in rows}:
        own = sorted((t, v) for t, e, v in rows if e == entity)
        for i, (t, v) in enumerate(own):
            past = np.array([np.nan if p is None else p for _, p in own[max(0, i - window) : i]], float)
            past = past[~np.isnan(past)]
            sd = past.std(ddof=1) if len(past) > 1 else 0.0
            judged = i >= window and sd > 0
            out[entity, t] = None if judged and v is None else bool(judged and abs(v - past.mean()) > threshold * sd)
    return out


def test_shuffled_files_equal_the_batch_and_late_rows_are_refused(spark):
    prepare(spark)
    rng = np.random.default_rng(4)
    rows = [
        (START + timedelta(hours=h), e, None if rng.random() < 0.1 else float(rng.normal()))
        for e in ("a", "b") for h in range(48)
    ]
    end = (START + timedelta(hours=100), "end", 0.0)
    late = [(START + timedelta(hours=h), "a", 99.0) for h in (2, 3)]
    path = scratch_path(spark, "arriving")
    groups = [[rows[i] for i in rng.permutation(len(rows)) if lo <= (rows[i][0] - START).total_seconds() / 3600 < lo + 12] for lo in (0, 12, 24, 36)]
    # Hours of two neighbouring files are swapped, within the allowed lateness.
    groups[0], groups[1] = groups[0][::2] + groups[1][::2], groups[0][1::2] + groups[1][1::2]
    for part in [*groups, [end], late]:
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(path)
    arriving = stream.read_stream(spark, path, spark.createDataFrame([], DDL).schema, files_per_trigger=1)
    flagged = stream.trailing_flags(arriving, "entity", "x", window=5, threshold=1.0, lateness="24 hours")
    queries = []
    result = stream.read_result(spark, stream.run_available(flagged, "flags", queries)).collect()
    got = {(r["entity"], r["timestamp"]): r["is_anomaly"] for r in result}
    assert got == batch(rows) and len(result) == len(rows)
    assert any(got.values()) and None in got.values()
    assert stream.late_rows(queries[0]) == len(late)
