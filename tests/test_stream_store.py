"""The embedding store under micro-batches: touched buckets only, replays, clearing."""

import os

from conftest import table
from rankmill.streaming import apply as ap

DDL = "store_id long, product_id long, generation_id long, revision long, sequence long, status string, source_hash string, vector binary"


def rows_of(spark, *rows):
    return spark.createDataFrame([(1, p, g, r, s, status, f"h{r}", bytes([r])) for s, (p, g, r, status) in enumerate(rows)], DDL)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def state(spark, path):
    return table(ap.read_store(spark, path), "product_id", "generation_id", "revision", "status")


def test_untouched_buckets_keep_their_files_and_replays_change_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    assert state(spark, path) == []
    ap.apply_batch(rows_of(spark, *[(p, 1, 1, "COMPLETE") for p in range(40)], (3, 2, 1, "COMPLETE")), 0, path, 16)
    first, before = files(path), state(spark, path)
    assert len(before) == 41
    change = rows_of(spark, (3, 1, 2, "COMPLETE"), (3, 1, 5, "DELETED"), (4, 1, 0, "COMPLETE"))
    ap.apply_batch(change, 1, path, 16)
    after, later = files(path), state(spark, path)
    assert {f: m for f, m in after.items() if f in first} == first  # nothing that stood there was touched
    assert 1 <= len(after) - len(first) <= 2
    assert set(later) - set(before) == {(3, 1, 5, "DELETED")} and len(later) == 41
    ap.apply_batch(change, 1, path, 16)  # the batch comes again
    assert state(spark, path) == later and len(files(path)) == len(after)
    ap.apply_batch(rows_of(spark).limit(0), 2, path, 16)
    assert state(spark, path) == later


def test_uncommitted_versions_do_not_count_and_old_ones_can_go(spark, tmp_path):
    path = str(tmp_path / "store")
    for i in range(4):
        ap.apply_batch(rows_of(spark, (7, 1, i + 1, "COMPLETE")), i, path, 4)
    os.remove(f"{path}/version=3/_SUCCESS")  # a batch that did not end
    assert state(spark, path) == [(7, 1, 3, "COMPLETE")]
    ap.apply_batch(rows_of(spark, (7, 1, 9, "COMPLETE")), 3, path, 4)
    assert state(spark, path) == [(7, 1, 9, "COMPLETE")]
    assert ap.remove_superseded(spark, path) == 2 and state(spark, path) == [(7, 1, 9, "COMPLETE")]
    ap.apply_batch(rows_of(spark, (7, 1, 10, "COMPLETE")), 3, path, 4)  # replay from the version before
    assert state(spark, path) == [(7, 1, 10, "COMPLETE")]
