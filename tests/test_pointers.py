"""A catalog of pointers gives what a merge of whole records gives, and moves no text that is there."""

import random

from postlark.operators import catalog, pointers, sync
from postlark.sources import files

RECORDS = "stable_key string, payload_hash string, posted_at string, updated_at string, record_json string"


def test_merges_in_a_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pointers, "RUNS", 2)
    folder, draw = f"file://{tmp_path}/c", random.Random(5)
    whole = spark.createDataFrame([], sync.CATALOG)
    assert pointers.read(spark, folder).count() == 0
    for n in range(4):
        rows = [(f"k{k}", f"h{draw.randrange(3)}", f"2026-01-{draw.randrange(1, 9):02d}", None, f'{{"run": {n}, "k": {k}}}') for k in draw.sample(range(30), 18)] + ([("", "h", None, None, "{}")] if n == 1 else [])
        records, at = spark.createDataFrame(rows, RECORDS), f"2026-0{1 + 2 * n}-01"
        changes = pointers.merge(spark, folder, records, at, n != 2, prune_days=100)
        merged = catalog.merge(whole, records, at, n != 2, prune_days=100)
        assert sorted((r.stable_key, r.change) for r in changes.collect()) == sorted((r.stable_key, r.change) for r in merged.collect())
        whole = spark.createDataFrame(merged.drop("change").collect(), sync.CATALOG)
        assert sorted(map(str, pointers.read(spark, folder).select(*whole.columns).collect())) == sorted(map(str, whole.collect())), n
    for _ in range(2):
        pointers.compact(spark, folder)
    assert sorted(map(str, pointers.read(spark, folder).select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert len(list((tmp_path / "c/records").iterdir())) == 2  # the run that the keys name, and the one of the version before


def test_merge_moves_no_texts(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    records = spark.createDataFrame([("a", "h", None, None, "{}")], RECORDS)
    pointers.merge(spark, folder, records, "2026-01-01", True)
    assert "record_json" not in files.read_catalog(spark, f"{folder}/keys", sync.CATALOG).drop("latest_record_json").columns
    run = files.read_catalog(spark, f"{folder}/keys", sync.CATALOG).first().latest_record_json
    pointers.merge(spark, folder, records, "2026-01-02", True)
    assert files.read_catalog(spark, f"{folder}/keys", sync.CATALOG).first().latest_record_json == run  # unchanged: nothing was written again
    assert {r.latest_record_json for r in pointers.read(spark, folder).collect()} == {"{}"}
