"""Record files, snapshots and the catalog's table."""

import datetime as dt
import hashlib

import pytest

from postlark.sources import files, shared


def test_records(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    df = spark.createDataFrame([("b", 1, None), ("ü\n", None, "x")], "t string, a long, z string")
    files.write_records(df, path)
    files.write_records(df.limit(1), path, "append")
    assert sorted(r.value for r in spark.read.text(path).collect())[0] == '{"a":1,"t":"b","z":null}'
    assert sorted(map(str, files.read_records(spark, path, "t string, a long, z string").collect())) == sorted(map(str, [*df.collect(), df.first()]))
    (tmp_path / "odd").write_text('\n  \n[1]\n3\n {"a": 5, "more": 1}\n')
    assert [r.a for r in files.read_records(spark, f"file://{tmp_path}/odd", "a long").collect()] == [5]
    (tmp_path / "bad").write_text('{"a": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_records(spark, f"file://{tmp_path}/bad", "a long").collect()


def test_snapshots(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    assert files.prune_snapshots(spark, folder, 2) == ([], [])
    for day in (3, 1, 2):
        files.write_snapshot(spark.range(day), folder, dt.datetime(2026, 1, day))
    (tmp_path / "s" / "note.txt").write_text("x")
    kept, gone = files.prune_snapshots(spark, folder, 2)
    assert [k[:8] for k in kept] == ["20260103", "20260102"] and [g[:8] for g in gone] == ["20260101"]
    assert sorted(p.name[:8] for p in (tmp_path / "s").iterdir()) == ["20260102", "20260103", "note.txt"]


def test_catalog(spark, tmp_path):
    path = f"file://{tmp_path}/c/catalog.parquet"
    assert files.read_catalog(spark, path, "id long").count() == 0
    files.write_catalog(spark.range(3), path)
    files.write_catalog(files.read_catalog(spark, path, "id long").where("id > 0"), path)
    assert sorted(r.id for r in files.read_catalog(spark, path, "id long").collect()) == [1, 2]
    # a run that breaks off before it points to its version leaves the catalog as it was
    spark.range(9).write.parquet(f"{path}/version-broken")
    assert sorted(r.id for r in files.read_catalog(spark, path, "id long").collect()) == [1, 2]
    for n in range(3):
        files.write_catalog(files.read_catalog(spark, path, "id long"), path)
    names = [p.name for p in (tmp_path / "c" / "catalog.parquet").iterdir() if not p.name.startswith(".")]
    assert sum(n.startswith("current-") for n in names) == 2 and sum(n.startswith("version-") for n in names) == 3


def test_bundle_and_content_id(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    files.write_bundle({"a": spark.range(3), "b": spark.range(2)}, folder, {"rows": 3})
    manifest, tables = files.read_bundle(spark, folder)
    assert manifest["summary"] == {"rows": 3} and {n: t.count() for n, t in tables.items()} == {"a": 3, "b": 2}
    files.write_json(spark, f"{folder}/manifest.json", manifest | {"files": {"c": "tables/c.parquet"}})
    with pytest.raises(FileNotFoundError):
        files.read_bundle(spark, folder)
    (tmp_path / "one.txt").write_text("abc")
    assert files.content_id(spark, f"file://{tmp_path}/one.txt") == hashlib.sha256(b"abc").hexdigest()
    assert files.content_id(spark, f"{folder}/tables/a.parquet") != files.content_id(spark, f"{folder}/tables/b.parquet")


def test_content_id_reads_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "CHUNK", 1000)
    (tmp_path / "t/deep").mkdir(parents=True)
    data = {"b": b"x" * 5001, "a": b"", "c c": bytes(range(256)) * 20}
    (tmp_path / "t/b").write_bytes(data["b"])
    (tmp_path / "t/deep/a").write_bytes(data["a"])
    (tmp_path / "t/c c").write_bytes(data["c c"])
    (tmp_path / "t/_SUCCESS").write_bytes(b"")
    (tmp_path / "t/.hidden").write_bytes(b"1")
    want = hashlib.sha256("".join(hashlib.sha256(data[n]).hexdigest() for n in sorted(data)).encode()).hexdigest()
    assert files.content_id(spark, f"file://{tmp_path}/t") == files.content_id(spark, f"{tmp_path}/t") == want
    monkeypatch.setattr(files, "_READ_BY_ARROW", ())  # a store that only Spark reads
    assert files.content_id(spark, f"file://{tmp_path}/t") == want
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.content_id(spark, f"file://{tmp_path}/empty")


def test_raw_lines_have_sorted_keys(spark, tmp_path):
    texts = ['{"b": {"z": 1, "a": [ {"y": null, "x": "\\u00e9"} ]}, "a": 1.50}', "not json", None, "[2, 1]", '{"b":1, "B":2}']
    files.write_raw(spark.createDataFrame([(t,) for t in texts], "raw string").coalesce(1), f"file://{tmp_path}/raw")
    assert [r.value for r in spark.read.text(f"{tmp_path}/raw").collect()] == ['{"a":1.5,"b":{"a":[{"x":"é","y":null}],"z":1}}', "[2,1]", '{"B":2,"b":1}']


def test_kept_tables_can_be_forgotten(spark, tmp_path, monkeypatch):
    table = shared.kept(spark.range(3), "ids")
    assert table.count() == 3 and table.inputFiles()[0].startswith(shared.own_folder(spark))
    monkeypatch.setattr(shared, "shared_folder", lambda _: f"file://{tmp_path}")
    shared.kept(spark.range(4), "ids")
    assert len(list(tmp_path.iterdir())) == 1
    shared.forget(spark)
    assert not list(tmp_path.glob("tables-*")) and table.count() == 3
