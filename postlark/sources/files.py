"""Record files, snapshots of runs and the catalog's table, in any store that Spark reaches."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _store(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a maker of its path objects."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line, columns in alphabetical order, nulls written out; mode "append" adds to what is there."""
    row = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_raw(df: DataFrame, path: str, raw: str = "raw", mode: str = "errorifexists") -> None:
    """JSON texts as lines, the keys of objects sorted at every level; texts that aren't JSON are left out.

    A parsed text keeps its keys sorted, so rendering it again is one expression.
    """
    df.select(F.to_json(F.try_parse_json(raw)).alias("value")).where("value is not null").write.mode(mode).text(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a file of JSON lines; blank lines and lines that don't begin an object are skipped, a broken object fails."""
    lines = spark.read.text(path).where(F.ltrim("value").startswith("{"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_snapshot(df: DataFrame, folder: str, at: dt.datetime | None = None) -> str:
    """Write a run's rows under a new name that sorts by time; returns the path."""
    at = at or dt.datetime.now(dt.UTC)
    path = f"{folder.rstrip('/')}/{at:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:12]}.parquet"
    df.write.parquet(path)
    return path


def prune_snapshots(spark: SparkSession, folder: str, keep: int) -> tuple[list[str], list[str]]:
    """Delete all but the newest ``keep`` snapshots by name; returns the names kept and deleted, newest first.

    Other files in the folder stay. A folder that isn't there has no snapshots.
    """
    if keep < 0:
        raise ValueError("can't keep a negative number of snapshots")
    store, make = _store(spark, folder)
    if not store.exists(make(folder)):
        return [], []
    names = sorted((s.getPath().getName() for s in store.listStatus(make(folder)) if s.getPath().getName().endswith(".parquet")), reverse=True)
    for name in names[keep:]:
        store.delete(make(f"{folder.rstrip('/')}/{name}"), True)
    return names[:keep], names[keep:]


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small report, manifest or state as one JSON file, keys sorted, in any store that Spark reaches; written beside and renamed."""
    store, make = _store(spark, path)
    fresh = f"{path}.{uuid.uuid4().hex}"
    out = store.create(make(fresh), True)
    out.write(bytearray(json.dumps(value, indent=2, sort_keys=True, default=str).encode()))
    out.close()
    store.delete(make(path), False)
    if not store.rename(make(fresh), make(path)):
        raise OSError(f"can't write {path}")


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


#: Names by which Spark calls a store that Arrow calls otherwise; stores that Arrow reads.
_SAME_STORE = {"s3a": "s3", "s3n": "s3"}
_READ_BY_ARROW = ("file", "hdfs", "s3", "gs", "abfs", "abfss")
#: Bytes of a file that are hashed at once.
CHUNK = 1 << 23


def _hashed(frames):
    """(name, h) of files (name, uri), each read from its beginning to its end in chunks."""
    from pyarrow import fs

    for frame in frames:
        hashes = []
        for uri in frame["uri"]:
            scheme, _, rest = uri.partition(":")
            store, path = fs.FileSystem.from_uri(f"{_SAME_STORE.get(scheme, scheme)}:{rest if rest.startswith('//') else '//' + rest}")
            digest = hashlib.sha256()
            with store.open_input_stream(path) as stream:
                while data := stream.read(CHUNK):
                    digest.update(data)
            hashes.append(digest.hexdigest())
        yield frame[["name"]].assign(h=hashes)


def content_id(spark: SparkSession, path: str) -> str:
    """SHA-256 over the files of a table, in the order of their names: the id of what it holds.

    Files of any size are hashed on executors, a chunk in memory at a time; names and hashes alone come together. Stores that only
    Spark reads are read by Spark, in which case a file must fit in memory.
    """
    store, make = _store(spark, path)
    found, listing = [], store.listFiles(make(path), True)
    while listing.hasNext():
        status = listing.next()
        at = status.getPath()
        if not at.getName().startswith(("_", ".")):
            found.append((at.getName(), at.toUri().getScheme(), at.toUri().toString(), status.getLen()))
    if not found:
        raise FileNotFoundError(path)
    if all(_SAME_STORE.get(scheme, scheme) in _READ_BY_ARROW for _, scheme, _, _ in found):
        named = spark.createDataFrame([(name, uri) for name, _, uri, _ in found], "name string, uri string")
        each = named.repartition(min(len(found), 1000)).mapInPandas(_hashed, "name string, h string")
    else:
        content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]"))
        each = content.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("h"))
        # Spark's reader passes over files without content
        empty = [(name, hashlib.sha256(b"").hexdigest()) for name, _, _, size in found if not size]
        each = each.unionByName(spark.createDataFrame(empty, "name string, h string"))
    rows = each.orderBy("name", "h").collect()
    return rows[0].h if len(rows) == 1 else hashlib.sha256("".join(r.h for r in rows).encode()).hexdigest()


def write_bundle(tables: dict[str, DataFrame], folder: str, summary: dict | None = None) -> dict:
    """A set of tables, each as Parquet, with a manifest that names them; returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/tables/{name}.parquet")
    manifest = {"schema_version": "1.0", "files": {name: f"tables/{name}.parquet" for name in sorted(tables)}, "summary": summary or {}}
    write_json(spark, f"{folder}/manifest.json", manifest)
    return manifest


def read_bundle(spark: SparkSession, folder: str) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest and the tables of a bundle; a table that is named but not there is an error."""
    manifest = read_json(spark, f"{folder}/manifest.json")
    store, make = _store(spark, folder)
    if missing := [f for f in manifest["files"].values() if not store.exists(make(f"{folder}/{f}"))]:
        raise FileNotFoundError(f"{folder} lacks {missing}")
    return manifest, {name: spark.read.parquet(f"{folder}/{f}") for name, f in manifest["files"].items()}


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of the pointers under a path, by number."""
    store, make = _store(spark, path)
    if not store.exists(make(path)):
        return []
    names = sorted(f.getPath().getName() for f in store.listStatus(make(path)) if f.getPath().getName().startswith("current-"))
    read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
    out = []
    for name in names:
        stream = store.open(make(f"{path}/{name}"))
        out.append((int(name.split("-")[1]), read(stream, "UTF-8")))
        stream.close()
    return out


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The catalog's latest whole version, or an empty table of the schema before the first run."""
    pointers = _pointers(spark, path.rstrip("/"))
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{pointers[-1][1]}") if pointers else spark.createDataFrame([], schema)


#: A version that no pointer names is taken for one whose writer died when it is older than this.
ABANDONED_MS = 24 * 3600 * 1000


def write_catalog(df: DataFrame, path: str) -> int:
    """Write a new version of a table, which ``df`` may itself read, and point to it; returns its number.

    Versions are folders; a file ``current-<number>`` names one, the highest number counts. It is made last and never
    replaced: a run that breaks off leaves the version before as it is, and of two writers that began from the same
    version the later one fails, so no merge is lost unnoticed. Older versions but the last go after that, and so do
    versions a day old that no pointer names.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    store, make = _store(spark, path)
    pointers = _pointers(spark, path)
    number = pointers[-1][0] + 1 if pointers else 1
    version = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    try:
        out = store.create(make(f"{path}/current-{number:012d}"), False)
    except Exception as e:
        store.delete(make(f"{path}/{version}"), True)
        raise RuntimeError(f"{path} was written by another run meanwhile") from e
    out.write(bytearray(version.encode()))
    out.close()
    for n, old in pointers[:-1]:
        store.delete(make(f"{path}/{old}"), True)
        store.delete(make(f"{path}/current-{n:012d}"), False)
    named = {version, *(v for _, v in pointers[-1:])}
    now = dt.datetime.now(dt.UTC).timestamp() * 1000
    for f in store.listStatus(make(path)):
        if f.getPath().getName().startswith("version-") and f.getPath().getName() not in named and now - f.getModificationTime() > ABANDONED_MS:
            store.delete(f.getPath(), True)
    return number
