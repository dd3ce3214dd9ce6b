"""Versioned tables below any path that Hadoop reaches, with an optimistic commit.

A version is a folder of tables and a numbered manifest. Tables are written first, with a fingerprint of their rows taken on
the way, read again and compared; then the manifest of the next number is created, which fails if another one has it. Readers
take the highest manifest that is complete. Nothing is renamed or replaced, so a store needs no more than creating a file
that isn't there.
"""

from __future__ import annotations

import fcntl
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .scratch import seen_of

MANIFESTS, LOCK = "_versions", "_LOCK"
#: A hash is summed up in pieces of so many bits, so that no sum of up to 2 ** 42 rows overflows.
PIECE, PIECES = 21, 3


class Conflict(RuntimeError):
    """Another version was committed meanwhile, or another run holds the folder."""


# ---------------------------------------------------------------- files


def _file(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _local(spark: SparkSession, path: str) -> Path | None:
    """The path on this machine, if it is one."""
    fs, p = _file(spark, path)
    return Path(p.toUri().getPath()) if fs.getUri().getScheme() == "file" else None


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text; False if there is one already."""
    fs, p = _file(spark, path)
    fs.mkdirs(p.getParent())
    if (own := _local(spark, path)) is not None:  # Hadoop looks and then creates here, which isn't one step
        try:
            with open(own, "x") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(p):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _text(spark: SparkSession, path: str) -> str:
    fs, p = _file(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


@contextmanager
def run_lock(spark: SparkSession, root: str) -> Iterator[None]:
    """One run at a time; a second one fails at once. On this machine the lock ends with its process; elsewhere it is a file,
    which `break_lock` deletes after a run that was killed."""
    fs, p = _file(spark, root)
    fs.mkdirs(p)
    if (own := _local(spark, f"{root}/{LOCK}")) is not None:
        with open(own, "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError:
                raise Conflict(f"another run holds {root}") from None
            yield
        return
    if not create_once(spark, f"{root}/{LOCK}", spark.sparkContext.applicationId):
        raise Conflict(f"another run holds {root}: {_text(spark, f'{root}/{LOCK}')}")
    try:
        yield
    finally:
        break_lock(spark, root)


def break_lock(spark: SparkSession, root: str) -> None:
    _delete(spark, f"{root}/{LOCK}")


# ---------------------------------------------------------------- fingerprints


def fingerprint(df: DataFrame) -> list[Column]:
    """Aggregates that tell multisets of rows apart, whatever their order: the count, and the sums of two hashes of each row. A null
    and an empty value, and values that change places, give other hashes; a lost, doubled or changed row other sums."""
    cells = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    out = [F.count("*").alias("rows")]
    for salt in range(2):
        h = F.xxhash64(F.lit(salt), *cells)
        out += [F.coalesce(F.sum(F.shiftrightunsigned(h, k * PIECE).bitwiseAND((1 << PIECE) - 1)), F.lit(0)).alias(f"h{salt}{k}") for k in range(PIECES)]
    return out


def fingerprint_of(df: DataFrame) -> dict[str, int]:
    return df.agg(*fingerprint(df)).first().asDict()


# ---------------------------------------------------------------- versions


def _versions(spark: SparkSession, root: str) -> dict[int, dict | None]:
    """Manifests by number; None for one that isn't complete."""
    fs, p = _file(spark, f"{root}/{MANIFESTS}")
    if not fs.exists(p):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    out: dict[int, dict | None] = {}
    for name in sorted(n for n in names if n.isdigit()):
        try:
            out[int(name)] = json.loads(_text(spark, f"{root}/{MANIFESTS}/{name}"))
        except ValueError:
            out[int(name)] = None
    return out


def current(spark: SparkSession, root: str) -> dict | None:
    """The manifest of the highest complete version."""
    return max((m for m in _versions(spark, root).values() if m), key=lambda m: m["number"], default=None)


def recover(spark: SparkSession, root: str) -> None:
    """Put manifests aside that were begun and never completed. Not while a commit may be under way."""
    for number, m in _versions(spark, root).items():
        if m is None:
            fs, p = _file(spark, f"{root}/{MANIFESTS}/{number:08d}")
            fs.rename(p, p.suffix(f".broken-{uuid.uuid4().hex}"))


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """One sorted file for each bucket of the key."""
    name = f"larkfeed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay, as the path is ours


def read_bucketed(spark: SparkSession, path: str, ddl: str, key: str, buckets: int) -> DataFrame:
    """The same as a table that Spark knows to be dealt by its key: joins and groups on the key need no exchange on this side."""
    name = f"larkfeed_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def ddl_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _read(spark: SparkSession, root: str, version: dict, table: str) -> DataFrame:
    about, path = version["tables"][table], f"{root}/{version['folder']}/{table}"
    if about["buckets"]:
        return read_bucketed(spark, path, about["ddl"], about["key"], about["buckets"])
    return spark.read.schema(about["ddl"]).parquet(path)


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the current version."""
    if (version := current(spark, root)) is None:
        raise FileNotFoundError(f"{root} has no committed version")
    return _read(spark, root, version, table)


def verify_rows(spark: SparkSession, root: str, version: dict | None = None) -> None:
    """Compare the rows of a version's tables with the fingerprints in its manifest."""
    version = version or current(spark, root)
    for name, about in version["tables"].items():
        if (have := fingerprint_of(_read(spark, root, version, name))) != about["fingerprint"]:
            raise RuntimeError(f"{name} of version {version['number']} isn't what was written: {have} against {about['fingerprint']}")


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], verify: Callable[[dict[str, DataFrame]], None] | None = None, buckets: dict[str, tuple[str, int]] | None = None) -> int:
    """Write all tables as the next version. Until its manifest is there readers see the version before; a version that fails is
    removed. `buckets` names the key and number of buckets of tables that are kept by a key."""
    have = _versions(spark, root)
    base = max((n for n, m in have.items() if m), default=0)
    if any(n > base for n in have):
        raise Conflict(f"version {base + 1} of {root} was begun and isn't complete: it is being committed, or recover() puts it aside")
    version = {"number": base + 1, "folder": f"v-{uuid.uuid4().hex}", "tables": {}}
    manifest = f"{root}/{MANIFESTS}/{base + 1:08d}"
    try:
        for name, df in tables.items():
            key, n = (buckets or {}).get(name, (None, 0))
            seen, path = Observation(), f"{root}/{version['folder']}/{name}"
            watched = df.observe(seen, *fingerprint(df))
            if n:
                write_bucketed(watched, path, key, n)
            else:
                watched.write.parquet(path)
            version["tables"][name] = {"ddl": ddl_of(df), "key": key, "buckets": n, "fingerprint": seen_of(seen, df, fingerprint(df))}
        back = {name: _read(spark, root, version, name) for name in tables}
        verify_rows(spark, root, version)
        if verify:
            verify(back)
        text = json.dumps(version, ensure_ascii=False)
        if not create_once(spark, manifest, text) or _text(spark, manifest) != text:
            raise Conflict(f"version {base + 1} of {root} was committed by another run meanwhile")
    except BaseException:
        _delete(spark, f"{root}/{version['folder']}")
        raise
    return base + 1
