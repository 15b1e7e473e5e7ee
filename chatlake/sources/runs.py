"""Tables of one archive that grow by whole runs: what a run adds is seen in all tables at once, or not at all. [SNK-1]

root/tables/<table>/run=<run> holds the rows that one run added to a table. root/versions/<number>.json is a version: it names the runs that count, with
their numbers of rows, and the last batch of each stream. Readers take the newest version; what it does not name, such as the half-written run of a
job that died, is not there. A version's file is only ever created, so of two writers that began with the same version the slower one fails and
may try again.

Runs of like size are merged once there are FANOUT of them, so n imports leave some log(n) runs, and a row is rewritten as often at most.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Runs of one tier that are merged, versions that are kept, rows that are written as they come, and rows of a file beyond.
FANOUT, KEPT, SMALL, FILE_ROWS = 8, 100, 200_000, 2_000_000
#: Characters of text that a task sorts, or indexes, at most, about: their postings take some 25 times as many bytes.
PART_CHARS = 16 << 20
#: Shares of PART_CHARS that files are made of where cores would be idle otherwise.
LEAST_PARTS = 8
#: Characters of text that a byte of a file stands for, about.
PACKED = 4


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one began with."""


@dataclass(frozen=True)
class Table:
    """schema of the files, the columns that each run is sorted by, and, where rows are dealt or merged in another way, how."""

    schema: str
    sort: tuple[str, ...]
    #: (rows, number of rows) to rows dealt and sorted for writing.
    deal: Callable[[DataFrame, int], DataFrame] | None = None
    #: The rows of several runs as those of one.
    merge: Callable[[DataFrame], DataFrame] = lambda rows: rows
    partition: tuple[str, ...] = ()


@dataclass(frozen=True)
class Version:
    """runs: dictionaries with run, rows (by table) and numbers; batches: the last batch of each stream."""

    number: int = 0
    runs: tuple[dict, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)

    def total(self, name: str) -> int:
        return sum(r["numbers"].get(name, 0) for r in self.runs)


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, files = _store(spark, path)
    files.delete(at, True)


def kind(spark: SparkSession, path: str) -> str | None:
    """'folder', 'file' or None, as the path's file system says."""
    at, files = _store(spark, path)
    return ("folder" if files.getFileStatus(at).isDirectory() else "file") if files.exists(at) else None


def matching(spark: SparkSession, path: str) -> list[str]:
    """The paths that a pattern matches; a path that exists, or that is no pattern, itself."""
    at, files = _store(spark, path)
    if files.exists(at) or not any(c in path for c in "*?[{"):
        return [path]
    return [x.getPath().toString() for x in files.globStatus(at) or []]


def _numbers(spark: SparkSession, root: str) -> list[int]:
    at, files = _store(spark, f"{root}/versions")
    return sorted(int(x.getPath().getName()[:-5]) for x in files.listStatus(at) if x.getPath().getName().endswith(".json")) if files.exists(at) else []


def current(spark: SparkSession, root: str) -> Version:
    """The newest version that was written whole; an empty one if there is none."""
    for number in reversed(_numbers(spark, root)):
        at, files = _store(spark, f"{root}/versions/{number:010d}.json")
        stream = files.open(at)
        try:
            text = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:  # its writer died, or is still at it
            continue
        return Version(number, tuple(found["runs"]), found["batches"])
    return Version()


def _young(spark: SparkSession, path: str, minutes: float = 10) -> bool:
    """Whether a version without contents may still be written."""
    at, files = _store(spark, path)
    return files.getFileStatus(at).getModificationTime() > spark.sparkContext._jvm.java.lang.System.currentTimeMillis() - minutes * 60_000


def commit(spark: SparkSession, root: str, base: Version, added: list[dict], dropped: tuple[str, ...] = (), batches: dict[str, int] | None = None) -> Version:
    """Write the version after base: its runs but the dropped ones, and the added ones. Conflict if another writer has written one since base."""
    numbers = _numbers(spark, root)
    latest = max(numbers, default=0)
    now = current(spark, root).number
    if now != base.number or (latest > now and _young(spark, f"{root}/versions/{latest:010d}.json")):
        raise Conflict(f"{root} has grown since version {base.number}")
    made = Version(latest + 1, tuple(r for r in base.runs if r["run"] not in dropped) + tuple(added), base.batches | (batches or {}))
    at, files = _store(spark, f"{root}/versions/{made.number:010d}.json")
    try:
        out = files.create(at, False)
    except Exception as e:
        if not files.exists(at):
            raise
        raise Conflict(f"{root} has grown since version {base.number}") from e
    out.write(bytearray(json.dumps({"runs": made.runs, "batches": made.batches}).encode()))
    out.close()
    for number in numbers[:-KEPT]:
        delete(spark, f"{root}/versions/{number:010d}.json")
    return made


def read(spark: SparkSession, root: str, name: str, table: Table, version: Version | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """A table's rows in a version, by default the newest; empty if it has none. only: of these runs."""
    version = version or current(spark, root)
    held = [r["run"] for r in version.runs if r["rows"].get(name) and (only is None or r["run"] in only)]
    if not held:
        return spark.createDataFrame([], table.schema)
    base = f"{root}/tables/{name}"
    return spark.read.schema(table.schema).option("basePath", base).parquet(*[f"{base}/run={r}" for r in held])


def text_parts(chars: int) -> int:
    """How many tasks share texts of so many characters."""
    return math.ceil(chars / PART_CHARS)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files below path."""
    at, files = _store(spark, path)
    return files.getContentSummary(at).getLength() if files.exists(at) else 0


class Run:
    """A run being written: write() its tables, then commit() or drop() it."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables, self.name = spark, root, tables, uuid.uuid4().hex
        self.rows: dict[str, int] = {}
        self.numbers: dict[str, int] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/tables/{name}/run={self.name}"

    def write(self, name: str, rows: DataFrame, about: int, chars: int = 0) -> int:
        """Write a table's rows, of which there are `about` as many at most, with `chars` characters of text; how many there were."""
        table = self.tables[name]
        if table.deal:
            dealt = table.deal(rows, about)
        elif about <= SMALL and chars <= PART_CHARS:
            dealt = rows.sortWithinPartitions(*table.sort)
        else:
            # Tasks that read texts again get whole files, so that there are as many as cores, unless they are small.
            wide = min(self.spark.sparkContext.defaultParallelism, LEAST_PARTS * chars // PART_CHARS)
            dealt = rows.repartitionByRange(max(math.ceil(about / FILE_ROWS) + 1, text_parts(chars) + 1, wide), *table.sort).sortWithinPartitions(*table.sort)
        writer = dealt.write
        (writer.partitionBy(*table.partition) if table.partition else writer).parquet(self.path(name))
        self.rows[name] = self.read(name).count()  # of the files' footers
        return self.rows[name]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.tables[name].schema).parquet(self.path(name))

    def entry(self) -> dict:
        return {"run": self.name, "rows": self.rows, "numbers": self.numbers}

    def drop(self) -> None:
        for name in self.tables:
            delete(self.spark, self.path(name))


def compact(spark: SparkSession, root: str, tables: dict[str, Table], fanout: int = FANOUT) -> Version:
    """Merge the runs of each tier that has `fanout` of them or more, the smallest tier first. Their folders stay for readers of older versions; see vacuum()."""
    version = current(spark, root)
    while True:
        tiers: dict[int, list[dict]] = {}
        for run in version.runs:
            tiers.setdefault(int(math.log(max([1, *run["rows"].values()]), fanout)), []).append(run)
        full = [tiers[k] for k in sorted(tiers) if len(tiers[k]) >= fanout]
        if not full:
            return version
        merged, names = Run(spark, root, tables), tuple(r["run"] for r in full[0])
        for name, table in tables.items():
            if about := sum(r["rows"].get(name, 0) for r in full[0]):
                held = sum(size(spark, f"{root}/tables/{name}/run={r}") for r in names)
                merged.write(name, table.merge(read(spark, root, name, table, version, names)), about, PACKED * held)
        for r in full[0]:
            for k, n in r["numbers"].items():
                merged.numbers[k] = merged.numbers.get(k, 0) + n
        try:
            version = commit(spark, root, version, [merged.entry()], names)
        except Conflict:
            merged.drop()  # the next import merges
            return current(spark, root)


def vacuum(spark: SparkSession, root: str, hours: float = 24) -> int:
    """Delete the folders of runs that no kept version names and that are older than `hours`, so that no running writer or reader needs them; how many."""
    named = set()
    for number in _numbers(spark, root):
        at, files = _store(spark, f"{root}/versions/{number:010d}.json")
        stream = files.open(at)
        text = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        stream.close()
        named |= {r["run"] for r in json.loads(text)["runs"]} if text else set()
    at, files = _store(spark, f"{root}/tables")
    before = spark.sparkContext._jvm.java.lang.System.currentTimeMillis() - int(hours * 3_600_000)
    lost = [run.getPath() for table in (files.listStatus(at) if files.exists(at) else []) for run in files.listStatus(table.getPath()) if run.getPath().getName()[4:] not in named and run.getModificationTime() <= before]
    for path in lost:
        files.delete(path, True)
    return len(lost)


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A setting of the session for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared one that spark.checkpoint.dir names; where that is unset, a temporary one on local masters, and RuntimeError on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chatlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/archive/{uuid.uuid4().hex}"


def written(rows: DataFrame, path: str) -> DataFrame:
    """rows, written to path and read back, so that they are worked out once."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def few(rows: DataFrame, most: int) -> bool:
    """Whether there are at most `most` rows, without counting more."""
    return rows.limit(most + 1).count() <= most


__all__ = ["Conflict", "Run", "Table", "Version", "commit", "compact", "current", "delete", "few", "kind", "read", "scratch", "setting", "size", "text_parts", "vacuum", "written"]
