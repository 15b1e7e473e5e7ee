"""Sources of exported conversations: folders, files and zip archives, as rows of (source_path, value). [SRC-1..7]"""

from __future__ import annotations

import hashlib
import posixpath
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.sources import arrays, runs

#: Files of at least so many bytes are read by element instead of as one row.
LARGE = 128 << 20
#: Archives with a damaged member that are broadcast at most, and open archives of a task.
FEW_ARCHIVES, OPEN = 100_000, 16


def read_folder(spark: SparkSession, *paths: str, recursive: bool = True, any_name: bool = False) -> DataFrame:
    """Rows (source_path, value) of the .json files of folders, or with any_name of files of any name; a file is one row, so below 2 GB. [SRC-1, SRC-2, SRC-3]"""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive)
    named = (reader if any_name else reader.option("pathGlobFilter", "*.json")).text(list(paths))
    return named.select(decoded_path(F.col("_metadata.file_path")).alias("source_path"), "value", F.col("_metadata.file_size").alias("size"))


def read_large(spark: SparkSession, *paths: str, any_name: bool = False, at_least: int = LARGE, size: int = arrays.RANGE) -> tuple[DataFrame, DataFrame] | None:
    """(elements, rejected) of the files of at_least so many bytes, see arrays.read_elements(); None if there are none. [SRC-1, NRM-2]"""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = (reader if any_name else reader.option("pathGlobFilter", "*.json")).load(list(paths)).where(F.col("length") >= at_least).select("path", "length")
    return None if found.isEmpty() else arrays.read_elements(spark, found, size)


def decoded_path(path):
    """Spark's file paths are percent-encoded; a plus sign stands for itself."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_zips(spark: SparkSession, *paths: str, with_key: bool = True) -> DataFrame:
    """Rows (archive, archive_key, source_path, value, reason) of the JSON members of zip archives. [SRC-4, SRC-7]

    The list of an archive's members is read first, from its end; the members, below 2 GB each, are then dealt to all tasks, which read their ranges. Folders and other members
    are left out, and so are names that end in .JSON but not .json, which the scan of an unpacked archive does not see. An archive that is no zip, of which
    a JSON member escapes its folder or is damaged, gives one row without value but with a reason, and none of its members. archive_key is the
    start of the SHA-256 of its bytes, which is what reads all of an archive in one task; with_key=False leaves it null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").option("recursiveFileLookup", True).load(list(paths)).select("path", "length")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listing = "archive string, archive_key string, member string, reason string"

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, _ in batch.itertuples(index=False, name=None):
                store, at = arrays.opened(path)
                key = None
                if with_key:
                    digest = hashlib.sha256()
                    with store.open_input_stream(at) as f:
                        while data := f.read(1 << 20):
                            digest.update(data)
                    key = digest.hexdigest()[:12]
                try:
                    with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                        names = [x.filename for x in z.infolist() if not x.is_dir() and x.filename.lower().endswith(".json")]
                    found = [(path, key, None, "Unsafe zip entry")] if any(escapes(x) for x in names) else [(path, key, x, None) for x in names if x.endswith(".json")]
                except _DAMAGED:
                    found = [(path, key, None, "Invalid zip archive")]
                yield pd.DataFrame(found, columns=["archive", "archive_key", "member", "reason"])

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, zipfile.ZipFile] = {}
        for batch in batches:
            for path, key, member, reason in batch.itertuples(index=False, name=None):
                value = None
                if reason is None:
                    try:
                        if path not in held:
                            if len(held) >= OPEN:
                                held.pop(next(iter(held))).close()
                            store, at = arrays.opened(path)
                            held[path] = zipfile.ZipFile(store.open_input_file(at))
                        value = held[path].read(member).decode("utf-8", "replace")
                    except _DAMAGED:
                        reason = "Invalid zip archive"
                yield pd.DataFrame([(path, key, f"{path}!/{member}" if value is not None else None, value, reason)], columns=["archive", "archive_key", "source_path", "value", "reason"])

    listed = runs.written(files.repartition(n, "path").mapInPandas(members, listing), runs.scratch(spark))
    read = listed.repartition(n, "archive", "member").mapInPandas(contents, "archive string, archive_key string, source_path string, value string, reason string")
    read = runs.written(read, runs.scratch(spark))
    bad = read.where("reason is not null").groupBy("archive").agg(F.min("archive_key").alias("archive_key"), F.min("reason").alias("reason"))
    names = bad.select("archive")
    good = read.where("reason is null").join(F.broadcast(names) if runs.few(names, FEW_ARCHIVES) else names.hint("merge"), "archive", "left_anti")
    rows = good.unionByName(bad.select("archive", "archive_key", F.lit(None).cast("string").alias("source_path"), F.lit(None).cast("string").alias("value"), "reason"))
    return rows.withColumns({c: _shown(F.col(c)) for c in ("archive", "source_path")})


#: What zipfile and zlib raise on archives that cannot be read: damaged, encrypted, of an unknown method.
_DAMAGED = (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, EOFError, ValueError, zlib.error)


def _shown(path):
    """Paths as read_folder() gives them."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def escapes(member: str) -> bool:
    """Whether a member's name leads out of the folder that it is unpacked to."""
    flat = posixpath.normpath(member.replace("\\", "/"))
    return flat.startswith("/") or flat == ".." or flat.startswith("../") or flat[1:2] == ":"


def read_exports(spark: SparkSession, *paths: str, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """(files, rejected) of paths of any kind: a folder's .json files, a single .json file or zip archive, told apart by what they are. [SRC-5, SRC-6]

    files has (source_path, value), and for files of at least `large` bytes a row for each element, told by its position, which is null in other rows; rejected has (source_path, reason). The
    suffix of a single file may be in either case. Patterns stand for the paths that they match. A path that does not exist, or a file with another suffix, raises ValueError.
    """
    folders, files_, zips = [], [], []
    for path in [x for p in paths for x in runs.matching(spark, p)]:
        if (kind := runs.kind(spark, path)) is None:
            raise ValueError(f"Import path does not exist: {path}")
        suffix = posixpath.splitext(path.rstrip("/"))[1].lower()
        if kind == "file" and suffix not in (".json", ".zip"):
            raise ValueError(f"Unsupported import file type: {suffix or posixpath.basename(path)}")
        (folders if kind == "folder" else zips if suffix == ".zip" else files_).append(path)
    nothing = spark.createDataFrame([], "source_path string, reason string")
    found, rejected = [], [nothing]
    for some, any_name in ((folders, False), (files_, True)):
        if some:
            whole = read_folder(spark, *some, any_name=any_name)
            if by_element := read_large(spark, *some, any_name=any_name, at_least=large):
                elements, bad = by_element
                found.append(elements.withColumn("source_path", _shown(F.col("source_path"))))
                rejected.append(bad.withColumn("source_path", _shown(F.col("source_path"))))
                whole = whole.where(F.col("size") < large)
            found.append(whole.drop("size").withColumn("position", F.lit(None).cast("long")))
    if zips:
        members = read_zips(spark, *zips, with_key=False)
        found.append(members.where("reason is null").select("source_path", "value", F.lit(None).cast("long").alias("position")))
        rejected.append(members.where("reason is not null").select(F.col("archive").alias("source_path"), "reason"))
    files = found[0] if found else spark.createDataFrame([], "source_path string, value string, position long")
    for x in found[1:]:
        files = files.unionByName(x)
    for x in rejected[1:]:
        nothing = nothing.unionByName(x)
    return files, nothing
