"""Files of one huge JSON array, by element: a file's byte ranges are read by many tasks. [SRC-1, NRM-2]

Whether a byte lies in a string, and how deep in brackets, depends on all bytes before it. So a first pass gives, for each range, its quotes and what it does to the
depth, once for a start outside a string and once for one inside; summed over the ranges before, in order, that tells how each range begins. In a second pass a range
gives the elements that begin in it, and reads on to the end of its last one. A task holds one range and one element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.sources.runs import few, scratch, written

#: Bytes of a range, and of a step beyond its end.
RANGE, STEP = 64 << 20, 1 << 20
#: Paths of bad files that are broadcast at most.
FEW_PATHS = 100_000
_WHITE = b" \t\r\n"
#: What each byte does to the depth.
_DEPTH = np.zeros(256, np.int8)
_DEPTH[list(b"[{")], _DEPTH[list(b"]}")] = 1, -1


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path in it of a path as Spark names it."""
    if local := re.match(r"file:/*(/.*)", path, re.S):
        return pyarrow.fs.LocalFileSystem(), local[1]
    return pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@?&=%+,;~")) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def real_quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of the quotes that no backslash escapes; escaped: whether the first byte is."""
    slash = data == 92
    # A byte is escaped if an odd number of backslashes stands right before it.
    place = np.arange(len(data))
    run_start = np.where(slash & ~np.concatenate([[False], slash[:-1]]), place, -1)
    run_start = np.maximum.accumulate(run_start)
    found = np.flatnonzero(data == 34)
    before = found - 1
    length = np.where((before >= 0) & slash[before], before - run_start[before] + 1, 0)
    at_start = (length > 0) & (run_start[before] == 0) | (found == 0)
    odd = (length + (at_start & escaped)) % 2 == 1
    return found[~odd]


def inside(size: int, quotes: np.ndarray, starts_inside: bool) -> np.ndarray:
    """Whether each byte lies in a string; closing quotes do, opening ones do not."""
    flips = np.zeros(size + 1, np.int8)
    flips[quotes + 1] = 1
    return (np.cumsum(flips[:-1]) + starts_inside) % 2 == 1


class Ranges:
    """Reads ranges of one file."""

    def __init__(self, path: str, length: int):
        store, at = opened(path)
        self.file, self.length = store.open_input_file(at), length

    def read(self, at: int, size: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(max(0, min(size, self.length - at)), at), np.uint8)

    def escaped(self, at: int) -> bool:
        """Whether an odd number of backslashes ends right before this place."""
        count, end = 0, at
        while end > 0:
            data = self.read(max(0, end - 4096), min(4096, end))
            other = np.flatnonzero(data != 92)
            count += len(data) if not len(other) else len(data) - 1 - other[-1]
            if len(other):
                break
            end -= len(data)
        return count % 2 == 1

    def close(self) -> None:
        self.file.close()


def summary(data: np.ndarray, escaped: bool) -> tuple[int, int, int]:
    """(quotes, change of depth if it starts outside a string, the same inside)."""
    quotes = real_quotes(data, escaped)
    change = _DEPTH[data]
    within = inside(len(data), quotes, False)
    return len(quotes), int(change[~within].sum()), int(change[within].sum())


def elements_of(source: Ranges, at: int, size: int, in_string: bool, depth: int, first: int = 0) -> Iterator[tuple[int, str | None]]:
    """(place, text) of the top-level elements that begin in a range of an array, whose bracket stands at `first`; a null text stands for something that is no array."""
    begin, opener = None, ""
    held: list[bytes] = []
    now, end = at, min(at + size, source.length)
    while now < source.length and (now < end or begin is not None):
        data = source.read(now, end - now if now < end else STEP)
        if not len(data):
            break
        quotes = real_quotes(data, source.escaped(now))
        within = inside(len(data), quotes, in_string)
        level = depth + np.cumsum(np.where(within, 0, _DEPTH[data]))
        before = np.concatenate([[depth], level[:-1]])
        outside = ~within
        if now < end and (stray := outside & (before <= 0) & (level <= 0) & ~np.isin(data, list(_WHITE))).any():
            yield now + int(np.flatnonzero(stray)[0]), None
        opens, closes = outside & (before == 0) & (level == 1), outside & (before == 1) & (level == 0)
        if now < end and ((opens & (data != 91)).any() or (closes & (data != 93)).any() or (np.flatnonzero(opens) + now != first).any()):
            yield now, None
        borders = np.flatnonzero(opens | closes | outside & (level == 1) & (data == 44))
        last, raw = 0, data.tobytes()
        for b in borders.tolist():
            mark = chr(raw[b])
            if begin is not None:
                held.append(raw[last:b])
                text = b"".join(held).strip(_WHITE)
                if text or opener != "[" or mark != "]":  # [] has no element, [1,] a bad one
                    yield begin, text.decode("utf-8", "replace")
                begin, held = None, []
            if mark != "]" and now + b < end:
                begin, opener, last = now + b + 1, mark, b + 1
            if now >= end:
                return
        if begin is not None:
            held.append(raw[last:])
        in_string, depth, now = (len(quotes) + in_string) % 2 == 1, int(level[-1]), now + len(data)
    if begin is not None:  # the file ends within an element
        yield begin, None


def read_elements(spark: SparkSession, files: DataFrame, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(elements, rejected) of files (path, length): rows (source_path, position, value), position the byte where an element begins, and (source_path, reason).

    A file that is no array, such as a single object, is one element, read by one task. Files whose brackets or quotes do not end, or with anything after the array, are rejected,
    and have no elements; whether an element is valid JSON is not tested here.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / size), F.lit(1)) - 1)).alias("k")).repartition(n, "path", "k")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length, k in batch.itertuples(index=False, name=None):
                source = Ranges(path, length)
                data, first = source.read(k * size, size), None
                if k == 0:
                    at, text = 0, b""
                    while not text and at < length:
                        text = source.read(at, 4096).tobytes().lstrip(_WHITE)
                        at += 4096
                    first = min(at, length) - len(text) if text[:1] == b"[" else -1
                found = (path, length, k, first, *summary(data, source.escaped(k * size)))
                source.close()
                yield pd.DataFrame([found], columns=columns)

    columns = ["path", "length", "k", "first", "quotes", "outside", "inside"]
    seen = ranges.mapInPandas(scan, "path string, length long, k long, first long, quotes long, outside long, inside long")
    before = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a file
    started = seen.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    started = started.withColumn("change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    started = started.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0))).withColumn("first", F.max("first").over(Window.partitionBy("path")))
    started = written(started, scratch(spark))
    ends = started.groupBy("path").agg(F.sum("change").alias("depth"), F.sum("quotes").alias("quotes"), F.max("first").alias("first"))
    unended = ends.where("first >= 0 and (depth <> 0 or quotes % 2 = 1)").select("path")

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                source = Ranges(row.path, row.length)
                if row.first >= 0:
                    held, chars = [], 0
                    for found in elements_of(source, row.k * size, size, row.in_string, row.depth, row.first):
                        held.append((row.path, *found))
                        chars += len(found[1] or "")
                        if chars > STEP:
                            yield pd.DataFrame(held, columns=["path", "position", "value"])
                            held, chars = [], 0
                    yield pd.DataFrame(held, columns=["path", "position", "value"])
                elif row.k == 0:
                    yield pd.DataFrame([(row.path, 0, source.read(0, row.length).tobytes().decode("utf-8", "replace"))], columns=["path", "position", "value"])
                source.close()

    given = started.select("path", "length", "k", "first", "in_string", "depth").repartition(n, "path", "k").mapInPandas(give, "path string, position long, value string")
    given = written(given, scratch(spark))
    bad = unended.unionByName(given.where("value is null").select("path")).distinct()
    good = given.join(F.broadcast(bad) if few(bad, FEW_PATHS) else bad.hint("merge"), "path", "left_anti")
    return good.select(F.col("path").alias("source_path"), "position", "value"), bad.select(F.col("path").alias("source_path"), F.lit("not valid JSON").alias("reason"))
