"""What the corpus operators share: shared storage, words, and grouped streaming over sorted partitions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Keys of over HOT_ROWS rows, and over a share of 1 / HOT_KEYS of all rows, are hot: there are fewer than HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 1000, 1000
#: Rows (key, size) of large groups that are broadcast at most; beyond, they are merged.
LARGE = 200_000
#: White space of str.split() that the corpus definition of a word does not split at, or the reverse.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    """Runs of characters other than space and U+0009 to U+000D; none for null."""
    if not text:
        return []
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; where that is unset, a temporary one on local masters, and RuntimeError on a cluster, where a folder of one machine would not do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chatlake-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let at most `rows` texts at a time pass to Python, unless the session's setting is lower: a batch's texts, their Python
    strings and its results are all in memory at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and any executor may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chatlake/{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.cut_path = path
    return found


def forget(*tables: DataFrame) -> None:
    """Delete tables that cut() has written and nothing will read again."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut_and_measure(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """cut(), and aggregates of the rows taken while they are written, without a job of their own."""
    seen = Observation()
    return cut(df.observe(seen, *(c.alias(name) for name, c in measures.items()))), seen.get


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal df by hash of keys over the session's number of shuffle partitions, and sort each partition by them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[tuple, dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """Call fn(key, columns as arrays) for each group of equal keys; it returns tuples of the schema.

    Unlike applyInPandas it costs little for a group of two rows: a partition is sorted by the keys and streamed, and
    only one batch and one group are held at a time. Groups must be bounded; see block_pairs for those that are not.
    """
    names = [x.strip().split(" ")[0].strip("`") for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in _then_none(batches):
            if batch is not None:
                new = {c: batch[c].to_numpy() for c in batch.columns}
                held = {c: np.concatenate([held[c], v]) if len(held.get(c, ())) else v for c, v in new.items()}
            n = len(held[keys[0]]) if held else 0
            if not n:
                continue
            change = np.zeros(n, bool)
            for k in keys:
                change[1:] |= held[k][1:] != held[k][:-1]
            starts = [0, *np.flatnonzero(change).tolist(), n]
            last = len(starts) - (1 if batch is None else 2)  # the last group may go on in the next batch
            out: list[tuple] = []
            for a, b in zip(starts[:last], starts[1 : last + 1], strict=True):
                out += fn(tuple(held[k][a] for k in keys), {c: v[a:b] for c, v in held.items()})
            if out:
                yield pd.DataFrame(out, columns=names)
            held = {c: v[starts[last] :] for c, v in held.items()} if batch is not None else {}

    return spread(df, *keys).mapInPandas(run, schema)


def _then_none(it: Iterator) -> Iterator:
    yield from it
    yield None


def block_pairs(members: DataFrame, group: str, record: str, block: int) -> DataFrame:
    """Deal each group's records into blocks of about `block`, and give every unordered pair of blocks its rows.

    Adds p <= q, the pair's blocks, and own, the block of the row's record. All pairs of a group's records meet in
    exactly one (group, p, q), except those of one block, which meet in each pair of blocks that has it: take them where
    p = q alone. A task holds two blocks however large the group is. members has the size of each row's group as _n, as
    counted() adds it.
    """
    blocks = F.ceil(F.col("_n") / block).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64(F.lit(7), record), blocks).cast("int"))
    return (
        dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("p", F.least("own", "_other")).withColumn("q", F.greatest("own", "_other"))
        .drop("_n", "_other")
    )


def join_hot(rows: DataFrame, of_key: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with of_key, which has one row a key, with the number of the key's rows as _n.

    of_key is written out first. The entries of hot keys, fewer than HOT_KEYS, are broadcast, so that their rows stay where they are; the others meet in a
    merge join of two plain exchanges, which Spark can split. Null keys match nothing.
    """
    of_key, seen = cut_and_measure(of_key, total=F.sum("_n"), most=F.max("_n"))
    limit = max(HOT_ROWS, (seen["total"] or 0) // HOT_KEYS)
    if (seen["most"] or 0) <= limit:
        return rows.join(of_key.hint("merge"), key, how)
    hot = of_key.where(F.col("_n") > limit)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(others.join(of_key.where(F.col("_n") <= limit).hint("merge"), key, how))


def counted(members: DataFrame, group: str) -> DataFrame:
    """members with _n, the size of each row's group; groups of one row are left out. members is read up to three times."""
    return join_hot(members, members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), group)


def sized(members: DataFrame, group: str, block: int) -> DataFrame:
    """members with _n, the size of each row's group if it is over `block`, else 1; without moving members unless over LARGE groups are that large. members is read twice."""
    large, seen = cut_and_measure(members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block), groups=F.count(F.lit(1)))
    if not seen["groups"]:
        forget(large)
        return members.withColumn("_n", F.lit(1).cast("long"))
    joined = members.join(F.broadcast(large) if seen["groups"] <= LARGE else large.hint("merge"), group, "left")
    return joined.withColumn("_n", F.coalesce("_n", F.lit(1)))


def pairs_to_compare(chosen: DataFrame, leaves: DataFrame, block: int, wide: int) -> DataFrame:
    """Rows (part, node, p, q, own, key, others of chosen, nodes), in groups (part, node, p, q) of at most two blocks: each pair of members
    of a part that may be a link meets in at least one, and counts in exactly one.

    chosen has (part, key, ...) and _n, the size of the part; leaves (node, key) says where keys met. A part of at most `wide` members is
    compared as a whole: node is 0 and nodes null. In a larger one, its pairs may outnumber those that met in a node by far, as parts
    are chains of what may be similar; the cheaper of the two ways is taken. Pairs that met in several nodes count in the least of those,
    which is what nodes, the nodes of a member, is for: see first_met().
    """
    small = block_pairs(chosen.where(F.col("_n") <= wide), "part", "key", block).withColumn("node", F.lit(0).cast("long")).withColumn("nodes", F.lit(None).cast("array<long>"))
    large = chosen.where(F.col("_n") > wide)
    if large.isEmpty():
        return small
    met = cut(leaves.select("node", "key").join(large.select("key", "part", F.col("_n").alias("_whole")).hint("merge"), "key").distinct())
    groups = cut(met.groupBy("part", "node").agg(F.count(F.lit(1)).alias("_m"), F.max("_whole").alias("_whole")).where("_m > 1"))
    narrow = cut(groups.groupBy("part").agg(F.sum(F.col("_m") * F.col("_m")).alias("_met"), F.max("_whole").alias("_whole")).where(F.col("_met") < F.col("_whole").cast("double") * F.col("_whole")).select("part", F.col("_whole").alias("_n")))
    whole = large.drop("_n").join(join_parts(large, narrow, "left_anti").select("key", "_n").hint("merge"), "key")
    rest = block_pairs(whole, "part", "key", block).withColumn("node", F.lit(0).cast("long")).withColumn("nodes", F.lit(None).cast("array<long>"))
    inside = cut(join_parts(met, narrow, "left_semi").join(groups.select("part", "node", F.col("_m").alias("_n")).hint("merge"), ["part", "node"]))
    nodes = inside.groupBy("key").agg(F.collect_set("node").alias("nodes"))  # at most one for each path of a key
    held = inside.select("node", "key", "_n").join(large.drop("_n").join(nodes.hint("merge"), "key").hint("merge"), "key")
    return small.unionByName(rest).unionByName(block_pairs(held, "node", "key", block))


def join_parts(rows: DataFrame, parts: DataFrame, how: str) -> DataFrame:
    """rows whose part is in parts (left_semi) or is not (left_anti). parts, each of over some thousand members, are few: broadcast if they are at most LARGE."""
    few = parts.limit(LARGE + 1).count() <= LARGE
    return rows.join(F.broadcast(parts.select("part")) if few else parts.select("part").hint("merge"), "part", how)


def first_met(linked: np.ndarray, node: int, nodes: np.ndarray) -> np.ndarray:
    """linked without the pairs of rows that have a lower node than `node` in common; nodes as pairs_to_compare() gives them."""
    if nodes[0] is None or not linked.any():
        return linked
    lower = [[x for x in one if x < node] for one in nodes]
    number = {x: k for k, x in enumerate(sorted({x for one in lower for x in one}))}
    if not number:
        return linked
    has = np.zeros((len(nodes), len(number)), np.float32)
    for i, one in enumerate(lower):
        has[i, [number[x] for x in one]] = 1
    return linked & ~(has @ has.T > 0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def star_edges(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest (root, member) of the symmetric boolean matrix `linked`; roots are the lowest positions."""
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return []
    near_of = linked[np.ix_(some, some)]
    seen, out = np.zeros(len(some), bool), []
    for root in range(len(some)):
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            near = near_of[front].any(axis=0) & ~seen
            front = np.flatnonzero(near).tolist()
            seen[front] = True
            out += [(int(some[root]), int(some[x])) for x in front]
    return out
