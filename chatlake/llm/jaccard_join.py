"""Self-join of documents by the Jaccard similarity of their word n-grams, after the chosen-path join of Christiani, Pagh and
Sivertsen (2018).

Every distinct set of n-grams gets T min-hashes. A run starts from one node that holds all sets. A node chooses a few of
the T positions by a hash of its own name, each with probability 1 / (SPLIT T), and sends each set it holds to one child
per chosen position, named by the set's min-hash there: the sampled shared token. Nodes of one set end; nodes of at most
SMALL sets are brute-forced; larger ones are split again, down to a depth that grows with the number of documents, where they are
brute-forced block by block. Similar sets part with little probability on each path, and runs repeat until a pair of the threshold
meets with the target recall.

Brute force compares min-hashes and yields a spanning forest of what may be similar, so a node of n sets gives fewer than n
rows. Inside each connected component of these forests pairs are compared exactly, block against block, on the whole sets: all of
them, or in a large component those that met in a node, whichever is less work. That gives the links of each set as a number, and
again a forest of true links, whose components are the classes. Documents with the same set of n-grams are one set with a
multiplicity throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.bpe import Cache
from chatlake.llm.common import block_pairs, bound_batches, counted, cut, first_met, join_hot, map_groups, mix64, pairs_to_compare, sized, star_edges, words
from chatlake.llm.components import connected_components

#: Min-hashes of a set; the share of them below which brute force rules a pair out is the threshold less MARGIN.
T, MARGIN = 64, 0.2
#: Branching: a node's expected children per set are 1 / SPLIT.
SPLIT = 0.8
#: Nodes of at most SMALL sets are not split; blocks of brute force on min-hashes, and on whole sets.
SMALL, BLOCK, EXACT_BLOCK = 64, 256, 96
#: Components of more sets are compared within nodes if that is less work.
WIDE = 1024
#: Columns of the dense matrix in which intersections are counted at a time.
COLUMNS = 8192
#: Documents are digested in slices of this many rows, n-grams in slices of this many columns.
_SLICE = 4096


def runs_for(recall: float, depth: int, similarity: float) -> int:
    """Runs in which a pair of this similarity meets at the given depth with probability `recall` at least.

    On a path, a pair keeps a Poisson number of common children of mean similarity / SPLIT, a branching process.
    """
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(-(similarity / SPLIT) * (1 - lost))
    return math.ceil(math.log(1 - recall) / math.log(lost))


def depth_for(rows: int) -> int:
    """Levels of splitting: three, and one more for each 64 times of 2 ** 18 documents."""
    return max(3, math.ceil(math.log2(max(rows, 1)) / 6))


def _word_codes() -> Cache:
    return Cache(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))


def shingles(text: str | None, codes: Cache, n: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the runs of n words of a text; of all its words where there are fewer; none without words."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(codes.__getitem__, found), np.uint64, len(found))
    n = min(n, len(found))
    out = np.full(len(found) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + each[k : k + len(out)])
    return np.unique(out)


_rng = np.random.default_rng(7)
_FACTORS = _rng.integers(1, 1 << 63, (T, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, (T, 1), dtype=np.uint64)


def min_hashes(items: np.ndarray) -> np.ndarray:
    """T min-hashes of 32 bits of a set that is not empty."""
    best = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), _SLICE):
        np.minimum(best, (items[at : at + _SLICE] * _FACTORS + _OFFSETS).min(1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def set_key(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _branches(node: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions that a node chooses, and the seeds of its children's names there."""
    chosen = np.flatnonzero(mix64(np.uint64(node) + np.arange(1, T + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) < np.uint64(int(2**64 / (SPLIT * T))))
    return chosen, mix64(np.uint64(node) ^ mix64(chosen.astype(np.uint64) + np.uint64(1)))


def _children(branches: tuple[np.ndarray, np.ndarray], sketch: np.ndarray) -> np.ndarray:
    """The names of the children that a set is sent to."""
    return mix64(branches[1] + sketch[branches[0]].astype(np.uint64)).view(np.int64)


def _roots(runs: int) -> tuple[np.ndarray, np.ndarray]:
    """The branches of the starting nodes of all runs; they are the same for every set."""
    each = [_branches(int(x)) for x in mix64(np.arange(1, runs + 1, dtype=np.uint64))]
    return np.concatenate([c for c, _ in each]), np.concatenate([s for _, s in each])


def _agreement(sketches: np.ndarray) -> np.ndarray:
    """How many min-hashes each two rows share."""
    out = np.zeros((len(sketches), len(sketches)), np.uint8)
    for k in range(T):
        column = sketches[:, k]
        out += column[:, None] == column
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each two sets, counted over slices of the items that occur twice or more."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[item] > 1
    row, item = row[common], item[common]
    _, item = np.unique(item, return_inverse=True)
    order = np.argsort(item, kind="stable")
    row, item = row[order], item[order]
    out = np.zeros((n, n), np.float64)
    for low in range(0, int(item[-1]) + 1 if len(item) else 0, COLUMNS):
        a, b = np.searchsorted(item, [low, low + COLUMNS])
        dense = np.zeros((n, min(COLUMNS, int(item[b - 1]) - low + 1)), np.float32)
        dense[row[a:b], item[a:b] - low] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def _row_key(id_col: Column, text: Column) -> Column:
    """128 bits of a row's id and text: rows that share them are alike, also where ids are null or stand for several texts."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("i"), id_col.cast("string")), F.lit("n")), F.lit("\0"), F.coalesce(text, F.lit("")))))


def similar_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, n: int = 5, recall: float = 0.99, depth: int | None = None
) -> DataFrame:
    """Rows (id, class_id, n_links, kept), one for each row of documents.

    n_links counts the other rows whose set of word n-grams has a Jaccard similarity of at least `threshold`; class_id is the least
    id that can be reached by links, itself included; kept marks the rows whose id it is. A text of fewer than n words has one n-gram, of all
    its words. Texts without words, null ones too, link with nothing. Words are compared as they are. Rows of equal n-grams, repeated rows
    among them, are copies: each links to all others. A row with a null id links as others do, and is never kept; a class of such rows alone
    has a null class_id. Other columns are not read; an empty table gives no rows. depth is depth_for() the number of rows, if not given.
    """
    judged = _judged(documents, id_col, text_col, threshold, n, recall, depth).withColumn("class_id", F.coalesce("class_id", "id"))
    return judged.select(F.col("id").alias(id_col), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)).alias("kept"))


def _judged(documents: DataFrame, id_col: str, text_col: str, threshold: float, n: int, recall: float, depth: int | None) -> DataFrame:
    """Rows (id, row, key, n_links, class_id, class) of documents: row as _row_key() gives it, key of the set of n-grams, class of the set's class; all but id and row null for a text without words."""
    bound_batches(documents.sparkSession)
    kind = dict(documents.dtypes)[id_col]
    depth = depth or depth_for(documents.count())
    runs = runs_for(recall, depth, threshold)
    limit = Fraction(threshold).limit_denominator(10**6)
    least = math.floor(T * (threshold - MARGIN))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _row_key(F.col(id_col), F.col(text_col)).alias("row"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, roots = _word_codes(), _roots(runs)
        for batch in batches:
            out = []
            for i, x, row in zip(batch["id"], batch["text"], batch["row"], strict=True):
                items = shingles(x, codes, n)
                if len(items):
                    sketch = min_hashes(items)
                    out.append((i, row, set_key(items), sketch.tobytes(), _children(roots, sketch)))
                else:
                    out.append((i, row, None, None, None))
            yield pd.DataFrame(out, columns=["id", "row", "key", "sketch", "nodes"])

    rows = cut(texts.mapInPandas(digest, f"id {kind}, row binary, key binary, sketch binary, nodes array<long>"))
    sets = cut(
        rows.where("key is not null").groupBy("key")
        .agg(F.min("id").alias("rep"), F.min("row").alias("row"), F.count(F.lit(1)).alias("size"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"))
    )

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kids = [_children(_branches(node & (1 << 64) - 1), np.frombuffer(s, np.uint32)) for node, s in zip(batch["node"].tolist(), batch["sketch"], strict=True)]
            yield pd.DataFrame({"key": batch["key"], "nodes": kids})

    at = sets.select(F.explode("nodes").alias("node"), "key")
    leaves = None
    for level in range(1, depth + 1):
        live = cut(counted(at, "node"))
        ended = live if level == depth else live.where(F.col("_n") <= SMALL)
        leaves = ended if leaves is None else leaves.unionByName(ended)
        large = live.where(F.col("_n") > SMALL)
        if level == depth or large.isEmpty():
            break
        at = large.join(sets.select("key", "sketch").hint("merge"), "key").select("node", "key", "sketch").mapInPandas(split, "key binary, nodes array<long>").select(F.explode("nodes").alias("node"), "key")
        at = cut(at)  # counted() reads it more than once

    def may_match(_: tuple, rows: dict[str, np.ndarray]) -> list[tuple]:
        keys, near = rows["key"], np.frombuffer(b"".join(rows["sketch"]), np.uint32).reshape(-1, T)
        if len(keys) == 2:
            return [(keys[0], keys[1])] if (near[0] == near[1]).sum() >= least else []
        return [(keys[i], keys[j]) for i, j in star_edges(_agreement(near) >= least)]

    members = leaves.join(sets.select("key", "sketch").hint("merge"), "key")
    forest = map_groups(block_pairs(members, "node", "key", BLOCK), ["node", "p", "q"], may_match, "a binary, b binary")
    parts = connected_components(forest).select(F.col("node").alias("key"), F.col("component").alias("part"))
    chosen = sized(cut(parts), "part", EXACT_BLOCK).join(sets.select("key", "row", "size").hint("merge"), "key")

    def whole_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _word_codes()
        for batch in batches:
            yield batch[["part", "key", "size", "_n"]].assign(items=[shingles(x, codes, n).tobytes() for x in batch["text"]])

    # The text of one row of each set. Rows of a null id may repeat it without end, so they are merged first; others are dropped after the join, by which they are sorted.
    named = texts.where("id is not null").select("row", "text").unionByName(texts.where("id is null").select("row", "text").dropDuplicates(["row"]))
    full = cut(named.join(cut(chosen).hint("merge"), "row").dropDuplicates(["row"]).select("text", "part", "key", "size", "_n").mapInPandas(whole_sets, "part binary, key binary, size long, _n long, items binary"))

    def links(group: tuple, rows: dict[str, np.ndarray]) -> list[tuple]:
        _, node, p, q = group
        keys, own, size = rows["key"], rows["own"], rows["size"]
        items = [np.frombuffer(x, np.uint64) for x in rows["items"]]
        if len(items) < 2:
            return []
        both, length = intersections(items), np.array([len(x) for x in items])
        linked = both * limit.denominator >= limit.numerator * (length[:, None] + length - both)
        linked &= ~np.eye(len(items), dtype=bool) if p == q else own[:, None] != own
        linked = first_met(linked, node, rows["nodes"])
        out = [(k, None, int(c)) for k, c in zip(keys, linked @ size.astype(np.int64), strict=True) if c]
        return out + [(keys[i], keys[j], 0) for i, j in star_edges(linked)]

    found = cut(map_groups(pairs_to_compare(full, leaves, EXACT_BLOCK, WIDE), ["part", "node", "p", "q"], links, "a binary, b binary, n long"))
    others = found.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("links"))
    reached = connected_components(found.where("b is not null"))
    of_key = cut(reached.select(F.col("node").alias("key"), "component").join(sets.select("key", "rep").hint("merge"), "key"))
    classes = of_key.groupBy("component").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("_n"))
    of_set = (
        sets.select("key", "rep", "size").join(others.hint("merge"), "key", "left")
        .join(join_hot(of_key.select("key", "component"), classes, "component").select("key", "component", F.col("class_id").alias("least")).hint("merge"), "key", "left")
        .select(
            "key", F.col("size").alias("_n"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("class_id"), F.coalesce("component", "key").alias("class"),
        )
    )
    return join_hot(rows.select("id", "row", "key"), of_set, "key", "left").select("id", "row", "key", "n_links", "class_id", "class")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, n: int = 5, recall: float = 0.99, depth: int | None = None) -> DataFrame:
    """The rows of documents that remain when one row of each class of similar_documents() stays: of the least id, a null id last, and of its texts the one of the least digest.

    Texts without words are in no class and stay as they are, repeated rows too.
    """
    judged = _judged(documents, id_col, text_col, threshold, n, recall, depth)
    winners = judged.where("key is not null").groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row")).alias("w")).select(F.col("w.row").alias("__row"))
    keyed = documents.withColumn("__row", _row_key(F.col(id_col), F.col(text_col)))
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.where(worded).join(winners.hint("merge"), "__row", "left_semi").dropDuplicates(["__row"])
    return kept.drop("__row").unionByName(documents.where(~worded))
