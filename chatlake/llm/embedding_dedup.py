"""Near duplicates among embeddings: signs against random hyperplanes in several tables, exact cosines, and distributed connected components.

Equal vectors are one row with a multiplicity. What goes to a bucket of a table is a key and SKETCH further signs, never the vector:
members whose sketches differ in few signs may be similar, and a bucket yields a spanning forest of what may be. Each component of
these forests is a part. A vector goes to its part, and there all pairs that may be links are compared in double precision, block
against block, each once: a block gives the links of each row as a number, and a spanning forest of true links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import LARGE, block_pairs, cut, first_met, join_hot, map_groups, pairs_to_compare, sized, star_edges
from chatlake.llm.components import connected_components

SEED = 11
#: Vectors that a bucket holds if directions are even; rows of a block in a bucket, and in a part.
BUCKET, NEAR_BLOCK, BLOCK = 1024, 2048, 512
#: Signs of a sketch, and the standard deviations of slack that a pair at the threshold has in them: 0.5 % of such pairs are lost, of pairs
#: of cosine 0.92 one in 10,000. With much more slack, chance pairs would join most vectors of a large table to one part.
SKETCH, SLACK = 128, 2.6
#: Parts of more vectors are compared within buckets if that is cheaper.
WIDE = 16 * BLOCK


def tables_for(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits and tables so that buckets hold about BUCKET vectors, and a pair at the threshold meets with this probability."""
    bits = min(44, max(4, math.ceil(math.log2(max(rows, 1) / BUCKET + 1))))
    meets = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meets)) if meets < 1 else 1


def most_apart(threshold: float) -> int:
    """The signs of a sketch in which a pair at the threshold may differ."""
    share = math.acos(min(1.0, threshold)) / math.pi
    return math.ceil(SKETCH * share + SLACK * math.sqrt(SKETCH * share * (1 - share)))


def _vector(v) -> np.ndarray | None:
    """The vector in double precision without negative zeros; None if it links with nothing."""
    x = np.array([np.nan if c is None else c for c in v], np.float64) + 0.0 if v is not None else np.empty(0)
    return x if len(x) and np.isfinite(x).all() and x.any() else None


def _unit(v: np.ndarray) -> np.ndarray:
    """v in double precision, scaled to length 1; components whose squares are out of range are scaled first."""
    x = v.astype(np.float64)
    with np.errstate(over="ignore", under="ignore"):
        norm = np.linalg.norm(x)
    if not 1e-140 < norm < math.inf:
        x = x / np.abs(x).max()
        norm = np.linalg.norm(x)
    return x / norm


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.99) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for each row of vectors.

    A link joins two rows of equal length whose cosine is at least `threshold`, found if their codes agree in a table, which a pair at the
    threshold does with probability `recall`, a closer one more surely; n_links counts a row's links, component_id is the least id reachable,
    kept says whether that is the row's own. Vectors that are null, empty, zero, or have null or non-finite components link with nothing.
    Repeated rows are rows like others. A null id has the component of its copies and links, or null, and is not kept. Other columns,
    labels too, are not read; an empty table gives no rows.
    """
    kinds = dict(vectors.dtypes)
    kind, single = kinds[id_col], kinds[vector_col] == "array<float>"
    bits, tables = tables_for(vectors.count(), threshold, recall)
    apart = most_apart(threshold)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        at = np.arange(tables, dtype=np.int64) << np.int64(bits)
        for whole in batches:
            for start in range(0, len(whole), 1000):
                batch = whole.iloc[start : start + 1000]
                x = [_vector(v) for v in batch["v"]]
                digest = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() if v is not None else None for v in x]
                data = [None if v is None else (v.astype(np.float32) if single else v).tobytes() for v in x]
                codes: list = [None] * len(x)
                signs = np.zeros((len(x), 2), np.int64)
                lengths = np.array([0 if v is None else len(v) for v in x])
                for n in np.unique(lengths[lengths > 0]).tolist():
                    if n not in planes:
                        planes[n] = np.random.default_rng([SEED, n]).standard_normal((SKETCH + tables * bits, n)).T.copy()
                    mine = np.flatnonzero(lengths == n)
                    above = np.stack([_unit(x[k]) for k in mine]) @ planes[n] > 0
                    signs[mine] = np.packbits(above[:, :SKETCH], axis=1).view(np.int64)
                    for k, code in zip(mine.tolist(), above[:, SKETCH:].reshape(len(mine), tables, bits) @ weights + at, strict=True):
                        codes[k] = code
                yield pd.DataFrame({"id": batch["id"].to_numpy(), "digest": digest, "v": data, "s0": signs[:, 0], "s1": signs[:, 1], "buckets": codes})

    bucket = "int" if bits + math.log2(tables) < 31 else "long"
    rows = cut(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInPandas(keyed, f"id {kind}, digest binary, v binary, s0 long, s1 long, buckets array<{bucket}>"))
    # Copies are one vector; its number is fixed by being written. The vectors themselves stay where they are.
    sets = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), *[F.first(c).alias(c) for c in ("s0", "s1", "buckets")])
    sets = cut(sets.withColumn("key", F.monotonically_increasing_id()))
    members = sets.select("key", "s0", "s1", F.explode(F.col("buckets").cast("array<long>")).alias("node"))

    def may_match(group: tuple, held: dict[str, np.ndarray]) -> list[tuple]:
        keys, own = held["key"], held["own"]
        if len(keys) < 2:
            return []
        a, b = held["s0"].view(np.uint64), held["s1"].view(np.uint64)
        near = np.empty((len(keys), len(keys)), bool)
        for low in range(0, len(keys), 32):  # so many rows that what is between stays in the processor's cache
            high = low + 32
            near[low:high] = np.bitwise_count(a[low:high, None] ^ a) + np.bitwise_count(b[low:high, None] ^ b) <= apart
        np.fill_diagonal(near, False)
        if group[1] != group[2]:
            near &= own[:, None] != own
        return [(int(keys[i]), int(keys[j])) for i, j in star_edges(near)]

    forest = map_groups(block_pairs(sized(members, "node", NEAR_BLOCK), "node", "key", NEAR_BLOCK), ["node", "p", "q"], may_match, "a long, b long")
    parts = cut(connected_components(forest).select(F.col("node").alias("key"), F.col("component").alias("part")))
    named_parts = cut(sized(parts, "part", BLOCK).join(sets.select("key", "digest", "rep", "size").hint("merge"), "key"))
    # Each set's vector is that of its rep; rows that repeat it are dropped again.
    wanted = rows.select("id", "digest", "v")
    if named_parts.limit(LARGE + 1).count() <= LARGE:
        wanted = wanted.join(F.broadcast(named_parts.select("digest")), "digest", "left_semi")
    found = wanted.join(named_parts.hint("merge"), (wanted["digest"] == named_parts["digest"]) & wanted["id"].eqNullSafe(named_parts["rep"]))
    chosen = cut(found.groupBy("key", "part", "size", "_n").agg(F.first("v").alias("v")))

    def links(group: tuple, held: dict[str, np.ndarray]) -> list[tuple]:
        _, node, p, q = group
        keys, own = held["key"], held["own"]
        lengths = np.array([len(v) for v in held["v"]])
        out: list[tuple] = []
        for n in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == n)
            if len(mine) < 2:
                continue
            x = np.stack([_unit(np.frombuffer(v, np.float32 if single else np.float64)) for v in held["v"][mine]])
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if p != q:
                linked &= own[mine][:, None] != own[mine]
            linked = first_met(linked, node, held["nodes"][mine])
            if linked.any():
                out += [(int(k), None, int(c)) for k, c in zip(keys[mine], linked @ held["size"][mine].astype(np.int64), strict=True) if c]
                out += [(int(keys[mine[i]]), int(keys[mine[j]]), 0) for i, j in star_edges(linked)]
        return out

    found = cut(map_groups(pairs_to_compare(chosen, members, BLOCK, WIDE), ["part", "node", "p", "q"], links, "a long, b long, n long"))
    others = found.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("links"))
    reached = connected_components(found.where("b is not null"))
    named = cut(reached.select(F.col("node").alias("key"), "component").join(sets.select("key", "rep").hint("merge"), "key"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    of_set = (
        sets.select("digest", "key", "rep", "size").join(others.hint("merge"), "key", "left")
        .join(join_hot(named.select("key", "component"), least, "component").select("key", "component_id").hint("merge"), "key", "left")
        .select("digest", F.col("size").alias("_n"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    out = join_hot(rows.select("id", "digest"), of_set, "digest", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
