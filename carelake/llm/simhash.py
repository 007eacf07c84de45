"""Near duplicates by SimHash: fingerprints, vantage-point tree shards, exact links, distributed components.

A fingerprint has a bit where more than half of the text's shingle hashes have it. Two fingerprints link when they differ in few bits.
Equal fingerprints are one vertex. A vantage-point tree, fitted on a bounded sample of fingerprints, deals all of them to shards by their
Hamming distance to vantage points. Whatever lies within the link distance of a boundary is copied across it, so both ends of every link
meet in some shard: the triangle bound d(x, v) >= d(y, v) - d(x, y) says that no other branch can hold a partner. Within a shard the
same split is repeated until brute force is cheap. A shard returns a spanning forest, not its links, so a dense group costs rows in
proportion to its members. Components of all shards' forests are joined by contraction rounds over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, staged

SHINGLE_WORDS, MAX_BITS = 3, 2
#: Fingerprints that fit the tree at least, and at most one of so many and MOST_SAMPLE in all, so that shards don't grow with the data as long as
#: there are fewer than MAX_SHARDS; members that a shard should have, and members below which brute force runs.
TREE_SAMPLE, SAMPLE_SHARE, MOST_SAMPLE, SHARD_MEMBERS, BRUTE = 16384, 256, 1 << 20, 4096, 4096
#: Shards at most. A node is 3 numbers, so the tree that tasks get has a fixed bound; fuller shards split on within their task.
MAX_SHARDS = 65536
BLOCK = 1 << 16


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text as an unsigned number; texts without words have 0."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(parts) > words:
        starts, ends = starts[: 1 - words or None], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h, n = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        a, b = starts[i : i + BLOCK].tolist(), ends[i : i + BLOCK].tolist()
        hashes = np.array([h(joined[x:y], 42) for x, y in zip(a, b, strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split(prints: np.ndarray, seed: int, max_bits: int) -> tuple[np.uint64, int] | None:
    """The vantage point and radius, of a few tried, whose larger branch (with what is copied into it) is smallest; None if none helps."""
    draw = np.random.default_rng(seed)
    best, found = 0.9 * len(prints), None
    for v in prints[draw.integers(0, len(prints), 6)]:
        count = np.bincount(distance(prints, v), minlength=65).cumsum()
        inner = count[:64]
        outer = len(prints) - count[:64] + count[:64] - np.concatenate([np.zeros(max_bits, np.int64), count[: 64 - max_bits]])
        load = np.maximum(inner, outer)
        radius = int(load.argmin())
        if load[radius] < best:
            best, found = load[radius], (v, radius)
    return found


def branches(prints: np.ndarray, node: tuple[np.uint64, int], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Who goes inside and who outside: all beyond the radius, and those inside so close to it that a partner can lie beyond."""
    d = distance(prints, node[0])
    return d <= node[1], d > node[1] - max_bits


class Tree:
    """Vantage-point tree of shards; nodes are (vantage point, radius, inner child, outer child), leaves are numbered."""

    def __init__(self, sample: np.ndarray, total: int, max_bits: int = MAX_BITS, members: int = SHARD_MEMBERS):
        self.max_bits, self.leaves = max_bits, 0
        members = max(members, 8 * total // MAX_SHARDS)
        self.root = self._grow(sample, total / max(1, len(sample)), members, 1)

    def _grow(self, part: np.ndarray, scale: float, members: int, seed: int):
        node = split(part, seed, self.max_bits) if len(part) * scale > members and len(part) >= 16 else None
        if node is None or self.leaves >= MAX_SHARDS:
            self.leaves += 1
            return self.leaves - 1
        inner, outer = branches(part, node, self.max_bits)
        return (*node, self._grow(part[inner], scale, members, 2 * seed), self._grow(part[outer], scale, members, 2 * seed + 1))

    def route(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf that gets some of the prints, with them."""
        todo = [(self.root, prints)]
        while todo:
            node, part = todo.pop()
            if not len(part):
                continue
            if isinstance(node, int):
                yield node, part
            else:
                inner, outer = branches(part, node[:2], self.max_bits)
                todo += [(node[2], part[inner]), (node[3], part[outer])]


def roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n vertices reaches by the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def close_pairs(prints: np.ndarray, max_bits: int, seed: int = 1, index: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that differ in at most max_bits, some of them twice: the tree goes on until brute force is cheap."""
    index = np.arange(len(prints)) if index is None else index
    node = split(prints, seed, max_bits) if len(prints) > BRUTE else None
    if node is not None:
        for k, side in enumerate(branches(prints, node, max_bits)):
            yield from close_pairs(prints[side], max_bits, 2 * seed + k, index[side])
        return
    step = max(1, (1 << 22) // max(1, len(prints)))
    for at in range(0, len(prints), step):
        i, j = np.nonzero(distance(prints[at : at + step, None], prints[None, at:]) <= max_bits)
        ahead = j > i
        yield index[at + i[ahead]], index[at + j[ahead]]


def forest(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, its component's first member) for the members of a shard that are not first; links are folded in block by block."""
    prints = np.unique(prints)
    label = np.arange(len(prints))
    for i, j in close_pairs(prints, max_bits):
        if len(i):
            i, j = label[i], label[j]
            label = roots(i, j, len(prints))[label]
    moved = label != np.arange(len(prints))
    return prints[moved], prints[label[moved]]


#: Links up to which one task joins them; more are contracted over all tasks first.
SMALL_LINKS = 1_000_000


def _joined(edges: DataFrame) -> DataFrame:
    """(a, p) of all vertices of a bounded number of links: one task reads them and finds the least vertex of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if held:
            ends = np.concatenate([np.concatenate(x) for x in zip(*held, strict=True)])
            names, at = np.unique(ends, return_inverse=True)
            label = roots(at[: len(at) // 2], at[len(at) // 2 :], len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], names=["a", "p"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "a long, p long")


def components(links: DataFrame, small: int = SMALL_LINKS) -> DataFrame:
    """(vertex, root) of all vertices of links (a, b); root is the least vertex of the component.

    Rounds hook each vertex to its least neighbour, shorten the paths and contract, until so few links are left that one task joins them.
    """
    edges = staged(links.where("a <> b"), "links")
    mapping: DataFrame | None = None
    while n := edges.count():
        if n <= small:
            hook = staged(_joined(edges), "hooks")
        else:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            hook = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), "hooks")
            for _ in range(2):
                above = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
                hook = staged(hook.join(above, "p").select("a", F.col("q").alias("p")), "hooks")
        if mapping is None:
            mapping = hook.select(F.col("a").alias("vertex"), F.col("p").alias("root"))
        else:
            step = hook.select(F.col("a").alias("root"), "p")
            mapping = staged(mapping.join(step, "root", "left").select("vertex", F.coalesce("p", "root").alias("root")), "mapping")
        if n <= small:
            return mapping
        ends = [hook.select(F.col("a").alias(c), F.col("p").alias(f"p{c}")) for c in "ab"]
        edges = staged(edges.join(ends[0], "a").join(ends[1], "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct(), "links")
    if mapping is None:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return mapping


def print_links(prints: DataFrame, max_bits: int = MAX_BITS, members: int = SHARD_MEMBERS) -> DataFrame:
    """(a, b): forests of the links between the distinct fingerprints in prints (fp long), of all shards."""
    total = prints.count()
    sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(min(MOST_SAMPLE, max(TREE_SAMPLE, total // SAMPLE_SHARE))).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = Tree(np.sort(sample), total, max_bits, members)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for shard, part in tree.route(own):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard, np.int32)), pa.array(part.view(np.int64))], names=["shard", "fp"])

    def within(group: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(group["fp"].to_numpy(np.int64).view(np.uint64), max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return prints.select("fp").mapInArrow(deal, "shard int, fp long").groupBy("shard").applyInPandas(within, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, members: int = SHARD_MEMBERS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs; other columns are ignored, whatever their names.

    Null and empty texts have fingerprint zero, which links like any other. Repeated rows and ids are kept, each with its component.
    component_id is the smallest id that is reachable; null ids are passed over, and a component without an id has null.
    An empty table gives an empty result.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = staged(map_texts(plain, ["doc_id"], "text", lambda: lambda texts: [(_signed(fingerprint(x, words)),) for x in texts], "fp long"), "prints")
    prints = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(print_links(prints, max_bits, members)).withColumnRenamed("vertex", "fp")
    rooted = staged(prints.join(linked, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    ids = staged(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "component")
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each near-duplicate group: the row with the least id, and one of them if that id is repeated.

    Groups without any id keep one row too. All columns stay.
    """
    names, key = docs.columns, "_row_of_keep_one"
    while key in names:
        key += "_"
    numbered = staged(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.struct(F.col(doc_id).isNull().alias("z"), F.col(doc_id).alias("i"), F.col(key).alias("k")).alias("id"), F.col(text).alias("body")), "id", "body", **options)
    stay = found.where("doc_id = component_id").select(F.col("doc_id.k").alias(key))
    return numbered.join(stay, key, "left_semi").select(*names)
