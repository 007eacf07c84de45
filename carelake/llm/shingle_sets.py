"""Near duplicates by the similarity of shingle sets, as the near-duplicate stage of the pipeline: SimHash fingerprints and sketches find candidates, exact sets decide.

Fingerprints of the shingles link by op10's vantage-point tree within two bits. What is similar and farther apart is found by sketches:
Texts with equal sets are one vertex. A vertex has minima of BANDS * ROWS hash functions; vertices that agree in all rows of a band share a
bucket. Within a bucket, vertices whose minima agree in less than LIKELY of all functions can't be similar (at 0.8 that is 4.7 standard
deviations off), the others are linked by a spanning forest. The components of these unverified links are blocks, and all that is similar is in one block.

A block whose sets are few enough goes to one task, which decides all of its pairs exactly. A larger one stays dealt over all tasks: in each
round a bounded number of its sets, twice as many as in the round before, are queries that all its sets are compared with, exactly. Components grow by what is found; only pairs of
different components are still of interest, so a block is done when all sets that haven't been queries are in one component. Groups of copies of any
size thus end after few rounds, and no task holds more than its batch and the queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget_ended, join_small, limit_batches, map_texts, sorted_groups, staged
from .simhash import components, fingerprint, print_links

WORDS = 5
#: The least similarity as a fraction, 4 / 5.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 32, 5
#: Share of agreeing minima from which two vertices of a bucket are candidates.
LIKELY = 0.65
#: Members up to which a bucket is looked through; beyond, all its members are candidates of the first.
BUCKET = 256
#: Hashes up to which a block goes to one task.
BLOCK_HASHES = 1 << 16
#: Queries of a round over all larger blocks, and their hashes, at most (one query at least); and the queries of a block in the first round.
QUERIES, QUERY_HASHES, EACH = 4096, 1 << 22, 64
STEP = 2048
_DRAW = np.random.default_rng(42)
FACTORS = _DRAW.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _DRAW.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
PLACES = _DRAW.integers(0, 1 << 63, 1 << 10, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a shorter text is one shingle, and a text without words has none.

    A shingle's hash mixes the sum of its words' hashes, each times the factor of its place.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    own = np.fromiter(map(h, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    out = np.full(len(parts) - size + 1, size, np.uint64)
    for k in range(size):
        out += own[k : len(parts) - size + 1 + k] * PLACES[k]
    out ^= out >> np.uint64(32)
    out *= PLACES[-1]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), STEP):
        np.minimum(least, (short[None, i : i + STEP] * FACTORS[:, None] + OFFSETS[:, None]).min(axis=1), out=least)
    return least


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketch(text: str, words: int = WORDS) -> tuple[int, int, bytes, list[int]]:
    """Digest of the set, its size, the low byte of each minimum, and a key for each band; sets without shingles have no band."""
    hashes = shingles(text, words)
    digest = _signed(xxhash.xxh3_64_intdigest(hashes.tobytes()))
    if not len(hashes):
        return digest, 0, b"", []
    least = minima(hashes)
    rows = least.reshape(BANDS, ROWS)
    return digest, len(hashes), least.astype(np.uint8).tobytes(), [_signed(xxhash.xxh64_intdigest(rows[k].tobytes(), k)) for k in range(BANDS)]


def reach(near, n: int) -> np.ndarray:
    """For each of n members the first of its component; near(x, left) tells which of the members left are near x. Members reached are no longer compared."""
    label = np.arange(n)
    left = np.arange(n)
    while len(left):
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            hit = near(todo.pop(), left)
            if hit.any():
                label[left[hit]] = root
                todo += left[hit].tolist()
                left = left[~hit]
    return label


def likely(signatures: np.ndarray) -> np.ndarray:
    """Components of the members whose minima agree often enough."""
    return reach(lambda x, left: (signatures[left] == signatures[x]).mean(axis=1) >= LIKELY, len(signatures))


class Sets:
    """Sets by place, for the numbers of hashes that another set shares with each of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = flat.argsort(kind="stable")
        self.hashes, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def near(self, x: np.ndarray) -> np.ndarray:
        """Which of the sets are similar to x; sets without hashes are similar to each other."""
        at, end = np.searchsorted(self.hashes, x, "left"), np.searchsorted(self.hashes, x, "right")
        count = end - at
        first = np.cumsum(count) - count
        places = np.repeat(at - first, count) + np.arange(count.sum())
        shared = np.bincount(self.owner[places], minlength=len(self.sizes))
        return (NUMERATOR + DENOMINATOR) * shared >= NUMERATOR * (self.sizes + len(x))


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first place of its component of exact links."""
    table = Sets(sets)
    return reach(lambda x, left: table.near(sets[x])[left], len(sets))


def _hashes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def fingerprint_links(vertices: DataFrame) -> DataFrame:
    """(a, b): vertices (fp, print) whose SimHash fingerprints are equal or reach each other by links of the vantage-point tree's shards, each to the least of them."""
    prints = staged(vertices.select("print").distinct(), "prints")
    linked = components(print_links(prints.select(F.col("print").alias("fp")))).withColumnRenamed("vertex", "print")
    rooted = staged(vertices.select("fp", "print").join(linked, "print", "left").select("fp", F.coalesce("root", "print").alias("own")), "printed")
    least = rooted.groupBy("own").agg(F.min("fp").alias("b"), F.count("*").alias("members")).where("members > 1").select("own", "b")
    return rooted.join(least, "own").where("fp <> b").select(F.col("fp").alias("a"), "b")


def candidate_blocks(vertices: DataFrame) -> DataFrame:
    """(vertex, root): blocks of the vertices (fp, print, signature, bands), by links of their fingerprints and by buckets of their minima; those that are alone don't appear."""
    keyed = vertices.select("fp", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("fp").alias("lead"), F.count("*").alias("members")).where("members > 1")
    members = staged(keyed.join(shared, "key"), "buckets")
    wide = members.where((F.col("members") > BUCKET) & (F.col("fp") != F.col("lead"))).select(F.col("fp").alias("a"), F.col("lead").alias("b")).distinct()
    # most buckets of a group hold the same members, so each different bucket is looked through once
    lists = members.where(F.col("members") <= BUCKET).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("own")).select("own").distinct()
    rows = lists.select(F.xxhash64("own").alias("bucket"), F.explode("own").alias("fp")).join(vertices.select("fp", "signature"), "fp")

    def forest(key: int, columns: list[pa.Array]) -> Iterator[tuple]:
        prints = columns[0].to_numpy(zero_copy_only=False)
        label = likely(np.frombuffer(b"".join(columns[1].to_pylist()), np.uint8).reshape(len(prints), -1))
        moved = label != np.arange(len(prints))
        yield from zip(prints[moved].tolist(), prints[label[moved]].tolist(), strict=True)

    narrow = sorted_groups(rows.select("bucket", "fp", "signature"), "bucket", forest, "a long, b long")
    return staged(components(fingerprint_links(vertices).unionByName(wide).unionByName(narrow).distinct()), "blocks")


def small_heads(sets: DataFrame) -> DataFrame:
    """(fp, head) of blocks (root, fp, hashes) that one task holds: exact components within each."""

    def within(root: int, columns: list[pa.Array]) -> Iterator[tuple]:
        prints = columns[0].to_numpy(zero_copy_only=False)
        label = similar([_hashes(x) for x in columns[1].to_pylist()])
        yield from zip(prints.tolist(), prints[label].tolist(), strict=True)

    return sorted_groups(sets.select("root", "fp", "hashes"), "root", within, "fp long, head long")


def query_links(members: DataFrame, queries: list[tuple[int, int, bytes]]) -> DataFrame:
    """(a, b): links that join whatever the queries (root, fp, hashes) are similar to; members (root, fp, hashes) are of the queries' blocks."""
    limit_batches(members.sparkSession)
    sent = members.sparkSession.sparkContext.broadcast(queries)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for q in sent.value:
            by.setdefault(q[0], []).append(q)
        tables: dict[int, Sets] = {}
        joined: dict[int, np.ndarray] = {}  # for each query the first of those that this task has joined it with
        for batch in batches:
            a, b = [], []
            for root, fp, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                mine = by[root]
                if root not in tables:
                    tables[root] = Sets([_hashes(q[2]) for q in mine])
                    joined[root] = np.arange(len(mine))
                hit = np.nonzero(tables[root].near(_hashes(data)))[0]
                if not len(hit):
                    continue
                label = joined[root]
                found = np.unique(label[hit])
                first = mine[found[0]][1]
                if first != fp:
                    a.append(fp)
                    b.append(first)
                if len(found) > 1:
                    a += [mine[k][1] for k in found[1:].tolist()]
                    b += [first] * (len(found) - 1)
                    label[np.isin(label, found)] = found[0]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return members.select("root", "fp", "hashes").mapInArrow(compare, "a long, b long")


def large_heads(sets: DataFrame, queries: int = QUERIES, each: int = EACH) -> DataFrame:
    """(fp, head) of blocks (root, fp, hashes) of any size, by rounds of bounded queries that leave each block dealt over all tasks.

    A block has ``each`` queries in the first round and twice as many in each further one, so that one that many sets keep open takes few rounds:
    the driver keeps something of each query and task that it has run. ``queries`` of all blocks is the most of a round.
    """
    members = staged(sets.select("root", "fp", "hashes"), "large")
    state = staged(members.select("root", "fp", F.col("fp").alias("label"), F.lit(False).alias("asked")), "state")
    while True:
        open_ = state.where("NOT asked")
        parts = open_.groupBy("root", "label").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        active = staged(parts.select("root", "main"), "active")
        blocks = active.count()
        if not blocks:
            return state.select("fp", F.col("label").alias("head"))
        quota = max(1, min(each, queries // blocks))
        each *= 2
        rank = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("fp"), "fp"))
        wanted = open_.join(active, "root").where("label <> main").withColumn("rank", rank).where(F.col("rank") <= quota).orderBy("rank", "root").limit(queries)
        chosen = staged(wanted.select("root", "fp"), "asked")
        sized = members.join(F.broadcast(chosen.select("fp")), "fp").select("root", "fp", F.octet_length("hashes").alias("size")).collect()
        taken, total = [], 0
        for r in sorted(sized, key=lambda r: r.size):
            if taken and total + r.size > 8 * QUERY_HASHES:
                break
            taken.append((r.root, r.fp))
            total += r.size
        asked = members.sparkSession.createDataFrame(taken, "root long, fp long")
        rows = members.join(F.broadcast(asked.select("fp")), "fp").select("root", "fp", "hashes").collect()
        links = staged(query_links(members.join(F.broadcast(asked.select("root").distinct()), "root"), [(r.root, r.fp, bytes(r.hashes)) for r in rows]), "found")
        ends = [state.select(F.col("fp").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab"]
        merged = links.distinct().join(ends[0], "a").join(ends[1], "b").where("label_a <> label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
        step = components(merged).select(F.col("vertex").alias("label"), F.col("root").alias("to"))
        forget_ended(members.sparkSession)
        done = asked.select("fp", F.lit(True).alias("now"))
        state = staged(
            state.join(step, "label", "left").join(F.broadcast(done), "fp", "left").select("root", "fp", F.coalesce("to", "label").alias("label"), (F.col("asked") | F.coalesce("now", F.lit(False))).alias("asked")), "state"
        )


def heads(sets: DataFrame, sizes: DataFrame, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """(fp, head): exact components within the blocks of sets (root, fp, hashes); sizes has each root's number of hashes."""
    large = staged(sizes.where(F.col("hashes_of_block") > block_hashes).select("root"), "large-roots")
    out = small_heads(sets.join(sizes.where(F.col("hashes_of_block") <= block_hashes).select("root"), "root", "left_semi"))
    if not large.isEmpty():
        out = out.unionByName(large_heads(join_small(sets, large, "root")))
    return out


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """docs with one row of each near-duplicate group: the row with the least id, and one of them if that id is repeated.

    Groups are the components of the links between texts of similarity 0.8 or more over shingles of ``words`` words, words being what stands between
    ASCII white space with A-Z in lower case. Null texts are empty; texts without words are equal to each other, and texts with fewer words are one
    shingle. Null ids come last; groups without any id keep one row too. All columns stay. An empty table gives an empty one.
    """
    key = "_row_of_keep_one"
    while key in docs.columns:
        key += "_"
    numbered = staged(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    ident = F.struct(F.col(doc_id).isNull().alias("z"), F.col(doc_id).alias("i"), F.col(key).alias("k")).alias("id")
    rows = staged(map_texts(numbered.select(ident, F.col(text).alias("body")), ["id"], "body", lambda: lambda texts: [(*sketch(x, words), _signed(fingerprint(x, words))) for x in texts], "fp long, hashes long, signature binary, bands array<long>, print long"), "sketches")
    facts = [F.any_value(c).alias(c) for c in ("hashes", "signature", "bands")]  # equal sets have equal sketches
    facts.append(F.min("print").alias("print"))  # fingerprints count repeats; copies of a set need one of theirs
    vertices = staged(rows.groupBy("fp").agg(F.min("id").alias("least"), *facts), "vertices")
    blocks = candidate_blocks(vertices)
    forget_ended(docs.sparkSession)
    chosen = staged(vertices.join(blocks, F.col("fp") == F.col("vertex")).select(F.col("least.k").alias(key), "fp", "root", "hashes"), "chosen")
    bodies = join_small(numbered.select(key, F.col(text).alias("body")), chosen.select(key, "fp", "root"), key)
    sets = staged(map_texts(bodies, ["fp", "root"], "body", lambda: lambda texts: [(shingles(x, words).tobytes(),) for x in texts], "hashes binary"), "sets")
    head = staged(heads(sets, chosen.groupBy("root").agg(F.sum("hashes").alias("hashes_of_block")), block_hashes), "heads")
    stay = vertices.select("fp", "least").join(head, "fp", "left").groupBy(F.coalesce("head", "fp").alias("head")).agg(F.min("least").alias("id")).select(F.col("id.k").alias(key))
    gone = staged(rows.select(F.col("id.k").alias(key)).join(stay, key, "left_anti"), "gone")
    return join_small(numbered, gone, key, "left_anti").select(*docs.columns)
