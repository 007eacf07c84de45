"""Best-fit packing of token pieces into sequences, bulk-synchronously.

The pieces are range-sorted by length over all tasks, so a piece's place in that order is its task's offset plus its place in the task.
Pieces of one length are interchangeable, and so are open sequences with one gap; a class of either is a run of numbers. A round takes
the next shorter length: a sweep up the sorted gaps finds for each piece its successor, the smallest gap that holds it. Pieces that want
the same gap are resolved by their rank; the gaps shrink, and the next round works on what they are then. As lengths and gaps are at most
the capacity, the classes are bounded by it whatever the number of pieces: a class at least halves its gap whenever it is used, so it moves
at most log2(capacity) times, and a round splits two classes at most. The rounds thus need the counts by length alone. The resulting runs
(under 3 * capacity * log2(capacity) rows) go to the tasks, where each piece finds its run, sequence and offset by its place.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SLICE, kept_encoder
from .common import gathered, limit_batches, only, staged

CAPACITY = 2048
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def rounds(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Runs (place of the first piece, length, first sequence, pieces in a sequence, offset) for counts[n] pieces of length n.

    Pieces are placed in order of length, ascending; runs are sorted by their first place and cover all places.
    """
    before = np.concatenate([[0], np.cumsum(counts)]).tolist()
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    runs, opened = [], 0
    for n in range(capacity, 0, -1):
        rank, left = before[n], int(counts[n])
        gap = n
        while left:
            if gap < capacity and not gaps[gap]:
                gap += 1
                continue
            each = gap // n
            if gap < capacity:
                first, size = gaps[gap].pop()
            else:  # nothing fits: new sequences
                first, size = opened, -(-left // each)
                opened += size
            taken = min(left, size * each)
            full, part = divmod(taken, each)
            runs.append((rank, n, first, each, capacity - gap))
            if full:
                gaps[gap - each * n].append((first, full))
            if part:
                gaps[gap - part * n].append((first + full, 1))
            if (rest := size - full - (part > 0)) > 0:
                gaps[gap].append((first + full + (part > 0), rest))
            rank, left = rank + taken, left - taken
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and end_id, cut into pieces of at most capacity ids."""
    limit_batches(docs.sparkSession)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("bpe")
        encoder = kept_encoder(path, "bytes")
        for batch in gathered(batches, SLICE):
            rows, pieces, starts, lengths, sums = [], [], [], [], []

            def emit(row: int, at: int, data: bytes, out=(rows, pieces, starts, lengths, sums)) -> None:
                for column, x in zip(out, (row, at // capacity, at, len(data) // 4, zlib.crc32(data)), strict=True):
                    column.append(x)

            texts = batch.column(1).to_pylist()
            stream = encoder.joined(texts)
            k, part = next(stream, (len(texts), []))
            for row in range(len(texts)):
                pending, done = b"", 0
                while k == row:
                    pending += part[0]
                    whole = (len(pending) // 4 - 1) // capacity if len(pending) else 0
                    for i in range(whole):
                        emit(row, done + i * capacity, pending[4 * i * capacity : 4 * (i + 1) * capacity])
                    done, pending = done + whole * capacity, pending[4 * whole * capacity :]
                    k, part = next(stream, (len(texts), []))
                pending += array("I", [end_id]).tobytes()
                for i in range(0, len(pending), 4 * capacity):
                    emit(row, done + i // 4, pending[i : i + 4 * capacity])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return plain.mapInArrow(cut, PIECES.format(id=plain.schema["doc_id"].dataType.simpleString()))


def place(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset: best fit of all rows by their length (1 to capacity).

    Two passes over tables in the shared folder: the range-sorted pieces are written with their task and place, then counted and placed.
    The driver gets a count for each task and each length.
    """
    names = pieces.columns
    spread = staged(pieces, "pieces").withColumn("spread_of_piece", F.monotonically_increasing_id())
    width = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = spread.repartitionByRange(width, length, "spread_of_piece").sortWithinPartitions(length, "spread_of_piece").drop("spread_of_piece")
    ordered = staged(ranged.withColumns({"task_of_piece": F.spark_partition_id(), "place_of_piece": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ordered")
    tasks = sorted((r[0], r[1]) for r in ordered.groupBy("task_of_piece").count().collect())
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in ordered.groupBy(length).count().collect():
        if n is None or not 1 <= n <= capacity:
            raise ValueError(f"a piece of {n} ids doesn't fit a sequence of {capacity}")
        counts[n] = k
    offsets = np.zeros((tasks[-1][0] if tasks else 0) + 1, np.int64)
    offsets[[t for t, _ in tasks]] = np.concatenate([[0], np.cumsum([k for _, k in tasks])])[:-1] if tasks else []
    runs = rounds(counts, capacity)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            task, own = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (len(names), len(names) + 1))
            at = offsets[task] + own
            run = runs[np.searchsorted(runs[:, 0], at, "right") - 1]
            step, within = np.divmod(at - run[:, 0], run[:, 3])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(run[:, 2] + step), pa.array(run[:, 4] + within * run[:, 1])], names=[*names, "sequence_id", "offset"])

    schema = type(pieces.schema)(pieces.schema.fields).add("sequence_id", "long").add("offset", "long")
    return ordered.select(*names, "task_of_piece", "place_of_piece").mapInArrow(assign, schema)


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all texts packed into sequences of at most capacity ids.

    Null and empty texts are one piece, the end id. Long texts are cut at whole capacities. Repeated rows and null ids are packed as often as
    they come. Only the id and text columns are read. An empty table gives no rows.
    """
    return place(token_pieces(docs, path, end_id, capacity, doc_id, text), capacity)
