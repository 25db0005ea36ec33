"""Best-fit packing with certificates: bound-certified repacking.

Documents become token ids plus an end id, only those longer than a sequence
are cut.  Full pieces are sequences of their own.  The others are dealt into
cells of bounded size; each cell is packed by best-fit decreasing, and
dual-feasible functions give a lower bound of its bins.  A cell that meets its
bound is certified and keeps its bins (but for its loosest, which may yet be
merged with others'); cells with a gap release all bins that aren't full.
What was released is dealt anew, so that cells exchange documents, and packed
again, for as long as that makes the gaps smaller.  The result says of each
piece whether its cell was certified; :func:`certificate` sums it up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm.common import release_memory, small_batches, stored
from querylens.llm.tokens import grouped, tokenizer

#: Tokens of a sequence, and the id after each document.
CAPACITY, END_ID = 4096, 1
#: Pieces of a cell on average: what a task holds.
CELL = 100_000


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in grouped(batches, 1):
            rows, cols, row = [], [[], [], [], []], 0
            for ids, sizes in tok.encode_slices(batch.column(1)):
                at = 0
                for size in sizes.tolist():
                    own = np.append(ids[at : at + size], np.uint32(end_id)).astype("<u4", copy=False)
                    at += size
                    for piece, start in enumerate(range(0, size + 1, capacity)):
                        part = own[start : start + capacity]
                        rows.append(row)
                        for col, x in zip(cols, (piece, start, len(part), zlib.crc32(part))):
                            col.append(x)
                    row += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        release_memory()

    return run


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids cut
    into pieces of at most ``capacity``."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(_pieces(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset of each item, room left in each bin)."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
    rooms, room_left = 0, []  # bit r of rooms: a bin with room r exists
    for item, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
        else:
            room, own = capacity, len(room_left)
            room_left.append(capacity)
        bins[item], offsets[item] = own, capacity - room
        room -= size
        room_left[own] = room
        open_at[room].append(own)
        rooms |= 1 << room
    return bins, offsets, np.array(room_left, dtype=np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by dual-feasible functions.

    f_e keeps sizes from e to capacity - e, drops smaller and rounds larger
    ones up to the capacity; u_k rounds (k + 1)-folds of sizes down to whole
    capacities.  Both map a bin's items to at most one capacity.
    """
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """:func:`lower_bound` of as many pieces of each length."""
    if not count.any():
        return 0
    size = np.arange(capacity + 1)
    below = np.concatenate([[0], np.cumsum(count)])  # items smaller than
    total = np.concatenate([[0], np.cumsum(count * size)])
    e = np.arange(0, capacity // 2 + 1)
    f = (below[-1] - below[capacity - e + 1]) * capacity + total[capacity - e + 1] - total[e]
    best = -(-int(f.max()) // capacity)
    for k in range(1, 40):
        folds = (k + 1) * size
        # times k, to stay with integers
        u = np.where(folds % capacity == 0, size * k, folds // capacity * capacity)
        best = max(best, -(-int((u * count).sum()) // (capacity * k)))
    return best


def _pack_cell(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        items = table.column("item").to_numpy()
        lengths = table.column("length").to_numpy()
        order = np.argsort(items)  # the same result in whatever order rows come
        items, lengths = items[order], lengths[order]
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        gap = len(room) - lower_bound(lengths, capacity)
        released = room > 0 if gap else np.arange(len(room)) == np.argmax(room)
        # bins over the bound, told once
        first = np.arange(len(items)) == 0
        name = np.full(len(room), np.iinfo(np.int64).max)
        np.minimum.at(name, bins, items)  # a bin is named by its least item
        n = len(items)
        return pa.table(
            {
                "item": items,
                "length": lengths,
                "bin": name[bins],
                "offset": offsets,
                "released": released[bins],
                "certified": np.full(n, gap == 0),
                "gap": np.where(first, gap, 0),
            }
        )

    return run


def packed(items: DataFrame, capacity: int = CAPACITY, cell: int = CELL) -> DataFrame:
    """``(item, bin, offset, certified)`` for ``items`` (item long, unique; length
    1 to ``capacity``).  Bins are named by one of their items; certified says
    that no packing of the cell's pieces has fewer bins."""
    schema = "item long, length long, bin long, offset long, released boolean, certified boolean, gap long"
    rest, n, kept, turn, best = items.select("item", "length"), items.count(), [], 0, None
    while n:
        cells = -(-n // cell)
        dealt = rest.withColumn("cell", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(cells)))
        done = stored(dealt.groupBy("cell").applyInArrow(_pack_cell(capacity), schema), "packed")
        gap, n = done.agg(F.sum("gap"), F.count_if("released")).first()
        turn += 1
        if cells == 1 or (best is not None and gap >= best):
            kept.append(done)  # nothing left to exchange, or no use
            break
        best = gap
        kept.append(done.where("not released"))
        rest = done.where("released")
    out = kept[0] if kept else items.sparkSession.createDataFrame([], schema)
    for more in kept[1:]:
        out = out.unionAll(more)
    return out.select("item", "bin", "offset", "certified")


def certificate(packed_rows: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """What the rows of :func:`pack_documents` prove: ``sequences``, the
    ``lower_bound`` of any packing of all pieces (dual-feasible functions of the
    counts of lengths) and ``uncertified``, the sequences of cells with a gap."""
    lengths = packed_rows.groupBy("length").agg(F.count("*").alias("n")).collect()
    count = np.zeros(capacity + 1, dtype=np.int64)
    for r in lengths:
        count[r.length] = r.n
    of = packed_rows.groupBy("sequence_id").agg(F.min("certified").alias("certified"))
    found = of.agg(F.count("*").alias("n"), F.count_if(~F.col("certified")).alias("open")).first()
    return {"sequences": found.n, "lower_bound": bound_of_counts(count, capacity), "uncertified": found.open}


def pack_documents(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, cell: int = CELL
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, certified); the pieces of a sequence fill it from 0 without gaps.

    A null, empty or blank text is the end id alone.  Rows that repeat are
    packed as often as they occur; an id may be null.  Other columns don't
    matter; an empty table gives an empty one.
    """
    # the number of each piece is written down, so it survives recomputation
    with small_batches(docs.sparkSession):
        cut = stored(pieces(docs, path, doc_id, text, capacity, end_id).withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("item"), "offset": F.lit(0).cast("long"), "certified": F.lit(True)})
    placed = packed(cut.where(F.col("length") < capacity).select("item", "length"), capacity, cell)
    placed = placed.select(F.col("item").alias("of"), F.col("bin").alias("sequence_id"), "offset", "certified")
    part = cut.where(F.col("length") < capacity).join(placed, F.col("item") == F.col("of"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"]
    return full.select(out).unionAll(part.select(out))
