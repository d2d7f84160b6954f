"""Best-fit packing of token sequences by hierarchical residual packing.

Every input partition cuts its documents into pieces and packs them best-fit, longest first. Bins
with at most ``SLACK`` free places are done; the others become the items of the next round, in which
fewer, larger tasks pack them best-fit again, until one task has packed what is left. A task never
holds more than ``TASK_ITEMS`` items, and each round's bins are cut off in the shared folder before
the next round reads them, so a lost executor never changes a packing that others have seen.

Where a round of several tasks merges little, its tasks' bins are too alike to wait for one task: the
last round then packs all that are left at once by their number of each length. Bins of one length
are interchangeable, so best fit over these at most ``capacity`` numbers says which bins, by their rank
among those of their length, go where; the bins themselves stay distributed.

Edge cases: a null text counts as empty, and an empty document is its end id alone; only documents
longer than a sequence are cut; equal lengths are taken by document order; texts of any length are packed whole;
repeated rows are packed as often as they occur; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import bisect
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import bpe
from weftline.session import cut, prepare

#: Items that one task packs at a time.
TASK_ITEMS = 50_000
#: Free places up to which a bin is done.
SLACK = 4
#: Share of the bins that a round of several tasks merges, below which the next round is the last.
LEAST_GAIN = 0.02

MEMBER = "struct<doc_id: {kind}, piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: longest item first, each into the fullest bin that has room.

    Bit r of ``open_at`` says that a bin with r free places exists, so the best bin is found by one
    shift and one lowest-bit test whatever the number of bins.
    """
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_at = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = open_at >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                open_at &= ~(1 << room)
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            free[left].append(at)
            open_at |= 1 << left
    return bins


def _rows(bins: list[list[int]], sizes: list[int], members: pa.Array, first_id: int, capacity: int) -> pa.RecordBatch:
    """One row a bin: its id, fill and members with their places. ``members`` holds, for each item,
    a list of members whose offsets count from the item's start."""
    order = np.fromiter((i for b in bins for i in b), dtype=np.int64)
    taken = members.take(pa.array(order))
    counts = np.diff(taken.offsets.to_numpy())
    flat = taken.flatten()
    base, fill = [], []
    for b in bins:
        at = 0
        for i in b:
            base.append(at)
            at += sizes[i]
        fill.append(at)
    offset = flat.field("offset").to_numpy() + np.repeat(np.array(base, dtype=np.int64), counts)
    fields = [f for f in flat.type if f.name != "offset"]
    flat = pa.StructArray.from_arrays([*(flat.field(f.name) for f in fields), pa.array(offset)], names=[*(f.name for f in fields), "offset"])
    per_bin = np.add.reduceat(counts, np.cumsum([0, *map(len, bins[:-1])])) if bins else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_bin)]).astype(np.int32)), flat)
    ids = pa.array(np.arange(len(bins), dtype=np.int64) + first_id)
    fill = np.array(fill, dtype=np.int64)
    return pa.RecordBatch.from_arrays([ids, pa.array(fill), pa.array(fill >= capacity - SLACK), lists], names=["sequence_id", "fill", "done", "members"])


def _in_parts(batch: pa.RecordBatch, rows: int = 1000):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _item_lists(flat: pa.StructArray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32)), flat)


def first_round(docs: DataFrame, path: str, capacity: int, end_id: int, text: str, key: str) -> DataFrame:
    """Bins of each input partition, ``TASK_ITEMS`` pieces at a time."""
    spark = prepare(docs.sparkSession)
    shared = bpe.share(spark, path)
    kept = docs.select(key, text)
    kind = kept.schema[0].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def work(batches):
        context = TaskContext.get()
        made = (context.partitionId() if context else 0) << 34
        held: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        arrow = None

        def pack():
            nonlocal made, held
            sizes = held["length"]
            columns = [pa.array(held["doc_id"], type=arrow), pa.array(held["piece"], pa.int32()), *(pa.array(held[k], pa.int64()) for k in ("start", "length", "ids_crc32")), pa.array(np.zeros(len(sizes), dtype=np.int64))]
            flat = pa.StructArray.from_arrays(columns, names=[*held, "offset"])
            bins = best_fit(sizes, capacity)
            rows = _rows(bins, sizes, _item_lists(flat), made, capacity)
            made += len(bins)
            held = {k: [] for k in held}
            yield from _in_parts(rows)

        for batch in batches:
            arrow = batch.column(0).type
            coded = bpe.encode_column(batch, text, shared)
            for doc_id, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for k, v in (("doc_id", doc_id), ("piece", n), ("start", at // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                        held[k].append(v)
            if len(held["piece"]) >= TASK_ITEMS:
                yield from pack()
        if held["piece"]:
            yield from pack()

    return kept.mapInArrow(work, f"sequence_id long, fill long, done boolean, members array<{MEMBER.format(kind=kind)}>")


def next_round(bins: DataFrame, number: int, tasks: int, capacity: int, last: bool) -> DataFrame:
    """Underfull bins packed as items, in ``tasks`` tasks that each get the same bins if run again."""

    def work(batches):
        context = TaskContext.get()
        made = (number << 56) | ((context.partitionId() if context else 0) << 34)
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        table = table.take(pa.array(np.argsort(table["sequence_id"].to_numpy(), kind="stable"))).combine_chunks()
        sizes = table["fill"].to_pylist()
        found = best_fit(sizes, capacity)
        members = table["members"].combine_chunks()
        rows = _rows(found, sizes, members.chunk(0) if isinstance(members, pa.ChunkedArray) else members, made, capacity)
        if last:
            rows = rows.set_column(2, "done", pa.array(np.ones(len(found), dtype=bool)))
        yield from _in_parts(rows)

    return bins.repartition(tasks, "sequence_id").mapInArrow(work, bins.schema)


def plan_by_size(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit of ``counts[size]`` items of each size, longest first, as runs (size, first rank, ranks,
    first bin, items a bin, offset): the items of a size with these ranks go to bins one after the other."""
    runs, bins = [], 0
    open_at: dict[int, list[tuple[int, int]]] = {}  # free places: first bin and number of such bins
    rooms: list[int] = []  # sorted

    def free(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in open_at:
                bisect.insort(rooms, room)
            open_at.setdefault(room, []).append((first, number))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, number = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[at]
            else:
                room, first, number = capacity, bins, -(-left // (capacity // size))
                bins += number
            each = room // size
            used = min(number, left // each)
            runs.append((size, rank, used * each, first, each, capacity - room))
            rank, left = rank + used * each, left - used * each
            free(room - each * size, first, used)
            if used < number and left:  # the last bin that takes some takes fewer
                runs.append((size, rank, left, first + used, left, capacity - room))
                free(room - left * size, first + used, 1)
                used, left = used + 1, 0
            free(room if room < capacity else 0, first + used, number - used)
    return [r for r in runs if r[2]]


def last_round(rest: DataFrame, number: int, count: int, capacity: int) -> DataFrame:
    """All underfull bins packed as items by their number of each length."""
    spark = rest.sparkSession
    counts = {r["fill"]: r["count"] for r in rest.groupBy("fill").count().collect()}  # at most ``capacity`` rows
    runs = spark.createDataFrame(plan_by_size(counts, capacity), "fill long, first_rank long, ranks long, first_bin long, each long, base long")
    # ranks among bins of one length: within a salt, after the bins of the salts before it
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("sequence_id"), F.lit(max(1, count // TASK_ITEMS))))
    within = F.row_number().over(Window.partitionBy("fill", "salt").orderBy("sequence_id"))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("fill").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    salts = salted.groupBy("fill", "salt").count().select("fill", "salt", before.alias("before"))
    ranked = salted.withColumn("within", within).join(salts, ["fill", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    placed = ranked.join(F.broadcast(runs), "fill").filter("rank >= first_rank and rank < first_rank + ranks")
    placed = placed.withColumn("turn", F.expr("rank - first_rank")).withColumn("shift", F.expr("base + fill * pmod(turn, each)"))
    fields = [f for f in rest.schema["members"].dataType.elementType.names if f != "offset"]
    moved = F.expr("transform(members, m -> struct(" + ", ".join(f"m.{f}" for f in fields) + ", m.offset + shift AS offset))")
    return placed.select(F.expr(f"{number << 56}L + first_bin + turn div each").alias("sequence_id"), moved.alias("members"))


def best_fit_pack(docs: DataFrame, path: str, *, capacity: int = 4096, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a piece: the key, piece, start, length, ids_crc32, sequence_id and offset."""
    bins = cut(first_round(docs, path, capacity, end_id, text, key))
    finished = bins.filter("done").select("sequence_id", "members")
    rest = bins.filter("not done")
    number, count, gained = 0, rest.count(), True
    while count > 1:
        number += 1
        tasks = math.ceil(count / TASK_ITEMS)
        if tasks > 1 and not gained:
            finished, count = finished.unionByName(cut(last_round(rest, number, count, capacity))), 0
            break
        bins = cut(next_round(rest, number, tasks, capacity, last=tasks == 1))
        finished = finished.unionByName(bins.filter("done").select("sequence_id", "members"))
        rest = bins.filter("not done")
        before, count = count, rest.count()
        gained = count <= (1 - LEAST_GAIN) * before
    if count:
        finished = finished.unionByName(rest.select("sequence_id", "members"))
    return finished.select("sequence_id", F.inline("members")).select(F.col("doc_id").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
