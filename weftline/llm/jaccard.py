"""N-gram Jaccard join: links between texts whose shingle sets overlap by a share, and their components.

The overlaps of all pairs are the product of the document by n-gram incidence matrix with its transpose.
It is computed in blocks of columns, and only as far as size-derived bounds ask for:

1. Texts with equal sets form a class and go on as one. A fixed-size count sketch of all shingles is
   summed over all texts; shingles are ordered by it (rare first), then by hash.
2. Two sets of sizes a and b link only if they share ``ceil(4 (a + b) / 9)`` shingles (at 80 %). So they
   share one among the first ``n - ceil(0.8 n) + 1`` of each in that order: only these entries of the
   matrix are kept. They are dealt by shingle to blocks. The column of a very frequent shingle is cut
   into parts that a hub ties together, so no column grows without bound.
3. Within a block, entries of a shingle give a list of sets. First, each set is paired with one centre,
   the smallest name of its lists, and of these pairs the one that shares most is compared exactly,
   if it shares enough to link. What links forms trees: a group of near copies is joined with as many
   comparisons as it has texts.
4. Sets that lists of more than ``LIST`` sets hold together form families. All other candidates share
   short lists only: their pairs of different trees are counted, at most ``LIST / 2`` an entry. Counts
   are complete for such pairs, and a pair of which less is shared than ``ceil(4 (a + b) / 9)`` minus
   what may lie behind the kept entries is discarded. The rest is compared exactly.
5. A family is dealt to parts of bounded sets and shingles, and every two parts that are near in size
   and hold several trees meet in one task. It multiplies their incidence matrices, so that overlaps
   are exact counts in an array, and gives only links that join trees: rows grow with the sets, however
   many pairs of a family there are. What one large tree holds is never compared with itself.

Shingles are told apart by 64-bit hashes; links are confirmed on the words themselves.

No link between different components is lost; links within one are not listed.

Edge cases: null and empty texts have empty sets, which link with nothing; shorter texts than a shingle
are one shingle; texts of any length count whole; rows with a null id get a null component and link
nothing; rows with one id are one document; repeated rows are copies; an empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftline.llm.components import components, forest, roots
from weftline.llm.shingles import mix, shingle_sets, word_shingles
from weftline.session import cut, prepare

#: Least share of the union that is common, in per cent.
PERCENT = 80
#: Counters of the sketch, and in one part of it.
SKETCH, PART = 1 << 23, 1 << 16
#: Sets in a part of a frequent shingle's column, about.
COLUMN = 2048
#: Sets in a list whose pairs are listed; longer lists make families.
LIST = 64
#: Sets and shingles in a part of a family, about.
PART_SETS, PART_SHINGLES = 1024, 1 << 20
#: Parts that the sums of a family are dealt to.
SALTS = 64
#: Pairs in a column of a product from which it is multiplied densely, and columns at a time.
DENSE, COLUMNS = 10_000, 2048
#: Entries of a block of columns, about.
BLOCK_ENTRIES = 4_000_000
#: Entries that a task gathers before it deals them out.
FLUSH = 1_000_000


def needed(a, b):
    """Shingles that sets of sizes a and b must share to link."""
    return -(-(PERCENT * (a + b)) // (100 + PERCENT))


def prefix(n):
    """Entries of a set of n that are kept."""
    return n - -(-(PERCENT * n) // 100) + 1


def _name(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _short(name: bytes) -> int:
    """The first 64 bits of a name: enough to find candidates by, which are then told apart by id."""
    return int.from_bytes(name[:8], "little", signed=True)


def sizes_and_sketch(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows of part -1: id, size and name of each text's set; of other parts: counters of a task."""
    kept = docs.select(key, text)
    kind, arrow = kept.schema[0].dataType.simpleString(), to_arrow_type(kept.schema[0].dataType)
    schema = pa.schema([("part", pa.int32()), ("id", arrow), ("n", pa.int64()), ("name", pa.binary()), ("short", pa.int64()), ("counts", pa.binary())])

    def work(batches):
        sketch, held, waiting, seen = None, [], 0, set()

        def count():
            nonlocal sketch, held, waiting
            if held:
                more = np.bincount((np.concatenate(held) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
                sketch = more if sketch is None else sketch + more
            held, waiting = [], 0

        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist())
            names = [_name(s) for s in sets]
            for s, name in zip(sets, names, strict=True):
                if len(s) and name not in seen:
                    if len(seen) < 500_000:
                        seen.add(name)
                    held.append(s)
                    waiting += len(s)
            if waiting >= FLUSH:
                count()
            n = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array([_short(x) for x in names], pa.int64()), pa.nulls(n, pa.binary())], schema=schema)
        count()
        if sketch is not None:
            parts = sketch.reshape(-1, PART)
            for at in range(0, len(parts), 16):
                some = parts[at : at + 16]
                blobs = [zlib.compress((b"\1" + p.astype(np.uint8).tobytes()) if p.max() < 256 else (b"\4" + p.tobytes()), 1) for p in some]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(some), dtype=np.int32)), pa.nulls(len(some), arrow), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.int64()), pa.array(blobs, pa.binary())], schema=schema)

    return kept.mapInArrow(work, f"part int, id {kind}, n long, name binary, short long, counts binary")


def _levels(part: pa.Table) -> pa.Table:
    """Eight times the binary logarithm of what a counter holds above the usual, by counter."""
    total = np.zeros(PART, dtype=np.int64)
    for blob in part["counts"].to_pylist():
        raw = zlib.decompress(blob)
        total += np.frombuffer(raw[1:], dtype=np.uint8 if raw[0] == 1 else np.uint32)
    usual = float(np.median(total))
    above = np.maximum(0.0, total - usual - 4 * np.sqrt(usual) - 4)
    levels = np.minimum(255, np.ceil(8 * np.log2(1 + above))).astype(np.uint8)
    return pa.table({"part": part["part"].slice(0, 1), "levels": pa.array([levels.tobytes()], pa.binary())})


def sketch_levels(first: DataFrame) -> np.ndarray:
    """One byte a counter, the same number of bytes whatever the data."""
    found = first.filter("part >= 0").select("part", "counts").groupBy("part").applyInArrow(_levels, "part int, levels binary").collect()
    levels = np.zeros(SKETCH, dtype=np.uint8)
    for row in found:
        levels[row.part * PART : (row.part + 1) * PART] = np.frombuffer(bytes(row.levels), dtype=np.uint8)
    return levels


def entries(docs: DataFrame, levels: np.ndarray, blocks: int, text: str) -> DataFrame:
    """The kept entries, by block: shingle tags, names' first 64 bits and sizes of sets. Rows without
    sizes hold the tags of parts of frequent columns, with the hubs that tie the parts together."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    parts_of_level = np.maximum(1, np.ceil((2.0 ** (np.arange(256) / 8) - 1) / COLUMN)).astype(np.int64)
    frequent = int(np.argmax(parts_of_level > 1)) if (parts_of_level > 1).any() else 256

    def by_block(z, **columns):
        block = ((z >> np.uint64(34)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[order], np.arange(blocks + 1))
        columns = {"tags": z.astype(np.uint32), **columns}
        columns = {k: v[order] for k, v in columns.items()}
        full = np.flatnonzero(edges[1:] > edges[:-1])
        for some in np.array_split(full, max(1, len(full) // 64)):
            cuts = [(edges[b], edges[b + 1]) for b in some]
            made = {k: pa.array([v[a:b].tobytes() for a, b in cuts], pa.binary()) for k, v in columns.items()}
            yield pa.RecordBatch.from_pydict({"block": pa.array(some, pa.int64())} | {k: made.get(k, pa.nulls(len(some), pa.binary())) for k in ("tags", "names", "sizes")})

    def work(batches):
        held: list[tuple[np.ndarray, int, int]] = []
        hubs: list[np.ndarray] = []
        waiting, seen = 0, set()

        def deal():
            nonlocal held, hubs, waiting
            counts = [len(z) for z, _, _ in held]
            z = np.concatenate([z for z, _, _ in held])
            name = np.repeat(np.array([n for _, n, _ in held], dtype=np.uint64), counts)
            size = np.repeat(np.array([s for _, _, s in held], dtype=np.uint32), counts)
            yield from by_block(z, names=name, sizes=size)
            if hubs:
                z, hub = np.unique(np.concatenate(hubs, axis=1), axis=1)
                yield from by_block(z, names=hub)
            held, hubs, waiting = [], [], 0

        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist()):
                if not len(s):
                    continue
                name = _name(s)
                if name in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(name)
                short = _short(name) % (1 << 64)
                level = shared.value[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                rank = (level.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                p = prefix(len(s))
                if p < len(rank):
                    rank = np.partition(rank, p - 1)[:p]
                often = rank >> np.uint64(56) >= np.uint64(frequent)
                z = mix(rank[~often])
                if often.any():  # this set's part of each frequent column
                    r = rank[often]
                    part = np.uint64(short) % parts_of_level[(r >> np.uint64(56)).astype(np.int64)].astype(np.uint64)
                    cut_off = mix(r ^ mix(part + np.uint64(1)))
                    hubs.append(np.stack([cut_off, mix(r ^ np.uint64(SKETCH))]))
                    z = np.concatenate([z, cut_off])
                held.append((z, short, len(s)))
                waiting += len(z)
            if waiting >= FLUSH:
                yield from deal()
        if held:
            yield from deal()

    return docs.select(text).mapInArrow(work, "block long, tags binary, names binary, sizes binary")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and the sums of their weights."""
    if not len(a):
        return a, b, w
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    return a[first], b[first], np.add.reduceat(w, np.flatnonzero(first))


PAIRS = "list long, names array<long>, sizes array<int>, a long, b long, weight long"
_PAIRS = pa.schema([("list", pa.int64()), ("names", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("a", pa.int64()), ("b", pa.int64()), ("weight", pa.int64())])


def _pair_rows(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> pa.Table:
    n = len(a)
    return pa.table([pa.nulls(n, pa.int64()), *(pa.nulls(n, _PAIRS.field(k).type) for k in ("names", "sizes")), pa.array(_signed(a)), pa.array(_signed(b)), pa.array(weight.astype(np.int64))], schema=_PAIRS)


def lists_and_centres(block: pa.Table, limit: int = LIST) -> pa.Table:
    """Of one block: each distinct short list of sets that share shingles (list, names, sizes, weight),
    pairs (a, b, weight; list is null) of each set with the centre of its lists, and links (a, b, 0)
    that tie the sets of lists longer than ``limit``, and the parts of frequent ones, to families."""

    def column(rows, name, kind):
        return np.concatenate([np.frombuffer(x, dtype=kind) for x in rows[name].to_pylist()] or [np.zeros(0, kind)])

    is_entry = pc.is_valid(block["sizes"])
    rows, tied = block.filter(is_entry), block.filter(pc.invert(is_entry))
    tag, name, size = column(rows, "tags", np.uint32), column(rows, "names", np.uint64), column(rows, "sizes", np.uint32)
    order = np.lexsort((name, tag))
    tag, name, size = tag[order], name[order], size[order]
    keep = np.append(True, (tag[1:] != tag[:-1]) | (name[1:] != name[:-1]))
    tag, name, size = tag[keep], name[keep], size[keep]
    starts = np.flatnonzero(np.append(True, tag[1:] != tag[:-1]))
    counts = np.diff(np.append(starts, len(tag)))
    hub_tag, hub = column(tied, "tags", np.uint32), column(tied, "names", np.uint64)
    long = (counts > limit) | np.isin(tag[starts], hub_tag)
    least = np.repeat(name[starts], counts)
    inside = np.repeat(long, counts) & (least != name)
    left, right = forest(np.concatenate([least[inside], name[starts][np.searchsorted(tag[starts], hub_tag)]]), np.concatenate([name[inside], hub]))
    families = _pair_rows(left, right, np.zeros(len(left)))
    # lists of two and more, equal ones once: a list is told by the sum of its mixed names
    sums = np.add.reduceat(mix(name), starts)
    several = counts > 1
    sums, starts, counts, long = sums[several], starts[several], counts[several], long[several]
    if not len(sums):
        return families
    sums, index, weight = np.unique(mix(sums ^ counts.astype(np.uint64)), return_index=True, return_counts=True)
    starts, counts, long = starts[index], counts[index], long[index]
    ends = np.cumsum(counts)
    at = np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])
    name, size = name[at], size[at].astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    weights = weight[owner]
    # sets near in size have one band in one of two bandings at least
    band = np.log(size) / np.log(100 / PERCENT)
    left, right, shared = [], [], []
    for shift in (0.0, 0.5):
        group = owner * 4096 + np.floor(band + shift).astype(np.int64)
        order = np.lexsort((name, group))
        g = group[order]
        first = np.append(True, g[1:] != g[:-1])
        centre = name[order][np.flatnonzero(first)][np.cumsum(first) - 1]
        left.append(centre[~first])
        right.append(name[order][~first])
        shared.append(weights[order][~first])
    a, b, w = _summed(np.concatenate(left), np.concatenate(right), np.concatenate(shared))
    # sets too far apart in size cannot link
    sorted_names, first_at = np.unique(name, return_index=True)
    n_a, n_b = (size[first_at[np.searchsorted(sorted_names, x)]] for x in (a, b))
    close = (n_a * 100 >= PERCENT * n_b) & (n_b * 100 >= PERCENT * n_a)
    a, b, w = a[close], b[close], w[close]
    listed = ~long
    kept = listed[owner]
    number = _signed(mix(sums[listed] ^ np.uint64(int(block["block"][0].as_py()) + 1)))
    offsets = pa.array(np.append(0, np.cumsum(counts[listed])).astype(np.int32))
    n = len(number)
    lists = pa.table([pa.array(number), pa.ListArray.from_arrays(offsets, pa.array(_signed(name[kept]))), pa.ListArray.from_arrays(offsets, pa.array(size[kept].astype(np.int32))), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(weight[listed].astype(np.int64))], schema=_PAIRS)
    return pa.concat_tables([lists, _pair_rows(a, b, w), families])


def across_trees(group: pa.Table) -> pa.Table:
    """Pairs of different trees, and not of one family, that share a list and are near in size: a, b,
    their sizes, weight. Lists hold at most ``LIST`` sets."""
    lists, name, n, weight, tree, family = (group[k].to_numpy() for k in ("list", "a", "n", "weight", "tree", "family"))
    order = np.lexsort((n, lists))
    lists, name, n, weight, tree, family = (x[order] for x in (lists, name, n, weight, tree, family))
    edges = np.append(np.flatnonzero(np.append(True, lists[1:] != lists[:-1])), len(lists))
    out = []
    for s, e in zip(edges, edges[1:], strict=False):
        t, f = tree[s:e], family[s:e]
        if (t == t[0]).all() or (f[0] and (f == f[0]).all()):
            continue
        size = n[s:e]
        reach = np.searchsorted(size, size * 100 // PERCENT, side="right")
        count = np.maximum(0, reach - np.arange(1, len(size) + 1))
        i = np.repeat(np.arange(len(size)), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        other = (t[i] != t[j]) & ((f[i] != f[j]) | (f[i] == 0))
        i, j = i[other], j[other]
        out.append((name[s:e][i], name[s:e][j], size[i], size[j], np.full(len(i), weight[s])))
    schema = pa.schema([(k, pa.int64()) for k in ("a", "b", "n_a", "n_b", "weight")])
    if not out:
        return schema.empty_table()
    a, b, n_a, n_b, w = (np.concatenate(x) for x in zip(*out, strict=True))
    swap = a > b
    a, b, n_a, n_b = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, n_b, n_a), np.where(swap, n_a, n_b)
    order = np.lexsort((b, a))
    a, b, n_a, n_b, w = a[order], b[order], n_a[order], n_b[order], w[order]
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    if not len(a):
        return schema.empty_table()
    w = np.add.reduceat(w, np.flatnonzero(first))
    return pa.table([a[first], b[first], n_a[first], n_b[first], w], schema=schema)


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A fixed number of bits in which the hash of every id is set: which texts to read again."""
    h = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(F.shiftright(h, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {bits}) % 64 as int))").alias("bit"))
    made = np.zeros(bits // 64, dtype=np.int64)
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    made[found["word"].to_numpy()] = found["bits"].to_numpy()
    return made.view(np.uint64)


def _texts_of(docs: DataFrame, ids: DataFrame, text: str, key: str) -> DataFrame:
    """id and text of documents, and of few others: a bitmap of at most 2^27 bits turns most of them
    away at the scan, and the join with pairs the rest."""
    bits = 1 << max(16, min(27, (16 * max(1, ids.count())).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(ids, bits))
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.pmod(F.xxhash64(F.col(key)), F.lit(bits)).alias("spot"), F.col(text).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def work(batches):
        for batch in batches:
            spot = batch.column(1).to_numpy()
            there = (shared.value[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1)
            some = batch.filter(pa.array(there.astype(bool)))
            if some.num_rows:
                yield some.select(["id", "text"])

    return rows.mapInArrow(work, f"id {kind}, text string")


def _words_link(x: str, y: str) -> bool:
    """Whether the sets of two texts with words link, by the words themselves."""
    a, b = word_shingles(x), word_shingles(y)
    common = len(a & b)
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _linked(batches):
    for batch in batches:
        lefts, rights = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        once = {t: i for i, t in enumerate(dict.fromkeys([*lefts, *rights]))}
        sets = shingle_sets(list(once))
        keep = []
        for x, y in zip(lefts, rights, strict=True):
            a, b = sets[once[x]], sets[once[y]]
            both = np.concatenate([a, b])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= PERCENT * (len(a) + len(b) - common) and common > 0 and _words_link(x, y))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def verified(docs: DataFrame, pairs: DataFrame, text: str, key: str) -> DataFrame:
    """The pairs (a, b) of ids whose sets link. The text of b travels to a (texts are less than half as
    large as sets), where both sets are computed; Spark splits a hot a."""
    pairs = cut(pairs)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = _texts_of(docs, cut(ids), text, key)
    kind = pairs.schema["a"].dataType.simpleString()
    moved = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    met = moved.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return cut(met.mapInArrow(_linked, f"a {kind}, b {kind}").distinct())


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The product of two blocks of the incidence matrix: shared shingles of each two sets."""
    row = np.full(len(sets), -1)
    column = row.copy()
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    z = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(z, kind="stable")
    z, owner = z[order], owner[order]
    starts = np.flatnonzero(np.append(True, z[1:] != z[:-1]))
    counts = np.diff(np.append(starts, len(z)))
    starts, counts = starts[counts > 1], counts[counts > 1]
    total = np.zeros((len(left), len(right)))
    if not len(starts):
        return total
    # shingles of the same sets are one column with a weight
    marks = mix(np.arange(1, len(sets) + 1, dtype=np.uint64))
    edges = np.append(0, np.cumsum(counts))
    owner = owner[np.repeat(starts - edges[:-1], counts) + np.arange(edges[-1])]
    _, index, weight = np.unique(np.add.reduceat(marks[owner], edges[:-1]), return_index=True, return_counts=True)
    dense: list[tuple[np.ndarray, np.ndarray, int]] = []
    cells: list[np.ndarray] = []
    weights: list[np.ndarray] = []
    waiting = 0

    def add_cells():
        nonlocal cells, weights, waiting
        if cells:
            total.ravel()[:] += np.bincount(np.concatenate(cells), np.concatenate(weights), total.size)
        cells, weights, waiting = [], [], 0

    def add_dense():
        nonlocal dense
        if dense:
            a, b = np.zeros((len(left), len(dense))), np.zeros((len(dense), len(right)))
            for k, (i, j, w) in enumerate(dense):
                a[i, k] = w
                b[k, j] = 1
            total[:] += a @ b
        dense = []

    for k, w in zip(index.tolist(), weight.tolist(), strict=True):
        who = owner[edges[k] : edges[k + 1]]
        i, j = row[who], column[who]
        i, j = i[i >= 0], j[j >= 0]
        pairs = len(i) * len(j)
        if pairs >= DENSE:
            dense.append((i, j, w))
            if len(dense) == COLUMNS:
                add_dense()
        elif pairs:
            cells.append((i[:, None] * len(right) + j).ravel())
            weights.append(np.full(pairs, w))
            waiting += pairs
            if waiting >= FLUSH:
                add_cells()
    add_cells()
    add_dense()
    return np.rint(total).astype(np.int64)


def _joining(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Which of the links a, b of numbered nodes are enough to join what all of them join."""
    label, chosen, open_ = np.arange(nodes), [], np.arange(len(a))
    while True:
        x, y = label[a[open_]], label[b[open_]]
        open_, x, y = open_[x != y], x[x != y], y[x != y]
        if not len(open_):
            return np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)
        first = np.full(nodes, len(a))
        np.minimum.at(first, x, open_)
        np.minimum.at(first, y, open_)
        some = np.unique(first[first < len(a)])
        chosen.append(some)
        root, node = forest(label[a[some]], label[b[some]])
        above = np.arange(nodes)
        above[node] = root
        label = above[label]


def block_links(group: pa.Table) -> pa.Table:
    """Of two parts of a family (or one, where no row is on the right): links that join their trees."""
    ids, texts = group["id"], group["text"].to_pylist()
    side = group["side"].to_numpy()
    _, tree = np.unique(group["tree"].to_numpy(), return_inverse=True)
    sets = shingle_sets(texts)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    size = np.array([len(s) for s in sets])
    common = _overlaps(sets, left, right)
    link = 100 * common >= PERCENT * (size[left][:, None] + size[right] - common)
    link &= tree[left][:, None] != tree[right]
    i, j = np.nonzero(link)
    i, j = left[i], right[j]
    checked: dict[tuple[int, int], bool] = {}
    while True:
        some = _joining(tree[i], tree[j], int(tree.max()) + 1)
        wrong = []
        for k in some.tolist():
            pair = (int(i[k]), int(j[k]))
            if pair not in checked:
                checked[pair] = _words_link(texts[pair[0]], texts[pair[1]])
            if not checked[pair]:
                wrong.append(k)
        if not wrong:
            return pa.table({"a": ids.take(pa.array(i[some])), "b": ids.take(pa.array(j[some]))})
        i, j = np.delete(i, wrong), np.delete(j, wrong)


def _salted(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join of many rows a key, which are split by their tree, with one row a key, which is copied."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))
    return left.withColumn("salt", F.pmod(F.xxhash64("tree"), F.lit(SALTS))).join(right.withColumn("salt", salts), [*keys, "salt"], how).drop("salt")


def family_links(docs: DataFrame, members: DataFrame, text: str, key: str, unique: bool) -> DataFrame:
    """Links between trees of each family, from members (id, n, tree, family). A document's text travels to
    each block that its part is in; parts of one tree never meet."""
    band = F.floor(F.log("n") / math.log(100 / PERCENT))
    members = members.withColumn("share", F.lit(1 / PART_SETS) + F.col("n") / PART_SHINGLES).withColumn("own_band", band)
    shares = cut(members.groupBy("family", "tree", "own_band").agg(F.sum("share").alias("share")))
    whole = shares.groupBy("family", "tree").agg(F.sum("share").alias("share")).groupBy("family").agg(F.sum("share").alias("all_share"), F.count("*").alias("trees")).filter("trees > 1")
    # a family of one part has one band
    banded = _salted(shares, whole.select("family", (F.col("all_share") <= 1).alias("one")), ["family"]).withColumn("band", F.when(F.col("one"), 0).otherwise(F.col("own_band")))
    trees = banded.groupBy("family", "band", "tree").agg(F.sum("share").alias("tree_share"), F.any_value("one").alias("one")).withColumn("large", F.expr("not one and tree_share > 0.25"))
    rest = trees.filter("not large").groupBy("family", "band").agg(F.sum("tree_share").alias("rest_share"))
    plan = cut(_salted(trees, rest, ["family", "band"], "left"))
    own = F.when(F.col("large"), F.xxhash64(members["family"], "band", members["tree"], F.expr("pmod(xxhash64(id), cast(ceil(tree_share) as long))")))
    part = own.otherwise(F.xxhash64(members["family"], "band", F.pmod(F.xxhash64(members["tree"]), F.ceil("rest_share"))))
    same = (members["family"] == plan["family"]) & (members["tree"] == plan["tree"]) & (plan["one"] | (members["own_band"] == plan["band"]))
    placed = cut(members.join(plan, same).select("id", "n", members["tree"], members["family"], part.alias("part")))
    parts = placed.groupBy("family", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("tree").alias("tree"), F.max("tree").alias("top"))
    p, q = (parts.select("family", *(F.col(k).alias(f"{k}_{x}") for k in ("part", "low", "high", "tree", "top"))) for x in "pq")
    meeting = p.join(q, "family").filter("part_p <= part_q").filter(f"high_p * 100 >= {PERCENT} * low_q and high_q * 100 >= {PERCENT} * low_p").filter("not (tree_p = top_p and tree_q = top_q and tree_p = tree_q)")
    meeting = cut(meeting.select("part_p", "part_q", F.xxhash64("part_p", "part_q").alias("block")))
    sides = meeting.select(F.col("part_p").alias("part"), "block", F.lit(0).alias("side")).unionByName(meeting.filter("part_p <> part_q").select(F.col("part_q").alias("part"), "block", F.lit(1).alias("side")))
    dealt = cut(placed.select("id", "tree", "part").join(sides, "part").select("id", "tree", "block", "side"))
    texts = _texts_of(docs, cut(dealt.select("id").distinct()), text, key)
    if not unique:
        texts = texts.distinct()
    kind = dealt.schema["id"].dataType.simpleString()
    return cut(dealt.join(texts, "id").groupBy("block").applyInArrow(block_links, f"a {kind}, b {kind}").distinct())


def jaccard_components(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: the key, n_shingles and component_id."""
    spark = prepare(docs.sparkSession)
    first = cut(sizes_and_sketch(docs, text, key))
    slim = first.filter("part = -1").select("id", "n", "name", "short")
    alive = slim.filter("n > 0 and id is not null")
    classes = cut(alive.groupBy("name", "short", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    levels = sketch_levels(first)
    total = classes.agg(F.coalesce(F.sum(F.expr(f"n - ceil({PERCENT} * n / 100) + 1")), F.lit(0))).first()[0]
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // BLOCK_ENTRIES), 1)
    limit = LIST
    made = cut(entries(docs.filter(F.col(key).isNotNull()), levels, blocks, text).groupBy("block").applyInArrow(lambda t: lists_and_centres(t, limit), PAIRS))

    node = classes.select("short", "id", "n")

    def least_shared(a: str, b: str) -> Column:
        """Kept entries that two sets of these sizes must share to link: all but what may lie behind them."""
        return F.expr(f"ceil({PERCENT} * ({a} + {b}) / {100 + PERCENT}) - greatest(ceil({PERCENT} * {a} / 100), ceil({PERCENT} * {b} / 100)) + 1")

    centres = made.filter("list is null and weight > 0").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    best = Window.partitionBy("b").orderBy(F.desc("weight"), "a")
    stars = centres.withColumn("turn", F.row_number().over(best)).filter("turn = 1").select("a", "b", "weight")

    def named(pairs: DataFrame) -> DataFrame:
        a, b = (node.select(F.col("short").alias(x), F.col("id").alias(f"id_{x}"), F.col("n").alias(f"size_{x}")) for x in "ab")
        return pairs.join(b, "b").join(a, "a").filter("id_a <> id_b").drop("a", "b").withColumnsRenamed({"id_a": "a", "id_b": "b"})

    # a centre that shares too little is not compared here; if a link is there, the next steps find it
    near = named(stars).filter(F.col("weight") >= least_shared("size_a", "size_b"))
    links = verified(docs, near.select("a", "b"), text, key)
    repeated = cut(slim.filter("id is not null").groupBy("id").count().filter("count > 1").select("id"))
    unique = repeated.isEmpty()
    if unique:
        # centres have smaller names than what they are paired with, so these links form a forest
        trees = roots(links.groupBy("b").agg(F.min("a").alias("parent")).withColumnRenamed("b", "node"))
    else:  # documents of several texts link the classes that they are in: these links need not form one
        held = cut(alive.join(repeated, "id").select("id", "name").distinct().join(classes.select("name", F.col("id").alias("b")), "name").select("id", "b").distinct())
        least_of = held.groupBy("id").agg(F.min("b").alias("a"))
        trees = components(links.unionByName(held.join(least_of, "id").filter("a <> b").select("a", "b")).distinct())

    tree_of = node.join(trees, node["id"] == trees["node"]).select("short", F.xxhash64("root").alias("tree"))
    tree_of = cut(tree_of.unionByName(node.join(trees.select(F.col("root").alias("id")).distinct(), "id", "left_semi").select("short", F.xxhash64("id").alias("tree"))))
    tied = made.filter("list is null and weight = 0").select("a", "b")
    alone, no_family = F.xxhash64(F.lit("alone"), "short"), F.lit(0).cast("long")
    in_families = not tied.isEmpty()
    place = tree_of.withColumn("family", no_family)
    if in_families:
        families = components(tied)
        families = families.unionByName(families.select(F.col("root").alias("node"), "root").distinct())
        family_of = node.select("short").join(families, node["short"] == families["node"]).select("short", F.xxhash64("root").alias("family"))
        place = cut(tree_of.join(family_of, "short", "full").select("short", F.coalesce("tree", alone).alias("tree"), F.coalesce("family", no_family).alias("family")))

    members = made.filter("list is not null").select("list", "weight", F.explode(F.arrays_zip("names", "sizes")).alias("m")).select("list", F.col("m.names").alias("short"), F.col("m.sizes").cast("long").alias("n"), "weight")
    placed = members.join(place, "short", "left").select(F.col("short").alias("a"), "list", "n", "weight", F.coalesce("tree", alone).alias("tree"), F.coalesce("family", no_family).alias("family"))
    placed = placed.withColumn("deal", F.pmod("list", F.lit(4 * blocks)))
    crossing = placed.groupBy("deal").applyInArrow(across_trees, "a long, b long, n_a long, n_b long, weight long")
    counted = crossing.groupBy("a", "b", "n_a", "n_b").agg(F.sum("weight").alias("common"))
    more = verified(docs, named(counted.filter(F.col("common") >= least_shared("n_a", "n_b")).select("a", "b")).select("a", "b"), text, key)
    if in_families:
        of_family = place.filter("family <> 0").join(classes.select("short", "id", "n"), "short").select("id", "n", "tree", "family")
        more = more.unionByName(family_links(docs, of_family, text, key, unique))

    # links between trees, as links between their roots
    def root_of(side: str) -> DataFrame:
        return trees.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))

    between = more.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = components(between)
    above = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    placed_nodes = trees.unionByName(trees.select(F.col("root").alias("node"), "root")).unionByName(joined.select("node", F.col("node").alias("root"))).unionByName(joined.select(F.col("root").alias("node"), "root")).distinct()
    tops = cut(placed_nodes.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("top")).distinct())
    least = cut(tops.groupBy("top").agg(F.min("node").alias("component_id")))
    of_node = tops.join(least, "top").groupBy("node").agg(F.min("component_id").alias("component_id"))
    of_name = cut(classes.join(of_node.withColumnRenamed("node", "id"), "id", "left").filter("copies > 1 or component_id is not null").select("name", F.coalesce("component_id", "id").alias("component_id")))
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    found = slim.join(of_name, "name", "left").select("id", "n", F.when(F.col("id").isNotNull(), own).alias("component_id"))
    if not unique:  # rows without words follow the other rows of their document
        by_id = found.join(repeated, "id").groupBy("id").agg(F.min("component_id").alias("of_id"))
        found = found.join(by_id, "id", "left").select("id", "n", F.coalesce("of_id", "component_id").alias("component_id"))
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: array_to_string(words[i:i + 4], ' '))) END AS s FROM w
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s) AS n_shingles, (SELECT min(r.b) FROM reach r WHERE r.a = s.doc_id) AS component_id FROM sets s
"""
