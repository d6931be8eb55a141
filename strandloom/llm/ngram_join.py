"""N-gram Jaccard join by T-occurrence search with DivideSkip; exact, as components.

A document's set holds its different shingles of `n` lower-cased words. Two documents link if
percent_den * |A and B| >= percent_num * |A or B|. Documents with equal sets are one class from the start.

Routing. Two linked sets of at most m shingles differ in at most k = floor((1 - t) / (1 + t) * 2 m) shingles. The
shingles' hash space is cut into more than k cells, so linked sets agree in all shingles of all but k cells. A set is
written once per cell under the hash of the cell's shingles, in its size group (and in the next, if a partner may be there); the
cells that hold the fewest shingles are left out, as many as leave one to agree in. The classes under one key make a star
about the least of them: linear in the input, also where a third of all documents share a key. Each star is taken once, however many keys make it.

Sketches. Documents that share a passage or a turn of phrase share a key now and then. To tie all of a star would chain such documents
to ever larger groups as the input grows, and large groups are searched block against block. So each class has a
sketch, the parities of its shingles in a few cells: sets differ in as many shingles as their sketches do, or more. In a star only classes that may link by their
sizes and sketches are tied, by as many ties as connect them. Stars beyond a budget of comparisons or bytes are tied whole, so no link is lost.
Connected ties give groups that hold every link, and few other documents.

Shingles of passages that many documents share would tie those. Postings are counted over all documents in 2 ** COUNTERS
counters; shingles whose counter stands out of the mean don't take part in the cells, which loses no link, for sets
without them differ no more. Sets whose rare shingles leave too many cells empty go by their whole sets besides.

Search. In a group, inverted lists of all shingles are built. A set of size s needs T common shingles with a partner;
its T - 1 longest lists (DivideSkip's long lists) are left out of the merge, the short ones are merged (by a heap, or a
sort where many postings meet), and each candidate so found, of which every partner is one, is completed by binary probes of the long lists until T is
reached or out of reach. Passages that many documents share are long lists and so never merged. Pairs already
connected need no search, for only components are asked. A group beyond `block` shingles is cut into blocks by hash, and
every pair of blocks is searched in a task of its own, so no task holds an unbounded group.

Links between classes, membership and components go through tables in the shared folder; none reach the driver.

Cases: documents without words or text have an empty set and are alone. With fewer than n words the whole sequence is the
one shingle. Rows that repeat a doc_id count each by their text, and each row gets the component of its text. Equal texts
share a class. An empty table gives no rows.
Rows with a null doc_id link like all others, also as bridges; a component's id is the smallest doc_id that isn't null, or null if there is none. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap as id_bitmap
from .common import connected_components, fresh_name, may_be_in, remove, small_batches, written
from .text import Words, mix, slices, utf8, windows

COUNTERS, SEGMENTS, FAN = 22, 64, 64  # counters of postings (a power of two), parts they are summed in, tasks whose counts one task adds up
GROWTH = 1.5  # largest size of a group of sizes over its smallest
BUDGET = 1 << 24  # comparisons of sketches in a star, and bytes a task holds of one
CLASSED = "doc_id long, lo long, hi long, n_shingles int, sketch binary"
LINK_NAMES = ["lo", "hi", "lo2", "hi2"]


def difference(size: int, num: int, den: int) -> int:
    """Most shingles that two linked sets of at most size shingles differ in."""
    return floor((den - num) * 2 * size / (den + num) + 1e-9)


def bounds(limit: int = 1 << 40) -> list[int]:
    """Largest sizes of the size groups."""
    out, now = [], 4
    while now < limit:
        out.append(now)
        now = max(now + 1, int(now * GROWTH))
    return out


BOUNDS = np.array(bounds())


def shingle_sets(column: pa.Array, n: int, kinds: int = 1) -> list[tuple[np.ndarray, ...]]:
    """Of each text the hashes of its different shingles, ascending by the first kind, one array for each kind."""
    data, offsets = utf8(column)
    words = Words(data, offsets, lower=True)
    h = words.hashes(kinds)
    full = [mix(windows(x, n, kind)) for kind, x in enumerate(h)]
    out = []
    for lo, hi in zip(words.first, words.first[1:]):
        if hi - lo >= n:
            a, at = np.unique(full[0][lo : hi - n + 1], return_index=True)
            out.append((a, *(x[lo : hi - n + 1][at] for x in full[1:])))
        elif hi > lo:
            out.append(tuple(mix(windows(x[lo:hi], int(hi - lo), kind) + np.uint64(hi - lo)) for kind, x in enumerate(h)))
        else:
            out.append((np.zeros(0, np.uint64),) * kinds)
    return out


def cell_keys(a: np.ndarray, common: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """Keys of the cells that a set of ascending hashes is routed by; common: which of them are common, None: none."""
    size = len(a)
    own = int(np.searchsorted(BOUNDS, size))
    groups = [own]
    if size * den >= (int(BOUNDS[own]) + 1) * num:  # a partner may be in the next group
        groups.append(own + 1)
    rare = a if common is None else a[~common]
    out = []
    for group in groups:
        k = difference(int(BOUNDS[group]), num, den)
        cells = k + 1 + -(-(k + 1) // 4)
        keys, filled, least = _cells(rare, cells, k, 2 * group)
        out.append(keys[filled >= max(1, least)])
        if not least:  # few rare shingles: also by the whole set, with or without common ones, for two such sets may agree in empty cells alone
            keys, filled, least = _cells(a, cells, k, 2 * group + 1)
            out.append(keys[filled >= least])
    return np.concatenate(out)


def _cells(a: np.ndarray, cells: int, k: int, salt: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each cell a key and its number of shingles, and the largest c such that cells of fewer than c shingles are no more than cells - k - 1."""
    cell = (((a >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)
    total = np.zeros(cells, np.uint64)
    np.add.at(total, cell, mix(a + np.uint64(0x51ED270B)))
    filled = np.bincount(cell, minlength=cells)
    return mix(total + mix(np.arange(cells, dtype=np.uint64) + np.uint64((salt + 1) << 40))), filled, int(np.sort(filled)[cells - k - 1])


def _counted(batches, n):
    """Postings per counter of the texts of a task, as compressed segments."""
    counts = np.zeros(1 << COUNTERS, np.uint32)
    for batch in slices(batches, size=1 << 20):
        if sets := [a for a, in shingle_sets(batch.column("text"), n)]:
            at, times = np.unique(np.concatenate(sets) >> np.uint64(64 - COUNTERS), return_counts=True)
            counts[at.astype(np.int64)] += times.astype(np.uint32)
    parts = [zlib.compress(part.tobytes(), 1) for part in counts.reshape(SEGMENTS, -1)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SEGMENTS, dtype=np.int32)), pa.array(parts, pa.binary())], ["segment", "counts"])


def common_counters(texts: DataFrame, n: int) -> np.ndarray:
    """Bitmap of the counters (leading bits of a shingle's hash) that stand out of the mean over all documents: a fixed 2 ** COUNTERS bits."""
    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << COUNTERS) // SEGMENTS, np.uint64)
        for part in table.column("counts").to_pylist():
            part = zlib.decompress(part)
            total += np.frombuffer(part, np.uint32 if len(part) == 4 * len(total) else np.uint64)
        return pa.table({"segment": table.column("segment")[:1], "task": table.column("task")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    kind = "segment int, task int, counts binary"
    parts = texts.select("text").mapInArrow(lambda it: _counted(it, n), "segment int, counts binary").select("segment", F.spark_partition_id().alias("task"), "counts")
    # In steps, so that no task adds up more than FAN tasks' counts of a segment, up to FAN ** 3 tasks.
    for _ in range(2):
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("segment", "task").applyInArrow(add, kind)
    rows = parts.groupBy("segment").applyInArrow(add, kind).collect()  # 2 ** COUNTERS counts
    total = np.zeros((SEGMENTS, (1 << COUNTERS) // SEGMENTS), np.uint64)
    for row in rows:
        total[row["segment"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint64)
    mean = total.mean()
    return np.packbits(total.reshape(-1) > mean + 4 * np.sqrt(mean) + 4)


def _class_of(a: np.ndarray, kind: int = 0) -> int:
    """A 64-bit hash of a set, from its hashes of a kind; both make a class."""
    return int(mix(np.array([a.sum() + np.uint64(kind * len(a))])).view(np.int64)[0])


def sketch(a: np.ndarray, num: int, den: int) -> bytes:
    """Parities of the number of shingles in a power of two of cells, about 4 to 8 for each shingle that a linked set of this size may differ in.

    Two sets differ in as many shingles as their parities do, or more. The cells go by a hash's last bits, so a sketch can be folded.
    """
    bits = 1 << max(6, (4 * difference(len(a), num, den) - 1).bit_length())
    odd = np.bincount((a & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(one: int, bits: int, to: int) -> int:
    """A sketch of fewer bits of the same set."""
    while bits > to:
        bits >>= 1
        one = (one >> bits) ^ (one & ((1 << bits) - 1))
    return one


def forest(sets: list[tuple[int, int, int]], num: int, den: int, budget: int = BUDGET) -> list[tuple[int, int]]:
    """Edges that connect sets, each (number of shingles, bits of its sketch, sketch), as all pairs do that may link by size and sketch.

    Every link is such a pair. Beyond the budget of comparisons all that aren't connected yet are, so that none is lost.
    """
    edges, left = [], list(range(len(sets)))
    while left:
        reached = [left.pop()]
        while reached and left:
            p, far = reached.pop(), []
            n, bits, one = sets[p]
            least, most = -(-n * num // den), n * den // num
            budget -= len(left)
            for q in left:
                m, other, two = sets[q]
                if budget >= 0:
                    if not least <= m <= most:
                        far.append(q)
                        continue
                    differ = one ^ two if bits == other else folded(one, bits, other) ^ folded(two, other, bits)
                    if differ.bit_count() > (den - num) * (n + m) // (den + num):
                        far.append(q)
                        continue
                edges.append((p, q))
                reached.append(q)
            left = far
    return edges


def _near(batches, num, den):
    """Stars in rows sorted by their centre (least): edges (src, dst) that connect a star's classes as all pairs do that may link."""
    held, centre, weight = [], None, 0

    def edges():
        return [(held[p][0], held[q][0]) for p, q in forest([x[1:] for x in held], num, den)]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["src", "dst"])

    out = []
    for batch in batches:
        for least, lo, size, blob in zip(*(batch.column(c).to_pylist() for c in ("least", "lo", "n_shingles", "sketch"))):
            if least != centre:
                out += edges()
                held, centre, weight = [], least, 0
            held.append((lo, size, 8 * len(blob), int.from_bytes(blob, "little")))
            weight += len(blob) + 100
            if weight > BUDGET:  # more than a task should hold: all are connected
                out += [(x[0], least) for x in held]
                held = []
        if len(out) > 4096:
            yield batch_of(out)
            out = []
    out += edges()
    if out:
        yield batch_of(out)


def _classed(batches, n, num, den):
    for batch in slices(batches):
        rows = [(_class_of(a), _class_of(b, 1), len(a), sketch(a, num, den)) if len(a) else (0, 0, 0, None) for a, b in shingle_sets(batch.column("text"), n, 2)]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "lo", "hi", "n_shingles", "sketch"])


def _keyed(batches, n, num, den, bitmap):
    """(key, lo) of each class in a task, once however many copies it has there."""
    seen, bits = set(), np.unpackbits(bitmap).view(bool)
    for batch in slices(batches, size=1 << 20):
        keys, owners = [], []
        for a, in shingle_sets(batch.column("text"), n):
            if len(a) and (made := _class_of(a)) not in seen:
                seen.add(made)
                found = cell_keys(a, bits[(a >> np.uint64(64 - COUNTERS)).astype(np.int64)], num, den)
                keys.append(found)
                owners.append(np.full(len(found), made))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], ["key", "lo"])


def t_occurrence(sets: list[np.ndarray], num: int, den: int, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the sets as all links do (a spanning forest). apart: a side (0 or 1) of each set; only sets of different sides are compared."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order])
    side = None if apart is None else np.asarray(apart)[order]
    group = np.arange(len(order))  # of each set what it is connected to so far
    flat, owner = np.concatenate([sets[i] for i in order]), np.repeat(np.arange(len(order)), size)
    value, code = np.unique(flat, return_inverse=True)
    by = np.argsort(code, kind="stable")
    listed, edge = owner[by], np.searchsorted(code[by], np.arange(len(value) + 1))
    starts = np.concatenate([[0], np.cumsum(size)])
    links = []
    for q in range(1, len(order)):
        least = -(-int(size[q]) * num // den)
        low = int(np.searchsorted(size[:q], least))  # partners come before q and have `least` shingles or more
        if low == q:
            continue
        mine = code[starts[q] : starts[q + 1]]
        # A partner of s shingles shares ceil(num * (size + s) / (num + den)) of them, so `needed` at the least.
        needed = -(-num * (int(size[q]) + least) // (num + den))
        length = edge[mine + 1] - edge[mine]
        ranked = np.argsort(length, kind="stable")
        short, long = mine[ranked[: len(mine) - needed + 1]], mine[ranked[len(mine) - needed + 1 :]]
        lists = []
        for k in short[edge[short + 1] - edge[short] > 1].tolist():
            one = listed[edge[k] : edge[k + 1]]
            at, stop = np.searchsorted(one, (low, q))
            if at < stop:
                lists.append(one[at:stop])
        for p, count in merged(lists):
            if group[p] == group[q] or (side is not None and side[p] == side[q]):
                continue
            enough = -(-num * int(size[q] + size[p]) // (num + den))
            if count + len(long) < enough:
                continue
            theirs = code[starts[p] : starts[p + 1]]
            at = np.searchsorted(theirs, long)
            at[at == len(theirs)] = 0
            if count + int((theirs[at] == long).sum()) >= enough:
                group[group == group[q]] = group[p]
                links.append((order[q], order[p]))
    return links


def merged(lists: list[np.ndarray], heap: int = 64) -> list[tuple[int, int]]:
    """Members of ascending lists with the number of lists each is in, the most frequent first: by a heap, or by one sort where many postings meet."""
    if sum(map(len, lists)) > heap:
        value, count = np.unique(np.concatenate(lists), return_counts=True)
        best = np.argsort(-count, kind="stable")
        return list(zip(value[best].tolist(), count[best].tolist()))
    out: list[list[int]] = []
    for value in heapq.merge(*(x.tolist() for x in lists)):
        if out and out[-1][0] == value:
            out[-1][1] += 1
        else:
            out.append([value, 1])
    return sorted(map(tuple, out), key=lambda x: -x[1])


def _searched(batches, num, den):
    """Groups in rows sorted by (grp, a, b): their links as pairs of classes (lo, hi)."""
    held, key = [], None

    def links():
        ids = [r[0] for r in held]
        sets = [np.frombuffer(r[2], np.uint64) for r in held]
        apart = None if key[1] == key[2] else np.array([int(r[1] == key[2]) for r in held])
        found = t_occurrence(sets, num, den, apart) if len(held) > 1 else []
        return [(*ids[x], *ids[y]) for x, y in found]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], LINK_NAMES)

    out = []
    for batch in batches:
        for g, a, b, block, lo, hi, blob in zip(*(batch.column(c).to_pylist() for c in ("grp", "a", "b", "block", "lo", "hi", "shingles"))):
            if (g, a, b) != key:
                if held:
                    out += links()
                held, key = [], (g, a, b)
            held.append(((lo, hi), block, blob))
        if len(out) > 4096:
            yield batch_of(out)
            out = []
    if held:
        out += links()
    if out:
        yield batch_of(out)


def _linked(texts: DataFrame, n: int, num: int, den: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows' classes, classes with their least doc_id and number of rows, linked classes with the class at their component's root)."""
    bitmap = common_counters(texts, n)
    classed = written(texts.mapInArrow(lambda it: _classed(it, n, num, den), CLASSED), "join-classes")
    some = classed.filter("n_shingles > 0")
    facts = [F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("rows"), F.first("sketch").alias("sketch")]
    firsts = written(some.groupBy("lo", "hi").agg(*facts), "join-firsts")

    # Stars: under each key, every class goes to the least; equal sets share lo and fall together. In a star, what may link is connected.
    # Without the filter the aggregation and the join would each make an exchange of their own.
    tied = texts.mapInArrow(lambda it: _keyed(it, n, num, den, bitmap), "key long, lo long").filter("key is not null and lo is not null").repartition("key")
    least = tied.groupBy("key").agg(F.min("lo").alias("least"), F.max("lo").alias("most")).filter("least < most").select("key", "least")
    stars = tied.join(least, "key").select("least", "lo").distinct().join(firsts.select("lo", "n_shingles", "sketch"), "lo")
    ties = stars.repartition("least").sortWithinPartitions("least").mapInArrow(lambda it: _near(it, num, den), "src long, dst long")
    groups = connected_components(ties, "join-groups").select(F.col("node").alias("lo"), F.col("root").alias("grp"))

    # The sets of classes in groups, each once, cut into blocks where a group is large.
    members = firsts.join(groups, "lo")
    load = members.groupBy("grp").agg(F.sum("n_shingles").alias("load"))
    placed = members.join(load, "grp").withColumn("blocks", F.ceil(F.col("load") / block).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(lo, hi), blocks) as int)"))
    placed = written(placed.select("grp", "block", "blocks", "lo", "hi"), "join-placed")
    some_lo = id_bitmap(placed, "lo")  # most documents are in no group, and their sets needn't be shuffled

    def shingled(batches):
        seen = set()
        for batch in slices(batches):
            sets = [(_class_of(a), _class_of(b, 1), a) for a, b in shingle_sets(batch.column("text"), n, 2) if len(a)]
            asked = may_be_in(some_lo, np.array([lo for lo, _, _ in sets], np.int64))
            rows = [(lo, hi, a.tobytes()) for (lo, hi, a), ask in zip(sets, asked) if ask and (lo, hi) not in seen and not seen.add((lo, hi))]
            if rows:
                lo, hi, blobs = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(blobs, pa.binary())], ["lo", "hi", "shingles"])

    found = texts.mapInArrow(shingled, "lo long, hi long, shingles binary")
    sets = found.join(placed, ["lo", "hi"]).groupBy("lo", "hi", "grp", "block", "blocks").agg(F.first("shingles").alias("shingles"))  # tasks that hold copies of a class send it each
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("grp", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "lo", "hi", "shingles")
    dealt = pairs.repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b")
    links = dealt.mapInArrow(lambda it: _searched(it, num, den), "lo long, hi long, lo2 long, hi2 long")
    nodes = connected_components(links.select(F.struct("lo", "hi").alias("src"), F.struct(F.col("lo2").alias("lo"), F.col("hi2").alias("hi")).alias("dst")), "join-links")
    remove(placed)
    return classed, firsts, nodes.select("node.lo", "node.hi", "root")


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def ngram_jaccard(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, block: int = 200_000) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    classed, firsts, nodes = _linked(_texts(docs), n, num, den, block)
    least = firsts.join(nodes, ["lo", "hi"]).groupBy("root").agg(F.min("rep").alias("component_id"))
    known = firsts.join(nodes.join(least, "root"), ["lo", "hi"], "left").select("lo", "hi", F.coalesce("component_id", "rep").alias("component_id"))
    out = classed.join(known.repartition("hi"), ["lo", "hi"], "left")  # an exchange of its own lets Spark split a class of many copies
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def without_near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, block: int = 200_000) -> DataFrame:
    """docs with one row of each component: one of its smallest doc_id, of several the one of the least text hash; rows without words all stay.

    Decided row by row, so rows that repeat a doc_id or have none are treated as all others. Only rows that may have to go are shuffled.
    """
    _, firsts, nodes = _linked(_texts(docs), n, num, den, block)
    firsts = firsts.select("lo", "hi", "rep", "rows")
    members = firsts.join(nodes, ["lo", "hi"])
    best = members.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "lo", "hi")).alias("best")).select("root", F.col("best.lo").alias("best_lo"), F.col("best.hi").alias("best_hi"))
    gone = written(members.join(best, "root").filter("lo <> best_lo or hi <> best_hi").select("lo", "hi"), "join-gone")
    several = firsts.filter("rows > 1").select("lo", "hi")
    asked = id_bitmap(gone.union(several), "lo")

    @F.arrow_udf("struct<lo:long,hi:long>")
    def asked_class(column: pa.Array) -> pa.Array:
        """The class of each text that may have to go, null for others."""
        made = []
        for part in slices([pa.RecordBatch.from_arrays([column], ["text"])]):
            made += [(_class_of(a), _class_of(b, 1)) if len(a) else None for a, b in shingle_sets(part.column("text"), n, 2)]
        there = may_be_in(asked, np.array([0 if m is None else m[0] for m in made], np.int64))
        made = [m if t else None for m, t in zip(made, there)]
        lost = pa.array([m is None for m in made], pa.bool_())
        return pa.StructArray.from_arrays([pa.array([m and m[k] for m in made], pa.int64()) for k in (0, 1)], ["lo", "hi"], mask=lost)

    name, nth = fresh_name(docs, "class"), fresh_name(docs, "nth")
    rows = small_batches(docs).withColumn(name, asked_class(F.col("text").cast("string")))
    some = rows.filter(F.col(name).isNotNull()).join(gone.select(F.struct("lo", "hi").alias(name)), name, "left_anti")
    order = Window.partitionBy(name).orderBy(F.col("doc_id").cast("long").asc_nulls_last(), F.xxhash64("text"))
    kept = some.withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1)
    return rows.filter(F.col(name).isNull()).select(docs.columns).union(kept.select(docs.columns))
