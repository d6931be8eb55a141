"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours and a group too large for one
shard can be cut. A shard is made of slices of about `slice_bytes`, at most MOST_SLICES for all shards; so their number grows with the input, and a task sorts one slice. The boundaries of the
slices, of equal bytes, are found by counting: bytes below
candidate keys are summed exactly over all rows, first for equal steps of the hash, then only within the cells that
hold a boundary, in finer steps; within a single hash (equal texts) by doc_id. A boundary is done when its cell
has at most `tolerance` of a slice's bytes, or a single key. Then the rows are exchanged once, by slice.

The driver gets MOST_SLICES * 2 ** BITS sums a round at most, whatever the input; slices are cut also when one text makes a third of all rows.

Cases: a null text has no bytes and counts 1 as every row; null doc_ids come first. Rows equal in text and doc_id
have one key and stay together; their slots are dealt in any order. An empty table gives no rows. Columns named like
the result's are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, text_or_empty, written

FIRST, BITS, MOST_SLICES = 13, 6, 8192
RESULT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """The input's columns as one struct, and what the sort needs beside it; so no name can clash."""
    body, whole = text_or_empty("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(whole, F.col("doc_id"), F.col("text")).withColumns({"_h": F.xxhash64(body), "_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), "size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(body.cast("binary"))})


def _cells(rows: DataFrame, *by: Column) -> list:
    found = rows.groupBy(*by).agg(
        F.sum("size").alias("size"), F.min("_h").alias("h_min"), F.max("_h").alias("h_max"), F.min("_d").alias("d_min"), F.max("_d").alias("d_max")
    )
    return sorted(found.collect(), key=lambda r: (r["h_min"], r["d_min"]))  # 2 ** FIRST or boundaries * 2 ** BITS rows at most


def splitters(rows: DataFrame, parts: int, tolerance: float) -> list[tuple[int, int]]:
    """parts - 1 keys (hash, doc_id), ascending, that cut rows (_h, _d, size) into parts of nearly equal size."""
    shift = 64 - FIRST
    cells = _cells(rows, F.shiftright("_h", shift).alias("cell"))
    total = sum(c["size"] for c in cells)
    targets = [total * j // parts for j in range(1, parts)]
    most = tolerance * total / parts
    done: dict[int, tuple[int, int]] = {}
    below, active, keyed = 0, {}, {}

    def place(cells, below, wanted, finer):
        """Settle the boundaries of wanted (places in targets) that lie in cells, the first of which has below bytes before it; finer(cell) takes those to refine."""
        wanted = sorted(wanted)
        for cell in cells:
            here = [j for j in wanted if below <= targets[j] < below + cell["size"]]
            single = (cell["h_min"], cell["d_min"]) == (cell["h_max"], cell["d_max"])
            if here and (single or cell["size"] <= most):
                for j in here:
                    up = targets[j] - below > below + cell["size"] - targets[j]
                    done[j] = (cell["h_max"], cell["d_max"] + 1) if up and cell["d_max"] < MOST else (cell["h_min"], cell["d_min"])
            elif here:
                finer(cell, below, here)
            below += cell["size"]

    def finer(cell, below, here):
        if cell["h_min"] == cell["h_max"]:
            keyed[cell["h_min"], cell["d_min"]] = (cell, below, here)
        else:
            active[cell["h_min"] >> shift] = (cell, below, here)

    place(cells, 0, range(parts - 1), finer)
    while active:
        now, active = active, {}
        old, shift = shift, max(0, shift - BITS)
        some = rows.filter(F.shiftright("_h", old).isin(list(now)))
        by: dict[int, list] = {}
        for cell in _cells(some, F.shiftright("_h", shift).alias("cell")):
            by.setdefault(cell["h_min"] >> old, []).append(cell)
        for prefix, (_, below, here) in now.items():
            place(by[prefix], below, here, finer)
    while keyed:
        now, keyed = keyed, {}
        cases = None
        for number, ((h, _), (cell, _, _)) in enumerate(now.items()):
            step = max(1, -(-(cell["d_max"] - cell["d_min"] + 1) >> BITS))
            inside = (F.col("_h") == h) & F.col("_d").between(cell["d_min"], cell["d_max"])
            value = F.floor((F.col("_d").cast("decimal(38,0)") - F.lit(cell["d_min"]).cast("decimal(38,0)")) / F.lit(step).cast("decimal(20,0)")).cast("long") + number * (1 << BITS)
            cases = F.when(inside, value) if cases is None else cases.when(inside, value)
        some = rows.filter(F.col("_h").isin([h for h, _ in now])).withColumn("_cell", cases).filter("_cell is not null")
        by = {}
        for cell in _cells(some, F.col("_cell")):
            by.setdefault(cell["_cell"] >> BITS, []).append(cell)
        for number, (_, below, here) in enumerate(list(now.values())):
            place(by[number], below, here, finer)
    return [done[j] for j in sorted(done)]


def slice_of(cuts: list[tuple[int, int]]) -> Column:
    """How many cuts are at or below a row's key: a binary search written as nested conditions."""
    def number(x: int) -> str:
        return f"({x + 1}L - 1L)" if x == LEAST else f"{x}L"

    def search(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        h, d = map(number, cuts[mid])
        return f"CASE WHEN _h < {h} OR (_h = {h} AND _d < {d}) THEN {search(lo, mid)} ELSE {search(mid + 1, hi)} END"

    return F.expr(search(0, len(cuts)))


def histogram_shards(docs: DataFrame, shards: int = 16, slice_bytes: int = 64 << 20, slices: int | None = None, tolerance: float = 0.01) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (null under this law), sizes of shards near equal. slices: of each shard, where their number is to be given."""
    keyed = _keyed(docs)
    rows = written(keyed.select("_h", "_d", "size"), "shard-keys")
    if slices is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        slices = min(max(1, MOST_SLICES // shards), max(4, -(-total // (shards * slice_bytes))))
    parts = shards * slices
    cuts = splitters(rows, parts, tolerance)
    counts = {r["part"]: r["n"] for r in rows.groupBy(slice_of(cuts).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # parts rows
    remove(rows)
    before = []
    for part in range(parts):
        first = part // slices * slices
        before.append(sum(counts.get(p, 0) for p in range(first, part)))
    placed = keyed.withColumn("_part", slice_of(cuts))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_h", "_d"))
    made = placed.withColumns({
        "law": F.lit("bytes"), "shard": F.floor(F.col("_part") / slices).cast("int"),
        "slot": F.element_at(F.expr(f"array({', '.join(f'{n}L' for n in before)})"), F.col("_part") + 1) + rank - 1,
        "grown_shard": F.lit(None).cast("int"),
    })
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in RESULT]
    return made.select(*own, *RESULT)
