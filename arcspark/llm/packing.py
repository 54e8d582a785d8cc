"""Filling containers of fixed capacity with documents (problem 5).

Best-two-fit: a container is filled greedily with the largest documents that fit; then its smallest
document is replaced by the two unpacked documents that fit the gap so expanded more tightly.

The rule looks at sizes only, so it is run over the histogram of sizes, which has at most as many entries as the
capacity, whatever the number of documents: a filling found once is repeated as often as the
counts allow, and each such step uses up at least one size (or a pair of it), so there are
hardly more fillings than sizes.  The fillings, whose number the capacity bounds, are the only thing
the driver holds.  Documents then find their places in parallel: a document is the r-th of its size,
and the r-th place of a size is looked up in the fillings.  Ranks come from counts by (size, salt),
so a size that most documents share is spread over as many tasks as there are salts.

Defined results: a document larger than the capacity is split into pieces of the capacity, which fill a
container each, and a rest that is packed like a document; only such documents are split.  A null or empty
text has size 0 and takes no room: such documents share container 0 after its content.  Rows
with equal or null doc_id are documents of their own; equal sizes are placed by salt, a hash of doc_id and size, and then by doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import tokens as T

CAPACITY = 2048
#: Documents for each salt of a size, on average.
PER_SALT = 200_000


def sizes(docs: DataFrame, tokenizer: str = T.NAME, folder: str = T.FOLDER) -> DataFrame:
    """(doc_id, size): tokens of each document's whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = T.load(tokenizer, folder)
        for b in batches:
            found = [own.count(t) if t else 0 for t in map(pa.StringScalar.as_py, b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["doc_id", "size"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, "doc_id bigint, size bigint")


def _largest(counts: np.ndarray) -> np.ndarray:
    """For each x the largest size up to x that is left, or 0."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def fillings(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: how many}) that use up counts[1..capacity] by best-two-fit."""
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    out: list[tuple[int, dict[int, int]]] = []
    top = _largest(counts)
    while top[capacity]:
        own: dict[int, int] = {}
        room, limit = capacity, capacity
        while limit:
            s = int(top[min(room, limit)])
            if not s:
                break
            take = min(int(counts[s]), room // s)
            own[s] = take
            room -= take * s
            limit = s - 1
        if room and own:
            small = min(own)
            gap = room + small
            left = counts.copy()
            for s, m in own.items():
                left[s] -= m
            best = _largest(left)
            a = np.nonzero(left[1 : gap + 1])[0] + 1
            if len(a):
                b = best[gap - a]
                # Two of the same size need two that are left; else the next smaller one serves.
                same = (b == a) & (left[a] < 2)
                b = np.where(same, best[np.maximum(np.minimum(gap - a, a - 1), 0)], b)
                both = np.where(b > 0, a + b, 0)
                i = int(both.argmax())
                if both[i] > small:
                    own[small] -= 1
                    if not own[small]:
                        del own[small]
                    for s in (int(a[i]), int(b[i])):
                        own[s] = own.get(s, 0) + 1
        times = min(int(counts[s]) // m for s, m in own.items())
        for s, m in own.items():
            counts[s] -= times * m
        out.append((times, own))
        top = _largest(counts)
    return out


def _lookup(plan: list[tuple[int, dict[int, int]]], first: int) -> dict[str, np.ndarray]:
    """The fillings as places by size: place r of a size lies in the row with the last start up to r."""
    rows, seen, base = [], {}, first
    for times, own in plan:
        offset, nth = 0, 0
        for s in sorted(own, reverse=True):
            rows.append((s, seen.get(s, 0), base, own[s], offset, nth, times))
            seen[s] = seen.get(s, 0) + times * own[s]
            offset += s * own[s]
            nth += own[s]
        base += times
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 7).T
    return dict(zip(("size", "start", "base", "each", "offset", "nth", "times"), cols)) | {"containers": base}


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = T.NAME, folder: str = T.FOLDER) -> DataFrame:
    """(doc_id, piece, size, container, place, token_offset): where each document, or piece of one, lies.

    piece counts from 0 within a document; place and token_offset from 0 within a container.
    """
    sized = materialize(sizes(docs, tokenizer, folder), "sizes")
    salts = max(8, sized.count() // PER_SALT)
    # Whole pieces fill the first containers; what remains of a document, if anything, is an item.
    left = F.when((F.col("size") > 0) & (F.col("size") % capacity == 0), F.lit(-1)).otherwise(F.col("size") % capacity)
    # Documents that are empty and those that leave no rest have size 0 both; -1 tells the latter.
    rest = sized.select("doc_id", F.floor(F.col("size") / capacity).alias("full"), left.alias("size"), F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts)).alias("salt"))
    by = materialize(rest.groupBy("salt", "size").agg(F.count("*").alias("n"), F.sum("full").alias("full")), "size-counts")
    histogram = by.groupBy("size").agg(F.sum("n")).collect()  # at most one row for each size under the capacity
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram:
        counts[max(size, 0)] = n
    whole = by.groupBy("salt").agg(F.sum("full").alias("full"))
    containers = int(whole.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0])
    table = _lookup(fillings(counts, capacity), containers)
    # Where each salt starts: one row a salt is ordered as a whole, and the salts of one size.
    before = Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    of_salt = whole.select("salt", F.coalesce(F.sum("full").over(before), F.lit(0)).alias("full_first"))
    of_size = by.select("salt", "size", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    # A salt's starts travel ahead of its documents, so that one shuffle brings both together.
    heads = of_size.join(of_salt, "salt").select("salt", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("doc_id"), "size", F.col("first").alias("a"), F.col("full_first").alias("b"))
    own = rest.select("salt", F.lit(1).alias("kind"), "doc_id", "size", F.col("full").alias("a"), F.lit(0).cast("bigint").alias("b"))
    # By range, salts spread evenly over tasks, which a hash of so few numbers would not do.
    lined = heads.unionByName(own).repartitionByRange(salts, "salt").sortWithinPartitions("salt", "kind", "doc_id")
    return lined.mapInArrow(_placer(docs.sparkSession, table, capacity), PLACED)


PLACED = "doc_id bigint, piece bigint, size bigint, container bigint, place bigint, token_offset bigint"


def _placer(spark: SparkSession, table: dict, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The map that gives each document of a salt its rank in its size, and looks up the place of that rank."""
    step = int(table["start"].max() if len(table["start"]) else 0) + 1 + int((table["each"] * table["times"]).max() if len(table["start"]) else 0)
    first = table["base"] == 0
    # Empty documents come after the content of container 0, which may also be one whole piece.
    content = (int(table["each"][first].sum()), int((table["each"][first] * table["size"][first]).sum())) if first.any() else (1, capacity) if table["containers"] else (0, 0)
    shared = spark.sparkContext.broadcast(dict(table, order=table["size"] * step + table["start"], step=step, content=content))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        ranks: dict[tuple[int, int], int] = {}
        fulls: dict[int, int] = {}
        for batch in batches:
            salt, kind, size, a, b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 3, 4, 5))
            head = kind == 0
            if head.any():
                last = int(salt[0])
                ranks = {k: v for k, v in ranks.items() if k[0] >= last}
                for x, y, r, f in zip(*(c[head].tolist() for c in (salt, size, a, b))):
                    ranks[x, y] = r
                    fulls[x] = f
            pick = np.flatnonzero(~head)
            if not len(pick):
                continue
            ids = batch.column(2).take(pa.array(pick))
            salt, size, full = salt[pick], size[pick], a[pick]
            rank, begin = np.empty(len(pick), np.int64), np.empty(len(pick), np.int64)
            by = np.lexsort((size, salt))
            edges = np.flatnonzero(np.r_[True, (np.diff(size[by]) != 0) | (np.diff(salt[by]) != 0), True])
            for lo, hi in zip(edges, edges[1:]):
                at = by[lo:hi]
                key = int(salt[at[0]]), int(size[at[0]])
                rank[at] = ranks[key] + np.arange(len(at))
                ranks[key] += len(at)
            edges = np.flatnonzero(np.r_[True, np.diff(salt) != 0, True])
            for lo, hi in zip(edges, edges[1:]):
                ends = np.cumsum(full[lo:hi])
                begin[lo:hi] = fulls[int(salt[lo])] + ends - full[lo:hi]
                fulls[int(salt[lo])] += int(ends[-1])
            zero = np.zeros(len(pick), np.int64)
            rows = np.repeat(np.arange(len(pick)), full)
            part = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
            out = [(rows, part, np.full(len(rows), capacity), begin[rows] + part, zero[:1].repeat(len(rows)), zero[:1].repeat(len(rows)))]
            at = np.flatnonzero(size > 0)
            if len(at):
                row = np.searchsorted(t["order"], size[at] * t["step"] + rank[at], side="right") - 1
                inside = rank[at] - t["start"][row]
                nth = inside % t["each"][row]
                out.append((at, full[at], size[at], t["base"][row] + inside // t["each"][row], t["nth"][row] + nth, t["offset"][row] + nth * size[at]))
            at = np.flatnonzero((size == 0) & (full == 0))
            if len(at):
                out.append((at, zero[at], zero[at], zero[at], t["content"][0] + rank[at], zero[at] + t["content"][1]))
            cols = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0])), *(pa.array(c, pa.int64()) for c in cols[1:])], PLACED_NAMES)

    return put


PLACED_NAMES = [x.split()[0] for x in PLACED.split(", ")]


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, unused, filled_share) of a packing."""
    return packed.agg((F.coalesce(F.max("container"), F.lit(-1)) + 1).alias("containers"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens")).select(
        "containers", "tokens", (F.col("containers") * capacity - F.col("tokens")).alias("unused"), (F.col("tokens") / F.greatest(F.col("containers") * capacity, F.lit(1))).alias("filled_share")
    )


def invariants(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(documents, tokens, overfull, misplaced, split_small, tight) of a packing, one row.

    documents counts first pieces and empty documents; overfull: containers over the capacity; misplaced: rows that don't begin where the one
    before them in the container ends; split_small: rows of a piece under the capacity that isn't its document's last; tight: whether at most 1 %
    and one container more than the tokens need are used.  doc_ids must be unique.
    """
    at = Window.partitionBy("container").orderBy("token_offset", "place")
    lined = packed.where("size > 0").withColumns({"before": F.lag(F.col("token_offset") + F.col("size"), 1, 0).over(at), "nth": F.row_number().over(at) - 1})
    # Empty documents share one container, so their rows are left out of the order.
    full = lined.groupBy("container").agg(F.sum("size").alias("size"), F.count_if((F.col("token_offset") != F.col("before")) | (F.col("place") != F.col("nth"))).alias("wrong"))
    held = full.agg(F.count_if(F.col("size") > capacity).alias("overfull"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("misplaced"), F.count("*").alias("containers"))
    rows = packed.agg(F.count_if(F.col("piece") == 0).alias("documents"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"), F.count_if((F.col("piece") > 0) & (F.col("size") > capacity)).alias("over"))
    last = packed.where("doc_id is not null").groupBy("doc_id").agg(F.max("piece").alias("last"))
    small = packed.join(last.where("last > 0"), "doc_id").agg(F.count_if((F.col("piece") < F.col("last")) & (F.col("size") != capacity)).alias("split_small"))
    one = lambda df: df.withColumn("one", F.lit(1))
    need = F.ceil(F.col("tokens") / capacity)
    return one(rows).join(one(held), "one").join(one(small), "one").select("documents", "tokens", "overfull", "misplaced", "split_small", (F.col("containers") <= need * 1.01 + 1).alias("tight"))
