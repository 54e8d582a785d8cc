"""New batches against everything accepted before (problem 2).

A prefix-tree hash forest.  Each distinct set of checksums has a path of DEPTH nodes in each of TREES prefix trees: the d-th
node stands for its first d minimum hashes there.  Paths are kept in sorted runs, so that the sets below a node are
a contiguous range; a run is cut into segments by the leading bits of that order.  A batch

* looks up its sets and its places by key,
* plans a range for each new set in each tree: it begins at the deepest node and widens towards the root until the chance to miss a
  set of the wanted similarity, over all trees, is under 1 - RECALL.  A node with more than HOT_RANGE sets below
  it is not entered: the set stays at a narrower one in that tree and widens further in the others,
* searches these ranges in the segments they lie in, and verifies what it finds member by member,
* adds what it accepts as one more run.  Beyond MAX_RUNS runs the newest are merged, up to the first that is larger than all newer
  ones together, so a row is rewritten about log(batches) times.

What a batch reads of the history is the segments its keys lie in, whatever the history's size, as long as a batch has fewer
keys than there are segments; with more keys every segment is touched.

Two things keep the work bounded by the data rather than by its repetitions: equal sets are one class and equal (place,
size) are one group, both kept as keys, and a hot group is never expanded into pairs; and sets that can't reach the
recall outside hot nodes are searched exactly instead: a similar set holds one of any n - ceil(0.8 n) + 1 of their n members, of which the
rarest are looked up in an index of members.  Sets of up to 3 members can only repeat equal sets, and don't enter the forest.

The order of arrival (batch_no, then file_index) decides which file is accepted: a file is turned down if an earlier accepted one
repeats it; what the history holds is earlier than any batch.  Within a batch that is settled by rounds over the states of keys
(at most one file of a class or group is ever accepted), with as many rounds as the longest chain of undecided repeats.

Members are 64-bit hashes of checksums: two unlike members of a pair that is compared are taken for equal with a chance of 2**-64.
A set travels as one row of 8 bytes a member, as all chunk lists of a file do.

Defined results: rows with a null file_index or batch_no belong to no file and are left out; each
(file, chunk_seq) counts once, at its largest size, rows with a null chunk_seq once for each checksum; null sizes are 0;
files of total size 0 or without checksums take part by place and size alone, files without a path
by checksums alone; further columns are ignored; an empty batch repeats nothing.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, LongType

from ..functions.paths import place
from ..session import counted, forget, materialize, shared_path

SIMILARITY = (4, 5)
TREES = 12
DEPTH = 4
RECALL = 0.99999
#: Sets below one node, from which on the search doesn't enter it.
HOT_RANGE = 200
#: A batch's keys are broadcast to the history up to so many rows (of some 60 bytes each).
MAX_LOOKUP = 500_000
#: Rows of a segment, on average, and the largest number of leading bits that tell segments apart.
SEGMENT_ROWS = 1 << 19
MAX_BITS = 16
#: A batch with more keys than this reads all segments.
MAX_PRUNED = 10_000
MAX_RUNS = 4
#: A backfill checks so many batches at once, and each time after that up to so many times what lies before.
FIRST_BATCHES = 128
GROWTH = 4
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paths_of(tokens: pa.Array) -> np.ndarray:
    """Nodes of each set (a list array without empty or null lists): TREES x DEPTH 64-bit numbers a row, tree by tree."""
    flat = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    first = tokens.offsets.to_numpy()[:-1].astype(np.int64) - tokens.offsets[0].as_py()
    out = np.empty((len(tokens), TREES * DEPTH), np.int64)
    if not len(tokens):
        return out
    with np.errstate(over="ignore"):
        for tree in range(TREES):
            node = np.full(len(tokens), tree + 1, np.uint64)
            for d in range(DEPTH):
                least = np.minimum.reduceat(_mix(flat + np.uint64(tree * DEPTH + d + 1) * _GOLD), first)
                node = _mix((node * _GOLD) ^ least)
                out[:, tree * DEPTH + d] = node.view(np.int64)
    return out


@F.arrow_udf(ArrayType(LongType()))
def nodes(tokens: pa.Array) -> pa.Array:
    own = paths_of(tokens)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, TREES * DEPTH), pa.int32()), pa.array(own.ravel()))


def widened(hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(depth in each tree, 0 for none; whether the recall is reached) for rows of TREES x DEPTH flags of nodes not to enter."""
    s = SIMILARITY[0] / SIMILARITY[1]
    best, done = np.zeros(hot.shape[:2], np.int8), np.zeros(len(hot), bool)
    for level in range(DEPTH, 0, -1):
        depth = np.zeros(hot.shape[:2], np.int8)
        for d in range(DEPTH, level - 1, -1):
            depth = np.where(hot[:, :, d - 1], depth, d)
        best = np.where(done[:, None], best, depth)
        done |= np.where(depth > 0, 1 - s**depth, 1.0).prod(axis=1) <= 1 - RECALL
    return best, done


@F.arrow_udf(ArrayType(ByteType()))
def _plan(hot: pa.Array) -> pa.Array:
    """Depth in each tree, then 1 where the recall is reached, from the positions of hot nodes."""
    flags = np.zeros((len(hot), TREES * DEPTH), bool)
    for i, own in enumerate(hot.to_pylist()):
        flags[i, own or []] = True
    depth, done = widened(flags.reshape(-1, TREES, DEPTH))
    own = np.column_stack([depth, done]).astype(np.int8)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, TREES + 1), pa.int32()), pa.array(own.ravel()))


def search_depth() -> int:
    """The depth of a set without hot nodes."""
    return int(widened(np.zeros((1, TREES, DEPTH), bool))[0][0, 0])


def files(chunks: DataFrame) -> DataFrame:
    """(file_id, batch_no, n, size, cls, spot, tokens): one row for each file; tokens where it has more than 3.

    Rows are reduced by (file, chunk, checksum) before a file's own distinct checksums meet in its row.
    """
    own = chunks.where("file_index is not null and batch_no is not null")
    nth = F.when(F.col("chunk_seq").isNull(), F.xxhash64("checksum"))
    once = (
        own.select(F.col("file_index").cast("bigint").alias("file_id"), F.col("batch_no").cast("int").alias("batch_no"), "chunk_seq", nth.alias("nth"), F.when(F.col("checksum").isNotNull(), F.xxhash64("checksum")).alias("token"), F.coalesce(F.col("uncompressed_size").cast("bigint"), F.lit(0)).alias("size"), "relative_path")
        .groupBy("file_id", "batch_no", "chunk_seq", "nth", "token", "relative_path").agg(F.max("size").alias("size"))
    )
    part = F.struct("chunk_seq", "nth", "size")
    rows = once.groupBy("file_id", "batch_no").agg(F.sort_array(F.collect_set("token")).alias("tokens"), F.array_sort(F.collect_list(part)).alias("parts"), F.min("relative_path").alias("path"))
    # Of the rows of one chunk the last, and largest, counts.
    last = lambda p, i: ~F.coalesce(F.get("parts", i + 1)["chunk_seq"].eqNullSafe(p["chunk_seq"]) & F.get("parts", i + 1)["nth"].eqNullSafe(p["nth"]) & F.get("parts", i + 1).isNotNull(), F.lit(False))
    size = F.aggregate(F.filter("parts", last), F.lit(0).cast("bigint"), lambda a, p: a + p["size"])
    sized = rows.select("file_id", "batch_no", "tokens", F.size("tokens").alias("n"), size.alias("size"), place("path").alias("place"))
    digest = lambda c: F.unhex(F.md5(c.cast("binary")))
    usable = (F.col("n") > 0) & (F.col("size") > 0)
    return sized.select(
        "file_id", "batch_no", "n", "size",
        F.when(usable, digest(F.array_join(F.col("tokens").cast("array<string>"), ","))).alias("cls"),
        F.when(F.col("place").isNotNull(), digest(F.concat_ws("|", F.col("size").cast("string"), "place"))).alias("spot"),
        F.when(usable & (F.col("n") > 3), F.col("tokens")).alias("tokens"),
    )


def sets_of(new: DataFrame) -> DataFrame:
    """(cid, cls, n, tokens, nodes): each class of more than 3 members once."""
    one = new.where("tokens is not null").select("cls", "n", "tokens").dropDuplicates(["cls"])
    return one.select(F.xxhash64("cls").alias("cid"), "cls", "n", "tokens", nodes("tokens").alias("nodes"))


def _close_in_size(a: Column, b: Column) -> Column:
    num, den = SIMILARITY
    return (a * den >= b * num) & (b * den >= a * num)


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_LOOKUP else df


def _own(key: str) -> Column:
    """The key, or one of the file's own where it is null: rows without a key spread over all tasks and meet nothing."""
    return F.coalesce(F.col(key), F.concat(F.lit("-"), F.col("file_id").cast("string")).cast("binary"))


def _with(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """df left joined with found on a key that many rows of df may lack."""
    return df.withColumn("__k", _own(key)).join(found.withColumnRenamed(key, "__k"), "__k", "left").drop("__k")


def _below(sets: DataFrame) -> DataFrame:
    """(cid, n, pos, key): every node of each set; pos is tree * DEPTH + depth - 1."""
    return sets.select("cid", "n", F.posexplode("nodes").alias("pos", "key"))


def _member_key(token: str = "token") -> Column:
    return F.xxhash64(F.lit("member"), token)


def _crowded(sets: DataFrame, least: int, among: DataFrame | None = None) -> DataFrame:
    """(key, sets) of members and nodes with more than least sets; among: keys that alone may be so.

    A node has no more sets below it than hold the member it was made of, so only sets with a crowded member have their nodes counted.
    """
    flat = sets.select("nodes", F.explode("tokens").alias("token")).select(_member_key().alias("key"), "nodes")
    more = lambda df: df.groupBy("key").agg(F.count("*").alias("sets")).where(F.col("sets") > least)
    if among is not None:
        nodes = sets.select(F.explode("nodes").alias("key"))
        return more(flat.select("key").unionByName(nodes).join(among, "key", "left_semi"))
    members = materialize(more(flat.select("key")), "crowded-members")
    nodes = flat.join(members.select("key"), "key", "left_semi").select("nodes").distinct().select(F.explode("nodes").alias("key"))
    return members.unionByName(more(nodes))


def _rows(sets: DataFrame) -> DataFrame:
    """(k0.., cid, n): one row for each set and tree, its path."""
    path = F.slice("nodes", F.col("tree") * DEPTH + 1, F.lit(DEPTH))
    rows = sets.select("cid", "n", "nodes", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("cid", "n", path.alias("p"))
    return rows.select(*(F.col("p")[d].alias(f"k{d}") for d in range(DEPTH)), "cid", "n")


def _members(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("tokens").alias("token"), "cid", "n")


def _settle(busy: DataFrame, edges: DataFrame) -> DataFrame:
    """busy (file_id, batch_no, cls, spot, ..., state 0) with state 1 accepted or 2 repeating, by rounds over the states of keys."""
    order = F.struct("batch_no", "file_id")
    keep = busy.columns
    old = None
    while True:
        agg = [F.min(F.when(F.col("state") == s, order)).alias(c) for s, c in ((1, "acc"), (0, "und"))]
        c = busy.where("cls is not null").groupBy("cls").agg(*agg)
        s = busy.where("spot is not null").groupBy("spot").agg(*agg).withColumnsRenamed({"acc": "s_acc", "und": "s_und"})
        near = edges.join(c, edges.cls_b == c.cls).groupBy("cls_a").agg(F.min("acc").alias("n_acc"), F.min("und").alias("n_und")).withColumnRenamed("cls_a", "cls")
        seen = _with(_with(busy, c.withColumnsRenamed({"acc": "c_acc", "und": "c_und"}).join(near, "cls", "left"), "cls"), s, "spot")
        acc, und = F.least("c_acc", "n_acc", "s_acc"), F.least("c_und", "n_und", "s_und")
        undecided = F.col("state") == 0
        step = F.when(undecided & F.coalesce(acc < order, F.lit(False)), 2).when(undecided & (und >= order), 1).otherwise(F.col("state"))
        busy, left = counted(seen.withColumn("state", step).select(*keep), "states", F.col("state") == 0)
        if old is not None:
            forget(old)
        old = busy
        if not left:
            return busy


class History:
    """Everything accepted so far, in a folder, as sorted runs:

    keys (k, key, file_id, batch_no, tokens) of classes and of places, forest (k0.., cid, n), members (token, cid, n), and
    crowded (key, sets).  A history opened on a folder that has runs goes on from them.

    check(batch) compares a batch with it and within itself; accept=True adds what is new as one more run.  A batch may be one ingest or
    many.  Chunks of the history are never read again.
    """

    BY = {"keys": "k", "forest": "k0", "members": "token"}

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "history")
        self.runs = self._recorded()

    def _files(self) -> tuple:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs")
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root, jvm.org.apache.hadoop.fs.Path

    def _recorded(self) -> list[dict]:
        """The runs that the newest record in the folder names; a run that was cut off is in none."""
        fs, root, path = self._files()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        done = [int(n) for n in names if n.isdigit()]
        if not done:
            return []
        with_ = fs.open(path(root, str(max(done))))
        try:
            return json.loads(bytes(with_.readAllBytes()))
        finally:
            with_.close()

    def _record(self, runs: list[dict]) -> None:
        """Written beside its place and moved there, so that a record is there whole or not at all."""
        fs, root, path = self._files()
        name = str(max(r["run"] for r in runs))
        out = fs.create(path(root, f"_{name}"), True)
        out.write(json.dumps(runs).encode())
        out.close()
        fs.rename(path(root, f"_{name}"), path(root, name))
        self.runs = runs

    @staticmethod
    def _bits(rows: int) -> int:
        return min(MAX_BITS, max(0, int(rows // SEGMENT_ROWS).bit_length()))

    def _put(self, df: DataFrame, table: str, run: int, rows: int) -> None:
        """Write a run of a table in the order of its key, in segments by the key's leading bits."""
        by, bits = self.BY[table], self._bits(rows)
        order = [by, *(c for c in df.columns if c.startswith("k") and c[1:].isdigit() and c != by)]
        seg = F.shiftrightunsigned(by, 64 - bits) if bits else F.lit(0).cast("bigint")
        spread = df.withColumn("seg", seg)
        spread = spread.repartitionByRange("seg", by) if bits else spread.coalesce(1)
        spread.sortWithinPartitions("seg", *order).write.mode("overwrite").partitionBy("seg").parquet(f"{self.path}/{table}/run={run}")

    def _all(self, table: str, runs: list[dict] | None = None) -> DataFrame:
        kinds = {
            "keys": "k bigint, key binary, file_id bigint, batch_no int, tokens array<bigint>", "members": "token bigint, cid bigint, n int",
            "forest": ", ".join(f"k{d} bigint" for d in range(DEPTH)) + ", cid bigint, n int", "crowded": "key bigint, sets bigint",
        }
        seg = ", seg bigint" if table in self.BY else ""
        parts = [self.spark.read.schema(kinds[table] + seg).parquet(f"{self.path}/{table}/run={r['run']}") for r in (self.runs if runs is None else runs)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _near(self, table: str, wanted: DataFrame, key: str, rows: int) -> DataFrame:
        """The table's rows in the segments that the wanted keys (column key of rows rows) lie in."""
        most = max(self._bits(r[table]) for r in self.runs)
        if not most or rows > MAX_PRUNED:
            return self._all(table)
        asked = {r[0] for r in wanted.select(F.shiftrightunsigned(key, 64 - most)).distinct().collect()}  # at most MAX_PRUNED numbers
        out = None
        for r in self.runs:
            own = self._all(table, [r])
            if bits := self._bits(r[table]):
                own = own.where(F.col("seg").isin(*{s >> (most - bits) for s in asked}) if asked else F.lit(False))
            out = own if out is None else out.unionByName(own)
        return out

    def _find(self, wanted: DataFrame, name: str) -> DataFrame:
        """Rows of keys with a wanted k."""
        wanted, rows = counted(wanted, name)
        return self._near("keys", wanted, "k", rows).join(_few(wanted, rows), "k", "left_semi")

    def check(self, chunks: DataFrame, accept: bool = False) -> DataFrame:
        """(file_a, file_b): each file of the batch that repeats an accepted one, with every accepted file it repeats, the smaller id first."""
        return self.check_files(materialize(files(chunks), "files"), accept)

    def candidates(self, sets: DataFrame) -> DataFrame:
        """(a, b, old): pairs of sets (by cid) to verify; a is of sets, b of sets or, where old is true, of the history."""
        base, below = search_depth(), _below(sets)
        crowd, rows = counted(_crowded(sets, HOT_RANGE // 8), "crowded")
        self.crowd = _few(crowd.select("key"), rows)
        if self.runs:
            crowd = crowd.unionByName(self._all("crowded")).groupBy("key").agg(F.sum("sets").alias("sets"))
        hot, hots = counted(crowd.where(F.col("sets") > HOT_RANGE), "hot")
        depths = [base]
        if not hots:
            targets = probes = below.where(F.col("pos") % DEPTH == base - 1).select("cid", "n", "key")
            hards = 0
        else:
            depths = list(range(1, DEPTH + 1))
            met = _few(hot.select("key"), hots)
            flagged = below.join(met, "key", "left_semi").groupBy("cid").agg(F.collect_set("pos").alias("hot"))
            planned, hards = counted(sets.join(flagged, "cid").select("cid", "n", "tokens", "nodes", _plan("hot").alias("plan")), "planned", F.col("plan")[TREES] == 0)
            at = planned.select("cid", "n", "nodes", F.posexplode(F.slice("plan", 1, TREES)).alias("tree", "depth")).where("depth > 0")
            free = below.join(planned.select("cid"), "cid", "left_anti").where(F.col("pos") % DEPTH == base - 1)
            probes = free.select("cid", "n", "key").unionByName(at.select("cid", "n", F.element_at("nodes", F.col("tree") * DEPTH + F.col("depth").cast("int")).alias("key")))
            targets = below.join(met, "key", "left_anti").select("cid", "n", "key")
            hard = planned.where(F.col("plan")[TREES] == 0)
        probes, rows = counted(probes, "probes")
        own = lambda p, t, key: p.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), key).join(t.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), key), key).where((F.col("a") != F.col("b")) & _close_in_size(F.col("n_a"), F.col("n_b")))
        twice = own(probes, probes if not hots else targets, "key").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(False).alias("old"))
        found = twice if hots else twice.where("a < b")
        old = lambda p, t, key: own(p, t, key).select("a", "b", F.lit(True).alias("old"))
        if self.runs:
            # A path lies in the segment of its first node, whatever the depth that is searched.
            roots = below.where(F.col("pos") % DEPTH == 0).select("key")
            near = self._near("forest", roots, "key", rows)
            flat = near.select("cid", "n", F.explode(F.array(*(f"k{d - 1}" for d in depths))).alias("key"))
            found = found.unionByName(old(_few(probes, rows), flat, "key"))
        if hards:
            num, den = SIMILARITY
            width = F.col("n") - F.ceil(F.col("n") * F.lit(num) / F.lit(den)).cast("int") + 1
            common = hot.select("key", "sets")
            ranked = hard.select("cid", "n", F.explode("tokens").alias("token")).withColumn("key", _member_key()).join(_few(common, hots), "key", "left")
            first = ranked.groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("sets", F.lit(0)).alias("sets"), "token"))).alias("t")).select("cid", "n", F.explode(F.slice("t", F.lit(1), width)).alias("m"))
            rare, rows = counted(first.select("cid", "n", F.col("m.token").alias("token")), "rare")
            found = found.unionByName(own(_few(rare, rows), _members(sets), "token").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(False).alias("old")))
            if self.runs:
                found = found.unionByName(old(_few(rare, rows), self._near("members", rare, "token", rows), "token"))
        return found.distinct()

    def similar(self, sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Verified pairs: (cls_a, cls_b) within sets, both ways, and (cls, file_id, batch_no) with accepted files."""
        num, den = SIMILARITY
        found = materialize(self.candidates(sets), "candidates")
        own = sets.select("cid", "cls", "tokens")
        side = lambda df, s: df.select(F.col("cid").alias(s), F.col("cls").alias(f"cls_{s}"), F.col("tokens").alias(f"t_{s}"))
        common = F.size(F.array_intersect("t_a", "t_b"))
        alike = common * den >= (F.size("t_a") + F.size("t_b") - common) * num
        one = found.where("not old").join(side(own, "a"), "a").join(side(own, "b"), "b").where(alike)
        edges = one.select(F.explode(F.array(F.struct("cls_a", "cls_b"), F.struct(F.col("cls_b").alias("cls_a"), F.col("cls_a").alias("cls_b")))).alias("e")).select("e.*")
        edges = materialize(edges, "edges")
        if not self.runs:
            return edges, None
        held = self._find(found.where("old").select(F.col("b").alias("k")).distinct(), "asked").where("tokens is not null").select(F.col("k").alias("b"), F.col("tokens").alias("t_b"), "file_id", "batch_no")
        to_old = found.where("old").join(side(own, "a"), "a").join(held, "b").where(alike)
        return edges, materialize(to_old.select(F.col("cls_a").alias("cls"), "file_id", "batch_no"), "edges")

    def check_files(self, new: DataFrame, accept: bool = False) -> DataFrame:
        """check, of files(chunks), which must be written already."""
        order = ["file_id", "batch_no"]
        keys = new.select(F.explode(F.array("cls", "spot")).alias("key")).where("key is not null")
        past, sets = None, new
        if self.runs:
            asked = keys.select(F.xxhash64("key").alias("k")).distinct()
            known, rows = counted(self._find(asked, "asked").select("key", F.col("file_id").alias("a")), "known")
            known = _few(known, rows)
            by = lambda key: new.select(*order, F.col(key).alias("key")).join(known, "key")
            past = by("cls").unionByName(by("spot")).select(*order, "a")
            sets = new.where("tokens is not null").join(known.select(F.col("key").alias("cls")), "cls", "left_anti")
        sets = materialize(sets_of(sets), "sets")
        edges, to_old = self.similar(sets)
        # A file that shares no key within the batch and has no similar set there is decided at once and takes no part in the rounds.
        shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key").union(edges.select("cls_a")).distinct()
        shared, rows = counted(shared, "shared")
        on = lambda c: _few(shared.select(F.col("key").alias(c), F.lit(True).alias(f"{c}_on")), rows)
        marked = _with(_with(new.select(*order, "cls", "spot", "n", F.col("tokens").isNotNull().alias("big")), on("cls"), "cls"), on("spot"), "spot")
        gone = F.lit(False)
        if past is not None:
            near = new.select(*order, "cls").where("cls is not null").join(to_old.select("cls", F.col("file_id").alias("a")), "cls").select(*order, "a")
            past, rows = counted(past.unionByName(near).distinct(), "past")
            marked = marked.join(_few(past.select(*order).distinct().withColumn("past", F.lit(True)), rows), order, "left")
            gone = F.col("past").isNotNull()
        linked = F.col("cls_on").isNotNull() | F.col("spot_on").isNotNull()
        first = marked.select(*order, "cls", "spot", "n", "big", linked.alias("linked"), F.when(gone, 2).when(linked, 0).otherwise(1).alias("state"))
        first, open_ = counted(first, "states", F.col("state") == 0)
        states = first.where("linked and state = 0")
        if open_:
            states = _settle(states, edges)
        found = self._repeats(states.unionByName(first.where("linked and state = 2")), edges)
        if past is not None:
            found = found.unionByName(past.select(F.least("file_id", "a").alias("file_a"), F.greatest("file_id", "a").alias("file_b"))).distinct()
        if accept:
            found = materialize(found, "repeats")
            self._add(first.where("state = 1").unionByName(states.where("state = 1")), sets)
        return found

    @staticmethod
    def _repeats(states: DataFrame, edges: DataFrame) -> DataFrame:
        """(file_a, file_b): files of the batch with the accepted ones of the same batch that they repeat."""
        f = states.where("state = 2").select(F.col("file_id").alias("f"), F.struct("batch_no", "file_id").alias("f_at"), "cls", "spot")
        a = states.where("state = 1").select(F.col("file_id").alias("a"), F.struct("batch_no", "file_id").alias("a_at"), "cls", "spot")
        same = f.drop("spot").join(a.drop("spot"), "cls")
        spot = f.drop("cls").join(a.drop("cls"), "spot")
        near = f.select("f", "f_at", F.col("cls").alias("cls_a")).join(edges, "cls_a").join(a.select("a", "a_at", F.col("cls").alias("cls_b")), "cls_b")
        pairs = [p.where("a_at < f_at").select("f", "a") for p in (same, spot, near)]
        return pairs[0].union(pairs[1]).union(pairs[2]).select(F.least("f", "a").alias("file_a"), F.greatest("f", "a").alias("file_b")).distinct()

    def _add(self, taken: DataFrame, sets: DataFrame) -> None:
        run = max((r["run"] for r in self.runs), default=-1) + 1
        size = taken.agg(F.count("cls").alias("c"), F.count("spot").alias("s"), F.count_if("big").alias("b"), F.coalesce(F.sum(F.when(F.col("big"), F.col("n"))), F.lit(0)).alias("m")).first()
        # The accepted sets, each with the one accepted file that has it.
        fresh = materialize(sets.join(taken.where("big").select("cls", "file_id", "batch_no"), "cls"), "fresh")
        key = lambda df, c, tokens: df.where(f"{c} is not null").select(F.xxhash64(c).alias("k"), F.col(c).alias("key"), "file_id", "batch_no", tokens.alias("tokens"))
        none = F.lit(None).cast("array<bigint>")
        own = key(fresh, "cls", F.col("tokens")).unionByName(key(taken.where("not big"), "cls", none)).unionByName(key(taken, "spot", none))
        record = {"run": run, "keys": size["c"] + size["s"], "forest": size["b"] * TREES, "members": size["m"]}
        self._put(own, "keys", run, record["keys"])
        self._put(_rows(fresh), "forest", run, record["forest"])
        self._put(_members(fresh), "members", run, record["members"])
        _crowded(fresh, HOT_RANGE // 8, self.crowd).write.mode("overwrite").parquet(f"{self.path}/crowded/run={run}")
        self._record([*self.runs, record])
        if len(self.runs) > MAX_RUNS:
            total, first = record["keys"], len(self.runs) - 1
            while first and self.runs[first - 1]["keys"] <= total:
                first -= 1
                total += self.runs[first]["keys"]
            self.merge(self.runs[first:])

    def merge(self, runs: list[dict] | None = None) -> None:
        """Rewrite some of the runs, by default all, as one in the order of their keys."""
        runs = self.runs if runs is None else runs
        if len(runs) < 2:
            return
        run = max(r["run"] for r in self.runs) + 1
        record = {"run": run, **{t: sum(r[t] for r in runs) for t in self.BY}}
        for table in self.BY:
            self._put(self._all(table, runs).drop("seg"), table, run, record[table])
        # Counted anew: a key may have stayed under the threshold in every run.
        forest, least = self._all("forest", [record]), HOT_RANGE // 8
        more = lambda keys: keys.groupBy("key").agg(F.count("*").alias("sets")).where(F.col("sets") > least)
        roots = materialize(more(forest.select(F.col("k0").alias("key"))), "roots")
        below = forest.join(roots.select(F.col("key").alias("k0")), "k0", "left_semi").select(F.explode(F.array(*(f"k{d}" for d in range(1, DEPTH)))).alias("key"))
        crowded = more(self._all("members", [record]).select(_member_key().alias("key"))).unionByName(roots).unionByName(more(below))
        crowded.write.mode("overwrite").parquet(f"{self.path}/crowded/run={run}")
        self._record([*(r for r in self.runs if r not in runs), record])


def repeats(chunks: DataFrame, first: int = FIRST_BATCHES) -> DataFrame:
    """(file_a, file_b) of a whole table, as a backfill: its batches in order, against the history of those before.

    A Spark job for one batch of some hundred chunks costs as much as one for many, so the first check takes first batch
    numbers together, and each further one GROWTH - 1 times as many as lie before it: a check's history is never much smaller than
    the batches it takes, so reading the history costs no more than these do, and there are about log(batches) checks.
    The result doesn't depend on either number.
    """
    spark = chunks.sparkSession
    # Which check a batch belongs to: 0 up to first, then growing.
    ahead = chunks.agg(F.min("batch_no").alias("lo"), F.max("batch_no").alias("hi")).first()
    if ahead["lo"] is None:
        return spark.createDataFrame([], "file_a bigint, file_b bigint")
    ends = [first]
    while ends[-1] <= ahead["hi"] - ahead["lo"]:
        ends.append(ends[-1] * GROWTH)
    at = F.col("batch_no") - ahead["lo"]
    step = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        step = F.when(at < ends[i], i).otherwise(step)
    path = shared_path(spark, "prepared")
    files(chunks).withColumn("step", step).write.option("compression", "zstd").partitionBy("step").parquet(path)
    all_ = spark.read.parquet(path)
    own, out = History(spark), None
    for i in range(len(ends)):
        part = own.check_files(all_.where(F.col("step") == i).drop("step"), accept=True)
        out = part if out is None else out.unionByName(part)
    return out
