"""References to keys that don't exist when they are made (problem 3).

A split-block Bloom filter of all parent keys is built by bitwise-or aggregates and
broadcast as a table of blocks: a reference whose bits are not all set is a definite
orphan and leaves the plan there.  Only filter-positive references are joined exactly,
against the periods in which their key was alive.  The filter is broadcast only while
its size, known from the number of keys, stays under a limit; beyond it references and blocks
meet by a shuffle on the block, of some 2 bytes a key, and all else is the same.

A period of a key runs from an upload to the first removal at or after it.  Uploads are
reduced to one row for each key and end of period before anything is joined, so a package
with most of the uploads costs no more than one with few.

Defined results: parents with a null name are no parents; a null version names no version,
such a parent serves references to its name alone; references with a null time or null id
source rows are judged like others, a null time holds nowhere; null and empty
requires_dist give no reference; equal rows give equal results, one row for each
source row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import counted

#: Keys per block of 4 x 64 bits; about 0.3 % of absent keys pass.
KEYS_PER_BLOCK = 16
#: Largest filter to broadcast, counted at 128 bytes a block in an executor.
MAX_FILTER_BYTES = 64 << 20
REQUIREMENT = r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[[^\]]*\])?\s*(.*)$"
FAR = "9999-12-31 00:00:00"


def normal_name(name: Column) -> Column:
    """Names that differ only in letter case and in runs of '-', '_', '.' become equal."""
    return F.regexp_replace(F.lower(name), r"[-_.]+", "-")


def key_of(name: Column, version: Column) -> Column:
    """Key of a release, or of the name alone where version is null."""
    return F.when(version.isNull(), name).otherwise(F.concat(name, F.lit("=="), version))


def requirement(entry: Column) -> tuple[Column, Column]:
    """(normal name or null, pinned version or null) of a requirement line.

    Markers (after ';') and locations (after '@') never pin; a line pins a version if its
    bounds hold one single == or === without wildcard.
    """
    spec = F.trim(F.split(entry, ";", 2)[0])
    name = F.regexp_extract(spec, REQUIREMENT, 1)
    rest = F.regexp_extract(spec, REQUIREMENT, 2)
    bounds = F.when(rest.startswith("@"), F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(rest, r"[()\s]", ""), ","))
    pins = F.array_distinct(
        F.transform(F.filter(bounds, lambda b: b.rlike(r"^={2,3}[^=*]+$")), lambda b: F.regexp_replace(b, "^=+", ""))
    )
    known = name != ""
    return F.when(known, normal_name(name)), F.when(known & (F.size(pins) == 1), pins[0])


def extension_references(ext: DataFrame) -> DataFrame:
    entries = ext.select("ext_id", "extracted_at", F.posexplode("requires_dist").alias("ref_no", "entry"))
    name, version = requirement(F.col("entry"))
    return entries.select(F.lit("extension_row").alias("src_table"), F.col("ext_id").alias("src_id"), "ref_no", name.alias("name"), version.alias("version"), F.col("extracted_at").alias("at")).where("name is not null")


def edge_references(edges: DataFrame) -> DataFrame:
    """Both ends of each edge; a version that is empty or a placeholder ('$...') pins nothing."""
    ends = edges.select("edge_id", "resolved_at", F.posexplode(F.array("parent", "child")).alias("ref_no", "coord"))
    parts = F.split("coord", ":", 3)
    name, version = F.trim(F.get(parts, F.lit(1))), F.trim(F.get(parts, F.lit(2)))
    pinned = F.when((version != "") & ~version.contains("${") & ~version.startswith("$"), version)
    return ends.select(F.lit("dependency_edge").alias("src_table"), F.col("edge_id").alias("src_id"), "ref_no", normal_name(name).alias("name"), pinned.alias("version"), F.col("resolved_at").alias("at")).where("name <> ''")


def alive_periods(ext: DataFrame, removed: DataFrame) -> DataFrame:
    """(key, since, until): times in which a key of a release, or of a name, holds; until is exclusive."""
    uploads = ext.select(normal_name(F.col("name")).alias("name"), "version", F.col("extracted_at").alias("at")).where("name is not null and at is not null").groupBy("name", "version", "at").agg(F.lit(1).alias("one"))
    times = removed.select(normal_name(F.col("name")).alias("name"), "version", F.col("removed_at").alias("gone")).where("name is not null and gone is not null")
    own = times.where("version is not null").groupBy("name", "version").agg(F.collect_set("gone").alias("own"))
    every = times.where("version is null").groupBy("name").agg(F.collect_set("gone").alias("every"))
    first = lambda c: F.array_min(F.filter(c, lambda t: t >= F.col("at")))
    ends = uploads.join(own, ["name", "version"], "left").join(every, "name", "left").select("name", "version", "at", F.least(first("own"), first("every")).alias("until"))
    until = F.coalesce("until", F.lit(FAR).cast("timestamp"))
    release = ends.groupBy("name", "version", until.alias("until")).agg(F.min("at").alias("since")).where("since < until")
    of_name = release.groupBy("name", "until").agg(F.min("since").alias("since")).select(F.col("name").alias("key"), "since", "until")
    of_release = release.where("version is not null").select(key_of(F.col("name"), F.col("version")).alias("key"), "since", "until")
    return of_release.unionByName(of_name)


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(key)
    g = F.xxhash64(key, F.lit(1))
    return F.pmod(h, F.lit(blocks)).alias("block"), [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3): a split-block Bloom filter of column key as a table."""
    block, bits = _bits(F.col("key"), blocks)
    return keys.select(block, *(b.alias(f"b{i}") for i, b in enumerate(bits))).groupBy("block").agg(*(F.bit_or(f"b{i}").alias(f"w{i}") for i in range(4)))


def with_filter(refs: DataFrame, filter_blocks: DataFrame, blocks: int, small: bool = True) -> DataFrame:
    """refs with column maybe: false proves that no parent has the key.  small: whether the filter may be broadcast."""
    block, bits = _bits(F.col("key"), blocks)
    own = refs.withColumn("block", block)
    hit = F.lit(True)
    for i, b in enumerate(bits):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) != 0)
    return own.join(F.broadcast(filter_blocks) if small else filter_blocks, "block", "left").withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("block", "w0", "w1", "w2", "w3")


def orphans(ext: DataFrame, edges: DataFrame, removed: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(src_table, src_id, ref_no, at, reason) of each reference that doesn't hold when made.

    reason is 'unknown' if nothing was ever alive under the key, else 'not alive'; exact, whatever the filter's size.
    """
    refs = extension_references(ext).unionByName(edge_references(edges)).select("src_table", "src_id", "ref_no", "at", key_of(F.col("name"), F.col("version")).alias("key"))
    alive, n = counted(alive_periods(ext, removed), "alive-periods")
    blocks = max(1, n // KEYS_PER_BLOCK)
    cols = ["src_table", "src_id", "ref_no", "at"]
    known = alive.select("key").distinct().withColumn("known", F.lit(True))
    probed = with_filter(refs, bloom_blocks(alive, blocks), blocks, blocks * 128 <= max_filter_bytes)
    surely = probed.where("not maybe").select(*cols, F.lit("unknown").alias("reason"))
    fallen = probed.where("maybe").alias("r").join(
        alive.alias("p"), (F.col("r.key") == F.col("p.key")) & (F.col("r.at") >= F.col("p.since")) & (F.col("r.at") < F.col("p.until")), "left_anti"
    )
    told = fallen.join(known, "key", "left").select(*cols, F.when(F.col("known"), F.lit("not alive")).otherwise(F.lit("unknown")).alias("reason"))
    return surely.unionByName(told)


def report(found: DataFrame) -> DataFrame:
    """Orphan references per table and month (null for references without a time)."""
    return found.groupBy("src_table", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("orphans"), F.count_if(F.col("reason") == "unknown").alias("unknown"))
