"""Per-key results where a few keys hold most rows (problem 4).

Distributed exact selection.  Quantiles of a key are found without sorting or gathering
its values: every round counts, for each key and wanted rank, how many values fall into
each of BINS equal bins of the range still open, keeps the bin that holds the rank
and continues inside it until it is a single value.  Counts, sums and bounds are
mergeable, so each task sends at most BINS numbers for each key and rank, whatever the
number of rows, and a hot key is spread over as many tasks as its rows.  A range of
2**63 integers closes in 8 rounds, one of 2**24 in 3.

Heavy keys are selected the same way, without a sum for every key: rows are ordered by a hash of their key and weighted, and a key
with 1/25 of the whole weight or more takes up one of the ranks 1/25, 2/25, ... of the whole.  So the values at these 25 ranks
name all keys that can be heavy, and exact sums of these few decide.

Defined results: a null package type counts as 0 and a null repository as '' (both mean
untyped); null values take part in rows but neither in sums nor in quantiles, a key with null values
only has null quantiles; the quantile q is the value of rank ceil(q * n), the lowest for q
= 0, so ties need no rule; an empty table gives no keys; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import forget, materialize

KEY = ["pkg_type", "repo"]
BINS = 256
#: Open ranges of up to so many keys are broadcast.
MAX_KEYS = 50_000
#: Beyond that, keys with 1/HEAVY_PART of all values or more are: there are at most HEAVY_PART of them.
HEAVY_PART = 1000
QUANTILES = (0.5, 0.9, 0.99)


def typed_key(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.col("pkg_type"), F.lit(0)).cast("int").alias("pkg_type"), F.coalesce(F.col("repo"), F.lit("")).alias("repo")]


def entries(manifest: DataFrame) -> DataFrame:
    """Each entry (batch_no, pkg_type, repo, part_no) once: rows written again count once, at their largest row_count."""
    return manifest.select("batch_no", *typed_key(manifest), "part_no", F.col("row_count").cast("bigint").alias("row_count"), F.col("index_len").cast("bigint").alias("index_len")).groupBy("batch_no", *KEY, "part_no").agg(F.max("row_count").alias("row_count"), F.max("index_len").alias("index_len"))


def chunks(index: DataFrame) -> DataFrame:
    """Each chunk (batch_no, file_index, chunk_seq) once."""
    return index.select(*typed_key(index), "batch_no", "file_index", "chunk_seq", F.col("uncompressed_size").cast("bigint").alias("uncompressed_size")).groupBy(*KEY, "batch_no", "file_index", "chunk_seq").agg(F.max("uncompressed_size").alias("uncompressed_size"))


def totals(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Round 0: rows, non-null values (or their weight), sum and bounds of each key; all of them mergeable."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), (F.sum(F.when(F.col(value).isNotNull(), F.col(weight))) if weight else F.count(value)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def _meet(values: DataFrame, spans: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """values with their key's open ranges, without shuffling the values of a heavy key."""
    if spans.count() <= MAX_KEYS:
        return values.join(F.broadcast(spans), keys)
    whole = base.agg(F.sum("n")).first()[0]
    heavy = materialize(base.where(F.col("n") * HEAVY_PART >= whole).select(*keys), "heavy")
    big, rest = F.broadcast(spans.join(F.broadcast(heavy), keys, "left_semi")), spans.join(F.broadcast(heavy), keys, "left_anti")
    return values.join(big, keys).unionByName(values.join(F.broadcast(heavy), keys, "left_anti").join(rest, keys))


def select_ranks(df: DataFrame, keys: list[str], value: str, base: DataFrame, quantiles: tuple[float, ...] = QUANTILES, bins: int = BINS, weight: str | None = None, parts: int | None = None) -> DataFrame:
    """(keys..., q, result): exact quantiles of integer values by refining histograms.

    base holds n, lo and hi of each key.  All state is one row for each key and quantile.  weight: a column of integers from 0 on, so
    often a row counts; parts: the quantiles are 1/parts, 2/parts, ..., 1, their ranks found in integers.
    """
    dec = "decimal(38,0)"
    if parts:
        quantiles = tuple(float(k) for k in range(1, parts + 1))
        rank = F.ceil(F.col("q").cast("int").cast(dec) * F.col("n").cast(dec) / F.lit(parts)).cast("bigint")
    else:
        rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).cast("bigint")
    open_ = base.where("n > 0").select(*keys, "n", "lo", "hi", F.explode(F.array(*(F.lit(float(q)) for q in quantiles))).alias("q")).select(*keys, "q", rank.alias("rank"), "lo", "hi")
    state = materialize(open_, "ranks")
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("weight"))
    if weight:
        values = values.where("weight > 0")
    dec = "decimal(20,0)"
    while not state.where("lo < hi").isEmpty():
        todo = state.where("lo < hi")
        # Ranks of a key that share a range are counted together.
        ranges = todo.select(*keys, "lo", "hi").distinct().withColumn("width", F.ceil((F.col("hi").cast(dec) - F.col("lo").cast(dec) + 1) / F.lit(bins)).cast(dec))
        spans = ranges.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi", "width")).alias("spans"))  # at most one for each quantile
        placed = _meet(values, spans, base, keys).select(*keys, "value", "weight", F.explode("spans").alias("s")).where("value between s.lo and s.hi")
        bin_ = F.floor((F.col("value").cast(dec) - F.col("s.lo").cast(dec)) / F.col("s.width")).cast("int")
        counted = placed.groupBy(*keys, F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), F.col("s.width").alias("width"), bin_.alias("bin")).agg(F.sum("weight").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
        hist = counted.groupBy(*keys, "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "least", "most"))).alias("hist"))  # at most BINS entries
        walk = F.aggregate(
            "hist",
            F.struct(F.lit(0).cast("bigint").alias("below"), F.lit(None).cast("bigint").alias("least"), F.lit(None).cast("bigint").alias("most"), F.lit(False).alias("done")),
            lambda a, h: F.when(a["done"], a)
            .when(a["below"] + h["n"] >= F.col("rank"), F.struct(a["below"].alias("below"), h["least"].alias("least"), h["most"].alias("most"), F.lit(True).alias("done")))
            .otherwise(F.struct((a["below"] + h["n"]).alias("below"), a["least"].alias("least"), a["most"].alias("most"), F.lit(False).alias("done"))),
        )
        closer = todo.join(hist, [*keys, "lo", "hi"]).select(*keys, "q", "rank", walk.alias("w")).select(*keys, "q", (F.col("rank") - F.col("w.below")).alias("rank"), F.col("w.least").alias("lo"), F.col("w.most").alias("hi"))
        new = materialize(state.where("lo >= hi").unionByName(closer), "ranks")
        forget(state)
        state = new
    return state.select(*keys, "q", F.col("lo").alias("result"))


def profile(df: DataFrame, keys: list[str], value: str, quantiles: tuple[float, ...] = QUANTILES, heavy_share: float = 0.04) -> DataFrame:
    """One row for each key: rows, n, total, least, most, share of all totals, is_heavy, and a column for each quantile (p50, p90, ...)."""
    base = materialize(totals(df, keys, value), "totals")
    cols = {q: f"p{q * 100:g}".replace(".", "_") for q in quantiles}
    whole = base.agg(F.sum("total")).first()[0]
    share = F.col("total") / F.lit(whole) if whole else F.lit(None).cast("double")
    # Exact in integers: share >= heavy_share without rounding.
    permille = round(heavy_share * 10_000)
    heavy = F.coalesce(F.col("total").cast("decimal(38,0)") * 10_000 >= F.lit(whole or 0).cast("decimal(38,0)") * permille, F.lit(False)) if whole else F.lit(False)
    out = base
    if quantiles:
        picked = select_ranks(df, keys, value, base, quantiles)
        out = base.join(picked.groupBy(*keys).agg(*(F.max(F.when(F.col("q") == float(q), F.col("result"))).alias(c) for q, c in cols.items())), keys, "left")
    return out.select(*keys, "rows", "n", "total", F.col("lo").alias("least"), F.col("hi").alias("most"), share.alias("share"), heavy.alias("is_heavy"), *cols.values())


def heavy_keys(manifest: DataFrame, parts: int = 25) -> DataFrame:
    """(pkg_type, repo) of each key with at least 1/parts of all index rows; null and negative row counts are 0, and without any index row no key is heavy."""
    n = F.greatest(F.coalesce("row_count", F.lit(0)), F.lit(0))
    own = materialize(entries(manifest).select(*KEY, n.alias("n"), F.xxhash64(*KEY).alias("h"), F.lit(0).alias("whole")).where("n > 0"), "entries")
    base = materialize(totals(own, ["whole"], "h", "n").select("whole", "n", "lo", "hi"), "totals")
    picked = select_ranks(own, ["whole"], "h", base, weight="n", parts=parts).select(F.col("result").alias("h")).distinct()  # at most parts rows
    sums = own.join(F.broadcast(picked), "h", "left_semi").groupBy(*KEY).agg(F.sum("n").alias("total"))
    whole = base.agg(F.sum("n")).first()[0] or 0
    return sums.where(F.col("total").cast("decimal(38,0)") * parts >= F.lit(whole)).select(*KEY)


def key_results(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """(pkg_type, repo, parts, listed_rows, rows, bytes, files, p50, p90, p99, is_heavy) of each key of either table."""
    parts = entries(manifest).groupBy(*KEY).agg(F.count("*").alias("parts"), F.sum("row_count").alias("listed_rows"))
    once = materialize(chunks(index), "chunks")
    files = once.groupBy(*KEY, "batch_no", "file_index").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.count("*").alias("files"))
    found = profile(once, KEY, "uncompressed_size")
    whole = parts.agg(F.sum("listed_rows")).first()[0] or 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    out = parts.join(files, KEY, "full_outer").join(found.select(*KEY, F.col("rows"), F.col("total").alias("bytes"), "p50", "p90", "p99"), KEY, "full_outer")
    heavy = (F.coalesce(F.col("listed_rows"), F.lit(0)) * 25 >= F.lit(whole)) & F.lit(whole > 0)
    return out.select(*KEY, zero("parts"), zero("listed_rows"), zero("rows"), zero("bytes"), zero("files"), "p50", "p90", "p99", heavy.alias("is_heavy"))
