"""Queries of the archive, package, element, lookup and streaming operators, each with SQL that says the same."""

from __future__ import annotations

import io
import os
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import archives, maven
from ..functions import packages as P
from ..operators import codec, ingest, lookup, plugins, reading, resolve, zonemap
from ..session import materialize, shared_path, table
from ..sources import container, entries, osm, ranges, sinks
from ..streaming import ingest as streaming
from ..streaming import segments, windows
from . import archive

Query = Callable[[SparkSession, str], DataFrame]
SLICE = 4096
LEVEL = 3
REGISTERED: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTERED[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return entries.from_documents(table(spark, d, "documents"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return ingest.slices(_documents(spark, d), SLICE)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_index").select("relative_path").where("relative_path is not null").distinct()


DOCS = "docs as (select coalesce(source, '') || '/' || doc_id || '.txt' as relative_path, encode(coalesce(text, '')) as content, coalesce(source, '') as repo, doc_id from documents)"
CHUNKS = f"""{DOCS}, chunks as (select relative_path, repo, doc_id, i::int as chunk_seq, i * {SLICE} as fdata_offset, unhex(substring(hex(content), i * {2 * SLICE} + 1, {2 * SLICE})) as data
  from (select *, unnest(range(0, greatest(octet_length(content) - 1, 0) // {SLICE} + 1)) as i from docs))"""
PATHS = "paths as (select distinct relative_path from chunk_index where relative_path is not null)"


@query(f"with {CHUNKS} select relative_path, chunk_seq, fdata_offset, octet_length(data) as uncompressed_size, sha256(data) as checksum from chunks")
def q01_chunk_index(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("relative_path", "chunk_seq", "fdata_offset", "uncompressed_size", _hex(ingest.checksum(F.col("data"))).alias("checksum"))


@query(f"""with {CHUNKS} select relative_path, chunk_seq, octet_length(data) as blob_size,
  coalesce(sum(octet_length(data)) over (order by relative_path, chunk_seq rows between unbounded preceding and 1 preceding), 0)::bigint as blob_offset from chunks""")
def q02_blob_layout(spark: SparkSession, d: str) -> DataFrame:
    own = _chunks(spark, d).select("relative_path", "chunk_seq", F.col("uncompressed_size").alias("blob_size"))
    return ingest.blob_layout(own).select("relative_path", "chunk_seq", "blob_size", "blob_offset")


@query("""select coalesce(pkg_type, 0)::tinyint as pkg_type, coalesce(repo, '') as repo, count(*) as row_count, count(distinct relative_path) as files, sum(uncompressed_size)::bigint as total_bytes
  from chunk_index group by 1, 2""")
def q03_manifest(spark: SparkSession, d: str) -> DataFrame:
    return ingest.manifest(table(spark, d, "chunk_index"))


@query("""with e as (select * from (select relative_path, name, version, row_number() over (partition by relative_path order by ext_id) as k from extension_row) where k = 1)
  select relative_path, uncompressed_size as chunk0_size, case when name is not null then 'pypi:' || name || ':' || coalesce(version, '') end as gav
  from chunk_index left join e using (relative_path) where chunk_seq = 0""")
def q04_listing(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "extension_row").groupBy("relative_path").agg(F.min(F.struct("ext_id", "name", "version")).alias("e"))
    ext = first.select("relative_path", F.when(F.col("e.name").isNotNull(), "pypi").alias("group_id"), F.col("e.name").alias("artifact_id"), "e.version")
    return reading.listing(ingest.attach(table(spark, d, "chunk_index"), ext)).select("relative_path", "chunk0_size", "gav")


@query("select relative_path, sum(uncompressed_size)::bigint as file_size, count(*) as chunks from chunk_index group by 1")
def q05_file_rollup(spark: SparkSession, d: str) -> DataFrame:
    return reading.rollup(table(spark, d, "chunk_index"))


DIGESTS = f"with {DOCS} select relative_path, octet_length(content) as file_size, sha256(content) as digest from docs"


def _digests(files: DataFrame) -> DataFrame:
    return files.select("relative_path", F.octet_length("content").cast("bigint").alias("file_size"), F.sha2("content", 256).alias("digest"))


@query(DIGESTS)
def q06_reassemble(spark: SparkSession, d: str) -> DataFrame:
    return _digests(reading.reassemble(_chunks(spark, d)))


@query(f"with {PATHS} select relative_path, lower(regexp_extract(regexp_extract(relative_path, '([^/]+)/*$', 1), '^.+\\.([^.]*)$', 1)) in {ingest.STORED} as stored from paths")
def q07_skip_flag(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("relative_path", ingest.skip_flag(F.col("relative_path")).alias("stored"))


@query("""with f as (select relative_path, bool_or(compressed) as c, sum(case when compressed then uncompressed_size else 0 end) as cb, sum(case when compressed then 0 else uncompressed_size end) as ub,
    sum(blob_size) as o, count(*) as n from chunk_index group by 1),
  t as (select count(*) as total_files, count(*) filter (where c) as compressed_files, count(*) filter (where not c) as uncompressed_files, sum(n)::bigint as chunks,
    sum(cb)::bigint as compressed_bytes, sum(ub)::bigint as uncompressed_bytes, sum(o)::bigint as total_bytes_out from f)
  select *, compressed_bytes + uncompressed_bytes as total_bytes_in,
    case when compressed_bytes > 0 and total_bytes_out > uncompressed_bytes then compressed_bytes / (total_bytes_out - uncompressed_bytes) * 100 else 0.0 end as ratio_stream,
    case when uncompressed_bytes > 0 then compressed_bytes / greatest(total_bytes_out, 1) * 100 else 0.0 end as ratio_dir,
    case when total_bytes_out > 0 then (compressed_bytes + uncompressed_bytes) / total_bytes_out else 0.0 end as ratio from t""")
def q08_compression_report(spark: SparkSession, d: str) -> DataFrame:
    return ingest.compression_report(table(spark, d, "chunk_index"))


@query(f"""with {CHUNKS}, s as (select relative_path, octet_length(data) as n, doc_id % 17 = 0 as bad from chunks)
  select count(distinct relative_path) as total_files, count(*) filter (where bad) as corrupt_files, count(distinct relative_path) filter (where bad) as corrupt_files_distinct,
    sum(n)::bigint as total_bytes, sum(case when bad then 0 else n end)::bigint as verified_bytes, sum(case when bad then n else 0 end)::bigint as corrupt_bytes, count(*) as chunks,
    greatest(count(distinct relative_path) - count(*) filter (where bad), 0) as verified_files from s""")
def q09_verify(spark: SparkSession, d: str) -> DataFrame:
    """Every 17th document gets a wrong checksum; all are encoded, decoded and compared."""
    encoded = archive.encode(_documents(spark, d), True, SLICE, LEVEL)
    number = F.regexp_extract("relative_path", r"/(\d+)\.txt$", 1).cast("bigint")
    planted = encoded.withColumn("checksum", F.when(number % 17 == 0, F.unhex(F.sha2(F.lit(b"planted"), 256))).otherwise(F.col("checksum")))
    return codec.verify_report(codec.decode(planted).drop("data"))


@query(f"""with {DOCS}, s as (select octet_length(content) as n from docs)
  select case when n > {SLICE} or n = 0 then 'big' else 'small' end as pass, count(*) as files, sum(n)::bigint as total_bytes from s group by 1""")
def q10_big_small(spark: SparkSession, d: str) -> DataFrame:
    files = _documents(spark, d).select(F.octet_length("content").cast("bigint").alias("file_size"))
    big, small = ingest.big_small(files, SLICE)
    both = big.withColumn("pass", F.lit("big")).unionByName(small.withColumn("pass", F.lit("small")))
    return both.groupBy("pass").agg(F.count("*").alias("files"), F.sum("file_size").alias("total_bytes"))


@query(r"""with paths as (select distinct relative_path, regexp_extract(relative_path, '([^/]*)$', 1) as b from chunk_index where relative_path is not null)
  select 2::tinyint as pkg_type, relative_path, regexp_extract(b, '^(.*)-([0-9].*)\.crate$', 1) as name, regexp_extract(b, '^(.*)-([0-9].*)\.crate$', 2) as version, null as packaging
    from paths where regexp_matches(b, '^(.*)-([0-9].*)\.crate$')
  union all
  select 1::tinyint, relative_path, null, null, regexp_extract(relative_path, '\.([a-z]+)$', 1) from paths where regexp_matches(relative_path, '\.(jar|war|ear|pom)$')""")
def q11_union_groups(spark: SparkSession, d: str) -> DataFrame:
    """Typed rows of two plugins with different columns as one table."""
    own = plugins.Registry().register(plugins.cargo())
    kind = StructType([StructField("packaging", StringType())])
    own.register(plugins.Plugin("maven", plugins.TYPE_IDS["maven"], P.MAVEN, kind, columns=lambda p: F.struct(F.regexp_extract(p, r"\.([a-z]+)$", 1).alias("packaging"))))
    return own.rows(_paths(spark, d).withColumn("content", F.lit(None).cast("binary")))


@query("select count(distinct relative_path) as files from chunk_index")
def q12_distinct_paths(spark: SparkSession, d: str) -> DataFrame:
    return reading.files(table(spark, d, "chunk_index")).agg(F.count("relative_path").alias("files"))


@query(rf"with {PATHS}, b as (select relative_path, regexp_extract(relative_path, '([^/]*)$', 1) as b from paths) select relative_path, regexp_extract(b, '^(.*)-([0-9].*)\.crate$', 1) as name, regexp_extract(b, '^(.*)-([0-9].*)\.crate$', 2) as version from b where regexp_matches(b, '^(.*)-([0-9].*)\.crate$')")
def q13_crate_names(spark: SparkSession, d: str) -> DataFrame:
    return plugins.cargo().rows(_paths(spark, d)).select("relative_path", "name", "version")


@query(rf"""with {PATHS}, p as (select relative_path, string_split(regexp_extract(relative_path, '([^/]*)\.whl$', 1), '-') as p from paths where relative_path like '%.whl'),
  n as (select *, len(p) as n, len(p) = 6 or (len(p) > 6 and regexp_matches(p[-4], '^[0-9]')) as built from p where len(p) >= 5)
  select relative_path, array_to_string(p[1:n - (case when built then 5 else 4 end)], '_') as name, case when built then p[-5] else p[-4] end as version, case when built then p[-4] end as build_tag,
    p[-3] as python_tag, p[-2] as abi_tag, p[-1] as platform_tag from n""")
def q14_wheel_names(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("relative_path", P.wheel(F.col("relative_path")).alias("w")).where("w is not null").select("relative_path", "w.*")


@query(rf"""with {PATHS}, b as (select relative_path, regexp_extract(relative_path, '([^/]*)\.(tar\.gz|zip)$', 1) as s from paths)
  select relative_path, regexp_extract(s, '^(.*)-([^-]*)$', 1) as name, regexp_extract(s, '^(.*)-([^-]*)$', 2) as version, 'source' as python_tag from b where contains(s, '-')""")
def q15_sdist_names(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("relative_path", P.sdist(F.col("relative_path")).alias("s")).where("s is not null").select("relative_path", "s.name", "s.version", "s.python_tag")


@query("select distinct name, replace(replace(lower(name), '_', '-'), '.', '-') as normal, name || '-' || version || '.dist-info' as dist_info from extension_row where name is not null and version is not null")
def q16_name_normalise(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "extension_row").where("name is not null and version is not null")
    return own.select("name", P.pypi_name(F.col("name")).alias("normal"), P.dist_info(F.col("name"), F.col("version")).alias("dist_info")).distinct()


MAVEN_RULE = r"^([^\\]+)/([^/\\]+)/([^/\\]+)/[^/\\]+\.(jar|war|ear|pom)$"
MAVEN_SQL = rf"""{PATHS}, m as (select relative_path, regexp_extract(relative_path, '{MAVEN_RULE}', 1) as g, regexp_extract(relative_path, '{MAVEN_RULE}', 2) as a,
  regexp_extract(relative_path, '{MAVEN_RULE}', 3) as v, regexp_extract(relative_path, '{MAVEN_RULE}', 4) as k from paths where regexp_matches(relative_path, '{MAVEN_RULE}'))"""


def _maven(spark: SparkSession, d: str) -> DataFrame:
    part = lambda i: F.regexp_extract("relative_path", MAVEN_RULE, i)
    return _paths(spark, d).where(F.col("relative_path").rlike(MAVEN_RULE)).select("relative_path", part(1).alias("g"), part(2).alias("a"), part(3).alias("v"), part(4).alias("k"))


@query(f"with {MAVEN_SQL} select g || ':' || a || ':' || v as gav, 'https://repo1.maven.org/maven2/' || replace(g, '.', '/') || '/' || a || '/' || v || '/' || a || '-' || v || '.' || k as url from m")
def q17_coordinates(spark: SparkSession, d: str) -> DataFrame:
    g, a, v, k = map(F.col, "gavk")
    return _maven(spark, d).select(P.coordinate(g, a, v).alias("gav"), P.maven_url(g, a, v, k, F.lit(None).cast("string")).alias("url"))


def _pom(g: Column, a: Column, v: Column, more: Column | None = None) -> Column:
    text = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<?xml version='1.0'?>\n<project>\n <!-- built --> <groupId>"), text(g), F.lit("</groupId>\n <artifactId>"), text(a), F.lit("</artifactId><version>"), text(v), F.lit("</version>\n"), more if more is not None else F.lit(""), F.lit("</project>"))


@query(f"with {MAVEN_SQL} select relative_path, g as group_id, a as artifact_id, v as version, 'jar' as packaging from m")
def q18_pom_project(spark: SparkSession, d: str) -> DataFrame:
    """A POM for every Maven path, packed into a JAR unless it is a .pom, read back by the plugin."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, pom in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not path.endswith(".pom"):
                    sink = io.BytesIO()
                    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr("META-INF/MANIFEST.MF", "")
                        z.writestr("META-INF/maven/g/a/pom.xml", pom)
                    pom = sink.getvalue()
                out.append(pom)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["relative_path", "content"])

    jars = _maven(spark, d).select("relative_path", F.encode(_pom(F.col("g"), F.col("a"), F.col("v")), "utf-8").alias("content")).mapInArrow(pack, "relative_path string, content binary")
    return plugins.maven().rows(jars).select("relative_path", "group_id", "artifact_id", "version", "packaging")


@query("""with e as (select edge_id, dep_scope, split_part(child, ':', 1) as g, split_part(child, ':', 2) as a, split_part(child, ':', 3) as v from dependency_edge where child is not null)
  select edge_id, g as group_id, a as artifact_id, v as version, 'jar' as packaging from e where g <> '' and a <> '' and v <> '' and coalesce(dep_scope, '') not in ('test', 'provided', 'system')""")
def q19_pom_dependencies(spark: SparkSession, d: str) -> DataFrame:
    part = lambda i: F.coalesce(F.get(F.split("child", ":", 3), F.lit(i)), F.lit(""))
    scope = F.when(F.col("dep_scope").isNotNull(), F.concat(F.lit("<scope>"), "dep_scope", F.lit("</scope>"))).otherwise("")
    dep = F.concat(F.lit("<dependencies><dependency><groupId>"), part(0), F.lit("</groupId><artifactId>"), part(1), F.lit("</artifactId><version>"), part(2), F.lit("</version>"), scope, F.lit("</dependency></dependencies>"))
    poms = table(spark, d, "dependency_edge").where("child is not null").select("edge_id", F.encode(_pom(F.lit("x"), F.lit("y"), F.lit("1"), dep), "utf-8").alias("pom"))
    return poms.select("edge_id", F.explode(maven.dependencies_of(F.col("pom"))).alias("d")).select("edge_id", "d.group_id", "d.artifact_id", "d.version", "d.packaging")


@query("select c.row_id, e.ext_id, e.python_tag from chunk_index c left join extension_row e on e.relative_path = c.relative_path")
def q20_extension_join(spark: SparkSession, d: str) -> DataFrame:
    ext = table(spark, d, "extension_row").select("relative_path", "ext_id", "python_tag")
    return ingest.attach(table(spark, d, "chunk_index").select("row_id", "relative_path"), ext).select("row_id", "ext_id", "python_tag")


@query("""with k as (select o_orderkey as id, min(p) as pos from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as p from orders) group by 1)
  select l_orderkey * 16 + l_linenumber as query_pos, l_orderkey + l_linenumber as id, pos from lineitem left join k on k.id = l_orderkey + l_linenumber""")
def q21_batch_lookup(spark: SparkSession, d: str) -> DataFrame:
    index = lookup.build(table(spark, d, "orders"), "o_orderkey")
    wanted = table(spark, d, "lineitem").select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("query_pos"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("id"))
    return lookup.batch(wanted, index)


@query("select l_orderkey as id, min(p) as pos from (select l_orderkey, row_number() over (order by l_orderkey) - 1 as p from lineitem) group by 1")
def q22_lower_bound(spark: SparkSession, d: str) -> DataFrame:
    return lookup.build(table(spark, d, "lineitem"), "l_orderkey")


@query("select count(*) - 1 as pos from orders where o_orderkey <= (select max(o_orderkey) from orders)")
def q23_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return lookup.find(lookup.build(orders, "o_orderkey"), orders.agg(F.max("o_orderkey")).first()[0])


#: Events as elements: three kinds, one flag for each event type, the value as place.
TYPES = ("click", "error", "purchase", "signup", "view")
ELEMENTS = f"""ev as (select event_id as file_offset, case when event_type = 'click' then 0 when event_type = 'view' then 1 else 2 end as kind, event_id as id,
  trunc(value * 1000)::int as lat_e7, trunc(value * -1000)::int as lon_e7, case {' '.join(f"when event_type = '{t}' then {1 << i}" for i, t in enumerate(TYPES))} else 0 end as tag_flags, row_number() over (order by event_id) - 1 as rn from events)"""
ZONES = f"""{ELEMENTS}, z as (select rn // 1024 as block_id, min(rn) as index_start, max(rn) + 1 as index_end, bit_or(1 << kind)::int as kind_mask, bit_or(tag_flags)::int as tag_flags,
  min(case when kind = 0 then lat_e7 end) as lat_min, max(case when kind = 0 then lat_e7 end) as lat_max, min(case when kind = 0 then lon_e7 end) as lon_min, max(case when kind = 0 then lon_e7 end) as lon_max from ev group by 1)"""


def _elements(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    flags = F.lit(0)
    for i, t in enumerate(TYPES):
        flags = F.when(F.col("event_type") == t, 1 << i).otherwise(flags)
    cut = lambda by: (F.col("value") * by).cast("int")
    return table(spark, d, "events").select(F.col("event_id").alias("file_offset"), kind.cast("tinyint").alias("kind"), F.col("event_id").alias("id"), cut(1000).alias("lat_e7"), cut(-1000).alias("lon_e7"), flags.alias("tag_flags"))


@query(f"with {ZONES} select * from z")
def q24_zone_map(spark: SparkSession, d: str) -> DataFrame:
    return zonemap.summaries(zonemap.number(_elements(spark, d)))


@query(f"with {ELEMENTS} select id from ev where kind = 2 and (tag_flags & 10) <> 0")
def q25_filter_kind_mask(spark: SparkSession, d: str) -> DataFrame:
    return zonemap.filter_scan(_elements(spark, d), zonemap.Filter(kind=2, tag_mask=10)).select("id")


@query(f"with {ELEMENTS} select id from ev where kind <> 0 or (lat_e7 between 10000 and 60000 and lon_e7 between -50000 and 0)")
def q26_filter_box(spark: SparkSession, d: str) -> DataFrame:
    return zonemap.filter_scan(_elements(spark, d), zonemap.Filter(bbox=(10_000, 60_000, -50_000, 0))).select("id")


@query(f"with {ELEMENTS} select id from ev where kind = 0 and lat_e7 between 99000 and 100000 and lon_e7 between -100000 and 0")
def q27_pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    own = zonemap.store(zonemap.number(_elements(spark, d)))
    return zonemap.filter_pruned(own, zonemap.summaries(own), zonemap.Filter(kind=0, bbox=(99_000, 100_000, -100_000, 0))).select("id")


@query(f"with {ELEMENTS} select kind::tinyint as kind, count(*) as elements from ev group by 1")
def q28_element_counts(spark: SparkSession, d: str) -> DataFrame:
    return zonemap.counts(_elements(spark, d))


COORD = "case when c_acctbal < 0 then '-' else '' end || c_nationkey || '.' || lpad(c_custkey::varchar, 9, '7')"


@query(f"with t as (select c_custkey, {COORD} as t from customer) select c_custkey, (case when t like '-%' then -1 else 1 end * floor(abs(t::decimal(20,12)) * 10000000))::int as e7, abs(regexp_replace(t, '[^0-9]', '', 'g')::bigint) * case when t like '-%' then -1 else 1 end as digits from t")
def q29_fixed_point(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.when(F.col("c_acctbal") < 0, "-").otherwise(""), F.col("c_nationkey").cast("string"), F.lit("."), F.lpad(F.col("c_custkey").cast("string"), 9, "7"))
    return table(spark, d, "customer").select("c_custkey", P.coord_e7(t).alias("e7"), P.lenient_long(t).alias("digits"))


@query("select o_orderkey, row_number() over (order by o_custkey, o_orderkey) - 1 as pos from orders")
def q30_key_sort(spark: SparkSession, d: str) -> DataFrame:
    return lookup.rank(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"]).select("o_orderkey", "pos")


@query("""with recursive e as (select distinct parent, child from dependency_edge where parent is not null and child is not null and split_part(child, ':', -1) not like '$%'),
  top as (select distinct child as coord from dependency_edge where child is not null and parent not in (select child from dependency_edge where child is not null)),
  walk as (select coord, 0 as depth from top union select e.child, depth + 1 from walk join e on e.parent = walk.coord where depth < 3)
  select 'all' as root, coord, min(depth) as depth from walk group by coord""")
def q31_transitive(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "dependency_edge")
    children = edges.select(F.col("child").alias("parent")).where("parent is not null").distinct()
    direct = edges.where("parent is not null").join(children, "parent", "left_anti").select(F.lit("all").alias("root"), F.col("child").alias("coord"))
    return resolve.transitive(direct, edges, 3)


@query("select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as events from events group by 1, 2")
def q32_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(table(spark, d, "events"), by=("event_type",))


@query("""with g as (select user_id, ts, case when ts > lag(ts) over (partition by user_id order by ts) + interval 30 minute or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
  s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as n from g)
  select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as events from s group by user_id, n""")
def q33_sessions(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(table(spark, d, "events"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query(f"with {CHUNKS} select 0::tinyint as pkg_type, repo, count(*) as row_count, count(distinct relative_path) as files, sum(octet_length(data))::bigint as total_bytes from chunks group by repo")
def q34_stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a stream into an archive, then its manifest."""
    path = f"{d}/documents.parquet"
    raw = spark.readStream.schema(spark.read.parquet(path).schema)
    raw = raw.parquet(path) if _is_dir(spark, path) else raw.option("pathGlobFilter", "documents.parquet").parquet(d)
    out = shared_path(spark, "stream")
    streaming.Ingest(entries.from_documents(raw), out, slice_size=SLICE, level=LEVEL).finish()
    return streaming.published(spark, out, "manifest")


@query("""with s as (select l_returnflag || l_linestatus || l_linenumber as name, sum(case when l_shipdate >= timestamp '1998-09-24' then l_quantity::bigint else 0 end)::double as c1, sum(case when l_shipdate >= timestamp '1998-09-24' then l_partkey else 0 end)::double as d1,
    sum(case when l_shipdate < timestamp '1998-09-24' then l_quantity::bigint else 0 end)::double as c0, sum(case when l_shipdate < timestamp '1998-09-24' then l_partkey else 0 end)::double as d0 from lineitem group by 1),
  m as (select name, 'compress_mbs' as metric, c1 as current, c0 as baseline from s union all select name, 'decompress_mbs', d1, d0 from s)
  select name, metric, current, baseline, (1 - current / baseline) * 100 as drop_pct from m where current < baseline * 0.8""")
def q35_regressions(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").withColumn("name", F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")))
    late = F.col("l_shipdate") >= F.lit("1998-09-24").cast("timestamp")
    side = lambda when: own.groupBy("name").agg(F.sum(F.when(when, F.col("l_quantity").cast("bigint")).otherwise(0)).cast("double").alias("compress_mbs"), F.sum(F.when(when, F.col("l_partkey")).otherwise(0)).cast("double").alias("decompress_mbs"))
    return resolve.regressions(side(late), side(~late))


@query(r"""with g as (select distinct coalesce(pkg_type, 0) as pkg_type, coalesce(repo, '') as repo, coalesce(module_name, '') as module_name from manifest),
  c as (select *, trim(regexp_replace(repo, '[^A-Za-z0-9]', '_', 'g'), '_') as r, trim(regexp_replace(module_name, '[^A-Za-z0-9]', '_', 'g'), '_') as m from g)
  select repo, module_name, 'idx_' || lpad((pkg_type & 255)::varchar, 3, '0') || case when r <> '' then '_' || r else '' end || case when m <> '' then '_' || m else '' end || '_7' as name from c""")
def q36_table_names(spark: SparkSession, d: str) -> DataFrame:
    own = ingest.untyped(table(spark, d, "manifest")).withColumn("module_name", F.coalesce("module_name", F.lit(""))).select("pkg_type", "repo", "module_name").distinct()
    return own.select("repo", "module_name", P.table_name(F.col("pkg_type"), F.col("repo"), F.col("module_name"), F.lit(7)).alias("name"))


@query(f"with {CHUNKS} select relative_path, chunk_seq, fdata_offset, octet_length(data) as uncompressed_size, sha256(data) as checksum, 0::tinyint as pkg_type, repo from chunks")
def q37_container_index(spark: SparkSession, d: str) -> DataFrame:
    """The documents as one file, its index read back group by group."""
    path = _container(spark, d)
    own = container.index(spark, path)
    return own.select("relative_path", "chunk_seq", "fdata_offset", "uncompressed_size", _hex(F.col("checksum")).alias("checksum"), "pkg_type", "repo")


def _container(spark: SparkSession, d: str) -> str:
    path = ranges.local_path(shared_path(spark, "container"))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    sinks.ContainerSink(path).write(archive.encode(_documents(spark, d), False, SLICE, LEVEL))
    return path


@query(f"with {CHUNKS} select 0::tinyint as pkg_type, repo, count(*) as row_count from chunks group by repo")
def q38_container_manifest(spark: SparkSession, d: str) -> DataFrame:
    return container.manifest(spark, _container(spark, d)).select("pkg_type", "repo", "row_count")


@query(DIGESTS)
def q39_container_blobs(spark: SparkSession, d: str) -> DataFrame:
    path = _container(spark, d)
    return _digests(reading.reassemble(codec.decode(container.stored_blobs(spark, path, container.index(spark, path)))))


@query("""select case when c_custkey % 3 = 0 then 1 else 0 end::tinyint as kind, c_custkey as id, case when c_custkey % 3 = 0 then 0 else trunc(c_custkey * 1000)::int end as lat_e7,
  case when c_custkey % 3 = 0 then 0 else -(c_nationkey * 10000000 + 5000000) end::int as lon_e7, case when c_custkey % 3 = 0 then 1 when c_custkey % 5 = 0 then 64 else 0 end::int as tag_flags from customer""")
def q40_element_scan(spark: SparkSession, d: str) -> DataFrame:
    """Customers as map elements in XML files, scanned in small ranges."""
    text = lambda c: F.col(c).cast("string")
    frac = F.lpad((F.col("c_custkey") * 1000 % 10_000_000).cast("string"), 7, "0")
    place = F.concat(F.lit('" lat="'), F.floor(F.col("c_custkey") * 1000 / 10_000_000).cast("string"), F.lit("."), frac, F.lit('" lon="-'), text("c_nationkey"), F.lit(".5"))
    way = F.concat(F.lit(' <way id="'), text("c_custkey"), F.lit('">\n  <nd ref="1"/>\n  <tag k="highway" v="x"/>\n </way>'))
    node = F.concat(F.lit(' <node id="'), text("c_custkey"), place, F.when(F.col("c_custkey") % 5 == 0, '"><tag k="amenity" v="x"/></node>').otherwise('"/>'))
    out = shared_path(spark, "map")
    table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, way).otherwise(node).alias("value")).write.option("compression", "none").text(out)
    for crc in ranges.files_below(out):
        if crc[0].endswith(".crc") or os.path.basename(crc[0]).startswith("_"):
            os.remove(crc[0])
    return osm.elements(spark, out, 20_000).select("kind", "id", "lat_e7", "lon_e7", "tag_flags")


@query("select ext_id, array_to_string(list_transform(requires_dist, lambda x: trim(x)), '|') as requires from extension_row where len(requires_dist) > 0")
def q41_wheel_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Each file's requirements written into the METADATA of a wheel and read back."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for needs in b.column(1).to_pylist():
                sink = io.BytesIO()
                with zipfile.ZipFile(sink, "w") as z:
                    z.writestr("x/__init__.py", "")
                    z.writestr("x-1.dist-info/METADATA", "Name: x\n" + "".join(f"Requires-Dist: {n}\n" for n in needs))
                out.append(sink.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["relative_path", "content"])

    own = table(spark, d, "extension_row").where(F.size("requires_dist") > 0).select(F.concat(F.col("ext_id").cast("string"), F.lit("/x-1-py3-none-any.whl")).alias("relative_path"), "requires_dist")
    rows = plugins.pypi(deps=True).rows(own.mapInArrow(pack, "relative_path string, content binary"))
    return rows.select(F.split("relative_path", "/")[0].cast("bigint").alias("ext_id"), F.array_join("requires_dist", "|").alias("requires"))


@query(r"""with p as (select edge_id, split_part(child, ':', 2) as name from dependency_edge where child is not null)
  select edge_id, 'pkg' || edge_id as name, '1.0.' || edge_id as version, name as dependencies from p where name <> ''""")
def q42_crate_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Each edge as a crate whose Cargo.toml names it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name in b.column(1).to_pylist():
                toml = f"[package]\nname = 'x'\n[dependencies]\n# none\n{name} = \"1\"\n[dev-dependencies]\nother = \"2\"\n".encode()
                sink = io.BytesIO()
                with tarfile.open(fileobj=sink, mode="w:gz") as t:
                    info = tarfile.TarInfo("x-1/Cargo.toml")
                    info.size = len(toml)
                    t.addfile(info, io.BytesIO(toml))
                out.append(sink.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["relative_path", "content"])

    id_ = F.col("edge_id").cast("string")
    own = table(spark, d, "dependency_edge").where("child is not null").select(F.concat(F.lit("c/pkg"), id_, F.lit("-1.0."), id_, F.lit(".crate")).alias("relative_path"), F.get(F.split("child", ":"), F.lit(1)).alias("name")).where("name <> ''")
    rows = plugins.cargo(deps=True).rows(own.mapInArrow(pack, "relative_path string, content binary"))
    return rows.select(F.regexp_extract("relative_path", r"pkg(\d+)-", 1).cast("bigint").alias("edge_id"), "name", "version", F.array_join("dependencies", "|").alias("dependencies"))


def _written(spark: SparkSession, d: str) -> archive.Archive:
    out = shared_path(spark, "archive")
    archive.write(_documents(spark, d), out, slice_size=SLICE, level=LEVEL)
    return archive.open(spark, out)


@query(DIGESTS)
def q43_archive_extract(spark: SparkSession, d: str) -> DataFrame:
    """The documents written as an archive; every file extracted."""
    own = _written(spark, d)
    return _digests(own.extract_many(own.files()))


VERIFIED = f"""with {CHUNKS} select count(distinct relative_path) as total_files, count(distinct relative_path) as verified_files, 0::bigint as corrupt_files, 0::bigint as corrupt_files_distinct,
  sum(octet_length(data))::bigint as total_bytes, sum(octet_length(data))::bigint as verified_bytes, 0::bigint as corrupt_bytes, count(*) as chunks from chunks"""


@query(VERIFIED)
def q44_archive_verify(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d).verify()


@query(VERIFIED)
def q45_folder_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written as an archive, extracted to files, the files read in ranges into an archive, and that verified."""
    folder, out = shared_path(spark, "files"), shared_path(spark, "archive")
    _written(spark, d).extract_all(folder)
    archive.write_dir(spark, folder, out, slice_size=SLICE, level=LEVEL)
    return archive.open(spark, out).verify()


@query("select 'checksum' as key, 'sha256' as value union all select 'compression_level', '3' union all select 'file_split_block_size', '4096' union all select 'format_version', '3' union all select 'no_skip', 'False'")
def q46_config(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d).config_rows()


@query("select o_orderkey, o_custkey from orders")
def q47_segments(spark: SparkSession, d: str) -> DataFrame:
    """Orders as lines of text, cut at line ends across ranges and parsed."""
    out = shared_path(spark, "lines")
    table(spark, d, "orders").select(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("value")).write.text(out)
    for f in ranges.files_below(out):
        if not f[0].endswith(".txt"):
            os.remove(f[0])
    kind = StructType([StructField("o_orderkey", LongType()), StructField("o_custkey", LongType())])
    return segments.transform(spark, out, lambda r: [tuple(map(int, r.split(b"|")))], kind, range_size=10_000).select("o_orderkey", "o_custkey")


@query("select entry_id, module_name, row_count::int as row_count from manifest")
def q48_declared_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as a plugin's JSON answers, read by its declared schema."""
    own = table(spark, d, "manifest").select("entry_id", F.to_json(F.struct("module_name", "row_count")).alias("answer"))
    return plugins.json_rows(own, "answer", "module_name:utf8,row_count:u32").select("entry_id", "module_name", "row_count")


@query("""select coalesce(pkg_type, 0)::tinyint as pkg_type, coalesce(repo, '') as repo, count(*) as row_count, sum(uncompressed_size)::bigint as total_bytes from chunk_index group by 1, 2
  union all select coalesce(pkg_type, 0)::tinyint, null, count(*), sum(uncompressed_size)::bigint from chunk_index group by 1
  union all select null, null, count(*), sum(uncompressed_size)::bigint from chunk_index""")
def q49_manifest_rollup(spark: SparkSession, d: str) -> DataFrame:
    return ingest.manifest_rollup(table(spark, d, "chunk_index"))


@query(r"""with g as (select coalesce(pkg_type, 0) as pkg_type, coalesce(repo, '') as repo, count(*) as rows_in from chunk_index group by 1, 2),
  n as (select *, trim(regexp_replace(repo, '[^A-Za-z0-9]', '_', 'g'), '_') as r, row_number() over (order by pkg_type, repo) - 1 as nth from g)
  select 'idx_' || lpad((pkg_type & 255)::varchar, 3, '0') || case when r <> '' then '_' || r else '' end || '_' || nth as name, rows_in from n""")
def q50_table_sink(spark: SparkSession, d: str) -> DataFrame:
    """The index as one table for each package type and repository, and the rows of each table."""
    own = table(spark, d, "chunk_index")
    place = shared_path(spark, "tables")
    name = "t" + place[-12:]
    sink = sinks.TableSink(spark, name, location=place)
    sink.write(own)
    out = None
    for r in sink.names(own).collect():
        part = spark.table(f"{name}.{r['table']}").select(F.lit(r["table"]).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("name").agg(F.count("*").alias("rows_in"))


@query("select doc_id, sha256(encode(text)) as digest from documents where text is not null and doc_id is not null")
def q51_zip_entries(spark: SparkSession, d: str) -> DataFrame:
    """Each text inside a ZIP next to an entry that isn't wanted."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                sink = io.BytesIO()
                with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                    z.writestr("other.bin", b"x")
                    z.writestr("docs/text.txt", text.encode())
                out.append(sink.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["relative_path", "content"])

    own = table(spark, d, "documents").where("text is not null and doc_id is not null").select(F.col("doc_id").cast("string").alias("relative_path"), "text")
    found = archives.entries(own.mapInArrow(pack, "relative_path string, content binary"), "zip", "text")
    return found.select(F.col("relative_path").cast("bigint").alias("doc_id"), F.sha2("data", 256).alias("digest"))


def queries() -> dict[str, Query]:
    return dict(REGISTERED)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
