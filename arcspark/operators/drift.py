"""One table out of JSON lines whose schema drifts from file to file (problem 1).

Tagged-union inference: every leaf value of every line carries its path and its type tag.  Fusing the schemas of parallel
inputs is then a mergeable count per (file, path, tag), so all types seen at a path are kept and
none wins early.  A path with more than one tag is split into one typed branch
for each tag plus one canonical value; comparing the fused schema of a file with
that of the preceding file of its series reports what appeared, went or changed.

Parsing is the only Python step (Arrow batches); all else is joins and hash aggregates whose keys include the file, so that
no series and no field, however large, is handled by one task.  Raw lines aren't shuffled, but for those of a place that was
loaded more than once.  changes() parses twice: all lines for counts alone, then the lines of files with fields that go next to
fields that come for their values.

Defined results: a null or unreadable line, or one that is no JSON object, is not
counted; rows with a null series or file_seq have no place in an order and are left
out; a line loaded more than once (same series, file_seq, line_no) counts once, in
the copy with the smallest line_id; lines without line_no are told apart by line_id;
integers have a tag and a branch of their own in records() and count as numbers in changes(); an object is no leaf: records() lists its path with the
tag object and no value, changes() leaves it out;
between types that are equally frequent the first of array, boolean, number, string
holds; a field with nulls only has no type and is never retyped; columns other than
those named are ignored.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import counted, forget, materialize

TAGS = ("array", "boolean", "number", "string")
TYPES = {type(None): "null", bool: "boolean", str: "string", int: "number", float: "number"}
LEAF = (
    "series string, file_seq int, line_no bigint, line_id bigint, entry string, field string, tag string, "
    "string_value string, integer_value decimal(38,0), number_value double, boolean_value boolean, array_value string, value_text string"
)
KINDS = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.decimal128(38, 0), pa.float64(), pa.bool_(), pa.string(), pa.string()]
#: Repeated places, and files whose values are wanted, are broadcast up to so many rows.
MAX_LOOKUP = 200_000
FILE = ["series", "file_seq"]
#: Files of one block are ordered together; blocks are chained through their last file.
BLOCK = 4096


def _no_constant(_: str) -> None:
    raise ValueError("not JSON")


def _holds_object(values: list) -> bool:
    return any(isinstance(v, dict) or (isinstance(v, list) and _holds_object(v)) for v in values)


OBJECT = object()


def _walk(value: object, path: str, entry: str, objects: bool) -> Iterator[tuple[str, str, object]]:
    """(path without list positions, list positions, leaf value), with objects also those below the top as OBJECT."""
    if isinstance(value, dict):
        if objects and path:
            yield path, entry, OBJECT
        for k, v in value.items():
            yield from _walk(v, f"{path}.{k}" if path else k, entry, objects)
    elif isinstance(value, list) and _holds_object(value):
        for i, v in enumerate(value):
            yield from _walk(v, path, f"{entry}.{i}" if entry else str(i), objects)
    else:
        yield path, entry, value


def _gather(value: dict, path: str, out: list[tuple[str, object]]) -> None:
    """(path, value) of each leaf, as _walk has them, without places in lists."""
    for k, v in value.items():
        own = f"{path}.{k}" if path else k
        if type(v) is dict:
            _gather(v, own, out)
        elif type(v) is list and _holds_object(v):
            _gather_list(v, own, out)
        else:
            out.append((own, v))


def _gather_list(values: list, path: str, out: list[tuple[str, object]]) -> None:
    for v in values:
        if type(v) is dict:
            _gather(v, path, out)
        elif type(v) is list and _holds_object(v):
            _gather_list(v, path, out)
        else:
            out.append((path, v))


def parse_object(raw: str | None) -> dict | None:
    """The object a line holds, or None unless it is one complete JSON object."""
    try:
        found = json.loads(raw, parse_constant=_no_constant)
    except (ValueError, TypeError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _clean(s: str) -> str:
    return s if s.isascii() else s.encode("utf-8", "replace").decode()


def tagged(v: object) -> tuple[str, str | None]:
    """(tag, text) of a leaf value."""
    if v is None:
        return "null", None
    if isinstance(v, bool):
        return "boolean", "true" if v else "false"
    if isinstance(v, str):
        return "string", _clean(v)
    if isinstance(v, int):
        return "integer", repr(v)
    if isinstance(v, float):
        return "number", repr(v) if math.isfinite(v) else json.dumps(v)
    return "array", json.dumps(v)


def leaf_values(raw: str | None) -> list[tuple]:
    """(entry, path, tag, string, integer, number, boolean, array, text) of each leaf of a line, and of each object in it."""
    found = parse_object(raw)
    out: list[tuple] = []
    if found is None:
        return out
    for path, entry, v in _walk(found, "", "", True):
        if v is OBJECT:
            out.append((entry, _clean(path), "object", *[None] * 6))
            continue
        tag, text = tagged(v)
        branch = dict.fromkeys(("string", "integer", "number", "boolean", "array"))
        branch[tag] = text if tag in ("string", "array") else v
        if tag == "integer" and abs(v) >= 10**38:
            branch[tag] = None
        branch.pop("null", None)
        out.append((entry, _clean(path), tag, *branch.values(), text))
    return out


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in LEAF.split(", ")]
    for batch in batches:
        rows = []
        for key in zip(*(batch.column(i).to_pylist() for i in range(5))):
            rows += [(*key[:4], *leaf) for leaf in leaf_values(key[4])]
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names)


def _tally(with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of (series, file_seq, field, tag, value_text or null) of a batch's leaves."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in TALLY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for series, seq, raw in zip(batch.column("series").to_pylist(), batch.column("file_seq").to_pylist(), batch.column("raw").to_pylist()):
                found = parse_object(raw)
                if found is None:
                    continue
                leaf: list[tuple[str, object]] = []
                _gather(found, "", leaf)
                for path, v in leaf:
                    seen[series, seq, _clean(path), TYPES.get(type(v), "array"), tagged(v)[1] if with_text else None] += 1
            if seen:
                cols = list(zip(*seen)) + [tuple(seen.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return run


TALLY = "series string, file_seq int, field string, tag string, value_text string, n bigint"


def lines_once(lines: DataFrame) -> DataFrame:
    """(series, file_seq, line_no, line_id, raw): each counted line once.

    Places are counted by their keys alone; only lines of a repeated place are shuffled with their text.
    """
    own = lines.where("series is not null and file_seq is not null").select(
        "series", F.col("file_seq").cast("int").alias("file_seq"), F.col("line_no").cast("bigint").alias("line_no"), F.col("line_id").cast("bigint").alias("line_id"), "raw"
    ).where("raw is not null")
    kind = F.when(F.col("line_no").isNotNull(), 0).when(F.col("line_id").isNotNull(), 1).otherwise(2)
    placed = own.withColumns({"kind": kind, "place": F.coalesce("line_no", "line_id", F.lit(0))})
    place = [*FILE, "kind", "place"]
    again, rows = counted(placed.groupBy(*place).agg(F.count("*").alias("k")).where("k > 1").select(*place), "repeated")
    if not rows:
        return own
    if rows <= MAX_LOOKUP:
        again = F.broadcast(again)
    first = placed.join(again, place, "left_semi").groupBy(*place).agg(F.min(F.struct("line_id", "raw", "line_no")).alias("first"))
    return placed.join(again, place, "left_anti").select(own.columns).unionByName(first.select(*FILE, "first.line_no", "first.line_id", "first.raw"))


def leaves(lines: DataFrame) -> DataFrame:
    """One row for each leaf of each counted line, tagged with its type."""
    return lines_once(lines).mapInArrow(_explode, LEAF)


def fuse(values: DataFrame) -> DataFrame:
    """The fused schema: (series, file_seq, field) with the count of each tag and the prevailing type."""
    counts = [F.sum(F.when(F.col("tag") == t, F.col("n")).otherwise(0)).alias(f"n_{t}") for t in (*TAGS, "null")]
    ranked = F.filter(
        F.array(*(F.struct(F.col(f"n_{t}").alias("n"), F.lit(-i).alias("rank"), F.lit(t).alias("tag")) for i, t in enumerate(TAGS))),
        lambda x: x["n"] > 0,
    )
    return values.groupBy(*FILE, "field").agg(*counts).withColumn("type", F.array_max(ranked)["tag"])


def _preceding(files: DataFrame) -> DataFrame:
    """Each file with the one before it in its series, without ordering a series in one task."""
    block = F.floor(F.col("file_seq") / BLOCK)
    inner = files.select(*FILE, block.alias("block")).withColumn("inside", F.lag("file_seq").over(Window.partitionBy("series", "block").orderBy("file_seq")))
    lasts = inner.groupBy("series", "block").agg(F.max("file_seq").alias("last"))
    before = lasts.select("series", "block", F.lag("last").over(Window.partitionBy("series").orderBy("block")).alias("outside"))
    return inner.join(before, ["series", "block"]).select(*FILE, F.coalesce("inside", "outside").alias("prev_seq")).where("prev_seq is not null")


def changes(lines: DataFrame) -> DataFrame:
    """(series, file_seq, change, old_field, new_field): every change against the preceding file."""
    once = lines_once(lines)
    fused = materialize(fuse(once.mapInArrow(_tally(False), TALLY)), "drift-schema")

    def texts(wanted: DataFrame) -> DataFrame:
        files, rows = counted(wanted.select(*FILE).distinct(), "drift-files")
        own = once.join(F.broadcast(files), FILE, "left_semi") if rows <= MAX_LOOKUP else once
        return own.mapInArrow(_tally(True), TALLY)

    return changes_of(fused, texts)


def distinct_values(parsed: DataFrame) -> DataFrame:
    """(series, file_seq, field, tag, value_text, n): each distinct value of a field of a file once, integers as numbers, without objects."""
    tag = F.when(F.col("tag") == "integer", "number").otherwise(F.col("tag")).alias("tag")
    return parsed.where("tag <> 'object'").groupBy(*FILE, "field", tag, "value_text").agg(F.count("*").alias("n"))


def changes_of(fused: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """changes, from the fused schemas of files and what gives (at least) the values of wanted (series, file_seq, field)."""
    steps = _preceding(fused.select(*FILE).distinct())
    old = fused.select("series", F.col("file_seq").alias("prev_seq"), F.col("field"), F.col("type").alias("old_type"), F.lit(True).alias("was")).join(steps, ["series", "prev_seq"])
    new = fused.join(steps, FILE).select(*FILE, "prev_seq", "field", F.col("type").alias("new_type"), F.lit(True).alias("is"))
    both = materialize(old.join(new, [*FILE, "prev_seq", "field"], "full_outer"), "drift-steps")
    gone = both.where("`is` is null").select(*FILE, "prev_seq", F.col("field").alias("old_field"), "old_type")
    came = both.where("was is null").select(*FILE, "prev_seq", F.col("field").alias("new_field"), "new_type")
    # Only where fields go and come together can one be the other's new name, and only values of these two kinds tell.
    step = [*FILE, "prev_seq"]
    mixed = gone.select(*step).distinct().join(came.select(*step).distinct(), step)
    gone_in, came_in = gone.join(mixed, step, "left_semi"), came.join(mixed, step, "left_semi")
    wanted = materialize(gone_in.select("series", F.col("prev_seq").alias("file_seq"), F.col("old_field").alias("field")).unionByName(came_in.select(*FILE, F.col("new_field").alias("field"))).distinct(), "drift-wanted")
    text = materialize(texts(wanted).where("value_text is not null").join(wanted, [*FILE, "field"], "left_semi").select(*FILE, "field", "value_text").distinct(), "drift-texts")
    gone_text = gone_in.join(text.select("series", F.col("file_seq").alias("prev_seq"), F.col("field").alias("old_field"), "value_text"), ["series", "prev_seq", "old_field"])
    came_text = came_in.drop("prev_seq").join(text.withColumnRenamed("field", "new_field"), [*FILE, "new_field"])
    renamed = materialize(gone_text.join(came_text, [*FILE, "value_text"]).select(*FILE, "old_field", "new_field", "old_type", "new_type").distinct(), "drift-renamed")
    row = lambda df, change, a, b: df.select(*FILE, F.lit(change).alias("change"), a.alias("old_field"), b.alias("new_field"))
    none, a, b = F.lit(""), F.col("old_field"), F.col("new_field")
    parts = (
        row(renamed, "renamed", a, b),
        row(renamed.where("old_type <> new_type"), "retyped", a, b),
        row(gone.join(renamed, [*FILE, "old_field"], "left_anti"), "removed", a, none),
        row(came.join(renamed, [*FILE, "new_field"], "left_anti"), "added", none, b),
        row(both.where("was and `is` and old_type <> new_type"), "retyped", F.col("field"), F.col("field")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def canonical_names(found: DataFrame, fused: DataFrame) -> DataFrame:
    """(field, canonical): the names that renames connect, under the one found in most files.

    Labels spread over the graph of field names by iterated joins; its size is that of the
    schema, not of the data.  Between equally frequent names the first in order holds.
    """
    links = found.where("change = 'renamed'").select(F.col("old_field").alias("a"), F.col("new_field").alias("b")).distinct()
    links = materialize(links.union(links.select("b", "a")).distinct(), "drift-links")
    weight = fused.groupBy("field").agg(F.count("*").alias("files"))
    # The smallest struct is the most frequent name, so a minimum over neighbours elects it.
    labels = materialize(weight.select("field", F.struct((-F.col("files")).alias("rank"), F.col("field").alias("name")).alias("label")), "drift-labels")
    while True:
        near = links.join(labels, links.a == labels.field).groupBy(F.col("b").alias("field")).agg(F.min("label").alias("near"))
        new = materialize(labels.join(near, "field", "left").select("field", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")), "drift-labels")
        forget(labels)
        labels = new.select("field", "label")
        labels._arcspark_path = new._arcspark_path
        if new.where("moved").isEmpty():
            return labels.select("field", F.col("label.name").alias("canonical"))


def records(lines: DataFrame) -> DataFrame:
    """All lines as one consistent long table: a typed branch per tag plus a canonical value.

    field is the canonical name, source_field the name in the file; canonical_type is the
    prevailing type of the canonical field over all files and canonical_value the value
    converted to it as text, null where it can't be converted.
    """
    parsed = materialize(leaves(lines), "drift-leaves")
    values = materialize(distinct_values(parsed), "drift-values")
    fused = materialize(fuse(values), "drift-schema")
    names, rows = counted(canonical_names(changes_of(fused, lambda wanted: values), parsed.select(*FILE, "field").distinct()), "drift-names")
    named = parsed.join(F.broadcast(names) if rows <= 10_000 else names, "field")
    totals = named.groupBy("canonical", "tag").agg(F.count("*").alias("n")).where("tag not in ('null', 'object')")
    order = F.struct(F.col("n"), F.col("tag"))
    kinds = totals.groupBy("canonical").agg(F.max(order)["tag"].alias("canonical_type"))
    text = F.col("value_text")
    value = (
        F.when(F.col("canonical_type") == "integer", F.when(text.rlike(r"^\s*-?\d+\s*$"), F.trim(text)))
        .when(F.col("canonical_type") == "number", F.when(text.rlike(r"^\s*-?\d+(\.\d+)?([eE][-+]?\d+)?\s*$"), F.trim(text)))
        .when(F.col("canonical_type") == "boolean", F.when(F.lower(text).isin("true", "false"), F.lower(text)))
        .when((F.col("canonical_type") == "array") & (F.col("tag") != "array"), F.to_json(F.array(text)))
        .otherwise(text)
    )
    return named.join(F.broadcast(kinds) if rows <= 10_000 else kinds, "canonical", "left").select(
        *FILE, "line_no", "line_id", "entry", F.col("canonical").alias("field"), F.col("field").alias("source_field"), "tag", "string_value", "integer_value", "number_value", "boolean_value", "array_value", "canonical_type", value.alias("canonical_value")
    )


def alternatives(long: DataFrame) -> DataFrame:
    """(field, tag, series, first_file, values): each type a canonical field has in a series, and the file in which it appears."""
    return long.groupBy("field", "tag", "series").agg(F.min("file_seq").alias("first_file"), F.count("*").alias("values"))


def elected(long: DataFrame, fields: dict[str, str]) -> dict[str, str]:
    """fields with each name, any of those that renames connect, replaced by the canonical one; a name not in the data stays."""
    pairs = long.where(F.col("source_field").isin(*fields.values())).select("source_field", "field").distinct().collect()  # at most one row a name
    names = {r["source_field"]: r["field"] for r in pairs}
    return {c: names.get(f, f) for c, f in fields.items()}


def wide(long: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The long table as one row for each record and list entry, with one column for each canonical field.

    fields maps the column's name to the canonical field's name.  A value that stands outside a list holds for all entries below it: it is
    carried down to them, and a place with entries of its own gives no row.
    """
    line = [*FILE, "line_no", "line_id"]
    rows = long.where(F.col("field").isin(*fields.values())).groupBy(*line, "entry").agg(*(F.min(F.when(F.col("field") == f, F.col("canonical_value"))).alias(c) for c, f in fields.items()))
    # The entries of one line are its own content, and small.
    g = rows.groupBy(*line).agg(F.collect_list(F.struct(F.length("entry").alias("depth"), "entry", *fields)).alias("g"))
    above = lambda x, e: (x["entry"] == "") | (x["entry"] == e) | F.startswith(e, F.concat(x["entry"], F.lit(".")))
    each = g.select(*line, "g", F.explode("g").alias("e")).where(~F.exists("g", lambda x: (x["entry"] != F.col("e.entry")) & above(F.struct(F.col("e.entry").alias("entry")), x["entry"])))
    nearest = lambda c: F.array_max(F.filter("g", lambda x: above(x, F.col("e.entry")) & x[c].isNotNull()))[c]
    return each.select(*line, "e.entry", *(nearest(c).alias(c) for c in fields))
