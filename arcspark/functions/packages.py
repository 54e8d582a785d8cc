"""Package file names, coordinates and fixed-point numbers as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def crate(path: Column) -> Column:
    """struct<name, version> of a '.crate' file name, split at the last hyphen before a digit; null for others."""
    rule = r"(?s)^(.*)-([0-9].*)\.crate$"
    name, version = F.regexp_extract(base_name(path), rule, 1), F.regexp_extract(base_name(path), rule, 2)
    return F.when(version != "", F.struct(name.alias("name"), version.alias("version")))


def wheel(path: Column) -> Column:
    """struct<name, version, build_tag, python_tag, abi_tag, platform_tag> of a '.whl' file name; null for others.

    With 7 parts or more the last three are tags, a part before them that begins with a digit is the
    build tag, and what remains of the name is joined by '_'.
    """
    stem = F.regexp_extract(base_name(path), r"(?s)^(.*)\.whl$", 1)
    p = F.split(stem, "-", -1)
    n = F.size(p)
    built = (n == 6) | ((n > 6) & F.element_at(p, -4).rlike("^[0-9]"))
    version = F.when(built, F.element_at(p, -5)).otherwise(F.element_at(p, -4))
    name = F.array_join(F.slice(p, F.lit(1), F.greatest(n - F.when(built, 5).otherwise(4), F.lit(0))), "_")
    fields = F.struct(name.alias("name"), version.alias("version"), F.when(built, F.element_at(p, -4)).alias("build_tag"), F.element_at(p, -3).alias("python_tag"), F.element_at(p, -2).alias("abi_tag"), F.element_at(p, -1).alias("platform_tag"))
    return F.when(path.endswith(".whl") & (n >= 5), fields)


def sdist(path: Column) -> Column:
    """The same fields of a source archive ('.tar.gz' or '.zip'), split at the last hyphen."""
    stem = F.regexp_extract(base_name(path), r"(?s)^(.*)\.(?:tar\.gz|zip)$", 1)
    rule = r"(?s)^(.*)-([^-]*)$"
    fields = F.struct(F.regexp_extract(stem, rule, 1).alias("name"), F.regexp_extract(stem, rule, 2).alias("version"), F.lit(None).cast("string").alias("build_tag"), F.lit("source").alias("python_tag"), F.lit("none").alias("abi_tag"), F.lit("any").alias("platform_tag"))
    return F.when(stem.contains("-"), fields)


def pypi(path: Column) -> Column:
    return F.coalesce(wheel(path), sdist(path))


def pypi_name(name: Column) -> Column:
    """Lower case, each of '_', '.', '-' as '-'; runs stay as long as they are."""
    return F.translate(F.lower(name), "_.", "--")


def dist_info(name: Column, version: Column) -> Column:
    return F.concat(name, F.lit("-"), version, F.lit(".dist-info"))


def requires_dist(metadata: Column) -> Column:
    """Requirements of a METADATA text, in order."""
    key = "Requires-Dist:"
    lines = F.filter(F.split(metadata, r"\r?\n"), lambda x: x.startswith(key))
    return F.transform(lines, lambda x: F.trim(F.substring(x, len(key) + 1, 1 << 30)))


def maven_file(artifact: Column, version: Column, packaging: Column, classifier: Column) -> Column:
    tail = F.when(F.coalesce(classifier, F.lit("")) != "", F.concat(F.lit("-"), classifier)).otherwise("")
    kind = F.when(F.coalesce(packaging, F.lit("")) != "", packaging).otherwise("jar")
    return F.concat(artifact, F.lit("-"), version, tail, F.lit("."), kind)


def maven_url(group: Column, artifact: Column, version: Column, packaging: Column, classifier: Column, root: str = "https://repo1.maven.org/maven2") -> Column:
    return F.concat_ws("/", F.lit(root), F.replace(group, F.lit("."), F.lit("/")), artifact, version, maven_file(artifact, version, packaging, classifier))


def coordinate(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def matches(path: Column, *suffixes: str) -> Column:
    """Whether a path ends with one of the suffixes; case counts."""
    test = F.lit(False)
    for s in suffixes:
        test = test | path.endswith(s)
    return test


MAVEN, CARGO, PYPI = (".jar", ".war", ".ear", ".pom"), (".crate",), (".whl", ".tar.gz", ".zip")


def table_name(pkg_type: Column, repo: Column, module: Column, index: Column) -> Column:
    """Name of a group's table: 'idx_', three digits of the type, cleaned repository and module, number."""
    clean = lambda c: _or_null(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", "_"), "^_+|_+$", ""))
    number = F.lpad(pkg_type.cast("int").bitwiseAND(F.lit(255)).cast("string"), 3, "0")
    return F.concat_ws("_", F.concat(F.lit("idx_"), number), clean(repo), clean(module), index.cast("string"))


def coord_e7(text: Column) -> Column:
    """Decimal degrees x 10**7 as int; digits beyond the seventh decimal are cut, not rounded."""
    number = text.cast("decimal(20,12)")
    return (F.signum(number.cast("double")) * F.floor(F.abs(number) * 10_000_000).cast("double")).cast("int")


def lenient_long(text: Column) -> Column:
    """A leading '-' and all digits; other characters are passed over."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(digits == "", 0).otherwise(F.when(text.startswith("-"), -1).otherwise(1) * digits.cast("bigint")).cast("bigint")
