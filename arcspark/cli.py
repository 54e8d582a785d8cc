"""Command line: compress, decompress, list, verify, extract, manifest."""

from __future__ import annotations

import argparse

from .operators import plugins
from .plans import archive
from .session import build

PLUGINS = {"maven": plugins.maven, "cargo": plugins.cargo, "pypi": plugins.pypi}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="arcspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("compress", "decompress", "list", "verify", "extract", "manifest"):
        s = sub.add_parser(name)
        s.add_argument("--input", "-i", required=True)
        if name in ("compress", "decompress", "extract"):
            s.add_argument("--output", "-o", required=True)
        if name == "compress":
            s.add_argument("--no-skip", action="store_true", help="compress files that are stored otherwise")
            s.add_argument("--plugin", choices=sorted(PLUGINS), action="append", default=None)
            s.add_argument("--repo", default="")
            s.add_argument("--level", type=int, default=19)
        if name == "extract":
            s.add_argument("--repo")
            s.add_argument("--type", type=int)
    a = p.parse_args(argv)
    spark = build(master=None)
    if a.command == "compress":
        chosen = tuple(PLUGINS[n]() for n in (a.plugin or ["maven"]))
        archive.write_dir(spark, a.input, a.output, a.no_skip, chosen, a.repo, level=a.level).show(vertical=True, truncate=False)
        return 0
    own = archive.open(spark, a.input)
    if a.command == "list":
        for r in own.listing().select("line").orderBy("line").toLocalIterator():
            print(r[0])
    elif a.command == "manifest":
        own.manifest().orderBy("pkg_type", "repo").show(1000, truncate=False)
    else:
        report = own.verify() if a.command == "verify" else own.extract_all(a.output, getattr(a, "repo", None), getattr(a, "type", None))
        row = report.first()
        print("\n".join(f"{k}: {v}" for k, v in row.asDict().items()))
        return int(row["corrupt_files"] > 0)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
