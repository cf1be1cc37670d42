"""``python -m quillspan.cli PATH``: index a tree, show its statistics and the types that could be taken out."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from .plans import report, tools
from .plans.corpus import open_corpus
from .session import session, ship
from .sinks import apply


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillspan")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--ignore", action="append", default=[], help="patterns to leave out, with commas between them")
    p.add_argument("--mode", choices=("reference", "corrected"), default="reference")
    p.add_argument("--apply", action="store_true", help="write the changes (default: show them)")
    p.add_argument("--dry-run", action="store_true", help="show the changes even with --apply")
    p.add_argument("--types-path", default="src/types", help="where centralized types would go (no definition is centralized)")
    p.add_argument("--include-tests", action="store_true", help="show the ratio of test files to sources too")
    p.add_argument("--format", choices=("markdown", "json"), default="markdown")
    p.add_argument("--output", help="write the report to a file")
    p.add_argument("-v", "--verbose", action="count", default=0, help="log more: warnings, then information, then everything")
    p.add_argument("--skip-type-abstraction", action="store_true")
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(argv)
    logging.basicConfig(level=max(logging.ERROR - 10 * (a.verbose + 1), logging.DEBUG), format="%(levelname)s %(message)s", stream=sys.stderr)
    log = logging.getLogger("quillspan")
    spark = ship(session(a.master))
    from .sources.corpus import all_excludes

    corpus = open_corpus(spark, a.path, a.mode, exclude=tuple(all_excludes(a.path, tuple(x.strip() for y in a.ignore for x in y.split(",") if x.strip()))))
    log.info("indexing %s", a.path)
    parts = {"summary": corpus.stats(), "files": corpus.files.select("relative_path", "language", "size", "complexity").orderBy("relative_path").limit(5)}
    if a.include_tests:
        parts["tests"] = tools.test_ratio(corpus)
    text = report.markdown("Index", parts) if a.format == "markdown" else json.dumps({name: [json.loads(r["value"]) for r in report.as_json(df).collect()] for name, df in parts.items()}, indent=2)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)
    if not a.skip_type_abstraction:
        found = tools.type_abstraction(corpus)
        print(report.table(found["found"].select("type_name", "source_file", "target_file")))
        for path, operation in apply(found["changes"], a.path, dry_run=a.dry_run or not a.apply):
            print(operation, path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
