"""Change sets as unified diffs.

The line rule is greedy: where two lines differ, the new line is an addition if the old one comes back sooner in the
new text than the new one does in the old text, else the old line is a deletion.  It is not a shortest diff.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = 3


def line_changes(old: list[str], new: list[str]) -> list[tuple[str, int, int, str]]:
    """(sign, old index, new index, line); sign is ``+``, ``-`` or a blank.  Places of lines are looked up, not searched."""
    places_old, places_new = defaultdict(list), defaultdict(list)
    for k, x in enumerate(old):
        places_old[x].append(k)
    for k, x in enumerate(new):
        places_new[x].append(k)

    def after(places: list[int], at: int) -> float:
        k = bisect.bisect_left(places, at)
        return places[k] if k < len(places) else float("inf")

    out, i, j = [], 0, 0
    while i < len(old) or j < len(new):
        if i < len(old) and j < len(new) and old[i] == new[j]:
            out.append((" ", i, j, old[i]))
            i, j = i + 1, j + 1
        elif j < len(new) and (i >= len(old) or after(places_new.get(old[i], []), j) < after(places_old.get(new[j], []), i)):
            out.append(("+", i, j, new[j]))
            j += 1
        else:
            out.append(("-", i, j, old[i]))
            i += 1
    return out


def hunks(changes: list[tuple[str, int, int, str]]) -> Iterator[str]:
    """Hunks with up to three equal lines before; one ends at the first equal line that no change follows within three."""
    k, n = 0, len(changes)
    while k < n:
        while k < n and changes[k][0] == " ":
            k += 1
        if k == n:
            return
        start = max(0, k - CONTEXT)
        end = k
        while end < n and (changes[end][0] != " " or any(c[0] != " " for c in changes[end + 1 : end + 1 + CONTEXT])):
            end += 1
        end = min(end + 1, n)
        part = changes[start:end]
        minus, plus = sum(c[0] != "+" for c in part), sum(c[0] != "-" for c in part)
        yield f"@@ -{part[0][1] + 1},{minus} +{part[0][2] + 1},{plus} @@\n" + "".join(f"{c[0]}{c[3]}\n" for c in part)
        k = end


def unified(path: str, operation: str, old: str | None, new: str | None) -> tuple[str, int, int]:
    """The diff of one change, additions and deletions."""
    head = f"diff --git a/{path} b/{path}\n"
    if operation == "create":
        lines = (new or "").split("\n")
        return head + f"new file mode 100644\n--- /dev/null\n+++ b/{path}\n@@ -0,0 +1,{len(lines)} @@\n" + "".join(f"+{x}\n" for x in lines), len(lines), 0
    if operation == "delete":
        if old is None:
            return f"File {path} does not exist (nothing to delete)\n", 0, 0
        lines = old.split("\n")
        return head + f"deleted file mode 100644\n--- a/{path}\n+++ /dev/null\n@@ -1,{len(lines)} +0,0 @@\n" + "".join(f"-{x}\n" for x in lines), 0, len(lines)
    body = "".join(hunks(line_changes((old or "").split("\n"), (new or "").split("\n"))))
    rows = [x for x in body.split("\n") if x[:1] in ("+", "-") and x[:3] not in ("+++", "---")]
    plus = sum(x[0] == "+" for x in rows)
    return head + f"--- a/{path}\n+++ b/{path}\n" + body, plus, len(rows) - plus


def diffs(changes: DataFrame, files: DataFrame) -> DataFrame:
    """file_path, operation, diff, additions and deletions of each change against the corpus."""
    joined = changes.join(files.select(F.col("path").alias("file_path"), "content"), "file_path", "left").select("file_path", "operation", "content", "new_content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [unified(*row) for row in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            rest = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *rest], ["file_path", "operation", "diff", "additions", "deletions"])

    return joined.mapInArrow(run, "file_path string, operation string, diff string, additions int, deletions int")


def summary(diffed: DataFrame) -> DataFrame:
    """One row: changes by operation, lines added and deleted."""
    by = lambda x, name: F.count_if(F.col("operation") == x).alias(name)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return diffed.agg(F.count(F.lit(1)).alias("total"), by("update", "modified"), by("create", "created"), by("delete", "deleted"), total("additions"), total("deletions"))
