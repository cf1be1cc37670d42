"""A tree of files as a DataFrame, with ignore rules compiled to one predicate."""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx

#: Fixed defaults of a scan.
INCLUDE = ("**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.py", "**/*.go", "**/*.java", "**/*.cpp", "**/*.c", "**/*.cs", "**/*.php", "**/*.rb", "**/*.rs")
EXCLUDE = (
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**", "**/coverage/**", "**/.next/**", "**/.nuxt/**", "**/vendor/**",
    "**/__pycache__/**", "**/*.min.js", "**/*.bundle.js",
)
MAX_FILE_SIZE, MAX_FILES = 1024 * 1024, 10_000
LANGUAGES = ("typescript", "javascript", "python", "go")


def glob_regex(glob: str) -> str:
    """A regular expression over paths relative to the root: ``**`` any folders, ``*`` and ``?`` within a name,
    ``{a,b}`` one of several."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "(?:/.*)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(x) for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def ignore_globs(lines: list[str]) -> list[str]:
    """Globs of an ignore file; negations are not understood and stay as literal patterns."""
    out = []
    for line in map(str.strip, lines):
        if line and not line.startswith("#"):
            line = line.removeprefix("/")
            if "**" not in line:
                line = f"**/{line}**" if line.endswith("/") else f"**/{line}"
            out.append(line)
    return out


def all_excludes(root: str, extra: tuple[str, ...] = ()) -> list[str]:
    """Defaults, ``extra`` and the ignore file of the repository around ``root``, without repeats."""
    globs = [*EXCLUDE, *extra]
    folder = os.path.abspath(root)
    while not os.path.exists(os.path.join(folder, ".git")) and folder != os.path.dirname(folder):
        folder = os.path.dirname(folder)
    path = os.path.join(folder, ".gitignore")
    if os.path.exists(os.path.join(folder, ".git")) and os.path.exists(path):
        with open(path, encoding="utf-8", errors="replace") as f:
            globs += ignore_globs(f.read().split("\n"))
    return list(dict.fromkeys(globs))


def any_glob(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    return path.rlike("^(?:" + "|".join(map(glob_regex, globs)) + ")$") if globs else F.lit(False)


def with_metrics(files: DataFrame) -> DataFrame:
    """``files`` (path, relative_path, size, last_modified, content) with language, n_lines, is_test and complexity."""
    return files.withColumns(
        {"language": fx.language(F.col("path")), "n_lines": fx.n_lines(F.col("content")), "is_test": fx.is_test(F.col("path")), "complexity": fx.file_complexity(F.col("content"))}
    )


def _empty_files(found: DataFrame) -> DataFrame:
    """Rows of the files of length 0, which a scan of contents never opens; from the names that the scan listed."""
    names = [(unquote(p),) for p in found.inputFiles()]
    every = found.sparkSession.createDataFrame(names, "path string")
    key = F.regexp_replace("path", r"^([a-z0-9]+):/+", "$1:/")
    rest = every.withColumn("k", key).join(found.select(key.alias("k")), "k", "left_anti")
    return rest.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("bigint").alias("length"))


def _endings(include: tuple[str, ...]) -> str | None:
    """One glob for the names that ``include`` can match, where each of its globs ends in an extension."""
    found = [re.fullmatch(r"(?:.*/)?\*(\.[A-Za-z0-9]+)", g) for g in include]
    return "*{" + ",".join(m[1] for m in found) + "}" if found and all(found) else None


def scan(
    spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] | None = None, max_file_size: int = MAX_FILE_SIZE,
    max_files: int | None = MAX_FILES, languages: tuple[str, ...] = LANGUAGES,
) -> DataFrame:
    """The files of a tree, in the order of their paths up to ``max_files`` (None: all) *before* the language gate.

    Names come first: size, path, order and language are decided on a listing without contents, from which names with
    other endings are left out at once.  Then contents are read of the chosen files alone, whose names the driver gets,
    as it does any listing.
    """
    globs = all_excludes(root) if exclude is None else list(exclude)
    base = os.path.abspath(root) if "://" not in root and not root.startswith("file:") else re.sub(r"^file:/*", "/", root).rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    ending = _endings(include)
    found = (reader.option("pathGlobFilter", ending) if ending else reader).load(_literal(root)).select("path", "modificationTime", "length")
    plain = F.regexp_replace("path", r"^file:/*", "/")
    listed = found.filter(F.col("length") <= max_file_size).unionByName(_empty_files(found)).withColumn("at", plain)
    listed = listed.withColumn("relative_path", F.expr(f"substring(at, {len(base) + 2})"))
    kept = listed.filter(any_glob(F.col("relative_path"), include) & ~any_glob(F.col("relative_path"), globs))
    if max_files is not None:
        kept = kept.orderBy("at").limit(max_files)
    kept = kept.filter(fx.language(F.col("at")).isin(*languages))
    chosen = kept.select("path", "at", "length", "modificationTime").collect()
    filled = [_literal(r["path"]) for r in chosen if r["length"]]
    none = spark.createDataFrame([(r["path"], r["modificationTime"], 0, bytearray()) for r in chosen if not r["length"]], "path string, modificationTime timestamp, length bigint, content binary")
    rows = spark.read.format("binaryFile").load(filled).select("path", "modificationTime", "length", "content").unionByName(none) if filled else none
    rows = rows.withColumn("path", plain)
    read = rows.select("path", F.expr(f"substring(path, {len(base) + 2})").alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), F.decode("content", "UTF-8").alias("content"))
    return with_metrics(read)


def _literal(path: str) -> str:
    """A path whose characters stand for themselves where a reader takes globs."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def write_tree(spark: SparkSession, root: str, rows: list[tuple[str, str]]) -> None:
    """Write a few files (path below ``root``, content) from the driver, to any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = place(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for path, content in rows:
        out = system.create(place(place(root), path))
        out.write(bytearray(content.encode()))
        out.close()


def from_rows(spark: SparkSession, rows: list[tuple[str, str]], root: str = "/") -> DataFrame:
    """A corpus from (path, content) rows."""
    df = spark.createDataFrame(rows, "path string, content string")
    base = len(root.rstrip("/")) + 2
    read = df.select("path", F.expr(f"substring(path, {base})").alias("relative_path"), F.octet_length("content").cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("last_modified"), "content")
    return with_metrics(read)


def test_counts(paths: DataFrame) -> DataFrame:
    """n_tests and n_sources among script files of a listing, five generated folders pruned."""
    pruned = F.col("path").rlike(r"(?:^|/)(?:node_modules|dist|build|coverage|\.git)/")
    script = F.col("path").rlike(r"\.(?:ts|tsx|js|jsx)$")
    name = fx.basename(F.col("path"))
    test = name.contains(".test.") | name.contains(".spec.")
    return paths.filter(script & ~pruned).agg(F.count_if(test).alias("n_tests"), F.count_if(~test).alias("n_sources"))
