"""What goes into an index: filters with priorities, change detection, statistics, dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.operators.folds import folded


def judged_files(files: DataFrame, rules: list[str] = ()) -> DataFrame:
    """Files (path, size) with language, included, priority, important and estimated lines."""
    p = F.col("path")
    return files.withColumns(
        {
            "language": P.language(p), "included": P.is_included(p, rules), "priority": P.in_priority_folder(p),
            "important": P.is_important(p), "lines": P.lines_of(F.col("size")),
        }
    )


def corpus_stats(files: DataFrame, by: list[str]) -> DataFrame:
    """Per repository: files, code files, bytes, lines, whether it is large or empty."""
    code = P.is_included(F.col("path"))
    size = F.coalesce(F.sum(F.when(code, F.col("size"))), F.lit(0))
    return files.groupBy(*by).agg(
        F.count("*").alias("files"), F.count_if(code).alias("code_files"), size.cast("long").alias("code_bytes"),
        F.ceil(size / F.lit(float(P.CHARS_PER_LINE))).cast("long").alias("lines"),
    ).withColumns({"is_large": F.col("lines") > P.LARGE_LINES, "is_empty": F.col("code_files") == 0})


def prioritised(files: DataFrame, by: str, most_lines: int = P.LARGE_LINES, rules: list[str] = ()) -> DataFrame:
    """The files that are indexed: all included ones of a repository that isn't large; of a large one those in priority
    folders or important, and if still too many, the ones that fit, important first, a file that doesn't fit being
    passed over.

    Only the files of repositories that still are too large are sorted, for the fold that packs them row by row.
    """
    def too_large(rows: DataFrame, name: str) -> DataFrame:
        lines = F.ceil(F.sum("size") / F.lit(float(P.CHARS_PER_LINE)))
        return rows.join(rows.groupBy(by).agg((lines > most_lines).alias(name)), by)

    j = too_large(judged_files(files, rules).filter("included"), "large")
    j = too_large(j.filter("not large or priority or important"), "still")
    done = j.filter("not (large and still)").select(by, "path", "size", "language")
    later = j.filter("large and still").select(by, "path", F.col("size").cast("long").alias("size"), "language", "lines", (~F.col("important")).alias("later"))

    def start():
        used = 0

        def fits(later, path, size, language, lines):
            """A file that doesn't fit into what is left is passed over."""
            nonlocal used
            if lines is None or used + lines > most_lines:
                return False
            used += lines
            return True

        return fits

    packed = folded(later, by, ["later", "path", "size", "language", "lines"], start, "fits", "boolean").filter("fits")
    return done.unionByName(packed.select(by, "path", "size", "language"))


# What a report says.
NO_CODE = "No indexable code files found in repository"
FIRST_FOLDERS = 5


def filter_report(files: DataFrame, by: str, most_lines: int = P.LARGE_LINES, rules: list[str] = ()) -> DataFrame:
    """One row per repository about its filtering by `prioritised`: files and bytes in all and kept, how many were excluded and
    how many of them for their path, whether it was cut down to priority folders, whether it has no code, warnings."""
    judged = judged_files(files, rules)
    chosen = F.col("included") & (F.col("priority") | F.col("important"))
    lines = lambda test: F.ceil(F.coalesce(F.sum(F.when(test, F.col("size"))), F.lit(0)) / F.lit(float(P.CHARS_PER_LINE)))
    whole = judged.groupBy(by).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.count_if("included").alias("indexable"),
        lines(F.col("included")).alias("lines"), lines(chosen).alias("chosen_lines"),
    )
    kept = prioritised(files, by, most_lines, rules).groupBy(by).agg(F.count("*").alias("kept"), F.sum("size").cast("long").alias("kept_bytes"))
    large = F.col("lines") > most_lines
    folders = ", ".join(P.PRIORITY_FOLDERS[:FIRST_FOLDERS])
    thousands = F.floor(F.col("lines") / 1000 + F.lit(0.5)).cast("long").cast("string")
    cut = F.concat(F.lit("Repository is large (~"), thousands, F.lit(f"k lines). Only priority folders will be indexed: {folders}, etc."))
    packed = F.concat(F.lit("Indexed "), F.col("kept").cast("string"), F.lit(" of "), F.col("indexable").cast("string"), F.lit(" files due to size limit."))
    warnings = F.array_compact(F.array(F.when(F.col("indexable") == 0, F.lit(NO_CODE)), F.when(large, cut), F.when(large & (F.col("chosen_lines") > most_lines), packed)))
    both = whole.join(kept, by, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("kept", "kept_bytes")})
    return both.select(
        by, "files", "bytes", "kept", "kept_bytes", (F.col("files") - F.col("kept")).alias("excluded"), (F.col("files") - F.col("indexable")).alias("filtered"),
        large.alias("is_prioritised"), (F.col("indexable") == 0).alias("is_empty"), warnings.alias("warnings"),
    )


def excluded(files: DataFrame, by: str, most_lines: int = P.LARGE_LINES, rules: list[str] = ()) -> DataFrame:
    """(by, path, size, reason) of the files that `prioritised` leaves out: ignored, binary, folder, pattern or language for
    their path, else size. Paths are unique in a repository."""
    p = F.col("path")
    tests = [("binary", P.is_binary(p)), ("folder", P.in_excluded_dir(p)), ("pattern", P.is_excluded(p)), ("ignored", P.is_ignored(p, list(rules))), ("language", ~P.is_code(p))]
    reason = F.lit("size")
    for name, test in reversed(tests):
        reason = F.when(test, name).otherwise(reason)
    return files.join(prioritised(files, by, most_lines, rules).select(by, "path"), [by, "path"], "left_anti").select(by, "path", "size", reason.alias("reason"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", sha: str = "sha") -> DataFrame:
    """(key, change): added, modified or deleted; unchanged rows are left out."""
    o = old.select(key, F.col(sha).alias("_old"))
    n = new.select(key, F.col(sha).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    )
    return o.join(n, key, "full_outer").withColumn("change", change).filter("change is not null").select(key, "change")


# How each language names what it depends on.
DEPENDENCIES = {
    "typescript": [r"""import\s+.*?from\s+['"]([^'"]+)['"]""", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""],
    "javascript": [r"""import\s+.*?from\s+['"]([^'"]+)['"]""", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""],
    "python": [r"(?:from\s+(\S+)\s+)?import\s+(\S+)"],
    "go": [r"""import\s+(?:\(\s*)?["']([^"']+)["']"""],
}


def dependencies(content: Column, language: Column) -> Column:
    """Distinct names in order of their first mention, by kind of statement; a module named after `from` goes before
    what is imported of it."""
    none = F.array().cast("array<string>")
    out = none
    for name, patterns in DEPENDENCIES.items():
        of = lambda p, i: F.regexp_extract_all(content, F.lit(p), i)
        found = [F.zip_with(of(p, 1), of(p, 2), lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)) if p.startswith("(?:from") else of(p, 1) for p in patterns]
        out = F.when(language == name, F.array_distinct(F.concat(*found))).otherwise(out)
    return F.coalesce(out, none)


def repo_stats(chunks: DataFrame, by: list[str], path: str) -> DataFrame:
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.countDistinct(path).alias("files"))


def one_hop(chunks: DataFrame, found: DataFrame, path: str, deps: str) -> DataFrame:
    """Paths that the found chunks depend on and that the index has."""
    wanted = found.select(F.explode(deps).alias("dep")).distinct()
    have = chunks.select(path).distinct()
    return have.join(wanted, F.col(path) == F.col("dep"), "left_semi")
