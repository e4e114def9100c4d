"""Discovery of source files as a DataFrame: include and exclude globs, ignore rules, size and language."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import stats


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: `**/` any folders, `*` and `?` within one, `{a,b}` and `[...]`."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i:]:
            end = glob.index("]", i + 1)
            out, i = out + glob[i : end + 1].replace("[!", "[^"), end + 1
            continue
        if c in "{}":
            depth += (c == "{") - (c == "}")
            out += "(?:" if c == "{" else ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(ignored, pattern) of each line of an ignore file, in order."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line.lstrip("\\") if line.startswith("\\#") or line.startswith("\\!") else line
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = glob_regex(line.lstrip("/"))[1:-1]
        rules.append((not keep, ("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$")))
    return rules


def ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the last rule that matches a path ignores it."""
    out = F.lit(False)
    for yes, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(yes)).otherwise(out)
    return out


def parse_size(text: str) -> int:
    """Bytes of a size such as 1MB or 1.5GB; anything else is an error here, not for each file."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(KB|MB|GB)", text, re.IGNORECASE)
    if not m:
        raise ValueError(f"invalid size: {text}")
    return int(float(m[1]) * 1024 ** (1 + ("KB", "MB", "GB").index(m[2].upper())))


def described(files: DataFrame, languages: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds extension and language to files with path."""
    out = files.withColumn("extension", stats.extension(F.col("path")))
    return out.withColumn("language", stats.detect_language(F.col("extension"), languages))


def selected(files: DataFrame, include: list[str], exclude: list[str], rules: list[tuple[bool, str]] = (), max_bytes: int = 1 << 20) -> DataFrame:
    """Files (path, size, language) that are included, not excluded or ignored, of a known language and not too large."""
    path = F.col("path")
    return files.where(matches_any(path, include) & ~matches_any(path, exclude) & ~ignored(path, list(rules)) & F.col("language").isNotNull() & (F.col("size") <= max_bytes))


def discover(
    spark: SparkSession, root: str, include: list[str], exclude: list[str], max_size: str = "1MB",
    languages: dict[str, list[str]] | None = None, ignore_text: str = ""
) -> DataFrame:
    """path (below root), extension, language, size, last_modified and content of the selected files.

    Path, size and language are tested on the listing; contents are read of what is left."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = F.lit(re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/")
    plain = F.regexp_replace(F.col("path"), r"^\w+:/*", "/")
    files = raw.select(
        F.substring(plain, F.length(prefix) + 1, F.length(plain)).alias("path"), F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"), "content"
    )
    kept = selected(described(files, languages), include, exclude, ignore_rules(ignore_text), parse_size(max_size))
    return kept.withColumn("content", F.decode("content", "UTF-8"))


def sample_files(
    files: DataFrame, most: int = 1000, skipped: tuple[str, ...] = ("node_modules", ".git", "dist", "build", "coverage", "vendor")
) -> DataFrame:
    """A bounded sample of paths outside the skipped folders: the feature of onboarding."""
    return files.where(~F.col("path").rlike("(?:^|/)(?:" + "|".join(map(re.escape, skipped)) + ")/")).limit(most)


def of_languages(files: DataFrame, languages: list[str]) -> DataFrame:
    return files.where(F.col("language").isin(languages))
