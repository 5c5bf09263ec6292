"""Sources of code and history: a checkout's files, version control output, diffs and status."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import predicates as P
from ..session import filesystem

# Folders that a walk does not enter.
SKIPPED = (".git", ".mypy_cache", ".pytest_cache", ".tox", ".venv", "__pycache__", "migrations", "node_modules", "venv")


def ignore_rules(folder: str, text: str) -> list[tuple[str, str, bool, bool]]:
    """The rules of an ignore file in ``folder`` (empty for the root): where they hold, a pattern
    of names or of paths below, whether folders only, whether they take back."""
    out = []
    for line in text.splitlines():
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        back = rule.startswith("!")
        rule = rule[1:] if back else rule.removeprefix("\\")
        only = rule.endswith("/")
        rule = rule.rstrip("/")
        anchored = "/" in rule
        rx = ""
        for part in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]*\]|.", rule.lstrip("/")):
            if part == "**/":
                rx += "(?:.*/)?"
            elif part == "/**":
                rx += "/.*"
            elif part in ("**", "*"):
                rx += ".*" if part == "**" else "[^/]*"
            elif part == "?":
                rx += "[^/]"
            else:
                rx += part.replace("[!", "[^") if len(part) > 1 else re.escape(part)
        out.append((folder, rx if anchored else f"(?:.*/)?{rx}", only, back))
    return out


def is_ignored(path: str, rules: list[tuple[str, str, bool, bool]]) -> bool:
    """Whether the rules leave a file out: of those that match the last holds, and nothing below a
    folder that is left out can be taken back."""
    parts = path.split("/")
    for i in range(1, len(parts) + 1):
        at, whole = "/".join(parts[:i]), i == len(parts)
        left = False
        for folder, rx, only, back in rules:
            if only and whole:
                continue
            below = at if not folder else at[len(folder) + 1 :] if at.startswith(folder + "/") else None
            if below and re.fullmatch(rx, below):
                left = not back
        if left:
            return True
    return False


def _ignore_files(spark: SparkSession, base: str, folders: list[str]) -> list[tuple[str, str, bool, bool]]:
    """The rules of a checkout's ignore files, outer folders first. Spark's own listing hides them."""
    every = {""} | {"/".join(f.split("/")[:i]) for f in folders for i in range(1, f.count("/") + 2) if f}
    fs, path = filesystem(spark, base)
    out = []
    for folder in sorted(every, key=lambda f: (f.count("/") + bool(f), f)):
        at = path("/".join(x for x in (base.rstrip("/"), folder, ".gitignore") if x))
        if fs.exists(at):
            stream = fs.open(at)
            try:
                out += ignore_rules(folder, spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
    return out


def walk(spark: SparkSession, root: str, project_id: str, most_bytes: int = 8 * 1024 * 1024) -> DataFrame:
    """``(project_id, file_path, content, size_bytes, modified_at)`` of a checkout's source files.

    The listing and the reads are distributed. Skipped folders, foreign suffixes and what the
    checkout's own ignore files leave out are filtered by the path.
    """
    base = "file:" + root if "://" not in root and not root.startswith("file:") else root
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/").removeprefix("file:")) + "/", "")
    skip = "(^|/)(" + "|".join(map(re.escape, SKIPPED)) + ")/"
    rows = raw.where(F.col("length") <= most_bytes).select(rel.alias("file_path"), "content", F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("modified_at"))
    rows = rows.where(P.language_of("file_path").isNotNull() & ~F.col("file_path").rlike(skip))
    rules = _ignore_files(spark, base, [r[0] for r in rows.select(F.regexp_replace("file_path", "/?[^/]*$", "")).distinct().collect()])  # folders, not files
    if rules:

        @F.pandas_udf(BooleanType())
        def kept(paths: pd.Series) -> pd.Series:
            return paths.map(lambda p: not is_ignored(p, rules))

        rows = rows.where(kept("file_path"))
    return rows.select(F.lit(project_id).alias("project_id"), "file_path", F.decode("content", "UTF-8").alias("content"), "size_bytes", "modified_at")


#: Lines of a log that are ordered in one task.
_STRETCH = 4096


def with_hash(content: DataFrame) -> DataFrame:
    return content.withColumn("content_hash", P.content_hash("content"))


def parse_log(lines: DataFrame, project_id: str) -> tuple[DataFrame, DataFrame]:
    """``(commits, commit_files)`` from numstat log lines ``(n, value)``.

    A commit's line holds hash, author, epoch seconds and summary between unit separators; the
    lines that follow are ``insertions<TAB>deletions<TAB>path``, ``-`` for binary files. Each
    file takes the last commit line above it: within a stretch of ``_STRETCH`` lines by a window, at
    its beginning from the stretches before, of which one row each is ordered together.
    """
    sep = "\x1f"
    head = F.col("value").contains(sep)
    part = lines.withColumn("_s", F.floor(F.col("n") / _STRETCH).cast("long"))
    own = F.when(head, F.split("value", sep)[0])
    ends = part.groupBy("_s").agg(F.max_by(own, F.when(head, F.col("n"))).alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    rows = part.withColumn("_h", F.last(own, ignorenulls=True).over(Window.partitionBy("_s").orderBy("n"))).join(ends.select("_s", carried.alias("_c")), "_s")
    rows = rows.withColumn("hash", F.coalesce("_h", "_c"))
    part = F.split("value", sep)
    commits = rows.where(head).select(
        F.lit(project_id).alias("project_id"), part[0].alias("commit_hash"), part[1].alias("author"), part[2].cast("long").alias("committed_at"), F.element_at(part, 4).alias("summary")
    )
    cell = F.split("value", "\t")
    number = lambda c: F.when(c == "-", F.lit(0)).otherwise(c.try_cast("long")).cast("long")
    files = rows.where(~head & F.col("value").rlike(r"^(\d+|-)\t(\d+|-)\t")).select(
        F.lit(project_id).alias("project_id"), F.col("hash").alias("commit_hash"), F.element_at(cell, 3).alias("file_path"), number(cell[0]).alias("insertions"), number(cell[1]).alias("deletions")
    )
    return commits, files


def read_blobs(asked: DataFrame) -> DataFrame:
    """``(root, commit_hash, file_path, content)`` of files as they were in a commit.

    ``asked(root, commit_hash, file_path)``; ``root`` is a checkout that all executors see. Requests
    are laid together by checkout and spread within it, and one version control process per
    checkout and batch answers them in turn. What isn't there, or isn't text, has null content.
    """
    spread = F.pmod(F.xxhash64("commit_hash", "file_path"), F.lit(_READERS))
    rows = asked.select("root", "commit_hash", "file_path").where("root IS NOT NULL AND commit_hash IS NOT NULL AND file_path IS NOT NULL").distinct()
    return rows.repartition("root", spread).mapInPandas(_blobs, "root string, commit_hash string, file_path string, content string")


#: Processes that read blobs of one checkout at a time.
_READERS = 16


def _blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for root, some in pdf.groupby("root", sort=False):
            git = subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
            found: list[str | None] = []
            try:
                for commit, path in zip(some["commit_hash"], some["file_path"]):
                    found.append(_blob(git, commit, path))
            finally:
                git.stdin.close()
                git.stdout.close()
                git.wait()
            yield some.assign(content=pd.Series(found, index=some.index, dtype=object))


def _blob(git: subprocess.Popen, commit: str, path: str) -> str | None:
    """One request and its answer, in lock step: no pipe fills up while the other is waited for."""
    if "\n" in path or not re.fullmatch(r"[0-9A-Za-z][\w./-]*", commit):
        return None
    try:
        git.stdin.write(f"{commit}:{path}\n".encode())
        git.stdin.flush()
        head = git.stdout.readline().split()
    except OSError:  # no repository there
        return None
    if len(head) != 3 or not head[2].isdigit():
        return None
    data = git.stdout.read(int(head[2]) + 1)[:-1]
    try:
        return data.decode() if head[1] == b"blob" else None
    except UnicodeDecodeError:
        return None


def parse_diff(lines: DataFrame) -> DataFrame:
    """``(file_path, h_start, h_end)`` of the new side of unified diffs ``(diff, n, value)``.

    The file is the last ``+++ b/`` line above a hunk; a hunk that only removes anchors at its
    line; lines start at 1; deleted files have no hunks.
    """
    w = Window.partitionBy("diff").orderBy("n")
    name = F.when(F.col("value").startswith("+++ "), F.regexp_replace(F.regexp_replace("value", r"^\+\+\+ (b/)?", ""), r"\t.*$", ""))
    rows = lines.withColumn("file_path", F.last(name, ignorenulls=True).over(w)).where(F.col("value").startswith("@@ "))
    start = F.regexp_extract("value", r"\+(\d+)", 1).cast("int")
    count = F.regexp_extract("value", r"\+\d+,(\d+)", 1)
    size = F.when(count == "", 1).otherwise(count.try_cast("int"))
    hunks = rows.where((F.col("file_path") != "/dev/null") & F.col("value").rlike(r"\+\d+")).select("diff", "file_path", F.greatest(start, F.lit(1)).alias("h_start"), size.alias("size"))
    return hunks.select("diff", "file_path", "h_start", (F.col("h_start") + F.greatest(F.col("size") - 1, F.lit(0))).alias("h_end"))


def parse_status(lines: DataFrame) -> DataFrame:
    """``(file_path, state, weight)`` from porcelain status lines: the strongest state per file."""
    code = F.substring("value", 1, 2)
    state = F.when(code == "??", "untracked").when(code.contains("D"), "deleted").when(code.contains("A"), "added").otherwise("modified")
    rank = F.when(state == "untracked", 1).when(state == "deleted", 2).when(state == "added", 3).otherwise(4)
    path = F.regexp_replace(F.expr("substring(value, 4)"), r"^.* -> ", "")
    return lines.where(F.length("value") > 3).select(path.alias("file_path"), F.struct(rank.alias("r"), state.alias("s")).alias("v")).groupBy("file_path").agg(F.max("v").alias("v")).select("file_path", F.col("v.s").alias("state"), F.col("v.r").alias("weight"))
