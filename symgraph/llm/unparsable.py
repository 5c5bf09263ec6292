"""Source files that do not parse, per file and as rates per project and language.

Method: the languages are ranked by telling tokens, and every file is parsed by all grammars from
the likeliest on. The grammar of its path's extension must accept it; where another one does
instead, the extension is wrong, and a failure in all of them is corruption (truncation, merge
leftovers, damage). The template grammar accepts nearly any text, so there a better ranked language
that accepts it as well decides. The pass runs on the partitions as they are read; only verdicts leave it.

Defined results: empty and blank files, line ends and a leading byte order mark are valid; files
without a content and with another extension are not judged; of several contents of one file one
that fails makes it a case; duplicates count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammars import LANGUAGES, diagnose


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [diagnose(g, c if isinstance(c, str) else None) for g, c in zip(pdf["language"], pdf["content"])]
        out = pdf[["project_id", "path", "language"]].copy()
        out["error"] = [e for e, _ in found]
        out["actual"] = [a for _, a in found]
        yield out


def parse_all(files: DataFrame, content: DataFrame) -> DataFrame:
    """``(project_id, path, language, error, actual)`` of every judged file of ``files``.

    ``error`` is null for a valid file; ``actual`` the language of a wrong extension.
    """
    ext = F.lower(F.regexp_extract("file_path", r"\.([^./\\]+)$", 1))
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]
    texts = content.select("project_id", F.col("file_path").alias("path"), language.alias("language"), "content").where(F.col("language").isNotNull())
    judged = texts.mapInPandas(_judge, "project_id string, path string, language string, error string, actual string")
    judged = judged.groupBy("project_id", "path", "language").agg(F.max("error").alias("error"), F.max("actual").alias("actual"))
    return judged.join(files.select("project_id", "path").distinct(), ["project_id", "path"], "left_semi")


def rates(judged: DataFrame) -> DataFrame:
    """``(project_id, language, files, invalid, wrong_extension, corrupt, rate)``."""
    bad = F.col("error").isNotNull()
    return judged.groupBy("project_id", "language").agg(
        F.count(F.lit(1)).alias("files"),
        F.count(F.when(bad, 1)).alias("invalid"),
        F.count(F.when(bad & F.col("actual").isNotNull(), 1)).alias("wrong_extension"),
        F.count(F.when(bad & F.col("actual").isNull(), 1)).alias("corrupt"),
        F.avg(bad.cast("double")).alias("rate"),
    )
