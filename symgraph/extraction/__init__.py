"""Source text to symbols, links and pending references.

An extractor is a plain function ``(path, text) -> list of records``, registered per language;
all files of a batch run through it in one pass over the contents (the only place where graph
building needs Python workers). A file that breaks its extractor yields an error record instead
of failing the task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P

Record = dict[str, object]
Extractor = Callable[[str, str], list[Record]]

#: Larger files are not read, as in the reference walk.
MOST_BYTES = 8 * 1024 * 1024
COLUMNS = {
    "record": "string", "kind": "string", "name": "string", "qualified_name": "string", "source": "string", "line": "int", "end_line": "int", "col": "int",
    "signature": "string", "docstring": "string", "decorators": "string", "candidates": "string", "exported": "boolean", "module": "string",
}

_REGISTRY: dict[str, Extractor] = {}


def register(language: str, fn: Extractor | None = None):
    """Make ``fn`` the extractor of a language (also as a decorator)."""
    if fn is None:
        return lambda f: register(language, f)
    _REGISTRY[language] = fn
    return fn


def extractors() -> dict[str, Extractor]:
    from . import css, javascript, python, template

    base = {"python": python.extract, "javascript": javascript.extract, "css": css.extract, "htmldjango": template.extract}
    return {**base, **_REGISTRY}


def extract_text(language: str, path: str, text: str, table: dict[str, Extractor] | None = None) -> list[Record]:
    fn = (table or extractors()).get(language)
    if fn is None:
        return []
    try:
        return fn(path, text.removeprefix("﻿").replace("\r\n", "\n"))
    except Exception as e:  # one broken file must not end the job
        return [{"record": "error", "kind": "error", "name": type(e).__name__, "docstring": str(e)[:500]}]


def _mangled() -> Column:
    # mangled scripts are worthless; mangled style sheets keep their selectors
    return (F.col("language") == "javascript") & (P.is_minified_source("content") | P.is_minified_path("file_path"))


def extract(content: DataFrame, *carried: str) -> DataFrame:
    """Records of every file in ``content(project_id, file_path, content)``.

    Files of unknown languages, above the size limit, and minified scripts give no record; null
    contents neither. Records: node, edge (inside the file), ref, import, event, error.
    ``carried``: text columns of ``content`` that go with each record of their file; then a file
    without any record has one of kind ``skipped`` with the reason, so that it is known as read.
    """
    table = extractors()
    rows = content.where(F.col("content").isNotNull()).withColumn("language", P.language_of("file_path"))
    why = F.when(F.col("language").isNull(), "language").when(F.octet_length("content") > MOST_BYTES, "size").when(_mangled(), "minified")
    rows = rows.withColumn("_why", why)
    if not carried:
        rows = rows.where(F.col("_why").isNull())
    rows = rows.withColumn("content", F.when(F.col("_why").isNull(), F.col("content")))
    names = ["project_id", "file_path", "language", *carried, *COLUMNS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for project, path, language, text, why, *more in zip(*(pdf[c] for c in ("project_id", "file_path", "language", "content", "_why", *carried))):
                found = extract_text(language, path, text, table) if isinstance(text, str) else []
                if carried and not found:
                    found = [{"record": "skipped", "kind": "skipped", "name": why or "empty"}]
                for r in found:
                    row = [project, path, language, *more]
                    for c, kind in COLUMNS.items():
                        v = r.get(c)
                        row.append(json.dumps(v, ensure_ascii=False) if isinstance(v, list) else v)
                    out.append(row)
            frame = pd.DataFrame(out, columns=names)
            for c, kind in COLUMNS.items():
                frame[c] = frame[c].astype({"int": "Int32", "boolean": "boolean"}.get(kind, object))
            yield frame

    schema = "project_id string, file_path string, language string, " + "".join(f"`{c}` string, " for c in carried) + ", ".join(f"{k} {v}" for k, v in COLUMNS.items())
    return rows.select("project_id", "file_path", "language", "content", "_why", *carried).mapInPandas(run, schema)


def node_id(path: str) -> object:
    return F.concat_ws("::", "project_id", path)


def tables(records: DataFrame) -> dict[str, DataFrame]:
    """The records as roles: nodes, edges, refs, import_mappings, events, errors."""
    n = records.where("record = 'node'").select(
        F.concat_ws("::", "project_id", "qualified_name").alias("id"), "project_id", "kind", "name", "qualified_name", "file_path", "language",
        F.col("line").alias("start_line"), "end_line", "docstring", "signature", "decorators", F.coalesce("exported", F.lit(False)).alias("is_exported"),
    )
    e = records.where("record = 'edge'").select(
        F.concat_ws("::", "project_id", "source").alias("source"), F.concat_ws("::", "project_id", "qualified_name").alias("target"), "kind", "line", "col"
    )
    r = records.where("record = 'ref'").select(
        F.xxhash64("project_id", "file_path", "source", "name", "kind", "line", "col").alias("ref_id"), "project_id", F.concat_ws("::", "project_id", "source").alias("from_node_id"),
        F.col("name").alias("reference_name"), F.col("kind").alias("reference_kind"), "line", "col", "file_path", "language", "candidates",
    )
    i = records.where("record = 'import'").select("project_id", "file_path", F.col("name").alias("local_name"), F.col("signature").alias("exported_name"), F.col("module").alias("source"))
    v = records.where("record = 'event'").select("project_id", "file_path", F.col("kind").alias("role"), F.col("name").alias("event_name"), F.col("source").alias("symbol"), "line", "col")
    return {"nodes": n, "edges": e, "refs": r, "import_mappings": i, "events": v, "errors": records.where("record = 'error'")}
