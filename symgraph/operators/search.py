"""Full-text search and ranking over names, documentation and file contents.

The few terms of a query (bounded by :func:`symgraph.functions.arguments.search_terms`) are
counted inside each text's array of words, so no word that isn't asked for is ever a row, and a
text is read once: what is kept of it is its key, its length and its hits. For many queries over
the same texts :func:`postings` is the index, partitioned by term when it is written. BM25 in
closed form with k1 = 1.2 and b = 0.75. Scores end in the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions import predicates as P
from ..functions.arguments import query_tokens, search_terms
from ..functions.porter import stem
from ..session import Scratch

_SPLIT = r"[^\p{L}\p{N}]+"


def postings(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """``(key, term, tf, size)``: terms of letters and digits in lower case, with the text's length."""
    rows = texts.select(*key, _words(text).alias("_t")).withColumn("size", F.size("_t").cast("long"))
    return rows.select(*key, "size", F.explode("_t").alias("term")).groupBy(*key, "term", "size").agg(F.count(F.lit(1)).alias("tf"))


def write_postings(posts: DataFrame, path: str, parts: int = 64) -> None:
    """A persistent index: postings in folders by a hash of the term, so a query reads its terms' folders."""
    posts.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).repartition("part").sortWithinPartitions("term").write.partitionBy("part").mode("overwrite").parquet(path)


def read_postings(posts: DataFrame, terms: list[str], parts: int = 64) -> DataFrame:
    """The postings of ``terms`` from an index: other folders are pruned, other terms pushed down."""
    part = F.array_contains(F.transform(F.array(*[F.lit(t) for t in terms]), lambda t: F.pmod(F.xxhash64(t), F.lit(parts)).cast("int")), F.col("part"))
    return posts.where(part & F.col("term").isin(*terms)).drop("part")


def _stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"term": pdf["term"], "stem": [stem(t) for t in pdf["term"]]})


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda x: x != "")


def _score(found: DataFrame, key: list[str], n: int, every: bool) -> DataFrame:
    """``(key, matched, score)`` from ``found(key, size, hits array<struct<q, tf>>)`` of all texts."""
    scratch = Scratch(found.sparkSession, "search")
    # lengths and hits are read three times, texts once
    found = scratch.keep(scratch.write(found.where(F.col("size") > 0)))
    total = found.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))).scalar()
    hit = found.select(*key, "size", F.explode("hits").alias("h")).select(*key, "size", "h.q", "h.tf")
    # one entry per asked term
    df = hit.groupBy("q").agg(F.count(F.lit(1)).alias("df")).agg(F.map_from_entries(F.collect_list(F.struct("q", "df")))).scalar()
    rows = hit.withColumn("df", df[F.col("q")]).withColumn("_t", total)
    idf = F.log(1 + (F.col("_t.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    k, b = D.BM25_K1, D.BM25_B
    weight = idf * F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("size") / F.col("_t.mean")))
    out = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("matched"), F.sum(weight).alias("score"))
    return out.where(F.col("matched") == n) if every else out


def bm25(texts: DataFrame, key: list[str], text: str, terms: list[str], prefix: bool = False, every: bool = False) -> DataFrame:
    """``(key, matched, score)`` of the texts with any (``every``: all) of the terms.

    ``texts`` has a row per ``key``. ``prefix``: a term matches all words it begins. Texts without
    a word are not counted.
    """
    ask = list(dict.fromkeys(terms))
    if not ask:
        return texts.limit(0).select(*key, F.lit(0).alias("matched"), F.lit(0.0).alias("score"))
    is_hit = (lambda q: lambda x: F.startswith(x, F.lit(q))) if prefix else (lambda q: lambda x: x == F.lit(q))
    hits = F.array(*[F.struct(F.lit(q).alias("q"), F.size(F.filter("_w", is_hit(q))).cast("long").alias("tf")) for q in ask])
    found = texts.select(*key, _words(text).alias("_w")).select(*key, F.size("_w").cast("long").alias("size"), F.filter(hits, lambda h: h["tf"] > 0).alias("hits"))
    return _score(found, key, len(ask), every)


def bm25_stemmed(texts: DataFrame, key: list[str], text: str, stems: list[str]) -> DataFrame:
    """:func:`bm25` by stems. A word and its stem agree but for the stem's last letters, so only
    words that begin like an asked stem leave their text; each distinct one is stemmed once."""
    ask = list(dict.fromkeys(stems))
    if not ask:
        return texts.limit(0).select(*key, F.lit(0).alias("matched"), F.lit(0.0).alias("score"))
    like = lambda x: reduce(Column.__or__, [F.startswith(x, F.lit(q[: max(1, len(q) - 2)])) for q in ask])
    scratch = Scratch(texts.sparkSession, "stems")
    words = texts.select(*key, _words(text).alias("_w")).select(*key, F.size("_w").cast("long").alias("size"), F.filter("_w", like).alias("near"))
    words = scratch.keep(scratch.write(words))
    table = words.select(F.explode("near").alias("term")).distinct().mapInPandas(_stems, "term string, stem string").where(F.col("stem").isin(*ask))
    near = words.select(*key, F.explode("near").alias("term")).join(table, "term").groupBy(*key, F.col("stem").alias("q")).agg(F.count(F.lit(1)).alias("tf"))
    hits = near.groupBy(*key).agg(F.collect_list(F.struct("q", "tf")).alias("hits"))  # at most one entry per asked stem
    none = F.array().cast("array<struct<q:string,tf:bigint>>")
    return _score(words.drop("near").join(hits, key, "left").withColumn("hits", F.coalesce("hits", none)), key, len(ask), False)


def search_nodes(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """``(id, way, score)``: exact names, then name beginnings, then text matches, best first."""
    needle = query.strip().lower()
    text = nodes.select("id", F.concat_ws(" ", "name", "qualified_name", "docstring", "signature").alias("text"))
    found = bm25(text, ["id"], "text", search_terms(query), prefix=True, every=True)
    n = nodes.select("id", "name")
    exact = n.where(F.lower("name") == needle).select("id", F.lit(0).alias("way"), F.lit(0.0).alias("score"))
    ranked = found.join(n, "id").select("id", F.when(F.lower("name").startswith(needle), 1).otherwise(2).alias("way"), "score")
    every = (exact.unionByName(ranked) if not any(c.isspace() for c in query.strip()) else ranked).groupBy("id").agg(F.min("way").alias("way"), F.max("score").alias("score"))
    return every.orderBy("way", F.desc("score"), "id").limit(limit)


def search_text(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Listed search: hand-written source first, definitions first, exact and prefix names first.

    Where nothing matches, definitions whose name contains the query's letters in order (and is
    at most 12 longer), shortest first.
    """
    needle = query.strip()
    found = search_nodes(nodes, query, max(limit, min(max(limit * 4, 64), 200))).select("id")
    named = nodes.where(F.col("name") == needle).select("id")
    hit = nodes.join(found.union(named).distinct(), "id", "left_semi")
    rank = [P.path_penalty("file_path"), P.kind_rank("kind"), F.when(F.lower("name") == needle.lower(), 0).otherwise(1), F.when(F.lower("name").startswith(needle.lower()), 0).otherwise(1)]
    if hit.isEmpty():
        return fuzzy(nodes, needle).limit(limit)
    return hit.orderBy(*rank, *P.listing_order()).limit(limit)


def fuzzy(nodes: DataFrame, needle: str) -> DataFrame:
    import re

    low = needle.lower()
    rx = ".*".join(re.escape(c) for c in low)
    hit = nodes.where(P.is_definition("kind") & (F.length("name") <= len(low) + 12) & F.lower("name").rlike(f"(?s){rx}")) if low else nodes.limit(0)
    return hit.orderBy(F.length("name"), P.path_penalty("file_path"), *P.listing_order())


def file_ranking(nodes: DataFrame, query: str, walk: DataFrame | None = None) -> DataFrame:
    """Files by how they answer a query: compound words in the path, words covered by one name,
    names hit exactly, summed inverse frequency (in thousandths, whole), first place in a walk.

    ``walk(id, place)``. Only files with a match are listed.
    """
    words = query_tokens(query)
    keys = ["project_id", "file_path"]
    if not words:
        return nodes.limit(0).select(*keys)
    name, path, base = F.lower("name"), F.lower("file_path"), F.lower(P.base_name("file_path"))
    has = [F.max((name.contains(w) | base.contains(w)).cast("int")).alias(f"has{i}") for i, w in enumerate(words)]
    covered = F.lit(0)
    for w in words:
        covered = covered + name.contains(w).cast("int")
    exact = [F.max((P.ascii_lower("name") == w).cast("int")).alias(f"is{i}") for i, w in enumerate(words)]
    in_path = F.lit(0)
    for w in words:
        in_path = in_path + (path.contains(w).cast("int") if "_" in w else 0)
    n = nodes.where(F.col("file_path").isNotNull())
    files = n.groupBy(*keys).agg(F.max(in_path).alias("path_coverage"), F.max(covered).alias("name_coverage"), *has, *exact)
    # one row of totals, read as a scalar
    total = files.agg(F.struct(F.count(F.lit(1)).alias("n_files"), *[F.greatest(F.sum(f"has{i}"), F.lit(1)).alias(f"df{i}") for i in range(len(words))]).alias("t"))
    rows = files.withColumn("_t", total.scalar()).select("*", "_t.*").drop("_t")
    weighted = F.lit(0).cast("long")
    names = F.lit(0)
    for i in range(len(words)):
        weighted = weighted + F.when(F.col(f"has{i}") == 1, F.floor(F.col("n_files") * 1000 / F.col(f"df{i}")).cast("long")).otherwise(0)
        names = names + F.col(f"is{i}")
    rows = rows.withColumn("weighted", weighted).withColumn("exact_names", names).where((F.col("weighted") > 0) | (F.col("path_coverage") > 0))
    if walk is not None:
        place = nodes.select("id", *keys).join(walk, "id").groupBy(*keys).agg(F.min("place").alias("place"))
        rows = rows.join(place, keys, "left")
    else:
        rows = rows.withColumn("place", F.lit(None).cast("long"))
    order = [F.desc("path_coverage"), F.desc("name_coverage"), F.desc("exact_names"), F.desc("weighted"), F.asc_nulls_last("place"), *keys]
    return rows.select(*keys, "path_coverage", "name_coverage", "exact_names", "weighted", "place").orderBy(*order)


def document_frequencies(nodes: DataFrame, query: str) -> DataFrame:
    """``(term, files)``: in how many files each query word occurs in a name or the base name."""
    words = query_tokens(query)
    base, name = F.lower(P.base_name("file_path")), F.lower("name")
    hits = F.filter(F.array(*[F.when(name.contains(w) | base.contains(w), F.lit(w)) for w in words]), lambda x: x.isNotNull()) if words else F.array().cast("array<string>")
    rows = nodes.select("project_id", "file_path", F.explode(hits).alias("term")).distinct()
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("files"))


def focused(nodes: DataFrame, named: DataFrame, around: int = 2) -> DataFrame:
    """The named symbols ``(id)`` of each file with their neighbours by line."""
    w = Window.partitionBy("project_id", "file_path").orderBy("start_line", "id")
    marked = nodes.join(named.select("id", F.lit(1).alias("hit")), "id", "left").withColumn("n", F.row_number().over(w))
    near = F.max("hit").over(w.rowsBetween(-around, around))
    return marked.withColumn("near", near).where(F.col("near") == 1).select("id", "project_id", "file_path", F.col("n").alias("position"), (F.col("hit") == 1).alias("named"))


def uncovered(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """The first definitions among ``seeds(id)`` that no test covers."""
    src = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("source_path"))
    covered = edges.join(src, "source").where(P.is_covering("kind", "source_path")).select(F.col("target").alias("id")).distinct()
    checked = nodes.where(F.col("kind").isin("class", "model", "function", "view") & (F.col("name") != "Meta") & ~P.is_dunder("name") & ~P.is_test_path("file_path"))
    return checked.join(seeds.select("id"), "id", "left_semi").join(covered, "id", "left_anti").orderBy(*P.listing_order()).limit(limit)


def explore(nodes: DataFrame, edges: DataFrame, content: DataFrame, query: str, files: int = 10) -> DataFrame:
    """Search, walk and rank: the files that answer a query, best first."""
    from .graph import restart_walk

    found = search_nodes(nodes, query, 30).select("id")
    if found.isEmpty():
        text = nodes.select("id", F.concat_ws(" ", "name", "qualified_name", "docstring", "signature").alias("text"))
        found = bm25(text, ["id"], "text", search_terms(query), prefix=True).orderBy(F.desc("score"), "id").limit(30).select("id")
    best = bm25_stemmed(content, ["project_id", "file_path"], "content", [stem(t) for t in search_terms(query)])
    best = best.orderBy(F.desc("score"), "project_id", "file_path").limit(5)
    by_text = nodes.where(P.is_definition("kind")).join(best, ["project_id", "file_path"], "left_semi").orderBy(*P.listing_order()).limit(30).select("id")
    walk = restart_walk(found.union(by_text).distinct(), edges, nodes)
    head = walk.orderBy(F.desc("seed"), F.desc("rank"), "id").limit(4096)
    place = head.withColumn("place", F.row_number().over(Window.orderBy(F.desc("seed"), F.desc("rank"), "id")).cast("long")).select("id", "place")
    shown = nodes.where(~F.col("kind").isin("file", "module") & (P.path_penalty("file_path") == 0))
    return file_ranking(shown, query, place).limit(files)
