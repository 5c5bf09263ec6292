import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symgraph.llm import contexts, docpairs, frequency, grammars, handwritten, jsparse, mixing, queries, tails, tokenize, truncated, unparsable

from ..conftest import DATA, check_sql, rows

# --- all queries --------------------------------------------------------------------------------


@pytest.mark.parametrize("name", list(queries.registry.queries))
def test_query(spark, name):
    fn = queries.registry.queries[name]
    if name in queries.registry.sql:
        check_sql(spark, name, fn, queries.registry.sql[name])
        return
    got = fn(spark, DATA).collect()
    assert len({repr(r) for r in got}) == len(got) > 0


# --- p1 -----------------------------------------------------------------------------------------

CODE = "import logging\n\n\ndef f(x):\n    return [i for i in range(x)]\n" * 8


@pytest.mark.parametrize(
    "path,text,reason",
    [
        ("a/models.py", CODE, None),
        ("a/x_pb2.py", CODE, "suffix"),
        ("a/static/app.min.js", "var a=1;", "suffix"),
        ("a\\node_modules\\x\\index.js", "x()", "vendored"),
        ("a/static/lib/x.js", "x()", "vendored"),
        ("a/vendors/x.py", CODE, None),
        ("a/migrations/0001_init.py", CODE, "migration"),
        ("a/migrations/__init__.py", "", None),
        ("a/vendor/__init__.py", "# pkg\n", None),
        ("a/migration_helpers.py", CODE, None),
        ("package-lock.json", "{}", "lockfile"),
        ("a/x.py", "# Code generated by toolx. DO NOT EDIT.\n" + CODE, "notice"),
        ("a/x.py", "﻿# (c) us\r\n# all rights kept\r\n# @generated\r\n" + CODE, "notice"),
        ("a/x.py", CODE + "# Automatisch erzeugt von w, nicht bearbeiten\n", "notice"),
        ("a/x.py", 'BANNER = "# AUTO-GENERATED FILE, DO NOT EDIT"\n' + CODE, None),
        ("a/x.py", "# Not generated: this table is kept by hand, edit away.\n" + CODE, None),
        ("a/x.py", CODE + "    # do not edit in a loop\n" + CODE, None),
        ("a/x.js", "/*! lib v1.2.3 | (c) the lib authors | MIT */\nfunction f() {}\n", "banner"),
        ("a/x.py", "# Copyright (c) 2023 the crew. Internal use.\n" + CODE, None),
        ("a/x.js", "var a=1,b=[2];function f(a){return a?a+1:null}" * 20, "minified"),
        ("a/x.py", "ROWS = [\n" + "    [1, 22, 333, 4444],\n" * 60 + "]\n", "data"),
        ("a/x.py", "LIMITS = {\n    'small': 10,\n}\n", None),
        ("a/x.css", ".i{background:url(data:image/png;base64," + "A" * 600 + ")}\n", "data"),
    ],
)
def test_handwritten(path, text, reason):
    assert handwritten.verdict(path, text)[0] == reason


@pytest.mark.parametrize(
    "path,text,reason",
    [
        ("a/x.js", "/**\n * @generated\n */\nvar a = 1;\n", "notice"),
        ("a/x.css", "/**\n * Styles of the site.\n * Do not edit, compiled from scss.\n */\n\n.a { b: c }\n", "notice"),
        ("a/x.js", "/*\n  Automatically generated by w.\n*/\nf();\n", "notice"),
        ("a/x.py", '"""Client.\n\nThis file was automatically generated by toolx.\n"""\n' + CODE, "notice"),
        ("a/x.py", "#!/usr/bin/env python\n'''Autogenerated by Thrift. DO NOT EDIT.'''\n" + CODE, "notice"),
        ("a/x.html", "<!--\n  Auto-generated file\n-->\n<p>a</p>\n", "notice"),
        ("a/x.html", "{% comment %}\n@generated\n{% endcomment %}\n<p>a</p>\n", "notice"),
        ("a/x.js", "/*!\n * jQuery v3.6.0\n * Released under the MIT license\n */\nf();\n", "banner"),
        ("a/x.js", "/**\n * Formats automatically generated rows.\n */\nfunction f() {}\n", None),
        ("a/x.py", '"""Reads automatically generated reports. Do not edit rows in a loop."""\n' + CODE, None),
        ("a/x.py", CODE + '"""\n@generated\n"""\n' + CODE, None),
        ("a/x.js", "/*\n * Copyright (c) 2023 the crew.\n * Orders 1.2\n */\nf();\n", None),
        ("a/x.js", "/*\n * Needs node 18.2\n * Licensed under the Apache License\n */\nf();\n", None),
    ],
)
def test_notices_in_whole_headers(path, text, reason):
    assert handwritten.verdict(path, text)[0] == reason


def test_copies_under_long_banners_have_one_fingerprint():
    banner = "/*!\n * jQuery v3.6.0\n * Released under the MIT license\n */\n"
    assert handwritten.fingerprint(banner + CODE) == handwritten.fingerprint(CODE) is not None


def test_copies_and_odd_rows(spark):
    body = "function load(a) {\n  return a.map((x) => x + 1).filter(Boolean);\n}\n// a comment of some length here\n"
    s = "project_id string, file_path string, content string, reason string, mark int"
    content = spark.createDataFrame(
        [("p", "vendor/l.js", body, "", 1), ("p", "vendor/l.js", body, "", 1), ("q", "app/own.js", "/*! l 1.0 | MIT */\r\n" + body.replace("\n", "\r\n") + "\n", "", 1), ("r", "app/bare.js", body, "", 1), ("r", "app/else.js", body + "x();\n", "", 1), ("p", None, "x", "", 1), ("r", "big.py", CODE * 3000, "", 1), ("p", "null.py", None, "", 1)],
        s,
    )
    files = spark.createDataFrame([("p", "vendor/l.js"), ("q", "app/own.js"), ("r", "app/bare.js"), ("r", "app/else.js"), ("r", "x.min.js"), ("p", None), ("r", "big.py"), ("p", "null.py"), ("p", "vendor/l.js")], "project_id string, path string")
    got = rows(handwritten.classify(files, content))
    assert got == [("p", "vendor/l.js", "vendored"), ("q", "app/own.js", "banner"), ("r", "app/bare.js", "copy"), ("r", "x.min.js", "suffix")]
    assert rows(handwritten.classify(files.limit(0), content.limit(0))) == []


# --- p2 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "doc,says",
    [
        (None, False),
        (" \n ", False),
        ('"""..."""', False),
        ("/** — */", False),
        ("TODO: document", False),
        ("TODO: move.\n\nAmounts are in minor units.", True),
        ("# N/A", False),
        ("See base class.", False),
        ("{@inheritDoc}", False),
        ("Inherited.", False),
        ("noqa: D102", False),
        ("pylint: disable=missing-docstring", False),
        ("This is the load order method.", False),
        ("load_order(rows, limit) -> bool", False),
        ("LOAD ORDER", False),
        (":param rows:\n:return:", False),
        (":type rows: str\n:rtype: None", False),
        (":param rows: those whose sums drift", True),
        ("@param {Object} rows", False),
        ("@param {Object} rows - to start from", True),
        ("Args:\n    rows:\n\nReturns:\n", False),
        ("Args:\n    rows: the first day.", True),
        ("Verwirft Entwürfe, die seit 3 Tagen niemand geöffnet hat.", True),
        ("古い行を消す。", True),
        ("Callers must hold the lock.", True),
        ("// Loads orders lazily.", True),
    ],
)
def test_describes(doc, says):
    assert docpairs.describes(doc, "load_order", "(rows, limit) -> bool") is says


def test_pairs_inherit(spark):
    N = "id string, project_id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, docstring string, signature string, updated_at bigint, own int"
    m = lambda i, name, doc, a=1, at=1, kind="Method ": (i, "p", kind, name, i, "a.py", a, a and a + 1, doc, "()", at, 0)
    nodes = spark.createDataFrame(
        [m("A.go", "go", "Ships what is due.", 1), m("B.go", "go", "{@inheritDoc}", 3), m("C.go", "go", None, 5), m("D.go", "go", "TODO", 7), m("E.go", "go", None, 9), m("F.up", "up", "", 1), m("A.go", "go", "old", 1, 0), m("A.go", "go", "Ships what is due.", 1), m("x", "x", "Never a pair.", 1, 1, "class"), m("n", "n", "Counts the days left.", None, 1, "function")],
        N,
    )
    E = "source string, target string, kind string"
    edges = spark.createDataFrame(
        [("B", "A", "extends"), ("C", "B", "EXTENDS "), ("B.go", "A.go", "overrides"), ("D", "C", "extends"), ("E", "F", "extends"), ("F", "E", "extends"), ("A", "A.go", "contains"), ("B", "B.go", "contains"), ("C", "C.go", "contains"), ("D", "D.go", "contains"), ("E", "E.go", "contains"), ("F", "F.up", "contains"), (None, "A", "extends")],
        E,
    )
    content = spark.createDataFrame([("p", "a.py", "\r\n".join(f"line{i}" for i in range(1, 12))), ("p", "a.py", None)], "project_id string, file_path string, content string")
    got = {r[0]: r[1:] for r in rows(docpairs.pairs(nodes, edges, content), "id", "doc_from", "inherited", "code", "docstring")}
    assert set(got) == {"A.go", "B.go", "C.go", "D.go", "n"}
    assert got["A.go"] == ("A.go", False, "line1\nline2", "Ships what is due.")
    assert got["D.go"] == ("A.go", True, "line7\nline8", "Ships what is due.") and got["n"][2] is None
    assert docpairs.pairs(nodes.limit(0), edges.limit(0), content.limit(0)).count() == 0


def test_bases_of_any_height(spark):
    high = 40
    N = "id string, kind string, name string, updated_at bigint"
    nodes = spark.createDataFrame([("C0.go", "method", "go", 1), (f"C{high}.go", "method", "go", 1), ("R0.up", "method", "up", 1)], N)
    links = [(f"C{i}", f"C{i + 1}", "extends") for i in range(high)] + [("R0", "R1", "extends"), ("R1", "R2", "extends"), ("R2", "R0", "extends")]
    edges = spark.createDataFrame([*links, ("C0", "C0.go", "contains"), (f"C{high}", f"C{high}.go", "contains"), ("R0", "R0.up", "contains")], "source string, target string, kind string")
    assert rows(docpairs.overridden(nodes, edges)) == [("C0.go", f"C{high}.go")]


# --- p6 -----------------------------------------------------------------------------------------


def _signed(df):
    from pyspark.sql import functions as F

    return df.select("field", F.col("_delta").alias("sign"), "terms")


def test_counts_by_deltas_equal_a_recount(spark, tmp_path):
    import os

    from symgraph.operators.incremental import VersionedTable

    rnd = random.Random(5)
    T = "field string, id string, terms array<string>"
    before = {("f", f"r{i}"): [rnd.choice("abcde") for _ in range(rnd.randrange(4))] for i in range(60)}
    after = {k: ([rnd.choice("abcdefg")] if rnd.random() < 0.3 else v) for k, v in before.items() if rnd.random() < 0.8} | {("f", f"s{i}"): ["z", None, "z"] for i in range(3)}
    table = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], T)
    source = VersionedTable(spark, f"file://{tmp_path}/s")
    counts = frequency.TermCounts(spark, f"file://{tmp_path}/c", buckets=5)
    source.merge(table(before), ["field", "id"], "terms")
    counts.update({"s": (source, _signed)})
    first = rows(counts.counts())
    source.merge(table(after), ["field", "id"], "terms")

    def dies(df):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        counts.update({"s": (source, dies)})
    assert rows(counts.counts()) == first
    counts.update({"s": (source, _signed)})
    assert counts.update({"s": (source, _signed)}) == counts.table.version() == 2
    again = {}
    for (f, _), ts in after.items():
        ts = [t for t in ts if t]
        for t in {*ts, *([None] if ts else [])}:
            n, m = again.get((f, t), (0, 0))
            again[f, t] = (n + ts.count(t), m + 1)
    assert {r[:2]: r[2:] for r in rows(counts.counts())} == again and len(again) > 3
    # a change of one term leaves the other folders' files as they are
    held = {os.path.basename(f) for f in counts.table.files()}
    source.merge(spark.createDataFrame([("g", "new", ["only"])], T), ["field", "id"], "terms", full=False)
    counts.update({"s": (source, _signed)})
    now = {os.path.basename(f) for f in counts.table.files()}
    assert len(held - now) <= 2 and held & now and ("g", "only", 1, 1) in rows(counts.counts())


def test_marks(spark):
    data = [("f", f"r{i}", ["often"]) for i in range(26)] + [("f", f"q{i}", ["often", "rare"]) for i in range(4)] + [("f", f"m{i}", ["mid"]) for i in range(5)] + [("f", f"x{i}", [f"u{i % 9}"]) for i in range(45)] + [("g", "1", ["both", "both"]), ("f", "n", [None]), ("f", "e", []), ("f", "n2", None)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data, "field string, record_id string, terms array<string>").withColumn("sign", F.lit(1))
    counts = frequency.merge_counts(None, frequency.term_deltas(df))
    got = {(r[0], r[1]): r[2:] for r in rows(frequency.mark(counts), "field", "term", "occurrences", "records", "mark")}
    assert got["f", "often"] == (30, 30, "common") and got["f", "rare"] == (4, 4, "rare") and got["f", "mid"][2] is None and got["g", "both"] == (2, 1, "rare")
    assert frequency.mark(frequency.term_deltas(df.limit(0))).count() == 0


# --- p7 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "language,text,valid",
    [
        ("python", "﻿x = 1\r\n", True),
        ("python", 'S = """\n<<<<<<< HEAD\n"""\n', True),
        ("python", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", False),
        ("python", "def f(:\n", False),
        ("python", "return 1\n", False),
        ("python", "x = 1\x00", False),
        ("python", "(" * 5000, False),
        ("javascript", "export default class { #p = 1; get x() { return /[/]/.test(`a${1}`) } }", True),
        ("javascript", "/*\n<<<<<<< ours\n*/\nf();", True),
        ("javascript", "function f() {", False),
        ("javascript", "const s = 'open", False),
        ("javascript", "import logging\nfrom x import y\n", False),
        ("javascript", "[" * 3000, False),
        ("css", ".a > b::before { content: \"}\"; color: red }\n@media (max-width: 2px) { .b { } }", True),
        ("css", ".a { color: red", False),
        ("css", "/* open", False),
        ("css", ".a { color }", False),
        ("css", "def f():\n    pass\n", False),
        ("css", "@import url(x.css);\n:root { --a: {b:c} }", True),
        ("htmldjango", "{% if a %}{{ a|default:\"{%\" }}{% endif %}", False),
        ("htmldjango", "{% block b %}<p>{# {% for #}</p>{% endblock %}", True),
        ("htmldjango", "{% for x in y %}<p>", False),
        ("htmldjango", "{% comment %}{% if %}{% endcomment %}", True),
        ("htmldjango", "<p>{{ a", False),
        ("htmldjango", "{% if a %}{% endfor %}", False),
        ("htmldjango", "<p>=======\n</p>", True),
        ("htmldjango", "<p>\n=======\n</p>", False),
        ("htmldjango", "import logging\n\n\ndef f():\n    return None\n", False),
    ],
)
def test_grammars(language, text, valid):
    assert (grammars.diagnose(language, text)[0] is None) is valid


def test_wrong_extensions():
    assert grammars.diagnose("css", "import logging\n\n\ndef f():\n    return None\n")[1] == "python"
    assert grammars.diagnose("python", ".a {\n  color: red;\n}\n")[1] == "css"
    assert grammars.diagnose("python", "const f = (a) => {\n  return a;\n};\n")[1] == "javascript"
    assert grammars.diagnose("javascript", "{% load x %}\n<p>a</p>\n")[1] == "htmldjango"
    assert grammars.diagnose("python", "def f(:\n")[1] is None
    assert grammars.diagnose("python", "")[0] is None and grammars.diagnose("css", None)[0] is None


@pytest.mark.parametrize(
    "text,actual",
    [
        ("# <auto-generated> by w </auto-generated>\nimport logging\n\n\ndef f(x):\n    return None\n", "python"),
        ("import logging\n\nROWS = ['<li>a</li>', '<li>b</li>', '<b>c</b>']\n", "python"),
        ("def f(a):\n    return f'{{a}} {a}'\n", "python"),
        ("function f(a) {\n  return `<b>{{ ${a} }}</b>`;\n}\n", "javascript"),
        ("/* <li>a</li> */\n.a {\n  color: red;\n}\n", "css"),
        ("{{ a }}\n", None),
        ("<p>import logging</p>\n<script>\nconst a = 1;\nf(null);\n</script>\n", None),
        ("<style>\n.a {\n  color: red;\n  margin: 0;\n  top: 0;\n}\n</style>\n", None),
        ("{% load x %}\nimport logging\nself None\n", None),
    ],
)
def test_other_languages_with_marks_of_templates(text, actual):
    error, other = grammars.diagnose("htmldjango", text)
    assert other == actual and (error is None) is (actual is None)


SCRIPT = ["a = b ? c : d;", "if (a) { b(); } else c;", "for (const x of y) { z(x); }", "const f = async (a, {b, c: [d]}) => { await g(a); };", "class A extends B { m() { return `t${1}`; } }", "x = /re/g.test(s) / 2;", "switch (a) { case 1: break; default: c(); }", "try { a(); } catch { b(); }"]


@given(st.lists(st.sampled_from(SCRIPT), min_size=1, max_size=6), st.data())
@settings(max_examples=80, deadline=None)
def test_scripts_cut_inside_a_block_fail(parts, data):
    text = "\n".join(parts)
    jsparse.check(text)
    whole = "function outer() {\n" + text + "\n}"
    cut = data.draw(st.integers(1, len(text)))
    with pytest.raises(jsparse.JsError):
        jsparse.check(whole[: 18 + cut])


def test_unparsable_table(spark):
    c = spark.createDataFrame([("p", "a.py", "x = (", 1), ("p", "a.py", "x = (", 1), ("p", "b.PY", "x = 1", 1), ("p", "c.txt", "(", 1), ("p", "d.js", None, 1), ("p", None, "(", 1), ("p", "e.css", "def f():\n    pass\n", 1), ("p", "unknown.py", "(", 1)], "project_id string, file_path string, content string, error int")
    f = spark.createDataFrame([("p", x) for x in ("a.py", "b.PY", "c.txt", "d.js", "e.css", "nocontent.py", None)], "project_id string, path string")
    j = unparsable.parse_all(f, c)
    assert rows(j.where("error IS NOT NULL"), "path", "actual") == [("a.py", None), ("e.css", "python")]
    assert rows(unparsable.rates(j), "language", "files", "invalid", "wrong_extension", "rate") == [("css", 1, 1, 1, 1.0), ("javascript", 1, 0, 0, 0.0), ("python", 2, 1, 0, 0.5)]
    assert unparsable.parse_all(f.limit(0), c.limit(0)).count() == 0


# --- p8 -----------------------------------------------------------------------------------------

PATH = tokenize.tokenizer_path()
WHOLE = tokenize.Encoder(PATH, 1 << 30)
SMALL = {n: tokenize.Encoder(PATH, n) for n in range(1, 10)}


@given(st.text(alphabet=st.one_of(st.sampled_from("ab  '\n\tst1.l\u00a0"), st.characters(exclude_categories=["Cs"])), max_size=80), st.integers(1, 9))
@settings(max_examples=400, deadline=None)
def test_joined_pieces_equal_the_whole(text, leaf):
    want = WHOLE.words.encode_ordinary(text)
    assert SMALL[leaf].encode([text])[0] == (want if text else [])
    assert WHOLE.decode(want) == text


def test_places_of_all_characters():
    """Every character between others of each kind: the places are the tokenizer's."""
    for c in range(0x30000):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b 1{chr(c)}2!{chr(c)}?"
            assert SMALL[1].encode([text])[0] == WHOLE.words.encode_ordinary(text), hex(c)


def test_another_library_agrees():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(tokenize.tokenizer_path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = ["it's  a\n\n test <|endoftext|>", " " * 500 + "x", "日本語 👍", "a" * 900, "words of 12 letters, and more. " * 40]
    assert tokenize.Encoder(PATH).encode([*texts, "", None]) == [other.encode(t, add_special_tokens=False).ids for t in texts] + [[], []]


def test_joins_re_encode_windows_only():
    e = tokenize.Encoder(PATH)
    seen = []
    plain = e.words.encode_ordinary
    e.words = type("W", (), {"encode_ordinary": staticmethod(lambda t: seen.append(len(t)) or plain(t))})
    text = "".join(f"The walker keeps {i} names.\n" for i in range(400))
    assert e.encode([text])[0] == plain(text)
    assert len(seen) > 100 and max(seen) <= tokenize.LEAF and sum(seen) < 1.5 * len(text)


def test_encode_table(spark):
    long = "word 数字 <|endoftext|> it's\n" * 6000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a<|endoftext|>", 0), (4, long, 0), (5, "a" * 40_000, 0)], "doc_id bigint, text string, ids int")
    got = dict(rows(tokenize.encode(df, "doc_id", "text")))
    assert got[1] == [] and got[2] == [] and 50256 not in got[3]
    assert got[4] == WHOLE.words.encode_ordinary(long) and WHOLE.decode(got[5]) == "a" * 40_000
    counts = dict(rows(tokenize.token_counts(df, ["doc_id"], "text")))
    assert counts == {k: len(v) for k, v in got.items()}
    assert tokenize.encode(df.limit(0), "doc_id", "text").count() == 0


# --- p9 -----------------------------------------------------------------------------------------


@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 4)), max_size=5), st.integers(0, 60))
@settings(max_examples=150, deadline=None)
def test_fill_is_the_best(items, budget):
    sizes = dict(items)
    taken = mixing.fill(list(sizes), list(sizes.values()), budget)
    reach = {0}
    for n, c in sizes.items():
        reach = {r + n * k for r in reach for k in range(c + 1)}
    assert all(k <= sizes[n] for n, k in taken.items())
    assert sum(n * k for n, k in taken.items()) == max(r for r in reach if r <= budget)


@pytest.mark.parametrize(
    "lengths,counts,budget",
    [([9000, 9001], [1, 1], 10_000), ([5000, 6000], [2, 1], 10_000), ([5000], [3], 14_999), ([3, 7000, 50_000], [1, 40, 9], 300_000), ([4100, 9999], [400, 300], 1_000_000)],
)
def test_long_documents_fill_the_budget(lengths, counts, budget):
    passes, take = mixing.plan_source(lengths, counts, budget, 1)
    assert passes == 0 and all(k <= c for k, c in zip(take, counts))
    best = max(a * lengths[-1] + b for a in range(counts[-1] + 1) if (b := _rest(lengths[:-1], counts[:-1], budget - a * lengths[-1])) is not None)
    assert sum(n * k for n, k in zip(lengths, take)) == best


def _rest(lengths, counts, budget):
    if budget < 0 or not lengths:
        return None if budget < 0 else 0
    tries = (k * lengths[-1] for k in range(min(counts[-1], budget // lengths[-1]) + 1))
    return max(x + _rest(lengths[:-1], counts[:-1], budget - x) for x in tries)


@pytest.mark.parametrize("scale", [1, 1000])
@pytest.mark.parametrize("lengths,some", [([6000, 10_007], [193, 88]), ([4100, 9999], [251, 97]), ([5000, 7001, 9000], [41, 90, 13])])
def test_a_fill_is_as_good_at_any_size(lengths, some, scale):
    some = [scale * k + 1 for k in some]
    budget = sum(n * k for n, k in zip(lengths, some))  # so these documents fill it
    passes, take = mixing.plan_source(lengths, [400 * scale] * len(lengths), budget, 1)
    assert passes == 0 and all(0 <= k <= 400 * scale for k in take)
    assert sum(n * k for n, k in zip(lengths, take)) == budget


def test_a_fill_of_padded_documents_is_the_best():
    lengths, counts, budget = [7, 100, 5000, *range(1024, 131_073, 1024)], [1] * 3 + [500] * 128, 2_000_000_999
    passes, take = mixing.plan_source(lengths, counts, budget, 1)
    odd = {a + b + c for a in (0, 7) for b in (0, 100) for c in (0, 5000)}
    assert passes == 0 and budget - sum(n * k for n, k in zip(lengths, take)) == min((budget - x) % 1024 for x in odd)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 30), min_size=1, max_size=5), st.sampled_from([1, 1, 2, 3]), st.floats(0, 1), st.sampled_from([1, 16]))
@settings(max_examples=300, deadline=None)
def test_exchange_is_the_best(sizes, unit, part, window):
    lengths, counts = [unit * n for n in sizes], list(sizes.values())
    budget = int(part * sum(n * c for n, c in zip(lengths, counts)))
    taken, missing = [], budget
    for n, c in zip(lengths, counts):
        taken.append(min(c, missing // n))
        missing -= n * taken[-1]
    left = [c - k if n <= budget else 0 for n, c, k in zip(lengths, counts, taken)]
    now = [k + x for k, x in zip(taken, mixing.exchange(lengths, taken, left, missing, window))]
    reach = {0}
    for n, c in zip(lengths, counts):
        reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= budget}
    assert all(0 <= k <= c for k, c in zip(now, counts)) and sum(n * k for n, k in zip(lengths, now)) == max(reach)


def test_mix(spark):
    rnd = random.Random(2)
    docs = [(i, s, rnd.randrange(1, 50)) for i, s in enumerate(["big"] * 300 + ["Small "] * 8 + ["other"] * 20)] + [(900, "big", 0), (901, None, 5), (902, "hot", 7)] + [(1000 + i, "hot", 7) for i in range(400)]
    sized = spark.createDataFrame([*docs, docs[0]], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.1, 3), ("missing", 0.1, 2), ("hot", 0.3, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(sized, targets, window=64)
    assert rows(got) == rows(mixing.mix(sized, targets, window=64))
    total = sum(n for _, s, n in docs if s in ("big", "Small ", "hot"))
    by = {}
    for doc, s, n, k in rows(got):
        by.setdefault(s, []).append((doc, n, k))
    assert set(by) == {"big", "small", "hot"}
    for s, share, cap in (("big", 0.5, 2), ("small", 0.1, 3), ("hot", 0.3, 1)):
        assert max(k for _, _, k in by[s]) <= cap and len({d for d, _, _ in by[s]}) == len(by[s])
        used = sum(n * k for _, n, k in by[s])
        most = min(int(share * total), cap * sum(n for _, x, n in docs if (x or "").strip().lower() == s))
        assert used <= most and most - used <= (6 if s == "hot" else 1)
    shares = {r[0]: r[1:] for r in rows(mixing.shares(got, sized, targets), "source", "mixed_tokens", "reached_share")}
    assert shares["missing"] == (0, 0.0) and abs(sum(v[1] for v in shares.values()) - 1) < 1e-9
    assert mixing.mix(sized.limit(0), targets).count() == 0


# --- p10 ----------------------------------------------------------------------------------------


def corpus():
    rnd = random.Random(9)
    things = ["orders", "tokens", "carts", "menus", "votes"]
    full = [f"The {rnd.choice(things)} importer quietly drops {rnd.randrange(99)} symbols without an owner. Every {rnd.choice(things)} view keeps the longest chain." for _ in range(300)]
    full += [f"Fix {rnd.choice(things)} lookup" for _ in range(60)] + [f"- keep {rnd.choice(things)} names short\n- keep {rnd.choice(things)} ids stable" for _ in range(60)]
    full += [f"The {t} walker skips version 4.{i} on Monday. Otherwise fine, I guess…" for t in things for i in range(8)] + ["Thanks in advance" for _ in range(5)]
    return full


def test_truncated(spark):
    whole = corpus()
    cut = [
        "The orders importer quietly drops 7 symb",
        "The carts importer quietly drops 12 symbols without…",
        "Every menus view keeps the longest (more)",
        "The votes walker skips version 4.",
        "```python\nx = 1",
        "def f(x):\n    return [x for x in range(3) if x\n",
        "function f() {\n  const a = 1;\n  return a;\n",
        "A note (about 12 of ",
        "The tokens importer quietly drops\r\n",
    ]
    odd = [None, "", "  \n", "…", "x" * 30_000, "👍"]
    data = [(i, t, "S") for i, t in enumerate([*whole, *odd])] + [(10_000 + i, t, " s ") for i, t in enumerate(cut)] + [(20_000, cut[0], None)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    judged = truncated.judge(docs)
    found = {r[0] for r in rows(judged.where("reason IS NOT NULL"), "doc_id")}
    assert found == {10_000 + i for i in range(len(cut))} | {20_000}
    rates = {r[0]: r[1:] for r in rows(truncated.rates(docs, judged), "source", "documents", "truncated")}
    assert rates["s"] == (len(whole) + len(odd) + len(cut), len(cut)) and rates[None] == (1, 1)
    assert truncated.judge(docs.limit(0)).count() == 0


def _contexts(toks, i):
    """What the keys of a token stand for, in plain words."""
    one = toks[i - 1][0] if i > 0 else "\n"
    two = toks[i - 2][0] if i > 1 else "\n"
    w = (toks[i][1], toks[i][0])
    return {"k3": (two, one, w), "k4": ("frame", toks[0][0], w) if 2 <= i < contexts.FRAME else None, "k2": (one, w), "k1": w}


def _by_hand(bodies):
    """All tokens with their contexts, whether they go on (or end) and the beginnings of words."""
    seen = {}
    for text in bodies:
        rows = tails.lines(text)
        for n, line in enumerate(rows):
            toks = tails.tokens(line)
            for i, (t, gap) in enumerate(toks):
                if i == len(toks) - 1:
                    if n == len(rows) - 1:
                        continue
                    kind = "e"
                else:
                    kind = "e" if t in contexts.TERMINATORS and (toks[i + 1][1] or toks[i + 1][0] in "\"'`)]}»”’") else "f"
                for slot, c in _contexts(toks, i).items():
                    if c is not None:
                        seen[slot, c, kind] = seen.get((slot, c, kind), 0) + 1
                if t.isalpha():
                    one = toks[i - 1][0] if i > 0 else "\n"
                    for k in range(1, len(t)):
                        for c in (("p2", (one, gap, t[:k]), "p"), ("p1", (gap, t[:k]), "p")):
                            seen[c] = seen.get(c, 0) + 1
    return seen


@given(st.lists(st.text(alphabet="ab1 _é²٣.'\" x日Z)\n", min_size=1, max_size=30), max_size=6), st.integers(6, 40))
@settings(max_examples=150, deadline=None)
def test_contexts_equal_those_by_hand(texts, chunk):
    bodies = [b for t in texts if (b := truncated._plain(t))]
    for b in bodies:
        t = contexts.tokenise(b)
        assert [b[x:y] for x, y in zip(t.start, t.stop)] == [b[m.start(2) if m.group(2) else m.start(3) : m.end()] for line in [b] for m in tails._TOKEN.finditer(line)]
    want = _by_hand(bodies)
    before, contexts.CHUNK = contexts.CHUNK, chunk
    try:
        keys, on, end, begun = contexts.observe(bodies, contexts.Filter(b"\xff" * 4096))
    finally:
        contexts.CHUNK = before
    # keys are hashes: equal counts per kind, in any order, and as many different ones
    got = sorted([("f", n) for n in on.tolist() if n] + [("e", n) for n in end.tolist() if n] + [("p", n) for n in begun.tolist() if n])
    assert got == sorted((k[2], n) for k, n in want.items())


def test_the_filter_of_asked_keys(spark):
    import numpy as np

    rnd = random.Random(3)
    asked = [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(5000)]
    f = contexts.Filter(truncated._filter(spark.createDataFrame([(k,) for k in asked], "key bigint")))
    assert len(f(np.array(asked, np.int64).view(np.uint64))) == 5000
    others = np.array([rnd.randrange(-(1 << 63), 1 << 63) for _ in range(5000)], np.int64).view(np.uint64)
    assert len(f(others)) < 600


def test_a_decoy_between_a_text_and_its_copy(spark):
    texts = ["The fix wor", "The fix works in all cases", "The fix wor (see below) more"] * 3 + ["Some other text."] * 40
    got = {r[0] for r in rows(truncated.prefix_texts(spark.createDataFrame([(t,) for t in texts], "text string")))}
    assert got == {truncated._h("The fix wor")}
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    assert {r[0] for r in rows(truncated.judge(docs).where("reason = 'copy'"), "doc_id")} == {0, 3, 6}


def test_prefix_texts(spark):
    texts = ["abc def", "abc def ghi", "abc", "abc\nnext", "Whole. Next", "Whole.", "mid", "middle", "mid"] + [f"filler {i} end." for i in range(200)]
    got = {r[0] for r in rows(truncated.prefix_texts(spark.createDataFrame([(t,) for t in texts], "text string")))}
    hashes = {t: truncated._h(t) for t in texts}
    assert hashes["abc def"] in got and hashes["mid"] in got and hashes["Whole."] not in got
    assert hashes["abc def ghi"] not in got and hashes["middle"] not in got


def test_prefix_texts_beyond_the_successor(spark):
    deep = ["The walker of " + "x y " * i + "keeps" for i in range(3)]
    cut = ["abc", "La recherche de", "The total of all open orders is", "Die Prüfung der alten Daten nutzt die", "chain", "chain of", "lone"]
    more = ["abc\nnext", "abc def", "La recherche de `A.b` perd 8 noms.", "The total of all open orders is 42 today.", "Die Prüfung der alten Daten nutzt die Tabelle.", "chain of all", "lone"] + [f"lone Z{i:03} filler" for i in range(400)] + ["lone zebra"]
    whole = ["Add index", "Add index on ids", "Sum up", "Done.", "Done. :)"]
    after = ["Add index\n\nThis adds one.", "Add index on ids One of 3 is enough.", "Sum up :)", "Sum up\n\nIt is `a`.", "Sum up `a`", "Done. More", "Done. :) More", "Fine, I guess", "Fine, I guess… More"]
    texts = cut + more + deep + whole + after
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    hashes = {truncated._h(t): t for t in texts}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the ranges are merged into one
        for n in ("1", "7"):  # "lone" and its only telling copy are in different ranges
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {hashes[r[0]] for r in rows(truncated.prefix_texts(df))}
            assert got == set(cut)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_tails():
    assert tails.body("a b … (more) \n") == "a b" and tails.body("I guess…") == "I guess"
    assert tails.body("The `Batch.canc <cut>") == "The `Batch.canc"
    assert tails.left_open("x = 'it\ndef f():\n    return 1\n") is None and tails.left_open("x = 1\ndef f():\n    \"\"\"open\n") == "statement"
    assert tails.left_open("see `a.b") == "quote" and tails.left_open("fine. :)") is None and tails.left_open("a (b)") is None
