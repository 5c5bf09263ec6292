import json

from hypothesis import given, settings
from hypothesis import strategies as st

from symgraph.operators.packed import SPECIAL, rule, split_packed

from .conftest import rows


def split(spark, values, at=False):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    out = {}
    for i, pos, item in rows(split_packed(df, "id", "v", at)):
        out.setdefault(i, {})[pos] = item
    return [[out[i][p] for p in sorted(out[i])] if i in out else [] for i in range(len(values))]


def test_forms(spark):
    values = [
        '["a(\\"x-y\\")", "b"]',
        '"flag(""m-3"")" | "property"',
        "@a @b(60 * 15), , c;",
        "['build(kind=\\'a;b\\', size=4)','x']",
        '["\\u0001queue","M"]',
        "Mapping[str, X],Y",
        "it's, ok",
        "[]",
        "  @x \r\n@y\n",
        '["review; draft"]',
        "'mails/a, copy.html', \x01typed",
        "a,(b",
        '"open, c',
        "",
        None,
        " ; ,\n",
        "a,a",
    ]
    assert split(spark, values, True) == [
        ['a("x-y")', "b"],
        ['flag("m-3")', "property"],
        ["a", "b(60 * 15)", "c"],
        ["build(kind='a;b', size=4)", "x"],
        ["\x01queue", "M"],
        ["Mapping[str, X]", "Y"],
        ["it's", "ok"],
        [],
        ["x", "y"],
        ["review; draft"],
        ["mails/a, copy.html", "\x01typed"],
        ["a", "(b"],
        ['"open', "c"],
        [],
        [],
        [],
        ["a", "a"],
    ]


def test_empty_table_clashing_columns_and_long_text(spark):
    empty = spark.createDataFrame([], "id string, v string")
    assert rows(split_packed(empty, "id", "v")) == []
    odd = spark.createDataFrame([("k", ",".join("x" * 9 for _ in range(20_000)), 1, 2)], "id string, v string, item int, skeleton int")
    assert split_packed(odd, "id", "v").count() == 20_000
    twice = spark.createDataFrame([(None, "a,b"), (None, "a,b")], "id string, v string")
    assert split_packed(twice, "id", "v").count() == 4  # a null key is a key


def test_round_trips(spark):
    items = ["f(1, 2)", 'say "hi"', "it's", "a;b|c", "x", "[1, [2]]", "back\\slash", "tab\there", "ü, é"]
    packed = [json.dumps(items[i:j]) for i in range(len(items)) for j in range(i + 1, len(items) + 1)]
    want = [items[i:j] for i in range(len(items)) for j in range(i + 1, len(items) + 1)]
    assert split(spark, packed) == want


def plain(s):
    """Items of a text without quotes and brackets, character by character."""
    out, now = [], ""
    for c in s + ",":
        if c in ",;|\r\n":
            if now.strip(" \t"):
                out.append(now.strip(" \t"))
            now = ""
        else:
            now += c
    return out


@given(st.text(alphabet="ab ,;|\n\t_.-", max_size=30))
@settings(max_examples=200, deadline=None)
def test_against_a_character_wise_parser(s):
    import re

    toks = re.findall(r"[^,;|\n\r\t \"'()\[\]{}@\\]+|[ \t]+|[,;|\n\r\t \"'()\[\]{}@\\]", s)
    skeleton = "".join(t if t[0] in SPECIAL and not t.isspace() or t in "\n\r" else " " if t[0] in " \t" else "a" for t in toks)
    assert ["".join(toks[a - 1 : a - 1 + n]) for a, n, _ in rule(skeleton, False)] == plain(s)


def test_rules_that_are_not_broadcast(spark):
    values = ["a, b"] * 40 + ["[]"] * 40 + ['["x", "y(1, 2)"]', " [ , ] ", "[", "x"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    want = rows(split_packed(df, "id", "v"))
    assert rows(split_packed(df, "id", "v", broadcast=0)) == want and len(want) == 84
    plan = split_packed(df, "id", "v", broadcast=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan and "_s" in plan
    assert rows(split_packed(df.where("id < 50"), "id", "v", source=df)) == [r for r in want if r[0] < 50]
