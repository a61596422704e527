from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanframe.config import QueryConfig
from gleanframe.functions import code, text
from gleanframe.functions.vectors import tokens_of
from gleanframe.retriever import analyze_queries, sketch_queries


@pytest.fixture
def one(spark):
    """The value of a text expression for one text."""

    def value(make, t):
        return spark.createDataFrame([(t,)], "t string").select(make(F.col("t"))).first()[0]

    return value


def plain_chunks(t: str, limit: int, overlap: int) -> list[str]:
    if limit <= 0 or len(t) <= limit:
        return [t]
    out, window = [], []
    weight = lambda lines: sum(len(x) + 1 for x in lines)
    for line in t.split("\n"):
        if window and weight(window) + len(line) + 1 > limit:
            out.append("\n".join(window))
            keep = 0
            while keep < len(window) and weight(window[len(window) - keep - 1 :]) <= overlap:
                keep += 1
            window = window[len(window) - keep :] if keep else []
        window.append(line)
    return [*out, "\n".join(window)]


def test_normalize_and_clean(one):
    assert one(text.normalize_query, "  a\t b\n\u00a0c ") == "a b c"
    assert one(text.normalize_query, None) == ""
    assert one(text.clean_snippet, "x  \r\ny\t\r\n\n\n\n\nz \n") == "x\ny\n\nz"
    assert one(text.clean_snippet, None) == ""


@pytest.mark.parametrize("limit, overlap", [(200, 40), (50, 0), (30, 29), (0, 5)])
def test_chunks_follow_the_rule(one, limit, overlap):
    t = "\n".join(f"value_{i} = compute({i}) " + "x" * (i % 37) for i in range(60)) + "\n" + "y" * 90
    assert one(lambda c: text.chunk_lines(c, limit, overlap), t) == plain_chunks(t, limit, overlap)


def test_tokens_agree_with_the_worker_side(one):
    for t in ("getUserName(my_var__x, 42) != ٣é", "a_b _c_ __", "", "naïve\u00a0x\x1cy"):
        assert one(text.tokenize, t) == tokens_of(t)
    assert one(lambda c: text.trigrams(c), "ab") == []
    assert one(lambda c: text.trigrams(c), "abc") == ["#ab", "abc", "bc#"]


def test_keywords_and_kinds(spark):
    asked = spark.createDataFrame(
        [("1", "reverse a linked list"), ("2", "numpy.dot()"), ("3", "which files call connect before close"), ("4", "where is `userName` used"), ("5", "hello world"), ("6", None), ("7", "sort Sort SORT my_list")],
        "query_id string, text string",
    )
    found = {r.query_id: r for r in analyze_queries(asked, QueryConfig()).collect()}
    assert [found[k].query_type for k in "123456"] == ["behavioral", "lookup", "structural", "usage", "general", "general"]
    assert found["7"].keywords == ["my_list", "sort"]
    assert found["4"].keywords[0] == "userName"
    assert found["6"].keywords == [] and found["6"].normalized == ""
    off = analyze_queries(asked, QueryConfig(normalize=False, extract_keywords=False, classify_type=False)).where("query_id = '1'").first()
    assert (off.keywords, off.query_type, off.prepared) == ([], "general", "reverse a linked list")


def test_front_load_skips_what_leads(spark):
    asked = spark.createDataFrame([("1", "merge the sorted arrays quickly")], "query_id string, text string")
    assert analyze_queries(asked, QueryConfig(front_load_keywords=True)).first().prepared == "sorted, arrays, quickly. merge the sorted arrays quickly"


def test_sketches(spark):
    asked = spark.createDataFrame([("1", "sort numbers"), ("2", "where is parser used"), ("3", "which class calls save")], "query_id string, text string")
    found = analyze_queries(asked, QueryConfig())
    made = {r.query_id: r.sketch for r in sketch_queries(found).collect()}
    compile(made["1"], "sketch", "exec")
    assert made["1"].startswith("def sort_numbers(sort, numbers):") and "# sort" in made["1"]
    assert "return parser(data)" in made["2"]
    assert "ast.walk(tree)" in made["3"]
    cache = spark.createDataFrame([("sort numbers", "cached")], "key string, sketch string")
    assert {r.query_id: r.sketch for r in sketch_queries(found, cache).collect()}["1"] == "cached"


def test_code_forms():
    a, b = "def f(x):\n    '''doc'''\n    y = x + 1  # one\n    return y", "def g(value):\n    total = value + 1\n    return total"
    assert code.python_form(a) == code.python_form(b) == "def FUNC1(ARG1):\n    VAR1 = ARG1 + 1\n    return VAR1"
    assert code.python_form("def f(:") == ""
    assert code.code_form("let total = price // gone", "javascript") == "VAR1 VAR2 = VAR3"
    assert code.code_form("") == ""
    assert code.identifier_bag("getUserName(my_id)").split()[:4] == ["getUserName", "get", "User", "Name"]
    assert code.identifier_bag("not python { 'inside' outer_name }").split()[0] == "inside"


def test_views_fall_back_to_the_text(spark):
    docs = spark.createDataFrame([("a", "!!!"), ("b", None), ("c", "class A:\n    pass")], "doc_id string, text string")
    found = {r.doc_id: r for r in code.build_views(docs, ["doc_id"]).collect()}
    assert found["a"].ast == "!!!" and found["a"].identifiers == "!!!"
    assert found["b"].raw == "" and found["c"].ast.startswith("class FUNC1")
