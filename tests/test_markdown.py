"""What Markdown shows, construct by construct."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions.markdown import markdown_plain, parts

CASES = [
    ("", []),
    ("plain", ["plain", ""]),
    ("one\ntwo  \nthree", ["one", "two", "three", ""]),
    ("# Head #\n\ntext", ["Head", "", "text", ""]),
    ("####### no heading", ["####### no heading", ""]),
    ("#none\n#\n", ["#none", "", ""]),
    ("Head\n====\nSub\n---\ntext", ["Head", "", "Sub", "", "text", ""]),
    ("a\n\n***\n- - -\n___\nb", ["a", "", "b", ""]),
    ("an *em* b", ["an ", "em", " b", ""]),
    ("a **strong** b", ["a ", "strong", " b", ""]),
    ("**b**", ["", "b", "", ""]),
    ("***both***", ["", "both", "", ""]),
    ("snake_case_name and 2*3*4", ["snake_case_name and 2", "3", "4", ""]),
    ("_a_b_", ["a_b", ""]),
    ("*open and ** more", ["*open and ** more", ""]),
    ("*a **b** c*", ["a ", "b", " c", ""]),
    (r"\*no\* \[x\] \a", [r"*no* [x] \a", ""]),
    ("use `` a`b `` and `x", ["use ", "a`b", " and `x", ""]),
    ("`*a*`", ["*a*", ""]),
    ("[link](http://a.b/c_(d) \"t\") end", ["link", " end", ""]),
    ("[a *b*](<u v>)", ["a ", "b", ""]),
    ("![alt *x*](u.png)", ["alt ", "x", ""]),
    ("[![in](i)](o) [x [y](z)](w)", ["in", " [x ", "y", "](w)", ""]),
    ("[ref][Id] [id][] [id] [none]\n\n[ID]: http://x 'title'", ["ref", " ", "id", " ", "id", " [none]", ""]),
    ("[only]: /x\n", []),
    ("[a](b c d)", ["[a](b c d)", ""]),
    ("<http://x.y> <a@b.c> <b>bold</b>", ["http://x.y", " ", "a@b.c", " ", "bold", ""]),
    ("a &amp; b &copy; &#65; &nope &unknownname;", ["a & b © A &nope &unknownname;", ""]),
    ("```py\ncode *x*\n\n```\nafter", ["code *x*\n\n", "after", ""]),
    ("~~~\nopen", ["open\n"]),
    ("  ```\n  a\n    b\n  ```", ["a\n  b\n"]),
    ("    indented\n\n      more\n\ntext", ["indented\n\n  more\n", "text", ""]),
    ("text\n    still text", ["text", "still text", ""]),
    ("> quote *a*\nlazy\n> > deep\n\nout", ["quote ", "a", "lazy", "", "deep", "", "out", ""]),
    ("- one\n- two\n  - nested\n\n    para\n- three", ["one", "", "two", "", "nested", "", "para", "", "three", ""]),
    ("1. a\n2) b\n\n   c\n10. d", ["a", "", "b", "", "c", "", "d", ""]),
    ("text\n- item\n2. not", ["text", "", "item", "", "not", ""]),
    ("text\n2. not", ["text", "2. not", ""]),
    ("-\n\n  no item content", ["no item content", ""]),
    ("- ```\n  in list\n  ```\n- > q", ["in list\n", "q", ""]),
    ("<div>\nhidden *x*\n</div>\n\nshown", ["shown", ""]),
    ("<!-- a\n\nb --> c\nd", ["d", ""]),
    ("<script>\n\nx\n</script>\nd", ["d", ""]),
    ("a <!-- c --> b", ["a ", " b", ""]),
    ("\ttab code", ["tab code\n"]),
    ("a\r\nb\rc", ["a", "b", "c", ""]),
    ("`a\nb`", ["a b", ""]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    assert parts(text) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t*_`[]()<>!#->=~1.)a&;:\\b\"", max_size=60))
def test_any_text_ends(text):
    shown = "".join(parts(text))
    assert shown.count("b") <= text.count("b") + text.count("&")


@given(st.lists(st.text(alphabet="abc d.", min_size=1, max_size=20).filter(lambda t: t.strip() == t and t[0] in "abc"), min_size=1, max_size=5))
def test_plain_paragraphs_stay(paragraphs):
    assert parts("\n\n".join(paragraphs)) == [x for p in paragraphs for x in (p, "")]


def test_long_and_deep_texts():
    for text in ("*" * 20_000, "[" * 5000, ">" * 3000, "a*" * 5000, "> a\n" + "b\n" * 5000, "> a\nb\n" * 3000, "- a\n" + "b\n" * 5000, "- " * 500):
        assert isinstance(parts(text), list)


def test_column(spark):
    df = spark.createDataFrame([("# A\n\nb *c*",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(markdown_plain(F.col("t"))).collect()] == ["A\n\nb \nc\n", "", None]
