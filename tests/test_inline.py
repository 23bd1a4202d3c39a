"""Inline segments and page lines: nested, unclosed and escaped marks; lists, quotes and code."""

import random
import re

import pytest
from pyspark.sql import functions as F

from graticule.functions import inline


def shown(text):
    """Segments in a short form: b, i, c for the styles."""
    return [(s["text"], "".join(k[0] for k in ("bold", "italic", "code") if s[k])) for s in inline.inline_segments(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("plain", [("plain", "")]),
        ("a *b* c", [("a ", ""), ("b", "i"), (" c", "")]),
        ("**b** _i_ `c`", [("b", "b"), (" ", ""), ("i", "i"), (" ", ""), ("c", "c")]),
        ("***both***", [("both", "bi")]),
        ("**bold *both* bold**", [("bold ", "b"), ("both", "bi"), (" bold", "b")]),
        ("*i **both***", [("i ", "i"), ("both", "bi")]),
        ("**open", [("**open", "")]),
        ("*open **b**", [("*open ", ""), ("b", "b")]),
        ("a * b * c", [("a * b * c", "")]),
        ("snake_case_name and __init__", [("snake_case_name and ", ""), ("init", "b")]),
        (r"\*not\* \`code\`", [("*not* `code`", "")]),
        ("`a *b* c`", [("a *b* c", "c")]),
        ("``a ` b``", [("a ` b", "c")]),
        ("` x `", [("x", "c")]),
        ("`open *i*", [("`open ", ""), ("i", "i")]),
        ("[text](u)", [("text (u)", "")]),
        ("[*t*](<a b> \"title\") x", [("t", "i"), (" (a b) x", "")]),
        ("[a](u_(1)_x)", [("a (u_(1)_x)", "")]),
        ("*a [b* c](u)", [("*a b* c (u)", "")]),
        ("[open *i*", [("[open ", ""), ("i", "i")]),
        ("[a [b](u) c](v)", [("[a b (u) c](v)", "")]),
        ("![alt *x*](i.png)after", [("after", "")]),
        ("[![alt](i.png) t](u)", [(" t (u)", "")]),
        ("a\nb  \nc\\\nd", [("a", ""), ("\n", ""), ("b", ""), ("\n", ""), ("c", ""), ("\n", ""), ("d", "")]),
        ("*foo**bar*", [("foo**bar", "i")]),
        ("**foo*bar**", [("foo*bar", "b")]),
        ("*(**foo**)*", [("(", "i"), ("foo", "bi"), (")", "i")]),
        ("foo***", [("foo***", "")]),
        ("", []),
    ],
)
def test_segments(text, want):
    assert shown(text) == want


def test_marks_are_all_that_goes():
    """On texts of random marks: what is left are the same letters in order, and no text of links is lost."""
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["*", "**", "_", "`", "[", "](u)", "a", "b ", " c", "\\", "!", "\n"]) for _ in range(rng.randrange(1, 14)))
        if "![" in text or "!" in text:
            text = text.replace("!", "")
        said = "".join(s["text"] for s in inline.inline_segments(text))
        assert re.findall("[abc]", said) == re.findall("[abc]", text.replace("(u)", "")), text
        assert re.findall("[abc]", inline.inline_text(text)) == re.findall("[abc]", said)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("# Title\n\ntext *i*\nmore\n\nend", ["text i more", "end"]),
        ("Setext\n===\n\nx\n---\ny", ["y"]),
        ("- a\n- b\n  more\n\n  second\n- c", ["- a", "- b more", "second", "- c"]),
        ("3. x\n4. y\n   - in\n   - in2\n5. z", ["3. x", "4. y", "- in", "- in2", "5. z"]),
        ("1. a\n\n   ```\n   code  1\n\n   code 2\n   ```\n2. b", ["1. a", "code  1", "code 2", "2. b"]),
        ("> quoted\nlazy\n> - item\n>   more\n\nout", ["quoted lazy", "- item more", "out"]),
        ("- a\n+ b", ["- a", "- b"]),
        ("1. a\n1) b", ["1. a", "1. b"]),
        ("    indented code\n\ntext\n    not code", ["indented code", "text not code"]),
        ("```py\nx = 1\n\n- no item\n```\ntext", ["x = 1", "- no item", "text"]),
        ("~~~\nopen\n# still", ["open", "# still"]),
        ("a\n2. not a list\n- a list", ["a 2. not a list", "- a list"]),
        ("***\n- - nested", ["- nested"]),
        ("![only](image.png)\n\n[link](u) text", ["link text"]),
        ("- ![x](y)\n- b", ["- b"]),
        ("", []),
    ],
)
def test_lines(page, want):
    assert inline.page_lines(page) == want


def test_as_columns(spark):
    rows = spark.createDataFrame([("**a** b",), (None,), ("",)], "t string")
    got = [tuple(r) for r in rows.select(inline.segments_of(F.col("t")), inline.lines_of(F.col("t"))).collect()]
    assert [[(s["text"], s["bold"]) for s in g[0]] if g[0] is not None else None for g in got] == [[("a", True), (" b", False)], None, []]
    assert [g[1] for g in got] == [["a b"], None, []]
