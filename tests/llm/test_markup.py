from __future__ import annotations

import pytest

from lectern.llm.markup import clean_fields, cleaned, found_markup, markup_found

CASES = {
    "": [], "Plain text, 2 * 3 * 4 and a < b > c.": [], "The R&D team spent $5 and then $7 on it.": [], "It was ranked #3 of # 9 entries.": [], "Files are kept in D:\\archive\\labs\\week3 for now.": [],
    "Use the *nix style option --dry-run -v.": [], "C# uses max_row_count and min_row_count.": [], "We test r == v first and r != v later.": [], "About ~27% of the set {s, {v2}} stays.": [], "Tables [3] and [4] in the list, a[3] too.": [], "- 4 -": [], "settles near\n12.06 and stays": [], "AT&T; R & D": [],
    "<p>One</p>": ["html"], "a<BR />b": ["html"], "x <!-- note --> y": ["html"], "one&nbsp;two": ["html"], "R&amp;D &gt; 5": ["html"], "b &lt; 41": ["html"], "<pre><code># x\n**y**</code></pre>": ["html"],
    "# Title\n\ntext": ["markdown"], "Title\n=====\n\ntext": ["markdown"], "a **bold** word": ["markdown"], "see [this](/notes/3)": ["markdown"], "run `x_2()` first": ["markdown"], "* one\n* two": ["markdown"], "1. one\n2. two": ["markdown"], "```\nx = <b>\n```": ["markdown"], "~~~\n== x ==\n~~~": ["markdown"], "> quoted": ["markdown"], "| a | b |\n|---|---|\n| 1 | 2 |": ["markdown"],
    "== Head ==\n\n* one\n* two": ["wiki"], "'''bold''' text": ["wiki"], "see [[page|this]]": ["wiki"], "{{note|unit=3}}": ["wiki"], "{| class=\"t\"\n|-\n| a || b\n|}": ["wiki"], "# First sentence here.\n# Second sentence here.": ["wiki"], "== H ==\n# a\n## b": ["wiki"],
    "\\section{One}": ["latex"], "so \\(x\\) holds": ["latex"], "$$x^2$$": ["latex"], "Hence $\\alpha q \\leq b$.": ["latex"], "\\begin{verbatim}\n<b>x</b> `y`\n\\end{verbatim}": ["latex"], "\\frac{a}{b}": ["latex"], "(see \\ref{eq:3})": ["latex"],
    "== Head ==\nSome <b>bold</b>": ["html", "wiki"], "# Head\n\n\\textbf{x} here": ["latex", "markdown"], "```latex\n\\sqrt{x}\n```": ["latex", "markdown"], "<span class=\"math\">\\vec{u}</span>": ["html", "latex"],
}


@pytest.mark.parametrize("text", list(CASES))
def test_found(text):
    assert found_markup(text) == CASES[text]


def test_null_and_long():
    assert found_markup(None) == [] and cleaned(None) is None
    long = "word " * 200_000
    assert found_markup(long) == [] and cleaned(long) == long.strip() and found_markup(long + "<b>x</b>") == ["html"]


@pytest.mark.parametrize("text,want", [
    ("<h2>Head</h2>\n<p>One&nbsp;<b>two</b></p><ul><li>a</li><li>b</li></ul>", "## Head\n\nOne two\n\n- a\n- b"),
    ("<pre><code>if a &lt; b:\n    swap(a, b)</code></pre>", "```\nif a < b:\n    swap(a, b)\n```"),
    ("== Head ==\n\n# a\n# b\n\nSee [[page|this]] '''now'''. {{x|y=1}}", "# Head\n\n1. a\n2. b\n\nSee this now."),
    ("\\section{Head}\n\\begin{itemize}\n  \\item a\n  \\item b\n\\end{itemize}\n\\[ x^2 \\]", "# Head\n\n- a\n- b\n$$x^2$$"),
    ("\\begin{verbatim}\nx = 1\n\\end{verbatim}", "```\nx = 1\n```"),
    ("Title\n=====\n\n+ a\n+ b\n\nsee [this](/x) and **that** and `code`", "# Title\n\n- a\n- b\n\nsee this and that and code"),
    ("~~~\nx * 2\n~~~", "```\nx * 2\n```"), ("plain a < b", "plain a < b"),
])
def test_cleaned(text, want):
    assert cleaned(text) == want


def test_operator(spark):
    rows = [(1, "<b>x</b>", "\\frac{a}{b}", "h"), (1, "<b>x</b>", None, "h"), (2, None, "", "h"), (3, "plain", "E = m", "h"), (None, "<b>x</b>", None, "h")]
    df = spark.createDataFrame(rows, "id int, text string, latex string, markup string")
    assert sorted(map(tuple, markup_found(df).collect())) == [(1, "latex", "latex"), (1, "text", "html")]
    assert clean_fields(df).count() == 5 and markup_found(df.where("false")).count() == 0


def test_long_and_wrapped_formulas():
    from lectern.llm.markup import DOLLAR

    assert DOLLAR.search("so $" + "a + " * 80 + "b$ holds") and DOLLAR.search("so $a +\nb$ holds")
    assert not DOLLAR.search("pay $5\n\nfor b$ here") and not DOLLAR.search("pay $5\nor $6 here") and not DOLLAR.search("$a\n$ b")
