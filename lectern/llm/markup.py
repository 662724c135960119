"""Markup residue: which markup a text holds, and the text without it.

A text is lexed per markup. Code is taken out first, so that what it holds counts for nothing. Constructs that only one
markup writes decide which language a text is written in; constructs that several write the same way (lists by stars,
lines that begin with number signs) count for that language alone. Clean text keeps headings, lists, code and formulas
in one plain notation: '# ' headings, '- ' and '1. ' lists, fenced code, formulas between dollar signs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names that count as HTML, fixed values.
TAGS = (
    "a abbr article aside b big blockquote body br button caption center cite code col dd del details div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd "
    "label li link main mark meta nav ol option p pre q s samp script section select small span strike strong style sub summary sup table tbody td textarea tfoot th thead time title tr tt u ul var video"
).split()

TAG = re.compile(r"</?(?:" + "|".join(sorted(TAGS, key=len, reverse=True)) + r")(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=`]+))?)*\s*/?>", re.I)
COMMENT = re.compile(r"<!--.*?-->", re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
FENCE = re.compile(r"^[ ]{0,3}(`{3,}|~{3,})[ \t]*([\w+#.-]*)[^\n`]*\n(.*?)(?:^[ ]{0,3}\1[`~]*[ \t]*$|\Z)", re.S | re.M)
VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted)\}(.*?)\\end\{\1\}", re.S)
PRE = re.compile(r"<pre\b[^>]*>(.*?)</pre\s*>", re.S | re.I)
INLINE_CODE = re.compile(r"(?<![`\\])(`+)(?!`)([^\n]*?[^`\n])\1(?!`)")
DRIVE_PATH = re.compile(r"\b[A-Za-z]:(?:\\[\w.$~-]+)+\\?|\\\\[\w.-]+(?:\\[\w.$~-]+)+")
COMMAND = re.compile(r"(?<![\\\w])\\(?:begin|end)\{[A-Za-z]+\*?\}|(?<![\\])\\[A-Za-z]{2,}\*?(?![A-Za-z])")
DISPLAY = re.compile(r"\$\$(?=[^$]*\S)[^$]+\$\$|(?<!\\)\\\[.+?\\\]|(?<!\\)\\\(.+?\\\)", re.S)
DOLLAR = re.compile(r"(?<![\\$\w])\$(?=\S)([^$\n]++(?:\n(?![ \t]*\n)[^$\n]++)*+)(?<=[^\s\\])\$(?![\d$\w])")
BOLD = re.compile(r"(?<![*\w\\])\*\*(?=[^\s*])[^*\n]*?[^\s*]\*\*(?![*\w])|(?<![\w\\])__(?=[^\s_])[^_\n]*?[^\s_]__(?!\w)|~~(?=\S)[^~\n]+?\S~~")
LINK = re.compile(r"!?\[[^\]\n]*\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)|^\[[^\]\n]+\]:\s+\S+|\[[^\]\n]+\]\[[^\]\n]+\]", re.M)
TABLE_RULE = re.compile(r"^\s*\|?[ ]*:?-{3,}:?[ ]*(?:\|[ ]*:?-{3,}:?[ ]*)+\|?\s*$", re.M)
SETEXT = re.compile(r"^(?=[^\n]*[A-Za-z])([^\n|#>=*+-][^\n]*)\n(=+|-{3,})[ \t]*$", re.M)
QUOTE = re.compile(r"^[ ]{0,3}> ?\S", re.M)
ATX = re.compile(r"^#{1,6} +(?=[A-Za-z])[^\n]*$", re.M)
BULLET = re.compile(r"^[ ]{0,8}([*+-]) +(?=\S)(?!\d+ -\s*$)[^\n]*$", re.M)
ORDERED = re.compile(r"^[ ]{0,8}(\d{1,3})[.)] +\S[^\n]*$", re.M)
WIKI_HEAD = re.compile(r"^(={1,6}) *[^=\n]+? *\1[ \t]*$", re.M)
WIKI_LINK = re.compile(r"\[\[[^\[\]\n]+\]\]|\[https?://[^\s\]]+(?: [^\]\n]*)?\]")
WIKI_TEMPLATE = re.compile(r"\{\{[^{}\n\\]+\}\}")
WIKI_QUOTES = re.compile(r"(?<!['\w`])('{2,5})(?=[^'\s])[^'\n]*(?:'[^'\n]+)*\1(?!')")
WIKI_TABLE = re.compile(r"^\{\|[^\n]*$|^\|\}[ \t]*$|^\|-+[ \t]*$", re.M)
WIKI_LIST = re.compile(r"^(?:[*#]{2,}|[#;:]) *(?=[A-Za-z\[{'])[^\n]*$", re.M)


def _blank(found: re.Match) -> str:
    return "\n" * found[0].count("\n") or " "


def _runs(matches: Iterator[re.Match], text: str) -> int:
    """Length of the longest run of matches on adjacent lines."""
    best, run, last = 0, 0, -2
    for m in matches:
        line = text.count("\n", 0, m.start())
        run = run + 1 if line == last + 1 else 1
        best, last = max(best, run), line
    return best


def found_markup(text: str | None) -> list[str]:
    """The markups of which the text holds at least one construct, in the order html, latex, markdown, wiki.

    A pattern is tried only where the text holds the signs it can't do without.
    """
    if not text:
        return []
    out = set()
    rest = text.replace("\r\n", "\n")
    if "<" in rest and PRE.search(rest):
        out.add("html")
        rest = PRE.sub(_blank, rest)
    if "\\begin{" in rest and VERBATIM.search(rest):
        out.add("latex")
        rest = VERBATIM.sub(_blank, rest)
    if "```" in rest or "~~~" in rest:
        fences = list(FENCE.finditer(rest))
        if fences:
            out.add("markdown")
            if any(f[2].lower() in ("latex", "tex", "math") and _is_latex(f[3]) for f in fences):
                out.add("latex")
            rest = FENCE.sub(_blank, rest)
    if "`" in rest and INLINE_CODE.search(rest) and not re.search(r"``[^`\n]+''", rest):
        out.add("markdown")
        rest = INLINE_CODE.sub(" ", rest)
    if "$" in rest or "\\" in rest:
        if _is_latex(rest):
            out.add("latex")
        rest = DISPLAY.sub(_blank, DOLLAR.sub(_blank, rest))
    if "<" in rest:
        if COMMENT.search(rest) or TAG.search(rest):
            out.add("html")
        rest = COMMENT.sub(_blank, rest)
    if "&" in rest and any(_is_entity(e[0]) for e in ENTITY.finditer(rest)):
        out.add("html")
    bracket, bars, equals = "[" in rest, "|" in rest, "=" in rest
    if equals and WIKI_HEAD.search(rest) or bracket and WIKI_LINK.search(rest) or "{{" in rest and WIKI_TEMPLATE.search(rest) or "''" in rest and WIKI_QUOTES.search(rest) or bars and len(WIKI_TABLE.findall(rest)) > 1:
        out.add("wiki")
    emphasis = "**" in rest or "__" in rest or "~~" in rest
    underlined = "\n=" in rest or "\n---" in rest
    if emphasis and BOLD.search(rest) or bracket and LINK.search(WIKI_LINK.sub(" ", rest)) or "---" in rest and bars and TABLE_RULE.search(rest) or underlined and SETEXT.search(rest) or ">" in rest and QUOTE.search(rest):
        out.add("markdown")
    starts = {line[:1] for line in (x.lstrip(" ") for x in rest.split("\n"))}
    if "wiki" not in out:
        shared = _shared(rest, starts)
        if shared == "wiki" and "markdown" not in out:
            out.add("wiki")
        elif shared:
            out.add("markdown")
    elif starts & {"+", "-"} and any(m[1] in "+-" for m in BULLET.finditer(rest)) and _runs((m for m in BULLET.finditer(rest) if m[1] in "+-"), rest) > 1:
        out.add("markdown")
    return sorted(out)


def _is_entity(entity: str) -> bool:
    return entity[1] == "#" or entity[1:] in html5


def _is_latex(text: str) -> bool:
    rest = DRIVE_PATH.sub(" ", text)
    return bool(COMMAND.search(rest) or DISPLAY.search(rest) or DOLLAR.search(rest))


def _shared(text: str, starts: set[str]) -> str:
    """What constructs that Markdown and wiki text share speak for: 'wiki', 'markdown' or nothing. ``starts`` are the
    signs with which its lines begin."""
    if starts & set("*#;:"):
        marks = list(WIKI_LIST.finditer(text))
        sentence = [m for m in marks if m[0].startswith("#") and m[0].rstrip().endswith((".", "?", "!", ";"))]
        if any(m[0].startswith("**") and m[0][2:3] == " " for m in marks) or _runs(iter(sentence), text) > 1:
            return "wiki"
        if any(not m[0].rstrip().endswith((".", ",", ";")) for m in ATX.finditer(text)):
            return "markdown"
    if starts & set("*+-") and _runs(BULLET.finditer(text), text) > 1:
        return "markdown"
    if any(c.isdigit() for c in starts):
        numbers = [int(m[1]) for m in ORDERED.finditer(text)]
        if _runs(ORDERED.finditer(text), text) > 1 and numbers[0] == 1 and numbers[1] in (1, 2):
            return "markdown"
    return ""


class _Html(HTMLParser):
    """Plain notation of HTML; what isn't a tag passes through."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.code = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("p", "div", "table", "blockquote", "section"):
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("\n")
        elif re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "pre":
            self.code += 1
            self.out.append("\n\n```\n")
        elif tag == "tr":
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "sub":
            self.out.append("_")
        elif tag == "sup":
            self.out.append("^")

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("p", "div", "table", "blockquote", "section") or re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n\n" if not self.lists else "\n")
        elif tag == "pre" and self.code:
            self.code -= 1
            self.out.append("\n```\n\n")

    def handle_data(self, data: str) -> None:
        self.out.append(data)

    def handle_entityref(self, name: str) -> None:
        whole = f"&{name};"
        self.out.append(html.unescape(whole).replace("\xa0", " ") if _is_entity(whole) else f"&{name}")

    def handle_charref(self, name: str) -> None:
        self.out.append(html.unescape(f"&#{name};"))

    def unknown_decl(self, data: str) -> None:
        self.out.append(data)


def _from_html(text: str) -> str:
    held: list[str] = []

    def keep(m: re.Match) -> str:  # a sign that begins no known tag is content
        held.append(m[0])
        return f"\ue000{len(held) - 1}\ue001"

    lexer = _Html()
    lexer.feed(re.sub(r"<(?!/?(?:" + "|".join(TAGS) + r")\b[^<>]*>|!--)", keep, text, flags=re.I))
    lexer.close()
    return re.sub("\ue000(\\d+)\ue001", lambda m: held[int(m[1])], "".join(lexer.out))


def _from_latex(text: str) -> str:
    text = VERBATIM.sub(lambda m: f"\n```\n{m[2].strip(chr(10))}\n```\n", text)
    pieces = re.split(r"(```\n.*?\n```)", text, flags=re.S)
    for k in range(0, len(pieces), 2):
        t = pieces[k]
        t = re.sub(r"\\begin\{(equation|align|gather|displaymath|eqnarray|multline)\*?\}\s*(.*?)\s*\\end\{\1\*?\}", lambda m: f"$${m[2]}$$", t, flags=re.S)
        t = re.sub(r"(?<!\\)\\\[\s*(.+?)\s*\\\]", r"$$\1$$", t, flags=re.S)
        t = re.sub(r"(?<!\\)\\\(\s*(.+?)\s*\\\)", r"$\1$", t, flags=re.S)
        for depth, name in ((1, "section"), (2, "subsection"), (3, "subsubsection"), (4, "paragraph")):
            t = re.sub(rf"\\{name}\*?\{{([^{{}}]*)\}}", lambda m, d=depth: f"\n{'#' * d} {m[1]}\n", t)
        lines, kinds = [], []
        for line in t.split("\n"):
            if m := re.match(r"\s*\\begin\{(itemize|enumerate|description)\}", line):
                kinds.append([m[1], 0])
            elif re.match(r"\s*\\end\{(itemize|enumerate|description)\}", line):
                kinds = kinds[:-1]
            elif kinds and (m := re.match(r"\s*\\item(?:\[[^\]]*\])?\s*(.*)", line)):
                kinds[-1][1] += 1
                lines.append("  " * (len(kinds) - 1) + (f"{kinds[-1][1]}. " if kinds[-1][0] == "enumerate" else "- ") + m[1])
            else:
                lines.append(line)
        parts = re.split(r"(\$\$.+?\$\$|(?<![\\$\w])\$(?=\S)[^$\n]+?(?<=\S)\$(?![\d$\w])|[A-Za-z]:(?:\\[\w.$~-]+)+)", "\n".join(lines), flags=re.S)
        for i in range(0, len(parts), 2):
            p = re.sub(r"[ ]*\((?:see|cf\.) \\(?:ref|eqref|cite)\{[^{}]*\}\)|\\(?:label|ref|eqref|cite|index)\{[^{}]*\}", "", parts[i])
            for _ in range(4):
                p = re.sub(r"\\(?:textbf|textit|emph|texttt|underline|textrm|mbox|text|href\{[^{}]*\})\{([^{}]*)\}", r"\1", p)
            p = re.sub(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]]*\])?", "", p)
            parts[i] = re.sub(r"\\([%&$#_{}])", r"\1", p)
        pieces[k] = "".join(parts)
    return "".join(pieces)


def _from_wiki(text: str) -> str:
    text = re.sub(r"\{\{[^{}\n]*\}\}|\[\[(?:Category|Kategorie|Categoría|File|Image):[^\[\]\n]*\]\]", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\[\]\n|]*\|)?([^\[\]\n|]+)\]\]", r"\1", text)
    text = re.sub(r"\[https?://[^\s\]]+ ([^\]\n]+)\]", r"\1", text)
    text = re.sub(r"'{2,5}([^'\n]+(?:'[^'\n]+)*)'{2,5}", r"\1", text)
    lines, count = [], {}
    for line in text.split("\n"):
        if m := re.match(r"^(={1,6}) *([^=\n]+?) *\1\s*$", line):
            line = "#" * max(1, len(m[1]) - 1) + " " + m[2]
        elif m := re.match(r"^([*#]+) *(\S.*)$", line):
            depth = len(m[1])
            count = {d: n for d, n in count.items() if d <= depth}
            count[depth] = count.get(depth, 0) + 1
            lines.append("  " * (depth - 1) + (f"{count[depth]}. " if m[1][-1] == "#" else "- ") + m[2])
            continue
        elif re.match(r"^(\{\||\|\}|\|-)", line):
            line = ""
        elif m := re.match(r"^[|!]\s*(.*)$", line):
            line = re.sub(r"\s*(?:\|\||!!)\s*", " ", m[1])
        count = {}
        lines.append(line)
    return "\n".join(lines)


def _from_markdown(text: str) -> str:
    pieces = re.split(r"(^[ ]{0,3}(?:`{3,}|~{3,}).*?(?:^[ ]{0,3}(?:`{3,}|~{3,})[ \t]*$|\Z))", text, flags=re.S | re.M)
    for k, piece in enumerate(pieces):
        if k % 2:
            body = re.sub(r"\A[ ]{0,3}[`~]{3,}[^\n]*\n?|\n?[ ]{0,3}[`~]{3,}[ \t]*\Z", "", piece)
            pieces[k] = f"$${body.strip()}$$" if re.match(r"[ ]*[`~]{3,}\s*(?:latex|tex|math)\b", piece) else f"```\n{body}\n```"
            continue
        t = SETEXT.sub(lambda m: ("# " if m[2][0] == "=" else "## ") + m[1], piece)
        t = TABLE_RULE.sub("", t)
        t = re.sub(r"^\|(.+)\|[ \t]*$", lambda m: " ".join(c.strip() for c in m[1].split("|")), t, flags=re.M)
        t = re.sub(r"!?\[([^\]\n]*)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)", r"\1", t)
        t = re.sub(r"(?<![*\w\\])\*\*(?=[^\s*])([^*\n]*?[^\s*])\*\*(?![*\w])|~~(?=\S)([^~\n]+?)~~", lambda m: m[1] or m[2], t)
        t = re.sub(r"^([ ]{0,8})[*+-] +(?=\S)(?!\d+ -\s*$)", r"\1- ", t, flags=re.M)
        t = re.sub(r"^[ ]{0,3}> ?", "", t, flags=re.M)
        pieces[k] = INLINE_CODE.sub(lambda m: m[2], t)
    return "".join(pieces)


def cleaned(text: str | None) -> str | None:
    """The text without markup, in the plain notation above; null stays null, text without markup is only trimmed.

    Each markup found is taken off in the order wiki, Markdown, LaTeX, HTML. A text of any length is handled whole.
    """
    if text is None:
        return None
    kinds = found_markup(text)
    out = text.replace("\r\n", "\n")
    if "wiki" in kinds:
        out = _from_wiki(out)
    if "markdown" in kinds:
        out = _from_markdown(out)
    if "latex" in kinds:
        out = _from_latex(out)
    if "html" in kinds:
        out = _from_html(COMMENT.sub("", out))
    out = re.sub(r"[ \t]+$", "", out, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def _fields(notes: DataFrame, fields: list[str]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields))
    return notes.where(F.col("id").isNotNull()).select(F.col("id").cast("int").alias("note_id"), F.explode(rows).alias("r")).select("note_id", "r.*").where(F.col("value").isNotNull() & (F.col("value") != ""))


def markup_found(notes: DataFrame, fields: tuple[str, ...] = ("text", "latex")) -> DataFrame:
    """(note_id, field_name, markup): each markup that a field holds. Null and empty fields hold none; a repeated id
    gives each of its findings once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, f, m) for i, f, v in zip(*(b[c].to_pylist() for c in ("note_id", "field_name", "value"))) for m in found_markup(v)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["note_id", "field_name", "markup"])

    return _fields(notes, list(fields)).mapInArrow(run, "note_id int, field_name string, markup string").distinct()


def clean_fields(notes: DataFrame, fields: tuple[str, ...] = ("text", "latex")) -> DataFrame:
    """(note_id, field_name, clean_text) of every non-empty field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["note_id"], b["field_name"], pa.array([cleaned(v) for v in b["value"].to_pylist()], pa.string())], names=["note_id", "field_name", "clean_text"])

    return _fields(notes, list(fields)).mapInArrow(run, "note_id int, field_name string, clean_text string")
