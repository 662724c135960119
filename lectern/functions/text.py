"""Text expressions of the exam-paper parser, all inside the JVM. White space and letters are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line patterns, fixed values.
PAGE_LINE = r"(?U)^(?:\d+|-\s*\d+\s*-|[Pp]age\s+\d+|[Pp]age\s+\d+\s+of\s+\d+|\d+\s+of\s+\d+|\[\d+\])$"
DECORATIVE = r"^(?=.{4})[─━═—–\-_=~.* ]*[─━═—–\-_=~.*][─━═—–\-_=~.* ]*$"
SECTION = r"(?iU)^\s*(SECTION|PART)\s+([A-Z]{1,3}|\d{1,2})\s*[:\-]?"
Q_PREFIX = r"(?iU)^\s*Q\.?\d+[.)?\s]"
NUMBERED = r"(?U)^\s*\d{1,2}[.)]\s"
SUB = r"(?U)^\s*\([a-zA-Z]{1,3}\)\s"
#: What any of the four begins with.
MAY_START = r"(?iU)^\s*(?:SECTION|PART|Q\.?\d|\d{1,2}[.)]|\()"
#: Exam types in the order in which they are tried, fixed values.
EXAM_TYPES = (
    (r"end[\s\-]+semester", "End Semester"), (r"end[\s\-]+term", "End Semester"), (r"final[\s\-]+exam", "End Semester"), (r"mid[\s\-]+semester", "Mid Semester"), (r"mid[\s\-]+term", "Mid Semester"),
    (r"internal[\s\-]+assessment", "Internal"), (r"\binternal\b", "Internal"), (r"supplementary", "Supplementary"), (r"back[\s\-]+log", "Supplementary"), (r"re[\s\-]+exam", "Supplementary"),
    (r"unit[\s\-]+test", "Unit Test"), (r"class[\s\-]+test", "Unit Test"), (r"quiz", "Quiz"), (r"model[\s\-]+exam", "Model Exam"),
)
#: Where marks stand, the surest form first, fixed values.
MARKS = (r"\[(\d+)\s*[Mm]arks?\]", r"\((\d+)\s*[Mm]arks?\)", r"\b(\d+)\s+[Mm]arks?\b", r"(?i)marks?\s*[:=]\s*(\d+)", r"[\[(](\d{1,2})[\])]")
GLOBAL_MARKS = (r"(?i)each\s+question\s+carries?\s+(\d+)\s+marks?", r"(?i)carries?\s+(\d+)\s+marks?", r"(?i)(\d+)\s+marks?\s+each", r"(?i)equal\s+marks\s*\((\d+)\)")
COMPULSORY = r"(?i)\bcompulsory\b|\bmandatory\b|answer\s+all\b|attempt\s+all\b|all\s+questions?\s+are\s+compulsory|all\s+questions?\s+must\s+be\s+answered"
OPTIONAL = r"(?i)\boptional\b|answer\s+any\s+\w+|attempt\s+any\s+\w+"
EXAM_WORDS = r"(?i)examination|exam|semester|assessment|test|paper|annual|mid[\s-]?term|end[\s-]?term|supplementary|back[\s-]?log"


def _unicode(pattern: str) -> str:
    """The pattern with Unicode classes."""
    return "(?iU)" + pattern[4:] if pattern.startswith("(?i)") else "(?U)" + pattern


def strip(c: Column) -> Column:
    """Without white space at either end, as Unicode has it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def usable(c: Column, least: int = 20) -> Column:
    """Whether a text layer has at least ``least`` characters besides spaces, tabs and line ends; null is not usable."""
    return F.coalesce(F.length(F.translate(c, " \n\t", "")) >= least, F.lit(False))


def line_ends(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def drop_artifacts(lines: Column) -> Column:
    """Lines without page numbers and decorative lines; blank lines stay as empty strings."""
    kept = F.filter(lines, lambda x: ~F.coalesce(strip(x).rlike(PAGE_LINE) | strip(x).rlike(DECORATIVE), F.lit(False)))
    return F.transform(kept, lambda x: F.when(strip(x) == "", F.lit("")).otherwise(x))


def join_hyphens(c: Column) -> Column:
    """Words broken by a hyphen at a line end, joined in one pass however many lines they span."""
    return F.regexp_replace(c, r"(?U)(?<=\w)-\n(?=\w)", "")


#: Whole artifact lines with their line end, for one pass over a text.
_ARTIFACT_LINES = r"(?dmU)^[^\S\n]*(?=[\d\-Pp\[─━═—–_=~.*])(?:" + PAGE_LINE[5:-1] + "|" + DECORATIVE[1:-1].replace("(?=.{4})", "(?=[^\\n]{4})") + r")[^\S\n]*(?:\n|\z)"


def normalize(text: Column, source: Column) -> Column:
    """Line ends, trailing white space, page artifacts, runs of spaces and blank lines; broken words of scanned text.

    Each step is one expression over the whole text. Null and empty texts give an empty string.
    """
    trimmed = F.regexp_replace(line_ends(F.coalesce(text, F.lit(""))), r"(?U)[^\S\n]+(?=\n|\z)", "")
    kept = F.regexp_replace(trimmed, _ARTIFACT_LINES, "")
    even = F.regexp_replace(F.regexp_replace(kept, " {2,}", " "), "\n{3,}", "\n\n")
    return strip(F.when(source == "ocr", join_hyphens(even)).otherwise(even))


def line_kind(line: Column) -> Column:
    """section, main, sub or null, tried in that order; a numbered line of at most 3 characters is none of them."""
    return (
        F.when(line.rlike(SECTION), "section").when(line.rlike(Q_PREFIX), "main")
        .when(line.rlike(NUMBERED), F.when(F.length(strip(line)) > 3, F.lit("main"))).when(line.rlike(SUB), "sub")
    )


def section_of(line: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(line, SECTION, 2), F.lit("")))


def label_of(line: Column) -> Column:
    """(a), Q1 or 1 at the beginning of a line, else its first word, else '?'."""
    s = strip(line)
    pick = lambda pattern: F.nullif(F.regexp_extract(s, pattern, 1), F.lit(""))
    return F.coalesce(pick(r"^(\([a-zA-Z]{1,3}\))"), F.replace(F.upper(pick(r"(?i)^(Q\.?\d+)")), F.lit("Q."), F.lit("Q")), pick(r"^(\d{1,2})[.)]"), pick(r"(?U)^(\S+)"), F.lit("?"))


def _first_in_range(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first match of each pattern in turn, until one lies within 1..100."""
    values = [F.nullif(F.regexp_extract(text, _unicode(p), 1), F.lit("")).try_cast("int") for p in patterns]
    return F.coalesce(*(F.when(v.between(1, 100), v) for v in values))


def extract_marks(text: Column) -> Column:
    return _first_in_range(text, MARKS)


def extract_global_marks(text: Column) -> Column:
    return _first_in_range(text, GLOBAL_MARKS)


def extract_compulsory(text: Column) -> Column:
    return F.when(text.rlike(_unicode(COMPULSORY)), F.lit(True)).when(text.rlike(_unicode(OPTIONAL)), F.lit(False))


def extract_exam_type(text: Column) -> Column:
    out = None
    for pattern, name in EXAM_TYPES:
        hit = text.rlike(_unicode("(?i)" + pattern))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


#: A year as a word of its own.
_YEAR = r"(?U)(?<!\w)(?:19|20)[0-9]{2}(?!\w)"


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def extract_year(text: Column) -> Column:
    """The year of a header: the only one from 1990 to 2099, or the latest near an exam word (100 characters before,
    100 behind its beginning), or the latest. Matches are found in one pass; where they stand follows from what lies
    between them."""
    matches = F.transform(F.regexp_extract_all(text, F.lit(_YEAR), F.lit(0)), lambda y: y.cast("int"))
    between = F.transform(F.split(text, _YEAR, -1), lambda s: F.length(s))

    def at(lengths: Column) -> Column:
        start = lambda k: F.aggregate(F.slice(lengths, 1, k + 1), F.lit(1) + 4 * k, lambda n, x: n + x)
        return F.filter(F.transform(matches, lambda y, k: F.struct(y.alias("y"), start(k).alias("i"))), lambda s: s["y"].between(1990, 2099))

    window = lambda i: F.substring(text, F.greatest(F.lit(1), i - 100), i - 1 + 100 - F.greatest(F.lit(0), i - 101))
    latest = lambda a: F.array_max(F.transform(a, lambda s: s["y"]))
    near = lambda found: F.filter(found, lambda s: window(s["i"]).rlike(_unicode(EXAM_WORDS)))
    year = _with(_with(between, at), lambda found: F.when(F.size(found) < 2, latest(found)).otherwise(F.coalesce(latest(near(found)), latest(found))))
    return F.when(text.rlike("(?:19|20)[0-9]{2}"), year)


def squash(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def norm_words(c: Column) -> Column:
    """Lower-case words between white space; an empty text has one empty word."""
    return F.split(F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " "), " ")


def latex_balanced(c: Column) -> Column:
    """Whether braces balance (escaped ones don't count), never close before they open, and begin/end counts agree."""
    bare = F.regexp_replace(c, r"\\[{}]", "")
    depth = F.aggregate(
        F.split(F.regexp_replace(bare, r"[^{}]", ""), ""), F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")),
        lambda a, x: F.struct((a["d"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)).alias("d"), (a["ok"] & (a["d"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0) >= 0)).alias("ok")),
    )
    return (depth["d"] == 0) & depth["ok"] & (F.regexp_count(c, F.lit(r"\\begin\{")) == F.regexp_count(c, F.lit(r"\\end\{")))
