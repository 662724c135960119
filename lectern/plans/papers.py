"""Queries of the exam-paper parser over papers built from the questions table, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import papers
from lectern.sources.tables import table

#: One page per question: a heading on the first page of a paper, a section line, the text, a page number.
_PAGE = "concat_ws('\n', CASE WHEN page = 1 THEN exam_type || ' Examination ' || CAST(year AS {s}) END, 'SECTION ' || section || ':', text, '- ' || CAST(page AS {s}) || ' -')"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").select("document_id", F.col("id").alias("page_number"), F.expr(_PAGE.format(s="STRING")).alias("text"), F.when(F.col("id") % 2 == 0, "ocr").otherwise("embedded").alias("source"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions")


def q_usable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").select("id", tx.usable(F.col("latex")).alias("usable"))


def q_readable(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "notes").select("document_id", F.col("id").alias("page_number"), F.col("latex").alias("embedded_text"), F.col("text").alias("ocr_text"))
    return papers.readable_pages(notes)


def q_normalize(spark: SparkSession, d: str) -> DataFrame:
    return papers.normalized_pages(_pages(spark, d))


def q_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("id", F.array_join(tx.drop_artifacts(F.split(tx.line_ends(F.col("text")), "\n", -1)), "\n").alias("kept"))


def q_hyphens(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("id", tx.join_hyphens(F.col("text")).alias("joined"))


def q_segments(spark: SparkSession, d: str) -> DataFrame:
    return papers.segments(papers.normalized_pages(_pages(spark, d)))


def q_segments_strict(spark: SparkSession, d: str) -> DataFrame:
    return papers.segments(papers.normalized_pages(_pages(spark, d)), strict_sections=True)


def q_labels(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("id", tx.label_of(F.col("text")).alias("label"), tx.line_kind(F.col("text")).alias("kind"))


def q_header(spark: SparkSession, d: str) -> DataFrame:
    return papers.headers(papers.normalized_pages(_pages(spark, d)))


def q_year(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_number", tx.extract_year(F.col("text")).alias("year"))


def q_exam_type(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_number", tx.extract_exam_type(F.col("text")).alias("exam_type"))


def q_marks(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("id", tx.extract_marks(F.col("text")).alias("marks"))


_INSTRUCTION = "concat('Answer ', CASE id % 4 WHEN 0 THEN 'all questions' WHEN 1 THEN 'any 3 questions' WHEN 2 THEN 'this' ELSE 'the Compulsory part' END, '. Each question carries ', CAST(coalesce(marks, 0) AS {s}), ' marks. ', text)"


def q_global_marks(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("id", tx.extract_global_marks(F.expr(_INSTRUCTION.format(s="STRING"))).alias("marks"))


def q_compulsory(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("id", tx.extract_compulsory(F.expr(_INSTRUCTION.format(s="STRING"))).alias("is_compulsory"))


def q_parse(spark: SparkSession, d: str) -> DataFrame:
    return papers.parsed_questions(_pages(spark, d))


def q_evaluation(spark: SparkSession, d: str) -> DataFrame:
    expected = _questions(spark, d).groupBy("document_id").agg(F.count("*").alias("n_questions"), F.max("year").alias("year"), F.max("exam_type").alias("exam_type"))
    return papers.evaluation(q_parse(spark, d), expected)


def q_latex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").where("latex is not null").select("id", tx.latex_balanced(F.col("latex")).alias("balanced"))


# ---- SQL: RE2 has neither Unicode classes by flag nor lookaround, so white space and word signs are written out --------

_S, _W = r"[\s\x{a0}]", r"[\p{L}\p{N}_]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_S}+', ''), '{_S}+$', '')"


def _artifacts(lines: str) -> str:
    number = rf"^(\d+|-{_S}*\d+{_S}*-|[Pp]age{_S}+\d+|[Pp]age{_S}+\d+{_S}+of{_S}+\d+|\d+{_S}+of{_S}+\d+|\[\d+\])$"
    rule = r"^[─━═—–\-_=~.* ]*[─━═—–\-_=~.*][─━═—–\-_=~.* ]*$"
    s = _strip("x")
    return f"list_transform(list_filter({lines}, lambda x: NOT regexp_matches({s}, '{number}') AND NOT (length({s}) >= 4 AND regexp_matches({s}, '{rule}'))), lambda x: CASE WHEN {s} = '' THEN '' ELSE x END)"


def _hyphens(x: str) -> str:
    for _ in range(2):
        x = f"regexp_replace({x}, '({_W})-\n({_W})', '\\1\\2', 'g')"
    return x


_SECTION = rf"(?i)^{_S}*(SECTION|PART){_S}+([A-Z]{{1,3}}|\d{{1,2}}){_S}*[:\-]?"


def _kind(x: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({x}, '{_SECTION}') THEN 'section' WHEN regexp_matches({x}, '(?i)^{_S}*Q\.?\d+([.)?]|{_S})') THEN 'main' "
        rf"WHEN regexp_matches({x}, '^{_S}*\d{{1,2}}[.)]{_S}') THEN CASE WHEN length({_strip(x)}) > 3 THEN 'main' END WHEN regexp_matches({x}, '^{_S}*\([a-zA-Z]{{1,3}}\){_S}') THEN 'sub' END"
    )


def _label(x: str) -> str:
    s = _strip(x)
    return rf"coalesce(nullif(regexp_extract({s}, '^(\([a-zA-Z]{{1,3}}\))', 1), ''), replace(upper(nullif(regexp_extract({s}, '(?i)^(Q\.?\d+)', 1), '')), 'Q.', 'Q'), nullif(regexp_extract({s}, '^(\d{{1,2}})[.)]', 1), ''), nullif(regexp_extract({s}, '^([^\s\x{{a0}}]+)', 1), ''), '?')"


def _first(x: str, patterns: tuple[str, ...]) -> str:
    values = [f"try_cast(nullif(regexp_extract({x}, '{p.replace(chr(92) + "s", _S)}', 1), '') AS INTEGER)" for p in patterns]
    return "coalesce(" + ", ".join(f"CASE WHEN {v} BETWEEN 1 AND 100 THEN {v} END" for v in values) + ")"


def _exam_type(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){p}') THEN '{n}'" for p, n in tx.EXAM_TYPES) + " END"


def _year(x: str) -> str:
    spots = f"list_filter(range(1, length({x}) - 2), lambda i: regexp_matches(substring({x}, i, 4), '^(19|20)\\d\\d$') AND (i = 1 OR NOT regexp_matches(substring({x}, i - 1, 1), '^{_W}$')) AND NOT regexp_matches(substring({x}, i + 4, 1), '^{_W}$') AND try_cast(substring({x}, i, 4) AS INTEGER) BETWEEN 1990 AND 2099)"
    year = f"lambda i: try_cast(substring({x}, i, 4) AS INTEGER)"
    near = f"list_filter({spots}, lambda i: regexp_matches(substring({x}, CAST(greatest(1, i - 100) AS BIGINT), CAST(i - 1 + 100 - greatest(0, i - 101) AS BIGINT)), '{tx.EXAM_WORDS}'))"
    return f"CASE WHEN len({spots}) = 1 THEN list_max(list_transform({spots}, {year})) ELSE coalesce(list_max(list_transform({near}, {year})), list_max(list_transform({spots}, {year}))) END"


_PG = f"pg AS (SELECT document_id, id AS page_number, {_PAGE.format(s='VARCHAR')} AS text, CASE WHEN id % 2 = 0 THEN 'ocr' ELSE 'embedded' END AS source FROM questions)"
_NM = f"""{_PG}, n0 AS (SELECT document_id, page_number, source, list_transform(string_split(regexp_replace(text, '\r\n?', '\n', 'g'), '\n'), lambda x: regexp_replace(x, '{_S}+$', '')) AS l FROM pg),
 n1 AS (SELECT document_id, page_number, source, regexp_replace(regexp_replace(array_to_string({_artifacts('l')}, '\n'), ' {{2,}}', ' ', 'g'), '\n{{3,}}', '\n\n', 'g') AS t FROM n0),
 n2 AS (SELECT document_id, page_number, CASE WHEN source = 'ocr' THEN {_hyphens('t')} ELSE t END AS t FROM n1),
 nm AS (SELECT document_id, page_number, {_strip('t')} AS normalized_text FROM n2)"""


def _segments(strict: bool = False) -> str:
    stop = "kind IS NOT NULL" if strict else "kind IN ('main', 'sub')"
    return f"""{_NM}, ln AS (SELECT document_id, page_number, unnest(string_split(normalized_text, '\n')) AS line, generate_subscripts(string_split(normalized_text, '\n'), 1) - 1 AS i FROM nm),
 kd AS (SELECT *, {_kind('line')} AS kind, CASE WHEN regexp_matches(line, '{_SECTION}') THEN upper(regexp_extract(line, '{_SECTION}', 2)) END AS sec FROM ln),
 sp AS (SELECT *, last_value(sec IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section, sum(CASE WHEN kind IN ('main', 'sub') THEN 1 ELSE 0 END) OVER w AS span,
   sum(CASE WHEN {stop} THEN 1 ELSE 0 END) OVER w AS part FROM kd WINDOW w AS (PARTITION BY document_id, page_number ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 hd AS (SELECT document_id, page_number, span, part, line, kind, section FROM sp WHERE kind IN ('main', 'sub')),
 tx AS (SELECT document_id, page_number, span, part, string_agg(line, '\n' ORDER BY i) AS t FROM sp WHERE span > 0 GROUP BY 1, 2, 3, 4),
 sg AS (SELECT hd.document_id, hd.page_number, CAST(hd.span - 1 AS INTEGER) AS seg_no, {_strip('tx.t')} AS raw_text, {_label('hd.line')} AS question_label, hd.kind AS question_type, hd.section
   FROM hd JOIN tx ON tx.document_id = hd.document_id AND tx.page_number = hd.page_number AND tx.span = hd.span AND tx.part = hd.part WHERE {_strip('tx.t')} <> '')"""


_HEADERS = "rn AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS n FROM nm), he AS (SELECT document_id, coalesce(string_agg(normalized_text, '\n' ORDER BY n) FILTER (normalized_text <> ''), '') AS header FROM rn WHERE n <= 2 GROUP BY document_id)"
_PARSED = f"""{_segments()}, {_HEADERS}, md AS (SELECT document_id, {_year('header')} AS year, {_exam_type('header')} AS exam_type FROM he),
 pq AS (SELECT sg.document_id, sg.page_number AS page, seg_no, raw_text, question_label, question_type, section, year, exam_type, {_first('raw_text', tx.MARKS)} AS marks,
   CASE WHEN regexp_matches(raw_text, '{tx.COMPULSORY}') THEN true WHEN regexp_matches(raw_text, '{tx.OPTIONAL}') THEN false END AS is_compulsory FROM sg LEFT JOIN md ON md.document_id = sg.document_id WHERE sg.page_number >= 1)"""
_INSTR = _INSTRUCTION.format(s="VARCHAR")

QUERIES = {
    "usable_text": q_usable, "readable_pages": q_readable, "normalize_text": q_normalize, "drop_page_artifacts": q_artifacts, "fix_hyphen_breaks": q_hyphens, "segment_questions": q_segments,
    "segment_questions_strict": q_segments_strict, "question_labels": q_labels, "header_text": q_header, "extract_year": q_year, "extract_exam_type": q_exam_type, "extract_marks": q_marks,
    "extract_global_marks": q_global_marks, "extract_compulsory": q_compulsory, "parse_papers": q_parse, "parser_evaluation": q_evaluation, "latex_structure_check": q_latex,
}

SQL = {
    "usable_text": "SELECT id, coalesce(length(translate(latex, chr(32) || chr(10) || chr(9), '')) >= 20, false) AS usable FROM notes",
    "readable_pages": f"WITH u AS (SELECT *, CASE WHEN coalesce(length(translate(latex, chr(32) || chr(10) || chr(9), '')) >= 20, false) THEN 'embedded' WHEN {_strip('text')} <> '' THEN 'ocr' END AS source FROM notes) SELECT document_id, id AS page_number, CASE WHEN source = 'embedded' THEN latex ELSE text END AS text, source FROM u WHERE source IS NOT NULL",
    "normalize_text": f"WITH {_NM} SELECT * FROM nm",
    "drop_page_artifacts": f"WITH l AS (SELECT id, string_split(regexp_replace(text, '\r\n?', '\n', 'g'), '\n') AS l FROM questions) SELECT id, array_to_string({_artifacts('l')}, '\n') AS kept FROM l",
    "fix_hyphen_breaks": f"SELECT id, {_hyphens('text')} AS joined FROM questions",
    "segment_questions": f"WITH {_segments()} SELECT * FROM sg",
    "segment_questions_strict": f"WITH {_segments(True)} SELECT * FROM sg",
    "question_labels": f"SELECT id, {_label('text')} AS label, {_kind('text')} AS kind FROM questions",
    "header_text": f"WITH {_NM}, {_HEADERS} SELECT * FROM he",
    "extract_year": f"WITH {_PG} SELECT page_number, {_year('text')} AS year FROM pg",
    "extract_exam_type": f"WITH {_PG} SELECT page_number, {_exam_type('text')} AS exam_type FROM pg",
    "extract_marks": f"SELECT id, {_first('text', tx.MARKS)} AS marks FROM questions",
    "extract_global_marks": f"SELECT id, {_first(_INSTR, tx.GLOBAL_MARKS)} AS marks FROM questions",
    "extract_compulsory": f"SELECT id, CASE WHEN regexp_matches({_INSTR}, '{tx.COMPULSORY}') THEN true WHEN regexp_matches({_INSTR}, '{tx.OPTIONAL}') THEN false END AS is_compulsory FROM questions",
    "parse_papers": f"WITH {_PARSED} SELECT * FROM pq",
    "parser_evaluation": f"""WITH {_PARSED}, ex AS (SELECT document_id, count(*) AS n_questions, max(year) AS year, max(exam_type) AS exam_type FROM questions GROUP BY 1),
      gt AS (SELECT document_id, count(*) AS extracted, count(marks) AS with_marks, max(year) AS got_year, max(exam_type) AS got_type FROM pq GROUP BY 1),
      j AS (SELECT ex.*, coalesce(extracted, 0) AS extracted, coalesce(with_marks, 0) AS marks_found, got_year IS NOT DISTINCT FROM ex.year AS year_matched, coalesce(contains(lower(got_type), lower(exam_type)), false) AS exam_type_matched FROM ex LEFT JOIN gt ON gt.document_id = ex.document_id)
      SELECT document_id, n_questions, extracted, year_matched, exam_type_matched, marks_found, round(40 * least(1.0, extracted / n_questions) + 30 * (CASE WHEN year_matched THEN 0.5 ELSE 0 END + CASE WHEN exam_type_matched THEN 0.5 ELSE 0 END) + 30 * least(1.0, marks_found / n_questions), 2) AS accuracy_score FROM j""",
    "latex_structure_check": r"""WITH b AS (SELECT id, latex, regexp_replace(regexp_replace(latex, '\\[{}]', '', 'g'), '[^{}]', '', 'g') AS s FROM notes WHERE latex IS NOT NULL),
      c AS (SELECT id, latex, list_transform(string_split(s, ''), lambda x: CASE x WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) AS v FROM b),
      p AS (SELECT id, latex, list_transform(range(1, len(v) + 1), lambda k: list_sum(v[1:k])) AS r FROM c)
      SELECT id, coalesce(list_min(r), 0) >= 0 AND coalesce(r[-1], 0) = 0 AND len(regexp_extract_all(latex, '\\begin\{')) = len(regexp_extract_all(latex, '\\end\{')) AS balanced FROM p""",
}
