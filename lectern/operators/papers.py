"""Exam papers: from raw page text to typed question rows.

Everything within a page is done on the array of its lines, so lines are never shuffled. Only two things cross pages:
the section carried from page to page, computed over one narrow row a page, and the header of each document, taken from
its first two pages by a ranking that keeps two rows a document before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx

HEADER_PAGES = 2


def readable_pages(pages: DataFrame, least: int = 20) -> DataFrame:
    """(document_id, page_number, text, source): the text layer where it is usable, else scanned text; pages with
    neither are left out. Input has embedded_text and ocr_text."""
    source = F.when(tx.usable(F.col("embedded_text"), least), "embedded").when(tx.strip(F.coalesce("ocr_text", F.lit(""))) != "", "ocr")
    text = F.when(F.col("source") == "embedded", F.col("embedded_text")).otherwise(F.col("ocr_text"))
    return pages.withColumn("source", source).where("source is not null").select("document_id", "page_number", text.alias("text"), "source")


def normalized_pages(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, normalized_text) of (document_id, page_number, text, source)."""
    return pages.select("document_id", "page_number", tx.normalize(F.col("text"), F.col("source")).alias("normalized_text"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(F.count("*").alias("total_pages"))


def _marked(lines: Column) -> Column:
    """Lines that are headings or question starts: structs of position, kind and section."""
    few = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda m: m["x"].rlike(tx.MAY_START))
    every = F.transform(few, lambda m: F.struct(m["i"].alias("i"), tx.line_kind(m["x"]).alias("kind"), tx.section_of(m["x"]).alias("section")))
    return F.filter(every, lambda m: m["kind"].isNotNull())


def segments(pages: DataFrame, strict_sections: bool = False) -> DataFrame:
    """(document_id, page_number, seg_no, raw_text, question_label, question_type, section) of normalised pages.

    A question runs from its first line to the line before the next one, or to the end of the page; headings between
    belong to the question before, unless ``strict_sections`` ends it there. The section is the last heading above, on
    this page or an earlier one of the document. Blank questions and lines before the first one are left out.
    """
    # in steps: an expression used twice in one projection, or pushed below it by a filter, would be evaluated twice
    lined = pages.select("document_id", "page_number", F.split("normalized_text", "\n", -1).alias("lines"))
    marked = lined.select("document_id", "page_number", "lines", _marked(F.col("lines")).alias("marked"))
    heads = lambda: F.filter("marked", lambda m: m["kind"] == "section")
    last = marked.select("document_id", "page_number", F.try_element_at(heads(), F.lit(-1))["section"].alias("last_section"))
    w = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("document_id", "page_number", F.last("last_section", ignorenulls=True).over(w).alias("carried"))
    starts = marked.withColumns({"starts": F.filter("marked", lambda m: m["kind"] != "section"), "heads": heads()})
    stops = F.transform("marked", lambda m: m["i"]) if strict_sections else F.transform("starts", lambda m: m["i"])
    rows = starts.withColumn("stops", stops).select("document_id", "page_number", "lines", "heads", "stops", F.posexplode("starts").alias("seg_no", "s"))
    rows = rows.join(carried, ["document_id", "page_number"], "left")
    begin = F.col("s.i")
    stop = F.coalesce(F.array_min(F.filter("stops", lambda x: x > begin)), F.size("lines"))
    raw = tx.strip(F.array_join(F.slice("lines", begin + 1, stop - begin), "\n"))
    own = F.try_element_at(F.filter("heads", lambda h: h["i"] < begin), F.lit(-1))["section"]
    out = rows.select("document_id", "page_number", F.col("seg_no").cast("int").alias("seg_no"), raw.alias("raw_text"), tx.label_of(F.element_at("lines", begin + 1)).alias("question_label"), F.col("s.kind").alias("question_type"), F.coalesce(own, F.col("carried")).alias("section"))
    return out.where("raw_text <> ''")


def headers(pages: DataFrame, n_pages: int = HEADER_PAGES) -> DataFrame:
    """(document_id, header): the texts of a document's first pages, joined by line ends."""
    ranked = pages.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("page_number"))).where(F.col("n") <= n_pages)
    parts = F.array_sort(F.collect_list(F.when(F.col("normalized_text") != "", F.struct("n", "normalized_text"))))
    return ranked.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["normalized_text"]), "\n").alias("header"))


def first_pages(pages: DataFrame, n_pages: int = HEADER_PAGES) -> DataFrame:
    """The first pages of each document, before anything is done to their texts."""
    return pages.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("page_number"))).where(F.col("n") <= n_pages).drop("n")


def document_metadata(pages: DataFrame) -> DataFrame:
    """(document_id, year, exam_type) read from the headers of (document_id, page_number, text, source)."""
    return headers(normalized_pages(first_pages(pages))).select("document_id", tx.extract_year(F.col("header")).alias("year"), tx.extract_exam_type(F.col("header")).alias("exam_type"))


def parsed_questions(pages: DataFrame, global_marks: int | None = None, strict_sections: bool = False) -> DataFrame:
    """The whole chain for (document_id, page_number, text, source): one typed row per question.

    Marks in the question win over ``global_marks``; year and exam type come from the document. Rows outside the
    validation rules (page below 1, blank text) are left out.
    """
    # one shuffle of the raw pages, by the keys of the join with the carried sections, so that lines needn't move again
    normal = normalized_pages(pages.repartition("document_id", "page_number"))
    found = segments(normal, strict_sections).join(document_metadata(pages), "document_id", "left")
    raw = F.col("raw_text")
    return found.where("page_number >= 1").select(
        "document_id", F.col("page_number").alias("page"), "seg_no", "raw_text", "question_label", "question_type", "section", "year", "exam_type",
        F.coalesce(tx.extract_marks(raw), F.lit(global_marks).cast("int")).alias("marks"), tx.extract_compulsory(raw).alias("is_compulsory"),
    )


def with_question_ids(questions: DataFrame) -> DataFrame:
    """A stable id from document, page and place instead of a random one, so that a re-run task gives the same rows."""
    return questions.withColumn("question_id", F.concat(F.lit("q-"), F.substring(F.sha2(F.concat_ws(":", "document_id", "page", "seg_no"), 256), 1, 32)))


def evaluation(parsed: DataFrame, expected: DataFrame) -> DataFrame:
    """Accuracy per document: 40 for questions found, 30 for year and type, 30 for marks, against
    (document_id, n_questions, year, exam_type)."""
    got = parsed.groupBy("document_id").agg(F.count("*").alias("extracted"), F.count("marks").alias("with_marks"), F.max("year").alias("got_year"), F.max("exam_type").alias("got_type"))
    both = expected.join(got, "document_id", "left")
    share = lambda c: F.when(F.col("n_questions") > 0, F.least(F.lit(1.0), F.coalesce(c, F.lit(0)) / F.col("n_questions"))).otherwise(1.0)
    year_ok = F.col("got_year").eqNullSafe(F.col("year"))
    type_ok = F.coalesce(F.contains(F.lower("got_type"), F.lower("exam_type")), F.lit(False))
    score = 40 * share(F.col("extracted")) + 30 * (F.when(year_ok, 0.5).otherwise(0.0) + F.when(type_ok, 0.5).otherwise(0.0)) + 30 * share(F.col("with_marks"))
    return both.select("document_id", "n_questions", F.coalesce("extracted", F.lit(0)).alias("extracted"), year_ok.alias("year_matched"), type_ok.alias("exam_type_matched"), F.coalesce("with_marks", F.lit(0)).alias("marks_found"), F.round(score, 2).alias("accuracy_score"))
