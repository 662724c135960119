"""Queries of linking, pages, lookups, exports and changes of stored tables, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import editing
from lectern.functions import text as tx
from lectern.operators import exports, linking, mutations, pages
from lectern.sources.tables import table

#: Thresholds at which the test vectors have matches.
COSINE = 0.30


# ---- linking --------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("topic_id"), F.col("embedding").alias("vector"))


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    parts = _vectors(spark, d).select("topic_id", F.posexplode("vector").alias("pos", "v")).groupBy("topic_id", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return parts.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("vector")).select(F.col("topic_id").alias("id"), "vector")


def q_assign(spark: SparkSession, d: str) -> DataFrame:
    return linking.assign_topics(_vectors(spark, d), _centroids(spark, d), COSINE).select("id", "topic_id", F.round("score", 4).alias("score"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return linking.repeat_pairs(_vectors(spark, d), COSINE)


def q_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("topic_id", "left", "right", F.round("score", 4).alias("score"))


def q_groups(spark: SparkSession, d: str) -> DataFrame:
    return linking.repeat_groups(_vectors(spark, d), _pairs(spark, d), linking.last_group(table(spark, d, "questions")))


def q_last_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").agg(F.coalesce(F.max("repeat_group_id"), F.lit(0)).alias("last_group"))


def q_link_texts(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").select(F.col("id"), linking.question_text(F.col("text"), F.col("cleaned_text")).alias("linked_text"))
    return q.unionByName(table(spark, d, "topics").select((-F.col("id")).alias("id"), linking.topic_text(F.col("name"), F.col("syllabus_unit")).alias("linked_text")))


def q_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return linking.keep_first(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id", "text").select("doc_id", "source")


# ---- pages ----------------------------------------------------------------------------------------------------------


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Words with places and confidences, made from the texts of the notes."""
    lines = table(spark, d, "notes").where("text is not null").select("document_id", F.col("id").alias("page_number"), F.posexplode(F.split("text", "\n", -1)).alias("line_id", "line"))
    words = lines.select("document_id", "page_number", "line_id", F.posexplode(F.filter(F.split("line", " ", -1), lambda w: w != "")).alias("pos", "text"))
    return words.select(
        "document_id", "page_number", F.concat(F.lit("r"), F.floor(F.col("line_id") / 5).cast("string")).alias("region_id"), F.concat(F.col("line_id").cast("string"), F.lit(":"), F.col("pos").cast("string")).alias("word_id"), "text",
        (((F.col("page_number") * 31 + F.col("line_id") * 7 + F.col("pos") * 17) % 97) / 97.0).alias("confidence"), (F.col("pos") * 12).alias("x"), (F.col("line_id") * 20 + F.col("pos") % 3).alias("y"), "line_id", F.lit(False).alias("corrected"),
    )


def _equations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").where("latex is not null").select("document_id", F.col("id").alias("page_number"), F.lit("e1").alias("region_id"), "latex", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), tx.latex_balanced(F.col("latex")).alias("render_ok"), F.lit(False).alias("corrected"), F.lit(0).alias("x"), F.lit(100000).alias("y"))


def q_blocks(spark: SparkSession, d: str) -> DataFrame:
    return pages.block_texts(_words(spark, d)).select("document_id", "page_number", "region_id", "x", "y", "text", F.round("mean_confidence", 6).alias("mean_confidence"), "n_words")


def q_page_texts(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_texts(pages.block_texts(_words(spark, d)), _equations(spark, d))


def q_confidence(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_confidence(_words(spark, d), _equations(spark, d))


def q_review(spark: SparkSession, d: str) -> DataFrame:
    return pages.review_queue(_words(spark, d), _equations(spark, d))


def _corrections(spark: SparkSession, d: str) -> DataFrame:
    words = _words(spark, d).where("line_id = 0 and page_number % 7 = 0").select("document_id", "page_number", "word_id", F.upper("text").alias("text"))
    return words.unionByName(table(spark, d, "notes").where("id % 11 = 0").select("document_id", F.col("id").alias("page_number"), F.lit("zz").alias("word_id"), F.lit("?").alias("text")))


def q_corrected(spark: SparkSession, d: str) -> DataFrame:
    return pages.corrected_words(_words(spark, d), _corrections(spark, d)).where("corrected").select("document_id", "page_number", "word_id", "text", "confidence")


def q_unknown_corrections(spark: SparkSession, d: str) -> DataFrame:
    return pages.unknown_corrections(_words(spark, d), _corrections(spark, d)).select("document_id", "page_number", "word_id")


def q_split(spark: SparkSession, d: str) -> DataFrame:
    boxes = table(spark, d, "topics").select(F.col("id").alias("box_id"), F.col("name").alias("text"), (F.col("id") % 50).alias("x"), (F.length("name") * 7 + 3).alias("w"))
    return pages.split_by_share(boxes)


def q_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).select(F.col("topic_id").alias("document_id"), F.col("id").alias("page_number"), F.col("vector").alias("fingerprint"))
    return pages.fold_pages(rows, 0.35, -0.5).select("document_id", "page_number", F.array_join(F.transform("source_page_numbers", lambda p: p.cast("string")), ",").alias("source_pages"))


def q_chains(spark: SparkSession, d: str) -> DataFrame:
    return pages.stitch_chains(table(spark, d, "notes").select("document_id", F.col("id").alias("page_number"), (F.col("id") % 3 != 0).alias("joins_previous")))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "notes").where("text is not null").select(F.col("id").alias("page_id"), F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return lines.select("page_id", (F.col("page_id").cast("long") * 1000 + F.col("n")).alias("box_id"), (F.col("n") % 3 * 5).alias("x"), (F.col("n") * 20 + F.floor(F.col("n") / 4).cast("int") * 200).alias("y"), (F.length("line") * 6 + 1).alias("w"), (F.col("n") % 4 * 6 + 16).alias("h"))


def q_box_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pages.box_pairs(_boxes(spark, d))


def q_regions(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d)
    groups = linking.components(pages.box_merges(boxes, 2000, 100).select("left", "right"))
    return pages.merged_boxes(boxes, groups, 2000, 4000)


def q_strokes(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d)
    return pages.strokes_in_blocks(boxes.select("page_id", (F.col("x") + 3).alias("x"), (F.col("y") + 7).alias("y"), "w", "h"), boxes)


def q_corners(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "notes").select(F.col("id").alias("page_id"))
    corner = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((90, 80), (3, 5), (7, 88), (95, 9)))))
    return pages.ordered_corners(notes.select("page_id", corner.alias("p")).select("page_id", (F.col("p.x") + F.col("page_id") % 3).alias("x"), F.col("p.y").alias("y")))


def q_sources(spark: SparkSession, d: str) -> DataFrame:
    pair = table(spark, d, "notes").select("id", F.array("page", "document_id").alias("a"), F.array(F.col("page") + 1, "page").alias("b"))
    return pair.select("id", F.array_join(F.transform(pages.merged_sources(F.col("a"), F.col("b")), lambda p: p.cast("string")), ",").alias("merged"))


# ---- lookups and exports --------------------------------------------------------------------------------------------


def _q(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions")


_BRIEF = ("id", "document_id", "page", "year", "section", "marks")


def q_by_document(spark: SparkSession, d: str) -> DataFrame:
    return exports.question_query(_q(spark, d), document_id=1, year=1990).select(*_BRIEF)


def q_by_year(spark: SparkSession, d: str) -> DataFrame:
    return exports.question_query(_q(spark, d), year=2020).select(*_BRIEF)


def q_by_section(spark: SparkSession, d: str) -> DataFrame:
    return exports.question_query(_q(spark, d), section=" a ").select(*_BRIEF)


def q_ordered(spark: SparkSession, d: str) -> DataFrame:
    return exports.question_query(_q(spark, d)).select(*_BRIEF)


def q_documents(spark: SparkSession, d: str) -> DataFrame:
    return exports.documents_newest_first(table(spark, d, "source_documents")).select("id", "doc_type", "file_name", "year")


def q_document(spark: SparkSession, d: str) -> DataFrame:
    return exports.document_by_id(table(spark, d, "source_documents"), 5).select("id", "doc_type", "file_name")


def q_topics(spark: SparkSession, d: str) -> DataFrame:
    return exports.topics_by_code(table(spark, d, "topics")).select("id", "topic_code", "name", "syllabus_unit")


def q_contract(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "notes").select("document_id", F.col("page").alias("page_number"), F.col("id").alias("note_id"))
    return exports.pages_with_documents(rows, table(spark, d, "source_documents"))


def _images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").select("document_id", F.col("lecture_date").alias("taken_at"), F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("file_name"), F.col("id").alias("upload_pos"))


def q_upload(spark: SparkSession, d: str) -> DataFrame:
    return exports.upload_order(_images(spark, d))


def q_first_time(spark: SparkSession, d: str) -> DataFrame:
    return exports.first_time(_images(spark, d))


def q_to_structure(spark: SparkSession, d: str) -> DataFrame:
    return exports.notes_to_structure(table(spark, d, "notes")).select("id", "document_id")


def q_flashcards(spark: SparkSession, d: str) -> DataFrame:
    return exports.flashcards(table(spark, d, "notes"), table(spark, d, "note_topics"), _q(spark, d))


def q_markdown(spark: SparkSession, d: str) -> DataFrame:
    return exports.markdown_pages(table(spark, d, "notes"))


def q_anki(spark: SparkSession, d: str) -> DataFrame:
    return exports.anki_rows(table(spark, d, "flashcards"), table(spark, d, "notes"), _q(spark, d))


def q_anki_all(spark: SparkSession, d: str) -> DataFrame:
    return exports.anki_rows_all(table(spark, d, "flashcards"), table(spark, d, "note_topics"))


# ---- changes --------------------------------------------------------------------------------------------------------


def q_upsert_topics(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "topics")
    new = t.where("id % 3 = 0").select("topic_code", F.concat("name", F.lit(" v2")).alias("name"), "syllabus_unit", F.col("id").alias("seq"))
    new = new.unionByName(t.where("id % 6 = 0").select("topic_code", F.concat("name", F.lit(" v3")).alias("name"), "syllabus_unit", (F.col("id") + 1000).alias("seq")))
    new = new.unionByName(t.where("id % 50 = 0").select(F.concat(F.lit("NEW"), "topic_code").alias("topic_code"), "name", "syllabus_unit", (F.col("id") + 2000).alias("seq")))
    return mutations.upsert_topics(t, new)


def _note_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").groupBy("document_id", "page").agg(F.min("id").alias("id"), F.min_by(F.struct("lecture_date", "text", "latex", "confidence"), "id").alias("r")).select("document_id", "page", "id", "r.*")


def q_upsert_notes(spark: SparkSession, d: str) -> DataFrame:
    """All stored pages, with every third page changed and one page added after the last of each document."""
    base = _note_pages(spark, d)
    added = base.groupBy("document_id").agg((F.max("page") + 1).cast("int").alias("page"), F.max_by(F.struct("lecture_date", "text", "latex"), "page").alias("r")).select("document_id", "page", "r.*")
    delta = base.where("page % 3 = 0").select("document_id", "page", "lecture_date", "text", "latex").unionByName(added.where("page is not null"))
    new = delta.select("document_id", "page", F.upper("text").alias("text"), "latex", F.lit(0.9).alias("confidence"), F.when(F.col("page") % 2 == 0, F.lit("")).otherwise(F.col("lecture_date")).alias("lecture_date"), F.when(F.col("page") % 4 == 0, F.lit("2024-01-01")).alias("taken_at"))
    return mutations.upsert_notes(base, new)


def q_defaults(spark: SparkSession, d: str) -> DataFrame:
    return mutations.children_with_defaults(_q(spark, d), table(spark, d, "source_documents")).select("id", "document_id", "year", "exam_type")


def q_integrity(spark: SparkSession, d: str) -> DataFrame:
    return mutations.orphaned_children(_q(spark, d), table(spark, d, "source_documents")).select("id", "document_id")


def q_cascade(spark: SparkSession, d: str) -> DataFrame:
    return mutations.without_documents(_q(spark, d), table(spark, d, "source_documents").where("id % 5 = 0")).select("id", "document_id")


def q_idempotent(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    return mutations.not_yet_stored(q, q.where("document_id % 4 = 0")).select("id", "document_id")


def q_set_topics(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    return mutations.with_topics(q, q.select("id", (F.col("id") % 200 + 1).alias("topic_id"))).select("id", "topic_id")


def q_set_groups(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    return mutations.with_repeat_groups(q, q.where("id % 10 = 0").select("id", F.lit(7).alias("repeat_group_id"))).select("id", "repeat_group_id")


def q_reorder(spark: SparkSession, d: str) -> DataFrame:
    base = _note_pages(spark, d).select("document_id", F.col("page").alias("page_number"), "id")
    orders = base.where("document_id % 2 = 0").groupBy("document_id").agg(F.sort_array(F.collect_list("page_number"), asc=False).alias("new_order"))
    return mutations.reordered_pages(base, orders)


# ---- edit distances -------------------------------------------------------------------------------------------------


def _edited(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d).where(F.col("text").isNotNull() & F.col("cleaned_text").isNotNull())


def q_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return _edited(spark, d).select("id", F.levenshtein("text", "cleaned_text").alias("distance"))


def q_text_errors(spark: SparkSession, d: str) -> DataFrame:
    return editing.text_errors(_q(spark, d), "text", "cleaned_text")


def q_formula_errors(spark: SparkSession, d: str) -> DataFrame:
    return editing.formula_errors(_edited(spark, d), "text", "cleaned_text", F.col("id") % 3 != 0)


def q_calibration(spark: SparkSession, d: str) -> DataFrame:
    return editing.calibration(_words(spark, d).select("confidence", (F.length("text") % 5 != 0).alias("is_right")), 0.6)


# ---- SQL ------------------------------------------------------------------------------------------------------------

_V = "v AS (SELECT vec_id AS id, label AS topic_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"
_C = f"{_V}, u AS (SELECT topic_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM v), m AS (SELECT topic_id, pos, avg(x) AS x FROM u GROUP BY 1, 2), c AS (SELECT topic_id, list(x ORDER BY pos) AS vector FROM m GROUP BY 1)"
_PAIRS = f"{_V}, pr AS (SELECT a.topic_id, a.id AS l, b.id AS r, list_cosine_similarity(a.vector, b.vector) AS score FROM v a JOIN v b ON a.topic_id = b.topic_id AND a.id < b.id WHERE list_cosine_similarity(a.vector, b.vector) >= {COSINE})"
_REACH = "e AS (SELECT {l} AS a, {r} AS b FROM {t} UNION ALL SELECT {r}, {l} FROM {t}), rc(s, n) AS (SELECT DISTINCT a, a FROM e UNION SELECT rc.s, e.b FROM rc JOIN e ON rc.n = e.a), cc AS (SELECT s AS node, min(n) AS root FROM rc GROUP BY s)"
_WORDS = """ln AS (SELECT document_id, id AS page_number, unnest(string_split(text, '\n')) AS line, generate_subscripts(string_split(text, '\n'), 1) - 1 AS line_id FROM notes WHERE text IS NOT NULL),
 w0 AS (SELECT document_id, page_number, line_id, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM ln), w1 AS (SELECT document_id, page_number, line_id, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS pos FROM w0),
 wd AS (SELECT document_id, page_number, 'r' || CAST(line_id // 5 AS VARCHAR) AS region_id, line_id || ':' || pos AS word_id, text, ((page_number * 31 + line_id * 7 + pos * 17) % 97) / 97.0 AS confidence, pos * 12 AS x, line_id * 20 + pos % 3 AS y, line_id, pos FROM w1)"""
_EQ = r"""eb AS (SELECT *, regexp_replace(regexp_replace(latex, '\\[{}]', '', 'g'), '[^{}]', '', 'g') AS s FROM notes WHERE latex IS NOT NULL),
 ec AS (SELECT *, list_transform(range(1, length(s) + 1), lambda k: length(replace(s[1:k], '}', '')) - length(replace(s[1:k], '{', ''))) AS r FROM eb),
 eq AS (SELECT document_id, id AS page_number, 'e1' AS region_id, latex, coalesce(confidence, 0.5) AS confidence, coalesce(list_min(r), 0) >= 0 AND coalesce(r[-1], 0) = 0 AND len(regexp_extract_all(latex, '\\begin\{')) = len(regexp_extract_all(latex, '\\end\{')) AS render_ok FROM ec)"""
_BLOCKS = """bl AS (SELECT document_id, page_number, region_id, line_id, min(y) AS top, min(x) AS x, count(*) AS n, sum(confidence) AS c, string_agg(text, ' ' ORDER BY x) AS line FROM wd GROUP BY 1, 2, 3, 4),
 bk AS (SELECT document_id, page_number, region_id, min(x) AS x, min(top) AS y, CAST(sum(n) AS BIGINT) AS n_words, sum(c) / sum(n) AS mean_confidence, string_agg(line, '\n' ORDER BY top, line_id) AS text FROM bl GROUP BY 1, 2, 3)"""
_CORR = "cr AS (SELECT document_id, page_number, word_id, upper(text) AS text FROM wd WHERE line_id = 0 AND page_number % 7 = 0 UNION ALL SELECT document_id, id, 'zz', '?' FROM notes WHERE id % 11 = 0)"
_BOX = "bx0 AS (SELECT id AS page_id, unnest(string_split(text, '\n')) AS line, generate_subscripts(string_split(text, '\n'), 1) - 1 AS n FROM notes WHERE text IS NOT NULL), bx AS (SELECT page_id, CAST(page_id AS BIGINT) * 1000 + n AS box_id, n % 3 * 5 AS x, n * 20 + n // 4 * 200 AS y, length(line) * 6 + 1 AS w, n % 4 * 6 + 16 AS h FROM bx0)"
_INSIDE = "({i}.x >= {o}.x AND {i}.y >= {o}.y AND {i}.x + {i}.w <= {o}.x + {o}.w AND {i}.y + {i}.h <= {o}.y + {o}.h)"
_XO, _YO = "(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))", "(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
_INTER = f"(greatest(0, {_XO}) * greatest(0, {_YO}))"
_NP = "np AS (SELECT document_id, page, min(id) AS id, arg_min({'d': lecture_date, 't': text, 'l': latex, 'c': confidence}, id) AS r FROM notes GROUP BY 1, 2), nb AS (SELECT document_id, page, id, r.d AS lecture_date, r.t AS text, r.l AS latex, r.c AS confidence FROM np)"
_ASCII = r"cleaned_text IS NOT NULL AND regexp_full_match(text, '[\x00-\x7F]*') AND regexp_full_match(cleaned_text, '[\x00-\x7F]*')"
_SQ = r"regexp_replace({}, '\s+', '', 'g')"

QUERIES = {
    "topic_assignment": q_assign, "repeat_pairs": q_pairs, "repeat_groups": q_groups, "last_repeat_group": q_last_group, "link_texts": q_link_texts, "dedup_keep_first": q_keep_first,
    "page_blocks": q_blocks, "page_rebuild_text": q_page_texts, "page_confidence": q_confidence, "review_queue": q_review, "apply_corrections": q_corrected, "unknown_corrections": q_unknown_corrections,
    "split_word_boxes": q_split, "page_dedup_vectors": q_fold, "stitch_chains": q_chains, "box_iou_pairs": q_box_pairs, "page_regions": q_regions, "box_containment": q_strokes, "ordered_corners": q_corners, "merged_source_pages": q_sources,
    "questions_by_document": q_by_document, "questions_by_year": q_by_year, "questions_by_section": q_by_section, "questions_ordered_all": q_ordered, "documents_newest_first": q_documents, "document_by_id": q_document,
    "topics_by_code": q_topics, "page_contract": q_contract, "upload_order": q_upload, "first_upload_time": q_first_time, "notes_to_structure": q_to_structure, "flashcards": q_flashcards, "markdown_notes": q_markdown,
    "anki_rows": q_anki, "anki_rows_all": q_anki_all, "upsert_topics": q_upsert_topics, "upsert_notes": q_upsert_notes, "save_children_defaults": q_defaults, "integrity_check": q_integrity, "cascade_delete": q_cascade,
    "idempotent_insert": q_idempotent, "set_topics": q_set_topics, "set_repeat_groups": q_set_groups, "page_reorder": q_reorder, "levenshtein_cer": q_levenshtein, "text_error_rates": q_text_errors, "normalized_edit_distance": q_formula_errors, "confidence_calibration": q_calibration,
}

SQL = {
    "topic_assignment": f"WITH {_C}, s AS (SELECT v.id, c.topic_id, list_cosine_similarity(v.vector, c.vector) AS score FROM v CROSS JOIN c), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, topic_id) AS n FROM s) SELECT id, CAST(topic_id AS BIGINT) AS topic_id, round(score, 4) AS score FROM b WHERE n = 1 AND score >= {COSINE}",
    "repeat_pairs": f"WITH {_PAIRS} SELECT CAST(topic_id AS BIGINT) AS topic_id, l AS left, r AS right, round(score, 4) AS score FROM pr",
    "repeat_groups": f"WITH RECURSIVE {_PAIRS}, {_REACH.format(l='l', r='r', t='pr')} SELECT cc.node AS id, CAST(v.topic_id AS BIGINT) AS topic_id, dense_rank() OVER (ORDER BY v.topic_id, cc.root) + (SELECT coalesce(max(repeat_group_id), 0) FROM questions) AS repeat_group_id FROM cc JOIN v ON v.id = cc.node",
    "last_repeat_group": "SELECT coalesce(max(repeat_group_id), 0) AS last_group FROM questions",
    "link_texts": "SELECT id, coalesce(nullif(cleaned_text, ''), text) AS linked_text FROM questions UNION ALL SELECT -id, name || '. ' || syllabus_unit FROM topics",
    "dedup_keep_first": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
    "page_blocks": f"WITH {_WORDS}, {_BLOCKS} SELECT document_id, page_number, region_id, x, y, text, round(mean_confidence, 6) AS mean_confidence, n_words FROM bk",
    "page_rebuild_text": f"WITH {_WORDS}, {_BLOCKS}, it AS (SELECT document_id, page_number, y, x, region_id, text, NULL AS tex FROM bk WHERE text <> '' UNION ALL SELECT document_id, id, 100000, 0, 'e1', '$$ ' || latex || ' $$', latex FROM notes WHERE latex <> '') SELECT document_id, page_number, string_agg(text, '\n\n' ORDER BY y, x, region_id) AS text, coalesce(string_agg(tex, '\n' ORDER BY tex), '') AS latex FROM it GROUP BY 1, 2",
    "page_confidence": f"WITH {_WORDS}, {_EQ}, a AS (SELECT document_id, page_number, avg(confidence) AS cw FROM wd GROUP BY 1, 2), b AS (SELECT document_id, page_number, avg(confidence) AS ce FROM eq WHERE latex <> '' GROUP BY 1, 2) SELECT document_id, page_number, round((coalesce(cw, 0) + coalesce(ce, 0)) / (CASE WHEN cw IS NULL THEN 0 ELSE 1 END + CASE WHEN ce IS NULL THEN 0 ELSE 1 END), 4) AS confidence FROM a FULL JOIN b USING (document_id, page_number)",
    "review_queue": f"WITH {_WORDS}, {_EQ} SELECT document_id, page_number, 'word' AS kind, word_id AS item_id, text AS content, confidence FROM wd WHERE confidence < 0.6 UNION ALL SELECT document_id, page_number, 'equation', region_id, latex, confidence FROM eq WHERE confidence < 0.6 OR NOT render_ok",
    "apply_corrections": f"WITH {_WORDS}, {_CORR} SELECT document_id, page_number, word_id, cr.text, 1.0 AS confidence FROM wd JOIN cr USING (document_id, page_number, word_id)",
    "unknown_corrections": f"WITH {_WORDS}, {_CORR} SELECT document_id, page_number, word_id FROM cr ANTI JOIN wd USING (document_id, page_number, word_id)",
    "split_word_boxes": "WITH t AS (SELECT id AS box_id, name, id % 50 AS x, length(name) * 7 + 3 AS w, list_filter(string_split(name, ' '), lambda s: s <> '') AS ws FROM topics), u AS (SELECT *, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM t) SELECT box_id, pos, word, CAST(x + floor(w * (CASE WHEN pos = 0 THEN 0 ELSE length(array_to_string(ws[1:pos], ' ')) + 1 END) / length(name)) AS INTEGER) AS x, CAST(greatest(1, floor(w * length(word) / length(name))) AS INTEGER) AS w FROM u",
    "stitch_chains": "WITH m AS (SELECT document_id, id, lag(id) OVER w IS NULL OR id % 3 = 0 AS s FROM notes WINDOW w AS (PARTITION BY document_id ORDER BY id)), c AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY id) AS ch FROM m) SELECT document_id, min(id) AS first_page, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS source_pages FROM c GROUP BY document_id, ch",
    "box_iou_pairs": f"WITH {_BOX} SELECT a.page_id, a.box_id AS a, b.box_id AS b, round({_INTER} / (a.w * a.h + b.w * b.h - {_INTER}), 6) AS iou, {_INSIDE.format(o='a', i='b')} AS a_contains_b, {_INSIDE.format(o='b', i='a')} AS b_contains_a FROM bx a JOIN bx b ON a.page_id = b.page_id AND a.box_id < b.box_id WHERE {_INTER} > 0",
    "page_regions": f"""WITH RECURSIVE {_BOX}, mg AS (SELECT a.box_id AS l, b.box_id AS r FROM bx a JOIN bx b ON a.page_id = b.page_id AND a.box_id < b.box_id WHERE {_INTER} / greatest(1, a.w * a.h + b.w * b.h - {_INTER}) >= 0.35 OR {_INSIDE.format(o='a', i='b')} OR {_INSIDE.format(o='b', i='a')}
      OR (greatest(0, -{_YO}) <= greatest(a.h, b.h) * 0.55 AND greatest(0, -{_XO}) <= greatest(90.0, greatest(a.h, b.h) * 0.9) AND ({_XO} > 0 OR greatest(0, -{_XO}) <= 90.0)) OR ({_XO} > least(a.w, b.w) * 0.25 AND greatest(0, -{_YO}) <= greatest(greatest(a.h, b.h) * 1.8, 12.0))),
      {_REACH.format(l='l', r='r', t='mg')}, g AS (SELECT bx.*, coalesce(cc.root, bx.box_id) AS root FROM bx LEFT JOIN cc ON cc.node = bx.box_id),
      un AS (SELECT page_id, root, greatest(0, min(x)) AS x, greatest(0, min(y)) AS y, least(2000, max(x + w)) AS x2, least(4000, max(y + h)) AS y2 FROM g GROUP BY 1, 2)
      SELECT page_id, 'r' || lpad(CAST(row_number() OVER (PARTITION BY page_id ORDER BY y, x, root) AS VARCHAR), 3, '0') AS region_id, x, y, greatest(1, x2 - x) AS w, greatest(1, y2 - y) AS h FROM un""",
    "box_containment": f"WITH {_BOX} SELECT b.page_id, b.box_id, count(*) AS n_strokes FROM bx b JOIN bx s ON s.page_id = b.page_id AND s.x + 3 + s.w / 2 BETWEEN b.x AND b.x + b.w AND s.y + 7 + s.h / 2 BETWEEN b.y AND b.y + b.h GROUP BY 1, 2",
    "ordered_corners": "SELECT id AS page_id, c.corner, c.x + id % 3 AS x, c.y FROM notes CROSS JOIN (VALUES ('top_left', 3, 5), ('top_right', 95, 9), ('bottom_right', 90, 80), ('bottom_left', 7, 88)) c(corner, x, y)",
    "merged_source_pages": "SELECT id, CASE WHEN page = document_id THEN page || ',' || (page + 1) WHEN document_id = page + 1 THEN page || ',' || document_id ELSE page || ',' || document_id || ',' || (page + 1) END AS merged FROM notes",
    "questions_by_document": "SELECT id, document_id, page, year, section, marks FROM questions WHERE document_id = 1",
    "questions_by_year": "SELECT id, document_id, page, year, section, marks FROM questions WHERE year = 2020",
    "questions_by_section": "SELECT id, document_id, page, year, section, marks FROM questions WHERE upper(coalesce(section, '')) = 'A'",
    "questions_ordered_all": "SELECT id, document_id, page, year, section, marks FROM questions ORDER BY year DESC NULLS LAST, document_id, id",
    "documents_newest_first": "SELECT id, doc_type, file_name, year FROM source_documents ORDER BY id DESC",
    "document_by_id": "SELECT id, doc_type, file_name FROM source_documents WHERE id = 5",
    "topics_by_code": "SELECT id, topic_code, name, syllabus_unit FROM topics ORDER BY topic_code",
    "page_contract": "SELECT n.document_id, n.page AS page_number, n.id AS note_id, d.doc_type, d.taken_at FROM notes n JOIN source_documents d ON d.id = n.document_id",
    "upload_order": "SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(lecture_date, ''), id) AS page_number, 'p' || lpad(CAST(id AS VARCHAR), 9, '0') AS file_name FROM notes",
    "first_upload_time": "SELECT document_id, arg_min(lecture_date, id) AS taken_at FROM notes WHERE lecture_date <> '' GROUP BY document_id",
    "notes_to_structure": "SELECT id, document_id FROM notes WHERE text IS NOT NULL AND structured_content IS NULL",
    "flashcards": """WITH t AS (SELECT note_id, min(topic_id) AS topic_id FROM note_topics WHERE topic_id IS NOT NULL GROUP BY 1), q AS (SELECT topic_id, arg_min(text, id) AS qt, min(id) AS qid FROM questions WHERE repeat_group_id IS NOT NULL AND topic_id IS NOT NULL GROUP BY 1)
      SELECT n.id AS note_id, 'Key concept from page ' || page AS front, array_to_string(string_split(n.text, '\n')[1:2], ' ') || CASE WHEN qid IS NULL THEN '' ELSE '\n\n[Past Exam Context]: ' || qt END AS back, qid AS linked_question_id FROM notes n LEFT JOIN t ON t.note_id = n.id LEFT JOIN q ON q.topic_id = t.topic_id WHERE n.text IS NOT NULL""",
    "markdown_notes": "SELECT document_id, page, id AS note_id, '## Page ' || page || '\n' || CASE WHEN lecture_date <> '' THEN '**Lecture Date:** ' || lecture_date || '\n\n' ELSE '' END || CASE WHEN text <> '' THEN text || '\n\n' ELSE '' END || CASE WHEN latex <> '' THEN '**Equations:**\n$$\n' || latex || '\n$$\n\n' ELSE '' END || '---\n\n' AS markdown FROM notes",
    "anki_rows": "SELECT f.id AS flashcard_id, coalesce(q.text, 'Note Review (Page ' || n.page || ')') AS front, coalesce(n.text, '') || CASE WHEN n.latex <> '' THEN ' [LaTeX: ' || n.latex || ']' ELSE '' END AS back, 'StudyPlanner' AS tags FROM flashcards f JOIN notes n ON n.id = f.note_id LEFT JOIN questions q ON q.id = f.linked_question_id",
    "anki_rows_all": "WITH t AS (SELECT note_id, string_agg(DISTINCT 'topic_' || topic_id, ' ' ORDER BY 'topic_' || topic_id) AS t0, list_sort(list(DISTINCT topic_id)) AS l FROM note_topics WHERE topic_id IS NOT NULL GROUP BY 1) SELECT f.id AS flashcard_id, front, replace(back, chr(10), '<br>') AS back, 'study_platform' || CASE WHEN l IS NULL THEN '' ELSE ' ' || array_to_string(list_transform(l, lambda x: 'topic_' || x), ' ') END AS tags FROM flashcards f LEFT JOIN t ON t.note_id = f.note_id",
    "upsert_topics": """WITH nw AS (SELECT topic_code, name || ' v2' AS name, syllabus_unit, id AS seq FROM topics WHERE id % 3 = 0 UNION ALL SELECT topic_code, name || ' v3', syllabus_unit, id + 1000 FROM topics WHERE id % 6 = 0 UNION ALL SELECT 'NEW' || topic_code, name, syllabus_unit, id + 2000 FROM topics WHERE id % 50 = 0),
      ls AS (SELECT topic_code, arg_max(name, seq) AS name, arg_max(syllabus_unit, seq) AS unit FROM nw GROUP BY 1), j AS (SELECT t.id, coalesce(t.topic_code, ls.topic_code) AS topic_code, coalesce(ls.name, t.name) AS name, coalesce(ls.unit, t.syllabus_unit) AS syllabus_unit FROM topics t FULL JOIN ls ON ls.topic_code = t.topic_code)
      SELECT CAST(coalesce(id, (SELECT max(id) FROM topics) + row_number() OVER (PARTITION BY id IS NULL ORDER BY topic_code)) AS INTEGER) AS id, topic_code, name, syllabus_unit FROM j""",
    "upsert_notes": f"""WITH {_NP}, ad AS (SELECT document_id, max(page) + 1 AS page, arg_max({{'d': lecture_date, 't': text, 'l': latex}}, page) AS r FROM nb WHERE page IS NOT NULL GROUP BY 1),
      dl AS (SELECT document_id, page, lecture_date, text, latex FROM nb WHERE page % 3 = 0 UNION ALL SELECT document_id, page, r.d, r.t, r.l FROM ad),
      nw AS (SELECT document_id, page, upper(text) AS text, latex, 0.9 AS confidence, CASE WHEN page % 2 = 0 THEN '' ELSE lecture_date END AS lecture_date, CASE WHEN page % 4 = 0 THEN '2024-01-01' END AS taken_at, true AS hit FROM dl), od AS (SELECT * FROM nb)
      SELECT document_id, page, coalesce(nullif(nw.lecture_date, ''), nullif(nw.taken_at, ''), od.lecture_date) AS lecture_date, CASE WHEN hit THEN nw.text ELSE od.text END AS text, CASE WHEN hit THEN nw.latex ELSE od.latex END AS latex, CASE WHEN hit THEN nw.confidence ELSE od.confidence END AS confidence FROM od FULL JOIN nw USING (document_id, page)""",
    "save_children_defaults": "SELECT q.id, q.document_id, coalesce(q.year, d.year) AS year, coalesce(q.exam_type, d.exam_type) AS exam_type FROM questions q LEFT JOIN source_documents d ON d.id = q.document_id",
    "integrity_check": "SELECT id, document_id FROM questions WHERE document_id NOT IN (SELECT id FROM source_documents)",
    "cascade_delete": "SELECT id, document_id FROM questions WHERE document_id NOT IN (SELECT id FROM source_documents WHERE id % 5 = 0)",
    "idempotent_insert": "SELECT id, document_id FROM questions WHERE document_id % 4 <> 0",
    "set_topics": "SELECT id, coalesce(topic_id, id % 200 + 1) AS topic_id FROM questions",
    "set_repeat_groups": "SELECT id, CASE WHEN id % 10 = 0 THEN 7 ELSE repeat_group_id END AS repeat_group_id FROM questions",
    "page_reorder": f"WITH {_NP} SELECT document_id, CASE WHEN document_id % 2 = 0 THEN row_number() OVER (PARTITION BY document_id ORDER BY page DESC) ELSE page END AS page_number, id FROM nb",
    "levenshtein_cer": f"SELECT id, levenshtein(text, cleaned_text) AS distance FROM questions WHERE {_ASCII}",
    "normalized_edit_distance": f"SELECT count(*) AS samples, round(avg(CASE WHEN {_SQ.format('text')} = {_SQ.format('cleaned_text')} THEN 1.0 ELSE 0 END), 4) AS exact_match, round(avg(CASE WHEN {_SQ.format('cleaned_text')} <> '' AND id % 3 <> 0 THEN 1.0 ELSE 0 END), 4) AS render_rate, round(sum(levenshtein({_SQ.format('text')}, {_SQ.format('cleaned_text')})) / sum(length({_SQ.format('text')})), 4) AS normalized_edit_distance FROM questions WHERE {_ASCII}",
    "confidence_calibration": f"WITH {_WORDS}, r AS (SELECT confidence, length(text) % 5 <> 0 AS ok FROM wd) SELECT round(avg(CASE WHEN ok THEN confidence END), 4) AS mean_conf_right, round(avg(CASE WHEN NOT ok THEN confidence END), 4) AS mean_conf_wrong, round(count(*) FILTER (NOT ok AND confidence < 0.6) / count(*) FILTER (NOT ok), 4) AS wrong_flagged_share FROM r",
}
