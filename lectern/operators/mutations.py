"""Changes of stored tables as pure transforms: each gives the next version of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_topics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Topics by topic_code: the last of ``new`` (by seq) wins over the old row, whose id is kept; ids go on for the rest.

    ``new`` has topic_code, name, syllabus_unit and seq. Codes are few per syllabus; the numbering of new codes runs
    over those alone.
    """
    last = new.groupBy("topic_code").agg(F.max_by(F.struct("name", "syllabus_unit"), "seq").alias("n")).select("topic_code", F.col("n.name").alias("new_name"), F.col("n.syllabus_unit").alias("new_unit"))
    both = old.select("id", "topic_code", "name", "syllabus_unit").join(last, "topic_code", "full")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = F.row_number().over(Window.partitionBy(F.col("id").isNull()).orderBy("topic_code"))
    return both.crossJoin(F.broadcast(top)).select(F.coalesce("id", F.when(F.col("id").isNull(), F.col("top") + fresh)).cast("int").alias("id"), "topic_code", F.coalesce("new_name", "name").alias("name"), F.coalesce("new_unit", "syllabus_unit").alias("syllabus_unit"))


def upsert_notes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Notes by (document_id, page): new text, latex and confidence win; the date is the new one, else the new page's
    time, else the old date."""
    n = new.select("document_id", "page", *(F.col(c).alias(f"new_{c}") for c in ("text", "latex", "confidence", "lecture_date", "taken_at")), F.lit(True).alias("hit"))
    both = old.select("document_id", "page", "lecture_date", "text", "latex", "confidence").join(n, ["document_id", "page"], "full")
    pick = lambda c: F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    date = F.coalesce(F.nullif("new_lecture_date", F.lit("")), F.nullif("new_taken_at", F.lit("")), F.col("lecture_date"))
    return both.select("document_id", "page", date.alias("lecture_date"), pick("text"), pick("latex"), pick("confidence"))


def children_with_defaults(children: DataFrame, documents: DataFrame) -> DataFrame:
    """Questions with year and exam type of their document where they have none; the rest stays as it is."""
    parent = documents.select(F.col("id").alias("document_id"), F.col("year").alias("_y"), F.col("exam_type").alias("_t"))
    return children.join(parent, "document_id", "left").withColumns({"year": F.coalesce("year", "_y"), "exam_type": F.coalesce("exam_type", "_t")}).drop("_y", "_t").select(*children.columns)


def orphaned_children(children: DataFrame, documents: DataFrame) -> DataFrame:
    """Children whose document is unknown: what a foreign key would refuse."""
    return children.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def without_documents(children: DataFrame, deleted: DataFrame) -> DataFrame:
    """Children left when documents (id) are deleted with all that is theirs."""
    return children.join(deleted.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def not_yet_stored(new: DataFrame, stored: DataFrame, key: str = "document_id") -> DataFrame:
    """New rows of documents of which nothing is stored: processing a document again changes nothing."""
    return new.join(stored.select(key).distinct(), key, "left_anti")


def with_topics(questions: DataFrame, assigned: DataFrame) -> DataFrame:
    """Questions with (id, topic_id) put in where they had no topic."""
    new = assigned.select(F.col("id").cast("int").alias("id"), F.col("topic_id").cast("int").alias("_t"))
    return questions.join(new, "id", "left").withColumn("topic_id", F.coalesce("topic_id", "_t")).drop("_t").select(*questions.columns)


def with_repeat_groups(questions: DataFrame, groups: DataFrame) -> DataFrame:
    """Questions with (id, repeat_group_id) put in; others keep theirs."""
    new = groups.select(F.col("id").cast("int").alias("id"), F.col("repeat_group_id").cast("int").alias("_g"))
    return questions.join(new, "id", "left").withColumn("repeat_group_id", F.coalesce("_g", "repeat_group_id")).drop("_g").select(*questions.columns)


def reordered_pages(pages: DataFrame, orders: DataFrame) -> DataFrame:
    """Pages renumbered by (document_id, new_order: array of old numbers); documents without an order stay.

    An order that doesn't have exactly the document's number of pages fails at run time, as the request would.
    """
    n = pages.groupBy("document_id").agg(F.count("*").alias("n"))
    checked = orders.join(n, "document_id").select("document_id", F.when(F.size("new_order") == F.col("n"), F.col("new_order")).otherwise(F.raise_error(F.lit("an order names another number of pages than the document has"))).alias("new_order"))
    moves = checked.select("document_id", F.posexplode("new_order").alias("pos", "page_number"))
    moved = pages.join(moves, ["document_id", "page_number"]).withColumn("page_number", F.col("pos") + 1).drop("pos").select(*pages.columns)
    return moved.unionByName(pages.join(orders.select("document_id"), "document_id", "left_anti").select(*pages.columns))
