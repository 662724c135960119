"""Pages of scanned text: reading order, confidence, review queue, corrections, greedy page folding, boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.params import DEFAULT

PAGE = ("document_id", "page_number")


def block_texts(words: DataFrame) -> DataFrame:
    """(page, region_id, x, y, text, mean_confidence): words joined by x within lines, lines by their top.

    Words of a line are joined in order of x, lines in order of their smallest y (then line_id); one page's words are
    bounded by the page.
    """
    lines = words.groupBy(*PAGE, "region_id", "line_id").agg(F.min("y").alias("top"), F.min("x").alias("x"), F.count("*").alias("n"), F.sum("confidence").alias("c"), F.array_sort(F.collect_list(F.struct("x", "word_id", "text"))).alias("w"))
    lines = lines.withColumn("line", F.array_join(F.transform("w", lambda w: w["text"]), " "))
    blocks = lines.groupBy(*PAGE, "region_id").agg(F.min("x").alias("x"), F.min("top").alias("y"), F.sum("n").alias("n_words"), (F.sum("c") / F.sum("n")).alias("mean_confidence"), F.array_sort(F.collect_list(F.struct("top", "line_id", "line"))).alias("l"))
    return blocks.select(*PAGE, "region_id", "x", "y", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"), "mean_confidence", "n_words")


def page_texts(blocks: DataFrame, equations: DataFrame) -> DataFrame:
    """(page, text, latex): blocks and equations in order of (y, x), equations between double dollar signs."""
    items = blocks.where("text <> ''").select(*PAGE, "y", "x", "region_id", "text", F.lit(None).cast("string").alias("tex")).unionByName(
        equations.where("latex <> ''").select(*PAGE, "y", "x", "region_id", F.concat(F.lit("$$ "), "latex", F.lit(" $$")).alias("text"), F.col("latex").alias("tex")))
    sorted_items = F.array_sort(F.collect_list(F.struct("y", "x", "region_id", "text", "tex")))
    both = items.groupBy(*PAGE).agg(sorted_items.alias("i"))
    return both.select(*PAGE, F.array_join(F.transform("i", lambda x: x["text"]), "\n\n").alias("text"), F.array_join(F.array_sort(F.filter(F.transform("i", lambda x: x["tex"]), lambda t: t.isNotNull())), "\n").alias("latex"))


def page_confidence(words: DataFrame, equations: DataFrame) -> DataFrame:
    """(page, confidence): mean of the words' mean and the equations' mean, of those that exist, to 4 decimals."""
    w = words.groupBy(*PAGE).agg(F.avg("confidence").alias("cw"))
    e = equations.where("latex <> ''").groupBy(*PAGE).agg(F.avg("confidence").alias("ce"))
    both = w.join(e, list(PAGE), "full")
    n = F.when(F.col("cw").isNotNull(), 1).otherwise(0) + F.when(F.col("ce").isNotNull(), 1).otherwise(0)
    return both.select(*PAGE, F.round((F.coalesce("cw", F.lit(0.0)) + F.coalesce("ce", F.lit(0.0))) / n, 4).alias("confidence"))


def low_words(words: DataFrame, threshold: float = DEFAULT.low_confidence) -> DataFrame:
    return words.where(~F.col("corrected") & (F.col("confidence") < threshold))


def low_equations(equations: DataFrame, threshold: float = DEFAULT.low_confidence) -> DataFrame:
    return equations.where(~F.col("corrected") & ((F.col("confidence") < threshold) | ~F.col("render_ok")))


def review_queue(words: DataFrame, equations: DataFrame, threshold: float = DEFAULT.low_confidence) -> DataFrame:
    """(page, kind, item_id, content, confidence) of what needs a look, least confident first, then by page and kind."""
    items = low_words(words, threshold).select(*PAGE, F.lit("word").alias("kind"), F.col("word_id").alias("item_id"), F.col("text").alias("content"), "confidence").unionByName(
        low_equations(equations, threshold).select(*PAGE, F.lit("equation").alias("kind"), F.col("region_id").alias("item_id"), F.col("latex").alias("content"), "confidence"))
    return items.orderBy("confidence", *PAGE, F.when(F.col("kind") == "word", 0).otherwise(1), "item_id")


def corrected_words(words: DataFrame, corrections: DataFrame) -> DataFrame:
    """The words with (document_id, page_number, word_id, text) corrections put in, marked, at confidence 1."""
    new = corrections.groupBy(*PAGE, "word_id").agg(F.max("text").alias("new_text"))
    hit = F.col("new_text").isNotNull()
    return words.join(new, [*PAGE, "word_id"], "left").withColumns({"text": F.coalesce("new_text", "text"), "corrected": F.col("corrected") | hit, "confidence": F.when(hit, F.lit(1.0)).otherwise(F.col("confidence"))}).drop("new_text").select(*words.columns)


def unknown_corrections(words: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections that point at no word; a caller rejects the request when there are any."""
    return corrections.join(words.select(*PAGE, "word_id"), [*PAGE, "word_id"], "left_anti")


def split_by_share(boxes: DataFrame) -> DataFrame:
    """(box_id, pos, word, x, w): words of a box (box_id, text, x, w) at their share of its characters."""
    words = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    parts = boxes.select("box_id", "x", "w", F.greatest(F.length("text"), F.lit(1)).alias("n"), words.alias("words"))
    before = F.transform("words", lambda t, i: F.aggregate(F.slice("words", F.lit(1), i), F.lit(0), lambda a, y: a + F.length(y) + 1))
    rows = parts.select("box_id", "x", "w", "n", F.posexplode(F.arrays_zip(F.col("words").alias("word"), before.alias("before"))).alias("pos", "z"))
    return rows.select("box_id", "pos", F.col("z.word").alias("word"), (F.col("x") + F.floor(F.col("w") * F.col("z.before") / F.col("n"))).cast("int").alias("x"), F.greatest(F.lit(1), F.floor(F.col("w") * F.length("z.word") / F.col("n"))).cast("int").alias("w"))


def scaled(value, factor: float):
    """A confidence or coordinate rescaled: clamped to 0..1 and rounded to 4 decimals."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value * F.lit(factor))), 4)


# ---- greedy folding of pages ----------------------------------------------------------------------------------------


#: Least correlation of two pages as a whole and in each quarter, and the least deviation of a page that isn't blank;
#: fixed values.
WHOLE, QUARTER, LEAST_STD = 0.93, 0.88, 0.02


def areas(image: np.ndarray) -> list[np.ndarray]:
    """A square fingerprint as five vectors of length 1 (0 where constant): the whole, then its quarters."""
    y, x = image.shape[0] // 2, image.shape[1] // 2
    out = []
    for part in (image, image[:y, :x], image[:y, x:], image[y:, :x], image[y:, x:]):
        v = part.ravel() - part.mean() if part.size else part.ravel()
        length = float(np.linalg.norm(v))
        out.append(v / length if length > 1e-4 else np.zeros_like(v))
    return out


class KeptPages:
    """Fingerprints of the pages kept of one document, by side length, one growing matrix for each area."""

    def __init__(self, whole: float, quarter: float):
        self.least = np.array([whole, *[quarter] * 4])
        self.held: dict[int, tuple[list[np.ndarray], list[int]]] = {}

    def first_match(self, image: np.ndarray) -> int | None:
        """The first kept page that correlates in every area; all kept pages are compared by one product an area."""
        held, places = self.held.get(image.shape[0], ([], []))
        if not places or image.std() < LEAST_STD:
            return None
        n = len(places)
        alike = np.all([rows[:n] @ v >= low for rows, v, low in zip(held, areas(image), self.least)], axis=0)
        return places[int(alike.argmax())] if alike.any() else None

    def add(self, image: np.ndarray, place: int) -> None:
        if image.std() < LEAST_STD:
            return  # a blank page matches nothing
        vectors = areas(image)
        held, places = self.held.setdefault(image.shape[0], ([np.zeros((8, len(v))) for v in vectors], []))
        for k, v in enumerate(vectors):
            if len(places) == len(held[k]):
                held[k] = np.concatenate([held[k], np.zeros_like(held[k])])
            held[k][len(places)] = v
        places.append(place)


def fold_pages(pages: DataFrame, whole: float = WHOLE, quarter: float = QUARTER, parts: int | None = None) -> DataFrame:
    """(document_id, page_number, source_page_numbers) of the pages kept: later copies are folded into the first match.

    Input (document_id, page_number, fingerprint: a square array). A page is compared with the pages kept before it, in
    order, which no join expresses; documents are streamed sorted through the tasks, and only the kept pages of the
    document at hand are held. A null fingerprint is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, kept, prints = object(), [], KeptPages(whole, quarter)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([document] * len(kept), pa.int64()), pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.list_(pa.int64()))], names=["document_id", "page_number", "source_page_numbers"])

        for batch in batches:
            for doc, number, print_ in zip(batch["document_id"].to_pylist(), batch["page_number"].to_pylist(), batch["fingerprint"].to_pylist()):
                if doc != document:
                    if kept:
                        yield flush()
                    document, kept, prints = doc, [], KeptPages(whole, quarter)
                image, match = None, None
                if print_ is not None:
                    side = int(len(print_) ** 0.5)
                    image = np.asarray(print_[: side * side], dtype=np.float64).reshape(side, side)
                    match = prints.first_match(image)
                if match is None:
                    if image is not None:
                        prints.add(image, len(kept))
                    kept.append((number, [number]))
                elif number not in kept[match][1]:
                    kept[match][1].append(number)
        if kept:
            yield flush()

    rows = pages.select(F.col("document_id").cast("long").alias("document_id"), F.col("page_number").cast("long").alias("page_number"), "fingerprint").where("document_id is not null")
    rows = rows.repartition(parts, "document_id") if parts else rows.repartition("document_id")
    return rows.sortWithinPartitions("document_id", "page_number").mapInArrow(run, "document_id long, page_number long, source_page_numbers array<long>")


def stitch_chains(pages: DataFrame) -> DataFrame:
    """(document_id, first_page, source_pages): runs of pages of which each joins the one before.

    Input (document_id, page_number, joins_previous); the image blend itself is a seam. The chain of a page is a running
    count of the pages that join nothing.
    """
    w = Window.partitionBy("document_id").orderBy("page_number")
    first = F.lag("page_number").over(w).isNull() | ~F.coalesce("joins_previous", F.lit(False))
    marked = pages.select("document_id", "page_number", first.alias("starts"))
    chain = F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = marked.withColumn("chain", chain)
    return numbered.groupBy("document_id", "chain").agg(F.min("page_number").alias("first_page"), F.array_join(F.transform(F.array_sort(F.collect_list("page_number")), lambda p: p.cast("string")), ",").alias("source_pages")).drop("chain")


def merged_sources(a, b):
    """Source pages of two pages in order, each once."""
    return F.array_distinct(F.concat(a, b))


# ---- boxes ----------------------------------------------------------------------------------------------------------


def box_pairs(boxes: DataFrame) -> DataFrame:
    """(page_id, a, b, iou, a_contains_b, b_contains_a), a < b: boxes (page_id, box_id, x, y, w, h) of a page that meet.

    The boxes of one page are bounded by the page, so the join on page_id emits no unbounded group.
    """
    left, right = boxes.toDF("page_id", "a", "ax", "ay", "aw", "ah"), boxes.toDF("page_id", "b", "bx", "by", "bw", "bh")
    both = left.join(right, "page_id").where("a < b")
    ix = F.greatest(F.lit(0), F.least(F.col("ax") + F.col("aw"), F.col("bx") + F.col("bw")) - F.greatest("ax", "bx"))
    iy = F.greatest(F.lit(0), F.least(F.col("ay") + F.col("ah"), F.col("by") + F.col("bh")) - F.greatest("ay", "by"))
    both = both.withColumn("inter", ix * iy).where("inter > 0")
    union = F.col("aw") * F.col("ah") + F.col("bw") * F.col("bh") - F.col("inter")
    inside = lambda o, i: (F.col(f"{i}x") >= F.col(f"{o}x")) & (F.col(f"{i}y") >= F.col(f"{o}y")) & (F.col(f"{i}x") + F.col(f"{i}w") <= F.col(f"{o}x") + F.col(f"{o}w")) & (F.col(f"{i}y") + F.col(f"{i}h") <= F.col(f"{o}y") + F.col(f"{o}h"))
    return both.select("page_id", "a", "b", F.round(F.col("inter") / union, 6).alias("iou"), inside("a", "b").alias("a_contains_b"), inside("b", "a").alias("b_contains_a"))


def box_merges(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(page_id, left, right): boxes of a page that belong to one block: overlapping, contained, on one line, stacked."""
    left, right = boxes.toDF("page_id", "a", "ax", "ay", "aw", "ah"), boxes.toDF("page_id", "b", "bx", "by", "bw", "bh")
    c = F.col
    both = left.join(right, "page_id").where("a < b")
    x_overlap = F.least(c("ax") + c("aw"), c("bx") + c("bw")) - F.greatest("ax", "bx")
    y_overlap = F.least(c("ay") + c("ah"), c("by") + c("bh")) - F.greatest("ay", "by")
    gap_x, gap_y, tall = F.greatest(F.lit(0), -x_overlap), F.greatest(F.lit(0), -y_overlap), F.greatest("ah", "bh")
    inter = F.greatest(F.lit(0), x_overlap) * F.greatest(F.lit(0), y_overlap)
    iou = inter / F.greatest(F.lit(1), c("aw") * c("ah") + c("bw") * c("bh") - inter)
    inside = lambda o, i: (c(f"{i}x") >= c(f"{o}x")) & (c(f"{i}y") >= c(f"{o}y")) & (c(f"{i}x") + c(f"{i}w") <= c(f"{o}x") + c(f"{o}w")) & (c(f"{i}y") + c(f"{i}h") <= c(f"{o}y") + c(f"{o}h"))
    line = (gap_y <= tall * 0.55) & (gap_x <= F.greatest(F.lit(0.045 * width), tall * 0.9)) & ((x_overlap > 0) | (gap_x <= 0.045 * width))
    stack = (x_overlap > F.least("aw", "bw") * 0.25) & (gap_y <= F.greatest(tall * 1.8, F.lit(0.12 * height)))
    return both.where((iou >= 0.35) | inside("a", "b") | inside("b", "a") | line | stack).select("page_id", c("a").alias("left"), c("b").alias("right"))


def merged_boxes(boxes: DataFrame, groups: DataFrame, width: int, height: int) -> DataFrame:
    """(page_id, region_id, x, y, w, h): the union box of each group (node, root), clipped to the page, named in reading order."""
    rows = boxes.join(groups.toDF("box_id", "root"), "box_id", "left").withColumn("root", F.coalesce("root", "box_id"))
    x2, y2 = F.least(F.lit(width), F.max(F.col("x") + F.col("w"))), F.least(F.lit(height), F.max(F.col("y") + F.col("h")))
    union = rows.groupBy("page_id", "root").agg(F.greatest(F.lit(0), F.min("x")).alias("x"), F.greatest(F.lit(0), F.min("y")).alias("y"), x2.alias("x2"), y2.alias("y2"))
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("y", "x", "root"))
    return union.select("page_id", F.concat(F.lit("r"), F.lpad(order.cast("string"), 3, "0")).alias("region_id"), "x", "y", F.greatest(F.lit(1), F.col("x2") - F.col("x")).alias("w"), F.greatest(F.lit(1), F.col("y2") - F.col("y")).alias("h"))


def strokes_in_blocks(strokes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, box_id, n_strokes): strokes (page_id, x, y, w, h) whose centre lies in a block (page_id, box_id, x, y, w, h)."""
    s = strokes.select("page_id", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    hit = F.col("cx").between(F.col("x"), F.col("x") + F.col("w")) & F.col("cy").between(F.col("y"), F.col("y") + F.col("h"))
    return blocks.join(s, "page_id").where(hit).groupBy("page_id", "box_id").agg(F.count("*").alias("n_strokes"))


def ordered_corners(points: DataFrame) -> DataFrame:
    """(page_id, corner, x, y): of four points the ones with the least and largest x + y and y - x."""
    total, diff, p = F.col("x") + F.col("y"), F.col("y") - F.col("x"), F.struct("x", "y")
    found = points.groupBy("page_id").agg(F.min_by(p, total).alias("top_left"), F.min_by(p, diff).alias("top_right"), F.max_by(p, total).alias("bottom_right"), F.max_by(p, diff).alias("bottom_left"))
    rows = found.select("page_id", F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in ("top_left", "top_right", "bottom_right", "bottom_left"))), F.array("top_left", "top_right", "bottom_right", "bottom_left"))).alias("corner", "p"))
    return rows.select("page_id", "corner", "p.x", "p.y")
