"""Texts to sections and paragraphs, with array functions and windows over a document's lines.

Rows: doc_id, section_idx, para_idx (running through the document), heading, level, text, in_blockquote. A section
without paragraphs is a row whose para_idx and text are null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import trim

COLUMNS = ("doc_id", "section_idx", "para_idx", "heading", "level", "text", "in_blockquote")


def plain(raw: DataFrame) -> DataFrame:
    """Paragraphs between empty lines, trimmed, empty ones dropped; one section without heading. Row by row, no shuffle."""
    parts = F.filter(F.transform(F.split("text", "\n\n"), trim), lambda p: p != "")
    rows = raw.select("doc_id", F.posexplode(parts).alias("para_idx", "text"))
    return rows.select(
        "doc_id", F.lit(0).alias("section_idx"), "para_idx", F.lit(None).cast("string").alias("heading"), F.lit(0).alias("level"), "text", F.lit(False).alias("in_blockquote")
    )


def markdown(raw: DataFrame) -> DataFrame:
    """Headings, paragraphs and blockquotes of a small Markdown.

    Front matter between --- lines, fenced code and table lines go; a line `## References` or `*References*` ends the text.
    A line in # starts a section; a line in > makes its whole paragraph a blockquote; an empty line ends a paragraph.
    All steps are running counts over a document's lines, which one shuffle by doc_id brings together.
    """
    lines = raw.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"\r\z", "")).withColumn("bare", trim(F.col("line")))
    doc = W.partitionBy("doc_id")
    so_far = doc.orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    front = F.max(F.expr("n = 0 AND bare = '---'")).over(doc)
    closes = F.min(F.expr("IF(n > 0 AND bare = '---', n, NULL)")).over(doc)
    body = lines.withColumn("front", front).withColumn("closes", closes).where("NOT front OR n > closes")
    fenced = body.withColumn("fence", F.expr("startswith(bare, '```')")).withColumn("fences", F.sum(F.col("fence").cast("int")).over(so_far))
    text = fenced.where("NOT fence AND fences % 2 = 0 AND NOT startswith(bare, '|')")
    ends = F.min(F.expr("IF(bare IN ('## References', '*References*'), n, NULL)")).over(doc)
    text = text.withColumn("ends", ends).where("ends IS NULL OR n < ends")
    text = text.withColumn("is_heading", F.expr("startswith(bare, '#')")).withColumn("breaks", F.expr("is_heading OR bare = ''"))
    text = text.withColumn("sec", F.sum(F.col("is_heading").cast("int")).over(so_far)).withColumn("par", F.sum(F.col("breaks").cast("int")).over(so_far))
    quoted = F.expr("startswith(bare, '>')")
    body_line = F.when(quoted, trim(F.regexp_replace("bare", "^>+", ""))).otherwise(F.col("line"))
    grouped = text.where("NOT breaks").groupBy("doc_id", "sec", "par").agg(
        F.array_sort(F.collect_list(F.struct("n", body_line.alias("line")))).alias("lines"), F.max(quoted).alias("in_blockquote")
    )
    paragraphs = grouped.select("doc_id", "sec", "par", trim(F.array_join("lines.line", "\n")).alias("text"), "in_blockquote").where("text <> ''")
    hashes = F.regexp_extract("bare", "^#+", 0)
    headings = text.where("is_heading").select("doc_id", "sec", trim(F.expr("ltrim('#', bare)")).alias("heading"), F.length(hashes).alias("level"))
    joined = paragraphs.join(headings, ["doc_id", "sec"], "full").withColumn("level", F.coalesce("level", F.lit(0)))
    order = doc.orderBy("sec", F.col("par").asc_nulls_first())
    return joined.select(
        "doc_id",
        (F.dense_rank().over(doc.orderBy("sec")) - 1).alias("section_idx"),
        F.when(F.col("text").isNotNull(), F.sum(F.col("text").isNotNull().cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int").alias("para_idx"),
        "heading", "level", "text", "in_blockquote",
    )


Decomposer = Callable[[DataFrame], DataFrame]
DECOMPOSERS: dict[str, Decomposer] = {"markdown": markdown, "plain": plain}


def decompose(raw: DataFrame, decomposers: dict[str, Decomposer] | None = None) -> DataFrame:
    """Each document by the decomposer of its format; formats without one are the gates' business."""
    table = DECOMPOSERS if decomposers is None else decomposers
    parts = [f(raw.where(F.col("format") == name)).select(*COLUMNS) for name, f in table.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
