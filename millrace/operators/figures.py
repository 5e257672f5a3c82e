"""Images of pages and the captions nearest to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import block_text, caption_kind, is_caption


def nearest_captions(blocks: DataFrame) -> DataFrame:
    """path, page, index, kind, caption, bbox of every image block.

    ``blocks``: path, page, pos, type (0 text, 1 image), bbox, lines. The
    caption is the caption-like text block of the page with the smallest
    vertical gap to the image, the first of equal ones; a caption may serve
    several images. ``index`` counts images through the document, from 1.
    """
    images = blocks.filter("type = 1").select("path", "page", "pos", "bbox")
    captions = blocks.filter("type = 0").withColumn("caption", block_text(F.col("lines"))).filter(is_caption(F.col("caption")))
    captions = captions.select("path", "page", F.col("pos").alias("c_pos"), F.col("bbox").alias("c_bbox"), "caption")
    met = images.join(captions, ["path", "page"], "left")
    below = F.abs(F.get("c_bbox", F.lit(1)) - F.get("bbox", F.lit(3)))
    above = F.abs(F.get("bbox", F.lit(1)) - F.get("c_bbox", F.lit(3)))
    best = met.groupBy("path", "page", "pos").agg(
        F.first("bbox").alias("bbox"),
        F.min_by("caption", F.struct(F.least(below, above).alias("gap"), F.col("c_pos"))).alias("caption"),
    )
    order = Window.partitionBy("path").orderBy("page", "pos")
    return best.select(
        "path", "page", F.row_number().over(order).alias("index"),
        F.when(F.col("caption").isNull(), "figure").otherwise(caption_kind(F.col("caption"))).alias("kind"),
        F.coalesce("caption", F.lit("")).alias("caption"),
        F.transform("bbox", lambda x: F.bround(x, 1)).alias("bbox"),
    )


def figure_documents(figures: DataFrame) -> DataFrame:
    """path, source, text, figure: documents whose text is the caption, or a stand-in where there is none."""
    name = F.element_at(F.split("path", "/"), -1)
    stand_in = F.concat(F.lit("["), F.col("kind"), F.lit(" on page "), F.col("page").cast("string"), F.lit("]"))
    return figures.select(
        "path", F.concat(name, F.lit("#fig"), F.col("page").cast("string"), F.lit("-"), F.col("index").cast("string")).alias("source"),
        F.when(F.col("caption") == "", stand_in).otherwise(F.col("caption")).alias("text"),
        F.struct("page", "index", "kind", "caption", "bbox").alias("figure"),
    )
