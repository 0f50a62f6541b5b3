"""The visual pass: glyph visibility, image coverage, grid occupancy, regions, annotations, and classes of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.functions import numbers
from glyphlake.schema import PAGE, REGION_SAMPLES, REGION_TYPES


def visibility(g: dict[str, Column]) -> dict[str, Column]:
    """Kinds of visibility of a painted glyph; g: fill, stroke, fill_alpha, stroke_alpha, x, y, crop (x, y, w, h), in_clip."""
    invisible = ~g["fill"] & ~g["stroke"]
    transparent = ~invisible & (~g["fill"] | (g["fill_alpha"] <= 0)) & (~g["stroke"] | (g["stroke_alpha"] <= 0))
    c = g["crop"]
    off = (g["x"] < c["x"]) | (g["x"] > c["x"] + c["w"]) | (g["y"] < c["y"]) | (g["y"] > c["y"] + c["h"])
    clipped = ~off & ~g["in_clip"]
    return {"invisible": invisible, "transparent": transparent, "off_page": off, "clipped": clipped, "visible": ~(invisible | transparent | off | clipped)}


def rotated(shear_y: Column, scale_x: Column) -> Column:
    return F.abs(F.atan2(shear_y, scale_x)) > 1e-4


def visibility_counters(glyphs: DataFrame) -> DataFrame:
    """Counts by page, of painted glyphs with their page's crop."""
    kinds = visibility({c: F.col(c) for c in ("fill", "stroke", "fill_alpha", "stroke_alpha", "x", "y", "crop", "in_clip")})
    rows = glyphs.select(*PAGE, *(v.alias(k) for k, v in kinds.items()), rotated(F.col("shear_y"), F.col("scale_x")).alias("rotated"), "vertical")
    return rows.groupBy(*PAGE).agg(*(F.count_if(k).alias(f"{k}_count") for k in (*kinds, "rotated", "vertical")))


def duplicate_glyphs(glyphs: DataFrame) -> DataFrame:
    """Glyphs drawn again at the same place: by page, rows less distinct (x, y, code, font). Two aggregations, so that rows are summed before they are dealt."""
    spot = [numbers.nearest(F.col("x") * 1000).alias("rx"), numbers.nearest(F.col("y") * 1000).alias("ry"), "code", "font_name"]
    once = glyphs.select(*PAGE, *spot).groupBy(*PAGE, "rx", "ry", "code", "font_name").agg(F.count("*").alias("n"))
    return once.groupBy(*PAGE).agg((F.sum("n") - F.count("*")).alias("duplicate_count"))


def clipped_box(crop: Column) -> list[Column]:
    """x0, y0, x1, y1 within the crop."""
    return [F.greatest("x0", crop["x"]).alias("x0"), F.greatest("y0", crop["y"]).alias("y0"), F.least("x1", crop["x"] + crop["w"]).alias("x1"), F.least("y1", crop["y"] + crop["h"]).alias("y1")]


def coverage(images: DataFrame) -> DataFrame:
    """Number of images and largest share of the page by page; images: x0, y0, x1, y1, crop, and area where what is seen of an image is
    less than its bounds."""
    w, h = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")), F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    own = [F.col("area")] if "area" in images.columns else []
    rows = images.select(*PAGE, "crop", *own, *clipped_box(F.col("crop")))
    whole = F.col("crop.w") * F.col("crop.h")
    share = F.when((F.col("crop.w") > 0) & (F.col("crop.h") > 0), F.least(F.lit(1.0), F.coalesce(*own, w * h) / whole)).otherwise(0.0)
    return rows.groupBy(*PAGE).agg(F.count("*").alias("image_count"), F.max(share).alias("max_coverage"))


def union_share(images: DataFrame) -> DataFrame:
    """Exact share of the page under the union of its images, by coordinate compression.

    Edges cut a page in vertical strips; in each strip the covered height is found by one running maximum, so the work is
    (images of a page) * (strips they span), never images squared over the corpus. Only a page's own images meet.
    """
    rows = images.select(*PAGE, "crop", *clipped_box(F.col("crop"))).filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    edges = rows.select(*PAGE, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    strips = edges.withColumn("to", F.lead("x").over(W.partitionBy(*PAGE).orderBy("x"))).filter("to is not null")
    inside = strips.join(rows, PAGE).filter((F.col("x0") <= F.col("x")) & (F.col("x1") >= F.col("to")))
    by = W.partitionBy(*PAGE, "x").orderBy("y0", "y1").rowsBetween(W.unboundedPreceding, -1)
    low = F.greatest(F.col("y0"), F.coalesce(F.max("y1").over(by), F.col("y0")))
    area = F.greatest(F.lit(0.0), F.col("y1") - F.col("low")) * (F.col("to") - F.col("x"))
    summed = inside.withColumn("low", low).groupBy(*PAGE).agg(F.sum(area).alias("area"), F.max(F.col("crop.w") * F.col("crop.h")).alias("whole"))
    return summed.select(*PAGE, F.least(F.lit(1.0), F.col("area") / F.col("whole")).alias("union_share"), "area")


def cells_of_box(crop: Column) -> Column:
    """Bit mask of the 8 x 8 cells that a box within the crop touches."""
    first = lambda v, lo, size: F.greatest(F.lit(0), F.least(F.lit(7), F.floor((v - lo) / size * 8).cast("int")))
    last = lambda v, lo, size: F.greatest(F.lit(0), F.least(F.lit(7), (F.ceil((v - lo) / size * 8) - 1).cast("int")))
    c0, c1 = first(F.col("x0"), crop["x"], crop["w"]), last(F.col("x1"), crop["x"], crop["w"])
    r0, r1 = first(F.col("y0"), crop["y"], crop["h"]), last(F.col("y1"), crop["y"], crop["h"])
    row = F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("bigint"), c1 - c0 + 1) - 1, c0)
    rows = F.aggregate(F.sequence(r0, r1), F.lit(0).cast("bigint"), lambda acc, r: acc.bitwiseOR(F.call_function("shiftleft", F.col("row"), r * 8)))
    return rows, row


def grid_overlap(images: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Cells of an 8 x 8 grid that images and visible glyphs occupy by page, their overlap, and its share of the image cells."""
    boxes = images.select(*PAGE, "crop", *clipped_box(F.col("crop"))).filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    rows, row = cells_of_box(F.col("crop"))
    image = boxes.withColumn("row", row).withColumn("mask", rows).groupBy(*PAGE).agg(F.bit_or("mask").alias("image_mask"))
    crop = F.col("crop")
    cell = numbers.grid_cell(F.col("y"), crop["y"], crop["h"]) * 8 + numbers.grid_cell(F.col("x"), crop["x"], crop["w"])
    inside = (crop["w"] > 0) & (crop["h"] > 0) & (F.col("x") >= crop["x"]) & (F.col("x") <= crop["x"] + crop["w"]) & (F.col("y") >= crop["y"]) & (F.col("y") <= crop["y"] + crop["h"])
    bits = glyphs.filter(inside).select(*PAGE, F.call_function("shiftleft", F.lit(1).cast("bigint"), cell).alias("bit")).groupBy(*PAGE).agg(F.bit_or("bit").alias("text_mask"))
    both = image.join(bits, PAGE, "full_outer").fillna(0, ["image_mask", "text_mask"])
    n = {k: F.bit_count(v).cast("bigint") for k, v in (("image_cells", F.col("image_mask")), ("text_cells", F.col("text_mask")), ("overlap_cells", F.col("image_mask").bitwiseAND(F.col("text_mask"))))}
    share = F.when(n["image_cells"] > 0, n["overlap_cells"] / n["image_cells"]).otherwise(0.0)
    return both.select(*PAGE, *(v.alias(k) for k, v in n.items()), share.alias("overlap_ratio"))


def classification(glyphs: Column, images: Column, paths: Column, chars: Column, combined: Column, cells: Column, overlap: Column) -> Column:
    """The class of a page, from its counters; combined: share of the page under images; cells: those that images occupy."""
    bare = F.when(images > 0, "IMAGE_ONLY").when(paths > 0, "VECTOR_ONLY").otherwise("BLANK")
    return F.when(glyphs == 0, bare).when(images == 0, "NATIVE_TEXT").when((combined >= 0.75) & (chars <= 32), "SPARSE_OCR").when((combined >= 0.75) & (cells > 0) & (overlap < 0.25), "PARTIAL_OCR").otherwise("MIXED")


def regions(boxes: DataFrame) -> DataFrame:
    """Displayed boxes of visible boxes (type, paint_no, x0, y0, x1, y1, crop, rotation); those outside the crop are left out."""
    rows = boxes.select(*PAGE, "type", "paint_no", "crop", "rotation", *clipped_box(F.col("crop"))).filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    return numbers.displayed(rows).select(*PAGE, "type", "paint_no", "x", "y", "w", "h")


def region_counts(shown: DataFrame) -> DataFrame:
    """Exact counts by page and type, and whether samples are fewer."""
    by = shown.groupBy(*PAGE, "type").agg(F.count("*").alias("n")).groupBy(*PAGE)
    one = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, F.col("n"))), F.lit(0).cast("bigint"))
    return by.agg(F.sum("n").alias("total_region_count"), one("IMAGE").alias("image_regions"), one("ANNOTATION").alias("annotation_regions"), one("FORM_FIELD").alias("form_field_regions"), one("VECTOR_PATH").alias("vector_path_regions"), (F.max("n") > REGION_SAMPLES).alias("truncated"))


def region_samples(shown: DataFrame) -> DataFrame:
    """The first samples of each page and type in paint order."""
    by = W.partitionBy(*PAGE, "type").orderBy("paint_no")
    return shown.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= REGION_SAMPLES).withColumn("n", F.col("n").cast("int"))


def hidden_depth(operators: DataFrame) -> DataFrame:
    """Nesting depth of hidden content after each operator; operators: seq, and step: 1 for a hidden begin, -1 for its end, 0 else."""
    return operators.withColumn("depth", F.sum("step").over(W.partitionBy(*PAGE).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))


def annotation_shown(a: dict[str, Column]) -> Column:
    """Whether an annotation has a region; oc_hidden is null where there is no optional content, oc_unknown where it can't be evaluated."""
    finite = F.coalesce(a["w"] > 0, F.lit(False)) & F.coalesce(a["h"] > 0, F.lit(False))
    return ~a["hidden"] & ~a["invisible"] & ~a["no_view"] & ~F.coalesce(a["oc_hidden"], F.lit(False)) & ~a["oc_unknown"] & finite
