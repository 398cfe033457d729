"""Image measurements over a table of pixels: vec_id (the image), pos, x, y, r, g, b, a."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import clamp


def fixture_pixels(embeddings: DataFrame) -> DataFrame:
    """Embeddings of 64 values as 8 x 8 images."""
    rows = embeddings.select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.round(128 + 400 * F.col("e")))).cast("int")
    alpha = F.when((F.col("pos") == 0) & (F.col("vec_id") % 4 == 0), 30).otherwise(255)
    blue = F.greatest(F.lit(0), F.least(F.lit(255), v + F.col("label"))).cast("int")
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).alias("y"), v.alias("r"), v.alias("g"), blue.alias("b"), alpha.alias("a"))


def _distance(*pairs: tuple[str, str]) -> Column:
    total = F.lit(0.0)
    for a, b in pairs:
        total = total + (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    return F.sqrt(total)


def border_stats(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """vec_id, mean r, g, b of the sampled border and the mean distance from it; corners count twice, nearly
    transparent pixels not at all; 245 and 0 if none is left."""
    step = max(1, min(width, height) // 40)
    in_row = (F.col("x") % step == 0).cast("int") * ((F.col("y") == 0).cast("int") + (F.col("y") == height - 1).cast("int"))
    in_column = (F.col("y") % step == 0).cast("int") * ((F.col("x") == 0).cast("int") + (F.col("x") == width - 1).cast("int"))
    border = pixels.withColumn("k", F.when(F.col("a") >= 20, in_row + in_column).otherwise(0))
    mean = border.groupBy("vec_id").agg(*((F.sum(F.col("k") * F.col(c)) / F.sum("k")).alias(f"m{c}") for c in "rgb"))
    apart = border.join(mean, "vec_id").groupBy("vec_id").agg(*(F.first(f"m{c}").alias(c) for c in "rgb"), (F.sum(F.col("k") * _distance(("r", "mr"), ("g", "mg"), ("b", "mb"))) / F.sum("k")).alias("spread"))
    return apart.select("vec_id", *(F.coalesce(c, F.lit(245.0)).alias(c) for c in "rgb"), F.coalesce("spread", F.lit(0.0)).alias("spread"))


def masks(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """pixels with fg, alpha_aware and spread."""
    stats = border_stats(pixels, width, height).select("vec_id", *(F.col(c).alias(f"b{c}") for c in "rgb"), "spread")
    aware = pixels.groupBy("vec_id").agg((F.count_if(F.col("a") < 245) > width * height * 0.01).alias("alpha_aware"))
    threshold = F.greatest(F.lit(28.0), F.least(F.lit(82.0), 24 + 1.4 * F.col("spread")))
    far = F.round(_distance(("r", "br"), ("g", "bg"), ("b", "bb")), 9) > F.round(threshold, 9)
    return pixels.join(stats, "vec_id").join(aware, "vec_id").withColumn("fg", F.when(F.col("alpha_aware"), F.col("a") > 36).otherwise(far))


def mask_summary(mask: DataFrame, width: int, height: int) -> DataFrame:
    """Coverage, confidence and bounding box (the full frame if the mask is empty or nearly empty or full)."""
    fg = lambda c: F.when(F.col("fg"), F.col(c))
    per = mask.groupBy("vec_id").agg(F.first("alpha_aware").alias("alpha_aware"), F.first("spread").alias("spread"), (F.count_if("fg") / F.lit(width * height)).alias("coverage"), F.min(fg("x")).alias("x0"), F.max(fg("x")).alias("x1"), F.min(fg("y")).alias("y0"), F.max(fg("y")).alias("y1"))
    c = F.col("coverage")
    plain = clamp(1 - F.col("spread") / 80) * F.when((c > 0.03) & (c < 0.92), 1.0).otherwise(0.35)
    confidence = F.when(F.col("alpha_aware"), clamp(0.85 + F.least(F.lit(0.14), c))).otherwise(plain)
    whole = F.col("x0").isNull() | (c < 0.02) | (c > 0.96)
    box = {"min_x": (0, "x0"), "min_y": (0, "y0"), "max_x": (width - 1, "x1"), "max_y": (height - 1, "y1")}
    return per.select("vec_id", "alpha_aware", "coverage", confidence.alias("confidence"), *(F.when(whole, F.lit(a)).otherwise(F.col(b)).alias(n) for n, (a, b) in box.items()))


def square_crop(boxes: DataFrame, width: int, height: int, padding: float = 0.14) -> DataFrame:
    """boxes (min_x .. max_y) with crop_x, crop_y, crop_side: the box padded by a share of its longer side, as a square
    around its centre, moved inside the frame."""
    half_up = lambda x: F.floor(x + 0.5)
    inside = lambda x, most: F.greatest(F.lit(0), F.least(F.lit(most), x))
    pad = half_up(F.greatest(F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1) * padding)
    padded = boxes.withColumns({"__x0": inside(F.col("min_x") - pad, width - 1), "__y0": inside(F.col("min_y") - pad, height - 1), "__x1": inside(F.col("max_x") + pad, width - 1), "__y1": inside(F.col("max_y") + pad, height - 1)})
    padded = padded.withColumn("__side", F.greatest(F.col("__x1") - F.col("__x0") + 1, F.col("__y1") - F.col("__y0") + 1))
    start = lambda a, b, size: F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), size - F.col("__side")), half_up((F.col(a) + F.col(b)) / 2 - F.col("__side") / 2)))
    placed = padded.withColumns({"crop_x": start("__x0", "__x1", F.lit(width)), "crop_y": start("__y0", "__y1", F.lit(height))})
    return placed.withColumn("crop_side", F.least("__side", width - F.col("crop_x"), height - F.col("crop_y"))).drop("__x0", "__y0", "__x1", "__y1", "__side")


def gray(r: Column, g: Column, b: Column) -> Column:
    luma = 0.2126 * r + 0.7152 * g + 0.0722 * b
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (luma - 128) * 1.12 + 128))).cast("int")


def query_quality(width: Column, height: Column, blur: Column, exposure: Column, coverage: Column) -> Column:
    resolution = F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), width * height)) / 900)
    return clamp(0.25 * resolution + 0.25 * F.coalesce(blur, F.lit(0.0)) + 0.20 * F.coalesce(exposure, F.lit(0.0)) + 0.30 * F.coalesce(coverage, F.lit(0.0)))


def foreground_action(complexity: Column, coverage: Column, confidence: Column) -> Column:
    return F.when(coverage < 0.05, "fallback_original").when(complexity < 0.35, "skip_removal").when(confidence >= 0.70, "use_mask").otherwise("fallback_original")
