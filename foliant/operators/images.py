"""Grey-level work for four-level displays: as columns on pixel rows, and in numpy where order matters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEVICES = {"x4": (480, 800), "x3": (528, 792)}
LEVELS = (0, 85, 170, 255)


def luma(r: Column, g: Column, b: Column) -> Column:
    """BT.601 luma in 16-bit fixed point."""
    return F.shiftright((r.cast("int") * 19595 + g.cast("int") * 38470 + b.cast("int") * 7471 + 32768), 16)


def fit(w: Column, h: Column, most_w: Column, most_h: Column) -> tuple[Column, Column]:
    """Size within bounds at the same proportions, never larger than it was, one pixel at least."""
    scale = F.least(F.lit(1.0), most_w.cast("double") / w, most_h.cast("double") / h)
    return tuple(F.greatest(F.lit(1), F.floor(x * scale + 0.5).cast("int")) for x in (w, h))


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id", "v").agg(F.count("*").alias("n"))


def autocontrast_bounds(hist: DataFrame, cutoff: int = 1) -> DataFrame:
    """(image_id, low, high): the levels left when ``cutoff`` percent is cut at either end."""
    w = W.partitionBy("image_id")
    seen = hist.withColumn("cut", F.expr(f"sum(n) over (partition by image_id) * {cutoff} div 100"))
    seen = seen.withColumn("up", F.sum("n").over(w.orderBy("v"))).withColumn("down", F.sum("n").over(w.orderBy(F.desc("v"))))
    return seen.groupBy("image_id").agg(F.min(F.when(F.col("up") > F.col("cut"), F.col("v"))).alias("low"), F.max(F.when(F.col("down") > F.col("cut"), F.col("v"))).alias("high"))


def stretch(v: Column, low: Column, high: Column) -> Column:
    """A level after the range low..high is stretched to 0..255."""
    scale = F.lit(255.0) / (high - low)
    value = (v * scale + (-low) * scale).cast("int")
    return F.when(high <= low, v).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), value)))


def contrast(v: Column, mean: Column, factor: float) -> Column:
    """A level moved away from the mean (a whole number) by a factor, in single precision."""
    f = F.lit(factor).cast("float")
    return F.least(F.lit(255), F.greatest(F.lit(0), (mean.cast("float") + f * (v.cast("float") - mean.cast("float"))).cast("int")))


def mean_level(v: Column) -> Column:
    return F.floor(F.avg(v) + 0.5).cast("int")


def dither(gray: np.ndarray, levels=LEVELS) -> np.ndarray:
    """Error diffusion onto the nearest levels (of two as near the lower), row by row from the left."""
    height, width = gray.shape
    own = np.zeros((height + 1, width + 2), np.float32)
    own[:height, 1:-1] = gray
    out = np.zeros((height, width), np.uint8)
    marks = np.array(levels, np.float32)
    for y in range(height):
        for x in range(1, width + 1):
            old = own[y, x]
            new = marks[np.argmin(np.abs(marks - old))]
            out[y, x - 1] = new
            error = old - new
            own[y, x + 1] += error * np.float32(7 / 16)
            own[y + 1, x - 1] += error * np.float32(3 / 16)
            own[y + 1, x] += error * np.float32(5 / 16)
            own[y + 1, x + 1] += error * np.float32(1 / 16)
    return out


def flatten(rgba: np.ndarray) -> np.ndarray:
    """Transparent pixels laid on white."""
    c, a = rgba[..., :3].astype(np.int32), rgba[..., 3:].astype(np.int32)
    return ((c * a + 255 * (255 - a) + 127) // 255).astype(np.uint8)


def split_spread(image: np.ndarray, rotate_left: bool = False) -> list[np.ndarray]:
    """A wide spread as its right and left half, a landscape page turned to the left or right, a portrait page as it is."""
    h, w = image.shape[:2]
    if w <= h:
        return [image]
    if w / h > 1.8:
        return [image[:, w // 2 :], image[:, : w // 2]]
    return [np.rot90(image, 1 if rotate_left else -1)]


def gray_to_rgb(gray: np.ndarray) -> np.ndarray:
    return np.repeat(gray[..., None], 3, axis=-1)


def largest_sampling(components):
    """(image_id, hmax, vmax) over the components (image_id, h, v) of each image."""
    return components.groupBy("image_id").agg(F.max("h").alias("hmax"), F.max("v").alias("vmax"))
