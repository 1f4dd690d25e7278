"""Boxes, points and bits, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def similarity(source: Column, target: Column) -> Column:
    """The similarity (scale and turn a, b and shift tx, ty: x' = a x - b y + tx, y' = b x + a y + ty) that takes source points (array of x, y structs) nearest to target's, by least squares; in the plane that is a quotient of sums. Null where the source points are one."""
    n = F.size(source)
    pairs = F.zip_with(source, target, lambda p, q: F.struct(p["x"].alias("x"), p["y"].alias("y"), q["x"].alias("u"), q["y"].alias("v")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p))
    x, y, u, v = (total(lambda p, c=c: p[c]) for c in "xyuv")
    # n times the sums about the means: whole points give whole sums, and one division ends each number.
    size = n * total(lambda p: p["x"] * p["x"] + p["y"] * p["y"]) - x * x - y * y
    a = n * total(lambda p: p["x"] * p["u"] + p["y"] * p["v"]) - x * u - y * v
    b = n * total(lambda p: p["x"] * p["v"] - p["y"] * p["u"]) - x * v + y * u
    return F.when(size > 0, F.struct((a / size).alias("a"), (b / size).alias("b"), ((size * u - a * x + b * y) / (n * size)).alias("tx"), ((size * v - b * x - a * y) / (n * size)).alias("ty")))


def moved(fit: Column, x: Column, y: Column) -> Column:
    """A point after a similarity."""
    return F.struct((fit["a"] * x - fit["b"] * y + fit["tx"]).alias("x"), (fit["b"] * x + fit["a"] * y + fit["ty"]).alias("y"))


def anchor_boxes(outputs: DataFrame, stride: int, least: float, size: int = 640, per_cell: int = 2) -> DataFrame:
    """Boxes that a detector's outputs (key, score: array, bbox: array of four for each score) stand for: key, idx, x1, y1, x2, y2, score; scores below the least are left out."""
    cells = size // stride
    rows = outputs.select("key", "bbox", F.posexplode("score").alias("idx", "score")).where(F.col("score") >= least)
    cell = F.expr(f"idx div {per_cell}")
    ax, ay = (cell % cells + 0.5) * stride, (F.floor(cell / cells) + 0.5) * stride
    side = lambda k: F.get("bbox", F.col("idx") * 4 + k) * stride
    return rows.select("key", "idx", (ax - side(0)).alias("x1"), (ay - side(1)).alias("y1"), (ax + side(2)).alias("x2"), (ay + side(3)).alias("y2"), "score")


def ten_bit_groups(data: Column) -> Column:
    """The bits of bytes, first bit first, as numbers of ten bits; the last is filled up with zeros."""
    bits = F.regexp_replace(F.hex(data), "(.)", "$1")
    nibbles = F.transform(F.split(bits, ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0"))
    text = F.array_join(nibbles, "")
    n = F.ceil(F.length(text) / 10).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.rpad(F.substring(text, i * 10 + 1, F.lit(10)), 10, "0"), 2, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def mono(planar: Column, channels: Column) -> Column:
    """Samples of one channel after another (array), averaged over the channels."""
    frames = F.floor(F.size(planar) / channels).cast("int")
    sample = lambda i: F.aggregate(F.sequence(F.lit(0), channels - 1), F.lit(0.0), lambda s, c: s + F.get(planar, c * frames + i)) / channels
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), sample)).otherwise(F.array().cast("array<double>"))
