"""Colours of sub-pictures, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a file names no palette: greys, but for the usual background, outline, fill and shade.
DEFAULT_PALETTE = [0x000000, 0x000000, 0xFFFFFF, 0x808080, *(0x010101 * round(i / 15 * 255) for i in range(4, 16))]


def yuv_rgb(y: Column, cb: Column, cr: Column) -> Column:
    """0xRRGGBB of a colour by BT.601 with studio swing."""
    level = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(c + 0.5))).cast("int")
    luma, u, v = 1.164 * (y - 16), cb - 128, cr - 128
    return level(luma + 1.596 * v) * 65536 + level(luma - 0.813 * v - 0.391 * u) * 256 + level(luma + 2.018 * u)


def idx_palette(header: Column) -> Column:
    """16 numbers of the palette line of an .idx header; colours that it doesn't give are those of DEFAULT_PALETTE."""
    line = F.regexp_extract(F.coalesce(header, F.lit("")), r"(?m)^[ \t]*palette:([^\r\n]*)", 1)
    parts = F.transform(F.split(line, ","), lambda x: F.regexp_extract(x, r"^\s*(?:0[xX])?([0-9A-Fa-f]+)", 1))
    given = lambda i: F.get(parts, i)
    value = lambda i: F.when(given(i) != "", F.conv(F.right(given(i), F.lit(6)), 16, 10).cast("int"))
    return F.transform(F.array(*map(F.lit, DEFAULT_PALETTE)), lambda grey, i: F.coalesce(value(i), grey))


def idx_size(header: Column) -> Column:
    """width and height of the size line of an .idx header, null without one."""
    part = lambda i: F.nullif(F.regexp_extract(F.coalesce(header, F.lit("")), r"(?mi)^[ \t]*size:\s*(\d+)\s*x\s*(\d+)\s*$", i), F.lit("")).cast("int")
    return F.struct(part(1).alias("width"), part(2).alias("height"))
