"""What the pixels of a picture say, as Columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CROP = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x", "y", "width", "height")])

# A channel up to DARK is dark; a line with less than STRAY of its pixels lighter is a bar; pictures under
# LEAST on a side are left alone, and so are those of which less than KEPT would stay.
DARK, STRAY, LEAST, KEPT = 20, 0.02, 64, 0.5
# The worker's rule: a line is a bar where no pixel's channels add up to DARK_SUM; of the height KEPT_BY_WORKER has to stay.
DARK_SUM, KEPT_BY_WORKER = 90, 0.6


def without_bars(bars: np.ndarray, kept: float) -> tuple[int, int]:
    """First line and number of lines between the bars at both ends; all, where too few would stay or none is anything else."""
    other = np.flatnonzero(~bars)
    if not len(other) or other[-1] + 1 - other[0] < kept:
        return 0, len(bars)
    return int(other[0]), int(other[-1] + 1 - other[0])


def crop(data: bytes | None, width: int | None, height: int | None, channels: int, worker: bool) -> dict | None:
    if data is None or not width or not height or width < 0 or height < 0 or len(data) < width * height * channels:
        return None
    lines = np.frombuffer(data, np.uint8, width * height * channels).reshape(height, width, channels)[:, :, :3]
    if worker:
        first, n = without_bars(lines.sum(axis=2, dtype=np.int32).max(axis=1) < DARK_SUM, int(height * KEPT_BY_WORKER))
    elif width < LEAST or height < LEAST:
        first, n = 0, height
    else:
        first, n = without_bars((lines > DARK).any(axis=2).sum(axis=1) / width < STRAY, height * KEPT)
    return {"x": 0, "y": first, "width": width, "height": n}


def letterbox(data: Column, width: Column, height: Column, channels: int = 4, worker: bool = False) -> Column:
    """The part of a picture (bytes of its pixels, line by line) between black bars at its top and bottom: x, y, width, height.

    Bars at the sides stay, as do pictures that are too small, black all over, or would lose most of their height. Null where
    the bytes aren't as many as the sides say.
    """

    @F.pandas_udf(CROP)
    def crops(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        found = [crop(d, None if pd.isna(w) else int(w), None if pd.isna(h) else int(h), channels, worker) for d, w, h in zip(data, width, height, strict=True)]
        return pd.DataFrame({n: pd.Series([None if r is None else r[n] for r in found], dtype="object") for n in CROP.names})

    made = crops(data, width, height)
    return F.when(made["width"].isNotNull(), made)
