"""Sub-picture packets: the chain of commands that says when, where and in which colours, and the run-length coded bitmap.

A packet is one cue, of some kilobytes; both functions map a column of packets, as many at once as Arrow brings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTS = T.ArrayType(T.IntegerType())
CONTROL = T.StructType([T.StructField("ok", T.BooleanType()), *(T.StructField(n, INTS if n in ("colors", "alpha") else T.IntegerType()) for n in ("showMs", "hideMs", "colors", "alpha", "x1", "x2", "y1", "y2", "top", "bottom"))])
BITMAP = T.StructType([T.StructField("ok", T.BooleanType()), *(T.StructField(n, T.IntegerType()) for n in ("x", "y", "width", "height")), T.StructField("rgba", T.BinaryType())])

# Commands, and the bytes that follow them.
SHOW, FORCE_SHOW, HIDE, COLORS, ALPHA, AREA, OFFSETS, CHANGES, END = 1, 0, 2, 3, 4, 5, 6, 7, 255
LENGTHS = {SHOW: 0, FORCE_SHOW: 0, HIDE: 0, COLORS: 2, ALPHA: 2, AREA: 6, OFFSETS: 4}
MOST_SEQUENCES, MOST_PIXELS = 64, 4096


def word(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 2])


def nibbles(pair: bytes) -> list[int]:
    """Four numbers, for pixel values 0 to 3: they are stored last first."""
    return [pair[1] & 15, pair[1] >> 4, pair[0] & 15, pair[0] >> 4]


def held_size(data: bytes) -> int:
    """Bytes of a packet: what it claims or what is there, whichever is less."""
    return min(word(data, 0) or len(data), len(data))


def commands(data: bytes, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Commands of one sequence with their bytes, up to its end, one that is cut off, or one that isn't known."""
    while at < end:
        code, at = data[at], at + 1
        if code == CHANGES and at + 2 <= end:
            at += word(data, at)  # its length counts itself
        elif code in LENGTHS and at + LENGTHS[code] <= end:
            yield code, data[at : at + LENGTHS[code]]
            at += LENGTHS[code]
        else:
            return


def sequences(data: bytes) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Delay (ms) and commands of each sequence along the chain."""
    end = held_size(data)
    at = word(data, 2)
    for _ in range(MOST_SEQUENCES):
        if at < 4 or at + 4 > end:
            return
        yield int(word(data, at) * 1024 * 1000 / 90000 + 0.5), list(commands(data, at + 4, end))
        following = word(data, at + 2)
        if following == at or following >= end:
            return
        at = following


def read_control(data: bytes | None) -> dict | None:
    """What a packet says of its first display, None where that can't be shown.

    Looks are those of the sequence that gives the bitmap's place and of those before; later ones only fade it out and tell
    when it ends. If so far nothing can be seen, the first later alpha that shows something counts: a fade-in.
    """
    if data is None or len(data) < 4 or word(data, 2) >= held_size(data):
        return None
    out: dict = {"showMs": None, "hideMs": None, "colors": [0, 1, 2, 3], "alpha": [0, 15, 15, 15], "top": None}
    for delay, each in sequences(data):
        settled = out["top"] is not None
        for code, args in each:
            if code in (SHOW, FORCE_SHOW):
                out["showMs"] = delay if out["showMs"] is None else out["showMs"]
            elif code == HIDE:
                out["hideMs"] = delay if out["hideMs"] is None else out["hideMs"]
            elif code == ALPHA and (not settled or not any(out["alpha"]) and any(args)):
                out["alpha"] = nibbles(args)
            elif settled:
                continue
            elif code == COLORS:
                out["colors"] = nibbles(args)
            elif code == AREA:
                x, y = int.from_bytes(args[:3]), int.from_bytes(args[3:])
                out |= {"x1": x >> 12, "x2": x & 0xFFF, "y1": y >> 12, "y2": y & 0xFFF}
            elif code == OFFSETS:
                out |= {"top": word(args, 0), "bottom": word(args, 2)}
    if out["top"] is None or "x1" not in out or out["x2"] < out["x1"] or out["y2"] < out["y1"]:
        return None
    return out | {"showMs": out["showMs"] or 0}


def unpacked_field(data: bytes, at: int, end: int, pixels: np.ndarray, rows: range) -> None:
    """Fill every other line of pixels from runs of one to four half bytes: the last two bits are the value, the others the length, 0 for the rest of the line."""
    halves = np.frombuffer(data[at:end], np.uint8)
    halves = np.stack([halves >> 4, halves & 15], axis=1).reshape(-1).tolist()
    n, width, i = len(halves), pixels.shape[1], 0
    for row in rows:
        x = 0
        while x < width:
            if i >= n:
                return
            run = 0
            for least in (4, 16, 64, 0):  # a run is as long as it is small
                run = run << 4 | (halves[i] if i < n else 0)
                i += 1
                if run >= least:
                    break
            length = run >> 2
            length = width - x if length == 0 else min(length, width - x)
            pixels[row, x : x + length] = run & 3
            x += length
        i += i & 1  # lines begin with whole bytes


def read_bitmap(data: bytes | None, palette: list[int] | np.ndarray | None) -> dict | None:
    """Place, size and RGBA bytes of a packet; None where nothing can be seen."""
    c = read_control(data)
    if c is None or not any(c["alpha"]):
        return None
    width, height = c["x2"] - c["x1"] + 1, c["y2"] - c["y1"] + 1
    if width > MOST_PIXELS or height > MOST_PIXELS:
        return None
    pixels, end = np.zeros((height, width), np.uint8), held_size(data)
    unpacked_field(data, c["top"], end, pixels, range(0, height, 2))
    unpacked_field(data, c["bottom"], end, pixels, range(1, height, 2))
    named = [int(x) for x in palette] if palette is not None else []
    rgb = [named[i] if i < len(named) else 0 for i in c["colors"]]
    looks = np.array([[x >> 16 & 255, x >> 8 & 255, x & 255, a * 17] for x, a in zip(rgb, c["alpha"], strict=True)], np.uint8)
    return {"x": c["x1"], "y": c["y1"], "width": width, "height": height, "rgba": looks[pixels].tobytes()}


def frame_of(rows: list[dict | None], schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r is not None if n == "ok" else None if r is None else r[n] for r in rows], dtype=object) for n in schema.names})


@F.pandas_udf(CONTROL)
def _control(data: pd.Series) -> pd.DataFrame:
    return frame_of([read_control(x) for x in data], CONTROL)


@F.pandas_udf(BITMAP)
def _bitmap(data: pd.Series, palette: pd.Series) -> pd.DataFrame:
    return frame_of([read_bitmap(x, p) for x, p in zip(data, palette, strict=True)], BITMAP)


def control(data: str) -> Column:
    """Struct of a packet's timing, looks and place (column by name), null where it can't be shown."""
    c = _control(F.col(data))
    return F.when(c["ok"], c)


def bitmap(data: str, palette: str) -> Column:
    """Struct of a packet's place, size and RGBA bytes, null where nothing can be seen."""
    b = _bitmap(F.col(data), F.col(palette))
    return F.when(b["ok"], b)
