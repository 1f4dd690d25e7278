"""How numbers are shown, colours, sizes of tiles, and tests of messages and names, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import base_of, fnv1a

# Extensions of videos, widths of stored thumbnails, names of channel layouts.
VIDEO_EXTENSIONS = ("mkv", "mp4", "webm", "mov", "m4v", "avi", "ts", "mpg", "mpeg")
THUMB_WIDTHS = (160, 320, 640)
CHANNEL_LAYOUTS = {1: "Mono", 2: "Stereo", 3: "2.1", 6: "5.1", 8: "7.1"}


def is_video_name(name: Column) -> Column:
    return F.lower(name).rlike(rf"\.({'|'.join(VIDEO_EXTENSIONS)})$")


def is_transient_error(message: Column) -> Column:
    """Not the file's fault: it is tried again."""
    return message.rlike("(?i)victim changed|no decode victim|victim is playing|Scan aborted")


def is_hang_error(message: Column) -> Column:
    return message.rlike("(?i)unresponsive|hung|decoder is stuck")


def is_timeout_error(message: Column) -> Column:
    return message.rlike("(?i)timed out|inactivity timeout")


def is_hdr(tracks: Column, live: Column) -> Column:
    """Whether a decoder says so now, or a video track (kind, hdr, colorTransfer) does."""
    track = lambda t: (t["kind"] == "video") & (F.coalesce(t["hdr"], F.lit(False)) | F.coalesce(t["colorTransfer"].isin("pq", "hlg"), F.lit(False)))
    return F.coalesce(live, F.lit(False)) | F.coalesce(F.exists(tracks, track), F.lit(False))


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + 0.5)


def hours_minutes(seconds: Column) -> Column:
    """1h30m, 2h or 45m; empty for what isn't a duration."""
    total = rounded(seconds)
    h, m = F.floor(total / 3600), F.floor(total % 3600 / 60)
    text = F.when(h == 0, F.concat(m.cast("string"), F.lit("m"))).otherwise(F.concat(h.cast("string"), F.lit("h"), F.when(m > 0, F.concat(m.cast("string"), F.lit("m"))).otherwise("")))
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf")), "").otherwise(text)


def clock(seconds: Column) -> Column:
    """h:mm:ss or m:ss; ? where unknown."""
    total = F.greatest(F.lit(0), rounded(seconds))
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    return F.when(seconds.isNull(), "?").when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def bit_rate(bps: Column) -> Column:
    return F.when(bps >= 1_000_000, F.format_string("%.2f Mbps", bps / 1_000_000)).when(bps >= 1000, F.format_string("%.0f kbps", bps / 1000)).when(bps > 0, F.concat(bps.cast("string"), F.lit(" bps")))


def sample_rate(hz: Column) -> Column:
    return F.when(hz >= 1000, F.format_string("%.1f kHz", hz / 1000)).when(hz > 0, F.concat(hz.cast("string"), F.lit(" Hz")))


def channels(n: Column) -> Column:
    layout = F.create_map(*(F.lit(x) for pair in CHANNEL_LAYOUTS.items() for x in pair))
    return F.when(n > 0, F.concat(n.cast("string"), F.coalesce(F.concat(F.lit(" ("), F.element_at(layout, n), F.lit(")")), F.lit(""))))


def name_hue(name: Column) -> Column:
    return fnv1a(name) % 360


def title_hue(text: Column) -> Column:
    """By the hash h = 31 h + unit over UTF-16 units, 32 bits."""
    units = F.encode(text, "UTF-16BE")
    unit = lambda i: F.conv(F.hex(F.substring(units, 2 * i + 1, 2)), 16, 10).cast("long")
    places = F.when(F.octet_length(units) > 0, F.sequence(F.lit(0), (F.octet_length(units) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0).cast("long"), lambda h, i: (h * 31 + unit(i)) % (1 << 32)) % 360


def group_hue(group: Column) -> Column:
    """By the golden angle."""
    return group * 137.508 % 360


def thumb_width(needed: Column, there: Column) -> Column:
    """The width, of those in there (array), to show where so many pixels are needed: the fitting one, else a larger, else a smaller one."""
    wanted = F.when(needed <= 200, THUMB_WIDTHS[0]).when(needed <= 400, THUMB_WIDTHS[1]).otherwise(THUMB_WIDTHS[2])
    larger = F.array_min(F.filter(there, lambda w: w >= wanted))
    smaller = F.array_min(F.filter(there, lambda w: w < wanted))
    return F.coalesce(larger, smaller)


def thumb_times(duration: Column) -> Column:
    """Seconds at which a thumbnail is sought, in order: the middle of a short video (under half an hour), a fifth into others, then earlier ones."""
    first = F.when(duration < 1800, duration / 2).otherwise(duration * 0.2)
    return F.array_distinct(F.filter(F.array(first, duration * 0.1, duration * 0.05, F.lit(1.0), F.lit(0.0)), lambda t: (t >= 0) & ((duration == 0) | (t <= duration))))


def column_widths(available: Column, slot: Column, gap: Column) -> Column:
    """Whole widths of as many columns as fit, which fill the row; the first ones take what is left over. Empty where not one fits."""
    n = F.greatest(F.lit(1), F.floor((available + gap) / (slot + gap))).cast("int")
    inner = available - (n - 1) * gap
    each = F.floor(inner / n)
    widths = F.transform(F.sequence(F.lit(0), n - 1), lambda c: (each + F.when(c < inner - each * n, 1).otherwise(0)).cast("long"))
    return F.when(available >= slot, widths).otherwise(F.array().cast("array<bigint>"))


def avatar_square(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """The square around a face's box that lies within its frame: x, y, side."""
    side = F.least(F.greatest(x2 - x1, y2 - y1, F.lit(1.0)), width, height)
    at = lambda a, b, size: F.greatest(F.lit(0.0), F.least((a + b) / 2 - side / 2, size - side))
    return F.struct(at(x1, x2, width).alias("x"), at(y1, y2, height).alias("y"), side.alias("side"))


def later_version(a: Column, b: Column) -> Column:
    """The later of two ISO times; nulls lose."""
    return F.greatest(a, b)


def in_folder_name(path: Column, text: str) -> Column:
    return F.contains(F.lower(path), F.lit(text.strip().lower()))


def stem_of(path: Column) -> Column:
    """A file's name without its last extension, lower-case; a name that only has a dot in front stays whole."""
    name = base_of(path)
    return F.lower(F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name))
