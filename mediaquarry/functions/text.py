"""Text functions as Columns: search predicates, paths, names, labels, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The collation of names that people read.
NAMES = "UNICODE"


# White space, characters that can't be shown, and a clock's form.
SPACES = r"\t\n\x0B\f\r\x20\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
UNSHOWN = r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}\u2028\u2029\uFFFD&&[^\n\t]]"
CLOCK = r"(?:(\d{1,2}):)?(\d{1,2}):(\d{2})[.,](\d{1,3})"


def match_filter(expression: str, value: Column) -> Column:
    """Whether value satisfies a boolean text expression: | is or, & is and, a leading ! negates.

    A term of letters, digits and spaces alone is sought with everything else taken out of both sides; any other term is
    sought as it stands. An empty term (so also an empty expression or branch) holds for every value.
    """
    low = F.trim(F.lower(value))
    bare = F.regexp_replace(low, "[^a-z0-9]", "")

    def term(text: str) -> Column:
        text = text.strip()
        leaf = text[1:].strip() if text.startswith("!") else text
        plain = "".join(c for c in leaf if c.isascii() and c.isalnum())
        if any(not (c.isascii() and c.isalnum() or c.isspace()) for c in leaf):
            holds = F.contains(low, F.lit(leaf))
        elif plain:
            holds = F.contains(bare, F.lit(plain))
        else:
            holds = F.lit(True)
        return ~holds if text.startswith("!") else holds

    wanted = expression.lower().strip()
    if not wanted:
        return F.lit(True)
    branches = [reduce(Column.__and__, map(term, branch.split("&"))) for branch in wanted.split("|")]
    return reduce(Column.__or__, branches)


def collated(name: Column) -> Column:
    return F.collate(name, NAMES)


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-16 units, 32 bits: characters beyond the basic plane count as their two surrogates."""
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long")
    step = lambda h, unit: F.expr("0L") + h.bitwiseXOR(unit) * F.lit(16777619).cast("long") % F.lit(1 << 32)

    def char(h: Column, c: Column) -> Column:
        unit = code(c)
        pair = step(step(h, F.shiftrightunsigned(unit, 16)), unit.bitwiseAND(0xFFFF))
        return F.when(c == "", h).when(unit > 0xFFFF, pair).otherwise(step(h, unit))

    return F.aggregate(F.split(text, ""), F.lit(2166136261).cast("long"), char)


def parent_of(path: Column) -> Column:
    """Folder of a path; null at the root."""
    return F.nullif(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit(""))


def base_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth_of(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_of(path), r"\.([^.]+)$", 1))


def prefixes_of(path: Column) -> Column:
    """All folders above the last part of a path, shortest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def owner_of(key: Column) -> Column:
    """What stands before the last # of a composite key: files may hold # themselves."""
    return F.regexp_extract(key, "^(.*)#([^#]*)$", 1)


def padded(number: Column, width: int = 2) -> Column:
    """Zero-padded, never cut."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def slug(name: Column) -> Column:
    """Lower-case words joined by hyphens; empty where nothing is left."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-|-$", "")


def title_case(text: Column) -> Column:
    """First letter of each word raised, the rest as it is (initcap would lower it)."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def error_signature(message: Column, path: Column) -> Column:
    """A message without what differs between like failures: the file, numbers, spacing."""
    named = F.replace(F.replace(message, path, F.lit("<file>")), base_of(path), F.lit("<file>"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(named, "0x[0-9a-fA-F]+", "0x#"), "[0-9]+", "#"), r"\s+", " ")
    return F.left(F.trim(bare), F.lit(240))


def without_tags(text: Column) -> Column:
    """A subtitle's text without <tags> and {override blocks}."""
    return F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"\{[^}]*\}", "")


def trimmed(text: Column) -> Column:
    """text without any white space, line breaks and non-breaking spaces included, at its ends."""
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def with_escapes(text: Column) -> Column:
    """Characters that can't be shown (controls but for line feed and tab, formats, private use, the replacement character) as [U+XXXX]."""
    code = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0{1,4}", "")
    each = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(UNSHOWN), F.concat(F.lit("[U+"), code(c), F.lit("]"))).otherwise(c))
    return F.when(text.rlike(UNSHOWN), F.array_join(each, "")).otherwise(text)


def cue_text(text: Column) -> Column:
    """A cue's text as it is shown: no markup, line feeds only, trimmed, what can't be shown escaped."""
    return with_escapes(trimmed(F.regexp_replace(without_tags(text), "\r\n?", "\n")))


def ass_text(event: Column) -> Column:
    """The text of an ASS event: what follows its eighth comma (all of it if there are fewer), with \\N, \\n and \\h as breaks and space."""
    tail = F.regexp_replace(event, "^(?:[^,]*,){8}", "")
    return cue_text(F.regexp_replace(F.regexp_replace(tail, r"\\[Nn]", "\n"), r"\\h", " "))


def clock_ms(text: Column) -> Column:
    """Milliseconds of [h:]m:ss[,.]ms; null for anything else."""
    whole = rf"^[{SPACES}]*{CLOCK}[{SPACES}]*$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, whole, i), F.lit("")), F.lit("0")).cast("long")
    ms = F.rpad(F.regexp_extract(text, whole, 4), 3, "0").cast("long")
    return F.when(text.rlike(whole), (part(1) * 3600 + part(2) * 60 + part(3)) * 1000 + ms)


def duration_bucket(seconds: Column) -> Column:
    return (
        F.when(F.coalesce(seconds, F.lit(0)) == 0, "—")
        .when(seconds >= 3600, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h")))
        .when(seconds >= 600, F.concat((F.floor(seconds / 600) * 10).cast("string"), F.lit("m")))
        .otherwise("<10m")
    )


def month_bucket(ms: Column) -> Column:
    """Mon YYYY of an epoch time, in UTC whatever the session's time zone."""
    wall = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "—").otherwise(F.date_format(wall, "MMM yyyy"))


def letter_bucket(name: Column) -> Column:
    first = F.upper(F.substring(F.trim(name), 1, 1))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise("#")


def epoch_ms(wall: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, read as UTC whatever the session's."""
    since = (wall.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second")
    return (since.cast("decimal(20,6)") * 1000).cast("long")


def watched_percent(position: Column, duration: Column) -> Column:
    return F.when(duration > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * F.coalesce(position, F.lit(0.0)) / duration))).otherwise(0.0)
