import pytest
from pyspark.sql import functions as F

from mediaquarry.functions import text


def model(query, value):
    """The predicate, restated on strings."""
    alnum = lambda s: "".join(c for c in s if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    value = value.lower().strip()
    query = query.lower().strip()

    def hit(leaf):
        if any(c not in "abcdefghijklmnopqrstuvwxyz0123456789" and not c.isspace() for c in leaf):
            return leaf in value
        return alnum(leaf) in alnum(value)

    def term(t):
        t = t.strip()
        return not hit(t[1:].strip()) if t.startswith("!") else hit(t)

    return not query or any(all(term(t) for t in branch.split("&")) for branch in query.split("|"))


VALUES = ["Show.One/The silence-of x.mkv", "b/Cold Widget 2.MKV", "été/Ünder.avi", "", "a|b & c!", "silence  of", "100%"]
WANTED = ["", "  ", "silence of", "silence.of", "cold & !widget", "widget|", "|", "!", "!cold", "é", "a & ", "show one | 100%", "& !", "ünder", "2.mkv&cold"]


@pytest.mark.parametrize("query", WANTED)
def test_match_filter(spark, query):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    got = [r[0] for r in df.select(text.match_filter(query, F.col("v"))).collect()]
    assert got == [model(query, v) for v in VALUES]


def fnv(s):
    h = 2166136261
    data = s.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(data), 2):
        h = ((h ^ (data[i] << 8 | data[i + 1])) * 16777619) % (1 << 32)
    return h


def test_fnv1a(spark):
    words = ["abc", "", "é漢", "a😀b", "x" * 300]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(text.fnv1a(F.col("w"))).collect()] == list(map(fnv, words))
    assert fnv("abc") == 440920331


def test_paths_and_labels(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.parent_of(F.lit("a/b/c.mkv"))) == "a/b"
    assert one(text.parent_of(F.lit("c.mkv"))) is None
    assert one(text.prefixes_of(F.lit("a/b/c"))) == ["a", "a/b"]
    assert one(text.prefixes_of(F.lit("c"))) == []
    assert one(text.owner_of(F.lit("a#1#02"))) == "a#1"
    assert one(text.padded(F.lit(123))) == "123"
    assert one(text.padded(F.lit(3))) == "03"
    assert one(text.title_case(F.lit("hello wORLD"))) == "Hello WORLD"
    assert one(text.slug(F.lit("  My List! (2) "))) == "my-list-2"
    assert one(text.slug(F.lit("!!"))) == ""
    assert one(text.clock_ms(F.lit("01:02:03,5"))) == 3723500
    assert one(text.clock_ms(F.lit("02:03.045"))) == 123045
    assert all(one(text.clock_ms(F.lit(x))) is None for x in ("nonsense", "01:02:03", "123:00:00.1", "1:2.3"))
    assert [one(text.duration_bucket(F.lit(x))) for x in (0.0, 599.0, 1250.0, 7300.0)] == ["—", "<10m", "20m", "2h"]
    assert one(text.month_bucket(F.lit(1_704_067_200_000).cast("long"))) == "Jan 2024"
    assert one(text.error_signature(F.lit("bad 0xAF at a/b.mkv  line 12 of b.mkv"), F.lit("a/b.mkv"))) == "bad #x# at <file> line # of <file>"
    assert one(text.watched_percent(F.lit(30.0), F.lit(20.0))) == 100.0
    assert one(text.watched_percent(F.lit(None).cast("double"), F.lit(20.0))) == 0.0


def test_month_is_utc_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.range(1).select(text.month_bucket(F.lit(1_704_067_200_000).cast("long")), text.epoch_ms(F.lit("2024-01-01 00:00:00.123").cast("timestamp_ntz")))
        assert tuple(df.first()) == ("Jan 2024", 1_704_067_200_123)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_cue_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.cue_text(F.lit(" <i>a</i> <> {\\an8}b\r\nc�​\ttab \U000f0000\n"))) == "a <> b\nc[U+FFFD][U+200B]\ttab [U+F0000]"
    assert one(text.ass_text(F.lit("0,0,Default,,0,0,0,,One, two\\Nthree\\hfour"))) == "One, two\nthree four"
    assert one(text.ass_text(F.lit("only, three, fields"))) == "only, three, fields"
    assert one(text.without_tags(F.lit("a <> b <b>c</b>{x}"))) == "a <> b c"
