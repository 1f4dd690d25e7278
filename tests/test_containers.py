"""Container readers on files that the tests build byte by byte."""

import hashlib
import struct

import pytest

from mediaquarry.sources import matroska, mp4, ranges, vobsub

# --- packets: a rectangle with ink in some columns -------------------------------------------------------------------
X, Y, WIDE, HIGH, FROM, TO = 10, 400, 96, 24, 20, 60


def run_of(length, value):
    v = length << 2 | value
    n = 1 if 4 <= v < 16 else 2 if 16 <= v < 64 else 3 if 64 <= v < 256 else 4
    return [v >> 4 * i & 15 for i in reversed(range(n))]


def packed(halves):
    halves = halves + [0] * (len(halves) % 2)
    return bytes(a << 4 | b for a, b in zip(halves[::2], halves[1::2]))


def packet(kind="plain", hide=3000, lines=None, wide=WIDE, high=HIGH):
    line = packed(run_of(FROM, 0) + run_of(TO - FROM, 1) + run_of(0, 0))
    lines = lines or [line] * high
    fields = b"".join(lines[::2]), b"".join(lines[1::2])
    clear, solid = b"\x00\x00", b"\xff\xf0"
    x2, y2 = X + wide - 1, Y + high - 1
    area = (X << 12 | x2).to_bytes(3) + (Y << 12 | y2).to_bytes(3)
    first = b"\x03\x32\x10\x04" + (clear if kind == "fade in" else solid) + b"\x05" + area + b"\x06" + struct.pack(">HH", 4, 4 + len(fields[0])) + b"\x01\xff"
    then = {"plain": b"", "fade out": b"\x04" + clear, "fade in": b"\x04" + solid}[kind] + b"\x02\xff"
    at = 4 + len(fields[0]) + len(fields[1])
    after = at + 4 + len(first)
    return struct.pack(">HH", after + 4 + len(then), at) + fields[0] + fields[1] + struct.pack(">HH", 0, after) + first + struct.pack(">HH", round(hide * 90 / 1024), after) + then


PALETTE = [0x000000, 0x112233, 0xFFFFFF, 0x808080] + [0] * 12


@pytest.mark.parametrize("kind", ["plain", "fade out", "fade in"])
def test_packets(kind):
    data = packet(kind)
    c, b = vobsub.read_control(data), vobsub.read_bitmap(data, PALETTE)
    assert (c["showMs"], c["hideMs"]) == (0, round(round(3000 * 90 / 1024) * 1024 / 90)) and (c["x1"], c["x2"], c["y1"], c["y2"]) == (X, X + WIDE - 1, Y, Y + HIGH - 1)
    line = b"\x00\x00\x00\x00" * FROM + b"\x11\x22\x33\xff" * (TO - FROM) + b"\x00\x00\x00\x00" * (WIDE - TO)
    assert (b["x"], b["y"], b["width"], b["height"]) == (X, Y, WIDE, HIGH) and b["rgba"] == line * HIGH


def test_packets_that_break_off():
    data = packet()
    assert vobsub.read_control(None) is None and vobsub.read_control(b"\x00\x02\x00") is None and vobsub.read_control(b"\x00\x04\x00\x04") is None
    for n in range(len(data)):
        vobsub.read_bitmap(data[:n], PALETTE)  # no crash
    at = int.from_bytes(data[2:4])
    assert vobsub.read_control(data[:at] + b"\x00\x00" + data[2:4] + b"\x05" + data[at + 11 : at + 17] + b"\xff") is None  # no place of the bitmap
    unseen = data.replace(b"\x04\xff\xf0", b"\x04\x00\x00")
    assert vobsub.read_control(unseen) and vobsub.read_bitmap(unseen, PALETTE) is None
    changed = data[:at] + data[at : at + 4] + b"\x07\x00\x05\xaa\xbb\xcc" + data[at + 4 :]
    size = len(changed)
    changed = struct.pack(">H", size) + changed[2:at] + b"\x00\x00" + struct.pack(">H", at) + changed[at + 4 :]
    assert vobsub.read_control(changed)["x1"] == X  # a command of a length of its own is passed over
    assert vobsub.read_bitmap(packet(lines=[packed(run_of(200, 2))] * 3, wide=64, high=3), PALETTE)["rgba"] == b"\xff\xff\xff\xff" * 192


# --- MP4 -------------------------------------------------------------------------------------------------------------
def box(kind, content, large=False):
    if large:
        return struct.pack(">I4sQ", 1, kind, len(content) + 16) + content
    return struct.pack(">I4s", len(content) + 8, kind) + content


def listed(kind, form, entries, head=b"\0\0\0\0"):
    return box(kind, head + struct.pack(">I", len(entries)) + b"".join(struct.pack(form, *e) for e in entries))


YUV = bytes([0, 235, 128, 128]) + bytes([0, 16, 128, 128]) * 15


def movie(payloads, deltas, per_chunk, gap=b"\xee" * 5, handler=b"subp", edits=(), wide=False, head_first=False, uniform=False, version=0):
    esds = b"\0\0\0\0" + b"\x03\x80\x80\x22" + b"\0\0\0" + b"\x04\x20" + b"\0" * 13 + b"\x05" + bytes([len(YUV)]) + YUV
    stsd = box(b"stsd", b"\0\0\0\0" + struct.pack(">I", 1) + box(b"mp4s", b"\0" * 8 + box(b"esds", esds)))
    chunks = [payloads[i : i + per_chunk] for i in range(0, len(payloads), per_chunk)]

    def moov(first):
        at, places = first, []
        for c in chunks:
            places.append((at,))
            at += sum(map(len, c)) + len(gap)
        runs = [(1, per_chunk, 1)] + ([(len(chunks), len(chunks[-1]), 1)] if len(chunks) > 1 and len(chunks[-1]) < per_chunk else [])
        coded = []
        for d in deltas:
            coded = [*coded[:-1], (coded[-1][0] + 1, d)] if coded and coded[-1][1] == d else [*coded, (1, d)]
        stsz = box(b"stsz", b"\0\0\0\0" + (struct.pack(">II", len(payloads[0]), len(payloads)) if uniform else struct.pack(">II", 0, len(payloads)) + b"".join(struct.pack(">I", len(p)) for p in payloads)))
        stbl = box(b"stbl", stsd + listed(b"stts", ">II", coded) + stsz + (listed(b"co64", ">Q", places) if wide else listed(b"stco", ">I", places)) + listed(b"stsc", ">III", runs))
        lang = (ord("d") - 96) << 10 | (ord("e") - 96) << 5 | (ord("u") - 96)
        mdhd = box(b"mdhd", b"\0" * 12 + struct.pack(">IIHH", 90000, 0, lang, 0)) if version == 0 else box(b"mdhd", b"\1" + b"\0" * 19 + struct.pack(">IQ4xHH", 90000, 0, lang, 0))
        elst = box(b"edts", listed(b"elst", ">Iii" if version == 0 else ">Qqi", edits, bytes([version, 0, 0, 0]))) if edits else b""
        trak = box(b"trak", elst + box(b"mdia", mdhd + box(b"hdlr", b"\0" * 8 + handler + b"\0" * 12) + box(b"minf", stbl)))
        mvhd = box(b"mvhd", b"\0" * 12 + struct.pack(">II", 600, 0))
        return box(b"moov", mvhd + box(b"trak", box(b"mdia", box(b"hdlr", b"\0" * 8 + b"vide"))) + trak, large=wide)

    media = gap.join(b"".join(c) for c in chunks) + gap
    head = box(b"ftyp", b"isom\0\0\0\0")
    mdat = lambda: box(b"mdat", media, large=wide)
    if head_first:
        return head + moov(len(head) + len(moov(0)) + (16 if wide else 8)) + mdat()
    return head + mdat() + moov(len(head) + (16 if wide else 8))


@pytest.mark.parametrize(("per_chunk", "wide", "head_first", "version"), [(1, False, False, 0), (3, True, False, 1), (4, False, True, 0), (100, True, True, 1)])
def test_mp4_samples(spark, tmp_path, per_chunk, wide, head_first, version):
    payloads = [bytes([i]) * (5 + i * 7 % 11) for i in range(10)]
    deltas = [3000, 3000, 4500, 4500, 4500, 0, 90000, 90000, 1, 2]
    edits = [(300, -1, 1 << 16), (0, 9000, 1 << 16), (0, 5, 1 << 16)]
    (tmp_path / "a.mp4").write_bytes(movie(payloads, deltas, per_chunk, wide=wide, head_first=head_first, edits=edits, version=version))
    (tmp_path / "other.mp4").write_bytes(b"\0\0\0\x08free" + b"\0\0\0\x02" + b"x" * 20)
    (tmp_path / "small.mp4").write_bytes(b"\0")
    files = spark.createDataFrame([(str(p),) for p in tmp_path.iterdir()], "path string")
    found = mp4.tracks(mp4.heads(files)).cache()
    listed = mp4.subtitle_tracks(found)
    (track,) = listed.collect()
    assert (track.track, track["index"], track.lang, track.timescale, track.shiftMs) == (2, 0, "deu", 90000, 500.0 - 100.0)
    assert track.palette[:3] == [0xFFFFFF, 0, 0]
    got = ranges.sample_bytes(mp4.samples(listed)).orderBy("sample").collect()
    assert [bytes(r.data) for r in got] == payloads and [r.time for r in got] == [sum(deltas[:i]) for i in range(10)] and [r.duration for r in got] == deltas


def test_mp4_tables_that_disagree(spark, tmp_path):
    """As many samples as all tables know; runs that claim no end are not expanded."""
    whole = movie([b"a" * 10] * 6, [100] * 6, 2, uniform=True)
    at = whole.index(b"stsc") + 4 + 8
    (tmp_path / "a.mp4").write_bytes(whole[:at] + struct.pack(">III", 1, 0xFFFFFFF0, 1) + whole[at + 12 :])
    at = whole.index(b"stts") + 4 + 8
    (tmp_path / "b.mp4").write_bytes(whole[:at] + struct.pack(">II", 4, 7) + whole[at + 8 :])
    at = whole.index(b"stco") + 4 + 4
    (tmp_path / "c.mp4").write_bytes(whole[:at] + struct.pack(">I", 99) + whole[at + 4 :])
    files = spark.createDataFrame([(str(tmp_path / f"{n}.mp4"),) for n in "abc"], "path string")
    n = {r.path[-5]: r.n for r in mp4.samples(mp4.tracks(mp4.heads(files))).groupBy("path").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert n == {"a": 6, "b": 4, "c": 6}


def test_mp4_cues(spark, tmp_path):
    payloads = [packet(hide=2000), packet("fade in", 1000), b"\0\4\0\0", b"broken packet", packet()[:-1]]
    (tmp_path / "a.mp4").write_bytes(movie(payloads, [90000] * 5, 2))
    files = spark.createDataFrame([(str(tmp_path / "a.mp4"),)], "path string")
    rows = mp4.subtitle_cues(mp4.subtitle_tracks(mp4.tracks(mp4.heads(files)))).withColumn("b", vobsub.bitmap("data", "palette")).orderBy("sample").collect()
    assert [(r.sample, r.startMs, r.endMs - r.startMs) for r in rows] == [(0, 0, vobsub.read_control(payloads[0])["hideMs"]), (1, 1000, vobsub.read_control(payloads[1])["hideMs"]), (4, 4000, vobsub.read_control(payloads[4])["hideMs"])]
    assert rows[0].b.rgba[FROM * 4 : FROM * 4 + 4] == b"\0\0\0\xff" and rows[0].b.width == WIDE


def test_planned_reads_read_no_byte_twice(spark, tmp_path):
    import random

    draw, at, samples = random.Random(3), 0, []
    for i in range(3000):
        at += draw.choice([0, 0, 0, 5, 900, 5000])
        size = draw.choice([0, 1, 40, 300, 2500])
        samples.append(("a", i, at, size))
        at += size
    table = spark.createDataFrame(samples, "path string, n int, at long, size long")
    reads = ranges.planned(table, most=4096, gap=1000).collect()
    seen, spans = [], sorted((r.start, r.start + r.length) for r in reads)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    for r in reads:
        assert r.length < 4096 + 2500 and all(r.start <= s["at"] and s["at"] + s["size"] <= r.start + r.length for s in r.samples)
        seen += [s["n"] for s in r.samples]
    assert sorted(seen) == [n for _, n, _, size in samples if size > 0]
    assert len(reads) < sum(size > 0 for *_, size in samples) / 3


# --- Matroska --------------------------------------------------------------------------------------------------------
def size_of(n, length=0):
    length = length or next(i for i in range(1, 9) if n < (1 << 7 * i) - 1)
    return (n | 1 << 7 * length).to_bytes(length)


def element(code, content, length=0):
    return code.to_bytes((code.bit_length() + 7) // 8) + size_of(len(content), length) + content


def number(code, n):
    return element(code, n.to_bytes(max(1, (n.bit_length() + 7) // 8)))


def entry(n, kind, codec, lang=None, name=None, private=None):
    return element(0xAE, number(0xD7, n) + number(0x83, kind) + element(0x86, codec.encode()) + (element(0x22B59C, lang.encode()) if lang else b"") + (element(0x536E, name.encode()) if name else b"") + (element(0x63A2, private) if private else b""))


def block(track, time, content, flags=0):
    return size_of(track) + struct.pack(">hB", time, flags) + content


def group(track, time, content, length):
    return element(0xA0, element(0xA1, block(track, time, content)) + number(0x9B, length))


def film(clusters, tracks, scale=1_000_000, unknown=False, tail=b""):
    head = element(0x1A45DFA3, element(0x4282, b"matroska"))
    body = element(0x114D9B74, b"seek") + element(0x1549A966, number(0x2AD7B1, scale)) + element(0x1654AE6B, b"".join(tracks))
    for c in clusters:
        body += b"\x1f\x43\xb6\x75\x01" + b"\xff" * 7 + c if unknown else element(0x1F43B675, c, 8)
    body += tail
    return head + (b"\x18\x53\x80\x67\x01" + b"\xff" * 7 if unknown else b"\x18\x53\x80\x67" + size_of(len(body), 8)) + body


HEADER = b"# VobSub\nsize: 720x576\npalette: 000000, 112233, ffffff, zz, 010203\n"
SUBS = [entry(1, 1, "V_MPEG4/ISO/AVC"), entry(3, 0x11, "S_TEXT/UTF8", "ger", "Deutsch"), entry(200, 0x11, "S_TEXT/ASS"), entry(5, 0x11, "S_VOBSUB", "eng", None, HEADER), entry(6, 0x11, "S_HDMV/PGS")]
SOUND = element(0xA3, block(1, 0, b"\x55" * 40_000))
CLUSTERS = [
    number(0xE7, 1000) + SOUND + element(0xA3, block(3, 0, b"<i>Guten Tag</i>")) + group(3, 4000, "Wie geht’s?".encode(), 1500) + SOUND + element(0xA3, block(3, 5, b"two frames", 2)),
    number(0xE7, 30_000) + element(0xA3, block(200, -100, b"0,0,Default,,0,0,0,,One\\NTwo")) + element(0xA3, block(3, 20, b" ")) + group(5, 0, packet(hide=1000), 9000) + SOUND,
    number(0xE7, 60_000) + element(0xA3, block(3, 0, b"End \xff")) + group(5, 5, b"no packet", 10) + element(0xA3, block(6, 0, b"x")) + element(0xEC, b"void"),
]


@pytest.mark.parametrize("unknown", [False, True])
def test_matroska(spark, tmp_path, unknown):
    tail = element(0x1C53BB6B, b"cues") + element(0x1254C367, b"tags")
    (tmp_path / "a.mkv").write_bytes(film(CLUSTERS, SUBS, unknown=unknown, tail=tail))
    indexed = matroska.index(spark.createDataFrame([(str(tmp_path / "a.mkv"),)], "path string"))
    tracks = matroska.subtitle_tracks(indexed)
    assert [(r.number, r.lang, r.name, r.codec, r.supported) for r in tracks.orderBy("number").collect()] == [(3, "ger", "Deutsch", "UTF8", True), (5, "eng", "", "VOBSUB", True), (6, "eng", "", "HDMV/PGS", False), (200, "eng", "", "ASS", True)]
    assert indexed.where("kind = 'cluster'").count() == 3
    want = None
    for window in (1, 13, 50_000, 8 << 20):
        rows = matroska.subtitle_cues(indexed, tracks, window).orderBy("number", "idx").collect()
        got = [(r.number, r.idx, r.startMs, r.endMs, r.text, None if r.data is None else hashlib.sha256(r.data).hexdigest()) for r in rows]
        want = want or got
        assert got == want  # whatever the window
    hide = vobsub.read_control(packet(hide=1000))["hideMs"]
    assert [x[:5] for x in want] == [
        (3, 0, 1000.0, 5000.0, "Guten Tag"), (3, 1, 5000.0, 6500.0, "Wie geht’s?"), (3, 2, 60000.0, 65000.0, "End [U+FFFD]"),
        (5, 0, 30000.0, 30000.0 + hide, ""), (200, 0, 29900.0, 34900.0, "One\nTwo"),
    ]
    assert rows[3].palette[:5] == [0, 0x112233, 0xFFFFFF, 0x808080, 0x010203]


def test_matroska_scale_and_faults(spark, tmp_path):
    good = film(CLUSTERS[:1], SUBS[:2], scale=500_000)
    (tmp_path / "scaled.mkv").write_bytes(good)
    (tmp_path / "cut.mkv").write_bytes(film(CLUSTERS, SUBS)[:-60_000])
    (tmp_path / "none.mkv").write_bytes(b"not a film at all")
    (tmp_path / "empty.mkv").write_bytes(b"")
    (tmp_path / "early.mkv").write_bytes(b"\x18\x53\x80\x67" + size_of(200_000, 8) + element(0x1F43B675, CLUSTERS[0], 8) + element(0x1654AE6B, SUBS[1]))
    indexed = matroska.index(spark.createDataFrame([(str(p),) for p in tmp_path.iterdir()], "path string"))
    cues = {}
    for r in matroska.subtitle_cues(indexed, matroska.subtitle_tracks(indexed)).where("number = 3").collect():
        cues.setdefault(r.path.split("/")[-1], []).append((r.startMs, r.text))
    assert sorted(cues["scaled.mkv"]) == [(500.0, "Guten Tag"), (2500.0, "Wie geht’s?")] and "early.mkv" not in cues and "none.mkv" not in cues
    assert {r.path.split("/")[-1] for r in indexed.where("kind = 'error'").collect()} >= {"none.mkv", "cut.mkv"}


def test_numbers_of_variable_length():
    for n in (0, 1, 126, 128, 300, 16382, 1 << 20, (1 << 56) - 2):
        for length in range(next(i for i in range(1, 9) if n < (1 << 7 * i) - 1), 9):
            assert matroska.variable(size_of(n, length), 0, False) == (n, length, False)
    assert matroska.variable(b"\xff", 0, False)[2] and matroska.variable(b"\x01" + b"\xff" * 7, 0, False)[2] and not matroska.variable(b"\xff", 0, True)[2]
    for bad in (b"", b"\x00", b"\x40"):
        with pytest.raises(ValueError):
            matroska.variable(bad, 0, False)


# --- pictures and files ----------------------------------------------------------------------------------------------
def picture(*lines):
    """Lines of 100 pixels: (number, grey, stray white pixels)."""
    return b"".join((bytes([g, g, g, 255]) * (100 - k) + b"\xff" * 4 * k) * n for n, g, k in lines), 100, sum(n for n, _, _ in lines)


@pytest.mark.parametrize(
    ("lines", "want", "worker"),
    [
        ([(10, 0, 0), (80, 90, 0), (10, 20, 1)], (10, 80), (10, 90)), ([(10, 0, 2), (90, 90, 0)], (0, 100), (0, 100)), ([(10, 21, 0), (90, 90, 0)], (0, 100), (10, 90)),
        ([(100, 0, 0)], (0, 100), (0, 100)), ([(51, 0, 0), (49, 90, 0)], (0, 100), (0, 100)), ([(50, 0, 0), (50, 90, 0)], (50, 50), (0, 100)), ([(40, 0, 0), (60, 90, 0)], (40, 60), (40, 60)),
        ([(10, 0, 0), (50, 90, 0)], (0, 60), (10, 50)), ([(20, 0, 0), (30, 90, 0), (10, 0, 0), (40, 90, 0)], (20, 80), (20, 80)), ([(64, 90, 0)], (0, 64), (0, 64)),
    ],
)
def test_letterbox(lines, want, worker):
    from mediaquarry.functions import frames

    data, width, height = picture(*lines)
    for by_worker, (y, n) in ((False, want), (True, worker)):
        assert frames.crop(data, width, height, 4, by_worker) == {"x": 0, "y": y, "width": width, "height": n}


def test_letterbox_of_nothing(spark):
    from pyspark.sql import functions as F

    from mediaquarry.functions import frames

    rows = [(1, None, 10, 10), (2, b"abc", 10, 10), (3, b"", 0, 0), (4, b"\0" * 400, 10, 10), (5, b"\0" * 400, None, 10)]
    table = spark.createDataFrame(rows, "n int, data binary, w int, h int")
    got = {r.n: r.c for r in table.select("n", frames.letterbox(F.col("data"), F.col("w"), F.col("h")).alias("c")).collect()}
    assert [got[i] is None for i in range(1, 6)] == [True, True, True, False, True] and tuple(got[4]) == (0, 0, 10, 10)


def test_footers(spark, tmp_path):
    import os

    import pyarrow.parquet as pq

    from mediaquarry.operators import storage

    path = str(tmp_path / "t")
    spark.range(50_000).selectExpr("id", "CAST(id % 7 AS STRING) AS s", "array(id, id + 1) AS a", "IF(id % 5 = 0, NULL, id) AS x").repartition(3).write.parquet(path)
    files = [f"{path}/{f}" for f in os.listdir(path) if f.endswith(".parquet")]
    want = {}
    for f in files:
        about = pq.ParquetFile(f).metadata
        for i in range(about.num_row_groups):
            for j in range(about.num_columns):
                c = about.row_group(i).column(j)
                want[c.path_in_schema.split(".")[0]] = want.get(c.path_in_schema.split(".")[0], 0) + c.total_compressed_size
    table = spark.read.parquet(path)
    found = storage.footers(storage.files_of(table)).cache()
    sizes = storage.column_sizes(found).collect()
    assert {r.column: r.bytes for r in sizes} == want and [r.bytes for r in sizes] == sorted(want.values(), reverse=True)
    assert {r.column: (r.rows, r.nulls) for r in sizes}["x"] == (50_000, 10_000)
    from pyspark.sql import functions as F

    row = storage.totals(found, table, "s", F.col("path").endswith(os.path.basename(files[0]))).first()
    sizes_on_disk = [os.path.getsize(f) for f in files]
    assert (row.rows, row["columns"], row.files, row.bytes, row.looseBytes) == (50_000, 4, 3, sum(sizes_on_disk), sizes_on_disk[0]) and abs(row.duplicates - (1 - 7 / 50_000)) < 1e-12
