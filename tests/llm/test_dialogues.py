"""Repaired conversations against a search through all edits, and a shortest path written another way."""

import hashlib
import heapq
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mediaquarry.llm import dialogues
from mediaquarry.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def show(x):
    return " " if x is None else str(x)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    out = []
    for i, (_, role, text) in enumerate(rows):
        seen = any(r == role and t == text for _, r, t in rows[:i])
        bare = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not bare else "duplicate" if seen else "" if bare[-1] in ".!?" else "truncated")
    return out


def edited(initials, bad, audit):
    """Cost and roles that an audit gives, None if it can't be; R and I try both roles."""
    found = [(0, "", ())]
    at = 0
    for letter in audit:
        if letter == "I":
            found = [(c + 2, g + r, e + (("I", r),)) for c, g, e in found for r in "ua"]
            continue
        fault = bad[at]
        more = int(fault == "truncated")
        if letter == "D":
            found = [(c + 3, g, e) for c, g, e in found]
        elif fault in ("blank", "duplicate"):
            return []
        elif letter == "K":
            found = [(c + more, g + (initials[at] or "?"), e + ((at, None),)) for c, g, e in found]
        else:
            found = [(c + more + 2, g + r, e + ((at, r),)) for c, g, e in found for r in "ua"]
        at += 1
    return [x for x in found if re.fullmatch("(s?(ua)+)?", x[1])]


def cheapest(initials, bad):
    """(cost, audit, edits): shortest path over whole strings, by cost and string."""
    heap, done, best = [(0, "", 0, "", ())], set(), None
    while heap:
        cost, audit, at, roles, edits = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if at == len(bad) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit, edits), (cost, audit, edits))
        state = roles[-1:] if len(roles) < 2 else roles[-1]
        if (audit, at, state) in done or not re.fullmatch("(s?(ua)*u?)?", roles):
            continue
        done.add((audit, at, state))
        for r in "ua":
            heapq.heappush(heap, (cost + 2, audit + "I", at, roles + r, edits + (("I", r),)))
        if at < len(bad):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, roles, edits))
            if bad[at] not in ("blank", "duplicate"):
                more = int(bad[at] == "truncated")
                if initials[at]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + initials[at], edits + ((at, None),)))
                for r in "ua":
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, roles + r, edits + ((at, r),)))
    return best


def plain(rows):
    rows = [(turn, role, text) for turn, role, text in rows]
    bad, initials = faults(rows), [r[1][:1] for r in rows]
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, edits = cheapest(initials, bad)
    full = {"u": "user", "a": "assistant"}
    lines = [f"{full[r]}:" if at == "I" else f"{full[r] if r else rows[at][1]}:{rows[at][2]}" for at, r in edits]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def results(df):
    return sorted(map(tuple, df.select(*dialogues.RESULT.replace(" long", "").replace(" string", "").split(", ")).collect()), key=repr)


def expected(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    return sorted(((conv, *plain(damage(own))) for conv, own in convs.items()), key=repr)


@pytest.mark.parametrize("few", [None, 2])
def test_whole_table(spark, few, monkeypatch):
    """Also with segments of two rows, so that conversations are cut."""
    table = spark.read.parquet(f"{DATA}/conversations.parquet")
    want = expected([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    if few:
        monkeypatch.setattr(dialogues, "cut", few_rows(few))
        got = dialogues.repair_damaged(table)
    else:
        got = QUERIES["op12_dialogues"](spark, DATA)
    assert results(got) == want and len(want) > 50


def few_rows(n):
    """cut() with segments of n rows, in the workers."""
    real = dialogues.cut

    def cut(batches):
        dialogues.SEGMENT = n
        return real(batches)

    return cut


ROLES = ["system", "user", "assistant", "tool", "", None, "user", "assistant"]
TEXTS = ["Yes.", "No", "", " \n", "Why?", None, "Yes.", "I see!  ", "é ", "long " * 3000 + "."]


@pytest.mark.parametrize("few", [None, 1, 3])
def test_odd_rows(spark, few, monkeypatch):
    import random

    draw = random.Random(5)
    rows = [(draw.choice([None, *range(40)]), draw.choice([None, 0, 1, 2, 3, 5, 8]), draw.choice(ROLES), draw.choice(TEXTS)) for _ in range(260)]
    rows = sorted(set(rows), key=repr) + rows[:20]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, part int")
    if few:
        monkeypatch.setattr(dialogues, "cut", few_rows(few))
    assert results(dialogues.repair_damaged(table)) == expected(rows)


def test_hot_conversation(spark, monkeypatch):
    """One conversation has most rows; its segments lie in several ranges."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i} is this.") for i in range(3000)] + [(c, t, "user", "Hm.") for c in range(2, 40) for t in range(3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(dialogues, "cut", few_rows(500))
    cut = {r.conv_id: r for r in dialogues.repair_damaged(table).collect()}
    monkeypatch.undo()
    whole = {r.conv_id: r for r in dialogues.repair_damaged(table).collect()}
    one = [r for r in damage(rows[:3000])]
    bad, layer = faults_fast(one), dialogues.FIRST_LAYER
    for (_, role, _), fault in zip(one, bad):
        layer = dialogues.advanced(layer, role[:1], fault)
    assert cut == whole and cut[1].audit == dialogues.lowest(layer[0], layer[3])[1]


def faults_fast(rows):
    return dialogues.faults_of([r for _, r, _ in rows], [t for _, _, t in rows])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua?"), st.sampled_from(["", "blank", "truncated"])), max_size=3))
def test_all_audits(rows):
    """Every string of letters is tried."""
    initials, bad = [r[0] for r in rows], [r[1] for r in rows]
    layer = dialogues.FIRST_LAYER
    for c, fault in rows:
        layer = dialogues.advanced(layer, c, fault)
    got = dialogues.lowest(layer[0], layer[3])
    n = len(rows)
    best = None
    for letters in itertools.product("KRD", repeat=n):
        for spots in itertools.product(range(3), repeat=n + 1):
            if sum(spots) * 2 <= got[0]:
                audit = "I" * spots[0] + "".join(x + "I" * s for x, s in zip(letters, spots[1:]))
                for cost, _, _ in edited(initials, bad, audit):
                    best = min(best or (cost, audit), (cost, audit))
    assert got == best


def test_no_rows(spark):
    assert results(dialogues.repair_damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = results(dialogues.repair_damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")))
    assert row == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
