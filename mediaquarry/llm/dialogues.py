"""Repair of conversations: the cheapest edits that give roles of the form (s?(ua)+)?, by a forward Viterbi search.

Four grammar states: nothing yet, after system, after user, after assistant (the first and last may end a conversation). For
each state the search carries the least (cost, audit string) of the rows so far. A row is kept, gets another role or is
deleted; then its layer is closed by insertions, at most two in a row, as a third would come back to a state at a higher
cost. At one layer two audit strings of one cost never begin one with the other (they have the same number of letters for
rows, and each insertion costs), so that the least stays the least whatever follows.

Conversations are sorted by ranges and cut into segments of at most SEGMENT rows or SEGMENT_BYTES of text. Nearly all
are one segment, which is searched whole. Of those that are cut, or that a range's border may cut, each segment is searched
from all four states, which makes a small matrix; the matrices are multiplied in order, by one task that holds a few
letters a row and no texts, and each segment then gets its state and its letters. Texts of a repaired conversation are
hashed one segment after another, as a digest must be. So a conversation with most of the rows needs no task that holds it.

Defined cases: nulls of any column count as one space (a null text is blank, a null role has to be changed or deleted, a null
conv_id is a conversation of its own; null turns come first and don't count for gaps); rows of one turn go by role, then
text; repeated rows are duplicates; an empty role is no legal neighbour; texts of any length are worked on whole; an empty
table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard, stored

SEGMENT, SEGMENT_BYTES = 4096, 4 << 20

# What is cut out of 20, edits' costs, white space.
PARTS = 20
RANK_COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1
SPACE = " \t\n\v\f\r"
ENDS = ".!?"

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: The state after a role's initial; what isn't named isn't allowed.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

Best = tuple[int, str] | None

SEGMENTS = "conv string, conv_id long, part int, seq int, whole boolean, turns array<long>, roles array<string>, texts array<string>"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
SUMMARY = "conv string, conv_id long, part int, seq int, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, costs array<long>, audits array<string>"
CHOICE = "conv string, conv_id long, part int, seq int, state int, letters string, ends boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and alive (false: the row was dropped) after the damage that a digest of conv_id and turn chooses."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % PARTS
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), (kind != 0).alias("alive"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("_copy", "copies")


def lowest(a: Best, b: Best) -> Best:
    return b if a is None or b is not None and b < a else a


def then(a: Best, cost: int, letter: str) -> Best:
    return None if a is None else (a[0] + cost, a[1] + letter)


def closed(layer: list[Best]) -> list[Best]:
    """The layer and what up to two insertions reach."""
    out = list(layer)
    for state in (START, SYSTEM, ASSISTANT):
        out[USER] = lowest(out[USER], then(layer[state], RANK_COST["I"], "I"))
    out[ASSISTANT] = lowest(out[ASSISTANT], then(out[USER], RANK_COST["I"], "I"))
    return out


def advanced(layer: list[Best], initial: str, fault: str) -> list[Best]:
    """The closed layer after one more row."""
    out = [then(x, RANK_COST["D"], "D") for x in layer]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED_COST if fault == "truncated" else 0
        for state in range(STATES):
            if (to := AFTER.get((state, initial))) is not None:
                out[to] = lowest(out[to], then(layer[state], RANK_COST["K"] + more, "K"))
            to = ASSISTANT if state == USER else USER
            out[to] = lowest(out[to], then(layer[state], RANK_COST["R"] + more, "R"))
    return closed(out)


FIRST_LAYER = closed([(0, ""), None, None, None])


def fault_of(text: str, first: bool) -> str:
    bare = text.rstrip(SPACE)
    return "blank" if not bare else "duplicate" if not first else "" if bare[-1] in ENDS else "truncated"


def faults_of(roles: list[str], texts: list[str]) -> list[str]:
    """Of a whole conversation."""
    seen: set[tuple[str, str]] = set()
    found = []
    for both in zip(roles, texts, strict=True):
        found.append(fault_of(both[1], both not in seen))
        seen.add(both)
    return found


def counts_of(roles: list[str], faults: list[str]) -> list[int]:
    initials = [r[:1] for r in roles]
    return [*(faults.count(x) for x in COUNTS[:3]), sum(x not in LEGAL for x in zip(initials, initials[1:]))]


def repaired(roles: list[str], texts: list[str], letters: str, state: int) -> Iterator[str]:
    """Lines role:text of rows that are edited by letters, from a state on."""
    at = 0
    for letter in letters:
        if letter == "D":
            at += 1
            continue
        if letter == "K":
            state = AFTER[state, roles[at][:1]]
            yield f"{roles[at]}:{texts[at]}"
        else:
            state = ASSISTANT if state == USER else USER
            yield f"{ROLE[state]}:{texts[at] if letter == 'R' else ''}"
        at += letter != "I"


def digest(lines: Iterator[str]) -> str:
    h = hashlib.sha256()
    for i, line in enumerate(lines):
        h.update((("\n" if i else "") + line).encode())
    return h.hexdigest()


def gaps_of(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
ARROW |= {f"array<{k}>": pa.list_(v) for k, v in ARROW.items()}


def schema_of(ddl: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in map(str.split, ddl.split(", "))])


class Batches:
    """Rows to come, as batches of bounded size."""

    def __init__(self, ddl: str):
        self.schema, self.rows, self.size = schema_of(ddl), [], 0

    def add(self, row: tuple, size: int = 100) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size > SEGMENT_BYTES or len(self.rows) >= 4096:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield arrow(self.rows, self.schema)
        self.rows, self.size = [], 0


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of sorted rows; whole: the segment surely is a conversation."""
    part, out = TaskContext.get().partitionId(), Batches(SEGMENTS)
    conv_id, seq, size, first, turns, roles, texts = None, -1, 0, True, [], [], []

    def ended(whole: bool) -> Iterator[pa.RecordBatch]:
        yield from out.add(("" if conv_id is None else str(conv_id), conv_id, part, seq, whole, turns, roles, texts), 100 + size)

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            columns = [c.to_pylist() for c in batch.slice(at, 1024).columns]
            for conv, turn, role, text, alive in zip(*columns, strict=True):
                fresh = seq < 0 or conv != conv_id
                if fresh or len(turns) >= SEGMENT or size >= SEGMENT_BYTES:
                    if seq >= 0:
                        yield from ended(fresh and not first and seq == 0)
                        first = first and not fresh
                    conv_id, seq, size, turns, roles, texts = conv, 0 if fresh else seq + 1, 0, [], [], []
                if alive:
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                    size += len(text) + len(role)
    if seq >= 0:
        yield from ended(False)
    yield from out.rest()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield tuple(c[0].as_py() for c in batch.slice(at, 1).columns)


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations that are one segment."""
    out = Batches(RESULT)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            few = batch.slice(at, 256).to_pydict()
            for conv_id, turns, roles, texts in zip(few["conv_id"], few["turns"], few["roles"], few["texts"], strict=True):
                faults, layer = faults_of(roles, texts), FIRST_LAYER
                for role, fault in zip(roles, faults, strict=True):
                    layer = advanced(layer, role[:1], fault)
                cost, audit = lowest(layer[START], layer[ASSISTANT])
                yield from out.add((conv_id, gaps_of(turns), *counts_of(roles, faults), cost, audit, digest(repaired(roles, texts, audit, START))), 200 + len(audit))
    yield from out.rest()


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a segment does from each state; firsts: its rows (from 0) that aren't blank or duplicates."""
    out = Batches(SUMMARY)
    for conv, conv_id, part, seq, turns, roles, texts, firsts in rows_of(batches):
        new = set(firsts or ())
        faults = [fault_of(text, i in new) for i, text in enumerate(texts)]
        costs, audits = [], []
        for start in range(STATES):
            layer: list[Best] = [(0, "") if s == start else None for s in range(STATES)]
            for role, fault in zip(roles, faults, strict=True):
                layer = advanced(layer, role[:1], fault)
            costs += [None if x is None else x[0] for x in layer]
            audits += [None if x is None else x[1] for x in layer]
        known = [t for t in turns if t is not None]
        yield from out.add((conv, conv_id, part, seq, *counts_of(roles, faults), roles[0][:1] if roles else None, roles[-1][:1] if roles else None, min(known, default=None), max(known, default=None), len(set(known)), costs, audits), 200 + 16 * len(roles))
    yield from out.rest()


class Folded:
    """Segments of one conversation, multiplied in order."""

    def __init__(self):
        self.layer, self.steps, self.counts = FIRST_LAYER, [], [0] * 4
        self.last = self.low = self.high = None
        self.turns = 0

    def add(self, key: tuple, counts: list[int], ends: tuple, turns: tuple, costs: list[int | None], audits: list[str | None]) -> None:
        (first, last), (low, high, n) = ends, turns
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        if first is not None:
            self.counts[3] += self.last is not None and (self.last, first) not in LEGAL
            self.last = last
        if low is not None:
            self.turns += n - (low == self.high)  # sorted: only a turn at the border is in both
            self.low, self.high = low if self.low is None else self.low, high
        layer, came = [None] * STATES, [None] * STATES
        for to in range(STATES):
            for state in range(STATES):
                if self.layer[state] is not None and costs[STATES * state + to] is not None:
                    new = then(self.layer[state], costs[STATES * state + to], audits[STATES * state + to])
                    if lowest(layer[to], new) is new:
                        layer[to], came[to] = new, (state, audits[STATES * state + to])
        self.layer = layer
        self.steps.append((key, came))

    def rows(self) -> Iterator[tuple]:
        """A row for each segment, the last with the conversation's results."""
        cost, audit = lowest(self.layer[START], self.layer[ASSISTANT])
        at = START if self.layer[START] == (cost, audit) else ASSISTANT
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        back = []
        for i in range(len(self.steps) - 1, -1, -1):
            key, came = self.steps[i]
            at, letters = came[at]
            if i == 0:  # insertions before the first row
                letters = FIRST_LAYER[at][1] + letters
                at = START
            end = i == len(self.steps) - 1
            back.append((*key, at, letters, end, *((gaps, *self.counts, cost, audit) if end else (None,) * 7)))
        yield from reversed(back)


def choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, held, folded = Batches(CHOICE), None, None
    for conv, conv_id, part, seq, blank, duplicate, truncated, illegal, first, last, low, high, turns, costs, audits in rows_of(batches):
        if conv != held:
            for row in folded.rows() if folded else ():
                yield from out.add(row, 200 + len(row[5]) + len(row[-1] or ""))
            held, folded = conv, Folded()
        folded.add((conv, conv_id, part, seq), [blank, duplicate, truncated, illegal], (first, last), (low, high, turns), costs, audits)
    for row in folded.rows() if folded else ():
        yield from out.add(row, 200 + len(row[5]) + len(row[-1] or ""))
    yield from out.rest()


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose segments come in order."""
    out, h, any_line = Batches(RESULT), hashlib.sha256(), False
    for conv_id, roles, texts, state, letters, ends, *results in rows_of(batches):
        for line in repaired(roles, texts, letters, state):
            h.update((("\n" if any_line else "") + line).encode())
            any_line = True
        if ends:
            yield from out.add((conv_id, *results, h.hexdigest()), 200 + len(results[-1]))
            h, any_line = hashlib.sha256(), False
    yield from out.rest()


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conv_id of rows (conv_id, turn, role, text, alive): its faults, and cost, letters and digest of its repair."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("conv_id", "turn", "role", "text", "alive").repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    segments, path = stored(dealt.mapInArrow(cut, SEGMENTS), "segments")
    whole = segments.where("whole").select("conv_id", "turns", "roles", "texts").mapInArrow(solved, RESULT)

    key, rest = ["conv", "part", "seq"], segments.where("NOT whole")
    lines = rest.select(*key, F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "line")).select(*key, "pos", F.col("line.roles").alias("role"), F.col("line.texts").alias("text"))
    firsts = lines.groupBy("conv", "role", "text").agg(F.min(F.struct("part", "seq", "pos")).alias("p")).select("conv", "p.*").groupBy(*key).agg(F.collect_list("pos").alias("firsts"))
    summed = rest.select(*key, "conv_id", "turns", "roles", "texts").join(firsts, key, "left").select("conv", "conv_id", "part", "seq", "turns", "roles", "texts", "firsts").mapInArrow(summaries, SUMMARY)
    chosen, chosen_path = stored(summed.repartition("conv").sortWithinPartitions(*key).mapInArrow(choices, CHOICE), "repairs")
    joined = rest.select(*key, "roles", "texts").join(chosen, key).repartition("conv").sortWithinPartitions(*key)
    cut_ones = joined.select("conv_id", "roles", "texts", "state", "letters", "ends", "gaps", *COUNTS, "cost", "audit").mapInArrow(hashed, RESULT)
    result = checkpointed(whole.unionByName(cut_ones))
    for p in (path, chosen_path):
        discard(spark, p)
    return result


def repair_damaged(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))
