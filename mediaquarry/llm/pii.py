"""PII: fixed patterns, and terms around them that disclose what they stand next to.

Every personal datum that the patterns find is a protected entity. The words within CONTEXT characters of it are its
context. Over the whole corpus, with probabilities as shares of rows, a term t discloses an entity e by its pointwise
mutual information PMI(e; t) = log2(P(e, t) / (P(e) P(t))), whose most is the entity's own information IC(e) = -log2 P(e).
A term that stands with an entity in at least SUPPORT rows is judged: it is removed (kind `removed`) where PMI reaches
REMOVE of IC, and generalised (kind `general`) where it reaches GENERALISE of it. It is generalised to the commonest
term of the same entity's contexts that discloses it less than that; where there is none, it is removed. The strongest
verdict on a term holds wherever the term stands, in any row, with or without the entity: it would disclose it there too.

All work is DataFrame functions. Positions come from splitting a text at the matches: a match starts after all pieces and
matches before it. Each pattern may begin only where a longer match can't have begun, so that the search is linear.

Defined cases: a null text counts as empty and has no spans; rows alike in doc_id and text get the same spans, each in a
row of its own; null doc_ids are kept; a term that is judged for several entities is removed if one of them asks for it, else
it takes the general term of the entity that it stands with most often (ties: the first by alphabet, as among general
terms); terms within base spans are not judged or touched; terms under MIN_TERM characters, and those seen with an entity
in fewer than SUPPORT rows, are not judged; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Kinds in order with their patterns; possessive loops and look-behinds only save time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE_KINDS = ("removed", "general")
WORD = r"[\p{L}\p{N}]+"

#: Stands for a letter or figure of a datum; no text is meant to hold it.
MARK = "\ufdd0"

CONTEXT = 80
#: Characters of a piece in which contexts are looked up; more than any context.
CHUNK = 1000
MIN_TERM = 2
SUPPORT = 2
#: Pairs of one term that go to one task together.
HEAVY = 100_000
REMOVE, GENERALISE = 0.98, 0.85

SPAN = "struct<start:int,end:int,text:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once though the lambdas in body use it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(numbers: Column) -> Column:
    """For each number of an array the sum of those before it. Blocks of about the cube root of their count keep that far from a square."""

    def in_blocks(x: Column, n: Column) -> Column:
        total = lambda first, count: F.aggregate(F.slice(x, first + 1, count), F.lit(0), lambda a, e: a + e)
        sums = lambda blocks: F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / n).cast("int")), lambda b: F.aggregate(F.slice(blocks, 1, b), F.lit(0), lambda a, e: a + e))
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / n).cast("int") - 1), lambda b: total(b * n, n))
        return let(let(blocks, sums), lambda s: F.transform(x, lambda _, i: F.get(s, F.floor(i / n).cast("int")) + total(i - i % n, i % n)))

    return let(numbers, lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(let(F.ceil(F.cbrt(2 * F.size(x))).cast("int"), lambda n: in_blocks(x, n))))


def matches(text: Column, pattern: str | Column) -> Column:
    """Array of (start, end, text) of the matches, left to right, in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(found: Column, gaps: Column) -> Column:
        both = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, gap: F.length(m) + gap)
        starts = F.zip_with(sums_before(both), F.slice(gaps, 1, F.size(found)), lambda at, gap: at + gap)
        return F.zip_with(found, starts, lambda m, at: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("text")))

    found = lambda f: F.when(F.size(f) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(let(F.transform(F.split(text, pattern, -1), F.length), lambda g: placed(f, g)))
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), found)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def at_most_255(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def tested(kind: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Whether a text can have spans of a kind (a cheap test), and whether a match is one."""
    n = lambda m: F.length(digits(m))
    return {
        "email": (lambda text: F.contains(text, F.lit("@")), lambda m: F.lit(True)),
        "ip": (lambda text: text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), at_most_255),
        "card": (lambda text: text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), lambda m: n(m).between(16, 19) & passes_luhn(digits(m))),
        "phone": (lambda text: text.rlike(r"\+[0-9]"), lambda m: n(m).between(8, 15)),
    }[kind]


def base_spans(text: Column) -> dict[str, Column]:
    """By kind, the spans of a text that isn't null."""
    none = F.array().cast(f"array<{SPAN}>")
    spans = lambda may, is_one, pattern: F.when(may(text), F.filter(matches(text, pattern), lambda x: is_one(x["text"]))).otherwise(none)
    return {kind: spans(*tested(kind), pattern) for kind, pattern in PATTERNS.items()}


def overlaid(a: Column, b: Column) -> Column:
    """Of two texts of one length, a with the marks of b."""
    some = lambda x: F.regexp_extract_all(x, F.lit("(?s).{1,512}"), F.lit(0))
    each = lambda x, y: F.array_join(F.zip_with(F.split(x, ""), F.split(y, ""), lambda c, d: F.when(d == MARK, d).otherwise(c)), "")
    return F.array_join(F.zip_with(some(a), some(b), each), "")


def free_text(text: Column) -> Column:
    """The text with a mark for each letter or figure of its data, and everything else where it stands."""

    def marked(t: Column, kind: str) -> Column:
        put = lambda m: F.when(tested(kind)[1](m), F.regexp_replace(m, r"[\p{L}\p{N}]", MARK)).otherwise(m)
        joined = lambda m: F.array_join(F.zip_with(F.split(t, F.lit(PATTERNS[kind]), -1), m, lambda gap, x: F.concat(gap, F.coalesce(put(x), F.lit("")))), "")
        return let(F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0)), joined)

    def all_marked(t: Column) -> Column:
        with_kind = lambda o, kind: F.when(tested(kind)[0](t), let(marked(t, kind), lambda m: F.when(m == t, o).when(o == t, m).otherwise(overlaid(o, m)))).otherwise(o)
        step = lambda out, kind: let(out, lambda o: with_kind(o, kind))
        return reduce(step, PATTERNS, t)

    return let(F.translate(text, MARK, " "), all_marked)


def joined(kinds: dict[str, Column]) -> Column:
    """kind:start:end of all spans by kind, comma-joined."""
    named = lambda kind, spans: F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))
    return F.array_join(F.concat(*(named(*x) for x in kinds.items())), ",")


def free_words(text: Column) -> Column:
    """Spans of the words of a marked text that hold no mark."""
    return F.filter(matches(text, f"[{MARK}" + WORD[1:]), lambda w: ~F.contains(w["text"], F.lit(MARK)))


def context_terms(chunks: Column, length: Column, span: Column, context: int) -> Column:
    """Words (lower-case) within so many characters of a span that neither the window cuts nor a datum has a part of. chunks: the marked text in pieces of CHUNK."""

    def between(first: Column, past: Column) -> Column:
        at = F.floor(first / CHUNK).cast("int")
        return F.substring(F.concat(F.get(chunks, at), F.coalesce(F.get(chunks, at + 1), F.lit(""))), first - at * CHUNK + 1, past - first)

    # A character of the span is seen with either side: there a word that runs into the span shows its mark.
    left, right = F.greatest(span["start"] - context, F.lit(0)), F.least(span["end"] + context, length)
    before = F.filter(free_words(between(left, span["start"] + 1)), lambda w: (w["start"] > 0) | (left == 0))
    after = F.filter(free_words(between(span["end"] - 1, right)), lambda w: (w["end"] < right - span["end"] + 1) | (right == length))
    return F.filter(F.transform(F.concat(before, after), lambda w: F.lower(w["text"])), lambda t: F.length(t) >= MIN_TERM)


def measured(pairs: DataFrame, by_term: DataFrame, by_entity: DataFrame, n_rows: int) -> DataFrame:
    """pairs (entity, term, n_both) with kind, null where little is disclosed. A term of many entities is dealt to several tasks."""
    # At most a row for each HEAVY pairs.
    heavy = F.broadcast(pairs.groupBy("term").agg(F.count("*").alias("_m")).where(F.col("_m") > HEAVY).select("term", F.ceil(F.col("_m") / HEAVY).cast("int").alias("_chunks")))
    chunks = F.coalesce("_chunks", F.lit(1))
    dealt = pairs.join(heavy, "term", "left").withColumn("_chunk", F.pmod(F.xxhash64("entity"), chunks).cast("int")).drop("_chunks")
    copied = by_term.join(heavy, "term", "left").withColumn("_chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("_chunks")
    total = float(max(n_rows, 1))
    ic = F.log2(F.lit(total) / F.col("n_entity"))
    pmi = F.log2(F.col("n_both") * total / (F.col("n_term") * F.col("n_entity")))
    both = dealt.join(copied, ["term", "_chunk"]).join(by_entity, "entity")
    return both.select("entity", "term", "n_both", F.when(pmi >= REMOVE * ic, "removed").when(pmi >= GENERALISE * ic, "general").alias("kind"))


def verdicts(pairs: DataFrame) -> DataFrame:
    """(term, kind, general) from measured pairs."""
    less = pairs.where(F.col("kind").isNull()).groupBy("entity").agg(F.min(F.struct((-F.col("n_both")).alias("n"), F.col("term").alias("word"))).alias("g")).select("entity", F.col("g.word").alias("general"))
    judged = pairs.where(F.col("kind").isNotNull()).join(less, "entity", "left").withColumn("kind", F.when(F.col("general").isNull(), "removed").otherwise(F.col("kind")))
    strongest = judged.groupBy("term").agg(F.max("kind").alias("kind"), F.min(F.when(F.col("kind") == "general", F.struct((-F.col("n_both")).alias("n"), F.col("general").alias("word")))).alias("g"))  # removed is the later word
    return strongest.select("term", "kind", F.when(F.col("kind") == "general", F.col("g.word")).alias("general"))


def find_pii(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """A row for each row of docs (doc_id, text): counts, digest of the base spans, all spans as text and, with what takes their place, as array (all_spans)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("same", F.xxhash64("text"))
    spans = rows.withColumns(base_spans(F.col("text"))).withColumn("taken", F.concat(*PATTERNS))
    entity = lambda kind: F.transform(F.col(kind), lambda x: F.struct(F.xxhash64(F.lit(kind), F.lower(x["text"]) if kind == "email" else digits(x["text"]) if kind != "ip" else x["text"]).alias("entity"), x["start"].alias("start"), x["end"].alias("end")))
    entities = spans.withColumn("entities", F.concat(*map(entity, PATTERNS)))
    pieces = F.regexp_extract_all(free_text(F.col("text")), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    near = let(F.length("text"), lambda n: let(pieces, lambda c: F.flatten(F.transform("entities", lambda x: F.transform(F.array_distinct(context_terms(c, n, x, context)), lambda term: F.concat_ws(":", x["entity"], term))))))
    # Pairs are strings while they are made distinct: of those Spark keeps a hash set, of structs a list.
    found = entities.withColumn("near", F.when(F.size("taken") > 0, F.array_distinct(near))).select("doc_id", "same", *PATTERNS, F.array_distinct(F.transform("entities", lambda x: x["entity"])).alias("entities"), "near")
    # One pass over the texts finds what is counted; matched strings aren't kept.
    bare = found.withColumns({k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in PATTERNS})
    base, _ = stored(bare, "pii-base")

    n_rows = base.count()
    by_entity = base.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    near = base.select(F.explode("near").alias("p")).select(F.substring_index("p", ":", 1).cast("long").alias("entity"), F.expr("substring(p, instr(p, ':') + 1)").alias("term"))
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= SUPPORT)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    # Rows that hold a term, for all terms of the corpus.
    by_term = rows.select(F.explode(F.array_distinct(F.transform(words, F.lower))).alias("term")).where(F.length("term") >= MIN_TERM).groupBy("term").agg(F.count("*").alias("n_term"))
    judged, _ = stored(verdicts(measured(pairs, by_term, by_entity, n_rows)), "pii-verdicts")

    # Of all rows, those that hold judged terms, in the forms that stand there; only their texts are searched again.
    key = ["_d", "_null", "same"]
    keyed = rows.withColumns({"_d": F.coalesce("doc_id", F.lit(0)), "_null": F.col("doc_id").isNull()})
    forms = keyed.select(*key, F.explode(F.array_distinct(words)).alias("form")).withColumn("term", F.lower("form"))
    hits = forms.join(judged, "term").groupBy(*key).agg(F.collect_set(F.struct("form", "kind", "general")).alias("hits"))
    edge = rf"[{MARK}\p{{L}}\p{{N}}]"
    place = lambda h: F.transform(matches(F.col("free"), F.concat(F.lit(f"(?<!{edge})"), h["form"], F.lit(f"(?!{edge})"))), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), h["kind"].alias("kind"), h["general"].alias("general")))
    more = keyed.join(hits, key).dropDuplicates(key).withColumn("free", free_text(F.col("text"))).select(*key, F.array_sort(F.flatten(F.transform("hits", place))).alias("more"))

    out = base.withColumns({"_d": F.coalesce("doc_id", F.lit(0)), "_null": F.col("doc_id").isNull()}).join(more, key, "left")
    kinds = {k: F.col(k) for k in PATTERNS}
    all_more = F.coalesce("more", F.array().cast("array<struct<start:int,end:int,kind:string,general:string>>"))
    of_kind = lambda k: F.filter(all_more, lambda x: x["kind"] == k)
    others = {k: of_kind(k) for k in MORE_KINDS}
    mark = lambda kind: F.lit(f"[{kind.upper()}]")
    named = lambda kind, spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), (s["general"] if kind == "general" else mark(kind)).alias("put")))
    return out.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS), F.sha2(joined(kinds), 256).alias("base_sha256"), joined(kinds | others).alias("spans"),
        *(F.size(x).cast("long").alias(f"n_{k}") for k, x in others.items()), "same",
        F.concat(*(named(*x) for x in (kinds | others).items())).alias("all_spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with [KIND] in place of every datum, [REMOVED] of every removed term and the general term of every generalised one (a span that overlaps an earlier one joins it); n_chars follows; other columns stay."""
    found = find_pii(docs).where(F.size("all_spans") > 0).select(F.col("doc_id").alias("_d"), F.col("same").alias("_s"), F.array_sort("all_spans").alias("_spans")).dropDuplicates(["_d", "_s"])

    def step(state: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= state["at"], F.concat(F.substring(F.col("text"), state["at"] + 1, x["start"] - state["at"]), x["put"])).otherwise("")
        return F.struct(F.concat(state["out"], gap).alias("out"), F.greatest(state["at"], x["end"]).alias("at"))

    whole = F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    changed = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_s")), "left").withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(whole))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)
