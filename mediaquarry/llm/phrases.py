"""Phrases whose words go together, by level-wise passes as Apriori makes them.

Texts are lower-cased (A to Z only), cut into pieces at punctuation and line ends, and pieces into words. The first pass
counts words. Pass k counts phrases of k words, of which only those are emitted whose first and last k - 1 words both are
frequent in their language: what is frequent was counted by the pass before and reaches the tasks as a broadcast bit
table of at most FILTER_BLOCKS blocks, whose size doesn't follow the corpus. The table lets a few rare ones through, so it
saves work and never decides: a phrase counts by its own exact number of occurrences, and one with a rare part can't be
frequent. Cuts are then scored from the counts of all levels, joined by phrase.

All counts are combined in the map tasks before they are shuffled; joins on common words are split by the adaptive skew
join; the best LIMIT of a language are chosen in buckets first. Products are decimals of 38 digits.

Defined cases: a null text is empty, a null lang is `und` (and meets rows whose lang is that); texts of any length are
worked on whole; repeated rows count each; ties end in the order of phrases, which is total; a table without words gives
no rows; only text and lang are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, discard, stored

UNKNOWN = "und"
LONGEST = 3
LEAST = 10
#: A candidate goes if one that contains it has at least this share of its occurrences, in percent.
COVERED = 50
SCALE = 1_000_000
LIMIT = 2000
#: A block of the bit table is BLOCK longs; a phrase sets BITS bits of one block.
BLOCK, BITS = 64, 3
#: At most 64 MB of bits.
FILTER_BLOCKS = 1 << 17
#: Bits for each phrase as long as the bound allows it.
ROOM = 12
TOP_BUCKETS = 32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(docs: DataFrame) -> DataFrame:
    """lang and each piece that has words, its words parted by one space."""
    cut = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.explode(F.split(F.coalesce("text", F.lit("")), r"[.,;:!?\n-\r]")).alias("piece"))
    cut = cut.select("lang", F.trim("piece", F.lit(" \t")).alias("piece")).where(F.col("piece") != "")
    # lower() also changes letters beyond A to Z, which only texts of one byte a character surely don't have.
    low = F.when(F.octet_length("piece") == F.length("piece"), F.lower("piece")).otherwise(F.translate("piece", UPPER, LOWER))
    return cut.select("lang", F.array_join(F.split(low, "[ \t]+"), " ").alias("piece"))


def grams(cut: DataFrame, k: int) -> DataFrame:
    """lang and w1 to wk for each k words that follow one another in a piece."""
    cut = cut.select("lang", F.split("piece", " ").alias("words"))
    shifted = [F.col("words"), *(F.expr(f"slice(words, {i + 1}, size(words))") for i in range(1, k))]
    rows = cut.where(F.size("words") >= k).select("lang", F.inline(F.arrays_zip(*(x.alias(f"w{i + 1}") for i, x in enumerate(shifted)))).alias(*(f"w{i + 1}" for i in range(k))))
    return rows.where(F.col(f"w{k}").isNotNull())


def joined(first: int, last: int) -> Column:
    return F.concat_ws(" ", *(F.col(f"w{i}") for i in range(first, last + 1)))


def bits_of(lang: Column, phrase: Column, blocks: int) -> tuple[Column, list[tuple[Column, Column]]]:
    """A phrase's block, and the long and the bit in it that each of its BITS bits has."""
    h = F.xxhash64(lang, phrase)
    # The low bits choose the block; each further 12 bits a long and a bit.
    return h.bitwiseAND(F.lit(blocks - 1).cast("long")), [(F.shiftrightunsigned(h, 20 + 12 * i).bitwiseAND(F.lit(63)).cast("int"), F.shiftrightunsigned(h, 26 + 12 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]


def bit_table(frequent: DataFrame, blocks: int) -> DataFrame:
    """block and its longs, of the frequent phrases (lang, phrase)."""
    block, bits = bits_of(F.col("lang"), F.col("phrase"), blocks)
    each = frequent.select(block.alias("block"), F.inline(F.array(*(F.struct(a.alias("at"), b.alias("bit")) for a, b in bits))))
    longs = each.groupBy("block", "at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("long"))
    filled = longs.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("at", "long"))).alias("m"))
    return filled.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("longs"))


def blocks_for(n: int) -> int:
    blocks = 1
    while blocks < FILTER_BLOCKS and blocks * BLOCK * 64 < n * ROOM:
        blocks *= 2
    return blocks


def may_be_frequent(rows: DataFrame, table: DataFrame, blocks: int, phrase: Column, keep: list[str]) -> DataFrame:
    block, bits = bits_of(F.col("lang"), phrase, blocks)
    numbered = {f"_a{i}": a for i, (a, _) in enumerate(bits)} | {f"_b{i}": b for i, (_, b) in enumerate(bits)}
    met = rows.withColumns({"_block": block} | numbered).join(F.broadcast(table.withColumnRenamed("block", "_block")), "_block")
    for i in range(BITS):
        met = met.where(F.expr(f"getbit(longs[_a{i}], _b{i}) = 1"))
    return met.select(*keep)


def level_tables(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[list[DataFrame], DataFrame, list[str]]:
    """For each length the frequent phrases (lang, phrase, f and their words), the number of words of each lang, and the paths of what is stored."""
    cut, path = stored(pieces(docs), "phrase-pieces")  # every level reads them
    paths = [path]
    counted = grams(cut, 1).groupBy("lang", "w1").agg(F.count("*").alias("f"))
    # Rare words are one row of their lang: they only count for the number of words.
    words, path = stored(counted.groupBy("lang", F.when(F.col("f") >= least, F.col("w1")).alias("w1")).agg(F.sum("f").alias("f")), "phrase-words")
    paths.append(path)
    levels = [words.where(F.col("w1").isNotNull()).withColumn("phrase", F.col("w1"))]
    for k in range(2, longest + 1):
        keep = ["lang", *(f"w{i}" for i in range(1, k + 1))]
        blocks = blocks_for(levels[-1].count())
        table, path = stored(bit_table(levels[-1], blocks), "phrase-bits")
        paths.append(path)
        rows = may_be_frequent(grams(cut, k), table, blocks, joined(1, k - 1), keep)
        rows = may_be_frequent(rows, table, blocks, joined(2, k), keep)
        level, path = stored(rows.groupBy(*keep).agg(F.count("*").alias("f")).where(F.col("f") >= least).withColumn("phrase", joined(1, k)), f"phrase-level{k}")
        paths.append(path)
        levels.append(level)
    return levels, words.groupBy("lang").agg(F.sum("f").alias("n")), paths


def lowest_cuts(levels: list[DataFrame]) -> DataFrame:
    """lang, phrase, a and the l, r and score of the lowest-scoring cut, of all phrases of two words and more."""
    cuts = None
    for k, level in enumerate(levels[1:], 2):
        each = level.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.array(*(F.struct(F.lit(i).alias("k"), joined(1, i).alias("left"), joined(i + 1, k).alias("right")) for i in range(1, k)))))
        cuts = each if cuts is None else cuts.unionByName(each)
    known = None
    for level in levels[:-1]:
        known = level.select("lang", "phrase", "f") if known is None else known.unionByName(level.select("lang", "phrase", "f"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = {x: F.col(x).cast("decimal(15,0)") for x in ("a", "l", "r")}
    top = (F.lit(SCALE).cast("decimal(7,0)") * (exact["a"] * exact["a"])).alias("top")
    scored = cuts.select("lang", "phrase", "a", "k", "l", "r", top, (exact["l"] * exact["r"]).alias("under")).withColumn("score", F.expr("top div under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")


def uncovered(levels: list[DataFrame]) -> DataFrame:
    """lang and phrase of candidates that no longer candidate with share enough of their occurrences contains."""
    left = None
    for k, level in enumerate(levels[1:], 2):
        own = level.select("lang", "phrase", "f")
        for n, longer in enumerate(levels[k:], k + 1):
            parts = longer.select("lang", "f", F.explode(F.array(*(joined(i, i + k - 1) for i in range(1, n - k + 2)))).alias("phrase"))
            most = parts.groupBy("lang", "phrase").agg(F.max("f").alias("_most"))
            own = own.join(most, ["lang", "phrase"], "left").where(F.col("_most").isNull() | (100 * F.col("_most") < COVERED * F.col("f"))).drop("_most")
        left = own if left is None else left.unionByName(own)
    return left.select("lang", "phrase")


def best_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first phrases by score."""
    levels, totals, paths = level_tables(docs, longest, least)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scored = lowest_cuts(levels).join(uncovered(levels), ["lang", "phrase"], "left_semi")
    for keys in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(TOP_BUCKETS))], ["lang"]):
        scored = scored.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)
    found = scored.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    result = checkpointed(found)
    for path in paths:
        discard(docs.sparkSession, path)
    return result
