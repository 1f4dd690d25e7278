"""N-gram Jaccard join: chosen-path join.

A text is the set of its runs of SHINGLE words (words: what white space parts). In each of several runs, a tree of nodes splits
the sets: at a node a set x follows each token it holds with probability 1 / (THRESHOLD |x|), by a hash of node and token, so
that sets above the threshold go on together at least once on average and others thin out. A node of at most LEAF sets is
brute-forced; a larger one is split again, down to DEPTH, and what is larger there is brute-forced in chunks, so nothing is
capped. Pairs at the threshold survive a run of full depth with a probability that a branching process gives, and the number
of runs follows from the wanted recall.

Brute force compares sketches (min-hashes and sizes), far below the threshold, and gives stars. What they connect is
checked exactly: all sets of a connected piece meet, by chunks of GROUP, and Jaccard similarities are counted from
products of incidence matrices. A text goes to one chunk only; pairs of chunks get its difference from the piece's first set, which
for near copies is a small part of it, and from which similarities follow exactly. Since sets of one piece all meet there, the first FIRST_RUNS runs compare only within chunks, dealt anew at each
node, and then all runs leave out nodes whose sets are in one piece already: a large group of near copies goes down the trees
of the first runs only, and isn't compared by pairs of chunks. Exact copies are one class from the start; links are counted, not written as pairs.

Defined cases: a text under SHINGLE words is one token, all its words; one without words (null, empty, blank) links with
nothing; rows alike in doc_id and text are copies of one another; a row without doc_id counts as one more copy of an equal
text that has one (n_links are that text's) and else links with nothing; rows that share a doc_id with different texts are
sets of their own, of which one (by hash) stands first in a group where several have the smallest doc_id; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, by_groups, discard, stored
from .components import stars

THRESHOLD = 0.8
SHINGLE = 5
RECALL = 0.9995
DEPTH = 3
FIRST_RUNS = 5
LEAF = 48
GROUP = 256
#: Sketches that a chunk of a leaf holds.
SKETCHES = 1024
SKETCH = 64
#: Sketches whose share of equal places is less than the threshold by this can't be of a pair, but for 1 in a million.
SLACK = 0.25
SEED = 11

U64 = np.uint64
SALTS = np.random.default_rng(SEED).integers(1, 1 << 63, size=SKETCH, dtype=np.uint64) * U64(2) + U64(1)
#: Numbers that a step over tokens holds at once, so that they stay in a processor's cache.
AT_ONCE = 1 << 15
#: Words whose hashes are kept.
CACHED = 200_000

SCANNED = "doc_id long, k1 long, k2 long, size int, sketch binary, firsts array<smallint>, nodes1 array<long>, nodes2 array<long>, parents2 array<smallint>, nodes3 array<long>, parents3 array<smallint>"
ARRAYS = ("size", "sketch", "firsts", "nodes1", "nodes2", "parents2", "nodes3", "parents3")

#: What a set of a piece of several chunks goes to the others as.
ENCODED = ("size", "base", "missing", "apart")
PIECES = "piece long, chunk int, chunks int, rep long, n long, links long, parent long, size int, base int, missing int, apart binary"

KNOWN: dict[str, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits."""
    x = (x ^ (x >> U64(29))) * U64(0x9FB21C651E98DF25)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def word_hashes(words: list[str]) -> np.ndarray:
    try:
        return np.fromiter(map(KNOWN.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(KNOWN) > CACHED:
            KNOWN.clear()
        KNOWN.update((w, xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in set(words).difference(KNOWN))
        return np.fromiter(map(KNOWN.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None) -> np.ndarray:
    """The set of a text, as sorted 64-bit hashes."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(words) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(words))):
        total = total * U64(0x9E3779B97F4A7C15) + h[i : i + n]
    return np.unique(mixed(total))


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs for a pair at the threshold, which goes on together once on average at each level."""
    survives = 1.0
    for _ in range(depth):
        survives = 1 - math.exp(-survives)
    return math.ceil(math.log(1 - recall) / math.log(1 - survives))


def chosen(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children that a set goes on to from nodes, hashed from node and token, and the place of each one's parent in nodes.

    A token's draw at a node is its hash times the node's odd number; high bits of such products are spread evenly.
    """
    limit = U64(min(float(1 << 64) / (THRESHOLD * len(tokens)), float((1 << 64) - 2048)))
    odd, step = nodes | U64(1), max(1, AT_ONCE // len(tokens))
    children, parents = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for at in range(0, len(nodes), step):
        draw = (tokens * odd[at : at + step, None]).ravel()
        taken = np.flatnonzero(draw < limit)
        place = at + taken // len(tokens)
        children.append(mixed(draw[taken] + nodes[place]))
        parents.append(place)
    return np.concatenate(children), np.concatenate(parents)


def paths(tokens: np.ndarray, runs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By level: (nodes, places of their parents in the level above)."""
    above = mixed(np.arange(1, runs + 1, dtype=np.uint64) * U64(SEED))
    out = []
    for _ in range(DEPTH):
        above, parents = chosen(tokens, above)
        out.append((above, parents))
    return out


def of_first_runs(levels: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """By level, how many of the nodes, which are in the order of the runs, the first runs have."""
    out, n = [], FIRST_RUNS
    for _, parents in levels:
        n = int(np.searchsorted(parents, n))
        out.append(n)
    return out


def sketch(tokens: np.ndarray) -> bytes:
    low = np.full(SKETCH, np.iinfo(np.uint64).max)
    spread, step = mixed(tokens), AT_ONCE // SKETCH
    for at in range(0, len(tokens), step):
        low = np.minimum(low, (spread[at : at + step] * SALTS[:, None]).min(axis=1))
    return mixed(low).astype(np.uint8).tobytes()


def scanned(batches: Iterator[pa.RecordBatch], runs: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            rows = []
            for text in batch.column("text").to_pylist():
                tokens = shingles(text)
                rows.append((len(tokens), sketch(tokens), paths(tokens, runs)) if len(tokens) else (0, b"", [(np.empty(0, np.uint64),) * 2] * DEPTH))

            def lists(level: int, part: int) -> pa.Array:
                found = [r[2][level][part] for r in rows]
                values = np.concatenate(found).astype(np.int16) if part else np.concatenate(found).view(np.int64)
                return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32()), pa.array(values))

            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                pa.array([of_first_runs(r[2]) for r in rows], pa.list_(pa.int16())), lists(0, 0), lists(1, 0), lists(1, 1), lists(2, 0), lists(2, 1),
            ], names=["doc_id", "k1", "k2", "size", *ARRAYS[1:]])


def lowest_reached(linked: np.ndarray) -> np.ndarray:
    """For each row of a square of links the first row that they reach."""
    low = np.arange(len(linked), dtype=np.int32)
    while True:
        lower = low.copy()
        for at in range(0, len(low), ROWS_AT_ONCE):
            part = slice(at, at + ROWS_AT_ONCE)
            lower[part] = np.minimum(low[part], np.where(linked[part], low, np.int32(len(low))).min(axis=1))
        lower = np.minimum(lower, lower[lower])
        if (lower == low).all():
            return low
        low = lower


def alike(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each leaf, or pair of chunks: stars of what sketches and sizes don't part; a pair of chunks gives only what joins their own stars."""
    rep, chunk, c1, c2 = (np.asarray(table.column(x)) for x in ("rep", "chunk", "c1", "c2"))
    size = np.asarray(table.column("size")).astype(float)
    sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    least = (THRESHOLD - SLACK) * SKETCH
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        order = a + np.argsort(rep[a:b], kind="stable")
        s, n = sketches[order], size[order]
        linked = np.empty((b - a, b - a), bool)
        for at in range(0, b - a, ROWS_AT_ONCE):
            part = slice(at, at + ROWS_AT_ONCE)
            equal = np.zeros((len(s[part]), b - a), np.uint8)
            for k in range(SKETCH):
                equal += s[part, k, None] == s[None, :, k]
            linked[part] = (equal >= least) & (np.minimum(n[part, None], n) >= THRESHOLD * np.maximum(n[part, None], n))
        np.fill_diagonal(linked, False)
        low = lowest_reached(linked)
        some = low != np.arange(b - a)
        if c1[a] != c2[a]:  # each chunk's own group gives the rest
            mine = chunk[order]
            some &= lowest_reached(linked & (mine[:, None] == mine)) == np.arange(b - a)
        pairs.append((rep[order][some], rep[order][low[some]]))
    # Runs find the same pairs again.
    found = np.unique(np.stack([np.concatenate([p[i] for p in pairs]) for i in range(2)], axis=1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(found[:, i], pa.int64()) for i in range(2)], names=["u", "v"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections, from products of incidence matrices, some tokens at a time."""
    sizes = [len(x) for x in sets]
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = times[place] > 1
    owner, place = owner[shared], place[shared]
    _, place = np.unique(place, return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(sets), len(sets)))
    width = 4096
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, (at, at + width))
        has = np.zeros((len(sets), min(width, int(place[b - 1]) - at + 1)), np.float32)
        has[owner[a:b], place[a:b] - at] = 1
        total += has @ has.T
    return total


def links_and_stars(both: np.ndarray, sizes: np.ndarray, n: np.ndarray, across: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From sizes of intersections and sets: whether a set links to another, the rows it links to (n each), and the first set that links reach. Given across, chunks, only links from one to another count."""
    linked = both / np.maximum(sizes[:, None] + sizes - both, 1) >= THRESHOLD
    np.fill_diagonal(linked, False)
    if across is not None:
        linked &= across[:, None] != across
    return linked.any(axis=1), linked @ n, lowest_reached(linked)


def of_chunks(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each chunk of a piece: the links and stars of its sets. Where a piece has more chunks, each set too, as its size and what parts it from the piece's base: tokens that only one of them has, and how many it misses."""
    piece, rep, n, chunk, chunks, base = (np.asarray(table.column(x)) for x in ("piece", "rep", "n", "chunk", "chunks", "base"))
    alone: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def batch(at: np.ndarray, links: np.ndarray, parents: pa.Array, encoded: list[pa.Array]) -> pa.RecordBatch:
        columns = [pa.array(piece[at]), pa.array(chunk[at], pa.int32()), pa.array(chunks[at], pa.int32()), pa.array(rep[at]), pa.array(n[at]), pa.array(links, pa.int64()), parents, *encoded]
        return pa.RecordBatch.from_arrays(columns, names=["piece", "chunk", "chunks", "rep", "n", "links", "parent", *ENCODED])

    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        mine = a + np.flatnonzero(~base[a:b])
        order = mine[np.argsort(rep[mine], kind="stable")]
        if not len(order):  # a chunk that no set fell in
            continue
        sets = [shingles(table.column("text")[int(i)].as_py()) for i in order]
        sizes = np.array([len(x) for x in sets])
        some, links, low = links_and_stars(intersections(sets), sizes.astype(float), n[order])
        if chunks[a] == 1:
            alone.append((order[some], links[some], rep[order][low][some]))
            continue
        whole = shingles(table.column("text")[a + int(np.flatnonzero(base[a:b])[0])].as_py())
        apart = [np.setxor1d(x, whole, assume_unique=True) for x in sets]
        missing = [(len(x) + len(whole) - len(s)) // 2 for s, x in zip(sets, apart)]
        encoded = [pa.array(sizes, pa.int32()), pa.array(np.full(len(order), len(whole)), pa.int32()), pa.array(missing, pa.int32()), pa.array([x.tobytes() for x in apart], pa.binary())]
        yield batch(order, links, pa.array(rep[order][low], pa.int64(), mask=~some), encoded)
    if alone:
        at, links, parents = (np.concatenate([x[i] for x in alone]) for i in range(3))
        yield batch(at, links, pa.array(parents, pa.int64()), [pa.nulls(len(at), t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary())])


def across_chunks(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each pair of a piece's chunks: for each set that links to the other chunk the rows it links to there, and its star.

    With R the base, |A & B & R| = |R| - |R - A| - |R - B| + |R - A - B|, and the tokens that A and B both miss or both have besides are what their differences from R share.
    """
    rep, n, chunk, size, base, missing = (np.asarray(table.column(x)) for x in ("rep", "n", "chunk", "size", "base", "missing"))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        order = a + np.argsort(rep[a:b], kind="stable")
        apart = [np.frombuffer(table.column("apart")[int(i)].as_py(), U64) for i in order]
        lacks = missing[order].astype(float)
        both = base[a] - lacks[:, None] - lacks + intersections(apart)
        some, links, low = links_and_stars(both, size[order].astype(float), n[order], chunk[order])
        out.append((rep[order][some], links[some], rep[order][low][some]))
    columns = [np.concatenate([o[i] for o in out]) for i in range(3)]
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["rep", "links", "parent"])


def in_chunks(rows: DataFrame, keys: list[str], limit: int, pairs: bool) -> DataFrame:
    """rows (keys, rep, size of the group) with chunk, c1, c2: groups over the limit become chunks or pairs of chunks, a row in each pair of its own."""
    cut = rows.withColumn("chunks", F.ceil(F.col("group_size") / limit).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("rep", *keys), F.col("chunks")).cast("int"))
    if not pairs:
        return cut.select(*keys, "rep", F.col("chunk").alias("c1"), F.col("chunk").alias("c2"), "chunk")
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return spread.select(*keys, "rep", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "chunk")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with two hashes that tell texts apart."""
    return docs.select("doc_id", "text").withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(SEED), "text")})


def leaves(classes: DataFrame, piece: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(node, rep, group_size) of the nodes to be brute-forced: of the first runs, or given piece (rep, piece) of all runs, where a node's sets are in several pieces; and the paths of tables that hold them."""
    found, held = None, []
    heavy = None
    for level in range(1, DEPTH + 1):
        node = F.col(f"nodes{level}").alias("node")
        paths = F.transform(node, lambda n: F.struct(n.alias("node"))) if level == 1 else F.arrays_zip(node, F.transform(f"parents{level}", lambda i: F.get(f"nodes{level - 1}", i)).alias("parent"))
        n = F.col("firsts")[level - 1].cast("int")
        here = classes.select("rep", (paths if piece else F.slice(paths, F.lit(1), n)).alias("paths"))
        if level == 1:
            sets = here.join(piece, "rep", "left").withColumn("piece", F.coalesce("piece", "rep")) if piece else here.withColumn("piece", F.col("rep"))
        else:
            sets = here.join(heavy, "rep").withColumn("paths", F.filter("paths", lambda x: F.array_contains("heavy", x["parent"])))
        places = sets.select("rep", "piece", F.explode(F.array_distinct(F.transform("paths", lambda x: x["node"]))).alias("node"))
        sizes = places.groupBy("node").agg(F.count("*").alias("group_size"), F.min("piece").alias("low"), F.max("piece").alias("high")).where("low <> high").select("node", "group_size")
        met, path = stored(places.join(sizes, "node"), "nodes")
        held.append(path)
        leaf = met if level == DEPTH else met.where(F.col("group_size") <= LEAF)
        found = leaf if found is None else found.unionByName(leaf)
        heavy = met.where(F.col("group_size") > LEAF).groupBy("rep").agg(F.collect_set("node").alias("heavy"), F.first("piece").alias("piece"))  # a set follows a few nodes
    return found.select("node", "rep", "group_size"), held


def linked_roughly(classes: DataFrame, leaf: DataFrame, pairs: bool) -> DataFrame:
    groups = in_chunks(leaf, ["node"], SKETCHES, pairs).join(classes.select("rep", "size", "sketch"), "rep")
    return by_groups(groups, ["node", "c1", "c2"], alike, "u long, v long")


def similar_texts(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_links (rows it links to), class_id (smallest doc_id that links reach), whether its text stands first in its group, and the hashes k1, k2 of its text."""
    spark = docs.sparkSession
    runs = runs_needed(recall)
    rows = keyed(docs)
    full, at_full = stored(rows.mapInArrow(lambda batches: scanned(batches, runs), SCANNED), "chosen-paths")
    grouped = full.where((F.col("size") > 0) & F.col("doc_id").isNotNull()).groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), *(F.first(x).alias(x) for x in ARRAYS))
    # rep numbers the classes in the order of their smallest ids: an id may stand for several texts.
    ordered = grouped.repartitionByRange("low", "k1").sortWithinPartitions("low", "k1")
    classes, at = stored(ordered.withColumn("rep", F.monotonically_increasing_id()), "text-classes")
    scan, _ = stored(full.select("doc_id", "size", "k1", "k2"), "text-keys")
    discard(spark, at_full)

    leaf, held = leaves(classes)
    first = stars(linked_roughly(classes, leaf, pairs=False))
    leaf, more = leaves(classes, first.select(F.col("node").alias("rep"), F.col("component").alias("piece")))
    later = linked_roughly(classes, leaf, pairs=True)
    pieces = stars(later.unionByName(first.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    for path in held + more:
        discard(spark, path)

    member = pieces.select(F.col("node").alias("rep"), F.col("component").alias("piece"))
    member = member.unionByName(member.select(F.col("piece").alias("rep"), "piece").distinct())
    sizes = member.groupBy("piece").agg(F.count("*").alias("group_size"))
    # The wanted texts: one row of each class that stands in a piece.
    wanted = member.join(sizes, "piece").join(classes.select("rep", "low", "n", "k1", "k2"), "rep").select(F.col("low").alias("doc_id"), "k1", "k2", "rep", "piece", "group_size", "n")
    found = rows.join(wanted, ["doc_id", "k1", "k2"]).dropDuplicates(["doc_id", "k1", "k2"])
    cut = found.withColumn("chunks", F.ceil(F.col("group_size") / GROUP).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    # A text goes to its own chunk; that of a piece's first set, its base, to all of the piece's chunks.
    own = F.array(F.struct("chunk", F.lit(False).alias("base")))
    copies = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(c.alias("chunk"), F.lit(True).alias("base")))
    dealt = cut.withColumn("at", F.explode(F.when((F.col("rep") == F.col("piece")) & (F.col("chunks") > 1), F.concat(own, copies)).otherwise(own)))
    sets, at_sets = stored(by_groups(dealt.select("piece", "at.chunk", "chunks", "at.base", "rep", "n", "text"), ["piece", "chunk"], of_chunks, PIECES), "piece-sets")
    spread = sets.where("chunks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("other <> chunk")
    pairs = spread.select("piece", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "chunk", "rep", "n", *ENCODED)
    across = by_groups(pairs, ["piece", "c1", "c2"], across_chunks, "rep long, links long, parent long")
    counted, at_links = stored(sets.where(F.col("parent").isNotNull()).select("rep", "links", "parent").unionAll(across), "text-links")
    discard(spark, at_sets)
    components = stars(counted.select(F.col("rep").alias("u"), F.col("parent").alias("v")))

    links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    lows = components.join(classes.select(F.col("rep").alias("component"), F.col("low").alias("component_low")), "component").select(F.col("node").alias("rep"), "component_low")
    by_class = classes.select("k1", "k2", "rep", "n", "low").join(links, "rep", "left").join(lows, "rep", "left")
    by_class = by_class.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_low", "low").alias("class_id"), F.col("component_low").isNull().alias("first"))
    done, _ = stored(by_class, "text-results")
    discard(spark, at)
    discard(spark, at_links)
    return scan.select("doc_id", F.col("size").alias("n_shingles"), "k1", "k2").join(done, ["k1", "k2"], "left").select(
        "doc_id", F.coalesce("first", F.lit(True)).alias("first"), F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(F.col("n_shingles") > 0, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"), "n_shingles", "k1", "k2"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id names their class, one of each; columns stay. Texts without words all stay."""
    kept = similar_texts(docs).where(F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_d"), F.col("k1").alias("_1"), F.col("k2").alias("_2")).distinct()
    keyed_docs = docs.withColumns({"_k1": F.xxhash64("text"), "_k2": F.xxhash64(F.lit(SEED), "text")})
    same = keyed_docs.doc_id.eqNullSafe(kept["_d"]) & (F.col("_k1") == F.col("_1")) & (F.col("_k2") == F.col("_2"))
    return keyed_docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_k1", "_k2"]).select(*docs.columns)
