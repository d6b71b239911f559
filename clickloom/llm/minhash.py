"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

1. A text's words give a set of word shingles, each hashed to 64 bits. Documents with equal sets form a class (``node``:
   128 bits of the set); everything below runs on one row per class, so exact copies cost nothing.
2. Sketch: in round i every shingle is thrown into one of T bins by a hash of that round, and an empty bin keeps the
   smallest value thrown into it; from round T on, round T + j throws all shingles into bin j. So every coordinate is
   filled after at most 2T rounds, mostly after a few, and equal coordinates estimate the Jaccard similarity with
   concentration bounds like those of T independent min-hashes.
3. Banding: bands of R coordinates; classes that share a band's hash share a bucket. Their number follows from the similarity
   asked for: a pair at that similarity shares no bucket with probability MISSED. Buckets with the same members are one.
4. Leaders: in every bucket the class that shares most with others leads; each class is compared, on full sets, with the
   best connected of its leaders. Verified links join components, and buckets that lie in one component are done: a group of
   near copies, however large, takes one comparison each.
5. Tiles: what is left are buckets with classes that are not in the component of most. There, those classes are
   compared with all others, on full sets: a bucket is dealt by hash into tiles of bounded size, and each pair of tiles that holds
   open pairs is one block of work, in which one product of 0/1 matrices counts all intersections. Pairs inside the main
   component need no comparison: they cannot change it. The work is quadratic only in classes that are in fact unlike.

Sets travel once to each leader's chunk (CHUNK members) and to each block; links and components are tables; nothing of them
reaches the driver but counts. ``percent`` below 50 is refused: it would take over 800 bands.

Defined cases: null and blank texts have an empty set and are a component of their own each; fewer words than a shingle
has are one shingle; equal rows are one class; null ids are ids, after all others, when the smallest id is chosen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import if_small, unused, written

ROWS = 6
MISSED = 3e-6
#: A tile holds about so many classes or shingles; a column block of the 0/1 matrices so many different shingles.
TILE, TILE_SHINGLES, COLUMNS = 512, 200_000, 4096
CHUNK = 256
NODE = "struct<a:bigint,b:bigint>"
U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def bands_for(percent: int) -> int:
    """So many bands that a pair at the similarity shares none with probability MISSED."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    return 1 if percent == 100 else math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** ROWS))


def _round_seed(i: int) -> np.uint64:
    return U64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted set of hashed shingles. bytes.lower and bytes.split know ASCII letters and white space only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    size = min(size, len(h))
    n = len(h) - size + 1
    mixed = np.full(n, U64(size))
    for k in range(size):
        mixed = _mix((mixed + h[k:k + n]) * U64(0x9E3779B97F4A7C15))
    return np.unique(mixed)


def sketch(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` coordinates for every set; none may be empty."""
    out = np.full(len(sets) * size, U64(2**64 - 1))
    filled = np.zeros(len(sets) * size, bool)
    lengths = np.array([len(s) for s in sets])
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    for i in range(2 * size):
        v = _mix(items ^ _round_seed(i))
        if i < size:
            at = owner * size + ((v >> U64(32)) * U64(size) >> U64(32)).astype(np.int64)
            v = _mix(v)
        else:
            at = owner * size + (i - size)
        new = ~filled[at]
        np.minimum.at(out, at[new], v[new])
        filled[at[new]] = True
        full = filled.reshape(-1, size).all(axis=1)
        if full.all():
            break
        left = ~full[owner]
        items, owner = items[left], owner[left]
    return out.reshape(-1, size)


def _band_keys(sk: np.ndarray) -> np.ndarray:
    keys = np.repeat(np.arange(sk.shape[1] // ROWS, dtype=U64)[None, :], len(sk), axis=0)
    for r in range(ROWS):
        keys = _mix((keys + sk[:, r::ROWS]) * U64(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


def _node(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return tuple(int(np.sum(_mix(s * U64(k)), dtype=U64).view(np.int64)) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _chunks(sets: list[np.ndarray], most: int = 200_000, least: int = 32) -> Iterator[tuple[int, int]]:
    """Ranges of sets that are sketched together; a set counts as ``least`` shingles at least, for its sketch's memory."""
    start = total = 0
    for i, s in enumerate(sets):
        own = max(least, len(s))
        if total and total + own > most:
            yield start, i
            start, total = i, 0
        total += own
    if start < len(sets):
        yield start, len(sets)


def _sketched(size: int, bands: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingles(t, size) for t in frame["text"]]
            for start, end in _chunks(sets):
                some = sets[start:end]
                has = [k for k, s in enumerate(some) if len(s)]
                keys = [[] for _ in some]
                if has:
                    for k, key in zip(has, _band_keys(sketch([some[k] for k in has], ROWS * bands))):
                        keys[k] = key
                nodes = [_node(s) for s in some]
                yield pd.DataFrame({
                    "id": frame["id"].iloc[start:end].to_numpy(), "text_hash": frame["text_hash"].iloc[start:end].to_numpy(),
                    "a": [n[0] for n in nodes], "b": [n[1] for n in nodes], "n": [len(s) for s in some], "bands": keys,
                })
    return run


def _sets(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "shingles": [shingles(t, size).tobytes() for t in frame["text"]]})
    return run


def _compared(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leader, own = None, None
        for frame in frames:
            links = []
            for la, lb, salt, is_member, a, b, data in frame[["la", "lb", "salt", "member", "a", "b", "shingles"]].itertuples(index=False, name=None):
                s = np.frombuffer(data, U64)
                if not is_member:
                    leader, own = (la, lb, salt), s
                    continue
                if leader != (la, lb, salt):
                    raise RuntimeError("a member arrived without its leader")
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(s) - both):
                    links.append((la, lb, a, b))
            yield pd.DataFrame(links, columns=["la", "lb", "a", "b"]).astype("int64")
    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the ``pairs`` (leader, member: nodes) whose sets are similar enough."""
    sizes = pairs.groupBy("leader").agg(F.count("*").alias("members"))
    salted = pairs.join(sizes, "leader").withColumn("salt", F.pmod(F.xxhash64("member"), F.ceil(F.col("members") / CHUNK)).cast("int"))
    salted = salted.select("leader", "member", "salt")
    sets = sets.select("node", "shingles")
    members = salted.join(sets, salted.member == sets.node).select("leader", "salt", "member", "shingles")
    leaders = salted.select("leader", "salt").distinct()
    leaders = leaders.join(sets, leaders.leader == sets.node).select("leader", "salt", F.lit(None).cast(NODE).alias("member"), "shingles")
    both = members.unionByName(leaders).select(
        F.col("leader.a").alias("la"), F.col("leader.b").alias("lb"), "salt", F.col("member").isNotNull().alias("member"),
        F.coalesce("member.a", F.lit(0)).alias("a"), F.coalesce("member.b", F.lit(0)).alias("b"), "shingles",
    )
    dealt = both.repartition("la", "lb", "salt").sortWithinPartitions("la", "lb", "salt", "member")
    links = dealt.mapInPandas(_compared(percent), "la bigint, lb bigint, a bigint, b bigint")
    return links.select(F.struct(F.col("la").alias("a"), F.col("lb").alias("b")).alias("u"), F.struct("a", "b").alias("v"))


def contracted(links: DataFrame) -> DataFrame | None:
    """(node, root) for the nodes of ``links`` (u, v), root being one node for each component; None without links.

    Every node hooks onto its smallest neighbour if that is smaller; links are rewritten to the hooks, and loops and
    doubles go, until no link is left. Each step is written; at the end a node follows the hooks of all steps.
    """
    edges, steps = written(links.filter("u <> v").distinct(), "links"), []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("to")), "hooks")
        steps.append(hooks)
        first = edges.join(hooks, "u").select(F.col("to").alias("x"), F.col("v").alias("u"))
        second = first.join(hooks, "u").select("x", F.col("to").alias("y"))
        edges = written(
            second.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "links")
    if not steps:
        return None
    roots = steps[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for hooks in steps[1:]:
        moved = roots.join(hooks, roots.root == hooks.u, "left")
        roots = moved.select("node", F.coalesce("to", "root").alias("root"))
    return roots


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """The number of common elements of each set of ``left`` with each of ``right``, or with each other one of ``left``."""
    both = left + (right or [])
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, column, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = times[column] > 1  # what is in one set only counts for no pair
    owner, column = owner[shared], column[shared]
    values, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right or left)), np.float32)  # exact below 2**24
    for low in range(0, len(values), COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        held = np.zeros((len(both), min(COLUMNS, len(values) - low)), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        out += held[:len(left)] @ held[len(left) if right else 0:].T
    return out.astype(np.int64)


def _block_links(tile: list[int], comp: list[tuple[int, int]], sets: list[np.ndarray], low: int, high: int, percent: int) -> list[tuple]:
    """Links between components, one for each pair of them at most, found between two tiles or inside one."""
    left = [k for k, t in enumerate(tile) if t == low]
    right = [k for k, t in enumerate(tile) if t == high]
    if not left or not right:
        return []
    both = intersections([sets[k] for k in left], None if low == high else [sets[k] for k in right])
    n, m = (np.array([len(sets[k]) for k in side]) for side in (left, right))
    links = {(comp[left[i]], comp[right[j]]) for i, j in np.argwhere(100 * both >= percent * (n[:, None] + m[None, :] - both))}
    return sorted({(min(pair), max(pair)) for pair in links if pair[0] != pair[1]})


def _tiled(percent: int):
    schema = pa.schema([(c, pa.int64()) for c in ("la", "lb", "a", "b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, ([], [], [])

        def links() -> pa.RecordBatch:
            found = _block_links(*held, block[1], block[2], percent) if len(held[0]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([u[0] for u, _ in found], pa.int64()), pa.array([u[1] for u, _ in found], pa.int64()),
                                               pa.array([v[0] for _, v in found], pa.int64()), pa.array([v[1] for _, v in found], pa.int64())], schema=schema)

        for batch in batches:
            bucket, low, high, tile, ca, cb, data = (batch.column(k).to_pylist() for k in ("bucket", "low", "high", "tile", "ca", "cb", "shingles"))
            for k in range(len(bucket)):
                if block != (bucket[k], low[k], high[k]):
                    if block:
                        yield links()
                    block, held = (bucket[k], low[k], high[k]), ([], [], [])
                held[0].append(tile[k])
                held[1].append((ca[k], cb[k]))
                held[2].append(np.frombuffer(data[k], U64))
        if block:
            yield links()
    return run


def open_links(meeting: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """Links (u, v) between components, by comparing all classes of a bucket that may still join two components."""
    members = meeting.join(labels, "node").select("bucket", "node", "n", "comp")
    by_comp = members.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    buckets = by_comp.groupBy("bucket").agg(
        F.max(F.struct("c", "n", "comp")).alias("main"), F.sum("c").alias("c"), F.sum("n").alias("n")).filter("c > main.c")
    tiles = lambda c, n: F.greatest(F.ceil(c / tile), F.ceil(n / TILE_SHINGLES)).cast("int")
    buckets = buckets.select(
        "bucket", F.col("main.comp").alias("main"), tiles(F.col("main.c"), F.col("main.n")).alias("mains"),
        tiles(F.col("c") - F.col("main.c"), F.col("n") - F.col("main.n")).alias("others"))
    open_ = members.join(buckets, "bucket")
    all_tiles, hashed = F.col("mains") + F.col("others"), F.xxhash64("node", F.lit("tile"))
    is_main = F.col("comp") == F.col("main")
    own = F.when(is_main, F.pmod(hashed, "mains")).otherwise(F.col("mains") + F.pmod(hashed, "others")).cast("int")
    partners = F.sequence(F.when(is_main, F.col("mains")).otherwise(0), all_tiles - 1)
    dealt = open_.withColumn("tile", own).withColumn("partner", F.explode(partners))
    dealt = dealt.select("bucket", "node", "comp", "tile", F.least("tile", "partner").alias("low"), F.greatest("tile", "partner").alias("high"))
    whole = dealt.join(sets, "node").select(
        "bucket", "low", "high", "tile", F.col("comp.a").alias("ca"), F.col("comp.b").alias("cb"), "shingles")
    blocks = whole.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    links = blocks.mapInArrow(_tiled(percent), "la bigint, lb bigint, a bigint, b bigint")
    return links.select(F.struct(F.col("la").alias("a"), F.col("lb").alias("b")).alias("u"), F.struct("a", "b").alias("v"))


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """New components after adding links between components."""
    roots = contracted(links)
    if roots is None:
        return labels
    moved = labels.join(roots.select(F.col("node").alias("comp"), "root"), "comp", "left")
    return written(moved.select("node", F.coalesce("root", "comp").alias("comp")), "labels")


def components(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", leaders: bool = True,
) -> DataFrame:
    """One row per document: id, text_hash, n (size of its set), node, comp (both null for an empty set) and first,
    the smallest (id, text_hash) of its component. Runs Spark jobs when called. Without ``leaders`` all goes by tiles."""
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("text_hash"), F.col(text_col).alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()
    sketches = written(keyed.mapInPandas(
        _sketched(shingle, bands_for(percent)), f"id {kind}, text_hash bigint, a bigint, b bigint, n bigint, bands array<bigint>",
    ).withColumn("node", F.struct("a", "b")).drop("a", "b"), "sketches")
    nonempty = sketches.filter("n > 0")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    first = F.min(F.struct(order.alias("o"), "n", "bands"))
    classes = written(nonempty.groupBy("node").agg(first.alias("f")).select("node", "f.o", "f.n", "f.bands"), "classes")

    placed = classes.select("node", "n", F.explode("bands").alias("bucket"))
    members_of = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    shared = placed.groupBy("bucket").agg(F.count("*").alias("c"), *members_of).filter("c > 1")
    shared = shared.groupBy("c", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket", "c")
    meeting = written(placed.join(shared, "bucket"), "meeting")
    some = written(meeting.groupBy("node").agg(F.sum("c").alias("met")), "meeting-nodes")
    found = classes.join(some, "node", "left_semi")
    wanted = if_small(written(found.select("node", F.col("o.id").alias("id"), "o.text_hash"), "wanted"))
    texts = keyed.alias("d").join(wanted.alias("w"), F.expr("d.id <=> w.id AND d.text_hash = w.text_hash"))
    texts = texts.select("w.node.a", "w.node.b", "d.text")
    sets = texts.mapInPandas(_sets(shingle), "a bigint, b bigint, shingles binary").dropDuplicates(["a", "b"])
    sets = written(sets.select(F.struct("a", "b").alias("node"), "shingles"), "sets")

    labels = some.select("node", F.col("node").alias("comp"))
    if leaders:
        ranked = meeting.select("bucket", "node", "n").join(some, "node")
        leader = ranked.groupBy("bucket").agg(F.max(F.struct("met", "node", "n")).alias("l"))
        fit = (F.col("l.node") != F.col("node")) & (100 * F.least("n", "l.n") >= percent * F.greatest("n", "l.n"))
        pairs = meeting.join(leader, "bucket").filter(fit).groupBy("node").agg(F.max(F.struct("l.met", "l.node")).alias("l"))
        pairs = written(pairs.select(F.col("l.node").alias("leader"), F.col("node").alias("member")), "leader-pairs")
        labels = _merge(labels, verified(pairs, sets, percent))
    labels = _merge(labels, open_links(meeting, labels, sets, percent))

    labelled = written(classes.select("node", "o").join(labels, "node", "left").select("node", "o", F.coalesce("comp", "node").alias("comp")), "labelled")
    smallest = labelled.groupBy("comp").agg(F.min("o").alias("first"))
    of = written(labelled.join(smallest, "comp").select("node", "comp", "first"), "components")
    grouped = nonempty.select("id", "text_hash", "n", "node").join(of, "node").select("id", "text_hash", "n", "node", "comp", "first")
    alone = sketches.filter("n = 0").select("id", "text_hash", "n", F.lit(None).cast(NODE).alias("node"), F.lit(None).cast(NODE).alias("comp"), order.alias("first"))
    return grouped.unionByName(alone)


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component, one row each; rows with an empty set all stay.

    Columns of ``docs`` may have any name. Runs Spark jobs when called."""
    found = components(docs, shingle, percent, id_col, text_col).filter("node IS NOT NULL")
    rows = written(found.groupBy("id", "text_hash").agg(
        F.count("*").alias("times"), F.first("first").alias("first")), "rows")
    is_first = F.expr("id <=> first.id AND text_hash = first.text_hash")
    gone = if_small(written(rows.filter(~is_first).select("id", "text_hash"), "dropped"))
    twice = written(rows.filter(is_first & (F.col("times") > 1)).select("id", "text_hash"), "repeated")
    text_hash = unused(docs, "text_hash")
    keyed = docs.withColumn(text_hash, F.coalesce(F.xxhash64(text_col), F.lit(0)))
    same = F.expr(f"d.`{id_col}` <=> g.id AND d.`{text_hash}` = g.text_hash")
    kept = keyed.alias("d").join(gone.alias("g"), same, "left_anti")
    if not twice.isEmpty():  # equal rows: one of them stays
        again = if_small(twice).alias("g")
        single = kept.alias("d").join(again, same, "left_semi").dropDuplicates([id_col, text_hash])
        kept = kept.alias("d").join(again, same, "left_anti").unionByName(single)
    return kept.drop(text_hash)
