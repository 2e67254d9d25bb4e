"""Near-duplicate documents by an LSH forest over MinHash signatures.

Each tree is one sorted order of the signatures.  Documents that stand next to
each other there share the longest prefixes, so neighbours are compared first,
however deep their common prefix is.  A region is a run of documents that
share ``LEAST_DEPTH`` values; where a region still falls into several groups
after that, its pairs across groups are looked at.  A crowded region is first
followed to a greater depth, in several orders so that no link gets lost, as
far as that leaves less to compare.  Every link is confirmed on the full
shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, components, map_arrow, staged, table, text_slices
from .shingles import shingle_set, word_hashes

WIDTH = 4
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 80
TREES, DEPTH, LEAST_DEPTH = 16, 8, 4
VALUES = TREES * DEPTH
#: Share of equal signature values below which a pair is not looked at: five deviations under the threshold.
LEAST_EQUAL = PERCENT / 100 - 5 * (0.16 / VALUES) ** 0.5
#: Documents of a region that one cell compares; larger regions go deeper or are cut into blocks.
BLOCK = 512
#: Documents of a region that is crowded: orders in which it is divided, values that each adds to its depth, and how often it may go deeper.
#: A pair at the threshold parts in one order with 1 - 0.8 ** 6, in all of them with about 3e-4.
CROWDED, ORDERS, DEEPER, LEVELS = 4096, 32, 6, 2
_SLICE = 1 << 20

_rng = np.random.default_rng(4_711)
_XOR = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
_TIMES = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
#: The values of each order of each level.
_FURTHER = np.random.default_rng(90_210).permuted(np.tile(np.arange(VALUES), (LEVELS * ORDERS, 1)), axis=1)[:, :DEEPER].reshape(LEVELS, ORDERS, DEEPER).tolist()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the hash functions, big endian so that bytes sort."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 2048):
        x = (low[a : a + 2048, None] ^ _XOR) * _TIMES
        np.minimum(best, x.min(0), out=best)
    return best.astype(">u4")


def similar(a: int, b: int, both: int, percent: int = PERCENT) -> bool:
    return 100 * both >= percent * (a + b - both)


def _describe(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sig) of every row; equal sets have equal set_a and set_b."""

    def run(batches):
        for batch in batches:
            n, sums, mixes, sigs = [], [], [], []
            for a, b, raw, off in text_slices(batch.column(1), _SLICE):
                words, before = word_hashes(raw, off)
                for i in range(b - a):
                    s = shingle_set(words[before[i] : before[i + 1]], width)
                    n.append(len(s))
                    sums.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    mixes.append(int(np.bitwise_xor.reduce(s * (s >> np.uint64(7)) if len(s) else s, initial=0).view(np.int64)) if len(s) else 0)
                    sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.int64()), pa.array(mixes, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "sig"])

    return map_arrow(docs, run, "doc_id long, n_shingles long, set_a long, set_b long, sig binary")


def _neighbours(paths: DataFrame) -> DataFrame:
    """(a, b, depth): rows (tree, path, rep) next to each other in their tree, with their common depth.

    Rows are range-partitioned by their whole place in the order, so a region
    of any size is spread over tasks.
    """
    ordered = paths.repartitionByRange("tree", "path", "rep").sortWithinPartitions("tree", "path", "rep")

    def run(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if batch.num_rows:
                held = batch.slice(batch.num_rows - 1)
            if batch.num_rows < 2:
                continue
            tree, rep = batch.column("tree").to_numpy(), batch.column("rep").to_numpy()
            path = np.frombuffer(b"".join(batch.column("path").to_pylist()), ">u4").reshape(-1, DEPTH)
            depth = (np.cumprod(path[1:] == path[:-1], axis=1)).sum(1)
            keep = (tree[1:] == tree[:-1]) & (depth >= LEAST_DEPTH) & (rep[1:] != rep[:-1])
            a, b = rep[:-1][keep], rep[1:][keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(depth[keep].astype(np.int32))], names=["a", "b", "depth"])

    return map_arrow(ordered, run, "a long, b long, depth int")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, shingles) of the wanted documents, as sorted 64-bit values."""

    def run(batches):
        for batch in batches:
            out = []
            for a, b, raw, off in text_slices(batch.column(1), _SLICE):
                words, before = word_hashes(raw, off)
                out += [shingle_set(words[before[i] : before[i + 1]], width).tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["rep", "shingles"])

    texts = docs.join(wanted.select(F.col("rep").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", "text")
    return map_arrow(texts, run, "rep long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("in_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("in_b"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("in_a"), batch.column("in_b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                near = similar(len(x), len(y), min(len(x), len(y)), percent)
                keep.append(near and similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "in_a", "in_b"), run, "a long, b long")


def _deepened(placed: DataFrame, sigs: DataFrame) -> DataFrame:
    """rows (region, rep, part), with crowded regions divided by further values of the signatures wherever that at least halves the pairs.

    A region that its orders don't divide well stays as it is, for ``_cells``;
    no row of it is left out.
    """
    for orders in _FURTHER:
        crowded = staged(placed.groupBy("region").agg(F.count("*").cast("double").alias("n")).where(F.col("n") > CROWDED))
        if crowded.isEmpty():
            break
        subs = F.array(*[F.xxhash64("region", F.lit(k), *[F.substring("sig", 4 * v + 1, 4) for v in values]) for k, values in enumerate(orders)])
        each = placed.join(crowded.select("region"), "region", "left_semi").join(sigs, "rep")
        each = staged(each.select("region", "rep", "part", F.explode(subs).alias("sub")))
        several = staged(each.groupBy("region", "sub").agg(F.count("*").cast("double").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi"))
        left = several.groupBy("region").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
        divided = staged(crowded.join(left, "region", "left").where(2 * F.coalesce("pairs", F.lit(0.0)) <= F.col("n") * F.col("n")).select("region"))
        if divided.isEmpty():
            break
        inner = each.join(several.select("region", "sub"), ["region", "sub"], "left_semi").join(divided, "region", "left_semi")
        placed = staged(placed.join(divided, "region", "left_anti").select("region", "rep", "part").union(inner.select(F.col("sub").alias("region"), "rep", "part")))
    return placed


def _cells(rows: DataFrame, group: str) -> DataFrame:
    """rows (``group``, part, ...) with ``cell`` and ``side`` so that rows of different part meet in a cell.

    A group of at most BLOCK rows is one cell.  In a larger one, rows of its
    most frequent part never meet each other: they stand in blocks of their
    own and only the other rows are brought to them.
    """
    sizes = rows.groupBy(group, "part").agg(F.count("*").alias("n"))
    tops = sizes.groupBy(group).agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("all")).where(F.col("all") > BLOCK)
    tops = tops.select(group, F.col("top.part").alias("main"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("others"))
    tops = staged(tops)
    if tops.isEmpty():
        return rows.withColumn("cell", F.lit("0")).withColumn("side", F.lit(0))
    cut = rows.join(tops, group, "left")
    is_main = F.col("part") == F.col("main")
    block = F.pmod(F.xxhash64("rep"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    cut = cut.withColumn("block", block)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda kind, i, j: F.concat_ws("-", F.lit(kind), i, j)
    cells = (
        F.when(F.col("main").isNull(), F.array(F.struct(F.lit("0").alias("cell"), F.lit(0).alias("side"))))
        .when(is_main, F.transform(upto(F.col("others")), lambda i: F.struct(pair("m", i, F.col("block")).alias("cell"), F.lit(1).alias("side"))))
        .otherwise(
            F.concat(
                F.transform(upto(F.col("mains")), lambda j: F.struct(pair("m", F.col("block"), j).alias("cell"), F.lit(2).alias("side"))),
                F.transform(upto(F.col("others")), lambda j: F.struct(pair("o", F.least("block", j), F.greatest("block", j)).alias("cell"), F.when(F.col("block") == j, 0).when(F.col("block") < j, 1).otherwise(2).alias("side"))),
            )
        )
    )
    return cut.withColumn("at", F.explode(cells)).select(*rows.columns, "at.cell", "at.side")


def _across(t: pa.Table) -> np.ndarray:
    """Which rows of a cell may meet: of different parts, and on different sides if it has two."""
    part, side = t["part"].to_numpy(), t["side"].to_numpy()
    return (part[:, None] != part[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] == 0))


def _equal_share(t: pa.Table) -> np.ndarray:
    """Share of equal signature values of all pairs of a cell, judged on a byte of each."""
    s = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(t), VALUES)
    out = np.empty((len(s), len(s)), np.float32)
    for i in range(len(s)):
        out[i] = (s == s[i]).sum(1)
    return out / VALUES


def _promising(t: pa.Table):
    """Rows of a cell that have a partner in another group which looks near enough."""
    if len(t) < 2:
        return
    pairs = _across(t)
    keep = pairs.any(1)
    t, pairs = t.filter(pa.array(keep)), pairs[np.ix_(keep, keep)]
    if len(t):
        keep = (pairs & (_equal_share(t) >= LEAST_EQUAL)).any(1)
        yield from t.filter(pa.array(keep)).combine_chunks().to_batches()


def _spanning(percent: int):
    def work(t: pa.Table):
        """Confirmed links that join the groups of a cell, most promising first; none inside a group."""
        if len(t) < 2:
            return
        near = np.where(_across(t), _equal_share(t), 0)
        i, j = np.nonzero(np.triu(near >= LEAST_EQUAL, 1))
        order = np.argsort(-near[i, j], kind="stable")
        rep, part = t["rep"].to_pylist(), t["part"].to_pylist()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in t["shingles"]]
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        found = []
        for x, y in zip(i[order].tolist(), j[order].tolist()):
            p, q = root(part[x]), root(part[y])
            if p == q:
                continue
            a, b = sets[x], sets[y]
            if similar(len(a), len(b), min(len(a), len(b)), percent) and similar(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True)), percent):
                above[max(p, q)] = min(p, q)
                found.append((rep[x], rep[y]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return work


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    A document's set holds its distinct shingles of ``width`` words; with
    fewer words, the whole sequence.  Documents whose sets have 100 * both >=
    ``percent`` * union are linked; component_id is the smallest id reachable
    over links, kept is doc_id = component_id.

    Null texts and texts without a word have an empty set, n_shingles 0, and
    link with nothing.  Equal sets are one class that is compared once, so
    copies are never paired.  Rows of one id are one node.  A row without an
    id links with nothing and is not kept.  An empty table stays empty; other
    columns are not looked at.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = staged(_describe(docs, width))
    with_set = rows.where("n_shingles > 0 and doc_id is not null")
    same = ["set_a", "set_b", "n_shingles"]
    classes = staged(with_set.groupBy(*same).agg(F.min("doc_id").alias("rep")))
    reps = with_set.join(classes.withColumnRenamed("rep", "doc_id"), [*same, "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), "sig")

    places = reps.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    path = F.substring("sig", F.col("tree") * F.lit(4 * DEPTH) + 1, F.lit(4 * DEPTH))
    paths = places.select("tree", path.alias("path"), "rep")
    regions = paths.select(F.xxhash64("tree", F.substring("path", 1, 4 * LEAST_DEPTH)).alias("region"), "rep")
    shared = regions.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region")
    regions = staged(regions.join(shared, "region", "left_semi").distinct())

    crowded = reps.join(regions.select("rep").distinct(), "rep", "left_semi")
    crowded = staged(crowded.withColumn("sketch", F.unhex(F.regexp_replace(F.hex("sig"), "(.{6})(.{2})", "$2"))))
    near = crowded.select("rep", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig").select("tree", path.alias("path"), "rep")
    pairs = staged(_neighbours(near))
    best = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "depth")).groupBy("a").agg(F.max(F.struct("depth", (-F.col("b")).alias("b"))).alias("best"))
    best = best.select(F.least("a", -F.col("best.b")).alias("a"), F.greatest("a", -F.col("best.b")).alias("b")).distinct()

    sketches = crowded.select("rep", "sketch")
    sets = staged(_sets(docs, crowded.select("rep"), width))
    links = staged(_confirmed(best, sets, percent))

    parts = components(links).withColumnRenamed("id", "rep").withColumnRenamed("component", "part")
    placed = staged(regions.join(parts, "rep", "left").select("region", "rep", F.coalesce("part", "rep").alias("part")))
    several = placed.groupBy("region").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("who")).where("lo < hi")
    several = several.groupBy("who", "n", "lo", "hi").agg(F.min("region").alias("region")).select("region")
    deep = _deepened(placed.join(several, "region", "left_semi").select("region", "rep", "part"), crowded.select("rep", "sig"))
    open_rows = deep.join(sketches, "rep")
    open_rows = _cells(open_rows.select("region", "rep", "part", "sketch"), "region")
    schema = "region long, rep long, part long, sketch binary, cell string, side int"
    promising = staged(by_group(open_rows.select("region", "rep", "part", "sketch", "cell", "side"), ["region", "cell"], _promising, schema))
    more = staged(by_group(promising.join(sets, "rep"), ["region", "cell"], _spanning(percent), "a long, b long"))

    final = components(links.union(more)).withColumnRenamed("id", "rep")
    of_class = classes.join(final, "rep", "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    linked = with_set.join(of_class, same).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op8_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
