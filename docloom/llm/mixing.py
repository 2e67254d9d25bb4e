"""Mixing sources to target weights, in fixed-length blocks of words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import find_range, pick, set_aside, staged, table, uniform

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words; no source more than so many times its own.
SHARE, MOST_TIMES = 1.5, 2
#: Longest block in words; a source of fewer than BLOCK * LEAST_BLOCKS words has shorter ones.
BLOCK, LEAST_BLOCKS = 256, 512
SLOTS_PER_SHARD = 4096
ROUNDS = 12
SEED = 20_240_917
#: Documents whose places in their source one task adds up, about.
SUMMED_TOGETHER = 5_000


@dataclass
class Source:
    """One source of the mix; ``key`` is its name behind an ``s``, or ``n`` for null."""

    key: str
    size: int
    target: float
    block: int
    blocks: int
    wanted: int


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST_TIMES) -> list[float]:
    """Targets in proportion to the weights, capped at ``most`` times the size.

    What a cap cuts off is shared again by weight among the others until none
    is above its cap.
    """
    want, out = share * sum(sizes), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        all_weights = sum(weights[i] for i in sorted(free))
        over = {i for i in free if want * weights[i] / all_weights > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = want * weights[i] / all_weights
            break
        for i in over:
            out[i] = float(most * sizes[i])
        want -= sum(out[i] for i in sorted(over))
        free -= over
    return out


def plan_sources(sized: DataFrame) -> list[Source]:
    """The sources in code point order, null last; one row each comes to the driver.

    The list of sources is a parameter of the mix, a few names; it doesn't
    grow with the documents.
    """
    found = {r["source"]: r["size"] for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    names = sorted((x for x in found if x is not None), key=lambda x: x.encode("utf-8", "surrogatepass")) + [None] * (None in found)
    sizes = [found[x] for x in names]
    wanted = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))])
    out = []
    for name, size, target in zip(names, sizes, wanted):
        block = max(1, min(BLOCK, size // LEAST_BLOCKS))
        blocks = -(-size // block)
        out.append(Source("n" if name is None else f"s{name}", size, target, block, blocks, min(MOST_TIMES * blocks, round(target * blocks / size)) if size else 0))
    return out


def source_key(c: Column | str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(c) if isinstance(c, str) else c), F.lit("n"))


def laid_out(sized: DataFrame, sources: list[Source]) -> DataFrame:
    """sized with ``s`` (number of the source) and ``start`` (words of it before the document).

    Running sums are made of the sums of hashed parts of a source and the sums
    within a part, so a source that holds most documents is added up by many
    tasks.
    """
    number = F.array_position(F.array(*[F.lit(x.key) for x in sources]) if sources else F.array().cast("array<string>"), source_key()) - 1
    rows = sized.withColumn("s", number.cast("int"))
    salts = max(64, -(-sized.count() // SUMMED_TOGETHER))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts)).cast("int"))
    sums = salted.groupBy("s", "salt").agg(F.sum("size").alias("sum"))
    before = W.partitionBy("s").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("s", "salt", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("s", "salt").orderBy("doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = F.sum("size").over(within) - F.col("size")
    return salted.withColumn("running", running).join(sums, ["s", "salt"]).withColumn("start", F.col("before") + F.col("running")).drop("salt", "running", "before")


def permuted(i: Column, n: Column, *keys: Column | str) -> Column:
    """A pseudorandom permutation of 0..n-1 applied to i: swap-or-not rounds."""

    def swap(at: Column, r: Column) -> Column:
        mate = F.pmod(F.xxhash64(F.lit(SEED), r, *keys) % n - at, n)
        coin = F.xxhash64(F.lit(SEED + 1), r, F.greatest(at, mate), *keys).bitwiseAND(F.lit(1))
        return F.when(coin == 1, mate).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i.cast("long"), swap)


def draw_blocks(spark, sources: list[Source]) -> DataFrame:
    """(shard, slot, s, epoch, block): which block of which source stands in each slot.

    Every slot of an output shard draws its source, so a shard's counts are
    multinomial.  A source's slots are numbered over all shards; those beyond
    the blocks it may give move to sources that drew too few.  The number,
    through the source's permutation, is the block: each block once per epoch.
    """
    total = sum(x.wanted for x in sources)
    bounds, at = [], 0
    for x in sources[:-1]:
        at += x.wanted
        bounds.append(at / max(1, total))
    slots = spark.range(total).select((F.col("id") / SLOTS_PER_SHARD).cast("long").alias("shard"), (F.col("id") % SLOTS_PER_SHARD).cast("int").alias("slot"), find_range(bounds, uniform("id", F.lit(SEED))).alias("s"))
    counts = slots.groupBy("shard", "s").agg(F.count("*").alias("n"))
    before = W.partitionBy("s").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("shard", "s").orderBy("slot")) - 1
    numbered = slots.withColumn("nth", nth).join(offsets, ["shard", "s"]).select("shard", "slot", "s", (F.col("before") + F.col("nth")).alias("j"))

    drawn = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    spare, spares, lacks, lack = 0, [], [], 0
    for k, x in enumerate(sources):
        spares.append(spare - x.wanted)  # + j: number among all slots that move
        spare += max(0, drawn.get(k, 0) - x.wanted)
        if drawn.get(k, 0) < x.wanted:
            lacks.append((lack, k, drawn.get(k, 0)))
            lack += x.wanted - drawn.get(k, 0)
    if lacks:
        moves = F.col("j") >= pick([x.wanted for x in sources], F.col("s"))
        number = F.col("j") + pick(spares, F.col("s"))
        numbered = numbered.withColumn("to", F.when(moves, find_range([x[0] for x in lacks[1:]], number)))
        numbered = numbered.select(
            "shard", "slot",
            F.when(moves, pick([x[1] for x in lacks], F.col("to"))).otherwise(F.col("s")).alias("s"),
            F.when(moves, number - pick([x[0] for x in lacks], F.col("to")) + pick([x[2] for x in lacks], F.col("to"))).otherwise(F.col("j")).alias("j"),
        )
    blocks = pick([x.blocks for x in sources], F.col("s")).cast("long") if sources else F.lit(1)
    numbered = numbered.withColumn("blocks", blocks).withColumn("epoch", F.floor(F.col("j") / F.col("blocks")).cast("int"))
    return numbered.select("shard", "slot", "s", "epoch", permuted(F.col("j") % F.col("blocks"), F.col("blocks"), "s", "epoch").alias("block"))


def parts_taken(laid: DataFrame, drawn: DataFrame, sources: list[Source]) -> DataFrame:
    """(doc_id, s, size, start, block, epoch, words) for the part of each document in each drawn block.

    ``start`` tells repeated rows apart.  Blocks are joined by index.
    """
    length = pick([x.block for x in sources], F.col("s"))
    first, last = F.floor(F.col("start") / F.col("length")), F.floor((F.col("start") + F.col("size") - 1) / F.col("length"))
    spread = laid.where("size > 0").select("doc_id", "s", "size", "start", length.cast("long").alias("length")).withColumn("block", F.explode(F.sequence(first, last)))
    words = F.least((F.col("block") + 1) * F.col("length"), F.col("start") + F.col("size")) - F.greatest(F.col("block") * F.col("length"), F.col("start"))
    return spread.withColumn("words", words).join(drawn.select("s", "epoch", "block"), ["s", "block"]).drop("length")


def sized_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; needs doc_id, source, text.

    Sizes are words.  Null text: size 0, nothing taken.  A null source is a
    source of its own.  Repeated rows are taken each for itself; the same
    input always gives the same mix.  An empty table stays empty.  A source
    takes its target to within about a block; no block is taken more than
    twice, so no document is.  Built-in functions only.
    """
    sized = staged(sized_rows(docs))
    sources = plan_sources(sized)
    laid = laid_out(sized, sources)
    if not sources or not sum(x.wanted for x in sources):
        return laid.select("doc_id", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    laid = staged(laid)
    taken = parts_taken(laid, draw_blocks(docs.sparkSession, sources), sources).groupBy("s", "start").agg(F.sum("words").alias("taken"))
    got = laid.where("size > 0").join(taken, ["s", "start"], "left").select("doc_id", "s", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    none = laid.where("size = 0").select("doc_id", "s", "size", F.lit(0).cast("long").alias("taken"))
    return got.union(none).select("doc_id", "size", pick([x.size for x in sources], F.col("s")).cast("long").alias("source_size"), pick([x.target for x in sources], F.col("s")).alias("target"), "taken")


def op6_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself as documents: the columns of ``docs``, one row per document and epoch it is taken in.

    The text is what the drawn blocks hold of the document: all of it as it
    was, or the words of the blocks, joined by single spaces.  ``n_chars``, if
    there is such a column, is the new length.  Documents of which nothing is
    drawn, and those without a word, are not in the mix.  Needs doc_id, source
    and text; the cases are those of :func:`mix`.
    """
    docs, back = set_aside(docs, ("doc_id", "text", "source", "n_chars"))
    sized = staged(sized_rows(docs))
    sources = plan_sources(sized)
    if not sum(x.wanted for x in sources):
        return back(docs.limit(0))
    laid = staged(laid_out(sized, sources).where("size > 0"))
    parts = parts_taken(laid, draw_blocks(docs.sparkSession, sources), sources)
    epochs = parts.groupBy("s", "start", "epoch").agg(F.sum("words").alias("words"), F.collect_list("block").alias("blocks"))
    takes = epochs.groupBy("s", "start").agg(F.collect_list(F.struct("epoch", "words", "blocks")).alias("takes"))
    named = laid.join(takes, ["s", "start"]).select(F.col("doc_id").alias("take_id"), "s", "start", F.col("size").alias("take_size"), "takes")
    if sized.groupBy("doc_id").count().where("count > 1").isEmpty():
        joined = docs.join(named.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("take_id")))
    else:
        #: rows of one id are told apart by their rank among them, in the same order on both sides
        ranked = laid.select(F.col("doc_id").alias("take_id"), "s", "start", F.row_number().over(W.partitionBy("doc_id").orderBy("size", source_key(), "start")).alias("take_nth"))
        plan = ranked.join(named, (ranked["take_id"].eqNullSafe(named["take_id"])) & (ranked["s"] == named["s"]) & (ranked["start"] == named["start"])).select(ranked["take_id"], ranked["s"], ranked["start"], "take_nth", "take_size", "takes")
        size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD))
        rows = docs.withColumn("own_size", size).where("own_size > 0").withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy("own_size", source_key(), F.xxhash64("text"))))
        joined = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("take_id")) & (F.col("nth") == F.col("take_nth")))
    joined = joined.withColumn("take", F.explode("takes"))
    length = pick([x.block for x in sources], F.col("s"))
    words = F.filter(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w, i: F.array_contains(F.col("take.blocks"), F.floor((F.col("start") + i) / length)))
    text = F.when(F.col("take.words") == F.col("take_size"), F.col("text")).otherwise(F.array_join(words, " "))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return back(out)
