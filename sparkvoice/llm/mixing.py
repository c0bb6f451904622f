"""Mixing sources to target weights.

A source's documents, in a seeded order, are one line of words, cut into blocks of equally many words. A seeded order
of a source's blocks is walked, once more where the source is to be repeated, until its target, rounded to words, is
taken: the last block is cut. That is Sainte-Lague apportionment at one word a seat, so a source of any size meets its
target to half a word. A document's share is what is taken of its words. ``apportion`` gives seats of whole blocks by
highest quotients target / (2s + 1); the order in which they are won cuts them into shards, so every shard has an
integer quota of each source.

Sources in code point order, null last, weigh 3, 1, 2, repeating. Targets share 1.5 times all words by weight, none
above twice its source; what is above is shared again by weight.

Defined cases: null or empty texts have size 0 and take 0; repeated rows count one by one; an empty table gives an
empty table; other columns are kept by ``mixed_documents`` and ignored by ``mix``. The number of blocks is bounded by
``blocks``, whatever the input's size, plus one for each source; it bounds no source's error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small, table, words

SEED = 77
#: Blocks into which all words are cut.
BLOCKS = 131_072
LANE_ROWS = 500_000
#: Bytes of a document's cuts, as far as the choice of a join needs them.
CUT_BYTES = 120


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size -> also sid, weight and target. One row for each source passes through one window."""
    everything = Window.partitionBy(F.lit(0))
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("sid", F.row_number().over(ordered) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("pool", F.sum("source_size").over(everything) * share).withColumn("all_w", F.sum("weight").over(everything))
    ranked = Window.partitionBy(F.lit(0)).orderBy("ratio", "sid")
    past = ranked.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("i", F.row_number().over(ranked))
    left = F.col("pool") - F.coalesce(F.sum("cap").over(past), F.lit(0.0))
    t = t.withColumn("level", left / (F.col("all_w") - F.coalesce(F.sum("weight").over(past), F.lit(0.0))))
    # Up to the first source whose cap is not below the level of those left, all are capped.
    t = t.withColumn("at", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("i", "level"))).over(everything))
    target = F.when(F.col("at").isNull() | (F.col("i") < F.col("at.i")), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at.level") * F.col("weight")))
    return t.select("source", "sid", F.col("source_size").cast("long"), "weight", target.alias("target"))


def apportion(targets: DataFrame, words_per_block: int, seats: int, shards: int, seed: int, most: int = 2) -> DataFrame:
    """sid, block, shard: a row for each seat."""
    n = F.expr(f"cast(ceil(source_size / {words_per_block}) as long)")
    parties = targets.withColumn("n", n).filter("n > 0")
    seat = parties.select("sid", "target", "n", F.explode(F.expr(f"sequence(0L, {most} * n - 1)")).alias("s"))
    best = Window.partitionBy(F.lit(0)).orderBy((F.col("target") / (2 * F.col("s") + 1)).desc(), "sid", "s")
    won = seat.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= seats)
    won = won.select("sid", (F.col("s") % F.col("n")).alias("pos"), F.expr(f"cast(((rank - 1) * {shards}) div {max(seats, 1)} as int)").alias("shard"))
    block = parties.select("sid", F.explode(F.expr("sequence(0L, n - 1)")).alias("block"))
    order = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed), "sid", "block"), "block")
    return won.join(block.withColumn("pos", (F.row_number().over(order) - 1).cast("long")), ["sid", "pos"]).select("sid", "block", "shard")


def spans(targets: DataFrame, words_per_block: int, seed: int) -> DataFrame:
    """sid, block, first, last, times: words first to last - 1 of a source's line, inside one block, are taken so many
    times. They add up to the source's rounded target."""
    b = words_per_block
    block = targets.filter("source_size > 0").select("sid", "source_size", F.round("target").cast("long").alias("aim"), F.explode(F.expr(f"sequence(0L, (source_size - 1) div {b})")).alias("block"))
    block = block.withColumn("width", F.expr(f"least({b}L, source_size - block * {b})"))
    before = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed), "sid", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.expr("aim % source_size") - F.coalesce(F.sum("width").over(before), F.lit(0))
    block = block.withColumn("more", F.greatest(F.lit(0), F.least(rest, F.col("width")))).withColumn("rounds", F.expr("aim div source_size"))
    # A block's first words are taken once more than its others where the target ends in it.
    cut = F.expr(f"""array(struct(block * {b} as first, block * {b} + more as last, rounds + 1 as times),
        struct(block * {b} + more as first, block * {b} + width as last, rounds as times))""")
    return block.select("sid", "block", F.explode(cut).alias("c")).select("sid", "block", "c.*").filter("last > first and times > 0")


def _plan(spark: SparkSession, sized: DataFrame, scratch: Scratch, blocks: int, seed: int):
    """sized (row, doc_id, source, size) -> its lines (with sid, start), targets, taken spans and words per block."""
    targets = scratch.table(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    total = targets.agg(F.sum("source_size").alias("words")).first()
    b = max(1, (total["words"] or 0) // blocks)
    won = scratch.table(spans(targets, b, seed), "spans")
    lanes = max(64, sized.count() // LANE_ROWS)
    named = targets.select(F.col("source").alias("__s"), "sid")
    line = sized.join(named, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    line = line.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("lane", F.pmod("h", F.lit(lanes)))
    line = scratch.table(line, "lines")
    offset = line.groupBy("sid", "lane").agg(F.sum("size").alias("n"))
    past = Window.partitionBy("sid").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offset = offset.select("sid", "lane", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("offset"))
    within = Window.partitionBy("sid", "lane").orderBy("h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    line = line.join(offset, ["sid", "lane"]).withColumn("start", F.col("offset") + F.col("before"))
    return line.select("row", "doc_id", "size", "sid", "start"), targets, won, b


def mix(spark: SparkSession, sized: DataFrame, blocks: int = BLOCKS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """sized: row (unique), doc_id, source, size. Gives the rows with source_size, target, taken, and the pieces
    (row, size, lo, hi, times): words lo to hi - 1 of the document are taken so many times."""
    scratch = Scratch(spark, "mixing")
    line, targets, won, b = _plan(spark, sized, scratch, blocks, seed)
    line = scratch.table(line, "starts")
    met = line.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
    pieces = met.join(won, ["sid", "block"]).select(
        "row", "size", F.greatest(F.expr("first - start"), F.lit(0)).alias("lo"), F.least(F.expr("last - start"), F.col("size")).alias("hi"), "times",
    ).filter("hi > lo")
    pieces = scratch.table(pieces, "pieces")
    taken = pieces.groupBy("row").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
    out = line.join(taken, "row", "left").join(targets.select("sid", "source_size", "target"), "sid")
    return out.select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), pieces


def mixed_documents(spark: SparkSession, docs: DataFrame, **more) -> DataFrame:
    """The mix itself, in the columns of docs: each document once for every round in which some of its words are
    taken, its text cut to them (whole documents keep their text as it is); n_chars follows the text."""
    scratch = Scratch(spark, "mixed")
    # Packed, so that no column of docs meets one of ours.
    whole = docs.select(F.monotonically_increasing_id().alias("at"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    whole = scratch.table(whole, "docs")
    sized = whole.select(F.col("at").alias("row"), "doc.doc_id", "doc.source", F.size(words(F.col("doc.text"))).cast("long").alias("size"))
    sized = scratch.table(sized, "sizes")
    _, pieces = mix(spark, sized, **more)
    cuts = pieces.groupBy("row", "size").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "times"))).alias("cuts"), F.max("times").cast("int").alias("rounds"))
    cuts = scratch.table(cuts, "cuts")
    out = whole.join(small(cuts, CUT_BYTES), F.col("at") == F.col("row"))
    # A text is split once, and only where some round takes a part of it.
    rounds = F.transform(F.sequence(F.lit(1), F.col("rounds")), lambda r: F.filter("cuts", lambda c: c["times"] >= r))
    covered = lambda own: F.aggregate(own, F.lit(0).cast("long"), lambda a, c: a + c["hi"] - c["lo"])
    out = out.withColumn("taken", rounds)
    out = out.withColumn("w", F.when(F.exists("taken", lambda own: covered(own) < F.col("size")), words(F.col("doc.text"))))
    part = lambda own: F.concat_ws(" ", F.transform(own, lambda c: F.concat_ws(" ", F.slice(F.col("w"), (c["lo"] + 1).cast("int"), (c["hi"] - c["lo"]).cast("int")))))
    texts = F.transform("taken", lambda own: F.when(covered(own) == F.col("size"), F.col("doc.text")).otherwise(part(own)))
    out = out.select("doc", F.explode(texts).alias("cut"))
    new = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: what the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    sized = Scratch(spark, "op8").table(sized, "sizes")
    return mix(spark, sized)[0].select("doc_id", "size", "source_size", "target", "taken")
