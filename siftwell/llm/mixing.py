"""Mixing sources to target weights: blocks of fixed length, drawn per output shard and joined by index.

Each source's documents form one stream of words, cut into blocks of a fixed length. Output shards hold a fixed
number of slots. How many slots of a shard go to each source is drawn from the target shares; slot after slot of a
source is then mapped through a pseudorandom permutation of its block numbers, a new one for every pass over the
source. Slots meet documents in one join on (source, block number), which spreads a hot source over all its blocks.

All draws are hashes of their coordinates, so reruns and retried tasks agree.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import words
from siftwell.storage import staged

BLOCK_WORDS = 32
SHARD_SLOTS = 1024
MOST_SHARDS = 4096
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
# Rows of a source that one task puts in order.
BUCKET_ROWS = 4096

# Primes above any number of blocks; a step that shares no factor with the count visits every block once.
STEPS = (999999999999999989, 1000000000000000003, 1000000000000000009, 2305843009213693951)


class Mixture(NamedTuple):
    """sources: one row per source; slots: one per use of a block; rows: one per document with the words taken."""

    sources: DataFrame
    slots: DataFrame
    rows: DataFrame


def _uniform(*coordinates: Column) -> Column:
    """A reproducible draw from [0, 1)."""
    return F.pmod(F.xxhash64(*coordinates), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Each source's share of all words by weight, none above `most` times what it has.

    Resharing an excess until nothing is above ends at one level: a source takes its weight times that level
    or, where that is less, all it may. Sources in order of the level at which they are used up give it directly.
    The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    used_up = Window.orderBy("full_at", "place")
    before = used_up.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumns({"place": F.row_number().over(order), "limit": F.col("source_size") * F.lit(float(most))})
    ranked = ranked.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1)})
    ranked = ranked.withColumns({"full_at": F.col("limit") / F.col("weight")})
    taken, spent = F.coalesce(F.sum("limit").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(whole) - taken) / (F.sum("weight").over(whole) - spent)
    ranked = ranked.withColumns({"__level": level})
    fits = F.when(F.col("__level") <= F.col("full_at"), F.col("__level"))
    ranked = ranked.withColumns({"__level": F.coalesce(F.max(fits).over(whole), F.lit(0.0))})
    return ranked.withColumns({"target": F.least(F.col("limit"), F.col("weight") * F.col("__level"))}).drop("__level", "full_at", "limit")


def _plan(sizes: DataFrame, weights: tuple[int, ...], most: int, block: int) -> DataFrame:
    """One row per source: its blocks, and its interval of [0, 1) from which slots are drawn."""
    whole = Window.partitionBy(F.lit(0))
    plan = _targets(sizes, weights, most).withColumns({"blocks": F.ceil(F.col("source_size") / block).cast("long")})
    # The last block may be short, so a slot of the source brings its mean block on average.
    plan = plan.withColumns({"wanted": F.when(F.col("blocks") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)})
    plan = plan.withColumns({"slots": F.round(F.sum("wanted").over(whole)).cast("long")})
    share = F.when(F.sum("wanted").over(whole) > 0, F.col("wanted") / F.sum("wanted").over(whole)).otherwise(0.0)
    plan = plan.withColumns({"share": share})
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    plan = plan.withColumns({"high": F.least(F.lit(1.0), F.sum("share").over(upto))})
    low = F.coalesce(F.lag("high").over(Window.orderBy("place")), F.lit(0.0))
    last = F.col("place") == F.max("place").over(whole)
    return plan.withColumns({"low": low}).withColumns({"high": F.when(last, 1.0).otherwise(F.col("high"))})


def _drawn(bound: Column, seed: int) -> Column:
    """How many of a shard's draws lie below `bound`; draw k is uniform in [k / n, (k + 1) / n)."""
    n = F.col("shard_slots")
    whole = F.floor(bound * n)
    return whole + F.when(_uniform(F.lit(seed), F.col("shard"), whole) < bound * n - whole, 1).otherwise(0)


def _slots(plan: DataFrame, most: int, shard_slots: int, seed: int) -> DataFrame:
    """source place, block number, shard and pass of every slot."""
    size = F.greatest(F.lit(shard_slots), F.ceil(F.col("slots") / MOST_SHARDS)).cast("long")
    shards = plan.where("slots > 0 and blocks > 0").withColumns({"__size": size})
    shards = shards.withColumns({"shard": F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / F.col("__size"))))})
    shards = shards.withColumns({"shard_slots": F.least(F.col("__size"), F.col("slots") - F.col("shard") * F.col("__size"))})
    shards = shards.withColumns({"n": (_drawn(F.col("high"), seed) - _drawn(F.col("low"), seed)).cast("long")})
    # One row per shard: at most MOST_SHARDS rows of a source meet.
    earlier = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumns({"first": F.coalesce(F.sum("n").over(earlier), F.lit(0))}).where("n > 0")
    slots = shards.select(
        "place", "blocks", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot")
    )
    slots = slots.withColumns({"pass": F.floor(F.col("slot") / F.col("blocks"))}).where(F.col("pass") < most)
    draw = F.xxhash64(F.lit(seed), F.col("place"), F.col("pass"))
    step = F.element_at(F.array(*map(F.lit, STEPS)), F.pmod(draw, F.lit(len(STEPS))).cast("int") + 1)
    wide = "decimal(38,0)"
    turned = F.pmod(step, F.col("blocks")).cast("decimal(19,0)") * F.pmod(F.col("slot"), F.col("blocks")).cast("decimal(19,0)")
    block = F.pmod(turned.cast(wide) + F.pmod(draw, F.col("blocks")).cast(wide), F.col("blocks").cast(wide)).cast("long")
    return slots.select("place", block.alias("block"), "shard", "slot", "pass")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS, seed: int = 0, keys: tuple[str, ...] = (),
) -> Mixture:
    """Mix `docs` (doc_id, text, source and whatever else) towards weights that repeat over the sources in order.

    A null text has no words; a null source is a source of its own, last in order. Rows count one by one, also
    with equal or null doc_id; equal rows may swap their words taken. Other columns play no part, whatever their
    names; `keys` names further columns to carry along. Without words anywhere every target is zero. Short tables
    lie within a block or two of their targets. Draws are stratified within a shard: the counts have the expectation
    of multinomial ones and stay within two of it.
    """
    size = F.size(words(F.col("text"))).cast("long")
    rows = staged(docs.select("doc_id", "source", *keys, size.alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = staged(_plan(sizes, weights, most, block))
    slots = _slots(plan, most, shard_slots, seed)

    about = plan.select(F.col("source").alias("__source"), "place", "source_size", "target", "n")
    placed = rows.join(about, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    placed = placed.withColumns({"bucket": F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.ceil(F.col("n") / BUCKET_ROWS).cast("long"))})
    totals = placed.groupBy("place", "bucket").agg(F.sum("size").alias("__words"))
    earlier = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("place", "bucket", F.coalesce(F.sum("__words").over(earlier), F.lit(0)).alias("__start"))
    within = Window.partitionBy("place", "bucket").orderBy("doc_id", "size", *keys)
    placed = placed.join(totals, ["place", "bucket"]).withColumns(
        {
            "row": F.row_number().over(within),
            "start": F.col("__start")
            + F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    end = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / block), F.floor((end - 1) / block)
    touched = F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(first))
    parts = placed.withColumns({"block": F.explode(touched)})
    overlap = F.least(end, (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    # Spark takes the slots for as small as the plan they come from, so the join is told not to broadcast them.
    uses = slots.groupBy("place", "block").agg(F.count(F.lit(1)).alias("uses")).hint("merge")
    identity = ("place", "bucket", "row", "doc_id", "source", *keys, "size", "source_size", "target")
    taken = F.sum(F.greatest(overlap, F.lit(0)) * F.coalesce("uses", F.lit(0))).alias("taken")
    rows = parts.join(uses, ["place", "block"], "left").groupBy(*identity).agg(taken)
    return Mixture(plan, slots, rows.select("doc_id", "source", *keys, "size", "source_size", "target", "taken"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Rows of `docs` as often as the mix takes their words, with the columns they came with.

    A document of which the mix takes 1.4 times the words comes once or, with a probability of 0.4 decided by
    hash, twice. Equal rows are told apart by their number only, so they share what the mix takes of them all.
    """
    digest = F.xxhash64("text")
    mixture = mix(docs.select("doc_id", "text", "source", digest.alias("__digest")), seed=seed, keys=("__digest",))
    ids = ("__id", "__source", "__digest")
    shares = mixture.rows.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), "__digest").agg(
        (F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("__share")
    )
    times = F.floor(F.col("__share") + _uniform(F.lit(seed + 1), F.col("__id"), F.col("__source"), F.col("__digest"))).cast("int")
    shares = shares.select(*ids, times.alias("__times")).where("__times > 0")
    match = (
        F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__text") == F.col("__digest"))
    )
    # The columns travel as one, so none of their names can clash.
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "source", digest.alias("__text"))
    out = rows.join(shares, match).withColumns({"__copy": F.explode(F.sequence(F.lit(1), F.col("__times")))})
    return out.select("__row.*")


def report(docs: DataFrame) -> DataFrame:
    return mix(docs).rows.select("doc_id", "size", "source_size", "target", "taken")
