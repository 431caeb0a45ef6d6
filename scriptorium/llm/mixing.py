"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source's target is a share of the whole, capped at a multiple of its size.
Whole repeats of a source are taken outright; what its target has beyond them
is measured in blocks of equally many words.  All blocks of the mix are seats:
sources receive them by highest quotients target / (2 * seats + 1).  The words of
a source's blocks are then dealt to its shards in the same way, which gives an
integer quota per shard, and within a shard documents stand in a seeded order, of
which the quota is taken from the front.

Where units are many they are apportioned in two steps, groups of TOGETHER units
first, so no task holds all sources of a mix or all shards of a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scriptorium.llm.common import Scratch, partitions

#: Documents a shard holds on average, units that are apportioned together, the
#: number of blocks a small mix is cut into at most, the most words of a block,
#: and how often a document may be repeated.
SHARD_DOCS, TOGETHER, MAX_BLOCKS, BLOCK, REPEATS = 2_000, 1_000, 1_000_000, 64, 3


def words(text: Column) -> Column:
    """The number of words, [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: Sequence[Column], out: str, scratch: Scratch) -> DataFrame:
    """``df`` with ``out``: each row's number from 0 in a total order, in two
    levels: ranges of the order, then rows within their range."""
    spark = df.sparkSession
    ranged = scratch.put(df.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id()), "ranged")
    rows = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a row per shuffle partition: a proven bound
    ahead = F.broadcast(rows.select("_range", before.alias("_ahead")))
    number = F.col("_ahead") + F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(ahead, "_range").withColumn(out, number).drop("_range", "_ahead")


def capped_targets(sources: DataFrame, weights: Sequence[float], scratch: Scratch, repeats: int = REPEATS) -> DataFrame:
    """``sources`` (source, source_size, one row each) with ``number`` and ``target``.

    Weights repeat over the sources in code-point order, null last.  With s the
    total size, the targets are min(level * weight, repeats * size) at the level
    at which they add up to s.  It is found from below: sources above their cap at
    one level leave a higher level to the others, until no further one is.
    """
    listed = F.array(*[F.lit(float(w)) for w in weights])
    w = numbered(sources, [F.col("source").isNull(), F.encode("source", "utf-8")], "number", scratch)
    w = w.withColumn("weight", F.element_at(listed, (F.col("number") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * repeats)
    w = scratch.put(w, "sources")
    total, free = w.agg(F.sum("source_size"), F.sum("weight")).first()
    level, before = (total / free if total else 0.0), 0
    while total:
        over = F.col("cap") < level * F.col("weight")
        n, capped, free = w.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == before or not free:
            break
        level, before = (total - capped) / free, n
    return w.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight"))).drop("weight", "cap")


def sainte_lague(units: DataFrame, group: Sequence[str], unit: Sequence[str], weight: str, seats: str, out: str) -> DataFrame:
    """``units`` with ``out``, the unit's share of its group's ``seats`` by highest
    quotients weight / (2k + 1), ties to the lower unit.

    With n units and T the group's weight, every unit surely has the seats whose
    quotient is above T / (2 seats - n), which is a rounding; at most a few per
    unit remain in doubt, so ranking their quotients takes a number of rows in
    proportion to the units, however many seats there are.
    """
    all_, rest = W.partitionBy(*group), F.col("_left")
    u = units.withColumns({"_n": F.count(F.lit(1)).over(all_), "_t": F.sum(weight).over(all_)})
    sure = F.floor(F.col(weight) / F.col("_t") * (F.col(seats) - F.col("_n") / 2) + 0.5 - 1e-9)
    u = u.withColumn("_sure", F.when((F.col("_t") > 0) & (F.col(seats) > F.col("_n") / 2), F.greatest(sure, F.lit(0))).otherwise(F.lit(0)).cast("long"))
    u = u.withColumn("_left", F.col(seats) - F.sum("_sure").over(all_))
    more = F.ceil(F.coalesce(F.try_divide(F.col(weight), F.col("_t")), F.lit(0.0)) * (rest + F.col("_n"))) + 2
    seat = u.where((F.col(weight) > 0) & (rest > 0)).withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_sure") + more)))
    rank = F.row_number().over(all_.orderBy(F.desc(F.col(weight) / (2 * F.col("_k") + 1)), *unit, "_k"))
    extra = seat.withColumn("_rank", rank).where(F.col("_rank") <= rest).groupBy(*group, *unit).agg(F.count(F.lit(1)).alias("_extra"))
    keys = list(dict.fromkeys([*group, *unit]))
    same = [F.col(f"u.{k}").eqNullSafe(F.col(f"x.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return u.alias("u").join(extra.alias("x"), on, "left").select(*[f"u.{c}" for c in units.columns], (F.col("u._sure") + F.coalesce("x._extra", F.lit(0))).alias(out))


def in_groups(units: DataFrame, group: Sequence[str], part: str, unit: str, weight: str, seats: str, out: str, scratch: Scratch) -> DataFrame:
    """``units`` with ``out``: seats of each ``group`` dealt to its parts by their
    weights, then those of a part to its units."""
    parts = units.groupBy(*group, part).agg(F.sum(weight).alias("_weight"), F.first(seats).alias("_seats"))
    parts = scratch.put(sainte_lague(parts, group, [part], "_weight", "_seats", "_part_seats"), "parts")
    keys = [*group, part]
    on = F.col(f"u.{keys[0]}").eqNullSafe(F.col(f"p.{keys[0]}"))
    for k in keys[1:]:
        on = on & F.col(f"u.{k}").eqNullSafe(F.col(f"p.{k}"))
    joined = units.alias("u").join(parts.alias("p"), on).select("u.*", "p._part_seats")
    return sainte_lague(joined, keys, [unit], weight, "_part_seats", out).drop("_part_seats")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), repeats: int = REPEATS, seed: int = 17, share: float = 1.0, block: int | None = None) -> DataFrame:
    """Per row: doc_id, size, source_size, target (its source's), taken (words the
    mix takes of it, repeats counted), source.

    A null text has size 0; a null source is a source of its own, the last; rows
    that are equal are told apart by nothing and may be taken alike; a text of any
    length is counted whole, and may be taken in part; an empty table gives an
    empty mix; other columns are ignored.  No document is taken more than
    ``repeats`` times.  ``block``: words of a block, by default a millionth of the
    mix, 64 at most.
    """
    with Scratch(docs.sparkSession) as scratch:
        sized = scratch.put(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes", keep=True)
        sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        plan = capped_targets(sources, weights, scratch, repeats).withColumn("target", F.col("target") * share)
        plan = plan.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / SHARD_DOCS)).cast("long"))
        ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
        # a hair below a whole number of repeats counts as that number
        plan = plan.withColumn("whole", F.floor(ratio + 1e-9)).withColumn("part", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
        target, part = plan.agg(F.sum("target"), F.sum("part")).first()
        block = block or max(1, min(BLOCK, int((target or 0) // MAX_BLOCKS)))
        plan = plan.withColumns({"mix": F.lit(0), "seats": F.lit(round((part or 0) / block)).cast("long"), "group": F.floor(F.col("number") / TOGETHER)})
        plan = in_groups(plan, ["mix"], "group", "source", "part", "seats", "source_seats", scratch)
        plan = scratch.put(plan.withColumn("source_words", F.col("source_seats") * block).drop("mix", "seats", "group", "number"), "mix-plan", keep=True)

        # the plan has a row per source; Spark broadcasts it by its size or else shuffles, splitting hot sources
        at = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "p.source_size", "p.target", "p.whole", "p.source_words", "p.n_shards")
        draw = F.xxhash64(F.col("doc_id"), F.lit(seed))
        at = at.withColumns({"draw": draw, "shard": F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("n_shards"))})
        shards = at.groupBy("source", "shard").agg(F.sum("size").cast("double").alias("shard_size"), F.first("source_words").alias("source_words"))
        shards = scratch.put(shards.withColumn("group", F.floor(F.col("shard") / TOGETHER)), "shards")
        quota = in_groups(shards, ["source"], "group", "shard", "shard_size", "source_words", "quota", scratch).select("source", "shard", "quota")
        quota = scratch.put(quota, "quotas", keep=True)
    at = at.alias("d").join(quota.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard"))).select("d.*", "q.quota")
    ahead = W.partitionBy("source", "shard").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    drawn = F.col("quota") - F.coalesce(F.sum("size").over(ahead), F.lit(0))
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), drawn))
    return at.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")
