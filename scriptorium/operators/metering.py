"""Token costs of sessions: to which article each turn belongs, shares, prices."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

BUCKETS = ("inp", "out", "cache_write", "cache_read")


#: Bytes of a session's text that one task searches at a time.
SHARE_BYTES = 32 << 20


def attribute(turns: DataFrame, keys: DataFrame, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """``turns`` (session, turn, blob, ...) with n_owners and owner: the article of
    the session one of whose keys (session, article, key) the turn's text holds,
    if it is the only one.

    All keys of a session are sought at once, by one automaton over the text, so
    the work is that of reading it.  A long session is dealt out in shares of about
    ``share_bytes``, each with the session's keys.
    """
    k = keys.where("key is not null and key <> ''").select("session", "article", F.lower("key").alias("key")).distinct()
    size = F.coalesce(F.octet_length("blob"), F.lit(0)) + 64
    shares = turns.groupBy("session").agg((F.floor(F.sum(size) / share_bytes) + 1).cast("int").alias("_shares"))
    t = turns.join(shares.withColumnRenamed("session", "_s"), F.col("session").eqNullSafe(F.col("_s")), "left").drop("_s")
    t = t.withColumn("_share", F.pmod(F.xxhash64("turn"), F.col("_shares")).cast("int")).drop("_shares")
    k = k.join(shares, "session").select(F.col("session").alias("_session"), "article", "key", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_of"))
    article = keys.schema["article"].dataType
    schema = StructType(list(turns.schema.fields)).add("n_owners", "long").add("owner", article)

    def search(part: pa.Table, sought: pa.Table) -> pa.Table:
        import ahocorasick

        part = part.drop_columns(["_share"])
        owners: dict[str, set] = {}
        for article, key in zip(sought["article"].to_pylist(), sought["key"].to_pylist()):
            owners.setdefault(key, set()).add(article)
        counts, mine = [0] * part.num_rows, [None] * part.num_rows
        if owners:
            machine = ahocorasick.Automaton()
            for key, of in owners.items():
                machine.add_word(key, of)
            machine.make_automaton()
            for i, blob in enumerate(part["blob"]):
                found = set().union(*(of for _, of in machine.iter(blob.as_py() or ""))) - {None}
                counts[i] = len(found)
                if len(found) == 1:
                    mine[i] = found.pop()
        kind = sought.schema.field("article").type
        return part.append_column("n_owners", pa.array(counts, pa.int64())).append_column("owner", pa.array(mine, kind))

    # Arrow keeps whole numbers whole where a pandas frame with nulls would not
    return t.groupBy("session", "_share").cogroup(k.groupBy("_session", "_of")).applyInArrow(search, schema)


def direct_and_shared(attributed: DataFrame, articles: DataFrame) -> DataFrame:
    """Per session and article: its own work buckets, and the session's overhead:
    work of turns with no single owner, and all that was read from the cache."""
    own = F.col("owner").isNotNull()
    direct = attributed.where(own).groupBy("session", F.col("owner").alias("article")).agg(*[F.sum(b).alias(f"direct_{b}") for b in BUCKETS[:3]], F.count(F.lit(1)).alias("n_matched"))
    shared = attributed.groupBy("session").agg(*[F.sum(F.when(~own, F.col(b)).otherwise(0)).alias(f"overhead_{b}") for b in BUCKETS[:3]], F.sum("cache_read").alias("overhead_cache_read"), F.count_if(~own).alias("n_unmatched"))
    out = articles.select("session", "article").distinct().join(shared, "session", "left").join(direct, ["session", "article"], "left")
    return out.fillna(0, [c for c in out.columns if c not in ("session", "article")])


def allocate(totals: DataFrame, by_direct: bool = False) -> DataFrame:
    """Overhead dealt to a session's articles, equally or by their own work; each
    bucket is rounded half to even."""
    one = W.partitionBy("session")
    work = sum((F.col(f"direct_{b}") for b in BUCKETS[1:3]), F.col("direct_inp"))
    factor = work / F.greatest(F.sum(work).over(one), F.lit(1)) if by_direct else 1.0 / F.count(F.lit(1)).over(one)
    out = totals.withColumn("_factor", factor)
    return out.withColumns({f"share_{b}": F.bround(F.col(f"overhead_{b}") * F.col("_factor"), 0).cast("long") for b in BUCKETS}).drop("_factor")


def priced(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """With ``cost`` per million tokens of each bucket; a model without a price
    has that of ``default``, and without that none: its cost is null.  ``prices``:
    model and a column per bucket; of rows that repeat a model the least price."""
    default = prices.where("model = 'default'").agg(*[F.min(b).alias(f"d_{b}") for b in BUCKETS])
    out = rows.join(prices.groupBy("model").agg(*[F.min(b).alias(f"p_{b}") for b in BUCKETS]), "model", "left").crossJoin(F.broadcast(default))  # one row
    amount: Column = F.lit(0.0)
    for b in BUCKETS:
        amount = amount + (F.col(f"share_{b}") + (F.col(f"direct_{b}") if b != "cache_read" else 0)) * F.coalesce(f"p_{b}", f"d_{b}")
    return out.withColumn("cost", amount / 1e6).drop(*[f"{x}_{b}" for x in "pd" for b in BUCKETS])


def latest_by_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: an upsert's result."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def cost_by_model(costs: DataFrame) -> DataFrame:
    return costs.groupBy("model").agg(F.count(F.lit(1)).alias("runs"), F.sum("cost").alias("cost"))


def cost_rollup(costs: DataFrame) -> DataFrame:
    """Runs and cost by model and article, by model, and over all: ``level`` 0, 1 and 3
    tells them apart, since a model may be null itself."""
    return costs.rollup("model", "article").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("runs"), F.sum("cost").alias("cost"))


def history(rows: DataFrame) -> DataFrame:
    """Stored costs (n_articles, overhead_total, direct_tokens, computed_at, pmid, ...)
    with the share of the overhead, derived on reading and rounded once, half to
    even, the total, and the place by age, newest first, of each article."""
    share = F.bround(F.coalesce("overhead_total", F.lit(0)) / F.greatest(F.coalesce("n_articles", F.lit(1)), F.lit(1)), 0).cast("long")
    place = F.row_number().over(W.partitionBy("pmid").orderBy(F.desc("computed_at"), "session"))
    return rows.withColumn("overhead_share", share).withColumn("total_tokens", F.coalesce("direct_tokens", F.lit(0)) + F.col("overhead_share")).withColumn("place", place)
