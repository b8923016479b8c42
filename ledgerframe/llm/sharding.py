"""Shards by balanced label propagation: linked documents move together, counts stay even."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerframe.llm.dedup import digest
from ledgerframe.operators.scale import join_groups, numbered
from ledgerframe.session import forget, materialise

#: Parts of the hubs that enter a shard one after the other.
STRATA = 64


def propagate(members: DataFrame, nodes: DataFrame, shards: int, rows: int, rounds: int | None = None) -> DataFrame:
    """Move linked nodes towards their neighbours' shards, as far as shards have room for them.

    `members` (node, hub) links the nodes of a hub with each other; a hub stands for all its pairs. `nodes`
    (node, shard) are those that have a link. `rows` counts all rows to shard, linked or not: linked nodes may
    fill a shard up to its even share, since unlinked rows give way later. In each round a node wants the shard in
    which its hubs have most members; ties go by a hash, the same for all of a hub. A hub whose rest does not fit
    into that shard's room asks for the next ones as well, for as many as its rest fills. Those who want a shard enter
    it up to its room, surest first and hub by hub, so that the room's end parts few hubs; others ask again in the next round. It ends when no wish is left (where nodes
    have one hub, every move makes the cut smaller), or after `rounds`, the number of shards and eight if not given.
    Returns (node, shard).
    """
    room_each = rows // shards
    now = nodes
    by_votes = W.partitionBy("hub").orderBy(F.desc("n"), F.desc("tie"))
    before, beyond, hub = by_votes.rowsBetween(W.unboundedPreceding, -1), by_votes.rowsBetween(1, W.unboundedFollowing), W.partitionBy("hub")
    for k in range(shards + 8 if rounds is None else rounds):
        held = members.join(now, "node")
        room = F.broadcast(now.groupBy("shard").agg((F.lit(room_each) - F.count("*")).alias("room")))  # one row a shard at most
        tally = held.groupBy("hub", "shard").agg(F.count("*").alias("n")).withColumn("tie", F.xxhash64("hub", "shard")).join(room, "shard")
        free = F.greatest("room", F.lit(0))
        tally = tally.withColumn("rank", F.row_number().over(by_votes)).withColumn("lead", F.coalesce(F.sum(free).over(before), F.lit(0))).withColumn("after", F.coalesce(F.sum("n").over(beyond), F.lit(0)))
        target = (F.col("room") > 0) & (F.col("lead") < F.col("after"))
        tally = tally.withColumn("last", F.max(F.when(target, F.col("rank"))).over(hub)).withColumn("targets", F.count(F.when(target, 1)).over(hub)).withColumn("rest", F.min(F.when(target, F.col("after"))).over(hub))
        begin, end = F.when(target, F.col("lead") / F.col("rest")), F.when(target, F.when(F.col("rank") == F.col("last"), 2.0).otherwise((F.col("lead") + free) / F.col("rest")))
        vote = F.struct("n", "tie", "shard", (F.col("room") > 0).alias("open"), (F.col("rank") <= F.col("last")).alias("keep"), begin.alias("begin"), end.alias("end"))
        profile = tally.groupBy("hub").agg(F.collect_list(vote).alias("votes"), F.sum("n").alias("hub_size"), (F.max("targets") > 1).alias("spread"))  # one entry a shard at most
        at = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 30)) / (1 << 30)
        kept = F.exists("votes", lambda v: (v["shard"] == F.col("shard")) & v["keep"])
        asks = join_groups(held, profile, "hub", "hub_size").select("node", "shard", "spread", at.alias("at"), kept.alias("kept"), F.explode("votes").alias("v"))
        own = F.col("v.shard") == F.col("shard")
        may = own | (F.col("v.open") & (~F.col("spread") | (~F.coalesce("kept", F.lit(False)) & F.coalesce((F.col("at") >= F.col("v.begin")) & (F.col("at") < F.col("v.end")), F.lit(False)))))
        here = asks.withColumn("may", may).groupBy("node", "shard", F.col("v.shard").alias("to")).agg(F.sum("v.n").alias("n"), F.max("v.tie").alias("tie"), F.min("may").alias("may")).filter("may")
        best = here.groupBy("node", "shard").agg(F.max(F.struct("n", "tie", "to")).alias("best"), F.max(F.when(F.col("to") == F.col("shard"), F.col("n"))).alias("stay"))
        wish = materialise(best.filter("best.to <> shard").select("node", F.col("best.to").alias("to"), F.pmod("best.tie", F.lit(STRATA)).alias("stratum"), (F.col("best.n") - F.coalesce("stay", F.lit(0))).alias("gain")), "shard-wishes")
        asked = wish.count()
        if not asked:
            break
        sure = 30 - F.least(F.lit(30), F.floor(F.log2(F.col("gain") + 1)))
        ranked = numbered(wish, ["to"], [F.col("node")], [F.col("node")], "place", asked, first=sure * STRATA + F.col("stratum"))
        moved = ranked.join(room.withColumnRenamed("shard", "to"), "to").filter("place < room").select("node", F.col("to").alias("moved"))
        after = materialise(now.join(moved, "node", "left").select("node", F.coalesce("moved", "shard").alias("shard")), "shard-state")
        forget(wish)
        if now is not nodes:
            forget(now)
        now = after
    return now


def level(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """Bring every shard to its even share: of (row, shard, loose), loose rows leave full shards first.

    The first (total mod shards) shards hold one row more than the others. Rows beyond a shard's share are
    numbered in one row of all, in which each shard with room takes a stretch.
    """
    share, extra = divmod(total, shards)
    quota = F.when(F.col("shard") < extra, share + 1).otherwise(share)
    ranked = materialise(numbered(rows, ["shard"], [F.col("row")], [F.col("row")], "place", total, first=F.col("loose").cast("int")), "shard-places")
    over = ranked.filter(F.col("place") >= quota)
    kept = dict(ranked.groupBy("shard").count().collect())  # one row a shard
    stay = ranked.filter(F.col("place") < quota).select("row", "shard")
    stretches, at = [], 0
    for shard in range(shards):
        lack = share + (shard < extra) - kept.get(shard, 0)
        if lack > 0:
            stretches.append((at, at + lack, shard))
            at += lack
    if not at:
        return stay
    queue = numbered(over.withColumn("one", F.lit(0)), ["one"], [F.col("row")], [F.col("row")], "queue", at)
    to = F.coalesce(*[F.when((F.col("queue") >= a) & (F.col("queue") < b), F.lit(s)) for a, b, s in stretches])
    return stay.unionByName(queue.select("row", to.alias("shard")))


def shard(docs: DataFrame, shards: int = 24, rounds: int | None = None) -> DataFrame:
    """Put each row of `docs` (doc_id, text) into one of `shards`, equal texts together, counts at most one apart.

    One row per input row: doc_id, size, text_crc32, law ('rows'), shard, slot (0, 1 ... in its shard), grown_shard
    (null under this law). Rows start at a hash; label propagation brings equal texts together. A group larger than
    a shard's share fills as many shards as it needs. Null text counts as empty in a group and in the checksum, and has
    size 8; repeated ids are rows of their own; other columns don't matter; no rows give no rows; fewer rows than shards
    leave some shards empty.
    """
    text = F.coalesce("text", F.lit(""))
    base = materialise(
        docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), digest(F.col("text")).alias("hub")).withColumn("row", F.monotonically_increasing_id()), "shard-base"
    )
    groups = base.groupBy("hub").agg(F.count("*").alias("n"))
    total, linked = base.count(), groups.filter("n > 1")
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    members = materialise(join_groups(base.select("row", "hub"), linked, "hub", "n").select(F.col("row").alias("node"), "hub"), "shard-links")
    nodes = members.select("node", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"))
    placed = propagate(members, nodes, shards, total, rounds)
    state = base.select("row", start.alias("start")).join(placed.withColumnRenamed("node", "row"), "row", "left")
    state = state.select("row", F.coalesce("shard", "start").alias("shard"), F.col("shard").isNull().alias("loose"))
    final = materialise(level(state, shards, total), "shard-final")
    slots = numbered(final, ["shard"], [F.col("row")], [F.col("row")], "slot", total)
    return base.join(slots, "row").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_links(sharded: DataFrame, members: DataFrame) -> int:
    """Pairs of a hub's members in different shards, counted from the hubs' tallies: (row, shard) and (row, hub)."""
    tally = members.join(sharded, "row").groupBy("hub", "shard").agg(F.count("*").alias("n"))
    pairs = tally.groupBy("hub").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("cut"))
    return int(pairs.agg(F.sum("cut")).first()[0] or 0)
