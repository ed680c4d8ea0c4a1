"""Sharding by balanced label propagation.

Rows with equal texts are linked. Each row starts in a shard by hash; in each round
a join tells every linked row which open shard holds most of its links, and rows in
shards that hold fewer move there as far as that shard's quota lasts: a destination
takes linked rows up to its share of all rows, and where more want in, the hash of
row and round says who goes. Shards that are nearly full are closed and keep what
they have, so a group larger than a shard fills one after the other. Counts for each
group and shard are pre-aggregated; only a table of a row per pair of shards reaches
the driver. Then rows of full shards trade places: as many go from one shard to another
as come back, or as it has room for.

Last, the law "rows" is made exact: rows get their slot from counts of (shard,
linked or not, bucket), the rows beyond a shard's share (the unlinked come last, so
they go first) fill the shards that have room.

Laws: "rows" gives counts at most one apart, at any parameters. These say only where
linked rows go: below `least_room` of its share a shard is closed to them, and groups of
at most `small` of a share (`few` rows) come together in an open shard even where a
closed one has more of them; such a group is split less often, a larger one moves less.

Defined results: a null text is an empty one (size 1); a null doc_id is a value of its
own; equal rows are interchangeable and placed each by itself; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm._spark import cut, partitions

SHARDS, ROUNDS = 8, 12
#: A shard with less than this part of its share left is closed; quotas are kept on average, so the last places wait for the end.
LEAST_ROOM = 0.05
#: Groups of at most this part of a share come together in an open shard even if a closed one has more of them.
SMALL, FEW = 0.005, 8
UNIT = 1_000_000
#: A large group's rows are ranked in so many pieces at least.
SALTS = 64


def _chance(*columns) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(UNIT))


def propagate(linked: DataFrame, shares: dict[int, int], rounds: int = ROUNDS, least_room: float = LEAST_ROOM, small_part: float = SMALL, few: int = FEW) -> DataFrame:
    """linked: key, group, shard. Rows moved towards the shard with most of their group, under quotas."""
    shards = sorted(shares)
    linked = cut(linked)
    held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    for number in range(rounds):
        open_shards = [s for s in shards if shares[s] - held.get(s, 0) > least_room * shares[s]]
        if not open_shards:
            break
        parts = cut(linked.groupBy("group", "shard").agg(F.count("*").alias("n")))
        # a group's best open shard has most of its rows, ties by hash; rows leave the shards that have fewer, and small groups come together there
        tie = F.xxhash64("group", "shard")
        rank = F.struct(F.when(F.col("shard").isin(open_shards), F.col("n")).otherwise(-1), tie)
        best = F.max_by(F.struct("shard", "n", tie.alias("tie")), rank)
        wish = cut(parts.groupBy("group").agg(best.alias("top"), F.sum("n").alias("total")).filter(F.col("top.shard").isin(open_shards)).select("group", F.col("top.shard").alias("best"), F.col("top.n").alias("most"), F.col("top.tie").alias("tie"), "total"))
        fewer = (F.col("n") < F.col("most")) | (F.col("n") == F.col("most")) & (tie < F.col("tie"))
        small = F.col("total") <= max(few, small_part * min(shares.values()))
        wants = parts.join(wish, "group").filter((F.col("shard") != F.col("best")) & (fewer | small))
        flows = {r["best"]: r["n"] for r in wants.groupBy("best").agg(F.sum("n").alias("n")).collect()}
        if not flows:
            break
        ratio = {s: min(UNIT, UNIT * max(0, shares[s] - held.get(s, 0)) // n) for s, n in flows.items()}
        rate = F.coalesce(*[F.when(F.col("best") == s, F.lit(r)) for s, r in ratio.items()], F.lit(0))
        go = wants.select("group", "shard", "best", rate.alias("rate"))
        moved = F.when(F.col("best").isNotNull() & (_chance("key", F.lit(number)) < F.col("rate")), F.col("best")).otherwise(F.col("shard"))
        linked = cut(linked.join(cut(go), ["group", "shard"], "left").select("key", "group", moved.alias("shard")))
        held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return _swap(linked, shares, rounds)


def _swap(linked: DataFrame, shares: dict[int, int], rounds: int) -> DataFrame:
    """Rows of full shards trade places: what goes from one shard to another is matched by what comes back, or by free places."""
    for number in range(rounds):
        parts = cut(linked.groupBy("group", "shard").agg(F.count("*").alias("n")))
        held = {r["shard"]: r["n"] for r in parts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        # a tie is cast anew each time, so that flows of one direction only find a match
        rank = F.struct("n", F.xxhash64("group", "shard", F.lit(number)))
        top = parts.groupBy("group").agg(F.max_by("shard", rank).alias("best"), F.count("*").alias("k")).filter("k > 1").select("group", "best")
        wants = cut(parts.join(top, "group").filter(F.col("shard") != F.col("best")))
        flows = {(r["shard"], r["best"]): r["n"] for r in wants.groupBy("shard", "best").agg(F.sum("n").alias("n")).collect()}
        if not flows:
            break
        matched = {(a, b): min(n, flows.get((b, a), 0)) for (a, b), n in flows.items()}
        left = {b: sum(n - matched[k] for k, n in flows.items() if k[1] == b) for b in shares}
        room = {b: max(0, shares[b] - held.get(b, 0)) for b in shares}
        rates = [(a, b, UNIT * (matched[a, b] * left[b] + (n - matched[a, b]) * min(room[b], left[b])) // (n * left[b]) if left[b] else UNIT) for (a, b), n in flows.items()]
        if not any(r[2] for r in rates):
            break
        table = linked.sparkSession.createDataFrame(rates, "shard int, best int, rate long")
        go = cut(wants.join(F.broadcast(table), ["shard", "best"]).select("group", "shard", "best", "rate"))
        moved = F.when(F.col("best").isNotNull() & (_chance("key", F.lit(-1 - number)) < F.col("rate")), F.col("best")).otherwise(F.col("shard"))
        linked = cut(linked.join(go, ["group", "shard"], "left").select("key", "group", moved.alias("shard")))
    return linked


def shard_rows(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, least_room: float = LEAST_ROOM, small: float = SMALL, few: int = FEW) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard; law "rows"."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group")).withColumn("key", F.xxhash64("doc_id", "group")).withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    equal = cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit(True).alias("equal")))
    if not equal.isEmpty():  # equal rows get keys of their own, by their place in the checkpoint
        rows = cut(rows.join(equal, "key", "left").withColumn("key", F.when(F.col("equal"), F.xxhash64("key", "row")).otherwise(F.col("key"))).drop("equal"))
    rows = rows.drop("row")
    shares = {s: total // shards + (s < total % shards) for s in range(shards)}
    twice = cut(rows.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").select("group", F.lit(True).alias("twice")))
    told = rows.join(twice, "group", "left")
    start = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(shards)).cast("int")
    linked = propagate(told.filter("twice").select("key", "group", start.alias("shard")), shares, rounds, least_room, small, few)
    where = cut(linked.dropDuplicates(["key"]).select("key", F.col("shard").alias("moved")))
    n_buckets = max(16, 4 * partitions(spark))
    placed = told.join(where, "key", "left").select(
        "doc_id", "size", "text_crc32", F.coalesce("moved", start).alias("home"), F.when(F.col("twice"), 0).otherwise(1).alias("loose"),
        F.pmod(F.xxhash64("key", F.lit(5)), F.lit(n_buckets)).cast("int").alias("bucket"), "key", "group",
    )
    # linked rows of a group share a bucket range by group, so that a shard's excess splits few groups
    placed = cut(placed.withColumn("bucket", F.when((F.col("loose") == 0), F.pmod(F.xxhash64("group", F.lit(5)), F.lit(n_buckets)).cast("int")).otherwise(F.col("bucket"))).withColumn("salt", F.when(F.col("loose") == 0, F.pmod(F.col("key"), F.lit(max(SALTS, n_buckets))).cast("int")).otherwise(0)))
    cells = placed.groupBy("home", "loose", "bucket", "salt").agg(F.count("*").alias("n"))
    # one row per shard, kind, bucket and salt: a number that follows the tasks, not the rows
    before = Window.partitionBy("home").orderBy("loose", "bucket", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("home", "loose", "bucket", "salt", "before"))
    counts = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect()}
    rank = F.row_number().over(Window.partitionBy("home", "loose", "bucket", "salt").orderBy("key", "doc_id"))
    ranked = placed.withColumn("rank", rank).join(offsets, ["home", "loose", "bucket", "salt"]).withColumn("slot", F.col("before") + F.col("rank") - 1)
    # the e-th row beyond the shares goes to the shard whose room holds the e-th place
    share, excess, room, at, place = F.lit(0).cast("long"), F.lit(0).cast("long"), [], 0, 0
    for s in range(shards):
        here = F.col("home") == s
        share = F.when(here, F.lit(shares[s])).otherwise(share)
        excess = F.when(here, F.lit(at)).otherwise(excess)
        at += max(0, counts.get(s, 0) - shares[s])
        if (free := shares[s] - counts.get(s, 0)) > 0:
            room.append((s, place, place + free, counts.get(s, 0)))
            place += free
    e = excess + F.col("slot") - share
    over = F.col("slot") >= share
    new_shard, new_slot = F.col("home"), F.col("slot")
    for s, lo, hi, first in room:
        inside = over & (e >= lo) & (e < hi)
        new_shard, new_slot = F.when(inside, F.lit(s)).otherwise(new_shard), F.when(inside, e - lo + first).otherwise(new_slot)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), new_shard.cast("int").alias("shard"), new_slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
