"""Balanced label propagation: linked documents move to the shard where most of their neighbours are, under quotas.

Documents with equal texts are linked. Members of such a group are alike, so the state is how many of
each group are in each shard, at most one row for a group and shard, however hot the group. Each
round, every group proposes to move its members to the shard with most of them that has room, and
quotas accept as many as fit. Then all groups stand in one line by their shard, each whole, and the
line is cut into equal parts. Law `rows`: the shards' counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 40
ROUNDS = 6
#: Rows that one task ranks; larger groups are ranked in buckets with offsets.
BUCKET_ROWS = 1_000_000


def ranked(df: DataFrame, part: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """df with a rank from 0 within part, gapless, in no particular but a fixed order.

    Rows fall into hash buckets by the order columns; a task sorts one bucket of one part, and the
    buckets' counts, few rows for each part, give the offsets.
    """
    n = max(1, -(-rows // BUCKET_ROWS))
    df = df.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    own = Window.partitionBy(*part, "bucket").orderBy(*order)
    if n == 1:
        return df.withColumn(name, F.row_number().over(own).cast("long") - 1).drop("bucket")
    keys = [*part, "bucket"]
    count = df.groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*part).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    df = df.withColumn(name, F.row_number().over(own).cast("long") - 1).join(count, keys)
    return df.withColumn(name, F.col(name) + F.col("offset")).drop("bucket", "offset")


def _by_rank(rank: Column, sizes: list[int]) -> Column:
    """The shard of a rank when shard 0 takes the first sizes[0] ranks, and so on."""
    upto, ends = 0, []
    for s in sizes:
        upto += s
        ends.append(upto)
    return F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e <= rank))


def propagate(groups: DataFrame, capacity: list[int]) -> DataFrame:
    """groups(g, n): linked documents by group -> (g, label): the shard where most of a group's members end.

    The shards' loads, a number or two each, are all that reaches the driver.
    """
    k = len(capacity)
    start = F.pmod(F.xxhash64("g"), F.lit(k))
    # each group starts evenly spread from a shard that its hash names
    spread = F.transform(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(k)).cast("int") - 1), lambda i: F.struct(F.pmod(start + i, F.lit(k)).cast("int").alias("shard"), (F.floor(F.col("n") / k) + (i < F.col("n") % k).cast("long")).alias("c")))
    state = written(groups.select("g", F.inline(spread)), "labels")
    turn = (-F.pmod(F.col("shard") - F.xxhash64("g"), F.lit(k))).alias("s")
    fullest = lambda fits: F.max_by("shard", F.struct(fits.alias("a"), F.col("c").alias("b"), turn))
    best = 0
    for _ in range(ROUNDS):
        most = state.groupBy("g").agg(fullest(F.lit(True)).alias("to"))
        loads = state.join(most, "g").groupBy("shard").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("shard") != F.col("to"), F.col("c")).otherwise(0)).alias("away"), F.count("*").alias("parts")).collect()
        parts = sum(r.parts for r in loads)
        if not parts or parts == best:
            break
        best = parts
        load, away = {r.shard: r.n for r in loads}, {r.shard: r.away for r in loads}
        # room: what is free and what others' proposals would free
        room = F.array(*(F.lit(c - load.get(s, 0) + away.get(s, 0)).cast("long") for s, c in enumerate(capacity)))
        cap = F.array(*(F.lit(c).cast("long") for c in capacity))
        fits = (F.get(room, F.col("shard")) > 0) & (F.col("c") < F.get(cap, F.col("shard")))
        per = state.groupBy("g").agg(fullest(fits).alias("to"), F.count("*").alias("parts"))
        moves = state.join(per.where("parts > 1"), "g").where(F.col("shard") != F.col("to"))
        moves = moves.where(F.get(room, F.col("to")) > 0).select("g", "shard", "to", "c")
        # each bucket of moves to a shard has its part of the quota; a move may be taken in part
        n = max(1, -(-parts // BUCKET_ROWS))
        moves = moves.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(n)))
        own = Window.partitionBy("to", "bucket").orderBy("g", "shard").rowsBetween(Window.unboundedPreceding, 0)
        quota = F.floor(F.get(room, F.col("to")) / n)
        moves = moves.withColumn("upto", F.sum("c").over(own))
        taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("c"), quota - (F.col("upto") - F.col("c"))))
        moves = moves.withColumn("taken", taken).where("taken > 0")
        change = moves.select("g", "shard", (-F.col("taken")).alias("c")).union(moves.select("g", F.col("to").alias("shard"), F.col("taken").alias("c")))
        state = written(state.union(change).groupBy("g", "shard").agg(F.sum("c").alias("c")).where("c > 0"), "labels")
    return state.groupBy("g").agg(fullest(F.lit(True)).alias("label"))


def placed(nodes: DataFrame) -> DataFrame:
    """nodes(g, n, label) -> (g, start): all groups in one line by label, each whole behind the one before.

    Prefix sums in two levels: tasks sort the groups of a bucket of a label; the buckets' sums, few
    rows, give the offsets.
    """
    n = max(1, -(-nodes.count() // BUCKET_ROWS))
    nodes = nodes.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(n)))
    sums = nodes.groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    line = Window.orderBy("label", "bucket").rowsBetween(Window.unboundedPreceding, -1)  # SHARDS rows for each million groups
    offset = sums.select("label", "bucket", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("offset"))
    own = Window.partitionBy("label", "bucket").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0))).join(offset, ["label", "bucket"])
    return nodes.select("g", (F.col("offset") + F.col("before")).alias("start"), "n")


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row.

    Every row gets a place, repeated rows one each: equal texts, null counting as empty, are a group.
    Counts of shards differ by one at most and slots are gapless from 0. Null ids are as any other.
    Other columns aren't read. An empty table gives an empty result.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("g"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "rows")
    total = rows.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    counts = written(rows.groupBy("g").agg(F.count("*").alias("n")), "groups")
    labels = propagate(counts.where("n > 1"), capacity)
    linked = written(counts.where("n > 1").join(labels, "g").select("g", "n", "label"), "labels")
    load = {r.label: r.n for r in linked.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    room = [max(0, capacity[s] - load.get(s, 0)) for s in range(shards)]
    # texts without an equal fill the room, half of them on either side of a shard's groups
    alone = counts.where("n = 1").select("g", "n", _by_rank(F.pmod(F.xxhash64("g"), F.lit(max(1, sum(room)))), room).alias("label"))
    sides = alone.select("g", "n", (3 * F.col("label") + 2 * F.pmod(F.xxhash64("g", "label"), F.lit(2))).cast("int").alias("label"))
    line = written(placed(linked.select("g", "n", (3 * F.col("label") + 1).cast("int").alias("label")).union(sides)), "line")
    # the line is cut where a shard is full, so at most one group is cut at each shard's end
    known = rows.join(line, "g")
    many = ranked(known.where("n > 1"), ["g"], ["id", "row"], "rank", total).withColumn("at", F.col("start") + F.col("rank"))
    columns = ["id", "size", "text_crc32", "at"]
    all_ = many.select(*columns).union(known.where("n = 1").withColumn("at", F.col("start")).select(*columns))
    begin = F.array(*(F.lit(sum(capacity[:s])).cast("long") for s in range(shards)))
    all_ = all_.withColumn("shard", _by_rank(F.col("at"), capacity))
    return all_.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), (F.col("at") - F.get(begin, F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
