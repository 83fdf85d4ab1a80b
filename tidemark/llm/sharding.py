"""Shards of equal row counts that keep linked documents together, by balanced label propagation.

Documents with equal texts are linked. Groups that are a large part of a shard, of which there can be a few hundred at
most, name their shards first: as many whole shards as they fill, then for each rest the shard with the least room that
takes it. Every other document begins in a shard that a hash of its id names, out of the room that is left. In each round
the members of a group move towards the shard where most of the group is, as far as that shard has room: what asks for
room is added up per shard, and a quota, the room there is over the room asked for, decides which movers go, by a hash
that changes with the round. Rounds end when none moves. Documents without a link fill what the groups leave free.
Members of a group are interchangeable, so the state is a row per group and shard with a count and not a row per
document; a group of any size has at most as many rows as there are shards.

The rounds leave sizes near equal, and a few members apart where no room was left; these follow the rest of their group.
The last step makes counts equal within one: large groups stand where they were placed, the other documents are numbered by
shard, group after group, and the numbers are cut to the room of each shard, so a cut parts one of these groups at most.
Documents without a link stand at the ends of each shard, so that cuts fall on them rather than on a group. Only DataFrame
operations are used.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import draw, whole_text
from tidemark.operators.ordering import ranked
from tidemark.session import materialise

SHARDS = 40
SLACK = 1.02  # a shard may be larger than the mean by this factor while documents move
LARGE = 0.1  # a group with so much of a shard's rows is large: at most ``shards / LARGE`` of them
ROW_BYTES = 16


def place_large(members: list[int], capacity: list[int]) -> list[list[tuple[int, int]]]:
    """For each group, given largest first, its (shard, count): the shards it fills, then the tightest room for the rest."""
    room, places, rests = list(capacity), [[] for _ in members], []
    shard = 0  # whole shards come first, so that no cut of the numbered rows falls into them
    for group, n in enumerate(members):
        while shard < len(room) and n >= room[shard]:
            if room[shard]:
                places[group].append((shard, room[shard]))
            n, room[shard], shard = n - room[shard], 0, shard + 1
        if n:
            rests.append((n, group))
    for n, group in sorted(rests, key=lambda r: (-r[0], r[1])):
        while n:
            fitting = [s for s, free in enumerate(room) if free >= n]
            best = min(fitting, key=lambda s: (room[s], s)) if fitting else max(range(len(room)), key=lambda s: (room[s], -s))
            taken = min(n, room[best])
            places[group].append((best, taken))
            n, room[best] = n - taken, room[best] - taken
    return places


def propagate(votes: DataFrame, room: list[int]) -> DataFrame:
    """Rows (link, shard, n) when no row moves any more; a shard takes up to its ``room`` times the slack.

    A move makes a group's largest part larger, so the sum of squares grows with each and the rounds come to an end."""
    rooms = F.array(*[F.lit(SLACK * r) for r in room])
    step, before = 0, None
    while True:
        now = votes.agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("n"))).first()[0]
        if now is None or now == before:
            return votes
        before = now
        at_home = Window.partitionBy("link").orderBy(F.desc("n"), F.xxhash64("link", "shard"), "shard")
        wish = votes.withColumn("target", F.first("shard").over(at_home))  # at most one row per shard in a window
        moving = F.col("target") != F.col("shard")
        asked = wish.where(moving).groupBy(F.col("target").alias("shard")).agg(F.sum("n").alias("asked"))
        staying = wish.where(~moving).groupBy("shard").agg(F.sum("n").alias("staying"))
        free = F.greatest(F.lit(0.0), F.element_at(rooms, F.col("shard") + 1) - F.coalesce("staying", F.lit(0)))
        quotas = asked.join(staying, "shard", "left")  # a row per shard
        quotas = quotas.select(F.col("shard").alias("target"), F.least(F.lit(1.0), free / F.col("asked")).alias("quota"))
        chosen = wish.join(F.broadcast(quotas), "target", "left")
        share = F.col("n") * F.coalesce("quota", F.lit(0.0))  # whole members move; the fraction left decides by a hash
        movers = F.floor(share + draw("link", "shard", F.lit(step))).cast("long")
        movers = F.when(moving, F.least(F.col("n"), movers)).otherwise(F.lit(0))
        parts = F.array(
            F.struct(F.col("target").alias("shard"), movers.alias("n")),
            F.struct(F.col("shard").alias("shard"), (F.col("n") - movers).alias("n")),
        )
        moved = chosen.select("link", F.explode(parts).alias("p")).select("link", "p.shard", "p.n").where("n > 0")
        votes = materialise(moved.groupBy("link", "shard").agg(F.sum("n").alias("n")), "votes")
        step += 1


def _by_room(room: list[int], *columns: str | Column) -> Column:
    """A shard, as likely as it has room."""
    upto = F.array(*[F.lit(float(x)) for x in accumulate(room)])
    return F.least(F.size(F.filter(upto, lambda f: f <= draw(*columns) * F.element_at(upto, -1))), F.lit(len(room) - 1))


def shard_rows(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, link (equal for equal texts), shard, slot.

    Shards hold numbers of rows that differ by one at most, slots count from 0 without gaps. Size is the UTF-8 bytes of the
    text plus 16; null text counts as empty here but is linked only with other empty texts, as its rows are the same.
    Repeated rows, also those with the same id or none, are rows of their own. No row gives no shard.
    """
    body = F.encode(whole_text(F.col(text)), "UTF-8")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("link"),
    ).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "rows")  # without texts
    total = rows.count()
    capacity = [-(-(s + 1) * total // shards) - -(-s * total // shards) for s in range(shards)]
    groups = materialise(rows.groupBy("link").agg(F.count("*").alias("members")).where("members > 1"), "groups")
    large = groups.where(F.col("members") >= F.lit(max(2.0, LARGE * total / shards))).orderBy(F.desc("members"), "link").collect()
    places = place_large([r["members"] for r in large], capacity)
    placed_large = [(r["link"], shard, n) for r, parts in zip(large, places) for shard, n in parts]
    fixed = docs.sparkSession.createDataFrame(placed_large, "link long, shard int, n long")
    room = list(capacity)
    for _, shard, n in placed_large:
        room[shard] -= n
    small = groups.join(F.broadcast(fixed.select("link").distinct()), "link", "left_anti").select("link")
    homes = rows.join(small, "link", "left_semi").withColumn("shard", _by_room(room, "doc_id", "row"))
    votes = propagate(materialise(homes.groupBy("link", "shard").agg(F.count("*").alias("n")), "votes"), room)
    united = materialise(votes.groupBy("link").agg(F.max_by("shard", F.struct("n", "shard")).alias("near"), F.sum("n").alias("n")), "united")
    linked = {r["near"]: r["n"] for r in united.groupBy("near").agg(F.sum("n").alias("n")).collect()}  # a number per shard
    free = [max(0, r - linked.get(shard, 0)) for shard, r in enumerate(room)]
    first = docs.sparkSession.createDataFrame([(r["link"], i - len(large)) for i, r in enumerate(large)], "link long, near int")
    placed = rows.join(united.select("link", "near").unionByName(first), "link", "left")  # large groups have numbers below 0
    filled = _by_room(free, "row", F.lit("fill"))
    side = F.when(F.col("near").isNotNull(), 1).otherwise(F.when(F.xxhash64("row") % 2 == 0, 0).otherwise(2))
    placed = placed.select("doc_id", "size", "text_crc32", "link", "row", F.coalesce("near", filled).alias("near"), side.alias("side"))
    numbered = ranked(materialise(placed, "placed"), ["near", "side", "link", "row"], name="number")
    # runs of numbers that go to one shard, at most a few for each large group and one for each shard
    number, used, runs = 0, [0] * shards, []
    for shard, n in [*[(shard, n) for parts in places for shard, n in parts], *enumerate(room)]:
        if n:
            runs.append((number, shard, used[shard]))
            number, used[shard] = number + n, used[shard] + n
    runs = runs or [(0, 0, 0)]
    starts, targets, offsets = (F.array(*[F.lit(x) for x in column]) for column in zip(*runs))
    at = F.size(F.filter(starts, lambda s: s < F.col("number")))
    slot = F.col("number") - 1 - F.element_at(starts, F.col("at")) + F.element_at(offsets, F.col("at"))
    return numbered.withColumn("at", at).select(
        "doc_id", "size", "text_crc32", "link", F.element_at(targets, F.col("at")).cast("int").alias("shard"), slot.cast("long").alias("slot")
    )
