"""The prefix trie of all conversations, with sums over its subtrees, by a splitter skeleton.

Conversations are sorted by their path, the sums of their turns one after the other, and range-partitioned into shards. A
node whose members lie in more than one shard is a prefix of the paths on both sides of a border between shards, so the
trie of these splitter paths holds all such nodes: the skeleton. Because the splitters are sorted, their trie is given by how many turns
neighbours share: two numbers a shard, which are all that is sent to the tasks.

Each shard walks its sorted paths with a stack of open nodes. Nodes off the skeleton are finished there. For a node of the
skeleton a shard gives what it saw of it and below it, named by the first shard that has it and its depth, and these parts
are added up. What must count once for a node although many shards see it is given by its first shard (the node as a child
of its parent, the first copy of its tokens) or by its last, which alone knows whether anything follows (the node as leaf).

The digest of the ids that end at a node of the skeleton needs them in order; they come in blocks of text that are sorted and
streamed through one hash. That is one task a node: a digest of a list can be taken in no other way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, whole_text
from tidemark.operators.skew import lookup_join
from tidemark.session import materialise

BASE_EVERY, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
STEP = 32  # characters of a path a turn: a hexadecimal MD5
SHARD_BYTES = 16 << 20
IDS_PER_ROW = 10_000
ROWS_PER_BATCH = 5_000

NUMBERS = ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
SCHEMA = (
    "kind int, node int, depth long, parent int, parent_conv_id long, conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, shard int, block int, ids string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
FINISHED, PART, ENDS = range(3)


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, path (32 characters a turn), n_words of its turns."""
    role, text = whole_text(F.col("role")), whole_text(F.col("text"))
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    n_words = F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    turn = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), mark.alias("mark"), n_words.alias("n_words"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    own = materialise(turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns")), "turns")
    base = F.col("conv_id") - F.col("conv_id") % BASE_EVERY
    heads = own.where(F.col("conv_id") % BASE_EVERY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    head = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    both = own.withColumn("base", base).join(heads, "base", "left").withColumn("n_head", head)
    first = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("n_head")))
    rest = F.slice("turns", F.col("n_head") + 1, F.size("turns"))
    rebuilt = both.select("conv_id", F.concat(first, rest).alias("turns"))
    path = F.array_join(F.transform("turns", lambda t: t["mark"]), "")
    return rebuilt.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["n_words"]).alias("n_words"))


def _shards(paths: DataFrame) -> DataFrame:
    """``paths`` in shards by (path, conv_id), of at most some 16 MB of paths each."""
    size = paths.agg(F.coalesce(F.sum(F.length("path") + STEP), F.lit(0))).first()[0]
    count = max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES + 1)
    return materialise(paths.repartitionByRange(count, "path", "conv_id").withColumn("shard", F.spark_partition_id()), "shards")


def _shared(a: str, b: str) -> Column:
    """How many turns two paths begin with that are the same."""
    shorter = F.least(F.length(a), F.length(b)) / STEP
    part = lambda c, i: F.substring(c, i * STEP + 1, F.lit(STEP))
    return F.filter(F.sequence(F.lit(0), shorter.cast("int")), lambda i: (i >= shorter) | (part(a, i) != part(b, i)))[0]


def _borders(laid: DataFrame) -> dict[int, tuple[int, int, int]]:
    """shard -> (the shard before it, turns that the paths at their border share, turns that all paths of the one before
    share), for every shard that has rows but the first: three numbers a shard, of which there is one for 16 MB of paths."""
    ends = materialise(laid.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")), "ends")
    order = [r.shard for r in ends.select("shard").orderBy("shard").collect()]
    if len(order) < 2:
        return {}
    follows = laid.sparkSession.createDataFrame(list(zip(order[1:], order)), "shard int, before int")
    earlier = ends.select(F.col("shard").alias("before"), "last", _shared("first", "last").alias("inner"))
    pairs = ends.select("shard", "first").join(follows, "shard").join(earlier, "before")
    return {r.shard: (r.before, r.shared, r.inner) for r in pairs.select("shard", "before", _shared("last", "first").alias("shared"), "inner").collect()}


class _Node:
    __slots__ = ("depth", "words", "before", "least", "n_convs", "children", "has_child", "leaves", "saved", "ids", "waiting")

    def __init__(self, depth: int, words: int, before: bool):
        self.depth, self.words, self.before = depth, words, before
        self.least, self.n_convs, self.children, self.has_child = None, 0, 0, False
        self.leaves = self.saved = 0
        self.ids: list[int] = []
        self.waiting: list[tuple] = []


class _Walk:
    """The walk over one shard's sorted paths."""

    def __init__(self, shard: int, borders: dict[int, tuple[int, int, int]], after: dict[int, int]):
        self.shard, self.borders = shard, borders
        self.shared_before = borders[shard][1] if shard in borders else -1
        self.shared_after = after.get(shard, -1)
        self.stack: list[_Node] = []
        self.path: str | None = None
        self._first_shards: dict[int, int] = {}
        at = shard
        whole = self.shared_before  # turns that all paths of shard ``at`` share
        for depth in range(self.shared_before, -1, -1):
            while whole >= depth and at in borders and borders[at][1] >= depth:
                at, _, whole = borders[at]
            self._first_shards[depth] = at

    def first_shard(self, depth: int) -> int:
        """The first shard that has the node of this depth on the current path; this one, if no earlier shard has it."""
        return self._first_shards[depth] if self.stack[depth].before else self.shard

    def add(self, path: str, conv_id: int, words) -> Iterator[tuple]:
        first = self.path is None
        if first:
            self.stack = [_Node(0, 0, self.shared_before >= 0)]
            common = 0
        else:
            common, most = 0, min(len(path), len(self.path))
            while (common + 1) * STEP <= most and path.startswith(self.path[common * STEP : (common + 1) * STEP], common * STEP):
                common += 1
        while len(self.stack) > common + 1:
            yield from self._pop(last=False)
        for depth in range(len(self.stack), len(path) // STEP + 1):
            self.stack.append(_Node(depth, int(words[depth - 1]), first and depth <= self.shared_before))
        node = self.stack[-1]
        node.ids.append(conv_id)
        node.n_convs += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        self.path = path

    def end(self) -> Iterator[tuple]:
        while self.stack:
            yield from self._pop(last=True)

    def _pop(self, last: bool) -> Iterator[tuple]:
        """Close the deepest open node. ``last``: it is on the shard's last path."""
        node = self.stack[-1]
        goes_on = last and node.depth <= self.shared_after
        node.leaves += not goes_on and not node.has_child
        node.saved += node.n_convs * node.words - (0 if node.before else node.words)
        parent = self.stack[-2] if node.depth else None
        if parent is not None:
            parent.n_convs += node.n_convs
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
            parent.children += not node.before
            parent.has_child = True
            parent.leaves += node.leaves
            parent.saved += node.saved
        numbers = (node.least, node.n_convs, node.children, node.leaves, node.saved)
        if node.before or goes_on:
            name = self.first_shard(node.depth)
            above = self.first_shard(node.depth - 1) if node.depth else None
            yield (PART, name, node.depth, above, None, *numbers, None, self.shard, None, None)
            for block, at in enumerate(range(0, len(node.ids), IDS_PER_ROW)):
                text = ",".join(map(str, node.ids[at : at + IDS_PER_ROW]))
                yield (ENDS, name, node.depth, None, None, *[None] * 5, None, self.shard, block, text)
            for depth, values in node.waiting:
                yield (FINISHED, None, depth, name, None, *values, None, None, None)
        else:
            sha = hashlib.sha256(",".join(map(str, node.ids)).encode()).hexdigest()
            for depth, values in node.waiting:
                yield (FINISHED, None, depth, None, node.least, *values, None, None, None)
            if parent is None:
                yield (FINISHED, None, 0, None, None, *numbers, sha, None, None, None)
            else:
                parent.waiting.append((node.depth, (*numbers, sha)))
        self.stack.pop()


def _batched(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS_PER_BATCH:
            yield pd.DataFrame(held, columns=COLUMNS, dtype=object)
            held = []
    if held:
        yield pd.DataFrame(held, columns=COLUMNS, dtype=object)


def _local_nodes(borders: dict[int, tuple[int, int, int]]):
    """Rows (shard, path, conv_id, n_words), sorted, -> finished nodes, parts of skeleton nodes, ids that end at these."""
    after = {before: shared for before, shared, _ in borders.values()}

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        walk = None
        for batch in batches:
            for shard, path, conv_id, words in zip(batch["shard"], batch["path"], batch["conv_id"], batch["n_words"]):
                if walk is None or walk.shard != shard:
                    if walk is not None:
                        yield from walk.end()
                    walk = _Walk(int(shard), borders, after)
                yield from walk.add(path, int(conv_id), words)
        if walk is not None:
            yield from walk.end()

    return lambda batches: _batched(walked(batches))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted blocks of ids -> a digest per node."""
    node, digest = None, None
    for batch in batches:
        done = []
        for shard, depth, ids in zip(batch["node"], batch["depth"], batch["ids"]):
            if (shard, depth) != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (shard, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["node", "depth", "sha"])
    if node is not None:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=["node", "depth", "sha"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, turns with the same number by the MD5 of role and text; null role or text
    counts as empty, and repeated rows are repeated turns. Conversation c begins with the first h turns of c - c % 20 (h is
    the CRC-32 of c modulo 4; all, if that one has fewer, none, if there is none) and goes on with its own turns after its
    first h. Rows with a null conv_id belong to no conversation. Other columns are not read. Without conversations there is
    no node.

    A turn is known by 16 bytes and its number of words, so texts are not shuffled. A conversation is a row with 36 bytes a
    turn; conversations of equal turns, however many, are sorted by id over as many shards as they need.
    """
    bounded_batches(conversations.sparkSession)
    laid = _shards(materialise(conversation_paths(conversations), "paths"))
    walk = _local_nodes(_borders(laid))
    shards = laid.repartition("shard").sortWithinPartitions("shard", "path", "conv_id").select("shard", "path", "conv_id", "n_words")
    nodes = materialise(shards.mapInPandas(walk, SCHEMA), "nodes")
    parts = nodes.where(F.col("kind") == PART).groupBy("node", "depth")
    sums = [F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in NUMBERS[1:]]]
    skeleton = materialise(parts.agg(F.min("parent").alias("parent"), *sums), "skeleton")
    blocks = nodes.where(F.col("kind") == ENDS).select("node", "depth", "shard", "block", "ids")
    blocks = blocks.repartition("node", "depth").sortWithinPartitions("node", "depth", "shard", "block")
    digests = blocks.select("node", "depth", "ids").mapInPandas(_digests, "node int, depth long, sha string")
    ends = F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    shared = skeleton.join(digests, ["node", "depth"], "left").select("parent", "depth", *NUMBERS, ends)
    finished = nodes.where(F.col("kind") == FINISHED)
    below = finished.where("parent is not null").select("parent", "depth", *NUMBERS, "ends_sha256").union(shared.where("depth > 0"))
    names = skeleton.select(F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    result = ["conv_id", "depth", "parent_conv_id", *NUMBERS[1:], "ends_sha256"]
    of_skeleton = lookup_join(below, names, ["parent", "depth"]).select(*result)
    root = shared.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*result)
    return finished.where("parent is null").select(*result).union(of_skeleton).union(root)
