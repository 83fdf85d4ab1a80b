"""Jaccard self-join of n-gram sets: which texts are linked, directly or over others.

1. Equal sets are one class; what follows works on classes.
2. An n-gram of no other class cannot be shared. A text with more of these than a link allows has no partner. They are
   counted exactly among the n-grams whose hash is in a fixed part of all hashes, which is enough to rule most texts out.
3. N-grams have one order for all texts: by hash, the most frequent ones last. Two linked texts share an n-gram of their
   first ones (their prefixes), so texts that meet at no such n-gram are not linked. An n-gram that a third of all texts
   share is late in the order and thus in next to no prefix. The order decides what is compared, never what is linked.
4. Of the texts that meet at an n-gram, each is first compared with the one that has most in common with the others, then
   with its neighbour in size. That links groups of near copies, with pairs in proportion to the texts. Then every text is compared with those that it meets and is not yet connected to, leaving
   out, for each n-gram, the pairs within the largest connected part: whatever their number, no link between parts is missed.
5. Comparing: the sets that one set is compared with are stored in a prefix tree in hash order. A walk shares the overlap of
   what they have in common, and leaves a subtree when the lengths that remain cannot bring the overlap needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, components, first_row_number, whole_text
from tidemark.llm.shingles import set_signature, shingle_set
from tidemark.session import materialise

WORDS = 5
PERCENT = 80  # least similarity of a link, in whole per cent
SAMPLED = 1.5  # n-grams of one class are counted in a part of all hashes so many times the part of a set that may differ
FREQUENT = 100_000  # n-grams that are put last; a bound on what is sent to the tasks, not on what is compared
LEAST_FREQUENT = 8
KEYS_SENT = 1_000_000  # up to so many keys (16 bytes each) are broadcast; more are joined by a shuffle
LOT = 500  # texts of an n-gram among which neighbours in size are sought
PARTNERS = 2  # of those compared first, the ones that share most n-grams


def required(a: int, b: int, percent: int) -> int:
    """Least overlap of sets of these sizes with at least ``percent`` per cent similarity."""
    return -(-percent * (a + b) // (100 + percent))


def may_differ(n: int, percent: int) -> int:
    """Most n-grams of a set of size n that a linked set does not have."""
    return n - -(-percent * n // 100)


class PrefixTree:
    """Compressed trie of sorted sets. A node holds a run of n-grams; ``most`` is the longest run from here to a set's end."""

    __slots__ = ("run", "children", "ids", "most")

    def __init__(self, run: np.ndarray):
        self.run, self.children, self.ids, self.most = run, {}, [], len(run)

    def insert(self, grams: np.ndarray, name) -> None:
        node = self
        while True:
            size = min(len(node.run), len(grams))
            differ = np.flatnonzero(node.run[:size] != grams[:size])
            shared = int(differ[0]) if len(differ) else size
            node.most = max(node.most, len(grams))
            if shared < len(node.run):
                below = PrefixTree(node.run[shared:])
                below.children, below.ids = node.children, node.ids
                below.most = len(below.run) + max([0, *(c.most for c in below.children.values())])
                node.run, node.children, node.ids = node.run[:shared], {int(below.run[0]): below}, []
            grams = grams[shared:]
            if not len(grams):
                node.ids.append(name)
                return
            child = node.children.get(int(grams[0]))
            if child is None:
                child = node.children[int(grams[0])] = PrefixTree(grams)
            node = child

    def linked(self, probe: np.ndarray, percent: int) -> Iterator[object]:
        """Names of the sets that are linked with ``probe``."""
        stack = [(self, 0, 0)]  # node, n-grams above it, of these in the probe
        while stack:
            node, depth, overlap = stack.pop()
            passed = int(np.searchsorted(probe, node.run[0])) if len(node.run) else 0
            # the best that this subtree can bring: everything that is left, of the shorter side
            best = overlap + min(node.most, len(probe) - passed)
            if best < required(len(probe), max(depth + 1, best), percent):
                continue
            if len(node.run):
                at = np.searchsorted(probe, node.run)
                at[at == len(probe)] = 0
                overlap += int((probe[at] == node.run).sum())
            depth += len(node.run)
            if node.ids and overlap >= required(len(probe), depth, percent):
                yield from node.ids
            stack.extend((c, depth, overlap) for c in node.children.values())


def _signed(words: int, percent: int):
    """(id, h, text) -> (row, doc_id, h, n, s1, s2, sample)."""
    least = -(1 << 63)
    below = least + int(min(1.0, SAMPLED * (100 - percent) / 100) * ((1 << 64) - 1))

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = first_row_number()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                sets = [shingle_set(t, words) for t in part["_text"]]
                signs = [set_signature(s) for s in sets]
                yield pd.DataFrame(
                    {
                        "row": np.arange(row, row + len(sets)),
                        "doc_id": part["_id"].array,
                        "h": part["_h"].array,
                        "n": [len(s) for s in sets],
                        "s1": [s[0] for s in signs],
                        "s2": [s[1] for s in signs],
                        "sample": [s[: np.searchsorted(s, below)] for s in sets],
                    }
                )
                row += len(sets)

    return made


def _keyed(keys: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with these keys and the columns of ``keys``, a written table: broadcast after a count of it."""
    return rows.join(F.broadcast(keys) if keys.count() <= KEYS_SENT else keys, on)


def _sets(words: int):
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                yield pd.DataFrame({"node": part["node"].array, "n": part["n"].array, "grams": [shingle_set(t, words).tobytes() for t in part["_text"]]})

    return made


def _repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """N-grams that a batch has more than once, with how often: the frequent ones of the whole are among these."""
    for batch in batches:
        grams, n = np.unique(np.concatenate([np.frombuffer(g, np.int64) for g in batch["grams"]] or [np.zeros(0, np.int64)]), return_counts=True)
        yield pd.DataFrame({"gram": grams[n > 1], "times": n[n > 1]})


def _prefixes(frequent: np.ndarray, percent: int):
    """(node, n, grams) -> the first n-grams in the common order, with their place."""
    order = np.argsort(frequent, kind="stable")
    by_hash, rank = frequent[order], order  # ``frequent`` is from rarest to commonest

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams, nodes, sizes, places, lates = [], [], [], [], []
            for node, n, data in zip(batch["node"], batch["n"], batch["grams"]):
                own = np.frombuffer(data, np.int64)
                late = np.zeros(len(own), np.int64)
                if len(by_hash):
                    at = np.searchsorted(by_hash, own)
                    at[at == len(by_hash)] = 0
                    late = np.where(by_hash[at] == own, rank[at] + 1, 0)
                first = np.argsort(late, kind="stable")[: may_differ(n, percent) + 1]
                own = own[first]
                grams.append(own)
                lates.append(late[first] > 0)
                nodes.append(np.full(len(own), node))
                sizes.append(np.full(len(own), n))
                places.append(np.arange(len(own)))
            if grams:
                yield pd.DataFrame({"gram": np.concatenate(grams), "node": np.concatenate(nodes), "n": np.concatenate(sizes), "place": np.concatenate(places), "late": np.concatenate(lates)})

    return made


def _compared(percent: int):
    """(a, grams_a, b, grams_b), rows of an ``a`` together -> links (a, b)."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for a, part in batch.groupby("a", sort=False):
                tree = PrefixTree(np.zeros(0, np.int64))
                for b, grams in zip(part["b"], part["grams_b"]):
                    tree.insert(np.frombuffer(grams, np.int64), b)
                found += [(a, b) for b in tree.linked(np.frombuffer(part["grams_a"].iloc[0], np.int64), percent)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return made


def _possible(percent: int, left: str, right: str) -> Column:
    """Can the sets of these rows, which share an n-gram at their places, be linked? By their sizes, by what is before and
    after, and by the n-grams of one's prefix that are in no other (``own``): they come before the other's last one if
    that is a frequent one (``to_late``), and so would be in its prefix if it had them. Of the n-grams that linked sets share
    one is so early in both that the overlap they need could follow from it on: pairs are taken there only."""
    n1, n2, p1, p2, e1, e2, l1, l2 = (F.col(f"{s}.{c}") for c in ("n", "place", "own", "to_late") for s in (left, right))
    most = F.least(p1, p2) + 1 + F.least(n1 - p1 - 1, n2 - p2 - 1)
    most = F.least(most, n1 - F.when(l2, e1).otherwise(0), n2 - F.when(l1, e2).otherwise(0))
    most = F.least(most, n1 - p1, n2 - p2)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * most >= percent * (n1 + n2))


def _links(pairs: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """Those of the pairs (a, b) that are linked; written."""
    first = sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    second = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    both = pairs.join(second, "b").join(first, "a").sortWithinPartitions("a")
    return materialise(both.select("a", "grams_a", "b", "grams_b").mapInPandas(_compared(percent), "a long, b long"), label)


def _with_part(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the connected part of their node."""
    parts = components(links)
    return rows.join(parts.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))


def _centre(rows: DataFrame) -> DataFrame:
    """With each row (gram, x) the text y that has most in common with the others of the n-gram."""
    return rows.join(rows.groupBy("gram").agg(F.max("x").alias("y")), "gram")


def _neighbour(rows: DataFrame) -> DataFrame:
    """With each row (gram, lot, x) the next smaller text y of the lot."""
    by_size = Window.partitionBy("gram", "lot").orderBy("x.n", "x.node")
    return rows.withColumn("y", F.lag("x").over(by_size)).where("y is not null")


def _kinds(rows: DataFrame, percent: int) -> DataFrame:
    """(gram, kx, ky): kinds of rows of an n-gram whose texts can be linked. Texts of a kind have the same bounds, so these
    are checked once for two kinds and not for each two texts; only sizes that may match meet."""
    scale = F.floor(F.log(F.col("kind.n")) / float(np.log(100 / percent))) if 0 < percent < 100 else F.col("kind.n")
    kinds = rows.groupBy("gram", "kind").agg(F.bool_or(F.col("part") != F.col("main")).alias("open"))
    kinds = materialise(kinds.withColumn("scale", scale.cast("long")), "kinds")
    # sizes that match are at most one step apart; one more allows for rounding at the edge of a step
    spread = [F.lit(d) for d in range(-2, 3)] if 0 < percent < 100 else [F.lit(0)]
    x = kinds.where("open").select("gram", F.col("kind").alias("kx"), F.explode(F.array(*spread)).alias("step"), "scale")
    x = x.select("gram", "kx", (F.col("scale") + F.col("step")).alias("scale"))
    y = kinds.select("gram", F.col("kind").alias("ky"), "scale")
    return x.join(y, ["gram", "scale"]).where(_possible(percent, "kx", "ky")).select("gram", "kx", "ky")


def linked_classes(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the sets (node, n, grams; a table) that connect what is linked: a link that is left out joins two
    sets which the others already connect."""
    spark = sets.sparkSession
    counts = sets.mapInPandas(_repeated, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))
    top = counts.where(F.col("times") >= LEAST_FREQUENT).orderBy(F.desc("times"), "gram").limit(FREQUENT).collect()
    frequent = np.array([r["gram"] for r in reversed(top)], np.int64)
    prefixes = sets.mapInPandas(_prefixes(frequent, percent), "gram long, node long, n long, place long, late boolean")
    prefixes = materialise(prefixes, "prefixes")
    shared = prefixes.groupBy("gram").count().where("count > 1")
    meets = materialise(prefixes.join(shared, "gram"), "meets")
    # a text whose first n-grams are in many others differs little from what they have in common
    early = F.sum(F.when(F.col("late"), 0).otherwise(1))
    met = meets.groupBy("node").agg(F.sum("count").alias("common"), early.alias("met"))
    ends = prefixes.groupBy("node").agg(early.alias("early"), F.max("late").alias("to_late"))
    facts = materialise(met.join(ends, "node").select("node", "common", (F.col("early") - F.col("met")).alias("own"), "to_late"), "facts")
    lots = F.ceil(F.col("count") / LOT)  # a frequent n-gram's rows are dealt out to look for neighbours
    meets = meets.withColumn("lot", F.pmod(F.xxhash64("node"), lots)).drop("count", "late")
    meets = materialise(meets.join(facts, "node"), "meets")
    row = F.struct("common", "node", "n", "place", "own", "to_late", "part")

    links = spark.createDataFrame([], "a long, b long")
    for partner in (_centre, _neighbour):
        near = partner(_with_part(meets, links).select("gram", "lot", row.alias("x")))
        near = near.where((F.col("x.part") != F.col("y.part")) & _possible(percent, "x", "y"))
        pairs = near.groupBy(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).agg(F.count("*").alias("met"), F.max("x.node").alias("x"))
        best = Window.partitionBy("x").orderBy(F.desc("met"), "a", "b")
        pairs = pairs.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= PARTNERS).select("a", "b")
        links = materialise(links.union(_links(pairs, sets, percent, "near")), "links")

    rows = materialise(_with_part(meets, links), "parts")
    parts = rows.groupBy("gram", "part").agg(F.count("*").alias("rows"))
    mixed = parts.groupBy("gram").agg(F.max(F.struct("rows", "part"))["part"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_rows = rows.join(mixed.select("gram", "main"), "gram").withColumn("kind", F.struct("n", "place", "own", "to_late"))
    open_rows = materialise(open_rows.select("gram", "main", "part", "node", "kind"), "open")
    others = open_rows.where("part <> main").select("gram", F.struct("node", "part").alias("x"), F.col("kind").alias("kx"))
    every = open_rows.select("gram", "main", F.struct("node", "part").alias("y"), F.col("kind").alias("ky"))
    met = others.join(_kinds(open_rows, percent), ["gram", "kx"]).join(every, ["gram", "ky"]).where("x.part <> y.part")
    met = met.where((F.col("y.part") == F.col("main")) | (F.col("x.node") > F.col("y.node")))
    pairs = met.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    return materialise(links.union(_links(pairs, sets, percent, "rest")), "links")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links lead to, its own included),
    kept (one row of each component) and text_hash.

    Texts are linked when the Jaccard similarity of their sets of n-grams is at least ``percent`` per cent. A text with fewer
    words than an n-gram has one n-gram, all of it; null, empty and blank texts have none and are linked with nothing. Null
    ids are never the smallest. Repeated rows are equal texts. Of a component the row with the smallest id stays, of rows that
    share it the first one. ``docs`` must read the same rows again (a table). Other columns may have any name; an empty table
    gives no row.
    """
    bounded_batches(docs.sparkSession)
    h = F.xxhash64(whole_text(F.col(text)))
    read = docs.select(F.col(key).cast("long").alias("_id"), h.alias("_h"), whole_text(F.col(text)).alias("_text"))
    signed = read.mapInPandas(_signed(words, percent), "row long, doc_id long, h long, n long, s1 long, s2 long, sample array<long>")
    signed = materialise(signed, "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first")
    classes = signed.where("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("node"), first, F.max("n").alias("n"))
    classes = materialise(classes, "classes")
    owners = signed.select("s1", F.explode("sample").alias("gram")).groupBy("gram").agg(F.min("s1").alias("s1"), F.max("s1").alias("other"))
    alone = owners.where("s1 = other").groupBy("s1").agg(F.count("*").alias("alone"))
    may = F.col("n") - F.ceil(F.col("n") * percent / 100)
    left = classes.join(alone, "s1", "left").where(F.coalesce("alone", F.lit(0)) <= may).select("node", "n")
    keys = materialise(left.join(signed.select(F.col("row").alias("node"), "doc_id", "h"), "node"), "keys")
    keys = keys.select("node", "n", F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    found = _keyed(keys.where("_id is not null"), read, ["_id", "_h"])
    nameless = _keyed(keys.where("_id is null").drop("_id"), read.where("_id is null"), ["_h"]).dropDuplicates(["node"])
    texts = found.select("node", "n", "_text").unionByName(nameless.select("node", "n", "_text"))
    sets = materialise(texts.mapInPandas(_sets(words), "node long, n long, grams binary"), "sets")
    parts = components(linked_classes(sets, percent))
    named = classes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("first"))
    named = named.drop("first").join(least, "component").select("s1", "s2", "first")
    result = signed.drop("sample").join(named, ["s1", "s2"], "left")
    empty = F.col("n") == 0
    return result.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (empty | (F.col("row") == F.col("first.row"))).alias("kept"),
        F.col("h").alias("text_hash"),
    )


def drop_near(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns; of rows with the same id and text, one."""
    kept = near_duplicates(docs, words, percent, key, text).where("kept").select(F.col("doc_id").alias("_k"), F.col("text_hash").alias("_t"))
    marked = docs.withColumn("_tidemark_hash", F.xxhash64(whole_text(F.col(text))))
    same = marked[key].eqNullSafe(F.col("_k")) & (F.col("_tidemark_hash") == F.col("_t"))
    return marked.join(kept, same, "left_semi").dropDuplicates([key, "_tidemark_hash"]).drop("_tidemark_hash")
