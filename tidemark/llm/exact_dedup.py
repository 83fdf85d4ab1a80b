"""Exact duplicates by Patricia tries.

Texts are dealt out by length and a hash of their content. A task inserts the full byte strings of its share into
a compressed radix trie, below their length; the terminal node of a string stores its owner, so two texts are the same
only if they are the same byte by byte. A task reads its rows in one go: before the shuffle, the texts of a task's input are
inserted into tries in the same way, so that of a text with a million copies each task sends one, with how many it saw.
A trie that outgrows its memory moves its largest subtrees to files of the task and finishes them afterwards, one by one.
The rows of a text with very many copies meet their owner in several tasks.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, first_row_number, whole_text
from tidemark.operators.skew import MIN_HEAVY_ROWS, skew_join
from tidemark.session import materialise, size_of

LOCAL_BYTES = 24 << 20  # texts that a task gathers before it sends what it has
TRIE_BYTES = 48 << 20  # what a task's trie may take before subtrees go to files
NODE_BYTES = 600  # what a node and its owner take besides the label
LENGTH_BYTES = 4  # a text has less than 2 GB
PART_BYTES = 32 << 20  # input bytes for which there is a part of the shuffle
IDS_PER_ROW = 1000
UNKNOWN_SIZE = 1 << 60  # what the planner estimates for rows that are not from files is no size
SMALLEST = -(1 << 63)


class Node:
    """``label`` leads here from the parent; ``owner`` is set where an inserted string ends; ``file`` where what follows
    the first byte of the label has been moved out."""

    __slots__ = ("label", "children", "owner", "file")

    def __init__(self, label: bytes, owner=None):
        self.label, self.owner = label, owner
        self.children: dict[int, Node] = {}
        self.file = None


class Patricia:
    """Compressed radix trie of byte strings. ``insert`` combines the owners of equal strings; ``owners`` yields each
    distinct string's owner once, in no particular order, and leaves the trie empty.

    ``size`` is what the nodes in memory take. Above ``most`` bytes whole subtrees, with the labels that lead to them, go to
    files until half of it is free. What stays is the path that all strings share and one node a file.
    """

    def __init__(self, combine, most: int = TRIE_BYTES, folder: str | None = None):
        self.root, self.combine, self.most, self.folder = Node(b""), combine, most, folder
        self.size = 0
        self.limit = most
        self.moved = 0

    def insert(self, key: bytes, owner) -> None:
        node, at = self.root, 0
        while True:
            if node.file is not None:
                pickle.dump((key[at:], owner), node.file)
                return
            if at == len(key):
                node.owner = owner if node.owner is None else self.combine(node.owner, owner)
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], owner)
                self.size += len(key) - at + NODE_BYTES
                break
            label = child.label
            if key.startswith(label, at):
                at += len(label)
                node = child
                continue
            shared = len(os.path.commonprefix([label, key[at : at + len(label)]]))
            upper = Node(label[:shared])
            child.label = label[shared:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            self.size += NODE_BYTES
            node, at = upper, at + shared
        if self.size > self.limit:
            self._move_out()

    @staticmethod
    def _walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.owner is not None:
                yield prefix, node.owner
            stack.extend((c, prefix + c.label) for c in node.children.values())

    @staticmethod
    def _weight(node: Node) -> tuple[int, bool]:
        """Bytes of a subtree, and whether parts of it are in files."""
        total, parted, stack = 0, False, [node]
        while stack:
            node = stack.pop()
            total += len(node.label) + NODE_BYTES
            parted = parted or node.file is not None
            stack.extend(node.children.values())
        return total, parted

    def _move_out(self) -> None:
        """Move the subtrees below the first fork to files, the largest first, until half the memory is free; if that is not
        enough, go on in the one that is left, which has parts in files. Only subtrees below a fork are moved, so the strings
        of a file are fewer than those of its trie. The next call comes when what is left has doubled, or ``most`` is reached."""
        node = self.root
        while self.size > self.most // 2:
            inner = sorted(((*self._weight(c), c) for c in node.children.values() if c.file is None), key=lambda x: -x[0])
            fork = len(node.children) > 1 or node.owner is not None
            left = []
            for weight, parted, child in inner:
                if parted or not fork:
                    left.append(child)
                elif self.size > self.most // 2:
                    self._to_file(child)
                    self.size -= weight - NODE_BYTES - 1
            if not left:
                break
            node = left[0]
        self.limit = max(self.most, 2 * self.size)

    def _to_file(self, node: Node) -> None:
        node.file = tempfile.TemporaryFile(dir=self.folder)
        for key, owner in self._walk(node, node.label[1:]):
            pickle.dump((key, owner), node.file)
        node.label, node.children, node.owner = node.label[:1], {}, None
        self.moved += 1

    def owners(self) -> Iterator[object]:
        files, stack = [], [self.root]
        self.root, self.size = Node(b""), 0
        while stack:
            node = stack.pop()
            if node.owner is not None:
                yield node.owner
            if node.file is not None:
                files.append(node.file)
            stack.extend(node.children.values())
        del node
        for file in files:
            yield from self._reread(file)

    def _reread(self, file) -> Iterator[object]:
        file.seek(0)
        rest = Patricia(self.combine, self.most, self.folder)
        while True:
            try:
                rest.insert(*pickle.load(file))
            except EOFError:
                break
        file.close()
        yield from rest.owners()


def _merge(a: tuple, b: tuple) -> tuple:
    """(doc_id, -row, count, ..): the larger id stays, of equal ids the earlier row; counts add up."""
    top = max(a, b, key=lambda x: x[:2])
    return (*top[:2], a[2] + b[2], *top[3:])


def _local_groups(with_text: bool):
    """Rows (id, text) of a task -> its groups of equal texts. With the text: one row a group; else rows of ids."""

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = first_row_number()
        tries: dict[int, Patricia] = {}
        size = 0

        def flush() -> pd.DataFrame:
            rows = []
            for length, trie in tries.items():
                for top, first, count, sha, text, ids, numbers in trie.owners():
                    if with_text:
                        rows.append((length, sha, text, top, first, count))
                    else:
                        for at in range(0, len(ids), IDS_PER_ROW):
                            rows.append((sha, ids[at : at + IDS_PER_ROW], numbers[at : at + IDS_PER_ROW]))
            return pd.DataFrame(rows, columns=GROUP_NAMES if with_text else ID_NAMES)

        for batch in batches:
            for doc_id, null, text in zip(batch["_id"], batch["_null"], batch["_text"]):
                data = text.encode()
                top = SMALLEST if null else int(doc_id)
                trie = tries.get(len(data))
                if trie is None:
                    trie = tries[len(data)] = Patricia(_gather, most=1 << 62)
                sha = hashlib.sha256(data).hexdigest()
                trie.insert(data, (top, -number, 1, sha, data if with_text else None, [top], [number]))
                number += 1
                size += len(data) + 64
                if size > LOCAL_BYTES:
                    yield flush()
                    tries, size = {}, 0
        if tries:
            yield flush()

    return grouped


def _gather(a: tuple, b: tuple) -> tuple:
    a[5].extend(b[5])
    a[6].extend(b[6])
    return (*_merge(a, b)[:3], a[3], a[4], a[5], a[6])


GROUP_NAMES = ["n_bytes", "sha", "text", "top", "first", "n"]
ID_NAMES = ["sha", "ids", "numbers"]
OWNER_NAMES = ["sha", "top", "first", "n"]


def _owners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups of one part -> one row per distinct text, from one trie: the length comes before the text, so that texts of a
    length are a subtree."""
    trie = Patricia(_merge)
    for batch in batches:
        for length, sha, text, top, first, n in batch.itertuples(index=False, name=None):
            trie.insert(int(length).to_bytes(LENGTH_BYTES, "big") + bytes(text), (int(top), int(first), int(n), sha))
    rows = []
    for top, first, n, sha in trie.owners():
        rows.append((sha, top, first, n))
        if len(rows) == 10_000:
            yield pd.DataFrame(rows, columns=OWNER_NAMES)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=OWNER_NAMES)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", heavy_rows: int = MIN_HEAVY_ROWS) -> DataFrame:
    """One row per row of ``docs``: its id as ``doc_id``, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; null counts as empty. Of equal texts the row with the largest id stays (null
    is smaller than any id), and of rows that also share the id exactly one: the first in the input's order. ``docs`` must
    read the same rows in the same order when read again (a table; not a plan with random order). The columns of
    ``docs`` beside these two may have any name. An empty table gives no row. A text with ``heavy_rows`` copies and more than
    a partition's share of the rows is spread over tasks.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_id"), F.col(key).isNull().alias("_null"), whole_text(F.col(text)).alias("_text"))
    groups = rows.mapInPandas(_local_groups(True), "n_bytes long, sha string, text binary, top long, first long, n long")
    size = size_of(docs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1 if size < UNKNOWN_SIZE else 0)
    owners = groups.repartition(parts, "n_bytes", "sha").mapInPandas(_owners, "sha string, top long, first long, n long")
    ids = rows.mapInPandas(_local_groups(False), "sha string, ids array<long>, numbers array<long>")
    owners = materialise(owners, "owners")
    each = skew_join(ids, owners, ["sha"], weights=owners, weight="n", min_rows=heavy_rows).select("sha", "top", "first", "n", F.explode(F.arrays_zip("ids", "numbers")).alias("_r"))
    mine = F.col("_r.ids") == F.col("top")
    return each.select(
        _or_null(F.col("_r.ids")).alias("doc_id"),
        _or_null(F.col("top")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (mine & (F.col("_r.numbers") == -F.col("first"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _or_null(value: Column) -> Column:
    return F.when(value != SMALLEST, value)


def drop_exact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns; of rows with the same id and text, one."""
    kept = exact_groups(docs, key, text).where("kept").select(F.col("doc_id").alias("_k"), F.col("text_sha256").alias("_s"))
    marked = docs.withColumn("_tidemark_sha", F.sha2(whole_text(F.col(text)), 256))
    same = marked[key].eqNullSafe(F.col("_k")) & (F.col("_tidemark_sha") == F.col("_s"))
    once = marked.join(kept, same, "left_semi")
    return once.dropDuplicates([key, "_tidemark_sha"]).drop("_tidemark_sha")
