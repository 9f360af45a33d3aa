"""Prefix trie of conversations: ternary search trees for ranges of conversations, whose common paths are merged.

Method: a turn is a 16-byte content id (MD5 of role and text) and a conversation the ids of its turns, so its key is narrow
and sorts in preorder of the trie.  Spark partitions conversations by ranges of (key, conversation id), so a huge group of
equal conversations is cut as well, and a task cuts its sorted rows into ranges of about ``TURNS`` turns.  The ids of a range
are numbered by a dictionary of the range, its distinct conversations go into a ternary search tree, the middle one
first, which balances it, and an iterative traversal adds up members, leaves, children and savings from the bottom.  Only nodes
on a range's first path, or on the part of its last path that the next range shares, can have members elsewhere: these
edges are merged by node in a streaming pass.  What must count once for a node (as a leaf, as its parent's child, its words)
counts in the last range that has it; where a task's last path goes on in the next task, a correction follows from the two paths.

How rows flow: texts are read once and never shuffled; about 40 bytes a turn are.  A task holds one range, so memory doesn't
grow with the table; nothing is sent to the driver.  The edges are two paths a range, the corrections one path a task,
found by a window over one row a task.  A conversation's key is one value, 20 bytes a turn, and members' numbers are digested as
they stream by.

Defined results: a null role or text is empty; rows of a turn that repeats go by content; rows without a conversation id
belong to none; columns beside the four named are not read; an empty table gives no node, else the root is there even if
no conversation has a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, arrow_stream, materialize, small

TURNS, WIDTH = 50_000, 16


def turns(convs: DataFrame) -> DataFrame:
    """``(conv_id, turn, id, words)``: each turn's content id and the words of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return convs.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.md5(content.cast("binary"))).alias("id"), F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"))


def _ordered(t: DataFrame, *group: str) -> DataFrame:
    """One row for each group: the ids and words of its turns in order."""
    row = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "id", "words")
    return t.groupBy(*group).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def _keyed(x: DataFrame) -> DataFrame:
    """``(conv_id, key binary, words array<int>)``."""
    return x.select("conv_id", F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["id"])), "")).alias("key"), F.col("rows.words").alias("words"))


def sequences(convs: DataFrame) -> DataFrame:
    """Each conversation as it is."""
    return _keyed(_ordered(turns(convs), "conv_id"))


def rebuilt(convs: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with its first turns taken from the first of its family of ``family`` ids, as many as a checksum
    of its id says, fewer than ``most``; all turns of a family are shuffled to one place."""
    base = F.col("conv_id") - F.col("conv_id") % family
    x = _ordered(turns(convs).withColumn("base", base).repartition("base"), "base", "conv_id")
    head = F.when(F.col("conv_id") == F.col("base"), F.slice("rows", 1, most - 1))
    x = x.withColumn("head", F.coalesce(F.first(head, ignorenulls=True).over(Window.partitionBy("base")), F.slice("rows", 1, 0)))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = F.when(F.size("rows") > h, F.expr(f"slice(rows, cast(crc32(cast(cast(conv_id as string) as binary)) % {most} as int) + 1, greatest(size(rows), 1))")).otherwise(F.slice("rows", 1, 0))
    return _keyed(x.withColumn("rows", F.concat(F.slice("head", F.lit(1), h), own)))


class Tree:
    """A ternary search tree over sequences of numbers."""

    def __init__(self):
        self.symbol, self.low, self.high, self.down = [], [], [], []
        self.first = -1
        self.members, self.least, self.ends = [], [], []  # of each node: conversations through it, the least id, ids that end in it

    def _new(self, symbol: int) -> int:
        for column, value in ((self.symbol, symbol), (self.low, -1), (self.high, -1), (self.down, -1), (self.members, 0), (self.least, None), (self.ends, None)):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, sequence: tuple[int, ...], ids: list[int]) -> None:
        least, parent = min(ids), -1
        node = -1
        for s in sequence:
            at, link, owner = (self.down[parent] if parent >= 0 else self.first), "down", parent
            while at >= 0 and self.symbol[at] != s:
                link, owner = ("low" if s < self.symbol[at] else "high"), at
                at = getattr(self, link)[at]
            if at < 0:
                at = self._new(s)
                if owner < 0:
                    self.first = at
                else:
                    getattr(self, link)[owner] = at
            self.members[at] += len(ids)
            self.least[at] = least if self.least[at] is None else min(self.least[at], least)
            parent = node = at
        self.ends[node] = ids

    def siblings(self, first: int) -> Iterator[int]:
        """The nodes of one level under one parent, in order, without recursion."""
        stack, at = [], first
        while stack or at >= 0:
            while at >= 0:
                stack.append(at)
                at = self.low[at]
            at = stack.pop()
            yield at
            at = self.high[at]


def middle_first(n: int) -> Iterator[int]:
    """0 .. n-1, the middle of each half before its parts."""
    spans = [(0, n)]
    while spans:
        a, b = spans.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            spans += ((m + 1, b), (a, m))


def digest(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys share from the start."""
    n = min(len(a), len(b)) // WIDTH
    return next((i for i in range(n) if a[i * WIDTH : (i + 1) * WIDTH] != b[i * WIDTH : (i + 1) * WIDTH]), n)


SUMS = "conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
NODES = f"part long, place long, depth long, node binary, parent binary, edge boolean, parent_conv_id long, {SUMS}, ends string, first binary, last binary, words array<int>"
NAMES = tuple(c.split()[0] for c in NODES.split(", "))


def cut(key: bytes) -> list[bytes]:
    return [key[i : i + WIDTH] for i in range(0, len(key), WIDTH)]


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys share from the start."""
    return next((i for i, (x, y) in enumerate(zip(cut(a), cut(b))) if x != y), min(len(a), len(b)) // WIDTH)


def range_nodes(part: int, place: int, rows: list[tuple[bytes, int, list[int]]], following: bytes | None) -> Iterator[tuple]:
    """The nodes of one range from its sorted ``(key, conv_id, words)``; ``following`` is the next range's first key, or None
    at the end of a task, where all of the last path counts here until ``corrections`` come.

    Nodes on the range's first path and those that may go on are edges: their rows hold this range's part of their sums, and
    as ``ends`` the ids themselves."""
    distinct: dict[bytes, tuple[list[int], list[int]]] = {}
    for key, conv_id, words in rows:
        distinct.setdefault(key, (words, []))[1].append(conv_id)
    keys = list(distinct)
    names = sorted({s for key in keys for s in cut(key)})
    number = {s: i for i, s in enumerate(names)}
    words_of = [0] * len(names)
    for key, (words, _) in distinct.items():
        for s, w in zip(cut(key), words, strict=True):
            words_of[number[s]] = w
    tree = Tree()
    for i in middle_first(len(keys)):
        if keys[i]:
            tree.insert([number[s] for s in cut(keys[i])], distinct[keys[i]][1])

    first, last = cut(keys[0]), cut(keys[-1])
    goes_on = -1 if following is None else common(keys[-1], following)  # down to this depth the last path goes on
    nodes, ups, depths = [-1], [-1], [0]  # in preorder, the root first
    stack = [(n, 0, 1) for n in reversed(list(tree.siblings(tree.first)))]
    while stack:
        node, up, depth = stack.pop()
        stack += [(n, len(nodes), depth + 1) for n in reversed(list(tree.siblings(tree.down[node])))]
        nodes.append(node)
        ups.append(up)
        depths.append(depth)
    n = len(nodes)
    on_first, on_last, paths = [True] * n, [True] * n, [hashlib.md5()] * n
    for i in range(1, n):
        up, d, s = ups[i], depths[i], names[tree.symbol[nodes[i]]]
        on_first[i] = on_first[up] and d <= len(first) and first[d - 1] == s
        on_last[i] = on_last[up] and d <= len(last) and last[d - 1] == s
        if on_first[up] or on_last[up]:  # paths are named where they or their parents are edges
            paths[i] = paths[up].copy()
            paths[i].update(s)
    members = [len(rows), *(tree.members[x] for x in nodes[1:])]
    least = [min(c for _, c, _ in rows), *(tree.least[x] for x in nodes[1:])]
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        words = words_of[tree.symbol[nodes[i]]] if i else 0
        saved[i] += members[i] * words
        up = ups[i]
        if not (on_last[i] and depths[i] <= goes_on):  # what counts once counts in the node's last range
            saved[i] -= words
            leaves[i] += (tree.down[nodes[i]] if i else tree.first) < 0
            if i:
                children[up] += 1
        if i:
            leaves[up] += leaves[i]
            saved[up] += saved[i]
    edge = [a or (b and (following is None or d <= goes_on)) for a, b, d in zip(on_first, on_last, depths, strict=True)]
    for i in range(n):
        ids = (tree.ends[nodes[i]] or []) if i else distinct.get(b"", (None, []))[1]
        above = i > 0 and edge[ups[i]]
        yield (
            part, place, depths[i], paths[i].digest() if edge[i] else None, paths[ups[i]].digest() if above else None, edge[i], None if above or not i else least[ups[i]],
            least[i], members[i], children[i], leaves[i], saved[i], ",".join(map(str, ids)) if edge[i] else digest(ids), None, None, None,
        )


def part_nodes(part: int, rows: Iterator[tuple[bytes, int, list[int]]], turns_each: int) -> Iterator[tuple]:
    """The nodes of all ranges of a task, and a last row with its first and last path."""
    held, size, place, first = [], 0, 0, None
    for row in rows:
        first = row[0] if first is None else first
        if size >= turns_each:
            yield from range_nodes(part, place, held, row[0])
            held, size, place = [], 0, place + 1
        held.append(row)
        size += len(row[2]) + 1
    if held:
        yield from range_nodes(part, place, held, None)
        yield part, place, None, None, None, None, None, None, None, None, None, None, None, first, held[-1][0], held[-1][2]


def corrections(last: bytes, words: list[int], following: bytes) -> Iterator[tuple]:
    """``(node, n_children, n_leaves, saved_tokens)`` to be added for the nodes of a last path that go on in the next task."""
    deep = common(last, following)
    path, ids = hashlib.md5(), cut(last)
    below = sum(words[:deep])
    for d in range(deep + 1):
        if d:
            path = path.copy()
            path.update(ids[d - 1])
        yield path.digest(), -(d < deep), -(deep == len(ids)), below
        below -= words[d - 1] if d else 0


def _merged(edges: DataFrame) -> DataFrame:
    """One row for each edge node; its parts stream by in the order of the ranges."""
    names = ("node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

    def run(batches):
        now, sums, sha, any_ends, held = None, None, None, False, []
        for cols in batches:
            for node, parent, depth, conv_id, *more, ends in zip(*(cols[c] for c in (*names[:-1], "ends")), strict=True):
                if node != now:
                    if now is not None:
                        held.append((*sums, sha.hexdigest()))
                    now, sums, sha, any_ends = node, [node, None, None, None, 0, 0, 0, 0], hashlib.sha256(), False
                if depth is not None:
                    sums[1], sums[2], sums[3] = parent, depth, conv_id if sums[3] is None else min(sums[3], conv_id)
                for i, x in enumerate(more):
                    sums[4 + i] += x
                if ends:
                    sha.update(b"," * any_ends + ends.encode())
                    any_ends = True
            if held:
                yield dict(zip(names, zip(*held, strict=True), strict=True))
                held = []
        if now is not None:
            yield dict(zip(names, zip((*sums, sha.hexdigest())), strict=True))

    x = edges.repartition("node").sortWithinPartitions("node", "part", "place")
    return arrow_stream(x, run, f"node binary, parent binary, depth long, {SUMS}, ends_sha256 string")


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(seqs: DataFrame, turns_each: int = TURNS) -> DataFrame:
    """One row for each node of the trie over ``(conv_id, key, words)``: ``RESULT``."""
    x = materialize(seqs).repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def run(batches):
        from pyspark import TaskContext

        rows = (r for cols in batches for r in zip(cols["key"], cols["conv_id"], (list(map(int, w)) for w in cols["words"]), strict=True))
        held = []
        for r in part_nodes(TaskContext.get().partitionId(), rows, turns_each):
            held.append(r)
            if len(held) == 1024:
                yield dict(zip(NAMES, zip(*held, strict=True), strict=True))
                held = []
        if held:
            yield dict(zip(NAMES, zip(*held, strict=True), strict=True))

    out = materialize(arrow_stream(x, run, NODES))
    parts = out.where("last is not null").select("part", "place", "first", "last", "words")  # a row for each task
    meeting = parts.withColumn("following", F.lead("first").over(Window.orderBy("part"))).where("following is not null")

    def correct(batches):
        for cols in batches:
            rows = [(p, q, *c) for p, q, last, words, following in zip(cols["part"], cols["place"], cols["last"], cols["words"], cols["following"], strict=True) for c in corrections(last, list(map(int, words)), following)]
            yield dict(zip(("part", "place", "node", "n_children", "n_leaves", "saved_tokens"), zip(*rows, strict=True), strict=True))

    fixes = arrow_stream(meeting, correct, "part long, place long, node binary, n_children long, n_leaves long, saved_tokens long")
    none = lambda kind: F.lit(None).cast(kind)
    fixes = fixes.select("part", "place", none("long").alias("depth"), "node", none("binary").alias("parent"), none("long").alias("conv_id"), F.lit(0).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.lit("").alias("ends"))
    edges = materialize(_merged(out.where("edge").select(*fixes.columns).unionByName(fixes)))
    inner = out.where("not edge").withColumnRenamed("ends", "ends_sha256")
    named = edges.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    of_edges = inner.where("parent is not null").drop("parent_conv_id").select("parent", *[c for c in RESULT if c != "parent_conv_id"]).unionByName(edges.select("parent", *[c for c in RESULT if c != "parent_conv_id"]))
    joined = of_edges.join(small(named), "parent", "left")
    return inner.where("parent is null").select(*RESULT).unionByName(joined.select(*RESULT))
