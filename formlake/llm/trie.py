"""Prefix tries of conversations: adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is 16 bytes of the SHA-256 of its role and text, so no table of turns is needed. A conversation is the
string of its turns' ids. Conversations are range-sorted by (string, id); every run of sorted rows becomes an
adaptive radix tree, whose nodes grow from 4 to 16, 48 and 256 children and hold the bytes they skip, and only
byte depths that are a whole number of turns give trie nodes.

Figures of a node are sums over runs. A run knows the strings next to it, so it can tell which nodes began in an
earlier run and which leaves go on in a later one. Only the nodes on the two edges of a run are open; they are added
up by Spark. A large group of equal conversations, or of equal first turns, is thus cut like any other rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlake.llm.common import distinct_names, sized, store

#: Bytes of a turn's id.
WIDTH = 16
#: Conversations and turns in a run.
RUN_ROWS, RUN_TURNS = 20_000, 200_000

_WORD = "[^\\x20\\x09-\\x0D]+"


# ---- the adaptive radix tree


class Node4:
    """Up to 4 (or 16) children: sorted bytes beside the children."""

    room = 4

    def __init__(self, items=()):
        self.bytes = [b for b, _ in items]
        self.children = [c for _, c in items]

    def get(self, byte):
        i = bisect_left(self.bytes, byte)
        return self.children[i] if i < len(self.bytes) and self.bytes[i] == byte else None

    def put(self, byte, child) -> None:
        i = bisect_left(self.bytes, byte)
        if i < len(self.bytes) and self.bytes[i] == byte:
            self.children[i] = child
        else:
            insort(self.bytes, byte)
            self.children.insert(i, child)

    def full(self) -> bool:
        return len(self.bytes) == self.room

    def items(self):
        return list(zip(self.bytes, self.children, strict=True))


class Node16(Node4):
    room = 16


class Node48:
    """Up to 48 children behind an index of 256 places."""

    def __init__(self, items=()):
        self.index = bytearray(b"\xff" * 256)
        self.children = []
        for b, c in items:
            self.put(b, c)

    def get(self, byte):
        i = self.index[byte]
        return None if i == 255 else self.children[i]

    def put(self, byte, child) -> None:
        i = self.index[byte]
        if i != 255:
            self.children[i] = child
        else:
            self.index[byte] = len(self.children)
            self.children.append(child)

    def full(self) -> bool:
        return len(self.children) == 48

    def items(self):
        return [(b, self.children[i]) for b, i in enumerate(self.index) if i != 255]


class Node256:
    """A place for every byte."""

    def __init__(self, items=()):
        self.children = [None] * 256
        for b, c in items:
            self.children[b] = c

    def get(self, byte):
        return self.children[byte]

    def put(self, byte, child) -> None:
        self.children[byte] = child

    def full(self) -> bool:
        return False

    def items(self):
        return [(b, c) for b, c in enumerate(self.children) if c is not None]


_LARGER = {Node4: Node16, Node16: Node48, Node48: Node256}


class Inner:
    """A path-compressed node: the bytes it skips, the value of the string that ends here, its children."""

    __slots__ = ("path", "value", "layout")

    def __init__(self, path: bytes, value=None):
        self.path, self.value, self.layout = path, value, Node4()

    def put(self, byte: int, child: Inner) -> None:
        if self.layout.get(byte) is None and self.layout.full():
            self.layout = _LARGER[type(self.layout)](self.layout.items())
        self.layout.put(byte, child)


class RadixTree:
    """Values of byte strings."""

    def __init__(self):
        self.root: Inner | None = None

    def insert(self, key: bytes, value) -> None:
        if self.root is None:
            self.root = Inner(key, value)
            return
        above, byte, node, at = None, 0, self.root, 0
        while True:
            path = node.path
            same = _common(path, key, at)
            if same < len(path):  # the key leaves inside the path: the node is cut in two
                upper = Inner(path[:same])
                node.path = path[same + 1:]
                upper.put(path[same], node)
                if above is None:
                    self.root = upper
                else:
                    above.put(byte, upper)
                node = upper
            at += same
            if at == len(key):
                node.value = value
                return
            child = node.layout.get(key[at])
            if child is None:
                node.put(key[at], Inner(key[at + 1:], value))
                return
            above, byte, node, at = node, key[at], child, at + 1


def _common(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``path`` the key goes on with at ``at``."""
    if key.startswith(path, at):
        return len(path)
    low, high = 0, min(len(path), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(path[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


# ---- figures of one run


class _Turns:
    """A trie node on the way down: what its subtree in this run adds up to."""

    __slots__ = ("depth", "words", "n", "least", "ends", "children", "leaves", "saved", "new", "open", "parent")

    def __init__(self, depth, words, new, open_, parent):
        self.depth, self.words, self.new, self.open, self.parent = depth, words, new, open_, parent
        self.n = self.children = self.leaves = self.saved = 0
        self.least = self.ends = None


def run_nodes(keys: list[bytes], ids: list[list[int]], words: list[list[int]], before: bytes | None, after: bytes | None,
              width: int = WIDTH):
    """Trie nodes of a run: ``keys`` ascend and differ, each with its conversations' ids and its turns' words.

    ``before`` and ``after`` are the keys next to the run, None at the ends of all. Nodes on a path shared with
    these are open: another run has a part of them.
    """
    tree = RadixTree()
    for i, key in enumerate(keys):
        tree.insert(key, i)
    last = len(keys) - 1

    def shared(key, other):
        return -1 if other is None else _common(other, key, 0) // width

    from_before = shared(keys[0], before)
    to_after = shared(keys[-1], after)
    out: list[_Turns] = []

    # Depth first without recursion: (node, byte depth where its path begins, some key below it).
    def any_key(node):
        while node.value is None:
            node = node.layout.items()[0][1]
        return node.value

    stack = [(tree.root, 0, None, False)]
    first_key, last_key = keys[0], keys[-1]
    while stack:
        node, begin, above, done = stack.pop()
        if done:  # above is the chain of trie nodes that this tree node made, the deepest last
            for t in reversed(above):
                if t.new:
                    t.saved -= t.words
                t.saved += t.n * t.words
                if t.parent is not None:
                    p = t.parent
                    p.n += t.n
                    p.leaves += t.leaves
                    p.saved += t.saved
                    p.children += t.new
                    p.least = t.least if p.least is None else min(p.least, t.least)
            continue
        k = any_key(node)
        key = keys[k]
        end = begin + len(node.path)
        chain, parent = [], above
        # Turn-aligned depths on the compressed path, the top of the tree (depth 0) included.
        low = 0 if parent is None else parent.depth + 1
        for depth in range(low, end // width + 1):
            on_first = depth <= from_before and first_key.startswith(key[:depth * width])
            on_last = depth <= to_after and last_key.startswith(key[:depth * width])
            t = _Turns(depth, words[k][depth - 1] if depth else 0, not on_first, on_first or on_last, parent)
            t.ends = []
            out.append(t)
            chain.append(t)
            parent = t
        if node.value is not None:
            parent.ends = ids[node.value]
            parent.n += len(parent.ends)
            parent.least = min(parent.ends) if parent.least is None else min(parent.least, *parent.ends[:1])
            children = node.layout.items()
            goes_on = node.value == last and after is not None and after.startswith(key)
            if not children and not goes_on:
                parent.leaves += 1
        else:
            children = node.layout.items()
        stack.append((node, begin, chain, True))
        for _, child in reversed(children):
            stack.append((child, end + 1, parent, False))
    return out, from_before, to_after


def _digest(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _rolling(key: bytes, depth: int, width: int = WIDTH) -> list[bytes]:
    """Names of the prefixes of a key, from depth 0 on."""
    h = hashlib.sha256()
    out = [h.digest()]
    for d in range(depth):
        h.update(key[d * width:(d + 1) * width])
        out.append(h.copy().digest())
    return out


# ---- Spark


def rebuilt(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
            block: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, key, words): the string of turn ids (hex) of each rebuilt conversation, and the words of each turn.

    Conversation c has the first h turns of conversation c - c % ``block``, then its own after its first h, where h is
    crc32 of c as text modulo ``heads``. Turns are in order of their number, null first; equal numbers are ordered by id.
    """
    rows = distinct_names(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat_ws("", F.length(role).cast("string"), F.lit(":"), role, text)  # the length keeps role and text apart
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        "turn", F.substring(F.sha2(named, 256), 1, 2 * WIDTH).alias("id"),
        F.regexp_count(text, F.lit(_WORD)).alias("words")).alias("turn"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    own = store(own.select("conv_id", F.expr("turns.id").alias("ids"), F.expr("turns.words").alias("words")), "conversations")
    tops = own.where(F.pmod("conv_id", F.lit(block)) == 0).select(
        F.col("conv_id").alias("top"), F.slice("ids", 1, heads).alias("top_ids"), F.slice("words", 1, heads).alias("top_words"))
    top = F.col("conv_id") - F.pmod("conv_id", F.lit(block))
    joined = own.withColumns({"top": top, "h": F.crc32(F.col("conv_id").cast("string")) % heads}).join(tops, "top", "left")

    def put_together(name, kind):
        head = F.expr(f"slice(coalesce(top_{name}, cast(array() as array<{kind}>)), 1, cast(h as int))")
        return F.concat(head, F.expr(f"slice({name}, cast(h as int) + 1, greatest(size({name}) - cast(h as int), 0))"))

    return joined.select("conv_id", F.array_join(put_together("ids", "string"), "").alias("key"),
                         put_together("words", "int").alias("words"))


_RUN = (
    "part int, run int, edge_first boolean, edge_last boolean, first binary, last binary, before binary, after binary, "
    "keys array<binary>, ids array<array<long>>, words array<array<int>>"
)


def _run_maker(run_rows: int, run_turns: int):
    from pyspark import TaskContext

    def make(batches):
        part, number, before = TaskContext.get().partitionId(), 0, None
        held: list[tuple[bytes, list[int], list[int]]] = []
        ready = None
        rows = turns = 0

        def packed(after):
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before is None]),
                pa.array([after is None]), *[pa.array([x], pa.binary()) for x in (ready[0][0], ready[-1][0], before, after)],
                pa.array([[x[0] for x in ready]], pa.list_(pa.binary())),
                pa.array([[x[1] for x in ready]], pa.list_(pa.list_(pa.int64()))),
                pa.array([[x[2] for x in ready]], pa.list_(pa.list_(pa.int32()))),
            ], ["part", "run", "edge_first", "edge_last", "first", "last", "before", "after", "keys", "ids", "words"])

        for batch in batches:
            for conv, key, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "words")), strict=True):
                key = bytes.fromhex(key)
                if rows and (rows >= run_rows or turns >= run_turns):
                    ready, held, rows, turns = held, [], 0, 0
                    yield packed(key)
                    number, before = number + 1, ready[-1][0]
                if held and held[-1][0] == key:
                    held[-1][1].append(conv)
                else:
                    held.append((key, [conv], words))
                    turns += len(words)
                rows += 1
        if held:
            ready = held
            yield packed(None)

    return make


_NODE = (
    "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, first_end long, ends string, open boolean"
)


def _node_maker(batches):
    names = [f.split()[0] for f in _NODE.split(", ")]
    types = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.string(), pa.bool_()]
    for batch in batches:
        for r in batch.to_pylist():
            nodes, from_before, to_after = run_nodes(r["keys"], r["ids"], r["words"], r["before"], r["after"])
            first, last = _rolling(r["first"], max(from_before, 0)), _rolling(r["last"], max(to_after, 0))
            rows = []
            for t in nodes:
                p = t.parent
                # An open node lies on the path shared with the run before or, if it isn't there, the one after.
                name = None if not t.open else first[t.depth] if not t.new else last[t.depth]
                above = None if p is None or not p.open else first[p.depth] if not p.new else last[p.depth]
                rows.append((
                    name, above, t.depth, t.least, None if p is None or p.open else p.least, t.n, t.children, t.leaves,
                    t.saved, None if t.open else _digest(t.ends), t.ends[0] if t.open and t.ends else None,
                    ",".join(map(str, t.ends)) if t.open and t.ends else None, t.open))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)


def _joined_ends(batches):
    """Digests of nodes whose ends come in order, piece after piece."""
    node, state = None, None

    def given(node, state):
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "digest"])

    for batch in batches:
        for name, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if name != node:
                if state is not None:
                    yield given(node, state)
                node, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ends.encode())
    if state is not None:
        yield given(node, state)


def prefix_trie(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    run_rows: int = RUN_ROWS, run_turns: int = RUN_TURNS,
) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations, from the textless root down.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 (of the ids of the members that end here, ascending, joined by commas). Null roles and texts
    are empty; rows without a conv_id belong to no conversation; a null turn comes first, and turns of
    one number (repeated rows too) are all kept, in order of their id. An empty table gives no node, not even a root.
    A conversation is worked on as a whole, but only its turns' ids. Other columns are ignored.
    """
    convs = rebuilt(df, conv_col, turn_col, role_col, text_col)
    order = ["key", "conv_id"]
    sorted_ = convs.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = store(sorted_.mapInArrow(_run_maker(run_rows, run_turns), _RUN), "runs")
    # One row for each partition that has rows.
    edges = runs.groupBy("part").agg(F.min_by("first", "run").alias("first"), F.max_by("last", "run").alias("last"))
    by_part = Window.orderBy("part")
    edges = edges.select("part", F.lag("last").over(by_part).alias("low"), F.lead("first").over(by_part).alias("high"))
    runs = runs.join(F.broadcast(edges), "part").withColumns({
        "before": F.when(F.col("edge_first"), F.col("low")).otherwise(F.col("before")),
        "after": F.when(F.col("edge_last"), F.col("high")).otherwise(F.col("after")),
    }).drop("low", "high")
    nodes = store(runs.mapInArrow(_node_maker, _NODE), "trie-nodes")

    shared = nodes.where("open")
    ends = shared.where("ends is not null").select("node", "first_end", "ends")
    ends = ends.repartition("node").sortWithinPartitions("node", "first_end").select("node", "ends")
    digests = ends.mapInArrow(_joined_ends, "node binary, digest string")
    merged = shared.groupBy("node").agg(
        F.first("depth").alias("depth"), F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"),
        F.max("parent_conv_id").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    merged = store(merged.join(digests, "node", "left").withColumn(
        "ends_sha256", F.coalesce("digest", F.lit(_digest([])))).drop("digest"), "shared-nodes")
    columns = ["depth", "conv_id", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = nodes.where("not open").select(*columns).unionByName(merged.select(*columns))
    parents = sized(merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")))
    return every.join(parents, "parent", "left").select(
        "conv_id", "depth", F.coalesce("above", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", "ends_sha256")
