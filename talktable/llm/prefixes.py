"""Trie of the prefixes that conversations share, from adaptive radix trees over ranges of sorted conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktable.llm.common import written
from talktable.storage import materialize

#: bytes of a turn's id
WIDTH = 16
#: turns from which a task starts a new tree
TURNS = 100_000
#: neighbouring trees whose borders meet in one task
NEIGHBOURS = 64


class Radix:
    """A node of an adaptive radix tree: the bytes on the way to it, and children by next byte.

    Up to 16 children stand in byte order beside their bytes (layouts of 4 and 16), up to 48 behind an index of 256 bytes,
    beyond that in 256 places.
    """

    __slots__ = ("path", "size", "keys", "slots", "ends", "sample")

    def __init__(self, path: bytes, sample: int):
        self.path, self.sample, self.size = path, sample, 0
        self.keys, self.slots, self.ends = bytearray(), [], []

    def child(self, byte: int) -> Radix | None:
        if self.size <= 16:
            at = self.keys.find(byte)
            return self.slots[at] if at >= 0 else None
        if self.size <= 48:
            at = self.keys[byte]
            return self.slots[at - 1] if at else None
        return self.slots[byte]

    def put(self, byte: int, node: Radix) -> None:
        """Set or add the child of ``byte``, in a larger layout where this one is full."""
        known = self.child(byte) is not None
        if not known:
            if self.size == 16:
                index = bytearray(256)
                for at, key in enumerate(self.keys):
                    index[key] = at + 1
                self.keys = index
            elif self.size == 48:
                self.slots = [self.slots[at - 1] if at else None for at in self.keys]
                self.keys = bytearray()
            self.size += 1
        if self.size <= 16:
            at = self.keys.find(byte)
            if not known:
                at = next((i for i, key in enumerate(self.keys) if key > byte), len(self.keys))
                self.keys.insert(at, byte)
                self.slots.insert(at, node)
            self.slots[at] = node
        elif self.size <= 48:
            if not known:
                self.slots.append(node)
                self.keys[byte] = len(self.slots)
            self.slots[self.keys[byte] - 1] = node
        else:
            self.slots[byte] = node

    def children(self) -> list[Radix]:
        """In the order of their bytes."""
        if self.size <= 16:
            return self.slots
        if self.size <= 48:
            return [self.slots[at - 1] for at in self.keys if at]
        return [node for node in self.slots if node is not None]


def _common(a: bytes, b: bytes) -> int:
    """Number of bytes that both start with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    unlike = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (unlike.bit_length() + 7) // 8


def radix_tree(paths: list[bytes], ids: list[int]) -> Radix:
    """Tree of ``paths``; the node where a path ends holds its id. The root has no bytes."""
    root = Radix(b"", 0)
    for number, (path, key) in enumerate(zip(paths, ids)):
        node, above, at = root, None, 0
        while True:
            way = node.path
            if not path.startswith(way, at):
                shared = _common(way, path[at:at + len(way)])
                fork = Radix(way[:shared], node.sample)
                above.put(way[0], fork)
                node.path = way[shared:]
                fork.put(way[shared], node)
                node, at = fork, at + shared
            else:
                at += len(way)
            if at == len(path):
                node.ends.append(key)
                break
            below = node.child(path[at])
            if below is None:
                below = Radix(path[at:], number)
                below.ends.append(key)
                node.put(path[at], below)
                break
            above, node = node, below
    return root


_NODE = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("up", pa.int32()), ("n_convs", pa.int64()),
         ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
_OPEN = [("place", pa.int32()), ("digest", pa.binary()), ("words", pa.int64()), ("first", pa.bool_()), ("ends", pa.string())]
_CUT = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), *_NODE, *_OPEN])
_CUT_SQL = """part long, chunk long, conv_id long, depth long, parent_conv_id long, up int, n_convs long, n_children long, n_leaves long,
    saved_tokens long, ends_sha256 string, place int, digest binary, words long, first boolean, ends string"""


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _rows(paths: list[bytes], words: list[list[int]], ids: list[int], part: int, chunk: int) -> list[tuple]:
    """Rows of ``_CUT`` for a stretch of the conversations sorted by path and id.

    A prefix of the first or the last path may go on in the stretches beside this one: it stays open, and its row, with a
    ``place``, counts only the children that are closed. All others are whole. Only depths at the end of a turn give rows.
    """
    root, first, last = radix_tree(paths, ids), paths[0], paths[-1]
    nodes, ups, starts, fore, rear, shared = [], [], [], [], [], []
    stack = [(root, -1, 0)]
    while stack:
        node, up, start = stack.pop()
        at = len(nodes)
        nodes.append(node)
        ups.append(up)
        starts.append(start)
        end = start + len(node.path)
        # bytes shared with the first path, and with the first or the last
        both = [start + _common(node.path, border[start:end]) if up < 0 or with_border[up] >= start else -1
                for border, with_border in ((first, fore), (last, rear))]
        fore.append(both[0])
        rear.append(both[1])
        shared.append(max(both))
        stack += [(child, at, end) for child in reversed(node.children())]
    # bottom up: members, smallest member, closed children, their leaves and savings
    members, least, tops, leaves, saved = ([0] * len(nodes) for _ in range(5))
    found: list[list[tuple]] = [[] for _ in nodes]
    for at in range(len(nodes) - 1, -1, -1):
        node, start = nodes[at], starts[at]
        end = start + len(node.path)
        members[at] += len(node.ends)
        if node.ends:
            least[at] = min(least[at], node.ends[0]) if members[at] > len(node.ends) else node.ends[0]
        n, top, leaf, save = members[at], tops[at], leaves[at], saved[at]
        depths = range(end // WIDTH, start // WIDTH, -1) if at else [0]
        for depth in depths:
            closed = depth * WIDTH > shared[at]
            if closed:
                leaf = leaf if top else 1
                save += (n - 1) * words[node.sample][depth - 1]
            found[at].append((depth, closed, top, leaf, save))
            top, leaf, save = (1, leaf, save) if closed else (0, 0, 0)
        if at:
            up = ups[at]
            least[up] = min(least[up], least[at]) if members[up] else least[at]
            members[up] += n
            tops[up] += top
            leaves[up] += leaf
            saved[up] += save
    # top down: parents, and places of the open rows in order
    out, below, place = [], [(None, None)] * len(nodes), 0
    running = hashlib.blake2b(digest_size=WIDTH)
    digests: list = []
    for at, node in enumerate(nodes):
        end = starts[at] + len(node.path)
        parent = below[ups[at]] if at else (None, None)
        for depth, closed, top, leaf, save in reversed(found[at]):
            ends = node.ends if depth * WIDTH == end else []
            row = (part, chunk, least[at], depth, *parent, members[at], top, leaf, save)
            if closed:
                out.append((*row, _sha256(",".join(map(str, sorted(ends)))), None, None, None, None, None))
                parent = (least[at], None)
                continue
            path = paths[node.sample]
            del digests[depth:]
            running = digests[-1].copy() if digests else hashlib.blake2b(digest_size=WIDTH)
            running.update(path[max(0, depth - 1) * WIDTH:depth * WIDTH])
            digests.append(running)
            own = words[node.sample][depth - 1] if depth else 0
            on_first = depth * WIDTH <= fore[at]
            out.append((*row, None, place, running.digest(), own, on_first, ",".join(map(str, sorted(ends))) if ends else None))
            parent = (None, place)
            place += 1
        below[at] = parent
    return out


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of the conversations of a task, tree by tree."""
    part, chunk = TaskContext.get().partitionId(), 0
    paths, words, ids, turns = [], [], [], 0

    def made() -> Iterator[pa.RecordBatch]:
        rows = _rows(paths, words, ids, part, chunk)
        for at in range(0, len(rows), 20_000):
            columns = zip(*rows[at:at + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CUT)], schema=_CUT)

    for batch in batches:
        for path, counts, key in zip(batch.column("path"), batch.column("words"), batch.column("conv_id")):
            paths.append(path.as_py())
            words.append(counts.as_py())
            ids.append(key.as_py())
            turns += 1 + len(words[-1])
            if turns >= most:
                yield from made()
                chunk += 1
                paths, words, ids, turns = [], [], [], 0
    if ids:
        yield from made()


_BORDER = ["seg", "place", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "digest", "words", "first"]
_MET = pa.schema([("seg", pa.int64()), ("place", pa.int32()), *_NODE[:3], *_NODE[4:8], ("digest", pa.binary()), ("words", pa.int64()),
                  ("first", pa.bool_()), ("parent", pa.binary()), ("closed", pa.bool_())])
_MET_SQL = """seg long, place int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,
    saved_tokens long, digest binary, words long, first boolean, parent binary, closed boolean"""


def _meet(last_round: bool, neighbours: int):
    """Function that joins the open rows of neighbouring stretches; what touches neither outer border is closed."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(_BORDER).to_pylist(), key=lambda r: (r["seg"], r["place"]))
        way: list[dict] = []  # the open rows from the root to the one met last
        kept: list[dict] = []
        lowest = min(r["seg"] for r in rows)

        def close(depth: int) -> None:
            while len(way) > depth:
                node = way.pop()
                up = way[-1] if way else None
                node["parent"] = up["digest"] if up else None
                node["closed"] = last_round or not node["first"]
                if node["closed"]:
                    if not node["n_children"]:
                        node["n_leaves"] = 1
                    node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
                    if up:
                        up["n_children"] += 1
                        up["n_leaves"] += node["n_leaves"]
                        up["saved_tokens"] += node["saved_tokens"]
                kept.append(node)

        for row in rows:
            depth = row["depth"]
            row["first"] = row["first"] and row["seg"] == lowest
            if depth < len(way) and way[depth]["digest"] == row["digest"]:
                same = way[depth]
                same["conv_id"] = min(same["conv_id"], row["conv_id"])
                for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    same[name] += row[name]
                continue
            close(depth)
            way.append(row)
        if last_round:
            close(0)
        # the way to the last path stays open, as does that to the first
        for node in way:
            node |= {"parent": None, "closed": False}
        left = sorted((n for n in (*kept, *way) if not n["closed"]), key=lambda n: (n["seg"], n["place"]))
        for place, node in enumerate(left):
            node |= {"seg": lowest // neighbours, "place": place}
        done = [n for n in kept if n["closed"]]
        return pa.Table.from_pylist([{"parent_conv_id": None, **n} for n in (*done, *left)], _MET)

    return run


def conversation_paths(conversations: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role",
                       text_col: str = "text") -> DataFrame:
    """(conv_id, path, words) of each conversation: the 16-byte ids of its turns one after another, and their numbers of words.

    The id of a turn is a digest of its role and text, null as empty; turns are in the order of ``order_col``, nulls first,
    ties by id. Words are runs without ASCII white space. Repeated rows are repeated turns. Rows with a null conversation belong to none.
    One conversation is one row: 20 bytes a turn.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    role, said = text(role_col), text(text_col)
    turns = conversations.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"),
        F.struct(
            F.col(f"`{order_col}`").alias("at"),
            F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, said).cast("binary"))).alias("id"),
            F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        ).alias("turn"),
    )
    held = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return held.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")).alias("path"),
        F.col("turns.words").alias("words"),
    )


def prefix_nodes(paths: DataFrame, turns: int = TURNS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Nodes of the trie over (conv_id: unique, path, words), as ``prefix_trie`` describes.

    A tree holds the conversations of about ``turns`` turns, and the borders of ``neighbours`` trees meet in a task.
    """
    spark = paths.sparkSession
    ordered = materialize(paths.select("conv_id", "path", "words")).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    cut = written(ordered.mapInArrow(lambda batches: _stretches(batches, turns), _CUT_SQL))
    columns = [name for name, _ in _NODE if name != "up"]
    whole, opened = cut.where("place IS NULL"), materialize(cut.where("place IS NOT NULL"))

    # borders meet by neighbours until one stretch is left
    reach = opened.agg(F.max("chunk").alias("chunk"), F.max("part").alias("part")).first()
    if reach["part"] is None:
        return whole.select(columns)
    chunks = reach["chunk"] + 1
    top = reach["part"] * chunks + reach["chunk"]
    borders = opened.withColumn("seg", F.col("part") * chunks + F.col("chunk")).select(_BORDER)
    closed = []
    while True:
        meet = borders.groupBy(F.floor(F.col("seg") / neighbours).alias("group")).applyInArrow(_meet(top < neighbours, neighbours), _MET_SQL)
        met = materialize(meet)
        closed.append(met.where("closed"))
        borders = met.where("NOT closed").select(_BORDER)
        if top < neighbours:
            break
        top //= neighbours
    final = closed[0]
    for more in closed[1:]:
        final = final.unionByName(more)
    final = materialize(final)

    # ids that end at a node of several stretches are hashed piece by piece, in the order of the stretches
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for digest, ends in zip(batch.column("digest"), batch.column("ends")):
                digest, ends = digest.as_py(), ends.as_py().encode()
                if digest != now:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = digest, hashlib.sha256(ends)
                else:
                    state.update(b"," + ends)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], ["ended", "sha"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["ended", "sha"])

    pieces = opened.where("ends IS NOT NULL").select("digest", "part", "chunk", "ends").repartition("digest")
    ended = pieces.sortWithinPartitions("digest", "part", "chunk").mapInArrow(hashed, "ended binary, sha string")
    above = final.select(F.col("digest").alias("above"), F.col("conv_id").alias("above_conv"))
    inner = (
        final.join(ended, final["digest"] == ended["ended"], "left").join(above, final["parent"] == above["above"], "left")
        .withColumn("parent_conv_id", F.col("above_conv")).withColumn("ends_sha256", F.coalesce("sha", F.lit(_sha256(""))))
    )
    tied = opened.select("part", "chunk", F.col("place").alias("up"), "digest").join(above, F.col("digest") == F.col("above"))
    hanging = whole.where("up IS NOT NULL").join(tied, ["part", "chunk", "up"]).withColumn("parent_conv_id", F.col("above_conv"))
    return whole.where("up IS NULL").select(columns).unionByName(hanging.select(columns)).unionByName(inner.select(columns))


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct beginning of the conversations, the empty one included.

    ``conv_id`` is its smallest member, ``depth`` its number of turns, ``parent_conv_id`` the ``conv_id`` of the beginning one turn
    shorter (root: null), ``n_convs`` its members, ``n_children`` and ``n_leaves`` its children and the childless nodes
    of its subtree, ``saved_tokens`` the words that its subtree stores once instead of once a member, ``ends_sha256`` the
    SHA-256 of the ids of the conversations that are exactly it, ascending, joined by commas.

    Conversations are dealt by ranges of their turn ids, so a beginning that many share is in several tasks; the few prefixes
    at the borders of the ranges are put together in rounds. Nulls, ties and repeated rows are as in ``conversation_paths``;
    an empty table gives no node. Only the four named columns are read.
    """
    return prefix_nodes(conversation_paths(conversations, id_col, order_col, role_col, text_col))
