"""Near duplicates by 64-bit SimHash, candidates by pigeonring filtering; near copies by shingle sets."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktable.llm.common import components, written
from talktable.llm.vectors import BLOCK
from talktable.storage import materialize

BITS = 2
#: least number of places of the parities by which near copies are told apart before their sets are compared
PARITIES = 2048
#: hubs of each shingle that its other nodes are compared with before all pairs
HUBS = 3
#: places of node ids in the table that tells which texts are needed
SIEVE = 1 << 18
#: shingles of partners that a set is compared with in one piece
SHINGLES = 1 << 18
#: (first bit, length) of the three segments on the ring, and of the two halves of each.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
HALVES = (((0, 11), (11, 11)), ((22, 11), (33, 10)), ((43, 11), (54, 10)))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles of ``text``; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    spans = zip(starts[:n].tolist(), ends[min(width, len(words)) - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(flat[s:e], seed) for s, e in spans), np.uint64, n))


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """Signed 64 bits, each set if it is in over half the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), step):
        part = hashes[at:at + step].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(_key, fp) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fps = [fingerprint(t.as_py(), width, seed) for t in rows.column("_text")]
            yield pa.RecordBatch.from_arrays([rows.column("_key"), pa.array(fps, pa.int64())], ["_key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("_key"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_key long, fp long")


def _cut(fp: Column, span: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, span[0]).bitwiseAND(F.lit((1 << span[1]) - 1))


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, cap: int = 256) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` that differ in 2 bits or fewer.

    Three segments on a ring share a budget of 2 bits. Then some segment starts a chain that stays within
    its share at each length: no difference in it, at most one in it and the next, two in all three. The
    first two links of the chain are the join key: the segment, and one half of the next (one difference
    leaves a half equal). The chain is tested before the full distance.

    A key that more than ``cap`` fingerprints have is not joined. Its fingerprints meet at the values one bit
    away: two of them differ in 2 bits or fewer if and only if they reach a common value, and each reaches 65.
    All that reach one value are linked with the smallest of them, so no pairs are listed.
    """
    fp = F.col("fp")
    keys = F.array(*[
        F.struct(
            F.lit(i * 2 + h).cast("byte").alias("way"),
            F.shiftleft(_cut(fp, SEGMENTS[i]), 11).bitwiseOR(_cut(fp, HALVES[(i + 1) % 3][h])).alias("bits"),
        )
        for i in range(3) for h in range(2)
    ])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.way", "k.bits")
    sizes = keyed.groupBy("way", "bits").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(materialize(sizes), ["way", "bits"]))
    a = shared.where(F.col("n") <= cap).select("way", "bits", F.col("fp").alias("a"))
    b = shared.where(F.col("n") <= cap).select("way", "bits", F.col("fp").alias("b"))
    first = F.floor(F.col("way") / 2)
    chain = F.lit(False)
    for i in range(3):
        part = lambda j: _differing(_cut(F.col("a"), SEGMENTS[j]), _cut(F.col("b"), SEGMENTS[j]))
        nxt = (i + 1) % 3
        chain = chain | ((first == i) & (part(i) == 0) & (part(nxt) <= 1))
    near = (
        a.join(b, ["way", "bits"]).where((F.col("a") < F.col("b")) & chain)
        .where(_differing(F.col("a"), F.col("b")) <= BITS).select("a", "b")
    )
    hot = shared.where(F.col("n") > cap).select("fp").distinct()
    steps = F.array(F.lit(0).cast("long"), *[F.lit(1 << p if p < 63 else -(1 << 63)).cast("long") for p in range(64)])
    reached = materialize(hot.select("fp", F.explode(steps).alias("s")).select("fp", fp.bitwiseXOR(F.col("s")).alias("mid")))
    hubs = reached.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("mid", "b")
    star = reached.join(hubs, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42,
                    cap: int = 256) -> DataFrame:
    """One row per row of ``docs``: ``_key`` (its id), ``fingerprint`` (16 hex digits), ``component_id``, ``kept``.

    ASCII letters are lower-cased, words are runs without ASCII white space, shingles of ``width`` words count
    as often as they occur. A text of fewer words is one shingle; null, empty and blank texts have fingerprint
    zero and link like any other. Equal fingerprints are one node, so exact copies make no links.
    ``component_id`` is the smallest id reachable by links of at most 2 bits; ``kept`` marks its row, or all
    rows of that id if rows repeat. Rows with a null id get the component of their text and are not kept.
    Other columns are not read; an empty table gives an empty one.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, width, seed))
    firsts = materialize(rows.groupBy("fp").agg(F.min("_key").alias("first")))
    roots = components(links(firsts.select("fp"), cap))
    firsts = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = materialize(firsts)
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = materialize(firsts.join(least, "root").select("fp", "component_id"))
    found = rows.join(classes, "fp").select(
        "_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.coalesce(F.col("_key") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
    return found


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of ``text``; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    flat = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    hashes = {digest(flat[s:e], 42) for s, e in zip(starts, ends[min(width, len(words)) - 1:])}
    found = np.fromiter(hashes, np.uint64, len(hashes)).view(np.int64)
    found.sort()
    return found


def rarest(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The part of a set, in an order all sets share, of which sets of this Jaccard similarity have one in common.

    They share at least ``similarity`` of either, so not all of what is left out can be the shared part. Hashes in
    ``common`` (sorted) come last.
    """
    if not len(hashes):
        return hashes
    last = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)
    n = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    return np.concatenate([hashes[~last], hashes[last]])[:n]


def parities(hashes: np.ndarray) -> np.ndarray:
    """Parity of the hashes that fall on each of some places; two sets differ in as many elements or more as in places.

    There are ``PARITIES`` places, for large sets the first power of two above their size: fewer would be full.
    """
    places = max(PARITIES, 1 << int(len(hashes)).bit_length())
    odd = np.bincount(hashes.view(np.uint64) % np.uint64(places), minlength=places).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def folded(odd: np.ndarray, words: int) -> np.ndarray:
    """Parities of the same hashes on fewer places."""
    while len(odd) > words:
        odd = odd[:len(odd) // 2] ^ odd[len(odd) // 2:]
    return odd


def _unlike(a: str, b: str) -> Column:
    """Number of places in which the parities of two columns differ, on the places of the shorter one if it has half as many."""
    half = lambda c: F.zip_with(
        F.slice(c, F.lit(1), (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2 + 1).cast("int"), (F.size(c) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y)
    )
    sum_of = lambda x, y: F.aggregate(F.zip_with(x, y, _differing), F.lit(0), lambda n, d: n + d)
    return (
        F.when(F.size(a) == F.size(b), sum_of(F.col(a), F.col(b)))
        .when(F.size(a) == 2 * F.size(b), sum_of(half(a), F.col(b)))
        .when(F.size(b) == 2 * F.size(a), sum_of(F.col(a), half(b))).otherwise(0)
    )


def _common_shingles(rows: DataFrame, width: int, docs: int = 4000, most: int = 100_000) -> np.ndarray:
    """Sorted hashes that several rows of a sample have; they only make keys that fewer rows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("_text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), width))], ["h"])

    drawn = rows.orderBy(F.xxhash64("_key"), "_key").limit(docs).repartition(8)
    counts = drawn.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return np.array(sorted(r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(most).collect()), np.int64)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8,
                cap: int = 8) -> DataFrame:
    """(_key, component_id): texts linked by a Jaccard similarity of ``similarity`` or more of their shingle sets.

    Exact up to equal 64-bit hashes, whatever the size of the table or of the texts, and every link is checked on the whole
    sets. SimHash goes first: fingerprints of the sets that the ring finds near give the candidates that connect most copies.
    What they leave comes from a lossless filter: two similar sets have one of their rarest shingles in common (see ``rarest``), and the
    first of those leaves enough of both sets. From then on only pairs whose ends are still apart are looked at: those of a
    shingle's nodes with a hub of it, for ``HUBS`` hubs, then all pairs of shingles that at most ``cap`` nodes have, and block
    against block those of the others. Sets do not differ in more parities than in elements (see ``parities``), which rules out
    most pairs before their sets are fetched. Which shingles count as frequent is learned from a sample and changes no result.

    Equal sets are one node, so copies make no links. Null, empty and blank texts are one group. Rows that share an id are one
    document, linked by any of its texts. Rows with a null id get no row, and an empty table gives none. Other columns are not read.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_key"), F.col(text_col).alias("_text"))
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(rows, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                sets = [shingles(t.as_py(), width) for t in part.column("_text")]
                yield pa.RecordBatch.from_arrays([
                    part.column("_key"), pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in sets], pa.binary()),
                    pa.array([len(v) for v in sets], pa.int32()), pa.array([majority(v.view(np.uint64)) for v in sets], pa.int64()),
                    _lists([rarest(v, common.value, similarity) for v in sets]), _lists([parities(v) for v in sets]),
                ], ["_key", "digest", "size", "fp", "rare", "odd"])

    printed = written(rows.mapInArrow(run, "_key long, digest binary, size int, fp long, rare array<bigint>, odd array<bigint>"))
    first = printed.groupBy("digest").agg(F.min("_key").alias("node"))
    whole = printed.join(first, "digest").where(F.col("_key") == F.col("node")).dropDuplicates(["digest"])
    nodes = written(whole.select("digest", "node", "size", "fp", "odd"))
    alike = _Verifier(rows, nodes.select("node", "size", "odd"), width, similarity)

    # candidates by SimHash: nodes of one fingerprint, and the first ones of fingerprints that the ring links
    firsts = written(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    end = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"node_{c}"))
    ring = links(firsts.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    found = alike(same.unionByName(ring))
    where = components(found)

    # candidates by rare shingles, as long as a shingle's nodes are not in one component
    keyed = whole.select("node", "size", F.posexplode("rare").alias("pos", "value"))
    often = written(keyed.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"))
    shared = written(keyed.join(often, "value"))

    def apart(shared: DataFrame, where: DataFrame, turn: int) -> DataFrame:
        """Rows of the shingles whose nodes are in several components, with ``comp``, the ``main`` one, and a hub."""
        placed = shared.join(where, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        hub = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node"), F.col("size"), F.col("pos"), F.col("comp"))).alias("hub")
        mixed = placed.groupBy("value").agg(hub, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        return written(placed.join(mixed.select("value", "hub"), "value"))

    def enough(size_a: Column, pos_a: Column, size_b: Column, pos_b: Column) -> Column:
        left_over = F.least(size_a - pos_a, size_b - pos_b)
        return left_over / (size_a + size_b - left_over) >= similarity

    for turn in range(HUBS):
        held = apart(shared, where, turn)
        if held.isEmpty():
            break
        hub = F.col("hub")
        spokes = held.where((F.col("comp") != hub["comp"]) & enough(F.col("size"), F.col("pos"), hub["size"], hub["pos"]))
        more = alike(spokes.select(F.least("node", hub["node"]).alias("a"), F.greatest("node", hub["node"]).alias("b")))
        if not more.isEmpty():
            found = found.unionByName(more)
            where = components(found)
        shared = held.drop("comp", "hub")

    held = apart(shared, where, HUBS)
    few = held.where(F.col("n") <= cap)
    side = lambda c: few.select("value", F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("pos").alias(f"pos_{c}"), F.col("comp").alias(f"comp_{c}"))
    fits = enough(F.col("size_a"), F.col("pos_a"), F.col("size_b"), F.col("pos_b"))
    pairs = side("a").join(side("b"), "value").where((F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & fits)
    found = found.unionByName(alike(pairs.select("a", "b")))

    # nodes outside the main component of a frequent shingle meet all its nodes, in blocks
    many = held.where(F.col("n") > cap).drop("hub", "n")
    main = many.groupBy("value", "comp").agg(F.count("*").alias("n")).groupBy("value").agg(
        F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n")
    )
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    widths = written(main.select("value", F.col("most.comp").alias("main"), blocks(F.col("n") - F.col("most.n")).alias("n_left"), blocks(F.col("n")).alias("n_right")).where("n_left > 0"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    full = many.drop("size", "pos").join(widths, "value").join(nodes.select("node", "size", "odd"), "node")
    columns = ["value", "node", "comp", "size", "odd"]
    left = full.where("comp <> main").select(*columns, own("n_left").alias("l"), every("n_right").alias("r"), F.lit(True).alias("left"))
    right = full.select(*columns, own("n_right").alias("r"), every("n_left").alias("l"), F.lit(False).alias("left"))
    differing = _differing_share(similarity)

    def compare(block: pa.Table) -> pa.Table:
        is_left, ids, comp, size = (block.column(c).to_numpy() for c in ("left", "node", "comp", "size"))
        # unsigned, as bits of negative numbers are counted in their absolute values
        full = [np.array(o, np.int64).view(np.uint64) for o in block.column("odd").to_pylist()]
        odd, others = np.stack([folded(o, PARITIES // 64) for o in full]), np.flatnonzero(~is_left)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def apart(i: int, j: int) -> int:
            words = min(len(full[i]), len(full[j]))
            return int(np.bitwise_count(folded(full[i], words) ^ folded(full[j], words)).sum(dtype=np.int64))

        for row in np.flatnonzero(is_left):
            both = size[row].astype(np.int64) + size[others]
            near = others[(np.abs(size[row] - size[others]) <= differing * both + 1e-6) & (comp[others] != comp[row])]
            n = np.bitwise_count(odd[row] ^ odd[near]).sum(axis=1, dtype=np.int64)
            near = near[n <= differing * (size[row].astype(np.int64) + size[near]) + 1e-6]
            if len(full[row]) > odd.shape[1]:
                near = np.array([i for i in near.tolist() if apart(row, i) <= differing * (int(size[row]) + int(size[i])) + 1e-6], np.int64)
            a.append(np.minimum(ids[row], ids[near]))
            b.append(np.maximum(ids[row], ids[near]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    met = left.unionByName(right).groupBy("value", "l", "r").applyInArrow(compare, "a long, b long")
    roots = components(found.unionByName(alike(written(met.distinct()))))
    classes = materialize(nodes.select("digest", "node").join(roots, "node", "left").select("digest", "node", F.coalesce("root", "node").alias("root")))
    least = classes.groupBy("root").agg(F.min("node").alias("component_id"))
    classes = materialize(classes.join(least, "root").select("digest", "component_id"))
    return printed.select("_key", "digest").join(classes, "digest").select("_key", "component_id")


def _differing_share(similarity: float) -> float:
    """Two sets of this similarity differ in at most this share of the sum of their sizes."""
    return (1 - similarity) / (1 + similarity)


class _Verifier:
    """Keeps those of the pairs (a, b) of nodes whose whole shingle sets are similar enough."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, width: int, similarity: float):
        self.rows, self.nodes, self.width, self.similarity = rows, nodes, width, similarity

    def _sets(self, met: DataFrame) -> DataFrame:
        """(node, set) of the nodes met. A table of at most ``SIEVE`` rows goes to all executors, so that few other texts are shuffled."""
        width = self.width

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part = batch.slice(at, 256)
                    yield pa.RecordBatch.from_arrays([part.column("_key"), _lists([shingles(t.as_py(), width) for t in part.column("_text")])], ["id", "set"])

        place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE))
        sieve = met.select(place("node").alias("place")).distinct()
        kept = self.rows.join(F.broadcast(sieve), place("_key") == F.col("place"), "left_semi")
        sets = kept.mapInArrow(whole, "id long, set array<bigint>")
        copies = sets.join(met, sets["id"] == met["node"]).groupBy("node", F.xxhash64("set").alias("h"))
        return copies.agg(F.first("set").alias("set")).drop("h")

    def __call__(self, wanted: DataFrame) -> DataFrame:
        about = lambda c: self.nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("odd").alias(f"odd_{c}"))
        unlike = _unlike("odd_a", "odd_b")
        both = F.col("size_a") + F.col("size_b")
        close = wanted.distinct().join(about("a"), "a").join(about("b"), "b").where(unlike <= _differing_share(self.similarity) * both + 1e-6)
        close = written(close.select("a", "b", "size_b"))
        if close.isEmpty():
            return close.select("a", "b")
        met = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
        sets = written(self._sets(materialize(met)))
        # a node's set is sent once for so many shingles of its partners
        salts = close.groupBy("a").agg(F.ceil((F.sum("size_b") + 1) / SHINGLES).alias("salts"))
        dealt = close.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
        theirs = dealt.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        own = dealt.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        common = F.size(F.array_intersect("set_a", "set_b"))
        similar = common / (F.size("set_a") + F.size("set_b") - common) >= self.similarity
        return written(theirs.join(own, ["a", "salt"]).where(similar).select("a", "b"))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its group of near copies, with the columns of ``docs``.

    Rows that share an id are one document: they stay if the id stands for the group of any of its texts. Rows with a null
    id cannot be named as a representative and stay.
    """
    found = near_copies(docs, id_col, text_col, width, similarity)
    stays = F.max((F.col("_key") == F.col("component_id")).cast("int"))
    gone = materialize(found.groupBy("_key").agg(stays.alias("stays")).where("stays = 0").select("_key"))
    return docs.join(gone, docs[id_col] == gone["_key"], "left_anti")
