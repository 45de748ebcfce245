"""Sub-word pieces by unigram Viterbi over a double-array trie, and back to text."""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from talktable.llm.common import with_column

SPACE = "▁"
_MODELS: dict = {}


class DoubleArray:
    """Trie as two integer arrays: the child of s by byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, words: list[bytes]):
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for value, word in enumerate(words):
            node = 0
            for c in word:
                if c not in tree[node]:
                    tree[node][c] = len(tree)
                    tree.append({})
                node = tree[node][c]
            ends[node] = value
        width = max([len(t) for t in tree] + [1])
        size = 2 * len(tree) + 1024
        used = np.zeros(size + 600, bool)
        base, check, value = np.zeros(size + 600, np.int32), np.full(size + 600, -1, np.int32), np.full(size + 600, -1, np.int32)
        used[0], place, starts, queue = True, {0: 0}, [0] * (width + 1), [0]
        for node in queue:
            at = place[node]
            value[at] = ends.get(node, -1)
            codes = sorted(tree[node])
            if not codes:
                continue
            # the search goes on where the last one for as many children ended
            b, span = starts[len(codes)], 1024
            while True:
                if b + span + 600 > len(used):
                    more = len(used)
                    used = np.concatenate([used, np.zeros(more, bool)])
                    base, check, value = (np.concatenate([x, np.full(more, fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                taken = np.zeros(span, bool)
                for c in codes:
                    taken |= used[b + c + 1:b + c + 1 + span]
                at_free = int(taken.argmin())
                if not taken[at_free]:
                    b += at_free
                    break
                b += span
            starts[len(codes)] = b
            base[at] = b
            for c in codes:
                check[b + c + 1], used[b + c + 1] = at, True
                place[tree[node][c]] = b + c + 1
                queue.append(tree[node][c])
        self.base, self.check, self.value = (array("i", x.tobytes()) for x in (base, check, value))


class Unigram:
    """Pieces with log scores. ``pieces``: (text, log score or None for pieces never matched, byte or None) by id."""

    def __init__(self, pieces: list[tuple[str, float | None, int | None]], remember: int = 800_000):
        self.pieces = pieces
        matched = [i for i, (text, score, _) in enumerate(pieces) if score is not None and text]
        self.trie = DoubleArray([pieces[i][0].encode() for i in matched])
        self.ids = matched
        self.scores = [pieces[i][1] for i in matched]
        # lists are read faster than arrays; the one of the child's place is added beforehand
        self.base, self.check = [b + 1 for b in self.trie.base], list(self.trie.check)
        self.gains = [self.scores[v] if v >= 0 else None for v in self.trie.value]
        self.byte_ids = {b: i for i, (_, _, b) in enumerate(pieces) if b is not None}
        self.unknown = (min(self.scores) if self.scores else 0.0) - 10.0
        self.raw = [b"" if s is None and b is None else bytes([b]) if b is not None else t.replace(SPACE, " ").encode()
                    for t, s, b in pieces]
        self.by_word = not any(SPACE in t.lstrip(SPACE) for t, s, _ in pieces if s is not None)
        self.remember = remember
        self.known: dict[str, bytes] = {}

    def best(self, unit: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation of ``unit``; a character without a piece becomes its bytes, a
        marker without one that of a space.

        Of equal scores the one whose last piece starts first is taken.
        """
        data, marker = unit.encode(), SPACE.encode()
        n = len(data)
        base, check, gains, value = self.base, self.check, self.gains, self.trie.value
        best, start, via = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            first = data[i]
            after = i + (1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4)
            here, s, j, whole = best[i], 0, i, False
            for c in data[i:]:
                t = base[s] + c
                if check[t] != s:
                    break
                s = t
                j += 1
                gain = gains[t]
                if gain is not None:
                    whole = whole or j == after
                    if here + gain > best[j]:
                        best[j], start[j], via[j] = here + gain, i, t
            if not whole and here + self.unknown > best[after]:
                best[after], start[after], via[after] = here + self.unknown, i, -1
            i = after
        out, at = [], n
        while at:
            i, t = start[at], via[at]
            out += [self.ids[value[t]]] if t >= 0 else [self.byte_ids[b] for b in reversed(data[i:at].replace(marker, b" "))]
            at = i
        return out[::-1], best[n]

    def _unit(self, unit: str) -> bytes:
        ids = self.known.get(unit)
        if ids is None:
            ids = np.array(self.best(unit)[0], "<i4").tobytes()
            if len(unit) <= 64:
                if len(self.known) >= self.remember:
                    self.known.clear()
                self.known[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit values. A space is put before the text; spaces are written as the marker.

        No piece holds a marker after another character, so the best segmentation is that of each word with
        the spaces before it. A marker in the text itself becomes bytes, so that decoding gives it back.
        """
        if not text:
            return b""
        literal = np.array([self.byte_ids[b] for b in SPACE.encode()], "<i4").tobytes()
        cut = re.compile(r" *[^ ]+| +").findall if self.by_word else lambda part: [part] if part else []
        unit = self._unit
        return literal.join(
            b"".join([unit(u.replace(" ", SPACE)) for u in cut(part)]) for part in (" " + text).split(SPACE)
        )

    def decode(self, ids) -> str:
        """Text of ids: bytes of all pieces, markers as spaces, without the first space. Wrong bytes become U+FFFD."""
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def read_pieces(path: str) -> list[tuple[str, float | None, int | None]]:
    """Pieces of a public model file, with Zipf log scores by their order in it.

    The file's own scores are merge ranks, no logarithms; the k-th piece gets log(1 / (k H)), the probability
    of rank k, which adds up to one.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    total = sum(1 / k for k in range(1, len(plain) + 1))
    scores = {i: -math.log(k * total) for k, i in enumerate(plain, 1)}
    byte = lambda i: int(model.id_to_piece(i)[1:-1], 16) if model.is_byte(i) else None
    return [(model.id_to_piece(i), scores.get(i), byte(i)) for i in range(n)]


def _model(pieces) -> Unigram:
    """One model per Python worker."""
    key = hash(tuple(pieces))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Unigram(pieces)
    return _MODELS[key]


def encode(docs: DataFrame, model_file: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``: array of the piece ids of the whole text.

    Null and empty texts give an empty array. A column ``out`` is replaced; rows may repeat; an empty table
    gives an empty one. The pieces are read on the driver and sent to the workers.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(model_file))

    def run(texts: pa.Array) -> pa.Array:
        model = _model(pieces.value)
        found = [model.encode(t.as_py() or "") for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(f) // 4 for f in found]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))

    return with_column(docs, text_col, out, T.ArrayType(T.IntegerType()), run)


def decode(rows: DataFrame, model_file: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with ``out``: the text of the ids. Null ids give null, none the empty text; ids must be the model's."""
    pieces = rows.sparkSession.sparkContext.broadcast(read_pieces(model_file))

    def run(ids: pa.Array) -> pa.Array:
        model = _model(pieces.value)
        return pa.array([None if i.values is None else model.decode(i.values.to_numpy(zero_copy_only=False).tolist()) for i in ids], pa.string())

    return with_column(rows, ids_col, out, T.StringType(), run)
