"""Token counts by greedy longest match, in one pass over the bytes and without building pieces."""

from __future__ import annotations

import json
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktable.llm.packing import byte_pieces

_COUNTERS: dict = {}


class LongestMatch:
    """Trie of a vocabulary with failure links and popped-token counts.

    A node stands for a string that starts some piece. Where the trie has no way on, the longest pieces that
    the string surely begins with are popped, and the failure link leads to the node of what is left of it.
    How many are popped is known beforehand, so a text of n bytes costs at most 2n steps.
    """

    def __init__(self, pieces):
        step: dict[int, int] = {}
        ends, parents = [False], [(0, 0)]
        for piece in sorted(set(pieces) - {b""}):
            node = 0
            for c in piece:
                key = node << 8 | c
                if key not in step:
                    step[key] = len(parents)
                    parents.append((node, c))
                    ends.append(False)
                node = step[key]
            ends[node] = True
        depth = [0] * len(parents)
        for v in range(1, len(parents)):
            depth[v] = depth[parents[v][0]] + 1
        fail, pops = [-1] * len(parents), [0] * len(parents)
        for v in sorted(range(1, len(parents)), key=depth.__getitem__):
            if ends[v]:
                fail[v], pops[v] = 0, 1
                continue
            u, c = parents[v]
            at, n = fail[u], pops[u]
            while at >= 0 and (at << 8 | c) not in step:
                n += pops[at]
                at = fail[at]
            if at >= 0:
                fail[v], pops[v] = step[at << 8 | c], n
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, data: bytes) -> int:
        """Number of longest-match tokens; 1 for a unit with a byte that no piece can take."""
        step, fail, pops = self.step, self.fail, self.pops
        node, n = 0, 0
        for c in data:
            to = step.get(node << 8 | c)
            while to is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                to = step.get(node << 8 | c)
            node = to
        while node > 0:
            n += pops[node]
            node = fail[node]
        return 1 if node < 0 else n


class WordCounts(dict):
    """Counts of words with the space before them; up to ``remember`` short words are kept."""

    def __init__(self, machine: LongestMatch, remember: int = 500_000):
        super().__init__()
        self.machine, self.remember = machine, remember

    def __missing__(self, word: str) -> int:
        n = self.machine.count(b" " + word.encode())
        if len(word) <= 64:
            if len(self) >= self.remember:
                self.clear()
            self[word] = n
        return n

    def text(self, text: str) -> tuple[int, int]:
        """(tokens, units) of a text: a unit runs up to the next space and has the space before it."""
        first, *rest = text.split(" ")
        head = self.machine.count(first.encode()) if first else 0
        return head + sum(map(self.__getitem__, rest)), len(rest) + bool(first)


def _counts(definition: str) -> WordCounts:
    """One automaton per Python worker."""
    key = zlib.crc32(definition.encode())
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = WordCounts(LongestMatch(byte_pieces(json.loads(definition)["model"]["vocab"])))
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_units`` and ``n_bytes`` of the whole text.

    A unit is a run of bytes without a space, with the one space before it; each further space is a unit. At
    each place of a unit the longest piece of the byte-level vocabulary in the file ``tokenizer`` is taken.
    Null and empty texts have zero of each. Columns of these names are replaced; rows may repeat; an empty
    table gives an empty one. The file is read on the driver and sent to the workers.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("struct<n_tokens:bigint,n_units:bigint,n_bytes:bigint>")
    def measure(texts: pa.Array) -> pa.Array:
        counts = _counts(definition.value)
        found = []
        for value in texts:
            text = value.as_py() or ""
            found.append((*counts.text(text), len(text.encode())))
        columns = list(zip(*found)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n_tokens", "n_units", "n_bytes"])

    made = ("n_tokens", "n_units", "n_bytes")
    rows = docs.withColumn("_measured", measure(F.col(text_col)))
    return rows.withColumns({c: F.col(f"_measured.{c}") for c in made}).drop("_measured")
