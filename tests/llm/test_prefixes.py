"""The prefix trie against a dictionary of all beginnings, with small trees so that borders meet."""

import hashlib
import random
import zlib

import pytest

from talktable.llm import prefixes, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(talks):
    """Rows of the trie over {id: [(role, text)]}."""
    members = {}
    for key, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(key)
    children, leaves, saved = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = leaves.get(path, 0) or 1
        words = len(path[-1][1].encode().split()) if path else 0
        saved[path] = saved.get(path, 0) + (len(members[path]) - 1) * words
        if path:
            up = path[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[path]
            saved[up] = saved.get(up, 0) + saved[path]
    ends = {}
    for key, turns in talks.items():
        ends.setdefault(tuple(turns), []).append(key)
    digest = lambda path: hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children.get(p, 0), leaves[p], saved[p], digest(p)) for p, m in members.items()
    )


def rows_of(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def table(spark, talks, parts=3):
    rows = [(key, at, *turn) for key, turns in talks.items() for at, turn in enumerate(turns)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def random_talks(rng, n, first=0):
    """Many share the first turn, many are the same, some go on after others end, some differ late."""
    talks = {}
    for key in range(first, first + n):
        turns = [("system", "you are a bot")] if rng.random() < 0.6 else []
        turns += [(rng.choice("ua"), f"say {rng.randrange(3)} more") for _ in range(rng.randrange(7))]
        talks[key] = turns or [("u", "only " + "x " * rng.randrange(4))]
    return talks


@pytest.mark.parametrize("turns,neighbours", [(1, 4), (12, 3), (12, 64), (100_000, 64)])
def test_trie_equals_plain_trie(spark, turns, neighbours):
    talks = random_talks(random.Random(turns), 250)
    talks |= {1000 + i: [("system", "you are a bot"), ("u", "the same")] for i in range(90)}
    talks[2000] = [("u", f"turn {i}") for i in range(500)]
    talks[2001] = talks[2000][:300] + [("u", "else")]
    paths = prefixes.conversation_paths(table(spark, talks))
    assert rows_of(prefixes.prefix_nodes(paths, turns, neighbours)) == plain_trie(talks)


def test_layouts_grow():
    for n in (1, 4, 5, 16, 17, 48, 49, 256):
        keys = random.Random(n).sample(range(256), n)
        root = prefixes.radix_tree([bytes([k]) * 16 for k in keys], keys)
        assert [c.ends[0] for c in root.children()] == sorted(keys) and root.size == n
        assert all(root.child(k).ends == [k] for k in keys) and (n == 256 or root.child(next(k for k in range(256) if k not in keys)) is None)
        again = prefixes.radix_tree([bytes([k]) * 16 for k in keys * 2] + [bytes([k]) * 32 for k in keys], [*keys, *keys, *keys])
        assert all(again.child(k).ends == [k, k] for k in keys)


def test_odd_rows(spark):
    rows = [(None, 0, "u", "lost"), (1, None, None, None), (1, 0, "u", "a  b\tc"), (2, 0, "", ""), (2, 1, "u", "a  b\tc"), (3, 5, "u", "x"), (3, 5, "u", "x"),
            (-4, 0, "u", "word " * 50_000), (5, 0, "ab", "c"), (6, 0, "a", "bc")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("path", "words", "depth", "part", "n_convs"):
        docs = docs.selectExpr("*", f"'mine' AS {name}")
    talks = {1: [("", ""), ("u", "a  b\tc")], 2: [("", ""), ("u", "a  b\tc")], 3: [("u", "x")] * 2, -4: [("u", "word " * 50_000)], 5: [("ab", "c")], 6: [("a", "bc")]}
    assert [tuple(r) for r in rows_of(prefixes.prefix_trie(docs))] == [tuple(r) for r in plain_trie(talks)]
    assert prefixes.prefix_trie(docs.where("conv_id = 99")).count() == 0


def test_query(spark, tmp_path):
    talks = random_talks(random.Random(3), 120, first=15)
    talks |= {200: [("u", "one")], 203: [("u", "two")], 405: [("u", "alone")]}
    table(spark, talks).write.parquet(str(tmp_path / "conversations.parquet"))
    rebuilt = {}
    for key, turns in talks.items():
        h = zlib.crc32(str(key).encode()) % 4
        rebuilt[key] = talks.get(key - key % 20, [])[:h] + turns[h:]
    assert any(not t for t in rebuilt.values())
    assert rows_of(queries.op13_prefixes(spark, str(tmp_path))) == plain_trie(rebuilt)
