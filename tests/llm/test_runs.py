"""Periodic runs against a plain search of every period, and on odd rows."""

import hashlib
import random
import zlib

import pytest

from talktable.llm import queries, runs


def plain_runs(words, min_length, min_exponent):
    n, found = len(words), []
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(min_length, min_exponent * p):
                part = words[i:i + size]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    found.append((i, size, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def looped(rng, n, letters):
    words = [f"w{rng.randrange(letters)}" for _ in range(n)]
    if n > 5 and rng.random() < 0.7:
        a, p = rng.randrange(n), rng.randint(1, 9)
        words = [w if i < a else words[min(n - 1, a + (i - a) % p)] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("min_length,min_exponent", [(2, 2), (5, 2), (6, 3), (24, 3), (9, 4)])
def test_runs_of_random_words(min_length, min_exponent):
    rng = random.Random(min_length)
    for _ in range(400):
        words = [w.encode() for w in looped(rng, rng.randint(0, 70), rng.randint(1, 4))]
        found, kept = runs.text_runs(words, min_length, min_exponent)
        assert found == plain_runs(words, min_length, min_exponent)
        assert b" ".join(kept).decode() == plain_row([w.decode() for w in words], found)


def test_nested_and_long_runs():
    inner = ["a", "b"] * 12 + ["c"]
    found, _ = runs.text_runs([w.encode() for w in inner * 4])
    assert found == plain_runs(inner * 4, 24, 3) and len(found) == 5
    long = [f"x{i}" for i in range(7000)] + [f"y{i % 997}" for i in range(20_000)]
    assert runs.text_runs([w.encode() for w in long])[0] == [(7000, 20_000, 997)]
    assert runs.text_runs([b"z"] * 100_000)[0] == [(0, 100_000, 1)]


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "é x " * 12), (5, "é x " * 11 + "é"), (6, "go " * 30), (6, "go " * 30), (None, "a b c " * 9),
       (7, "a\x85b " * 30), (8, "one " * 60_000)]


def test_odd_rows_and_clashing_columns(make):
    docs = make(ODD, extra=["runs", "collapsed", "_key", "n_words"])
    got = {}
    for r in runs.periodic_runs(docs).collect():
        got.setdefault(r["_key"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    assert got[1] == got[2] == got[3] == [(0, [], "")]
    assert got[4] == [(24, [(0, 24, 2)], "é x")]
    assert got[5] == [(23, [], " ".join(["é x"] * 11 + ["é"]))]
    assert got[6] == [(30, [(0, 30, 1)], "go")] * 2
    assert got[None] == [(27, [(0, 27, 3)], "a b c")]
    assert got[7] == [(30, [(0, 30, 1)], "a\x85b")]
    assert got[8] == [(60_000, [(0, 60_000, 1)], "one")]
    assert runs.periodic_runs(make([])).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, min_exponent=1)


def plain_query(doc_id, text):
    words = (text or "").encode().split()
    words, n = [w.decode() for w in words], len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words, 24, 3)
    best = (None, None, None, None)
    if found:
        s, m, p = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
        best = (s, m, p, 1000 * m // p)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, digest("".join(f"{s},{m},{p}\n" for s, m, p in found)), digest(plain_row(words, found)))


def test_query(spark, make, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(looped(rng, rng.randint(0, 130), 400))) for i in range(300)] + [(500, None), (501, ""), (502, "ab\ncd\tef " * 20)]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(tuple(r) for r in got.collect())
    assert got == sorted(plain_query(i, t) for i, t in rows)
    assert sum(r[1] > 0 for r in got) > 50
