"""The stages of the corpus pipeline on small documents, and near copies of texts."""

import random

import corpus_pipeline
from talktable.llm import simhash

WORDS = [f"{a}{b}{c}" for a in "bdklmp" for b in "aeiou" for c in "nrst"]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def similar(a, b, width=5):
    sets = [{tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_of_texts(make):
    rng = random.Random(1)
    rows = []
    for g in range(40):
        words = prose(rng, 200).split()
        rows.append((10 * g, " ".join(words)))
        for k in range(1, 4):
            other = list(words)
            for at in rng.sample(range(200), k):
                other[at] = "changed"
            rows.append((10 * g + k, " ".join(other)))
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "One"), (None, "one")]
    text = dict(rows)
    for cap in (2, 128):
        got = {r._key: r.component_id for r in simhash.near_copies(make(rows), cap=cap).collect()}
        assert set(got) == {i for i, _ in rows if i is not None}
        for g in range(40):
            for k in range(1, 4):
                if similar(text[10 * g], text[10 * g + k]) >= 0.82:
                    assert got[10 * g + k] == 10 * g
        assert all(got[i] // 10 * 10 == i // 10 * 10 for i in got if i < 1000)
        assert got[1001] == 1000 and got[1003] == 1002
    assert simhash.near_copies(make([])).count() == 0


def test_near_copies_at_the_threshold_in_tables_of_two_sizes(make):
    """Pairs of similarity 0.79, 0.80 and 0.81, and of short texts; more texts around change nothing."""
    rng = random.Random(3)
    rows, linked = [], {}
    for k in range(60):
        whole, shift = [f"{k}w{i}" for i in range(240)], (21, 20, 19)[k % 3]
        a, b = (" ".join(whole[at:at + 204 - shift]) for at in (0, shift))
        assert round(100 * similar(a, b)) == 79 + k % 3
        rows += [(2 * k, a), (2 * k + 1, b)]
        linked[2 * k + 1] = k % 3 > 0
    for k in range(60, 90):
        whole, n = [f"{k}s{i}" for i in range(20)], 7 + k % 2
        rows += [(2 * k, " ".join(whole[:8])), (2 * k + 1, " ".join(whole[:n]) + (" end" if n == 8 else ""))]
        linked[2 * k + 1] = similar(rows[-2][1], rows[-1][1]) >= 0.8
    assert sum(linked.values()) == 55
    for more in (0, 3000):
        table = rows + [(1000 + i, prose(rng, 30)) for i in range(more)]
        for cap in (1, 8):
            got = {r._key: r.component_id for r in simhash.near_copies(make(table), cap=cap).collect()}
            assert {i: got[i] == i - 1 for i in linked} == linked
            assert all(got[i] == i for i in got if i not in linked)


def test_near_copies_of_one_frequent_line(make, monkeypatch):
    """A line of most texts makes long lists of unlike texts; the blocks give what all pairs give."""
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = random.Random(4)
    line, rows = prose(rng, 30), []
    for i in range(60):
        rows.append((i, line + " " + (prose(rng, 6) if i % 3 else rows[i - 3][1][len(line):] + " x" if i else "y")))
    root = list(range(60))
    for a in range(60):
        for b in range(a):
            if similar(rows[a][1], rows[b][1]) >= 0.8 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    for cap in (2, 8):
        assert {r._key: r.component_id for r in simhash.near_copies(make(rows), cap=cap).collect()} == dict(enumerate(root))


def tables(spark, tmp_path):
    rng = random.Random(2)
    shared = prose(rng, 60)
    good = {i: prose(rng, 40) + "\n" + prose(rng, 30) for i in range(60)}
    good[5] += "\n" + shared
    good[6] += "\n" + shared
    good[50], good[51] = good[7], good[8].replace("\n", " \n")
    rows = [(i, t) for i, t in good.items()] + [(100 + i, "bla " * 60) for i in range(20)] + [(200, None), (201, "")]
    spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return good, shared


def test_stages(spark, tmp_path):
    good, shared = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, at = docs.columns, 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/stage{at}")
        docs = spark.read.parquet(f"{tmp_path}/stage{at}")
        assert docs.columns == columns, name
        at += 1
        rows = {r.doc_id: r.text for r in docs.collect()}
        assert not any(100 <= i < 200 for i in rows)
        assert set(range(50)) <= set(rows)
        if name != "quality classifier":
            assert not {50, 51} & set(rows)
        if name == "substring dedup":
            assert shared in rows[5] and shared not in rows[6]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(rows)
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_stages_on_odd_tables(spark, tmp_path, make):
    """Nulls, repeated ids, clashing names and an empty table pass every stage."""
    tables(spark, tmp_path)
    text = "some words that make a line of a document in the corpus here"
    rows = [(1, text), (1, text), (2, text + " once"), (3, None), (3, ""), (None, text), (None, None), (4, " \n ")]
    for table in (rows, []):
        docs = make(table, extra=["_key", "_score", "score", "removed", "_text", "node", "digest", "ids"])
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert all(r.removed == "mine" and r._key == "mine" for r in out.collect())
            docs = out
        left = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
        if table:
            # documents 1 and 2 share eight shingles of nine; blank texts are one group, whose first is document 3
            assert [i for i, _ in left] == [0, 0, 1, 1, 3, 3]
        else:
            assert left == []
        assert corpus_pipeline.STAGES[0][1](spark, make(table, extra=["_score", "score"]), str(tmp_path)).columns == make(table, extra=["_score", "score"]).columns
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert {r.doc_id or 0 for r in packed.collect()} == {i for i, _ in left}


def test_an_id_with_two_texts_stays_while_one_of_them_does(make):
    rng = random.Random(8)
    a, b = prose(rng, 40), prose(rng, 40)
    kept = simhash.keep_representatives(make([(1, a), (2, a), (2, b), (3, b)]))
    # document 2 stands for the group of its second text
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (2, a), (2, b)])


def test_long_texts_that_differ_are_told_apart_before_their_sets_are_fetched(make):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(9000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:8900])), (3, " ".join(base[:5000] + [f"x{i}" for i in range(4000)]))]
    got = {r._key: r.component_id for r in simhash.near_copies(make(rows), cap=1).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    import numpy as np

    for n in (10, 2100, 9000):
        one = np.array(rng.sample(range(1 << 60), n), np.int64)
        two = np.concatenate([one[: n * 9 // 10], np.array(rng.sample(range(1 << 60), n // 5), np.int64)])
        p, q = (simhash.parities(x).view(np.uint64) for x in (one, two))
        words = min(len(p), len(q))
        apart = int(np.bitwise_count(simhash.folded(p, words) ^ simhash.folded(q, words)).sum())
        assert 0 < apart <= len(set(one.tolist()) ^ set(two.tolist()))
