"""Operators on texts, against plain versions and on odd rows."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from talktable.llm import licenses, packing, pieces, quality, simhash, substring, suffixes, tokens

LONG = "word " * 30_000
ODD = [(1, None), (2, ""), (3, " \n\n "), (4, "naïve 漢字 😀 ▁ text"), (5, LONG), (None, "no id here at all, none"), (6, "same"), (6, "same")]
WORDS = [f"{a}{b}{c}" for a in "bdkl" for b in "aeiou" for c in "nrst"]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


# repeated lines


def lines_kept(rows, min_words):
    seen, out = set(), {}
    for i, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            form = " ".join(line.lower().split())
            if form.count(" ") + 1 >= min_words and form in seen:
                continue
            seen.add(form)
            kept.append(line)
        out[i] = kept
    return out


def test_repeated_lines_keep_the_first(make):
    rng = random.Random(1)
    pool = [prose(rng, rng.randint(1, 9)) for _ in range(40)]
    rows = [(i, "\n".join(rng.choices(pool, k=8))) for i in range(60)]
    got = {r.doc_id: r for r in substring.drop_repeated_units(make(rows)).collect()}
    want = lines_kept(rows, 5)
    for i, text in rows:
        left = got[i].text.split("\n")
        assert [x for x in left if x] == want[i]
        cut = "".join(text[s.start:s.end] for s in got[i].removed)
        assert len(cut) + len(got[i].text) == len(text)


def test_repeated_lines_ignore_case_and_spaces(make):
    got = {r.doc_id: r.text for r in substring.drop_repeated_units(make([(2, "x\nOne  two three FOUR five\ny"), (1, "one two three four five")])).collect()}
    assert got == {1: "one two three four five", 2: "x\ny"}


def test_repeated_lines_odd_rows(make):
    got = substring.drop_repeated_units(make(ODD, extra=["removed", "digest", "start"]))
    assert got.count() == len(ODD) and dict(got.dtypes)["start"] == "string"
    assert {(r.doc_id, r.text) for r in got.collect()} == set(ODD)
    # of seven words said 3,000 times about one passage stays
    loop = "al be cu do el fi ga " * 3_000
    left = substring.drop_repeated_units(make([(1, loop)])).first().text
    assert left == substring.without(loop, plain_cuts([(1, loop)], 24)[1]) and 24 <= len(left.split()) < 60
    assert substring.drop_repeated_units(make([])).count() == 0


def plain_cuts(rows, least, min_words=5, min_bytes=32):
    """Removed spans by comparing the forms themselves, first occurrences in order of (id, offset)."""
    import re

    units = []
    for i, text in rows:
        at = 0
        for line in text.split("\n"):
            form, end = " ".join(line.lower().split()), min(len(text), at + len(line) + 1)
            if form and (form.count(" ") + 1 >= min_words or len(form.encode()) >= min_bytes):
                units.append((i, at, end, "line " + form))
            at = end
        words = list(re.finditer(r"[^\x20\x09-\x0d]+", text))
        h = [sum(m.group().lower().encode()) for m in words]
        cuts = [k for k in range(len(words) + 1) if k in (0, len(words)) or k > 1 and ((h[k - 2] * 31 + h[k - 1]) * 2654435761 >> 16) % 4 == 0]
        for a in cuts:
            b = next((c for c in cuts if c >= a + least), None)
            if b is not None:
                units.append((i, words[a].start(), words[b - 1].end(), " ".join(m.group().lower() for m in words[a:b])))
    firsts, gone = {}, {i: [] for i, _ in rows}
    for i, s, e, form in sorted(units):
        first = firsts.setdefault(form, (i, e))
        if i > first[0] or s >= first[1]:
            gone[i].append({"start": s, "end": e})
    return {i: substring.merged(sorted(g, key=lambda x: (x["start"], x["end"]))) for i, g in gone.items()}


@pytest.mark.parametrize("passage", [6, 24])
def test_passages_inside_lines_are_cut(make, passage):
    rng = random.Random(passage)
    shared = [prose(rng, rng.randint(8, 90)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randint(0, 40))]
        for text in rng.sample(shared, rng.randint(0, 3)):
            parts += [text.upper() if rng.random() < 0.2 else text, prose(rng, rng.randint(0, 30))]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(parts)))
    want = plain_cuts(rows, passage)
    for r in substring.drop_repeated_units(make(rows), passage=passage).collect():
        text = dict(rows)[r.doc_id]
        assert [tuple(x) for x in r.removed] == want[r.doc_id]
        assert r.text == substring.without(text, want[r.doc_id])
    cut = sum(e - s for spans in want.values() for s, e in spans)
    assert cut > 0.15 * sum(len(t) for _, t in rows)


def test_most_of_a_repeated_passage_goes(make):
    rng = random.Random(9)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 30) + " " + passage + " " + prose(rng, 30)) for i in range(20)]
    for r in substring.drop_repeated_units(make(rows)).collect():
        assert r.removed == [] if r.doc_id == 0 else sum(x.end - x.start for x in r.removed) >= 0.7 * len(passage)


def test_lines_without_spaces_count_by_bytes(make):
    line = "数据清洗流程会把重复的段落从语料中删除" * 3
    got = {r.doc_id: r.text for r in substring.drop_repeated_units(make([(1, line), (2, "a\n" + line), (3, "短\nb"), (4, "短")])).collect()}
    assert got == {1: line, 2: "a\n", 3: "短\nb", 4: "短"}


def test_texts_of_one_id_are_cut_where_they_repeat(make):
    line = "one two three four five six"
    got = substring.drop_repeated_units(make([(1, line), (2, line + "\nx"), (2, "y\n" + line)], extra=["_key", "removed", "_of"]))
    assert sorted((r.doc_id, r.text, r._key, r._of) for r in got.collect()) == [(1, line, "mine", "mine"), (2, "x", "mine", "mine"), (2, "y\n", "mine", "mine")]


# repeated bytes


def bytes_kept(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            w = data[at:at + length]
            if w in seen:
                gone[at:at + length] = True
            seen.add(w)
        out[i] = bytes(np.frombuffer(data, np.uint8)[~gone])
    return out


@pytest.mark.parametrize("hot", [1 << 20, 300])
def test_repeated_bytes(make, monkeypatch, hot):
    rng = random.Random(hot)
    passage = prose(rng, 30)
    rows = [(i, prose(rng, 20) + passage[rng.randint(0, 40):rng.randint(90, 140)] + prose(rng, 12)) for i in range(40)]
    rows += [(50, "aba" * 70), (51, "é" * 200), (52, rows[3][1]), (53, rows[3][1]), (54, "x" * 99), (55, "x" * 100), (56, "x" * 100)]
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "SHARD", 400)
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    got = {r._key: r for r in suffixes.drop_repeats(make(rows), length=60).collect()}
    want = bytes_kept(rows, 60)
    for i, text in rows:
        assert bytes(got[i].kept) == want[i], i
        assert sum(s.end - s.start for s in got[i].spans) == len(text.encode()) - len(want[i])


def test_merged_transform_is_the_sorted_one():
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, 30).astype(np.uint8)) for _ in range(9)]
    for shard in (20, 90, 1000):
        row, at, group = suffixes.repeated_starts(strings, 7, shard_bytes=shard)
        found = {}
        for r, a, g in zip(row, at, group):
            found.setdefault(g, set()).add(strings[r][a:a + 7])
        assert all(len(v) == 1 for v in found.values())
        windows = [s[i:i + 7] for s in strings for i in range(24)]
        assert len(row) == sum(windows.count(w) > 1 for w in windows)


def test_repeated_bytes_odd_rows(make):
    got = {(r._key, bytes(r.kept)) for r in suffixes.drop_repeats(make(ODD, extra=["spans", "kept"])).collect()}
    long_left = (LONG[:104]).encode()
    assert {k for k, _ in got} == {i for i, _ in ODD}
    assert (1, b"") in got and (6, b"same") in got and (None, b"no id here at all, none") in got
    assert next(v for k, v in got if k == 5) == bytes_kept([(5, LONG[:1000])], 100)[5] == long_left[:len(bytes_kept([(5, LONG[:1000])], 100)[5])]
    assert suffixes.drop_repeats(make([])).count() == 0


# quality


def test_pairwise_model_orders_and_cuts():
    rng = random.Random(4)
    good = [prose(rng, 40) for _ in range(60)]
    bad = [" ".join(w + "$$$" for w in prose(rng, 40).split()) for _ in range(20)]
    x = np.array([quality.features(t) for t in good + bad])
    model = quality.fit_pairs(x, np.array([1] * 60 + [0] * 20), pairs=5000)
    s = model.score(x)
    assert (s[:60] >= 0.5).all() and (s[60:] < 0.5).all()
    one = quality.fit_pairs(x, np.ones(80, int))
    assert (one.score(x) >= 0.5).all()


def test_pairwise_fit_is_that_of_plain_gradient_steps():
    """The same pairs, the loss written out, small steps along its gradient."""
    rng = random.Random(6)
    good = [prose(rng, rng.randint(5, 80)) + rng.choice(["", ".", " 12"]) for _ in range(40)]
    bad = [rng.choice(["bla ", "!!! ### ", "word "]) * rng.randint(2, 40) + prose(rng, rng.randint(0, 30)) for _ in range(25)]
    x, y = np.array([quality.features(t) for t in good + bad]), np.array([1] * 40 + [0] * 25)
    pairs, ridge = 400, 0.05
    model = quality.fit_pairs(x, y, pairs=pairs, ridge=ridge, seed=3)
    z = np.concatenate([x, np.sqrt(x)], axis=1)
    spread = z.std(0)
    z = (z - z.mean(0)) / np.where(spread < 1e-9, 1.0, spread)
    draw = np.random.default_rng(3)
    d = z[draw.choice(np.flatnonzero(y == 1), pairs)] - z[draw.choice(np.flatnonzero(y == 0), pairs)]
    w = np.zeros(z.shape[1])
    step = 1 / (ridge + 0.25 * np.linalg.eigvalsh(d.T @ d / pairs).max())
    for _ in range(20_000):
        w -= step * (ridge * w - (d / (1 + np.exp(d @ w))[:, None]).mean(0))
    assert np.allclose(model.weights, w, atol=1e-6)
    scores = np.sort(z @ w)
    assert abs(model.threshold - (scores[24] + scores[25]) / 2) < 1e-5
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(z @ w - model.threshold))), atol=1e-5)


def test_of_several_texts_of_an_id_the_first_is_learned_from(spark, make):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = [(i, "a good long text of words " * 3 if i % 2 else "!! ## !!") for i in range(60)]
    more = [(i, "zzz zz z") for i in range(60)]
    assert (quality.train(make(rows), labels).weights == quality.train(make(more + rows), labels).weights).all()


def test_quality_on_tables(spark, make):
    rng = random.Random(5)
    rows = [(i, prose(rng, 30) if i % 4 else "bla " * 30) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(150)] + [(None, 1), (7, None)], "doc_id long, quality int")
    docs = make(rows + ODD, extra=["score", "_y"])
    model = quality.train(docs, labels)
    got = quality.score(docs, model)
    assert got.count() == len(rows + ODD) and got.columns.count("score") == 1
    right = got.where("doc_id >= 150 and doc_id < 200").select((F.col("score") >= 0.5) == (F.col("doc_id") % 4 > 0)).collect()
    assert all(r[0] for r in right)
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {r[0] for r in make(rows).where(quality.held_out()).select("doc_id").collect()} == held
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.train(docs, flipped).weights == model.weights).all()
    assert quality.keep_good(make([]), labels).count() == 0


def test_every_labelled_document_is_learned_from(spark, make, monkeypatch):
    """All pairs of the documents that are not held out, in one block and in many; the cut is that of all scores."""
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(5, 60)) if i % 9 else "bla !! " * rng.randint(1, 30) + prose(rng, 5)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(300)], "doc_id long, quality int")
    kept = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    x, y = np.array([quality.features(t) for _, t in kept]), np.array([int(i % 9 > 0) for i, _ in kept])
    z = np.concatenate([x, np.sqrt(x)], axis=1)
    spread = z.std(0)
    z = (z - z.mean(0)) / np.where(spread < 1e-9, 1.0, spread)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    model, local = quality.train(make(rows), labels), quality.fit_pairs(x, y)
    slope = 1e-3 * model.weights - (d / (1 + np.exp(d @ model.weights))[:, None]).mean(0)
    assert np.abs(slope).max() < 1e-7 and np.allclose(model.weights, local.weights, atol=1e-6)
    scores = np.sort(z @ model.weights)
    at = int((y == 0).sum())
    assert abs(model.threshold - (scores[at - 1] + scores[at]) / 2) < 1e-9
    # small blocks: each document is in one with both labels, those of the rarer label in several
    monkeypatch.setattr(quality, "BLOCK", 20)
    monkeypatch.setattr(quality, "RARE", 12)
    measured = spark.createDataFrame([(i, int(b), a.tolist()) for (i, _), a, b in zip(kept, x, y)], "_key long, y int, x array<double>")
    met = [[(r["_key"], r["y"]) for r in b["rows"]] for b in quality.blocks(measured, len(y) - at, at).collect()]
    assert len(met) > 5 and all({1, 0} == {label for _, label in b} for b in met)
    assert {k for b in met for k, _ in b} == {i for i, _ in kept}
    many = quality.train(make(rows), labels)
    assert ((many.score(x) >= 0.5) == (model.score(x) >= 0.5)).mean() > 0.95


# token counts


def test_longest_match_counts():
    rng = random.Random(6)
    for _ in range(40):
        vocabulary = {"".join(rng.choices("abc", k=rng.randint(1, 5))).encode() for _ in range(8)} | {b"a", b"b"}
        machine = tokens.LongestMatch(vocabulary)
        for _ in range(30):
            word = "".join(rng.choices("abc", k=rng.randint(0, 14))).encode()
            at = n = 0
            while at < len(word):
                size = next((k for k in range(5, 0, -1) if word[at:at + k] in vocabulary and at + k <= len(word)), 0)
                if not size:
                    n = 1
                    break
                at, n = at + size, n + 1
            assert machine.count(word) == n, (vocabulary, word)


def test_token_counts_odd_rows(make, byte_file):
    got = {(r.doc_id, r.n_tokens, r.n_bytes) for r in tokens.count_tokens(make(ODD, extra=["n_tokens", "_measured"]), byte_file).collect()}
    assert (1, 0, 0) in got and (2, 0, 0) in got
    assert next(n for i, n, _ in got if i == 5) >= 30_000
    assert tokens.count_tokens(make([]), byte_file).count() == 0


# licences


def test_licences(make):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and files. "
           "The above copyright notice and this permission notice shall be included in all copies. "
           "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. More.")
    rows = [(1, mit), (2, "Intro.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0. End"), (3, "Licensed under the Foo Licence."), (4, "plain text")]
    got = {r.doc_id: (r.licenses, r.n_unknown, r.sentence_ids) for r in licenses.scan_licenses(make(rows)).collect()}
    assert got[1] == (["MIT"], 0, ["MitGrant", "MitNotice", "MitAsIs"])
    assert got[2] == (["MIT", "CC-BY-NC-4.0"], 0, ["MitName", "CcByNc"])
    assert got[3] == ([], 1, ["Unknown"]) and got[4] == ([], 0, [])


def test_licence_tables_and_odd_rows(make):
    known = {name for name, _ in licenses.SENTENCES}
    assert all(set(run) <= known for _, run in licenses.RULES)
    assert known == {i for _, run in licenses.RULES for i in run if len(run) == 1} | {i for _, run in licenses.RULES for i in run}
    assert all(any(h in words for h in licenses.HINTS) for _, words in licenses.SENTENCES)
    got = licenses.scan_licenses(make(ODD, extra=["licenses"]))
    assert got.count() == len(ODD) and got.where("size(licenses) <> 0").count() == 0
    assert licenses.scan_licenses(make([])).count() == 0


# pieces


def test_viterbi_finds_the_best_score():
    rng = random.Random(7)
    for _ in range(30):
        texts = list({"".join(rng.choices("ab▁", k=rng.randint(1, 3))) for _ in range(9)})
        table = [(f"<{b}>", None, b) for b in range(256)] + [(t, -rng.random() * 5, None) for t in texts]
        model = pieces.Unigram(table)
        scores = {t: s for t, s, _ in table if s is not None}

        def best(unit):
            top = [0.0] + [-math.inf] * len(unit)
            for j in range(1, len(unit) + 1):
                for i in range(max(0, j - 3), j):
                    s = scores.get(unit[i:j], model.unknown if j - i == 1 else -math.inf)
                    top[j] = max(top[j], top[i] + s)
            return top[-1]

        for _ in range(20):
            unit = "".join(rng.choices("ab▁c", k=rng.randint(1, 9)))
            ids, score = model.best(unit)
            assert math.isclose(score, best(unit))
            text = unit.replace("▁", " ")
            assert model.decode(np.frombuffer(model.encode(text), "<i4").tolist()) == text


def test_pieces_round_trip(make, piece_file):
    rows = ODD + [(9, "  two  spaces▁marker \u0000\t"), (10, "<s> </s> <0x41>")]
    coded = pieces.encode(make(rows, extra=["ids", "decoded"]), piece_file)
    got = pieces.decode(coded, piece_file, out="decoded").collect()
    assert len(got) == len(rows) and all(r.decoded == (r.text or "") for r in got)
    assert pieces.decode(pieces.encode(make([]), piece_file), piece_file).count() == 0


def test_double_array_is_the_vocabulary():
    rng = random.Random(8)
    words = sorted({bytes(rng.choices(range(256), k=rng.randint(1, 4))) for _ in range(3000)})
    trie = pieces.DoubleArray(words)
    for value, word in enumerate(words):
        s = 0
        for c in word:
            t = trie.base[s] + c + 1
            assert trie.check[t] == s
            s = t
        assert trie.value[s] == value


# packing


def expected_ids(texts, path):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    return [[*e.ids, 1] for e in coder.encode_batch(texts, add_special_tokens=False)]


def packed(frame, rows, path):
    ids = expected_ids([t or "" for _, t in rows], path)
    want = sorted((i is None, i or 0, tuple(x)) for (i, _), x in zip(rows, ids))
    got = frame.collect()
    of, used = {}, {}
    for r in got:
        assert r.length > 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        of.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    back = []
    for (i, n), parts in of.items():
        copies = sum(p.start == 0 for p in parts)
        assert sum(p.length for p in parts) == n * copies
        if copies == 1:
            parts.sort(key=lambda p: p.start)
            back.append((i is None, i or 0, struct.unpack(f"<{n}I", b"".join(bytes(p.ids) for p in parts))))
    once = [w for w in want if want.count(w) == 1]
    assert sorted(b for b in back) == once
    assert packing.padding([(r.sequence_id, r.length) for r in got], 64) == 0


def test_packing_is_exact_and_full(make, byte_file, monkeypatch):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(0, 120))) for i in range(80)] + [(100, "a  b \n c  d's don't "), (101, "<|endoftext|> x <|endoftext|>")]
    monkeypatch.setattr(packing, "FAN_IN", 2)
    packed(packing.pack(make(rows).repartition(5), byte_file, size=64, open_windows=3), rows, byte_file)


def test_ids_with_added_tokens_are_those_of_the_tokenizer_as_loaded(make, byte_file):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(byte_file)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b", " <|endoftext|> \n x", "a <|endoftext| > b", "plain  text ", ""]
    want = {i: [*coder.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 1]
    rows = packing.pack(make(list(enumerate(texts))), byte_file, added_tokens=True).orderBy("start").collect()
    got = {i: b"".join(bytes(r.ids) for r in rows if r.doc_id == i) for i in want}
    assert {i: list(struct.unpack(f"<{len(b) // 4}I", b)) for i, b in got.items()} == want
    assert all(r.doc_tokens == len(want[r.doc_id]) for r in rows)


def test_packing_odd_rows(make, byte_file):
    packed(packing.pack(make(ODD, extra=["length", "ids", "_key"]), byte_file, size=64), ODD, byte_file)
    assert packing.pack(make([]), byte_file).count() == 0


# simhash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots_of(n, linked):
    root = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    return root


def test_fingerprints_and_components(make):
    rng = random.Random(10)
    rows = []
    for i in range(60):
        base = prose(rng, 150).split()
        rows.append((3 * i, " ".join(base)))
        base[rng.randrange(150)] = "CHANGED"
        rows.append((3 * i + 1, " ".join(base).upper() if i % 2 else " ".join(base)))
    rows += [(200, None), (201, ""), (202, "one"), (203, "One two"), (204, "\t\n")]
    got = {r._key: r for r in simhash.near_duplicates(make(rows)).collect()}
    ids = sorted(i for i, _ in rows)
    text = dict(rows)
    prints = [plain_fingerprint(text[i]) for i in ids]
    roots = roots_of(len(ids), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for k, i in enumerate(ids):
        assert got[i].fingerprint == f"{prints[k]:016x}"
        assert got[i].component_id == ids[roots[k]]


@pytest.mark.parametrize("cap", [2, 256])
def test_links_connect_all_within_two_bits(spark, cap):
    rng = random.Random(cap)
    seeds = [rng.getrandbits(64) for _ in range(8)]
    prints = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for s in seeds for _ in range(40)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = {(r.a, r.b) for r in simhash.links(frame, cap).collect()}
    at = {p: i for i, p in enumerate(signed)}
    pairs = {(at[a], at[b]) for a, b in links}
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in pairs)
    assert roots_of(len(prints), lambda a, b: (a, b) in pairs or (b, a) in pairs) == roots_of(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)


def test_simhash_odd_rows(make):
    got = simhash.near_duplicates(make(ODD, extra=["fp", "_text"])).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r._key in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(make([])).count() == 0
    left = simhash.keep_representatives(make(ODD))
    assert sorted(left.columns) == sorted(make(ODD).columns)
    assert {r.doc_id for r in left.collect()} >= {1, 5, 6, None}

