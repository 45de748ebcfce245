"""Literal cases of the column rules and of operators the given tables cannot trigger."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talktable.functions import text as T
from talktable.functions import times as C
from talktable.functions.vectors import agent_threshold, l2_normalize, snr_bucket
from talktable.operators import cluster, evaluate, frames, intervals, matching, roles, topk, vectors, words
from talktable.plans.identify import Settings, identify_calls
from talktable.sources import calls as S
from talktable.sources import registry as G
from talktable.sources import transcripts as X
from talktable.streaming.talk import stream_identify, stream_talk_time


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_seconds(spark):
    values = ["12.5", "1:02:03.5", "02:03", "7.25", "bad", None, "1:bad"]
    assert column(spark, values, C.to_seconds) == [12.5, 3723.5, 123.0, 7.25, 0.0, 0.0, 0.0]
    assert column(spark, ["02:03", "1:02:03.5"], lambda v: C.to_seconds(v, False)) == [0.0, 3723.5]


def test_agent_labels(spark):
    values = [None, "  ", "Customer", "customer", "Customer_2", "Ann", "Ann_3"]
    got = {m: column(spark, values, lambda v, m=m: C.is_agent_label(v, m)) for m in ("trimmed", "exact", "suffix", "contains")}
    assert got["trimmed"] == [False, False, False, False, True, True, True]
    assert got["exact"] == [False, True, False, True, True, True, True]
    assert got["suffix"] == [True, True, False, False, False, True, True]
    assert got["contains"] == [True, True, False, False, False, True, True]


def test_names_and_clocks(spark):
    assert column(spark, ["agent_ann_lee", "o'neil b2b"], C.clean_agent_name) == ["Ann Lee", "O'Neil B2B"]
    assert column(spark, [3723.4567, -2.0], C.clock_millis, "double") == ["01:02:03.457", "00:00:00.000"]
    assert column(spark, [65.9, 3605.0], C.clock_short, "double") == ["01:05", "01:00:05"]
    assert column(spark, ["  Ann  O'Hara! "], C.slug) == ["ann_o_hara"]


def test_text_rules(spark):
    assert column(spark, ["Is it?", "would you", "no", "go?", ""], T.looks_like_question) == [True, True, False, True, False]
    assert column(spark, ["All right", "Toronto", "two words", "", "abcdefghijklmnopq"], T.short_customer_reply) == [True, True, False, False, False]
    assert column(spark, ["Bye bye!", "good bye"], T.farewell) == [True, False]


def test_hallucinations(spark):
    share = "a a a a a a a a a b c d e f g h i j k l"  # 9 of 20 is 45 %, but in a row
    spread = "a b a c a d a e a f a g a h a i a j k l"  # 9 of 20, apart
    texts = ["...", "a a a a a", spread, spread.replace("k", "a"), "x y a a a z", "x y a a a a z", share]
    assert column(spark, texts, T.is_hallucination) == [True, False, False, True, True, True, True]


def cut_by_hand(text):
    w = text.split()
    if len(w) < 8:
        return text
    for n in (5, 4, 3, 2):
        for i in range(len(w) - n + 1):
            if any(w[j:j + n] == w[i:i + n] for j in range(i)):
                return " ".join(w[:i]) if i >= 4 else ""
    return "" if len(set(w)) / len(w) < 0.35 else text


def test_truncate_repetition(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n)) for k in (2, 5, 26) for n in (7, 8, 15, 60)]
    assert column(spark, texts, T.truncate_repetition) == [cut_by_hand(t) for t in texts]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_error_rate(spark):
    rng = random.Random(7)
    pairs = [("", ""), ("", "a"), ("a b", ""), ("a b c", "a b c"), ("a b c d", "a x c")]
    pairs += [(" ".join(rng.choices("abcdef", k=rng.randint(1, 90))), " ".join(rng.choices("abcdef", k=rng.randint(1, 90)))) for _ in range(80)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, ref string, hyp string")
    got = {r.i: r.wer for r in words.with_wer(df, "ref", "hyp").collect()}
    for i, (ref, hyp) in enumerate(pairs):
        r, h = ref.split(), hyp.split()
        want = edits(r, h) / len(r) if r else float(bool(h))
        assert abs(got[i] - want) < 1e-6


def test_thresholds_and_buckets(spark):
    assert column(spark, [None, "0.10", "0.33", "0.669", "x"], lambda v: agent_threshold(0.30, v)) == [0.3, 0.3, 0.38, 0.42, 0.3]
    assert column(spark, [20.0, 12.0, 11.9], snr_bucket, "double") == ["high", "mid", "low"]
    assert column(spark, [[0.0, 0.0], [3.0, 4.0]], l2_normalize, "array<float>") == [[0.0, 0.0], [0.6, 0.8]]


def turns(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "call_id int, turn_idx int, start_s double, end_s double, speaker string")


def test_merges(spark):
    t = turns(spark, [(0.0, 5.0, "a"), (1.0, 2.0, "a"), (2.5, 3.0, "a"), (3.6, 4.0, "a"), (4.0, 4.5, "b")])
    got = [(r.start_s, r.end_s) for r in intervals.merge_same_speaker(t).orderBy("island").collect()]
    assert got == [(0.0, 3.0), (3.6, 4.0), (4.0, 4.5)]
    b = turns(spark, [(0.0, 5.0, "a"), (1.0, 2.0, "a"), (6.0, 7.0, "a")])
    spans = lambda **k: [(r.start_s, r.end_s) for r in intervals.merge_blocks(b, 1.0, **k).orderBy("block").collect()]
    assert spans() == [(0.0, 7.0)]
    assert spans(inclusive=False) == [(0.0, 5.0), (6.0, 7.0)]


def test_dominant_speaker(spark):
    t = turns(spark, [(0.0, 2.0, "a"), (2.0, 4.0, "b"), (10.0, 11.0, "a")])
    s = spark.createDataFrame([(1, 0, 1.0, 3.0), (1, 1, 4.0, 5.0), (1, 2, 2.5, 200.0)], "call_id int, seg_idx int, start_s double, end_s double")
    got = {r.seg_idx: r.speaker for r in intervals.assign_dominant_speaker(s, t).collect()}
    assert got == {0: "a", 1: "UNKNOWN", 2: "b"}


def test_purity_buffer(spark):
    rows = [(1, 0, 0.0, 1.0, False), (1, 1, 3.0, 4.0, True), (1, 2, 2.9, 4.0, True), (2, 0, 0.0, 1.0, True), (1, 3, 50.0, 50.3, True)]
    p = spark.createDataFrame(rows, "call_id int, phrase_idx int, start_s double, end_s double, is_agent boolean")
    assert sorted((r.call_id, r.phrase_idx) for r in intervals.purity_filter(p, 2.0).collect()) == [(1, 1), (2, 0)]


def test_split_needs_words(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 10.0, "a b c d e f g h i j"), (1, 1, 20.0, 30.0, "a b c d")], "call_id int, seg_idx int, start_s double, end_s double, text string")
    t = spark.createDataFrame([(1, 1.0), (1, 5.0), (1, 22.0), (1, 23.0)], "call_id int, start_s double")
    got = [(r.seg_idx, r.text) for r in intervals.split_at_turns(s, t).orderBy("seg_idx", "part_idx").collect()]
    assert got == [(0, "a b c d e"), (0, "f g h i j"), (1, "a b c d")]


def test_keyword_role(spark):
    def winner(rows):
        df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "call_id int, seg_idx int, speaker string, text string")
        return [r.speaker for r in roles.keyword_role(df).collect()]

    assert winner([("A", "hello"), ("B", "hi")]) == []
    assert winner([("A", "My name is Ann"), ("B", "I need one")]) == ["A"]
    assert winner([("A", "my name is x"), ("B", "this is y")]) == []


def test_conversation_view(spark):
    rows = [
        (1, 0, 0.0, 5.0, "hi", "S0", "AGENT", "agent_ann", None, -0.3, 0.4), (1, 1, 5.0, 6.0, "yo", "S1", "AGENT", "agent_ann", None, 0.5, 0.4),
        (1, 2, 6.0, 7.0, "ok", "S2", "S2", None, None, 0.9, 0.0), (2, 0, 0.0, 1.0, "x", "S0", "S0", None, None, 0.9, 0.0),
    ]
    s = spark.createDataFrame(rows, "call_id int, seg_idx int, start_s double, end_s double, text string, speaker string, identified_speaker string, agent_name string, display_speaker string, confidence double, best_sim double")
    got = {(r.call_id, r.label): r.display_speaker for r in roles.label_roles(s).collect()}
    assert got == {(1, "S0"): "Agent (Ann)", (1, "S1"): "Customer 1", (1, "S2"): "Customer 2", (2, "S0"): "Customer"}


@pytest.fixture(scope="module")
def cloud(spark):
    """Two speakers per call around fixed directions."""
    rng = np.random.default_rng(2)
    base = np.eye(16)[:4] * 12
    rows, idx = [], 0
    for call in range(4):
        for i in range(24):
            v = base[0 if i % 3 else 1 + call % 3] + rng.normal(size=16)
            rows.append((call, i, i * 4.0, i * 4.0 + 3.5, "well then we go on", None if i % 8 == 7 else [float(x) for x in v]))
    return spark.createDataFrame(rows, "call_id int, seg_idx int, start_s double, end_s double, text string, embedding array<float>").cache(), base


def parts(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.call_id, r.cluster), set()).add(r.seg_idx)
    return sorted((k[0], sorted(v)) for k, v in out.items())


def test_large_groups_cluster_like_small_ones(cloud):
    s, _ = cloud
    small = cluster.cluster_groups(s, ["call_id"])
    large = cluster.cluster_groups(s, ["call_id"], group_rows=0)
    assert parts(small) == parts(large)
    assert all(len(p) in (7, 14) for _, p in parts(small))
    assert parts(cluster.choose_customer_k(s, ["call_id"])) == parts(cluster.choose_customer_k(s, ["call_id"], group_rows=0))


def test_split_covers_rows_without_vectors(cloud):
    s, _ = cloud
    got = cluster.two_speaker_split(s).collect()
    assert len(got) == s.count() and all(r.cluster is not None for r in got)


def test_registry_size_does_not_change_scores(spark, cloud):
    s, base = cloud
    reg = spark.createDataFrame([(f"a{i}", [float(x) for x in b]) for i, b in enumerate(base)], "agent_slug string, embedding array<double>")
    rows = lambda df: sorted((r.call_id, r.seg_idx, r.best_match, None if r.best_sim is None else round(r.best_sim, 9)) for r in df.collect())
    v = s.select("call_id", "seg_idx", "embedding")
    assert rows(matching.best_match(v, reg)) == rows(matching.best_match(v, reg, registry_bytes=0))


def test_identify_on_blocks_and_across_tasks(spark, cloud):
    s, base = cloud
    others = np.eye(16)[8:11]
    reg = spark.createDataFrame(
        [(f"agent_{i}", f"Agent {i}", [float(x) for x in b], "0.2") for i, b in enumerate([base[0], *others])],
        "agent_slug string, agent_name string, embedding array<double>, max_outside_sim string")
    rows, calls = identify_calls(s, reg)
    split, calls2 = identify_calls(s, reg, block_rows=5, window_rows=3, group_rows=0)
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(rows) == key(split) and key(calls) == key(calls2)
    got = rows.collect()
    assert len(got) == s.count() and all(r.display for r in got)
    assert {r.agent_slug for r in calls.collect()} == {"agent_0"}
    truth = sum((r.role == "AGENT") == (r.seg_idx % 3 != 0) for r in got if r.seg_idx % 8 != 7)
    assert truth / sum(r.seg_idx % 8 != 7 for r in got) > 0.95


def test_tighten_ignores_thin_passes(spark):
    rng = np.random.default_rng(1)
    near = lambda n, noise: [[float(x) for x in np.r_[1.0, rng.normal(size=7) * noise]] for _ in range(n)]
    far = [[-1.0] + [0.0] * 7] * 3
    rows = [("few", i, v) for i, v in enumerate(near(10, 0.1) + far)] + [("many", i, v) for i, v in enumerate(near(20, 0.1) + far)]
    df = spark.createDataFrame(rows, "g string, i int, embedding array<float>")
    kept = {r.g: (r.n, r.n_kept) for r in vectors.tighten(df, ["g"])[1].collect()}
    assert kept == {"few": (13, 13), "many": (23, 20)}


def test_top_fraction(spark):
    rows = [("a", float(i % 7) / 10) for i in range(20)] + [("b", 0.5), ("b", 0.1)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.k, round(r.top_mean, 6)) for r in topk.top_fraction_mean(df, ["g"], "x").collect()}
    best = sorted((x for g, x in rows if g == "a"), reverse=True)[:6]
    assert got == {"a": (6, round(sum(best) / 6, 6)), "b": (2, 0.3)}


def test_snr_of_silence(spark):
    df = spark.createDataFrame([(1, 0.0)] * 10 + [(2, 1.0)] * 5, "call_id int, rms double")
    got = {r.call_id: r.snr_db for r in frames.estimate_snr(df).collect()}
    assert got[2] == 0.0 and got[1] < 0


def test_recorded_evaluation(spark):
    counts = spark.createDataFrame([(1449, 332, 119, 315), (1431, 333, 118, 333), (933, 42, 409, 831)], "tp long, fp long, tn long, fn long")
    got = {r.tp: (r.precision, r.recall, r.f1) for r in evaluate.with_metrics(counts).collect()}
    assert got[1431] == (0.8112, 0.8112, 0.8112) and got[933] == (0.9569, 0.5289, 0.6813)
    assert round(got[1449][0], 3) == 0.814


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "Ann.json").write_text('[{"s3_url": "https://x.example/a/b1.mp3?k=1"}, {"s3_url": null}, {"s3_url": "https://x.example/a/b2.mp3"}]')
    got = S.read_manifests(spark, str(tmp_path / "m"), first=1).collect()
    assert [(r.agent_slug, r.file_name) for r in got] == [("agent_ann", "b1.mp3")]
    for name, body in (("r1", '{"model": "m", "total_segments": 3}'), ("r2", "{broken")):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "result.json").write_text(body)
    assert [(r.id, r.model) for r in S.read_runs(spark, str(tmp_path / "runs")).collect()] == [("r2", "unknown"), ("r1", "m")]
    segs = spark.createDataFrame([(1, "m", 1, "b"), (1, "m", 0, "a")], "call_id int, model string, seg_idx int, text string")
    docs = X.result_documents(segs, segs.select("call_id", "model").distinct())
    X.write_results(docs, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).collect()
    assert back[0].run_id == "1__m" and [s.text for s in back[0].segments] == ["a", "b"]
    agents = spark.createDataFrame([("a",), ("b",)], "agent_slug string")
    prints = spark.createDataFrame([("a", 2, [0.6, 0.8])], "agent_slug string, dim int, embedding array<double>")
    manifest = G.export_registry(agents, prints, str(tmp_path / "reg")).collect()[0]
    assert (manifest.agents, manifest.voiceprints, manifest.missing_agents) == (1, 1, 1)
    assert G.import_registry(spark, str(tmp_path / "reg")).count() == 1


def test_streams_equal_tables(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(1 + i % 2, t0 + timedelta(minutes=i), 0.0, float(i), "AGENT" if i % 3 else "CUSTOMER", [1.0, float(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "call_id int, arrived_at timestamp, start_s double, end_s double, identified_speaker string, embedding array<float>")
    df.write.parquet(str(tmp_path / "in"))
    reg = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "agent_slug string, embedding array<double>")
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, plan, mode in (("talk", lambda d: stream_talk_time(d, late="1 day"), "complete"), ("who", lambda d: stream_identify(d, reg, 0.9).drop("embedding"), "append")):
        q = plan(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, plan(df).collect()))


def test_index_of_lines_and_of_documents(spark, tmp_path):
    import json

    from talktable.sources.calls import broken_entries, read_calls

    entry = lambda i: {"_id": str(i), "agent_name": "Zoe", "horizon_call_s3_url": "s3://x", "speaker_json": [{"speaker": "Zoe", "phrase": "hi"}]}
    (tmp_path / "lines").mkdir()
    (tmp_path / "documents").mkdir()
    lines = [json.dumps(entry(i)) for i in range(5)]
    (tmp_path / "lines" / "a.json").write_text("\n".join([*lines[:3], "{broken", *lines[3:]]))
    (tmp_path / "documents" / "a.json").write_text("[" + ",\n".join(lines) + "]")
    ids = {str(i) for i in range(5)}
    for form in ("lines", "documents"):
        read = read_calls(spark, str(tmp_path / form), form.replace("documents", "document"))
        assert {r.call_id for r in read.collect()} == ids
    assert [r.broken for r in broken_entries(spark, str(tmp_path / "lines"), "lines").collect()] == [1]
    assert broken_entries(spark, str(tmp_path / "documents"), "document").count() == 0


def test_blank_turns_share_no_word(spark):
    from talktable.functions.text import norm_punct
    from talktable.operators.words import content_matches, with_wer

    turn = "call_id int, turn_idx int, speaker string, text string"
    ref = spark.createDataFrame([(1, 0, "A", "..."), (1, 1, "A", "good day")], turn)
    hyp = spark.createDataFrame([(1, 0, "A", "!!"), (1, 1, "B", "day")], turn)
    words = F.split(norm_punct(F.col("text"), True), " ")
    assert [(r.ref_idx, r.hyp_idx, r.shared) for r in content_matches(ref, hyp, words).collect()] == [(1, 1, 1)]
    pair = spark.createDataFrame([("a\nb c", "x")], "ref string, hyp string")
    assert with_wer(pair, "ref", "hyp").first().wer == 1.0


def test_long_registry_meets_micro_batches(spark, tmp_path):
    from talktable.streaming.talk import identify_batches, stream_identify

    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(20)], "vec_id int, embedding array<float>")
    rows.write.parquet(str(tmp_path / "in"))
    reg = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "agent_slug string, embedding array<double>")
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    sink = lambda batch, number: batch.drop("embedding").write.mode("append").parquet(str(tmp_path / "out"))
    writer = identify_batches(source, reg, 0.5, sink, registry_bytes=1)
    writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    want = stream_identify(rows, reg, 0.5).drop("embedding").collect()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, want))


def test_late_rows_vanish_and_a_restart_goes_on(spark, tmp_path):
    from datetime import datetime, timedelta

    from talktable.streaming.talk import stream_talk_time

    t0 = datetime(2024, 1, 1)
    schema = "call_id int, arrived_at timestamp, start_s double, end_s double, identified_speaker string"
    batch = lambda minutes: spark.createDataFrame([(1, t0 + timedelta(minutes=m), 0.0, 1.0, "AGENT") for m in minutes], schema).coalesce(1)
    for minutes in ([0, 1, 2], [40], [3, 41], [90], [120]):
        batch(minutes).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        plan = stream_talk_time(source, window="10 minutes", late="5 minutes")
        out = plan.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
        out.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    found = {(r.window_start - t0).seconds // 60: r.turns for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found[0] == 3 and found[40] == 2


def test_tiles_bound_the_product(monkeypatch):
    import numpy as np

    from talktable.operators import matching

    rng = np.random.default_rng(1)
    prints = [(f"a{i % 7}", rng.normal(size=16)) for i in range(50)]
    packed, rows = matching.PackedRegistry(prints), rng.normal(size=(333, 16))
    whole = packed.similarities(16, rows)
    monkeypatch.setattr(matching, "TILE_BYTES", 8 * 50 * 10)
    assert np.allclose(packed.similarities(16, rows), whole)


def test_tick_ranges_are_the_ticks(spark):
    import random

    from talktable.operators import ticks

    rng = random.Random(3)
    for ordered in (True, False):
        sides = []
        for name in ("truth", "ours"):
            rows = [(c, round(rng.uniform(0, 700), 2), round(rng.uniform(0, 40), 2), rng.random() < 0.5) for c in range(3) for _ in range(40)]
            if ordered:
                rows.sort(key=lambda r: (r[0], r[1]))
            sides.append(spark.createDataFrame([(c, i, s, s + n, x) for i, (c, s, n, x) in enumerate(rows)], f"call_id int, idx int, start_s double, end_s double, {name} boolean"))
        truth, ours = sides
        listed = intervals.labels_at_ticks(truth, "truth", "idx").join(intervals.labels_at_ticks(ours, "ours", "idx"), ["call_id", "tick"])
        assert sorted(map(str, ticks.interval_accuracy(truth, ours).collect())) == sorted(map(str, ticks.tick_accuracy(listed).collect()))
        assert sorted(map(str, ticks.joint_labels(truth, ours).select(*listed.columns).collect())) == sorted(map(str, listed.collect()))


def test_no_tick_is_shuffled(spark):
    """One long interval a side: its ticks are listed after the last exchange, in calls of any order of indexes."""
    from talktable.operators import ticks

    for idx in ((0, 1), (1, 0)):
        rows = [(1, i, s, 300_000.0 + s, i == 0) for i, s in zip(idx, (0.0, 10.0))]
        truth = spark.createDataFrame(rows, "call_id int, idx int, start_s double, end_s double, truth boolean")
        joint = ticks.joint_labels(truth, truth.withColumnRenamed("truth", "ours"))
        assert joint.count() == 600_021
        low = joint.where("truth <> ours or truth is null").count(), joint.where("truth").agg(F.min("tick"), F.max("tick")).first()
        assert low == (0, (0, 600_000) if idx[0] == 0 else (20, 600_020))
        plan = joint._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(tick" in plan.split("Window")[0] and plan.count("sequence(ceil") == 0


def test_word_errors_hold_one_pair(monkeypatch):
    """Memory is that of one pair's words: no masks of all words of a long text, no words of a whole batch."""
    import random
    import tracemalloc

    import pyarrow as pa

    from talktable.operators import words

    def peak(run):
        tracemalloc.start()
        got = run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got, most

    ref = [f"w{i}" for i in range(30_000)]
    got, most = peak(lambda: words.word_distance(ref, ["x", *ref[2:20], "y"]))
    assert got == len(ref) - 18 and most < 20e6
    ref = [f"w{i}" for i in range(30_000)]
    every = ["x", *ref[1::3000], "y"]
    got, most = peak(lambda: words.word_distance(ref[::-1], every))
    assert got >= len(ref) - len(every) and most < 20e6
    texts = pa.array([" ".join(f"{j}_{i}" for i in range(300)) for j in range(1000)])
    got, most = peak(lambda: words._distance.func(texts, texts))
    assert got.to_pylist() == [{"edits": 0, "ref_words": 300, "hyp_words": 300}] * 1000 and most < 5e6
    rng = random.Random(5)
    pairs = [([rng.choice("abcde") for _ in range(rng.randint(0, 70))], [rng.choice("abcdef") for _ in range(rng.randint(0, 70))]) for _ in range(60)]
    plain = [edits(r, h) for r, h in pairs]
    for room in (0, 20, 1 << 20):
        monkeypatch.setattr(words, "MASK_BYTES", room)
        assert [words.word_distance(r, h) for r, h in pairs] == plain
