"""Segments with vectors of two dimensions: the dimension of the best agent decides for the call."""

from pyspark.sql import functions as F

from talktable.plans.identify import choose_dimension, identify_calls

SEGMENTS = "call_id long, seg_idx long, start_s double, end_s double, text string, embeddings map<int, array<double>>"


def calls(spark):
    """Call 1 sounds like the agent with two components, call 2 like the one with three, call 3 has no usable vector."""
    near2, near3, far3 = [1.0, 0.1], [0.1, 1.0, 0.0], [0.2, 0.3, 1.0]
    rows = [(1, i, 10.0 * i, 10.0 * i + 8, f"line {i} of the call", {2: near2, 3: far3}) for i in range(8)]
    rows += [(1, 8, 80.0, 88.0, "a line without the small vector", {3: far3})]
    rows += [(2, i, 10.0 * i, 10.0 * i + 8, f"line {i} of the call", {2: [0.3, 1.0], 3: near3}) for i in range(8)]
    rows += [(3, 0, 0.0, 5.0, "nothing", None), (3, 1, 6.0, 9.0, "nothing more", {2: None, 3: [1.0]})]
    registry = [("agent_small", "Small", [1.0, 0.0], 0.1), ("agent_large", "Large", [0.0, 1.0, 0.0], 0.1), ("agent_other", "Other", [-1.0, 0.0, 0.0], 0.1)]
    return spark.createDataFrame(rows, SEGMENTS), spark.createDataFrame(registry, "agent_slug string, agent_name string, embedding array<double>, max_outside_sim double")


def test_the_better_dimension_wins(spark):
    segments, registry = calls(spark)
    got = {r.call_id: (r.agent_slug, r.matched_dim) for r in choose_dimension(segments, registry).collect()}
    assert got == {1: ("agent_small", 2), 2: ("agent_large", 3)}


def test_calls_are_labelled_by_vectors_of_their_dimension(spark):
    segments, registry = calls(spark)
    rows, summary = identify_calls(segments, registry)
    found = {r.call_id: r for r in summary.collect()}
    assert {i: (r.agent_slug, r.matched_dim, r.n_matches) for i, r in found.items()} == {1: ("agent_small", 2, 8), 2: ("agent_large", 3, 8), 3: ("", None, 0)}
    assert sum(p.turns for p in found[1].per_speaker) == 9 and found[1].n_speakers == len(found[1].per_speaker)
    spoken = {r.role for r in rows.where((F.col("call_id") < 3) & (F.col("seg_idx") < 8)).collect()}
    assert spoken == {"AGENT"}
    assert all(r.role_corrections == 0 for r in found.values() if r.call_id == 3)


def test_one_dimension_gives_what_plain_vectors_give(spark):
    segments, registry = calls(spark)
    large = registry.where("size(embedding) = 3")
    plain = segments.withColumn("embedding", F.when(F.size(F.try_element_at("embeddings", F.lit(3))) == 3, F.try_element_at("embeddings", F.lit(3)))).drop("embeddings")
    a, b = (identify_calls(x, large) for x in (segments, plain))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(a[0]) == key(b[0])
    assert key(a[1].drop("per_speaker")) == key(b[1].drop("per_speaker"))
