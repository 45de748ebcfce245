"""Call tables derived from the given tables, in Spark and as SQL text for the same rows.

Every view covers the whole of its source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import cut_keys, number_rows, scan, sum_before
from ..operators.vectors import centroids

# start of the clock of the event table in microseconds; a millisecond of it plays a microsecond
EPOCH_US = 1704067200000000


def clock() -> Column:
    """Seconds of the compressed clock, in whole microseconds."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US
    return F.floor(micros / F.lit(1000.0)) / F.lit(1e6)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark, sf_dir) -> DataFrame:
    """Diarizer turns: one per event."""
    start = clock()
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("call_id"), F.col("event_id").alias("turn_idx"), start.alias("start_s"),
        (start + F.col("value")).alias("end_s"), F.col("event_type").alias("speaker"),
        F.col("event_type").isin("click", "purchase").alias("is_agent"),
    )


def system(spark, sf_dir) -> DataFrame:
    """What a system made of the same speech: shifted, shortened, sometimes mislabelled segments."""
    t = turns(spark, sf_dir)
    length = F.col("end_s") - F.col("start_s")
    return t.select(
        "call_id", F.col("turn_idx").alias("seg_idx"), (F.col("start_s") + 2.5).alias("start_s"),
        (F.col("start_s") + 2.5 + length * 0.8).alias("end_s"),
        F.when(F.col("speaker").isin("click", "purchase", "view"), "AGENT").otherwise("CUSTOMER").alias("identified_speaker"),
    )


def frames(spark, sf_dir) -> DataFrame:
    """Frame energies: one frame per event, numbered within its call."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("call_id"), "event_id", F.col("value").alias("rms")
    )
    return number_rows(rows, ["call_id"], ["event_id"], cut_keys(rows, ["call_id"], "event_id"), "frame_idx").drop("event_id")


def segments(spark, sf_dir) -> DataFrame:
    """Transcript segments of conversations, timed by their text length."""
    length = F.round(F.length("text").cast("double") / F.lit(15.0), 2)
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("call_id"), F.col("turn").alias("seg_idx"), "role", "text", length.alias("dur"),
        (F.length("role") / F.lit(10.0)).alias("gap"),
    )
    timed = scan(
        rows, ["call_id"], ["seg_idx"], {"start_s": sum_before(F.col("dur") + F.col("gap"))},
        cut_keys(rows, ["call_id"], "seg_idx"),
    )
    return timed.select(
        "call_id", "seg_idx", "start_s", (F.col("start_s") + F.col("dur")).alias("end_s"), "text",
        F.when(F.col("role") == "user", "SPEAKER_01").when(F.col("role") == "assistant", "SPEAKER_00")
        .otherwise("SPEAKER_02").alias("speaker"),
        F.when(F.col("role") == "user", "CUSTOMER").when(F.col("role") == "assistant", "AGENT")
        .otherwise("OTHER").alias("identified_speaker"),
    )


def vectors(spark, sf_dir) -> DataFrame:
    """Segment vectors, ten to a call."""
    call = F.floor(F.col("vec_id") / F.lit(10.0)).cast("bigint")
    return table(spark, sf_dir, "embeddings").select(
        call.alias("call_id"), (F.col("vec_id") - call * 10).alias("seg_idx"), "vec_id", "embedding",
        F.concat(F.lit("agent_"), F.col("label").cast("string")).alias("agent_slug"),
    )


def registry(spark, sf_dir) -> DataFrame:
    """One voiceprint per agent: the unit centroid of all its vectors."""
    return centroids(vectors(spark, sf_dir), ["agent_slug"]).select(
        "agent_slug", F.col("centroid").alias("embedding")
    )


def scored(spark, sf_dir) -> DataFrame:
    """Vectors with their best agent; the first label of a call plays the expected agent."""
    from ..operators.matching import best_match

    expected = vectors(spark, sf_dir).groupBy("call_id").agg(
        F.min_by("agent_slug", "seg_idx").alias("expected_slug")
    )
    return (
        best_match(vectors(spark, sf_dir), registry(spark, sf_dir))
        .join(expected, "call_id")
        .select("call_id", "seg_idx", "agent_slug", "expected_slug", "best_match", "best_sim",
                (F.col("agent_slug") == F.col("expected_slug")).alias("is_agent"))
    )


def calls(spark, sf_dir) -> DataFrame:
    """Call index: one row per user."""
    t = table(spark, sf_dir, "events")
    agent = F.col("event_type").isin("click", "purchase").cast("bigint")
    start = clock()
    return t.groupBy(F.col("user_id").alias("call_id")).agg(
        F.concat(F.lit("agent_"), F.substring(F.col("user_id").cast("string"), -1, 1)).alias("agent_slug"),
        F.round(F.max(start + F.col("value")), 6).alias("duration_s"),
        F.min(F.col("ts").cast("timestamp")).alias("connect_time"),
        F.sum(agent).alias("n_agent_phrases"),
        F.count("*").alias("n_total_phrases"),
        F.min("event_id").alias("idx"),
        F.round(F.sum("value"), 6).alias("value_sum"),
    )


def lines(spark, sf_dir) -> DataFrame:
    """Documents as calls: every line is a phrase."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("call_id"), "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_idx", "line")
    )


SQL = {
    "v_turns": """
        SELECT user_id AS call_id, event_id AS turn_idx, floor((epoch_us(ts) - 1704067200000000) / 1000e0) / 1e6 AS start_s,
               floor((epoch_us(ts) - 1704067200000000) / 1000e0) / 1e6 + value AS end_s, event_type AS speaker,
               event_type IN ('click', 'purchase') AS is_agent
        FROM events""",
    "v_system": """
        SELECT call_id, turn_idx AS seg_idx, start_s + 2.5e0 AS start_s,
               start_s + 2.5e0 + (end_s - start_s) * 0.8e0 AS end_s,
               CASE WHEN speaker IN ('click', 'purchase', 'view') THEN 'AGENT' ELSE 'CUSTOMER' END AS identified_speaker
        FROM v_turns""",
    "v_frames": """
        SELECT user_id AS call_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_idx, value AS rms
        FROM events""",
    "v_segments": """
        SELECT call_id, seg_idx, start_s, start_s + dur AS end_s, text,
               CASE role WHEN 'user' THEN 'SPEAKER_01' WHEN 'assistant' THEN 'SPEAKER_00' ELSE 'SPEAKER_02' END AS speaker,
               CASE role WHEN 'user' THEN 'CUSTOMER' WHEN 'assistant' THEN 'AGENT' ELSE 'OTHER' END AS identified_speaker
        FROM (SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY call_id ORDER BY seg_idx
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_s
              FROM (SELECT conv_id AS call_id, turn AS seg_idx, role, text, length(role) / 10e0 AS gap,
                           round(CAST(length(text) AS DOUBLE) / 15e0, 2) AS dur FROM conversations))""",
    "v_vectors": """
        SELECT CAST(floor(vec_id / 10e0) AS BIGINT) AS call_id, vec_id - 10 * CAST(floor(vec_id / 10e0) AS BIGINT) AS seg_idx,
               vec_id, CAST(embedding AS DOUBLE[]) AS embedding, 'agent_' || label AS agent_slug
        FROM embeddings""",
    "v_positions": """
        SELECT agent_slug, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM v_vectors""",
    "v_means": """
        SELECT agent_slug, list(m ORDER BY pos) AS mean
        FROM (SELECT agent_slug, pos, avg(x) AS m FROM v_positions GROUP BY ALL) GROUP BY agent_slug""",
    "v_registry": """
        SELECT agent_slug, list_transform(mean, lambda x: x / sqrt(list_dot_product(mean, mean))) AS embedding FROM v_means""",
    "v_scores": """
        SELECT v.call_id, v.seg_idx, v.vec_id, v.agent_slug AS own_slug, r.agent_slug,
               list_dot_product(v.embedding, r.embedding) / sqrt(list_dot_product(v.embedding, v.embedding)) AS sim
        FROM v_vectors v, v_registry r""",
    "v_best": """
        SELECT call_id, seg_idx, vec_id, own_slug, agent_slug AS best_match, sim AS best_sim
        FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, agent_slug) AS rn FROM v_scores) WHERE rn = 1""",
    "v_scored": """
        SELECT b.call_id, b.seg_idx, b.own_slug AS agent_slug, e.expected_slug, b.best_match, b.best_sim,
               b.own_slug = e.expected_slug AS is_agent
        FROM v_best b JOIN (SELECT call_id, min_by(agent_slug, seg_idx) AS expected_slug FROM v_vectors GROUP BY call_id) e
             USING (call_id)""",
    "v_calls": """
        SELECT user_id AS call_id, 'agent_' || right(CAST(user_id AS VARCHAR), 1) AS agent_slug,
               round(max(floor((epoch_us(ts) - 1704067200000000) / 1000e0) / 1e6 + value), 6) AS duration_s, min(ts) AS connect_time,
               CAST(sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) AS BIGINT) AS n_agent_phrases,
               count(*) AS n_total_phrases, min(event_id) AS idx, round(sum(value), 6) AS value_sum
        FROM events GROUP BY user_id""",
    "v_lines": """
        SELECT doc_id AS call_id, lang, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx FROM documents""",
}

NEEDS = {
    "v_system": ["v_turns"], "v_positions": ["v_vectors"], "v_means": ["v_positions"], "v_registry": ["v_means"],
    "v_scores": ["v_vectors", "v_registry"], "v_best": ["v_scores"], "v_scored": ["v_best", "v_vectors"],
}


def sql(body: str, *views: str) -> str:
    """``body`` preceded by the views it names and those they need."""
    order: list[str] = []

    def add(name):
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    if not order:
        return body
    ctes = ", ".join(f"{v} AS ({SQL[v].strip()})" for v in order)
    body = body.lstrip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{ctes}, {body[len(head):].lstrip()}"
    return f"WITH {ctes} {body}"
