"""Queries that run whole chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.phrases import AGENT_KEYWORDS, CUSTOMER_KEYWORDS
from ..operators import cluster, matching, passes, roles
from ..operators import vectors as V
from ..plans import desk, enrol, evaluate, identify
from . import views as W
from .matching import _ONCE
from .views import sql

QUERIES, ORACLE = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return register


R = lambda *names: [F.round(n, 6).alias(n) for n in names]

# thresholds fitted to the given vectors, whose own-agent similarity is around 0.15
FITTED = identify.Settings(
    threshold=0.15, threshold_cap=0.20, least_matches=2, reclaim_sim=0.10, gate_seconds=30.0, gate_vectors=3,
    gate_share=0.40, floor=0.05, sure=0.25, likely=0.20,
)


def _segments(spark, d):
    return W.segments(spark, d).select("call_id", "seg_idx", "start_s", "end_s", "text").join(
        W.vectors(spark, d).select("call_id", "seg_idx", "embedding"), ["call_id", "seg_idx"], "left")


def _registry(spark, d):
    return W.registry(spark, d).withColumn("agent_name", F.initcap(F.replace("agent_slug", F.lit("_"), F.lit(" ")))).withColumn(
        "max_outside_sim", F.lit(0.12))


@query("identify_calls")
def _(spark, d):
    rows, _ = identify.identify_calls(_segments(spark, d), _registry(spark, d), FITTED)
    return rows.drop("text")


@query("identify_summary")
def _(spark, d):
    calls = identify.identify_calls(_segments(spark, d), _registry(spark, d), FITTED)[1]
    speakers = F.array_join(F.transform("per_speaker", lambda p: F.concat_ws(":", p["speaker"], p["turns"], F.format_string("%.2f", p["seconds"]))), ",")
    return calls.withColumn("per_speaker", speakers)


# agents of odd labels have voiceprints of 16 components only, and every third segment no vector of 64
@query("choose_dimension", sql("""
    WITH p AS (SELECT agent_slug, CASE WHEN CAST(replace(agent_slug, 'agent_', '') AS INT) % 2 = 1 THEN embedding[1:16] ELSE embedding END AS r FROM v_registry),
    s AS (SELECT v.call_id, p.agent_slug, len(r) AS dim, list_cosine_similarity(v.embedding[1:len(r)], r) AS sim FROM v_vectors v, p WHERE len(r) = 16 OR v.seg_idx % 3 > 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY call_id, agent_slug ORDER BY sim DESC) AS rn, count(*) OVER (PARTITION BY call_id, agent_slug) AS n FROM s),
    m AS (SELECT call_id, agent_slug, dim, avg(sim) FILTER (rn <= greatest(5, floor(n * CAST(0.3 AS DOUBLE)))) AS score FROM t GROUP BY ALL)
    SELECT call_id, agent_slug, dim AS matched_dim, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY round(score, 9) DESC, agent_slug) AS rn FROM m) WHERE rn = 1""", "v_vectors", "v_registry"))
def _(spark, d):
    odd = F.regexp_extract("agent_slug", r"(\d+)$", 1).cast("int") % 2 == 1
    registry = W.registry(spark, d).withColumn("embedding", F.when(odd, F.slice("embedding", 1, 16)).otherwise(F.col("embedding")))
    short = F.slice("embedding", 1, 16)
    both = F.map_from_arrays(F.array(F.lit(16), F.lit(64)), F.array(short, F.when(F.col("seg_idx") % 3 > 0, F.col("embedding"))))
    out = identify.choose_dimension(W.vectors(spark, d).withColumn("embeddings", both), registry)
    return out.select("call_id", "agent_slug", F.col("matched_dim").cast("bigint").alias("matched_dim"), *R("score"))


@query("soft_reclaim")
def _(spark, d):
    rows = cluster.choose_customer_k(
        matching.best_match(_segments(spark, d), _registry(spark, d)).where(F.col("best_sim") < 0.15).select(
            "call_id", "seg_idx", "embedding", F.col("best_sim").alias("sim"), F.col("best_match").alias("agent_slug"),
            F.lit(0.15).alias("agent_threshold")), ["call_id"])
    out = identify.soft_reclaim(rows, FITTED)
    return out.select("call_id", "seg_idx", *R("sim"), "cluster", "reclaimed")


_LABELS = """
    v_sim AS (SELECT s.*, coalesce(b.best_sim, 0) AS sim FROM v_segments s LEFT JOIN v_best b USING (call_id, seg_idx)),
    v_lab AS (SELECT call_id, seg_idx, start_s, end_s, text, sim, CASE WHEN identified_speaker = 'AGENT' THEN 'AGENT' ELSE 'CUSTOMER' END AS role,
              CASE WHEN identified_speaker = 'AGENT' THEN 'Ann' WHEN identified_speaker = 'OTHER' THEN 'Customer 2' ELSE 'Customer 1' END AS display FROM v_sim)"""


def _labelled(spark, d, blank=False):
    """Role labels from the conversations, similarities from the vectors."""
    best = matching.best_match(W.vectors(spark, d), W.registry(spark, d)).select("call_id", "seg_idx", "best_sim")
    agent, third = F.col("identified_speaker") == "AGENT", F.col("identified_speaker") == "OTHER"
    s = W.segments(spark, d).join(best, ["call_id", "seg_idx"], "left")
    display = F.when(agent, "Ann").when(third, "Customer 2").otherwise("Customer 1")
    if blank:
        display = F.when(F.col("best_sim") < 0.15, F.lit(None)).otherwise(display)
    return s.select(
        "call_id", "seg_idx", "start_s", "end_s", "text", F.coalesce("best_sim", F.lit(0.0)).alias("sim"),
        F.lit("Ann").alias("call_agent"), "speaker", F.when(agent, "AGENT").otherwise("CUSTOMER").alias("role"),
        display.alias("display"), F.when(agent, "Ann").alias("agent_name"))


def _out(df):
    return df.select("call_id", "seg_idx", "role", "display")


# the SQL walks every conversation row by row and carries the label and end of the last long row
@query("fill_unlabelled", sql("""
    WITH RECURSIVE """ + _LABELS + """,
    b AS (SELECT l.call_id, l.seg_idx, l.start_s, l.end_s, l.role, CASE WHEN x.best_sim < 0.15e0 THEN NULL ELSE l.display END AS display
          FROM v_lab l LEFT JOIN v_best x USING (call_id, seg_idx)),
    n AS (SELECT *, first_value(CASE WHEN display IS NOT NULL AND end_s - start_s >= 1 THEN {'d': display, 'r': role, 's': start_s} END IGNORE NULLS)
                      OVER (PARTITION BY call_id ORDER BY seg_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM b),
    f AS (SELECT DISTINCT call_id, CAST(-1 AS BIGINT) AS seg_idx, CAST(NULL AS VARCHAR) AS role, CAST(NULL AS VARCHAR) AS display,
                 CAST(NULL AS VARCHAR) AS lr, CAST(NULL AS VARCHAR) AS ld, CAST(NULL AS DOUBLE) AS le FROM n
          UNION ALL
          SELECT call_id, seg_idx, (o).r, (o).d, CASE WHEN keep THEN (o).r ELSE lr END, CASE WHEN keep THEN (o).d ELSE ld END, CASE WHEN keep THEN end_s ELSE le END
          FROM (SELECT *, end_s - start_s >= 1 AND (display IS NOT NULL OR ld IS NOT NULL OR nx IS NOT NULL) AS keep FROM (
            SELECT n.call_id, n.seg_idx, n.end_s, n.start_s, n.display, n.nx, f.lr, f.ld, f.le,
                   CASE WHEN n.display IS NOT NULL THEN {'r': n.role, 'd': n.display}
                        WHEN f.ld IS NULL AND n.nx IS NULL THEN {'r': 'CUSTOMER', 'd': 'Unknown'}
                        WHEN f.ld IS NULL THEN {'r': (n.nx).r, 'd': (n.nx).d}
                        WHEN n.nx IS NULL OR f.ld = (n.nx).d OR n.start_s - f.le <= (n.nx).s - n.end_s THEN {'r': f.lr, 'd': f.ld}
                        ELSE {'r': (n.nx).r, 'd': (n.nx).d} END AS o
            FROM f JOIN n ON n.call_id = f.call_id AND n.seg_idx = f.seg_idx + 1)))
    SELECT call_id, seg_idx, role, display FROM f WHERE seg_idx >= 0""", "v_segments", "v_best"))
def _(spark, d):
    return _out(passes.fill_unlabelled(_labelled(spark, d, True)))


# the SQL walks every conversation row by row; short and weak rows are those of this text
@query("smooth_sandwich", sql("""
    WITH RECURSIVE """ + _LABELS + """,
    n AS (SELECT *, lead(display) OVER w AS nxt, lead(role) OVER w AS nrole FROM v_lab WINDOW w AS (PARTITION BY call_id ORDER BY seg_idx)),
    f AS (SELECT call_id, seg_idx, role, display FROM n WHERE seg_idx = 0
          UNION ALL
          SELECT n.call_id, n.seg_idx, CASE WHEN n.end_s - n.start_s <= 20 AND n.nxt = f.display THEN f.role ELSE n.role END,
                 CASE WHEN n.end_s - n.start_s <= 20 AND n.nxt = f.display THEN f.display ELSE n.display END
          FROM f JOIN n ON n.call_id = f.call_id AND n.seg_idx = f.seg_idx + 1)
,
    m AS (SELECT f.*, l.sim, l.end_s - l.start_s AS len, lead(f.display) OVER w AS nxt, lag(l.sim) OVER w AS psim, lead(l.sim) OVER w AS nsim
          FROM f JOIN v_lab l USING (call_id, seg_idx) WINDOW w AS (PARTITION BY call_id ORDER BY seg_idx)),
    g AS (SELECT call_id, seg_idx, role, display FROM m WHERE seg_idx = 0
          UNION ALL
          SELECT call_id, seg_idx, CASE WHEN hit THEN grole ELSE role END, CASE WHEN hit THEN gdisplay ELSE display END
          FROM (SELECT m.*, g.role AS grole, g.display AS gdisplay,
                       m.len <= 40 AND m.sim < 0.3e0 AND m.nxt = g.display AND greatest(m.psim, m.nsim) >= 0.2e0 AS hit
                FROM g JOIN m ON m.call_id = g.call_id AND m.seg_idx = g.seg_idx + 1))
    SELECT * FROM g""", "v_segments", "v_best"))
def _(spark, d):
    return _out(passes.smooth_sandwich(_labelled(spark, d), tight_s=20.0, loose_s=40.0, strong=0.20))


@query("demote_backchannel", sql("""
    WITH """ + _LABELS + """
    SELECT call_id, seg_idx, CASE WHEN x THEN 'CUSTOMER' ELSE role END AS role, CASE WHEN x THEN 'Customer 1' ELSE display END AS display
    FROM (SELECT *, role = 'AGENT' AND sim < 0.3e0 AND end_s - start_s <= 4 AND len(w) BETWEEN 1 AND 15 AND
            w[1] IN ('yeah', 'yes', 'yep', 'yup', 'ok', 'okay', 'right', 'sure', 'alright', 'uhuh', 'mhm', 'mm', 'mhmm', 'kay') AS x
          FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM (
            SELECT * REPLACE (CASE WHEN seg_idx % 3 = 1 THEN 'Yeah, ' || string_split(text, ' ')[1] ELSE text END AS text,
                              CASE WHEN seg_idx % 3 = 1 THEN start_s + 3 ELSE end_s END AS end_s) FROM v_lab)))""", "v_segments", "v_best"))
def _(spark, d):
    """Every third turn is a short answer."""
    rows, short = _labelled(spark, d), F.col("seg_idx") % 3 == 1
    first = F.concat(F.lit("Yeah, "), F.get(F.split("text", " "), F.lit(0)))
    rows = rows.withColumn("text", F.when(short, first).otherwise(F.col("text")))
    return _out(passes.demote_backchannel(rows.withColumn("end_s", F.when(short, F.col("start_s") + 3).otherwise(F.col("end_s")))))


@query("demote_zero_sim", sql("""
    WITH RECURSIVE """ + _LABELS + """,
    n AS (SELECT *, coalesce(lead(role) OVER w, '') AS n1, coalesce(lead(role, 2) OVER w, '') AS n2, lead(display) OVER w AS d1 FROM v_lab WINDOW w AS (PARTITION BY call_id ORDER BY seg_idx)),
    f AS (SELECT call_id, seg_idx, role, display, '' AS role1 FROM n WHERE seg_idx = 0
          UNION ALL
          SELECT call_id, seg_idx, CASE WHEN hit AND p = 'CUSTOMER' THEN 'CUSTOMER' WHEN hit AND n1 = 'CUSTOMER' THEN 'CUSTOMER' ELSE role END,
                 CASE WHEN hit AND p = 'CUSTOMER' THEN pd WHEN hit AND n1 = 'CUSTOMER' THEN d1 ELSE display END, p
          FROM (SELECT n.*, f.role AS p, f.display AS pd, n.role = 'AGENT' AND n.sim < 0.15e0 AND (f.role = 'CUSTOMER' OR f.role1 = 'CUSTOMER')
                       AND (n.n1 = 'CUSTOMER' OR n.n2 = 'CUSTOMER') AS hit
                FROM f JOIN n ON n.call_id = f.call_id AND n.seg_idx = f.seg_idx + 1))
    SELECT call_id, seg_idx, role, display FROM f""", "v_segments", "v_best"))
def _(spark, d):
    return _out(passes.demote_zero_sim(_labelled(spark, d), 0.15))


@query("correct_roles")
def _(spark, d):
    return _out(passes.correct_roles(_labelled(spark, d), short_s=30.0))


def _viewed(spark, d):
    s = W.segments(spark, d)
    agent = F.col("identified_speaker") == "AGENT"
    return s.select(
        "call_id", "seg_idx", "start_s", "end_s", "text", "speaker", F.when(agent, "AGENT").otherwise(F.col("speaker")).alias("identified_speaker"),
        F.when(agent, "agent_ann_lee").alias("agent_name"), F.lit(None).cast("string").alias("display_speaker"),
        F.when(agent, -0.5).otherwise(0.9).alias("confidence"), F.lit(0.4).alias("best_sim"))


_VIEW = """
    l AS (SELECT call_id, speaker AS label, min(start_s) AS f, bool_or(identified_speaker = 'AGENT') AS agent FROM v_segments GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY call_id, agent ORDER BY round(f, 6), label) AS nth, count(*) OVER (PARTITION BY call_id, agent) AS c FROM l),
    v AS (SELECT s.call_id, s.seg_idx, s.speaker AS label, s.start_s, s.end_s, s.text, CASE WHEN agent THEN 'Agent' ELSE 'Customer' END AS role,
                 CASE WHEN agent THEN 'agent_ann_lee' ELSE 'customer_' || nth END AS speaker_key,
                 CASE WHEN agent THEN 'Agent (Ann Lee)' WHEN c > 1 THEN 'Customer ' || nth ELSE 'Customer' END AS display_speaker
          FROM v_segments s JOIN k ON k.call_id = s.call_id AND k.label = s.speaker)"""


@query("conversation_view", sql(f"WITH {_VIEW} SELECT call_id, seg_idx, label, role, speaker_key, display_speaker FROM v", "v_segments"))
def _(spark, d):
    return roles.conversation_view(_viewed(spark, d))[0].select("call_id", "seg_idx", "label", "role", "speaker_key", "display_speaker")


@query("conversation_speakers", sql(f"""
    WITH {_VIEW} SELECT call_id, speaker_key, min(display_speaker) AS display_speaker, count(*) AS segment_count, round(sum(round(end_s - start_s, 6)), 2) AS talk_time,
           string_agg(text, chr(10) ORDER BY seg_idx) AS text FROM v GROUP BY call_id, speaker_key""", "v_segments"))
def _(spark, d):
    s = _viewed(spark, d).withColumn("end_s", F.col("start_s") + F.round(F.col("end_s") - F.col("start_s"), 6))
    g = roles.conversation_view(s)[1]
    return g.select("call_id", "speaker_key", "display_speaker", "segment_count", "talk_time", "text")


def _speaker_scores(spark, d):
    """Speakers of a call by their centroids against the registry."""
    s = W.segments(spark, d).join(W.vectors(spark, d).select("call_id", "seg_idx", "embedding"), ["call_id", "seg_idx"])
    means = roles.speaker_centroids(s, 0.5, 10.0).select("call_id", "speaker", F.col("centroid").alias("embedding"))
    return matching.agent_scores(means, W.registry(spark, d)).drop("embedding")


_CENTROIDS = """
    x AS (SELECT s.call_id, s.seg_idx, s.speaker, v.embedding, coalesce(sum(s.end_s - s.start_s) OVER (PARTITION BY s.call_id, s.speaker ORDER BY s.seg_idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
          FROM v_segments s JOIN v_vectors v USING (call_id, seg_idx) WHERE s.end_s - s.start_s >= 0.5e0),
    p AS (SELECT call_id, speaker, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM x WHERE spent < 10),
    c AS (SELECT call_id, speaker, list(m ORDER BY pos) AS m FROM (SELECT call_id, speaker, pos, avg(e) AS m FROM p GROUP BY ALL) GROUP BY ALL),
    sc AS (SELECT c.call_id, c.speaker, r.agent_slug, list_dot_product(c.m, r.embedding) / sqrt(list_dot_product(c.m, c.m)) AS sim FROM c, v_registry r)"""


@query("speaker_centroids", sql(f"WITH {_CENTROIDS} SELECT call_id, speaker, agent_slug, round(sim, 6) AS sim FROM sc", "v_segments", "v_registry"))
def _(spark, d):
    return _speaker_scores(spark, d).select("call_id", "speaker", "agent_slug", *R("sim"))


_TALK = """
    t AS (SELECT call_id, speaker, sum(end_s - start_s) AS s, min(seg_idx) AS f FROM v_segments GROUP BY ALL),
    dom AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY round(s, 9) DESC, f) AS rn FROM t) WHERE rn = 1)"""


@query("weighted_identity", sql(f"""
    WITH {_CENTROIDS}, {_TALK},
    w AS (SELECT sc.*, sim * (0.7e0 + 0.3e0 * t.s / sum(t.s) OVER (PARTITION BY sc.call_id, sc.agent_slug)) AS w FROM t JOIN sc USING (call_id, speaker)),
    share AS (SELECT call_id, speaker, s / sum(s) OVER (PARTITION BY call_id) AS share FROM t),
    b AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY call_id ORDER BY sim * (0.7e0 + 0.3e0 * share) DESC, agent_slug, speaker) AS rn
          FROM sc JOIN share USING (call_id, speaker)) WHERE rn = 1)
    SELECT dom.call_id, CASE WHEN b.sim >= 0.25e0 THEN b.speaker ELSE dom.speaker END AS speaker, CASE WHEN b.sim >= 0.25e0 THEN b.agent_slug ELSE 'Unknown Agent' END AS agent,
           round(coalesce(b.sim, -2), 6) AS sim FROM dom LEFT JOIN b USING (call_id)""", "v_segments", "v_registry"))
def _(spark, d):
    s = W.segments(spark, d)
    total = s.groupBy("call_id").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("t"))
    shares = s.groupBy("call_id", "speaker").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("s")).join(total, "call_id").select(
        "call_id", "speaker", (F.col("s") / F.col("t")).alias("share"))
    out = roles.weighted_identity(_speaker_scores(spark, d), shares, roles.dominant_speaker(s), 0.25)
    return out.select("call_id", "speaker", "agent", *R("sim"))


def _hits(words):
    quoted = [w.replace("'", "''") for w in words]
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in quoted)


@query("agent_speaker", sql(f"""
    WITH {_CENTROIDS}, {_TALK},
    reg AS (SELECT * FROM (SELECT call_id, speaker, row_number() OVER (PARTITION BY call_id ORDER BY round(sum(o), 9) DESC, min(seg_idx)) AS rn FROM (
              SELECT s.call_id, s.seg_idx, s.speaker, least(s.end_s, t.end_s) - greatest(s.start_s, t.start_s) AS o FROM v_segments s JOIN v_turns t
              ON s.call_id = t.call_id AND s.start_s < t.end_s AND t.start_s < s.end_s AND t.speaker = 'signup' AND t.end_s > t.start_s) GROUP BY call_id, speaker) WHERE rn = 1),
    own AS (SELECT call_id, min_by(agent_slug, seg_idx) AS agent_slug FROM v_vectors GROUP BY call_id),
    en AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY sim DESC, speaker DESC) AS rn FROM sc JOIN own USING (call_id, agent_slug)) WHERE rn = 1 AND sim > 0.05e0),
    kw AS (SELECT call_id, speaker, sum(2 * a - c) AS score, min(seg_idx) AS f FROM (
             SELECT *, {_hits(AGENT_KEYWORDS)} AS a, {_hits(CUSTOMER_KEYWORDS)} AS c FROM v_segments) WHERE a > 0 OR c > 0 GROUP BY call_id, speaker),
    kr AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY score DESC, f) AS rn FROM kw),
    ko AS (SELECT call_id, min_by(score, f) AS other FROM kr WHERE rn > 1 GROUP BY call_id),
    k AS (SELECT kr.call_id, kr.speaker FROM kr LEFT JOIN ko USING (call_id) WHERE rn = 1 AND score >= 2 AND score - coalesce(other, 0) >= 1)
    SELECT dom.call_id, coalesce(reg.speaker, en.speaker, k.speaker, dom.speaker) AS speaker,
           CASE WHEN reg.speaker IS NOT NULL THEN 'regions' WHEN en.speaker IS NOT NULL THEN 'voiceprint'
                WHEN k.speaker IS NOT NULL THEN 'keywords' ELSE 'talk_time' END AS method
    FROM dom LEFT JOIN reg USING (call_id) LEFT JOIN en USING (call_id) LEFT JOIN k USING (call_id)""", "v_segments", "v_registry", "v_turns"))
def _(spark, d):
    """Scores of the agent each call is expected to have: that of its first vector."""
    regions = W.turns(spark, d).where("speaker = 'signup'")
    expected = W.vectors(spark, d).groupBy("call_id").agg(F.min_by("agent_slug", "seg_idx").alias("agent_slug"))
    one = _speaker_scores(spark, d).join(expected, ["call_id", "agent_slug"])
    return roles.agent_speaker(W.segments(spark, d), regions, one, 0.05)


# measures of a clip from its vector, so that every check drops some
_CLIPS = """
    clips AS (SELECT *, 1 + 100 * abs(embedding[1]) AS duration_s, -200 * abs(embedding[2]) AS rms_dbfs, 2 * abs(embedding[3]) AS flatness, 30 + 100 * embedding[4] AS snr_db FROM v_vectors),
    checked AS (SELECT *, CASE WHEN duration_s < 1.5e0 THEN 'too short' WHEN duration_s > 20 THEN 'too long' WHEN rms_dbfs < -40 THEN 'too quiet'
                  WHEN flatness > 0.6e0 THEN 'too noisy' WHEN snr_db < 10 THEN 'low SNR' ELSE '' END AS reason FROM clips),
    v_kept AS (SELECT * FROM checked WHERE reason = ''),
    sums AS (SELECT agent_slug, list(x ORDER BY pos) AS m FROM (SELECT agent_slug, pos, avg(x) AS x FROM (
               SELECT agent_slug, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM v_kept) GROUP BY ALL) GROUP BY 1),
    v_middle AS (SELECT agent_slug, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS embedding FROM sums),
    offered AS (SELECT agent_slug, sum(n) AS n_clips, string_agg(reason || '=' || n, ',' ORDER BY reason) FILTER (reason <> '') AS reasons FROM (
                  SELECT agent_slug, reason, count(*) AS n FROM checked GROUP BY ALL) GROUP BY 1)"""


@query("clean_extract", sql(
    _ONCE.format(ok="v.sim >= 0.1e0", least=1).replace("SELECT agent_slug, max(n) AS n,", "SELECT agent_slug, avg(cos) < 0.25e0 AS low_cohesion, CAST(max(n_clips) AS BIGINT) AS n_clips, max(reasons) AS reasons, max(n) AS n,")
    .replace("v_vectors", "v_kept").replace("v_registry", "v_middle").replace("FROM f GROUP BY", "FROM f JOIN offered USING (agent_slug) GROUP BY")
    .replace("WITH s AS", f"WITH {_CLIPS}, s AS"),
    "v_vectors", "v_registry"))
def _(spark, d):
    at = lambda i: F.get("embedding", F.lit(i))
    clips = W.vectors(spark, d).withColumnRenamed("vec_id", "clip_id").withColumns({
        "duration_s": 1 + 100 * F.abs(at(0)), "rms_dbfs": -200 * F.abs(at(1)), "flatness": 2 * F.abs(at(2)), "snr_db": 30 + 100 * at(3)})
    out = enrol.clean_extract(clips, 0.1, 0.25)
    reasons = F.array_join(F.transform("reasons", lambda r: F.concat_ws("=", r["reason"], r["n"])), ",")
    return out.select("agent_slug", "low_cohesion", "n_clips", reasons.alias("reasons"), "n", "n_used", "relaxed", *R("mean_cosine", "min_cosine", "max_cosine"))


def _enrolment(spark, d):
    """Calls of ten windows; frames are the windows' leading components."""
    v = W.vectors(spark, d)
    calls = v.groupBy("call_id").agg(F.min_by("agent_slug", "seg_idx").alias("agent_slug"), F.min("vec_id").alias("idx"))
    phrases = v.select("call_id", F.col("seg_idx").alias("phrase_idx"), (F.col("seg_idx") * 3.0).alias("start_s"),
                       (F.col("seg_idx") * 3.0 + 2.0).alias("end_s"), F.lit(True).alias("is_agent"))
    frames = v.select("call_id", F.abs(F.get("embedding", F.lit(0))).cast("double").alias("rms"))
    return calls, phrases, frames, v.select("vec_id", "call_id", "embedding")


@query("enrol_agents")
def _(spark, d):
    out = enrol.enrol_agents(*_enrolment(spark, d), first=0.10, second=0.15, gate={"least_seconds": 20.0, "least_windows": 20, "bucket_windows": 10})
    return out.select("agent_slug", "bucket", "vp_idx", "n_clips", F.size("embedding").alias("dim"), *R("inside", "max_outside_sim"), "snr_db", "used_calls")


@query("enrol_registry")
def _(spark, d):
    """Agents that were enrolled replace what the registry had of them, others stay."""
    old = W.registry(spark, d).withColumn("source", F.lit("old"))
    fresh = enrol.enrol_agents(*_enrolment(spark, d), first=0.10, second=0.15, gate={"least_seconds": 20.0, "least_windows": 20, "bucket_windows": 10})
    out = enrol.update_registry(old, fresh, "new")
    return out.select("agent_slug", "path", "bucket", "vp_idx", "n_clips", F.size("embedding").alias("dim"), *R("mean_inside_sim", "max_outside_sim"), "source")


@query("enrol_agents_strict")
def _(spark, d):
    calls, phrases, frames, vectors = _enrolment(spark, d)
    mixed = phrases.withColumn("is_agent", F.col("phrase_idx") < 8)
    out = enrol.enrol_agents(calls, mixed, frames, vectors, purity_buffer_s=2.0, first=0.10, second=0.15,
                             gate={"least_seconds": 10.0, "least_windows": 20, "bucket_windows": 10})
    return out.select("agent_slug", "bucket", "vp_idx", "n_clips", *R("inside", "max_outside_sim"), "used_calls")


@query("desk_report", sql("""
    WITH fr AS (SELECT call_id, seg_idx AS frame_idx, CAST(abs(embedding[1]) AS DOUBLE) AS rms FROM v_vectors),
    q AS (SELECT call_id, count(*) AS n, quantile_cont(rms, 0.6) AS m FROM fr GROUP BY call_id),
    w AS (SELECT call_id, m, unnest(generate_series(0, n - 2)) AS win_idx FROM q WHERE n >= 2),
    sp AS (SELECT w.call_id, win_idx FROM w JOIN fr ON fr.call_id = w.call_id AND fr.frame_idx >= win_idx AND fr.frame_idx < win_idx + 2
           GROUP BY ALL HAVING avg(CAST(fr.rms >= m AS INT)) >= 0.3e0),
    b AS (SELECT b.call_id, b.seg_idx, best_match AS agent_slug, round(best_sim, 3) AS sim FROM v_best b JOIN sp ON sp.call_id = b.call_id AND sp.win_idx = b.seg_idx),
    r AS (SELECT call_id, agent_slug, avg(sim) FILTER (WHERE rn <= greatest(3, floor(n * CAST(0.3 AS DOUBLE)))) AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY call_id, agent_slug ORDER BY sim DESC) AS rn, count(*) OVER (PARTITION BY call_id, agent_slug) AS n FROM b) GROUP BY ALL),
    i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY round(score, 6) DESC, agent_slug) AS rn FROM r) WHERE rn = 1)
    SELECT b.call_id, i.agent_slug AS identified_slug, round(round(max(i.score), 3), 2) AS score, count(*) AS n_speech_windows,
           round(avg(CAST(b.agent_slug = i.agent_slug AND sim >= 0.1e0 AS INT)), 3) AS agent_time_share,
           NOT (avg(CAST(b.agent_slug = i.agent_slug AND sim >= 0.1e0 AS INT)) BETWEEN 0.2e0 AND 0.8e0) AS flagged
    FROM b JOIN i USING (call_id) GROUP BY b.call_id, i.agent_slug""", "v_best"))
def _(spark, d):
    """One-second frames and windows of two of them, one window per vector."""
    v = W.vectors(spark, d)
    frames = v.select("call_id", F.col("seg_idx").alias("frame_idx"), F.abs(F.get("embedding", F.lit(0))).cast("double").alias("rms"))
    windows = v.select("call_id", F.col("seg_idx").alias("win_idx"), "embedding")
    out = desk.desk_report(frames, windows, W.registry(spark, d), 0.1, frame_s=1.0, window_s=2.0, step_s=1.0)
    # scores are means of rounded similarities, on which both sides agree to two digits
    return out.withColumn("score", F.round("score", 2))


def _reports(spark, d):
    v = W.vectors(spark, d)
    first_own = v.groupBy("call_id").agg(F.min_by("agent_slug", "seg_idx").alias("agent_slug"))
    stats = v.join(first_own.withColumnRenamed("agent_slug", "e"), "call_id").groupBy("call_id").agg(
        F.sum((F.col("agent_slug") == F.col("e")).cast("bigint")).alias("n_agent_phrases"), F.min("vec_id").alias("idx"))
    calls = first_own.join(stats, "call_id").withColumn("connect_time", F.col("idx"))
    phrases = v.join(first_own.withColumnRenamed("agent_slug", "e"), "call_id").select(
        "call_id", "seg_idx", "embedding", (F.col("agent_slug") == F.col("e")).alias("is_agent"))
    frames = v.select("call_id", F.abs(F.get("embedding", F.lit(0))).cast("double").alias("rms"))
    # the earlier half of the calls trained the registry
    middle = calls.agg(F.max("idx").alias("top"))
    enrolled = calls.join(middle, how="cross").where(F.col("idx") * 2 < F.col("top")).select("call_id")
    train = v.join(enrolled, "call_id", "left_semi")
    single = V.centroids(train, ["agent_slug"]).select("agent_slug", F.col("centroid").alias("embedding"))
    multi = cluster.voiceprint_centroids(train, ["agent_slug"], "vec_id", 2, 8).select("agent_slug", "embedding")
    return evaluate.evaluate_registries(calls, enrolled, phrases, frames, multi, single, 0.10, [0.05, 0.10, 0.15], least_phrases=1)


@query("evaluate_held_out")
def _(spark, d):
    return _reports(spark, d)["first_summary"]


@query("eval_report")
def _(spark, d):
    parts = _reports(spark, d)
    return evaluate.eval_report(parts)
