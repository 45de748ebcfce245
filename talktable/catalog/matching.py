"""Queries on vectors: voiceprints, matching, evaluation, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import agent_threshold, cosine, l2_normalize, snr_bucket
from ..operators import cluster, evaluate, matching, roles, topk
from ..operators import vectors as V
from ..sources.registry import voiceprint_health
from . import views as W
from .views import sql

QUERIES, ORACLE = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return register


R6 = lambda c: F.round(c, 6)
# similarity cut for the given vectors, whose own-agent similarity is around 0.15
CUT = 0.15


@query("l2_normalize", sql("""
    SELECT vec_id, unnest(range(len(embedding))) AS at, round(unnest(embedding) / sqrt(list_dot_product(embedding, embedding)), 6) AS value FROM v_vectors""", "v_vectors"))
def _(spark, d):
    u = W.vectors(spark, d).withColumn("u", l2_normalize(F.col("embedding")))
    return u.select("vec_id", F.posexplode("u").alias("at", "value")).select("vec_id", F.col("at").cast("bigint").alias("at"), R6("value").alias("value"))


@query("cosine", sql("""
    SELECT v.vec_id, round(list_cosine_similarity(v.embedding, r.embedding), 6) AS cos
    FROM v_vectors v JOIN v_registry r USING (agent_slug)""", "v_vectors", "v_registry"))
def _(spark, d):
    own = W.registry(spark, d).withColumnRenamed("embedding", "print")
    return W.vectors(spark, d).join(own, "agent_slug").select(
        "vec_id", R6(cosine(F.col("embedding"), F.col("print"))).alias("cos"))


@query("centroid", sql("""
    SELECT agent_slug, CAST(pos AS BIGINT) AS pos, round(x, 6) AS x FROM (
      SELECT agent_slug, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM v_registry)""", "v_registry"))
def _(spark, d):
    return W.registry(spark, d).select("agent_slug", F.posexplode("embedding").alias("pos", "x")).select(
        "agent_slug", F.col("pos").cast("bigint").alias("pos"), R6("x").alias("x"))


_TIGHT = """
    WITH s1 AS (SELECT v.agent_slug, v.vec_id, v.embedding, list_dot_product(v.embedding, r.embedding) >= {a}
                       AS hit FROM v_unit v JOIN v_registry r USING (agent_slug)),
    k1 AS (SELECT *, hit OR sum(CAST(hit AS INT)) OVER (PARTITION BY agent_slug) < {m} AS keep1 FROM s1),
    p1 AS (SELECT agent_slug, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM k1 WHERE keep1),
    m1 AS (SELECT agent_slug, list(x ORDER BY pos) AS m FROM (SELECT agent_slug, pos, avg(x) AS x FROM p1 GROUP BY ALL) GROUP BY 1),
    s2 AS (SELECT k1.*, keep1 AND list_dot_product(embedding, m) / sqrt(list_dot_product(m, m)) >= {b} AS hit2
           FROM k1 JOIN m1 USING (agent_slug)),
    k2 AS (SELECT *, CASE WHEN sum(CAST(hit2 AS INT)) OVER (PARTITION BY agent_slug) < {m} THEN keep1 ELSE hit2 END AS keep FROM s2),
    p2 AS (SELECT agent_slug, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM k2 WHERE keep),
    m2 AS (SELECT agent_slug, list(x ORDER BY pos) AS m FROM (SELECT agent_slug, pos, avg(x) AS x FROM p2 GROUP BY ALL) GROUP BY 1),
    f AS (SELECT k2.*, list_dot_product(embedding, m) / sqrt(list_dot_product(m, m)) AS sim FROM k2 JOIN m2 USING (agent_slug))
    SELECT agent_slug, count(*) AS n, CAST(sum(CAST(keep AS INT)) AS BIGINT) AS n_kept,
           round(coalesce(avg(sim) FILTER (WHERE keep), 0), 6) AS inside,
           round(coalesce(max(sim) FILTER (WHERE NOT keep), 0), 6) AS outside
    FROM f GROUP BY agent_slug"""
_UNIT = """(SELECT agent_slug, vec_id, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS embedding
            FROM v_vectors)"""


def _tight_sql(a, b, m):
    return sql(_TIGHT.format(a=a, b=b, m=m).replace("v_unit", _UNIT), "v_vectors", "v_registry")


def _tight(spark, d, a, b, m):
    _, groups = V.tighten(W.vectors(spark, d), ["agent_slug"], a, b, m)
    return groups.select("agent_slug", "n", "n_kept", R6("inside").alias("inside"), R6("outside").alias("outside"))


# cuts fitted to the given vectors, then the parameters used for real voiceprints
@query("tighten", _tight_sql("0.10e0", "0.15e0", 15))
def _(spark, d):
    return _tight(spark, d, 0.10, 0.15, 15)


@query("tighten_default", _tight_sql("0.45e0", "0.55e0", 15))
def _(spark, d):
    return _tight(spark, d, 0.45, 0.55, 15)


@query("tighten_desk", _tight_sql("0.35e0", "0.45e0", 20))
def _(spark, d):
    return _tight(spark, d, 0.35, 0.45, 20)


_ONCE = """
    WITH s AS (SELECT v.agent_slug, v.vec_id, v.embedding, v.sim, v.n, {ok} AS ok, sum(CAST({ok} AS INT)) OVER (PARTITION BY v.agent_slug) AS n_ok
               FROM (SELECT v.agent_slug, v.vec_id, v.embedding,
                            list_dot_product(v.embedding, r.embedding) / sqrt(list_dot_product(v.embedding, v.embedding)) AS sim,
                            count(*) OVER (PARTITION BY v.agent_slug) AS n
                     FROM v_vectors v JOIN v_registry r USING (agent_slug)) v),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_slug ORDER BY sim DESC, vec_id) AS rn FROM s)
          WHERE CASE WHEN n_ok >= {least} THEN ok ELSE rn <= greatest(1, floor(n / 2e0)) END),
    p AS (SELECT agent_slug, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM k),
    m AS (SELECT agent_slug, list(x ORDER BY pos) AS m FROM (SELECT agent_slug, pos, avg(x) AS x FROM p GROUP BY ALL) GROUP BY 1),
    f AS (SELECT k.*, list_cosine_similarity(embedding, m) AS cos FROM k JOIN m USING (agent_slug))
    SELECT agent_slug, max(n) AS n, count(*) AS n_used, max(n_ok) < {least} AS relaxed, round(avg(cos), 6) AS mean_cosine,
           round(min(cos), 6) AS min_cosine, round(max(cos), 6) AS max_cosine FROM f GROUP BY agent_slug"""


def _once(spark, d, *args):
    out = V.drop_outliers_once(W.vectors(spark, d), ["agent_slug"], ["vec_id"], *args)
    return out.select("agent_slug", "n", "n_used", "relaxed", *[R6(c).alias(c) for c in ("mean_cosine", "min_cosine", "max_cosine")])


@query("drop_outliers_once", sql(_ONCE.format(ok="v.sim >= 0.15e0", least=1), "v_vectors", "v_registry"))
def _(spark, d):
    return _once(spark, d, 0.15)


@query("drop_outliers_relaxed", sql(_ONCE.format(ok="v.sim > 0.3e0", least=3), "v_vectors", "v_registry"))
def _(spark, d):
    return _once(spark, d, 0.3, True, 3)


@query("pairwise_coherence", sql("""
    SELECT agent_slug, count(*) AS n_pairs, round(avg(c), 6) AS coherence FROM (
      SELECT a.agent_slug, list_cosine_similarity(a.embedding, b.embedding) AS c
      FROM v_vectors a JOIN v_vectors b ON a.agent_slug = b.agent_slug AND a.vec_id < b.vec_id) GROUP BY agent_slug""", "v_vectors"))
def _(spark, d):
    out = V.pairwise_coherence(W.vectors(spark, d), ["agent_slug"])
    return out.select("agent_slug", F.floor(F.col("n") * (F.col("n") - 1) / 2).alias("n_pairs"), R6("coherence").alias("coherence"))


@query("match_voiceprints", sql("""
    SELECT vec_id, best_match, round(best_sim, 6) AS best_sim,
           CASE WHEN best_sim >= 0.15e0 THEN best_match ELSE 'Customer' END AS identity FROM v_best""", "v_best"))
def _(spark, d):
    out = matching.best_match(W.vectors(spark, d).select("vec_id", "embedding"), W.registry(spark, d), CUT)
    return out.select("vec_id", "best_match", R6("best_sim").alias("best_sim"), "identity")


@query("similarity_profile", sql("""
    SELECT call_id, agent_slug, round(avg(sim), 6) AS mean_sim, round(max(sim), 6) AS max_sim, count(*) AS n
    FROM v_scores GROUP BY ALL""", "v_scores"))
def _(spark, d):
    return _agent_scores(spark, d).groupBy("call_id", "agent_slug").agg(
        R6(F.avg("sim")).alias("mean_sim"), R6(F.max("sim")).alias("max_sim"), F.count("*").alias("n"))


def _agent_scores(spark, d):
    return matching.agent_scores(
        W.vectors(spark, d).select("call_id", "seg_idx", "vec_id", F.col("agent_slug").alias("own_slug"), "embedding"),
        W.registry(spark, d))


_TOP = """
    SELECT {key}, agent_slug, max(n) AS n, max(k) AS k, round(avg(sim), 6) AS top_mean FROM (
      SELECT *, least(n, greatest({floor}, CAST(floor(n * CAST(0.3 AS DOUBLE)) AS BIGINT))) AS k,
             row_number() OVER (PARTITION BY {key}, agent_slug ORDER BY sim DESC) AS rn
      FROM (SELECT *, count(*) OVER (PARTITION BY {key}, agent_slug) AS n FROM {src}))
    WHERE rn <= k GROUP BY {key}, agent_slug"""


@query("rank_agents_topmean", sql(_TOP.format(key="own_slug", floor=5, src="v_scores"), "v_scores"))
def _(spark, d):
    """A whole enrolment set plays the call, so that the top share exceeds its floor."""
    out = topk.top_fraction_mean(_agent_scores(spark, d), ["own_slug", "agent_slug"], "sim", 0.3, 5)
    return out.select("own_slug", "agent_slug", "n", "k", R6("top_mean").alias("top_mean"))


@query("rank_agents_best_only", sql("""
    WITH t AS (""" + _TOP.format(key="own_slug", floor=3, src="(SELECT own_slug, best_match AS agent_slug, best_sim AS sim FROM v_best)") + """)
    SELECT own_slug, agent_slug, n, k, top_mean, rank, CAST(round(share, 6) AS DOUBLE) AS share FROM (
      SELECT *, row_number() OVER (PARTITION BY own_slug ORDER BY top_mean DESC, agent_slug) AS rank,
             n / CAST(sum(n) OVER (PARTITION BY own_slug) AS DOUBLE) AS share FROM t) WHERE rank <= 3""", "v_best"))
def _(spark, d):
    from ..plans.desk import rank_winners

    best = matching.best_match(W.vectors(spark, d), W.registry(spark, d)).select(
        F.col("agent_slug").alias("own_slug"), F.col("best_match").alias("agent_slug"), F.col("best_sim").alias("sim"))
    out = rank_winners(best, "own_slug")
    return out.select("own_slug", "agent_slug", "n", "k", R6("top_mean").alias("top_mean"), "rank", R6("share").alias("share"))


@query("call_agent_by_mean", sql("""
    SELECT call_id, agent AS predicted_slug, round(m, 6) AS mean_sim FROM (
      SELECT call_id, best_match AS agent, avg(best_sim) AS m,
             row_number() OVER (PARTITION BY call_id ORDER BY avg(best_sim) DESC, min(seg_idx)) AS rn
      FROM v_best GROUP BY call_id, best_match) WHERE rn = 1""", "v_best"))
def _(spark, d):
    out = evaluate.call_agents(W.scored(spark, d))
    return out.select("call_id", "predicted_slug", R6("mean_sim").alias("mean_sim"))


@query("agent_threshold", sql("""
    SELECT agent_slug, round(outside, 6) AS max_outside, round(least(0.42e0, greatest(0.10e0, outside + 0.05e0)), 6) AS threshold
    FROM (SELECT agent_slug, max(sim) AS outside FROM v_scores WHERE own_slug <> agent_slug GROUP BY agent_slug)""", "v_scores"))
def _(spark, d):
    out = _agent_scores(spark, d).where(F.col("own_slug") != F.col("agent_slug")).groupBy("agent_slug").agg(F.max("sim").alias("o"))
    return out.select("agent_slug", R6("o").alias("max_outside"), R6(agent_threshold(0.10, F.col("o"))).alias("threshold"))


@query("voiceprint_health", sql("""
    SELECT agent_slug, round(inside, 6) AS inside, round(outside, 6) AS outside FROM (
      SELECT agent_slug, avg(sim) FILTER (WHERE own_slug = agent_slug) AS inside, max(sim) FILTER (WHERE own_slug <> agent_slug) AS outside
      FROM v_scores GROUP BY agent_slug) WHERE outside >= inside""", "v_scores"))
def _(spark, d):
    own = F.col("own_slug") == F.col("agent_slug")
    stats = _agent_scores(spark, d).groupBy("agent_slug").agg(
        F.avg(F.when(own, F.col("sim"))).alias("inside"), F.max(F.when(~own, F.col("sim"))).alias("outside"))
    return voiceprint_health(stats).select("agent_slug", R6("inside").alias("inside"), R6("outside").alias("outside"))


_METRICS = """round(tp / greatest(tp + fp, 1), 4) AS precision, round(tp / greatest(tp + fn, 1), 4) AS recall,
    round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1))
          / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-9), 4) AS f1,
    round((tp + tn) / greatest(tp + fp + tn + fn, 1), 4) AS accuracy"""
_COUNTS = """CAST(sum(CASE WHEN {t} AND {p} THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN NOT ({t}) AND {p} THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
    CAST(sum(CASE WHEN NOT ({t}) AND NOT ({p}) THEN 1 ELSE 0 END) AS DOUBLE) AS tn, CAST(sum(CASE WHEN {t} AND NOT ({p}) THEN 1 ELSE 0 END) AS DOUBLE) AS fn"""
_INTS = "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn"


@query("confusion", f"""
    SELECT lang, {_INTS}, {_METRICS} FROM (
      SELECT d.lang, {_COUNTS.format(t="l.quality = 1", p="d.n_chars >= 200")}
      FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang)""")
def _(spark, d):
    rows = W.table(spark, d, "labels").join(W.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return evaluate.confusion(rows, ["lang"], F.col("quality") == 1, F.col("n_chars") >= 200)


_EVAL = f"""
    SELECT c.*, p.predicted_slug, p.predicted_slug = c.expected_slug AS correct_call FROM (
      SELECT call_id, expected_slug, {_COUNTS.format(t="is_agent", p="best_sim >= 0.15e0")},
             CAST(sum(CAST(is_agent AS INT)) AS BIGINT) AS agent_phrases,
             CAST(sum(CASE WHEN is_agent AND best_sim >= 0.15e0 AND best_match = expected_slug THEN 1 ELSE 0 END) AS BIGINT) AS agent_hits
      FROM v_scored GROUP BY call_id, expected_slug) c
    JOIN (SELECT call_id, best_match AS predicted_slug, row_number() OVER (PARTITION BY call_id ORDER BY avg(best_sim) DESC, min(seg_idx)) AS rn
          FROM v_scored GROUP BY call_id, best_match) p ON p.call_id = c.call_id AND p.rn = 1"""


@query("evaluate_calls", sql(f"""
    SELECT call_id, expected_slug, {_INTS}, agent_phrases, agent_hits, predicted_slug, correct_call FROM ({_EVAL})""", "v_scored"))
def _(spark, d):
    return evaluate.call_evaluation(W.scored(spark, d), CUT)


@query("confusion_by_bucket", sql(f"""
    SELECT level, expected_slug, bucket, calls, correct_calls, {_INTS}, {_METRICS}, round(correct_calls / CAST(calls AS DOUBLE), 4) AS call_accuracy
    FROM (SELECT CASE WHEN grouping(bucket) = 0 THEN 'bucket' WHEN grouping(expected_slug) = 0 THEN 'expected_slug' ELSE 'overall' END AS level,
                 expected_slug, bucket, count(*) AS calls, CAST(sum(CAST(correct_call AS INT)) AS BIGINT) AS correct_calls,
                 sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn
          FROM (SELECT e.*, CASE WHEN s >= 1.9e0 THEN 'high' WHEN s >= 1.7e0 THEN 'mid' ELSE 'low' END AS bucket
                FROM ({_EVAL}) e JOIN (SELECT call_id, round(sum(best_sim), 9) AS s FROM v_scored GROUP BY call_id) USING (call_id))
          GROUP BY GROUPING SETS ((), (bucket), (expected_slug)))""", "v_scored"))
def _(spark, d):
    scored = W.scored(spark, d)
    level = scored.groupBy("call_id").agg(F.round(F.sum("best_sim"), 9).alias("s")).select(
        "call_id", F.when(F.col("s") >= 1.9, "high").when(F.col("s") >= 1.7, "mid").otherwise("low").alias("bucket"))
    calls = evaluate.call_evaluation(scored, CUT).join(level, "call_id")
    return evaluate.summarise_calls(calls, [[], ["bucket"], ["expected_slug"]])


_STEPS = [0.10, 0.125, 0.15, 0.175, 0.20, 0.225, 0.25]


@query("threshold_sweep", sql(f"""
    WITH t AS (SELECT unnest([{", ".join(f"CAST({t} AS DOUBLE)" for t in _STEPS)}]) AS threshold),
    m AS (SELECT threshold, {_INTS}, {_METRICS} FROM (
            SELECT threshold, {_COUNTS.format(t="is_agent", p="best_sim >= threshold")} FROM v_scored, t GROUP BY threshold)),
    e AS ({_EVAL})
    SELECT m.threshold, tp, fp, tn, fn, precision, recall, f1, c.calls, c.accuracy,
           threshold = min(threshold) OVER () AS is_best_accuracy, f1 = max(f1) OVER () AS is_best_f1
    FROM (SELECT * EXCLUDE (accuracy) FROM m) m,
         (SELECT count(*) AS calls, round(avg(CAST(correct_call AS INT)), 4) AS accuracy FROM e) c""", "v_scored"))
def _(spark, d):
    return evaluate.threshold_sweep(W.scored(spark, d), _STEPS)


@query("head_to_head", sql(f"""
    WITH e AS ({_EVAL}),
    o AS (SELECT call_id, min_by(best_match, seg_idx) = min(expected_slug) AS ok FROM v_scored GROUP BY call_id)
    SELECT CAST(sum(CAST(e.correct_call AND NOT o.ok AS INT)) AS BIGINT) AS helped,
           CAST(sum(CAST(o.ok AND NOT e.correct_call AS INT)) AS BIGINT) AS hurt,
           CAST(sum(CAST(o.ok = e.correct_call AS INT)) AS BIGINT) AS same FROM e JOIN o USING (call_id)""", "v_scored"))
def _(spark, d):
    """Mean similarity against taking the first segment's match."""
    scored = W.scored(spark, d)
    other = scored.groupBy("call_id").agg(
        (F.min_by("best_match", "seg_idx") == F.min("expected_slug")).alias("correct_call"))
    return evaluate.head_to_head(evaluate.call_evaluation(scored, CUT), other)


@query("majority_identity", sql("""
    WITH s AS (SELECT call_id, seg_idx, CASE WHEN seg_idx < 5 THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS speaker,
                      CASE WHEN best_sim >= 0.15e0 THEN best_match ELSE 'Customer' END AS identity, best_sim AS confidence FROM v_best),
    w AS (SELECT * FROM (SELECT call_id, speaker, identity, round(sum(confidence) / count(*), 4) AS conf,
                 row_number() OVER (PARTITION BY call_id, speaker ORDER BY round(sum(confidence), 9) DESC, min(seg_idx)) AS rn
          FROM s GROUP BY call_id, speaker, identity) WHERE rn = 1)
    SELECT s.call_id, s.seg_idx, s.speaker, w.identity AS identified_speaker, w.conf AS confidence FROM s JOIN w USING (call_id, speaker)""", "v_best"))
def _(spark, d):
    m = matching.best_match(W.vectors(spark, d), W.registry(spark, d), CUT).select(
        "call_id", "seg_idx", F.when(F.col("seg_idx") < 5, "SPEAKER_00").otherwise("SPEAKER_01").alias("speaker"),
        "identity", F.col("best_sim").alias("confidence"))
    return roles.majority_identity(m)


@query("two_speaker_split")
def _(spark, d):
    return cluster.two_speaker_split(_timed_vectors(spark, d))


def _timed_vectors(spark, d):
    return W.segments(spark, d).drop("speaker").join(
        W.vectors(spark, d).select("call_id", "seg_idx", "embedding"), ["call_id", "seg_idx"], "left")


@query("choose_customer_k")
def _(spark, d):
    return cluster.choose_customer_k(W.vectors(spark, d), ["call_id"]).select("call_id", "seg_idx", "agent_slug", "cluster")


@query("voiceprint_centroids")
def _(spark, d):
    return cluster.voiceprint_centroids(W.vectors(spark, d), ["agent_slug"], "vec_id").select(
        "agent_slug", "vp_idx", "n_clips", F.size("embedding").alias("dim"))


@query("larger_cluster_is_agent")
def _(spark, d):
    return cluster.larger_cluster(W.vectors(spark, d), ["call_id"], "seg_idx").select("call_id", "n_windows", "n_agent")


@query("cluster_first_roles")
def _(spark, d):
    s = _timed_vectors(spark, d)
    own = matching.best_match(s, W.registry(spark, d)).withColumn("sim", F.coalesce("best_sim", F.lit(0.0)))
    out = cluster.cluster_first_roles(own)
    return out.select("call_id", "seg_idx", R6("sim").alias("sim"), "is_agent", "customer_idx", "clustered")
