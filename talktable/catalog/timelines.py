"""Queries on timed intervals and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as FR
from ..operators import intervals as I
from ..operators import roles
from ..operators.ordered import row_block
from ..sources.calls import min_duration
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


def R(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


_PAIRS = """
    v_pairs AS (SELECT a.call_id, a.seg_idx, a.start_s, a.end_s, a.identified_speaker, b.turn_idx, b.start_s AS r_start_s,
                       b.end_s AS r_end_s, b.speaker, b.is_agent, least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s) AS overlap_s
                FROM v_system a JOIN v_turns b ON a.call_id = b.call_id AND a.start_s < b.end_s AND b.start_s < a.end_s
                WHERE a.end_s > a.start_s AND b.end_s > b.start_s)"""


@query("overlap_seconds", sql(f"""
    WITH {_PAIRS} SELECT call_id, seg_idx, turn_idx, round(overlap_s, 6) AS overlap_s, round(overlap_s / (end_s - start_s), 6) AS fraction FROM v_pairs""", "v_system"))
def _(spark, d):
    p = I.overlapping(W.system(spark, d), W.turns(spark, d))
    args = [F.col(c) for c in ("start_s", "end_s", "r_start_s", "r_end_s")]
    return p.select("call_id", "seg_idx", F.col("r_turn_idx").alias("turn_idx"),
                    F.round(I.overlap_seconds(*args), 6).alias("overlap_s"), F.round(I.overlap_fraction(*args), 6).alias("fraction"))


@query("assign_dominant_speaker", sql(f"""
    WITH {_PAIRS},
    b AS (SELECT call_id, seg_idx, speaker, s, row_number() OVER (PARTITION BY call_id, seg_idx ORDER BY round(s, 9) DESC, f) AS rn
          FROM (SELECT call_id, seg_idx, speaker, sum(overlap_s) AS s, min(turn_idx) AS f FROM v_pairs GROUP BY ALL))
    SELECT v.call_id, v.seg_idx, coalesce(b.speaker, 'UNKNOWN') AS speaker, round(b.s, 6) AS overlap_s
    FROM v_system v LEFT JOIN b ON v.call_id = b.call_id AND v.seg_idx = b.seg_idx AND b.rn = 1""", "v_system"))
def _(spark, d):
    out = I.assign_dominant_speaker(W.system(spark, d), W.turns(spark, d))
    return out.select("call_id", "seg_idx", "speaker", *R("overlap_s"))


@query("best_overlap_match", sql(f"""
    WITH {_PAIRS}
    SELECT call_id, seg_idx, turn_idx, is_agent, identified_speaker, round(f, 6) AS fraction FROM (
      SELECT *, row_number() OVER (PARTITION BY call_id, seg_idx ORDER BY f DESC, turn_idx) AS rn
      FROM (SELECT *, round(overlap_s / (end_s - start_s), 9) AS f FROM v_pairs)) WHERE rn = 1 AND f >= 0.01e0""", "v_system"))
def _(spark, d):
    out = I.best_overlap_match(W.system(spark, d), W.turns(spark, d).withColumnRenamed("turn_idx", "phrase_idx"))
    return out.select("call_id", "seg_idx", F.col("p_phrase_idx").alias("turn_idx"), F.col("p_is_agent").alias("is_agent"),
                      "identified_speaker", *R("fraction"))


@query("segment_confusion", sql(f"""
    WITH {_PAIRS},
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id, seg_idx ORDER BY f DESC, turn_idx) AS rn
          FROM (SELECT *, round(overlap_s / (end_s - start_s), 9) AS f FROM v_pairs)) WHERE rn = 1 AND f >= 0.01e0),
    c AS (SELECT call_id, CAST(sum(CAST(identified_speaker = 'AGENT' AND is_agent AS INT)) AS DOUBLE) AS tp,
                 CAST(sum(CAST(identified_speaker = 'AGENT' AND NOT is_agent AS INT)) AS DOUBLE) AS fp,
                 CAST(sum(CAST(identified_speaker <> 'AGENT' AND NOT is_agent AS INT)) AS DOUBLE) AS tn,
                 CAST(sum(CAST(identified_speaker <> 'AGENT' AND is_agent AS INT)) AS DOUBLE) AS fn FROM m GROUP BY call_id)
    SELECT call_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
           round(tp / greatest(tp + fp, 1), 4) AS precision, round(tp / greatest(tp + fn, 1), 4) AS recall,
           round((tp + tn) / greatest(tp + fp + tn + fn, 1), 4) AS accuracy FROM c""", "v_system"))
def _(spark, d):
    from ..operators.evaluate import confusion

    m = I.best_overlap_match(W.system(spark, d), W.turns(spark, d).withColumnRenamed("turn_idx", "phrase_idx"))
    return confusion(m, ["call_id"], F.col("p_is_agent"), F.col("identified_speaker") == "AGENT").drop("f1")


@query("region_vote", sql(f"""
    WITH {_PAIRS}
    SELECT call_id, role AS speaker, round(s, 6) AS votes_s FROM (
      SELECT call_id, identified_speaker AS role, sum(overlap_s) AS s,
             row_number() OVER (PARTITION BY call_id ORDER BY round(sum(overlap_s), 9) DESC, min(seg_idx)) AS rn
      FROM v_pairs WHERE is_agent GROUP BY call_id, identified_speaker) WHERE rn = 1""", "v_system"))
def _(spark, d):
    s = W.system(spark, d).withColumnRenamed("identified_speaker", "speaker")
    return I.region_vote(s, W.turns(spark, d).where("is_agent")).select("call_id", "speaker", *R("votes_s"))


_TICKS = """
    ticks_t AS (SELECT call_id, tick, min_by(is_agent, turn_idx) AS truth FROM (
        SELECT call_id, turn_idx, is_agent, unnest(generate_series(CAST(ceil(start_s / 0.5e0) AS BIGINT), CAST(floor(end_s / 0.5e0) AS BIGINT))) AS tick
        FROM v_turns) GROUP BY ALL),
    ticks_s AS (SELECT call_id, tick, min_by(identified_speaker = 'AGENT', seg_idx) AS ours FROM (
        SELECT call_id, seg_idx, identified_speaker, unnest(generate_series(CAST(ceil(start_s / 0.5e0) AS BIGINT), CAST(floor(end_s / 0.5e0) AS BIGINT))) AS tick
        FROM v_system) GROUP BY ALL)"""


def _sides(spark, d):
    truth = W.turns(spark, d).select("call_id", F.col("turn_idx").alias("idx"), "start_s", "end_s", F.col("is_agent").alias("truth"))
    ours = W.system(spark, d).select(
        "call_id", F.col("seg_idx").alias("idx"), "start_s", "end_s", (F.col("identified_speaker") == "AGENT").alias("ours"))
    return truth, ours


@query("label_at_tick", sql(f"""
    WITH {_TICKS} SELECT call_id, tick, truth, ours FROM ticks_t JOIN ticks_s USING (call_id, tick)""", "v_system"))
def _(spark, d):
    from ..operators.ticks import joint_labels

    return joint_labels(*_sides(spark, d))


@query("tick_accuracy", sql(f"""
    WITH {_TICKS}
    SELECT call_id, count(*) AS ticks, round(100.0 * avg(CAST(truth = ours AS INT)), 4) AS overall_pct,
           round(100.0 * coalesce(avg(CAST(ours AS INT)) FILTER (WHERE truth), 0), 4) AS agent_pct,
           round(100.0 * coalesce(avg(CAST(NOT ours AS INT)) FILTER (WHERE NOT truth), 0), 4) AS customer_pct
    FROM ticks_t JOIN ticks_s USING (call_id, tick) GROUP BY call_id""", "v_system"))
def _(spark, d):
    from ..operators.ticks import interval_accuracy

    return interval_accuracy(*_sides(spark, d))


@query("tick_accuracy_macro", sql(f"""
    WITH {_TICKS}, c AS (SELECT call_id, avg(CAST(truth = ours AS INT)) AS o, coalesce(avg(CAST(ours AS INT)) FILTER (WHERE truth), 0) AS a,
           coalesce(avg(CAST(NOT ours AS INT)) FILTER (WHERE NOT truth), 0) AS cu
    FROM ticks_t JOIN ticks_s USING (call_id, tick) GROUP BY call_id)
    SELECT count(*) AS calls, round(100 * avg(o), 3) AS overall_pct, round(100 * avg(a), 3) AS agent_pct, round(100 * avg(cu), 3) AS customer_pct FROM c""", "v_system"))
def _(spark, d):
    from ..operators.ticks import interval_accuracy, macro_accuracy

    return macro_accuracy(interval_accuracy(*_sides(spark, d), digits=9), 3)


@query("label_at_mid", sql("""
    SELECT s.call_id, s.seg_idx, min_by(t.speaker, t.turn_idx) AS speaker
    FROM v_system s LEFT JOIN v_turns t ON s.call_id = t.call_id AND (s.start_s + s.end_s) / 2 BETWEEN t.start_s AND t.end_s
    GROUP BY s.call_id, s.seg_idx""", "v_system"))
def _(spark, d):
    return I.label_at_mid(W.system(spark, d), W.turns(spark, d), "speaker", "turn_idx").select("call_id", "seg_idx", "speaker")


@query("words_in_utterance", sql("""
    SELECT u.call_id, u.seg_idx, w.turn_idx AS word_idx, w.speaker AS word
    FROM v_system u JOIN v_turns w ON u.call_id = w.call_id AND w.start_s >= u.start_s - 0.05e0 AND w.end_s <= u.end_s + 0.05e0""", "v_system"))
def _(spark, d):
    words = W.turns(spark, d).select("call_id", F.col("turn_idx").alias("word_idx"), F.col("speaker").alias("word"), "start_s", "end_s")
    return I.words_in_utterances(W.system(spark, d), words).select("call_id", "seg_idx", "word_idx", "word")


_NEAR = """
    near AS (SELECT a.call_id, a.turn_idx, a.start_s, a.end_s, EXISTS (
        SELECT 1 FROM v_turns c WHERE c.call_id = a.call_id AND NOT c.is_agent AND c.start_s < a.end_s + {b} AND c.end_s > a.start_s - {b}) AS near
      FROM v_turns a WHERE a.is_agent)"""


@query("purity_filter", sql(f"""
    WITH {_NEAR.format(b="2e0")} SELECT call_id, turn_idx AS phrase_idx FROM near WHERE NOT near AND end_s - start_s >= 0.4e0""", "v_turns"))
def _(spark, d):
    return I.purity_filter(W.turns(spark, d).withColumnRenamed("turn_idx", "phrase_idx"), 2.0, 0.4).select("call_id", "phrase_idx")


@query("purity_ratio", sql(f"""
    WITH {_NEAR.format(b="3e0")}
    SELECT call_id, count(*) AS agent_phrases, CAST(sum(CAST(NOT near AND end_s - start_s >= 0.4e0 AS INT)) AS BIGINT) AS clean_phrases,
           round(avg(CAST(NOT near AND end_s - start_s >= 0.4e0 AS INT)), 6) AS purity,
           avg(CAST(NOT near AND end_s - start_s >= 0.4e0 AS INT)) >= 0.9e0 AS passes FROM near GROUP BY call_id""", "v_turns"))
def _(spark, d):
    return I.purity_ratio(W.turns(spark, d).withColumnRenamed("turn_idx", "phrase_idx"), 3.0, 0.4, 0.9)


@query("nearest_in_time", sql("""
    WITH r AS (SELECT call_id, turn_idx, (start_s + end_s) / 2 AS mid, CASE WHEN end_s - start_s >= 60 THEN speaker END AS label FROM v_turns)
    SELECT a.call_id, a.turn_idx AS seg_idx, coalesce(a.label, min_by(b.label, (abs(a.mid - b.mid), b.turn_idx))) AS label
    FROM r a LEFT JOIN r b ON a.call_id = b.call_id AND a.label IS NULL AND b.label IS NOT NULL
    GROUP BY a.call_id, a.turn_idx, a.label""", "v_turns"))
def _(spark, d):
    label = F.when(F.col("end_s") - F.col("start_s") >= 60, F.col("speaker"))
    rows = W.turns(spark, d).select("call_id", F.col("turn_idx").alias("seg_idx"), "start_s", "end_s", label.alias("label"))
    return I.nearest_in_time(rows, "label").select("call_id", "seg_idx", "label")


@query("split_at_turns", sql("""
    WITH s AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM v_segments),
    cuts AS (SELECT DISTINCT s.call_id, s.seg_idx, t.end_s - 0.25e0 AS cut FROM s JOIN v_segments p ON p.call_id = s.call_id,
             (SELECT unnest([0.3e0, 0.6e0]) AS f) q, LATERAL (SELECT p.start_s + (p.end_s - p.start_s) * q.f + 0.25e0 AS end_s) t
             WHERE s.end_s - s.start_s >= 2 AND len(s.w) >= 4 AND t.end_s - 0.25e0 > s.start_s + 1 AND t.end_s - 0.25e0 < s.end_s - 1),
    b AS (SELECT call_id, seg_idx, list_concat(list(cut ORDER BY cut)) AS cuts FROM cuts GROUP BY ALL),
    j AS (SELECT s.*, b.cuts, list_concat([s.start_s], b.cuts, [s.end_s]) AS edges FROM s LEFT JOIN b USING (call_id, seg_idx)),
    p AS (SELECT *, list_transform(edges, lambda t: CAST(floor(len(w) * (t - start_s) / greatest(end_s - start_s, 0.01e0)) AS BIGINT)) AS spot FROM j),
    k AS (SELECT *, cuts IS NOT NULL AND list_min(list_transform(generate_series(1, len(spot) - 1), lambda i: spot[i + 1] - spot[i])) >= 2 AS split FROM p)
    SELECT call_id, seg_idx, CAST(i - 1 AS BIGINT) AS part_idx,
           round(CASE WHEN split THEN edges[i] ELSE start_s END, 2) AS start_s, round(CASE WHEN split THEN edges[i + 1] ELSE end_s END, 2) AS end_s,
           CASE WHEN split THEN spot[i + 1] - spot[i] ELSE len(w) END AS n_words
    FROM (SELECT *, unnest(generate_series(1, CASE WHEN split THEN len(spot) - 1 ELSE 1 END)) AS i FROM k)""", "v_segments"))
def _(spark, d):
    from ..functions.text import split_words

    s = W.segments(spark, d)
    at = lambda f: F.col("start_s") + (F.col("end_s") - F.col("start_s")) * f + 0.25 - 0.25
    turns = s.select("call_id", F.explode(F.array(at(F.lit(0.3)), at(F.lit(0.6)))).alias("start_s"))
    out = I.split_at_turns(s, turns)
    return out.select("call_id", "seg_idx", F.col("part_idx").cast("bigint").alias("part_idx"), *R("start_s", "end_s", digits=2),
                      F.size(split_words(F.col("text"))).cast("bigint").alias("n_words"))


@query("merge_same_speaker", sql("""
    WITH l AS (SELECT *, lag(end_s) OVER w AS pe, lag(speaker) OVER w AS ps FROM v_turns WINDOW w AS (PARTITION BY call_id ORDER BY start_s, turn_idx)),
    i AS (SELECT *, sum(CASE WHEN ps = speaker AND start_s - pe <= 0.5e0 THEN 0 ELSE 1 END) OVER (PARTITION BY call_id ORDER BY start_s, turn_idx) AS island FROM l)
    SELECT call_id, CAST(island AS BIGINT) AS island, min(speaker) AS speaker, round(min(start_s), 6) AS start_s,
           round(max_by(end_s, (start_s, turn_idx)), 6) AS end_s, count(*) AS n_turns FROM i GROUP BY call_id, island""", "v_turns"))
def _(spark, d):
    out = I.merge_same_speaker(W.turns(spark, d), 0.5)
    return out.select("call_id", F.col("island").cast("bigint").alias("island"), "speaker", *R("start_s", "end_s"), "n_turns")


_BLOCKS = """
    WITH p AS (SELECT call_id, greatest(0, start_s - {a}) AS s, end_s + {z} AS e FROM v_turns),
    r AS (SELECT *, max(e) OVER (PARTITION BY call_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
    i AS (SELECT *, sum(CASE WHEN s - reach {op} {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY call_id ORDER BY s, e, reach ROWS UNBOUNDED PRECEDING) AS block FROM r),
    b AS (SELECT call_id, block, min(s) AS start_s, max(e) AS end_s, count(*) AS n_intervals FROM i GROUP BY call_id, block)"""
_PICK = " SELECT call_id, CAST(block AS BIGINT) AS block, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, n_intervals FROM b"


def _blocks(spark, d, *args, **kw):
    return I.merge_blocks(W.turns(spark, d), *args, **kw)


def _blocks_out(b):
    return b.select("call_id", F.col("block").cast("bigint").alias("block"), *R("start_s", "end_s"), "n_intervals")


@query("merge_blocks", sql(_BLOCKS.format(a="0.3e0", z="0.3e0", op="<=", gap="1.5e0") + _PICK, "v_turns"))
def _(spark, d):
    return _blocks_out(_blocks(spark, d, 1.5, 0.3))


@query("merge_blocks_wide", sql(_BLOCKS.format(a="1e0", z="1e0", op="<=", gap="5e0") + _PICK, "v_turns"))
def _(spark, d):
    return _blocks_out(_blocks(spark, d, 5.0, 1.0))


@query("merge_blocks_strict", sql(_BLOCKS.format(a="0.15e0", z="0.22e0", op="<", gap="1.5e0") + _PICK, "v_turns"))
def _(spark, d):
    return _blocks_out(_blocks(spark, d, 1.5, 0.15, 0.22, inclusive=False))


_CLEAN = _BLOCKS.format(a="0e0", z="0e0", op="<=", gap="0.5e0") + """,
    m AS (SELECT *, coalesce(sum(end_s - start_s) OVER (PARTITION BY call_id ORDER BY start_s, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clean FROM b)"""


@query("remap_time", sql(_CLEAN + """
    SELECT call_id, CAST(block AS BIGINT) AS block, round(start_s, 6) AS start_s, round(clean, 6) AS clean_start_s,
           round(clean + (end_s - start_s), 6) AS clean_end_s FROM m""", "v_turns"))
def _(spark, d):
    return I.remap_time(_blocks(spark, d, 0.5)).select(
        "call_id", F.col("block").cast("bigint").alias("block"), *R("start_s", "clean_start_s", "clean_end_s"))


@query("to_clean_time", sql(_CLEAN + """
    SELECT s.call_id, s.seg_idx, round(s.start_s - m.start_s + m.clean, 6) AS clean_time_s
    FROM v_system s LEFT JOIN m ON m.call_id = s.call_id AND s.start_s >= m.start_s AND s.start_s < m.end_s""", "v_turns", "v_system"))
def _(spark, d):
    points = W.system(spark, d).select("call_id", "seg_idx", F.col("start_s").alias("time_s"))
    return I.to_clean_time(points, _blocks(spark, d, 0.5)).select("call_id", "seg_idx", *R("clean_time_s"))


@query("pick_clips", sql(_BLOCKS.format(a="0e0", z="0e0", op="<=", gap="0.5e0") + """
    SELECT call_id, CAST(block AS BIGINT) AS block, round(len, 6) AS length_s, nth FROM (
      SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY len DESC, start_s) AS nth
      FROM (SELECT *, round(end_s - start_s, 6) AS len FROM b) WHERE len BETWEEN 1.5e0 AND 20e0) WHERE nth <= 5""", "v_turns"))
def _(spark, d):
    out = I.pick_clips(_blocks(spark, d, 0.5), n=5)
    return out.select("call_id", F.col("block").cast("bigint").alias("block"), *R("length_s"), F.col("nth").cast("bigint").alias("nth"))


@query("sliding_windows", sql("""
    SELECT call_id, CAST(w AS BIGINT) AS win_idx, round(w * 1e0, 6) AS win_start_s, round(w * 1e0 + 2, 6) AS win_end_s FROM (
      SELECT call_id, unnest(generate_series(0, CAST(ceil(round(duration_s - 2, 9)) AS BIGINT) - 1)) AS w FROM v_calls WHERE duration_s >= 2)""", "v_calls"))
def _(spark, d):
    return I.sliding_windows(W.calls(spark, d).select("call_id", "duration_s"), 2.0, 1.0, False).select(
        "call_id", "win_idx", *R("win_start_s", "win_end_s"))


@query("sliding_windows_desk", sql("""
    SELECT call_id, CAST(w AS BIGINT) AS win_idx, round(w * 0.75e0, 6) AS win_start_s, round(w * 0.75e0 + 1.5e0, 6) AS win_end_s FROM (
      SELECT call_id, unnest(generate_series(0, CAST(floor(round((duration_s - 1.5e0) / 0.75e0, 9)) AS BIGINT))) AS w FROM v_calls WHERE duration_s >= 1.5e0)""", "v_calls"))
def _(spark, d):
    return I.sliding_windows(W.calls(spark, d).select("call_id", "duration_s"), 1.5, 0.75, True).select(
        "call_id", "win_idx", *R("win_start_s", "win_end_s"))


@query("fixed_chunks", sql("""
    SELECT * FROM (SELECT call_id, CAST(c AS BIGINT) AS chunk_idx, c * 30e0 AS chunk_start_s, round(least(c * 30e0 + 30, duration_s), 6) AS chunk_end_s FROM (
      SELECT call_id, duration_s, unnest(generate_series(0, CAST(ceil(duration_s / 30e0) AS BIGINT) - 1)) AS c FROM v_calls))
    WHERE chunk_end_s - chunk_start_s >= 0.5e0""", "v_calls"))
def _(spark, d):
    return I.fixed_chunks(W.calls(spark, d).select("call_id", "duration_s"), 30.0, 0.5).select(
        "call_id", "chunk_idx", "chunk_start_s", *R("chunk_end_s"))


@query("group_words_by_speaker", sql("""
    WITH l AS (SELECT *, lag(speaker) OVER w AS ps FROM v_turns WINDOW w AS (PARTITION BY call_id ORDER BY turn_idx)),
    i AS (SELECT *, sum(CASE WHEN ps IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END) OVER (PARTITION BY call_id ORDER BY turn_idx) AS utt FROM l)
    SELECT call_id, CAST(utt AS BIGINT) AS utt_idx, min(speaker) AS speaker, round(min_by(start_s, turn_idx), 6) AS start_s, round(max_by(end_s, turn_idx), 6) AS end_s,
           count(*) AS n_words, string_agg(CAST(turn_idx AS VARCHAR), ' ' ORDER BY turn_idx) AS text FROM i GROUP BY call_id, utt""", "v_turns"))
def _(spark, d):
    words = W.turns(spark, d).select("call_id", F.col("turn_idx").alias("word_idx"), F.col("turn_idx").cast("string").alias("word"),
                                     "speaker", "start_s", "end_s")
    out = I.group_words_by_speaker(words)
    return out.select("call_id", F.col("utt_idx").cast("bigint").alias("utt_idx"), "speaker", *R("start_s", "end_s"), "n_words", "text")


@query("number_customers", sql("""
    SELECT call_id, speaker AS cluster, nth, 'Customer ' || nth AS display_speaker, 'SPEAKER_' || lpad(CAST(nth AS VARCHAR), 2, '0') AS speaker FROM (
      SELECT call_id, speaker, row_number() OVER (PARTITION BY call_id ORDER BY min(start_s), speaker) AS nth FROM v_turns WHERE NOT is_agent GROUP BY call_id, speaker)""", "v_turns"))
def _(spark, d):
    t = W.turns(spark, d).where(~F.col("is_agent")).withColumnRenamed("speaker", "cluster")
    return I.number_customers(t).select("call_id", "cluster", F.col("nth").cast("bigint").alias("nth"), "display_speaker", "speaker")


@query("speaker_flips", sql("""
    SELECT call_id, count(*) AS n_turns, CAST(coalesce(sum(CAST(speaker <> ps AS INT)), 0) AS BIGINT) AS flips
    FROM (SELECT *, lag(speaker) OVER (PARTITION BY call_id ORDER BY turn_idx) AS ps FROM v_turns) GROUP BY call_id""", "v_turns"))
def _(spark, d):
    return I.speaker_flips(W.turns(spark, d))


@query("min_duration", sql("SELECT call_id, turn_idx FROM v_turns WHERE end_s - start_s >= 1", "v_turns"))
def _(spark, d):
    return min_duration(W.turns(spark, d), 1.0).select("call_id", "turn_idx")


_SNR = """
    s AS (SELECT f.call_id, n, f.rms FROM v_frames f JOIN (SELECT call_id, count(*) AS n, quantile_cont(rms, 0.5) AS m FROM v_frames GROUP BY call_id) q
          ON f.call_id = q.call_id AND f.rms >= q.m),
    snr AS (SELECT call_id, max(n) AS n_frames, CASE WHEN max(n) < 8 OR count(*) < 4 THEN 0 ELSE
              20 * log10(greatest(quantile_cont(rms, 0.95), 1e-12) / greatest(quantile_cont(rms, 0.20), 1e-6)) END AS snr_db FROM s GROUP BY call_id)"""


@query("estimate_snr", sql(f"WITH {_SNR} SELECT call_id, n_frames, round(snr_db, 6) AS snr_db FROM snr", "v_frames"))
def _(spark, d):
    return FR.estimate_snr(W.frames(spark, d)).select("call_id", "n_frames", *R("snr_db"))


@query("snr_bucket", sql(f"""
    WITH {_SNR} SELECT call_id, CASE WHEN snr_db >= 20 THEN 'high' WHEN snr_db >= 12 THEN 'mid' ELSE 'low' END AS bucket FROM snr""", "v_frames"))
def _(spark, d):
    from ..functions.vectors import snr_bucket

    return FR.estimate_snr(W.frames(spark, d)).select("call_id", snr_bucket(F.col("snr_db")).alias("bucket"))


@query("speech_ratio", sql("""
    SELECT f.call_id, count(*) AS n_frames, round(CASE WHEN count(*) < 4 THEN 0 ELSE avg(CAST(rms > greatest(1.5e0 * m, 0.005e0) AS INT)) END, 6) AS speech_ratio
    FROM v_frames f JOIN (SELECT call_id, quantile_cont(rms, 0.5) AS m FROM v_frames GROUP BY call_id) USING (call_id) GROUP BY f.call_id""", "v_frames"))
def _(spark, d):
    return FR.speech_ratio(W.frames(spark, d), ["call_id"]).select("call_id", "n_frames", *R("speech_ratio"))


@query("audible_chunks", sql("""
    SELECT call_id, chunk, round(v, 6) AS voiced FROM (SELECT call_id, CAST(floor(frame_idx / 10e0) AS BIGINT) AS chunk, avg(CAST(rms > 90 AS INT)) AS v
    FROM v_frames GROUP BY ALL) WHERE v >= 0.08e0""", "v_frames"))
def _(spark, d):
    f = W.frames(spark, d).withColumn("chunk", F.floor(F.col("frame_idx") / 10.0))
    return FR.audible_chunks(f, ["call_id", "chunk"], 90.0).select("call_id", "chunk", *R("voiced"))


# frames of 30 ms and windows of 150 ms every 60 ms, so that a call of some 60 frames has many windows
@query("speech_windows", sql("""
    WITH q AS (SELECT call_id, count(*) AS n, quantile_cont(rms, 0.6) AS m FROM v_frames GROUP BY call_id),
    w AS (SELECT call_id, m, unnest(generate_series(0, CAST(floor((n * 30 - 150) / 60e0) AS BIGINT))) AS win_idx FROM q WHERE n * 30 >= 150)
    SELECT w.call_id, w.win_idx, round(avg(CAST(f.rms >= m AS INT)), 6) AS active, avg(CAST(f.rms >= m AS INT)) >= 0.3e0 AS is_speech
    FROM w JOIN v_frames f ON f.call_id = w.call_id AND f.frame_idx >= floor(win_idx * 60 / 30e0) AND f.frame_idx < floor((win_idx * 60 + 150) / 30e0)
    GROUP BY w.call_id, w.win_idx""", "v_frames"))
def _(spark, d):
    return FR.speech_windows(W.frames(spark, d), 0.030, 0.150, 0.060).select("call_id", "win_idx", *R("active"), "is_speech")


@query("energy_gate", sql("""
    SELECT call_id, turn_idx FROM (SELECT *, end_s - start_s AS rms, max(end_s - start_s) OVER (PARTITION BY call_id) AS peak FROM v_turns)
    WHERE peak <= 0 OR (rms > 0 AND round(20 * log10(peak) - 20 * log10(greatest(rms, 1e-300)), 9) <= 11)""", "v_turns"))
def _(spark, d):
    t = W.turns(spark, d).withColumn("rms", F.col("end_s") - F.col("start_s"))
    return FR.energy_gate(t).select("call_id", "turn_idx")


@query("embed_window", sql("""
    WITH c AS (SELECT call_id, max(end_s) - 0.1e0 AS ce FROM v_turns GROUP BY call_id)
    SELECT call_id, turn_idx, round(CASE WHEN short THEN greatest(0, start_s - 0.2e0) ELSE start_s END, 6) AS win_start_s,
           round(CASE WHEN short THEN least(ce, e + 0.2e0) ELSE e END, 6) AS win_end_s, len >= 0.3e0 AS long_enough
    FROM (SELECT *, len < 0.8e0 AS short FROM (SELECT t.*, ce, least(end_s, ce) AS e, round(least(end_s, ce) - start_s, 9) AS len FROM v_turns t JOIN c USING (call_id)))""", "v_turns"))
def _(spark, d):
    t = W.turns(spark, d)
    ends = t.groupBy("call_id").agg((F.max("end_s") - 0.1).alias("ce"))
    w = FR.embed_window(F.col("start_s"), F.col("end_s"), F.col("ce"))
    return t.join(ends, "call_id").select("call_id", "turn_idx", w.alias("w")).select(
        "call_id", "turn_idx", F.round("w.win_start_s", 6).alias("win_start_s"), F.round("w.win_end_s", 6).alias("win_end_s"), "w.long_enough")


@query("embeddable", sql("""
    WITH s AS (SELECT call_id, frame_idx AS seg_idx, frame_idx * 1e0 AS ws, frame_idx * 1e0 + 2 + (rms - floor(rms)) * 6 AS we0, n FROM v_frames
               JOIN (SELECT call_id, count(*) AS n FROM v_frames GROUP BY call_id) USING (call_id)),
    e AS (SELECT *, least(we0, CAST(n AS DOUBLE)) AS we FROM s),
    f AS (SELECT e.call_id, e.seg_idx, v.rms FROM e JOIN v_frames v ON v.call_id = e.call_id AND v.frame_idx >= ceil(round(ws, 6)) AND v.frame_idx <= floor(round(we, 6)) - 1),
    q AS (SELECT call_id, seg_idx, count(*) AS k, quantile_cont(rms, 0.5) AS m FROM f GROUP BY ALL),
    r AS (SELECT f.call_id, f.seg_idx, CASE WHEN max(k) < 4 THEN 0 ELSE avg(CAST(rms > greatest(1.5e0 * m, 0.005e0) AS INT)) END AS sr FROM f JOIN q USING (call_id, seg_idx) GROUP BY ALL)
    SELECT e.call_id, e.seg_idx, round(coalesce(sr, 0), 6) AS speech_ratio, coalesce(sr, 0) >= 0.25e0 AS eligible FROM e LEFT JOIN r USING (call_id, seg_idx)
    """, "v_frames"))
def _(spark, d):
    """One-second frames; every frame opens a segment of two to eight of them."""
    f = W.frames(spark, d)
    n = f.groupBy("call_id").agg(F.count("*").cast("double").alias("call_end_s"))
    start = F.col("frame_idx") * F.lit(1.0)
    segs = f.join(n, "call_id").select(
        "call_id", F.col("frame_idx").alias("seg_idx"), start.alias("start_s"),
        (start + 2 + (F.col("rms") - F.floor("rms")) * 6).alias("end_s"), "call_end_s")
    return FR.embeddable(segs, f, 1.0).select("call_id", "seg_idx", *R("speech_ratio"), "eligible")


_FEATURES = "SELECT event_id, value AS dur, -value AS dbfs, (value / 100e0) AS flat, value * 2 AS snr FROM events"


@query("clip_quality", f"""
    SELECT event_id, CASE WHEN dur < 1.5e0 THEN 'too short' WHEN dur > 20 THEN 'too long' WHEN dbfs < -15 THEN 'too quiet'
      WHEN flat > 0.12e0 THEN 'too noisy' WHEN snr < 10 THEN 'low SNR' ELSE '' END AS reason FROM ({_FEATURES})""")
def _(spark, d):
    v = F.col("value")
    q = FR.clip_quality(v, -v, v / 100.0, v * 2, quietest=-15.0, flattest=0.12)
    return W.table(spark, d, "events").select("event_id", q.alias("reason"))


@query("is_clean_recording", """
    SELECT event_id, value / 100e0 > 0.10e0 AND value / 1000e0 < 0.20e0 AS clean FROM events""")
def _(spark, d):
    v = F.col("value")
    return W.table(spark, d, "events").select("event_id", FR.is_clean_recording(v / 100.0, v / 1000.0).alias("clean"))


@query("enrolment_gate", sql(f"""
    WITH {_SNR},
    c AS (SELECT c.call_id, c.agent_slug, c.value_sum AS seconds, s.snr_db, CASE WHEN s.snr_db >= 20 THEN 'high' WHEN s.snr_db >= 12 THEN 'mid' ELSE 'low' END AS bucket
          FROM v_calls c JOIN snr s USING (call_id)),
    w AS (SELECT call_id, count(*) AS n FROM v_frames GROUP BY call_id),
    u AS (SELECT c.*, w.n FROM c JOIN w USING (call_id) WHERE seconds >= 3 AND n >= 3),
    a AS (SELECT agent_slug FROM u GROUP BY agent_slug HAVING sum(n) >= 30 AND sum(seconds) >= 60)
    SELECT agent_slug, bucket, CAST(sum(n) AS BIGINT) AS n_windows, count(*) AS calls, round(quantile_cont(snr_db, 0.5), 6) AS snr_median
    FROM u SEMI JOIN a USING (agent_slug) GROUP BY agent_slug, bucket HAVING sum(n) >= 20""", "v_frames", "v_calls"))
def _(spark, d):
    from ..functions.vectors import snr_bucket

    f = W.frames(spark, d)
    clips = W.calls(spark, d).join(FR.estimate_snr(f), "call_id").select(
        "agent_slug", "call_id", F.col("value_sum").alias("seconds"), "snr_db", snr_bucket(F.col("snr_db")).alias("bucket"))
    windows = f.join(W.calls(spark, d).select("call_id", "agent_slug"), "call_id")
    _, buckets = FR.enrolment_gate(windows, clips)
    return buckets.select("agent_slug", "bucket", "n_windows", "calls", *R("snr_median"))


@query("speaker_stats", sql("""
    SELECT call_id, speaker AS display_speaker, count(*) AS turns, round(sum(end_s - start_s), 6) AS seconds FROM v_turns GROUP BY ALL""", "v_turns"))
def _(spark, d):
    return roles.speaker_stats(W.turns(spark, d).withColumnRenamed("speaker", "display_speaker")).select(
        "call_id", "display_speaker", "turns", *R("seconds"))


@query("dominant_speaker", sql("""
    SELECT call_id, speaker, round(s, 6) AS seconds, round(t, 6) AS total_s FROM (
      SELECT *, sum(s) OVER (PARTITION BY call_id) AS t, row_number() OVER (PARTITION BY call_id ORDER BY round(s, 9) DESC, f) AS rn
      FROM (SELECT call_id, speaker, sum(end_s - start_s) AS s, min(turn_idx) AS f FROM v_turns GROUP BY ALL)) WHERE rn = 1""", "v_turns"))
def _(spark, d):
    return roles.dominant_speaker(W.turns(spark, d).withColumnRenamed("turn_idx", "seg_idx")).select("call_id", "speaker", *R("seconds", "total_s"))


@query("talk_ratio", sql("""
    SELECT call_id, round(sum(CASE WHEN a THEN d ELSE 0 END), 6) AS agent_s, round(sum(CASE WHEN a THEN 0 ELSE d END), 6) AS customer_s,
           CAST(sum(CAST(a AS INT)) AS BIGINT) AS agent_turns, CAST(sum(CAST(NOT a AS INT)) AS BIGINT) AS customer_turns,
           round(CASE WHEN sum(d) > 0 THEN sum(CASE WHEN a THEN d ELSE 0 END) / sum(d) ELSE 0 END, 6) AS agent_share
    FROM (SELECT call_id, identified_speaker = 'AGENT' AS a, end_s - start_s AS d FROM v_system) GROUP BY call_id""", "v_system"))
def _(spark, d):
    return roles.talk_ratio(W.system(spark, d)).select("call_id", *R("agent_s", "customer_s"), "agent_turns", "customer_turns", *R("agent_share"))
