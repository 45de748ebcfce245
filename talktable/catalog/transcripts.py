"""Queries on transcript text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times as C
from ..functions.phrases import BACKCHANNEL_STARTS, QUESTION_STARTS, SHORT_REPLIES
from ..operators import roles, words
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


def _list(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_TOKENS = "regexp_extract_all(lower({t}), '[a-z0-9'']+')"


@query("slug", """
    SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM conversations""")
def _(spark, d):
    return W.table(spark, d, "conversations").select("conv_id", "turn", C.slug(F.col("text")).alias("slug"))


# the same seconds written in the ways a clock can be written, and one way it cannot
_CLOCK = """CASE event_type
    WHEN 'click' THEN CAST(CAST(floor(value / 3600) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(value / 60) AS BIGINT) AS VARCHAR) || ':' || CAST(round(value - 60 * floor(value / 60), 2) AS VARCHAR)
    WHEN 'purchase' THEN CAST(CAST(floor(value / 60) AS BIGINT) AS VARCHAR) || ':' || CAST(round(value - 60 * floor(value / 60), 2) AS VARCHAR)
    WHEN 'view' THEN CAST(value AS VARCHAR) WHEN 'signup' THEN 'at ' || CAST(value AS VARCHAR) END"""


@query("ts_to_seconds", """
    SELECT event_id, round(CASE WHEN event_type IN ('signup', 'error') THEN 0 ELSE value END, 4) AS seconds,
           round(CASE WHEN event_type IN ('signup', 'error', 'purchase') THEN 0 ELSE value END, 4) AS seconds_strict FROM events""")
def _(spark, d):
    minutes = F.floor(F.col("value") / 60)
    rest = F.round(F.col("value") - 60 * minutes, 2).cast("string")
    kind = F.col("event_type")
    clock = (
        F.when(kind == "click", F.concat_ws(":", F.floor(F.col("value") / 3600).cast("string"), minutes.cast("string"), rest))
        .when(kind == "purchase", F.concat_ws(":", minutes.cast("string"), rest))
        .when(kind == "view", F.col("value").cast("string"))
        .when(kind == "signup", F.concat(F.lit("at "), F.col("value").cast("string")))
    )
    return W.table(spark, d, "events").select("event_id", clock.alias("clock")).select(
        "event_id", F.round(C.to_seconds(F.col("clock")), 4).alias("seconds"),
        F.round(C.to_seconds(F.col("clock"), minutes=False), 4).alias("seconds_strict"))


@query("format_ts", sql("""
    SELECT call_id, turn_idx,
      lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS millis,
      CASE WHEN s >= 3600 THEN lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS short,
      lpad(CAST(s // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS minutes
    FROM (SELECT call_id, turn_idx, CAST(round(start_s * 2 * 1000) AS BIGINT) AS ms, CAST(floor(start_s * 2) AS BIGINT) AS s FROM v_turns)""", "v_turns"))
def _(spark, d):
    s = F.col("start_s") * 2
    return W.turns(spark, d).select("call_id", "turn_idx", C.clock_millis(s).alias("millis"), C.clock_short(s).alias("short"),
                                    C.clock_minutes(s).alias("minutes"))


@query("norm_text", f"SELECT doc_id, array_to_string({_TOKENS.format(t='text')}, ' ') AS norm, len({_TOKENS.format(t='text')}) AS words FROM documents")
def _(spark, d):
    return W.table(spark, d, "documents").select(
        "doc_id", T.norm_text(F.col("text")).alias("norm"), F.size(T.norm_words(F.col("text"))).cast("bigint").alias("words"))


@query("norm_punct", r"""
    SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS joined,
           trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS spaced FROM documents""")
def _(spark, d):
    t = F.col("text")
    return W.table(spark, d, "documents").select(
        "doc_id", T.norm_punct(t, False).alias("joined"), T.norm_punct(t, True).alias("spaced"))


@query("is_agent_label", """
    SELECT event_id, trim(l) <> '' AND lower(trim(l)) <> 'customer' AS trimmed, l <> '' AND l <> 'Customer' AS exact,
           NOT starts_with(lower(regexp_replace(l, '_[^_]*_?[0-9]+$', '')), 'customer') AS suffix, NOT contains(lower(l), 'customer') AS contains
    FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'Customer' WHEN 'purchase' THEN ' customer ' WHEN 'view' THEN ''
          WHEN 'signup' THEN 'Ann_' || floor(value)::BIGINT ELSE 'Customer_' || floor(value)::BIGINT END AS l FROM events)""")
def _(spark, d):
    n = F.floor("value").cast("string")
    label = (
        F.when(F.col("event_type") == "click", "Customer").when(F.col("event_type") == "purchase", " customer ")
        .when(F.col("event_type") == "view", "").when(F.col("event_type") == "signup", F.concat(F.lit("Ann_"), n))
        .otherwise(F.concat(F.lit("Customer_"), n))
    )
    return W.table(spark, d, "events").select("event_id", label.alias("l")).select(
        "event_id", *[C.is_agent_label(F.col("l"), m).alias(m) for m in ("trimmed", "exact", "suffix", "contains")])


@query("contains_agent", "SELECT doc_id, source FROM documents WHERE contains(lower(source), 'src1')")
def _(spark, d):
    return W.table(spark, d, "documents").where(C.contains_agent(F.col("source"), "SRC1")).select("doc_id", "source")


@query("names_match", """
    SELECT doc_id, replace(lower(source || ' ' || lang), ' ', '_') = replace(lower(lang), ' ', '_') OR contains(replace(lower(source || ' ' || lang), ' ', '_'), lower(lang)) AS inside,
           contains(lower(source), 'src_' || lang) OR contains('src_' || lang, lower(source)) AS other FROM documents""")
def _(spark, d):
    full = F.concat_ws(" ", F.upper("source"), F.col("lang"))
    return W.table(spark, d, "documents").select(
        "doc_id", C.names_match(full, F.col("lang")).alias("inside"),
        C.names_match(F.col("source"), F.concat(F.lit("Src "), F.col("lang"))).alias("other"))


@query("clean_agent_name", """
    SELECT doc_id, upper(lang[1]) || lang[2:] || ' ' || upper(source[1]) || source[2:] AS name FROM documents""")
def _(spark, d):
    raw = F.concat(F.lit("agent_"), F.col("lang"), F.lit("_"), F.col("source"))
    return W.table(spark, d, "documents").select("doc_id", C.clean_agent_name(raw).alias("name"))


@query("looks_like_question", sql(f"""
    SELECT call_id, line_idx, contains(line, '?') OR coalesce({_TOKENS.format(t='line')}[1], '') IN ({_list(QUESTION_STARTS)}) AS asks FROM v_lines""", "v_lines"))
def _(spark, d):
    return W.lines(spark, d).select("call_id", "line_idx", T.looks_like_question(F.col("line")).alias("asks"))


@query("short_customer_reply", sql(f"""
    SELECT call_id, line_idx, len(w) BETWEEN 1 AND 3 AND (array_to_string(w, ' ') IN ({_list(SHORT_REPLIES)}) OR (len(w) = 1 AND length(w[1]) <= 16)) AS reply
    FROM (SELECT *, {_TOKENS.format(t='line')} AS w FROM v_lines)""", "v_lines"))
def _(spark, d):
    return W.lines(spark, d).select("call_id", "line_idx", T.short_customer_reply(F.col("line")).alias("reply"))


@query("phrase_rules", sql(f"""
    SELECT call_id, line_idx, n IN ('okay okay', 'okay perfect', 'perfect', 'cheers', 'thank you', 'what are your plans') AS agent_phrase,
           replace(n, 'bye bye', 'bye-bye') IN ('bye', 'bye-bye', 'goodbye') AS farewell,
           len(w) <= 15 AND coalesce(w[1], '') IN ({_list(BACKCHANNEL_STARTS)}) AS backchannel
    FROM (SELECT *, array_to_string(w, ' ') AS n FROM (SELECT *, {_TOKENS.format(t='line')} AS w FROM (
      SELECT * REPLACE (CASE line_idx % 5 WHEN 0 THEN 'Okay, perfect!' WHEN 1 THEN 'Bye bye.' WHEN 2 THEN 'Yeah, ' || substr(line, 1, 20) ELSE line END AS line) FROM v_lines)))""", "v_lines"))
def _(spark, d):
    """Three of five lines are, or open with, a phrase of the rules."""
    at, t = F.col("line_idx") % 5, F.col("line")
    lines = W.lines(spark, d).withColumn("line", F.when(at == 0, "Okay, perfect!").when(at == 1, "Bye bye.").when(
        at == 2, F.concat(F.lit("Yeah, "), F.substring(t, 1, 20))).otherwise(t))
    return lines.select("call_id", "line_idx", T.agent_phrase(t).alias("agent_phrase"), T.farewell(t).alias("farewell"),
                                    T.backchannel_start(t).alias("backchannel"))


_WORDS = r"list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')"


@query("drop_hallucinations", rf"""
    WITH w AS (SELECT doc_id, text, {_WORDS.format(t='lower(text)')} AS w FROM documents),
    x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM w WHERE len(w) >= 6),
    top AS (SELECT doc_id, max(c) / max(n) > 0.45 AS bad FROM (SELECT doc_id, word, count(*) AS c, max(n) AS n FROM x GROUP BY ALL) GROUP BY doc_id),
    r AS (SELECT doc_id, max(CAST(word = lag1 AND word = lag2 AND word = lag3 AS INT)) = 1 AS bad FROM (
            SELECT *, lag(word, 1) OVER o AS lag1, lag(word, 2) OVER o AS lag2, lag(word, 3) OVER o AS lag3 FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id)
    SELECT doc_id FROM w LEFT JOIN top USING (doc_id) LEFT JOIN r USING (doc_id)
    WHERE regexp_replace(text, '[^\p{{L}}\p{{N}}_]', '', 'g') <> '' AND NOT coalesce(top.bad, false) AND NOT coalesce(r.bad, false)""")
def _(spark, d):
    return W.table(spark, d, "documents").where(~T.is_hallucination(F.col("text"))).select("doc_id")


@query("truncate_repetition", rf"""
    WITH w AS (SELECT doc_id, text, {_WORDS.format(t='text')} AS w FROM documents),
    g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (
            SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM w, (SELECT unnest([5, 4, 3, 2]) AS n) WHERE len(w) >= 8)),
    r AS (SELECT doc_id, n, min(i) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, n, p ORDER BY i) AS k FROM g) WHERE k = 2 GROUP BY ALL),
    c AS (SELECT doc_id, max_by(cut, n) - 1 AS cut FROM r GROUP BY doc_id)
    SELECT doc_id, CASE WHEN len(w) < 8 THEN text WHEN cut >= 4 THEN array_to_string(w[1:cut], ' ') WHEN cut IS NOT NULL THEN ''
           WHEN len(list_distinct(w)) / len(w) < 0.35 THEN '' ELSE text END AS text FROM w LEFT JOIN c USING (doc_id)""")
def _(spark, d):
    return W.table(spark, d, "documents").select("doc_id", T.truncate_repetition(F.col("text")).alias("text"))


_A, _C = ["the", "die", "la ", "tion"], ["of", "und", "que", "ment"]
_HIT = lambda ws: " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ws)


@query("keyword_role", sql(f"""
    WITH s AS (SELECT call_id, speaker, sum(2 * a - c) AS score, min(seg_idx) AS f FROM (
                 SELECT *, {_HIT(_A)} AS a, {_HIT(_C)} AS c FROM v_segments) WHERE a > 0 OR c > 0 GROUP BY call_id, speaker),
    r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY score DESC, f) AS rn FROM s),
    o AS (SELECT call_id, min_by(score, f) AS other FROM r WHERE rn > 1 GROUP BY call_id)
    SELECT call_id, speaker, CAST(score AS BIGINT) AS score, CAST(score - coalesce(other, 0) AS BIGINT) AS margin
    FROM r LEFT JOIN o USING (call_id) WHERE rn = 1 AND score >= 2 AND score - coalesce(other, 0) >= 1""", "v_segments"))
def _(spark, d):
    return roles.keyword_role(W.segments(spark, d), _A, _C)


def _two_versions(spark, d):
    """Conversation turns, and what a system without the last word of every turn made of them."""
    s = W.segments(spark, d).select("call_id", F.col("seg_idx").alias("turn_idx"), "text",
                                    F.when(F.col("speaker") == "SPEAKER_00", "A").otherwise("B").alias("speaker"))
    return s, s.withColumn("text", F.regexp_replace("text", r"\s+\S+$", "")).withColumn(
        "speaker", F.when(F.col("turn_idx") < 2, F.col("speaker")).otherwise("A"))


_VERSIONS = f"""
    r AS (SELECT call_id, seg_idx AS turn_idx, text, CASE WHEN speaker = 'SPEAKER_00' THEN 'A' ELSE 'B' END AS speaker FROM v_segments),
    h AS (SELECT call_id, turn_idx, regexp_replace(text, '\\s+\\S+$', '') AS text, CASE WHEN turn_idx < 2 THEN speaker ELSE 'A' END AS speaker FROM r),
    rw AS (SELECT DISTINCT call_id, turn_idx, unnest({_TOKENS.format(t='text')}) AS w FROM r),
    hw AS (SELECT DISTINCT call_id, turn_idx, unnest({_TOKENS.format(t='text')}) AS w FROM h),
    m AS (SELECT call_id, rw.turn_idx AS ref_idx, hw.turn_idx AS hyp_idx, count(*) AS shared FROM rw JOIN hw USING (call_id, w) GROUP BY ALL),
    b AS (SELECT r.call_id, r.turn_idx AS ref_idx, r.speaker AS ref_speaker, m.hyp_idx, h.speaker AS hyp_speaker, m.shared FROM r
          LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY call_id, ref_idx ORDER BY shared DESC, hyp_idx) AS rn FROM m) m
            ON m.call_id = r.call_id AND m.ref_idx = r.turn_idx AND rn = 1
          LEFT JOIN h ON h.call_id = m.call_id AND h.turn_idx = m.hyp_idx)"""


@query("best_content_match", sql(f"WITH {_VERSIONS} SELECT * FROM b", "v_segments"))
def _(spark, d):
    return words.best_content_match(*_two_versions(spark, d), T.norm_words(F.col("text")))


@query("speaker_agreement", sql(f"""
    WITH {_VERSIONS}
    SELECT call_id, count(*) AS turns, CAST(sum(CAST(hyp_speaker IS NOT NULL AND hyp_speaker = ref_speaker AS INT)) AS BIGINT) AS direct,
           CAST(sum(CAST(hyp_speaker IS NOT NULL AND hyp_speaker <> ref_speaker AS INT)) AS BIGINT) AS swapped,
           CAST(greatest(sum(CAST(hyp_speaker IS NOT NULL AND hyp_speaker = ref_speaker AS INT)), sum(CAST(hyp_speaker IS NOT NULL AND hyp_speaker <> ref_speaker AS INT))) AS BIGINT) AS correct
    FROM b GROUP BY call_id""", "v_segments"))
def _(spark, d):
    return words.speaker_agreement(words.best_content_match(*_two_versions(spark, d), T.norm_words(F.col("text"))))


@query("shared_words", f"""
    SELECT a.conv_id, a.turn, len(list_distinct(list_intersect({_TOKENS.format(t='a.text')}, {_TOKENS.format(t='b.text')}))) AS shared
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""")
def _(spark, d):
    c = W.table(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), T.norm_words(F.col("text")).alias("b"))
    return c.join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.size(words.shared_words(T.norm_words(F.col("text")), F.col("b"))).cast("bigint").alias("shared"))


# without some of its words a text is as many edits away as words are gone
@query("wer", r"""
    WITH t AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents)
    SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE round(CAST(len(list_filter(w, lambda x: x IN ('the', 'of', 'die', 'und', 'la', 'que'))) AS DOUBLE) / len(w), 6) END AS wer FROM t""")
def _(spark, d):
    """Whole documents against themselves without some of their most frequent words."""
    ref = T.norm_punct(F.col("text"), True)
    left = F.filter(F.split(ref, " "), lambda w: ~w.isin("the", "of", "die", "und", "la", "que"))
    docs = W.table(spark, d, "documents").select("doc_id", ref.alias("ref"), F.array_join(left, " ").alias("hyp"))
    return words.with_wer(docs, "ref", "hyp").select("doc_id", "wer")


@query("role_wer")
def _(spark, d):
    role = F.when(F.col("speaker") == "A", "AGENT").otherwise("CUSTOMER")
    ref, hyp = (v.withColumn("role", role) for v in _two_versions(spark, d))
    return words.role_wer(ref, hyp)


@query("compare_transcripts")
def _(spark, d):
    from ..plans.compare import compare_transcripts

    ref, hyp = _two_versions(spark, d)
    shouted = hyp.withColumn("text", F.upper("text"))
    systems = hyp.withColumn("system", F.lit("short")).unionByName(shouted.withColumn("system", F.lit("loud")))
    return compare_transcripts(ref, systems)


@query("role_totals", sql("""
    SELECT call_id, role, round(sum(d), 1) AS time_s, count(*) AS turns, left(coalesce(min_by(trim(text), seg_idx) FILTER (WHERE named), ''), 120) AS first_words
    FROM (SELECT call_id, seg_idx, text, end_s - start_s AS d, CASE WHEN identified_speaker = 'AGENT' THEN 'AGENT' ELSE 'CUSTOMER' END AS role,
                 identified_speaker IN ('AGENT', 'CUSTOMER') AS named FROM v_segments) GROUP BY call_id, role""", "v_segments"))
def _(spark, d):
    return roles.role_totals(W.segments(spark, d))
