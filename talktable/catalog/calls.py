"""Queries on call indexes, runs, registries and formats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evaluate, roles
from ..operators.matching import best_match
from ..sources import calls as S
from ..sources import registry as G
from ..sources import transcripts as X
from ..storage import checkpoint_root
from ..streaming.talk import stream_identify, stream_talk_time
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


R = lambda *names: [F.round(n, 6).alias(n) for n in names]

# every document is a call and every line of it a phrase; long lines are the customer's
_PHRASES = """(SELECT doc_id, lang, source, i - 1 AS idx, l[i] AS line, CASE WHEN length(l[i]) >= 60 THEN 'Customer' ELSE source END AS speaker
   FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)))"""


def _call_json(spark, d):
    lines = F.split("text", "\n")
    phrases = F.transform(
        lines, lambda line, i: F.struct(
            F.concat(F.lit("0:00:"), i.cast("string")).alias("start"), (i + F.length(line) / 15.0).cast("string").alias("end"),
            F.when(F.length(line) >= 60, "Customer").otherwise(F.col("source")).alias("speaker"), line.alias("phrase")))
    doc = F.struct(
        F.col("doc_id").cast("string").alias("_id"), F.concat(F.lit("Agent "), F.col("source")).alias("agent_name"),
        F.when(F.col("lang") != "de", F.concat(F.lit("s3://calls/"), F.col("doc_id").cast("string"))).alias("horizon_call_s3_url"),
        (F.length("text") / 15.0).alias("duration"), F.lit("2024-01-02 03:04:05").alias("connect_time"),
        F.lit("sales").alias("call_type"), F.lit("in").alias("direction"), phrases.alias("speaker_json"))
    return W.table(spark, d, "documents").select(F.to_json(doc).alias("json"))


@query("read_calls", f"""
    SELECT CAST(doc_id AS VARCHAR) AS call_id, 'agent_' || min(source) AS agent_slug, CAST(sum(CAST(speaker <> 'Customer' AS INT)) AS BIGINT) AS n_agent_phrases, count(*) AS n_total_phrases
    FROM {_PHRASES} WHERE lang <> 'de' GROUP BY doc_id HAVING sum(CAST(speaker <> 'Customer' AS INT)) > 0""")
def _(spark, d):
    return S.parse_calls(_call_json(spark, d)).select(
        "call_id", "agent_slug", F.col("n_agent_phrases").cast("bigint").alias("n_agent_phrases"),
        F.col("n_total_phrases").cast("bigint").alias("n_total_phrases"))


@query("explode_phrases", f"""
    WITH p AS {_PHRASES}, k AS (SELECT doc_id FROM p WHERE lang <> 'de' GROUP BY doc_id HAVING sum(CAST(speaker <> 'Customer' AS INT)) > 0)
    SELECT CAST(doc_id AS VARCHAR) AS call_id, idx AS phrase_idx, CAST(idx AS DOUBLE) AS start_s, round(idx + length(line) / 15e0, 6) AS end_s,
           speaker, line AS text, speaker <> 'Customer' AS is_agent FROM p SEMI JOIN k USING (doc_id)""")
def _(spark, d):
    out = S.explode_phrases(S.parse_calls(_call_json(spark, d)))
    return out.select("call_id", F.col("phrase_idx").cast("bigint").alias("phrase_idx"), "start_s", *R("end_s"), "speaker", "text", "is_agent")


@query("normalize_phrases", """
    SELECT event_id, round(value, 3) AS start_s, round(value + CASE WHEN event_type = 'error' THEN 0 ELSE 3 END, 3) AS end_s,
           CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS speaker, props AS text
    FROM events WHERE event_type <> 'error'""")
def _(spark, d):
    """Field names vary with the event type; errors have no length."""
    kind, v = F.col("event_type"), F.col("value")
    item = lambda start, end, who, text, length=3: F.struct(
        v.alias(start), (v + length).cast("string").alias(end), kind.alias(who), F.col("props").alias(text))
    js = (
        F.when(kind == "click", F.to_json(item("start", "end", "speaker", "text")))
        .when(kind == "purchase", F.to_json(item("startTime", "endTime", "speakerName", "content")))
        .when(kind == "view", F.to_json(item("start_time", "end_time", "nobody", "transcript")))
        .when(kind == "signup", F.to_json(item("start", "endTime", "name", "original")))
        .otherwise(F.to_json(item("start", "end", "speaker", "phrase", 0)))
    )
    raw = W.table(spark, d, "events").select("event_id", F.concat(F.lit("["), js, F.lit(", 7]")).alias("json"))
    out = S.normalize_phrases(raw, keep=["event_id"])
    return out.select("event_id", *[F.round(c, 3).alias(c) for c in ("start_s", "end_s")], "speaker", "text")


@query("unwrap_history", """
    SELECT event_id AS page, CAST(i AS BIGINT) AS row_idx, user_id + i AS id FROM events, (SELECT unnest([0, 1]) AS i) WHERE event_type <> 'error'""")
def _(spark, d):
    rows = F.to_json(F.array(F.struct(F.col("user_id").alias("id")), F.struct((F.col("user_id") + 1).alias("id"))))
    wrap = lambda head, tail: F.concat(F.lit(head), rows, F.lit(tail))
    kind = F.col("event_type")
    js = (
        F.when(kind == "click", rows).when(kind == "purchase", wrap('{"data":{"data":', "}}"))
        .when(kind == "view", wrap('{"data":{"data":{"data":', "}}}"))
        .when(kind == "signup", wrap('{"total":1,"recordings":', "}")).otherwise(F.lit('{"message":"none"}'))
    )
    out = S.unwrap_history(W.table(spark, d, "events").select(F.col("event_id").alias("page"), js.alias("json")))
    return out.select("page", F.col("row_idx").cast("bigint").alias("row_idx"), F.try_variant_get("row", "$.id", "bigint").alias("id"))


@query("read_manifests", r"""
    SELECT 'agent_' || regexp_extract(url, '/(en|fr|de|es|[a-z]{2})/', 1) AS agent_slug, page_id AS idx,
           regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1) AS file_name FROM pages""")
def _(spark, d):
    entries = W.table(spark, d, "pages").select(
        F.regexp_extract("url", "/([a-z]{2})/", 1).alias("agent"), F.col("page_id").alias("idx"), F.col("url").alias("s3_url"))
    return S.manifest_rows(entries).select("agent_slug", "idx", "file_name")


@query("read_runs", """
    SELECT 'run_' || event_id AS id, CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS model, CASE WHEN event_type = 'error' THEN 0 ELSE user_id END AS segments,
           CASE WHEN event_type = 'error' THEN 0 ELSE value END AS processing_time_s, CASE WHEN event_type = 'error' THEN '' ELSE 'a/' || event_id || '.wav' END AS orig_file FROM events""")
def _(spark, d):
    doc = F.to_json(F.struct(
        F.concat(F.lit("a\\enhanced_"), F.col("event_id").cast("string"), F.lit(".wav")).alias("audio_file"), F.col("event_type").alias("model"),
        F.col("value").alias("processing_time_seconds"), F.col("user_id").alias("total_segments")))
    raw = W.table(spark, d, "events").select(
        F.concat(F.lit("run_"), F.col("event_id").cast("string")).alias("id"),
        F.when(F.col("event_type") == "error", F.substring(doc, 1, 20)).otherwise(doc).alias("json"))
    return S.catalogue_runs(raw).select("id", "model", "segments", "processing_time_s", "orig_file")


# English responses have utterances, French ones words, the rest only a transcript
_ASR_LINES = """(SELECT doc_id, lang, text, i - 1 AS idx, l[i] AS line FROM (SELECT *, unnest(generate_series(1, len(l))) AS i
   FROM (SELECT doc_id, lang, text, string_split(text, chr(10)) AS l FROM documents)))"""


@query("asr_json_to_segments", rf"""
    WITH u AS (SELECT doc_id AS call_id, idx AS seg_idx, CAST(idx AS DOUBLE) AS start_s, idx + 0.5e0 AS end_s, trim(line) AS text, 'SPEAKER_' || lpad(CAST(length(line) % 3 AS VARCHAR), 2, '0') AS speaker
               FROM {_ASR_LINES} WHERE lang = 'en'),
    w AS (SELECT doc_id, i - 1 AS idx, w[i] AS word, CAST(length(w[i]) > 4 AS INT) AS spk FROM (SELECT *, unnest(generate_series(1, len(w))) AS i
          FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE lang = 'fr'))),
    g AS (SELECT *, sum(CASE WHEN p = spk THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS utt FROM (SELECT *, lag(spk) OVER (PARTITION BY doc_id ORDER BY idx) AS p FROM w)),
    f AS (SELECT doc_id AS call_id, CAST(utt - 1 AS BIGINT) AS seg_idx, CAST(min(idx) AS DOUBLE) AS start_s, max(idx) + 0.9e0 AS end_s, string_agg(word, ' ' ORDER BY idx) AS text, 'SPEAKER_0' || min(spk) AS speaker FROM g GROUP BY doc_id, utt),
    t AS (SELECT doc_id AS call_id, 0 AS seg_idx, 0e0 AS start_s, 0e0 AS end_s, trim(text) AS text, 'SPEAKER_00' AS speaker FROM documents WHERE lang NOT IN ('en', 'fr'))
    SELECT call_id, seg_idx, round(start_s, 2) AS start_s, round(end_s, 2) AS end_s, text, speaker FROM (SELECT * FROM u UNION ALL SELECT * FROM f UNION ALL SELECT * FROM t) WHERE text <> ''""")
def _(spark, d):
    lines = F.split("text", "\n")
    utterances = F.transform(lines, lambda l, i: F.struct(
        l.alias("transcript"), i.cast("double").alias("start"), (i + 0.5).alias("end"), (F.length(l) % 3).alias("speaker")))
    from ..functions.text import split_words

    words = F.transform(split_words(F.col("text")), lambda w, i: F.struct(
        w.alias("word"), i.cast("double").alias("start"), (i + 0.9).alias("end"), (F.length(w) > 4).cast("int").alias("speaker")))
    lang = F.col("lang")
    js = (
        F.when(lang == "en", F.to_json(F.struct(utterances.alias("utterances"), F.lit("x").alias("transcript"))))
        .when(lang == "fr", F.to_json(F.struct(words.alias("words"), F.lit("x").alias("transcript"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("transcript"))))
    )
    out = X.asr_to_segments(W.table(spark, d, "documents").select(F.col("doc_id").alias("call_id"), js.alias("json")))
    return out.select("call_id", "seg_idx", "start_s", "end_s", "text", "speaker")


@query("chunked_asr_to_segments", """
    SELECT user_id AS call_id, event_id AS chunk_idx, 0 AS seg_idx, round(30 * value, 2) AS start_s,
           round(30 * value + CASE WHEN event_type = 'click' THEN 1.5e0 ELSE 30 END, 2) AS end_s, props AS text
    FROM events WHERE event_type <> 'error'""")
def _(spark, d):
    js = F.when(
        F.col("event_type") == "click",
        F.to_json(F.struct(F.array(F.struct(F.col("props").alias("text"), F.lit(0.0).alias("start"), F.lit(1.5).alias("end"))).alias("segments"))),
    ).when(F.col("event_type") == "error", F.lit('{"segments":[{"text":"  "}]}')).otherwise(
        F.to_json(F.struct(F.col("props").alias("transcript"), F.lit(30.0).alias("duration"))))
    raw = W.table(spark, d, "events").select(
        F.col("user_id").alias("call_id"), F.col("event_id").alias("chunk_idx"), (F.col("value") * 30).alias("offset_s"), js.alias("json"))
    return X.chunked_asr_to_segments(raw).select("call_id", "chunk_idx", "seg_idx", "start_s", "end_s", "text")


@query("read_rttm", sql("""
    SELECT CAST(call_id AS VARCHAR) AS call_id, round(start_s, 3) AS start_s, round(round(start_s, 3) + round(end_s - start_s, 3), 6) AS end_s, speaker
    FROM v_turns WHERE is_agent""", "v_turns"))
def _(spark, d):
    """Agent turns are SPEAKER lines, the others another record type."""
    line = F.concat_ws(
        " ", F.when(F.col("is_agent"), "SPEAKER").otherwise("SPKR-INFO"), F.col("call_id").cast("string"), F.lit("1"),
        F.round("start_s", 3).cast("decimal(20,3)").cast("string"), F.round(F.col("end_s") - F.col("start_s"), 3).cast("decimal(20,3)").cast("string"),
        F.lit("<NA> <NA>"), F.col("speaker"), F.lit("<NA> <NA>"))
    return X.parse_rttm(W.turns(spark, d).select(line.alias("value"))).select("call_id", *R("start_s", "end_s"), "speaker")


@query("parse_labelled_lines", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE value END AS start_s, CASE WHEN event_type = 'error' THEN 0 ELSE round(value + 60, 2) END AS end_s,
           CASE WHEN event_type = 'error' THEN 'SPEAKER_00' ELSE 'SPEAKER_' || user_id END AS speaker,
           CASE WHEN event_type = 'error' THEN '<' || props || '>' ELSE props END AS text FROM events""")
def _(spark, d):
    v = F.col("value")
    minutes = F.floor((v + 60) / 60)
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("  <"), F.col("props"), F.lit(">\n  "))).otherwise(
        F.concat(F.lit("[SPEAKER_"), F.col("user_id").cast("string"), F.lit("] ["), v.cast("string"), F.lit(" - "),
                 minutes.cast("string"), F.lit(":"), F.round(v + 60 - 60 * minutes, 2).cast("string"), F.lit("] "), F.col("props")))
    return X.parse_labelled_lines(W.table(spark, d, "events").select("event_id", line.alias("text")), keep=["event_id"]).select(
        "event_id", "start_s", "end_s", "speaker", "text")


@query("parse_speaker_blocks", """
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'A' ELSE 'B' END AS speaker, trim(text, chr(10) || chr(32) || chr(9)) AS phrase
    FROM conversations WHERE role IN ('user', 'assistant')""")
def _(spark, d):
    head = F.when(F.col("role") == "user", "Speaker A").when(F.col("role") == "assistant", "Speaker B").otherwise("Narrator")
    text = F.concat(head, F.lit("\n"), F.regexp_replace("text", r"\n\s*\n", "\n"))
    out = X.parse_speaker_blocks(
        W.table(spark, d, "conversations").select("conv_id", "turn", text.alias("text")), keep=["conv_id", "turn"])
    return out.select("conv_id", "turn", "speaker", "phrase")


# hours, minutes and seconds of a time in milliseconds
_MILLIS = (
    "lpad(CAST(CAST(round({s} * 1000) AS BIGINT) // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(round({s} * 1000) AS BIGINT) // 60000 % 60 AS VARCHAR), 2, '0')"
    " || ':' || lpad(CAST(CAST(round({s} * 1000) AS BIGINT) // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(CAST(round({s} * 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0')"
)


@query("transcript_json", sql(f"""
    SELECT call_id, seg_idx, {_MILLIS.format(s="start_s")} AS start, {_MILLIS.format(s="end_s")} AS "end", speaker, trim(text) AS phrase, nullif(round(CASE WHEN seg_idx = 0 THEN 0 ELSE length(text) / 1000e0 END, 3), 0) AS avg_score,
           CASE identified_speaker WHEN 'AGENT' THEN 'Unknown Agent' WHEN 'CUSTOMER' THEN 'Customer' ELSE identified_speaker END AS display_speaker
    FROM (SELECT * REPLACE (round(start_s, 6) AS start_s, round(end_s, 6) AS end_s) FROM v_segments)""", "v_segments"))
def _(spark, d):
    s = W.segments(spark, d).withColumn("display_speaker", F.lit(None).cast("string")).withColumn("agent_name", F.lit(None).cast("string"))
    s = s.withColumn("start_s", F.round("start_s", 6)).withColumn("end_s", F.round("end_s", 6))
    s = s.withColumn("confidence", F.when(F.col("seg_idx") == 0, 0.0).otherwise(F.length("text") / 1000.0))
    return X.transcript_json(s).select("call_id", "seg_idx", "start", "end", "speaker", "phrase", "avg_score", "display_speaker")


@query("transcript_lines", sql("""
    SELECT call_id, seg_idx + 1 AS line_no, '[' || lpad(CAST(CAST(floor(start_s) AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(start_s) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ' - '
      || lpad(CAST(CAST(floor(end_s) AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(end_s) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '] ' || speaker || ': ' || trim(text) AS line
    FROM (SELECT call_id, seg_idx, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, speaker, text FROM v_segments)""", "v_segments"))
def _(spark, d):
    s = W.segments(spark, d).withColumn("display_speaker", F.lit(None).cast("string"))
    s = s.withColumn("start_s", F.round("start_s", 6)).withColumn("end_s", F.round("end_s", 6))
    return X.transcript_lines(s)


_CLOCK = "lpad(CAST(CAST(floor({0}) AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor({0}) AS BIGINT) % 60 AS VARCHAR), 2, '0')"


@query("split_view", sql(f"""
    WITH s AS (SELECT call_id, seg_idx, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, identified_speaker AS role, trim(text) AS text, length(text) / 1000e0 AS c FROM v_segments WHERE trim(text) <> ''),
    x AS (SELECT *, CASE WHEN role = 'AGENT' THEN 'agent' ELSE 'customer' END AS side, '[' || {_CLOCK.format('start_s')} || '-' || {_CLOCK.format('end_s')} || '] ' || text AS line FROM s),
    h AS (SELECT call_id, side, avg(c) AS c, count(*) AS n, string_agg(line, chr(10) ORDER BY start_s, seg_idx) AS text FROM x GROUP BY ALL),
    k AS (SELECT DISTINCT call_id, unnest(['agent', 'customer']) AS side FROM v_segments)
    SELECT call_id, side, CASE WHEN side = 'agent' AND n > 0 THEN 'AGENT' END AS speaker, CASE WHEN side = 'agent' THEN round(c, 6) END AS confidence, coalesce(n, 0) AS n_lines,
           coalesce(text, '(no ' || side || ' segments detected)') AS text FROM k LEFT JOIN h USING (call_id, side)""", "v_segments"))
def _(spark, d):
    s = W.segments(spark, d).withColumns({
        "display_speaker": F.lit(None).cast("string"), "agent_name": F.lit(""), "confidence": F.length("text") / 1000.0,
        "start_s": F.round("start_s", 6), "end_s": F.round("end_s", 6)})
    return X.split_view(s).withColumn("confidence", F.round("confidence", 6))


@query("word_scores", sql("""
    WITH w AS (SELECT call_id, seg_idx, unnest(string_split(text, ' ')) AS word FROM v_segments)
    SELECT s.call_id, s.seg_idx, m.avg_score FROM v_segments s LEFT JOIN (
      SELECT call_id, seg_idx, round(avg(length(word) / 16e0) FILTER (length(word) > 9), 3) AS avg_score FROM w GROUP BY ALL) m USING (call_id, seg_idx)""", "v_segments"))
def _(spark, d):
    """Only words of over nine letters have a score."""
    s = W.segments(spark, d).select("call_id", "seg_idx", "text")
    words = s.select("call_id", "seg_idx", F.explode(F.split("text", " ")).alias("word"))
    scored = words.select("call_id", "seg_idx", F.when(F.length("word") > 9, F.length("word") / 16.0).alias("score"))
    return X.word_scores(s, scored).select("call_id", "seg_idx", "avg_score")


@query("result_documents", sql("""
    SELECT call_id || '__base' AS run_id, count(*) AS n_segments, round(sum(end_s - start_s), 4) AS seconds, min_by(text, seg_idx) AS first_text
    FROM v_segments GROUP BY call_id""", "v_segments"))
def _(spark, d):
    s = W.segments(spark, d).withColumn("model", F.lit("base"))
    docs = X.result_documents(s, s.select("call_id", "model").distinct())
    total = F.aggregate("segments", F.lit(0.0), lambda acc, x: acc + x["end_s"] - x["start_s"])
    return docs.select("run_id", F.size("segments").cast("bigint").alias("n_segments"), F.round(total, 4).alias("seconds"),
                       F.get("segments", F.lit(0))["text"].alias("first_text"))


def _agents(spark, d):
    """Registry documents that hold every vector of a label: lists of at most a thousand voiceprints, or for some labels legacy paths of one each."""
    listed = F.col("label") >= 3
    path = F.col("vec_id").cast("string")
    item = F.struct(path.alias("path"), F.lit("high").alias("bucket"), F.lit(1).cast("bigint").alias("n_clips"), F.lit(20.0).alias("snr_db"))
    call = F.struct(path.alias("_id"), F.lit(21.5).alias("snr_db"), F.lit("high").alias("bucket"), F.lit(1).cast("bigint").alias("embs"))
    sheet = F.when(listed, F.floor(F.col("vec_id") / 1000)).otherwise(F.col("vec_id"))
    a = W.table(spark, d, "embeddings").groupBy("label", sheet.alias("sheet")).agg(
        F.min(path).alias("first"), F.collect_list(item).alias("items"), F.collect_list(call).alias("calls"))
    entry = F.struct(
        F.concat(F.lit("Agent "), F.col("label").cast("string")).alias("agent_name"), F.col("first").alias("voiceprint_path"),
        F.when(listed, F.col("items")).alias("voiceprints"), F.col("calls").alias("per_call_snr"),
        F.lit(0.7).alias("mean_inside_sim"), F.lit("0.3").alias("max_outside_sim"), F.lit("index").alias("source"))
    js = F.to_json(F.map_from_arrays(F.array(F.concat(F.lit("agent_"), F.col("label").cast("string"))), F.array(entry)))
    return G.parse_agents(a.select(js.alias("json")))


def _prints(spark, d):
    vectors = W.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), "embedding")
    return G.voiceprints(_agents(spark, d), vectors)


_REG = "(SELECT 'agent_' || label AS agent_slug, 'Agent ' || label AS agent_name, vec_id FROM embeddings)"


@query("read_registry", f"""
    SELECT agent_slug, agent_name, CAST(vec_id AS VARCHAR) AS path, unnest(range(len(e))) AS at, round(unnest(e) / sqrt(list_dot_product(e, e)), 6) AS value
    FROM (SELECT agent_slug, agent_name, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM {_REG} JOIN embeddings USING (vec_id))""")
def _(spark, d):
    return _prints(spark, d).select("agent_slug", "agent_name", "path", F.posexplode("embedding").alias("at", "value")).select(
        "agent_slug", "agent_name", "path", F.col("at").cast("bigint").alias("at"), F.round("value", 6).alias("value"))


@query("registry_inventory", f"""
    SELECT len(embedding) AS dim, count(DISTINCT agent_slug) AS agents, count(*) AS voiceprints FROM {_REG} JOIN embeddings USING (vec_id) GROUP BY 1
    UNION ALL SELECT NULL, 0, 0""")
def _(spark, d):
    return G.inventory(_agents(spark, d), _prints(spark, d)).select(F.col("dim").cast("bigint").alias("dim"), "agents", "voiceprints")


@query("upsert_registry", f"""
    SELECT agent_slug, source, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM (
      SELECT agent_slug, 'old' AS source, vec_id FROM {_REG} WHERE agent_slug NOT IN (SELECT 'agent_' || label FROM embeddings GROUP BY label HAVING count(*) > 50)
      UNION ALL SELECT 'agent_' || label, 'new', vec_id FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) > 50)) GROUP BY ALL""")
def _(spark, d):
    old = _prints(spark, d).select("agent_slug", F.lit("old").alias("source"), F.col("path").cast("bigint").alias("vec_id"))
    v = W.vectors(spark, d)
    large = v.groupBy("agent_slug").agg(F.count("*").alias("n")).where("n > 50").select("agent_slug")
    new = v.join(large, "agent_slug", "left_semi").select("agent_slug", F.lit("new").alias("source"), "vec_id")
    return G.upsert_registry(old, new).groupBy("agent_slug", "source").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query("export_registry", f"""
    SELECT count(DISTINCT agent_slug) AS agents, count(*) AS voiceprints, 0 AS missing_agents, (SELECT count(*) FROM {_REG}) AS read_again FROM {_REG}""")
def _(spark, d):
    """Written to the shared folder and read from there again."""
    path = f"{checkpoint_root(spark)}/talktable/{uuid.uuid4().hex}"
    manifest = G.export_registry(_agents(spark, d), _prints(spark, d), path)
    again = G.import_registry(spark, path).agg(F.count("*").alias("read_again"))
    return manifest.drop("dims").join(again, how="cross")


@query("trained_ids", "SELECT DISTINCT CAST(vec_id AS VARCHAR) AS call_id FROM embeddings")
def _(spark, d):
    reg = _agents(spark, d).withColumn("per_call_snr", F.transform("per_call_snr", lambda c: F.struct(c["_id"].alias("call_id"))))
    return evaluate.trained_ids(reg)


# calls that began before the fifth day were enrolled from
_DAY = "2024-01-01 00:20:00"


@query("held_out_calls", sql(f"""
    SELECT call_id, agent_slug, n_agent_phrases FROM v_calls c WHERE connect_time >= TIMESTAMP '{_DAY}' AND n_agent_phrases >= 3
      AND EXISTS (SELECT 1 FROM v_vectors v WHERE v.agent_slug = c.agent_slug)""", "v_calls", "v_vectors"))
def _(spark, d):
    c = W.calls(spark, d)
    used = c.where(F.col("connect_time") < F.lit(_DAY).cast("timestamp"))
    return evaluate.held_out(c, used, W.registry(spark, d), 3).select("call_id", "agent_slug", "n_agent_phrases")


@query("held_out_ids", sql(f"SELECT call_id FROM v_calls EXCEPT SELECT call_id FROM v_calls WHERE connect_time < TIMESTAMP '{_DAY}'", "v_calls"))
def _(spark, d):
    c = W.calls(spark, d)
    return c.select("call_id").join(c.where(F.col("connect_time") < F.lit(_DAY).cast("timestamp")).select("call_id"), "call_id", "left_anti")


@query("dedupe_calls", """
    SELECT user_id AS call_id, min(event_id) AS idx, min_by(event_type, event_id) AS call_type FROM events GROUP BY user_id""")
def _(spark, d):
    rows = W.table(spark, d, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("idx"), F.col("event_type").alias("call_type"))
    return evaluate.dedupe_calls(rows)


@query("sample_calls", sql("""
    SELECT call_id, agent_slug FROM v_calls ORDER BY md5(CAST(call_id AS VARCHAR)), call_id LIMIT 10""", "v_calls"))
def _(spark, d):
    return evaluate.sample_calls(W.calls(spark, d), 10).select("call_id", "agent_slug")


@query("purity_audit", sql("""
    SELECT c.agent_slug, t.call_id, CAST(sum(CAST(is_agent AS INT)) AS BIGINT) AS agent_phrases, CAST(sum(CAST(NOT is_agent AS INT)) AS BIGINT) AS customer_phrases,
           round(100.0 * avg(CAST(NOT is_agent AS INT)), 4) AS contamination_pct, round(100.0 * avg(CAST(is_agent AS INT)), 4) AS purity_pct
    FROM v_turns t JOIN v_calls c USING (call_id) GROUP BY GROUPING SETS ((c.agent_slug, t.call_id), (c.agent_slug))""", "v_turns", "v_calls"))
def _(spark, d):
    p = W.turns(spark, d).select("call_id", "is_agent").join(W.calls(spark, d).select("call_id", "agent_slug"), "call_id")
    return evaluate.purity_audit(p)


@query("calls_per_agent", sql("""
    SELECT agent_slug, call_id, nth, n_calls FROM (SELECT *, row_number() OVER (PARTITION BY agent_slug ORDER BY idx, call_id) AS nth,
           count(*) OVER (PARTITION BY agent_slug) AS n_calls FROM v_calls) WHERE nth <= 5 AND n_calls >= 10""", "v_calls"))
def _(spark, d):
    return evaluate.calls_per_agent(W.calls(spark, d), 10, 5).select(
        "agent_slug", "call_id", F.col("nth").cast("bigint").alias("nth"), "n_calls")


@query("latency_summary", """
    SELECT event_type AS model, count(*) AS runs, round(avg(value), 6) AS avg_s, round(min(value), 6) AS min_s, round(max(value), 6) AS max_s,
           round(sum(value) / sum(user_id + 1e0), 6) AS real_time_factor FROM events GROUP BY event_type""")
def _(spark, d):
    runs = W.table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("value").alias("processing_time_s"), (F.col("user_id") + 1.0).alias("duration_s"))
    return evaluate.latency_summary(runs, ["model"])


@query("model_ranking", """
    SELECT source AS model, round(avg(n_chars) / 1000, 6) AS wer, count(*) AS segments, row_number() OVER (ORDER BY round(avg(n_chars) / 1000, 6), source) AS rank FROM documents GROUP BY source""")
def _(spark, d):
    m = W.table(spark, d, "documents").groupBy(F.col("source").alias("model")).agg(
        F.round(F.avg("n_chars") / 1000, 6).alias("wer"), F.count("*").alias("segments"))
    return evaluate.model_ranking(m).withColumn("rank", F.col("rank").cast("bigint"))


@query("call_summary", sql("""
    SELECT call_id, count(DISTINCT speaker) AS speakers, round(round(max(end_s), 6), 2) AS duration_s, round(avg(length(text) / 1009e0), 4) AS avg_confidence FROM v_segments GROUP BY call_id""", "v_segments"))
def _(spark, d):
    s = W.segments(spark, d).withColumn("confidence", F.length("text") / 1009.0).withColumn("end_s", F.round("end_s", 6))
    return roles.call_summary(s)


@query("swap_roles", sql("""
    SELECT call_id, seg_idx, CASE WHEN asked AND identified_speaker = 'AGENT' THEN 'CUSTOMER' WHEN asked AND identified_speaker = 'CUSTOMER' THEN 'AGENT' ELSE identified_speaker END AS identified_speaker,
           CASE WHEN asked AND identified_speaker = 'CUSTOMER' THEN 'Ann' WHEN asked AND identified_speaker = 'AGENT' THEN NULL WHEN identified_speaker = 'AGENT' THEN 'Bob' END AS agent_name,
           CASE WHEN asked AND identified_speaker = 'CUSTOMER' THEN 'Ann' WHEN asked AND identified_speaker = 'AGENT' THEN 'Customer' ELSE speaker END AS display_speaker
    FROM (SELECT *, call_id IN (SELECT call_id FROM v_segments WHERE identified_speaker = 'OTHER') AS asked FROM v_segments)""", "v_segments"))
def _(spark, d):
    """Swapped in calls that have a third speaker."""
    s = W.segments(spark, d).withColumn("display_speaker", F.col("speaker")).withColumn(
        "agent_name", F.when(F.col("identified_speaker") == "AGENT", "Bob"))
    asked = s.where("identified_speaker = 'OTHER'").select("call_id", F.lit("Ann").alias("agent_label")).distinct()
    return roles.swap_roles(s, asked).select("call_id", "seg_idx", "identified_speaker", "agent_name", "display_speaker")


@query("swap_stats", sql("""
    SELECT call_id, CASE WHEN asked AND role = 'AGENT' THEN 'CUSTOMER' WHEN asked THEN 'AGENT' ELSE role END AS role, asked AS roles_swapped, turns FROM (
      SELECT call_id, CASE WHEN identified_speaker = 'AGENT' THEN 'AGENT' ELSE 'CUSTOMER' END AS role, count(*) AS turns,
             call_id IN (SELECT call_id FROM v_segments WHERE identified_speaker = 'OTHER') AS asked FROM v_segments GROUP BY ALL)""", "v_segments"))
def _(spark, d):
    s = W.segments(spark, d)
    asked = s.where("identified_speaker = 'OTHER'").select("call_id").distinct()
    stats = roles.role_totals(s).withColumn("roles_swapped", F.lit(False))
    return roles.swap_stats(stats, asked).select("call_id", "role", "roles_swapped", "turns")


@query("keep_long_calls", sql("SELECT call_id, duration_s FROM v_calls WHERE duration_s >= 180 ORDER BY duration_s DESC, call_id LIMIT 20", "v_calls"))
def _(spark, d):
    return S.keep_long_calls(W.calls(spark, d), 180.0, 20).select("call_id", "duration_s")


@query("newest_first", sql("SELECT call_id, agent_slug FROM v_calls ORDER BY connect_time DESC, call_id LIMIT 25", "v_calls"))
def _(spark, d):
    return W.calls(spark, d).orderBy(F.desc("connect_time"), "call_id").limit(25).select("call_id", "agent_slug")


@query("overlay_metrics", """
    SELECT source AS model, CASE WHEN coalesce(s, 0) <> 0 THEN round(s) ELSE 45 END AS speed_s, CASE WHEN coalesce(n, 0) <> 0 THEN n ELSE 60 END AS segments
    FROM (SELECT DISTINCT source FROM documents) LEFT JOIN (SELECT source, avg(n_chars) / 10 AS s, count(*) FILTER (WHERE lang = 'de') AS n FROM documents WHERE lang IN ('de', 'en') GROUP BY source) USING (source)""")
def _(spark, d):
    docs = W.table(spark, d, "documents")
    models = docs.select(F.col("source").alias("model")).distinct().select("model", F.lit(45.0).alias("speed_s"), F.lit(60).cast("bigint").alias("segments"))
    live = docs.where(F.col("lang").isin("de", "en")).groupBy(F.col("source").alias("model")).agg(
        (F.avg("n_chars") / 10).alias("transcribe_s"), F.count(F.when(F.col("lang") == "de", 1)).alias("segments"))
    return S.overlay_metrics(models, live)


@query("orphan_runs", """
    SELECT doc_id || '__' || source AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, d):
    name = F.concat_ws("__", F.col("doc_id").cast("string"), F.col("source"))
    docs = W.table(spark, d, "documents")
    done = docs.join(W.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return S.orphan_runs(docs.select(name.alias("id")), done.select(name.alias("id")))


@query("pending_runs", """
    SELECT doc_id AS call_id, source AS model FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality > 0)""")
def _(spark, d):
    docs = W.table(spark, d, "documents").select(F.col("doc_id").alias("call_id"), F.col("source").alias("model"))
    runs = docs.join(W.table(spark, d, "labels").select(F.col("doc_id").alias("call_id"), F.col("quality").alias("total_segments")), "call_id")
    return S.pending_runs(docs, runs)


@query("stream_talk_time", """
    SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, user_id AS call_id, round(sum(CASE WHEN event_type IN ('click', 'purchase') THEN value ELSE 0 END), 6) AS agent_s,
           round(sum(CASE WHEN event_type IN ('click', 'purchase') THEN 0 ELSE value END), 6) AS customer_s, count(*) AS turns FROM events GROUP BY ALL""")
def _(spark, d):
    """The streaming plan on the table at rest; the tests run it as a stream."""
    s = W.table(spark, d, "events").select(
        F.col("user_id").alias("call_id"), F.col("ts").cast("timestamp").alias("arrived_at"), F.lit(0.0).alias("start_s"),
        F.col("value").alias("end_s"), F.when(F.col("event_type").isin("click", "purchase"), "AGENT").otherwise("CUSTOMER").alias("identified_speaker"))
    return stream_talk_time(s, "6 hours").select("window_start", "call_id", *R("agent_s", "customer_s"), "turns")


@query("stream_identify", sql("""
    SELECT vec_id, CASE WHEN best_sim >= 0.15e0 THEN best_match ELSE 'Customer' END AS identity FROM v_best""", "v_best"))
def _(spark, d):
    return stream_identify(W.vectors(spark, d).select("vec_id", "embedding"), W.registry(spark, d), 0.15).select("vec_id", "identity")
