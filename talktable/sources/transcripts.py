"""Transcript formats: ASR responses, RTTM, labelled lines, speaker blocks, JSON and text output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.times import clock_millis, clock_minutes, clock_short, to_seconds

ASR = (
    "utterances array<struct<transcript:string,text:string,start:double,end:double,speaker:string,confidence:double>>, "
    "words array<struct<word:string,punctuated_word:string,start:double,end:double,speaker:string>>, "
    "segments array<struct<text:string,start:double,end:double,avg_logprob:double>>, "
    "transcript string, confidence double, duration double"
)


def _speaker(index: Column) -> Column:
    """``SPEAKER_nn`` for numbers, ``SPEAKER_X`` for letters."""
    raw = F.coalesce(index, F.lit("0"))
    number = F.when(F.length(raw) < 2, F.lpad(raw, 2, "0")).otherwise(raw)
    return F.concat(F.lit("SPEAKER_"), F.when(raw.rlike(r"^\d+$"), number).otherwise(raw))


def asr_to_segments(responses: DataFrame, column: str = "json", time_scale: float = 1.0) -> DataFrame:
    """Segments of ASR responses (``call_id`` and a flat JSON document).

    Utterances are preferred, then words grouped by speaker, then the whole transcript; blank
    text is dropped. ``time_scale`` is 1000 for services that answer in milliseconds.
    """
    r = responses.select("call_id", F.from_json(column, ASR).alias("r"))
    has_utterances = F.coalesce(F.size("r.utterances") > 0, F.lit(False))
    has_words = F.coalesce(F.size("r.words") > 0, F.lit(False))
    seconds = lambda c: F.round(F.coalesce(c, F.lit(0.0)) / time_scale, 2)

    spoken = r.where(has_utterances).select("call_id", F.posexplode("r.utterances").alias("seg_idx", "u")).select(
        "call_id", F.col("seg_idx").cast("bigint"), seconds(F.col("u.start")).alias("start_s"),
        seconds(F.col("u.end")).alias("end_s"), F.trim(F.coalesce("u.transcript", "u.text", F.lit(""))).alias("text"),
        _speaker(F.col("u.speaker")).alias("speaker"),
        F.round(F.coalesce("u.confidence", F.lit(0.0)), 3).alias("confidence"),
    )
    # the words of a response are one row's array, so they are grouped inside the row
    speaker_of = lambda w: F.coalesce(w["speaker"], F.lit("0"))
    boundary = lambda ws: F.filter(
        F.sequence(F.lit(0), F.size(ws) - 1),
        lambda i: (i == 0) | (speaker_of(F.get(ws, i)) != speaker_of(F.get(ws, i - 1))),
    )
    cut = r.where(~has_utterances & has_words).select(
        "call_id", F.col("r.words").alias("ws"), let(F.col("r.words"), boundary).alias("starts")
    )
    runs = F.transform(
        "starts",
        lambda a, j: F.slice("ws", a + 1, F.coalesce(F.get("starts", j + 1), F.size("ws")) - a),
    )
    first, last = F.get("g", F.lit(0)), F.element_at("g", -1)
    spoken_words = F.transform("g", lambda w: F.coalesce(w["punctuated_word"], w["word"], F.lit("")))
    grouped = cut.select("call_id", F.posexplode(runs).alias("seg_idx", "g")).select(
        "call_id", F.col("seg_idx").cast("bigint"), seconds(first["start"]).alias("start_s"),
        seconds(last["end"]).alias("end_s"), F.trim(F.array_join(spoken_words, " ")).alias("text"),
        _speaker(speaker_of(first)).alias("speaker"), F.lit(0.0).alias("confidence"),
    )
    whole = r.where(~has_utterances & ~has_words).select(
        "call_id", F.lit(0).cast("bigint").alias("seg_idx"), F.lit(0.0).alias("start_s"),
        F.round(F.coalesce("r.duration", F.lit(0.0)), 2).alias("end_s"),
        F.trim(F.coalesce("r.transcript", F.lit(""))).alias("text"), F.lit("SPEAKER_00").alias("speaker"),
        F.round(F.coalesce("r.confidence", F.lit(0.0)), 3).alias("confidence"),
    )
    out = spoken.unionByName(grouped).unionByName(whole).where(F.col("text") != "")
    return out.withColumn("identified_speaker", F.col("speaker"))


def chunked_asr_to_segments(responses: DataFrame, column: str = "json") -> DataFrame:
    """Segments of chunk responses (``call_id, chunk_idx, offset_s``), shifted to call time.

    A chunk without usable segments gives its whole transcript.
    """
    r = responses.select("call_id", "chunk_idx", "offset_s", F.from_json(column, ASR).alias("r"))
    usable = F.filter("r.segments", lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != "")
    has = F.coalesce(F.size(usable) > 0, F.lit(False))
    at = lambda c: F.round(F.coalesce(c, F.lit(0.0)) + F.col("offset_s"), 2)
    parts = r.where(has).select("call_id", "chunk_idx", "offset_s", F.posexplode(usable).alias("i", "s")).select(
        "call_id", "chunk_idx", F.col("i").cast("bigint").alias("seg_idx"), at(F.col("s.start")).alias("start_s"),
        at(F.col("s.end")).alias("end_s"), F.trim("s.text").alias("text"),
        F.round(F.coalesce("s.avg_logprob", F.lit(0.0)), 3).alias("confidence"),
    )
    whole = r.where(~has).select(
        "call_id", "chunk_idx", F.lit(0).cast("bigint").alias("seg_idx"), F.round("offset_s", 2).alias("start_s"),
        at(F.col("r.duration")).alias("end_s"), F.trim(F.coalesce("r.transcript", F.lit(""))).alias("text"),
        F.lit(0.0).alias("confidence"),
    ).where(F.col("text") != "")
    return parts.unionByName(whole).withColumn("speaker", F.lit("SPEAKER_00"))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    return parse_rttm(spark.read.text(path))


def parse_rttm(lines: DataFrame) -> DataFrame:
    """Turns of RTTM lines (``value``), sorted by call and start."""
    p = F.split(F.trim("value"), r"\s+")
    start, length = F.get(p, F.lit(3)).try_cast("double"), F.get(p, F.lit(4)).try_cast("double")
    return (
        lines.where((F.get(p, F.lit(0)) == "SPEAKER") & (F.size(p) >= 8))
        .select(F.get(p, F.lit(1)).alias("call_id"), start.alias("start_s"), (start + length).alias("end_s"),
                F.get(p, F.lit(7)).alias("speaker"))
        .orderBy("call_id", "start_s")
    )


def parse_labelled_lines(texts: DataFrame, column: str = "text", keep: list[str] = ["call_id"]) -> DataFrame:
    """Lines ``[SPEAKER_X] [m:s - m:s] text``; other lines are kept whole with zero times."""
    pattern = r"^\[?(SPEAKER[_\s]*\d+|[A-Z]+)\]?\s*\[?(\d+:?\d*\.?\d*)\s*[-–]\s*(\d+:?\d*\.?\d*)\]?\s*(.*)$"
    lines = texts.select(*keep, F.posexplode(F.split(column, "\n")).alias("line_idx", "raw")).select(
        *keep, "line_idx", F.trim("raw").alias("line")
    ).where(F.col("line") != "")
    part = lambda i: F.regexp_extract("line", pattern, i)
    ok = F.col("line").rlike(pattern)
    clock = lambda c: F.round(to_seconds(c), 2)
    return lines.select(
        *keep, "line_idx",
        F.when(ok, clock(part(2))).otherwise(0.0).alias("start_s"),
        F.when(ok, clock(part(3))).otherwise(0.0).alias("end_s"),
        F.when(ok, F.replace(part(1), F.lit(" "), F.lit("_"))).otherwise("SPEAKER_00").alias("speaker"),
        F.when(ok, F.trim(part(4))).otherwise(F.col("line")).alias("text"),
    )


def parse_speaker_blocks(texts: DataFrame, column: str = "text", keep: list[str] = ["call_id"]) -> DataFrame:
    """Turns of texts made of ``Speaker A`` / ``Speaker B`` blocks separated by blank lines."""
    blocks = texts.select(
        *keep, F.posexplode(F.split(F.trim(column), r"\n\s*\n")).alias("turn_idx", "block")
    )
    lines = F.split(F.trim("block"), "\n", 2)
    head = F.trim(F.get(lines, F.lit(0)))
    return blocks.where((F.size(lines) >= 2) & head.isin("Speaker A", "Speaker B")).select(
        *keep, "turn_idx", F.replace(head, F.lit("Speaker "), F.lit("")).alias("speaker"),
        F.trim(F.get(lines, F.lit(1))).alias("phrase"),
    )


def transcript_json(segments: DataFrame) -> DataFrame:
    """Rows of the transcript document, with display names filled in."""
    role = F.coalesce("identified_speaker", "speaker", F.lit("UNKNOWN"))
    call_agent = F.col("call_agent") if "call_agent" in segments.columns else F.lit("Unknown Agent")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    display = F.coalesce(
        filled("display_speaker"),
        F.when(role == "AGENT", F.coalesce(filled("agent_name"), call_agent)).when(role == "CUSTOMER", "Customer").otherwise(role),
    )
    score = F.nullif(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0))
    return segments.select(
        "call_id", "seg_idx", clock_millis(F.col("start_s")).alias("start"), clock_millis(F.col("end_s")).alias("end"),
        F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker"), F.trim(F.coalesce("text", F.lit(""))).alias("phrase"),
        F.round(score, 3).alias("avg_score"), role.alias("identified_speaker"),
        display.alias("display_speaker"), "agent_name",
    )


def transcript_lines(segments: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """Printable conversation: one numbered line per segment, ``header`` lines (from talk ratios) first."""
    who = F.coalesce(F.col("display_speaker"), F.col("speaker"), F.lit("UNKNOWN"))
    lines = segments.select(
        "call_id", (F.col("seg_idx") + 1).cast("bigint").alias("line_no"),
        F.concat(F.lit("["), clock_minutes(F.col("start_s")), F.lit(" - "), clock_minutes(F.col("end_s")), F.lit("] "),
                 who, F.lit(": "), F.trim("text")).alias("line"),
    )
    if header is None:
        return lines
    percent = F.round(100 * F.col("agent_share"), 0).cast("int").cast("string")
    top = header.select(
        "call_id", F.lit(0).cast("bigint").alias("line_no"),
        F.concat(F.lit("agent "), clock_short(F.col("agent_s")), F.lit(" ("), percent, F.lit("%), customer "),
                 clock_short(F.col("customer_s")), F.lit(", turns "), F.col("agent_turns").cast("string"), F.lit("/"),
                 F.col("customer_turns").cast("string")).alias("line"),
    )
    return lines.unionByName(top)


def split_view(segments: DataFrame) -> DataFrame:
    """The two sides of a call apart: (call_id, side, speaker, confidence, n_lines, text), one row for each side of every call.

    The agent's side are segments whose role is an agent's (``AGENT``, ``Agent`` or a slug ``agent_…``), all others are the
    customer's. Lines are ``[mm:ss-mm:ss] text`` by start, segments without text are left out. The agent's side names the
    speaker of its first line and the mean confidence; a side without lines says so.
    """
    role = F.coalesce("identified_speaker", "speaker", F.lit("Unknown"))
    agent = role.isin("AGENT", "Agent") | role.startswith("agent_")
    said = F.trim(F.coalesce("text", F.lit("")))
    line = F.concat(F.lit("["), clock_minutes(F.col("start_s")), F.lit("-"), clock_minutes(F.col("end_s")), F.lit("] "), said)
    name = F.coalesce(F.nullif(F.col("display_speaker"), F.lit("")), F.nullif(F.col("agent_name"), F.lit("")), role)
    rows = segments.select(
        "call_id", F.when(agent, "agent").otherwise("customer").alias("side"), F.col("start_s"), F.col("seg_idx"), line.alias("line"),
        name.alias("name"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), said.alias("said"),
    )
    order = F.struct("start_s", "seg_idx")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_s", "seg_idx", "line"))), lambda x: x["line"]), "\n")
    held = rows.where("said <> ''").groupBy("call_id", "side").agg(
        F.min_by("name", order).alias("speaker"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_lines"), text.alias("text")
    )
    sides = rows.select("call_id").distinct().select("call_id", F.explode(F.array(F.lit("agent"), F.lit("customer"))).alias("side"))
    named = lambda c: F.when(F.col("side") == "agent", F.col(c)).alias(c)
    return sides.join(held, ["call_id", "side"], "left").select(
        "call_id", "side", named("speaker"), named("confidence"), F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce("text", F.concat(F.lit("(no "), F.col("side"), F.lit(" segments detected)"))).alias("text"),
    )


def word_scores(segments: DataFrame, words: DataFrame) -> DataFrame:
    """``segments`` with ``avg_score``: mean ``score`` of their words to three digits, null where no word has one.

    ``words`` has ``call_id, seg_idx, score``.
    """
    means = words.groupBy("call_id", "seg_idx").agg(F.round(F.avg("score"), 3).alias("avg_score"))
    return segments.drop("avg_score").join(means, ["call_id", "seg_idx"], "left")


def write_transcript_text(lines: DataFrame, path: str) -> None:
    """One folder per call with its lines in order."""
    lines.repartition("call_id").sortWithinPartitions("call_id", "line_no").select("call_id", "line").write.mode(
        "overwrite"
    ).partitionBy("call_id").text(path)


def result_documents(segments: DataFrame, runs: DataFrame) -> DataFrame:
    """One nested result per call and model: the run's fields and its segments in order.

    A document holds all segments of its call; that is the format's own limit.
    """
    rest = [c for c in segments.columns if c not in ("call_id", "model")]
    nested = segments.groupBy("call_id", "model").agg(
        F.sort_array(F.collect_list(F.struct("seg_idx", *[c for c in rest if c != "seg_idx"]))).alias("segments")
    )
    return runs.join(nested, ["call_id", "model"], "left").withColumn(
        "run_id", F.concat_ws("__", F.col("call_id").cast("string"), "model")
    )


def write_results(documents: DataFrame, path: str) -> None:
    """JSON documents in one folder per model."""
    documents.write.mode("overwrite").partitionBy("model").json(path)
