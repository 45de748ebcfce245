"""Call indexes, phrases, manifests and run catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import is_agent_label, slug, to_seconds

PHRASES = "array<struct<start:string,end:string,speaker:string,phrase:string>>"
RECORDING = "horizon_call_s3_url"
CALLS = (
    f"_id string, agent_name string, {RECORDING} string, duration double, connect_time string, "
    f"call_type string, direction string, speaker_json {PHRASES}"
)
RUN = (
    "audio_file string, model string, processed_at string, processing_time_seconds double, "
    "total_segments bigint, broken string"
)


def read_entries(spark: SparkSession, path: str, form: str, recording: str = RECORDING) -> DataFrame:
    """Entries of call index files with their text in ``broken`` where they are no JSON object.

    ``form`` is ``"lines"``, one entry a line, which Spark splits, or ``"document"``, one array or object a
    file, which is read whole by one task. It has to be given: lines read as a document end after the first.
    ``recording`` names the field of the recording's address.
    """
    if form not in ("lines", "document"):
        raise ValueError('form is "lines" or "document"')
    reader = spark.read.schema(f"{CALLS.replace(RECORDING, f'`{recording}`')}, broken string")
    entries = reader.option("multiLine", form == "document").option("columnNameOfCorruptRecord", "broken").json(path)
    return entries.withColumnRenamed(recording, RECORDING)


def read_calls(spark: SparkSession, path: str, form: str, recording: str = RECORDING) -> DataFrame:
    """Call index of JSON files; entries that are broken are left out here and counted by ``broken_entries``."""
    return index_calls(read_entries(spark, path, form, recording).where(F.col("broken").isNull()).drop("broken"))


def broken_entries(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Files with entries that are no JSON objects, and how many."""
    # the text column alone cannot be read from the files, so an entry field goes with it
    read = read_entries(spark, path, form).select(F.input_file_name().alias("file"), "_id", "broken")
    return read.groupBy("file").agg(F.count("_id").alias("ids"), F.count("broken").alias("broken")).where("broken > 0 and ids >= 0").drop("ids")


def parse_calls(raw: DataFrame, column: str = "json") -> DataFrame:
    """Call index from one JSON document per row."""
    return index_calls(raw.select(F.from_json(column, CALLS).alias("c")).select("c.*"))


def index_calls(calls: DataFrame) -> DataFrame:
    """Usable calls only: id, agent, recording and at least one agent phrase."""
    phrases = F.filter("speaker_json", lambda p: p.isNotNull())
    agent = F.size(F.filter(phrases, lambda p: is_agent_label(p["speaker"], "exact")))
    name = F.trim("agent_name")
    present = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return (
        calls.where(present("_id") & F.coalesce(name != "", F.lit(False)) & present(RECORDING))
        .where(F.size("speaker_json") > 0)
        .select(
            F.col("_id").alias("call_id"), name.alias("agent_name"), slug(name).alias("agent_slug"),
            F.col(RECORDING).alias("recording"), F.col("duration").alias("duration_s"),
            F.to_timestamp("connect_time").alias("connect_time"), "call_type", "direction",
            agent.alias("n_agent_phrases"), F.size("speaker_json").alias("n_total_phrases"),
            F.col("speaker_json").alias("phrases"),
        )
        .where(F.col("n_agent_phrases") > 0)
    )


def explode_phrases(calls: DataFrame) -> DataFrame:
    """One row per phrase with parsed times; entries that were no objects are dropped."""
    return (
        calls.select("call_id", F.posexplode("phrases").alias("phrase_idx", "p"))
        .where(F.col("p").isNotNull())
        .select(
            "call_id", "phrase_idx",
            to_seconds(F.col("p.start")).alias("start_s"), to_seconds(F.col("p.end")).alias("end_s"),
            F.trim(F.coalesce(F.col("p.speaker"), F.lit(""))).alias("speaker"),
            F.coalesce(F.col("p.phrase"), F.lit("")).alias("text"),
            is_agent_label(F.col("p.speaker")).alias("is_agent"),
        )
    )


# The names under which the fields of a phrase come.
SPELLINGS = {
    "start": ["start", "startTime", "start_time"],
    "end": ["end", "endTime", "end_time"],
    "speaker": ["speaker", "speakerName", "name"],
    "text": ["text", "content", "transcript", "phrase", "original"],
}


def normalize_phrases(raw: DataFrame, column: str = "json", keep: list[str] = ["call_id"]) -> DataFrame:
    """Phrases from JSON arrays whose fields come under several names; empty spans are dropped.

    Of several spellings the first that is present and not blank counts. Items that are no objects have no fields.
    """
    names = ", ".join(f"{n}: string" for spelled in SPELLINGS.values() for n in spelled)
    items = raw.select(
        *keep, F.posexplode(F.try_variant_get(F.try_parse_json(column), "$", "array<variant>")).alias("phrase_idx", "v")
    )
    # an item is taken apart once, then its fields are converted
    fields = items.select(*keep, "phrase_idx", F.try_variant_get("v", "$", f"struct<{names}>").alias("f"))
    first = lambda field: F.coalesce(*[F.nullif(F.col(f"f.{n}"), F.lit("")) for n in SPELLINGS[field]])
    read = fields.select(*keep, "phrase_idx", *[first(field).alias(field) for field in SPELLINGS])
    time = lambda c: F.round(to_seconds(F.coalesce(F.col(c), F.lit("0"))), 3)
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return read.select(
        *keep, "phrase_idx", time("start").alias("start_s"), time("end").alias("end_s"),
        text("speaker").alias("speaker"), text("text").alias("text"),
    ).where(F.col("end_s") > F.col("start_s"))


def unwrap_history(raw: DataFrame, column: str = "json", keep: list[str] = ["page"]) -> DataFrame:
    """Rows of API pages, wherever the page keeps them; one variant ``row`` per row."""
    doc = F.try_parse_json(column)
    rows = lambda path: F.try_variant_get(doc, path, "array<variant>")
    filled = lambda a: F.when(F.size(a) > 0, a)
    found = F.coalesce(
        rows("$"), filled(rows("$.data.data")), filled(rows("$.data.data.data")),
        *[rows(f"$.{k}") for k in ("recordings", "calls", "data", "result", "records", "history")],
    )
    return raw.select(*keep, F.posexplode(found).alias("row_idx", "row"))


def read_manifests(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Recording manifests ``<agent>.json``, each an array of ``{s3_url}`` in file order."""
    raw = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("agent"),
        F.posexplode(F.from_json("value", "array<struct<s3_url:string>>")).alias("idx", "m"),
    )
    return manifest_rows(raw.select("agent", "idx", F.col("m.s3_url").alias("s3_url")), first)


def manifest_rows(entries: DataFrame, first: int | None = None) -> DataFrame:
    """Agent folder and file name of every entry with a URL; ``first`` limits rows per agent."""
    named = entries.where(F.coalesce(F.col("s3_url") != "", F.lit(False))).select(
        F.concat(F.lit("agent_"), F.lower(F.trim("agent"))).alias("agent_slug"), "idx", "s3_url",
        F.regexp_extract(F.try_parse_url(F.col("s3_url"), F.lit("PATH")), r"([^/]+)/*$", 1).alias("file_name"),
    )
    if first is None:
        return named
    nth = F.row_number().over(Window.partitionBy("agent_slug").orderBy("idx"))
    return named.withColumn("__nth", nth).where(F.col("__nth") <= first).drop("__nth")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue of ``<run>/result.json`` files under ``path``."""
    raw = spark.read.text(f"{path}/*/result.json", wholetext=True).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("id"), F.col("value").alias("json")
    )
    return catalogue_runs(raw)


def catalogue_runs(raw: DataFrame) -> DataFrame:
    """One row per run (``id, json``), newest id first; unreadable documents stay as unknown."""
    r = F.from_json("json", RUN, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    ok = F.col("r.broken").isNull()
    value = lambda c, default: F.coalesce(F.when(ok, F.col(f"r.{c}")), F.lit(default))
    audio = value("audio_file", "")
    return (
        raw.select("id", r.alias("r"))
        .select(
            "id", value("model", "unknown").alias("model"),
            value("total_segments", 0).cast("bigint").alias("segments"),
            value("processed_at", "").alias("processed_at"),
            value("processing_time_seconds", 0.0).alias("processing_time_s"),
            audio.alias("audio_file"),
            F.replace(F.replace(audio, F.lit("enhanced_"), F.lit("")), F.lit("\\"), F.lit("/")).alias("orig_file"),
        )
        .orderBy(F.desc("id"))
    )


def orphan_runs(directories: DataFrame, runs: DataFrame) -> DataFrame:
    """Run directories ``<call>__<model>`` (``id``) that have no result."""
    return directories.where(F.contains("id", F.lit("__"))).join(runs.select("id"), "id", "left_anti")


def pending_runs(requested: DataFrame, runs: DataFrame) -> DataFrame:
    """Requested (call_id, model) pairs without a run that produced segments."""
    done = runs.where(F.col("total_segments") > 0).select("call_id", "model")
    return requested.join(done, ["call_id", "model"], "left_anti")


def overlay_metrics(models: DataFrame, live: DataFrame) -> DataFrame:
    """Static model table with speed and segments taken from live runs where those are not zero."""
    fresh = live.select(
        "model", F.round("transcribe_s").alias("__speed"), F.col("segments").alias("__segments"),
        F.col("transcribe_s").alias("__raw"),
    )
    use = lambda flag, new, old: F.when(F.coalesce(F.col(flag) != 0, F.lit(False)), F.col(new)).otherwise(F.col(old))
    return models.join(fresh, "model", "left").select(
        *[c for c in models.columns if c not in ("speed_s", "segments")],
        use("__raw", "__speed", "speed_s").alias("speed_s"),
        use("__segments", "__segments", "segments").alias("segments"),
    )


def keep_long_calls(calls: DataFrame, least_s: float = 180.0, n: int | None = None) -> DataFrame:
    """Calls of at least ``least_s`` seconds, longest first."""
    longest = calls.where(F.col("duration_s") >= least_s).orderBy(F.desc("duration_s"), "call_id")
    return longest if n is None else longest.limit(n)


def min_duration(rows: DataFrame, least_s: float) -> DataFrame:
    """Rows that last at least ``least_s`` seconds."""
    return rows.where(F.col("end_s") - F.col("start_s") >= least_s)
