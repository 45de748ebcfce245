"""The voiceprint registry: reading, inventory, replacing entries, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize

AGENTS = (
    "map<string, struct<agent_name:string, voiceprint_path:string, "
    "voiceprints:array<struct<path:string,bucket:string,n_clips:bigint,snr_db:double>>, "
    "per_call_snr:array<struct<_id:string,snr_db:double,bucket:string,embs:bigint>>, "
    "mean_inside_sim:double, max_outside_sim:string, source:string>>"
)


def read_agents(spark: SparkSession, path: str) -> DataFrame:
    """Agents of a registry document, one row each."""
    return parse_agents(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def parse_agents(raw: DataFrame, column: str = "json") -> DataFrame:
    return raw.select(F.explode(F.from_json(column, AGENTS)).alias("agent_slug", "a")).where(
        F.col("a").isNotNull()
    ).select("agent_slug", "a.*")


def voiceprints(agents: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row per usable voiceprint: the list if there is one, else the single legacy path.

    ``vectors`` has ``path, embedding``. Vectors get unit length and only the most common
    dimension of an agent is kept (the smaller one on a tie).
    """
    legacy = F.array(F.struct(
        F.col("voiceprint_path").alias("path"), F.lit(None).cast("string").alias("bucket"),
        F.lit(None).cast("bigint").alias("n_clips"), F.lit(None).cast("double").alias("snr_db"),
    ))
    listed = F.filter("voiceprints", lambda v: F.coalesce(v["path"], F.lit("")) != "")
    has_list = F.coalesce(F.size(listed) > 0, F.lit(False))
    prints = agents.select(
        "agent_slug", F.coalesce("agent_name", "agent_slug").alias("agent_name"), "mean_inside_sim", "max_outside_sim", "source",
        F.posexplode(F.when(has_list, listed).otherwise(legacy)).alias("vp_idx", "vp"),
    ).select("*", "vp.*").drop("vp").where(F.coalesce(F.col("path"), F.lit("")) != "")
    loaded = prints.join(vectors.select("path", "embedding"), "path").withColumn("dim", F.size("embedding"))
    dims = loaded.groupBy("agent_slug", "dim").agg(F.count("*").alias("n"))
    main = dims.groupBy("agent_slug").agg(F.max_by("dim", F.struct(F.col("n"), -F.col("dim"))).alias("dim"))
    return loaded.join(main, ["agent_slug", "dim"], "left_semi").withColumn(
        "embedding", l2_normalize(F.col("embedding"))
    )


def enrolled_calls(agents: DataFrame) -> DataFrame:
    return agents.select("agent_slug", F.explode("per_call_snr").alias("c")).select(
        "agent_slug", F.col("c._id").alias("call_id"), "c.snr_db", "c.bucket", F.col("c.embs").alias("n_embs")
    ).where(F.col("call_id").isNotNull())


def inventory(agents: DataFrame, prints: DataFrame) -> DataFrame:
    """Usable agents and voiceprints per dimension, plus a row (dim null) for agents without any."""
    usable = prints.groupBy("dim").agg(
        F.count_distinct("agent_slug").alias("agents"), F.count("*").alias("voiceprints")
    )
    missing = agents.join(prints.select("agent_slug"), "agent_slug", "left_anti").agg(
        F.lit(None).cast("int").alias("dim"), F.count("*").alias("agents"), F.lit(0).cast("bigint").alias("voiceprints")
    )
    return usable.unionByName(missing)


def voiceprint_health(prints: DataFrame) -> DataFrame:
    """Voiceprints whose best outsider is as close as their own clips."""
    return prints.where(F.col("outside") >= F.col("inside"))


def upsert_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """Re-enrolled agents replace all their entries, others stay."""
    return old.join(new.select("agent_slug").distinct(), "agent_slug", "left_anti").unionByName(
        new, allowMissingColumns=True
    )


def not_enrolled(agents: DataFrame, registry: DataFrame) -> DataFrame:
    """Agents still to be enrolled when existing entries are to be kept."""
    return agents.join(registry.select("agent_slug").distinct(), "agent_slug", "left_anti")


def write_registry(registry: DataFrame, path: str) -> None:
    registry.write.mode("overwrite").parquet(path)


def export_registry(agents: DataFrame, prints: DataFrame, path: str) -> DataFrame:
    """Portable copy: every voiceprint with its vector, and a one-row manifest, which is returned."""
    prints.write.mode("overwrite").parquet(f"{path}/voiceprints")
    missing = agents.join(prints.select("agent_slug"), "agent_slug", "left_anti").agg(F.count("*").alias("missing_agents"))
    manifest = prints.agg(
        F.count_distinct("agent_slug").alias("agents"), F.count("*").alias("voiceprints"),
        F.sort_array(F.collect_set("dim")).alias("dims"),
    ).join(missing, how="cross")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def import_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/voiceprints")
