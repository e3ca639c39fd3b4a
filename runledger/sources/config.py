"""Machine configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG_SCHEMA = (
    "machines array<struct<machine_name: string, hostname_pattern: string, "
    "update_paths: array<string>>>"
)


def read_config(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per machine and update path, with the machine's place in its document."""
    docs = spark.read.schema(CONFIG_SCHEMA).option("multiLine", multi_line).json(path)
    return explode_config(docs)


def explode_config(docs: DataFrame) -> DataFrame:
    machines = docs.select(F.posexplode("machines").alias("machine_pos", "machine"))
    return machines.select(
        "machine_pos",
        "machine.machine_name",
        "machine.hostname_pattern",
        F.posexplode_outer("machine.update_paths").alias("path_pos", "update_path"),
    )


def machine_patterns(config: DataFrame) -> DataFrame:
    """``(machine_pos, machine_name, hostname_pattern)``, each machine once."""
    return config.select("machine_pos", "machine_name", "hostname_pattern").distinct()
