"""Keyed merge with deterministic last-write-wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger import constants as K

ARRIVAL = "arrival_seq"


def arrival_seq(run_id: int, machine_pos="machine_pos", branch_pos="branch_pos"):
    """Order of arrival: run, then job by job, newest version first, then path."""
    return F.struct(
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.struct(F.col(machine_pos), F.col(branch_pos)).alias("job_pos"),
        F.col("hash_rank"),
        F.col("path"),
    )


def latest_per_key(
    df: DataFrame, keys: Sequence[str] = K.LEDGER_KEY, order: Sequence[str] = (ARRIVAL,)
) -> DataFrame:
    """The whole row that arrived last per key; ``order`` must be unique within a key.

    Ranking with a limit of one lets every map task drop all but its own last row of a key
    before the shuffle, so a key that holds a third of the rows stays cheap.
    """
    newest_first = [F.col(c).desc() for c in order]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*newest_first))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def upsert(
    stored: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str] = K.LEDGER_KEY,
    order: Sequence[str] = (ARRIVAL,),
) -> DataFrame:
    """``stored`` with incoming rows added, or put in place of the rows with their key.

    ``stored`` has one row per key. It is not shuffled when the incoming keys are few
    enough to broadcast, which Spark decides by their measured size.
    """
    replaced = incoming.select(*keys).distinct()
    kept = stored.join(replaced, list(keys), "left_anti")
    return kept.unionByName(latest_per_key(incoming, keys, order))


def history_key(keys: Sequence[str] = K.LEDGER_KEY) -> tuple[str, ...]:
    """Key under which every version keeps its own row."""
    return (*keys, "branch_hash")
