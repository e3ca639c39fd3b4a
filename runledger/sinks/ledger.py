"""The ledger: a keyed Parquet table that runs add to and replace in."""

from __future__ import annotations

import random
import uuid
from collections.abc import Sequence
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.operators.merge import ARRIVAL, history_key, latest_per_key

_SOURCE, _RUN, _PLACE = "_source", "_run", "_place"
_BLOOM = "parquet.bloom.filter.enabled#branch_hash"


class Ledger:
    """Plain Parquet below ``rows``, one partition for each source and run.

    A merge writes the run's own rows, last per key, into the run's partition; it never
    reads or rewrites what other runs stored, so its cost follows the run and not the
    ledger, and runs may overlap in time. Reading keeps, per key, the row of the run whose
    place is last.

    A run is known by its source and number. Its place among all runs is fixed when it is
    first claimed, by an empty file below ``runs``; so a run that is repeated, however
    late, replaces its own rows and stays where it was. Without a number a run claims one
    that no other run of its source has.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        keep_history: bool = False,
        keys: Sequence[str] | None = None,
        cluster: Sequence[str] = ("branch_hash", *K.REPORT_ORDER, "os"),
        order: Sequence[str] = (ARRIVAL,),
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        default = history_key() if keep_history else K.LEDGER_KEY
        self.keys = list(keys or default)
        self.cluster = list(cluster)
        self.order = list(order)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _create(self, name: str) -> None:
        path = self._path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True).close()

    def _take(self, source: str, number: int) -> bool:
        """Whether no other run wants this number.

        Everyone writes a file of their own, then looks; of two, the later one to write
        sees the other, so at most one keeps the number, whatever the store's renames and
        creations guarantee.
        """
        wanted = f"{quote(source, safe='')}.{number}."
        own = wanted + uuid.uuid4().hex
        self._create(f"runs/taken/{own}")
        return [n for n in self._names("runs/taken") if n.startswith(wanted)] == [own]

    def _places(self) -> dict[tuple[str, int], int]:
        """Place of every claimed run; the first place counts where a run has several."""
        out: dict[tuple[str, int], int] = {}
        for name in sorted(self._names("runs/places"), reverse=True):
            place, rest = name.split(".", 1)
            source, number = rest.rsplit(".", 1)
            out[unquote(source), int(number)] = int(place)
        return out

    def claim(self, source: str = "run", run_id: int | None = None) -> int:
        """Give a run its place after all claimed ones, unless it has one; returns its number.

        Runs that start at the same time get different numbers; one may then be left out.
        """
        places = self._places()
        if run_id is None:
            run_id = max((n for s, n in places if s == source), default=-1) + 1
            while not self._take(source, run_id):
                run_id += random.randint(1, 4)
        if (source, run_id) not in places:
            place = max(places.values(), default=-1) + 1
            self._create(f"runs/places/{place:012d}.{quote(source, safe='')}.{run_id}")
        return run_id

    def exists(self) -> bool:
        return any(name.startswith(f"{_SOURCE}=") for name in self._names("rows"))

    def runs(self) -> int:
        """Runs that have rows, or had none to write."""
        return sum(
            len([n for n in self._names(f"rows/{name}") if n.startswith(f"{_RUN}=")])
            for name in self._names("rows")
            if name.startswith(f"{_SOURCE}=")
        )

    def _clustered(self, df: DataFrame) -> DataFrame:
        """Sorted ranges, so that row groups hold few versions each; stands in for an index."""
        fixed = [c for c in (_SOURCE, _RUN) if c in df.columns]
        return df.repartitionByRange(*self.cluster).sortWithinPartitions(*fixed, *self.cluster)

    def merge(self, incoming: DataFrame, run_id: int | None = None, source: str = "run") -> int:
        """Store a run's rows in place of those it stored before; returns the run's number.

        Later places win over earlier ones, within a run the last arrival wins. A lost job
        leaves what was stored: the partition is replaced when the write commits.
        """
        run_id = self.claim(source, run_id)
        place = self._places()[source, run_id]
        rows = latest_per_key(incoming, self.keys, self.order).withColumn(_PLACE, F.lit(place))
        written = Observation(f"merge-{uuid.uuid4().hex}")
        counted = rows.observe(written, F.count(F.lit(1)).alias("rows"))
        counted = counted.withColumns({_SOURCE: F.lit(source), _RUN: F.lit(run_id)})
        self._clustered(counted).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).option(_BLOOM, "true").partitionBy(_SOURCE, _RUN).parquet(f"{self.root}/rows")
        if not written.get["rows"]:
            # No row names the partition, so it is emptied by its path.
            folder = f"{self.root}/rows/{_SOURCE}={quote(source, safe=' ')}/{_RUN}={run_id}"
            rows.limit(0).write.mode("overwrite").parquet(folder)
        return run_id

    def _rows(self) -> DataFrame:
        if not self.exists():
            raise ValueError(f"no ledger below {self.root}")
        return self.spark.read.parquet(f"{self.root}/rows")

    def _latest(self, rows: DataFrame) -> DataFrame:
        if self.runs() < 2:
            # A run stores one row per key.
            return rows.drop(_PLACE, _SOURCE, _RUN)
        # Partition values are read back with guessed types.
        named = rows.withColumn(_SOURCE, F.col(_SOURCE).cast("string"))
        return latest_per_key(named, self.keys, [_PLACE, _SOURCE, _RUN]).drop(_PLACE, _SOURCE, _RUN)

    def read(self) -> DataFrame:
        """One row per key."""
        return self._latest(self._rows())

    def _where(self, name: str, value: str) -> DataFrame:
        """Current rows with ``value`` in ``name``.

        The condition reaches the scan. Where ``name`` is no part of the key, a row may have
        been replaced by one with another value, so all rows of the keys found are ranked;
        other rows are left out before anything is shuffled while those keys are few.
        """
        rows, wanted = self._rows(), F.col(name) == value
        near = rows.where(wanted)
        if name in self.keys:
            return self._latest(near)
        same = rows.join(near.select(*self.keys).distinct(), self.keys, "left_semi")
        return self._latest(same).where(wanted)

    def by_hash(self, token: str) -> DataFrame:
        return self._where("branch_hash", token)

    def by_branch(self, branch: str) -> DataFrame:
        return self._where("branch", branch)

    def hashes_of_branch(self, branch: str) -> DataFrame:
        return self.by_branch(branch).select("branch_hash").distinct()

    def snapshot(self, target: str) -> DataFrame:
        """The table as it stands, written to ``target`` with one row per key, and read back.

        For readers that ask often: clustered by version, with Bloom filters on it. The
        ledger itself stays as it is.
        """
        self._clustered(self.read()).write.mode("overwrite").option(_BLOOM, "true").parquet(target)
        return self.spark.read.parquet(target)


def result_counts() -> dict[str, Column]:
    """Reports, those whose build passed, and those without a build log."""
    return {
        "reports": F.count("*"),
        "builds_passed": F.count_if(F.col("build_passed")),
        "without_log": F.count_if(F.col("netcdf_c") == K.UNKNOWN),
    }


def run_counts(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``result_counts`` per group."""
    return results.groupBy(*keys).agg(*[c.alias(n) for n, c in result_counts().items()])
