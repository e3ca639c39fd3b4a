"""Reports, build logs and commit logs rendered by Spark from the given tables.

One report per order, one build log per order that is not pending, one commit per event.
The rules are plain column expressions, repeated in SQL in ``oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.session import TASKS_MOVE_FILES, file_tasks, local_path, scratch_dir
from runledger.sources.files import write_files

HOSTS = ("cheyenne", "hera", "orion", "Gaea")
RUN_MACHINES = ("cheyenne", "gaea", "hera", "jet", "orion")
TREE_HOSTS = ("cheyenne", "hera", "orion")
TREE_VERSIONS = tuple(f"v9.{i}.0b1-2-gab{i}" for i in range(4))
BASE_URL = "https://example.org/artifacts"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(number: str, values: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), int({number} + 1))"


BRANCHES = ("develop", "feat_x", "layout_fix")
EVENT_BRANCHES = (*BRANCHES, "develop_x")
_HEADER = (
    "concat('Build for = ', compiler, '_', c_version, '_', mpi, '_', o_g, '_', {branch}, "
    f"', mpi version ', m_version, ' on ', host, ' {K.OS_MARK}: ', os)"
)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each report says, one row per order.

    Second-priority reports spell their version with other separators: a dot in a token
    stands for any sign, so untagged tokens still match and the tagged one does not. The
    rows are dealt out as the tables hold them, before any text is made of them: a table of
    one row group would otherwise be rendered and parsed by one task. How many parts that
    takes follows their size, so that no task's share grows with the table.
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    dealt = orders.join(customer, orders.o_custkey == customer.c_custkey).hint("rebalance", "o_orderkey")
    out = dealt.withColumn("k", F.expr("floor(o_orderkey / 60) % 6")).selectExpr(
        "o_orderkey AS seq",
        "o_orderstatus AS status",
        "o_orderpriority AS priority",
        "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS day",
        f"{_pick('o_custkey % 3', BRANCHES)} AS branch",
        f"{_pick('c_nationkey % 4', HOSTS)} AS host",
        f"{_pick('o_orderkey % 3', ('gfortran', 'intel', 'nag'))} AS compiler",
        "concat(8 + o_orderkey % 4, '.3.0') AS c_version",
        "CASE o_orderkey % 5 WHEN 0 THEN 'mpiuni' WHEN 1 THEN 'openmpi' ELSE 'intelmpi' END AS mpi",
        "concat('4.0.', o_orderkey % 3, '-A') AS m_version",
        "if(o_orderkey % 2 = 0, 'g', 'O') AS o_g",
        "if(o_custkey % 11 = 0, 'Darwin', 'Linux') AS os",
        "if(k = 5, 'v8.5.0', concat('v8.', k, '.0b0', k, '-5-g60a38e', k)) AS hash",
        "8000 + o_orderkey % 997 AS unit_pass",
        "o_custkey % 7 AS unit_fail",
        "if(o_orderkey % 13 <> 0, 49L, null) AS system_pass",
        "if(o_orderkey % 13 <> 0, o_custkey % 3, null) AS system_fail",
        "if(o_orderkey % 29 = 0, -1L, 80L) AS example_pass",
        "if(o_orderkey % 29 = 0, -1L, 0L) AS example_fail",
        "50L AS nuopc_pass",
        "0L AS nuopc_fail",
    )
    return out.selectExpr(
        "*",
        """translate(if(contains(hash, '-g'), concat(hash, '2'), hash), '.',
          if(priority = '2-HIGH', '_', '.')) AS version_line""",
        """concat('/r/', branch, '/', host, '/', compiler, '/', c_version, '/', o_g, '/', mpi, '/',
          m_version, '/r', lpad(string(seq), 12, '0'), '/') AS folder""",
    )


def _result_line(kind: str) -> str:
    return (
        f"if({kind}_pass IS NULL, '{kind} test results \\t{kind} tests did not complete', "
        f"concat('{kind} test results   \\tPASS ', {kind}_pass, '\\tFAIL ', {kind}_fail))"
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, priority, path, text, match_text)``; urgent orders hold an earlier, void attempt."""
    stale = _HEADER.format(branch="'stale_branch'")
    results = ", ".join(_result_line(kind) for kind in K.KINDS)
    return (
        cells(spark, sf_dir)
        .selectExpr(
            "seq",
            "priority",
            f"concat(folder, '{K.REPORT_FILE}') AS path",
            f"""concat('\\n===\\n',
              if(priority = '1-URGENT', concat({stale}, '\\nunit test results\\tPASS 1\\tFAIL 99\\n'), ''),
              concat_ws('\\n', {_HEADER.format(branch="branch")}, concat('Build time = ', day),
                concat('git hash = ', hash), '', {results}, '', 'Currently Loaded Modules:',
                '  None found.', '---', version_line, '---\\n')) AS text""",
        )
        .withColumn("match_text", F.col("text"))
    )


def damaged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reports, with one kind of damage for each order priority but the first two."""
    damage = (
        F.when(F.col("priority") == "3-MEDIUM", F.replace("text", F.lit("Build for"), F.lit("Built")))
        .when(
            F.col("priority") == "4-NOT SPECIFIED",
            F.replace("text", F.lit("nuopc test results"), F.lit("nuopc tests")),
        )
        .when(F.col("priority") == "5-LOW", F.replace("text", F.lit(" on "), F.lit("  on ")))
        .when(
            F.col("priority") == "2-HIGH",
            F.replace("text", F.lit("\tPASS 50\tFAIL 0"), F.lit("PASS 50 FAIL 0")),
        )
        .otherwise(F.col("text"))
    )
    return reports(spark, sf_dir).withColumn("text", damage)


def logs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """``(seq, path, text, match_text)`` of the build logs; pending orders have none.

    ``more`` names columns of ``cells`` to keep.
    """
    return (
        cells(spark, sf_dir)
        .where("status <> 'P'")
        .selectExpr(
            "seq",
            *more,
            f"concat(folder, '{K.LOG_FILE}') AS path",
            f"""concat_ws('\\n', version_line,
              concat('netcdf LIBRARY version: netCDF 4.', seq % 9, '.2 of build'),
              concat('NetCDF Fortran version: ', if(seq % 5 = 0, '', concat('4.', seq % 8, '.1'))),
              'NetCDF library version: netCDF 9.9.9', 'compiling',
              if(seq % 7 <> 0, '{K.SUCCESS_MESSAGE}', 'error: stopped'),
              repeat('trailing line\\n', int(seq % 300))) AS text""",
        )
        .withColumn("match_text", F.col("text"))
    )


def report_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per report: ``(machine, pos, commit_hash, committed_at, message, path)``."""
    return cells(spark, sf_dir).selectExpr(
        "lower(host) AS machine",
        "-seq AS pos",
        "md5(string(seq)) AS commit_hash",
        "concat(day, ' +0000') AS committed_at",
        """concat('update for test of ', compiler, '_', c_version, '_', mpi, '_', o_g, '_', branch,
          ' with hash ', hash, ' on ', lower(host), ' [ci skip]\\n') AS message""",
        f"concat(folder, '{K.REPORT_FILE}') AS path",
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per event, newest first by ``pos``; cheap events name no version."""
    return (
        table(spark, sf_dir, "events")
        .withColumn("n", F.expr("user_id % 20"))
        .selectExpr(
            "event_type AS machine",
            "-event_id AS pos",
            "md5(string(event_id)) AS commit_hash",
            "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' +0000') AS committed_at",
            f"""concat(if(value < 1.0, concat('merge of main on ', event_type),
              concat('  update for test of gfortran_8.3.0_mpiuni_O_', {_pick('user_id % 4', EVENT_BRANCHES)},
                ' with hash ', if(n % 2 = 0, concat('v8.3.0b', n, '-5-g64eb', n),
                  concat('{K.SNAPSHOT_PREFIX}8_3_0_beta_snapshot_', n, '-5-g64eb', n)),
                ' on ', event_type, ' [ci skip]')),
              '\\n\\nrecorded by the nightly job\\n') AS message""",
            f"concat('/r/file', user_id, '/{K.REPORT_FILE}') AS path",
        )
    )


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(branch, branch_pos)`` of the report commits, by name."""
    named = cells(spark, sf_dir).select("branch").distinct()
    return named.withColumn("branch_pos", F.col("branch"))


def tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a report and a build log per supplier, as files of their own bytes.

    Reports are ISO-8859-1 and name an operating system with a sign beyond ASCII; every
    seventh lacks its last result, every fifth supplier has no log, and some logs end in
    another suffix. Lines end in ``\\n``.
    """
    root = scratch_dir(spark, "tree")
    disk = local_path(spark, root)
    supplier = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.expr(_pick("s_nationkey % 3", BRANCHES)).alias("branch"),
        F.expr(_pick("s_suppkey % 3", TREE_HOSTS)).alias("host"),
        F.expr(_pick("s_suppkey % 2", ("intel", "nag"))).alias("compiler"),
        F.lit("18.0").alias("c_version"),
        F.lit("g").alias("o_g"),
        F.lit("mpich").alias("mpi"),
        F.expr("concat('3.', s_suppkey)").alias("m_version"),
        F.expr(_pick("s_suppkey % 4", TREE_VERSIONS)).alias("version"),
    )
    supplier = supplier.withColumn("os", F.lit("Línux"))
    results = F.expr(
        """transform(array('unit', 'system', 'example', 'nuopc'), k -> concat(k, ' test results\tPASS ',
          if(k = 'unit', s_suppkey, 7), '\tFAIL ', if(k = 'system', s_suppkey % 5, 0)))"""
    )
    results = F.when(F.col("s_suppkey") % 7 == 0, F.slice(results, 1, 3)).otherwise(results)
    report = F.concat(F.array(F.expr(_HEADER.format(branch="branch"))), results, F.array(F.lit("---"), "version"))
    log = F.array(
        F.lit("café"),
        F.lit("netcdf LIBRARY version: netCDF 4.7.1"),
        F.expr("concat('NetCDF Fortran version: ', if(s_suppkey % 4 = 0, '', '4.5.3'))"),
        F.lit("NetCDF library version: netCDF 9.9.9"),
        F.expr(f"if(s_suppkey % 6 <> 0, '{K.SUCCESS_MESSAGE}', 'error: stopped')"),
        F.col("version"),
    )
    folders = ["branch", "host", "compiler", "c_version", "o_g", "mpi", "m_version", "dir"]
    odd = F.when(F.col("s_suppkey") % 8 == 3, "txt").otherwise("log")
    kinds = (
        (K.REPORT_FILE, report, "dat", K.REPORT_ENCODING, F.lit("dat"), F.lit(True)),
        (K.LOG_FILE, log, "log", "UTF-8", odd, F.col("s_suppkey") % 5 != 0),
        (K.LOG_FILE, log, "txt", "UTF-8", odd, F.col("s_suppkey") % 5 != 0),
    )
    for name, lines, suffix, encoding, own, there in kinds:
        place = F.concat(F.lit("r"), F.col("s_suppkey").cast("string"), F.lit(f"-{name}"))
        rows = supplier.where(there & (own == suffix)).withColumn("dir", place)
        rows = rows.select(*folders, lines.alias("lines")).repartition(file_tasks(spark), "dir")
        if disk:
            # Named as ``partitionBy`` names folders; no value has a letter that it would escape.
            named = [F.concat(F.lit(f"{c}="), F.coalesce(c, F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in folders]
            body = F.concat(F.array_join("lines", "\n"), F.lit("\n"))
            rows = rows.select(
                F.concat_ws("/", *named, F.lit(f"lines.{suffix}")).alias("path"),
                F.encode(body, encoding).alias("content"),
            )
            write_files(rows.sortWithinPartitions("path"), disk)
            continue
        rows = rows.select(*folders, F.posexplode("lines").alias("at", "line"))
        rows = rows.sortWithinPartitions(*folders, "at").drop("at")
        # The CSV writer, as it takes a suffix and an encoding; no sign of its own can occur.
        options = {"extension": suffix, "encoding": encoding, "sep": "\x01", "quote": "\x02", "escape": "\x03",
                   "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}
        rows.write.mode("append").partitionBy(*folders).options(**options, **TASKS_MOVE_FILES).csv(root)
    return root
