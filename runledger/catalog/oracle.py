"""SQL for DuckDB that yields what each query must, from the tables alone.

Reports are never parsed here: the SQL computes what was rendered into them.
"""

from __future__ import annotations

from runledger import constants as K
from runledger.catalog import samples as S
from runledger.catalog.queries import HOST_PATTERNS, QTY

KINDS = tuple(K.KINDS)
KEY = ", ".join(K.LEDGER_KEY)
ORDER = ", ".join(K.REPORT_ORDER)

CELLS = """
base AS (
  SELECT *, (o_orderkey // 60) % 6 AS k FROM orders JOIN customer ON o_custkey = c_custkey
),
named AS (
  SELECT o_orderkey AS seq, o_orderstatus AS status, o_orderpriority AS priority,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day,
    ['develop', 'feat_x', 'layout_fix'][CAST(o_custkey % 3 AS INT) + 1] AS branch,
    ['cheyenne', 'hera', 'orion', 'Gaea'][c_nationkey % 4 + 1] AS host,
    ['gfortran', 'intel', 'nag'][CAST(o_orderkey % 3 AS INT) + 1] AS compiler,
    CAST(8 + o_orderkey % 4 AS VARCHAR) || '.3.0' AS c_version,
    CASE o_orderkey % 5 WHEN 0 THEN 'mpiuni' WHEN 1 THEN 'openmpi' ELSE 'intelmpi' END AS mpi,
    '4.0.' || CAST(o_orderkey % 3 AS VARCHAR) || '-A' AS m_shown,
    CASE WHEN o_orderkey % 2 = 0 THEN 'g' ELSE 'O' END AS o_g,
    CASE WHEN o_custkey % 11 = 0 THEN 'Darwin' ELSE 'Linux' END AS os,
    CASE WHEN k = 5 THEN 'v8.5.0'
      ELSE 'v8.' || k || '.0b0' || k || '-5-g60a38e' || k END AS hash,
    8000 + o_orderkey % 997 AS unit_pass, o_custkey % 7 AS unit_fail,
    CASE WHEN o_orderkey % 13 <> 0 THEN 49::BIGINT END AS system_pass,
    CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey % 3 END AS system_fail,
    CASE WHEN o_orderkey % 29 = 0 THEN -1::BIGINT ELSE 80::BIGINT END AS example_pass,
    CASE WHEN o_orderkey % 29 = 0 THEN -1::BIGINT ELSE 0::BIGINT END AS example_fail,
    50::BIGINT AS nuopc_pass, 0::BIGINT AS nuopc_fail
  FROM base
),
cells AS (
  SELECT *, lower(m_shown) AS m_version,
    CASE WHEN system_pass IS NULL THEN 'fail' ELSE 'ok' END AS system_status,
    'ok' AS unit_status, 'ok' AS example_status, 'ok' AS nuopc_status,
    CASE WHEN priority = '2-HIGH' THEN translate(raw_line, '.', '_') ELSE raw_line END AS version_line,
    '/r/' || branch || '/' || host || '/' || compiler || '/' || c_version || '/' || o_g || '/'
      || mpi || '/' || m_shown || '/r' || lpad(CAST(seq AS VARCHAR), 12, '0') || '/' AS folder
  FROM (SELECT *, CASE WHEN hash LIKE '%-g%' THEN hash || '2' ELSE hash END AS raw_line FROM named)
)"""

LOGS = """
logs AS (
  SELECT seq, hash, version_line, folder || 'build.log' AS path,
    seq % 7 <> 0 AS build_passed,
    '4.' || CAST(seq % 9 AS VARCHAR) || '.2' AS netcdf_c,
    CASE WHEN seq % 5 = 0 THEN '' ELSE '4.' || CAST(seq % 8 AS VARCHAR) || '.1' END AS netcdf_f,
    replace(branch, 'out', '') AS branch, lower(host) AS host, compiler, c_version, lower(o_g) AS o_g,
    mpi, m_version, branch AS real_branch, lower(host) = host AS own_machine
  FROM cells WHERE status <> 'P'
)"""


def _build_map(keys: str, source: str = "logs") -> str:
    return f"""
built AS (
  SELECT {keys}, arg_max(build_passed, path) AS build_passed, arg_max(netcdf_c, path) AS netcdf_c,
    arg_max(netcdf_f, path) AS netcdf_f
  FROM {source} GROUP BY {keys}
)"""


BUILT = _build_map(", ".join(K.LOOKUP_KEY))
OUTCOME = """
    coalesce(b.build_passed, false) AS build_passed,
    CASE WHEN b.branch IS NULL THEN 'unknown' WHEN b.netcdf_c = '' THEN 'N/A' ELSE b.netcdf_c END AS netcdf_c,
    CASE WHEN b.branch IS NULL THEN 'unknown' WHEN b.netcdf_f = '' THEN 'N/A' ELSE b.netcdf_f END AS netcdf_f"""
ON_KEY = " AND ".join(f"lower(c.{k}) = b.{k}" for k in K.LOOKUP_KEY)

RECORD = """
    md5(CAST(c.seq AS VARCHAR)) AS artifacts_hash, c.hash AS branch_hash, c.day || ' +0000' AS modified"""
ROWS = f"""
rows_ AS (
  SELECT c.*, {OUTCOME}, {RECORD} FROM cells c LEFT JOIN built b ON {ON_KEY}
)"""
FLAT = f"""{KEY}, {", ".join(f"{k}_pass, {k}_fail, {k}_status" for k in KINDS)},
  build_passed, netcdf_c, netcdf_f, artifacts_hash, branch_hash, modified"""


def _last(keys: str, order: str = "seq", source: str = "rows_", name: str = "ledger") -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order} DESC) AS rn FROM {source}
  ) WHERE rn = 1
)"""


WITH_ROWS = f"WITH {CELLS}, {LOGS}, {BUILT}, {ROWS}"
LEDGER = f"{WITH_ROWS}, {_last(KEY)}"
HISTORY = f"{WITH_ROWS}, {_last(KEY + ', branch_hash')}"


def _merged(name: str, kind: str, side: str) -> str:
    return (
        f"CASE WHEN {kind}_status = 'fail' THEN 'fail' "
        f"ELSE CAST({kind}_{side} AS VARCHAR) END AS {name}"
    )


ARCHIVE = f"""{KEY}, {", ".join(
    _merged(f"{short}_{side}", kind, side)
    for kind, short in K.KINDS.items() for side in ("pass", "fail"))},
  CAST(build_passed AS BIGINT) AS build, netcdf_c, netcdf_f, artifacts_hash, branch_hash, modified"""


def _shown(kind: str, short: str, side: str) -> str:
    return (
        f"CASE WHEN {kind}_status = 'fail' THEN 'fail' WHEN {kind}_{side} = -1 THEN 'pending' "
        f"ELSE CAST({kind}_{side} AS VARCHAR) END AS {short}_{side}"
    )


REPORT = f"""branch, host, compiler || ' ' || c_version AS compiler, mpi || ' ' || m_version AS mpi,
  netcdf_c || ' ' || netcdf_f AS netcdf, o_g, os,
  CASE WHEN build_passed THEN 'pass' ELSE 'fail' END AS build,
  {", ".join(_shown(kind, short, s) for kind, short in K.KINDS.items() for s in ("pass", "fail"))},
  '[artifacts]({S.BASE_URL}/tree/' || artifacts_hash || '/' || branch || '/' || host || '/' || compiler
    || '/' || c_version || '/' || o_g || '/' || mpi || '/' || m_version || ')' AS artifacts_hash,
  modified"""

# Which lines match which version, as a regular expression and as text.
REGEX_HIT = """(CASE WHEN h.hash LIKE '%-g%'
    THEN length(c.version_line) >= length(h.hash) ELSE c.version_line = h.hash END
  AND regexp_matches(c.version_line, '^(?:' || h.hash || ')'))"""
LITERAL_HIT = REGEX_HIT.replace(
    "regexp_matches(c.version_line, '^(?:' || h.hash || ')')", "starts_with(c.version_line, h.hash)"
)

# Recent versions per job of the run.
_MACHINES = ", ".join(f"('{m}', {i})" for i, m in enumerate(S.RUN_MACHINES))
RUN_JOBS = f"""
run_machines(machine, machine_pos) AS (VALUES {_MACHINES}),
run_jobs AS (SELECT m.*, b.branch FROM run_machines m, (SELECT DISTINCT branch FROM cells) b),
run_first AS (
  SELECT j.machine, j.machine_pos, j.branch, c.hash AS branch_hash, max(c.seq) AS newest
  FROM run_jobs j JOIN cells c ON lower(c.host) = j.machine AND c.branch = j.branch GROUP BY ALL
),
run_hashes AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY machine, branch ORDER BY newest DESC) AS hash_rank
    FROM run_first
  ) WHERE hash_rank <= {QTY}
)"""
_RUN_ON = " AND ".join(f"lower(c.{k}) = b.{k}" for k in K.LOOKUP_KEY)
RUN_RESULTS = f"""
run_logs AS (
  SELECT r.machine, r.branch AS job_branch, r.branch_hash, c.* EXCLUDE (real_branch, own_machine)
  FROM logs c JOIN run_hashes r ON c.real_branch = r.branch AND c.host = r.machine AND c.own_machine
  JOIN (SELECT DISTINCT hash FROM cells) h ON h.hash = r.branch_hash WHERE {REGEX_HIT}
),
{_build_map("machine, job_branch, branch_hash, " + ", ".join(K.LOOKUP_KEY), "run_logs").replace("built AS", "run_built AS")},
run_found AS (
  SELECT r.machine, r.machine_pos, r.branch AS job_branch, r.branch_hash, r.hash_rank, c.*
  FROM cells c JOIN run_hashes r ON c.branch = r.branch AND c.host = r.machine
  JOIN (SELECT DISTINCT hash FROM cells) h ON h.hash = r.branch_hash WHERE {REGEX_HIT}
),
rows_ AS (
  SELECT c.*, {OUTCOME}, md5(CAST(c.seq AS VARCHAR)) AS artifacts_hash, c.day || ' +0000' AS modified,
    c.folder || 'summary.dat' AS source_path
  FROM run_found c LEFT JOIN run_built b ON {_RUN_ON} AND c.machine = b.machine
    AND c.job_branch = b.job_branch AND c.branch_hash = b.branch_hash
)"""
WITH_RUN = f"WITH {CELLS}, {LOGS}, {RUN_JOBS}, {RUN_RESULTS}"

_TOKEN = f"""CASE WHEN user_id % 20 % 2 = 0
    THEN 'v8.3.0b' || user_id % 20 || '-5-g64eb' || user_id % 20
    ELSE '{K.SNAPSHOT_PREFIX}8_3_0_beta_snapshot_' || user_id % 20 || '-5-g64eb' || user_id % 20 END"""
EVENT_COMMITS = f"""
event_commits AS (
  SELECT event_id, event_type AS machine, {_TOKEN} AS token, user_id,
    ['develop', 'feat_x', 'layout_fix', 'develop_x'][CAST(user_id % 4 AS INT) + 1] AS branch,
    value >= 1.0 AS versioned
  FROM events
)"""


def _recent(named: str) -> str:
    return f"""WITH {EVENT_COMMITS},
jobs AS (
  SELECT DISTINCT branch, length(branch) - 4 AS qty FROM event_commits WHERE versioned
)
SELECT machine, branch, token AS branch_hash, hash_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY machine, branch ORDER BY newest DESC) AS hash_rank FROM (
    SELECT c.machine, j.branch, j.qty, c.token, max(c.event_id) AS newest
    FROM event_commits c JOIN jobs j ON {named} WHERE c.versioned GROUP BY ALL))
WHERE hash_rank <= qty"""


DOC_LINES = """
doc_lines AS (
  SELECT doc_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line_no
  FROM (SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10))
    THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l FROM documents)
)"""


def _markdown() -> str:
    columns = list(K.REPORT_COLUMNS)
    integer = "regexp_full_match({c}, '[+-]?[0-9]+')"
    sizes = ", ".join(
        f"greatest({len(c) + 2}, max(length({c}))) AS w_{c}, bool_and({integer.format(c=c)}) AS n_{c}"
        for c in columns
    )

    def cell(value: str, c: str) -> str:
        return (
            f"CASE WHEN n_{c} THEN lpad({value}, CAST(w_{c} AS INT), ' ') "
            f"ELSE rpad({value}, CAST(w_{c} AS INT), ' ') END"
        )

    head = " || ' | ' || ".join(cell(f"'{c}'", c) for c in columns)
    body = " || ' | ' || ".join(cell(c, c) for c in columns)
    rule = " || '|' || ".join(f"repeat('-', w_{c} + 2)" for c in columns)
    return f"""{HISTORY},
shown AS (
  SELECT branch_hash, row_number() OVER (PARTITION BY branch_hash ORDER BY {ORDER}, os) - 1 AS place,
    {REPORT} FROM ledger
),
sizes AS (
  SELECT branch_hash, greatest(2, length(CAST(count(*) - 1 AS VARCHAR))) AS w_, {sizes}
  FROM shown GROUP BY branch_hash
)
SELECT branch_hash, 0::BIGINT AS line_no,
  '| ' || lpad('', CAST(w_ AS INT), ' ') || ' | ' || {head} || ' |' AS line FROM sizes
UNION ALL SELECT branch_hash, 1, '|' || repeat('-', w_ + 2) || '|' || {rule} || '|' FROM sizes
UNION ALL SELECT branch_hash, place + 2,
  '| ' || lpad(CAST(place AS VARCHAR), CAST(w_ AS INT), ' ') || ' | ' || {body} || ' |'
FROM shown JOIN sizes USING (branch_hash)"""


def _aligned() -> str:
    names = ["os", "host", "compiler", "c_version", "mpi", "m_shown", "o_g"]
    names += [f"{k}_{s}" for k in KINDS for s in ("p", "f")]
    words = ", ".join(
        f"CASE WHEN {k}_pass IS NULL THEN '{p}' ELSE CAST({k}_{s} AS VARCHAR) END AS {k}_{c}"
        for k in KINDS
        for s, c, p in (("pass", "p", "tests"), ("fail", "f", "not"))
    )
    header = ", ".join(f"'{h}'" for h in K.ALIGNED_HEADER)
    line = " || ' ' || ".join(names)
    padded = " || '  ' || ".join(
        [f"rpad({n}, CAST(max(length({n})) OVER g AS INT), ' ')" for n in names[:-1]] + [names[-1]]
    )
    return f"""WITH {CELLS},
newest AS (
  SELECT DISTINCT arg_max(hash, seq) OVER (PARTITION BY lower(host)) AS branch_hash
  FROM cells WHERE branch = 'develop'
),
found AS (
  SELECT n.branch_hash, c.os, c.host, c.compiler, c.c_version, c.mpi,
    CASE WHEN c.mpi = 'mpiuni' THEN 'none' ELSE c.m_shown || '-r' || lpad(CAST(seq AS VARCHAR), 12, '0')
      END AS m_shown,
    c.o_g, {words}, c.folder || c.seq AS path
  FROM cells c JOIN newest n ON starts_with(c.hash, n.branch_hash) WHERE c.branch = 'develop'
),
texts AS (
  SELECT * EXCLUDE (path), path FROM found
  UNION ALL SELECT branch_hash, {header}, '' FROM (SELECT DISTINCT branch_hash FROM found)
)
SELECT branch_hash, row_number() OVER (PARTITION BY branch_hash ORDER BY host, {line}, path) - 1 AS line_no,
  {padded} AS line
FROM texts WINDOW g AS (PARTITION BY branch_hash)"""


def _host_case() -> str:
    whens = " ".join(
        f"WHEN regexp_matches(host, '^(?:{p})') THEN '{n}'" for n, p in HOST_PATTERNS
    )
    return f"CASE {whens} END"


_LINE_KEY = "l_orderkey, l_linenumber"
_LINE_ORDER = ", ".join(
    f"{c} DESC"
    for c in (
        "l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_tax",
        "l_discount", "l_returnflag", "l_linestatus",
    )
)

TREE = """
tree AS (
  SELECT s_suppkey AS seq, ['develop', 'feat_x', 'layout_fix'][CAST(s_nationkey % 3 AS INT) + 1] AS branch,
    ['cheyenne', 'hera', 'orion'][CAST(s_suppkey % 3 AS INT) + 1] AS host,
    ['intel', 'nag'][CAST(s_suppkey % 2 AS INT) + 1] AS compiler, '18.0' AS c_version, 'mpich' AS mpi,
    '3.' || s_suppkey AS m_version, 'g' AS o_g, 'Línux' AS os,
    'v9.' || s_suppkey % 4 || '.0b1-2-gab' || s_suppkey % 4 AS hash,
    s_suppkey % 5 <> 0 AND s_suppkey % 8 <> 3 AS logged, s_suppkey % 6 <> 0 AS build_passed,
    '4.7.1' AS netcdf_c, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '4.5.3' END AS netcdf_f,
    s_suppkey % 7 <> 0 AS whole
  FROM supplier
)"""
_TREE_LOGS = f"""WITH {TREE}
SELECT seq, {KEY.replace(", os", "")}, build_passed, netcdf_c, netcdf_f FROM tree WHERE logged"""

ORACLE: dict[str, str] = {
    "tree_reports": f"""WITH {TREE}
SELECT seq, {KEY}, seq AS unit_pass, 0::BIGINT AS unit_fail, 'ok' AS unit_status,
  7::BIGINT AS system_pass, seq % 5 AS system_fail, 'ok' AS system_status,
  7::BIGINT AS example_pass, 0::BIGINT AS example_fail, 'ok' AS example_status,
  CASE WHEN whole THEN 7::BIGINT END AS nuopc_pass, CASE WHEN whole THEN 0::BIGINT END AS nuopc_fail,
  CASE WHEN whole THEN 'ok' END AS nuopc_status,
  CASE WHEN whole THEN 'whole' ELSE 'missing_kind' END AS reject_reason
FROM tree""",
    "tree_logs": _TREE_LOGS,
    "tree_logs_by_line": _TREE_LOGS,
    "tree_run": f"""WITH {TREE}
SELECT host AS machine, branch AS job_branch, seq, host, hash AS branch_hash, seq AS unit_pass,
  logged AND build_passed AS build_passed, CASE WHEN logged THEN netcdf_c ELSE 'unknown' END AS netcdf_c,
  CASE WHEN NOT logged THEN 'unknown' WHEN netcdf_f = '' THEN 'N/A' ELSE netcdf_f END AS netcdf_f
FROM tree WHERE whole""",
    "lookup_missing_attribute": f"""WITH {CELLS},
{LOGS.replace("logs AS (", "logs AS ( SELECT * REPLACE (CASE WHEN mpi = 'mpiuni' THEN 'none' ELSE m_version END AS m_version, CASE WHEN mpi = 'mpiuni' THEN replace(path, '/4.0.' || seq % 3 || '-A/', '/None/') ELSE path END AS path) FROM (", 1)[:-1]})), {BUILT}
SELECT seq, {OUTCOME} FROM (SELECT * REPLACE (CASE WHEN mpi = 'mpiuni' THEN 'none' ELSE m_version END AS m_version) FROM cells) c
LEFT JOIN built b ON {ON_KEY}""",
    "file_scan": """
SELECT doc_id, CAST(len(string_split(body, chr(10))) AS BIGINT) AS n_lines, md5(body) AS digest,
  true AS valid
FROM (SELECT *, CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END AS body
  FROM documents)
WHERE lang <> 'de' AND source <> 'src3'""",
    "path_filter": """
SELECT page_id, url FROM pages
WHERE contains(url, '://') AND contains(url, '.example.')
  AND NOT contains(url, 'page=') AND NOT contains(url, 'cheap')""",
    "ref_listing": """
SELECT c_custkey AS pos, lower(c_mktsegment) || '/' || c_name AS branch,
  lower(c_mktsegment) || '_' || c_name AS folder FROM customer""",
    "config_explode": """
SELECT 0::BIGINT AS machine_pos, s_name AS machine_name, lower(s_name) || '*' AS hostname_pattern,
  CAST(i AS BIGINT) AS path_pos,
  CASE i WHEN 0 THEN '/scratch/' || s_suppkey ELSE '/home/' || s_nationkey END AS update_path
FROM supplier, (VALUES (0), (1)) v(i)""",
    "line_match": f"""WITH {DOC_LINES}
SELECT doc_id, line_no, line FROM doc_lines
WHERE regexp_matches(line, '^(?:The|E.u|Ist? [a-m])')""",
    "hash_match_rules": f"""WITH {CELLS},
hashes AS (
  SELECT hash FROM cells
  UNION SELECT replace(hash, 'v8', 'v+8') FROM cells
  UNION SELECT replace(hash, '60a38e', '[6].+') FROM cells
  UNION SELECT replace(hash, '5-g60a38e', '(5|6)-g6') FROM cells
)
SELECT c.folder || 'summary.dat' AS path, h.hash AS branch_hash
FROM cells c, hashes h WHERE {REGEX_HIT}""",
    "hash_match_literal": f"""WITH {CELLS}
SELECT c.folder || 'summary.dat' AS path, h.hash AS branch_hash
FROM cells c, (SELECT DISTINCT hash FROM cells) h WHERE {LITERAL_HIT}""",
    "path_job_match": f"""WITH {CELLS}, {RUN_JOBS}
SELECT c.folder || 'summary.dat' AS path, j.machine, j.branch
FROM cells c JOIN run_jobs j ON contains(c.folder, '/' || j.branch || '/') AND contains(c.folder, j.machine)""",
    "contains_mark": f"""WITH {CELLS}
SELECT c.folder || 'summary.dat' AS path, h.hash AS branch_hash
FROM cells c JOIN (SELECT DISTINCT hash FROM cells) h ON starts_with(c.hash, h.hash)""",
    "parse_header": f"WITH {CELLS} SELECT seq, {KEY} FROM cells",
    "parse_results": f"""WITH {CELLS}
SELECT seq, {", ".join(f"{k}_pass, {k}_fail, {k}_status" for k in KINDS)} FROM cells""",
    "parse_rejects": """
SELECT o_orderkey AS seq, CASE o_orderpriority WHEN '3-MEDIUM' THEN 'no_header'
  WHEN '4-NOT SPECIFIED' THEN 'missing_kind' WHEN '5-LOW' THEN 'bad_header'
  WHEN '2-HIGH' THEN 'bad_result' ELSE 'whole' END AS reject_reason
FROM orders""",
    "build_attrs": f"WITH {CELLS}, {LOGS} SELECT seq, build_passed, netcdf_c, netcdf_f FROM logs",
    "build_tail_success": f"""WITH {CELLS}, {LOGS}
SELECT seq, build_passed AND seq % 300 < 202 AS tail_passed FROM logs""",
    "path_attrs": f"""WITH {CELLS}
SELECT seq, replace(branch, 'out', '') AS branch, lower(host) AS host, compiler, c_version,
  lower(o_g) AS o_g, mpi, m_version FROM cells""",
    "hash_token": f"""WITH {EVENT_COMMITS}
SELECT md5(CAST(event_id AS VARCHAR)) AS commit_hash, CASE WHEN versioned THEN token ELSE '' END AS token,
  CASE WHEN versioned THEN '64eb' || user_id % 20 ELSE '' END AS prefix, NOT versioned AS tagged,
  CASE WHEN versioned THEN token ELSE 'the' END AS word
FROM event_commits""",
    "branch_from_log": f"""WITH {EVENT_COMMITS}
SELECT branch, -max(event_id) AS first_pos FROM event_commits WHERE versioned GROUP BY branch""",
    "ordered_unique": """
SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY ALL""",
    "recent_n_unique": _recent("regexp_matches(c.branch, j.branch)"),
    "recent_n_exact": _recent("c.branch = j.branch"),
    "job_grid": f"""
SELECT CAST(i AS BIGINT) AS machine_pos, machine, branch, 2::BIGINT AS qty
FROM (VALUES {", ".join(f"({i}, '{m}')" for i, m in enumerate(K.MACHINES))}) m(i, machine),
  (SELECT DISTINCT lang AS branch FROM documents)""",
    "job_hashes": f"""WITH {CELLS}, {RUN_JOBS}
SELECT machine, branch, branch_hash, hash_rank FROM run_hashes""",
    "missing_jobs": f"""WITH {CELLS}, {RUN_JOBS}
SELECT machine, branch FROM run_jobs ANTI JOIN run_hashes USING (machine, branch)""",
    "build_map": f"WITH {CELLS}, {LOGS}, {BUILT} SELECT * FROM built",
    "lookup_default": f"""{WITH_ROWS} SELECT seq, build_passed, netcdf_c, netcdf_f FROM rows_""",
    "latest_commit_per_file": """
SELECT event_type AS machine, '/r/file' || user_id || '/summary.dat' AS path,
  md5(CAST(max(event_id) AS VARCHAR)) AS artifacts_hash,
  strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') || ' +0000' AS modified,
  CAST(epoch(date_trunc('second', arg_max(ts, event_id))) AS BIGINT) AS epoch
FROM events GROUP BY event_type, user_id""",
    "regex_lookup": f"""
SELECT page_id, host, {_host_case()} AS machine
FROM (SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS host FROM pages)""",
    "upsert_last_wins": f"{LEDGER} SELECT {FLAT} FROM ledger",
    "upsert_lineitem": f"""
SELECT * EXCLUDE (rn, l_shipdate), CAST(l_shipdate AS DATE) AS l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY {_LINE_KEY}
    ORDER BY l_returnflag = 'R' DESC, {_LINE_ORDER}) AS rn FROM lineitem)
WHERE rn = 1""",
    "upsert_history": f"{HISTORY} SELECT {FLAT} FROM ledger",
    "ledger_all": f"{LEDGER} SELECT {FLAT} FROM ledger",
    "ledger_by_hash": f"{LEDGER} SELECT {ARCHIVE} FROM ledger WHERE branch_hash = 'v8.5.0'",
    "hashes_of_branch": f"{LEDGER} SELECT DISTINCT branch_hash FROM ledger WHERE branch = 'develop'",
    "ledger_counts": f"""{LEDGER}
SELECT branch, host, count(*) AS reports, count(*) FILTER (build_passed) AS builds_passed,
  count(*) FILTER (netcdf_c = 'unknown') AS without_log FROM ledger GROUP BY ALL""",
    "incremental_equals_batch": f"""{WITH_ROWS}, {_last(KEY, "status DESC, seq")}
SELECT {FLAT} FROM ledger""",
    "report_rows": f"{WITH_ROWS} SELECT branch_hash, {REPORT} FROM rows_",
    "archive_rows": f"{WITH_ROWS} SELECT {ARCHIVE} FROM rows_",
    "report_locations": f"""WITH {CELLS}
SELECT DISTINCT 'out/' || branch || '/' || hash AS location,
  '[artifacts]({S.BASE_URL}/tree/' || host || '/' || branch || '/' || host || '/' || compiler || '/'
    || c_version || '/' || o_g || '/' || mpi || '/' || m_version || ')' AS link
FROM cells""",
    "concat_sort_rank": f"""WITH {CELLS},
configs AS (
  SELECT DISTINCT {ORDER.replace("m_version", "m_shown AS m_version")} FROM cells
),
joined AS (SELECT *, {" || ".join(K.REPORT_ORDER)} AS joined FROM configs)
SELECT *, row_number() OVER (ORDER BY {ORDER}) - 1 AS column_place,
  row_number() OVER (ORDER BY joined, {ORDER}) - 1 AS joined_place FROM joined""",
    "markdown_lines": _markdown(),
    "csv_roundtrip": f"{HISTORY} SELECT branch_hash AS report_hash, {REPORT} FROM ledger",
    "aligned_report": _aligned(),
    "run_results": f"""{WITH_RUN}
SELECT machine, job_branch, source_path, {FLAT} FROM rows_""",
    "full_run": f"""{WITH_RUN}, {_last(KEY, "hash_rank DESC, source_path")} SELECT {FLAT} FROM ledger""",
    "run_missing": f"""{WITH_RUN}
SELECT machine, branch AS job_branch, branch_hash FROM run_hashes r
WHERE NOT EXISTS (SELECT 1 FROM run_found f WHERE f.machine = r.machine AND f.job_branch = r.branch
  AND f.branch_hash = r.branch_hash)""",
    "latest_pointer": f"""{WITH_RUN}
SELECT job_branch AS branch_dir, arg_max(branch_hash, machine_pos) AS branch_hash
FROM run_found WHERE hash_rank = 1 GROUP BY job_branch""",
    "report_targets": f"""{WITH_RUN}
SELECT DISTINCT job_branch AS branch_dir, branch_hash FROM run_found""",
    "reports_as_written": f"""WITH {CELLS}, {LOGS}, {BUILT}, {ROWS.replace("rows_ AS", "stored_rows AS")},
{_last(KEY, source="stored_rows", name="stored")}, {RUN_JOBS}, {RUN_RESULTS},
merged AS (
  SELECT {FLAT}, row(machine_pos, job_branch, hash_rank) AS at FROM (
    SELECT *, row_number() OVER (PARTITION BY {KEY}, machine_pos, job_branch, hash_rank
      ORDER BY source_path DESC) AS rn FROM rows_) WHERE rn = 1
  UNION ALL SELECT {FLAT}, row(-1, '', 0) FROM stored
),
targets AS (
  SELECT 'each' AS kind, job_branch AS report_branch, branch_hash AS report_hash,
    max(row(machine_pos, job_branch, hash_rank)) AS written FROM run_found GROUP BY ALL
  UNION ALL
  SELECT 'latest', job_branch, arg_max(branch_hash, machine_pos),
    max(row(machine_pos, job_branch, hash_rank)) FROM run_found WHERE hash_rank = 1 GROUP BY job_branch
)
SELECT kind, report_branch, report_hash, {FLAT}
FROM targets t JOIN merged m ON m.branch_hash = t.report_hash AND m.at <= t.written
WHERE NOT EXISTS (SELECT 1 FROM merged n WHERE n.at > m.at AND n.at <= t.written
  AND {" AND ".join(f"n.{k} = m.{k}" for k in K.LEDGER_KEY)})""",
    "two_runs_ledger": f"""{WITH_RUN}, {_last(KEY + ", branch_hash", "hash_rank DESC, source_path")}
SELECT {FLAT} FROM ledger""",
    "two_runs_reports": f"""{WITH_RUN},
first_run AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY machine_pos DESC, hash_rank DESC,
      source_path DESC) AS rn FROM rows_ WHERE job_branch = 'develop') WHERE rn = 1
),
batches AS (
  SELECT job_branch = 'develop' AS early, row(machine_pos, job_branch, hash_rank) AS at, job_branch,
    {FLAT} FROM (
    SELECT *, row_number() OVER (PARTITION BY {KEY}, machine_pos, job_branch, hash_rank
      ORDER BY source_path DESC) AS rn FROM rows_) WHERE rn = 1
),
merged AS (
  SELECT * EXCLUDE (job_branch) FROM batches
  UNION ALL SELECT false, row(-1, '', 0), {FLAT} FROM first_run
),
targets AS (
  SELECT job_branch = 'develop' AS early, job_branch AS report_branch, branch_hash AS report_hash,
    max(row(machine_pos, job_branch, hash_rank)) AS written FROM run_found GROUP BY ALL
),
ledger AS (
  SELECT t.report_branch, t.report_hash, m.* FROM targets t
  JOIN merged m ON m.early = t.early AND m.branch_hash = t.report_hash AND m.at <= t.written
  WHERE NOT EXISTS (SELECT 1 FROM merged n WHERE n.early = m.early AND n.at > m.at
    AND n.at <= t.written AND {" AND ".join(f"n.{k} = m.{k}" for k in K.LEDGER_KEY)})
)
SELECT report_branch, report_hash, {REPORT} FROM ledger""",
}
