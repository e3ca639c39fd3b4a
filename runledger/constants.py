"""Values the report formats prescribe.

Everything below is a fixed value: the texts, patterns and orders that reports,
logs and archives use. Changing one changes which reports are recognised.
"""

# Version tokens, tried in this order.
SNAPSHOT_PREFIX = "ESMF_"
HASH_PATTERNS = (r"ESMF_\S*", r"v\S*\.\S*\.\S*")

# Markers inside reports and build logs.
HEADER_MARK = "Build for"
RESULT_MARK = "test results"
OS_MARK = "esmf_os"
HASH_MARK = "hash = "
SUCCESS_MESSAGE = "ESMF library built successfully"
NETCDF_C_MARK = "NetCDF library version:"
NETCDF_F_MARK = "NetCDF Fortran version:"
VERSION_PATTERN = r"\d{1,}\.\d{1,}\.\d{1,}"
BRANCH_IN_LOG_PATTERN = r"(_[Og]_)(.*)(\swith.*)"

# Symbols.
QUEUED = -1
NOT_AVAILABLE = "N/A"
UNKNOWN = "unknown"
NO_ATTRIBUTE = "none"
PENDING = "pending"
PASSED = "pass"
FAILED = "fail"

# File names and the path parts that rule a file out.
REPORT_FILE = "summary.dat"
LOG_FILE = "build.log"
REPORT_IGNORE = ("swp",)
LOG_IGNORE = ("module", "python", "swp")
REPORT_ENCODING = "ISO-8859-1"
STRIPPED_PATH_TOKEN = "out"

# Machines a run covers unless told otherwise.
MACHINES = (
    "acorn",
    "catania",
    "cheyenne",
    "chianti",
    "cori",
    "discover",
    "gaea",
    "gaffney",
    "hera",
    "izumi",
    "jet",
    "onyx",
    "orion",
)

# Test kinds, and the column prefix each has in the archive.
KINDS = {"unit": "u", "system": "s", "example": "e", "nuopc": "nuopc"}

# Attributes that tie a report to its build log, in path order.
LOOKUP_KEY = ("branch", "host", "compiler", "c_version", "o_g", "mpi", "m_version")

# Primary key of the ledger and order of its reports.
LEDGER_KEY = ("branch", "host", "compiler", "c_version", "mpi", "m_version", "o_g", "os")
REPORT_ORDER = ("branch", "host", "compiler", "c_version", "mpi", "m_version", "o_g")

# Archive columns.
ARCHIVE_COLUMNS = (
    "branch",
    "host",
    "compiler",
    "c_version",
    "mpi",
    "m_version",
    "o_g",
    "os",
    "u_pass",
    "u_fail",
    "s_pass",
    "s_fail",
    "e_pass",
    "e_fail",
    "nuopc_pass",
    "nuopc_fail",
    "build",
    "netcdf_c",
    "netcdf_f",
    "artifacts_hash",
    "branch_hash",
    "modified",
)

# Report columns.
REPORT_COLUMNS = (
    "branch",
    "host",
    "compiler",
    "mpi",
    "netcdf",
    "o_g",
    "os",
    "build",
    "u_pass",
    "u_fail",
    "s_pass",
    "s_fail",
    "e_pass",
    "e_fail",
    "nuopc_pass",
    "nuopc_fail",
    "artifacts_hash",
    "modified",
)

# Header of the space-aligned text report.
ALIGNED_HEADER = (
    "OS",
    "HOST",
    "compilier",
    "version",
    "mpi-type",
    "mpi-ver",
    "O/g",
    "unit-pass",
    "unit-fail",
    "sys-pass",
    "sys-fail",
    "ex-pass",
    "ex-fail",
    "nuopc-p",
    "nuopc-f",
)
