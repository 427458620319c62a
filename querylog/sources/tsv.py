"""Tab-separated query logs: one file per day, or one per day and client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from querylog.functions.answers import SPACES, trim_space
from querylog.schema import UTC_NAMES, to_log_schema

# Field order of a line, and the names of log files.
TSV_FIELDS = (
    "request_ts",
    "client_ip",
    "client_name",
    "duration_ms",
    "reason",
    "question_name",
    "answer",
    "response_code",
    "response_type",
    "question_type",
    "hostname",
)
LOG_FILES = "*.log"
CLIENT_LOG_FILES = "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]_?*.log"
_FILE_DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2})_[^/]+\.log$"
# The layout that the writer makes: a directory per date, one per client inside.
WRITTEN_FILES = "part-*"
_WRITTEN_DATE = r"/log_date=([0-9]{4}-[0-9]{2}-[0-9]{2})/"
_NON_SPACE = f"[^{SPACES}]"
_ZONED = r"(?:[A-Za-z]|\d[+-]\d{1,2}(?::?\d{2})?)\s*$"
_MINUTES = r"[ T]\d{1,2}:\d{1,2}\s*$"


def _body(text: Column, strict_trim: bool) -> Column:
    if strict_trim:
        return trim_space(text)
    # Text files come without line ends; trimming characters visits whole lines.
    ended = F.endswith(text, F.lit("\r")) | F.endswith(text, F.lit("\n"))
    return F.when(ended, F.rtrim(text, F.lit("\r\n"))).otherwise(text)


def _filled(text: Column) -> Column:
    return F.rlike(text, F.lit(_NON_SPACE))


def _split(body: Column) -> Column:
    return F.split(body, "\t", -1)


def parse_timestamp(text: Column, time_zone: str = "UTC") -> Column:
    """A timestamp with its own zone or offset, else one in ``time_zone``.

    Unreadable text gives null.
    """
    form = text
    session_zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
    if session_zone != time_zone and not UTC_NAMES.issuperset((session_zone, time_zone)):
        # Told apart first: an attempt that fails costs far more than a match.
        zone = f" {time_zone}"
        form = (
            F.when(F.length(F.trim(text)) <= 10, F.concat(text, F.lit(" 00:00:00" + zone)))
            .when(F.rlike(text, F.lit(_ZONED)), text)
            .when(F.rlike(text, F.lit(_MINUTES)), F.concat(text, F.lit(":00" + zone)))
            .otherwise(F.concat(text, F.lit(zone)))
        )
    # A bare time of day would be read as today's.
    dated = F.substring(F.ltrim(text), 5, 1) == "-"
    return F.when(dated, form.try_cast("timestamp"))


def parse_integer_prefix(text: Column) -> Column:
    """Leading integer of a text, as ``12ms`` to 12; null where there is none."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("long")


def parse_tsv_lines(
    lines: DataFrame,
    line: str = "value",
    strict_trim: bool = False,
    time_zone: str = "UTC",
    observation: Observation | None = None,
) -> DataFrame:
    """Log rows of the well-formed lines. Fields past the eleventh are ignored.

    Only line ends are stripped, so a line may begin or end with empty fields.
    ``strict_trim`` strips all outer whitespace first, tabs included; a line
    ending in an empty field then comes out one field short.

    ``observation`` counts in the same pass: ``lines`` that are not blank, ``rejects``
    among them, and the rejects by their fields (``fields_1`` to ``fields_10``). It
    holds them once the first action on the rows is done.
    """
    body = _body(F.col(line), strict_trim)
    # Catalyst does not push filters through a generator: lines are split once.
    rows = lines.where(_filled(F.col(line)))
    rows = rows.select(F.explode(F.array(_split(body))).alias("fields"))
    if observation is not None:
        n = F.size("fields")
        by_size = (F.count_if(n == i).alias(f"fields_{i}") for i in range(1, len(TSV_FIELDS)))
        rejects = F.count_if(n < len(TSV_FIELDS)).alias("rejects")
        rows = rows.observe(observation, F.count("*").alias("lines"), rejects, *by_size)
    rows = rows.where(F.size("fields") >= len(TSV_FIELDS))
    field = {name: F.get("fields", F.lit(i)) for i, name in enumerate(TSV_FIELDS)}
    field["request_ts"] = parse_timestamp(field["request_ts"], time_zone)
    field["duration_ms"] = parse_integer_prefix(field["duration_ms"])
    missing = {name: F.lit(None) for name in ("id", "effective_tldp")}
    return to_log_schema(rows, **field, **missing)


def tsv_rejects(lines: DataFrame, line: str = "value", strict_trim: bool = False) -> DataFrame:
    """The malformed lines, ``line, n_fields``: not blank, and fewer than eleven
    fields."""
    body = _body(F.col(line), strict_trim)
    n_fields = F.size(_split(body))
    short = lines.where((n_fields < len(TSV_FIELDS)) & _filled(F.col(line)))
    return short.select(F.col(line).alias("line"), n_fields.alias("n_fields"))


def list_files(spark: SparkSession, directory: str, glob: str) -> DataFrame:
    """``path, modificationTime, length`` of matching files; contents stay unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    return files.select("path", "modificationTime", "length")


def newest_file(spark: SparkSession, directory: str, glob: str = LOG_FILES) -> str | None:
    """Path of the file modified last; None where no file matches."""
    files = list_files(spark, directory, glob)
    return files.agg(F.max_by("path", "modificationTime").alias("path")).first()["path"]


def latest_date(spark: SparkSession, directory: str, glob: str = CLIENT_LOG_FILES) -> str | None:
    """Latest date among file names ``YYYY-MM-DD_<client>.log``."""
    date = F.regexp_extract("path", _FILE_DATE, 1)
    return list_files(spark, directory, glob).agg(F.max(date).alias("date")).first()["date"]


def is_written(spark: SparkSession, directory: str) -> bool:
    """Whether a directory has the layout of the writer, seen from its first level."""
    return _matches(spark, f"{directory.rstrip('/')}/log_date=*")


def has_both_layouts(spark: SparkSession, directory: str, glob: str) -> bool:
    """Whether log files lie beside what the writer wrote."""
    return is_written(spark, directory) and _matches(spark, f"{directory.rstrip('/')}/{glob}")


def _matches(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _written_lines(spark: SparkSession, directory: str, latest_only: bool) -> DataFrame:
    """Lines that the writer wrote; ``latest_only`` keeps the latest date's directory."""
    reader = spark.read.option("pathGlobFilter", WRITTEN_FILES).option("recursiveFileLookup", True)
    if latest_only:
        files = spark.read.format("binaryFile").option("pathGlobFilter", WRITTEN_FILES)
        dates = files.option("recursiveFileLookup", True).load(directory).select("path")
        latest = dates.agg(F.max(F.regexp_extract("path", _WRITTEN_DATE, 1)).alias("date")).first()
        if latest["date"]:
            directory = f"{directory.rstrip('/')}/log_date={latest['date']}"
    return reader.text(directory).select("value")


def read_tsv_lines(
    spark: SparkSession,
    directory: str,
    per_client: bool = False,
    latest_only: bool = False,
    glob: str | None = None,
) -> DataFrame:
    """Raw lines (``value``) of the log files in a directory.

    All files are read by default. ``latest_only`` keeps the file modified last,
    or with ``per_client`` all files of the latest date in the file names; only
    that one path or date passes through the driver. A missing directory raises.

    A directory that ``write_tsv`` wrote is recognised; ``latest_only`` then keeps its
    latest date. Log files beside what it wrote are read as well; which of the two is
    the latest cannot be told, so ``latest_only`` raises there. ``glob`` names other files
    and turns the recognition off.
    """
    own = glob or (CLIENT_LOG_FILES if per_client else LOG_FILES)
    if glob is None and is_written(spark, directory):
        written = _written_lines(spark, directory, latest_only)
        if not has_both_layouts(spark, directory, own):
            return written
        if latest_only:
            raise ValueError(f"{directory} holds log files beside written dates: name one of them by glob")
        beside = spark.read.text(f"{directory.rstrip('/')}/{own}").select("value")
        return written.unionByName(beside)
    glob = own
    reader = spark.read.option("pathGlobFilter", glob)
    if not latest_only:
        if has_both_layouts(spark, directory, glob):  # files beside partitions are not listed
            return spark.read.text(f"{directory.rstrip('/')}/{glob}").select("value")
        return reader.text(directory).select("value")
    if per_client:
        date = latest_date(spark, directory, glob)
        chosen = None if date is None else f"{directory.rstrip('/')}/{date}_*.log"
    else:
        chosen = newest_file(spark, directory, glob)
    if chosen is None:
        return reader.text(directory).select("value").where(F.lit(False))
    return spark.read.text(chosen).select("value")


def read_tsv(
    spark: SparkSession,
    directory: str,
    per_client: bool = False,
    latest_only: bool = False,
    glob: str | None = None,
    strict_trim: bool = False,
    time_zone: str = "UTC",
    observation: Observation | None = None,
) -> DataFrame:
    """Log rows of a directory of tab-separated files; see :func:`read_tsv_lines` and,
    for ``observation``, :func:`parse_tsv_lines`."""
    lines = read_tsv_lines(spark, directory, per_client, latest_only, glob)
    return parse_tsv_lines(lines, strict_trim=strict_trim, time_zone=time_zone, observation=observation)
