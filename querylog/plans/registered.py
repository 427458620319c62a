"""Every operator as a query over the fixture log, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylog.functions import answers, display, predicates
from querylog.operators import logs, ranking, snapshot, timeseries
from querylog.plans.fixture import FIXTURE_SQL, fixture_log
from querylog.schema import LOG_COLUMNS, TIME_RANGES
from querylog.sinks.tsv import tsv_lines
from querylog.sources.jsonl import parse_jsonl_lines
from querylog.sources.payloads import parse_payloads
from querylog.sources.tsv import parse_timestamp, parse_tsv_lines, tsv_rejects
from querylog.streaming.counts import top_per_bucket, windowed_counts, windowed_names

#: Moments the ranges look back from: inside the data, and on a day boundary.
AS_OF = datetime(2024, 1, 30, 23, 17)
MIDNIGHT = datetime(2024, 1, 31)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str, *extra: str, name: str | None = None):
    """Register a query under ``name``, by default its function's. ``oracle`` is a
    SELECT over ``log``, ``extra`` are further entries of its WITH list."""

    def keep(query):
        key = name or query.__name__
        QUERIES[key] = query
        ORACLES[key] = "WITH " + ",\n".join((FIXTURE_SQL, *extra)) + "\n" + oracle
        return query

    return keep


def _log(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The fixture log with the columns that a query needs, or all."""
    return fixture_log(spark, sf_dir, columns or LOG_COLUMNS)


_DOMAIN = ("request_ts", "response_type", "question_name")
_CLIENT = ("request_ts", "response_type", "client_name")
_COUNTED = ("request_ts", "response_type")


def _wall(column: str):
    return F.col(column).cast("timestamp_ntz").alias(column)


# --- SQL building blocks -----------------------------------------------------

_SPANS = {"1h": "1 HOUR", "24h": "24 HOUR", "7d": "7 DAY", "30d": "30 DAY"}
_WIDTHS = {"1h": 300, "24h": 3600, "7d": 21600, "30d": 86400}
_BLOCKED = "CAST(count(*) FILTER (WHERE response_type = 'BLOCKED') AS BIGINT)"
_CACHED = "CAST(count(*) FILTER (WHERE response_type = 'CACHED') AS BIGINT)"
_ALL = ", ".join(LOG_COLUMNS)


def _start(range: str, as_of: datetime = AS_OF) -> str:
    return f"TIMESTAMP '{as_of}' - INTERVAL {_SPANS[range]}"


def _grouped_sql(column: str, range: str, blocked: bool = False) -> tuple[str, str]:
    only = " AND response_type = 'BLOCKED'" if blocked else ""
    return (
        f"""g AS (SELECT coalesce({column}, 'unknown') AS name, count(*) AS n, {_BLOCKED} AS b
FROM log WHERE request_ts >= {_start(range)}{only} GROUP BY 1)""",
        """t AS (SELECT count(*) AS total_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_queries,
CAST(coalesce(sum(b), 0) AS BIGINT) AS total_blocked FROM g)""",
    )


def _ranked_sql(name: str, count: str, limit: int, offset: int = 0) -> str:
    return f"""SELECT name AS {name}, n AS {count}, b AS blocked,
CAST(n AS DOUBLE) / CAST(total_queries AS DOUBLE) * 100 AS percentage
FROM g CROSS JOIN t ORDER BY n DESC, lower(name), name LIMIT {limit} OFFSET {offset}"""


def _page_sql(where: str = "true", limit: int = 50, offset: int = 0) -> str:
    return f"""SELECT {_ALL} FROM log WHERE {where}
ORDER BY request_ts DESC NULLS LAST, question_name ASC NULLS FIRST, id ASC NULLS FIRST
LIMIT {limit} OFFSET {offset}"""


def _search_sql(column: str, name: str, text: str, range: str, limit: int) -> str:
    return f"""SELECT {column} AS {name}, count(*) AS count FROM log
WHERE request_ts >= {_start(range)} AND contains(lower({column}), lower('{text}'))
GROUP BY 1 ORDER BY count(*) DESC, lower({column}), {column} LIMIT {limit}"""


def _series_sql(
    range: str, as_of: datetime = AS_OF, anchored: bool = False, where: str = "true"
) -> tuple[str, str]:
    """WITH entry ``s`` for the series, and the SELECT that returns it."""
    width = _WIDTHS[range] * 1_000_000
    start, now = f"epoch_us({_start(range, as_of)})", f"epoch_us(TIMESTAMP '{as_of}')"
    origin = start if anchored else f"{start} // {width} * {width}"
    n = f"({now} - {start}) // {width}" if anchored else f"({now} - {origin}) // {width} + 1"
    entry = f"""s AS (SELECT make_timestamp({origin} + slot * {width}) AS bucket_start,
coalesce(total, 0) AS total, coalesce(blocked, 0) AS blocked, coalesce(cached, 0) AS cached
FROM (SELECT unnest(range(0, {n})) AS slot) spine
LEFT JOIN (SELECT (epoch_us(request_ts) - {origin}) // {width} AS slot, count(*) AS total,
{_BLOCKED} AS blocked, {_CACHED} AS cached
FROM log WHERE request_ts >= {_start(range, as_of)} AND {where} GROUP BY 1) c USING (slot))"""
    return "SELECT * FROM s ORDER BY bucket_start", entry


# --- Rows, filters, parsers --------------------------------------------------


@register(f"SELECT {_ALL} FROM log")
def log_entries(spark, sf_dir):
    return _log(spark, sf_dir)


@register(f"SELECT id, request_ts FROM log WHERE request_ts >= {_start('7d')}")
def filter_time_range(spark, sf_dir):
    log = _log(spark, sf_dir, "id", "request_ts")
    return log.where(predicates.in_range(log, "7d", AS_OF))


def _raw_lines(spark, sf_dir) -> DataFrame:
    """Log lines of mixed quality: a unit after cached durations, an extra field
    where the duration is missing, a field short where the domain is missing."""
    log = _log(spark, sf_dir)
    unit = F.when(F.col("response_type") == "CACHED", "ms").otherwise("")
    dirty = log.withColumn("duration_ms", F.concat(F.col("duration_ms").cast("string"), unit))
    line = F.col("line")
    broken = (
        F.when(F.split(line, "\t")[5] == "", F.substring_index(line, "\t", 10))
        .when(F.split(line, "\t")[3] == "", F.concat(line, F.lit("\textra")))
        .otherwise(line)
    )
    # A generator keeps what is asked of the lines from being pushed below their making.
    whole = tsv_lines(dirty).select(F.explode(F.array("line")).alias("line"))
    return whole.select(F.explode(F.array(broken)).alias("value"))


@register(
    """SELECT CAST(NULL AS BIGINT) AS id, request_ts, client_ip, client_name, duration_ms, reason,
response_type, question_type, question_name, effective_tldp, nullif(answer, '') AS answer,
response_code, hostname FROM log WHERE question_name IS NOT NULL""",
    name="parse_tsv_lines",
)
def parsed_lines(spark, sf_dir):
    rows = parse_tsv_lines(_raw_lines(spark, sf_dir))
    return rows.withColumn("request_ts", F.col("request_ts").cast("timestamp_ntz"))


@register(
    """SELECT concat_ws(chr(9), strftime(request_ts, '%Y-%m-%d %H:%M:%S.%f'), client_ip,
coalesce(client_name, ''), coalesce(CAST(duration_ms AS VARCHAR)
|| CASE WHEN response_type = 'CACHED' THEN 'ms' ELSE '' END, ''), reason, '', answer,
response_code, response_type, question_type) AS line, CAST(10 AS INTEGER) AS n_fields
FROM log WHERE question_name IS NULL""",
    name="tsv_rejects",
)
def rejected_lines(spark, sf_dir):
    return tsv_rejects(_raw_lines(spark, sf_dir))


@register(
    """SELECT strftime(request_ts, '%Y-%m-%d') AS log_date,
regexp_replace(coalesce(client_name, ''), '[^a-zA-Z0-9_-]', '_', 'g') AS client_key,
concat_ws(chr(9), strftime(request_ts, '%Y-%m-%d %H:%M:%S.%f'), client_ip, coalesce(client_name, ''),
coalesce(CAST(duration_ms AS VARCHAR), ''), reason, coalesce(question_name, ''), answer,
response_code, response_type, question_type, hostname) AS line FROM log"""
)
def tsv_export_lines(spark, sf_dir):
    lines = tsv_lines(_log(spark, sf_dir), per_client=True)
    return lines.select(F.col("log_date").cast("string").alias("log_date"), "client_key", "line")


@register(
    """SELECT CAST(NULL AS BIGINT) AS id, request_ts, client_ip, client_name, duration_ms, reason,
response_type, question_type, question_name, effective_tldp, nullif(answer, '') AS answer,
response_code, CAST(NULL AS VARCHAR) AS hostname FROM log WHERE question_name IS NOT NULL"""
)
def parse_jsonl_logs(spark, sf_dir):
    # Records without a domain stand for the store's operational messages.
    log = _log(spark, sf_dir)
    record = F.struct(
        F.date_format("request_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("_time"),
        F.lit("seed").alias("_msg"),
        F.when(F.col("question_name").isNull(), "startup").otherwise("queryLog").alias("prefix"),
        "client_ip",
        F.coalesce("client_name", F.lit("")).alias("client_names"),
        F.coalesce(F.col("duration_ms").cast("string"), F.lit("")).alias("duration_ms"),
        F.col("reason").alias("response_reason"),
        "question_name",
        "answer",
        "response_code",
        "response_type",
        "question_type",
    )
    rows = parse_jsonl_lines(log.select(F.to_json(record).alias("value")))
    return rows.withColumn("request_ts", F.col("request_ts").cast("timestamp_ntz"))


# --- Log pages ---------------------------------------------------------------


@register(_page_sql(limit=50))
def query_logs_page(spark, sf_dir):
    return logs.query_logs(_log(spark, sf_dir)).items


@register(_page_sql(limit=100, offset=5000))
def query_logs_deep_page(spark, sf_dir):
    return logs.query_logs(_log(spark, sf_dir), limit=100, offset=5000).items


@register("SELECT count(*) AS total_count FROM log")
def query_logs_count(spark, sf_dir):
    return logs.count_logs(_log(spark, sf_dir, "id"))


@register(_page_sql("response_type = 'BLOCKED'", 100))
def query_logs_by_response_type(spark, sf_dir):
    return logs.query_logs(_log(spark, sf_dir), limit=100, response_type="BLOCKED").items


@register(_page_sql("question_type = 'AAAA'", 100, 100))
def query_logs_by_question_type(spark, sf_dir):
    return logs.query_logs(_log(spark, sf_dir), limit=100, offset=100, question_type="AAAA").items


@register(_page_sql("contains(lower(question_name), 'tion')", 100))
def query_logs_search_domain(spark, sf_dir):
    return logs.query_logs(_log(spark, sf_dir), limit=100, search="TION").items


@register(_page_sql("contains(lower(client_name), 'customer#00000001')", 100))
def query_logs_search_client(spark, sf_dir):
    return logs.query_logs(_log(spark, sf_dir), limit=100, client="customer#00000001").items


@register(
    _page_sql(
        """response_type = 'BLOCKED' AND question_type = 'A' AND contains(lower(question_name), 'th')
AND contains(lower(client_name), 'customer')""",
        100,
    )
)
def query_logs_combined(spark, sf_dir):
    page = logs.query_logs(
        _log(spark, sf_dir),
        limit=100,
        search="th",
        client="Customer",
        response_type="BLOCKED",
        question_type="A",
    )
    return page.items


# --- Totals ------------------------------------------------------------------


@register(
    f"""SELECT count(*) AS total_queries, {_BLOCKED} AS blocked FROM log
WHERE request_ts >= {_start('24h')}"""
)
def stats_24h(spark, sf_dir):
    return snapshot.stats_24h(_log(spark, sf_dir, *_COUNTED), AS_OF)


@register(
    """SELECT *, CAST(blocked AS DOUBLE) / CAST(total_queries AS DOUBLE) * 100 AS blocked_percentage,
CAST(cached AS DOUBLE) / CAST(cached + forwarded AS DOUBLE) * 100 AS cache_hit_rate FROM o""",
    f"""o AS (SELECT count(*) AS total_queries, {_BLOCKED} AS blocked, {_CACHED} AS cached,
CAST(count(*) FILTER (WHERE response_type = 'RESOLVED') AS BIGINT) AS forwarded,
avg(duration_ms) AS avg_response_ms FROM log WHERE request_ts >= {_start('24h')})""",
)
def overview_24h(spark, sf_dir):
    return snapshot.overview_24h(_log(spark, sf_dir, *_COUNTED, "duration_ms"), AS_OF)


# --- Ranked lists ------------------------------------------------------------


@register(_ranked_sql("domain", "count", 10), *_grouped_sql("question_name", "30d"))
def top_domains(spark, sf_dir):
    return ranking.top_domains(_log(spark, sf_dir, *_DOMAIN), "30d", as_of=AS_OF).items


@register(_ranked_sql("domain", "count", 20, 10), *_grouped_sql("question_name", "30d", True))
def top_domains_blocked(spark, sf_dir):
    log = _log(spark, sf_dir, *_DOMAIN)
    return ranking.top_domains(
        log, "30d", limit=20, offset=10, filter="blocked", as_of=AS_OF
    ).items


@register("SELECT * FROM t", *_grouped_sql("question_name", "30d"))
def top_domains_past_end(spark, sf_dir):
    log = _log(spark, sf_dir, *_DOMAIN)
    return ranking.top_domains(log, "30d", limit=100, offset=100_000, as_of=AS_OF).totals


@register(_ranked_sql("client", "total", 10), *_grouped_sql("client_name", "30d"))
def top_clients(spark, sf_dir):
    return ranking.top_clients(_log(spark, sf_dir, *_CLIENT), "30d", as_of=AS_OF).items


@register(_ranked_sql("client", "total", 10, 100), *_grouped_sql("client_name", "30d"))
def top_clients_deep_page(spark, sf_dir):
    log = _log(spark, sf_dir, *_CLIENT)
    return ranking.top_clients(log, "30d", offset=100, as_of=AS_OF).items


@register(
    "SELECT t.*, name, n, b, CAST(n AS DOUBLE) / CAST(total_queries AS DOUBLE) * 100 AS percentage "
    "FROM t LEFT JOIN (SELECT * FROM g ORDER BY n DESC, lower(name), name LIMIT 10) ON true",
    *_grouped_sql("question_name", "30d"),
)
def top_domains_with_totals(spark, sf_dir):
    rows = ranking.top_list_rows(_log(spark, sf_dir, *_DOMAIN), "domains", "30d", as_of=AS_OF)
    return rows.withColumnsRenamed({"count": "n", "blocked": "b"})


@register(_ranked_sql("client", "total", 10, 5), *_grouped_sql("client_name", "30d", True))
def top_clients_blocked(spark, sf_dir):
    log = _log(spark, sf_dir, *_CLIENT)
    return ranking.top_clients(log, "30d", offset=5, filter="blocked", as_of=AS_OF).items


@register(
    "SELECT 'domains' AS kind, * FROM t UNION ALL SELECT 'clients', * FROM ct",
    *_grouped_sql("question_name", "30d"),
    f"""cg AS (SELECT coalesce(client_name, 'unknown') AS name, count(*) AS n, {_BLOCKED} AS b
FROM log WHERE request_ts >= {_start('30d')} GROUP BY 1)""",
    """ct AS (SELECT count(*), CAST(coalesce(sum(n), 0) AS BIGINT),
CAST(coalesce(sum(b), 0) AS BIGINT) FROM cg)""",
)
def grouped_totals(spark, sf_dir):
    domains = ranking.top_list(_log(spark, sf_dir, *_DOMAIN), "domains", "30d", as_of=AS_OF)
    clients = ranking.top_list(_log(spark, sf_dir, *_CLIENT), "clients", "30d", as_of=AS_OF)
    return domains.totals.select(F.lit("domains").alias("kind"), "*").unionByName(
        clients.totals.select(F.lit("clients").alias("kind"), "*")
    )


@register(_ranked_sql("name", "count", 25), *_grouped_sql("client_name", "7d"))
def top_list_named(spark, sf_dir):
    log = _log(spark, sf_dir, *_CLIENT)
    return ranking.top_list(log, "clients", "7d", limit=25, as_of=AS_OF).items


@register(
    """SELECT *, width * (1 - blocked_percentage / 100) AS allowed_width,
width * (blocked_percentage / 100) AS blocked_width
FROM (SELECT *, CAST(count AS DOUBLE) / CAST(max(count) OVER () AS DOUBLE) * 100 AS width,
CAST(blocked AS DOUBLE) / CAST(count AS DOUBLE) * 100 AS blocked_percentage FROM p)""",
    *_grouped_sql("question_name", "30d"),
    f"p AS ({_ranked_sql('name', 'count', 10)})",
)
def top_list_shares(spark, sf_dir):
    log = _log(spark, sf_dir, *_DOMAIN)
    return ranking.list_shares(ranking.top_list(log, "domains", "30d", as_of=AS_OF).items)


@register(
    """SELECT total_count, CAST(ceil(total_count / 10) AS BIGINT) AS total_pages,
CAST(21 AS BIGINT) AS first_row, least(CAST(30 AS BIGINT), total_count) AS last_row FROM t""",
    *_grouped_sql("client_name", "30d"),
)
def page_info(spark, sf_dir):
    page = ranking.top_list(
        _log(spark, sf_dir, *_CLIENT), "clients", "30d", limit=10, offset=20, as_of=AS_OF
    )
    return ranking.page_info(page.totals, limit=10, offset=20)


@register(
    """SELECT name AS type, n AS count,
CAST(n AS DOUBLE) / CAST(total_queries AS DOUBLE) * 100 AS percentage FROM g CROSS JOIN t""",
    *_grouped_sql("question_type", "30d"),
)
def query_types_breakdown(spark, sf_dir):
    log = _log(spark, sf_dir, "request_ts", "question_type")
    return ranking.query_types_breakdown(log, "30d", AS_OF)


@register(_search_sql("question_name", "domain", "EXAMPLE.net", "30d", 10))
def search_domains(spark, sf_dir):
    log = _log(spark, sf_dir, *_DOMAIN)
    return ranking.search_domains(log, "30d", "EXAMPLE.net", as_of=AS_OF)


@register(_search_sql("client_name", "client", "#0000000", "30d", 50))
def search_clients(spark, sf_dir):
    log = _log(spark, sf_dir, *_CLIENT)
    return ranking.search_clients(log, "30d", "#0000000", limit=50, as_of=AS_OF)


@register("SELECT question_name AS domain, count(*) AS count FROM log WHERE false GROUP BY 1")
def search_domains_blank(spark, sf_dir):
    """A blank search finds nothing, whatever the log holds."""
    return ranking.search_domains(_log(spark, sf_dir, *_DOMAIN), "30d", "  ", as_of=AS_OF)


@register(
    f"""SELECT kind, domain, count FROM (
(SELECT '.' AS kind, question_name AS domain, count(*) AS count FROM log
WHERE request_ts >= {_start('30d')} AND strpos(lower(question_name), 'e.e') > 0 GROUP BY 2
ORDER BY 3 DESC, lower(question_name), question_name LIMIT 50)
UNION ALL SELECT '%', question_name, count(*) FROM log
WHERE request_ts >= {_start('30d')} AND strpos(question_name, '%') > 0 GROUP BY 2
UNION ALL SELECT '_', question_name, count(*) FROM log
WHERE request_ts >= {_start('30d')} AND strpos(question_name, '_') > 0 GROUP BY 2)"""
)
def search_domains_literal(spark, sf_dir):
    """Dots, percent signs and underscores stand for themselves."""
    log, found = _log(spark, sf_dir, *_DOMAIN), None
    for kind, text in ((".", "e.e"), ("%", "%"), ("_", "_")):
        hits = ranking.search_domains(log, "30d", text, limit=50, as_of=AS_OF).select(F.lit(kind).alias("kind"), "domain", "count")
        found = hits if found is None else found.unionByName(hits)
    return found


@register("SELECT id, request_ts, request_ts AS from_offset, request_ts AS from_zoneless, CAST(NULL AS TIMESTAMP) AS from_time FROM log")
def iso_instants(spark, sf_dir):
    """Times of the log as texts with an offset, without a zone, and without a date, read back."""
    log = _log(spark, sf_dir, "id", "request_ts")
    text = F.date_format("request_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    offset = F.date_format(F.col("request_ts") + F.expr("INTERVAL '5' HOUR"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+05:00'")
    forms = {"request_ts": F.concat(text, F.lit("Z")), "from_offset": offset, "from_zoneless": text, "from_time": F.date_format("request_ts", "HH:mm:ss")}
    return log.select("id", *(parse_timestamp(form).cast("timestamp_ntz").alias(name) for name, form in forms.items()))


@register(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{name}' AS name, CAST({width} AS BIGINT) AS seconds, CAST({n} AS BIGINT) AS buckets,
count(*) AS total FROM log WHERE request_ts >= {_start(name)}"""
        for (name, width), n in zip(_WIDTHS.items(), (12, 24, 28, 30))
    ) + ")"
)
def time_ranges(spark, sf_dir):
    """The offered ranges, their buckets, and the rows that the log has in each."""
    log, found = _log(spark, sf_dir, "request_ts"), None
    for name, span in TIME_RANGES.items():
        seconds = F.lit(int(span.interval.total_seconds())).cast("long").alias("seconds")
        row = log.where(predicates.in_range(log, name, AS_OF)).agg(F.count("*").alias("total"))
        row = row.select(F.lit(name).alias("name"), seconds, F.lit(span.buckets).cast("long").alias("buckets"), "total")
        found = row if found is None else found.unionByName(row)
    return found


def _top5_sql(column: str, label: str, kind: str, having: str = "", count: str = "count(*)") -> str:
    return f"""(SELECT '{kind}' AS {label}, coalesce({column}, 'unknown') AS name, {count} AS count
FROM log WHERE request_ts >= {_start('24h')} GROUP BY 2 {having}
ORDER BY 3 DESC, lower(name), name LIMIT 5)"""


@register(
    _top5_sql("question_name", "kind", "domain")
    + " UNION ALL "
    + _top5_sql("client_name", "kind", "client")
)
def suggestions_blank(spark, sf_dir):
    log = _log(spark, sf_dir, "request_ts", "question_name", "client_name")
    return ranking.suggestions(log, "", as_of=AS_OF)


@register(
    f"""SELECT 'domain' AS kind, domain AS name, count
FROM ({_search_sql('question_name', 'domain', 'er', '30d', 10)})
UNION ALL SELECT 'client', client, count
FROM ({_search_sql('client_name', 'client', 'er', '30d', 10)})"""
)
def suggestions_typed(spark, sf_dir):
    log = _log(spark, sf_dir, "request_ts", "question_name", "client_name")
    return ranking.suggestions(log, "er", range="30d", as_of=AS_OF)


@register(
    _top5_sql("question_name", "list", "domains")
    + " UNION ALL "
    + _top5_sql("question_name", "list", "blocked_domains", f"HAVING {_BLOCKED} > 0", _BLOCKED)
    + " UNION ALL "
    + _top5_sql("client_name", "list", "clients")
)
def snapshot_top_lists(spark, sf_dir):
    log = _log(spark, sf_dir, *_DOMAIN, "client_name")
    return snapshot.snapshot_top_lists(log, AS_OF)


# --- Series ------------------------------------------------------------------


def _series(spark, sf_dir, range, *columns, **options) -> DataFrame:
    log = _log(spark, sf_dir, *_COUNTED, *columns)
    options = {"as_of": AS_OF, **options}
    series = timeseries.queries_over_time(log, range, **options)
    return series.withColumn("bucket_start", _wall("bucket_start"))


@register(*_series_sql("1h"))
def queries_over_time_1h(spark, sf_dir):
    return _series(spark, sf_dir, "1h")


@register(*_series_sql("24h"))
def queries_over_time_24h(spark, sf_dir):
    return _series(spark, sf_dir, "24h")


@register(*_series_sql("7d", MIDNIGHT))
def queries_over_time_7d(spark, sf_dir):
    return _series(spark, sf_dir, "7d", as_of=MIDNIGHT)


@register(*_series_sql("30d"))
def queries_over_time_30d(spark, sf_dir):
    return _series(spark, sf_dir, "30d")


@register(*_series_sql("24h", anchored=True))
def queries_over_time_anchored_24h(spark, sf_dir):
    return _series(spark, sf_dir, "24h", mode="anchored")


@register(*_series_sql("30d", anchored=True))
def queries_over_time_anchored_30d(spark, sf_dir):
    return _series(spark, sf_dir, "30d", mode="anchored")


@register(*_series_sql("30d", where="contains(lower(question_name), 'tion')"))
def queries_over_time_domain(spark, sf_dir):
    return _series(spark, sf_dir, "30d", "question_name", domain="Tion")


@register(*_series_sql("30d", where="contains(lower(client_name), 'customer#00000001')"))
def queries_over_time_client(spark, sf_dir):
    return _series(spark, sf_dir, "30d", "client_name", client="customer#00000001")


_SERIES_7D = _series_sql("7d")[1]


@register("SELECT *, strftime(bucket_start, '%Y-%m-%d %H:%M') AS label FROM s", _SERIES_7D)
def bucket_labels(spark, sf_dir):
    log = _log(spark, sf_dir, *_COUNTED)
    series = timeseries.queries_over_time(log, "7d", as_of=AS_OF)
    labelled = timeseries.with_bucket_labels(series, "7d")
    return labelled.withColumn("bucket_start", _wall("bucket_start"))


@register(
    f"""SELECT make_timestamp(epoch_us(request_ts) // 3600000000 * 3600000000) AS bucket_start,
count(*) AS total, {_BLOCKED} AS blocked, {_CACHED} AS cached FROM log GROUP BY 1"""
)
def windowed_counts_hourly(spark, sf_dir):
    counts = windowed_counts(_log(spark, sf_dir, *_COUNTED), "24h")
    return counts.withColumn("bucket_start", _wall("bucket_start"))


@register(
    "SELECT * FROM w WHERE position <= 5",
    f"""w AS (SELECT *, CAST(row_number() OVER (PARTITION BY bucket_start
ORDER BY count DESC, lower(name), name) AS INTEGER) AS position FROM (
SELECT make_timestamp(epoch_us(request_ts) // 86400000000 * 86400000000) AS bucket_start,
coalesce(question_name, 'unknown') AS name, count(*) AS count, {_BLOCKED} AS blocked
FROM log GROUP BY 1, 2))""",
)
def windowed_top_domains_daily(spark, sf_dir):
    names = windowed_names(_log(spark, sf_dir, *_DOMAIN), "domains", "30d")
    return top_per_bucket(names, 5).withColumn("bucket_start", _wall("bucket_start"))


# --- Row functions -----------------------------------------------------------


@register(
    r"""SELECT id, CAST(i AS INTEGER) AS position, records[i] AS record
FROM (SELECT id, records, unnest(range(1, len(records) + 1)) AS i FROM (
SELECT id, CASE WHEN answer = '' THEN [] WHEN regexp_matches(answer, '^[A-Z0-9]+\s+\(')
THEN regexp_extract_all(answer, '[A-Z0-9]+\s+\(([^)]*)\)', 1) ELSE [answer] END AS records
FROM log))"""
)
def parse_answers(spark, sf_dir):
    log = _log(spark, sf_dir, "id", "answer")
    found = log.select("id", F.posexplode(answers.parse_answers(F.col("answer"))))
    return found.select("id", (F.col("pos") + 1).alias("position"), F.col("col").alias("record"))


_GROUP_SQL = r"""CASE WHEN regexp_extract(reason, '(?i)^BLOCKED(?: [^(]+)? \((.+?): .*\)$', 1) <> ''
THEN regexp_extract(reason, '(?i)^BLOCKED(?: [^(]+)? \((.+?): .*\)$', 1) END"""
_DETAIL_SQL = f"""CASE WHEN upper(response_type) = 'BLOCKED' THEN {_GROUP_SQL}
WHEN upper(reason) <> upper(response_type) THEN reason END"""


@register(f"SELECT id, reason, {_GROUP_SQL} AS blocking_group FROM log")
def blocking_group(spark, sf_dir):
    log = _log(spark, sf_dir, "id", "reason")
    return log.select("id", "reason", answers.blocking_group(F.col("reason")).alias("blocking_group"))


@register(f"SELECT id, {_DETAIL_SQL} AS detail FROM log")
def result_detail(spark, sf_dir):
    log = _log(spark, sf_dir, "id", "response_type", "reason")
    detail = answers.result_detail(F.col("response_type"), F.col("reason"))
    return log.select("id", detail.alias("detail"))


@register(
    rf"""SELECT id, response_type, response_code AS return_code,
CASE WHEN regexp_matches(answer, '^[A-Z0-9]+\s+\(') THEN
array_to_string(regexp_extract_all(answer, '[A-Z0-9]+\s+\(([^)]*)\)', 1), ' | ')
ELSE answer END AS answers, {_DETAIL_SQL} AS detail FROM log"""
)
def query_results(spark, sf_dir):
    log = _log(spark, sf_dir, "id", "response_type", "response_code", "answer", "reason")
    results = answers.query_results(log, keep=("id",))
    return results.withColumn("answers", F.array_join("answers", " | "))


@register(
    r"""SELECT id, trim(regexp_replace(reason, '\(.*?\)', '')) AS reason_text,
CASE WHEN contains(reason, '(') THEN CASE response_type WHEN 'RESOLVED' THEN 'Resolved by: '
WHEN 'BLOCKED' THEN 'Group: ' ELSE '' END || regexp_extract(reason, '\((.*?)\)', 1) END AS reason_note
FROM log"""
)
def reason_parts(spark, sf_dir):
    log = _log(spark, sf_dir, "id", "reason", "response_type")
    return log.select(
        "id",
        display.reason_text(F.col("reason")).alias("reason_text"),
        display.reason_note(F.col("reason"), F.col("response_type")).alias("reason_note"),
    )


@register(
    """SELECT id, CASE WHEN duration_ms = 0 AND response_type IN ('CACHED', 'HOSTSFILE', 'CUSTOMDNS',
'BLOCKED', 'SPECIAL', 'FILTERED', 'NOTFQDN') THEN '—'
ELSE CAST(duration_ms AS VARCHAR) || 'ms' END AS duration FROM log"""
)
def duration_label(spark, sf_dir):
    log = _log(spark, sf_dir, "id", "duration_ms", "response_type")
    label = display.duration_label(F.col("duration_ms"), F.col("response_type"))
    return log.select("id", label.alias("duration"))


@register(
    """SELECT client_ip, n, CASE WHEN n >= 1000000
THEN format('{:,}', (n + 50000) // 100000 // 10) || '.' || ((n + 50000) // 100000 % 10) || 'M'
WHEN n >= 1000 THEN format('{:,}', (n + 50) // 100 // 10) || '.' || ((n + 50) // 100 % 10) || 'K'
ELSE CAST(n AS VARCHAR) END AS compact, CASE WHEN n >= 1000
THEN ((n + 50) // 100 // 10) || '.' || ((n + 50) // 100 % 10) || 'K'
ELSE CAST(n AS VARCHAR) END AS short FROM c""",
    # Squared totals spread over all three tiers.
    """c AS (SELECT client_ip, CAST(count(*) * sum(duration_ms) AS BIGINT) AS n
FROM log GROUP BY 1)""",
)
def compact_counts(spark, sf_dir):
    log = _log(spark, sf_dir, "client_ip", "duration_ms")
    n = F.count("*") * F.sum("duration_ms")
    return (
        log.groupBy("client_ip")
        .agg(n.alias("n"))
        .select(
            "*",
            display.compact_count(F.col("n")).alias("compact"),
            display.short_count(F.col("n")).alias("short"),
        )
    )


# --- Statistics payloads -----------------------------------------------------

_TYPES = ("A", "AAAA", "CNAME", "MX", "TXT")


def _payloads(spark, sf_dir) -> DataFrame:
    """One payload per day and client, as a resolver would report it.

    Days on which a client hit no cache lack the cache section: malformed.
    """
    log = _log(
        spark, sf_dir, "request_ts", "client_ip", "duration_ms", "reason", *_COUNTED, "question_type"
    )
    response, reason = F.col("response_type"), F.col("reason")
    day = F.date_format("request_ts", "yyyy-MM-dd").alias("day")
    figures = log.groupBy(day, "client_ip").agg(
        F.count("*").alias("n"),
        F.count_if(response == "BLOCKED").alias("blocked"),
        F.count_if(response == "CACHED").alias("cached"),
        F.count_if(reason.contains("ads")).alias("ads"),
        F.count_if(reason.contains("tracking")).alias("tracking"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("ms"),
        *(F.count_if(F.col("question_type") == t).alias(t) for t in _TYPES),
    )
    entry = [F.struct(F.lit(t).alias("name"), F.col(t).alias("count")) for t in _TYPES]
    total = F.struct(F.lit("all").alias("name"), F.col("n").alias("count"))
    by_count = F.array_sort(
        F.array(*entry, total),
        lambda a, b: F.when(a["count"] != b["count"], (b["count"] - a["count"]).cast("int"))
        .when(a["name"] < b["name"], -1)
        .otherwise(1),
    )
    document = F.struct(
        F.struct(
            F.col("n").alias("queries"),
            "blocked",
            F.lit(200.5).alias("dropped"),
            F.lit(7.0).alias("errors"),
            F.col("ms").alias("avgResponseMs"),
            (F.col("cached") / F.col("n")).alias("cacheHitRate"),
        ).alias("summary"),
        by_count.alias("topDomains"),
        F.filter(by_count, lambda x: x["count"] > 1).alias("topBlockedDomains"),
        F.array(F.struct(F.col("client_ip").alias("name"), F.col("n").alias("count"))).alias(
            "topClients"
        ),
        F.struct(
            F.create_map(F.lit("ads"), "ads", F.lit("tracking"), "tracking").alias("denylist"),
            F.create_map(F.lit("default"), "cached").alias("allowlist"),
        ).alias("lists"),
        F.when(F.col("cached") > 0, F.struct(F.col("cached").alias("entries"))).alias("cache"),
        F.lit("ignored").alias("start"),
    )
    return parse_payloads(figures.select("day", "client_ip", F.to_json(document).alias("value")))


_FIGURES_SQL = f"""f AS (SELECT strftime(request_ts, '%Y-%m-%d') AS day, client_ip, count(*) AS n,
{_BLOCKED} AS blocked, {_CACHED} AS cached, coalesce(avg(duration_ms), 0) AS ms,
CAST(count(*) FILTER (WHERE contains(reason, 'ads')) AS BIGINT) AS ads,
CAST(count(*) FILTER (WHERE contains(reason, 'tracking')) AS BIGINT) AS tracking,
{", ".join(f"CAST(count(*) FILTER (WHERE question_type = '{t}') AS BIGINT) AS q_{t}" for t in _TYPES)}
FROM log GROUP BY 1, 2)"""


@register(
    """SELECT day, client_ip, CASE WHEN ok THEN CAST(n AS DOUBLE) END AS total_queries,
CASE WHEN ok THEN CAST(blocked AS DOUBLE) END AS blocked, CASE WHEN ok THEN CAST(200.5 AS DOUBLE) END AS dropped,
CASE WHEN ok THEN CAST(7 AS DOUBLE) END AS errors,
CASE WHEN ok THEN CAST(blocked AS DOUBLE) / CAST(n AS DOUBLE) * 100 END AS blocked_percentage,
CASE WHEN ok THEN CAST(cached AS DOUBLE) / CAST(n AS DOUBLE) * 100 END AS cache_hit_rate,
CASE WHEN ok THEN CAST(ads + tracking AS DOUBLE) END AS listed_domains,
CASE WHEN ok THEN ms END AS avg_response_ms, CASE WHEN ok THEN CAST(cached AS DOUBLE) END AS cache_entries,
CASE WHEN ok THEN CAST(2 AS INTEGER) END AS denylist_groups,
CASE WHEN ok THEN CAST(cached AS DOUBLE) END AS allowlist_domains FROM (SELECT *, cached > 0 AS ok FROM f)""",
    _FIGURES_SQL,
)
def statistics_snapshot(spark, sf_dir):
    return snapshot.snapshot_overview(_payloads(spark, sf_dir))


@register(
    """SELECT day, client_ip, list, CAST(row_number() OVER (
PARTITION BY day, client_ip, list ORDER BY count DESC, name) AS INTEGER) AS position, name,
CAST(count AS DOUBLE) AS count FROM e""",
    _FIGURES_SQL,
    "e AS ("
    + " UNION ALL ".join(
        f"SELECT day, client_ip, '{kind}' AS list, '{name}' AS name, {count} AS count "
        f"FROM f WHERE cached > 0{more}"
        for kind, limit in (("domains", None), ("blocked_domains", 1))
        for name, count in (*((t, f"q_{t}") for t in _TYPES), ("all", "n"))
        for more in ("" if limit is None else f" AND {count} > 1",)
    )
    + " UNION ALL SELECT day, client_ip, 'clients', client_ip, n FROM f WHERE cached > 0)",
)
def payload_top_lists(spark, sf_dir):
    return snapshot.payload_top_lists(_payloads(spark, sf_dir))

