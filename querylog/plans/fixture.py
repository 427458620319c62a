"""A query log derived from the test tables ``events``, ``pages`` and ``customer``.

Each event is one DNS query: its page names the domain, its user the client.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylog.schema import LOG_COLUMNS

_HOST = r"^https?://([^/:?#]+)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(key: Column, cases: dict, default: Column) -> Column:
    chosen = F
    for value, result in cases.items():
        chosen = chosen.when(key == value, result)
    return chosen.otherwise(default)


def fixture_log(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] = LOG_COLUMNS
) -> DataFrame:
    """The derived log, or some of its ``columns``.

    ``pages`` and ``customer`` are joined on their primary keys and only for the
    names they give, so a query without domains does not read ``pages``. No side
    is hinted: Catalyst broadcasts a table only while its size allows, and AQE
    splits a user that holds many events.
    """
    event_id, event_type = F.col("event_id"), F.col("event_type")
    rows = _table(spark, sf_dir, "events")
    if "question_name" in columns:
        pages = _table(spark, sf_dir, "pages")
        n_pages = pages.agg(F.count("*")).scalar()
        rows = rows.withColumn("page_key", F.pmod(event_id, n_pages)).join(
            pages.select("page_id", F.regexp_extract("url", _HOST, 1).alias("host")),
            F.col("page_key") == F.col("page_id"),
            "left",
        )
    if "client_name" in columns:
        customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
        rows = rows.join(customer, F.col("user_id") == F.col("c_custkey"), "left")

    response_type = _choose(
        event_type,
        {
            "error": F.lit("BLOCKED"),
            "view": F.lit("RESOLVED"),
            "click": F.lit("CACHED"),
            "purchase": F.lit("CONDITIONAL"),
        },
        F.lit("CUSTOMDNS"),
    )
    block_reason = _choose(
        event_id % 4,
        {
            0: F.lit("BLOCKED (ads: *.example.com)"),
            1: F.lit("BLOCKED CNAME (tracking: t.example.net)"),
            2: F.lit("BLOCKED (malware)"),
        },
        F.lit("BLOCKED"),
    )
    user = F.col("user_id")
    made = {
        "id": event_id,
        "request_ts": F.col("ts"),
        "client_ip": F.concat(
            F.lit("10.0."),
            F.floor(user / 256).cast("string"),
            F.lit("."),
            (user % 256).cast("string"),
        ),
        "client_name": lambda: F.when(user % 13 != 0, F.col("c_name")),
        "duration_ms": F.when(event_id % 19 == 0, F.lit(None))
        .when(event_type.isin("click", "error") & (event_id % 3 == 0), F.lit(0))
        .otherwise(F.floor("value"))
        .cast("long"),
        "reason": _choose(
            event_type,
            {
                "error": block_reason,
                "view": F.lit("RESOLVED (dns.example)"),
                "click": F.lit("CACHED"),
                "purchase": F.lit("CONDITIONAL"),
            },
            F.lit("CUSTOMDNS"),
        ),
        "response_type": response_type,
        "question_type": _choose(
            event_id % 5,
            {0: F.lit("A"), 1: F.lit("AAAA"), 2: F.lit("CNAME"), 3: F.lit("MX")},
            F.lit("TXT"),
        ),
        "question_name": lambda: F.when(event_id % 17 == 0, F.lit(None))
        .when(F.col("page_id") % 7 == 0, F.upper("host"))
        .otherwise(F.col("host")),
        "effective_tldp": F.lit(None).cast("string"),
        "answer": F.when(event_type == "error", "")
        .when(event_id % 6 == 0, "A (192.0.2.1), A (192.0.2.2)")
        .when(event_id % 6 == 1, "MX (10 mail.example.com.)")
        .otherwise("198.51.100.7"),
        "response_code": F.when(event_type == "error", "NXDOMAIN").otherwise("NOERROR"),
        "hostname": F.lit("resolver-1"),
    }
    chosen = [c for c in LOG_COLUMNS if c in columns]
    return rows.select(
        *((made[c]() if callable(made[c]) else made[c]).alias(c) for c in chosen)
    )


#: The same log in standard SQL, as the first entry of a WITH list.
FIXTURE_SQL = r"""log AS (
SELECT e.event_id AS id,
       e.ts AS request_ts,
       concat('10.0.', CAST(CAST(floor(e.user_id / 256) AS BIGINT) AS VARCHAR), '.',
              CAST(e.user_id % 256 AS VARCHAR)) AS client_ip,
       CASE WHEN e.user_id % 13 = 0 THEN NULL ELSE c.c_name END AS client_name,
       CASE WHEN e.event_id % 19 = 0 THEN NULL
            WHEN e.event_type IN ('click', 'error') AND e.event_id % 3 = 0 THEN CAST(0 AS BIGINT)
            ELSE CAST(floor(e.value) AS BIGINT) END AS duration_ms,
       CASE e.event_type
            WHEN 'error' THEN CASE e.event_id % 4
                 WHEN 0 THEN 'BLOCKED (ads: *.example.com)'
                 WHEN 1 THEN 'BLOCKED CNAME (tracking: t.example.net)'
                 WHEN 2 THEN 'BLOCKED (malware)' ELSE 'BLOCKED' END
            WHEN 'view' THEN 'RESOLVED (dns.example)' WHEN 'click' THEN 'CACHED'
            WHEN 'purchase' THEN 'CONDITIONAL' ELSE 'CUSTOMDNS' END AS reason,
       CASE e.event_type WHEN 'error' THEN 'BLOCKED' WHEN 'view' THEN 'RESOLVED'
            WHEN 'click' THEN 'CACHED' WHEN 'purchase' THEN 'CONDITIONAL'
            ELSE 'CUSTOMDNS' END AS response_type,
       CASE e.event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' WHEN 2 THEN 'CNAME'
            WHEN 3 THEN 'MX' ELSE 'TXT' END AS question_type,
       CASE WHEN e.event_id % 17 = 0 THEN NULL
            WHEN p.page_id % 7 = 0 THEN upper(regexp_extract(p.url, '^https?://([^/:?#]+)', 1))
            ELSE regexp_extract(p.url, '^https?://([^/:?#]+)', 1) END AS question_name,
       CAST(NULL AS VARCHAR) AS effective_tldp,
       CASE WHEN e.event_type = 'error' THEN ''
            WHEN e.event_id % 6 = 0 THEN 'A (192.0.2.1), A (192.0.2.2)'
            WHEN e.event_id % 6 = 1 THEN 'MX (10 mail.example.com.)'
            ELSE '198.51.100.7' END AS answer,
       CASE WHEN e.event_type = 'error' THEN 'NXDOMAIN' ELSE 'NOERROR' END AS response_code,
       'resolver-1' AS hostname
FROM events e
LEFT JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)
LEFT JOIN customer c ON c.c_custkey = e.user_id
)"""
