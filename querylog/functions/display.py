"""Display values derived from single log or list rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylog.functions.answers import trim_space

# Response types answered without asking an upstream resolver.
LOCAL_RESPONSE_TYPES = (
    "CACHED",
    "HOSTSFILE",
    "CUSTOMDNS",
    "BLOCKED",
    "SPECIAL",
    "FILTERED",
    "NOTFQDN",
)
NO_DURATION = "—"
_PARENTHESIS = r"\((.*?)\)"


def reason_text(reason: Column) -> Column:
    """The reason without its first parenthesis; null for an empty reason."""
    shown = F.regexp_replace(reason, r"^(.*?)\(.*?\)", "$1")
    return F.when(reason != "", trim_space(shown))


def reason_note(reason: Column, response_type: Column) -> Column:
    """Content of the first parenthesis, prefixed by what it means for the
    response type; null where there is none."""
    found = F.regexp_extract(reason, _PARENTHESIS, 1)
    inner = F.when(F.rlike(reason, F.lit(_PARENTHESIS)), found)
    return (
        F.when(response_type == "RESOLVED", F.concat(F.lit("Resolved by: "), inner))
        .when(response_type == "BLOCKED", F.concat(F.lit("Group: "), inner))
        .otherwise(F.nullif(inner, F.lit("")))
    )


def duration_label(duration_ms: Column, response_type: Column) -> Column:
    local = F.coalesce(response_type.isin(*LOCAL_RESPONSE_TYPES), F.lit(False))
    return F.when((duration_ms == 0) & local, F.lit(NO_DURATION)).otherwise(
        F.concat(duration_ms.cast("string"), F.lit("ms"))
    )


def compact_count(count: Column) -> Column:
    """``1,234`` style below a thousand, then ``1.2K``, ``3.4M`` (grouped)."""
    # format_number alone rounds half to even; the display rounds half up.
    millions = F.format_number(F.round(count / 1_000_000, 1), 1)
    thousands = F.format_number(F.round(count / 1_000, 1), 1)
    return (
        F.when(count >= 1_000_000, F.concat(millions, F.lit("M")))
        .when(count >= 1_000, F.concat(thousands, F.lit("K")))
        .otherwise(F.format_number(count, 0))
    )


def short_count(count: Column) -> Column:
    """The form used in filter suggestions: thousands only, no digit grouping."""
    thousands = F.format_string("%.1f", F.round(count / 1_000, 1))
    return F.when(count >= 1_000, F.concat(thousands, F.lit("K"))).otherwise(
        count.cast("string")
    )


def percentage(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``; 0 for an empty whole."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
