"""One object per log, one method per question."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from querylog.operators import logs, ranking, snapshot, timeseries
from querylog.operators.paging import Page
from querylog.operators.rollup import Rollup, rolled_series
from querylog.sources import open_database, read_query_log
from querylog.validation import LIST_PAGE_DEFAULT, LOG_PAGE_DEFAULT, SEARCH_DEFAULT


@dataclass(frozen=True)
class QueryLog:
    """A log frame with the moment its ranges look back from.

    Without ``as_of`` every call looks back from its own current time. Paged
    methods return a :class:`Page` of ``items`` and ``totals``. ``at_source`` is for the
    frame of a database, which then counts by itself where it can. A ``rollup`` of the
    log answers ranked lists, record types, name searches and unfiltered series of a day
    or more, with the log's rows only where the rollup does not reach.
    """

    log: DataFrame
    as_of: datetime | None = None
    at_source: bool = False
    rollup: Rollup | None = None

    @classmethod
    def open(
        cls,
        spark: SparkSession,
        kind: str,
        target: str | None,
        as_of: datetime | None = None,
        **options,
    ) -> QueryLog:
        return cls(read_query_log(spark, kind, target, **options), as_of)

    @classmethod
    def in_database(cls, spark: SparkSession, kind: str, target: str, as_of: datetime | None = None, **options) -> QueryLog:
        """A log that stays in its database, which answers totals and ranked lists."""
        return cls(open_database(spark, kind, target, **options), as_of, at_source=True)

    def query_logs(
        self,
        limit: int = LOG_PAGE_DEFAULT,
        offset: int = 0,
        search: str | None = None,
        response_type: str | None = None,
        client: str | None = None,
        question_type: str | None = None,
        range: str | None = None,
    ) -> Page:
        return logs.query_logs(
            self.log,
            limit,
            offset,
            search=search,
            response_type=response_type,
            client=client,
            question_type=question_type,
            range=range,
            as_of=self.as_of,
        )

    def stats_24h(self) -> DataFrame:
        return snapshot.stats_24h(self.log, self.as_of, self.at_source)

    def overview_24h(self) -> DataFrame:
        return snapshot.overview_24h(self.log, self.as_of)

    def snapshot_top_lists(self) -> DataFrame:
        return snapshot.snapshot_top_lists(self.log, self.as_of)

    def queries_over_time(
        self,
        range: str,
        domain: str | None = None,
        client: str | None = None,
        mode: str = "aligned",
    ) -> DataFrame:
        if self.rollup is not None and not (domain or client) and mode == "aligned" and range != "1h":
            return rolled_series(self.log, self.rollup, range, self.as_of)
        return timeseries.queries_over_time(self.log, range, domain, client, mode, self.as_of)

    def top_list(
        self,
        kind: str,
        range: str,
        limit: int = LIST_PAGE_DEFAULT,
        offset: int = 0,
        filter: str = "all",
    ) -> Page:
        return ranking.top_list(self.log, kind, range, limit, offset, filter, self.as_of, self.at_source, self.rollup)

    def top_domains(
        self, range: str, limit: int = LIST_PAGE_DEFAULT, offset: int = 0, filter: str = "all"
    ) -> Page:
        return ranking.top_domains(
            self.log, range, limit=limit, offset=offset, filter=filter, as_of=self.as_of, at_source=self.at_source, rollup=self.rollup
        )

    def top_clients(
        self, range: str, limit: int = LIST_PAGE_DEFAULT, offset: int = 0, filter: str = "all"
    ) -> Page:
        return ranking.top_clients(
            self.log, range, limit=limit, offset=offset, filter=filter, as_of=self.as_of, at_source=self.at_source, rollup=self.rollup
        )

    def query_types_breakdown(self, range: str) -> DataFrame:
        return ranking.query_types_breakdown(self.log, range, self.as_of, self.at_source, self.rollup)

    def search_domains(self, range: str, query: str, limit: int = SEARCH_DEFAULT) -> DataFrame:
        return ranking.search_domains(self.log, range, query, limit, self.as_of, self.rollup)

    def search_clients(self, range: str, query: str, limit: int = SEARCH_DEFAULT) -> DataFrame:
        return ranking.search_clients(self.log, range, query, limit, self.as_of, self.rollup)

    def suggestions(self, text: str = "", range: str = "24h") -> DataFrame:
        return ranking.suggestions(self.log, text, range, self.as_of)
