"""A paged REST source: one input partition for each page."""

from __future__ import annotations

import json
import math
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, IsNull, LessThanOrEqual

from quillmark.schemas import RAW_FIELDS

#: Limits of the remote interface.
MOST_ROWS, MOST_PAGES, PAGE = 10_000, 100, 100
#: The field by whose days a read is divided that has more rows than that.
DAY = "dateparution"

Fetch = Callable[[str], dict]


def http(url: str) -> dict:
    with urllib.request.urlopen(url, timeout=30) as answer:
        return json.load(answer)


@dataclass
class Page(InputPartition):
    offset: int
    limit: int
    #: The condition of the range of days that the page belongs to, besides those of the whole read.
    where: tuple[str, ...] = ()


def pages(total: int, size: int = PAGE) -> list[Page]:
    """Pages up to the total; more than the interface gives is an error, not a cut. Smaller pages than the total allows become larger."""
    size = max(min(size, PAGE), -(-total // MOST_PAGES))
    if total > MOST_ROWS or math.ceil(total / size) > MOST_PAGES:
        raise ValueError(f"{total} rows are more than the interface gives; narrow the range of dates")
    return [Page(k, size) for k in range(0, total, size)]


def day_ranges(count: Callable[[tuple[str, ...]], int], first: date, last: date, column: str, most: int = MOST_ROWS) -> Iterator[tuple[tuple[str, ...], int]]:
    """(condition, rows) of ranges of days from first to last, none of which has more rows than the interface gives; empty ones are left out.

    Ranges are halved as long as they have too many rows; only counts are asked for. A single day with too many is an error, not a cut.
    """
    where = (f"{column} >= '{first}'", f"{column} <= '{last}'")
    n = count(where)
    if n <= most:
        if n:
            yield where, n
        return
    if first == last:
        raise ValueError(f"{n} rows of {first} are more than the interface gives; add a condition")
    middle = first + (last - first) // 2
    yield from day_ranges(count, first, middle, column, most)
    yield from day_ranges(count, middle + timedelta(days=1), last, column, most)


def condition(f: Filter) -> str | None:
    """The remote condition of a filter, or None if it must be applied here."""
    column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
    if column is None:
        return None
    if isinstance(f, IsNull):
        return f"{column} is null"
    sign = {EqualTo: "=", GreaterThanOrEqual: ">=", LessThanOrEqual: "<="}.get(type(f))
    return f"{column} {sign} '{str(f.value).replace(chr(39), chr(39) * 2)}'" if sign and isinstance(f.value, str) else None


def selected(options: dict) -> list[str]:
    """The fields that the option ``select`` names (a list with commas), in the order of the schema; without it all. An unknown name is an error."""
    if not options.get("select"):
        return list(RAW_FIELDS.names)
    wanted = {n.strip() for n in options["select"].split(",")}
    if unknown := wanted - set(RAW_FIELDS.names):
        raise ValueError(f"no field {', '.join(sorted(unknown))}")
    return [n for n in RAW_FIELDS.names if n in wanted]


class TenderReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch = http) -> None:
        self.options, self.fetch, self.fields = options, fetch, selected(options)
        self.where = [options["where"]] if options.get("where") else []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            remote = condition(f)
            if remote:
                self.where.append(remote)
            else:
                yield f

    def url(self, offset: int, limit: int, where: tuple[str, ...] = (), order: str = f"{DAY} desc", fields: list[str] | None = None) -> str:
        query = {"select": ",".join(fields or self.fields), "order_by": order, "limit": limit, "offset": offset}
        if self.where or where:
            query["where"] = " and ".join([*self.where, *where])
        return f"{self.options['path']}?{urllib.parse.urlencode(query)}"

    def count(self, where: tuple[str, ...] = ()) -> int:
        return int(self.fetch(self.url(0, 1, where))["total_count"])

    def _end(self, order: str) -> date:
        """The first day in that order, of rows that have one."""
        found = self.fetch(self.url(0, 1, (f"{DAY} is not null",), f"{DAY} {order}", [DAY]))["results"]
        record = (found[0].get("record") or found[0]).get("fields") or found[0]
        return date.fromisoformat(str(record[DAY])[:10])

    def partitions(self) -> list[Page]:
        """Pages of the whole read; where it has more rows than the interface gives, of ranges of days that have not, and of the rows without a day."""
        size, total = int(self.options.get("pagesize", PAGE)), self.count()
        if total <= MOST_ROWS:
            return pages(total, size)
        without = (f"{DAY} is null",)
        ranges = [(without, n)] if (n := self.count(without)) else []
        if n < total:
            ranges += day_ranges(self.count, self._end("asc"), self._end("desc"), DAY)
        return [Page(p.offset, p.limit, where) for where, n in ranges for p in pages(n, size)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for record in self.fetch(self.url(partition.offset, partition.limit, partition.where)).get("results", []):
            record = (record.get("record") or record).get("fields") or record
            yield tuple(None if (v := record.get(n)) is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for n in self.fields)


class TenderSource(DataSource):
    """spark.dataSource.register(TenderSource); spark.read.format("tenders").load(url)

    Sources in Python are not told which columns a query uses: the option ``select`` names them, so that no others are fetched.
    """

    @classmethod
    def name(cls) -> str:
        return "tenders"

    def schema(self) -> T.StructType:
        return T.StructType([RAW_FIELDS[n] for n in selected(dict(self.options))])

    def reader(self, schema) -> TenderReader:
        return TenderReader(dict(self.options))
