"""RSS feeds as a source that is read in batch or polled as a stream: one partition for each feed, and a row for each feed that fails."""

from __future__ import annotations

import json
import time
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillmark import schemas

#: feed, its poll, the item's place in it; either an item or an error.
SCHEMA = T.StructType([T.StructField("feed", T.StringType()), T.StructField("poll", T.LongType()), T.StructField("position", T.IntegerType()), T.StructField("item", schemas.RSS_ITEM), T.StructField("error", T.StringType())])


def parse(data: bytes) -> list[tuple]:
    """The items of a feed in order; names lose their prefixes, and the first element of a name counts, but for categories."""
    found = []
    for node in ET.fromstring(data).iter("item"):
        first: dict[str, str | None] = {}
        categories = []
        for child in node:
            name = child.tag.rpartition("}")[2]
            if name == "category":
                categories.append(child.text)
            else:
                first.setdefault(name, child.text)
        found.append(tuple(categories or None if f.name == "category" else first.get(f.name) for f in schemas.RSS_ITEM.fields))
    return found


@dataclass
class Feed(InputPartition):
    url: str
    poll: int


class FeedReader(DataSourceReader):
    """options: urls (a JSON list) or path (one feed); tries, timeout and pause in seconds."""

    def __init__(self, options: dict) -> None:
        self.urls = json.loads(options["urls"]) if options.get("urls") else [options["path"]]
        self.tries, self.timeout, self.pause = int(options.get("tries", 2)), float(options.get("timeout", 30)), float(options.get("pause", 1))

    def partitions(self) -> list[Feed]:
        return [Feed(u, 0) for u in self.urls]

    def read(self, partition: Feed) -> Iterator[tuple]:
        """The items; after the last try that fails, or of a feed that cannot be parsed, one row that says so."""
        for attempt in range(1, self.tries + 1):
            try:
                with urllib.request.urlopen(partition.url, timeout=self.timeout) as answer:
                    items = parse(answer.read())
                break
            except (OSError, ValueError, ET.ParseError) as e:
                if attempt == self.tries or isinstance(e, ET.ParseError):
                    yield partition.url, partition.poll, 0, None, f"{type(e).__name__}: {e}"
                    return
                time.sleep(self.pause)
        for k, item in enumerate(items):
            yield partition.url, partition.poll, k, item, None


class FeedStream(FeedReader, DataSourceStreamReader):
    """A poll each ``interval`` seconds. A feed shows what it holds when it is read, so polls that were missed are one poll, and one that is replayed after a
    failure may show newer items: merges by guid make both harmless."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.interval = float(options.get("interval", 3600))

    def _now(self) -> int:
        return int(time.time() // self.interval)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": self._now() - 1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"poll": self._now()}

    def partitions(self, start: dict, end: dict) -> list[Feed]:
        return [Feed(u, end["poll"]) for u in self.urls] if end["poll"] > start["poll"] else []

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """spark.dataSource.register(FeedSource); spark.read.format("feeds").option("urls", json.dumps([...])).load()"""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> FeedReader:
        return FeedReader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> FeedStream:  # noqa: N802
        return FeedStream(dict(self.options))


def items(rows: DataFrame) -> DataFrame:
    """The items as ``canonical.from_rss`` reads them."""
    return rows.filter("item IS NOT NULL").select("item.*")


def failures(rows: DataFrame) -> DataFrame:
    """(feed, poll, error) of the feeds that could not be read, for a warning."""
    return rows.filter(F.col("error").isNotNull()).select("feed", "poll", "error")
