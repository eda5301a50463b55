"""Mails as files of an outbox: a sink in two phases, so a mail is there once or not at all.

Tasks write their messages aside; when all have ended, the driver moves them into ``new`` under a name made from what they
say, and on a failure it deletes them. A task that is run twice, a commit that is repeated, and a job that is run again give the same names,
so no mail is doubled; one that a mailer has taken (moved to ``sent``) does not come back. The folder lies on a file system that all executors mount.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("recipient", "subject", "html", "text")])


@dataclass
class Written(WriterCommitMessage):
    """Names of the messages of a task; a mail is a small row for a person, so these are few."""

    names: list[str] = field(default_factory=list)


class OutboxWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder, self.aside = folder, os.path.join(folder, f".{uuid.uuid4().hex}")
        os.makedirs(self.aside, exist_ok=True)

    def write(self, iterator: Iterator) -> Written:
        names = []
        for row in iterator:
            if row["recipient"] is None:
                raise ValueError("a mail has a recipient")
            body = json.dumps({n: row[n] for n in SCHEMA.names}, ensure_ascii=False, sort_keys=True)
            name = hashlib.sha256(body.encode()).hexdigest()
            part = os.path.join(self.aside, f"{name}.{uuid.uuid4().hex}")
            with open(part, "w", encoding="utf-8") as out:
                out.write(body)
            os.replace(part, os.path.join(self.aside, name))
            names.append(name)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        new = os.path.join(self.folder, "new")
        os.makedirs(new, exist_ok=True)
        for name in sorted({n for m in messages if m is not None for n in m.names}):
            known = any(os.path.exists(os.path.join(self.folder, place, f"{name}.json")) for place in ("new", "sent"))
            if not known and os.path.exists(os.path.join(self.aside, name)):
                os.replace(os.path.join(self.aside, name), os.path.join(new, f"{name}.json"))
        self._drop()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        """What attempts that did not count have left goes too."""
        for name in os.listdir(self.aside) if os.path.isdir(self.aside) else ():
            os.remove(os.path.join(self.aside, name))
        if os.path.isdir(self.aside):
            os.rmdir(self.aside)


class Outbox(DataSource):
    """spark.dataSource.register(Outbox); mails.write.format("outbox").mode("append").save(folder)"""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> T.StructType:
        return SCHEMA

    def writer(self, schema: T.StructType, overwrite: bool) -> OutboxWriter:
        if overwrite:
            raise ValueError("an outbox is appended to")
        return OutboxWriter(self.options["path"])
