"""Signed links: a person answers a mail, and the answer must be about the tender that the mail was about."""

from __future__ import annotations

import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sign(subject: str, secret: str) -> str:
    """HMAC-SHA256 in lower-case hex."""
    return hmac.new(secret.encode(), subject.encode(), "sha256").hexdigest()


def verify(subject: str, token: str, secret: str) -> bool:
    """In constant time."""
    return hmac.compare_digest(sign(subject, secret).encode(), token.encode())


def signed(subject: Column, secret: str) -> Column:
    """Tokens of a column; Spark has no such function, so that batches go through Arrow."""

    @F.pandas_udf("string")
    def run(subjects: pd.Series) -> pd.Series:
        return subjects.map(lambda s: None if s is None else sign(s, secret))

    return run(subject)
