from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], SCHEMA)


def words(seed: int, n: int, size: int = 400) -> list[str]:
    r = random.Random(seed)
    pool = ["".join(random.Random(k).choices("abcdefghilmnoprstuv", k=3 + k % 6)) for k in range(size)]
    return r.choices(pool, k=n)


def text(seed: int, n: int) -> str:
    return " ".join(words(seed, n))
