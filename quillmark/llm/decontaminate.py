"""Benchmark decontamination by template canonicalisation.

Texts become sequences of canonical tokens: numbers, names (capitalised words inside a sentence; several in a row
are one) and units (unit words after a number) turn into typed placeholders, other words are lower-cased. Windows
of ``WINDOW`` canonical tokens are hash-joined with those of the benchmark, so that a question with other numbers
or names still meets its template. Slot consistency then tells re-parameterised copies from chance: along one
alignment of a document with an item, the values in the item's slots must map one to one to the values in the
document's slots. A document is contaminated by an item when consistent windows cover ``COVERAGE`` of the item's.

Items with equal canonical texts are one template and share its windows in the join, but each is held against the
document with its own slot values, and all that fit are reported. Windows in which fewer than
``LITERALS`` of the tokens are words are not used as templates. Items that have such windows, or fewer than ``SHORTEST``
canonical tokens, are also sought word for word: by windows of their words and numbers as they stand (the whole item if
it is shorter, so that an item of one word is in every document with that word). The better of the two counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import checkpointed, lean
from quillmark.llm.kernel import _STEP, mix, runs, slices, span_hashes

WINDOW = 8
SHORTEST = 4
LITERALS = 0.5
COVERAGE = 0.5
#: Up to so many benchmark windows (8 bytes each) a filter of at most 32 MB is made on the driver and sent to all
#: tasks; a larger benchmark is joined without it.
FILTER_WINDOWS = 1 << 22

#: Unit words.
UNITS = (
    "km m cm mm mi mile miles ft feet foot inch inches yard yards kg g mg lb lbs oz ton tons tonnes l ml liter liters litre litres "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent mph kmh kwh w kw mw v hz khz mhz ghz kb mb gb tb degrees"
).split()

_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[[44, 46]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 33, 34, 40, 46, 58, 59, 63]] = True
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x4E554D4245523A31, 0x4E414D453A3A3A31, 0x554E49543A3A3A31))
#: Sets words and numbers as they stand apart from canonical tokens.
_LITERAL = np.uint64(0x4C49544552414C31)


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), dtype=np.uint8)
    starts, ends, _ = runs(_LETTER[data], np.array([0, len(data)]))
    return np.sort(span_hashes(data, starts, ends))


def _capital(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Does a word begin with A-Z or a capital of the Latin-1 block?"""
    lead, second = buf[starts], buf[np.minimum(starts + 1, len(buf) - 1)]
    return ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))


def _numbers(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Is a byte part of a number: a digit, or a point between digits."""
    digit = _DIGIT[buf]
    point = np.flatnonzero(_POINT[buf])
    point = point[(point > 0) & (point < len(buf) - 1)]
    point = point[digit[point - 1] & digit[point + 1]]
    point = point[~np.isin(point, offsets) & ~np.isin(point + 1, offsets)]
    digit[point] = True
    return digit


def canonical(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each canonical token: hash, is it a word, start, end; and the index of each document's first token."""
    digit = _numbers(buf, offsets)
    parts = [runs(digit, offsets)[:2], runs(_LETTER[buf], offsets)[:2]]
    starts = np.concatenate([p[0] for p in parts])
    ends = np.concatenate([p[1] for p in parts])
    number = np.zeros(len(starts), dtype=bool)
    number[: len(parts[0][0])] = True
    order = np.argsort(starts, kind="stable")
    starts, ends, number = starts[order], ends[order], number[order]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), number, starts, ends, np.zeros(len(offsets), dtype=np.int64)
    first = np.searchsorted(starts, offsets)
    opening = np.zeros(len(starts), dtype=bool)
    opening[first[:-1][first[:-1] < len(starts)]] = True
    stops = np.concatenate([[0], np.cumsum(_STOP[buf] & ~digit)])
    opening[1:] |= stops[starts[1:]] > stops[ends[:-1]]
    capital = _capital(buf, starts)
    h = span_hashes(buf, starts, ends)
    name = ~number & capital & ~opening
    follows = np.zeros(len(starts), dtype=bool)
    follows[1:] = number[:-1] & (starts[1:] - ends[:-1] <= 1)
    follows[first[:-1][first[:-1] < len(starts)]] = False
    units = _unit_hashes()
    unit = ~number & follows & (units[np.minimum(np.searchsorted(units, h), len(units) - 1)] == h)
    name &= ~unit
    h = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, h)))
    joined = np.zeros(len(starts), dtype=bool)
    joined[1:] = name[1:] & name[:-1] & ~opening[1:]
    keep = ~joined
    last = np.append(np.flatnonzero(keep)[1:], len(starts)) - 1
    return h[keep], (~number & ~unit & ~name)[keep], starts[keep], ends[last], np.concatenate([[0], np.cumsum(keep)])[first]


def _windows(h: np.ndarray, word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window, and does it have enough words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    total = h[:n] * _STEP[0]
    for k in range(1, width):
        total = total + h[k : k + n] * _STEP[k]
    words = np.concatenate([[0], np.cumsum(word)])
    return mix(total + np.uint64(width)), words[width:] - words[:-width] >= LITERALS * width


def _slots(buf: np.ndarray, word: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, width: int) -> list[int]:
    """Hashes of the values in the slots of a window, in order."""
    k = at + np.flatnonzero(~word[at : at + width])
    return span_hashes_of(buf, starts[k], ends[k])


def span_hashes_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """As span_hashes, for a few spans of a large buffer."""
    out = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        out.append(int(span_hashes(buf[a:b], np.array([0]), np.array([b - a])).view(np.int64)[0]))
    return out


def literal(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and number as it stands (lower case), and the index of each document's first."""
    digit = _numbers(buf, offsets)
    starts, ends = (np.concatenate(x) for x in zip(runs(digit, offsets)[:2], runs(_LETTER[buf], offsets)[:2], strict=True))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return span_hashes(buf, starts, ends) ^ _LITERAL, np.searchsorted(starts, offsets)


def _template(h: np.ndarray) -> np.uint64:
    return np.sum(mix(h + np.arange(len(h), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)


_HIT = "window long, at int, slots array<long>"


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, template, width, exact, windows, ats, hashes, slots: of each distinct item, the last three by window.

    Items of one template have equal ats and hashes; the slots are each item's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for a, b, buf, offsets in slices(batch.column(1)):
                h, word, starts, ends, first = canonical(buf, offsets)
                plain, plain_first = literal(buf, offsets)
                for d in range(b - a):
                    i, j = int(first[d]), int(first[d + 1])
                    width = min(WINDOW, j - i)
                    w, enough = _windows(h[i:j], word[i:j], width)
                    own = plain[int(plain_first[d]) : int(plain_first[d + 1])]
                    if len(own) and (width < SHORTEST or not enough.all()):
                        size = min(WINDOW, len(own))
                        exact = _windows(own, np.ones(len(own), dtype=bool), size)[0].view(np.int64).tolist()
                        rows.append((ids[a + d], int(mix(np.array([_template(own)], dtype=np.uint64)).view(np.int64)[0]), size, True, len(exact), list(range(len(exact))), exact, [[]] * len(exact)))
                    if width < SHORTEST:
                        continue
                    template = _template(h[i:j])
                    good = np.flatnonzero(enough).tolist()
                    found = [(k, int(w[k : k + 1].view(np.int64)[0]), _slots(buf, word, starts, ends, i + k, width)) for k in good]
                    if _capital(buf, starts[i : i + 1])[0] and word[i]:
                        # inside a document's sentence the item's first word reads as a name
                        inside, word_inside = h[i : i + width].copy(), word[i : i + width].copy()
                        inside[0], word_inside[0] = _NAME, False
                        first_w, first_enough = _windows(inside, word_inside, width)
                        if first_enough[0]:
                            values = span_hashes_of(buf, starts[i : i + 1], ends[i : i + 1]) + _slots(buf, word, starts, ends, i + 1, width - 1)
                            found.append((0, int(first_w.view(np.int64)[0]), values))
                            template = template + np.uint64(1)
                    if found:
                        rows.append((ids[a + d], int(mix(np.array([template], dtype=np.uint64)).view(np.int64)[0]), width, False, max(1, len(good)), *([f[k] for f in found] for k in range(3))))
            kinds = (batch.column(0).type, pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["item_id", "template", "width", "exact", "windows", "ats", "hashes", "slots"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.filter(F.col("item_id").isNotNull()).select("item_id", "text").mapInArrow(lean(run), f"item_id {kind}, template long, width int, exact boolean, windows int, ats array<int>, hashes array<long>, slots array<array<long>>").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, coverage, slots, changed): the items that contaminate a document.

    windows: the item's windows that were found in consistent alignments; slots: their distinct slot values, of
    which ``changed`` have another value in the document. Null or empty texts of either side match nothing; rows with
    a null id are left out. Rows of docs that repeat an id are read as one document; of benchmark rows that repeat an
    id the best match counts. Very long texts count whole. If
    either table is empty, so is the result. Columns other than id and text are not read.
    """
    spark = docs.sparkSession
    items = _items(benchmark)
    shared = items.select("template", "width", "exact", "windows", F.posexplode(F.arrays_zip("ats", "hashes")).alias("k", "at")).dropDuplicates(["template", "k"])
    shared = shared.select("template", "width", "exact", "windows", "k", F.col("at.ats").alias("item_at"), F.col("at.hashes").alias("window"))
    known = shared.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.struct("exact", "width")).alias("widths")).first()
    widths, n = sorted(map(tuple, known["widths"])), known["n"]
    seen, bits = None, 0
    if n <= FILTER_WINDOWS:
        bits = max(16, int(16 * n).bit_length())
        hashes = shared.select("window").distinct().toPandas()["window"].to_numpy(dtype=np.int64).view(np.uint64)
        flags = np.zeros(1 << bits, dtype=bool)
        flags[hashes >> np.uint64(64 - bits)] = True
        seen = spark.sparkContext.broadcast(np.packbits(flags))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in slices(batch.column(1)):
                h, word, starts, ends, first = canonical(buf, offsets)
                ids, rows = batch.column(0).slice(a, b - a), []
                slot = np.flatnonzero(~word)
                before = np.concatenate([[0], np.cumsum(~word)])
                values = None
                plain, plain_first = literal(buf, offsets) if any(x for x, _ in widths) else (h, first)
                for exact, width in widths:
                    w, good = _windows(plain, np.ones(len(plain), dtype=bool), width) if exact else _windows(h, word, width)
                    begin = plain_first if exact else first
                    if seen is not None and len(w):
                        top = w >> np.uint64(64 - bits)
                        good &= (seen.value[top >> np.uint64(3)] >> (np.uint64(7) - (top & np.uint64(7))).astype(np.uint8)) & 1 > 0
                    at = np.flatnonzero(good)
                    doc = np.searchsorted(begin, at, side="right") - 1
                    inside = at + width <= begin[np.minimum(doc + 1, len(begin) - 1)]
                    if not exact and values is None and inside.any():
                        values = span_hashes(buf, starts[slot], ends[slot]).view(np.int64).tolist()
                    rows += [(d, h_, k - int(begin[d]), [] if exact else values[before[k] : before[k + width]]) for k, d, h_ in zip(at[inside].tolist(), doc[inside].tolist(), w[at[inside]].view(np.int64).tolist(), strict=True)]
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in rows])), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds, 1))], ["doc_id", "window", "at", "slots"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    hits = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, {_HIT}")
    # templates meet once, whatever the number of their items; each item's values are then held against the alignments, one row for
    # each alignment: a text may repeat a template any number of times
    place = ["doc_id", "template"]
    aligned = checkpointed(hits.join(shared, "window").groupBy(*place, (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set(F.struct("item_at", "k", "slots")).alias("met"), F.max("windows").cast("long").alias("item_windows")))
    covered = aligned.select(*place, "item_windows", F.explode("met.item_at").alias("item_at")).distinct().groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.max("item_windows").alias("most"))
    covered = covered.filter(F.col("n") / F.col("most") >= coverage).select(*place)
    own = items.select("template", "item_id", F.col("slots").alias("item_slots")).distinct()
    pair = lambda m: F.zip_with(F.element_at("item_slots", m["k"] + 1), m["slots"], lambda i, d: F.struct(i.alias("i"), d.alias("d")))
    one_to_one = lambda v: (F.size(F.array_distinct(v["i"])) == F.size(v)) & (F.size(F.array_distinct(v["d"])) == F.size(v))
    fits = aligned.join(covered, place, "left_semi").join(own, "template").withColumn("values", F.array_distinct(F.flatten(F.transform("met", pair)))).filter(one_to_one(F.col("values")))
    keys = ["doc_id", "item_id", "template", "own"]
    fits = fits.select("doc_id", "item_id", "template", F.xxhash64("item_slots").alias("own"), "item_windows", F.col("met.item_at").alias("found"), "values")
    found = fits.select(*keys, "item_windows", F.explode("found").alias("item_at")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), F.max("item_windows").alias("item_windows"))
    held = fits.select(*keys, F.explode("values").alias("v")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("slots"), F.count_if(F.col("v.i") != F.col("v.d")).alias("changed"))
    total = found.withColumn("coverage", F.col("windows") / F.col("item_windows")).filter(F.col("coverage") >= coverage).join(held, keys, "left")
    total = total.withColumns({"slots": F.coalesce("slots", F.lit(0)), "changed": F.coalesce("changed", F.lit(0))})
    # of rows that repeat an item_id, the best one
    best = total.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", (-F.col("changed")).alias("kept"), "windows", "item_windows", "slots")).alias("best"))
    return best.select("doc_id", "item_id", "best.windows", "best.item_windows", "best.coverage", "best.slots", (-F.col("best.kept")).alias("changed"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that no item contaminates."""
    bad = contamination(docs, benchmark, coverage).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
