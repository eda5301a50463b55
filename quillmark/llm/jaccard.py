"""Jaccard join of documents over word shingles, by filters in several global token orders.

1. Every document becomes the set of its distinct shingles. Shingles travel as packed arrays, one for each pair
   of chunk and bucket of the hash range, so a shuffle row stands for thousands of shingles. A bucket finds
   the shingles that at least two documents have, with their document frequencies.
2. Overlap of 0.8 of the union means that 80 % of a document's own shingles are shared with one other. Documents
   with fewer shared shingles link with nothing; what follows is about the rest. Equal sets become one node.
3. Under a global order (rarest first, ties by hash), documents that link share a token within their prefixes of
   n - ceil(0.8 n) + 1. Documents with a common prefix token are connected by a star around the smallest
   of them, not pair by pair; the components of these stars hold all links.
4. Within a component, candidates must share prefix tokens under each of three orders (by frequency, and two
   permutations of the hash); the filters are intersected, then sizes, then the exact overlap decides. Pairs
   that are connected already are skipped, so a large group costs about one success for each of its members.
   In a component over ``BLOCK`` shingles every node is first compared with a few centres. The groups that this unites are dealt into
   blocks of their own, and each pair of blocks that may hold links between different groups is a task.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import bucket_bits, checkpointed, chunk_bytes, discard, lean, parts_for, stable
from quillmark.llm.graph import connected_components
from quillmark.llm.kernel import mix, shingle_sets, slices

WIDTH = 5
#: A link: PERCENT * union <= 100 * intersection.
PERCENT = 80
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 1 << 15
#: Shingles that one task verifies at once.
BLOCK = 2_000_000
#: Centres that a node of a large component is compared with before blocks are dealt, and tasks that may ask for one centre.
CENTRES, SALTS = 2, 256
#: Documents that one part of an intermediate result holds.
DOCUMENTS = 5_000
_REST = np.uint64(48)
_U = np.uint64


def needed(n: np.ndarray | int):
    """Shared shingles that a document of n needs for any link."""
    return (PERCENT * n + 99) // 100


def _shingles(docs: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """Rows by bucket: packed (name, document) arrays of a chunk, and for each chunk its table of documents."""
    size = chunk_bytes(docs, CHUNK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        names = ["bucket", "chunk", "keys", "n", "node", "payload"]
        for batch in batches:
            for part in (batch.slice(k, CHUNK_ROWS) for k in range(0, batch.num_rows, CHUNK_ROWS)):
                for a, b, buf, offsets in slices(part.column(1), size):
                    sets = list(shingle_sets(buf, offsets, WIDTH))
                    n = np.array([len(s) for s in sets], dtype=np.int64)
                    node = np.array([int(mix(np.array([np.sum(mix(s), dtype=np.uint64) + _U(len(s))], dtype=np.uint64))[0]) for s in sets], dtype=np.uint64).view(np.int64)
                    keys = part.column(0).slice(a, b - a)
                    listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                    yield pa.RecordBatch.from_arrays([pa.array([chunk % (1 << bits)], pa.int32()), pa.array([chunk], pa.int64()), listed(keys), listed(pa.array(n)), listed(pa.array(node)), pa.array([None], pa.binary())], names)
                    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
                    if len(flat):
                        doc = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
                        order = np.argsort(flat >> _U(64 - bits), kind="stable")
                        flat, doc = flat[order], doc[order]
                        bucket = flat >> _U(64 - bits)
                        rest = (flat >> (_U(64 - bits) - _REST)) & _U((1 << 48) - 1)
                        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                        ends = np.append(cut[1:], len(flat))
                        low, high = rest.astype(np.uint32), (rest >> _U(32)).astype(np.uint16)
                        blobs = [low[i:j].tobytes() + high[i:j].tobytes() + doc[i:j].tobytes() for i, j in zip(cut.tolist(), ends.tolist(), strict=True)]
                        m = len(blobs)
                        none = [pa.nulls(m, pa.list_(x)) for x in (keys.type, pa.int64(), pa.int64())]
                        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array(np.full(m, chunk)), *none, pa.array(blobs, pa.binary())], names)
                    chunk += 1

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), f"bucket int, chunk long, keys array<{kind}>, n array<long>, node array<long>, payload binary")


def _repeated(table: pa.Table) -> pa.Table:
    """Of a bucket: the entries whose name several documents have, with the document frequency (at most 65,535)."""
    payloads = table.column("payload").to_pylist()
    lows, highs, docs = [], [], []
    for p in payloads:
        n = len(p) // 8 if p else 0
        raw = p or b""
        lows.append(np.frombuffer(raw, "<u4", n))
        highs.append(np.frombuffer(raw, "<u2", n, 4 * n))
        docs.append(np.frombuffer(raw, "<u2", n, 6 * n))
    size = np.array([len(x) for x in lows])
    names = np.concatenate(highs).astype(np.uint64) << _U(32) | np.concatenate(lows)
    order = np.argsort(names)
    ordered = names[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(first, len(ordered)))
    df = np.empty(len(names), dtype=np.int64)
    df[order] = np.repeat(count, count)
    names |= _U(table.column("bucket")[0].as_py()) << _REST
    out = []
    edge = np.concatenate([[0], np.cumsum(size)])
    for k, p in enumerate(payloads):
        if p is None:
            out.append(None)
            continue
        keep = edge[k] + np.flatnonzero(df[edge[k] : edge[k + 1]] > 1)
        out.append(names[keep].tobytes() + docs[k][keep - edge[k]].tobytes() + np.minimum(df[keep], 65535).astype(np.uint16).tobytes())
    return table.select(["chunk", "keys", "n", "node"]).append_column("payload", pa.array(out, pa.binary()))


def _documents(table: pa.Table) -> pa.Table:
    """Of a chunk: its documents, with their shared shingles where these suffice for a link."""
    table = table.combine_chunks()
    head = next(k for k, x in enumerate(table.column("payload").is_null().to_pylist()) if x)
    keys, n, node = (table.column(c)[head].values for c in ("keys", "n", "node"))
    parts = [(np.frombuffer(p, "<u8", m), np.frombuffer(p, "<u2", m, 8 * m), np.frombuffer(p, "<u2", m, 10 * m)) for p in table.column("payload").to_pylist() if p for m in [len(p) // 12]]
    names, doc, df = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, "<u8"), np.zeros(0, "<u2"), np.zeros(0, "<u2"))
    size = n.to_numpy()
    shared = np.bincount(doc, minlength=len(size))
    able = (size > 0) & (shared >= needed(size))
    keep = able[doc]
    names, doc, df = names[keep], doc[keep], df[keep]
    order = np.lexsort((names, doc))
    names, doc, df = names[order], doc[order], df[order]
    edge = np.searchsorted(doc, np.arange(len(size) + 1))
    cut = lambda x: [x[i:j].tobytes() if ok else None for i, j, ok in zip(edge[:-1], edge[1:], able, strict=True)]
    return pa.table([keys, n, node, pa.array(cut(names), pa.binary()), pa.array(cut(df), pa.binary())], names=["key", "n", "node", "names", "df"])


def _prefix(n: int, names: np.ndarray, df: np.ndarray, order: int) -> np.ndarray:
    """The first tokens of a set under a global order; shingles that nobody shares come first and are left out."""
    length = n - needed(n) + 1 - (n - len(names))
    if length <= 0:
        return names[:0]
    if order == 0:
        return names[np.lexsort((names, df))[:length]]
    hashed = mix(names + _U(order * 0x9E3779B97F4A7C15 % (1 << 64)))
    # very frequent shingles go last in every order
    return names[np.lexsort((hashed, df >> 6))[:length]]


ORDERS = 3
#: Documents that a document is compared with before all filters are applied.
FIRST = 8


class _Groups:
    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return int(x)

    def roots(self, xs: np.ndarray) -> np.ndarray:
        r = self.parent[xs]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def _posted(indexes: list[dict[int, array]], tokens: list[int]) -> np.ndarray:
    """The documents that have one of the tokens, once for each token; the views of the lists end here, so that they can grow again."""
    lists = [np.frombuffer(y, dtype=np.int32) for index in indexes for t in tokens if (y := index.get(t)) is not None]
    return np.concatenate(lists) if lists else np.zeros(0, dtype=np.int32)


def _counted(flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values below n, ascending, and how often each occurs; without a sort where they are many."""
    if 16 * len(flat) < n:
        return np.unique(flat, return_counts=True)
    count = np.bincount(flat, minlength=n)
    found = np.flatnonzero(count)
    return found, count[found]


def link(sizes: list[int], sets: list[np.ndarray], dfs: list[np.ndarray], side: list[int] | None = None) -> _Groups:
    """Groups of documents that are connected by links; with ``side``, links within one side are another task's.

    A document is first compared with the few that share most of its first prefix. In a group of near copies this connects it, and
    only what is not connected yet goes through the other filters.
    """
    groups = _Groups(len(sizes))
    turn = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
    sides = [0] * len(sizes) if side is None else side
    index: dict[int, list[dict[int, array]]] = {s: [{} for _ in range(ORDERS)] for s in set(sides)}
    size = np.array(sizes)

    def unite(x: int, part: np.ndarray) -> None:
        flat = np.concatenate([sets[y] for y in part.tolist()])
        at = np.minimum(np.searchsorted(sets[x], flat), len(sets[x]) - 1)
        start = np.concatenate([[0], np.cumsum([len(sets[y]) for y in part.tolist()])[:-1]])
        both = np.add.reduceat((sets[x][at] == flat).astype(np.int64), start)
        for y in part[100 * both >= PERCENT * (sizes[x] + size[part] - both)].tolist():
            groups.union(x, y)

    def apart(x: int, found: np.ndarray) -> np.ndarray:
        return found[groups.roots(found) != groups.find(x)]

    for x in turn:
        prefixes = [_prefix(sizes[x], sets[x], dfs[x], o).tolist() for o in range(ORDERS)]
        met = [index[s] for s in index if side is None or s != sides[x]]
        found, count = _counted(_posted([m[0] for m in met], prefixes[0]), len(sizes))
        fits = 100 * size[found] >= PERCENT * sizes[x]
        found, count = found[fits], count[fits]
        if len(found) > FIRST:
            unite(x, found[np.argsort(-count, kind="stable")[:FIRST]])
            found = apart(x, found)
        for o in range(1, ORDERS):
            if not len(found):
                break
            other, _ = _counted(_posted([m[o] for m in met], prefixes[o]), len(sizes))
            found = np.intersect1d(found, other, assume_unique=True)
        found = found[np.argsort(-size[found], kind="stable")]
        while len(found := apart(x, found)):
            part, found = found[:64], found[64:]
            unite(x, part)
        for o, own in enumerate(index[sides[x]]):
            for t in prefixes[o]:
                own.setdefault(t, array("i")).append(x)
    return groups


def _with_centres(heavy: DataFrame, postings, parts: int) -> DataFrame:
    """Links (a, b) of nodes with the centres that share most of their prefix tokens: a few comparisons for each node.

    A centre that very many nodes ask for is read by SALTS tasks or fewer, each with its own copy.
    """
    posted = heavy.select("node", "n", "names", "df").mapInArrow(postings, "token long, node long")
    centre = posted.groupBy("token").agg(F.min("node").alias("a"))
    shared = posted.join(centre, "token").filter("a <> node").groupBy("node", "a").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "a")), asc=False), 1, CENTRES).alias("best"))  # of a prefix's tokens
    edges = best.select(F.col("node").alias("b"), F.explode("best.a").alias("a")).withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    copies = edges.select("a", "salt").distinct().join(heavy.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("names").alias("names_a")), "a")
    pairs = edges.join(heavy.select(F.col("node").alias("b"), "n", "names"), "b").join(copies, ["a", "salt"]).select("a", "b", "n_a", "n", "names_a", "names")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            passed = []
            for k in range(batch.num_rows):
                both = len(np.intersect1d(np.frombuffer(batch.column(4)[k].as_buffer(), "<u8"), np.frombuffer(batch.column(5)[k].as_buffer(), "<u8"), assume_unique=True))
                passed.append(100 * both >= PERCENT * (n_a[k] + n_b[k] - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(passed, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return checkpointed(pairs.mapInArrow(lean(compare), "a long, b long"), parts)


def _block_pairs(heavy: DataFrame, united: DataFrame) -> DataFrame:
    """The pairs of blocks of large components that are left to verify.

    Nodes of one group that is united already need no comparison with each other. So a group of a block's size or more has blocks of its own, which
    meet those of other groups only; all other nodes of the component share blocks that meet each other. Where one group has nearly
    all of a component, the pairs of blocks grow with the number of blocks and not with its square.
    """
    narrow = heavy.select("label", "node", "n").join(united.select("node", F.col("label").alias("united")), "node", "left")
    groups = narrow.filter("united is not null").groupBy("label", "united").agg(F.sum("n").alias("weight")).filter(F.col("weight") >= BLOCK).select("label", "united")
    homes = groups.select(F.col("label").alias("_label"), F.col("united").alias("home"))
    dealt = narrow.join(homes, narrow["united"] == F.col("home"), "left").select("label", "node", "n", "home")
    size = dealt.groupBy("label", "home").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    turn = Window.partitionBy("label").orderBy(F.col("home").asc_nulls_first())  # one row for each group of a block's size
    first = F.sum("blocks").over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("blocks")
    ranges = size.withColumns({"first": first, "total": F.sum("blocks").over(Window.partitionBy("label"))}).select(F.col("label").alias("_l"), F.col("home").alias("_h"), "blocks", "first", "total")
    placed = dealt.join(ranges, (F.col("label") == F.col("_l")) & F.col("home").eqNullSafe(F.col("_h"))).withColumn("own", F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("total") - 1)
    foreign = F.filter(every, lambda o: (o < F.col("first")) | (o >= F.col("first") + F.col("blocks")))
    meets = placed.select("node", "own", F.explode(F.when(F.col("home").isNull(), every).otherwise(foreign)).alias("other"))
    pairs = meets.select(F.col("node").alias("_node"), "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return heavy.join(pairs, F.col("node") == F.col("_node")).select(F.col("label").alias("lane"), "label", "node", "n", "names", "df", "own", "i", "j")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): for each row the size of its set and the smallest id that links reach.

    Two documents link when 100 * intersection >= 80 * union of their sets of five-word shingles (A-Z
    lower-cased, words between ASCII white space; a shorter text is one shingle). A null, empty or blank text has
    an empty set, links with nothing and is its own component. Rows that repeat an id or a text are
    documents like others; a null id is returned as it is and is nobody's smallest. Very long texts count
    whole. No documents give no rows; columns other than the two are not carried. Shingles and sets are
    known by hashes (of at least 54 and of 64 bits). Chunks number their documents in the order of docs, which must stay when a lost
    task is run again, so documents that come out of a shuffle are checkpointed first.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    bits = bucket_bits(docs)
    shingles = _shingles(stable(docs.select(key, text)), key, text, bits)
    repeated = shingles.groupBy("bucket").applyInArrow(_repeated, f"chunk long, keys array<{kind}>, n array<long>, node array<long>, payload binary")
    rows = checkpointed(repeated.groupBy("chunk").applyInArrow(_documents, f"key {kind}, n long, node long, names binary, df binary"))
    parts = parts_for(spark, rows.count(), DOCUMENTS)
    able = rows.filter(F.col("names").isNotNull())
    nodes = checkpointed(able.select("node", "n", "names", "df").dropDuplicates(["node"]), parts)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, owners = [], []
            for node, n, names, df in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens.append(_prefix(n, np.frombuffer(names, "<u8"), np.frombuffer(df, "<u2"), 0).view(np.int64))
                owners.append(np.full(len(tokens[-1]), node, dtype=np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(owners))], ["token", "node"])

    posted = nodes.mapInArrow(lean(postings), "token long, node long")
    centre = posted.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("token", "a")
    stars = posted.join(centre, "token").select("a", F.col("node").alias("b")).filter("a <> b").distinct()
    labels = connected_components(stars)
    grouped = checkpointed(nodes.join(labels, "node"), parts)
    discard(nodes)
    large = grouped.groupBy("label").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks")).filter("blocks > 1").select("label")
    heavy, united, small = [], None, grouped
    if large.limit(1).count():
        heavy = [checkpointed(grouped.join(large, "label", "left_semi"), parts)]
        united = _with_centres(heavy[0], postings, parts)
        small = grouped.join(large, "label", "left_anti")
    first = F.lit(0).cast("long")
    tasks = small.select(F.pmod("label", F.lit(1 << bits)).alias("lane"), "label", "node", "n", "names", "df", first.alias("own"), first.alias("i"), first.alias("j"))
    if united is not None:
        tasks = tasks.unionByName(_block_pairs(heavy[0], connected_components(united)))

    def verify(table: pa.Table) -> pa.Table:
        label, node, n, own = (np.array(table.column(c).to_pylist(), dtype=np.int64) for c in ("label", "node", "n", "own"))
        names, df = table.column("names").to_pylist(), table.column("df").to_pylist()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        order = np.lexsort((node, label))
        a, b = [], []
        for group in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            g = group.tolist()
            found = link(n[group].tolist(), [np.frombuffer(names[k], "<u8") for k in g], [np.frombuffer(df[k], "<u2") for k in g], own[group].tolist() if i != j else None)
            roots = found.roots(np.arange(len(g)))
            moved = np.flatnonzero(roots != np.arange(len(g)))
            a.append(node[group[roots[moved]]])
            b.append(node[group[moved]])
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    links = checkpointed(tasks.groupBy("lane", "i", "j").applyInArrow(verify, "a long, b long"), parts)
    discard(grouped, *heavy)
    links = links if united is None else links.unionByName(united)
    reached = connected_components(links)
    members = able.select("key", "node").join(reached, "node").groupBy("label").agg(F.min("key").alias("component"))
    whole = reached.join(members, "label").select("node", "component")
    alone = able.join(reached, "node", "left_anti").groupBy("node").agg(F.min("key").alias("component"))
    known = whole.unionByName(alone.select("node", "component")).withColumnRenamed("node", "known")
    result = rows.join(known, rows.node == known.known, "left")
    return result.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))
