"""Personal data: rule-based base spans, and further spans that gradient-boosted trees select.

Base spans are e-mail addresses, IPv4 addresses, card numbers that pass the Luhn check, and phone numbers with a
plus sign. High-recall generators propose further spans, which overlap: from each group of digits all continuations over
up to ``GROUPS`` groups in any of the usual notations; addresses written around the at sign; IPv6 addresses; account numbers;
and long tokens that mix letters and digits, as keys and passwords do. Boosted trees look at format and context of a candidate,
never at the rule that made it; a calibrated threshold selects. A selected span is added where it overlaps no base
span and no better candidate.

There are no labels for personal data, so the trees learn from a bounded sample of the corpus' own candidates
that the base rules can judge (matches; spans that cut a match; matches that the rules' checks reject), with the leading mark that
tells the base notation taken away from half of them, and from examples that a fixed grammar writes. What the base rules
know nothing about is left out of the sample. The threshold is the lowest at which ``PRECISION`` of the held-out examples
above it are right.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import checkpointed, lean

#: The base kinds, and those that only trees add.
KINDS = ("email", "ip", "card", "phone", "secret", "iban")
BASE = 4
SAMPLE = 4000
#: Groups of digits in a candidate, and its digits.
GROUPS, FEWEST_DIGITS, MOST_DIGITS = 8, 7, 19
#: The shortest token that may be a secret.
SHORTEST_SECRET = 12
PRECISION = 0.98
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 16

Span = tuple[int, int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_BETWEEN = frozenset(" ().-/")
_TOKEN_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-"
_TOKEN = re.compile(r"[A-Za-z0-9_+/-]+")
_CAPITALS = re.compile(r"(?<![\w+/-])[A-Z]{16,}(?![\w+/-])")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])")
_SECRET_WORDS = re.compile(r"(?i)pass(?:word|wd|phrase)?|pwd|token|secret|api.?key|access.?key|private|bearer|credential|auth")
_WIDE_AT = re.compile(r"[A-Za-z0-9._+-]{2,64}\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{2,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,12}){1,4}")
_WORDS = re.compile(r"(?i)tel|phone|call|fax|mobile|cell|card|visa|ip|server|host|mail|contact|iban|account|address")
_LEAD = re.compile(r"[A-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the four base kinds; leftmost and non-overlapping in each kind, in time linear in the text.

    Each kind starts at a maximal run (of local-part characters before an at sign, of digits) or at a plus sign,
    which is where a leftmost match can begin.
    """
    out: list[Span] = []
    at, low = text.find("@"), 0
    while at >= 0:
        head = text[low:at]
        start = low + len(head.rstrip(_LOCAL))
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((0, start, match.end()))
            low = match.end()
            at = text.find("@", low)
        else:
            low = at + 1
            at = text.find("@", low)
    ip = card = 0
    for run in _DIGITS.finditer(text):
        start = run.start()
        if start >= ip and (match := _IP.match(text, start)):
            ip = match.end()
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in match.groups()):
                out.append((1, start, ip))
        if start >= card and (match := _CARD.match(text, start)):
            card = match.end()
            digits = match[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, start, card))
    for match in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum("0" <= c <= "9" for c in match[0]) <= 15:
            out.append((3, *match.span()))
    return sorted(out)


def candidates(text: str) -> list[Span]:
    """High-recall proposals; the kind is a guess from the notation."""
    out = []
    if "@" in text or " at " in text or "(at)" in text or "[at]" in text:
        for anchor in re.finditer(r"@|\(at\)|\[at\]|\x20at\x20", text):
            low = max(0, anchor.start() - 66)
            for match in _WIDE_AT.finditer(text, low, min(len(text), anchor.end() + 160)):
                if match.start() <= anchor.start() < match.end():
                    out.append((0, *match.span()))
                    break
    if text.count(":") > 2:
        out += [(1, *m.span()) for m in _IPV6.finditer(text)]
    out += [(4, *m.span()) for m in _CAPITALS.finditer(text)]
    groups = [m.span() for m in _DIGITS.finditer(text)]
    low = 0
    for k, (first, _) in enumerate(groups):
        start = first - (first > 0 and text[first - 1] in "(+")
        digits = 0
        for j in range(k, min(k + GROUPS, len(groups))):
            if j > k and (groups[j][0] - groups[j - 1][1] > 2 or not _BETWEEN.issuperset(text[groups[j - 1][1] : groups[j][0]])):
                break
            digits += groups[j][1] - groups[j][0]
            if digits > MOST_DIGITS:
                break
            if digits >= FEWEST_DIGITS:
                quad = j - k == 3 and text[groups[k][0] : groups[j][1]].count(".") == 3
                out.append((1 if quad else 2 if digits >= 14 else 3, start, groups[j][1]))
        if first >= low:
            head = text[low:first]
            start = first - (len(head) - len(head.rstrip(_TOKEN_CHARACTERS)))
            low = _TOKEN.match(text, start).end()
            if low - start >= SHORTEST_SECRET and not text[start:low].replace("-", "").replace("/", "").replace("+", "").replace("_", "").isdigit():
                out.append((4, start, low))
        if first >= 2 and text[first - 2 : first].isupper() and (match := _ACCOUNT.match(text, first - 2)):
            out.append((5, *match.span()))
    return out


NAMES = (
    "kind", "length", "digits", "groups", "shortest", "longest", "spaces", "dashes", "dots", "slashes", "brackets", "letters", "luhn", "glued_left", "glued_right", "word_near", "octets", "first_group", "last_group",
    "at_words", "equal_groups", "plus", "digit_before", "digit_after", "capitals", "colons", "hexadecimal", "secret_word", "assigned", "account", "separators", "opens_alike", "new_sentence",
)


def _account(body: str) -> bool:
    """The check digits of an account number."""
    plain = body.replace(" ", "")
    return 15 <= len(plain) <= 34 and plain.isascii() and plain.isalnum() and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def features(text: str, span: Span, hide: bool = False) -> list[float]:
    """Format and context of a candidate; ``hide`` leaves out a plus sign."""
    kind, start, end = span
    body = text[start:end]
    groups = _DIGITS.findall(body)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    context = text[max(0, start - 32) : start]
    left, right = text[max(0, start - 1) : start], text[end : end + 1]
    separators = {text[k] for k in range(start, end) if text[k] in " .-/"} if kind in (1, 2, 3) else ()
    return [
        kind, min(end - start, 80), len(digits), len(groups), min(sizes), max(sizes), body.count(" "), body.count("-"), body.count("."), body.count("/"),
        body.count("(") + body.count(")"), sum(c.isalpha() for c in body[:80]), float(len(digits) >= 12 and luhn(digits)), float(bool(_LEAD.match(left)) or left in ("=", ".", "-", "_", "#", "/")), float(bool(_LEAD.match(right)) or right in ("_", "%", "-", "/")),
        float(bool(_WORDS.search(context))), float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)), sizes[0], sizes[-1], float("at" in body and "@" not in body), float(len(set(sizes)) == 1), 0.0 if hide else body.count("+"),
        float(text[max(0, start - 2) : start].strip()[:1].isdigit()), float(text[end : end + 2].strip()[-1:].isdigit()), sum("A" <= c <= "Z" for c in body[:80]), body[:80].count(":"), float(kind == 4 and all(c in "0123456789abcdefABCDEF" for c in body[:80])),
        float(bool(_SECRET_WORDS.search(context))), float(context.rstrip(" \"'")[-1:] in ("=", ":")), float(kind == 5 and _account(body)), len(separators), float(body[:4].isupper() and body[:4].isalpha()), float(". " in body),
    ]


def grammar(n: int = 3000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Examples in notations that a corpus may lack, whole spans against spans that cut or join them; the same at every call."""
    g = np.random.Generator(np.random.PCG64(seed))
    d = lambda k: "".join(map(str, g.integers(0, 10, k)))
    of = lambda letters, k: "".join(letters[x] for x in g.integers(0, len(letters), k))
    word = lambda: of("abcdefghijklmnopqrstuvwxyz", int(g.integers(3, 9)))
    pick = lambda x: x[g.integers(0, len(x))]
    upper, hexadecimal, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def account() -> str:
        country, body = pick(["DE", "FR", "GB", "ES", "NL"]), d(int(g.integers(12, 19)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        whole = f"{country}{check:02d}{body}"
        return whole if g.integers(0, 2) else " ".join(whole[k : k + 4] for k in range(0, len(whole), 4))

    number = [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: " ".join(["0" + d(1), d(2), d(2), d(2), d(2)]), lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{d(3)}/{d(6)}"]
    secret = [
        lambda: pick(["password", "passwd", "pwd", "token", "api_key", "secret", "auth_token"]) + pick(["=", ": ", ' = "', "='", " = "]) + "\0" + of(pick([hexadecimal, mixed]), int(g.integers(14, 48))),
        lambda: pick(["", "key ", "the ", "of "]) + "\0" + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4) + of(upper, 16), lambda: "Bearer \0" + of(mixed, int(g.integers(24, 60))),
    ]
    good = [*number, *number, lambda: f"{word()}.{word()} (at) {word()}.com", lambda: f"{word()}[at]{word()}[dot]org", lambda: f"{word()}{d(2)} at {word()} dot net", account, *secret, *secret, lambda: ":".join(of(hexadecimal, 4) for _ in range(8))]
    bad = [
        lambda: f"20{d(2)}-0{d(1)}-1{d(1)} 1{d(1)}", lambda: d(7), lambda: d(12), lambda: f"{d(1)}.{d(2)}.{d(2)}.{d(4)}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{d(2)}/{d(2)}/20{d(2)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{word()}{d(9)}{word()}",
        lambda: f"{word()} at {word()}. {word().title()}", lambda: d(16), lambda: f"{d(4)}-{d(4)}", lambda: f"id={of(hexadecimal, int(g.integers(16, 41)))}", lambda: f"commit {of(hexadecimal, 40)}", lambda: f"{of(hexadecimal, 8)}-{of(hexadecimal, 4)}-{of(hexadecimal, 4)}-{of(hexadecimal, 4)}-{of(hexadecimal, 12)}",
        lambda: f"/{word()}/{word()}/{word()}{d(4)}", lambda: f"{word()}_{word()}_{d(3)}", lambda: f"{of(upper, 3)}-{d(5)}-{of(upper, 4)}", lambda: f"1{d(1)}:{d(2)}:{d(2)}:{d(2)}",
        lambda: (word() + word() + word() + word()).upper(), lambda: (word() + word() + word() + word()).upper(),
    ]
    lead = ["tel: ", "phone ", "call me on ", "mail ", "", "", "the ", "of ", "is "]
    x, y = [], []
    for k in range(n):
        label = k % 2
        text = f"{word()} {pick(lead) if label else pick(['the ', 'no. ', 'of ', 'id=', '', 'v'])}"
        made = pick(good if label else bad)()
        before, _, body = made.rpartition("\0")
        start = len(text) + len(before)
        after = pick([f" {word()}", ".", ", ", '" ', f" {pick(number)()}" if label else ""]) if label else f" {word()}"
        whole = f"{text}{before}{body}{after}"
        right = (start, start + len(body))
        own = [s for s in candidates(whole) if s[1] < right[1] and s[2] > right[0]]
        exact = [s for s in own if s[1:] == right]
        others = sorted((s for s in own if s[1:] != right), key=lambda s: s[1] - s[2])
        if label and exact:
            x.append(features(whole, exact[-1]))
            y.append(1)
            others = others[: 1 + len(others) // 4]
        for s in others if label else own:
            x.append(features(whole, s))
            y.append(0)
    return np.array(x, dtype=float).reshape(-1, len(NAMES)), np.array(y, dtype=float)


@dataclass
class Forest:
    """Boosted regression trees of one depth: edges of bins, then for each tree feature and bin of every node, and leaf values."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float
    threshold: float = 1.0
    slope: float = 1.0
    shift: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray) -> Forest:
    """Gradient boosting with the logistic loss, Newton leaf values, splits over quantile bins."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(len(NAMES))]
    p = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
    nodes, leaves = 2**DEPTH - 1, 2**DEPTH
    forest = Forest(edges, np.zeros((0, nodes), dtype=np.int64), np.zeros((0, nodes), dtype=np.int64), np.zeros((0, leaves)), float(np.log(p / (1 - p))))
    if not 0 < y.sum() < len(y):
        return forest
    b = forest.bins(x)
    f = np.full(len(x), forest.start)
    trees = []
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, q * (1 - q)
        node = np.zeros(len(x), dtype=np.int64)
        feature, cut = np.zeros(nodes, dtype=np.int64), np.full(nodes, BINS, dtype=np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == k)
                if len(own) < 8:
                    continue
                best = 1e-6
                for j in range(x.shape[1]):
                    sg = np.cumsum(np.bincount(b[own, j], weights=g[own], minlength=BINS + 1))
                    sh = np.cumsum(np.bincount(b[own, j], weights=h[own], minlength=BINS + 1))
                    gain = sg**2 / (sh + 1) + (sg[-1] - sg) ** 2 / (sh[-1] - sh + 1) - sg[-1] ** 2 / (sh[-1] + 1)
                    c = int(np.argmax(gain))
                    if gain[c] > best:
                        best, feature[k], cut[k] = float(gain[c]), j, c
            node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > cut[node])
        at = node - nodes
        leaf = RATE * np.bincount(at, weights=g, minlength=leaves) / (np.bincount(at, weights=h, minlength=leaves) + 1)
        f = f + leaf[at]
        trees.append((feature, cut, leaf))
    forest.feature, forest.cut, forest.leaf = (np.stack(t) for t in zip(*trees, strict=True))
    return forest


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Trees on two thirds of the examples; calibration and threshold on the others."""
    held = np.arange(len(x)) % 3 == 2
    forest = boost(x[~held], y[~held])
    raw, truth = forest.raw(x[held]), y[held]
    if not 0 < truth.sum() < len(truth):
        return forest
    theta = np.array([1.0, 0.0])
    z = np.stack([raw, np.ones(len(raw))], 1)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + np.eye(2), z.T @ (q - truth) + (theta - [1, 0]))
        theta = theta - step / max(1.0, np.abs(step).max())
    forest.slope, forest.shift = float(max(theta[0], 1e-3)), float(theta[1])
    p = forest.probability(x[held])
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero((right >= PRECISION) & (p[order] >= 0.5))
    forest.threshold = float(p[order][good[-1]]) if len(good) else 1.0
    return forest


def train(docs: DataFrame, text: str = "text") -> Forest:
    """From the grammar and a bounded sample of candidates of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, rows, labels = [], [], []
            for t in batch.column(0).to_pylist():
                if not t or ("@" not in t and not _DIGITS.search(t)):
                    continue
                base = base_spans(t)
                starts = [b[1] for b in sorted(base, key=lambda b: b[1])]
                ordered = sorted(base, key=lambda b: b[1])
                for s in candidates(t):
                    near = [b for b in ordered[max(0, bisect.bisect_left(starts, s[1]) - 2) : bisect.bisect_left(starts, s[2])] if b[1] < s[2] and s[1] < b[2]]
                    body = t[s[1] : s[2]]
                    rejected = not near and (_IP.fullmatch(body) or (_CARD.fullmatch(body) and s[0] == 2) or _PHONE.fullmatch(body))
                    if s[0] >= BASE or not (near or rejected):
                        continue  # the base rules know nothing about it
                    mark = hashlib.md5(f"{s[0]}:{t[max(0, s[1] - 32) : s[2] + 8]}".encode()).digest()
                    marks.append(int.from_bytes(mark[:8], "little", signed=True))
                    rows.append(features(t, s, hide=mark[8] % 2 == 0))
                    labels.append(float(any(b[1:] == s[1:] for b in near)))
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64())], ["mark", "x", "y"])

    found = checkpointed(docs.select(F.col(text)).mapInArrow(lean(run), "mark long, x array<double>, y double").dropDuplicates(["mark"]).orderBy("mark").limit(SAMPLE)).toPandas()
    x, y = grammar()
    if len(found):
        x = np.concatenate([x, np.array(found["x"].tolist(), dtype=float)])
        y = np.concatenate([y, found["y"].to_numpy()])
    order = np.random.Generator(np.random.PCG64(5)).permutation(len(x))
    return fit(x[order], y[order])


def add_spans(text: str, base: list[Span], forest: Forest) -> list[Span]:
    """The base spans and the selected candidates, by kind and start; in time n log n of the candidates."""
    own = _apart(candidates(text), base)
    if own:
        p = forest.probability(np.array([features(text, s) for s in own], dtype=float))
        starts: list[int] = []  # of what is taken, which does not overlap
        ends: list[int] = []
        taken = []
        for k in np.lexsort((-np.array([s[2] - s[1] for s in own]), -np.round(p, 3))).tolist():  # of equals the longest
            if p[k] < forest.threshold:
                continue
            at = bisect.bisect_left(starts, own[k][2])
            if at and ends[at - 1] > own[k][1]:
                continue
            starts.insert(at, own[k][1])
            ends.insert(at, own[k][2])
            taken.append(own[k])
        base = base + taken
    return sorted(base)


def _apart(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that overlap no base span."""
    merged: list[list[int]] = []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [m[0] for m in merged]
    out = []
    for s in spans:
        at = bisect.bisect_left(starts, s[2])
        if not at or merged[at - 1][1] <= s[1]:
            out.append(s)
    return out


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", forest: Forest | None = None, redact: bool = False) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) and, with redact, redacted: one row for each input row.

    Counts by kind and digest are of the base spans; ``spans`` and n_spans have the added ones too. Positions are code points. A null text is
    an empty one; a null key stays; whatever repeats is scanned row by row; texts of any length are scanned
    whole. Columns other than the two are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest or train(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                t = t or ""
                base = base_spans(t)
                every = add_spans(t, base, shared.value)
                counts = [sum(s[0] == k for s in base) for k in range(4)]
                row = [*counts, hashlib.sha256(spell(base).encode()).hexdigest(), spell(every), len(every)]
                if redact:
                    pieces, at = [], 0
                    for k, a, b in sorted(every, key=lambda s: (s[1], -s[2])):
                        if a >= at:
                            pieces += [t[at:a], f"<{KINDS[k]}>"]
                        at = max(at, b)
                    row.append("".join([*pieces, t[at:]]))
                rows.append(row)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] + [pa.string()] * redact
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], ["key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", *["redacted"] * redact])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long{', redacted string' * redact}"
    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), schema).withColumnRenamed("key", key)
