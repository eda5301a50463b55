"""All terms of a lexicon in one pass: an Aho-Corasick automaton that steps through many texts at once.

The trie of all terms gets failure links and is completed to a table of transitions (state and character class to state).
Texts of a batch are cut into lanes that overlap by the longest term; all lanes take a step together, as one look-up in
the table, so the cost does not depend on the number of terms, and a long text is many lanes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Characters of a lane, and how many a batch steps through at once.
LANE, AT_ONCE = 1024, 1 << 22
#: Entries of the table of transitions: what a task holds.
MAX_ENTRIES = 1 << 27

_ASCII_LETTER = np.zeros(128, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


class Automaton:
    """Distinct non-empty terms, numbered in the order in which they are given."""

    def __init__(self, terms: Iterable[str]) -> None:
        self.terms = [t for t in dict.fromkeys(terms) if t]
        self.sizes = np.array([len(t) for t in self.terms] or [0])
        letters = sorted({c for t in self.terms for c in t})
        self.classes = np.zeros(0x110000, dtype=np.int32)  # 0: in no term
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, term in enumerate(self.terms):
            state = 0
            for c in term:
                c = int(self.classes[ord(c)])
                if c not in children[state]:
                    children[state][c] = len(children)
                    children.append({})
                    ends.append(-1)
                state = children[state][c]
            ends[state] = k
        width = len(letters) + 1
        if len(children) * width > MAX_ENTRIES:
            raise ValueError("the terms are too many for one table of transitions")
        self.table = np.zeros((len(children), width), dtype=np.int32)
        self.end = np.array(ends, dtype=np.int32)
        #: The next shorter term that ends with a state, as a state; 0 without one.
        self.shorter = np.zeros(len(children), dtype=np.int32)
        fail = [0] * len(children)
        level = []
        for c, s in children[0].items():
            self.table[0, c] = s
            level.append(s)
        while level:
            following = []
            for s in level:
                self.table[s] = self.table[fail[s]]
                f = fail[s]
                self.shorter[s] = f if self.end[f] >= 0 else self.shorter[f]
                for c, child in children[s].items():
                    fail[child] = int(self.table[s, c])
                    self.table[s, c] = child
                    following.append(child)
            level = following
        self.says = (self.end >= 0) | (self.shorter > 0)

    def _run(self, chars: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of the last character, state) of all states that say a term, for lanes [begin, end) warmed up from first."""
        order = np.argsort(first - end, kind="stable")
        first, begin, end = first[order], begin[order], end[order]
        lengths = end - first
        state = np.zeros(len(first), dtype=np.int32)
        active = len(first)
        for k in range(int(lengths[0]) if len(lengths) else 0):
            while lengths[active - 1] <= k:
                active -= 1
            at = first[:active] + k
            state[:active] = now = self.table[state[:active], chars[at]]
            said = np.flatnonzero(self.says[now])
            if len(said):
                said = said[at[said] >= begin[said]]
                if len(said):
                    yield at[said], now[said]

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every place of every term: text, term, start in the text, and whether no letter of a-z stands beside it; by text, term, start."""
        found: list[list[np.ndarray]] = [[], [], [], []]
        k = 0
        while k < len(texts) and self.terms:
            upto, size = k, 0
            while upto < len(texts) and (upto == k or size + len(texts[upto]) <= AT_ONCE):
                size += len(texts[upto])
                upto += 1
            for own, new in zip(found, self._part(texts[k:upto], k), strict=True):
                own.append(new)
            k = upto
        empty = [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=bool)]
        return tuple(np.concatenate([*own, e]) for own, e in zip(found, empty, strict=True))

    def _part(self, texts: list[str], offset: int) -> list[np.ndarray]:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars = self.classes[codes]
        stops = np.cumsum([len(t) for t in texts])
        starts = stops - [len(t) for t in texts]
        lanes = -(-(stops - starts) // LANE)
        begin = np.repeat(starts, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        low, high = np.repeat(starts, lanes), np.repeat(stops, lanes)
        places, states = [], []
        for at, now in self._run(chars, np.maximum(low, begin - int(self.sizes.max()) + 1), begin, np.minimum(high, begin + LANE)):
            while len(at):
                mine = self.end[now] >= 0
                places.append(at[mine])
                states.append(now[mine])
                now = self.shorter[now]
                at, now = at[now > 0], now[now > 0]
        last = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
        term = self.end[np.concatenate([*states, np.zeros(0, np.int32)])].astype(np.int64)
        start = last + 1 - self.sizes[term]
        text = np.searchsorted(stops, start, side="right")
        letter = lambda k: np.where(codes[k] < 128, _ASCII_LETTER[np.minimum(codes[k], 127)], False)
        before, behind = start > starts[text], last + 1 < stops[text]
        apart = ~(before & letter(np.maximum(start - 1, 0))) & ~(behind & letter(np.minimum(last + 1, len(codes) - 1))) if len(codes) else np.zeros(0, dtype=bool)
        order = np.lexsort((start, term, text))
        return [x[order] for x in (text + offset, term, start - starts[text], apart)]


def disjoint(starts: Iterable[int], size: int) -> Iterator[int]:
    """Of ascending starts those that do not overlap one that is taken."""
    free = 0
    for s in starts:
        if s >= free:
            yield s
            free = s + size
