"""Periodic run detection: stretches of a text that repeat with a period, found from squares.

A suffix automaton reads a text word by word. Its suffix links form a tree in which every state knows, as a colour, where
its substrings last ended. Each appended word recolours the path from its state to the root: the states above that share a
colour are one segment, kept as a splay tree, and a link-cut access meets each segment of the path once. A segment whose
substrings last ended `d` words before, and whose longest has `d` words or more, closes a square of period `d`. The
segments met over a whole text are n log n. A square not inside a known run of its period is extended both ways to a run.

A run of 12 words or more repeats six words within itself, and every word of it lies in such six. So only stretches of
words that lie in a six that the text repeats are read by an automaton; nearly all texts have few of them.
"""

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.batches import slices, with_columns
from siftwell.llm.shared import ship, words

LEAST_WORDS = 12
RUN = "array<struct<start: long, length: long, period: long>>"

_MIX = np.uint64(0x9E3779B97F4A7C15)
# How far an extension looks at first; each further look is twice as long.
LOOK = 64


class Squares:
    """Suffix automaton of a growing sequence; `append` gives the primitive periods of the squares that end there.

    States are numbers from 1, the root. Most have one transition, which is kept in two arrays; others have a dict.
    """

    def __init__(self):
        self.size, self.link = array("q", [0, 0]), array("q", [0, 0])
        self.symbol, self.target, self.more = array("q", [-1, -1]), array("q", [0, 0]), {}
        # The link-cut forest over suffix links: children and parent in splay trees, and the colour of a tree at its root.
        self.left, self.right, self.up, self.colour = array("q", [0, 0]), array("q", [0, 0]), array("q", [0, 0]), array("q", [0, 0])
        self.last, self.n = 1, 0

    def _state(self, size: int) -> int:
        self.size.append(size)
        self.symbol.append(-1)
        for a in (self.link, self.target, self.left, self.right, self.up, self.colour):
            a.append(0)
        return len(self.size) - 1

    def _next(self, state: int, word: int) -> int:
        if self.symbol[state] == word:
            return self.target[state]
        more = self.more.get(state)
        return more.get(word, 0) if more else 0

    def _set(self, state: int, word: int, target: int) -> None:
        if self.symbol[state] in (-1, word):
            self.symbol[state], self.target[state] = word, target
        else:
            self.more.setdefault(state, {})[word] = target

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]

    def _splay(self, x: int) -> None:
        """Make x the root of its segment's tree."""
        left, right, up = self.left, self.right, self.up
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                self._rotate(p if (left[p] == x) == (left[g] == p) else x)
            self._rotate(x)

    def append(self, word: int) -> list[int]:
        self.n += 1
        size, link = self.size, self.link
        new = self._state(self.n)
        p = self.last
        while p and not self._next(p, word):
            self._set(p, word, new)
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = self._next(p, word)
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                link[new] = self._split(p, q, word)
        self.up[new] = link[new]
        self.last = new
        return self._access(new)

    def _split(self, p: int, q: int, word: int) -> int:
        """A state for the shorter substrings of q, between q and its parent, with q's colour."""
        clone = self._state(self.size[p] + 1)
        self.symbol[clone], self.target[clone] = self.symbol[q], self.target[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self._splay(q)
        above = self.left[q]
        if above:
            self.left[q] = 0
            self.up[above], self.colour[above] = self.up[q], self.colour[q]
        self.colour[clone] = self.colour[q]
        parent = self.link[q]
        self.link[clone] = self.up[clone] = parent
        self.link[q] = self.up[q] = clone
        while p and self._next(p, word) == q:
            self._set(p, word, clone)
            p = self.link[p]
        return clone

    def _access(self, x: int) -> list[int]:
        size, right, up, colour, n = self.size, self.right, self.up, self.colour, self.n
        periods, below = [], 0
        while x:
            self._splay(x)
            ended = colour[x]
            if ended and n - ended <= size[x]:
                periods.append(n - ended)
            if right[x]:
                colour[right[x]] = ended
            right[x] = below
            below, x = x, up[x]
        colour[below] = n
        return periods


def _same(ids: np.ndarray, period: int, at: int, step: int) -> int:
    """How many words from `at` on, in this direction, equal the one a period later."""
    found, look = 0, LOOK
    while True:
        if step > 0:
            here = ids[at + found : max(at + found, min(at + found + look, len(ids) - period))]
            there = ids[at + found + period :][: len(here)]
        else:
            here = ids[max(0, at - found - look + 1) : max(0, at - found + 1)][::-1]
            there = ids[max(0, at - found - look + 1) + period : max(0, at - found + 1) + period][::-1]
        differ = np.flatnonzero(here != there)
        if len(differ):
            return found + int(differ[0])
        found += len(here)
        if len(here) < look:
            return found
        look *= 2


def _stretches(ids: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Where words lie in a group of `width` that occurs more than once; equal hashes of unlike groups only add some."""
    places = len(ids) - width + 1
    if places < 2:
        return
    h = np.zeros(places, np.uint64)
    for k in range(width):
        h = (h ^ ids[k : k + places].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(31)
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    if not len(at):
        return
    breaks = np.flatnonzero(np.diff(at) > width)
    for a, b in zip(at[np.append(0, breaks + 1)], at[np.append(breaks, len(at) - 1)]):
        yield int(a), int(b) + width


def runs(ids: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """start, length and smallest period of every run of at least `least` words and two periods, by start and period."""
    out = []
    for begin, end in _stretches(ids, max(1, least // 2)):
        part = ids[begin:end]
        squares, known = Squares(), {}
        for i, word in enumerate(part.tolist()):
            for d in squares.append(word):
                if i <= known.get(d, -1):
                    continue
                first = i - 2 * d + 1
                before, after = _same(part, d, first - 1, -1), _same(part, d, i - d + 1, 1)
                known[d] = i + after
                if 2 * d + before + after >= least:
                    out.append((begin + first - before, 2 * d + before + after, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words no run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:n] == 0


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """`docs` with `runs`, all runs of each whole text by start and period, and `collapsed`, its words without repetitions.

    A run is a stretch of consecutive words with a smallest period, at least two periods and `least` words long, that no
    neighbouring word extends. `collapsed` has the words that no run contains after its first period, joined by a space.
    Null and empty texts have no runs and an empty `collapsed`. Columns of these names are replaced, others are passed
    on; repeated rows are each answered; an empty table gives an empty one. A text is one task's work.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found, left = [], []
                for raw in part.column(text).cast(pa.binary()).to_pylist():
                    parts, known = raw.split() if raw else [], {}
                    ids = np.array([known.setdefault(w, len(known)) for w in parts], np.int64)
                    here = runs(ids, least) if len(ids) > len(known) else []
                    if here:
                        parts = [parts[i] for i in np.flatnonzero(_kept(len(ids), here))]
                    found.append([dict(zip(("start", "length", "period"), r)) for r in here])
                    left.append(b" ".join(parts).decode())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield with_columns(part, runs=pa.array(found, kind), collapsed=pa.array(left, pa.string()))

    kept = [f for f in docs.schema.fields if f.name not in ("runs", "collapsed")]
    added = T.StructType.fromDDL(f"runs {RUN}, collapsed string").fields
    return docs.mapInArrow(run, T.StructType([*kept, *added]))


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a repetition of the contract's kind in one document of ten, told by the checksum of its doc_id."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def rewritten(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(at, lambda i: F.get(w, i.cast("int"))), " ")

    # The words are split once, as the only element of an array.
    made = F.element_at(F.transform(F.array(words(text)), lambda w: F.when(F.size(w) > 0, rewritten(w)).otherwise("")), 1)
    return F.when(h % 10 == 0, made).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    found = collapse(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"), F.floor(F.col("best.l") * 1000 / (-F.col("best.p"))).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join("lines", "\n"), F.when(F.size("lines") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
