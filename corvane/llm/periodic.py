"""Periodic runs of words, found by matching aligned blocks and extending what they seed.

A run is a maximal stretch of words with smallest period q, of at least four periods and six words. For periods from B up to 2B - 1,
B a power of two, a run holds an aligned block of B words (one that starts at a multiple of B) within its first period, and the block's
words again one and two periods on. So the aligned blocks of B words are the keys of an automaton over word numbers, the automaton
searches the text, and a block that occurs at distances q and 2q from itself, B <= q < 2B, is a seed; word by word comparison extends it
both ways. That finds every run, and nothing but runs passes the last tests.

Most texts never meet an automaton: inside a run every pair of neighbouring words comes again within q words, so only stretches in which
all pairs do are searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: A run has at least so many periods, and so many words.
PERIODS, WORDS = 4, 6
#: Aligned blocks that one automaton holds; a longer stretch is searched in pieces.
PIECE = 64
#: Integers of a key: a longer block is written as the numbers of its eighths, so that no key, and no chain of failure links, is long.
LETTERS = 8


def _stretches(flags: np.ndarray) -> np.ndarray:
    """Rows (start, end) of the stretches of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges.reshape(-1, 2)


def _equal_ahead(x: np.ndarray, y: np.ndarray) -> int:
    """How many first elements of x and y are equal; steps double, so the work follows the answer."""
    n, at, step = min(len(x), len(y)), 0, 32
    while at < n:
        differ = x[at : min(at + step, n)] != y[at : min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


class _Search:
    """The runs of one text, from small periods to large ones."""

    def __init__(self, words: np.ndarray):
        self.words, self.names, self.span = words, words, 1  # names: numbers of the stretches of ``span`` words from each word on
        self.runs: dict[tuple[int, int], int] = {}  # (start, end): period
        self.seen: dict[int, int] = {}  # the end of the last stretch extended at a period
        self.settle()

    def settle(self) -> None:
        """The runs so far, by start, each with the farthest end up to it."""
        self.spans = np.array(sorted(self.runs), np.int64).reshape(-1, 2)
        np.maximum.accumulate(self.spans[:, 1], out=self.spans[:, 1])

    def extend(self, p: int, q: int, size: int) -> None:
        """The block of ``size`` words at p, again at p + q, grows while words q apart are equal."""
        if self.seen.get(q, 0) >= p + q + size:
            return
        w = self.words
        right = _equal_ahead(w[p + size : len(w) - q], w[p + size + q :])
        left = _equal_ahead(w[:p][::-1], w[q : p + q][::-1])
        start, end = p - left, p + size + q + right
        self.seen[q] = end
        if end - start >= max(WORDS, PERIODS * q):
            # the same stretch under a smaller period was found at a smaller size: two periods have their divisor as one
            self.runs.setdefault((start, end), q)

    def name(self, span: int) -> None:
        """Numbers all stretches of ``span`` words, equal ones alike, by doubling."""
        while self.span < span:
            pair = self.names[: -self.span] * (int(self.names.max()) + 1) + self.names[self.span :]
            self.names, self.span = np.unique(pair, return_inverse=True)[1], 2 * self.span

    def blocks(self, size: int, lo: int, hi: int) -> None:
        """Seeds of the aligned blocks inside words lo to hi."""
        import ahocorasick

        at = np.arange(-(-lo // size) * size, hi - size + 1, size)
        if len(self.spans):  # a run of a smaller period around all that a block could seed leaves no other period there
            i = np.searchsorted(self.spans[:, 0], at, "right") - 1
            at = at[(i < 0) | (self.spans[np.maximum(i, 0), 1] < at + 3 * size)]
        if not len(at):
            return
        step = max(1, size // LETTERS)
        self.name(step)
        offsets = np.arange(0, size, step)
        for piece in np.split(at, range(PIECE, len(at), PIECE)):
            a, z = int(piece[0]), min(len(self.words), int(piece[-1]) + 5 * size)
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            number: dict[tuple, int] = {}
            keys = [tuple(k) for k in self.names[piece[:, None] + offsets].tolist()]
            for key in keys:
                if key not in number:
                    number[key] = len(number)
                    automaton.add_word(key, number[key])
            automaton.make_automaton()
            occurs = np.full(z - a + 4 * size, -1, np.int64)
            for phase in range(step):
                letters = tuple(self.names[a + phase : z - step + 1 : step].tolist())
                for end, key in automaton.iter(letters):
                    occurs[phase + (end - len(offsets) + 1) * step] = key
            own = np.array([number[k] for k in keys])
            ahead = np.lib.stride_tricks.sliding_window_view(occurs, size)[piece - a + size]
            rows, steps = np.nonzero(ahead == own[:, None])
            twice = occurs[piece[rows] - a + 2 * (size + steps)] == own[rows]
            rows, steps = rows[twice], steps[twice]
            p, q = piece[rows], size + steps
            whole = p + 3 * q <= len(self.words)  # all three periods from the block on must agree: looked at in a few places first
            for x in (p + size, p + q - step, p + 2 * q - step):
                last = len(self.names) - 1
                whole &= self.names[np.minimum(x, last)] == self.names[np.minimum(x + q, last)]
            rows, steps = rows[whole], steps[whole]
            for k in np.lexsort((rows, steps)).tolist():
                self.extend(int(piece[rows[k]]), size + int(steps[k]), size)


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbered words, in order."""
    n = len(words)
    if n < WORDS:
        return []
    pair = words[:-1].astype(np.int64) * (int(words.max()) + 1) + words[1:]
    order = np.argsort(pair, kind="stable")
    again = pair[order[1:]] == pair[order[:-1]]
    gap = np.full(n - 1, 2 * n, np.int64)  # from a pair of words to where it comes next
    gap[order[:-1][again]] = np.diff(order)[again]
    search, size = None, 1
    while PERIODS * size <= n:
        near = _stretches(gap < 2 * size)
        # a run of period q has length - q - 1 such pairs
        for lo, hi in near[near[:, 1] - near[:, 0] >= max(WORDS - 2, 3 * size - 1)].tolist():
            search = search or _Search(words)
            search.blocks(size, lo, min(n, hi + 2 * size))
        if search:
            search.settle()
        size *= 2
    return sorted((s, e - s, q) for (s, e), q in search.runs.items()) if search else []


def numbered(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The text's words (ASCII white space separates them) and their numbers by first occurrence."""
    words, number = text.split(), {}
    return words, np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


#: What ``find_runs`` adds.
FIELDS = [StructField(n, LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")] + [
    StructField(n, StringType()) for n in ("runs_sha256", "collapsed_sha256")
]


def _collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by spaces."""
    stay = np.ones(len(words), bool)
    for start, length, period in found:
        stay[start + period : start + length] = False
    return b" ".join(words if stay.all() else [words[i] for i in np.flatnonzero(stay).tolist()])


def _row(text: bytes | None) -> tuple:
    words, ids = numbered(text or b"")
    found = runs(ids)
    most = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    collapsed = _collapsed(words, found)
    power = 1000 * most[1] // most[2] if found else None
    return len(found), *most, power, sha256(listed.encode()).hexdigest(), sha256(collapsed).hexdigest(), collapsed.decode()


def find_runs(docs: DataFrame, *, text: str | Column = "text", keep: list[str] | None = None, collapsed: bool = False) -> DataFrame:
    """The columns ``keep`` (by default all of ``docs``), then per row: n_runs; start, length, period, exponent_milli (thousandths of length over
    period) of the longest run (ties: least start, then period; null without runs); runs_sha256 of all runs (``start,length,period`` lines by
    start, then period); collapsed_sha256 of the words that are left if each run keeps its first period; with ``collapsed`` also their text.

    A null or empty text has no words and no runs, and its digests are those of nothing. Texts are taken whole; work grows with a text's length,
    not with its square, and memory with the longest text. Repeated rows are judged each for itself, an empty table gives no rows, and columns
    of ``docs`` may have any names but those added here, which is refused.
    """
    kept = docs.columns if keep is None else keep
    fields = [*FIELDS, *([StructField("collapsed", StringType())] if collapsed else [])]
    clash = {f.name for f in fields} & set(kept)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are added here; rename or leave them out with keep")
    whole = (F.col(text) if isinstance(text, str) else text).cast("string").cast("binary")
    rows = docs.select(*kept, whole.alias("__text"))
    schema = StructType([*rows.schema.fields[:-1], *fields])
    n = len(fields)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = list(zip(*(_row(t.as_py())[:n] for t in b.column(b.num_columns - 1)), strict=True)) or [()] * n
            types = [pa.int64()] * 5 + [pa.string()] * (n - 5)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(v, t) for v, t in zip(out, types, strict=True))], names=schema.names)

    return rows.mapInArrow(batches, schema)
