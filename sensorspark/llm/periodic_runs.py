"""Stretches of words that repeat with a period, found by convolution of blocks.

A run is a stretch of consecutive words whose smallest period q fills it at least four times (and
at least six words) and which no neighbouring word extends.  Periods are searched at dyadic scales:
at scale B, those from B to 2B - 1.  The text is cut into blocks of B words; a run of such a period
holds several whole blocks, and each of them occurs again q words later.  For every block the
squared differences with the 2B words after it are summed at all B distances at once, as a product
of polynomials modulo primes (number-theoretic transform, whole numbers only).  Enough primes are
taken that a sum divisible by all of them can only be zero.  Zeros at one distance in consecutive
blocks form a seed, and comparing words at that distance to its left and right completes the run.
A zero inside a run found at a smaller scale is a multiple of that run's period and is dropped.

The work is O(n log² n) for n words.  Texts of one Arrow batch share the transforms; blocks never
cross texts.

Defined results: null and empty texts have no words, no run and an empty collapsed text; repeated
rows and null ids are treated like any others; an empty table gives an empty table; columns of any
name are kept and the result's name gets underscores in front until it is free.
"""

from __future__ import annotations

from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import free_name, text_of

MIN_REPEATS = 4
MIN_WORDS = 6
# Primes k · 2^m + 1 below 2^31 and a generator of each.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
# Numbers per transform, so that its temporary arrays stay in a core's cache.
CELLS = 1 << 15
WORD = r"[^\x20\x09-\x0D]+"

RUN = "struct<start:bigint,length:bigint,period:bigint>"
RESULT = f"struct<n_words:bigint,runs:array<{RUN}>,collapsed:string>"


# --- transforms modulo a prime --------------------------------------------------------------


def _mod(x: np.ndarray, prime: int) -> np.ndarray:
    p = np.uint64(prime)
    return x - (x // p) * p


@cache
def _roots(size: int, prime: int, generator: int, inverse: bool) -> np.ndarray:
    """The first size/2 powers of a root of unity of order ``size``, as a column."""
    root = pow(generator, (prime - 1) // size, prime)
    if inverse:
        root = pow(root, prime - 2, prime)
    powers = np.ones(max(size // 2, 1), np.uint64)
    filled, step = 1, root
    while filled < len(powers):
        powers[filled : 2 * filled] = _mod(powers[:filled] * np.uint64(step), prime)
        step = step * step % prime
        filled *= 2
    return powers[:, None]


def forward(a: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Transforms every column of ``a`` in place; coefficients come out bit-reversed."""
    size, columns = a.shape
    p = np.uint64(prime)
    half = size // 2
    while half:
        pairs = a.reshape(-1, 2, half, columns)
        low, high = pairs[:, 0], pairs[:, 1]
        total = low + high
        high[...] = _mod((low + (p - high)) * _roots(2 * half, prime, generator, False), prime)
        low[...] = np.minimum(total, total - p)
        half //= 2
    return a


def backward(a: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The inverse of ``forward``, in place."""
    size, columns = a.shape
    p = np.uint64(prime)
    half = 1
    while half < size:
        pairs = a.reshape(-1, 2, half, columns)
        low, high = pairs[:, 0], pairs[:, 1]
        turned = _mod(high * _roots(2 * half, prime, generator, True), prime)
        total, rest = low + turned, low - turned
        low[...] = np.minimum(total, total - p)
        high[...] = np.minimum(rest, rest + p)
        half *= 2
    return _mod(a * np.uint64(pow(size, prime - 2, prime)), prime)


def zero_distances(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """True where a block (a column of B numbers) equals the B numbers of its window from row i on.

    ``windows`` has 2B rows; row i of the result says whether the squared differences add to zero.
    """
    size = len(blocks)
    columns = np.arange(blocks.shape[1])
    equal = np.zeros((size, blocks.shape[1]), bool)
    largest = int(max(blocks.max(initial=0), windows.max(initial=0)))
    bound, covered = size * largest * largest, 1
    for prime, generator in PRIMES:
        x, y = blocks[:, columns], windows[:, columns]
        if largest >= prime:
            x, y = _mod(x, prime), _mod(y, prime)
        squares = np.zeros((2 * size + 1, len(columns)), np.uint64)
        np.cumsum(_mod(y * y, prime), axis=0, out=squares[1:])
        both = _mod(x * x, prime).sum(axis=0, dtype=np.uint64) + squares[size : 2 * size] - squares[:size]
        flipped = np.zeros_like(y)
        flipped[:size] = x[::-1]
        product = _mod(forward(flipped, prime, generator) * forward(y.copy(), prime, generator), prime)
        mixed = backward(product, prime, generator)[size - 1 : 2 * size - 1]
        zero = _mod(both, prime) == _mod(mixed + mixed, prime)
        equal[:, columns] = equal[:, columns] & zero if covered > 1 else zero
        covered *= prime
        if covered > bound:
            return equal
        # Only columns that still hold a zero need another prime.
        columns = columns[equal[:, columns].any(axis=0)]
        if not len(columns):
            return equal
    raise ValueError(f"{size} words with numbers up to {largest}: more primes are needed")


# --- runs of many texts at once -------------------------------------------------------------


class _Found:
    """Runs of the smaller scales, to ask whether one of them holds a stretch."""

    def __init__(self) -> None:
        self.start = self.stop = self.period = np.zeros(0, np.int64)
        self.reach = self.stop

    def add(self, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> None:
        start, stop = np.concatenate([self.start, start]), np.concatenate([self.stop, stop])
        order = np.argsort(start, kind="stable")
        self.start, self.stop = start[order], stop[order]
        self.period = np.concatenate([self.period, period])[order]
        self.reach = np.maximum.accumulate(self.stop) if len(order) else self.stop

    def holds(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(len(start), bool)
        last = np.searchsorted(self.start, start, side="right") - 1
        return (last >= 0) & (self.reach[np.maximum(last, 0)] >= stop)


def _seeds(
    padded: np.ndarray, size: int, at: np.ndarray, end: np.ndarray, found: _Found
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, end of its text, distance) of the zeros that no smaller run explains."""
    out = []
    step = max(1, CELLS // (2 * size))
    rows = np.arange(2 * size)[:, None]
    for first in range(0, len(at), step):
        here, until = at[first : first + step], end[first : first + step]
        windows = padded[here + size + rows]
        zero = zero_distances(padded[here + rows[:size]], windows)
        zero &= rows[:size] <= until - here - 2 * size
        shift, column = np.nonzero(zero)
        block, distance = here[column], shift + size
        new = ~found.holds(block, block + size + distance)
        out.append((block[new], until[column][new], distance[new]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*out))


def _same_words(padded: np.ndarray, at: np.ndarray, step: int, limit: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How many words from ``at`` on, in direction ``step``, equal those a period later."""
    out = np.zeros(len(at), np.int64)
    width = int(limit.max(initial=0))
    if not width:
        return out
    ahead = np.arange(width)
    rows = max(1, CELLS // width)
    for first in range(0, len(at), rows):
        part = slice(first, first + rows)
        inside = ahead < limit[part, None]
        place = np.where(inside, at[part, None] + step * ahead, 0)
        same = inside & (padded[place] == padded[place + np.where(inside, period[part, None], 0)])
        out[part] = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
    return out


def find_runs(numbers: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of all runs; text t is ``numbers[offsets[t]:offsets[t + 1]]``.

    Equal numbers of one text stand for equal words.  Positions count over all texts.
    """
    found = _Found()
    lengths = np.diff(offsets)
    longest = int(lengths.max(initial=0))
    size = 1
    while longest >= max(MIN_WORDS, MIN_REPEATS * size):
        texts = np.flatnonzero(lengths >= max(MIN_WORDS, MIN_REPEATS * size))
        count = lengths[texts] // size - 1
        begin = np.repeat(offsets[texts], count)
        end = np.repeat(offsets[texts + 1], count)
        nth = np.arange(len(begin)) - np.repeat(np.cumsum(count) - count, count)
        padded = np.concatenate([numbers, np.zeros(2 * size, numbers.dtype)])
        block, until, distance = _seeds(padded, size, begin + nth * size, end, found)
        order = np.lexsort((block, distance))
        block, until, distance = block[order], until[order], distance[order]
        opens = np.ones(len(block), bool)
        opens[1:] = (distance[1:] != distance[:-1]) | (block[1:] != block[:-1] + size)
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(block))[: len(first)] - 1
        # A run leaves so many whole blocks with an equal block one period later.
        enough = last - first + 1 >= ((MIN_REPEATS - 1) * distance[first] - size + 1) // size
        first, last = first[enough], last[enough]
        left, right, period, until = block[first], block[last] + size, distance[first], until[first]
        text = offsets[np.searchsorted(offsets, left, side="right") - 1]
        left = left - _same_words(padded, left - 1, -1, np.minimum(left - text, size), period)
        right = right + _same_words(padded, right, 1, np.clip(until - period - right, 0, size), period)
        stop = right + period
        long = stop - left >= np.maximum(MIN_WORDS, MIN_REPEATS * period)
        found.add(left[long], stop[long], period[long])
        size *= 2
    return found.start, found.stop, found.period


def _number(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))


def examine(texts: list[bytes]) -> pa.StructArray:
    """The ``RESULT`` of each text."""
    words = [t.split() for t in texts]
    numbers = [_number(w) for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    flat = np.concatenate(numbers) if numbers else np.zeros(0, np.uint64)
    start, stop, period = find_runs(flat, offsets)
    order = np.lexsort((period, start))
    start, stop, period = start[order], stop[order], period[order]
    text = np.searchsorted(offsets, start, side="right") - 1
    # Words after a run's first period go: +1 where such a stretch opens, -1 where it closes.
    edges = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, stop, -1)
    kept = np.cumsum(edges)[:-1] == 0
    shorter = set(text.tolist())
    collapsed = [
        b" ".join(compress(w, kept[offsets[i] : offsets[i + 1]].tolist()) if i in shorter else w)
        for i, w in enumerate(words)
    ]
    runs = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(text, np.arange(len(words) + 1)), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(x, pa.int64()) for x in (start - offsets[text], stop - start, period)],
            ["start", "length", "period"],
        ),
    )
    return pa.StructArray.from_arrays(
        [
            pa.array(np.diff(offsets), pa.int64()),
            runs,
            pa.array(collapsed, pa.binary()).view(pa.string()),
        ],
        ["n_words", "runs", "collapsed"],
    )


def _examined(texts: pa.Array) -> pa.Array:
    return examine([t or b"" for t in texts.cast(pa.binary()).to_pylist()])


# --- on tables ------------------------------------------------------------------------------


def detect(docs: DataFrame, column: str = "text", name: str = "repeats") -> DataFrame:
    """``docs`` with a struct ``name``: n_words, runs (start, length, period; by start) and the
    text without the words that repeat, joined by single spaces."""
    examined = F.arrow_udf(_examined, RESULT)
    return docs.withColumn(free_name(docs, name), examined(text_of(docs, column)))


def strongest(runs: Column) -> Column:
    """The run with the greatest length per period; ties go to the smaller start, then period."""

    def before(a: Column, b: Column) -> Column:
        one, other = a["length"] * b["period"], b["length"] * a["period"]
        return (
            F.when(one > other, -1)
            .when(one < other, 1)
            .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
            .when(a["period"] < b["period"], -1)
            .when(a["period"] > b["period"], 1)
            .otherwise(0)
        )

    return F.get(F.array_sort(runs, before), F.lit(0))


def planted(docs: DataFrame, name: str = "planted") -> DataFrame:
    """``docs`` with a text column ``name`` in which one document of ten, drawn by crc32 of its id,
    repeats a stretch of its own words up to its end.  A null id counts as the empty text."""
    draw = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(draw / 10)
    words = F.regexp_extract_all(text_of(docs), F.lit(WORD), F.lit(0))
    n = F.size(words)
    a = F.try_mod(g, n).cast("int")
    period = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    times = F.ceil((n - a) / period).cast("int")
    copies = F.flatten(F.array_repeat(F.slice(words, a + 1, period), times))
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(copies, F.lit(1), n - a)), " ")
    text = F.when((draw % 10 == 0) & (n > 0), repeated).otherwise(text_of(docs))
    return docs.withColumn(name, text)


def digest(docs: DataFrame) -> DataFrame:
    """Runs of every document in which ``planted`` put some: counts, the strongest run, digests."""
    given = docs.select("doc_id", "text")
    found = detect(planted(given), "planted").select("doc_id", "repeats", strongest(F.col("repeats.runs")).alias("top"))
    line = F.transform(
        "repeats.runs",
        lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")),
    )
    return found.select(
        "doc_id",
        F.size("repeats.runs").cast("long").alias("n_runs"),
        *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("repeats.collapsed", 256).alias("collapsed_sha256"),
    )
