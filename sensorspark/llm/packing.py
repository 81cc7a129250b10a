"""Packing token sequences into windows by best-fit decreasing.

Every document becomes its token ids and an end id; overlong documents are cut into full windows
first, and what is left of each goes to the tightest open window that holds it, longest first.
Pieces of one length are interchangeable, so the plan needs only the number of pieces per length
(at most ``window`` numbers, whatever the corpus holds).  It is computed on those counts: a segment
tree over remaining capacities finds the tightest open windows, and whole runs of equal pieces go
to whole runs of equal windows.  The plan is exactly the one of placing pieces one by one.

Each piece then looks up its window by its ordinal among the pieces of its length: a rank inside
its task, counted while tokenizing and stored with the piece, plus the counts of the tasks before.
No length, source or document is ever gathered in one task.

Defined results: a null or empty text is the end id alone; rows repeat as in the input, each with
its own pieces; any ``doc_id`` is allowed, null too; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sensorspark.llm.common import text_of
from sensorspark.session import materialize

WINDOW = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
# The tokenizer's pieces of a text, contractions, letters, digits, other signs, blanks.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"
BLANK_RUNS = r"\s+(?!\S)|\s+"
SINGLE_BLANKS = r"\s"
# Characters up to U+024F are classed alike by every Unicode version.
BEYOND_LATIN = re.compile(r"[^\x00-\u024f]")
NEEDS_CARE = re.compile(r"\s\s|[^\x00-\u024f]")
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint,"
    " part int, rank bigint"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Encoder:
    """Ids of whole texts, equal to those of the tokenizer file.

    The file's own library is slow on long texts, so it only gets texts that name a special token
    or hold characters whose class depends on the Unicode version.  The others are encoded from the
    same vocabulary by a faster library, with a pattern that gives the same pieces; where no two
    blanks meet, the pattern needs no look-ahead.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.special = [x["content"] for x in model["added_tokens"]]
        # The file writes bytes as printable characters: those that are printable stand for
        # themselves, the others follow from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {
            bytes(byte_of[c] for c in token): number
            for token, number in model["model"]["vocab"].items()
            if token not in self.special
        }
        self.spaced, self.single = (
            tiktoken.Encoding("own", pat_str=WORDS + blanks, mergeable_ranks=ranks, special_tokens={})
            for blanks in (BLANK_RUNS, SINGLE_BLANKS)
        )

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if not NEEDS_CARE.search(text):
            return self.single.encode_ordinary(text)
        if BEYOND_LATIN.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.spaced.encode_ordinary(text)

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return np.array(self.ids(text), "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, path: str | None, window: int, with_ids: bool) -> DataFrame:
    """The pieces of every document, each with its task and its rank among the task's pieces of its
    length.  Written once, since a rank must not change when a task is run again."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path or default_tokenizer())
        end = np.array([END_ID], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        ranks = [0] * (window + 1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    own = ids[4 * start : 4 * (start + window)]
                    n = len(own) // 4
                    rows.append(
                        (doc_id, start, n, own if with_ids else None, zlib.crc32(own), total, part, ranks[n])
                    )
                    ranks[n] += 1
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
            yield out.astype({"doc_id": "Int64"})

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return materialize(source.mapInPandas(pieces, PIECES), "pieces")


class Capacities:
    """A segment tree over remaining capacities: which ones some open window has."""

    def __init__(self, window: int):
        self.leaves = 1
        while self.leaves <= window:
            self.leaves *= 2
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, on: bool) -> None:
        node = self.leaves + capacity
        self.open[node] = on
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity that is ``least`` or more."""
        node = self.leaves + least
        if self.open[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(counts: dict[int, int], window: int = WINDOW) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best-fit decreasing on counts per length.

    For each length: runs (first ordinal, first window, pieces per window, offset of the first
    piece), in the order of ordinals; a run ends where the next one begins.
    """
    tree, held = Capacities(window), [[] for _ in range(window + 1)]

    def keep(capacity: int, first: int, many: int) -> None:
        if capacity and many:
            held[capacity].append((first, many))
            tree.set(capacity, True)

    windows, runs = 0, {}
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, done, own = counts[length], 0, []
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, fit = window, window // length
                first, many = windows, -(-left // fit)
                windows += many
            else:
                fit = capacity // length
                first, many = held[capacity].pop()
                if not held[capacity]:
                    tree.set(capacity, False)
            full = min(many, left // fit)
            if full:
                own.append((done, first, fit, window - capacity))
                done, left = done + full * fit, left - full * fit
                keep(capacity - fit * length, first, full)
            if full < many and left:
                # Fewer pieces are left than one window holds: they end in the next window.
                own.append((done, first + full, left, window - capacity))
                keep(capacity - left * length, first + full, 1)
                done, left, full = done + left, 0, full + 1
            keep(capacity, first + full, many - full)
        runs[length] = own
    return runs


def pack(
    docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32, with ``with_ids``),
    ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = tokenized(docs, tokenizer, window, with_ids)
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(
        per_task.select(
            "part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
        ),
        "piece-bases",
    )
    counts = {r["length"]: r["total"] for r in bases.groupBy("length").agg(F.sum("n").alias("total")).collect()}
    runs = {n: tuple(np.array(x, np.int64).T) for n, x in plan(counts, window).items()}

    def place(length: pd.Series, ordinal: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ordinals = length.to_numpy(), ordinal.to_numpy()
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            first, bins, fit, start = runs[n]
            at = np.searchsorted(first, ordinals[rows], "right") - 1
            inside = ordinals[rows] - first[at]
            sequence[rows] = bins[at] + inside // fit[at]
            offset[rows] = start[at] + inside % fit[at] * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    # pandas_udf reads the hints, which are text in this module.
    place.__annotations__ = {"length": pd.Series, "ordinal": pd.Series, "return": pd.DataFrame}
    placed = F.pandas_udf(place, "sequence_id bigint, offset bigint")
    kept = ["doc_id", "start", "length", *(["ids"] if with_ids else []), "ids_crc32", "doc_tokens"]
    return (
        pieces.join(bases.select("part", "length", "base"), ["part", "length"])
        .withColumn("at", placed("length", F.col("base") + F.col("rank")))
        .select(*kept, "at.sequence_id", "at.offset")
    )
