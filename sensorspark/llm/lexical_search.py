"""Ranked search over inverted lists whose blocks of similar documents carry summaries.

Documents are measured once into vectors over the terms of the queries.  Every task then indexes
its documents in segments and searches them for all queries of a block of queries:

- Each term has a list of the documents that hold it.  A list is cut into blocks of documents that
  resemble each other (they go to the most similar of some seed documents, by random projections).
- A block's summary is the coordinatewise maximum of its documents' vectors, so the product of a
  query with it bounds every score inside.
- A query goes through its terms from the heaviest on.  A block is scored unless its bound shows that
  none of its documents can enter the best ones found so far.  Documents that hold an earlier term
  of the query have been dealt with in that term's list, so that a bound only needs the terms from
  the present one on; once the lists' own maxima cannot reach the best, the query is done.

The best documents so far are kept from segment to segment, so later segments skip more.  A task
emits at most the wanted number of documents for each query, and these are merged.  Scores are whole
numbers and bounds are exact: nothing is lost, whatever the clustering does.

Queries go in blocks of bounded vocabulary, which each task receives; documents are never shuffled.

Defined results: null and empty texts have no terms and match nothing; a query without terms, or
whose terms occur nowhere, finds nothing; every row of queries is a query of its own, and every row
of documents a document, so repeated rows appear repeatedly; equal scores are ordered by ascending
document id, null ids last; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorspark.llm.common import text_of
from sensorspark.session import materialize

TOP = 10
# Distinct terms of a block of queries, if a single query does not hold more.
QUERY_TERMS = 1 << 14
# Cells of a segment's document-by-term table, and its largest number of documents.
SEGMENT_CELLS = 1 << 24
SEGMENT_DOCS = 4096
# Documents in a block of a list, before and after clusters are cut.
BLOCK_DOCS, MOST_DOCS = 32, 64
PROJECTIONS = 16

VECTOR = "struct<n:bigint,terms:array<int>,counts:array<bigint>>"
HITS = "query int, id bigint, score bigint"

_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_LETTERS).split()


# --- queries --------------------------------------------------------------------------------


def query_blocks(items: DataFrame, key: str) -> Iterator[list[tuple[object, Counter]]]:
    """Blocks of (id, term counts); each row is read once, one partition at a time."""
    block, known = [], set()
    for row in items.select(F.col(key).alias("k"), text_of(items).alias("t")).toLocalIterator():
        counts = Counter(terms_of(row["t"].encode("utf-8", "surrogatepass")))
        if not counts:
            continue
        if block and len(known | counts.keys()) > QUERY_TERMS:
            yield block
            block, known = [], set()
        block.append((row["k"], counts))
        known |= counts.keys()
    if block:
        yield block


def term_weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


# --- vectors --------------------------------------------------------------------------------


def _vectors(texts: list[bytes], numbers: dict[bytes, int]) -> pa.StructArray:
    """Length, known terms and their counts of each text."""
    sizes, terms, counts, offsets = [], [], [], [0]
    for text in texts:
        words = terms_of(text)
        held = Counter(map(numbers.get, words))
        held.pop(None, None)
        sizes.append(len(words))
        terms.extend(held.keys())
        counts.extend(held.values())
        offsets.append(len(terms))
    places = pa.array(offsets, pa.int32())
    return pa.StructArray.from_arrays(
        [
            pa.array(sizes, pa.int64()),
            pa.ListArray.from_arrays(places, pa.array(terms, pa.int32())),
            pa.ListArray.from_arrays(places, pa.array(counts, pa.int64())),
        ],
        ["n", "terms", "counts"],
    )


def vectors(docs: DataFrame, numbers: dict[bytes, int], key: str) -> DataFrame:
    """(id, n, terms, counts) of every document, terms restricted to the keys of ``numbers``."""
    measure = F.arrow_udf(
        lambda texts: _vectors([t or b"" for t in texts.cast(pa.binary()).to_pylist()], numbers), VECTOR
    )
    measured = docs.select(F.col(key).cast("bigint").alias("id"), measure(text_of(docs)).alias("v"))
    return measured.select("id", "v.*")


# --- one segment ----------------------------------------------------------------------------


def saturation(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count is worth in a document of some length, in whole numbers."""
    if len(lengths) and 75 * int(lengths.max()) * n_docs >= 1 << 63:
        lengths = lengths.astype(object)
    m = (100 - 75 + (75 * lengths * n_docs) // n_terms).astype(np.int64)
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


class Segment:
    """An index over the vectors of some documents; positions stand for documents."""

    def __init__(self, ids: np.ndarray, position: np.ndarray, term: np.ndarray, value: np.ndarray, width: int):
        self.ids = ids
        self.table = np.zeros((len(ids), width), np.int32)
        self.table[position, term] = value
        order = np.argsort(term, kind="stable")
        self.documents = position[order]
        self.begin = np.searchsorted(term[order], np.arange(width + 1))
        self.highest = self.table.max(axis=0, initial=0).astype(np.int64)
        rng = np.random.default_rng(17)
        spread = self.table.astype(np.float32) @ rng.standard_normal((width, PROJECTIONS), np.float32)
        self.sketch = spread / np.maximum(np.linalg.norm(spread, axis=1, keepdims=True), 1e-9)
        self.blocks: dict[int, tuple[list[np.ndarray], np.ndarray, np.ndarray]] = {}

    def listed(self, term: int) -> np.ndarray:
        return self.documents[self.begin[term] : self.begin[term + 1]]

    def blocks_of(self, term: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The list of ``term`` in blocks: documents, summaries and smallest ids of each."""
        if term not in self.blocks:
            held = self.listed(term)
            seeds = held[:: BLOCK_DOCS]
            cluster = np.argmax(self.sketch[held] @ self.sketch[seeds].T, axis=1)
            order = np.argsort(cluster, kind="stable")
            cuts = np.flatnonzero(np.diff(cluster[order])) + 1
            parts = []
            for part in np.split(held[order], cuts):
                parts += [part[i : i + MOST_DOCS] for i in range(0, len(part), MOST_DOCS)]
            summaries = np.stack([self.table[p].max(axis=0) for p in parts])
            self.blocks[term] = parts, summaries, np.array([self.ids[p].min() for p in parts])
        return self.blocks[term]


class Best:
    """The best documents of one query so far."""

    def __init__(self, top: int):
        self.top = top
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def worth(self, bound: np.ndarray, smallest: np.ndarray) -> np.ndarray:
        """Whether a document with at most this score and at least this id could still enter."""
        if len(self.ids) < self.top:
            return bound > 0
        last, held = self.scores[-1], self.ids[-1]
        return (bound > last) | ((bound == last) & (smallest < held))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = self.worth(scores, ids)
        if not good.any():
            return
        ids, scores = np.concatenate([self.ids, ids[good]]), np.concatenate([self.scores, scores[good]])
        order = np.lexsort((ids, -scores))[: self.top]
        self.ids, self.scores = ids[order], scores[order]


def search_segment(segment: Segment, terms: np.ndarray, factors: np.ndarray, best: Best) -> None:
    """Brings ``best`` up to date; ``terms`` come with descending ``factors``."""
    reach = np.cumsum((factors * segment.highest[terms])[::-1])[::-1]
    done = np.zeros(len(segment.ids), bool)
    lowest = np.array([np.iinfo(np.int64).min])
    for nth, term in enumerate(terms):
        if not best.worth(reach[nth : nth + 1], lowest)[0]:
            return
        if segment.begin[term] == segment.begin[term + 1]:
            continue
        parts, summaries, smallest = segment.blocks_of(term)
        bounds = summaries[:, terms[nth:]].astype(np.int64) @ factors[nth:]
        order = np.argsort(-bounds, kind="stable")
        taken, step = 0, 1
        while taken < len(order):
            # A few blocks at a time, the most promising first, since every hit raises the bar.
            chosen = order[taken : taken + step]
            chosen = chosen[best.worth(bounds[chosen], smallest[chosen])]
            if len(chosen):
                documents = np.concatenate([parts[b] for b in chosen])
                documents = documents[~done[documents]]
                scores = segment.table[np.ix_(documents, terms)].astype(np.int64) @ factors
                best.add(segment.ids[documents], scores)
            elif bounds[order[taken]] < best.scores[-1:].sum():
                break
            taken += step
            step *= 2
        done[segment.listed(term)] = True


_NO_ID = np.iinfo(np.int64).max


def _search(
    batches: Iterator[pa.RecordBatch], plans: list[tuple[np.ndarray, np.ndarray]], width: int, n_docs: int, n_terms: int, top: int
) -> Iterator[pa.RecordBatch]:
    best = [Best(top) for _ in plans]
    room = max(16, min(SEGMENT_DOCS, SEGMENT_CELLS // width))
    held: list[pa.RecordBatch] = []

    def index_and_search(rows: pa.Table) -> None:
        terms, counts = (rows[c].combine_chunks() for c in ("terms", "counts"))
        size = np.diff(terms.offsets.to_numpy())
        position = np.repeat(np.arange(rows.num_rows), size)
        term = terms.flatten().to_numpy(zero_copy_only=False)
        lengths = rows["n"].to_numpy()[position]
        value = saturation(counts.flatten().to_numpy(zero_copy_only=False), lengths, n_docs, n_terms)
        ids = rows["id"].fill_null(_NO_ID).to_numpy()
        segment = Segment(ids, position, term, value, width)
        for (query_terms, factors), found in zip(plans, best):
            search_segment(segment, query_terms, factors, found)

    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= room:
            table = pa.Table.from_batches(held)
            index_and_search(table.slice(0, room).combine_chunks())
            held = table.slice(room).to_batches()
    if sum(b.num_rows for b in held):
        index_and_search(pa.Table.from_batches(held).combine_chunks())
    for number, found in enumerate(best):
        if len(found.ids):
            ids = pa.array(found.ids, pa.int64(), mask=found.ids == _NO_ID)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(ids), pa.int32()), ids, pa.array(found.scores, pa.int64())],
                ["query", "id", "score"],
            )


# --- on tables ------------------------------------------------------------------------------


def _search_block(docs: DataFrame, block: list[tuple[object, Counter]], key: str, top: int) -> DataFrame:
    """(query, id, score, rank) for the queries of one block, numbered from 0."""
    numbers: dict[bytes, int] = {}
    for _, counts in block:
        for term in counts:
            numbers.setdefault(term, len(numbers))
    measured = materialize(vectors(docs, numbers, key), "vectors")
    totals = measured.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    # One row for each term of the block.
    holding = dict(measured.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    plans = []
    for _, counts in block:
        weighted = [
            (times * term_weight(totals["docs"], holding[numbers[term]]), numbers[term])
            for term, times in counts.items()
            if numbers[term] in holding
        ]
        weighted.sort(reverse=True)
        plans.append(
            (np.array([t for _, t in weighted], np.int64), np.array([w for w, _ in weighted], np.int64))
        )
    width, n_docs, n_terms = len(numbers), totals["docs"], totals["terms"]
    hits = (
        measured.where(F.size("terms") > 0)
        .select("id", "n", "terms", "counts")
        .mapInArrow(lambda batches: _search(batches, plans, width, n_docs, n_terms, top), HITS)
    )
    place = F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    )
    return hits.withColumn("rank", place).where(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", item_key: str = "item_id"
) -> DataFrame:
    """The ``top`` best documents of each row of ``items``: item_id, rank (from 1), doc_id, score."""
    kind, doc_kind = dict(items.dtypes)[item_key], dict(docs.dtypes)[key]
    spark = docs.sparkSession
    out = spark.createDataFrame([], f"{item_key} {kind}, rank int, {key} {doc_kind}, score bigint")
    for block in query_blocks(items, item_key):
        found = _search_block(docs, block, key, top)
        names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(block)], f"query int, {item_key} {kind}")
        # As many rows as queries in a block.
        named = found.join(F.broadcast(names), "query").select(
            item_key, F.col("rank").cast("int").alias("rank"), F.col("id").cast(doc_kind).alias(key), "score"
        )
        out = out.unionByName(named)
    return out
