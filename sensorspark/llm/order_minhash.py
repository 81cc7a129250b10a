"""Near-duplicate documents by order MinHash and banded alignment.

A document's five-word shingles are numbered by occurrence, so that a repeated shingle counts each
time.  For every hash function the smallest ``PICK`` numbered shingles are kept in the order in
which they stand in the text; two documents agree on such a sketch with a probability that falls
when shingles differ and when their order differs.  Two sketches form a band, and documents that
share a band are candidates.

A candidate pair is a link if the edit similarity of the two word sequences (one minus distance over
the longer length, by alignment in a band) reaches 0.8.  All links are promised, at the rates below,
where the shingle sequences align at 0.8 as well; others are found where a band happens to agree.
Texts whose shingle sequences align have at least four fifths of the longer one's shingles in common, hence a Jaccard similarity of 0.67 or more, and a sketch of three
agrees with a probability of about its cube: one of the thirty bands at least does so in 94 of 100
pairs at the threshold and in all but one of 10,000 at a Jaccard similarity of 0.8.  Classes are the
connected components of the links; byte-identical texts are one node from the start.

Inside a band's bucket no pairs are listed: all members are compared with one pivot, and the rest of
a bucket pairwise if it is no more than ``FEW`` texts in several components.  Larger rests are mostly
texts with a passage in common that are not alike.  Their shingles are ordered by rarity among all
such texts; a link needs a common shingle among the rarest of both, as many as may differ and one
more (prefix filter), so that equal rare shingles are the buckets that replace the rest without
losing a promised link.  A text whose own shingles outnumber what may differ is done without a comparison.
The most frequent shingles, of which a common passage is made, come last in that order: every task has
their list, and a text gives away no more of them than its rarer ones leave room for.

Defined results: texts without words (null counts as empty) are alike only if byte-identical; texts
of fewer than five words are one shingle; a class is named by its smallest ``doc_id``, null if none
of its rows has one; repeated rows are copies of each other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorspark.llm.common import text_of
from sensorspark.llm.components import components
from sensorspark.session import broadcast_if_small, materialize

SHINGLE = 5
PICK = 3
ROWS = 2
BANDS = 30
SKETCHES = ROWS * BANDS
# Bands are searched in waves; what earlier waves have connected needs no comparison later.
WAVES = (6, BANDS)
SIMILARITY = 0.8
# Texts of a bucket that are compared with each other once its pivot is done.
FEW = 8
SEED = 20_240_601
# Shingles hashed at a time, which bounds a worker's memory on very long texts.
BLOCK = 1 << 15
WORD_CACHE = 200_000
# Frequent shingles that every task may be handed: 8 bytes each.
FREQUENT = 200_000
# Rows of (digest, id) that may be broadcast: about 60 bytes each.
SMALL_ROWS = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHashes()


def shingles(words: list[bytes]) -> np.ndarray:
    """A hash of every shingle, in text order; a text of fewer words is one shingle."""
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    codes = np.zeros(n, np.uint64)
    for j in range(k):
        codes = codes * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n + j]
    return _mix(codes)


def numbered_shingles(words: list[bytes]) -> np.ndarray:
    """A hash of every shingle together with its occurrence number, in text order."""
    codes = shingles(words)
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if not fresh.all():
        starts = np.flatnonzero(fresh)
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        codes = _mix(codes + occurrence * np.uint64(0x2545F4914F6CDD1D))
    return codes


FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, SKETCHES, np.uint32) * np.uint32(2) + np.uint32(1)
LAST = np.iinfo(np.uint32).max


def band_keys(words: list[bytes]) -> list[int]:
    """One 64-bit key per band; none for a text without words."""
    if not words:
        return []
    codes = numbered_shingles(words)
    # The hash functions multiply the upper half of a shingle's code by odd numbers.
    upper = (codes >> np.uint64(32)).astype(np.uint32)
    ranks = np.full((SKETCHES, PICK), LAST, np.uint32)
    where = np.full((SKETCHES, PICK), -1, np.int64)
    rows = np.arange(SKETCHES)
    for start in range(0, len(upper), BLOCK):
        values = FACTORS[:, None] * upper[None, start : start + BLOCK]
        more_ranks, more_places = [ranks], [where]
        for _ in range(min(PICK, values.shape[1])):
            at = values.argmin(axis=1)
            more_ranks.append(values[rows, at][:, None])
            more_places.append(at[:, None] + start)
            values[rows, at] = LAST
        if start == 0 and len(more_places) > PICK:
            ranks, where = np.hstack(more_ranks[1:]), np.hstack(more_places[1:])
            continue
        all_ranks, all_places = np.hstack(more_ranks), np.hstack(more_places)
        keep = np.argsort(all_ranks, axis=1, kind="stable")[:, :PICK]
        if start == 0:
            # A text of fewer shingles than a sketch holds fills the rest with places of no shingle.
            keep = np.argsort(all_places < 0, axis=1, kind="stable")[:, :PICK]
        ranks, where = np.take_along_axis(all_ranks, keep, 1), np.take_along_axis(all_places, keep, 1)
    where.sort(axis=1)
    picked = np.where(where >= 0, codes[where], np.uint64(0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in picked.reshape(BANDS, ROWS * PICK).T:
        keys = _mix(keys * np.uint64(0xD6E8FEB86659FD93) + column)
    return keys.view(np.int64).tolist()


def sketch(texts: pd.Series) -> pd.DataFrame:
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    return pd.DataFrame(
        {"n": [max(len(w) - SHINGLE + 1, min(len(w), 1)) for w in words], "bands": [np.array(band_keys(w), np.int64) for w in words]}
    )


def distance_within(a: list, b: list, most: int) -> int | None:
    """The edit distance of two sequences if it is at most ``most``, else None.

    Only cells at most ``most`` off the diagonal are looked at.  A column of that band is one
    integer, a bit per row; the band moves down by one row per column, and the distance is followed
    along its lower edge and then along the last row (bit-parallel columns after Myers and Hyyrö).
    """
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < high - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[low : len(a) - tail], b[low : len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    if not b:
        return len(a)
    most = min(most, len(a))
    # Bit i of a column stands for row j - most + i; the lower edge is bit 2 * most.
    width = 2 * most + 1
    mask, edge = (1 << width) - 1, 1 << (2 * most)
    rows: dict = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << i
    plus, minus = (mask >> most) << most, 0
    distance, last = most, len(a) - most
    for j, x in enumerate(b):
        shift = j - most
        match = rows.get(x, 0)
        match = (match >> shift if shift >= 0 else match << -shift) & mask
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & mask
        across_plus = (minus | ~(diagonal | plus)) & mask
        across_minus = diagonal & plus
        if j < last:
            distance += not diagonal & edge
        else:
            row = 1 << (2 * most - 1 - (j - last))
            distance += bool(across_plus & row)
            distance -= bool(across_minus & row)
        lowered = diagonal >> 1
        plus = (across_minus | ~(lowered | across_plus)) & mask
        minus = lowered & across_plus
    return distance if distance <= most else None


@lru_cache(maxsize=64)
def _words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def may_differ(n: int) -> int:
    """The edits that leave two sequences, the longer one of ``n`` elements, alike."""
    return int((1 - SIMILARITY) * n + 1e-9)


def alike(a: str, b: str) -> bool:
    """Whether the edit similarity of the word sequences reaches ``SIMILARITY``."""
    wa, wb = _words_of(a), _words_of(b)
    return bool(wa and wb) and distance_within(wa, wb, may_differ(max(len(wa), len(wb)))) is not None


def judge(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def numbered(texts: pd.Series) -> pd.Series:
    """The numbered shingles of each text."""
    split = (t.encode("utf-8", "surrogatepass").split() for t in texts)
    return pd.Series([numbered_shingles(w).view(np.int64) if w else np.empty(0, np.int64) for w in split])


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (src, dst) pairs whose texts are alike, as links (low, high) between their components."""
    same = F.pandas_udf(judge, "boolean")
    left = texts.select(F.col("v").alias("src"), F.col("text").alias("text_a"))
    right = texts.select(F.col("v").alias("dst"), F.col("text").alias("text_b"))
    compared = pairs.join(left, "src").join(right, "dst")
    alike_ = compared.select("low", "high", same("text_a", "text_b").alias("same")).where("same")
    return materialize(alike_.select("low", "high").distinct(), "links")


def _apart(members: DataFrame) -> DataFrame:
    """Members of the buckets in which members that were no pivot yet lie in several components."""
    fresh = F.when(~F.col("used"), F.col("component"))
    open_buckets = (
        members.groupBy("key")
        .agg(
            F.min(fresh).alias("_low"),
            F.max(fresh).alias("_high"),
            F.min(F.when(~F.col("used"), F.col("v"))).alias("pivot"),
            F.count_if(~F.col("used")).alias("fresh"),
        )
        .where(F.col("_low") < F.col("_high"))
        .drop("_low", "_high")
    )
    return members.join(open_buckets, "key")


def _settled(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` with the components that (low, high) links join given their lowest name.

    A component first takes the lowest name it is linked with; only the few links that still join
    different names are then followed to the end.
    """
    lower = materialize(
        links.groupBy(F.col("high").alias("component")).agg(F.min("low").alias("low")), "lower-names"
    )
    known = materialize(
        known.join(broadcast_if_small(lower, SMALL_ROWS), "component", "left").select("v", F.coalesce("low", "component").alias("component")),
        "text-components",
    )
    ends = links
    for end in ("low", "high"):
        ends = ends.join(known.select(F.col("v").alias(end), F.col("component").alias(f"{end}_now")), end)
    ends = materialize(
        ends.where("low_now != high_now").select(F.col("low_now").alias("src"), F.col("high_now").alias("dst")).distinct(),
        "open-links",
    )
    if ends.isEmpty():
        return known
    settled = components(ends).select(F.col("v").alias("component"), F.col("component").alias("settled"))
    return materialize(
        known.join(broadcast_if_small(settled, SMALL_ROWS), "component", "left").select(
            "v", F.coalesce("settled", "component").alias("component")
        ),
        "text-components",
    )


def _searched(
    state: DataFrame, known: DataFrame | None, involved: DataFrame, texts: DataFrame, few: int | None
) -> tuple[DataFrame | None, DataFrame | None]:
    """Components after comparing the (key, v, n) members of buckets, and what is left undone.

    With ``few``, each bucket takes one pivot and then all pairs of what is still apart, if that is
    no more than ``few`` texts; the texts of larger rests are returned.  Without, pivots are drawn by
    hash, eight times as many each turn, until nothing is apart.
    """
    state, turn = state.withColumn("used", F.lit(False)), 0
    while True:
        # Every text starts as a component of its own.
        placed = state.withColumn("component", F.col("v")) if known is None else state.join(known, "v")
        drawn = F.pmod(F.xxhash64("v", "key", F.lit(turn)), F.col("fresh")) < F.lit((1 << 3 * turn) - 1)
        if few is not None:
            drawn = F.lit(turn > 0) & (F.col("fresh") <= few)
        opened = materialize(
            _apart(placed).withColumn("lead", ~F.col("used") & ((F.col("v") == F.col("pivot")) | drawn)),
            "open-buckets",
        )
        rest = None
        if few is not None and turn > 0:
            rest = opened.where((F.col("fresh") > few) & ~F.col("used")).select("v")
            opened = opened.where(F.col("fresh") <= few)
        turn += 1
        if opened.isEmpty():
            return known, rest
        leads = opened.where("lead").select(
            "key", F.col("v").alias("dst"), F.col("component").alias("other"), F.col("n").alias("n_dst")
        )
        pairs = (
            opened.where("not used")
            .join(leads, "key")
            .where((F.col("component") != F.col("other")) & (~F.col("lead") | (F.col("v") > F.col("dst"))))
            .where(F.least("n", "n_dst") + SHINGLE - 1 >= SIMILARITY * (F.greatest("n", "n_dst") + SHINGLE - 1) - 1e-9)
            .select(
                F.least("v", "dst").alias("src"), F.greatest("v", "dst").alias("dst"),
                F.least("component", "other").alias("low"), F.greatest("component", "other").alias("high"),
            )
            .distinct()
        )
        found = _verified(pairs, texts)
        if not found.isEmpty():
            known = _settled(involved.withColumn("component", F.col("v")) if known is None else known, found)
        if rest is not None:
            return known, rest
        state = opened.select("key", "v", "n", (F.col("used") | F.col("lead")).alias("used"))


def repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shingles that several texts of a batch hold, and how many do."""
    for batch in batches:
        keys, texts = np.unique(np.concatenate([np.empty(0, np.int64), *batch["codes"]]), return_counts=True)
        several = texts > 1
        yield pd.DataFrame({"key": keys[several], "texts": texts[several]})


def frequent_shingles(whole: DataFrame) -> np.ndarray:
    """Shingles that more than ``FEW`` texts of (v, codes) hold, the rarest first, ``FREQUENT`` at most.

    They are counted where several texts of one batch hold them.  That misses some texts and some
    shingles, which costs time and no link: any order common to all texts will do.
    """
    counted = whole.select("codes").mapInPandas(repeated, "key bigint, texts bigint")
    held = materialize(counted.groupBy("key").agg(F.sum("texts").alias("texts")), "repeated-shingles")
    least = FEW
    while held.where(F.col("texts") > least).limit(FREQUENT + 1).count() > FREQUENT:
        least *= 2
    got = held.where(F.col("texts") > least).toPandas()
    return got.sort_values(["texts", "key"])["key"].to_numpy(np.int64)


def parted(frequent: np.ndarray):
    """Parts numbered shingles into those not ``frequent`` and the first ``frequent`` ones in need.

    Rarer shingles come first, so that frequent ones fill only what these leave of as many as may
    differ and one more.
    """
    order = np.argsort(frequent)
    ranked = frequent[order]

    def part(codes: pd.Series) -> pd.DataFrame:
        rare, common = [], []
        for c in codes:
            at = np.searchsorted(ranked, c)
            known = at < np.searchsorted(ranked, c, "right")
            rare.append(c[~known])
            room = max(may_differ(len(c)) + 1 - len(rare[-1]), 0)
            common.append(frequent[np.sort(order[at[known]])[:room]])
        return pd.DataFrame({"rare": rare, "frequent": common})

    return F.pandas_udf(part, "rare array<bigint>, frequent array<bigint>")


def rare_buckets(texts: DataFrame) -> DataFrame:
    """(key, v, n): the shingles of each (v, text) that a text alike to it has to share one of.

    Numbered shingles are ordered by the number of texts that hold them, then by hash, the frequent
    ones last.  Two alike texts lack at most ``may_differ`` of each other's shingles, hence share one
    of so many and one more of their first ones.  Shingles of one text only come first and need no row.
    """
    coded = F.pandas_udf(numbered, "array<bigint>")
    whole = materialize(texts.select("v", coded("text").alias("codes")), "rest-shingles")
    part = parted(frequent_shingles(whole))
    parts = materialize(
        whole.select("v", F.size("codes").cast("long").alias("n"), part("codes").alias("part")).select("v", "n", "part.*"),
        "rest-parts",
    )
    held = parts.select("v", "n", F.size("rare").alias("n_rare"), F.explode("rare").alias("key"))
    shared = held.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    of_text = Window.partitionBy("v")
    rare = (
        held.join(shared, "key")
        .withColumn("own", F.col("n_rare") - F.count(F.lit(1)).over(of_text))
        .withColumn("place", F.row_number().over(of_text.orderBy("texts", "key")))
        .where(F.col("own") + F.col("place") <= F.floor((1 - SIMILARITY) * F.col("n") + 1e-9) + 1)
        .select("key", "v", "n")
    )
    filled = parts.select(F.explode("frequent").alias("key"), "v", "n")
    return materialize(rare.unionByName(filled), "rare-buckets")


def linked(nodes: DataFrame, texts_of) -> DataFrame | None:
    """(v, component) for the (v, n, bands) nodes that share a band; None if none do.

    ``texts_of`` gives (v, text) for a table of v.
    """
    keyed = nodes.select("v", "n", F.posexplode("bands").alias("wave", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1")
    members = materialize(keyed.join(shared.select("key"), "key"), "buckets")
    involved = materialize(members.select("v").distinct(), "involved")
    if involved.isEmpty():
        return None
    texts = texts_of(involved)
    known, first, rests = None, 0, None
    for end in WAVES:
        wave = members.where(F.col("wave").between(first, end - 1)).select("key", "v", "n")
        known, rest = _searched(wave, known, involved, texts, FEW)
        if rest is not None:
            rests = rest if rests is None else rests.unionByName(rest)
        first = end
    if rests is not None:
        undone = materialize(rests.distinct(), "rest")
        if not undone.isEmpty():
            known, _ = _searched(rare_buckets(texts.join(undone, "v", "left_semi")), known, involved, texts, None)
    return involved.withColumn("component", F.col("v")) if known is None else known


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: rows (doc_id, fp) of ``docs``, and (fp, class_id, doc, copies, keeper) for
    every distinct text: its class, its smallest id, how many rows have both, and whether that row
    stands for the class."""
    sketched = F.pandas_udf(sketch, "n bigint, bands array<bigint>")
    rows = materialize(
        docs.select("doc_id", text_of(docs).alias("t"))
        .select("doc_id", digest(F.col("t")).alias("fp"), sketched("t").alias("s"))
        .select("doc_id", "fp", "s.n", "s.bands"),
        "sketch-rows",
    )
    # Null ids come last, so that a row with an id stands for its text.
    first = rows.groupBy("fp", "doc_id").agg(
        F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    nodes = materialize(
        first.groupBy("fp")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copies")).alias("m"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
        )
        .select(
            "fp", F.col("m.doc_id").alias("doc"), F.col("m.copies").alias("copies"), "n", "bands",
            F.monotonically_increasing_id().alias("v"),
        ),
        "texts",
    )

    def texts_of(involved: DataFrame) -> DataFrame:
        wanted = materialize(
            nodes.join(involved, "v", "left_semi").select("v", "fp", F.col("doc").alias("_doc")), "wanted"
        )
        plain = docs.select("doc_id", text_of(docs).alias("text")).withColumn("fp", digest(F.col("text")))
        small = broadcast_if_small(wanted, SMALL_ROWS).withColumnRenamed("fp", "_fp")
        found = plain.join(small, (F.col("fp") == F.col("_fp")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
        return materialize(found.select("v", "text").dropDuplicates(["v"]), "candidate-texts")

    found = linked(nodes, texts_of)
    if found is None:
        named = nodes.withColumn("component", F.col("v"))
    else:
        named = nodes.join(found, "v", "left").withColumn("component", F.coalesce("component", "v"))
    named = materialize(named.select("fp", "doc", "copies", "component"), "components")
    heads = named.groupBy("component").agg(
        F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "fp")).alias("head")
    )
    return rows.select("doc_id", "fp"), materialize(
        named.join(heads, "component").select(
            "fp", F.col("head.doc").alias("class_id"), "doc", "copies",
            (F.col("fp") == F.col("head.fp")).alias("keeper"),
        ),
        "classes",
    )


def class_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs``."""
    rows, named = classes(docs)
    return rows.join(named.select("fp", "class_id"), "fp").select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, the one with the smallest id, with all columns of ``docs``."""
    rows, named = classes(docs)
    judged = rows.join(named, "fp").withColumn(
        "kept", F.col("keeper") & F.col("doc_id").eqNullSafe(F.col("doc"))
    )
    # Rows equal in id and text are told apart only among themselves.
    gone = materialize(
        judged.where(~F.col("kept") | (F.col("copies") > 1))
        .groupBy(F.col("fp").alias("_fp"), F.col("doc_id").alias("_doc"))
        .agg(F.max("kept").alias("_again")),
        "dropped",
    )
    keyed = docs.withColumn("_fp_", digest(text_of(docs)))
    match = (F.col("_fp_") == F.col("_fp")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    single = keyed.join(broadcast_if_small(gone, SMALL_ROWS), match, "left_anti")
    again = gone.where("_again")
    if not again.isEmpty():
        repeated = keyed.join(again, match, "left_semi").dropDuplicates(["_fp_", "doc_id"])
        single = single.unionByName(repeated)
    return single.select(*[f"`{c}`" for c in docs.columns])
