import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from sensorspark.llm import packing as p
from tests_llm_data import documents


def one_by_one(counts, window):
    """Remaining capacities after placing pieces one by one."""
    left = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fitting = [(r, i) for i, r in enumerate(left) if r >= length]
        if fitting:
            left[min(fitting)[1]] -= length
        else:
            left.append(window - length)
    return sorted(left)


def test_plan_equals_one_by_one():
    draw = random.Random(5)
    for _ in range(200):
        window = draw.choice([4, 16, 31, 64])
        counts = {n: draw.choice([0, 1, 2, 7, 19]) for n in range(1, window + 1) if draw.random() < 0.5}
        filled = defaultdict(list)
        for length, runs in p.plan(counts, window).items():
            for o in range(counts[length]):
                first, bins, fit, start = [r for r in runs if r[0] <= o][-1]
                filled[bins + (o - first) // fit].append((start + (o - first) % fit * length, length))
        for pieces in filled.values():
            at = 0
            for start, length in sorted(pieces):
                assert start == at
                at += length
            assert at <= window
        assert sorted(filled) == list(range(len(filled)))
        assert sorted(window - sum(n for _, n in x) for x in filled.values()) == one_by_one(counts, window)


def test_plan_size_does_not_follow_the_counts():
    draw = random.Random(6)
    shares = [draw.random() for _ in range(1024)]
    small = sum(map(len, p.plan({n + 1: int(1e3 * s) for n, s in enumerate(shares)}).values()))
    large = sum(map(len, p.plan({n + 1: int(1e9 * s) for n, s in enumerate(shares)}).values()))
    assert large < 2 * small + 10_000


def test_ids_equal_the_tokenizer():
    draw = random.Random(7)
    own, ref = p.Encoder(p.default_tokenizer()), Tokenizer.from_file(p.default_tokenizer())
    texts = ["", " ", "  a   b ", "a \n b", "x<|endoftext|>y", "日本 語 ２ ²", "don't 'S 're", "a\n\n\nb  \n  c", "ǅ ɐ a"]
    parts = [" ", "\n", "a", "Éa", "12", ".", "\t", "'s", "日", "  ", "?!"]
    texts += ["".join(draw.choice(parts) for _ in range(draw.randint(1, 25))) for _ in range(3000)]
    for t in texts:
        assert own.ids(t) == ref.encode(t, add_special_tokens=False).ids, repr(t)


def test_round_trip(spark, odd_docs, no_docs):
    ref = Tokenizer.from_file(p.default_tokenizer())
    for docs in (odd_docs, documents(spark)):
        rows = p.pack(docs).collect()
        by_window, by_doc = defaultdict(list), defaultdict(list)
        for r in rows:
            assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and 0 < r.length <= 1024
            by_window[r.sequence_id].append((r.offset, r.length))
            by_doc[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        for pieces in by_window.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 1024
        given = defaultdict(list)
        for d in docs.collect():
            given[d.doc_id].append(ref.encode(d.text or "", add_special_tokens=False).ids + [p.END_ID])
        for doc_id, texts in given.items():
            if len(texts) == 1:
                whole = b"".join(x for _, x, _ in sorted(by_doc[doc_id]))
                assert np.frombuffer(whole, "<u4").tolist() == texts[0]
                assert {n for _, _, n in by_doc[doc_id]} == {len(texts[0])}
            else:
                assert sum(len(x) // 4 for _, x, _ in by_doc[doc_id]) == sum(map(len, texts))
    assert p.pack(no_docs).count() == 0
