from collections import defaultdict

import corpus_pipeline as p
from sensorspark.llm import order_minhash, pii, quality_rules
from sensorspark.session import materialize
from tests_llm_data import SF_DIR, documents, labels


def test_stages_take_effect(spark):
    docs = documents(spark)
    shapes, tables = docs.columns, [docs]
    for name, stage in p.STAGES:
        tables.append(materialize(stage(spark, tables[-1], SF_DIR), name))
    good, single, clean, mixed, packed = tables[1:]
    for t in (good, single, clean, mixed):
        assert t.columns == shapes
    kept = {r.doc_id for r in quality_rules.report(docs, labels(spark)).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    heads = {r.class_id for r in order_minhash.class_ids(good).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(heads)
    assert {r.doc_id for r in clean.collect()} == heads
    left = pii.digest(clean).selectExpr("sum(n_email + n_ip + n_card + n_phone) AS n").first().n
    assert left == 0
    assert clean.where("n_chars != length(text)").count() == 0
    assert {r.doc_id for r in mixed.collect()} <= heads
    tokens = defaultdict(int)
    for r in packed.collect():
        tokens[r.doc_id] += r.length
    assert set(tokens) == {r.doc_id for r in mixed.collect()}
    again = p.run(spark, SF_DIR)
    assert again.drop("sequence_id", "offset").exceptAll(packed.drop("sequence_id", "offset")).count() == 0
    assert again.count() == packed.count()


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in p.STAGES:
            out = stage(spark, docs, SF_DIR)
            if name != "packing":
                assert out.columns == docs.columns
            out.count()
