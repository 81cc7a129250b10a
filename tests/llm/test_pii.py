import hashlib
import random
import re

from sensorspark.llm import pii
from tests_llm_data import documents

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def by_hand(text):
    out = {k: [] for k in BASE}
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            s, digits = m[0], re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out[kind].append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.digest(table).collect():
        want = by_hand(texts[r.doc_id])
        flat = [x for k in BASE for x in want[k]]
        assert [r[f"n_{k}"] for k in BASE] == [len(want[k]) for k in BASE], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(flat).encode()).hexdigest(), texts[r.doc_id]
        assert [x for x in r.spans.split(",") if x.split(":")[0] in BASE] == flat


def test_base_spans_equal_brute_force(spark):
    draw = random.Random(3)
    texts = [None, "", "a@b.c_d@e.f", "a@b@c.d", "x@y", "1.2.3.4.5.6.7.8", "0001.0.00255.9", "256.1.1.1", "1.2.3"]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1112", "9" * 40, "+1 (2) 3.4-5 6 7 8 9", "+12 3", "++49 123456789"]
    texts += ["🙂é a@b.io 🙂 +49 30 123456 7", "a" * 50_000 + "@b.c", "1" * 30_000, ("1 " * 20_000), "+" * 9000]
    texts += ["99999999999999999999.1.1.1", "%@-.-", "a.@b-.c", "a@b.c.", "@a.b"]
    alphabet = ["a", "b", "@", ".", "1", "23", "255", "256", "+", " ", "-", "(", ")", "é", "_", "4111111111111111"]
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 40))) for _ in range(800)]
    check(spark, texts)


def test_given_documents(spark):
    check(spark, [r.text for r in documents(spark).collect()])


def test_checksums_and_context_add_spans(spark):
    texts = [
        "IBAN DE89 3704 0044 0532 0130 00 here",
        "GB82WEST12345698765432",
        "DE88 3704 0044 0532 0130 00",
        "my social security number is 123-45-6789 ok",
        "part 123-45-6789 of it",
        "security sample 123-45-6789",
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith(("iban", "id"))] for r in pii.digest(table).collect()}
    assert got[0] == ["iban:5:32"] and got[1] == ["iban:0:22"] and got[2] == []
    assert got[3] == ["id:29:40"] and got[4] == [] and got[5] == []


def test_redaction(spark, odd_docs, no_docs):
    texts = ["mail a@b.io, call +49 30 1234567!", None, "no data", "🙂 a@b.io", "+4111 1111 1111 1111"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r.text for r in pii.redact(table).orderBy("doc_id").collect()]
    assert got[:4] == ["mail [EMAIL], call [PHONE]!", None, "no data", "🙂 [EMAIL]"]
    assert not re.search(r"[0-9]", got[4])
    out = pii.redact(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert pii.redact(no_docs).count() == 0 and pii.digest(no_docs).count() == 0
    assert pii.digest(odd_docs).count() == odd_docs.count()


def test_no_python_in_the_plan(spark, odd_docs):
    plan = pii.digest(odd_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
