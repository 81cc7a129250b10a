r"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is built from SQL functions.  A pattern's matches and the pieces of text between them
(``regexp_extract_all`` and ``split``) give the positions of the spans, in code points.  The
patterns are written so that a search never backs up over a run of characters it has already
seen (possessive repeats, no start in the middle of a run), hence in linear time on any text.

Kinds: ``email``, ``ip`` (parts up to 255), ``card`` (Luhn), ``phone`` (9 to 15 digits); the context
method adds ``iban`` (mod-97) and ``id`` (three, two and four digits, as in a tax or insurance
number).  A kind starts with a score, a passed checksum counts most, and words such as "account" or
"insurance" within ``WINDOW`` characters before the span add to it, words that speak of samples
take away.  Base kinds are always kept; the added kinds are kept from ``THRESHOLD`` on.

Defined results: a null text is the empty text and has no spans; rows repeat as in the input; any
``doc_id`` is allowed, null too; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import free_name, text_of

LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,4})?\b",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# What a text must contain at all for the pattern to be tried.
NEEDLES = {"email": "@", "phone": "+", "id": "-"}
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "id")
SCORES = {"email": 1.0, "ip": 1.0, "card": 1.0, "phone": 1.0, "iban": 0.9, "id": 0.4}
RAISING = r"(?i)\b(?:iban|bank|account|konto|cuenta|compte|ssn|social|security|insurance|tax|passport|identity)\b"
LOWERING = r"(?i)\b(?:example|sample|test|dummy|invoice|order|version)\b"
WINDOW = 40
RAISE, LOWER, THRESHOLD = 0.3, 0.3, 0.6
SPAN = "array<struct<kind:string,start:bigint,stop:bigint,score:double>>"


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""
    n = F.length(digits)

    def weighed(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + weighed(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number without blanks leaves 1 when its rotated digits are divided by 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c <= 57, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, found: Column) -> Column:
    """The check that a match of ``kind`` has to pass."""
    digits = F.regexp_replace(found, r"[^0-9]", "")
    if kind == "card":
        long_enough = F.length(digits).between(13, 19)
        return F.when(long_enough, luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "ip":
        part = r"0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]|)"
        return found.rlike(rf"^(?:{part}\.){{3}}{part}$")
    if kind == "iban":
        code = F.regexp_replace(found, r"\x20", "")
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    return F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind, in order: kind, start, stop (exclusive), score."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    zero = F.lit(0).cast("bigint")
    empty = F.array().cast(SPAN)
    before = F.aggregate(
        F.arrays_zip(found.alias("f"), F.slice(between, 1, F.size(found)).alias("g")),
        F.struct(zero.alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + F.length(x["f"])).cast("bigint").alias("at"),
            F.when(
                confirmed(kind, x["f"]),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            F.lit(kind).alias("kind"),
                            (acc["at"] + F.length(x["g"])).cast("bigint").alias("start"),
                            (acc["at"] + F.length(x["g"]) + F.length(x["f"])).cast("bigint").alias("stop"),
                            score(kind, x["g"]).alias("score"),
                        )
                    ),
                ),
            ).otherwise(acc["out"]).alias("out"),
        ),
    )["out"]
    wanted = F.filter(before, lambda s: s["score"] >= THRESHOLD) if kind in ADDED else before
    needle = NEEDLES.get(kind)
    worth = text.contains(needle) if needle else text.rlike(r"[0-9]{2}" if kind == "iban" else r"[0-9]")
    return F.when(worth, wanted).otherwise(empty)


def score(kind: str, gap: Column) -> Column:
    """A kind's score, adjusted by the words in the gap before the span."""
    near = F.right(gap, F.lit(WINDOW))
    return (
        F.lit(SCORES[kind])
        + F.when(near.rlike(RAISING), RAISE).otherwise(0.0)
        - F.when(near.rlike(LOWERING), LOWER).otherwise(0.0)
    )


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
    )


def with_spans(docs: DataFrame, name: str, column: str = "text") -> DataFrame:
    """``docs`` with a struct ``name`` of one span array per kind."""
    text = text_of(docs, column)
    return docs.withColumn(
        name, F.struct(*[spans_of(text, k).alias(k) for k in (*BASE, *ADDED)])
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, a digest of the base spans, and all spans as text."""
    s = free_name(docs, "spans_by_kind")
    found = with_spans(docs.select("doc_id", "text"), s)
    base = F.concat(*[F.col(f"{s}.{k}") for k in BASE])
    every = F.concat(*[F.col(f"{s}.{k}") for k in (*BASE, *ADDED)])
    return found.select(
        "doc_id",
        *[F.size(f"{s}.{k}").cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with every span of ``column`` replaced by its kind in brackets.

    Where spans overlap, the one that starts first (the longer one on a tie) gives its name to
    their union.  A null text stays null.
    """
    s = free_name(docs, "spans_by_kind")
    found = with_spans(docs, s, column)
    every = F.concat(*[F.col(f"{s}.{k}") for k in (*BASE, *ADDED)])
    ordered = F.array_sort(
        F.transform(every, lambda x: F.struct(x["start"], (-x["stop"]).alias("neg"), x["kind"]))
    )
    text = F.col(f"`{column}`")
    zero = F.lit(0).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        stop = -x["neg"]
        fresh = x["start"] >= acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.struct(
            F.greatest(acc["at"], stop).alias("at"),
            F.when(
                fresh,
                F.concat(acc["out"], F.array(F.concat(gap, F.lit("["), F.upper(x["kind"]), F.lit("]")))),
            ).otherwise(acc["out"]).alias("out"),
        )

    rebuilt = F.aggregate(
        ordered,
        F.struct(zero.alias("at"), F.array().cast("array<string>").alias("out")),
        step,
        lambda acc: F.concat(
            F.array_join(acc["out"], ""),
            F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)),
        ),
    )
    return found.withColumn(column, F.when(F.size(every) > 0, rebuilt).otherwise(text)).select(
        *[f"`{c}`" for c in docs.columns]
    )
