"""The registered queries of this package, one per operator, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sensorspark.llm import (
    chat_format,
    html_layout,
    lexical_search,
    mixing,
    oracles,
    order_minhash,
    packing,
    periodic_runs,
    pii,
    quality_rules,
    rp_forest,
    rule_ensemble,
    toxicity,
    url_filter,
)
from sensorspark.llm.common import prepare, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return build(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_rule_ensemble")
def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every whole text of ``documents``."""
    return rule_ensemble.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_html_layout")
def op2_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page, laid out."""
    return html_layout.extract(table(spark, sf_dir, "pages"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every whole text of ``documents``."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query("op4_url_filter", oracles.URLS)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    rules = url_filter.rule_table(spark, URL_RULES)
    return url_filter.judged(table(spark, sf_dir, "pages"), rules)


@query("op5_pii", oracles.PII)
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return pii.digest(table(spark, sf_dir, "documents"))


@query("op6_rp_forest")
def op6_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found for every embedding whose id is divisible by 50."""
    return rp_forest.neighbours(table(spark, sf_dir, "embeddings"))


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and risk-controlled verdict of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    report = quality_rules.report(docs, labels)
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return report.select("doc_id", *shown, "base_failed", "kept")


# English fills half of each domain, the other languages share the rest evenly; domains are even.
TARGETS = mixing.Mix(weights={"lang": {"en": 3.0, "de": 1.0, "fr": 1.0, "es": 1.0}})


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents chosen to meet the target weights, one row per epoch."""
    chosen = mixing.mixed(table(spark, sf_dir, "documents"), TARGETS)
    return chosen.select("doc_id", "mix.*")


@query("op10_order_minhash")
def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return order_minhash.class_ids(table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of words of every whole text of ``documents``."""
    return periodic_runs.digest(table(spark, sf_dir, "documents"))


@query("op12_chat_format", oracles.CHAT)
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and a hostile one, formatted and read back."""
    given = chat_format.with_hostile_conversation(table(spark, sf_dir, "conversations"))
    read = chat_format.digest(chat_format.pieces(given))
    return read.drop("n_attachments", "attachment_tokens")


@query("op13_lexical_search", oracles.SEARCH)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every ``benchmark`` item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
