"""The engine: gates, decomposition, parse, detections, metrics. Everything is lazy; a caller persists what it uses twice."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decompose as D
from ..operators import extract, metrics, nest
from ..operators.detect import detect
from ..sources import ingest, models, providers

EXTRACTORS = {
    "tfidf": extract.tfidf_summary, "textrank": extract.textrank_summary, "rake": extract.rake_phrases, "yake": extract.yake_phrases,
}


@dataclass(frozen=True)
class Annotated:
    """Documents that passed the gates, by level; sentences carry tokens and detections."""

    raw: DataFrame
    paragraphs: DataFrame
    sentences: DataFrame
    errors: DataFrame


@dataclass(frozen=True)
class Engine:
    """provider turns paragraphs into sentences with tokens; decomposers turn a format's documents into paragraphs."""

    provider: providers.Provider = providers.rules
    decomposers: dict[str, D.Decomposer] = field(default_factory=lambda: dict(D.DECOMPOSERS))
    suite: tuple[metrics.Metric, ...] = metrics.SUITE

    @classmethod
    def from_path(cls, path: str) -> Engine:
        """With the statistical parser of a model file."""
        return cls(providers.udpipe(path))

    @classmethod
    def from_bytes(cls, model: bytes) -> Engine:
        return cls(providers.udpipe(model))

    @classmethod
    def english(cls, folder: str, fetch: Callable[[str], None] | None = None) -> Engine:
        """With the English model, checked by size and digest; `fetch` may download it to a path it is given."""
        return cls(providers.udpipe(models.load(folder, models.ENGLISH, fetch)))

    def parse(self, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(paragraphs, sentences with tokens) of documents that passed the gates, which lie together by doc_id.

        A union forgets how its parts lie, so with several formats it is paragraphs that are dealt out, not texts.
        """
        alone = len(self.decomposers) == 1
        paragraphs = D.decompose(ingest.spread(raw) if alone else raw, self.decomposers)
        paragraphs = paragraphs if alone else ingest.spread(paragraphs)
        return paragraphs, self.provider(paragraphs.where("para_idx IS NOT NULL"))

    def gated(self, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(documents that can be parsed, doc_id / path / error of the others): by the gates, then by the provider's failures."""
        good, errors = ingest.split_errors(ingest.gate(raw, tuple(self.decomposers)))
        failures = getattr(self.provider, "failures", None)
        if failures is None:
            return good, errors
        found = failures(D.decompose(good, self.decomposers).where("para_idx IS NOT NULL")).withColumnRenamed("doc_id", "failed")
        failed = good.join(found, F.col("doc_id") == F.col("failed")).select("doc_id", "path", ingest.error("ParseFailed", F.concat(F.lit("parse failed: "), "message")).alias("error"))
        return good.join(found, F.col("doc_id") == F.col("failed"), "left_anti"), errors.unionByName(failed)

    def annotate(self, raw: DataFrame) -> Annotated:
        good, errors = self.gated(raw)
        paragraphs, sentences = self.parse(good)
        return Annotated(good, paragraphs, detect(sentences), errors)

    def compose(self, a: Annotated) -> tuple[DataFrame, DataFrame]:
        """(paragraph rows with metrics, document rows with metrics)."""
        return metrics.paragraph_metrics(a.paragraphs, a.sentences, self.suite), metrics.document_metrics(a.raw, a.paragraphs, a.sentences)

    def analyze(self, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(documents as nested rows, errors): together as many as there were documents."""
        good, errors = self.gated(raw)
        # Joins leave such rows out anyway; if only some branches do so, each moves the texts once more.
        good = good.where("doc_id IS NOT NULL")
        paragraphs, sentences = self.parse(good)
        sentences = detect(sentences)
        paragraph_rows = metrics.paragraph_metrics(paragraphs, sentences, self.suite)
        for name in nest.METRICS:
            if name not in paragraph_rows.columns:
                paragraph_rows = paragraph_rows.withColumn(name, F.lit(None).cast("double"))
        return nest.nest(good.select("doc_id", "path"), paragraphs, paragraph_rows, sentences), errors

    def extract(self, raw: DataFrame, method: str = "tfidf", n: int = 3) -> tuple[DataFrame, DataFrame]:
        """(the n best sentences or phrases of each document, doc_id / path / error of documents that have none of their own:
        unfit, not parsed, or over the method's limit). With n = 0 there is nothing to rank, so no limit either."""
        good, errors = self.gated(raw)
        sentences = self.parse(good)[1]
        if n > 0:
            over = extract.over_limit(sentences, method).withColumnRenamed("doc_id", "over")
            large = good.join(over, F.col("doc_id") == F.col("over")).select("doc_id", "path", ingest.too_large(method, F.col("actual"), extract.LIMITS[method]).alias("error"))
            errors = errors.unionByName(large)
        return EXTRACTORS[method](sentences, n), errors

    def summarize(self, raw: DataFrame, method: str = "tfidf", n: int = 3) -> DataFrame:
        """The results of extract() alone; its errors are what is missing here."""
        return self.extract(raw, method, n)[0]

    keyphrases = summarize

    def extract_errors(self, raw: DataFrame, method: str, limit: int | None = None) -> DataFrame:
        """doc_id and error of the documents over an extractor's limit."""
        over = extract.over_limit(self.parse(self.gated(raw)[0])[1], method, limit)
        most = extract.LIMITS[method] if limit is None else limit
        return over.select("doc_id", ingest.too_large(method, F.col("actual"), most).alias("error"))

    def extract_one(self, spark: SparkSession, text: str, method: str = "tfidf", n: int = 3) -> list[dict]:
        """Results of one text, always read as plain, in order; raises what an error row stands for."""
        rows, errors = self.extract(ingest.text_source(spark, text), method, n)
        for row in errors.collect():
            ingest.raise_error(row.error.asDict())
        key = (lambda r: r["position"]) if method in ("tfidf", "textrank") else (lambda r: (-r["score"], r["phrase"]))
        return sorted((r.asDict() for r in rows.drop("doc_id").collect()), key=key)

    def analyze_one(self, spark: SparkSession, text: str, format: str = "plain") -> dict:
        """One document as nested dicts; raises what an error row stands for."""
        documents, errors = self.analyze(ingest.text_source(spark, text, format))
        for row in errors.collect():
            ingest.raise_error(row.error.asDict())
        return documents.drop("doc_id").first().asDict(recursive=True)
