"""Metrics of paragraphs, documents and the corpus. Null says that a metric wasn't computed, which isn't 0."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lexical_density, readability
from ..functions.tree import is_passive, word_count
from ..schema import MAX_COMPRESSED_BYTES, NOMINAL_ENDINGS, PASSIVE_DEPS, sql_list

#: A paragraph's metrics need more words than these, counted as tokens of its sentences.
READABILITY_WORDS, COMPRESSION_WORDS = 10, 50
Metric = Callable[[DataFrame], DataFrame]


def paragraph_words(paragraphs: DataFrame, sentences: DataFrame) -> DataFrame:
    """Adds word_count and sentence_count; both 0 for paragraphs without sentences, such as blockquotes."""
    counts = sentences.groupBy("doc_id", "para_idx").agg(F.sum(word_count()).alias("word_count"), F.count(F.lit(1)).alias("sentence_count"))
    joined = paragraphs.where("para_idx IS NOT NULL").join(counts, ["doc_id", "para_idx"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("word_count", "sentence_count")})


def readability_metric(p: DataFrame) -> DataFrame:
    return p.withColumn("readability_grade", F.when((F.col("word_count") > READABILITY_WORDS) & ~F.col("in_blockquote"), readability(F.col("text"))))


def density_metric(p: DataFrame) -> DataFrame:
    return p.withColumn("lexical_density", F.when((F.col("word_count") != 0) & ~F.col("in_blockquote"), lexical_density(F.col("text"))))


def compression_metric(p: DataFrame) -> DataFrame:
    """Compressed bytes by bytes, with Brotli at level 6. Only texts that qualify are sent to Python, as Arrow batches."""
    fits = (F.col("word_count") > COMPRESSION_WORDS) & ~F.col("in_blockquote") & (F.octet_length("text") <= MAX_COMPRESSED_BYTES)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = pa.Codec("brotli", compression_level=6)
        for texts in parts:
            raw = [None if t is None else t.encode() for t in texts.to_pylist()]
            yield pa.array([None if not r else len(codec.compress(r)) / len(r) for r in raw], pa.float64())

    ratio = F.arrow_udf(run, "double")
    return p.withColumn("compression_ratio", ratio(F.when(fits, F.col("text"))))


#: The default suite; order doesn't matter and any may be left out.
SUITE: tuple[Metric, ...] = (readability_metric, density_metric, compression_metric)


def paragraph_metrics(paragraphs: DataFrame, sentences: DataFrame, suite: tuple[Metric, ...] = SUITE) -> DataFrame:
    out = paragraph_words(paragraphs, sentences)
    for metric in suite:
        out = metric(out)
    return out


def sentence_facts(sentences: DataFrame) -> DataFrame:
    """Keys, words, is_passive of each sentence."""
    return sentences.select("doc_id", "section_idx", "para_idx", "sent_idx", word_count().alias("words"), is_passive().alias("is_passive"))


def document_metrics(raw: DataFrame, paragraphs: DataFrame, sentences: DataFrame) -> DataFrame:
    """A row for each document of raw: totals, sentence lengths, the three ratios, null where nothing was there to count, and
    passive_share, the passive ratio with 0.0 for a document without sentences.

    One pass over the sentences: a row for each of a sentence's lemmas, the first of which carries the sentence's own facts.
    They are added up by (doc_id, lemma) first, so that a document of any length is aggregated in parts.
    """
    ending = " OR ".join(f"endswith(low, '{e}')" for e in NOMINAL_ENDINGS)
    nominal = f"IF(t.pos = 'NOUN', element_at(transform(array(lower(t.text)), low -> cast({ending} AS BIGINT)), 1), 0L)"
    # What a lambda needs of the whole sentence is computed for the first token only; beside explode it would be for each.
    words, passive = "cast(size(filter(tokens, x -> NOT x.is_punct)) AS BIGINT)", f"cast(exists(tokens, x -> x.dep IN {sql_list(PASSIVE_DEPS)}) AS BIGINT)"
    own = f"IF(i = 0, element_at(transform(array({words}), w -> named_struct('n', 1L, 'words', w, 'squares', w * w, 'passive', {passive})), 1), NULL)"
    facts = f"transform(tokens, (t, i) -> named_struct('lemma', IF(t.is_punct, NULL, t.lemma), 'nominal', {nominal}, 'own', {own}))"
    none = "array(named_struct('lemma', cast(NULL AS STRING), 'nominal', 0L, 'own', named_struct('n', 1L, 'words', 0L, 'squares', 0L, 'passive', 0L)))"
    rows = sentences.select("doc_id", F.explode(F.expr(f"IF(size(tokens) > 0, {facts}, {none})")).alias("t"))
    by_lemma = rows.groupBy("doc_id", "t.lemma").agg(
        F.count("t.lemma").alias("n"), F.sum("t.nominal").alias("nominal"), F.sum("t.own.n").alias("sentences"), *(F.sum(f"t.own.{c}").alias(c) for c in ("words", "squares", "passive"))
    )
    by_document = by_lemma.groupBy("doc_id").agg(
        F.count("lemma").alias("lemmas"), *(F.sum(c).alias(c) for c in ("n", "nominal", "sentences", "words", "squares", "passive"))
    )
    by_paragraph = paragraphs.where("para_idx IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraph_count"))
    out = raw.select("doc_id").join(by_document, "doc_id", "left").join(by_paragraph, "doc_id", "left")
    zero, nothing = F.lit(0).cast("long"), F.lit(0.0)
    count = F.col("sentences").cast("double")
    # The sums are whole numbers, so the spread is exact up to the last division.
    spread = F.when(F.col("sentences") > 1, F.sqrt((F.col("sentences") * F.col("squares") - F.col("words") * F.col("words")).cast("double") / (count * (count - 1))))
    return out.select(
        "doc_id", F.coalesce("paragraph_count", zero).alias("paragraph_count"), F.coalesce("sentences", zero).alias("total_sentences"),
        F.coalesce("words", zero).alias("total_words"), F.coalesce(F.col("words") / count, nothing).alias("mean_sentence_length"), F.coalesce(spread, nothing).alias("sentence_length_std"),
        F.when(F.col("n") > 0, F.col("lemmas") / F.col("n")).alias("vocabulary_ttr"), F.when(F.col("n") > 0, F.col("nominal") / F.col("n")).alias("nominalization_ratio"),
        (F.col("passive") / count).alias("passive_ratio"), F.coalesce(F.col("passive") / count, nothing).alias("passive_share"),
    )


def section_breakdown(paragraphs: DataFrame, sentences: DataFrame) -> DataFrame:
    """Heading (cut at 45 characters; "(intro)" without one), level, paragraphs, sentences and words of each section."""
    counts = sentence_facts(sentences).groupBy("doc_id", "section_idx").agg(F.count(F.lit(1)).alias("sentences"), F.sum("words").alias("words"))
    sections = paragraphs.groupBy("doc_id", "section_idx").agg(F.max("heading").alias("heading"), F.max("level").cast("int").alias("level"), F.count("para_idx").alias("paragraphs"))
    zero = F.lit(0).cast("long")
    return sections.join(counts, ["doc_id", "section_idx"], "left").select(
        "doc_id", "section_idx", F.coalesce(F.substring("heading", 1, 45), F.lit("(intro)")).alias("heading"), "level", "paragraphs",
        F.coalesce("sentences", zero).alias("sentences"), F.coalesce("words", zero).alias("words"),
    )


def corpus_metrics(paragraph_rows: DataFrame, sentences: DataFrame) -> DataFrame:
    """One row: words, passive share over all sentences, mean grade over all paragraphs that have one; 0 without any."""
    words = sentence_facts(sentences).agg(
        F.coalesce(F.sum("words"), F.lit(0).cast("long")).alias("total_words"), F.coalesce(F.avg(F.col("is_passive").cast("double")), F.lit(0.0)).alias("passive_ratio")
    )
    grades = paragraph_rows.agg(F.coalesce(F.avg("readability_grade"), F.lit(0.0)).alias("mean_readability"))
    return words.withColumn("k", F.lit(1)).join(grades.withColumn("k", F.lit(1)), "k").drop("k")
