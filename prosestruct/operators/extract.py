"""Extractive summaries and keyphrases: the n best sentences or phrases of each document.

Scores are rounded to 12 places for ranking. Ties go to the earlier sentence, and to the phrase that sorts first: an
order the definitions leave open. Documents over a limit give no rows here; over_limit() reports them, and the engine's
extract() returns them as error rows beside the results.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import stop_list_sql
from ..schema import MAX_PHRASE_TOKENS, MAX_RANKED_SENTENCES

LIMITS = {"tfidf": MAX_RANKED_SENTENCES, "textrank": MAX_RANKED_SENTENCES, "rake": MAX_PHRASE_TOKENS, "yake": MAX_PHRASE_TOKENS}
DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-6, 50
PHRASE_TAGS = ("NOUN", "ADJ", "PROPN")


def _size(method: str) -> Column:
    return F.count(F.lit(1)) if method in ("tfidf", "textrank") else F.sum(F.size("tokens")).cast("long")


def over_limit(sentences: DataFrame, method: str, limit: int | None = None) -> DataFrame:
    """doc_id and actual size of the documents over a method's limit."""
    sizes = sentences.groupBy("doc_id").agg(_size(method).cast("long").alias("actual"))
    return sizes.where(F.col("actual") > (LIMITS[method] if limit is None else limit))


def _within(sentences: DataFrame, method: str) -> DataFrame:
    """Sentences of the documents within a method's limit, with `size`, what the limit counts. Nothing is computed twice."""
    size = F.sum(F.lit(1) if method in ("tfidf", "textrank") else F.size("tokens")).over(W.partitionBy("doc_id"))
    return sentences.withColumn("size", size.cast("long")).where(F.col("size") <= LIMITS[method])


#: Lemmas of a sentence that are neither signs nor stop words, in their own case.
TERMS = f"transform(filter(tokens, t -> NOT t.is_punct AND lower(t.lemma) NOT IN {stop_list_sql()}), t -> t.lemma)"


def _terms(sentences: DataFrame) -> DataFrame:
    """doc_id, sent_idx, term, n: how often each sentence has a term."""
    rows = sentences.select("doc_id", "sent_idx", F.explode(F.expr(TERMS)).alias("term"))
    return rows.groupBy("doc_id", "sent_idx", "term").agg(F.count(F.lit(1)).alias("n"))


def _top(scored: DataFrame, n: int, tie: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.round("score", 12).desc(), tie))
    return scored.withColumn("place", place).where(F.col("place") <= n).drop("place")


def tfidf_scores(sentences: DataFrame) -> DataFrame:
    """doc_id, position, text, score of each sentence: the mean over its distinct terms of tf * ln(N / df) in the document.

    Rows are a sentence's terms; windows by document put df beside them, so once documents lie together nothing moves. A
    sentence's text travels with its first term, and a sentence without terms is a row without one.
    """
    own = _within(sentences, "tfidf").select("doc_id", "sent_idx", "text", "size", F.posexplode_outer(F.expr(TERMS)).alias("at", "term"))
    first = F.coalesce(F.col("at") == 0, F.lit(True))
    counts = own.groupBy("doc_id", "sent_idx", "term").agg(F.count("term").alias("n"), F.max(F.when(first, F.col("text"))).alias("text"), F.max("size").alias("total"))
    df = F.count("term").over(W.partitionBy("doc_id", "term"))
    weights = counts.withColumn("weight", F.when(F.col("term").isNotNull(), F.col("n") * F.log(F.col("total") / F.greatest(df, F.lit(1)))))
    scores = weights.groupBy("doc_id", "sent_idx").agg(F.max("text").alias("text"), F.try_divide(F.sum("weight"), F.sum("n") * F.count("term")).alias("score"))
    return scores.select("doc_id", F.col("sent_idx").alias("position"), "text", F.coalesce("score", F.lit(0.0)).alias("score"))


def tfidf_summary(sentences: DataFrame, n: int) -> DataFrame:
    return _top(tfidf_scores(sentences), n, "position")


def similarity(sentences: DataFrame) -> DataFrame:
    """doc_id, i < j, sim: shared terms, as often as both have them, by the logs of both numbers of distinct terms."""
    terms = _terms(sentences)
    sizes = terms.groupBy("doc_id", "sent_idx").agg(F.count(F.lit(1)).alias("k"))
    one = terms.select("doc_id", "term", F.col("sent_idx").alias("i"), F.col("n").alias("a"))
    two = terms.select("doc_id", "term", F.col("sent_idx").alias("j"), F.col("n").alias("b"))
    shared = one.join(two, ["doc_id", "term"]).where("i < j").groupBy("doc_id", "i", "j").agg(F.sum(F.least("a", "b")).alias("shared"))
    ki = sizes.select("doc_id", F.col("sent_idx").alias("i"), F.col("k").alias("ki"))
    kj = sizes.select("doc_id", F.col("sent_idx").alias("j"), F.col("k").alias("kj"))
    return shared.join(ki, ["doc_id", "i"]).join(kj, ["doc_id", "j"]).select("doc_id", "i", "j", (F.col("shared") / (F.log1p("ki") + F.log1p("kj"))).alias("sim"))


def _rank(number: np.ndarray, terms: list[list[str]]) -> np.ndarray:
    """Ranks of one document's sentences, by power iteration; the limit bounds them, and so the square of similarities."""
    n = len(number)
    lists: dict[str, list[tuple[int, int]]] = {}
    for i, own in enumerate(terms):
        for term, count in Counter(own).items():
            lists.setdefault(term, []).append((i, count))
    shared = np.zeros((n, n))
    for places in lists.values():
        if len(places) > 1:
            at, counts = np.array(places).T
            shared[at[:, None], at[None, :]] += np.minimum(counts[:, None], counts[None, :])
    size = np.log1p([len(set(own)) for own in terms])
    sim = np.divide(shared, size[:, None] + size[None, :], out=shared, where=shared > 0)
    np.fill_diagonal(sim, 0)
    out = sim.sum(axis=1)
    share = np.divide(sim, out[:, None], out=sim, where=out[:, None] > 0).T
    score = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        new = (1 - DAMPING) / n + DAMPING * (share @ score)
        moved = np.abs(new - score).max()
        score = new
        if moved < TOLERANCE:
            break
    return score


def textrank_scores(sentences: DataFrame) -> DataFrame:
    """doc_id, position, text, score of each sentence: its rank in the similarity graph of its document.

    The graph is made where the document's sentences lie: edges are at most the square of the limit, and are never rows.
    """
    own = _within(sentences, "textrank").select("doc_id", "sent_idx", "text", F.expr(TERMS).alias("terms"))

    def rank(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("sent_idx")
        scores = _rank(rows["sent_idx"].to_numpy(), rows["terms"].to_pylist())
        return pa.table({"doc_id": rows["doc_id"], "position": rows["sent_idx"], "text": rows["text"], "score": pa.array(scores, pa.float64())})

    return own.groupBy("doc_id").applyInArrow(rank, "doc_id long, position int, text string, score double")


def textrank_summary(sentences: DataFrame, n: int) -> DataFrame:
    return _top(textrank_scores(sentences), n, "position")


def rake_scores(sentences: DataFrame) -> DataFrame:
    """doc_id, phrase, score: runs of nouns and adjectives, scored by the sum of degree / frequency over their words.

    Runs are found in the sentence's row: its words in one string, cut at the boundaries. Control characters 1 to 3 mark
    boundaries, words and runs, so no word holds them. A phrase joined in several ways has the best of their scores.
    """
    cut = f"t.is_punct OR lower(t.lemma) IN {stop_list_sql()} OR t.pos NOT IN ('{"', '".join(PHRASE_TAGS)}')"
    marked = F.expr(f"array_join(transform(tokens, t -> IF({cut}, '\u0001', concat('\u0002', lower(t.lemma)))), '')")
    runs = F.filter(F.split(marked, "\u0001+"), lambda r: r != "")
    phrases = _within(sentences, "rake").select("doc_id", "sent_idx", F.posexplode(runs).alias("run", "phrase"))
    words = F.split(F.expr("substring(phrase, 2)"), "\u0002")
    each = phrases.select("doc_id", "sent_idx", "run", F.posexplode(words).alias("at", "word"), F.size(words).alias("k"), F.col("phrase"))
    by_word = W.partitionBy("doc_id", "word")
    scored = each.withColumn("s", F.sum("k").over(by_word) / F.count(F.lit(1)).over(by_word))
    by_run = scored.groupBy("doc_id", "sent_idx", "run").agg(F.max(F.when(F.col("at") == 0, F.col("phrase"))).alias("phrase"), F.sum("s").alias("s"))
    return by_run.groupBy("doc_id", F.translate(F.expr("substring(phrase, 2)"), "\u0002", " ").alias("phrase")).agg(F.max("s").alias("score"))


def rake_phrases(sentences: DataFrame, n: int) -> DataFrame:
    return _top(rake_scores(sentences), n, "phrase")


def yake_scores(sentences: DataFrame) -> DataFrame:
    """doc_id, phrase, score: one to three terms in a row, by position, spread of neighbours and frequency; more is better.

    Neighbours are found in the sentence's row. What a term has in its document comes from windows by document and term: a
    row for each of its neighbours, of which one speaks for the term, and the first with a new neighbour counts it.
    """
    stop = f"NOT IN {stop_list_sql()}"
    w = "transform(filter(tokens, t -> NOT t.is_punct), t -> lower(t.lemma))"
    own = _within(sentences, "yake").select("doc_id", "sent_idx", F.expr(w).alias("w"))
    before = W.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("start", F.coalesce(F.sum(F.size("w")).over(before), F.lit(0))).withColumn("total", F.sum(F.size("w")).over(W.partitionBy("doc_id")))
    near = f"filter(array(try_element_at(w, IF(i > 0, i, size(w) + 1)), try_element_at(w, i + 2)), x -> x IS NOT NULL AND x {stop})"
    terms = f"filter(transform(w, (x, i) -> named_struct('w', x, 'at', i, 'near', {near})), t -> t.w {stop} AND octet_length(t.w) > 1)"
    rows = own.select("doc_id", "sent_idx", "start", "total", F.explode(F.expr(terms)).alias("t")).select("doc_id", "sent_idx", "start", "total", "t.w", "t.at", F.posexplode_outer("t.near").alias("i", "x"))
    by_neighbour, by_term = W.partitionBy("doc_id", "w", "x").orderBy("sent_idx", "at", "i"), W.partitionBy("doc_id", "w")
    rows = rows.withColumn("new", (F.col("x").isNotNull() & (F.row_number().over(by_neighbour) == 1)).cast("int")).withColumn("speaks", F.coalesce(F.col("i") == 0, F.lit(True)))
    place = F.when(F.col("speaks"), F.col("start") + F.col("at"))
    spread = F.coalesce(F.sum("new").over(by_term) / F.nullif(F.count("x").over(by_term), F.lit(0)), F.lit(0.0))
    size = F.greatest(F.lit(1), F.col("total"))
    score = (F.log1p(F.avg(place).over(by_term) / size) + spread) / (F.count(place).over(by_term) / size + 1)
    scored = rows.withColumn("s", score).where("speaks").select("doc_id", "sent_idx", "at", "w", "s")
    in_order = W.partitionBy("doc_id", "sent_idx").orderBy("at")
    grams = scored
    for k in (1, 2):
        grams = grams.withColumn(f"w{k}", F.lead("w", k).over(in_order)).withColumn(f"s{k}", F.lead("s", k).over(in_order))
    options = F.array(
        F.struct(F.col("w").alias("phrase"), F.col("s").alias("p")),
        F.struct(F.concat_ws(" ", "w", "w1").alias("phrase"), (F.col("s") * F.col("s1")).alias("p")),
        F.struct(F.concat_ws(" ", "w", "w1", "w2").alias("phrase"), (F.col("s") * F.col("s1") * F.col("s2")).alias("p")),
    )
    found = grams.select("doc_id", F.explode(options).alias("g")).where("g.p IS NOT NULL")
    least = found.groupBy("doc_id", F.col("g.phrase").alias("phrase")).agg(F.min("g.p").alias("p")).where("p > 0 AND NOT isnan(p) AND p < double('infinity')")
    return least.select("doc_id", "phrase", (1 / F.col("p")).alias("score"))


def yake_phrases(sentences: DataFrame, n: int) -> DataFrame:
    return _top(yake_scores(sentences), n, "phrase")
