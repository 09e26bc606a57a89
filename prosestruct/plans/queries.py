"""Registered queries: each operator over whole tables, or over literal trees where texts can't show what it does.

Documents have no empty lines, so line feeds are doubled to give paragraphs; Markdown is made from a document's lines by
their numbers. The oracles derive their input in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, tree
from ..operators import decompose, extract, metrics
from ..operators.detect import detect
from ..schema import TOKENS
from ..sources import ingest, providers
from .engine import Engine
from .fixtures import FEATS, PATHS, SENTENCES, STATED

Query = Callable[[SparkSession, str], DataFrame]
TOP = 5
QUERIES: dict[str, Query] = {}
PLAIN = Engine(decomposers={"plain": decompose.plain})
#: Limits low enough for some documents to be over them.
FEW_SENTENCES, FEW_TOKENS = 50, 500


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For work that a scan of few files would do in few tasks."""
    rows = documents(spark, sf_dir)
    return rows if rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else ingest.spread(rows)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    return documents(spark, sf_dir).select("doc_id", F.lit(None).cast("string").alias("path"), doubled.alias("text"), F.lit("plain").alias("format"))


def raw_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line i becomes a heading if i % 7 = 0, a quote if i % 5 = 3, code fence if i % 17 = 9, a table row if i % 11 = 4; then a blank if i % 3 = 2."""
    made = """array_join(transform(split(coalesce(text, ''), '\n'), (l, i) -> concat(CASE WHEN i % 7 = 0 THEN '## ' WHEN i % 5 = 3 THEN '> ' WHEN i % 17 = 9 THEN '```'
      WHEN i % 11 = 4 THEN '| ' ELSE '' END, l, IF(i % 3 = 2, '\n', ''))), '\n')"""
    return documents(spark, sf_dir).select("doc_id", F.lit(None).cast("string").alias("path"), F.expr(made).alias("text"), F.lit("markdown").alias("format"))


def raw_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document is named a PDF, which no decomposer takes; of the others odd ones are Markdown and even ones plain."""
    pdf, odd = F.col("doc_id") % 5 == 0, F.col("doc_id") % 2 == 1
    even = raw(spark, sf_dir).where(~odd).withColumn("format", F.when(pdf, "pdf").otherwise("plain"))
    return even.unionByName(raw_markdown(spark, sf_dir).where(odd).withColumn("format", F.when(pdf, "pdf").otherwise("markdown")))


def raw_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts have next to no negations or modals, so each gets one of three paragraphs that do, by its number."""
    stated = F.element_at(F.array(*map(F.lit, STATED)), (F.col("doc_id") % len(STATED) + 1).cast("int"))
    return raw(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n\n"), stated))


def parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return PLAIN.parse(raw(spark, sf_dir))


def trees(spark: SparkSession) -> DataFrame:
    """Literal sentences: sent, tokens."""
    rows = [(sent, [(i, t, lemma, pos, "_", feats, head, dep, "_", misc, pos == "PUNCT") for i, t, lemma, pos, feats, head, dep, misc in tokens]) for sent, tokens in SENTENCES.items()]
    return spark.createDataFrame(rows, f"sent STRING, tokens {TOKENS}")


@query
def text_readability(spark, sf_dir):
    own = F.coalesce("text", F.lit(""))
    counted = text.let(text.pieces(own), lambda w: F.struct(F.size(w).alias("words"), text.syllable_sum(w).alias("syllables")))
    rows = spread_documents(spark, sf_dir).withColumn("c", counted)
    return rows.select("doc_id", F.col("c.words").cast("long").alias("words"), F.col("c.syllables").cast("long").alias("syllables"), F.round(text.grade(F.col("c.words"), F.col("c.syllables"), own), 6).alias("grade"))


@query
def text_lexical_density(spark, sf_dir):
    return spread_documents(spark, sf_dir).select("doc_id", F.round(text.lexical_density(F.coalesce("text", F.lit(""))), 9).alias("density"))


@query
def decompose_plain(spark, sf_dir):
    return decompose.plain(raw(spark, sf_dir)).select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "text")


@query
def decompose_markdown(spark, sf_dir):
    rows = decompose.markdown(raw_markdown(spark, sf_dir))
    return rows.select("doc_id", F.col("section_idx").cast("long").alias("section_idx"), F.col("para_idx").cast("long").alias("para_idx"), "heading", F.col("level").cast("long").alias("level"), "text", "in_blockquote")


@query
def decompose_mixed(spark, sf_dir):
    """Each document by the decomposer of its format, through the table of decomposers; formats without one give no rows."""
    rows = decompose.decompose(raw_mixed(spark, sf_dir))
    return rows.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("section_idx", "para_idx", "level")), "heading", "text", "in_blockquote")


@query
def tokens_rules(spark, sf_dir):
    rows = parsed(spark, sf_dir)[1].select("doc_id", "para_idx", "sent_idx", F.explode("tokens").alias("t"))
    return rows.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("para_idx", "sent_idx")), F.col("t.id").cast("long").alias("id"), "t.text", "t.lemma", "t.pos", "t.feats", F.col("t.head").cast("long").alias("head"), "t.dep", "t.is_punct")


@query
def sentence_stats(spark, sf_dir):
    return parsed(spark, sf_dir)[1].select(
        "doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), tree.word_count().alias("words"), tree.is_passive().alias("is_passive"), tree.tree_depth().alias("depth"),
        tree.root_token()["lemma"].alias("root_lemma"), F.size(tree.children_of(tree.root_sql() + ".id")).cast("long").alias("root_children"),
        F.octet_length(tree.rebuilt_text()).cast("long").alias("rebuilt_bytes"),
    )


def _detections(sentences: DataFrame, column: str, *fields: str) -> DataFrame:
    found = detect(sentences).select("doc_id", "sent_idx", F.explode(column).alias("d"))
    kind = dict(found.select("d.*").dtypes)
    return found.select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), *((F.col(f"d.{f}").cast("long") if kind[f] == "int" else F.col(f"d.{f}")).alias(f) for f in fields))


@query
def negations(spark, sf_dir):
    return _detections(parsed(spark, sf_dir)[1], "negations", "cue_id", "cue_lemma", "head_id")


@query
def modals(spark, sf_dir):
    return _detections(parsed(spark, sf_dir)[1], "modals", "aux_id", "aux_lemma", "head_id")


@query
def stated_negations(spark, sf_dir):
    return _detections(PLAIN.parse(raw_stated(spark, sf_dir))[1], "negations", "cue_id", "cue_lemma", "head_id")


@query
def stated_modals(spark, sf_dir):
    return _detections(PLAIN.parse(raw_stated(spark, sf_dir))[1], "modals", "aux_id", "aux_lemma", "head_id")


@query
def bare_assertions(spark, sf_dir):
    return detect(parsed(spark, sf_dir)[1]).where("bare_assertion").select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"))


@query
def reportings(spark, sf_dir):
    return _detections(parsed(spark, sf_dir)[1], "reportings", "verb_id", "verb_lemma", "ccomp_id", "subject_id", "subject_lemma")


@query
def root_adverbials(spark, sf_dir):
    return _detections(parsed(spark, sf_dir)[1], "root_adverbials", "adv_id", "adv_lemma")


@query
def reportings_in_lexicon(spark, sf_dir):
    """Root verbs with `ed` forms as a lexicon taken from the tokens themselves would be endless; a fixed one shows the filter."""
    found = detect(trees(spark)).select("sent", F.size(tree.in_lexicon("reportings", "verb_lemma", F.array(F.lit("say"), F.lit("claim")))).cast("long").alias("reportings"),
        F.size(tree.in_lexicon("root_adverbials", "adv_lemma", F.array(F.lit("reportedly"), F.lit("never")))).cast("long").alias("root_adverbials"))
    return found


@query
def hearst_pairs(spark, sf_dir):
    rows = detect(trees(spark)).select("sent", F.explode("hearst_pairs").alias("p"))
    return rows.select("sent", "p.pattern", *(F.col(f"p.{side}.{f}").cast("string" if f == "head_lemma" else "long").alias(f"{side}_{f}") for side in ("hypernym", "hyponym") for f in ("head_id", "head_lemma", "first_id", "last_id")))


@query
def tree_depths(spark, sf_dir):
    return trees(spark).select("sent", tree.tree_depth().alias("depth"))


@query
def subtrees(spark, sf_dir):
    each = trees(spark).select("sent", "tokens", F.explode("tokens.id").alias("top"))
    return each.select("sent", F.col("top").cast("long").alias("top"), F.explode(tree.subtree("top")).alias("t")).select("sent", "top", F.col("t.id").cast("long").alias("id"))


@query
def heads(spark, sf_dir):
    each = trees(spark).select("sent", "tokens", F.explode("tokens.id").alias("own"))
    return each.select("sent", F.col("own").cast("long").alias("id"), tree.head_of("own")["id"].cast("long").alias("head"), F.size(tree.children_of("own")).cast("long").alias("children"))


def _sentences(spark, sf_dir) -> DataFrame:
    """Parsed sentences of the whole table: doc_id, sent_idx, tokens."""
    return parsed(spark, sf_dir)[1].withColumn("sent_idx", F.col("sent_idx").cast("long"))


@query
def document_reportings_in_lexicon(spark, sf_dir):
    found = detect(_sentences(spark, sf_dir))
    return found.select("doc_id", "sent_idx", F.size(tree.in_lexicon("reportings", "verb_lemma", F.array(F.lit("claimed"), F.lit("reported"), F.lit("stated")))).cast("long").alias("reportings"),
        F.size(tree.in_lexicon("root_adverbials", "adv_lemma", F.array(F.lit("reportedly"), F.lit("never"), F.lit("not")))).cast("long").alias("root_adverbials"))


@query
def document_subtrees(spark, sf_dir):
    """Each token with all above it: the same pairs as subtree() of every token, by walks up as long as the tree is deep."""
    up = "try_element_at(tokens, element_at(s, -1)).head"
    walk = f"aggregate(sequence(1, greatest(1, cast(depth AS INT))), array(t.id), (s, k) -> IF({up} > 0, concat(s, array({up})), s))"
    pairs = F.expr(f"flatten(transform(tokens, t -> transform({walk}, a -> named_struct('id', cast(t.id AS BIGINT), 'top', cast(a AS BIGINT)))))")
    each = _sentences(spark, sf_dir).withColumn("depth", tree.tree_depth())
    return each.select("doc_id", "sent_idx", F.explode(pairs).alias("p")).select("doc_id", "sent_idx", "p.id", "p.top")


@query
def document_heads(spark, sf_dir):
    """head_of() and children_of() of every token, in the sentence's row: looked up by place, not by a filter for each."""
    head = "cast(IF(t.head > 0, try_element_at(tokens, greatest(1, t.head)).id, NULL) AS BIGINT)"
    each = F.expr(f"transform(tokens, t -> named_struct('id', cast(t.id AS BIGINT), 'head', {head}, 'children', cast(size(filter(heads, h -> h = t.id)) AS BIGINT)))")
    rows = _sentences(spark, sf_dir).withColumn("heads", F.expr("transform(tokens, t -> t.head)"))
    return rows.select("doc_id", "sent_idx", F.explode(each).alias("p")).select("doc_id", "sent_idx", "p.id", "p.head", "p.children")


@query
def feat_lookup(spark, sf_dir):
    rows = spark.createDataFrame(FEATS, "feats STRING, wanted STRING")
    return rows.select("feats", "wanted", text.feat("feats", "wanted").alias("value"))


@query
def formats(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in PATHS], "path STRING").select("path", ingest.detect_format(F.col("path")).alias("format"))


@query
def gates(spark, sf_dir):
    """Every fifth document is named a PDF and every seventh a DOCX, which no decomposer takes."""
    kind = F.when(F.col("doc_id") % 5 == 0, "pdf").when(F.col("doc_id") % 7 == 0, "docx").otherwise("plain")
    good, errors = ingest.split_errors(ingest.gate(documents(spark, sf_dir).select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"), "text", kind.alias("format"))))
    shown = errors.select("doc_id", "error.kind", ingest.display(F.col("path"), F.col("error")).alias("message"))
    return good.select("doc_id", F.lit("ok").alias("kind"), F.lit(None).cast("string").alias("message")).unionByName(shown)


@query
def paragraph_metrics(spark, sf_dir):
    paragraphs, sentences = parsed(spark, sf_dir)
    rows = metrics.paragraph_metrics(paragraphs, sentences, (metrics.readability_metric, metrics.density_metric))
    return rows.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "word_count", "sentence_count", F.round("readability_grade", 6).alias("readability_grade"), F.round("lexical_density", 9).alias("lexical_density"))


@query
def document_metrics(spark, sf_dir):
    rows = metrics.document_metrics(raw(spark, sf_dir), *parsed(spark, sf_dir))
    rounded = ("mean_sentence_length", "sentence_length_std", "vocabulary_ttr", "nominalization_ratio", "passive_ratio")
    return rows.select("doc_id", "paragraph_count", "total_sentences", "total_words", *(F.round(c, 8).alias(c) for c in rounded))


@query
def document_totals(spark, sf_dir):
    """What the command line shows of a document; a document without sentences has a passive share of 0, not null."""
    rows = metrics.document_metrics(raw(spark, sf_dir), *parsed(spark, sf_dir))
    return rows.select("doc_id", "total_sentences", "total_words", *(F.round(c, 8).alias(c) for c in ("mean_sentence_length", "passive_share")))


@query
def composed_paragraphs(spark, sf_dir):
    """The engine's own composition, with a suite in another order."""
    engine = Engine(decomposers={"plain": decompose.plain}, suite=(metrics.density_metric, metrics.readability_metric))
    rows = engine.compose(engine.annotate(raw(spark, sf_dir)))[0]
    return rows.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), F.round("lexical_density", 9).alias("lexical_density"), F.round("readability_grade", 6).alias("readability_grade"))


@query
def section_breakdown(spark, sf_dir):
    paragraphs, sentences = Engine(decomposers={"markdown": decompose.markdown}).parse(raw_markdown(spark, sf_dir))
    rows = metrics.section_breakdown(paragraphs, sentences)
    return rows.select("doc_id", F.col("section_idx").cast("long").alias("section_idx"), "heading", F.col("level").cast("long").alias("level"), "paragraphs", "sentences", "words")


@query
def corpus_metrics(spark, sf_dir):
    paragraphs, sentences = parsed(spark, sf_dir)
    rows = metrics.corpus_metrics(metrics.paragraph_metrics(paragraphs, sentences, (metrics.readability_metric,)), sentences)
    return rows.select("total_words", F.round("passive_ratio", 9).alias("passive_ratio"), F.round("mean_readability", 6).alias("mean_readability"))


@query
def compression_ratio(spark, sf_dir):
    rows = metrics.compression_metric(metrics.paragraph_words(*parsed(spark, sf_dir)))
    return rows.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), F.round("compression_ratio", 6).alias("compression_ratio"))


@query
def tfidf_topk(spark, sf_dir):
    rows = extract.tfidf_summary(parsed(spark, sf_dir)[1], TOP)
    return rows.select("doc_id", F.col("position").cast("long").alias("position"), F.round("score", 9).alias("score"))


@query
def textrank_topk(spark, sf_dir):
    rows = extract.textrank_summary(parsed(spark, sf_dir)[1], TOP)
    return rows.select("doc_id", F.col("position").cast("long").alias("position"), F.round("score", 6).alias("score"))


@query
def rake_topk(spark, sf_dir):
    return extract.rake_phrases(parsed(spark, sf_dir)[1], TOP).select("doc_id", "phrase", F.round("score", 9).alias("score"))


@query
def yake_topk(spark, sf_dir):
    # Scores span many powers of ten, so their logarithm is what can be rounded.
    return extract.yake_phrases(parsed(spark, sf_dir)[1], TOP).select("doc_id", "phrase", F.round(F.log("score"), 8).alias("log_score"))


@query
def conversation_sentences(spark, sf_dir):
    """The same provider on another table: sentences and words of each role."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.expr("conv_id * 1000 + turn").alias("doc_id"), "role", F.coalesce("text", F.lit("")).alias("text"))
    sentences = providers.rules(decompose.plain(ingest.spread(turns)))
    return turns.select("doc_id", "role").join(metrics.sentence_facts(sentences), "doc_id").groupBy("role").agg(F.count(F.lit(1)).alias("sentences"), F.sum("words").alias("words"))


@query
def analyzed_documents(spark, sf_dir):
    """Whole documents as nested rows, written as JSON: length of the JSON's parts by document."""
    nested, _ = Engine(suite=(metrics.readability_metric, metrics.density_metric)).analyze(raw(spark, sf_dir))
    return nested.select("doc_id", F.coalesce(F.size("sections"), F.lit(0)).cast("long").alias("sections"), F.coalesce(F.size(F.flatten("sections.paragraphs")), F.lit(0)).cast("long").alias("paragraphs"),
        F.round("vocabulary_ttr", 8).alias("vocabulary_ttr"))


@query
def json_round_trip(spark, sf_dir):
    """Analysed documents as JSON and read again: each sentence's bytes, tokens and detections."""
    nested, _ = Engine(decomposers={"plain": decompose.plain}, suite=()).analyze(raw_stated(spark, sf_dir))
    read = ingest.from_json(ingest.to_json(nested.drop("path")))
    rows = read.select("doc_id", F.posexplode(F.flatten(F.flatten("sections.paragraphs").getField("sentences"))).alias("at", "s"))
    sizes = (F.size(f"s.{c}").cast("long").alias(c) for c in ("tokens", "negations", "modals", "reportings", "root_adverbials"))
    return rows.select("doc_id", F.col("at").cast("long").alias("sent_idx"), *sizes, "s.bare_assertion")


def _over(spark, sf_dir, method: str, limit: int) -> DataFrame:
    rows = PLAIN.extract_errors(raw(spark, sf_dir), method, limit)
    return rows.select("doc_id", F.lit(method).alias("method"), "error.kind", "error.message")


@query
def extractor_limits(spark, sf_dir):
    """Documents over an extractor's limit, as errors; the limits are lowered to show some."""
    return _over(spark, sf_dir, "textrank", FEW_SENTENCES).unionByName(_over(spark, sf_dir, "rake", FEW_TOKENS))
