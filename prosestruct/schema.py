"""Schemas and fixed values."""

from __future__ import annotations


TOKEN = (
    "id INT, text STRING, lemma STRING, pos STRING, xpos STRING, feats STRING, head INT, dep STRING, deps STRING, misc STRING, is_punct BOOLEAN"
)
TOKENS = f"ARRAY<STRUCT<{TOKEN.replace(' INT', ': INT').replace(' STRING', ': STRING').replace(' BOOLEAN', ': BOOLEAN')}>>"
_SPAN = "STRUCT<head_id: INT, head_lemma: STRING, first_id: INT, last_id: INT>"
DETECTIONS = {
    "negations": "ARRAY<STRUCT<cue_id: INT, cue_lemma: STRING, head_id: INT>>",
    "modals": "ARRAY<STRUCT<aux_id: INT, aux_lemma: STRING, head_id: INT>>",
    "bare_assertion": "BOOLEAN",
    "reportings": "ARRAY<STRUCT<verb_id: INT, verb_lemma: STRING, ccomp_id: INT, subject_id: INT, subject_lemma: STRING>>",
    "root_adverbials": "ARRAY<STRUCT<adv_id: INT, adv_lemma: STRING>>",
    "hearst_pairs": f"ARRAY<STRUCT<pattern: STRING, hypernym: {_SPAN}, hyponym: {_SPAN}>>",
}
RAW = "doc_id BIGINT, path STRING, text STRING, format STRING"
PARAGRAPHS = "doc_id BIGINT, section_idx INT, para_idx INT, text STRING, in_blockquote BOOLEAN"
ERROR = "STRUCT<kind: STRING, message: STRING, what: STRING, limit: BIGINT, actual: BIGINT>"
#: A whole document as read back from JSON.
SENTENCE_WIRE = f"STRUCT<text: STRING, tokens: {TOKENS}, " + ", ".join(f"{k}: {v}" for k, v in DETECTIONS.items()) + ">"
PARAGRAPH_WIRE = (
    f"STRUCT<text: STRING, in_blockquote: BOOLEAN, sentences: ARRAY<{SENTENCE_WIRE}>, readability_grade: DOUBLE, lexical_density: DOUBLE, compression_ratio: DOUBLE>"
)
SECTION_WIRE = f"STRUCT<heading: STRING, level: INT, paragraphs: ARRAY<{PARAGRAPH_WIRE}>>"
DOCUMENT_WIRE = f"sections ARRAY<{SECTION_WIRE}>, vocabulary_ttr DOUBLE, nominalization_ratio DOUBLE, passive_ratio DOUBLE"

# Limits.
MAX_INPUT_BYTES = 8_388_608
MAX_RANKED_SENTENCES = 2_000
MAX_PHRASE_TOKENS = 200_000
MAX_COMPRESSED_BYTES = 262_144
#: Depth of a sentence whose heads form a cycle.
CYCLE = 9223372036854775807

# Word lists.
STOP_WORDS = (
    "a", "above", "after", "again", "all", "an", "and", "are", "as", "at", "be", "been", "before", "being", "below", "between",
    "both", "but", "by", "can", "could", "did", "do", "does", "during", "each", "few", "for", "from", "had", "has", "have", "he",
    "her", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "may", "me", "might", "more", "most", "my",
    "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "out", "over", "own", "same", "shall",
    "she", "should", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this",
    "those", "through", "to", "too", "under", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who",
    "whom", "why", "will", "with", "would", "you", "your",
)
NEGATION_LEMMAS = ("not", "never", "no", "neither", "nor")
NEGATION_DEPS = ("advmod", "det", "cc")
MODAL_LEMMAS = ("can", "could", "may", "might", "must", "ought", "shall", "should", "will", "would")
PASSIVE_DEPS = ("nsubj:pass", "nsubjpass", "aux:pass")
SUBJECT_DEPS = ("nsubj", "nsubj:pass", "nsubjpass")
NOMINAL_ENDINGS = ("tion", "ment", "ness", "ity", "ence", "ance")
SPAN_DEPS = ("det", "amod", "compound", "nummod", "flat")
DEFINITE_DETERMINERS = ("the", "this", "that", "these", "those")


def sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
