"""Structural detections in a sentence, read off its dependency tree. Lemmas and relations are compared exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import feat_sql
from ..functions.tree import root_sql
from ..schema import DEFINITE_DETERMINERS, MODAL_LEMMAS, NEGATION_DEPS, NEGATION_LEMMAS, SPAN_DEPS, SUBJECT_DEPS, sql_list

NEGATIONS = f"""transform(filter(tokens, t -> t.lemma IN {sql_list(NEGATION_LEMMAS)} AND t.dep IN {sql_list(NEGATION_DEPS)}),
  t -> named_struct('cue_id', t.id, 'cue_lemma', t.lemma, 'head_id', t.head))"""

MODALS = f"""transform(filter(tokens, t -> t.lemma IN {sql_list(MODAL_LEMMAS)} AND (t.dep = 'aux' OR t.pos = 'AUX')),
  t -> named_struct('aux_id', t.id, 'aux_lemma', t.lemma, 'head_id', t.head))"""

#: Needs the columns modals and root. A finite indicative root, or one that a copula or auxiliary makes so, without a modal.
BARE_ASSERTION = f"""root IS NOT NULL AND NOT exists(modals, m -> m.head_id = root.id OR m.aux_id = root.id) AND (
  coalesce({feat_sql('root.feats', "'Mood'")} = 'Ind', false) OR
  exists(tokens, c -> c.head = root.id AND c.dep IN ('cop', 'aux', 'aux:pass') AND coalesce({feat_sql('c.feats', "'Mood'")} = 'Ind', false)))"""

_VERB = "try_element_at(filter(tokens, v -> v.id = t.head), 1)"
_SUBJECT = f"try_element_at(filter(tokens, s -> s.head = t.head AND s.dep IN {sql_list(SUBJECT_DEPS)}), 1)"
REPORTINGS = f"""transform(filter(tokens, t -> t.dep = 'ccomp' AND coalesce({_VERB}.pos = 'VERB', false)),
  t -> named_struct('verb_id', t.head, 'verb_lemma', {_VERB}.lemma, 'ccomp_id', t.id, 'subject_id', {_SUBJECT}.id, 'subject_lemma', {_SUBJECT}.lemma))"""

ROOT_ADVERBIALS = """transform(filter(tokens, t -> t.dep = 'advmod' AND t.head = root.id),
  t -> named_struct('adv_id', t.id, 'adv_lemma', t.lemma))"""


def detect(sentences: DataFrame) -> DataFrame:
    """Adds the detections' columns to rows with `tokens`; hearst_pairs included."""
    found = sentences.withColumn("root", F.expr(root_sql())).withColumn("negations", F.expr(NEGATIONS)).withColumn("modals", F.expr(MODALS))
    found = found.withColumn("bare_assertion", F.expr(BARE_ASSERTION)).withColumn("reportings", F.expr(REPORTINGS))
    found = found.withColumn("root_adverbials", F.coalesce(F.expr(ROOT_ADVERBIALS), F.expr("filter(transform(tokens, t -> named_struct('adv_id', t.id, 'adv_lemma', t.lemma)), t -> false)")))
    return found.withColumn("hearst_pairs", F.expr(hearst_sql())).drop("root")


# Hypernymy by lexico-syntactic patterns. n is a nominal token, m the id of a marker that is no part of its phrase.


def _first(condition: str, order: str = "") -> str:
    return f"try_element_at(filter(tokens, {condition}), 1)"


def span_sql(n: str, marker: str) -> str:
    """The phrase around a noun: neighbours that modify it leftwards without a gap, and its name parts to the right."""

    def walk(step: str, inside: str) -> str:
        # Goes on while the neighbouring id belongs to the phrase: the count of members up to the first gap.
        return f"aggregate({step}, named_struct('open', true, 'at', {n}.id), (s, i) -> IF(s.open AND exists(tokens, x -> x.id = i AND x.head = {n}.id AND {inside}), named_struct('open', true, 'at', i), named_struct('open', false, 'at', s.at)), s -> s.at)"

    left = walk(f"IF({n}.id > 1, reverse(sequence(1, {n}.id - 1)), array())", f"x.dep IN {sql_list(SPAN_DEPS)} AND x.id <> {marker}")
    right = walk(f"IF({n}.id < ids_end, sequence({n}.id + 1, ids_end), array())", "(x.dep = 'flat' OR startswith(x.dep, 'flat:'))")
    return f"named_struct('head_id', {n}.id, 'head_lemma', {n}.lemma, 'first_id', {left}, 'last_id', {right})".replace("ids_end", "array_max(transform(tokens, z -> z.id))")


_NOMINAL = "('NOUN', 'PROPN')"


def hearst_sql() -> str:
    """Pairs (pattern, hypernym, hyponym) in token order: a modifier `such as` / `including`, or a conjunct `and other`."""
    head = _first("h -> h.id = t.head")
    # What stands under a nominal t as `nmod` of h.
    such_as = "exists(tokens, c -> c.head = t.id AND c.dep = 'case' AND c.id > h.id AND c.id < t.id AND c.lemma = 'such' AND exists(tokens, f -> f.head = c.id AND f.dep = 'fixed' AND f.lemma = 'as'))"
    case_as = "exists(tokens, c -> c.head = t.id AND c.dep = 'case' AND c.id > h.id AND c.id < t.id AND c.lemma = 'as')"
    including = "exists(tokens, c -> c.head = t.id AND c.dep = 'case' AND c.id > h.id AND c.id < t.id AND c.lemma = 'include')"
    such = "coalesce(try_element_at(filter(tokens, c -> c.head = h.id AND c.dep = 'amod' AND c.lemma = 'such' AND c.id < h.id), 1).id, 0)"
    kind = f"CASE WHEN {such_as} THEN 'such_as' WHEN {such} > 0 AND {case_as} THEN 'such_np_as' WHEN {including} THEN 'including' END"
    conjuncts = f"filter(tokens, g -> g.head = t.id AND g.dep = 'conj' AND g.id > t.id AND g.pos IN {_NOMINAL})"
    pair = "named_struct('pattern', k, 'hypernym', {hyper}, 'hyponym', {hypo})"
    nmod_pairs = f"transform(concat(array(t), {conjuncts}), y -> {pair.format(hyper='up', hypo=span_sql('y', '0'))})"
    none = f"filter(array({pair.format(hyper=span_sql('t', '0'), hypo=span_sql('t', '0')).replace(', k,', ', cast(NULL AS STRING),')}), z -> false)"

    def let(value: str, name: str, body: str) -> str:
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    nmod = let(kind, "k", f"IF(k IS NULL, {none}, " + let(span_sql("h", f"IF(k = 'such_np_as', {such}, 0)"), "up", nmod_pairs) + ")")
    # What stands under a nominal t as `conj` of h.
    cc = _first("c -> c.head = t.id AND c.dep = 'cc'")
    other = _first("c -> c.head = t.id AND c.dep = 'amod' AND c.lemma = 'other' AND c.id < t.id")
    especially = _first("c -> c.head = t.id AND c.dep = 'advmod' AND c.lemma = 'especially' AND c.id < t.id")
    definite = f"exists(tokens, d -> d.head = t.id AND d.dep = 'det' AND d.lemma IN {sql_list(DEFINITE_DETERMINERS)})"
    fires = f"cc.id < o.id AND NOT {definite} AND cc.lemma IN ('and', 'or')"
    listed = f"concat(array(h), filter(tokens, g -> g.head = h.id AND g.dep = 'conj' AND g.id > h.id AND g.id < cc.id AND g.pos IN {_NOMINAL}))"
    others = let("concat(cc.lemma, '_other')", "k", let(span_sql("t", "o.id"), "up", f"transform({listed}, y -> {pair.format(hyper='up', hypo=span_sql('y', '0'))})"))
    special = let("'especially'", "k", f"array({pair.format(hyper=span_sql('h', '0'), hypo=span_sql('t', 'e.id'))})")
    conj = let(cc, "cc", let(other, "o", let(especially, "e",
        f"CASE WHEN cc IS NOT NULL AND o IS NOT NULL THEN IF({fires}, {others}, {none}) WHEN cc IS NULL AND e IS NOT NULL THEN {special} ELSE {none} END")))
    at = f"IF(h IS NULL OR h.pos NOT IN {_NOMINAL} OR h.id >= t.id, {none}, IF(t.dep = 'nmod', {nmod}, {conj}))"
    return f"flatten(transform(filter(tokens, t -> t.pos IN {_NOMINAL} AND t.dep IN ('nmod', 'conj')), t -> {let(head, 'h', at)}))"
