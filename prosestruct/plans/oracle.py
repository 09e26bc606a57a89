"""The registered queries in DuckDB SQL: flat tables, joins and windows where the engine works on arrays in a row."""

from __future__ import annotations

from ..schema import (
    DEFINITE_DETERMINERS, MODAL_LEMMAS, NEGATION_DEPS, NEGATION_LEMMAS, NOMINAL_ENDINGS, PASSIVE_DEPS, SPAN_DEPS, STOP_WORDS, SUBJECT_DEPS,
    sql_list,
)
from ..sources.providers import CLOSED, LEMMAS, SENTENCE, SUFFIXES
from .fixtures import FEATS, PATHS, SENTENCES, STATED

_STOP = sql_list(STOP_WORDS)
_SPACE = r"[\s\x0b\x85\p{Z}]"
TOP = 5


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _literal(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


_TREE_ROWS = ",\n".join(
    "(" + ", ".join(map(_literal, (sent, i, t, lemma, pos, feats, head, dep))) + ")" for sent, tokens in SENTENCES.items() for i, t, lemma, pos, feats, head, dep, _ in tokens
)
TREES = f"tok(sent, id, text, lemma, pos, feats, head, dep) AS (VALUES {_TREE_ROWS})"

PIECES = rf"""pieces AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda p: p <> '')) AS piece FROM documents),
words AS (SELECT doc_id, piece, regexp_replace(piece, '[^\p{{L}}\p{{M}}\p{{Nl}}]+', '', 'g') AS w FROM pieces)"""

_SYLLABLES = r"""CASE WHEN w = '' THEN 0 WHEN strlen(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+'))
  - CASE WHEN lower(w) LIKE '%e' AND len(regexp_extract_all(lower(w), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END"""


def _grade(words: str, syllables: str, marks: str) -> str:
    return f"CASE WHEN {words} = 0 THEN 0.0 ELSE 0.39 * (CAST({words} AS DOUBLE) / greatest(1, {marks})) + 11.8 * (CAST({syllables} AS DOUBLE) / {words}) - 15.59 END"


RAW = "raw AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS text FROM documents)"

PARAGRAPHS = rf"""{RAW},
cut AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS text, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS n FROM raw),
paragraphs AS (
  SELECT doc_id, 0 AS section_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS BIGINT) AS para_idx, t AS text, false AS in_blockquote
  FROM (SELECT doc_id, n, {_trim('text')} AS t FROM cut) WHERE t <> '')"""


def _tokens(source: str = "paragraphs") -> str:
    tag = "CASE WHEN regexp_matches(t, '^[^\\p{L}\\p{N}]') THEN 'PUNCT' WHEN regexp_matches(t, '^\\p{N}+$') THEN 'NUM'"
    tag += "".join(f" WHEN lower(t) IN {sql_list(words)} THEN '{name}'" for name, words in CLOSED.items())
    tag += "".join(f" WHEN regexp_matches(lower(t), '{ending}') THEN '{name}'" for name, ending in SUFFIXES) + " ELSE 'NOUN' END"
    lemma = "CASE" + "".join(f" WHEN lower(t) IN {sql_list(words)} THEN '{base}'" for base, words in LEMMAS.items()) + " ELSE lower(t) END"
    here, after = "PARTITION BY doc_id, para_idx, n", "PARTITION BY doc_id, para_idx, n ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
    return rf"""pieces0 AS (SELECT doc_id, section_idx, para_idx, unnest(s) AS text, generate_subscripts(s, 1) AS n
  FROM (SELECT *, regexp_extract_all(text, '{SENTENCE}') AS s FROM {source} WHERE para_idx IS NOT NULL AND NOT in_blockquote)),
forms AS (SELECT doc_id, section_idx, para_idx, n, unnest(f) AS t, CAST(generate_subscripts(f, 1) AS BIGINT) AS id
  FROM (SELECT *, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\s\x0b\p{{L}}\p{{N}}]') AS f FROM pieces0)),
tagged AS MATERIALIZED (SELECT *, {tag} AS pos, {lemma} AS lemma FROM forms),
looked AS (
  SELECT *, coalesce(min(id) FILTER (WHERE pos = 'VERB') OVER ({here}), min(id) FILTER (WHERE pos = 'AUX') OVER ({here}), min(id) FILTER (WHERE pos = 'NOUN') OVER ({here}), 1) AS root,
    min(id) FILTER (WHERE pos = 'NOUN') OVER ({after}) AS next_noun, min(id) FILTER (WHERE pos = 'VERB') OVER ({after}) AS next_verb,
    lead(pos) OVER ({here} ORDER BY id) AS next_pos,
    dense_rank() OVER (PARTITION BY doc_id ORDER BY para_idx, n) - 1 AS sent_idx
  FROM tagged),
placed AS MATERIALIZED (SELECT *, max(id) FILTER (WHERE pos IN ('NOUN', 'PRON') AND id < root) OVER ({here}) AS subject FROM looked),
tok AS MATERIALIZED (
  SELECT p.doc_id, p.section_idx, p.para_idx, p.sent_idx, p.id, p.t AS text, p.lemma, p.pos,
    CASE WHEN p.pos = 'VERB' AND lower(p.t) LIKE '%ed' THEN 'Mood=Ind|Tense=Past|VerbForm=Fin' WHEN lower(p.t) IN ('is', 'are', 'was', 'were') THEN 'Mood=Ind|VerbForm=Fin' ELSE '_' END AS feats,
    CASE WHEN p.id = p.root THEN 0 WHEN p.pos IN ('DET', 'ADP', 'CCONJ') THEN coalesce(p.next_noun, p.root) WHEN p.pos = 'AUX' THEN coalesce(p.next_verb, p.root)
      WHEN p.pos = 'ADJ' AND p.next_pos = 'NOUN' THEN p.id + 1 ELSE p.root END AS head,
    CASE WHEN p.id = p.root THEN 'root' WHEN p.pos = 'PUNCT' THEN 'punct' WHEN p.pos = 'DET' THEN 'det' WHEN p.pos = 'ADP' THEN 'case' WHEN p.pos = 'CCONJ' THEN 'cc'
      WHEN p.pos = 'AUX' THEN CASE WHEN p.lemma = 'be' AND lower(v.t) LIKE '%ed' THEN 'aux:pass' ELSE 'aux' END WHEN p.pos = 'ADV' THEN 'advmod'
      WHEN p.pos = 'ADJ' AND p.next_pos = 'NOUN' THEN 'amod' WHEN p.id = p.subject THEN 'nsubj' WHEN p.pos = 'VERB' THEN 'ccomp' ELSE 'dep' END AS dep,
    p.pos = 'PUNCT' AS is_punct
  FROM placed p LEFT JOIN placed v ON v.doc_id = p.doc_id AND v.sent_idx = p.sent_idx AND v.id = p.next_verb),
sents AS (SELECT doc_id, section_idx, para_idx, sent_idx, count(*) FILTER (WHERE NOT is_punct) AS words, bool_or(dep IN {sql_list(PASSIVE_DEPS)}) AS is_passive,
  sum(strlen(text)) + count(*) - 1 AS rebuilt FROM tok GROUP BY ALL)"""


TOKENS = f"{PARAGRAPHS},\n{_tokens()}"

# The Markdown of a document's lines, then the same rules with other means: everything by running counts over flat lines.
MARKDOWN = rf"""lines AS (
  SELECT doc_id, i, CASE WHEN i % 7 = 0 THEN '## ' WHEN i % 5 = 3 THEN '> ' WHEN i % 17 = 9 THEN '```' WHEN i % 11 = 4 THEN '| ' ELSE '' END || l || CASE WHEN i % 3 = 2 THEN chr(10) ELSE '' END AS l
  FROM (SELECT doc_id, unnest(s) AS l, generate_subscripts(s, 1) - 1 AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
md AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS text FROM lines GROUP BY doc_id),
l0 AS (SELECT doc_id, line, {_trim('line')} AS bare, n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM md)),
l1 AS (SELECT *, starts_with(bare, '```') AS fence, count(*) FILTER (WHERE starts_with(bare, '```')) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM l0),
l2 AS (SELECT * FROM l1 WHERE NOT fence AND fences % 2 = 0 AND NOT starts_with(bare, '|')),
l3 AS (SELECT *, count(*) FILTER (WHERE starts_with(bare, '#')) OVER (PARTITION BY doc_id ORDER BY n) AS sec,
  count(*) FILTER (WHERE starts_with(bare, '#') OR bare = '') OVER (PARTITION BY doc_id ORDER BY n) AS par FROM l2),
p0 AS (
  SELECT doc_id, sec, par, bool_or(starts_with(bare, '>')) AS in_blockquote,
    string_agg(CASE WHEN starts_with(bare, '>') THEN {_trim("ltrim(bare, '>')")} ELSE line END, chr(10) ORDER BY n) AS text
  FROM l3 WHERE NOT starts_with(bare, '#') AND bare <> '' GROUP BY ALL),
p1 AS (SELECT doc_id, sec, par, in_blockquote, {_trim('text')} AS text FROM p0 WHERE {_trim('text')} <> ''),
h AS (SELECT doc_id, sec, {_trim("ltrim(bare, '#')")} AS heading, CAST(length(bare) - length(ltrim(bare, '#')) AS BIGINT) AS level FROM l3 WHERE starts_with(bare, '#')),
j AS (SELECT coalesce(p1.doc_id, h.doc_id) AS doc_id, coalesce(p1.sec, h.sec) AS sec, par, heading, coalesce(level, 0) AS level, text, in_blockquote
  FROM p1 FULL JOIN h ON p1.doc_id = h.doc_id AND p1.sec = h.sec),
paragraphs AS (SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS BIGINT) AS section_idx,
  CASE WHEN text IS NOT NULL THEN CAST(count(text) OVER (PARTITION BY doc_id ORDER BY sec, par NULLS FIRST ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) END AS para_idx,
  heading, level, text, in_blockquote FROM j)"""

_HEAD = "doc_id, CAST(sent_idx AS BIGINT) AS sent_idx"
_SENT = "t.doc_id, CAST(t.sent_idx AS BIGINT) AS sent_idx"


def _same(a: str, b: str, key: str = "doc_id, sent_idx") -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in key.split(", "))


_ROOTS = "roots AS (SELECT doc_id, sent_idx, min(id) AS id FROM tok WHERE head = 0 GROUP BY ALL)"
_TERMS = f"terms AS (SELECT doc_id, sent_idx, lemma AS term, count(*) AS n FROM tok WHERE NOT is_punct AND lower(lemma) NOT IN {_STOP} GROUP BY ALL)"

_TREE_WALK = "walk(sent, id, place, far) AS (SELECT sent, id, id, 0 FROM tok UNION ALL SELECT w.sent, w.id, t.head, w.far + 1 FROM walk w JOIN tok t ON t.sent = w.sent AND t.id = w.place WHERE t.head <> 0 AND w.far < 200)"

_BARE = "sent, id, text, lemma, pos, head, dep"
_HEARST = f"""WITH RECURSIVE {TREES},
nom AS (SELECT t.sent, t.id AS t, h.id AS h, t.dep FROM tok t JOIN tok h ON h.sent = t.sent AND h.id = t.head
  WHERE t.pos IN ('NOUN', 'PROPN') AND h.pos IN ('NOUN', 'PROPN') AND h.id < t.id AND t.dep IN ('nmod', 'conj')),
cases AS (SELECT n.sent, n.t, n.h, c.id, c.lemma, bool_or(f.id IS NOT NULL) AS fixed_as FROM nom n JOIN tok c ON c.sent = n.sent AND c.head = n.t AND c.dep = 'case' AND c.id > n.h AND c.id < n.t
  LEFT JOIN tok f ON f.sent = c.sent AND f.head = c.id AND f.dep = 'fixed' AND f.lemma = 'as' WHERE n.dep = 'nmod' GROUP BY ALL),
kinds AS (SELECT c.sent, c.t, c.h, max(s.id) AS such, CASE WHEN bool_or(c.lemma = 'such' AND c.fixed_as) THEN 'such_as' WHEN max(s.id) IS NOT NULL AND bool_or(c.lemma = 'as') THEN 'such_np_as' WHEN bool_or(c.lemma = 'include') THEN 'including' END AS pattern
  FROM cases c LEFT JOIN (SELECT sent, head, min(id) AS id FROM tok WHERE dep = 'amod' AND lemma = 'such' AND id < head GROUP BY ALL) s ON s.sent = c.sent AND s.head = c.h GROUP BY c.sent, c.t, c.h),
nmods AS (SELECT k.sent, pattern, h AS up, CASE WHEN pattern = 'such_np_as' THEN such ELSE 0 END AS up_mark, unnest(list_concat([t], coalesce(g.ids, []))) AS down, 0 AS down_mark
  FROM kinds k LEFT JOIN (SELECT sent, head, list(id ORDER BY id) AS ids FROM tok WHERE dep = 'conj' AND id > head AND pos IN ('NOUN', 'PROPN') GROUP BY ALL) g ON g.sent = k.sent AND g.head = k.t WHERE pattern IS NOT NULL),
marks AS (SELECT n.sent, n.t, n.h,
    (SELECT min(id) FROM tok c WHERE c.sent = n.sent AND c.head = n.t AND c.dep = 'cc') AS cc,
    (SELECT min(id) FROM tok c WHERE c.sent = n.sent AND c.head = n.t AND c.dep = 'amod' AND c.lemma = 'other' AND c.id < n.t) AS other,
    (SELECT min(id) FROM tok c WHERE c.sent = n.sent AND c.head = n.t AND c.dep = 'advmod' AND c.lemma = 'especially' AND c.id < n.t) AS especially,
    EXISTS (SELECT 1 FROM tok c WHERE c.sent = n.sent AND c.head = n.t AND c.dep = 'det' AND c.lemma IN {sql_list(DEFINITE_DETERMINERS)}) AS definite
  FROM nom n WHERE n.dep = 'conj'),
others AS (SELECT m.sent, c.lemma || '_other' AS pattern, t AS up, other AS up_mark, d.id AS down, 0 AS down_mark FROM marks m JOIN tok c ON c.sent = m.sent AND c.id = m.cc
  JOIN tok d ON d.sent = m.sent AND (d.id = m.h OR (d.head = m.h AND d.dep = 'conj' AND d.pos IN ('NOUN', 'PROPN') AND d.id > m.h AND d.id < m.cc))
  WHERE m.cc < m.other AND NOT definite AND c.lemma IN ('and', 'or')),
specials AS (SELECT sent, 'especially' AS pattern, h AS up, 0 AS up_mark, t AS down, especially AS down_mark FROM marks WHERE cc IS NULL AND especially IS NOT NULL),
pairs AS (SELECT * FROM nmods UNION ALL SELECT * FROM others UNION ALL SELECT * FROM specials),
ends AS (SELECT DISTINCT sent, up AS id, up_mark AS mark FROM pairs UNION SELECT DISTINCT sent, down, down_mark FROM pairs),
lefts(sent, id, mark, place) AS (SELECT sent, id, mark, id FROM ends UNION ALL
  SELECT l.sent, l.id, l.mark, x.id FROM lefts l JOIN tok x ON x.sent = l.sent AND x.id = l.place - 1 AND x.head = l.id AND x.dep IN {sql_list(SPAN_DEPS)} AND x.id <> l.mark),
rights(sent, id, mark, place) AS (SELECT sent, id, mark, id FROM ends UNION ALL
  SELECT l.sent, l.id, l.mark, x.id FROM rights l JOIN tok x ON x.sent = l.sent AND x.id = l.place + 1 AND x.head = l.id AND (x.dep = 'flat' OR starts_with(x.dep, 'flat:'))),
spans AS (SELECT e.sent, e.id, e.mark, t.lemma, (SELECT min(place) FROM lefts l WHERE l.sent = e.sent AND l.id = e.id AND l.mark = e.mark) AS first_id,
  (SELECT max(place) FROM rights l WHERE l.sent = e.sent AND l.id = e.id AND l.mark = e.mark) AS last_id FROM ends e JOIN tok t ON t.sent = e.sent AND t.id = e.id)
SELECT p.sent, p.pattern, CAST(a.id AS BIGINT) AS hypernym_head_id, a.lemma AS hypernym_head_lemma, CAST(a.first_id AS BIGINT) AS hypernym_first_id, CAST(a.last_id AS BIGINT) AS hypernym_last_id,
  CAST(b.id AS BIGINT) AS hyponym_head_id, b.lemma AS hyponym_head_lemma, CAST(b.first_id AS BIGINT) AS hyponym_first_id, CAST(b.last_id AS BIGINT) AS hyponym_last_id
FROM pairs p JOIN spans a ON a.sent = p.sent AND a.id = p.up AND a.mark = p.up_mark JOIN spans b ON b.sent = p.sent AND b.id = p.down AND b.mark = p.down_mark"""

_MOOD = "('|' || {0} || '|') LIKE '%|Mood=Ind|%'"
_PARA_WORDS = f"""para_words AS (SELECT p.*, coalesce(s.w, 0) AS word_count, coalesce(s.c, 0) AS sentence_count FROM paragraphs p
  LEFT JOIN (SELECT doc_id, para_idx, sum(words) AS w, count(*) AS c FROM sents GROUP BY ALL) s ON s.doc_id = p.doc_id AND s.para_idx = p.para_idx WHERE p.para_idx IS NOT NULL),
pp AS (SELECT doc_id, para_idx, unnest(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '')) AS piece FROM paragraphs),
pw AS (SELECT *, regexp_replace(piece, '[^\\p{{L}}\\p{{M}}\\p{{Nl}}]+', '', 'g') AS w FROM pp),
pf AS (SELECT doc_id, para_idx, count(*) AS n, sum({_SYLLABLES}) AS syl, count(*) FILTER (WHERE lower(w) <> '' AND lower(w) NOT IN {_STOP}) AS content FROM pw GROUP BY ALL),
para AS (SELECT q.doc_id, q.para_idx, CAST(word_count AS BIGINT) AS word_count, CAST(sentence_count AS BIGINT) AS sentence_count,
  CASE WHEN word_count > 10 AND NOT in_blockquote THEN {_grade('f.n', 'f.syl', "len(regexp_extract_all(q.text, '[.!?]'))")} END AS grade,
  CASE WHEN word_count <> 0 AND NOT in_blockquote THEN CAST(f.content AS DOUBLE) / f.n END AS density
  FROM para_words q JOIN pf f ON f.doc_id = q.doc_id AND f.para_idx = q.para_idx)"""


def _ranked(scores: str, tie: str, digits: int, columns: str) -> str:
    return f"""SELECT {columns}, round(score, {digits}) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, {tie}) AS place FROM ({scores})) WHERE place <= {TOP}"""


ORACLE: dict[str, str] = {
    "text_readability": f"""WITH {PIECES}, counted AS (SELECT doc_id, count(*) AS n, sum({_SYLLABLES}) AS syl FROM words GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS words, CAST(coalesce(syl, 0) AS BIGINT) AS syllables,
  round({_grade('coalesce(n, 0)', 'syl', "len(regexp_extract_all(coalesce(d.text, ''), '[.!?]'))")}, 6) AS grade FROM documents d LEFT JOIN counted c ON c.doc_id = d.doc_id""",
    "text_lexical_density": f"""WITH {PIECES}
SELECT d.doc_id, round(CAST(count(*) FILTER (WHERE lower(w) <> '' AND lower(w) NOT IN {_STOP}) AS DOUBLE) / nullif(count(w), 0), 9) AS density
FROM documents d LEFT JOIN words ON words.doc_id = d.doc_id GROUP BY d.doc_id""",
    "decompose_plain": f"WITH {PARAGRAPHS} SELECT doc_id, para_idx, text FROM paragraphs",
    "decompose_markdown": f"WITH {MARKDOWN} SELECT doc_id, section_idx, para_idx, heading, level, text, in_blockquote FROM paragraphs",
    "tokens_rules": f"WITH {TOKENS} SELECT doc_id, para_idx, CAST(sent_idx AS BIGINT) AS sent_idx, id, text, lemma, pos, feats, CAST(head AS BIGINT) AS head, dep, is_punct FROM tok",
    "sentence_stats": f"""WITH RECURSIVE {TOKENS}, {_ROOTS},
walk AS (SELECT doc_id, sent_idx, id, 0 AS far FROM tok WHERE head = 0 UNION ALL SELECT t.doc_id, t.sent_idx, t.id, w.far + 1 FROM walk w JOIN tok t ON {_same('t', 'w')} AND t.head = w.id)
SELECT s.doc_id, CAST(s.sent_idx AS BIGINT) AS sent_idx, CAST(s.words AS BIGINT) AS words, s.is_passive, CAST(d.depth AS BIGINT) AS depth, r.lemma AS root_lemma,
  CAST(coalesce(k.n, 0) AS BIGINT) AS root_children, CAST(s.rebuilt AS BIGINT) AS rebuilt_bytes
FROM sents s JOIN (SELECT doc_id, sent_idx, max(far) AS depth FROM walk GROUP BY ALL) d ON {_same('d', 's')} JOIN roots x ON {_same('x', 's')} JOIN tok r ON {_same('r', 's')} AND r.id = x.id
LEFT JOIN (SELECT doc_id, sent_idx, head, count(*) AS n FROM tok GROUP BY ALL) k ON {_same('k', 's')} AND k.head = x.id""",
    "negations": f"WITH {TOKENS} SELECT {_HEAD}, id AS cue_id, lemma AS cue_lemma, CAST(head AS BIGINT) AS head_id FROM tok WHERE lemma IN {sql_list(NEGATION_LEMMAS)} AND dep IN {sql_list(NEGATION_DEPS)}",
    "modals": f"WITH {TOKENS} SELECT {_HEAD}, id AS aux_id, lemma AS aux_lemma, CAST(head AS BIGINT) AS head_id FROM tok WHERE lemma IN {sql_list(MODAL_LEMMAS)} AND (dep = 'aux' OR pos = 'AUX')",
    "bare_assertions": f"""WITH {TOKENS}, {_ROOTS} SELECT x.doc_id, CAST(x.sent_idx AS BIGINT) AS sent_idx FROM roots x JOIN tok r ON {_same('r', 'x')} AND r.id = x.id
WHERE NOT EXISTS (SELECT 1 FROM tok m WHERE {_same('m', 'x')} AND m.lemma IN {sql_list(MODAL_LEMMAS)} AND (m.dep = 'aux' OR m.pos = 'AUX') AND (m.head = x.id OR m.id = x.id))
AND ({_MOOD.format('r.feats')} OR EXISTS (SELECT 1 FROM tok c WHERE {_same('c', 'x')} AND c.head = x.id AND c.dep IN ('cop', 'aux', 'aux:pass') AND {_MOOD.format('c.feats')}))""",
    "reportings": f"""WITH {TOKENS} SELECT {_SENT}, v.id AS verb_id, v.lemma AS verb_lemma, t.id AS ccomp_id, s.id AS subject_id, s.lemma AS subject_lemma
FROM tok t JOIN tok v ON {_same('v', 't')} AND v.id = t.head AND v.pos = 'VERB'
LEFT JOIN (SELECT doc_id, sent_idx, head, min(id) AS id, min_by(lemma, id) AS lemma FROM tok WHERE dep IN {sql_list(SUBJECT_DEPS)} GROUP BY ALL) s ON {_same('s', 't')} AND s.head = v.id WHERE t.dep = 'ccomp'""",
    "root_adverbials": f"WITH {TOKENS}, {_ROOTS} SELECT {_SENT}, t.id AS adv_id, t.lemma AS adv_lemma FROM tok t JOIN roots x ON {_same('x', 't')} WHERE t.dep = 'advmod' AND t.head = x.id",
    "reportings_in_lexicon": f"""WITH {TREES}, roots AS (SELECT sent, min(id) AS id FROM tok WHERE head = 0 GROUP BY sent)
SELECT s.sent, CAST((SELECT count(*) FROM tok t JOIN tok v ON v.sent = t.sent AND v.id = t.head AND v.pos = 'VERB' WHERE t.sent = s.sent AND t.dep = 'ccomp' AND v.lemma IN ('say', 'claim')) AS BIGINT) AS reportings,
  CAST((SELECT count(*) FROM tok t JOIN roots x ON x.sent = t.sent AND x.id = t.head WHERE t.sent = s.sent AND t.dep = 'advmod' AND t.lemma IN ('reportedly', 'never')) AS BIGINT) AS root_adverbials
FROM (SELECT DISTINCT sent FROM tok) s""",
    "document_reportings_in_lexicon": f"""WITH {TOKENS}, {_ROOTS},
told AS (SELECT t.doc_id, t.sent_idx, count(*) AS n FROM tok t JOIN tok v ON {_same('v', 't')} AND v.id = t.head AND v.pos = 'VERB' WHERE t.dep = 'ccomp' AND v.lemma IN ('claimed', 'reported', 'stated') GROUP BY ALL),
advs AS (SELECT t.doc_id, t.sent_idx, count(*) AS n FROM tok t JOIN roots x ON {_same('x', 't')} AND x.id = t.head WHERE t.dep = 'advmod' AND t.lemma IN ('reportedly', 'never', 'not') GROUP BY ALL)
SELECT {_SENT}, CAST(coalesce(told.n, 0) AS BIGINT) AS reportings, CAST(coalesce(advs.n, 0) AS BIGINT) AS root_adverbials
FROM (SELECT DISTINCT doc_id, sent_idx FROM tok) t LEFT JOIN told ON {_same('told', 't')} LEFT JOIN advs ON {_same('advs', 't')}""",
    "document_subtrees": f"""WITH RECURSIVE {TOKENS}, up(doc_id, sent_idx, id, top) AS (SELECT doc_id, sent_idx, id, id FROM tok
  UNION SELECT u.doc_id, u.sent_idx, u.id, t.head FROM up u JOIN tok t ON {_same('t', 'u')} AND t.id = u.top WHERE t.head <> 0)
SELECT {_HEAD}, CAST(id AS BIGINT) AS id, CAST(top AS BIGINT) AS top FROM up""",
    "document_heads": f"""WITH {TOKENS}, below AS (SELECT doc_id, sent_idx, head, count(*) AS n FROM tok GROUP BY ALL)
SELECT {_SENT}, CAST(t.id AS BIGINT) AS id, CAST(h.id AS BIGINT) AS head, CAST(coalesce(b.n, 0) AS BIGINT) AS children
FROM tok t LEFT JOIN tok h ON {_same('h', 't')} AND h.id = t.head AND t.head <> 0 LEFT JOIN below b ON {_same('b', 't')} AND b.head = t.id""",
    "hearst_pairs": _HEARST,
    "tree_depths": f"""WITH RECURSIVE {TREES}, {_TREE_WALK}
SELECT sent, CASE WHEN max(far) >= 199 THEN 9223372036854775807 ELSE CAST(max(far) AS BIGINT) END AS depth FROM walk GROUP BY sent""",
    "subtrees": f"""WITH RECURSIVE {TREES}, below(sent, top, id) AS (SELECT sent, id, id FROM tok UNION SELECT b.sent, b.top, t.id FROM below b JOIN tok t ON t.sent = b.sent AND t.head = b.id)
SELECT sent, CAST(top AS BIGINT) AS top, CAST(id AS BIGINT) AS id FROM below""",
    "heads": f"""WITH {TREES} SELECT t.sent, CAST(t.id AS BIGINT) AS id, CAST(h.id AS BIGINT) AS head, CAST((SELECT count(*) FROM tok c WHERE c.sent = t.sent AND c.head = t.id) AS BIGINT) AS children
FROM tok t LEFT JOIN tok h ON h.sent = t.sent AND h.id = t.head""",
    "feat_lookup": "WITH f(feats, wanted) AS (VALUES " + ", ".join(f"({_literal(a)}, {_literal(b)})" for a, b in FEATS) + r"""),
pairs AS (SELECT feats, wanted, unnest(string_split(feats, '|')) AS p, generate_subscripts(string_split(feats, '|'), 1) AS n FROM f)
SELECT f.feats, f.wanted, (SELECT min_by(substr(p, instr(p, '=') + 1), n) FROM pairs WHERE pairs.feats = f.feats AND pairs.wanted = f.wanted AND instr(p, '=') > 0 AND substr(p, 1, instr(p, '=') - 1) = f.wanted) AS value FROM f""",
    "formats": "WITH p(path) AS (VALUES " + ", ".join(f"('{p}')" for p in PATHS) + r""")
SELECT path, CASE WHEN strpos(substr(name, 2), '.') = 0 THEN 'plain' ELSE CASE string_split(name, '.')[-1] WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' ELSE 'plain' END END AS format
FROM (SELECT path, string_split(path, '/')[-1] AS name FROM p)""",
    "gates": """SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) > 8388608 THEN 'InputTooLarge' WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'UnsupportedFormat' ELSE 'ok' END AS kind,
  CASE WHEN strlen(coalesce(text, '')) > 8388608 THEN 'd' || doc_id || ': input input too large: ' || strlen(text) || ' > limit 8388608' WHEN doc_id % 5 = 0 THEN 'd' || doc_id || ': unsupported format: Pdf' WHEN doc_id % 7 = 0 THEN 'd' || doc_id || ': unsupported format: Docx' END AS message FROM documents""",
    "paragraph_metrics": f"WITH {TOKENS}, {_PARA_WORDS} SELECT doc_id, para_idx, word_count, sentence_count, round(grade, 6) AS readability_grade, round(density, 9) AS lexical_density FROM para",
    "document_metrics": f"""WITH {TOKENS},
s AS (SELECT doc_id, count(*) AS c, sum(words) AS w, avg(words) AS m, stddev_samp(words) AS sd, avg(CAST(is_passive AS INT)) AS pr FROM sents GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT lemma) FILTER (WHERE NOT is_punct) AS k, count(*) FILTER (WHERE NOT is_punct) AS n, count(*) FILTER (WHERE pos = 'NOUN' AND regexp_matches(lower(text), '({'|'.join(NOMINAL_ENDINGS)})$')) AS z FROM tok GROUP BY doc_id),
p AS (SELECT doc_id, count(*) AS c FROM paragraphs GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(p.c, 0) AS BIGINT) AS paragraph_count, CAST(coalesce(s.c, 0) AS BIGINT) AS total_sentences, CAST(coalesce(s.w, 0) AS BIGINT) AS total_words,
  round(coalesce(m, 0.0), 8) AS mean_sentence_length, round(coalesce(sd, 0.0), 8) AS sentence_length_std, round(CAST(k AS DOUBLE) / nullif(n, 0), 8) AS vocabulary_ttr,
  round(CAST(z AS DOUBLE) / nullif(n, 0), 8) AS nominalization_ratio, round(pr, 8) AS passive_ratio
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id""",
    "section_breakdown": f"""WITH {MARKDOWN}, {_tokens()},
c AS (SELECT doc_id, section_idx, count(*) AS n, sum(words) AS w FROM sents GROUP BY ALL)
SELECT x.doc_id, x.section_idx, coalesce(substr(max(heading), 1, 45), '(intro)') AS heading, max(level) AS level, count(x.para_idx) AS paragraphs, CAST(coalesce(max(c.n), 0) AS BIGINT) AS sentences, CAST(coalesce(max(c.w), 0) AS BIGINT) AS words
FROM paragraphs x LEFT JOIN c ON c.doc_id = x.doc_id AND c.section_idx = x.section_idx GROUP BY x.doc_id, x.section_idx""",
    "corpus_metrics": f"""WITH {TOKENS}, {_PARA_WORDS}
SELECT CAST((SELECT coalesce(sum(words), 0) FROM sents) AS BIGINT) AS total_words, round((SELECT coalesce(avg(CAST(is_passive AS INT)), 0.0) FROM sents), 9) AS passive_ratio,
  round((SELECT coalesce(avg(grade), 0.0) FROM para), 6) AS mean_readability""",
    "tfidf_topk": f"""WITH {TOKENS}, {_TERMS},
df AS (SELECT doc_id, term, count(*) AS df FROM terms GROUP BY ALL), sz AS (SELECT doc_id, count(*) AS big FROM sents GROUP BY doc_id HAVING count(*) <= 2000),
ln AS (SELECT doc_id, sent_idx, sum(n) AS len, count(*) AS k FROM terms GROUP BY ALL),
sc AS (SELECT doc_id, sent_idx, sum(CAST(n AS DOUBLE) / len * ln(CAST(big AS DOUBLE) / df)) / max(k) AS score FROM terms JOIN df USING (doc_id, term) JOIN sz USING (doc_id) JOIN ln USING (doc_id, sent_idx) GROUP BY ALL)
{_ranked('SELECT s.doc_id, CAST(s.sent_idx AS BIGINT) AS position, coalesce(sc.score, 0.0) AS score FROM sents s JOIN sz USING (doc_id) LEFT JOIN sc ON sc.doc_id = s.doc_id AND sc.sent_idx = s.sent_idx', 'position', 9, 'doc_id, position')}""",
    "textrank_topk": f"""WITH RECURSIVE {TOKENS}, {_TERMS},
sz AS MATERIALIZED (SELECT doc_id, count(*) AS big FROM sents GROUP BY doc_id HAVING count(*) <= 2000),
kk AS MATERIALIZED (SELECT doc_id, sent_idx, count(*) AS k FROM terms GROUP BY ALL),
half AS MATERIALIZED (SELECT a.doc_id, a.sent_idx AS i, b.sent_idx AS j, sum(least(a.n, b.n)) AS shared FROM terms a JOIN terms b ON a.doc_id = b.doc_id AND a.term = b.term AND a.sent_idx < b.sent_idx JOIN sz ON sz.doc_id = a.doc_id GROUP BY ALL),
sim AS MATERIALIZED (SELECT h.doc_id, i, j, shared / (ln(1 + x.k) + ln(1 + y.k)) AS w FROM half h JOIN kk x ON x.doc_id = h.doc_id AND x.sent_idx = i JOIN kk y ON y.doc_id = h.doc_id AND y.sent_idx = j),
both_ways AS MATERIALIZED (SELECT doc_id, i AS src, j AS dst, w FROM sim UNION ALL SELECT doc_id, j, i, w FROM sim),
outs AS MATERIALIZED (SELECT doc_id, src, sum(w) AS o FROM both_ways GROUP BY ALL),
edges AS MATERIALIZED (SELECT b.doc_id, b.src, b.dst, w / o AS share, big FROM both_ways b JOIN outs USING (doc_id, src) JOIN sz USING (doc_id)
  UNION ALL SELECT s.doc_id, s.sent_idx, s.sent_idx, 0.0, big FROM sents s JOIN sz USING (doc_id)),
r(doc_id, i, score, moved, round) AS (
  SELECT s.doc_id, s.sent_idx, CAST(1.0 AS DOUBLE) / big, CAST(1.0 AS DOUBLE), 0 FROM sents s JOIN sz USING (doc_id)
  UNION ALL
  SELECT doc_id, dst, new, max(abs(new - old)) OVER (PARTITION BY doc_id), round FROM (
    SELECT r.doc_id, e.dst, (1 - CAST(0.85 AS DOUBLE)) / max(big) + CAST(0.85 AS DOUBLE) * sum(share * r.score) AS new, sum(r.score) FILTER (WHERE e.src = e.dst) AS old, max(r.round) + 1 AS round
    FROM r JOIN edges e ON e.doc_id = r.doc_id AND e.src = r.i WHERE r.moved >= 1e-6 AND r.round < 50 GROUP BY r.doc_id, e.dst))
{_ranked('SELECT doc_id, CAST(i AS BIGINT) AS position, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY round DESC) AS last FROM r) WHERE last = 1', 'position', 6, 'doc_id, position')}""",
    "rake_topk": f"""WITH {TOKENS},
b AS (SELECT *, lower(lemma) AS w, is_punct OR lower(lemma) IN {_STOP} OR pos NOT IN ('NOUN', 'ADJ', 'PROPN') AS stop FROM tok),
runs AS (SELECT *, count(*) FILTER (WHERE stop) OVER (PARTITION BY doc_id, sent_idx ORDER BY id) AS run FROM b),
ph AS (SELECT doc_id, sent_idx, run, string_agg(w, ' ' ORDER BY id) AS phrase, count(*) AS k FROM runs WHERE NOT stop GROUP BY ALL),
deg AS (SELECT r.doc_id, r.w, CAST(sum(k) AS DOUBLE) / count(*) AS s FROM runs r JOIN ph USING (doc_id, sent_idx, run) WHERE NOT stop GROUP BY ALL),
sc AS (SELECT r.doc_id, sent_idx, run, sum(s) AS score FROM runs r JOIN deg d ON d.doc_id = r.doc_id AND d.w = r.w WHERE NOT stop GROUP BY ALL)
{_ranked('SELECT doc_id, phrase, max(score) AS score FROM ph JOIN sc USING (doc_id, sent_idx, run) GROUP BY ALL', 'phrase', 9, 'doc_id, phrase')}""",
    "yake_topk": f"""WITH {TOKENS},
w AS (SELECT doc_id, sent_idx, id, lower(lemma) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx, id) - 1 AS p,
  lag(lower(lemma)) OVER (PARTITION BY doc_id, sent_idx ORDER BY id) AS l, lead(lower(lemma)) OVER (PARTITION BY doc_id, sent_idx ORDER BY id) AS r FROM tok WHERE NOT is_punct),
tt AS (SELECT doc_id, count(*) AS big FROM w GROUP BY doc_id), te AS (SELECT * FROM w WHERE w NOT IN {_STOP} AND strlen(w) > 1),
nb AS (SELECT doc_id, w, l AS x FROM te UNION ALL SELECT doc_id, w, r FROM te),
sp AS (SELECT doc_id, w, CAST(count(DISTINCT x) AS DOUBLE) / count(x) AS d FROM nb WHERE x IS NOT NULL AND x NOT IN {_STOP} GROUP BY ALL),
f AS (SELECT te.doc_id, te.w, (ln(1 + avg(p) / max(big)) + coalesce(max(d), 0)) / (CAST(count(*) AS DOUBLE) / max(big) + 1) AS s FROM te JOIN tt USING (doc_id) LEFT JOIN sp ON sp.doc_id = te.doc_id AND sp.w = te.w GROUP BY te.doc_id, te.w),
o AS (SELECT te.doc_id, sent_idx, row_number() OVER (PARTITION BY te.doc_id, sent_idx ORDER BY id) AS k, te.w, s FROM te JOIN f ON f.doc_id = te.doc_id AND f.w = te.w),
g AS (SELECT doc_id, w AS phrase, s AS p FROM o
  UNION ALL SELECT a.doc_id, a.w || ' ' || b.w, a.s * b.s FROM o a JOIN o b ON {_same('a', 'b')} AND b.k = a.k + 1
  UNION ALL SELECT a.doc_id, a.w || ' ' || b.w || ' ' || c.w, a.s * b.s * c.s FROM o a JOIN o b ON {_same('a', 'b')} AND b.k = a.k + 1 JOIN o c ON {_same('a', 'c')} AND c.k = a.k + 2)
{_ranked('SELECT doc_id, phrase, 1 / min(p) AS score FROM g GROUP BY ALL HAVING min(p) > 0 AND isfinite(min(p))', 'phrase', 8, 'doc_id, phrase').replace('round(score, 8) AS score', 'round(ln(score), 8) AS log_score')}""",
    "conversation_sentences": f"""WITH cut AS (SELECT conv_id * 1000 + turn AS doc_id, role, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS text FROM conversations),
paragraphs AS (SELECT doc_id, 0 AS section_idx, row_number() OVER (PARTITION BY doc_id) AS para_idx, {_trim('text')} AS text, false AS in_blockquote FROM cut WHERE {_trim('text')} <> ''),
{_tokens()} SELECT role, count(*) AS sentences, CAST(sum(words) AS BIGINT) AS words FROM sents JOIN (SELECT conv_id * 1000 + turn AS doc_id, role FROM conversations) USING (doc_id) GROUP BY role""",
    "analyzed_documents": f"""WITH {TOKENS}, t AS (SELECT doc_id, count(DISTINCT lemma) FILTER (WHERE NOT is_punct) AS k, count(*) FILTER (WHERE NOT is_punct) AS n FROM tok GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN p.c > 0 THEN 1 ELSE 0 END AS BIGINT) AS sections, CAST(coalesce(p.c, 0) AS BIGINT) AS paragraphs, round(CAST(k AS DOUBLE) / nullif(n, 0), 8) AS vocabulary_ttr
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS c FROM paragraphs GROUP BY doc_id) p ON p.doc_id = d.doc_id""",
}


def _stated(sql: str) -> str:
    """The same over texts with a stated paragraph behind each."""
    more = "[" + ", ".join(map(_literal, STATED)) + f"][doc_id % {len(STATED)} + 1]"
    return sql.replace(RAW, RAW.replace(" AS text FROM", f" || chr(10) || chr(10) || {more} AS text FROM"))


def _counted(name: str, sql: str) -> str:
    return f"{name} AS (SELECT doc_id, sent_idx, count(*) AS n FROM ({_stated(sql)}) GROUP BY ALL)"


_FOUND = ("negations", "modals", "reportings", "root_adverbials", "bare_assertions")
ORACLE |= {
    "stated_negations": _stated(ORACLE["negations"]),
    "stated_modals": _stated(ORACLE["modals"]),
    "decompose_mixed": f"""SELECT doc_id, CAST(0 AS BIGINT) AS section_idx, para_idx, CAST(0 AS BIGINT) AS level, CAST(NULL AS VARCHAR) AS heading, text, false AS in_blockquote
FROM ({ORACLE["decompose_plain"]}) WHERE doc_id % 2 = 0 AND doc_id % 5 <> 0
UNION ALL SELECT doc_id, section_idx, para_idx, level, heading, text, in_blockquote FROM ({ORACLE["decompose_markdown"]}) WHERE doc_id % 2 = 1 AND doc_id % 5 <> 0""",
    "document_totals": f"""SELECT doc_id, total_sentences, total_words, mean_sentence_length, coalesce(passive_ratio, 0.0) AS passive_share FROM ({ORACLE["document_metrics"]})""",
    "composed_paragraphs": f"""SELECT doc_id, para_idx, lexical_density, readability_grade FROM ({ORACLE["paragraph_metrics"]})""",
    "json_round_trip": f"""WITH {_stated(TOKENS)}, {", ".join(_counted(name, ORACLE[name]) for name in _FOUND)}
SELECT {_SENT}, t.n AS tokens, {", ".join(f"coalesce({name}.n, 0) AS {name}" for name in _FOUND[:-1])}, bare_assertions.n IS NOT NULL AS bare_assertion
FROM (SELECT doc_id, sent_idx, count(*) AS n FROM tok GROUP BY ALL) t {" ".join(f"LEFT JOIN {name} ON {_same(name, 't')}" for name in _FOUND)}""",
    "extractor_limits": f"""WITH {TOKENS}, sizes AS (SELECT doc_id, 'textrank' AS method, count(*) AS n, 50 AS most FROM sents GROUP BY doc_id
  UNION ALL SELECT doc_id, 'rake', count(*), 500 FROM tok GROUP BY doc_id)
SELECT doc_id, method, 'InputTooLarge' AS kind, method || ' input too large: ' || n || ' > limit ' || most AS message FROM sizes WHERE n > most""",
}
