"""Functions on a sentence's tokens and its dependency tree. `tokens` is the SQL of an array of tokens.

None needs a shuffle: a sentence is one row. Heads may be missing, dangling or cyclic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CYCLE, PASSIVE_DEPS, sql_list


def content_tokens(tokens: str = "tokens") -> Column:
    return F.expr(f"filter({tokens}, t -> NOT t.is_punct)")


def word_count(tokens: str = "tokens") -> Column:
    return F.expr(f"cast(size(filter({tokens}, t -> NOT t.is_punct)) AS BIGINT)")


def is_passive(tokens: str = "tokens") -> Column:
    return F.expr(f"exists({tokens}, t -> t.dep IN {sql_list(PASSIVE_DEPS)})")


def root_sql(tokens: str = "tokens") -> str:
    return f"try_element_at(filter({tokens}, t -> t.head = 0), 1)"


def root_token(tokens: str = "tokens") -> Column:
    return F.expr(root_sql(tokens))


def children_of(token_id: str, tokens: str = "tokens") -> Column:
    return F.expr(f"filter({tokens}, t -> t.head = {token_id})")


def head_of(token_id: str, tokens: str = "tokens") -> Column:
    """The head's token; null for a root, an unknown id or a head that isn't there."""
    own = f"try_element_at(filter({tokens}, t -> t.id = {token_id}), 1).head"
    return F.expr(f"try_element_at(filter({tokens}, h -> h.id = {own} AND {own} <> 0), 1)")


def tree_depth(tokens: str = "tokens") -> Column:
    """Edges on the longest way up. A missing head counts as a root one edge up; a cycle gives CYCLE; no tokens give 0.

    Ways double in length each round, so log2(n) rounds do.
    """
    # Most ids are places; where one isn't, its place is looked up.
    place = "IF(t.head <= size(ids) AND element_at(ids, t.head) = t.head, t.head, cast(array_position(ids, t.head) AS INT))"
    first = f"transform({tokens}, t -> named_struct('up', IF(t.head <= 0, IF(t.head = 0, 0, cast(array_position(ids, t.head) AS INT)), {place}), 'far', IF(t.head = 0, 0L, 1L)))"
    step = "transform(s, x -> IF(x.up > 0, named_struct('up', element_at(s, x.up).up, 'far', x.far + element_at(s, x.up).far), x))"
    rounds = f"sequence(1, cast(ceil(log2(size({tokens}) + 1)) AS INT) + 1)"
    last = f"IF(exists(s, x -> x.up > 0), {CYCLE}L, coalesce(array_max(transform(s, x -> x.far)), 0L))"
    # A round without anything to do leaves the array as it is.
    depth = f"aggregate({rounds}, {first}, (s, k) -> IF(exists(s, x -> x.up > 0), {step}, s), s -> {last})"
    return F.expr(f"element_at(transform(array(transform({tokens}, t -> t.id)), ids -> {depth}), 1)")


def subtree(token_id: str, tokens: str = "tokens") -> Column:
    """The token and all below it, by id; empty for an unknown id. Each round adds a level; at most as many as tokens."""
    start = f"transform(filter({tokens}, t -> t.id = {token_id}), t -> t.id)"
    more = f"array_union(s, transform(filter({tokens}, t -> array_contains(s, t.head)), t -> t.id))"
    reached = f"aggregate(sequence(1, greatest(1, size({tokens}))), {start}, (s, k) -> {more})"
    return F.expr(f"array_sort(filter({tokens}, t -> array_contains({reached}, t.id)), (a, b) -> a.id - b.id)")


def in_lexicon(detections: str, field: str, lexicon: Column) -> Column:
    """Detections whose lemma stands in a lexicon, an array of strings."""
    return F.filter(F.col(detections), lambda d: F.array_contains(lexicon, d[field]))


def rebuilt_text(tokens: str = "tokens") -> Column:
    """Forms in a row, with a space after each but the last and those whose misc says SpaceAfter=No."""
    spaced = f"transform({tokens}, (t, i) -> concat(t.text, IF(i = size({tokens}) - 1 OR contains(t.misc, 'SpaceAfter=No'), '', ' ')))"
    return F.expr(f"array_join({spaced}, '')")
