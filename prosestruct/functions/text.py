"""Functions on texts. White space and letters are Unicode's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import STOP_WORDS, sql_list


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def pieces(text: Column) -> Column:
    """Runs between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda p: p != "")


def letters(piece: Column) -> Column:
    return F.regexp_replace(piece, r"\P{IsAlphabetic}+", "")


def is_stop_word(word: Column) -> Column:
    return word.isin(*STOP_WORDS)


def syllables(word: Column) -> Column:
    """Syllables by vowel runs: at least one in any word, one in words of three bytes, no silent final e."""

    def counted(own: Column) -> Column:
        runs = lambda low: let(F.regexp_count(low, F.lit("[aeiouy]+")), lambda n: F.greatest(F.lit(1), n - (low.endswith("e") & (n > 1)).cast("int")))
        return F.when(own == "", 0).when(F.octet_length(own) <= 3, 1).otherwise(let(F.lower(own), runs))

    return let(letters(word), counted)


def syllable_sum(words: Column) -> Column:
    return F.aggregate(F.transform(words, syllables), F.lit(0), lambda a, s: a + s)


def readability(text: Column) -> Column:
    """School grade from words a sentence and syllables a word; 0.0 without words. Sentences are counted by end marks."""
    return let(pieces(text), lambda words: grade(F.size(words), syllable_sum(words), text))


def grade(words: Column, syllables: Column, text: Column) -> Column:
    """The grade of a text whose words and syllables are counted already."""
    sentences = F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]"))).cast("double")
    return F.when(words == 0, 0.0).otherwise(0.39 * (words.cast("double") / sentences) + 11.8 * (syllables.cast("double") / words.cast("double")) - 15.59)


def lexical_density(text: Column) -> Column:
    """Share of pieces that are words other than stop words; null without pieces."""

    def share(words: Column) -> Column:
        content = F.filter(words, lambda p: let(F.lower(letters(p)), lambda w: (w != "") & ~is_stop_word(w)))
        return F.when(F.size(words) > 0, F.size(content).cast("double") / F.size(words))

    return let(pieces(text), share)


def feat_sql(feats: str, key: str) -> str:
    """SQL for the value of the first pair with this key in `Key=Value|Key=Value`; null if there is none."""
    own = f"instr(p, '=') > 0 AND substring(p, 1, instr(p, '=') - 1) = {key}"
    return f"try_element_at(transform(filter(split({feats}, '[|]'), p -> {own}), p -> substring(p, instr(p, '=') + 1)), 1)"


def feat(feats: str, key: str) -> Column:
    """feats and key are SQL expressions: column names or quoted literals."""
    return F.expr(feat_sql(feats, key))


def stop_list_sql() -> str:
    return sql_list(STOP_WORDS)
