"""Quality rules, line first: clean lines, then judge what is left of a document.

Words are maximal runs of characters other than ASCII white space. Rules for a line with words (lines are split at \\n):

* navigation: SEPARATORS make up a tenth of its words or more, three at least;
* punctuation: half of its words or more, five at least, carry a sign of SYMBOLS or end in two exclamation or question
  marks; or it has LONG_LINE words or more and not one sentence mark, dash, comma or colon among them, in any script;
* repetition: LONG_LINE words or more of which fewer than a fifth are distinct;
* boilerplate: it contains one of BOILERPLATE and has fewer than LONG_LINE words, or is a line that occurs
  REPEATED_LINE times or more in the document.

Lines that fail go. A document that loses more than MAX_LOST of its words is rejected, as is one whose base rules fail:
fewer than 10 words, or more than 20 % of its words in 5-word windows that occur twice or more.

Null and empty texts have no words and fail the base rules. Repeated rows and null ids stay rows of their own; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import SPACES, arrow_map

# Fixed values of the rules.
SEPARATORS = (b"|", b"\xc2\xbb", b"\xc2\xab", b"\xe2\x80\xba", b"\xe2\x80\xa2", b"\xc2\xb7", b">", b">>", b"::")
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    b"all rights reserved", b"click here", b"cookie policy", b"enable javascript", b"lorem ipsum", b"privacy policy",
    b"sign up for", b"skip to content", b"subscribe to our", b"terms of service", b"terms of use",
)
LONG_LINE = 20
REPEATED_LINE = 4
MAX_LOST = 0.3
MIN_WORDS = 10
MAX_REPEATED = 0.2
WINDOW = 5

_NOISY = re.compile(rb"[#*$%&|<>]|[!?]{2,}$")
_MAYBE_NOISY = re.compile(rb"[#*$%&|<>]|[!?]{2}")
_PAUSE = re.compile("[.!?,;:…。！？、，؟।–—-]")
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, lost_words long, n_navigation long, n_punctuation long, n_repetition long, n_boilerplate long, cleaned string"
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 5 words found twice or more, first place included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total = covered = 0
    for at, window in enumerate(windows):
        if window in often:
            total += at + WINDOW - max(at, covered)
            covered = at + WINDOW
    return total


def line_rule(line: bytes, words: list[bytes], times: int) -> str | None:
    """The rule by which a line goes, or None."""
    n = len(words)
    separators = sum(map(words.count, SEPARATORS))
    if separators >= 3 and separators * 10 >= n:
        return "navigation"
    if n >= 5:
        noisy = _MAYBE_NOISY.search(line) and sum(1 for w in words if _NOISY.search(w))
        if noisy and 2 * noisy >= n:
            return "punctuation"
    if n >= LONG_LINE:
        if 5 * len(set(words)) < n:
            return "repetition"
        if not _PAUSE.search(line.decode("utf-8", "replace")):
            return "punctuation"
    elif any(x in low for low in (line.lower(),) for x in BOILERPLATE):
        return "boilerplate"
    return "boilerplate" if times >= REPEATED_LINE else None


def judge(text: str | None) -> dict:
    """All columns of a document but its id."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    split = [(line, own) for line in raw.split(b"\n") if (own := line.split())]
    times = Counter(line for line, _ in split)
    lost, by_rule, left = 0, Counter(), []
    for line, own in split:
        rule = line_rule(line, own, times[line])
        if rule:
            lost += len(own)
            by_rule[rule] += 1
        else:
            left.append(line)
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > 100 * MAX_REPEATED * n
    return {
        "n_words": n,
        "word_chars": len(text) - sum(raw.count(bytes((c,))) for c in SPACES),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(split) - len(times),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "kept": not failed and lost <= MAX_LOST * n,
        "lost_words": lost,
        **{f"n_{rule}": by_rule[rule] for rule in ("navigation", "punctuation", "repetition", "boilerplate")},
        "cleaned": b"\n".join(left).decode("utf-8", "replace"),
    }


def quality_rules(documents: DataFrame) -> DataFrame:
    """doc_id, the base columns, base_failed, kept, words lost, lines failed by rule, and the cleaned text."""

    def make():
        def work(batch):
            rows = list(map(judge, batch["text"].to_pylist()))
            return {"doc_id": batch["doc_id"]} | {name.split(" ")[0]: [r[name.split(" ")[0]] for r in rows] for name in SCHEMA.split(", ")[1:]}

        return work

    return arrow_map(documents.select("doc_id", "text"), make, SCHEMA)
