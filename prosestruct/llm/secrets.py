"""Secret scans with DataFrame functions only, in time linear in a text's length, but for a logarithm of its matches.

Base kinds are patterns; a match that fails its length rule is dropped but still takes up its characters. The method
adds kind `random`: runs of 20 or more of A-Z a-z 0-9 + / _ - with up to two = behind that hold a digit and don't overlap
a base span. The encoding of a run, padding aside, is inferred as the smallest of hex (either case), base 32, base 62 and
base 64 that has all its characters; a symbol's value is its place in that alphabet of k symbols. "Not random" is taken
to mean that one of three departures is at least as large as in plain strings; on n symbols:

* uniformity: X2 = k / n * sum(count^2) - n. In plain strings (words joined to names, slugs, paths, dates) X2 was measured
  to be about k - 1 + n * EFFECT with deviation SPREAD * sqrt(n); p is the normal lower tail;
* runs of values in the upper and lower half of the alphabet: |z| is that of a departure of ORDERED * sqrt(n) or more;
* serial correlation r of neighbouring values: |r| * sqrt(n) likewise.

To be random a run has to be so by each test, so its p-value is the largest of the three (intersection-union test), valid
however the three depend on each other. False discoveries are held to FDR by Benjamini-Hochberg over the runs of the whole
corpus with p weighted by length: weights grow with it up to 64 symbols and have mean 1, so longer runs, which the tests
tell apart better, get the larger share of the error. Only a histogram of at most BINS log p-values by WEIGHTED lengths
reaches the driver; a bin counts with its upper end, so the control is kept.

Spans are in code points, end exclusive. Null and empty texts have none. Rows with equal or null ids stay rows of their
own; an empty table gives an empty result; other columns, whatever their names, are ignored by scan() and kept by redact().
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, (kind, pattern, group whose length counts, least length). The least lengths of access
# and hex stand in the pattern itself: their matches are whole runs, so it finds the same ones without the short runs.
BASE = (
    ("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
RUN = "[A-Za-z0-9+/_-]{20,}+={0,2}"
HEX, BASE32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Measured on plain strings by size of the alphabet: dates and numbers, upper-case names, camel-case names, slugs and paths.
EFFECT = {16: 1.0, 32: 1.4, 62: 2.1, 64: 3.3}
SPREAD = {16: 2.5, 32: 3.5, 62: 5.5, 64: 6.7}
#: Departure of ordered strings, such as counters and repeated signs, in runs and in serial correlation.
ORDERED = 0.75
FDR = 0.01
#: Bins of -log10 p, BIN wide, and lengths from 20 to the longest that has a weight of its own.
BIN, BINS, WEIGHTED = 0.05, 400, 64
MARK = "[SECRET]"
#: Code points in a block of a text; cutting a piece out costs no more than its own blocks.
BLOCK = 1024
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
KINDS = ("assign", "access", "hex", "random")
_STRIDES = [1 << i for i in range(31)]


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums, or maxima, of an array of longs: in each round the reach doubles, so log2 of its size rounds do."""
    strides = F.filter(F.array(*map(F.lit, _STRIDES)), lambda d: d < F.size(values))
    step = lambda s, d: F.transform(s, lambda x, i: F.when(i >= d, join(x, F.element_at(s, F.greatest(i - d, F.lit(0)) + 1))).otherwise(x))
    return F.aggregate(strides, values, step)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _all_matches(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """(start, kind, end, match) of the matches of a pattern that never matches nothing, by start; null without any."""

    def located(found: Column) -> Column:
        # Lengths of gaps and matches in turn; a match ends after its gap and all lengths before it.
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        widths = F.zip_with(found, gaps, lambda m, g: (F.length(g) + F.length(m)).cast("long"))
        return _let(widths, lambda w: _let(_running(w, _plus), lambda ends: spans(found, ends)))

    def spans(found: Column, ends: Column) -> Column:
        each = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("match")))
        return F.filter(each, lambda s: F.length(F.regexp_extract(s.match, pattern, group) if group else s.match) >= least)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, located(found)))


def _bare(spans: Column) -> Column:
    """Spans without their texts; none for null."""
    return F.coalesce(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"))), F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """The base spans of a text, by start and kind."""
    return F.array_sort(F.concat(*(_bare(_all_matches(text, p, i, g, n)) for i, (_, p, g, n) in enumerate(BASE))))


def _phi(z: Column) -> Column:
    """Lower tail of the standard normal, to about 1e-7 (Abramowitz and Stegun 26.2.17), never zero."""

    def tail(x: Column, t: Column) -> Column:
        far = F.exp(-x * x / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.greatest(_let(far, lambda y: F.when(x < 0, y).otherwise(1 - y)), F.lit(1e-20))

    return _let(z, lambda x: _let(1 / (1 + 0.2316419 * F.abs(x)), lambda t: tail(x, t)))


def _by_alphabet(k: Column, values: dict[int, float]) -> Column:
    return F.when(k == 16, values[16]).when(k == 32, values[32]).when(k == 62, values[62]).otherwise(values[64])


def minus_log_p(match: Column) -> Column:
    """(n, p): symbols of a run, and -log10 of the p-value of "not random", never null."""

    def with_body(body: Column) -> Column:
        alphabet = (
            F.when(body.rlike("^[0-9a-f]*$") | body.rlike("^[0-9A-F]*$"), F.lit(HEX))
            .when(body.rlike("^[A-Z2-7]*$"), F.lit(BASE32))
            .when(body.rlike("^[A-Za-z0-9]*$"), F.lit(BASE62))
            .otherwise(F.lit(BASE62 + "+/"))
        )
        return _let(F.struct(alphabet.alias("a"), F.when(alphabet == HEX, F.lower(body)).otherwise(F.translate(body, "-_", "+/")).alias("s")), with_alphabet)

    def with_alphabet(x: Column) -> Column:
        values = F.transform(F.filter(F.split(x.s, ""), lambda c: c != ""), lambda c: F.instr(x.a, c) - 1)
        # A symbol's count is what the text loses in length without it.
        counts = F.transform(F.filter(F.split(x.a, ""), lambda c: c != ""), lambda c: (F.length(x.s) - F.length(F.replace(x.s, c, F.lit("")))).cast("double"))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        return _let(F.struct(F.length(x.a).alias("k"), values.alias("v"), squares.alias("squares")), statistics)

    def statistics(x: Column) -> Column:
        n, k = F.size(x.v).cast("double"), x.k.cast("double")
        mean = F.aggregate(x.v, F.lit(0.0), lambda a, v: a + v) / n
        return _let(F.struct(n.alias("n"), k.alias("k"), mean.alias("mean"), (k / n * x.squares - n).alias("x2"), x.v.alias("v")), moments)

    def moments(x: Column) -> Column:
        high = F.aggregate(x.v, F.lit(0.0), lambda a, v: a + (v * 2 >= x.k).cast("double"))
        spread = F.aggregate(x.v, F.lit(0.0), lambda s, v: s + (v - x.mean) * (v - x.mean))
        start = F.struct(F.element_at(x.v, 1).alias("last"), F.lit(1.0).alias("runs"), (-(F.element_at(x.v, 1) - x.mean) * (F.element_at(x.v, 1) - x.mean)).alias("cross"))
        # The first symbol is paired with itself, for which the sum starts that much lower.
        both = F.aggregate(x.v, start, lambda s, v: F.struct(
            v.alias("last"), (s.runs + ((v * 2 >= x.k) != (s["last"] * 2 >= x.k)).cast("double")).alias("runs"), (s.cross + (v - x.mean) * (s["last"] - x.mean)).alias("cross")))
        return _let(F.struct(x.n.alias("n"), x.k.alias("k"), x.x2.alias("x2"), high.alias("high"), spread.alias("spread"), both.alias("both")), verdict)

    def verdict(t: Column) -> Column:
        root = F.sqrt(t.n)
        uniform_z = (t.x2 - (t.k - 1 + t.n * _by_alphabet(t.k, EFFECT))) / (_by_alphabet(t.k, SPREAD) * root)
        expected = 1 + 2 * t.high * (t.n - t.high) / t.n
        variance = (expected - 1) * (expected - 2) / (t.n - 1)
        runs_z = F.when(variance > 0, F.abs(t.both.runs - expected) / F.sqrt(variance)).otherwise(F.lit(1e9))
        serial_z = F.when(t.spread > 0, F.abs(t.both.cross / t.spread) * root).otherwise(F.lit(1e9))
        # The largest p-value is that of the largest z.
        p = _phi(F.greatest(uniform_z, runs_z - ORDERED * root, serial_z - ORDERED * root))
        return F.struct(t.n.alias("n"), (-F.log10(p)).alias("p"))

    return _let(F.regexp_replace(match, "=+$", ""), with_body)


def _below(sorted_values: Column, bound: Column, inclusive: bool) -> Column:
    """How many of an ascending array's values are below (or at) a bound, by halving."""
    strides = F.reverse(F.filter(F.array(*map(F.lit, _STRIDES)), lambda d: d <= F.size(sorted_values)))

    def step(found: Column, d: Column) -> Column:
        value = F.element_at(sorted_values, F.least(found + d, F.size(sorted_values)))
        return F.when((found + d <= F.size(sorted_values)) & ((value <= bound) if inclusive else (value < bound)), found + d).otherwise(found)

    return F.aggregate(strides, F.lit(0), step)


def runs_of(text: Column, base: Column) -> Column:
    """(start, kind, end, n, bin) of the runs with a digit that no base span overlaps; null without any run."""
    found = F.filter(_all_matches(text, RUN, KINDS.index("random"), 0, 20), lambda r: r.match.rlike("[0-9]"))

    def alone(x: Column) -> Column:
        # A span overlaps a run if it starts before the run's end and doesn't end at the run's start or before.
        starts, ends = F.transform(x.base, lambda b: b.start), F.array_sort(F.transform(x.base, lambda b: b.end))
        return _let(F.struct(starts.alias("starts"), ends.alias("ends")), lambda e: F.filter(x.runs, lambda r: _below(e.starts, r.end, False) == _below(e.ends, r.start, True)))

    def binned(r: Column) -> Column:
        return _let(minus_log_p(r.match), lambda t: F.struct(
            r.start.alias("start"), r.kind.alias("kind"), r.end.alias("end"), F.least(t.n, F.lit(float(WEIGHTED))).cast("int").alias("n"),
            F.least(F.floor(t.p / BIN), F.lit(BINS)).cast("int").alias("bin")))

    return _let(F.struct(found.alias("runs"), base.alias("base")), lambda x: F.when(F.size(x.runs) > 0, F.transform(alone(x), binned)))


def discovery_bins(runs: DataFrame, column: str) -> dict[int, float]:
    """The lowest bin that weighted Benjamini-Hochberg accepts by length of run; none that are never reached."""
    counts = runs.select(F.explode(column).alias("r")).groupBy("r.n", "r.bin").count().collect()
    total = sum(r["count"] for r in counts)
    if not total:
        return {}
    mean = sum(r["n"] * r["count"] for r in counts) / total
    bonus = {r["n"]: math.log10(r["n"] / mean) for r in counts}
    at_least, best = 0, math.inf
    for strength, count in sorted(((BIN * r["bin"] + bonus[r["n"]], r["count"]) for r in counts), reverse=True):
        at_least += count
        if 10.0**-strength * total <= FDR * at_least:
            best = strength
    return {n: math.ceil((best - b) / BIN - 1e-9) for n, b in bonus.items() if best < math.inf}


def with_spans(rows: DataFrame, text: Column) -> DataFrame:
    """Adds base_spans and all_spans, as arrays of (start, kind, end), to rows without such columns. Reads the texts twice."""
    with_runs = rows.withColumn("base_spans", base_spans(text)).withColumn("runs", runs_of(text, F.col("base_spans")))
    least = discovery_bins(with_runs, "runs")
    accepts = lambda r: F.coalesce(r.bin >= F.element_at(F.create_map(*(F.lit(x) for pair in least.items() for x in pair)), r.n), F.lit(False))
    random = F.filter(F.col("runs"), accepts if least else lambda r: F.lit(False))
    return with_runs.withColumn("all_spans", F.array_sort(F.concat(F.col("base_spans"), _bare(random)))).drop("runs")


def joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, text, base_spans and all_spans of each row."""
    return with_spans(documents.select("doc_id", "text"), F.coalesce(F.col("text"), F.lit("")))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark in place of each span; overlapping spans become one."""

    def with_blocks(x: Column) -> Column:
        # reach[i]: where the first i spans end. A span that starts behind gets a mark after the text since then.
        reach = F.concat(F.array(F.lit(0).cast("long")), _running(F.transform(x.spans, lambda s: s.end), lambda a, b: F.greatest(a, b)))
        return _let(F.struct(x.blocks.alias("blocks"), x.spans.alias("spans"), reach.alias("reach")), pieces)

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        numbers = F.sequence(F.floor(a / BLOCK), F.greatest(F.floor((b - 1) / BLOCK), F.floor(a / BLOCK)))
        part = lambda i: F.substring(F.element_at(blocks, (i + 1).cast("int")), (F.greatest(a - i * BLOCK, F.lit(0)) + 1).cast("int"), (F.least(b - i * BLOCK, F.lit(BLOCK)) - F.greatest(a - i * BLOCK, F.lit(0))).cast("int"))
        return F.when(b > a, F.array_join(F.transform(numbers, part), "")).otherwise(F.lit(""))

    def pieces(x: Column) -> Column:
        before = F.transform(x.spans, lambda s, i: F.when(s.start >= F.element_at(x.reach, i + 1), F.concat(cut(x.blocks, F.element_at(x.reach, i + 1), s.start), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(before, ""), cut(x.blocks, F.element_at(x.reach, -1), F.length(text).cast("long")))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(F.struct(blocks.alias("blocks"), spans.alias("spans")), with_blocks)).otherwise(text)


def redact(documents: DataFrame, mark: str = MARK) -> DataFrame:
    """The same rows and columns with every span in `text` replaced by a mark; overlapping spans become one."""
    rows = with_spans(documents.select(F.struct("*").alias("row")), F.coalesce(F.col("row.text"), F.lit("")))
    return rows.select(F.col("row").withField("text", masked(F.col("row.text"), F.col("all_spans"), mark)).alias("row")).select("row.*")
