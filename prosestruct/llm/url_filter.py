"""URL filters: rules, and gradient-boosted trees on lexical features for what no rule covers.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; the path follows up to
`?`, `#` or the end. A rule (host, path) fits its host and all subdomains if the path starts with the rule's; the longest
fitting rule wins. URLs that a rule covers are the labelled ones: on at most MAX_FIT of them, by the smallest digests,
trees are fitted to the logistic loss. Features are lexical: lengths, depth, digit ratio, entropy, parameter and sign
counts, and for the host's last label and last two labels how many labelled URLs end so and which share is allowed.
A URL without a rule is allowed if its probability reaches 0.5. Without labelled URLs of both kinds all are allowed.

Null URLs and those without `://` have an empty host and path, no rule, and the trees' verdict on an empty URL. Repeated
rows and null ids stay rows of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
MAX_FIT = 20_000
TREES, DEPTH, RATE, BINS, LEAST = 60, 4, 0.2, 64, 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule (host and path of the longest fitting one, else null), listed (its verdict)."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    parts = pages.select("page_id", "url", F.coalesce(rest, F.lit("")).alias("rest"))
    host = F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), UPPER, LOWER)
    split = parts.select("page_id", "url", host.alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))
    rule: Column = F.lit(None).cast("string")
    listed: Column = F.lit(None).cast("string")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is tried first, so goes on last
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        rule, listed = F.when(fits, name + start).otherwise(rule), F.when(fits, verdict).otherwise(listed)
    return split.select("page_id", "url", "host", "path", rule.alias("rule"), listed.alias("listed"))


def lexical(url: str | None, host: str, path: str, suffixes: dict[str, tuple[int, int]]) -> list[float]:
    url = url or ""
    n = max(1, len(url))
    labels = host.split(".")
    query = url.partition("?")[2].partition("#")[0]
    counts = Counter(url)
    segments = [x for x in path.split("/") if x]
    out = [
        len(url), len(host), len(path), len(query), len(labels), len(segments), max(map(len, segments), default=0), len(labels[0]),
        sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host), sum(c.isdigit() for c in path) / max(1, len(path)),
        -sum(k / n * math.log2(k / n) for k in counts.values()), query.count("&") + bool(query), query.count("="), url.count("-"),
        url.count("_"), url.count("%"), url.count("."), url.count("@"), float("#" in url), float(url.startswith("https:")),
        float(path.endswith("/")), float("." in (segments[-1] if segments else "")), len(segments[0]) if segments else 0,
        sum(map(str.isupper, url)) / n,
    ]
    for size in (1, 2):
        good, total = suffixes.get(".".join(labels[-size:]), (0, 0))
        out += [math.log1p(total), (good + 1) / (total + 2)]
    return [float(x) for x in out]


def suffix_counts(hosts: list[str], good: np.ndarray) -> dict[str, tuple[int, int]]:
    """Labelled URLs by the last label and last two labels of their hosts: (allowed, all)."""
    out: dict[str, tuple[int, int]] = {}
    for host, y in zip(hosts, good.tolist(), strict=True):
        labels = host.split(".")
        for key in {labels[-1], ".".join(labels[-2:])}:
            a, b = out.get(key, (0, 0))
            out[key] = (a + int(y), b + 1)
    return out


@dataclass(frozen=True)
class Boosted:
    """Trees as arrays over a complete binary tree: feature (-1 at a leaf), cut, value."""

    start: float
    trees: tuple

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(f < 0, at, 2 * at + 1 + right)
            total += value[at]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Histogram gradient boosting on the logistic loss, with Newton leaf values."""
    if not len(y) or y.all() or not y.any():
        return Boosted(10.0 if not len(y) or y.all() else -10.0, ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    total, trees = np.full(len(y), start), []
    size = 2 ** (DEPTH + 1) - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = RATE * gs / (hs + 1.0)
            if node >= 2**DEPTH - 1 or len(rows) < 2 * LEAST:
                continue
            best = (1e-6, -1, 0)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], cuts[best[1]][best[2]]
                at[rows] = 2 * node + 1 + (binned[rows, best[1]] > best[2])
        trees.append((feature, cut, value))
        total += value[at]
    return Boosted(start, tuple(trees))


def train(ruled: DataFrame, max_fit: int = MAX_FIT) -> tuple[Boosted, dict]:
    known = ruled.where("listed IS NOT NULL").select("url", "host", "path", "listed")
    rows = known.distinct().orderBy(F.md5("url"), "url").limit(max_fit).collect()
    good = np.array([r.listed == "allow" for r in rows], dtype=float)
    # Labelled hosts lie under the rules' hosts, so their last labels are few however many rows there are.
    last, two = F.substring_index("host", ".", -1), F.substring_index("host", ".", -2)
    keys = known.select((F.col("listed") == "allow").cast("long").alias("good"), F.explode(F.array_distinct(F.array(last, two))).alias("key"))
    counts = keys.groupBy("key").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    suffixes = {r.key: (r.good, r.n) for r in counts}
    x = np.array([lexical(r.url, r.host, r.path, suffixes) for r in rows])
    return fit(x, good), suffixes


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, probability (of being allowed, by the trees) of each row."""
    ruled = with_rules(pages, rules)
    model, suffixes = train(ruled)

    def make():
        def work(batch):
            columns = [batch[c].to_pylist() for c in ("url", "host", "path")]
            x = np.array([lexical(*row, suffixes) for row in zip(*columns, strict=True)])
            p = model.probability(x) if len(x) else np.zeros(0)
            verdict = [v or ("allow" if q >= 0.5 else "block") for v, q in zip(batch["listed"].to_pylist(), p.tolist(), strict=True)]
            return {c: batch[c] for c in ("page_id", "host", "path", "rule")} | {"verdict": verdict, "probability": p}

        return work

    return arrow_map(ruled, make, "page_id long, host string, path string, rule string, verdict string, probability double")
