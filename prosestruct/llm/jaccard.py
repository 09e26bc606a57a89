"""N-gram Jaccard join by vertical partitioning, after a prefix filter.

A document's set holds its distinct n-word shingles as 64-bit hashes. The global order of n-grams puts rare ones first:
those known to be in one set alone, those in fewer than COMMON, those of which that isn't known, other common ones, and
the MAX_FREQUENT that batches of documents were most often seen to share, by how often; else by hash. Any fixed order gives
right results, but texts share shingles by chance, the more of them the larger the corpus is, and with such shingles in
prefixes lists and pairs would grow with its square. To know the rare ones, COUNTED of 256 hashes are dealt out by range
and counted there; bitmaps of 8 MB each show which were in two and in COMMON sets or more. What falls into one bit counts
as more frequent than it is, never as less; so a shingle without a bit for two sets can make no pair, and has no list.

1. Candidates. Sets r, s with similarity of at least t = num / den share one of the first |r| - ceil(t * |r|) + 1
   shingles of each (prefix filter), and the smaller has at least t times the size of the larger (length filter). Sets
   with a common prefix shingle are put in order of size. Each is paired with the NEAR before it that its size allows; where
   more would be allowed, the run of sizes without a gap is hot: its members are paired with NEAR_HOT before them and tied
   together as a group. The lists of shingles that very many sets share are split by salts, whose members are tied likewise;
   a set is paired in one of these lists only, that of its least shingle, which near copies mostly have in common.
   If a shingle is the first that two sets share, its places in both bound the overlap (positional filter). Pairs that fall
   short are dropped in the list, before anything of the sets is fetched.
   A sketch of each set, its shingles counted by hash range, bounds the overlap and drops pairs that can't link.
2. Vertical partial overlaps. The global order of n-grams is cut into FRAGMENTS fragments and each set in question into its
   segments. A pair meets, fragment by fragment, as a row of two segments, which counts the overlap in that fragment alone;
   the counts are summed per pair, and the sum meets the exact integer condition or not. So no task holds whole sets.
   Only segments of sets that the pairs at hand name are moved.
3. Rounds. Links give classes, as connected components. What the first round left out are pairs of a hot group, of which
   only those between different classes matter. Groups of one class are done: near copies, however many, cost a few pairs
   each. Of the others, members outside the largest class meet all members, in blocks of HOT_BLOCK, by finer sketches, and
   what passes is counted vertically like the first pairs. A block with many such pairs hands on SHARES of them, drawn by
   hashes of the pairs, round by round, until none is left or the classes have become one. No pair within a class is a row.
4. Documents with equal sets are one vertex all along. Components of the links, least doc_id first, are the result.

Words are maximal runs of characters other than ASCII white space after A-Z are lower-cased; with fewer words than n
the whole sequence is the one shingle. Null, empty and blank texts have an empty set and link with nothing. Rows with
equal ids are one document if their sets are equal, and otherwise their links are joined. Rows with a null id take no
part and have a null component. Other columns are ignored by components() and kept by representatives(). An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, checkpointed, give_back, hash64, to_batch
from .components import connected_components

#: Shared shingles whose counts order the rest, 16 bytes each, and the documents of a batch that make one shared.
MAX_FREQUENT, SHARED = 250_000, 3
#: Of 256 hashes how many are counted, sets from which a shingle is common, and ranges of hashes that are counted apart and bits
#: of each range's bitmaps, as powers of two.
COUNTED, COMMON, RANGES, RANGE_BITS = 128, 4, 8, 18
#: Rows of the tables of sets in question and of unfinished groups that are broadcast at most (16 and 32 bytes each).
MAX_BROADCAST = 1_000_000
#: Sets before a set in a prefix list that it is paired with, in a hot run and elsewhere, and sets in a block of a group.
NEAR, NEAR_HOT, HOT_BLOCK = 7, 2, 512
#: Sets in a prefix list from which it is split by salts, as far as the global order knows.
HOT_LIST = 2048
#: Bits for a shingle's place in its set, beside the set's size; a place that doesn't fit counts as the last that does.
PLACE_BITS = 16
#: Fragments of the order, pairs that a block hands on at once, and else the shares of its pairs that are tested by round.
FRAGMENTS, HANDED, SHARES = 4, 1024, (1 / 32, 1 / 4, 1)
#: How much finer the sketches are by which members of a group meet, and where they stand among the fragments.
FINER, FINE = 3, -1
MAX_WORDS = 500_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct shingle hashes of texts; words' hashes are kept, up to MAX_WORDS of them."""

    def __init__(self, n: int) -> None:
        self.n, self.words = n, {}

    def _hash(self, word: bytes) -> int:
        found = self.words[word] = hash64(word) & 0xFFFFFFFFFFFFFFFF
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > MAX_WORDS:
            self.words = {}
        get = self.words.get
        each = np.array([get(w) or self._hash(w) for w in words], dtype=np.uint64)
        n = min(self.n, len(words))
        out = np.full(len(words) - n + 1, n if n < self.n else 0, dtype=np.uint64)
        for i in range(n):
            out = _mix(out * _M1 + each[i : len(each) - n + 1 + i] + _M2)
        return np.unique(out)


@dataclass(frozen=True)
class Order:
    """The global order of n-grams: shared ones, sorted by hash, with their counts; all others count 0 and come first, and go
    by bitmaps of the hashes that were counted in two sets and in COMMON sets or more, if there are any."""

    shared: np.ndarray
    counts: np.ndarray
    twice: np.ndarray | None = None
    common: np.ndarray | None = None

    def count(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.zeros(len(shingles), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.shared, shingles), len(self.shared) - 1)
        return np.where(self.shared[at] == shingles, self.counts[at], 0)

    def alone(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles are known to be in one set only."""
        if self.twice is None:
            return np.zeros(len(shingles), dtype=bool)
        return is_counted(shingles) & ~bits_of(self.twice, shingles)

    def rank(self, shingles: np.ndarray) -> np.ndarray:
        """Where shingles stand in the order, but for their hashes."""
        counts = self.count(shingles)
        if self.twice is None:
            return counts
        known = np.where(bits_of(self.common, shingles), 3, bits_of(self.twice, shingles).astype(np.int64))
        return np.where(counts > 0, counts + 3, np.where(is_counted(shingles), known, 2))

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the fragments of the order's two halves begin: by hash among the unshared, by (count, hash) among the shared."""
        half = FRAGMENTS // 2
        hashes = np.array([(i << 64) // half for i in range(1, half)], dtype=np.uint64)
        order = np.lexsort((self.shared, self.counts))
        places = [len(order) * i // half for i in range(1, half)]
        return hashes, order[places] if len(order) else np.zeros(0, np.int64)

    def segments(self, shingles: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(fragment, shingles in it) of a set given by hash, for the fragments that hold any."""
        half = FRAGMENTS // 2
        counts = self.count(shingles)
        hashes, places = self.cuts()
        fragment = np.searchsorted(hashes, shingles, "right")
        if len(places):
            passed = sum(((counts > self.counts[at]) | ((counts == self.counts[at]) & (shingles >= self.shared[at]))).astype(np.int64) for at in places)
            fragment = np.where(counts > 0, half + passed, fragment)
        return [(int(f), shingles[fragment == f]) for f in np.unique(fragment)]

    def prefix(self, shingles: np.ndarray, num: int, den: int) -> np.ndarray:
        """The shingles of a set, given by hash, of which two sets that link have one in common."""
        size = len(shingles) + (-num * len(shingles)) // den + 1
        alone = np.flatnonzero(self.alone(shingles))
        if len(alone) >= size:
            return shingles[alone[:size]]
        ranks = self.rank(shingles)
        return shingles[np.argsort(ranks, kind="stable")[:size]] if ranks.any() else shingles[:size]


def is_counted(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(255)) < COUNTED


def bits_of(bitmap: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    at = shingles >> np.uint64(64 - RANGES - RANGE_BITS)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def by_range(values: np.ndarray, counts: np.ndarray) -> list[dict]:
    """Shingles that are counted, given by hash with the number of sets that hold each: 32 bits of each hash by range, as often as that."""
    own = is_counted(values)
    values = np.repeat(values[own], np.minimum(counts[own], COMMON))
    places = np.searchsorted(values, np.arange(1, 1 << RANGES, dtype=np.uint64) << np.uint64(64 - RANGES))
    parts = np.split(((values << np.uint64(RANGES)) >> np.uint64(32)).astype(np.uint32), places)
    return [{"p": p, "data": x.tobytes()} for p, x in enumerate(parts) if len(x)]


def range_bits(parts: list[bytes]) -> list[bytes]:
    """The bitmaps of a range, of what by_range gave for it twice and COMMON times or more."""
    hashes, out = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in parts])), []
    for times in (2, COMMON):
        bits, last = np.zeros(1 << RANGE_BITS, dtype=bool), hashes[times - 1 :]
        bits[last[last == hashes[: len(last)]] >> np.uint32(32 - RANGE_BITS)] = True
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return out


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def set_id(whole: bytes) -> int:
    return int.from_bytes(whole[:8], "little", signed=True)


def sketch(shingles: np.ndarray, finer: int = 0) -> bytes:
    """Shingles by hash range, one byte each; empty, which bounds nothing, if one doesn't fit. `finer` halves ranges so often."""
    if not len(shingles):
        return b""
    bits = max(3, (len(shingles) // 2).bit_length() - 1) + finer
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_link(x: np.ndarray, y: np.ndarray, nx: int, ny: int, num: int, den: int) -> bool:
    """Whether sketches x, y leave room for a link; the finer one is folded."""
    if not len(x) or not len(y):
        return True
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    most = int(np.minimum(x, y.reshape(len(x), -1).sum(axis=1)).sum())
    return den * most >= num * (nx + ny - most)


def set_table(documents: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, set_id (its leading bits) and sketch of each row; and on the first row of a batch
    shared, the shingles that SHARED or more different sets of it hold, with counts, and ranges, the counted shingles by_range."""

    def make():
        shingles = Shingler(n)

        def work(batch):
            sets = list(map(shingles, batch["text"].to_pylist()))
            digests = list(map(digest, sets))
            different = list(dict(zip(digests, sets, strict=True)).values())
            shared, ranges = [None] * len(sets), [None] * len(sets)
            if sets:
                values, counts = np.unique(np.concatenate(different), return_counts=True)
                often = counts >= SHARED
                shared[0] = [{"s": int(s), "n": int(c)} for s, c in zip(values[often].view(np.int64), counts[often], strict=True)]
                ranges[0] = by_range(values, counts)
            return {
                "doc_id": batch["doc_id"], "n_shingles": list(map(len, sets)), "digest": digests,
                "set_id": list(map(set_id, digests)), "shared": shared, "sketch": list(map(sketch, sets)), "ranges": ranges,
            }

        return work

    return arrow_map(
        documents.select("doc_id", "text"),
        make,
        "doc_id long, n_shingles long, digest binary, set_id long, shared array<struct<s:long,n:long>>, sketch binary, ranges array<struct<p:int,data:binary>>",
    )


def global_order(sets: DataFrame) -> Order:
    """The order from set_table: the MAX_FREQUENT most frequent of the shared shingles, at most 4 MB, and bitmaps of 16 MB."""
    seen = sets.select(F.explode("shared").alias("x")).groupBy("x.s").agg(F.sum("x.n").alias("n"))
    top = seen.orderBy(F.desc("n"), "s").limit(MAX_FREQUENT).toArrow()
    shared, counts = top["s"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(shared)
    schema = arrow_schema(sets, "p int, twice binary, common binary")

    def mark(table: pa.Table) -> pa.Table:
        twice, common = range_bits(table["data"].to_pylist())
        return pa.Table.from_batches([to_batch({"p": table["p"][:1].to_pylist(), "twice": [zlib.compress(twice, 1)], "common": [zlib.compress(common, 1)]}, schema)])

    parts = sets.select(F.explode("ranges").alias("x")).select("x.p", "x.data")
    found = parts.groupBy("p").applyInArrow(mark, "p int, twice binary, common binary").toArrow()
    width, bitmaps = 1 << (RANGE_BITS - 3), {}
    for name in ("twice", "common"):
        bitmaps[name] = np.zeros(width << RANGES, dtype=np.uint8)
        for p, bits in zip(found["p"].to_pylist(), found[name], strict=True):  # unpacked one by one, to spare the driver's memory
            bitmaps[name][p * width : (p + 1) * width] = np.frombuffer(zlib.decompress(bits.as_py()), np.uint8)
    del found
    give_back()
    return Order(shared[order], counts[order], **bitmaps)


def candidates(documents: DataFrame, order: Order, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, ties) of set ids (a, b): pairs to test, and ties that hold hot runs and split lists together as groups."""
    held = documents.sparkSession.sparkContext.broadcast(order)

    def make():
        shingles, seen, by = Shingler(n), set(), held.value

        def work(batch):
            keys, ids, packed, salts, homes = [], [], [], [], []
            for text in batch["text"].to_pylist():
                own = shingles(text)
                if len(own) * den < (len(own) + 1) * num:  # links with no other set
                    continue
                whole = digest(own)
                if whole in seen:  # copies within a task are listed once
                    continue
                if len(seen) < MAX_WORDS:
                    seen.add(whole)
                found = by.prefix(own, num, den)
                places = np.flatnonzero(~by.alone(found))
                found = found[places]
                parts = 1 + by.count(found) // HOT_LIST
                keys.append(found)
                ids.append(np.full(len(found), set_id(whole), dtype=np.int64))
                packed.append((len(own) << PLACE_BITS) + np.minimum(places, (1 << PLACE_BITS) - 1))
                salts.append(np.where(parts > 1, set_id(whole) % parts, -1).astype(np.int32))
                homes.append((parts > 1) & (found == found[parts > 1].min(initial=np.iinfo(np.uint64).max)))
            if not keys:
                return {"key": [], "salt": [], "a": [], "packed": [], "home": []}
            columns = {"key": keys, "salt": salts, "a": ids, "packed": packed, "home": homes}
            return {c: np.concatenate(x) for c, x in columns.items()} | {"key": pa.array(np.concatenate(keys).view(np.int64))}

        return work

    rows = arrow_map(documents.select("text"), make, "key long, salt int, a long, packed long, home boolean")
    by_size, size = W.partitionBy("key", "salt").orderBy("packed", "a"), F.col("size")
    fits = lambda less, more: F.coalesce(less * den >= more * num, F.lit(False))
    once = rows.withColumn("copy", F.coalesce(F.lag("a").over(by_size) == F.col("a"), F.lit(False))).where("NOT copy")
    # Taken apart behind the shuffle, where the rows are many.
    once = once.withColumn("size", F.shiftright("packed", PLACE_BITS)).withColumn("place", F.col("packed").bitwiseAND((1 << PLACE_BITS) - 1))
    around = once.withColumn("joined", fits(F.lag("size").over(by_size), size)).withColumn("joins", fits(size, F.lead("size").over(by_size)))
    held_keys = around.withColumn("far", fits(F.lag("size", NEAR + 1).over(by_size), size)).where("joined OR joins OR salt >= 0")
    runs = held_keys.withColumn("first", F.last(F.when(~F.col("joined"), F.col("a")), ignorenulls=True).over(by_size.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.withColumn("before", F.collect_list(F.struct("a", "size", "place")).over(by_size.rowsBetween(-NEAR, -1)))
    hot = F.max("far").over(W.partitionBy("key", "salt", "first")) | (F.col("salt") >= 0)
    none = F.slice("before", 1, 0)
    near = F.when((F.col("salt") >= 0) & ~F.col("home"), none).when(F.col("hot"), F.slice("before", F.greatest(F.size("before") - (NEAR_HOT - 1), F.lit(1)), NEAR_HOT)).otherwise(F.col("before"))

    def may_be_first(x):
        """Whether the sets can link if this shingle is the first in the order that they share: what follows it bounds the overlap."""
        # Different sets of one size don't have all in common.
        most = F.least(x["size"] - x["place"], size - F.col("place"), size - (x["size"] == size).cast("long"))
        return fits(x["size"], size) & (x["a"] != F.col("a")) & (most * (den + num) >= (x["size"] + size) * num)

    # A split list is tied to a vertex of its own; runs of whole lists to their first set.
    top = F.when(F.col("salt") >= 0, F.xxhash64("key")).when(F.col("hot"), F.col("first"))
    kept = runs.withColumn("hot", hot).select("a", F.transform(F.filter(near, may_be_first), lambda x: x["a"]).alias("near"), F.when(top != F.col("a"), top).alias("top"))
    kept = checkpointed(kept.where("size(near) > 0 OR top IS NOT NULL"))
    held.destroy()
    both = kept.select("a", F.explode("near").alias("x"))
    pairs = both.select(F.least("a", "x").alias("a"), F.greatest("a", "x").alias("b")).distinct()
    ties = kept.where("top IS NOT NULL").select(F.least("a", "top").alias("a"), F.greatest("a", "top").alias("b")).distinct()
    return pairs, ties


class Folded:
    """Sketches of a block, folded for comparison with sketches of one level; levels in a block differ by what sizes do."""

    def __init__(self, sketches: list[np.ndarray], members: np.ndarray) -> None:
        self.sketches, self.members, self.levels = sketches, members, {}

    def at(self, width: int) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """(members, matrix of sketches, whether the other side has to be folded) for each width in the block."""
        if width not in self.levels:
            by_width: dict[int, list[int]] = {}
            for i in self.members:
                by_width.setdefault(len(self.sketches[i]), []).append(i)
            out = []
            for own, members in by_width.items():
                if not own:
                    continue
                m = np.stack([self.sketches[i] for i in members])
                if own > width:
                    m = m.reshape(len(m), width, -1).sum(axis=2).astype(np.uint8 if own <= 2 * width and m.max() < 128 else np.int64)
                out.append((np.array(members), m, own < width))
            self.levels[width] = out
        return self.levels[width]


def passing_in_blocks(sketches: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """The pairs of places from left and right, of different labels, whose sizes and sketches leave room for a link; of a
    block with itself, each pair once."""
    folded, same = Folded(sketches, right), len(left) == len(right) and (left == right).all()
    blind = np.array([j for j in right if not len(sketches[j])], dtype=np.int64)
    for i in left:
        x, hits = sketches[i], [blind]
        if not len(x):
            hits = [right]
        else:
            for members, m, fold in folded.at(len(x)):
                ok = labels[members] != labels[i]
                if not ok.any():
                    continue
                own = x.reshape(m.shape[1], -1).sum(axis=1) if fold else x
                most = np.minimum(m[ok], own).sum(axis=1, dtype=np.int64)
                hits.append(members[ok][den * most >= num * (sizes[members[ok]] + sizes[i] - most)])
        for j in np.concatenate(hits):
            fits = den * min(sizes[i], sizes[j]) >= num * max(sizes[i], sizes[j])
            if fits and labels[i] != labels[j] and (not same or i < j):
                yield int(i), int(j)


def drawn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each pair of ids, the same whenever it is asked for."""
    with np.errstate(over="ignore"):
        return _mix(np.minimum(a, b).astype(np.uint64) * _M1 + np.maximum(a, b).astype(np.uint64) + _M2).astype(np.float64) / 2.0**64


def cross_pairs(members: DataFrame, labels: DataFrame, number: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of set ids of a group, from different classes, that a round tests; a null pair says that more are left.

    A block with few pairs hands on all of them in the first round; later rounds may test some of these again.

    members has set_id, n_shingles, sketch and group; labels has vertex and component, for sets in a class with others.
    """
    own = members.join(labels, F.col("set_id") == F.col("vertex"), "left").select("set_id", "n_shingles", "sketch", "group", F.coalesce("component", "set_id").alias("label"))
    classes = own.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = classes.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("big"), F.max("n").alias("most"), F.sum("n").alias("total")).where("most < total")
    groups = checkpointed(groups)
    few = groups.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    placed = own.join(F.broadcast(groups) if few else groups, "group").withColumn("bigs", F.ceil(F.col("most") / HOT_BLOCK).cast("int")).withColumn("others", F.ceil((F.col("total") - F.col("most")) / HOT_BLOCK).cast("int"))
    is_big, place = F.col("label") == F.col("big"), F.xxhash64("set_id")
    placed = placed.withColumn("mine", F.when(is_big, F.pmod(place, F.col("bigs"))).otherwise(F.col("bigs") + F.pmod(place, F.col("others"))).cast("int"))
    # Members of the largest class meet the others' blocks only.
    meets = F.sequence(F.when(is_big, F.col("bigs")).otherwise(F.lit(0)), F.col("bigs") + F.col("others") - 1)
    dealt = placed.withColumn("other", F.explode(meets)).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    schema = arrow_schema(members, "a long, b long")
    start, end = (0, *SHARES)[number], SHARES[number]

    def test(table: pa.Table) -> pa.Table:
        table = table.sort_by("set_id")
        ids, place, labels = table["set_id"].to_numpy(), table["mine"].to_numpy(), table["label"].to_numpy()
        sketches = [np.frombuffer(x, np.uint8) for x in table["sketch"].to_pylist()]
        left, right = np.flatnonzero(place == table["i"][0].as_py()), np.flatnonzero(place == table["j"][0].as_py())
        found = np.array(list(passing_in_blocks(sketches, table["n_shingles"].to_numpy(), labels, left, right, num, den)), dtype=np.int64).reshape(-1, 2)
        one, two = ids[found[:, 0]], ids[found[:, 1]]
        more = []
        if len(found) > HANDED or start:
            # A pair that an earlier round tested, and that still lies between classes, is no link.
            share = drawn(one, two)
            now = (share >= start) & (share < end) if end < 1 else share >= start
            more = [None] * bool((share >= end).any() and end < 1)
            one, two = one[now], two[now]
        a, b = np.minimum(one, two).tolist(), np.maximum(one, two).tolist()
        return pa.Table.from_batches([to_batch({"a": a + more, "b": b + more}, schema)])

    columns = ("set_id", "n_shingles", "sketch", "label", "group", "mine", "i", "j")
    # Dealt by blocks, as rows that lie together by group would go to one task.
    return dealt.select(*columns).repartition("group", "i", "j").groupBy("group", "i", "j").applyInArrow(test, "a long, b long")


def segment_table(documents: DataFrame, wanted: DataFrame, order: Order, n: int) -> DataFrame:
    """set_id, f, data: the segments of the sets of `wanted` (doc_id, set_id), by fragment, and a fine sketch as f = FINE; rows may repeat."""
    few = wanted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    asked = wanted.select(F.col("doc_id").alias("member"), F.col("set_id"))
    texts = documents.select("doc_id", "text").join(F.broadcast(asked) if few else asked, F.col("doc_id") == F.col("member"))
    held = documents.sparkSession.sparkContext.broadcast(order)

    def make():
        shingles, by, seen = Shingler(n), held.value, set()

        def work(batch):
            ids, fragments, data = [], [], []
            for text, asked_for in zip(batch["text"].to_pylist(), batch["set_id"].to_pylist(), strict=True):
                own = shingles(text)
                if asked_for in seen or set_id(digest(own)) != asked_for:  # an id may stand for several sets
                    continue
                if len(seen) < MAX_WORDS:
                    seen.add(asked_for)
                parts = [(f, part.tobytes()) for f, part in by.segments(own)] + [(FINE, sketch(own, FINER))]
                ids += [asked_for] * len(parts)
                fragments += [f for f, _ in parts]
                data += [x for _, x in parts]
            return {"set_id": ids, "f": fragments, "data": data}

        return work

    return arrow_map(texts.select("text", "set_id"), make, "set_id long, f int, data binary")


def of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows, by set_id, of the sets in pairs (a, b), which are read twice; all others stay where they are."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    few = ids.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return rows.join(F.broadcast(ids) if few else ids, "set_id", "left_semi")


def vertical_links(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, na, nb) that link: overlaps counted fragment by fragment, and summed per pair."""
    segments = of_pairs(segments.where(F.col("f") != FINE), pairs)
    first = segments.select(F.col("set_id").alias("a"), "f", F.col("data").alias("x"))
    second = segments.select(F.col("set_id").alias("b"), "f", F.col("data").alias("y"))
    met = pairs.join(first, "a").join(second, ["b", "f"])

    def make():
        def work(batch):
            both = zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)
            counts = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in both]
            return {c: batch[c] for c in ("a", "b", "na", "nb", "f")} | {"n": counts}

        return work

    partial = arrow_map(met.select("a", "b", "na", "nb", "f", "x", "y"), make, "a long, b long, na long, nb long, f int, n long")
    # A segment that came twice has counted the same.
    total = partial.groupBy("a", "b", "na", "nb", "f").agg(F.max("n").alias("n")).groupBy("a", "b", "na", "nb").agg(F.sum("n").alias("n"))
    return total.where(den * F.col("n") >= num * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b")


def sized(pairs: DataFrame, reps: DataFrame, *more: str) -> DataFrame:
    """pairs (a, b) with na, nb, and other columns of both sets."""
    reps = of_pairs(reps, pairs)
    sides = [reps.select(F.col("set_id").alias(s), F.col("n_shingles").alias(f"n{s}"), *(F.col(c).alias(f"{c}_{s}") for c in more)) for s in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b")


def near_pairs(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, na, nb of the pairs whose sketches leave room for a link."""

    def make():
        def work(batch):
            rows = zip(*(batch[c].to_pylist() for c in ("sketch_a", "sketch_b", "na", "nb")), strict=True)
            keep = pa.array([may_link(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), na, nb, num, den) for x, y, na, nb in rows], pa.bool_())
            return {c: batch[c].filter(keep) for c in ("a", "b", "na", "nb")}

        return work

    return arrow_map(sized(pairs, reps, "sketch").select("a", "b", "na", "nb", "sketch_a", "sketch_b"), make, "a long, b long, na long, nb long")


def set_links(documents: DataFrame, order: Order, reps: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between set ids whose components are those of all links; reps has doc_id, set_id, n_shingles, sketch."""
    pairs, ties = candidates(documents, order, n, num, den)
    order = Order(order.shared, order.counts)
    near = checkpointed(near_pairs(pairs, reps, num, den))
    groups = connected_components(ties).select(F.col("vertex").alias("set_id"), F.col("component").alias("group"))
    members = checkpointed(reps.join(groups, "set_id").select("set_id", "n_shingles", "sketch", "group"))
    asked = near.select(F.explode(F.array("a", "b")).alias("set_id")).unionByName(members.select("set_id")).distinct()
    segments = checkpointed(segment_table(documents, reps.join(asked, "set_id", "left_semi").select("doc_id", "set_id"), order, n))
    links = checkpointed(vertical_links(near, segments, num, den))
    fine = segments.where(F.col("f") == FINE).groupBy("set_id").agg(F.first("data").alias("sketch"))
    members = checkpointed(members.drop("sketch").join(fine, "set_id"))
    for number in range(len(SHARES)):
        found = checkpointed(cross_pairs(members, connected_components(links), number, num, den))
        if found.isEmpty():
            break
        tested = checkpointed(sized(found.where("a IS NOT NULL"), reps))
        links = checkpointed(links.unionByName(vertical_links(tested, segments, num, den)))
        if found.where("a IS NULL").isEmpty():
            break
    return links


def linked(documents: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id of each row, in no order."""
    sets = checkpointed(set_table(documents, n))
    filled = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = checkpointed(
        filled.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("set_id").alias("set_id"), F.first("sketch").alias("sketch"))
    )
    between = set_links(documents, global_order(sets), classes.select(F.col("rep").alias("doc_id"), "set_id", "n_shingles", "sketch"), n, num, den)
    ends = [classes.select(F.col("set_id").alias(s), F.col("rep").alias(f"rep_{s}")) for s in "ab"]
    links = between.join(ends[0], "a").join(ends[1], "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # Ids that stand for several sets tie these sets' representatives.
    several = filled.groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x <> y").select("doc_id")
    own = filled.join(several, "doc_id", "left_semi").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(links.unionByName(own)).select(F.col("vertex").alias("rep"), "component")
    by_set = classes.join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    joined = sets.join(by_set, "digest", "left")
    alone = F.col("n_shingles") == 0
    return joined.select("doc_id", "n_shingles", F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def components(documents: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links, itself included) of each row; see the module's text."""
    return linked(documents, n, num, den)


def representatives(documents: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows, with all their columns, whose doc_id is their component's id: one document of each group stays.

    Rows with an empty set or a null id stay. Of rows with one id, all stay or none.
    """
    gone = checkpointed(linked(documents, n, num, den).where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct())
    few = gone.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST  # then the texts stay where they are
    return documents.join(F.broadcast(gone) if few else gone, documents["doc_id"] == gone["gone"], "left_anti")
