"""Nearest neighbours by inner product, with cross-polytope hashing.

A hash turns a unit vector by fast pseudo-rotations (three rounds of random signs and a Hadamard transform each) and
assigns it to the nearest signed axis; one table joins the axes of as many rotations as give `bits` bits, the axes of a
rotation's leading coordinates where fewer are wanted. A row lies in one cell of each of TABLES tables. A query probes, in
each table, the cells of the largest sums of its coordinates along their axes. Rows of a probed cell are candidates; only
these are scored, exactly, in double precision, on the original vectors.

Vectors are hashed by direction; lengths are met by bands: rows whose lengths lie within a factor of BAND have tables of
their own, with some 2^bits cells for four times as many rows. The probes of a band are fitted: the k nearest of SAMPLE
queries (by the smallest digests) are found among all rows by one exact scan, and the probes are the fewest by which the
share HIT of those neighbours in the band is met. So recall is measured on every table; it is above 0.9 on vectors
without structure, of equal and unequal lengths (tests measure it). A short band takes one probe, a band of few rows has
one cell, in which every query meets every row. The share of rows that a query scores falls as the table grows.

Rows and queries meet by a join on the cell. Cells are dealt to parts, each vector goes once to each part that holds one of
its cells, and a part's queries come before its rows, which stream past in batches and leave the k best of each query. Equal
vectors of a batch travel as one, with their k + 1 smallest ids, which are all that can stay. Cells with more than their
share of rows or queries are split by salts, a grid of rows by queries. No vector reaches the driver but the sample's.

Nearest first, ties to the smaller vec_id. Vectors that are null, zero or empty, or hold null or non-finite components, and
rows with a null id take no part. Vectors of each dimension are searched among themselves. A row with the query's vec_id is
its own, so repeated ids are never their own neighbours; one of them, the least vector, asks, and a repeated id is listed
once, with its best score. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_schema, checkpointed, to_batch

TABLES, SEED = 12, 11
#: Ratio of lengths in a band, share of the sample's neighbours that the probes meet, and the sample's size.
BAND, HIT, SAMPLE = 1.25, 0.95, 64
#: Rows a cell holds on average, as bits, and cells ranked in fitting.
ROW_BITS, RANKED = 2, 8192
#: Bytes of vectors in a part, and rows or queries from which a cell is split, or a part's fair share if that is more.
PART_BYTES, HOT = 64 << 20, 4096
#: Pairs whose scores are computed at a time, and vectors hashed at a time.
PAIRS, HASHED = 4096, 256
SCHEMA = "query_id long, vec_id long, score double"


class Rotation:
    """A fast pseudo-rotation; assigns vectors to 2^bits signed axes of its leading coordinates."""

    def __init__(self, dim: int, bits: int, seed: tuple) -> None:
        self.width, self.bits = 1 << max(0, dim - 1).bit_length(), bits
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(3, self.width))

    def _hadamard(self, x: np.ndarray) -> np.ndarray:
        h = 1
        while h < self.width:
            x = x.reshape(len(x), -1, 2, h)
            out = np.empty_like(x)
            np.add(x[:, :, 0], x[:, :, 1], out=out[:, :, 0])
            np.subtract(x[:, :, 0], x[:, :, 1], out=out[:, :, 1])
            x = out.reshape(len(x), -1)
            h *= 2
        return x

    def turned(self, x: np.ndarray) -> np.ndarray:
        y = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        for s in self.signs:
            y = self._hadamard(y * s)
        return y

    def along(self, x: np.ndarray) -> np.ndarray:
        """Coordinates along the 2^bits signed axes."""
        y = self.turned(x)[:, : 1 << (self.bits - 1)]
        return np.concatenate([y, -y], axis=1)


class CrossPolytope:
    """Tables of 2^bits cells over directions of one dimension; see the module's text."""

    def __init__(self, dim: int, bits: int, tables: int = TABLES, seed: int = SEED) -> None:
        most = max(0, dim - 1).bit_length() + 1
        count = -(-bits // most)
        sizes = [bits // count + (i < bits % count) for i in range(count)]
        self.bits, self.tables = bits, tables if bits else 1
        self.rotations = [[Rotation(dim, b, (seed, t, i)) for i, b in enumerate(sizes)] for t in range(self.tables)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row in each table."""
        out = np.zeros((len(x), self.tables), dtype=np.int64)
        for t, rotations in enumerate(self.rotations):
            for r in rotations:
                out[:, t] = (out[:, t] << r.bits) + r.along(x).argmax(axis=1)
        return out

    def probes(self, x: np.ndarray, most: int) -> np.ndarray:
        """The `most` likeliest cells (rows, tables, most) of each row in each table, likeliest first."""
        most = min(most, 1 << self.bits)
        out = np.zeros((len(x), self.tables, most), dtype=np.int64)
        for t, rotations in enumerate(self.rotations):
            sums, codes = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
            for r in rotations:
                # A larger coordinate among 2^bits Gaussian ones tells more. Of sums of descending lists the pair (i, j)
                # has (i + 1) * (j + 1) - 1 that are no smaller, so only pairs with that product up to `most` count.
                along = r.along(x) * math.sqrt(r.bits)
                order = np.argsort(-along, axis=1, kind="stable")
                i, j = np.nonzero(np.outer(np.arange(1, sums.shape[1] + 1), np.arange(1, along.shape[1] + 1)) <= most)
                both = sums[:, i] + np.take_along_axis(along, order, axis=1)[:, j]
                best = np.argsort(-both, axis=1, kind="stable")[:, :most]
                rows = np.arange(len(x))[:, None]
                sums, codes = both[rows, best], (codes[rows, i[best]] << r.bits) + order[rows, j[best]]
            out[:, t] = codes
        return out


def band_of(norms: np.ndarray) -> np.ndarray:
    return np.floor(np.log(norms) / math.log(BAND) + 0.5).astype(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    largest = np.abs(x).max(axis=1, keepdims=True)
    x = x / largest
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    """Tables by band, with the probes that the fitted neighbours need. `sizes` has the rows of each band."""

    def __init__(self, dim: int, sizes: dict[int, int], queries: np.ndarray, neighbours: list[np.ndarray], tables: int = TABLES, hit: float = HIT) -> None:
        self.bands, self.order = {}, sorted(sizes)
        norms = [np.linalg.norm(n, axis=1) if len(n) else np.zeros(0) for n in neighbours]
        for band in self.order:
            own = [n[band_of(x) == band] if len(n) else n for n, x in zip(neighbours, norms, strict=True)]
            bits = max(0, min(4 * (max(0, dim - 1).bit_length() + 1), sizes[band].bit_length() - 1 - ROW_BITS))
            while True:
                table = CrossPolytope(dim, bits, tables)
                probes = self._needed(table, queries, own, hit)
                if probes is not None:
                    break
                bits -= 1
            self.bands[band] = (table, probes)

    @staticmethod
    def _needed(table: CrossPolytope, queries: np.ndarray, neighbours: list[np.ndarray], hit: float) -> int | None:
        """The probes in each table by which the share `hit` of neighbours is met; None if RANKED don't do."""
        places = []
        if any(map(len, neighbours)):
            ranked = table.probes(unit(queries), RANKED)
            for own, near in zip(ranked, neighbours, strict=True):
                if len(near):
                    found = own[:, :, None] == table.cells(unit(near)).T[:, None, :]
                    places.append(np.where(found.any(axis=1), found.argmax(axis=1), 1 << 62).min(axis=0))
        if not places:
            return 1
        place = int(np.quantile(np.concatenate(places), hit, method="higher"))
        return None if place >= 1 << 62 else place + 1

    def _code(self, band: int, cells: np.ndarray) -> np.ndarray:
        """Cell numbers that differ by band and table."""
        table = np.arange(cells.shape[1], dtype=np.int64).reshape((1, -1) + (1,) * (cells.ndim - 2))
        return mixed(cells, mixed(table + 1, np.int64(self.order.index(band) + 1)))

    def row_cells(self, x: np.ndarray) -> np.ndarray:
        """(row, cell) of each vector's cells, by row."""
        bands, parts = band_of(np.linalg.norm(x, axis=1)), []
        for band in np.unique(bands):
            at = np.flatnonzero(bands == band)
            cells = self._code(int(band), self.bands[int(band)][0].cells(unit(x[at])))
            parts.append(np.stack([np.repeat(at, cells.shape[1]), cells.ravel()], axis=1))
        return by_first(parts)

    def query_cells(self, x: np.ndarray) -> np.ndarray:
        """(row, cell) of each vector's probes in all bands, by row."""
        parts = []
        for band in self.order:
            table, probes = self.bands[band]
            cells = self._code(band, table.probes(unit(x), probes))
            parts.append(np.stack([np.repeat(np.arange(len(x)), cells[0].size), cells.ravel()], axis=1))
        return by_first(parts)


def by_first(parts: list[np.ndarray]) -> np.ndarray:
    both = np.concatenate(parts) if parts else np.zeros((0, 2), dtype=np.int64)
    return both[np.argsort(both[:, 0], kind="stable")]


def mixed(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A 64-bit hash of integers, as signed ones."""
    with np.errstate(over="ignore"):
        h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(seed).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
        for _ in range(2):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (in the type it came in), dim and band of the rows that take part."""
    v = F.col("embedding")
    rows = embeddings.select("vec_id", v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    doubles = F.col("v").cast("array<double>")
    finite = ~F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(finite).withColumn("norm", F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x * x)))
    return rows.where("norm > 0 AND norm < double('infinity')").withColumn("dim", F.size("v")).select("vec_id", "v", "dim", "norm")


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Best:
    """The k nearest rows so far of each of some queries, by place."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.least = np.full(len(ids), -np.inf)
        self.norms = np.linalg.norm(vectors, axis=1)
        self.waiting, self.held = [], 0

    def add(self, q: np.ndarray, r: np.ndarray, ids: list[np.ndarray], vectors: np.ndarray) -> None:
        """Candidate pairs of query q and row r, in the order of rows, where row r stands for ids[r]."""
        rough = np.empty(len(q))
        cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(q)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if end > start:
                np.dot(self.vectors.take(q[start:end], axis=0), vectors[r[start]], out=rough[start:end])
        near = rough >= self.least[q] - 1e-12 * self.norms[q] * np.linalg.norm(vectors, axis=1)[r]
        q, r = q[near], r[near]
        for at in range(0, len(q), PAIRS):
            a, b = q[at : at + PAIRS], r[at : at + PAIRS]
            score = np.einsum("ij,ij->i", self.vectors[a], vectors[b])  # alike for every pair, so equal vectors tie
            sizes = np.array([len(ids[i]) for i in b])
            vec, a, score = np.concatenate([ids[i] for i in b]), np.repeat(a, sizes), np.repeat(score, sizes)
            other = vec != self.ids[a]
            self.waiting.append((a[other], vec[other], score[other]))
            self.held += len(vec)
            if self.held > max(8 * PAIRS, len(self.found[0])):
                self.trim()

    def trim(self) -> None:
        if self.waiting:
            self._keep(*(np.concatenate(x) for x in zip(*self.waiting, strict=True)))
        self.waiting, self.held = [], 0

    def _keep(self, q: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        q, vec, score = (np.concatenate(x) for x in zip(self.found, (q, vec, score), strict=True))
        order = np.lexsort((vec, -score, q))
        q, vec, score = q[order], vec[order], score[order]
        first = np.ones(len(q), dtype=bool)
        first[1:] = (q[1:] != q[:-1]) | (vec[1:] != vec[:-1])
        q, vec, score = q[first], vec[first], score[first]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = place < self.k
        self.found = (q[keep], vec[keep], score[keep])
        last = place == self.k - 1
        self.least[q[last]] = score[last]

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        self.trim()
        q, vec, score = self.found
        return to_batch({"query_id": self.ids[q], "vec_id": vec, "score": score}, schema)


def exact(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """query_id, rank, vec_id, score, v of the k nearest of a bounded number of queries, by one scan of all rows."""
    dim = vectors.shape[1]
    schema = arrow_schema(rows, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, vectors, k)
        for batch in batches:
            x = vectors_of(batch.column(1), dim)
            rough = vectors @ x.T
            if len(x) > k + 1:  # one of them may be the query itself
                rough = np.where(rough >= np.partition(rough, len(x) - k - 1, axis=1)[:, [len(x) - k - 1]] - 1e-9 * np.abs(rough).max(), rough, -np.inf)
            r, q = np.nonzero(np.isfinite(rough).T)
            best.add(q, r, list(batch.column(0).to_numpy()[:, None]), x)
        yield best.rows(schema)

    found = ranked(rows.select("vec_id", "v").mapInArrow(run, SCHEMA), k)
    return rows.select("vec_id", "v").join(F.broadcast(found), "vec_id")  # k rows for each of the queries given


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, each vec_id once."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fitted(rows: DataFrame, asked: DataFrame, dim: int, sizes: dict[int, int], k: int, tables: int, sample: int, hit: float) -> Index:
    """The index with probes for the neighbours of `sample` queries."""
    chosen = asked.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(sample).toArrow()
    ids, vectors = chosen["vec_id"].to_numpy(), vectors_of(chosen["v"].combine_chunks(), dim)
    near: dict[int, list] = {}
    for r in exact(rows, ids, vectors, k).collect() if len(ids) else []:
        near.setdefault(r.query_id, []).append(r.v)
    return Index(dim, sizes, vectors, [np.array(near.get(i, []), dtype=np.float64).reshape(-1, dim) for i in ids.tolist()], tables, hit)


def hashed(rows: DataFrame, index: Index, dim: int, asks: bool, k: int) -> DataFrame:
    """ids (of equal vectors in a batch, k + 1 at most; a query's own), v and cells of each vector."""
    kind = rows.schema["v"].dataType.elementType.simpleString()
    ddl = f"ids array<long>, v array<{kind}>, cells array<long>"
    schema = arrow_schema(rows, ddl)

    def part(ids: np.ndarray, column: pa.Array) -> pa.RecordBatch:
        x = vectors_of(column, dim)
        if asks:
            firsts, groups = np.arange(len(x)), list(ids[:, None])
        else:
            _, firsts, which = np.unique(x, axis=0, return_index=True, return_inverse=True)
            which = which.ravel()
            order = np.lexsort((ids, which))
            which, own = which[order], ids[order]
            new = np.concatenate([[True], (which[1:] != which[:-1]) | (own[1:] != own[:-1])]) if len(own) else np.zeros(0, bool)
            groups = [g[: k + 1] for g in np.split(own[new], np.flatnonzero(np.diff(which[new])) + 1)] if len(own) else []
        pairs = (index.query_cells if asks else index.row_cells)(x[firsts])
        offsets = np.searchsorted(pairs[:, 0], np.arange(len(firsts) + 1))
        cells = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pairs[:, 1]))
        return to_batch({"ids": pa.array(groups, pa.list_(pa.int64())), "v": column.take(pa.array(firsts)).cast(schema.field("v").type), "cells": cells.cast(schema.field("cells").type)}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = HASHED if asks else max(1, batch.num_rows)
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                yield part(piece.column(0).to_numpy(), piece.column(1))

    return rows.select("vec_id", "v").mapInArrow(run, ddl)


def dealt(vectors: DataFrame, asks: bool, parts: int, salts: dict[int, tuple[int, int]]) -> DataFrame:
    """part, asks, ids, v and cells: each vector once for each part that holds one of its cells; see the module's text."""
    ddl = f"part int, asks boolean, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in vectors.schema)}"
    schema = arrow_schema(vectors, ddl)
    hot = np.array(sorted(salts), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(2)
            flat = cells.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(cells.offsets.to_numpy()))
            first = np.array([x[0] for x in batch.column(0).to_pylist()], dtype=np.int64)
            code = mixed(flat, np.int64(0))
            more: list[tuple[int, int, int]] = []
            for i in np.flatnonzero(np.isin(flat, hot)) if len(hot) else ():
                # My salt of my side, and each of the other's.
                mine, others = salts[int(flat[i])][:: -1 if asks else 1]
                own = int(mixed(first[owner[i : i + 1]], np.int64(1))[0] % mine)
                grid = [(o, own) if asks else (own, o) for o in range(others)]
                codes = mixed(np.full(others, flat[i]), np.array([1 + r * (1 << 20) + q for r, q in grid]))
                code[i] = codes[0]
                more += [(owner[i], flat[i], c) for c in codes[1:]]
            if more:
                added = np.array(more, dtype=np.int64)
                owner, flat, code = np.append(owner, added[:, 0]), np.append(flat, added[:, 1]), np.append(code, added[:, 2])
            part = code % parts
            order = np.lexsort((part, owner))
            owner, part, flat = owner[order], part[order], flat[order]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])])) if len(owner) else np.zeros(0, np.int64)
            for at in range(0, len(new), 8192):
                some = new[at : at + 8192]
                end = new[at + 8192] if at + 8192 < len(new) else len(owner)
                offsets = np.append(some, end) - some[0]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[some[0] : end])).cast(schema.field("cells").type)
                take = pa.array(owner[some])
                columns = {"part": part[some].astype(np.int32), "asks": np.full(len(some), asks), "ids": batch.column(0).take(take), "v": batch.column(1).take(take), "cells": lists}
                yield to_batch({name: x.cast(schema.field(name).type) if isinstance(x, pa.Array) else x for name, x in columns.items()}, schema)

    return vectors.mapInArrow(run, ddl)


def met(both: DataFrame, dim: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best candidates of each query in each part, from rows sorted by part, queries first."""
    schema = arrow_schema(both, SCHEMA)

    class Part:
        def __init__(self, number: int) -> None:
            self.number, self.ids, self.vectors, self.owner, self.cells, self.best = number, [], [], [], [], None

        def ask(self, ids: np.ndarray, x: np.ndarray, owner: np.ndarray, cells: np.ndarray) -> None:
            self.owner.append(owner + sum(map(len, self.ids)))
            self.cells.append(cells)
            self.ids.append(ids)
            self.vectors.append(x)

        def add(self, ids: list[np.ndarray], x: np.ndarray, owner: np.ndarray, cells: np.ndarray) -> None:
            if not self.ids:
                return
            if self.best is None:
                self.best = Best(np.concatenate(self.ids), np.concatenate(self.vectors), k)
                all_cells, all_owner = np.concatenate(self.cells), np.concatenate(self.owner)
                order = np.argsort(all_cells, kind="stable")
                self.sorted_cells, self.sorted_owner = all_cells[order], all_owner[order]
            lo, hi = np.searchsorted(self.sorted_cells, cells, "left"), np.searchsorted(self.sorted_cells, cells, "right")
            n, width = hi - lo, len(self.best.ids)
            # A pair may meet in several cells; blocks of rows bound the pairs held at a time.
            ends = np.cumsum(n)
            at = 0
            while at < len(owner):
                until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 64 * PAIRS, "right")))
                while until < len(owner) and owner[until] == owner[until - 1]:
                    until += 1
                m, start = n[at:until], lo[at:until]
                places = np.repeat(start - (np.cumsum(m) - m), m) + np.arange(m.sum())
                pairs = np.unique(np.repeat(owner[at:until], m) * width + self.sorted_owner[places])
                self.best.add(pairs % width, pairs // width, ids, x)
                at = until

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Part | None = None
        for batch in batches:
            part, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                if a == b:
                    continue
                if now is None or now.number != part[a]:
                    if now is not None and now.best is not None:
                        yield now.best.rows(schema)
                    now = Part(int(part[a]))
                piece = batch.slice(a, b - a)
                lists = piece.column(4)
                owner = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
                cells, x = lists.flatten().to_numpy(), vectors_of(piece.column(3), dim)
                ids = [np.array(i, dtype=np.int64) for i in piece.column(2).to_pylist()]
                if asks[a]:
                    now.ask(np.concatenate(ids), x, owner, cells)
                else:
                    now.add(ids, x, owner, cells)
        if now is not None and now.best is not None:
            yield now.best.rows(schema)

    return both.mapInArrow(run, SCHEMA)


def nearest_of(rows: DataFrame, asked: DataFrame, dim: int, sizes: dict[int, int], k: int, tables: int, sample: int, hit: float) -> DataFrame:
    index = fitted(rows, asked, dim, sizes, k, tables, sample, hit)
    held, asking = checkpointed(hashed(rows, index, dim, False, k)), checkpointed(hashed(asked, index, dim, True, k))
    total = sum(sizes.values())
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-total * tables * dim * 8 // PART_BYTES))
    # A part's fair share of rows is no hot cell; so there are no more hot cells than parts.
    most = max(HOT, total * tables // parts)
    counts = held.select(F.explode("cells").alias("cell"), F.lit(1).alias("r"), F.lit(0).alias("q")).unionAll(asking.select(F.explode("cells"), F.lit(0), F.lit(1)))
    hot = counts.groupBy("cell").agg(F.sum("r").alias("r"), F.sum("q").alias("q")).where((F.col("r") > most) | (F.col("q") > most)).collect()
    salts = {x.cell: (-(-max(1, x.r) // most), -(-max(1, x.q) // most)) for x in hot}
    both = dealt(asking, True, parts, salts).unionByName(dealt(held, False, parts, salts))
    return met(both.repartition(parts, "part").sortWithinPartitions("part", F.desc("asks")), dim, k)


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, tables: int = TABLES, sample: int = SAMPLE, hit: float = HIT) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, a vector whose vec_id is divisible by `every`."""
    rows = usable(embeddings)
    counts = rows.groupBy("dim", F.floor(F.log("norm") / math.log(BAND) + 0.5).alias("band")).count().collect()
    found = rows.sparkSession.createDataFrame([], SCHEMA)
    for dim in sorted({r.dim for r in counts}):
        sizes: dict[int, int] = {}
        for r in counts:
            # Rounding may put a length at a band's edge into the next one.
            for band in (r.band - 1, r.band, r.band + 1) if r.dim == dim else ():
                sizes[band] = max(sizes.get(band, 0), r["count"] if band == r.band else 1)
        own = rows.where(F.col("dim") == dim)
        asked = own.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
        found = found.unionByName(nearest_of(own, asked, dim, sizes, k, tables, sample, hit))
    return ranked(found, k)
