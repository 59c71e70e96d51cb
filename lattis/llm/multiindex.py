"""Embedding near-dedup with an inverted multi-index.

Vectors are scaled to length 1 and cut into two halves.  Each half has a codebook of its
own (k-means on a bounded sample, both fitted independently); the pair of nearest
centroids is a vector's cell in the product grid.  Every vector is indexed.

Search.  Each vector visits cells in order of its distance to them by a multi-sequence
traversal (both halves' distances sorted, the grid walked by a heap of the next best sums), as
far as ``slack`` beyond its own cell.  The slack is the smallest at which a bounded sample
of queries, compared with every vector, finds ``TARGET`` of its links (each query counts the
same), two standard errors allowed for.  Where fewer than ``ENOUGH`` queries of the whole sample have links, recall can't be
measured, and need not be: the grid gets coarse, and vectors visit every cell that can hold a link at all.  (A partner lies
on its own centroid's side of the plane between that and ours, so that the distances of a vector to these planes
bound its distance to anything in a cell.)  Then every link is found.  A pair is found if either vector visits the other's cell; where both do, it counts in
one of the two cells, so link counts are whole for both ends.  What meets is then verified:
cosine in double precision.

Blocks.  Rows with the same vector collapse to one class with a multiplicity.  Members and visitors
of a cell are dealt to chunks of about ``CHUNK``, and every two chunks meet in one
task of bounded size.  A task returns sums of links per class and a
spanning forest of the links it saw, never pairs; forests join to components.

Defined cases: vectors that are null, empty or zero, of another length than most, or hold null
or non-finite components have no links and are components of their own; a null id is kept,
rows of a repeated id each get their row and link with each other's vectors as any rows do; columns beyond the two are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut
from .graph import components

THRESHOLD, TARGET = 0.95, 0.97
#: Rows that codebooks are fitted on, queries that calibrate the radius, classes in a chunk.
SAMPLE, QUERIES, CHUNK = 20_000, 2048, 1024
#: Vectors that a cell holds on average, and sample rows that a centroid needs.
PER_CELL, PER_CENTROID = 16, 4
#: Cells up to which the table of their sizes is broadcast (24 bytes each).
BROADCAST_CELLS = 500_000
#: Steps of squared distance that calibration tells apart, up to the largest slack it finds.
STEPS, FARTHEST = 800, 4.0
#: Queries with links that a measured recall needs.
ENOUGH = 100


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt((v * v).sum(1))[:, None]


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids * centroids).sum(1)[None, :] - 2 * points @ centroids.T, axis=1)


def codebook(points: np.ndarray, k: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """k-means; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(points, centroids)
        sums, n = np.zeros_like(centroids), np.bincount(own, minlength=len(centroids))
        np.add.at(sums, own, points)
        centroids[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centroids


def traverse(first: np.ndarray, second: np.ndarray, order1: np.ndarray, order2: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) by rising first[i] + second[j], as far as ``limit``; orders: both sorted."""
    heap, seen = [(first[order1[0]] + second[order2[0]], 0, 0)], {(0, 0)}
    while heap:
        d, a, b = heapq.heappop(heap)
        if d > limit:
            return
        yield int(order1[a]), int(order2[b])
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(order1) and y < len(order2) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[order1[x]] + second[order2[y]], x, y))


class Grid:
    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.books = [codebook(sample[:, : self.half], k), codebook(sample[:, self.half :], k)]
        self.slack = 0.0
        #: Largest squared distance of a link where every cell within it is visited, else None.
        self.bound: float | None = None

    def distances(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Squared distances of both halves to their centroids, but for a constant of each vector."""
        halves = vectors[:, : self.half], vectors[:, self.half :]
        return [(b * b).sum(1)[None, :] - 2 * x @ b.T for x, b in zip(halves, self.books)]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        one, two = self.distances(vectors)
        return one.argmin(1) * two.shape[1] + two.argmin(1)

    def visits(self, vectors: np.ndarray) -> list[list[int]]:
        """The cells that each vector visits, its own first."""
        one, two = self.distances(vectors)
        width = two.shape[1]
        if self.bound is not None:
            return self._within(one, two, width)
        least1, least2 = one.min(1), two.min(1)
        near1, near2 = one <= (least1 + self.slack)[:, None], two <= (least2 + self.slack)[:, None]
        out = [[c] for c in (one.argmin(1) * width + two.argmin(1)).tolist()]
        for r in np.flatnonzero((near1.sum(1) > 1) | (near2.sum(1) > 1)):
            i, j = np.flatnonzero(near1[r]), np.flatnonzero(near2[r])
            i, j = i[np.argsort(one[r, i], kind="stable")], j[np.argsort(two[r, j], kind="stable")]
            home = out[r][0]
            out[r] += [c for x, y in traverse(one[r], two[r], i, j, least1[r] + least2[r] + self.slack) if (c := x * width + y) != home]
        return out


    def _within(self, one: np.ndarray, two: np.ndarray, width: int) -> list[list[int]]:
        """The cells that come within the bound of each vector, its own first."""
        gaps = []
        for d, book in zip((one, two), self.books):
            home = d.argmin(1)
            apart = np.sqrt(np.maximum((book * book).sum(1)[:, None] + (book * book).sum(1)[None, :] - 2 * book @ book.T, 0))[home]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(apart > 1e-12, np.maximum(d - d[np.arange(len(d)), home][:, None], 0) / (2 * apart), 0.0)
            gaps.append(plane * plane)
        out = [[c] for c in (one.argmin(1) * width + two.argmin(1)).tolist()]
        for r, cells in enumerate(out):
            home, first, second = cells[0], gaps[0][r], gaps[1][r]
            i, j = np.flatnonzero(first <= self.bound), np.flatnonzero(second <= self.bound)
            i, j = i[np.argsort(first[i], kind="stable")], j[np.argsort(second[j], kind="stable")]
            cells += [c for x, y in traverse(first, second, i, j, self.bound) if (c := x * width + y) != home]
        return out


def packed(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """ident and ``v``: the vector as bytes of float64, null if it can't link."""
    bounded_batches(df.sparkSession)
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                v = np.array([np.nan if c is None else c for c in x], "<f8") if x else np.zeros(0)
                # scaled by the largest component first, so that squares neither vanish nor overflow
                good = len(v) and np.isfinite(v).all() and np.abs(v).max() > 0
                out.append(v.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["ident", "v"])

    return df.select(F.col(ident).alias("ident"), F.col(vector).cast("array<double>")).mapInArrow(run, f"ident {kind}, v binary")


def rows_of(column) -> np.ndarray:
    """Packed vectors of one length as rows of length 1."""
    v = np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)
    return unit(v / np.abs(v).max(1)[:, None])


def fit(classes: DataFrame, n: int, sample: int = SAMPLE, queries: int = QUERIES, threshold: float = THRESHOLD, target: float = TARGET) -> Grid:
    """Codebooks from a bounded sample (by hash); slack from queries compared with all classes, or the bound of a link."""
    picked = classes.orderBy(F.xxhash64("v")).limit(min(sample, n)).select("v").toArrow()["v"].to_pylist()
    points = rows_of(picked)
    largest = max(1, len(points) // PER_CENTROID)
    grid = Grid(points, int(min(max(1, round(np.sqrt(n / PER_CELL))), largest)))
    counted = np.zeros((0, STEPS + 1), np.int64)
    # further queries are drawn while few have links
    for at in range(0, len(points), queries):
        counted = np.concatenate([counted, _links_by_step(classes, points[at : at + queries], grid, threshold)])
        if (counted.sum(1) > 0).sum() >= ENOUGH:
            break
    links = counted[counted.sum(1) > 0]
    if len(links) < ENOUGH:
        # cells of a chunk each: vectors go to many cells, so that these are few
        coarse = Grid(points, int(min(max(1, round(np.sqrt(n / CHUNK))), largest)))
        coarse.bound = 2 - 2 * threshold + 1e-9
        return coarse
    # every query counts the same, however many links it has
    share = np.cumsum(links, 1) / links.sum(1)[:, None]
    # the mean less two of its standard errors, so that few queries do not promise too much
    found = share.mean(0) - 2 * share.std(0) / np.sqrt(len(share))
    grid.slack = float(np.argmax(found >= target)) / STEPS * FARTHEST + 1e-9
    return grid


def _links_by_step(classes: DataFrame, queries: np.ndarray, grid: Grid, threshold: float) -> np.ndarray:
    """Per query, its links among all classes by the step of slack that covers them."""
    own = classes.sparkSession.sparkContext.broadcast((queries, grid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, g = own.value
        home, width, ask = g.cells(asked), STEPS + 1, g.distances(asked)
        columns, least = len(g.books[1]), ask[0].min(1) + ask[1].min(1)
        counts = np.zeros(len(asked) * width, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                v = rows_of(b.column(0).slice(at, 4096).to_pylist())
                q, c = np.nonzero(asked @ v.T >= threshold)
                if len(q):
                    own_d = g.distances(v[c])
                    cell, rows = own_d[0].argmin(1) * columns + own_d[1].argmin(1), np.arange(len(q))
                    there = ask[0][q, cell // columns] + ask[1][q, cell % columns] - least[q]
                    back = own_d[0][rows, home[q] // columns] + own_d[1][rows, home[q] % columns] - own_d[0].min(1) - own_d[1].min(1)
                    # rounded up, so that the slack of a step covers what it counts
                    step = np.ceil(np.minimum(there, back) / FARTHEST * STEPS).astype(np.int64).clip(0, STEPS)
                    counts += np.bincount(q * width + step, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["place", "links"])

    tally = classes.select("v").mapInArrow(run, "place bigint, links bigint").groupBy("place").agg(F.sum("links").alias("links")).toPandas()
    links = np.zeros(len(queries) * (STEPS + 1), np.int64)
    links[tally["place"].to_numpy(dtype=np.int64)] = tally["links"].to_numpy()
    links = links.reshape(-1, STEPS + 1)
    links[:, 0] -= 1  # every query finds itself in its own cell
    return links


def link(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: ident, ``n_links``, ``component_id``, ``kept``."""
    spark = df.sparkSession
    rows = cut(packed(df, ident, vector), "vectors")
    sizes = rows.where("v is not null").groupBy(F.length("v").alias("bytes")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bytes").limit(1).collect()
    width = sizes[0].bytes if sizes else 8
    good = F.col("v").isNotNull() & (F.length("v") == width)
    # a class: rows with the very same vector; its number is a hash of it, its least id names it
    grouped = cut(rows.where(good).groupBy("v").agg(F.count("*").alias("copies"), F.min("ident").alias("least")).withColumn("uid", F.monotonically_increasing_id()), "classes")
    n = grouped.count()
    if n == 0:
        return rows.select(F.col("ident").alias(ident), F.lit(0).cast("bigint").alias("n_links"), F.col("ident").alias("component_id"), F.lit(True).alias("kept"))
    grid = fit(grouped, n, threshold=threshold)
    found = cut(_blocks(cut(_filed(grouped, grid), "cells"), threshold), "found")
    counts = found.where("n is not null").groupBy("uid").agg(F.sum("n").alias("n"))
    parts = components(found.where("other is not null").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    classes = grouped.select("uid", "v", "copies", "least").join(counts, "uid", "left").join(parts.withColumnRenamed("node", "uid"), "uid", "left")
    classes = classes.withColumn("component", F.coalesce("component", "uid"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "component").select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(named, "v", "left")
    component = F.coalesce("component_id", "ident")
    return out.select(F.col("ident").alias(ident), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("ident") == component, F.lit(True)).alias("kept"))


def _filed(classes: DataFrame, grid: Grid) -> DataFrame:
    """Classes with ``home``, their cell, and ``away``, the other cells that they visit."""
    shared = classes.sparkSession.sparkContext.broadcast(grid)
    cells = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = shared.value.visits(rows_of(b.column(1).to_pylist())) if b.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x[0] for x in seen], pa.int64()), pa.array([x[1:] for x in seen], cells)], names=["uid", "v", "copies", "home", "away"]
            )

    return classes.select("uid", "v", "copies").mapInArrow(run, "uid bigint, v binary, copies bigint, home bigint, away array<bigint>")


def _blocks(filed: DataFrame, threshold: float) -> DataFrame:
    """(uid, n) sums of links and (uid, other) edges of forests, from all chunks that meet."""
    visitors = filed.select("uid", "v", "copies", "home", "away", F.explode("away").alias("cell"))
    chunks = lambda n: F.greatest(F.ceil(F.col(n) / CHUNK), F.lit(1)).cast("int")
    members = filed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("n"))
    callers = visitors.groupBy("cell").agg(F.count("*").alias("k"))
    sizes = cut(members.join(callers, "cell", "left").select("cell", chunks("n").alias("own"), chunks("k").alias("guests")), "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_CELLS else sizes
    own_chunk = F.pmod(F.xxhash64("uid"), F.col("own")).cast("int")
    guest_chunk = F.pmod(F.xxhash64("uid"), F.col("guests")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, a, b, side: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(side).alias("side"))
    rows = ["uid", "v", "copies", "home", "away"]
    # members meet the guests of every chunk, and the members of the other chunks once
    mine = filed.withColumn("cell", F.col("home")).join(sizes, "cell").withColumn("c", own_chunk)
    mine = mine.select("cell", *rows, F.explode(F.concat(
        F.transform(upto("guests"), lambda g: place("guests", F.col("c"), g, 0)),
        F.transform(F.filter(upto("own"), lambda o: o > F.col("c")), lambda o: place("members", F.col("c"), o, 0)),
        F.transform(F.filter(upto("own"), lambda o: o < F.col("c")), lambda o: place("members", o, F.col("c"), 1)),
    )).alias("p"))
    theirs = visitors.join(sizes, "cell").withColumn("c", guest_chunk)
    theirs = theirs.select("cell", *rows, F.explode(F.transform(upto("own"), lambda o: place("guests", o, F.col("c"), 1))).alias("p"))
    met = mine.unionByName(theirs).select("cell", "p.kind", "p.a", "p.b", "p.side", *rows)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        empty = pd.DataFrame({"uid": pd.array([], "int64"), "n": pd.array([], "Int64"), "other": pd.array([], "Int64")})
        guests, cell = pdf["kind"].iloc[0] == "guests", int(pdf["cell"].iloc[0])
        within = guests and int(pdf["b"].iloc[0]) == 0  # the members of a chunk meet each other where they meet the first guests
        if not len(one) or not (len(two) or within and len(one) > 1):
            return empty
        ids1, ids2 = one["uid"].to_numpy(), two["uid"].to_numpy()
        v1 = rows_of(one["v"].tolist())
        copies1 = one["copies"].to_numpy().astype(np.float64)
        uid, n, edges = [], [], []
        if within:
            close = v1 @ v1.T >= threshold
            np.fill_diagonal(close, False)
            uid.append(ids1)
            n.append(close @ copies1)
            edges.append(spanning(close, ids1, ids1))
        if len(two):
            close = v1 @ rows_of(two["v"].tolist()).T >= threshold
            if guests:
                # a pair that visits both ways counts in the smaller cell
                homes = two["home"].to_numpy()
                for i, away in enumerate(one["away"]):
                    if len(away):
                        close[i] &= ~(np.isin(homes, away) & (homes < cell))
            uid += [ids1, ids2]
            n += [close @ two["copies"].to_numpy().astype(np.float64), copies1 @ close]
            edges.append(spanning(close, ids1, ids2))
        uid, n, edges = np.concatenate(uid), np.concatenate(n).astype(np.int64), np.concatenate(edges)
        uid, n = uid[n > 0], n[n > 0]
        none = lambda k: pd.array([pd.NA] * k, "Int64")
        return pd.concat([
            pd.DataFrame({"uid": uid, "n": pd.array(n, "Int64"), "other": none(len(uid))}),
            pd.DataFrame({"uid": edges[:, 0], "n": none(len(edges)), "other": pd.array(edges[:, 1], "Int64")}),
        ])

    return met.groupBy("cell", "kind", "a", "b").applyInPandas(block, "uid bigint, n bigint, other bigint")


def spanning(close: np.ndarray, ids1: np.ndarray, ids2: np.ndarray) -> np.ndarray:
    """Edges (id, smaller id) that join what a block of links joins: a star per component."""
    i, j = np.nonzero(close)
    names = np.unique(np.concatenate([ids1[i], ids2[j]]))
    a, b = np.searchsorted(names, ids1[i]), np.searchsorted(names, ids2[j])
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(names))
    return np.stack([names[moved], names[label[moved]]], 1)
