"""Exact top-k inner products by best-first search of M-trees.

Integer vectors of any lengths lie on a sphere of radius R once a coordinate
``sqrt(R^2 - |x|^2)`` is added; a query gets a zero there. Then ``d(q, x)^2 = |q|^2 + R^2 -
2 q.x``: the nearest rows are those of the largest inner product, and distances between rows
obey the triangle inequality, which is all that a metric tree needs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.llm.vectors import best, classes_of_equals, usable
from adtally.session import materialize

PAGES = (
    "region int, part int, page int, leaf boolean, children array<int>, ids array<array<long>>, vectors binary, "
    "radii array<double>, parent_distances array<double>"
)
#: Bounds are floating-point; a page is passed over only if it misses by more than this share of the sphere's size.
SLACK = 1e-9


def scaled(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


@dataclass
class Page:
    """Entries of a node: vectors, how far they are from the node's own routing object, and what hangs below.

    A leaf's entries are rows, and ``below`` has the ids of each; an inner page's are routing
    objects, with the number of a page below and its covering radius.
    """

    leaf: bool
    vectors: np.ndarray
    radii: np.ndarray
    parent_distances: np.ndarray
    below: list

    def flat_ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a leaf's entries, and for each the place of its entry among ``entries``."""
        lists = [self.below[entry] for entry in entries]
        return np.array([name for own in lists for name in own], np.int64), np.repeat(np.arange(len(lists)), [len(own) for own in lists])


class TreeBuilder:
    """Loads a tree of pages of at most ``capacity`` entries from all of its rows; page 0 is the root."""

    def __init__(self, vectors: np.ndarray, ids: list, radius2: int, capacity: int = 64) -> None:
        self.x, self.ids, self.capacity = vectors, ids, capacity
        self.height = np.sqrt(np.maximum(radius2 - (vectors * vectors).sum(axis=1), 0).astype(float))
        self.pages: list[Page | None] = []

    def distances(self, rows: np.ndarray, point: np.ndarray, height: float) -> np.ndarray:
        flat = self.x[rows] - point
        return np.sqrt((flat * flat).sum(axis=1) + (self.height[rows] - height) ** 2)

    def add(self, rows: np.ndarray, point: np.ndarray, height: float) -> int:
        number = len(self.pages)
        self.pages.append(None)
        if len(rows) <= self.capacity:
            self.pages[number] = Page(
                True, self.x[rows], np.zeros(len(rows)), self.distances(rows, point, height), [self.ids[r] for r in rows]
            )
            return number
        width = min(self.capacity, -(-len(rows) // self.capacity) + 1)
        routers = rows[np.random.default_rng(number).permutation(len(rows))[:width]]
        far = np.stack([self.distances(rows, self.x[r], self.height[r]) for r in routers])
        own = far.argmin(axis=0)
        if np.bincount(own, minlength=width).max() == len(rows):
            own = np.arange(len(rows)) % width
        kept, radii, below = [], [], []
        for at, router in enumerate(routers):
            members = own == at
            if members.any():
                kept.append(router)
                radii.append(far[at][members].max())
                below.append(self.add(rows[members], self.x[router], self.height[router]))
        kept = np.array(kept)
        self.pages[number] = Page(False, self.x[kept], np.array(radii), self.distances(kept, point, height), below)
        return number


@dataclass
class Tops:
    """The k best rows of each query of a block: scores falling, ties by the smaller id. Empty places have the least score."""

    scores: np.ndarray
    ids: np.ndarray

    @classmethod
    def empty(cls, queries: int, k: int) -> Tops:
        return cls(np.full((queries, k), _NONE), np.full((queries, k), -1))

    def take(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores[query], scores), np.append(self.ids[query], ids)
        order = np.lexsort((ids, -scores))[: self.ids.shape[1]]
        self.scores[query], self.ids[query] = scores[order], ids[order]


#: Below every score: a sum of products of whole components stays within 2 ** 62.
_NONE = -(1 << 62)


def search_block(pages: list[Page], queries: np.ndarray, own: np.ndarray, to_root: np.ndarray, radius2: int, k: int,
                 floors: np.ndarray) -> tuple[Tops, np.ndarray]:
    """The k best rows of a tree for each query of a block that are not below its floor, and the distances computed.

    ``to_root`` has the queries' distances from the root's routing object, and a floor of
    ``_NONE`` is none. Pages are opened in order of the least distance their rows can have from any
    query; a page is opened for the queries it can still matter to, and an entry whose stored
    distance from its parent rules it out for all of these is passed over. The rest is one matrix product.
    """
    size = (queries * queries).sum(axis=1) + radius2
    slack = SLACK * np.sqrt(size) + 1e-6
    tops, computed = Tops.empty(len(queries), k), np.zeros(len(queries), np.int64)
    # In doubles a product is exact, and fast, as long as no sum can leave 53 bits.
    exact = float(size.max(initial=0)) < 2**52
    asked = queries.astype(np.float64) if exact else queries

    def reaches(some: np.ndarray) -> np.ndarray:
        """No row farther than this can be wanted."""
        bar = np.maximum(tops.scores[some, -1], floors[some])
        return np.where(bar == _NONE, np.inf, np.sqrt(np.maximum(size[some] - 2.0 * bar, 0)) + slack[some])

    every = np.arange(len(queries))
    limits, ticket = reaches(every), 0
    queue = [(0.0, ticket, 0, every, np.zeros(len(queries)), to_root)]
    while queue:
        _, _, number, some, least, to_parent = heapq.heappop(queue)
        open_for = least <= limits[some]
        if not open_for.any():
            continue
        some, to_parent = some[open_for], to_parent[open_for]
        page = pages[number]
        apart = np.abs(to_parent[:, None] - page.parent_distances) - page.radii
        near = np.flatnonzero((apart <= limits[some][:, None]).any(axis=0))
        computed[some] += len(near)
        vectors = page.vectors[near]
        scores = asked[some] @ (vectors.astype(np.float64) if exact else vectors).T
        if page.leaf:
            bars = np.maximum(tops.scores[some, -1], floors[some])
            ids, entries = page.flat_ids(near)
            hits = scores[:, entries].astype(np.int64) if exact else scores[:, entries]
            good = (hits >= bars[:, None]) & (ids != own[some][:, None])
            for at in np.flatnonzero(good.any(axis=1)):
                tops.take(some[at], hits[at, good[at]], ids[good[at]])
            limits[some] = reaches(some)
        else:
            away = np.sqrt(np.maximum(size[some][:, None] - 2.0 * scores, 0))
            bounds = np.maximum(away - page.radii[near], 0)
            for column, entry in enumerate(near.tolist()):
                wanted = np.flatnonzero(bounds[:, column] <= limits[some])
                if len(wanted):
                    ticket += 1
                    own_bounds = bounds[wanted, column]
                    heapq.heappush(queue, (own_bounds.min(), ticket, page.below[entry], some[wanted], own_bounds, away[wanted, column]))
    return tops, computed


def _integers(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def tree_search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, rows_per_tree: int = 4_096,
                most_regions: int = 256, page: int = 64, block: int = 256, id_column: str = "vec_id",
                vector_column: str = "embedding") -> DataFrame:
    """The k rows of ``vectors`` with the highest inner products with each row of ``queries``, exactly.

    Components become ``floor(scale * x)`` and scores are integers, exact while they stay
    below 2^63. Rows go to the nearest of at most ``most_regions`` routing objects, and each
    region becomes one or more M-trees of about ``rows_per_tree`` rows, however crowded it is.
    A query searches its nearest region first; its k-th score there tells which other regions
    can hold better rows, and only those are searched.

    A row that has its query's id is not its answer. Vectors that are null or hold a null or
    non-finite number take no part, nor do those of another length than the most common one,
    nor rows with a null id. Rows that repeat an id and a vector count once; equal scores go
    to the smaller id. Other columns are left out.
    """
    spark = vectors.sparkSession
    rows, asked = (
        frame.where(usable(vector_column, zero_too=True) & F.col(id_column).isNotNull())
        .select(F.col(id_column).cast("long").alias("vec_id"), scaled(vector_column, scale).alias("vector"))
        for frame in (vectors, queries)
    )
    common = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = common["width"]
    rows, asked = (frame.where(F.size("vector") == width) for frame in (rows, asked.distinct()))
    entries = materialize(classes_of_equals(rows, k + 1), "metric-tree-vectors")
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x)
    facts = entries.agg(F.count("*").alias("n"), F.max(square).alias("radius2")).first()
    radius2 = facts["radius2"]
    regions = min(most_regions, -(-facts["n"] // rows_per_tree))
    drawn = entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(regions).select("vector").collect()
    centres = np.array([row.vector for row in drawn], np.int64)
    heights = np.sqrt(np.maximum(radius2 - (centres * centres).sum(axis=1), 0).astype(float))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch.column("vector"), width)
            height = np.sqrt(np.maximum(radius2 - (x * x).sum(axis=1), 0).astype(float))
            far = [((x - c) ** 2).sum(axis=1) + (height - h) ** 2 for c, h in zip(centres, heights)]
            near = np.argmin(far, axis=0).astype(np.int32)
            reach = np.sqrt(np.min(far, axis=0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(reach)],
                                             names=[*batch.schema.names, "region", "reach"])

    placed = materialize(
        entries.mapInArrow(assigned, "vec_id long, ids array<long>, vector array<long>, region int, reach double"),
        "metric-tree-regions",
    )
    # At most most_regions rows.
    known = {r["region"]: r for r in placed.groupBy("region").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).collect()}
    reaches = np.array([known[r]["reach"] if r in known else -np.inf for r in range(regions)])
    parts = [max(1, -(-known[r]["n"] // rows_per_tree)) if r in known else 1 for r in range(regions)]
    part = F.pmod(F.xxhash64("vec_id"), F.element_at(F.array(*map(F.lit, parts)), F.col("region") + 1)).cast("int")

    def built(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id").combine_chunks()
        region, own_part = group.column("region")[0].as_py(), group.column("part")[0].as_py()
        x = _integers(group.column("vector").combine_chunks() if group.num_rows else pa.array([]), width)
        tree = TreeBuilder(x, group.column("ids").to_pylist(), radius2, page)
        tree.add(np.arange(len(x)), centres[region], heights[region])
        made = [
            (region, own_part, n, p.leaf, None if p.leaf else p.below, p.below if p.leaf else None, p.vectors.tobytes(),
             p.radii.tolist(), p.parent_distances.tolist())
            for n, p in enumerate(tree.pages)
        ]
        kinds = [pa.int32()] * 3 + [pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64())), pa.binary(),
                                    pa.list_(pa.float64()), pa.list_(pa.float64())]
        names = [p.split(" ")[0] for p in PAGES.split(", ")]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names=names)

    numbered = placed.select("vec_id", "ids", "vector", "region", part.alias("part"))
    index = materialize(numbered.groupBy("region", "part").applyInArrow(built, PAGES), "metric-tree-pages")
    content = F.struct("page", "leaf", "children", "ids", "vectors", "radii", "parent_distances")
    trees = index.groupBy("region", "part").agg(F.collect_list(content).alias("pages"))

    def routed(first: bool):
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, block):
                    rest = batch.slice(at, block)
                    q = _integers(rest.column("vector"), width)
                    size = (q * q).sum(axis=1)[:, None] + radius2
                    away = np.sqrt(np.maximum(size - 2 * (q @ centres.T), 0).astype(float))
                    home = away.argmin(axis=1)
                    if first:
                        wanted = home[:, None] == np.arange(regions)
                    else:
                        floor = np.array([np.nan if f is None else f for f in rest.column("floor").to_pylist()])
                        limit = np.sqrt(np.maximum(size[:, 0] - 2 * floor, 0)) + SLACK * np.sqrt(size[:, 0]) + 1e-6
                        limit = np.where(np.isnan(limit), np.inf, limit)
                        wanted = (away - reaches <= limit[:, None]) & (home[:, None] != np.arange(regions))
                    for region in np.flatnonzero(wanted.any(axis=0)):
                        some = pa.array(np.flatnonzero(wanted[:, region]))
                        own = rest.take(some)
                        names = np.asarray(own.column("vec_id"), "<i8").tobytes()
                        bars = np.asarray(pc.fill_null(own.column("floor"), _NONE), "<i8").tobytes()
                        wide, far = q[np.asarray(some)].astype("<i8").tobytes(), away[np.asarray(some), region].astype("<f8").tobytes()
                        for own_part in range(parts[region]):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([region], pa.int32()), pa.array([own_part], pa.int32()),
                                 *(pa.array([packed], pa.binary()) for packed in (names, bars, wide, far))],
                                names=["region", "part", "queries", "floors", "wanted", "away"],
                            )

        return route

    def decoded(stored: list[dict]) -> list[Page]:
        return [
            Page(p["leaf"], np.frombuffer(p["vectors"], np.int64).reshape(-1, width), np.array(p["radii"]),
                 np.array(p["parent_distances"]), p["ids"] if p["leaf"] else p["children"])
            for p in sorted(stored, key=lambda p: p["page"])
        ]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pages = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                key = (batch.column("region")[at].as_py(), batch.column("part")[at].as_py())
                if key != held:
                    # Rows come tree by tree: each is decoded once for all its queries.
                    held, pages = key, decoded(batch.column("pages")[at].as_py())
                names, bars, q = (np.frombuffer(batch.column(c)[at].as_py(), "<i8") for c in ("queries", "floors", "wanted"))
                away = np.frombuffer(batch.column("away")[at].as_py(), "<f8")
                tops, computed = search_block(pages, q.reshape(-1, width), names, away, radius2, k, bars)
                full = tops.scores != _NONE
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, full.sum(axis=1))), pa.array(tops.ids[full]), pa.array(tops.scores[full])],
                    names=["query_id", "vec_id", "score"],
                )

    def visit(frame: DataFrame, first: bool) -> DataFrame:
        routes = frame.mapInArrow(
            routed(first), "region int, part int, queries binary, floors binary, wanted binary, away binary"
        )
        # A row of this join is a block of queries beside one tree.
        pairs = routes.join(trees, ["region", "part"]).select("region", "part", "queries", "floors", "wanted", "away", "pages")
        return best(pairs.mapInArrow(searched, "query_id long, vec_id long, score long"), k)

    home = materialize(visit(asked.withColumn("floor", F.lit(None).cast("long")), True), "metric-tree-home")
    floors = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    floors = floors.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("low")).alias("floor"))
    others = visit(asked.join(floors, "vec_id", "left").select("vec_id", "vector", "floor"), False)
    return best(home.select("query_id", "vec_id", "score").union(others.select("query_id", "vec_id", "score")), k)
