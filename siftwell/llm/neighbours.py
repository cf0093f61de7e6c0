"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, with shard results merged.

Rows go to shards of bounded size by hash. A shard's graph has layers; each holds a sixteenth of the nodes of the one
below and, for every node, a fixed number of neighbours in one flat array. Layers are built from the top down: a node
finds its place by way of the layers above, searches its own layer with a beam, and is linked to near nodes that do
not lie behind one another. Nodes are inserted, and queries searched, many at a time: all beams of a block advance
together on arrays. Equal vectors are one node with a list of rows, so copies cannot fill a beam.

Nearness is the inner product. One more coordinate gives all vectors of a shard the same length, so that links can
follow distances; queries have zero there. Scores are computed anew from the original vectors in double precision.
"""

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import ship
from siftwell.storage import staged

SHARD_ROWS = 8_192
QUERY_ROWS = 4_096
LINKS, BASE_LINKS = 16, 32
BUILD_BEAM, SEARCH_BEAM, ENTRIES = 64, 160, 4
BLOCK = 256
NEIGHBOURS = 20
QUERY_STEP = 20


class Graph:
    """x: unit-length nodes; layers: from the top, the nodes of each and an array of their neighbours, -1 where there is none."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.layers = x, layers
        self.place = []
        for nodes, _ in layers:
            place = np.full(len(x), -1, np.int32)
            place[nodes] = np.arange(len(nodes), dtype=np.int32)
            self.place.append(place)

    def entries(self, queries: np.ndarray, below: int) -> np.ndarray:
        """For each query the nearest nodes found on the layers above layer `below`."""
        at = np.full((len(queries), 1), self.layers[0][0][0], np.int32)
        for k in range(below):
            at = self.beam(k, queries, at, 2 * ENTRIES)[0][:, :ENTRIES]
        return at

    def beam(self, k: int, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and nearness of each query's beam on layer k, nearest first; -1 and -inf fill it up."""
        x, place, links = self.x, self.place[k], self.layers[k][1]
        rows = np.arange(len(queries))
        found = np.full((len(queries), width), -1, np.int32)
        near = np.full((len(queries), width), -np.inf, np.float32)
        done = np.ones((len(queries), width), bool)
        first = entry.shape[1]
        found[:, :first] = entry
        near[:, :first] = np.where(entry >= 0, np.einsum("qd,qnd->qn", queries, x[entry]), -np.inf)
        done[:, :first] = entry < 0
        seen = np.zeros((len(queries), len(self.layers[k][0])), bool)
        for c in range(first):
            seen[rows, place[entry[:, c]]] |= entry[:, c] >= 0
        while True:
            open_near = np.where(done, -np.inf, near)
            best = open_near.argmax(axis=1)
            active = np.flatnonzero(open_near[rows, best] > -np.inf)
            if not len(active):
                break
            done[active, best[active]] = True
            around = links[place[found[active, best[active]]]]
            spot = place[around]
            fresh = (around >= 0) & ~seen[active[:, None], spot]
            seen[active[:, None], np.where(fresh, spot, 0)] |= fresh
            nearness = np.einsum("qd,qnd->qn", queries[active], x[around], optimize=True)
            nearness[~fresh] = -np.inf
            all_near = np.concatenate([near[active], nearness], axis=1)
            top = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
            near[active] = np.take_along_axis(all_near, top, 1)
            found[active] = np.take_along_axis(np.concatenate([found[active], around], axis=1), top, 1)
            closed = np.concatenate([done[active], np.zeros(around.shape, bool)], axis=1)
            done[active] = np.take_along_axis(closed, top, 1)
            done |= near == -np.inf
        order = np.argsort(-near, axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        return np.where(near > -np.inf, np.take_along_axis(found, order, 1), -1), near


def _spread_out(x: np.ndarray, own: np.ndarray, options: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each node's options, nearest first, those nearer to it than to any chosen before; the rest fills up."""
    chosen = np.zeros(options.shape, bool)
    valid = options >= 0
    vectors = x[options]
    between = vectors @ vectors.transpose(0, 2, 1)
    blocked = np.zeros(options.shape, bool)
    for c in range(options.shape[1]):
        take = valid[:, c] & ~blocked[:, c] & (chosen.sum(axis=1) < most)
        chosen[:, c] = take
        blocked |= take[:, None] & (between[:, c] > near)
    # Chosen ones first, then the nearest of the others.
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * options.shape[1] + np.arange(options.shape[1])
    order = np.argsort(rank, axis=1)[:, :most]
    picked = np.take_along_axis(np.where(valid, options, -1), order, 1)
    return np.pad(picked, ((0, 0), (0, max(0, most - picked.shape[1]))), constant_values=-1)


def _exact(x: np.ndarray, own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of `others` to each of `own`, itself left out."""
    near = x[own] @ x[others].T
    near[own[:, None] == others[None, :]] = -np.inf
    order = np.argsort(-near, axis=1, kind="stable")[:, :BUILD_BEAM]
    near = np.take_along_axis(near, order, 1)
    return np.where(near > -np.inf, others[order], -1).astype(np.int32), near


def _insert(graph: Graph, k: int, new: np.ndarray, options: np.ndarray, near: np.ndarray) -> None:
    """Link new nodes of layer k to some of their options, and those back to them."""
    x, place, links = graph.x, graph.place[k], graph.layers[k][1]
    most = links.shape[1]
    mine = _spread_out(x, new, options, near, most // 2)
    links[place[new], : mine.shape[1]] = mine
    source, target = np.repeat(new, mine.shape[1]), mine.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    for r in range(0, int(rank.max(initial=-1)) + 1, most):
        some = (rank >= r) & (rank < r + most)
        nodes, row = np.unique(target[some], return_inverse=True)
        more = np.full((len(nodes), most), -1, np.int32)
        more[row, rank[some] - r] = source[some]
        pool = np.concatenate([links[place[nodes]], more], axis=1)
        pool = np.sort(pool, axis=1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
        nearness = np.where(pool >= 0, np.einsum("qd,qnd->qn", x[nodes], x[pool], optimize=True), -np.inf)
        order = np.argsort(-nearness, axis=1, kind="stable")
        pool, nearness = np.take_along_axis(pool, order, 1), np.take_along_axis(nearness, order, 1)
        links[place[nodes]] = _spread_out(x, nodes, pool, nearness, most)


def build(x: np.ndarray, seed: int = 0) -> Graph:
    """The graph of distinct vectors."""
    lengths = np.sqrt((x**2).sum(axis=1))
    top = max(float(lengths.max()), 1e-30)
    extra = np.sqrt(np.maximum(0, 1 - (lengths / top) ** 2))
    unit = np.concatenate([x / top, extra[:, None]], axis=1).astype(np.float32)
    rng = np.random.default_rng(seed)
    height = np.floor(-np.log(1 - rng.random(len(x))) / np.log(LINKS)).astype(int)
    order = np.argsort(-height, kind="stable").astype(np.int32)
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    graph = Graph(unit, layers)
    upper = 0
    for level in range(int(height.max()), -1, -1):
        nodes = order[height[order] >= level]
        if level and len(nodes) < LINKS:
            continue
        layers.append((nodes, np.full((len(nodes), LINKS if level else BASE_LINKS), -1, np.int32)))
        graph = Graph(unit, layers)
        k = len(layers) - 1
        # Few at a time to begin with: while options are few, links reach far, and later nodes find their way by them.
        i, size = 0, LINKS
        while i < len(nodes):
            end = min(len(nodes), i + size) if i >= upper else min(upper, i + size)
            new = nodes[i:end]
            if i < max(upper, 2 * LINKS):
                found, near = _exact(unit, new, nodes[:end])
            else:
                found, near = graph.beam(k, unit[new], graph.entries(unit[new], k) if k else np.repeat(nodes[:1, None], len(new), 0), BUILD_BEAM)
                own, own_near = _exact(unit, new, new)
                found, near = np.concatenate([found, own], axis=1), np.concatenate([near, own_near], axis=1)
                best = np.argsort(-near, axis=1, kind="stable")[:, :BUILD_BEAM]
                found, near = np.take_along_axis(found, best, 1), np.take_along_axis(near, best, 1)
            _insert(graph, k, new, found, near)
            i, size = end, min(BLOCK, max(LINKS, end))
        upper = len(nodes)
    return graph


def search(graph: Graph, queries: np.ndarray, width: int = SEARCH_BEAM) -> np.ndarray:
    """Nodes found for each query, -1 where the beam is not full."""
    q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
    q = (q / np.maximum(np.sqrt((q**2).sum(axis=1, keepdims=True)), 1e-30)).astype(np.float32)
    last = len(graph.layers) - 1
    out = [
        graph.beam(last, q[i : i + BLOCK], graph.entries(q[i : i + BLOCK], last), width)[0] for i in range(0, len(q), BLOCK)
    ]
    return np.concatenate(out) if out else np.zeros((0, width), np.int32)


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0)


def nearest(
    vectors: DataFrame, queries: Column, k: int = NEIGHBOURS, id_column: str = "vec_id", vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score of the `k` nearest rows found for each row of `vectors` for which `queries` holds.

    Nearest first, ties to the smaller id; all other rows if there are fewer. Rows with a null id, and vectors that are
    null, empty or zero or hold a null or non-finite component, take no part. Vectors meet those of the same length only.
    Rows with equal ids are one row to each other: none is the other's neighbour. Other columns play no part.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector).cast("array<double>")
    rows = vectors.where(F.col(id_column).isNotNull() & _usable(v))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"), F.coalesce(queries, F.lit(False)).alias("asked"))
    # One row per length of vectors.
    plan = staged(
        rows.groupBy("dim").agg(
            F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"),
            F.greatest(F.ceil(F.count_if("asked") / QUERY_ROWS), F.lit(1)).alias("blocks"),
        )
    )
    dealt = rows.join(plan, "dim")

    def index(table: pa.Table) -> pa.Table:
        x, ids = _matrix(table.column("v")), table.column("id").to_numpy()
        order = np.lexsort((ids, *x.T))
        x, ids = x[order], ids[order]
        new = np.append(True, (x[1:] != x[:-1]).any(axis=1))
        starts = np.append(np.flatnonzero(new), len(x))
        graph = build(x[new])
        arrays = {f"nodes{i}": nodes for i, (nodes, _) in enumerate(graph.layers)}
        arrays |= {f"links{i}": links for i, (_, links) in enumerate(graph.layers)}
        blob = _packed(x=x[new], unit=graph.x, ids=ids, starts=starts, **arrays)
        return pa.table({"dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "graph": pa.array([blob], pa.binary())})

    sharded = dealt.select("dim", F.pmod(F.xxhash64("id"), "shards").alias("shard"), "id", "v")
    graphs = staged(sharded.groupBy("dim", "shard").applyInArrow(index, "dim int, shard long, graph binary"))

    def find(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asked.num_rows and held.num_rows:
            saved = np.load(io.BytesIO(held.column("graph")[0].as_py()))
            layers = [(saved[f"nodes{i}"], saved[f"links{i}"]) for i in range(sum(n.startswith("nodes") for n in saved.files))]
            x, ids, starts = saved["x"], saved["ids"], saved["starts"]
            q, own = _matrix(asked.column("v")), asked.column("id").to_numpy()
            nodes = search(Graph(saved["unit"], layers), q, max(SEARCH_BEAM, 2 * k))
            for row, key, found in zip(q, own, nodes):
                found = found[found >= 0]
                score = x[found] @ row
                # A copy's rows in order of id; one more than asked for, in case the query is among them.
                count = np.minimum(starts[found + 1] - starts[found], k + 1)
                at = np.repeat(starts[found], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                near, scores = ids[at], np.repeat(score, count)
                near, scores = near[near != key], scores[near != key]
                best = np.lexsort((near, -scores))[:k]
                out.append((np.full(len(best), key), near[best], scores[best]))
        columns = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0)] * 3
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(c, kind) for n, c, kind in zip(("query_id", "vec_id", "score"), columns, kinds)})

    asked = dealt.where("asked").select(
        "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"),
        F.pmod(F.xxhash64("id"), "blocks").alias("block"), "id", "v",
    )
    held = graphs.join(plan, "dim").select(
        "dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "graph"
    )
    keys = ("dim", "shard", "block")
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(find, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # Equal ids may bring the same neighbour several times.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumns({"rank": F.row_number().over(order)}).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    """The nearest rows of every row whose id is divisible by QUERY_STEP."""
    return nearest(embeddings, F.col("vec_id") % QUERY_STEP == 0)
