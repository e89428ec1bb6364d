"""Operator 8: approximate nearest neighbours by NN-descent and graph search.

Nearness is the inner product.  Equal vectors are one node, which keeps its
``k`` + 1 smallest ids (more can never be needed).  Nodes are dealt by a hash
into shards of about ``SHARD_ROWS``, each with a neighbour graph of its own, so
a task's memory never follows the input.

The graph starts from random neighbours.  One iteration joins, in Spark, each
block of nodes with the rows of its neighbours, forward and reversed, which bring
the neighbours' neighbours, and with the vectors of its shard, so that every
neighbour's neighbour is scored; the best ``NEIGHBOURS`` are kept.  A node takes at
most ``REVERSED`` reversed neighbours in an iteration, chosen by a hash that changes
with it.  Every iteration's graph is written to the shared folder.  At the end each
shard is packed once: vectors, links, ids.

Queries are broadcast in groups of at most ``QUERY_ROWS``; for each group the packed
shards are read and nothing but answers is shuffled.  A query walks the graph of
every shard greedily with a list of ``BEAM`` nodes, starting from fixed entry nodes
and from its own node if it is indexed; the shards' answers are merged.  Scores
are double-precision inner products of the original vectors.  The search is
approximate by nature: ``BEAM``, ``REVERSED`` and ``ITERATIONS`` trade recall for work,
and the recall is measured against brute force.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite
components, and a row with a null id, take no part; of rows that repeat an id
the least vector counts; vectors of different lengths are never compared; ties
go by smaller id; with fewer than k candidates all found are returned; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfold.llm.common import Workspace, pack, unpack

SHARD_ROWS = 12_288
BLOCK_ROWS = 4096
#: Queries that are broadcast together, half of it on average.
QUERY_ROWS = 16_384
NEIGHBOURS = 16
REVERSED = 16
ITERATIONS = 6
BEAM = 320
#: Nodes that a search expands at a time, and where searches begin.
EXPAND = 32
ENTRIES = 32
SALTS = 64


def nodes(embeddings: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(node, ids, vec): distinct vectors as bytes, with their smallest ids."""
    v = F.transform(F.col("v"), lambda c: c.cast("double"))
    some = embeddings.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null and size(v) > 0")
    some = some.select("id", v.alias("v")).filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    # -0.0 equals 0.0: adding 0.0 gives both the same bytes.
    some = some.groupBy("id").agg(F.min(F.transform("v", lambda c: c + F.lit(0.0))).alias("v"))
    # A vector that many rows share is cut down in salted groups first.
    w = Window.partitionBy("v", "salt").orderBy("id")
    few = some.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "v")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, first value of each row and the end) of a list column."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))


def _padded(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Rows of a ragged array, padded with -1."""
    sizes = np.diff(edges)
    out = np.full((len(sizes), max(1, int(sizes.max(initial=0)))), -1, dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - edges[row]] = values
    return out


def _places(sorted_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place of each id among sorted ones, -1 if it is not there."""
    if not len(sorted_ids):
        return np.full(ids.shape, -1)
    at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
    return np.where(sorted_ids[at] == ids, at, -1)


def _best(x: np.ndarray, own: np.ndarray, own_place: np.ndarray, candidates: np.ndarray, k: int) -> np.ndarray:
    """The k candidates (places in ``x``, -1 for none) nearest to each own vector."""
    c = np.sort(candidates, axis=1)
    bad = (c < 0) | (c == own_place[:, None])
    bad[:, 1:] |= c[:, 1:] == c[:, :-1]
    scores = np.einsum("nmd,nd->nm", x[np.maximum(c, 0)], own)
    scores[bad] = -np.inf
    if c.shape[1] > k:
        near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        c, scores = np.take_along_axis(c, near, axis=1), np.take_along_axis(scores, near, axis=1)
    order = np.argsort(-scores, axis=1, kind="stable")
    c, scores = np.take_along_axis(c, order, axis=1), np.take_along_axis(scores, order, axis=1)
    return np.where(np.isfinite(scores), c, -1)


def _start(k: int):
    """Random neighbours within a shard."""

    def run(table: pa.Table) -> pa.Table:
        ids = np.sort(table.column("node").to_numpy())
        table = table.take(pa.array(np.argsort(table.column("node").to_numpy(), kind="stable")))
        n = len(ids)
        rng = np.random.default_rng(n)
        picks = rng.integers(0, n, (n, min(k, n)))
        lists = [ids[np.unique(p[p != i])] for i, p in enumerate(picks)]
        return table.append_column("near", pa.array(lists, pa.list_(pa.int64())))

    return run


def _improve(k: int):
    """One iteration for a block: its nodes (left), the rows of their neighbours (right)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(["shard", "dim", "node", "ids", "v", "near"])
        dim = left.column("dim")[0].as_py()
        own_ids = left.column("node").to_numpy()
        ids = np.append(right.column("u").to_numpy(), own_ids)
        ids, first = np.unique(ids, return_index=True)
        vectors = np.concatenate([_matrix(right.column("vec"), dim), _matrix(left.column("v"), dim)]).astype(np.float32)
        x = vectors[first]
        near = _padded(*_lists(right.column("next"))) if right.num_rows else np.zeros((0, 1), np.int64)
        table = np.full((len(ids), near.shape[1]), -1, dtype=np.int64)
        table[_places(ids, right.column("u").to_numpy())] = _places(ids, near)
        both = _places(ids, _padded(*_lists(left.column("around"))))
        place = _places(ids, own_ids)
        out = []
        for lo in range(0, len(own_ids), 256):
            b = both[lo : lo + 256]
            c = np.where((b >= 0)[:, :, None], table[np.maximum(b, 0)], -1).reshape(len(b), -1)
            c = np.concatenate([b, c], axis=1)
            out += [ids[row[row >= 0]] for row in _best(x, x[place[lo : lo + 256]], place[lo : lo + 256], c, k)]
        left = left.select(["shard", "dim", "node", "ids", "v"])
        return left.append_column("near", pa.array(out, pa.list_(pa.int64())))

    return run


GRAPH = "shard int, dim int, node long, ids array<long>, v array<double>, near array<long>"


def _around(graph: DataFrame, reversed_: int, iteration: int) -> DataFrame:
    """(shard, dim, node, around): neighbours, forward and a bounded draw of reversed ones."""
    edges = graph.select("shard", "dim", "node", F.explode("near").alias("u"))
    w = Window.partitionBy("shard", "dim", "u").orderBy(F.xxhash64("node", F.lit(iteration)), "node")
    back = edges.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= reversed_)
    both = edges.unionByName(back.select("shard", "dim", F.col("u").alias("node"), F.col("node").alias("u")))
    return both.groupBy("shard", "dim", "node").agg(F.collect_set("u").alias("around"))


def build(points: DataFrame, n: int, k: int = NEIGHBOURS, reversed_: int = REVERSED, iterations: int = ITERATIONS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(shard, dim, payload): the packed graph of every shard over the rows of :func:`nodes`."""
    work = Workspace(points.sparkSession, "nn-descent")
    shards = max(1, -(-n // shard_rows))
    blocks = max(1, -(-min(n, shard_rows) // block_rows))
    dealt = points.select(F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), "node", "ids", "v")
    graph = work.save(dealt.groupBy("shard", "dim").applyInArrow(_start(k), GRAPH), "graph-0")
    for i in range(iterations):
        around = work.save(_around(graph, reversed_, i).withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(blocks)).cast("int")), f"around-{i}")
        need = around.select("shard", "dim", "block", F.explode("around").alias("u")).distinct()
        rows = graph.select(F.col("shard").alias("shard"), F.col("dim").alias("dim"), F.col("node").alias("u"), F.col("v").alias("vec"), F.col("near").alias("next"))
        # Each block gets all vectors of its shard, and the links of its nodes' neighbours.
        every = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        links = every.join(need.withColumn("asked", F.lit(True)), ["shard", "dim", "block", "u"], "left")
        fetched = links.withColumn("next", F.when(F.col("asked"), F.col("next")).otherwise(F.array().cast("array<long>"))).drop("asked")
        fetched = fetched.select(*(F.col(c).alias(c) for c in ("shard", "dim", "block", "u", "vec", "next")))
        own = graph.join(around, ["shard", "dim", "node"], "left").withColumn("around", F.coalesce("around", F.array().cast("array<long>"))).withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(blocks)).cast("int"))
        by = ("shard", "dim", "block")
        graph = work.save(own.groupBy(*by).cogroup(fetched.groupBy(*by)).applyInArrow(_improve(k), GRAPH), f"graph-{i + 1}")
        work.drop(f"graph-{i}")
        work.drop(f"around-{i}")
    final = graph.join(_around(graph, reversed_, iterations), ["shard", "dim", "node"], "left")
    final = final.withColumn("around", F.coalesce("around", F.array().cast("array<long>")))
    index = work.save(final.groupBy("shard", "dim").applyInArrow(_packed, "shard int, dim int, payload binary"), "index")
    work.drop(f"graph-{iterations}")
    return index


def _packed(table: pa.Table) -> pa.Table:
    """A shard as one row: nodes in order, vectors, places of the neighbours, ids of each node."""
    table = table.take(pa.array(np.argsort(table.column("node").to_numpy(), kind="stable")))
    dim = table.column("dim")[0].as_py()
    ids = table.column("node").to_numpy().astype("<i8")
    around = _places(ids, _padded(*_lists(table.column("around")))).astype("<i4")
    rows, edges = _lists(table.column("ids"))
    blob = pack(np.array([dim, around.shape[1]], "<i8"), ids, _matrix(table.column("v"), dim).astype("<f8").ravel(), around.ravel(), rows.astype("<i8"), edges.astype("<i8"))
    return pa.table({"shard": table.column("shard").slice(0, 1), "dim": table.column("dim").slice(0, 1), "payload": pa.array([blob], pa.binary())})


def greedy(x: np.ndarray, around: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the nodes that a best-first walk keeps, best first."""
    seen[:] = False
    ids = np.unique(start)
    seen[ids] = True
    scores, open_ = x[ids] @ q, np.ones(len(ids), dtype=bool)
    while True:
        order = np.argsort(-scores, kind="stable")[:beam]
        ids, scores, open_ = ids[order], scores[order], open_[order]
        at = np.flatnonzero(open_)[:EXPAND]
        if not len(at):
            return ids, scores
        open_[at] = False
        new = around[ids[at]].ravel()
        new = np.unique(new[new >= 0])
        new = new[~seen[new]]
        seen[new] = True
        ids, scores, open_ = np.append(ids, new), np.append(scores, x[new] @ q), np.append(open_, np.ones(len(new), dtype=bool))


def search(index: DataFrame, asked: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """(query_id, vec_id, score): answers of every task's shards to a bounded group of queries (query_id, v, dim)."""
    table = asked.select("query_id", "dim", "v").toArrow()
    sent: dict[int, tuple[list[int], np.ndarray]] = {}
    for dim in set(table.column("dim").to_pylist()):
        part = table.filter(pa.array(table.column("dim").to_numpy() == dim))
        sent[dim] = part.column("query_id").to_pylist(), _matrix(part.column("v"), dim)
    shared = index.sparkSession.sparkContext.broadcast(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                head, ids, x, around, rows, edges = unpack(blob.as_buffer(), "<i8", "<i8", "<f8", "<i4", "<i8", "<i8")
                dim, width = head.tolist()
                if dim not in shared.value:
                    continue
                x, around = x.reshape(-1, dim), around.reshape(-1, width)
                entries = np.linspace(0, len(ids) - 1, min(ENTRIES, len(ids))).astype(np.int64)
                where = {v.tobytes(): i for i, v in enumerate(x)}
                seen = np.zeros(len(ids), dtype=bool)
                out: list[tuple[int, int, float]] = []
                for i, v in zip(*shared.value[dim], strict=True):
                    own = where.get((v + 0.0).tobytes())
                    places, scores = greedy(x, around, v, entries if own is None else np.append(entries, own), max(beam, k + 1), seen)
                    order = np.lexsort((ids[places], -scores))[: k + 1]
                    found = [(j, s) for p, s in zip(places[order].tolist(), scores[order].tolist(), strict=True) for j in rows[edges[p] : edges[p + 1]].tolist() if j != i]
                    found.sort(key=lambda f: (-f[1], f[0]))
                    out += [(i, j, s) for j, s in found[:k]]
                i, j, s = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    return index.select("payload").mapInArrow(run, "query_id long, vec_id long, score double")


def neighbours(embeddings: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", beam: int = BEAM, query_rows: int = QUERY_ROWS, **settings) -> DataFrame:
    """Index every row, then search for the rows whose id is divisible by ``every``."""
    work = Workspace(embeddings.sparkSession, "neighbours")
    points = work.save(nodes(embeddings, key, vector, k), "nodes")
    index = build(points, points.count(), **settings)
    work.drop("nodes")
    v = F.transform(F.col("v"), lambda c: c.cast("double"))
    asked = embeddings.select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("v")).filter(F.col("query_id") % every == 0).filter("v is not null and size(v) > 0")
    asked = asked.select("query_id", v.alias("v")).filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)).groupBy("query_id").agg(F.min(F.transform("v", lambda c: c + F.lit(0.0))).alias("v"))
    asked = work.save(asked.withColumn("dim", F.size("v")), "queries")
    groups = max(1, -(-asked.count() // (query_rows // 2)))
    found = None
    for g in range(groups):
        answers = search(index, asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g), k, beam)
        found = answers if found is None else found.unionByName(answers)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
