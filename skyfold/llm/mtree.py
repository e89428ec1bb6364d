"""Operator 2: exact top-k search by inner product with M-trees.

Components are turned into floor(1024 * x), so scores are whole numbers.  With
M the largest norm, a vector x gets one more component sqrt(M^2 - |x|^2) and a
query q gets 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner
products are the nearest vectors of a metric space.

The rows are dealt by a hash of their id into blocks of about ``BLOCK_ROWS``.
The M-tree of each block is built once and written: pages of routing objects
with covering radius and distance to the parent's routing object, down to leaf
pages.  Queries are broadcast in groups of at most ``QUERY_ROWS``; for each group the
trees are read, nothing is shuffled but the answers.  A query walks the trees
of a task one after the other, each best first by the least distance a page can
hold, and takes the best of the trees before along as its bound.  An entry
whose stored distance to the parent, with the query's own distance to it, shows
by the triangle inequality that it lies too far is passed over without computing
its distance.  The tasks' answers are merged.

Defined cases: a vector that is null, empty, or holds null or non-finite
components, and a row with a null id, take no part; of rows that repeat an id
the least vector counts; vectors of different lengths are never compared; equal
scores go by the smaller id; with fewer than k candidates all are returned; an
empty table gives no rows; other columns are ignored; vectors so long that a
score could leave 64 bits are an error.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfold.llm.common import Workspace

BLOCK_ROWS = 8192
#: Queries that are broadcast together: at most 16,384 x 64 x 8 bytes for 64 components.
QUERY_ROWS = 16_384
LEAF = 128
FANOUT = 16
#: Whole numbers up to this are exact in double precision.
EXACT = float(1 << 53)


class MTree:
    """M-tree over the rows of ``x`` (whole numbers), with ids for ties."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self._widen()
        self.leaf, self.fanout = leaf, fanout
        # Pages: routing object, covering radius, distance to the parent's
        # routing object, then either children or the rows with their distances.
        self.pages: list[dict] = []
        self.computed = 0
        self.root = self._build(np.arange(len(ids)), 0, None) if len(ids) else None

    def _widen(self) -> None:
        wide = self.x.astype(np.float64)
        self.exact = bool(len(wide)) and float(np.abs(wide).max(initial=0.0)) ** 2 * wide.shape[1] < EXACT / 4
        self.wide = wide
        norms = (wide * wide).sum(axis=1)
        if norms.max(initial=0.0) >= 2.0**62:
            raise OverflowError("an inner product of these vectors may leave 64 bits")
        self.top = float(norms.max(initial=0.0))
        self.lift = np.sqrt(np.maximum(self.top - norms, 0.0))

    def __getstate__(self) -> dict:
        """What is written: not what follows from the vectors."""
        return {k: v for k, v in self.__dict__.items() if k not in ("wide", "lift")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._widen()

    def _apart(self, row: int, rows: np.ndarray) -> np.ndarray:
        diff = self.wide[rows] - self.wide[row]
        return np.sqrt((diff * diff).sum(axis=1) + (self.lift[rows] - self.lift[row]) ** 2)

    def _build(self, rows: np.ndarray, router: int, parent: int | None) -> int:
        router = int(rows[0]) if parent is None else router
        to_router = self._apart(router, rows)
        page = {"router": router, "radius": float(to_router.max()), "to_parent": 0.0 if parent is None else float(self._apart(parent, np.array([router]))[0])}
        number = len(self.pages)
        self.pages.append(page)
        if len(rows) <= self.leaf:
            page["rows"], page["to_router"] = rows, to_router
            return number
        pivots = self._pivots(rows, to_router)
        apart = np.stack([self._apart(p, rows) for p in pivots])
        near = apart.argmin(axis=0)
        groups = [(p, rows[near == i]) for i, p in enumerate(pivots) if (near == i).any()]
        if len(groups) == 1:  # equal vectors: no pivot parts them
            parts = np.array_split(rows, -(-len(rows) // self.leaf))
            groups = [(int(g[0]), g) for g in parts]
        children = [self._build(g, int(p), router) for p, g in groups]
        page["children"] = np.array(children)
        page["child_router"] = np.array([self.pages[c]["router"] for c in children])
        page["child_radius"] = np.array([self.pages[c]["radius"] for c in children])
        page["child_to_router"] = np.array([self.pages[c]["to_parent"] for c in children])
        return number

    def _pivots(self, rows: np.ndarray, to_router: np.ndarray) -> list[int]:
        """Routing objects that lie far from one another, the farthest next."""
        out = [int(rows[to_router.argmax()])]
        least = self._apart(out[0], rows)
        while len(out) < self.fanout and least.max() > 0:
            out.append(int(rows[least.argmax()]))
            least = np.minimum(least, self._apart(out[-1], rows))
        return out

    def _scores(self, q: np.ndarray, wide: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products as whole numbers."""
        if self.exact and float(np.abs(wide).max(initial=0.0)) * float(np.abs(self.wide[rows]).max(initial=0.0)) * len(wide) < EXACT:
            return (self.wide[rows] @ wide).astype(np.int64)
        return (self.x[rows] * q).sum(axis=1)

    def search(self, q: np.ndarray, k: int, own: int | None, known: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
        """The k best (score, id) of these rows and the ``known`` ones, without the id
        ``own``; ties by smaller id.
        """
        if self.root is None:
            return sorted(known, key=lambda f: (-f[0], f[1]))
        wide = q.astype(np.float64)
        shift = float(wide @ wide) + self.top
        slack = 1e-9 * np.sqrt(shift) + 1e-6

        def far(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            self.computed += len(rows)
            scores = self._scores(q, wide, rows)
            return scores, np.sqrt(np.maximum(shift - 2.0 * scores, 0.0))

        best = [(s, -i) for s, i in known]  # (score, -id), the worst first
        heapq.heapify(best)
        reach = np.sqrt(max(shift - 2.0 * best[0][0], 0.0)) if len(best) == k else np.inf
        _, d = far(np.array([self.pages[self.root]["router"]]))
        queue = [(max(float(d[0]) - self.pages[self.root]["radius"], 0.0), self.root, float(d[0]))]
        while queue:
            least, number, d_router = heapq.heappop(queue)
            if least > reach + slack:
                break
            page = self.pages[number]
            if "rows" in page:
                rows = page["rows"][np.abs(d_router - page["to_router"]) <= reach + slack]
                if not len(rows):
                    continue
                scores, _ = far(rows)
                use = np.ones(len(rows), bool) if len(best) < k else scores >= best[0][0]
                for s, i in sorted(zip(scores[use].tolist(), (-self.ids[rows[use]]).tolist(), strict=True), reverse=True)[: k + 1]:
                    if own is not None and i == -own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, i))
                    elif (s, i) > best[0]:
                        heapq.heapreplace(best, (s, i))
                if len(best) == k:
                    reach = np.sqrt(max(shift - 2.0 * best[0][0], 0.0))
                continue
            may = np.abs(d_router - page["child_to_router"]) - page["child_radius"] <= reach + slack
            at = np.flatnonzero(may)
            if len(at):
                _, d = far(page["child_router"][at])
                low = np.maximum(d - page["child_radius"][at], 0.0)
                for c, l_, dc in zip(page["children"][at].tolist(), low.tolist(), d.tolist(), strict=True):
                    if l_ <= reach + slack:
                        heapq.heappush(queue, (l_, c, dc))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def whole_vectors(embeddings: DataFrame, key: str, vector: str, scale: float = 1024.0) -> DataFrame:
    """(vec_id, x): vectors that take part, as whole numbers; one row for each id."""
    v = F.transform(F.col("v"), lambda c: c.cast("double"))
    some = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    some = some.select("vec_id", v.alias("v")).filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return some.select("vec_id", F.transform("v", lambda c: F.floor(F.lit(scale) * c)).alias("x")).groupBy("vec_id").agg(F.min("x").alias("x"))


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by
    ``every`` the k largest scores of the other rows; see the module's text.
    """
    work = Workspace(embeddings.sparkSession, "m-tree")
    x = whole_vectors(embeddings, key, vector).withColumn("dim", F.size("x"))
    n = embeddings.count()
    blocks = max(1, -(-n // block_rows))
    dealt = x.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def plant(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        rows = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
        tree = MTree(table.column("vec_id").to_numpy(), rows)
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": table.column("block").slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    trees = work.save(dealt.groupBy("dim", "block").applyInArrow(plant, "dim int, block int, tree binary"), "trees")
    asked = x.filter(F.col("vec_id") % every == 0)
    # The queries have no order that matters: ids are dealt by a hash, and each group is read once.
    groups = max(1, -(-asked.count() // (query_rows // 2)))
    asked = work.save(asked.withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")), "queries")
    found = None
    for g in range(groups):
        answers = _answers(trees, asked.filter(F.col("group") == g), k)
        found = answers if found is None else found.unionByName(answers)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(trees: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): per task the best of its trees for each query of a group."""
    table = asked.select("vec_id", "dim", "x").toArrow()
    sent: dict[int, tuple[list[int], np.ndarray]] = {}
    for dim in set(table.column("dim").to_pylist()):
        part = table.filter(pa.array(table.column("dim").to_numpy() == dim))
        sent[dim] = part.column("vec_id").to_pylist(), part.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
    shared = trees.sparkSession.sparkContext.broadcast(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for dim, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if dim not in shared.value:
                    continue
                tree = pickle.loads(blob.as_buffer())
                for i, v in zip(*shared.value[dim], strict=True):
                    best[i] = tree.search(v, k, i, best.get(i, []))
        rows = [(i, j, s) for i, found in best.items() for s, j in found]
        i, j, s = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (i, j, s)], names=["query_id", "vec_id", "score"])

    return trees.select("dim", "tree").mapInArrow(run, "query_id long, vec_id long, score long")


ORACLE_SQL = """
WITH e AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(1024 AS DOUBLE) * CAST(c AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(CAST(c AS DOUBLE)))) = len(embedding)),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
