"""Operator 10: toxicity severity by cumulative-link ordinal regression.

The probability of at least grade k is ``sigmoid(w . x - theta_k)`` with one
weight vector for all ordered thresholds; the output is the expected grade.
``x`` is sparse: every word of a text and its beginnings of ``HEADS`` letters have a
slot each (of ``SLOTS``, by a hash), with the damped share of the text's words that
fall into it, so a longer text is not a graver one.

Grade 0 is a row labelled as not toxic.  Every row labelled toxic has a grade
from 1 to 3, by the thirds of how densely it is set with words that mark toxic
texts: the mean, over its words, of the log odds that a naive Bayes model gives
them.  That model is fitted on the other half of the sample only, so that no
row grades itself.  Weights and thresholds are learnt from a bounded sample of
labelled rows (``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean ones, which hold all
rows where there are fewer); slots that fewer than ``LEAST_ROWS`` of them hold
carry no weight.  Every row is scored whole.

Defined cases: a null or empty text has no words and gets the severity of an
empty bag; with no labelled toxic rows every severity is 0; labels that are null
or have no document are not used; of several labels of one document the largest
counts, of several texts of one document that with the least hash; repeated
rows get equal values; null keys stay null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.llm.common import CHUNK_ROWS, Workspace, kept_by_worker, lean
from skyfold.llm.quality import held_out, labelled_rows, with_texts

GRADES = 3
MAX_TOXIC = 4096
MAX_CLEAN = 8192
SLOTS = 1 << 18
#: Letters of a word's beginnings that have slots of their own.
HEADS = (5, 6, 7)
LEAST_ROWS = 5
PENALTY = 3e-3
#: Part of the weight of all rows that the toxic ones have in the fit.
TOXIC_SHARE = 0.4
#: Words that a text is taken to have at least: the share of one word in three says little.
LEAST_WORDS = 20
CACHE_ENTRIES = 150_000
_WORD = re.compile(r"[^\W\d_]+")


def slots_of(word: str) -> list[int]:
    """Slots of a word and its beginnings."""
    names = [word, *("^" + word[:n] for n in HEADS if len(word) > n)]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % SLOTS for n in names]


def bag(text: str) -> tuple[list[int], list[int], int]:
    """(slots, counts, words) of a text."""
    words = Counter(_WORD.findall(text.lower()))
    found: Counter = Counter()
    for w, n in words.items():
        for s in slots_of(w):
            found[s] += n
    return list(found), list(found.values()), words.total()


def damped(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.log1p(100.0 * counts / np.maximum(words, LEAST_WORDS))


_SEEN: dict[str, tuple[int, ...]] = kept_by_worker({})
_SEEN_FOR: list[bytes] = [b""]


@dataclass
class Model:
    weights: np.ndarray  # SLOTS; 0 for slots that are not learnt
    thresholds: np.ndarray  # rising

    def __post_init__(self) -> None:
        self.mark = hashlib.blake2b(self.weights.tobytes(), digest_size=16).digest()

    def eta(self, texts: list[str | None]) -> np.ndarray:
        if _SEEN_FOR[0] != self.mark or len(_SEEN) > CACHE_ENTRIES:  # words of another model
            _SEEN.clear()
            _SEEN_FOR[0] = self.mark
        kept, weights, out = _SEEN, self.weights, np.zeros(len(texts))
        for i, t in enumerate(texts):
            words = Counter(_WORD.findall((t or "").lower()))
            at: list[int] = []
            times: list[int] = []
            for w, n in words.items():
                got = kept.get(w)
                if got is None:  # only slots that carry weight
                    got = kept[w] = tuple(s for s in slots_of(w) if weights[s])
                if got:
                    at += got
                    times += [n] * len(got)
            if at:
                used, place = np.unique(np.array(at), return_inverse=True)
                out[i] = weights[used] @ damped(np.bincount(place, weights=times), np.array(words.total()))
        return out

    def severity(self, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, probability of at least grade 1)."""
        if not self.weights.any():
            return np.zeros(len(eta)), np.zeros(len(eta))
        p = sigmoid(eta[:, None] - self.thresholds[None, :])
        return p.sum(axis=1), p[:, 0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


#: Entries of a sparse matrix that are multiplied at a time.
ENTRIES = 1 << 19


@dataclass
class Sparse:
    """A matrix by its entries, ordered by row."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    def _sum(self, by: np.ndarray, other: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        for lo in range(0, len(by), ENTRIES):
            part = slice(lo, lo + ENTRIES)
            out += np.bincount(by[part], weights=self.values[part] * x[other[part]], minlength=n)
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self._sum(self.rows, self.columns, w, self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return self._sum(self.columns, self.rows, g, self.shape[1])


def train(x: Sparse, y: np.ndarray, grades: int = GRADES, penalty: float = PENALTY, steps: int = 200, share: float = TOXIC_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds that maximise the likelihood (Adam, full batch);
    toxic rows have ``share`` of the weight of all.
    """
    n = x.shape[1]
    w = np.zeros(n)
    b = np.array([1.0, *([0.0] * (grades - 1))])  # first threshold, then logs of the gaps
    weight = np.where(y > 0, share / max(1, (y > 0).sum()), (1.0 - share) / max(1, (y == 0).sum()))
    m, v = np.zeros(n + grades), np.zeros(n + grades)
    rows = np.arange(len(y))
    for t in range(1, steps + 1):
        theta = b[0] + np.append(0.0, np.cumsum(np.exp(b[1:])))
        eta = x.dot(w)
        up = sigmoid(eta[:, None] - np.append(-np.inf, theta)[None, :])  # P(y >= k), k = 0..
        up[:, 0] = 1.0
        down = np.append(up[:, 1:], np.zeros((len(y), 1)), axis=1)
        p = np.maximum(up[rows, y] - down[rows, y], 1e-12)
        g_up, g_down = up[rows, y] * (1 - up[rows, y]) / p, down[rows, y] * (1 - down[rows, y]) / p
        g_theta = np.zeros(grades)
        np.add.at(g_theta, y[y > 0] - 1, (g_up * weight)[y > 0])
        np.add.at(g_theta, y[y < grades], -(g_down * weight)[y < grades])
        g_b = np.append(g_theta.sum(), [np.exp(b[k]) * g_theta[k:].sum() for k in range(1, grades)])
        g = np.append(x.back(-(g_up - g_down) * weight) + penalty * w, g_b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:n], b - step[n:]
    return w, b[0] + np.append(0.0, np.cumsum(np.exp(b[1:])))


def grades_of(rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, words: np.ndarray, toxic: np.ndarray, half: np.ndarray, n_columns: int) -> np.ndarray:
    """0 for other rows, 1 to ``GRADES`` for toxic ones by their density of marking words."""
    density = np.zeros(len(toxic))
    for h in (False, True):
        other, here = half != h, half == h
        odds = []
        for group in (toxic & other, ~toxic & other):
            held = Sparse(rows, columns, np.ones(1, np.float32).repeat(len(rows)), (len(toxic), n_columns)).back(group.astype(np.float64))
            odds.append(np.log((held + 0.5) / (group.sum() + 1.0)))
        mark = np.maximum(odds[0] - odds[1], 0.0)
        total = Sparse(rows, columns, counts, (len(toxic), n_columns)).dot(mark)
        density[here] = (total / np.maximum(words, LEAST_WORDS))[here]
    cuts = np.quantile(density[toxic], np.arange(1, GRADES) / GRADES)
    return np.where(toxic, 1 + (density[:, None] > cuts[None, :]).sum(axis=1), 0)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", keep: F.Column | None = None) -> Model:
    """The ordinal model of a bounded labelled sample; ``keep`` tells which labels may be learnt from."""
    nothing = Model(np.zeros(SLOTS), np.arange(1.0, GRADES + 1))
    use = F.lit(True) if keep is None else keep
    # The largest label of each document, then the sample of both kinds: one scan of the texts.
    worst = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & use).groupBy(key).agg(F.max(label).alias(label))
    some = None
    for y, n in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        part = labelled_rows(worst.filter(F.col(label) == y), key, label, F.lit(True), n)
        some = part if some is None else some.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(lo, CHUNK_ROWS)
                found = [bag(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([f[2] for f in found], pa.int64()), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int32()))], names=["k", "y", "words", "slots", "counts"])

    work = Workspace(docs.sparkSession, "toxicity")
    texts = with_texts(docs, some, key, text).select(F.xxhash64(F.col("k").cast("string")).alias("k"), "t", "y")
    sample = work.save(texts.mapInArrow(run, "k long, y int, words long, slots array<int>, counts array<int>"), "sample")
    seen = sample.select(F.explode("slots").alias("s")).groupBy("s").count().filter(F.col("count") >= LEAST_ROWS).select("s").toArrow()
    live = np.zeros(SLOTS, dtype=bool)
    live[seen.column("s").to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(live)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, counts = (c.flatten() for c in (batch.column(3), batch.column(4)))
            use = shared.value[slots.to_numpy()]
            owner = np.repeat(np.arange(batch.num_rows), batch.column(3).value_lengths().to_numpy())[use]
            ends = np.append(0, np.cumsum(np.bincount(owner, minlength=batch.num_rows))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), c.filter(pa.array(use))) for c in (slots, counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], names=["k", "y", "words", "slots", "counts"])

    table = sample.mapInArrow(kept, "k long, y int, words long, slots array<int>, counts array<int>").toArrow()
    work.drop("sample")
    table = table.sort_by([("k", "ascending")]).combine_chunks()
    toxic = table.column("y").to_numpy() == 1
    if not toxic.any() or not live.any():
        return nothing
    words = table.column("words").to_numpy()
    half = (table.column("k").to_numpy() & 1).astype(bool)
    lists = table.column("slots").combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    used = np.flatnonzero(live)
    place = np.zeros(SLOTS, dtype=np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    columns = place[lists.flatten().to_numpy()]
    counts = table.column("counts").combine_chunks().flatten().to_numpy().astype(np.float32)
    del table, lists
    y = grades_of(rows, columns, counts, words, toxic, half, len(used))
    w, theta = train(Sparse(rows, columns, damped(counts, words[rows]).astype(np.float32), (len(sizes), len(used))), y)
    weights = np.zeros(SLOTS)
    weights[used] = w
    return Model(weights, theta)


def severity_column(docs: DataFrame, model: Model, text: str = "text") -> F.Column:
    """struct(severity, toxic_probability) of each text, from the broadcast model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("toxic_probability", T.DoubleType())])

    @F.arrow_udf(kind)
    def grade(texts: pa.Array) -> pa.Array:
        model, parts = shared.value, [np.zeros(0)]
        for lo in range(0, len(texts), CHUNK_ROWS):
            parts.append(model.eta(texts.slice(lo, CHUNK_ROWS).to_pylist()))
        mean, p = model.severity(np.concatenate(parts))
        return pa.StructArray.from_arrays([pa.array(mean, pa.float64()), pa.array(p, pa.float64())], names=["severity", "toxic_probability"])

    return grade(F.col(text))


def grade(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", cut: float = 0.5, folds: int | None = None) -> DataFrame:
    """(key, severity, toxic_probability, toxic): toxic where the probability of grade 1 or more reaches ``cut``.

    With ``folds`` the rows whose key's crc32 leaves 0 by it are not learnt from.
    """
    model = fit(docs, labels, key, text, keep=None if folds is None else ~held_out(key, folds, 0))
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = out.withColumn("g", severity_column(out, model, "t"))
    return out.select(F.col("k").alias(key), "g.severity", "g.toxic_probability", (F.col("g.toxic_probability") >= cut).cast("int").alias("toxic"))
