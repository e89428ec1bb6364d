"""Operator 4: text quality by nearest-neighbour voting in a latent space.

A text is a bag of token shapes (letter case, digits and punctuation, runs
collapsed) and of words, with terms for repetition.  Inverse document frequencies are counted
over every document.  A bounded sample of labelled rows (``MAX_LABELLED``)
gives a latent-semantic basis; the sample's unit vectors and labels (at most
``MAX_LABELLED`` x ``RANK`` numbers) are broadcast, each block of documents is
multiplied with all of them, and the nearest labelled vectors vote with their
cosines as weights.

Defined cases: a null or empty text holds one term of its own; a text that is
near no labelled vector gets the labelled share of label 1, and 0.5 if nothing
is labelled; labels that are null, or whose document is missing, are not used;
of several labels of one document the largest counts, of several texts of one
document that with the least hash; a null key is never held
out; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.llm.common import CHUNK_ROWS, kept_by_worker, lean

#: Slots of shapes and repetition, and of words, which follow them.
SHAPE_SLOTS = 4096
WORD_SLOTS = 4096
SLOTS = SHAPE_SLOTS + WORD_SLOTS
#: Weight of a word beside that of a shape.
WORD_WEIGHT = np.float32(0.5)
RANK = 32
NEIGHBOURS = 25
#: Labelled rows that are learnt from, at most.
MAX_LABELLED = 4096
CACHE_ENTRIES = 100_000
#: Tokens from which counting by slot is quicker than sorting.
LONG_TEXT = 200
#: Shares of tokens equal to the one before that count as a term each.
AGAIN = (0.05, 0.15, 0.4)
#: Rows whose cosines with all labelled vectors are held at a time.
SCORE_ROWS = 256


class _Classes(dict):
    """Letters to x or X, digits to 9; other characters stand for themselves."""

    def __missing__(self, code: int) -> str:
        kind = unicodedata.category(chr(code))
        out = {"Lu": "X", "Lt": "X", "Ll": "x", "Lm": "x", "Lo": "x", "Nd": "9", "Nl": "9", "No": "9"}.get(kind, chr(code))
        self[code] = out
        return out


_CLASSES = _Classes()
_RUN = re.compile(r"(.)\1+", re.S)
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "“”„‘’«»…–—¿¡"
#: Slots of tokens, two bytes each.
_SHAPES: dict[str, bytes] = kept_by_worker({})


def slot(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % SHAPE_SLOTS


def word_slot(token: str) -> int:
    """Slot of a token without the marks around it, whatever its case."""
    return SHAPE_SLOTS + zlib.crc32(token.strip(_MARKS).lower().encode("utf-8", "surrogatepass")) % WORD_SLOTS


def shapes(token: str) -> list[str]:
    """The token's character classes with runs collapsed, in pieces of at most 16 of them."""
    if token.islower() and token.isalpha():  # most tokens
        return ["x"]
    s = _RUN.sub(r"\1", token.translate(_CLASSES))
    return [s[i : i + 16] for i in range(0, len(s), 16)]


_PIECES: dict[str, bytes] = kept_by_worker({})


def slot_bytes(token: str) -> bytes:
    """Slots of a token's shape and of its word, two bytes each."""
    out = b""
    for piece in shapes(token):
        found = _PIECES.get(piece)
        if found is None:
            if len(_PIECES) > CACHE_ENTRIES:
                _PIECES.clear()
            found = _PIECES[piece] = slot(piece).to_bytes(2, "little")
        out += found
    return out + word_slot(token).to_bytes(2, "little")


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) of a text: damped relative frequencies of its shapes."""
    tokens = text.split()
    if not tokens:
        return np.array([slot("#empty")]), np.array([1.0], dtype=np.float32)
    kept, n = _SHAPES, len(tokens)
    for t in set(tokens).difference(kept):
        kept[t] = slot_bytes(t)
    out = np.frombuffer(b"".join(map(kept.__getitem__, tokens)), dtype="<u2")
    if n > LONG_TEXT:
        counts = np.bincount(out, minlength=SLOTS)
        slots = np.flatnonzero(counts)
        counts = counts[slots]
    else:
        slots, counts = np.unique(out.astype(np.int64), return_counts=True)
    many = len(out) - n  # shapes; each token has one word besides
    again = sum(map(str.__eq__, tokens, tokens[1:])) / n
    # Repetition has terms of its own, by degrees.
    extra = [slot(f"#again {least}") for least in AGAIN if again >= least]
    if extra:
        slots = np.append(slots, extra)
        counts = np.append(counts, [many * max(again, 0.25)] * len(extra))
    weights = np.log1p(100.0 * counts / many).astype(np.float32)
    weights[slots >= SHAPE_SLOTS] *= WORD_WEIGHT
    return slots, weights


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bags of texts in one array each: slots, weights, first entry of each text."""
    if len(_SHAPES) > CACHE_ENTRIES:
        _SHAPES.clear()
    found = [bag(t or "") for t in texts]
    sizes = np.array([len(s) for s, _ in found])
    return np.concatenate([s for s, _ in found]), np.concatenate([w for _, w in found]), np.cumsum(sizes) - sizes


@dataclass
class Model:
    idf: np.ndarray  # SLOTS
    basis: np.ndarray  # SLOTS x RANK
    vectors: np.ndarray  # labelled x RANK, unit length
    labels: np.ndarray
    prior: float
    neighbours: int

    def latent(self, slots: np.ndarray, weights: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        z = np.add.reduceat(self.basis[slots] * (weights * self.idf[slots])[:, None], firsts, dtype=np.float64)
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        # In double precision, so that a score does not hang on the rows beside it.
        cos = self.latent(*bags(texts)).astype(np.float64) @ self.vectors.T.astype(np.float64)
        k = min(self.neighbours, cos.shape[1])
        near = np.argpartition(cos, cos.shape[1] - k, axis=1)[:, -k:]
        w = np.clip(np.take_along_axis(cos, near, axis=1), 0, 1) ** 4
        total = w.sum(axis=1)
        vote = (w * self.labels[near]).sum(axis=1)
        # One neighbour's worth of the labelled share keeps weak votes near it.
        return np.clip((vote + 0.05 * self.prior) / (total + 0.05), 0.0, 1.0)


def held_out(key: str, folds: int, fold: int) -> F.Column:
    """Whether crc32 of the key as text leaves this remainder; false for null."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each slot), over every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean(_SHAPES, _PIECES)
        n, df = 0, np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK_ROWS):
                texts = batch.slice(lo, CHUNK_ROWS).column(0).to_pylist()
                df += np.bincount(bags(texts)[0], minlength=SLOTS)
                n += len(texts)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], n))], names=["slot", "n"])

    counts = docs.select(F.col(text).alias("text")).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(SLOTS), 0
    for row in counts:
        if row.slot < 0:
            n = row.n
        else:
            df[row.slot] = row.n
    return n, df


def labelled_rows(labels: DataFrame, key: str, label: str, keep: F.Column, most: int) -> DataFrame:
    """(k, y) of at most ``most`` labelled keys, chosen by a hash of the key."""
    return (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & keep)
        .groupBy(F.col(key).alias("k"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64(F.col("k").cast("string")), "k")
        .limit(most)
    )


def with_texts(docs: DataFrame, some: DataFrame, key: str, text: str) -> DataFrame:
    """(k, y, t): the bounded rows ``some`` (k, y) with their texts; of several
    texts of one key that with the least hash.
    """
    one = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(some), "k")
    return one.groupBy("k", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), F.col("t"))).alias("t")).select("k", "t", "y")


class SampleRows:
    """The sample's weighted bags as unit rows, made dense a few rows at a time."""

    def __init__(self, slots: list[np.ndarray], weights: list[np.ndarray], idf: np.ndarray) -> None:
        self.slots = [np.asarray(x, dtype=np.int32) for x in slots]
        self.weights = []
        for at, w in zip(self.slots, weights, strict=True):
            row = np.bincount(at, weights=np.asarray(w, np.float64) * idf[at])  # a slot may stand twice
            self.weights.append((np.asarray(w, np.float64) * idf[at] / max(float(np.linalg.norm(row)), 1e-12)).astype(np.float32))
        self.shape = len(self.slots), len(idf)

    def blocks(self) -> Iterator[np.ndarray]:
        for lo in range(0, self.shape[0], SCORE_ROWS):
            part = range(lo, min(lo + SCORE_ROWS, self.shape[0]))
            out = np.zeros((len(part), self.shape[1]), dtype=np.float32)
            for i, k in enumerate(part):
                np.add.at(out[i], self.slots[k], self.weights[k])
            yield out

    def times(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([b @ q for b in self.blocks()])

    def back(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[1], y.shape[1]), dtype=np.float32)
        for i, b in enumerate(self.blocks()):
            out += b.T @ y[i * SCORE_ROWS : i * SCORE_ROWS + len(b)]
        return out


def basis_of(rows: SampleRows, rank: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration with a fixed start."""
    rank = min(rank, *rows.shape)
    q = np.random.default_rng(7).standard_normal((rows.shape[1], min(rank + 8, *rows.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(rows.back(rows.times(q)))
    _, _, right = np.linalg.svd(rows.times(q), full_matrices=False)
    return (q @ right.T)[:, :rank].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, fold: int = 0, most: int = MAX_LABELLED, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    """Learn from labelled rows outside the held-out fold; see the module's text."""
    n, df = document_frequencies(docs, text)
    idf = np.log((1.0 + n) / (1.0 + df)).astype(np.float32) + np.float32(0.05)
    sample = with_texts(docs, labelled_rows(labels, key, label, ~held_out(key, folds, fold), most), key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([s for s, _ in found], pa.list_(pa.int64())), pa.array([w for _, w in found], pa.list_(pa.float32()))], names=["k", "y", "slots", "weights"])

    table = sample.select(F.xxhash64(F.col("k").cast("string")).alias("k"), "t", "y").mapInArrow(run, "k long, y int, slots array<long>, weights array<float>").toArrow()
    table = table.sort_by([("k", "ascending")]).combine_chunks()
    y = table.column("y").to_numpy().astype(np.float64)
    if not len(y):
        return Model(idf, np.zeros((SLOTS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5, neighbours)
    ends = np.cumsum(table.column("slots").combine_chunks().value_lengths().to_numpy())[:-1]
    parts = [np.split(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), ends) for c in ("slots", "weights")]
    sample_rows = SampleRows(*parts, idf)
    del table, parts
    model = Model(idf, basis_of(sample_rows, rank), np.zeros((0, 1), np.float32), y, float(y.mean()), neighbours)
    z = sample_rows.times(model.basis)
    model.vectors = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    return model


def score_column(docs: DataFrame, model: Model, text: str = "text") -> F.Column:
    """Score of each text as a Column, from the broadcast model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        parts = [shared.value.score(texts.slice(lo, SCORE_ROWS).to_pylist()) for lo in range(0, len(texts), SCORE_ROWS)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", cut: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    model = fit(docs, labels, key, text)
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = out.withColumn("score", score_column(out, model, "t"))
    return out.select(F.col("k").alias(key), held_out("k", 5, 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
