"""Operator 7: document likelihood from a subword lattice.

A text is its words (A-Z lower-cased), each with one blank before it, and an
end.  It is a sequence of pieces of an existing vocabulary, drawn one by one: the
probability of a text is the sum over all its segmentations of the product of
the pieces' weights, times the end's weight.  Pieces hold a blank only at their
start, so the sum over the text is the product of the sums over its words; each
of these comes from a forward recursion in log space over the lattice of the
pieces that match (any byte can stand alone, so every word has a path).  Every
word of every text, seen in training or not, is scored by its lattice alone.

The weights begin as the vocabulary's own scores.  ``STEPS`` expectation steps over
all words of the training texts, each counted as often as it occurs and spread
over all its segmentations, calibrate them; the own scores stay in as a prior
with a share of ``KEEP_SCORES``.  The weights of all pieces and the end sum to one.

Words are counted by fragments of a hash, so no task holds the vocabulary of the
corpus.  Words that hold more than one in ``MOST_FREQUENT`` of all tokens are few
(at most ``MOST_FREQUENT``): their values are broadcast and summed where the text is
read.  All other words of a text are looked up in their fragments, where no word
can have many entries, and only sums per text come back.  The end is a constant
of each text.

Defined cases: a null or empty text is the end alone; a null key is never held
out; repeated rows are scored alike, each on its own; with no training texts the
vocabulary's scores decide alone, the end has the weight of one in four, and the
base is log10 of 1 / 1 for each token; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import Workspace, column_blobs, lean, pack, unpack
from skyfold.llm.quality import held_out

#: Tokens that a fragment is meant to hold.
FRAGMENT_TOKENS = 8_000_000
LEAST_FRAGMENTS = 6
#: Characters of text that are scored together, and texts at most.
BATCH_CHARS = 4 << 20
BATCH_ROWS = 8000
#: Distinct words that a task counts before it puts them out.
COUNTED_WORDS = 200_000
#: Words whose values are broadcast, at most; a longer one goes by a digest.
MOST_FREQUENT = 100_000
LONG_WORD = 64
#: Share of the vocabulary's own scores in the weights, and expectation steps.
KEEP_SCORES = 0.05
STEPS = 3
WORD_GROUP = 100_000
LOG10 = math.log(10.0)
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# -------------------------------------------------------------------- vocabulary
@dataclass
class Pieces:
    """Pieces as byte strings, found by hash; log weights that sum to 1 less the end's."""

    keys: np.ndarray  # rising hashes
    log_p: np.ndarray
    log_end: float
    prefixes: np.ndarray  # hashes of what a piece can begin with
    longest: int

    def __post_init__(self) -> None:
        self.near, self.begun = (np.zeros(1 << 20, dtype=bool) for _ in range(2))
        self.near[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.begun[(self.prefixes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, pieces) of the hashes that belong to a piece."""
        rows = np.flatnonzero(self.near[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[rows]), len(self.keys) - 1)
        good = self.keys[at] == hashes[rows]
        return rows[good], at[good]

    def go_on(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of which some longer piece may begin with the bytes hashed (none is missed)."""
        return np.flatnonzero(self.begun[(hashes >> np.uint64(44)).astype(np.int64)])


_B = np.uint64(0x9FB21C651E98DF25)


def _step(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    h = (h ^ (byte.astype(np.uint64) + np.uint64(1))) * _B
    return h ^ (h >> np.uint64(29))


def piece_hash(piece: bytes) -> int:
    h = np.zeros(1, dtype=np.uint64)
    for c in piece:
        h = _step(h, np.array([c]))
    return int(h[0])


def load_pieces(path: str | None) -> Pieces:
    """Pieces of a sentencepiece file with their own scores as weights.

    A unigram file's scores are log probabilities; a BPE file's scores are the
    negated ranks of its merges, which are read as Zipf weights.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {}
    low = min(model.get_score(i) for i in range(model.get_piece_size()))
    ranked = low < -200.0
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode("utf-8")
        if b" " in piece[1:]:
            continue  # a word holds no blank: no lattice has such an arc
        s = model.get_score(i)
        scores[piece] = max(scores.get(piece, 0.0), 1.0 / (1.0 - s) if ranked else math.exp(s))
    total = sum(scores.values())
    p = {k: 0.99 * v / total for k, v in scores.items()}
    for b in range(256):  # any byte can stand alone
        p[bytes([b])] = p.get(bytes([b]), 0.0) + 0.01 / 256
    # All prefixes' hashes, one byte at a time.
    heads = sorted({k[:n] for k in p for n in range(1, len(k) + 1)}, key=len)
    hashed: dict[bytes, int] = {}
    for n in range(1, len(heads[-1]) + 1):
        level = [h for h in heads if len(h) == n]
        before = np.array([hashed.get(h[:-1], 0) for h in level], dtype=np.uint64)
        hashed |= dict(zip(level, _step(before, np.array([h[-1] for h in level])).tolist(), strict=True))
    keys = np.array([hashed[k] for k in p], dtype=np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    if (keys[1:] == keys[:-1]).any():
        raise ValueError("two pieces share a hash")
    begun = np.array(sorted({hashed[k[:n]] for k in p for n in range(1, len(k))}), dtype=np.uint64)
    end = 0.25
    return Pieces(keys, np.log(np.array(list(p.values()))[order] * (1 - end)), math.log(end), begun, len(heads[-1]))


def spell(words: list[bytes], pieces: Pieces, expect: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
    """Natural log of each word's sum over all segmentations (with the blank before it).

    ``expect``, if given, gets each piece's expected number added, a word counting
    ``times`` often.
    """
    out = np.zeros(len(words))
    lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    lo = 0
    while lo < len(order):
        n = int(lengths[order[lo]])
        hi = lo + min(max(1, WORD_GROUP * 12 // n), int(np.searchsorted(lengths[order], n, "right")) - lo)
        at = order[lo:hi]
        lo = hi
        text = np.frombuffer(b" " + b" ".join(words[i] for i in at), dtype=np.uint8).reshape(len(at), n)
        alpha = np.full((n + 1, len(at)), -np.inf)
        alpha[0] = 0.0
        arcs = []
        for i in range(n):
            rows, h = np.arange(len(at)), np.zeros(len(at), dtype=np.uint64)
            for size in range(1, min(pieces.longest, n - i) + 1):
                h = _step(h, text[rows, i + size - 1])
                found, piece = pieces.find(h)
                if len(found):
                    here = rows[found]
                    end = alpha[i + size]
                    end[here] = np.logaddexp(end[here], alpha[i][here] + pieces.log_p[piece])
                    if expect is not None:
                        arcs.append((i, size, here, piece))
                more = pieces.go_on(h)
                if not len(more):
                    break
                rows, h = rows[more], h[more]
        out[at] = alpha[n]
        if expect is not None:
            beta = np.full((n + 1, len(at)), -np.inf)
            beta[n] = 0.0
            weight = np.zeros(len(at)) if times is None else np.log(times[at])
            for i, size, rows, piece in reversed(arcs):
                beta[i][rows] = np.logaddexp(beta[i][rows], pieces.log_p[piece] + beta[i + size][rows])
            for i, size, rows, piece in arcs:
                w = np.exp(alpha[i][rows] + pieces.log_p[piece] + beta[i + size][rows] - alpha[n][rows] + weight[rows])
                np.add.at(expect, piece, w)
    return out


def reweigh(pieces: Pieces, first: Pieces, expect: np.ndarray, texts: float) -> Pieces:
    """Weights from expected numbers, with a share of the first ones kept."""
    total = float(expect.sum())
    if not total or not texts:
        return pieces
    end = texts / (texts + total)
    own = np.exp(first.log_p) / np.exp(first.log_p).sum()
    p = (1 - KEEP_SCORES) * expect / total + KEEP_SCORES * own
    return Pieces(pieces.keys, np.log(p * (1 - end)), math.log(end), pieces.prefixes, pieces.longest)


# ------------------------------------------------------------------- the counts
def _words(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _fragment(words: list[bytes], fragments: int) -> np.ndarray:
    return np.array([zlib.crc32(w) for w in words], dtype=np.int64) % fragments


def _by_fragment(words: list[bytes], fragments: int) -> Iterator[tuple[int, np.ndarray]]:
    """(fragment, places of its words)."""
    frag = _fragment(words, fragments)
    order = np.argsort(frag, kind="stable")
    edges = np.searchsorted(frag[order], np.arange(fragments + 1))
    for f in np.flatnonzero(np.diff(edges)).tolist():
        yield f, order[edges[f] : edges[f + 1]]


def _joined(words: list[bytes], at: np.ndarray) -> np.ndarray:
    return np.frombuffer(b" ".join([words[i] for i in at.tolist()]), dtype=np.uint8)


def _counted(docs: DataFrame, fragments: int) -> DataFrame:
    """(frag, payload): words of a task with their numbers in its training texts; ``docs``: text, train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        coder = zstandard.ZstdCompressor(level=1)
        known: Counter = Counter()
        other: set[bytes] = set()

        def put_out() -> pa.RecordBatch:
            words = [*known, *(other - known.keys())]
            counts = np.zeros(len(words), dtype="<i8")
            counts[: len(known)] = list(known.values())
            rows = [(f, coder.compress(pack(counts[at], _joined(words, at)))) for f, at in _by_fragment(words, fragments)]
            known.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["frag", "payload"])

        for batch in batches:
            for text, train in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = _words(text.as_py() or "")
                if train:
                    known.update(words)
                else:
                    other.update(words)
                if len(known) + len(other) > COUNTED_WORDS:
                    yield put_out()
        yield put_out()

    return docs.mapInArrow(run, "frag int, payload binary")


def _open_words(blob) -> tuple[list[bytes], np.ndarray]:
    counts, text = unpack(zstandard.ZstdDecompressor().decompress(blob), "<i8", "u1")
    return (text.tobytes().split(b" ") if len(counts) else []), counts


def _merge_counts(table: pa.Table) -> pa.Table:
    """A fragment's words with their numbers in all training texts."""
    lean()
    total: Counter = Counter()
    for blob in column_blobs(table, "payload"):
        words, counts = _open_words(blob)
        total.update(dict(zip(words, counts.tolist(), strict=True)))
    counts = np.array(list(total.values()), dtype="<i8")
    blob = zstandard.ZstdCompressor(level=1).compress(pack(counts, np.frombuffer(b" ".join(total), dtype=np.uint8)))
    return pa.table({"frag": pa.array([table.column("frag")[0].as_py()], pa.int32()), "payload": pa.array([blob], pa.binary()), "tokens": pa.array([int(counts.sum())]), "distinct": pa.array([int((counts > 0).sum())])})


def _expectations(words: DataFrame, pieces) -> np.ndarray:
    """Expected numbers of the pieces over all words of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces.value
        expect = np.zeros(len(vocabulary.keys))
        for batch in batches:
            for blob in column_blobs(pa.Table.from_batches([batch]), "payload"):
                names, counts = _open_words(blob)
                spell([w for w, c in zip(names, counts.tolist(), strict=True) if c], vocabulary, expect, counts[counts > 0])
        used = np.flatnonzero(expect)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(expect[used])], names=["piece", "n"])

    expect = np.zeros(len(pieces.value.keys))
    for r in words.select("payload").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        expect[r.piece] = r.n
    return expect


# ------------------------------------------------------------------- the scores
def _name(word: bytes) -> bytes:
    """What a frequent word is sent as: itself, or a digest after a blank if it is long."""
    return word if len(word) <= LONG_WORD else b" " + hashlib.blake2b(word, digest_size=32).digest()


def _values(words: list[bytes], counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """log10 of the words' lattice sums, log10(c + 1), and whether c > 0."""
    return np.stack([spell(words, pieces) / LOG10, np.log10(counts + 1.0), (counts > 0).astype(float)], axis=1)


def _frequent(words: DataFrame, pieces, least: int) -> tuple[dict[bytes, int], np.ndarray]:
    """Places of the words that occur ``least`` times or more, and their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in column_blobs(pa.Table.from_batches([batch]), "payload"):
                names, counts = _open_words(blob)
                at = np.flatnonzero(counts >= least)
                some = [names[i] for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([_name(w) for w in some], pa.binary()), *(pa.array(c) for c in _values(some, counts[at], pieces.value).T)], names=["word", "p", "seen", "known"])

    found = words.select("payload").mapInArrow(run, "word binary, p double, seen double, known double").toArrow()
    index = {w: i for i, w in enumerate(found.column("word").to_pylist())}
    return index, np.stack([found.column(c).to_numpy() for c in ("p", "seen", "known")], axis=1) if index else np.zeros((0, 3))


def _scored(docs: DataFrame, fragments: int, frequent) -> DataFrame:
    """kind 0: a row for each text with sums over its frequent words; kind 1: a
    batch's other words of one fragment with the texts that hold them.
    ``docs``: key, text, train.
    """
    key_type = docs.schema["key"].dataType

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = np.cumsum(np.array([len(t) for t in batch.column(1).cast(pa.large_string()).fill_null("").to_pylist()], dtype=np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = int(np.searchsorted(edges, (edges[lo - 1] if lo else 0) + BATCH_CHARS, "right"))
                hi = max(lo + 1, min(hi, lo + BATCH_ROWS, batch.num_rows))
                yield batch.slice(lo, hi - lo)
                lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        coder = zstandard.ZstdCompressor(level=1)
        number = TaskContext.get().partitionId() << 32
        index, values = frequent.value
        get = index.get
        for batch in batches_of(batches):
            n = batch.num_rows
            seldom: dict[bytes, int] = {}
            sums, n_tokens = np.zeros((n, 3)), []
            rows, which, times = [], [], []
            for i, t in enumerate(batch.column(1)):
                counts = Counter(_words(t.as_py() or ""))
                n_tokens.append(counts.total() + 1)
                at = np.fromiter((get(w, -1) for w in counts), dtype=np.int64, count=len(counts))
                often = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                here = at >= 0
                sums[i] = often[here] @ values[at[here]]
                if not here.all():
                    names = list(counts)
                    for j in np.flatnonzero(~here).tolist():
                        w = names[j]
                        k = get(_name(w), -1) if len(w) > LONG_WORD else -1
                        if k >= 0:
                            sums[i] += often[j] * values[k]
                            continue
                        rows.append(i)
                        which.append(seldom.setdefault(w, len(seldom)))
                        times.append(int(often[j]))
            names = list(seldom)
            rows, which, times = np.array(rows, dtype="<u2"), np.array(which, dtype=np.int64), np.array(times, dtype="<u4")
            order = np.argsort(which, kind="stable")
            rows, times = rows[order], times[order]
            sizes = np.bincount(which, minlength=len(names))
            first = np.cumsum(sizes) - sizes
            frags, out = [], []
            for f, at in _by_fragment(names, fragments) if names else ():
                place = np.repeat(first[at] - np.cumsum(sizes[at]) + sizes[at], sizes[at]) + np.arange(int(sizes[at].sum()))
                frags.append(f)
                out.append(coder.compress(pack(sizes[at].astype("<u4"), rows[place], times[place], _joined(names, at))))
            more = len(frags)
            whole = np.concatenate([sums, np.zeros((more, 3))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * n + [1] * more, pa.int32()), pa.array([-1] * n + frags, pa.int32()), pa.array([number] * (n + more), pa.int64()), pa.array([*range(n), *[-1] * more], pa.int32()),
                    pa.concat_arrays([batch.column(0), pa.nulls(more, batch.column(0).type)]), pa.array(n_tokens + [0] * more, pa.int64()), pa.array(batch.column(2).to_pylist() + [False] * more, pa.bool_()),
                    *(pa.array(c) for c in whole.T), pa.array([None] * n + out, pa.binary()),
                ],
                names=["kind", "frag", "batch", "row", "key", "n_tokens", "train", "p", "seen", "known", "payload"],
            )
            number += 1

    schema = f"kind int, frag int, batch long, row int, key {key_type.simpleString()}, n_tokens long, train boolean, p double, seen double, known double, payload binary"
    return docs.mapInArrow(run, schema)


def _partial_sums(pieces):
    """Sums over a fragment's words for each text of each batch."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        batches, out = [], []
        if left.num_rows:
            lean()
            parts = [unpack(zstandard.ZstdDecompressor().decompress(b), "<u4", "<u2", "<u4", "u1") for b in column_blobs(left, "payload")]
            texts = [p[3].tobytes().split(b" ") for p in parts]
            needed = set().union(*texts)
            names, counts = _open_words(next(iter(column_blobs(right, "payload"))))
            use = np.array([w in needed for w in names], dtype=bool)
            names, counts = [w for w, u in zip(names, use.tolist(), strict=True) if u], counts[use]
            values = _values(names, counts, pieces.value)
            index = {w: i for i, w in enumerate(names)}
            for b, (sizes, rows, times, _), words in zip(left.column("batch").to_pylist(), parts, texts, strict=True):
                owner = np.repeat(np.array([index[w] for w in words], dtype=np.int64), sizes)
                used, place = np.unique(rows, return_inverse=True)
                sums = np.stack([np.bincount(place, weights=values[owner, k] * times, minlength=len(used)) for k in range(3)])
                batches.append(b)
                out.append(pack(used.astype("<u2"), sums.ravel().astype("<f8")))
        return pa.table({"batch": pa.array(batches, pa.int64()), "payload": pa.array(out, pa.binary())})

    return run


def _whole_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of a batch with the sums of their frequent and their other words."""
    sums = np.stack([left.column(c).to_numpy() for c in ("p", "seen", "known")])
    place = np.full(BATCH_ROWS, -1)
    place[left.column("row").to_numpy()] = np.arange(left.num_rows)
    for b in column_blobs(right, "payload"):
        rows, values = unpack(b, "<u2", "<f8")
        sums[:, place[rows]] += values.reshape(3, -1)
    kept = left.select(["key", "n_tokens", "train"])
    for name, column in zip(("p", "seen", "known"), sums, strict=True):
        kept = kept.append_column(name, pa.array(column))
    return kept


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, path: str | None = None, fragment_tokens: int = FRAGMENT_TOKENS, steps: int = STEPS, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    work = Workspace(spark, "lattice")
    some = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (~held_out(key, folds, fold)).alias("train"))
    # About one token in six characters; only the number of fragments hangs on it.
    chars, texts = some.agg(F.sum(F.length("text")), F.count_if("train")).first()
    fragments = max(LEAST_FRAGMENTS, -(-(chars or 0) // (6 * fragment_tokens)))
    counted = _counted(some.select("text", "train"), fragments)
    words = work.save(counted.repartition(fragments, "frag").groupBy("frag").applyInArrow(_merge_counts, "frag int, payload binary, tokens long, distinct long"), "words")
    tokens, distinct = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    tokens, distinct = tokens + texts, distinct + (texts > 0)  # with one end for each text
    first = spark.sparkContext.broadcast(load_pieces(path))
    pieces = first
    for _ in range(steps):
        pieces = spark.sparkContext.broadcast(reweigh(pieces.value, first.value, _expectations(words, pieces), texts))
    frequent = spark.sparkContext.broadcast(_frequent(words, pieces, max(2, -(-tokens // most_frequent))))
    entries = work.save(_scored(some, fragments, frequent), "entries", "kind")
    parts = entries.filter("kind = 1").select("frag", "batch", "payload")
    held = words.select(F.col("frag").alias("f"), "payload")
    sums = parts.groupBy("frag").cogroup(held.groupBy("f")).applyInArrow(_partial_sums(pieces), "batch long, payload binary")
    rows = entries.filter("kind = 0").select("batch", "row", "key", "n_tokens", "train", "p", "seen", "known")
    kind = docs.schema[key].dataType.simpleString()
    whole = rows.groupBy("batch").cogroup(sums.groupBy("batch")).applyInArrow(_whole_sums, f"key {kind}, n_tokens long, train boolean, p double, seen double, known double")
    base = F.col("seen") + math.log10(texts + 1.0) - F.col("n_tokens") * F.lit(math.log10(tokens + 1 * (distinct + 1)))
    return whole.select(
        F.col("key").alias(key), (~F.col("train")).alias("held_out"), "n_tokens", (F.round("known").cast("long") + int(texts > 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("p") + F.lit(pieces.value.log_end / LOG10)).alias("score"),
    )
