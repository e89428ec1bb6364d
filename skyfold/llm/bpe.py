"""Operator 9: BPE encoding and decoding in batched numpy merge rounds.

The new words of a batch of rows lie, symbol after symbol, in one flat array.
A round looks up every neighbouring pair by binary search in the sorted pair
keys, takes each word's lowest rank, and merges that pair wherever it stands in
the word.  Words that hold no known pair leave the array.  The rounds end when
it is empty.

The vocabulary file is one of the ``tokenizers`` JSON files with an NFC, white
space and lower-case normaliser, a split pattern, a byte-level alphabet and a
word-end suffix.  White space never lies inside a token of such a file, so the
unit that is encoded once and kept is a run without white space.

Defined cases: a null or empty text has no tokens (the digests are those of the
empty string); special strings of the file become their own ids; repeated rows
give repeated results; a null key stays null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.llm.common import CHUNK_ROWS, kept_by_worker

#: Entries that a worker keeps of what it has encoded.
CACHE_ENTRIES = 200_000
#: What the split pattern and Python's own split see differently as white space.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte, by the usual rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + spare)
            spare += 1
    return [out[b] for b in range(256)]


class MergeTable:
    """Pair keys in order, with the rank and the result of each pair."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.base = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * self.base + right
        rank = np.arange(len(keys), dtype=np.int64)
        order = np.lexsort((rank, keys))
        order = order[np.append(True, np.diff(keys[order]) > 0)] if len(order) else order
        self.keys, self.rank = keys[order], rank[order]
        self.made = made
        self.pair = keys
        # A merge may run everywhere in a word at once if no pair with its
        # result ranks below it; otherwise only its first place counts.
        soonest = np.full(self.base, len(keys), dtype=np.int64)
        np.minimum.at(soonest, left, rank)
        np.minimum.at(soonest, right, rank)
        self.everywhere = soonest[made] > rank

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair key, or the number of merges if there is none."""
        none = len(self.made)
        if not none:
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], none)


def merge_rounds(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, number of symbols of each word) after all merges.

    ``symbols`` holds the words one after another, ``lengths`` their sizes.
    """
    owner = np.repeat(np.arange(len(lengths)), lengths)
    none = len(table.made)
    ready: list[tuple[np.ndarray, np.ndarray]] = [(symbols[:0], owner[:0])]
    while len(symbols):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes = np.diff(np.append(starts, len(symbols)))
        ranks = np.full(len(symbols), none, dtype=np.int64)
        at = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[at] = table.lookup(symbols[at] * table.base + symbols[at + 1])
        best = np.minimum.reduceat(ranks, starts)
        done = best == none
        over = np.repeat(done, sizes)
        ready.append((symbols[over], owner[over]))
        symbols, owner, ranks = symbols[~over], owner[~over], ranks[~over]
        best, sizes = best[~done], sizes[~done]
        if not len(symbols):
            break
        lowest = np.repeat(best, sizes)
        hit = ranks == lowest
        # Of hits in a row (a pair of equal symbols) every second one counts.
        index = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), index, 0))
        hit &= (index - run) % 2 == 0
        if not table.everywhere[best].all():
            first = np.minimum.reduceat(np.where(hit, index, len(hit)), np.cumsum(sizes) - sizes)
            hit &= table.everywhere[lowest] | (index == np.repeat(first, sizes))
        place = np.flatnonzero(hit)
        symbols[place] = table.made[lowest[place]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[place + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    symbols, owner = (np.concatenate(x) for x in zip(*ready, strict=True))
    return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lengths))


class WordBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.table = MergeTable(self.vocab, model["merges"])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"], regex.V0)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_alphabet()
        self.inner = np.array([self.vocab.get(c, -1) for c in letters], dtype=np.int64)
        self.final = np.array([self.vocab.get(c + self.suffix, -1) for c in letters], dtype=np.int64)
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.digits = {i: str(i) for i in self.names}
        # Two generations: what the older one holds moves over when it is used.
        self.kept: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def normalise(self, run: str) -> str:
        """NFC, then each character in lower case (a final sigma is no exception)."""
        return unicodedata.normalize("NFC", run).replace("Σ", "σ").lower()

    def words_of(self, run: str) -> list[str]:
        """Words of a run by the file's normaliser and split pattern.

        Unicode versions differ in what they know.  A run with a character that
        Python's tables do not have goes through the library's own normaliser and
        splitter, whose tables decide.
        """
        if max(run, default="") > "\u024f" and any(unicodedata.category(c) == "Cn" for c in run):
            return [w for w, _ in self.library_split(self.library_normalise(run))]
        return self.pattern.findall(self.normalise(run))

    def library_normalise(self, run: str) -> str:
        return self.library.normalizer.normalize_str(run)

    def library_split(self, run: str) -> list:
        from tokenizers import Regex, pre_tokenizers

        return pre_tokenizers.Split(Regex(self.pattern.pattern), behavior="removed", invert=True).pre_tokenize_str(run)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def learn(self, runs: list[str]) -> None:
        """Encode runs without white space and keep (ids, their number, decoded)."""
        pieces = [self.words_of(r) for r in runs]
        words = list({w for p in pieces for w in p})
        coded: dict[str, tuple[str, int, str]] = {}
        if words:
            raw = [w.encode("utf-8", "surrogatepass") for w in words]
            lengths = np.array([len(w) for w in raw], dtype=np.int64)
            data = np.frombuffer(b"".join(raw), dtype=np.uint8)
            symbols = self.inner[data]
            ends = np.cumsum(lengths) - 1
            symbols[ends] = self.final[data[ends]]
            flat, sizes = merge_rounds(symbols, lengths, self.table)
            if (flat < 0).any():  # a symbol that the vocabulary lacks has no id
                sizes = np.bincount(np.repeat(np.arange(len(words)), sizes)[flat >= 0], minlength=len(words))
                flat = flat[flat >= 0]
            flat = flat.tolist()
            ids, names = [self.digits[i] for i in flat], [self.names[i] for i in flat]
            lo = 0
            for w, n in zip(words, sizes.tolist(), strict=True):
                hi = lo + n
                coded[w] = (ids[lo], 1, names[lo]) if n == 1 else (" ".join(ids[lo:hi]), n, " ".join(names[lo:hi]))
                lo = hi
        kept = self.kept
        for r, p in zip(runs, pieces, strict=True):
            if len(p) == 1:
                kept[r] = coded[p[0]]
            else:
                found = [x for w in p if (x := coded[w])[1]]
                kept[r] = " ".join([x[0] for x in found]), sum([x[1] for x in found]), " ".join([x[2] for x in found])

    def runs_of(self, text: str) -> list[str]:
        if _ODD_SPACE.search(text):
            return regex.split(r"\s+", text)
        return text.split()

    def parts_of(self, text: str) -> list[str]:
        """Runs without white space; special strings stand alone."""
        if self.special_split is not None and any(s in text for s in self.special):
            out = []
            for part in self.special_split.split(text):
                out += [part] if part in self.special else self.runs_of(part)
            return out
        return self.runs_of(text)

    def batch(self, texts: list[str]) -> Iterator[tuple[list[str], list[int], list[str]]]:
        """For each text: its ids, their numbers by run, its decoded runs."""
        parts = [self.parts_of(t) for t in texts]
        used = {r for p in parts for r in p}
        if len(self.kept) + len(used) > CACHE_ENTRIES:
            self.kept, self.older = {}, self.kept
        new = []
        for r in used - self.kept.keys():
            if r in self.older:
                self.kept[r] = self.older[r]
            elif r in self.special:
                self.kept[r] = self.digits[self.special[r]], 1, r
            else:
                new.append(r)
        if new:
            self.learn(new)
        for p in parts:
            found = [x for r in p if (x := self.kept[r])[1]]
            yield [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for run in ids for i in run.split(" ")] for ids, _, _ in self.batch(texts)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)


_LOADED: dict[str, WordBPE] = kept_by_worker({})


def vocabulary(path: str | None) -> WordBPE:
    """The vocabulary of a file, read once in each Python worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    for lo in range(0, batch.num_rows, CHUNK_ROWS):
        part = batch.slice(lo, CHUNK_ROWS)
        yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids, decoded) of every row of ``docs``."""

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            for keys, texts in _texts(batch):
                ids, decoded = [], []
                for i, _, d in bpe.batch(texts):
                    ids.append([int(x) for run in i for x in run.split(" ")])
                    decoded.append(" ".join(d))
                yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["key", "ids", "decoded"])

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): what :func:`encode` returns, as digests."""

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            for keys, texts in _texts(batch):
                n, a, b = [], [], []
                for ids, counts, decoded in bpe.batch(texts):
                    n.append(sum(counts))
                    a.append(hashlib.sha256(" ".join(ids).encode()).hexdigest())
                    b.append(hashlib.sha256(" ".join(decoded).encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)
