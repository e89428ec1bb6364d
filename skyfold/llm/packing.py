"""Operator 6: hierarchical packing of documents into several context sizes.

A document's ids (with the end id) are cut into whole windows of the longest
context; what is left is routed to the smallest tier that holds it.  Each tier
is packed from the longest to the shortest: a window takes one of its tier's
documents, its gap is filled with the longest documents of any tier that fit,
and the last gap is closed by cutting one document.

Every task packs what it reads.  What fills no window at its end (less than one
of the smallest tier) goes to a second pass over the leftovers of all tasks, and so
on until one task holds all that is left; that one alone lays out windows of falling
powers of two below the smallest tier, so that no window is padded.

The windows of a tier are counted over all tasks and dealt in turn to its step
groups, as many as ``STEP_TOKENS`` need: any two groups of a tier differ by one
window at most.  Windows below the smallest tier are one group of their own.

Passes are written to the shared folder; within a task documents keep the order
in which they are read, and leftovers are sorted, so a task that runs again
numbers its windows alike.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed each on its own; a null key stays null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skyfold.llm.common import Workspace, kept_by_worker, lean

TIERS = (256, 512, 1024, 2048)
#: Tokens of a step group.
STEP_TOKENS = 16_384
#: Rows that are packed together.
WINDOW_ROWS = 4096
#: Leftovers that one task packs in a later pass, and tasks whose counts are broadcast.
LEFT_ROWS = 4096
MOST_TASKS = 200_000

Piece = tuple[int, int, int]  # document, start, length


class Tokens:
    """Ids of texts as the ``tokenizers`` library gives them for a byte-level file.

    The merges run in ``tiktoken`` on the file's own vocabulary, which gives the
    same ids several times faster; a text that holds a special string goes
    through ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        from skyfold.llm.bpe import byte_alphabet

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        code = {c: b for b, c in enumerate(byte_alphabet())}
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(code[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


_LOADED: dict[str, Tokens] = kept_by_worker({})


def tokens(path: str | None) -> Tokens:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


class Packer:
    """Packs pieces into windows; keeps what does not fill one."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tuple(sorted(tiers))
        self.pool: list[tuple[int, int, int]] = []  # (length, document, start), in order
        self.windows = 0
        self.dealt = dict.fromkeys(self.tiers, 0)

    def add(self, doc: int, n: int) -> Iterator[tuple[int, list[Piece]]]:
        """Route a document; windows of the longest tier that it fills alone."""
        longest, start = self.tiers[-1], 0
        while n - start >= longest:
            yield longest, [(doc, start, longest)]
            start += longest
        if n > start:
            insort(self.pool, (n - start, doc, start))

    def _take(self, at: int) -> tuple[int, int, int]:
        return self.pool.pop(at)

    def pack(self) -> Iterator[tuple[int, list[Piece]]]:
        """Windows that the waiting documents fill, from the longest tier down."""
        for k in range(len(self.tiers) - 1, -1, -1):
            tier = self.tiers[k]
            below = self.tiers[k - 1] if k else 0
            while self.pool and self.pool[-1][0] > below:
                if sum(p[0] for p in self.pool[-4:]) < tier and self._total() < tier:
                    break
                yield tier, self._fill(tier)

    def _total(self) -> int:
        return sum(p[0] for p in self.pool)

    def _fill(self, size: int) -> list[Piece]:
        """One window of exactly ``size``; the pool holds at least as much."""
        gap, out = size, []
        while gap:
            at = bisect_left(self.pool, (gap + 1,)) - 1  # the longest that fits
            if at >= 0:
                n, doc, start = self._take(at)
            else:
                n, doc, start = self._take(0)
                insort(self.pool, (n - gap, doc, start + gap))
                n = gap
            out.append((doc, start, n))
            gap -= n
        return out

    def finish(self) -> Iterator[tuple[int, list[Piece]]]:
        """Windows of falling powers of two for what is left."""
        size = 1 << (self.tiers[-1].bit_length() - 1)
        left = self._total()
        while left:
            while size > left:
                size >>= 1
            yield size, self._fill(size)
            left -= size

    def leftover(self) -> list[Piece]:
        """What fills no window, in order."""
        left = [(doc, start, n) for n, doc, start in self.pool]
        self.pool = []
        return left

    def number(self, tier: int) -> tuple[int, int]:
        """(window of the task, window of the task and tier) of the next window."""
        window, dealt = self.windows, self.dealt.get(tier, 0)
        self.windows += 1
        self.dealt[tier] = dealt + 1
        return window, dealt


SCHEMA = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("tier", T.IntegerType()), ("step_group", T.LongType())]
#: Of a pass: pieces (kind 0), with the window's number in its task and tier, and leftovers (kind 1).
_NAMES = ["kind", "key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "place", "ids", "rest"]


class _Rows:
    """The rows of a pass; ``held`` has each waiting document's key, ids, ids before them, tokens, ids not yet laid out."""

    def __init__(self, tiers: tuple[int, ...], task: int, ids: bool, key_type: pa.DataType) -> None:
        self.packer, self.task, self.ids, self.key_type = Packer(tiers), task, ids, key_type
        self.held: dict[int, list] = {}
        self.seen = 0

    def add(self, key: object, ids: np.ndarray, before: int, tokens: int) -> Iterator[tuple[int, list[Piece]]]:
        self.held[self.seen] = [key, ids, before, tokens, len(ids)]
        self.seen += 1
        yield from self.packer.add(self.seen - 1, len(ids))

    def batch(self, windows: Iterator[tuple[int, list[Piece]]], rest: list[Piece] = ()) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in _NAMES]

        def put(doc: int, start: int, n: int, kind: int, window: int, offset: int, tier: int, place: int) -> None:
            entry = self.held[doc]
            part = entry[1][start : start + n]
            values = (kind, entry[0], entry[2] + start, n, zlib.crc32(part.tobytes()), entry[3], window, offset, tier, place, part if self.ids and not kind else None, part.tobytes() if kind else None)
            for c, v in zip(cols, values, strict=True):
                c.append(v)
            entry[4] -= n
            if not entry[4]:
                del self.held[doc]

        for tier, pieces in windows:
            window, place = self.packer.number(tier)
            offset = 0
            for doc, start, n in pieces:
                put(doc, start, n, 0, self.task + window, offset, tier, place)
                offset += n
        for i, (doc, start, n) in enumerate(rest):
            put(doc, start, n, 1, self.task + i, 0, 0, 0)
        types = [pa.int32(), self.key_type, *[pa.int64()] * 6, pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=_NAMES)


def _task(step: int) -> int:
    """First sequence number of this task in a pass."""
    return (step << 58) + (TaskContext.get().partitionId() << 32)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = 1, ids: bool = False, window_rows: int = WINDOW_ROWS, step_tokens: int = STEP_TOKENS, left_rows: int = LEFT_ROWS) -> DataFrame:
    """One row per piece: (key, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, tier, step_group), and the ids themselves if ``ids`` is set.

    ``sequence_id`` tells the pass, the task and the window; ``tier`` is the window's
    size: nothing is padded; ``step_group`` is unique over all tiers.
    """
    end = np.array([end_id], dtype="<u4")
    key_type = docs.schema[key].dataType
    fields = {n: t for n, t in SCHEMA if n != "step_group"} | {"kind": T.IntegerType(), "key": key_type, "place": T.LongType(), "ids": T.ArrayType(T.LongType()), "rest": T.BinaryType()}
    schema = T.StructType([T.StructField(n, fields[n]) for n in _NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean(_LOADED)
        coder, rows = tokens(path), None

        def filled(part: pa.RecordBatch) -> Iterator[tuple[int, list[Piece]]]:
            for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                all_ids = np.append(coder.ids(t or ""), end)
                yield from rows.add(k, all_ids, 0, len(all_ids))
            yield from rows.packer.pack()

        for batch in batches:
            rows = rows or _Rows(tiers, _task(0), ids, batch.schema.field(0).type)
            for lo in range(0, batch.num_rows, window_rows):
                yield rows.batch(filled(batch.slice(lo, window_rows)))
        if rows is not None:
            yield rows.batch(iter(()), rows.packer.leftover())

    def again(step: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = None

            def filled(batch: pa.RecordBatch) -> Iterator[tuple[int, list[Piece]]]:
                for k, start, total, rest in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "doc_tokens", "rest")), strict=True):
                    yield from rows.add(k, np.frombuffer(rest, dtype="<u4"), start, total)
                yield from rows.packer.pack()

            for batch in batches:
                rows = rows or _Rows(tiers, _task(step), ids, batch.schema.field(batch.schema.get_field_index("key")).type)
                yield rows.batch(filled(batch))
            if rows is not None:
                yield rows.batch(rows.packer.finish()) if last else rows.batch(iter(()), rows.packer.leftover())

        return run

    work = Workspace(docs.sparkSession, "packing")
    found = work.save(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema), "pass-0", "kind")
    pieces, step, last, groups = found.filter("kind = 0"), 0, False, None
    while not last:
        left = found.filter("kind = 1")
        wanted = -(-left.count() // left_rows)
        groups = wanted if groups is None else min(wanted, groups // 2)  # fewer each time
        step, last = step + 1, groups <= 1
        dealt = (left.coalesce(1) if last else left.repartition(groups, F.xxhash64("sequence_id"))).sortWithinPartitions("sequence_id")
        found = work.save(dealt.mapInArrow(again(step, last), schema), f"pass-{step}", "kind")
        pieces = pieces.unionByName(found.filter("kind = 0"))
    # Windows counted over all tasks: a row for each task and tier.
    pieces = pieces.withColumn("task", F.shiftright("sequence_id", 32))
    counts = pieces.groupBy("tier", "task").agg((F.max("place") + 1).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("tier").orderBy("task")) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("tier")))
    before = work.save(before, "windows")
    before = F.broadcast(before) if before.limit(MOST_TASKS + 1).count() <= MOST_TASKS else before
    dealt = pieces.join(before, ["tier", "task"])
    groups = F.greatest(F.ceil(F.col("total") * F.col("tier") / step_tokens), F.lit(1))
    in_tier = F.when(F.col("tier").isin(list(tiers)), F.shiftleft(F.col("tier").cast("long"), 40) + (F.col("before") + F.col("place")) % groups).otherwise(F.lit(0).cast("long"))
    dealt = dealt.withColumn("step_group", in_tier)
    return dealt.select(F.col("key").alias(key), *(n for n, _ in SCHEMA), *(["ids"] if ids else []))
