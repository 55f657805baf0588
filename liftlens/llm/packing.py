"""Packing tokenized documents into fixed windows by best-fit decreasing.

``tokenize`` turns documents into pieces: a document longer than a window is
first cut into full windows; the rest is one shorter piece. ``pack`` places the
pieces. Each task gets an even random share of all pieces, sorted by falling
length by Spark, and places them one by one: a segment tree indexed by
remaining capacity finds the tightest open window. Only open windows are held
(their capacity and number), never the pieces, so memory does not grow with
text. The number of tasks follows the total number of windows, so that the few
badly filled windows at the end of a task are a small part of its share.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, materialize, shuffle_partitions, slices, tidy

WINDOW = 4096
CACHE_RUNS = 400_000  # per Python worker, and twice as many stems; cleared when full
CACHED_LENGTH = 48  # longer runs are encoded anew each time


def _byte_characters() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Ids of a text from the ids of its space-separated runs.

    Only for byte-level tokenizers that lower-case, drop white space and split
    letters from other marks before they merge. A run of text between two
    spaces then has the same ids alone as inside the text. A run of Latin-1
    letters with closing marks is its lower-cased letters and its marks, which
    are encoded once each; other runs go through the whole tokenizer.
    """

    WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

    def __init__(self, path: str, cached: int = CACHE_RUNS):
        self.cached = cached
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.characters = _byte_characters()
        self.runs: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _whole(self, runs: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _stem(self, stem: str) -> bytes:
        text = stem if stem.isascii() else "".join(map(self.characters.__getitem__, stem.encode()))
        return struct.pack(f"<{len(ids)}I", *ids) if (ids := [t.id for t in self.merge(text)]) else b""

    def _new_runs(self, new: list[str]) -> dict[str, bytes]:
        got, others, stems, marks = {}, [], self.stems, self.marks
        match = self.WORD.fullmatch
        for run in new:
            word = match(run) if len(run) <= CACHED_LENGTH else None
            if word is None:
                others.append(run)
                continue
            stem, mark = word.groups()
            stem = stem.lower()
            ids = stems.get(stem)
            if ids is None:
                ids = stems[stem] = self._stem(stem)
            if mark:
                if mark not in marks:
                    marks[mark] = self._whole([mark])[0]
                ids += marks[mark]
            got[run] = ids
        for lo in range(0, len(others), 4096):
            got.update(zip(others[lo : lo + 4096], self._whole(others[lo : lo + 4096])))
        return got

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self.runs) > self.cached:
            self.runs.clear()
        if len(self.stems) > 2 * self.cached:
            self.stems.clear()
        known = self.runs
        got = self._new_runs(list(set(chain.from_iterable(split)).difference(known)))
        known.update(got)
        out = [b"".join(map(known.__getitem__, runs)) for runs in split]
        for run in got:
            if len(run) > CACHED_LENGTH:
                del known[run]
        return out


@lru_cache(maxsize=2)
def encoder(path: str, cached: int = CACHE_RUNS) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path, cached)


def tokenize(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = WINDOW,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    cached: int = CACHE_RUNS,
) -> DataFrame:
    """Pieces of all documents: the id column, start, length, doc_tokens, ids.

    ``ids`` is binary, little-endian unsigned 32-bit. Each document ends with
    ``end_id``, so a null or empty text is one piece of length 1. Repeated rows
    and null ids are documents like any other; long texts are read whole. An
    empty table gives no pieces. ``cached``: runs of letters whose ids a worker
    keeps, about 450 bytes each with their stems.
    """
    kind = arrow_type(docs, id_col)
    schema = pa.schema(
        [(id_col, kind), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
    )
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path, cached)
        for batch in batches:
            for part in slices(batch, 1):
                rows: list[tuple] = []
                for key, raw in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    rows += [(key, s, min(window, n - s), n, raw[4 * s : 4 * (s + window)]) for s in range(0, n, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    out = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens")]
        + [T.StructField("ids", T.BinaryType())]
    )
    return docs.select(id_col, text_col).mapInArrow(tidy(cut), out)


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over the capacities
    answers "smallest capacity of at least n that some window has"."""

    def __init__(self, window: int):
        self.window = window
        self.leaves = 1 << window.bit_length()
        self.used = bytearray(2 * self.leaves)  # 1: some window below this tree node
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]
        self.count = 0

    def tightest(self, need: int) -> int:
        """The smallest open capacity of at least ``need``; 0 if there is none."""
        node, used = need + self.leaves, self.used
        if used[node]:
            return need
        while node > 1:
            if not node & 1 and used[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if used[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return 0

    def place(self, length: int) -> tuple[int, int]:
        """(window number, offset) of a piece of this length."""
        capacity = self.tightest(length)
        if capacity:
            stack = self.stacks[capacity]
            number = stack.pop()
            if not stack:
                self._mark(capacity, 0)
        else:
            capacity, number = self.window, self.count
            self.count += 1
        rest = capacity - length
        if rest:
            self.stacks[rest].append(number)
            self._mark(rest, 1)
        return number, self.window - capacity

    def _mark(self, capacity: int, value: int) -> None:
        node, used = capacity + self.leaves, self.used
        used[node] = value
        while node > 1:
            node >>= 1
            now = used[2 * node] | used[2 * node + 1]
            if used[node] == now:
                break
            used[node] = now


def pack(pieces: DataFrame, window: int = WINDOW, windows_per_task: int = 1024, tasks: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` column.

    Every piece lies in exactly one sequence, gapless from offset 0. Lengths
    must be 1..window. Reads ``pieces`` twice (its total length sets the number
    of tasks, unless ``tasks`` is given), so pass a materialized frame.
    Existing columns of these two names are replaced. Ties fall in any order.
    """
    pieces = pieces.drop("sequence_id", "offset")
    at = pieces.columns.index("length")
    out = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    if tasks is None:
        total = pieces.agg(F.sum("length")).first()[0] or 0
        tasks = max(1, min(shuffle_partitions(pieces.sparkSession), total // (window * windows_per_task)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        windows = OpenWindows(window)
        for batch in batches:
            if batch.num_rows:
                spots = [windows.place(n) for n in batch.column(at).to_pylist()]
                number, offset = (np.asarray(x, dtype=np.int64) for x in zip(*spots))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(number + first), pa.array(offset)],
                    names=[*batch.schema.names, "sequence_id", "offset"],
                )

    dealt = pieces.repartition(tasks).sortWithinPartitions(F.desc("length"))
    return dealt.mapInArrow(place, out)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and pack; the pieces keep their ids."""
    return pack(materialize(tokenize(docs, tokenizer_path, window, id_col=id_col, text_col=text_col), "pieces"), window)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (binary, unpadded)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most one window of tokens in a group
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def padding(length: int, window: int = WINDOW) -> int:
    """Padded tokens of a sequence: up to the window, none at a power of two."""
    return 0 if length & (length - 1) == 0 else window - length
