"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Documents are cut only where they exceed a sequence. Pieces and gaps are then sorted by size and matched in supersteps,
largest piece size first: all pieces of that size sweep the gaps for the tightest that still holds one, pieces are dealt
to the gaps found by their rank among pieces of equal size (so that no gap gets two at once unless it has the room),
the gaps are updated, and the sweep repeats with the pieces left; pieces for which no gap is left open new sequences.
That gives the packing of sequential best-fit decreasing.

Equal pieces are exchangeable, and so are sequences with equal gaps. The state of the sweeps is therefore kept as runs:
(size, ranks) of pieces and (gap, sequence numbers) of sequences, a table bounded by the capacity and not by the
corpus. What grows with the corpus is distributed: counting sizes, ranking the pieces (by size and hashed block, block
offsets being prefix sums of counts, so that a size that a third of all pieces share is ranked by many tasks), and the
match of every piece with the run that holds its rank.

Edge cases: null and empty texts are the end id alone; the content of an added token is that token, as the library has it; repeated rows are packed each; a piece that fills a sequence has
one to itself; an empty table gives an empty result; texts of any length are encoded whole; other columns of the input
are not read and so may have any name.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.pretokens import Memo, spaced
from telemill.plans.lineage import BROADCAST_ROWS, written

CAPACITY = 1024
END_ID = 2
WORDS = 200_000
#: Pieces of one size are ranked in so many blocks at least, and more where a block would hold more than BLOCK pieces.
BLOCKS, BLOCK = 64, 200_000


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones themselves, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """Texts to ids by a byte-level BPE file of the tokenizers library, as little-endian unsigned 32-bit numbers.

    Added tokens are found first, wherever their content stands, the longest of those that begin at a place; what lies
    between them is cut by pattern and merged apart.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in added.values() for k in ("single_word", "lstrip", "rstrip", "normalized")) or spec.get("normalizer"):
            raise ValueError("added tokens with conditions and normalizers are not supported")
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = {c: t["id"].to_bytes(4, "little") for c, t in added.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.memo = Memo(self._merged, WORDS)

    def _merged(self, text: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.encoding.encode_ordinary(text)])

    def _plain(self, text: str) -> bytes:
        parts = spaced(text)
        return self._merged(text) if parts is None else b"".join(map(self.memo.__getitem__, parts))

    def __call__(self, text: str) -> bytes:
        if self.marks is None or not any(c in text for c in self.added):
            return self._plain(text)
        return b"".join(self.added[x] if x in self.added else self._plain(x) for x in self.marks.split(text) if x)


@lru_cache(2)
def tokenizer(path: str, pattern: str) -> Tokens:
    return Tokens(path, pattern)


def pieces(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32, and with ids the ids as 32-bit numbers."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], [[] for _ in names[1:]]
            own = tokenizer(path, pattern)
            for row, x in enumerate(b.column(1)):
                data = own(x.as_py() or "") + end_id.to_bytes(4, "little")
                n = len(data) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    part = data[4 * start : 4 * (start + length)]
                    at.append(row)
                    for column, value in zip(out, (piece, start, length, crc32(part), part), strict=False):
                        column.append(value)
                    start, piece = start + length, piece + 1
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(out, types, strict=False)]], names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Supersteps over runs. counts: pieces by size. Gives (size, first rank, ranks, first sequence, offset, per sequence):
    ranks first, first + 1, ... go, `per sequence` at a time, to the sequences from first sequence on, from offset on."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # by gap: runs of sequences
    order: list[int] = []
    found, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            i = bisect_left(order, size)
            if i == len(order):  # no gap holds one
                fit = capacity // size
                n = -(-left // fit)
                gap, first = capacity, opened
                opened += n
            else:
                gap = order[i]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[i]
                fit = gap // size
            full = min(n, left // fit)
            if full:
                found.append((size, rank, full * fit, first, capacity - gap, fit))
                put(gap - fit * size, first, full)
                rank, left, first, n = rank + full * fit, left - full * fit, first + full, n - full
            if n and 0 < left < fit:
                found.append((size, rank, left, first, capacity - gap, left))
                put(gap - left * size, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(gap, first, n)
    return found


def pack(parts: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """parts (with key, piece, length: 1 to capacity) with sequence_id and offset."""
    spark = parts.sparkSession
    total = parts.count()
    blocks = max(BLOCKS, total // BLOCK)
    parts = parts.withColumn("__block", F.pmod(F.xxhash64(key, "piece"), F.lit(blocks)))
    cells = parts.groupBy("length", "__block").agg(F.count(F.lit(1)).alias("__n"))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    runs = spark.createDataFrame(sweep(counts, capacity), "length long, __rank long, __ranks long, __first long, __offset long, __fit long")
    cells = cells.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__block")) - F.col("__n")).drop("__n")
    ranked = parts.withColumn("__row", F.row_number().over(Window.partitionBy("length", "__block").orderBy(key, "piece")) - 1)
    small = blocks * len(counts) <= BROADCAST_ROWS
    ranked = ranked.join(F.broadcast(cells) if small else cells, ["length", "__block"]).withColumn("__at", F.col("__before") + F.col("__row"))
    a, b = ranked.alias("a"), F.broadcast(runs).alias("b")  # runs: bounded by the capacity
    hit = (F.col("a.length") == F.col("b.length")) & (F.col("a.__at") >= F.col("b.__rank")) & (F.col("a.__at") < F.col("b.__rank") + F.col("b.__ranks"))
    place = F.col("a.__at") - F.col("b.__rank")
    return a.join(b, hit).select(
        *[F.col(f"a.`{c}`") for c in parts.columns if c != "__block"],
        (F.col("b.__first") + F.floor(place / F.col("b.__fit"))).cast("long").alias("sequence_id"),
        (F.col("b.__offset") + (place % F.col("b.__fit")) * F.col("a.length")).cast("long").alias("offset"),
    )


def best_fit(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """All pieces of docs with their places. path: a byte-level BPE file of the tokenizers library; pattern: its splits."""
    return pack(written(pieces(docs, path, pattern, key, text, capacity, end_id, ids), "pieces"), key, capacity)
