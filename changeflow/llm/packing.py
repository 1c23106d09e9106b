"""Packing of token pieces into sequences, with certified bounds and exchange between partitions.

Documents become token ids and a closing id 0; longer ones are cut into pieces of full length, the first
one shorter. Full pieces fill a sequence each. All others are dealt evenly over partitions of bounded
size. A partition packs its pieces best-fit decreasing, and dual-feasible functions give a lower bound
of its bins. Where a gap to the bound is left, all pieces go. Where the bins reach it, the partition is
certified; its emptiest bin goes, and if more than a bin's worth is empty, so do all bins that are not
nearly full, since pieces of other partitions might fill them. What partitions give away is dealt anew over
fewer partitions and packed again, until one partition holds the rest or their number stops falling.

Defined results: a null or empty text is the closing id alone; rows may repeat, each one is packed; an
empty table gives an empty result; other columns are ignored. A partition holds ``PARTITION`` pieces, a
tokenizer worker one Arrow batch and a bounded cache of words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .similar import Remembered, small_batches

CAPACITY = 2048
PARTITION = 8192
NEARLY = 64  # a bin is full enough when less than this part of it is free
CLOSING = 0
#: Characters of which all Unicode versions and both tokenizer libraries think alike.
_UNUSUAL = re.compile("[^\t\n -~¡-ɏ‐-‧‰-⁞€]")
_SPECIAL = "<|endoftext|>"


class _Unsplittable(Exception):
    pass


class ByteBpe:
    """Ids of the byte-level vocabulary as little-endian 32-bit bytes.

    Merges never cross the pre-tokens of the vocabulary, and a single space always begins one. So a text is
    split at its spaces, and every word, with the space before it, is encoded once and remembered.
    Texts with other runs of white space, unusual characters or the special token go to the library whole.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.words = Remembered(self._word)

    def _word(self, word: str) -> bytes:
        if not word or word[0].isspace() or _UNUSUAL.search(word) or _SPECIAL in word:
            raise _Unsplittable
        return self._bytes(self.plain.encode_ordinary(" " + word))

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            tail = b"".join(map(self.words.__getitem__, rest))
            if not _UNUSUAL.search(first) and _SPECIAL not in first:
                return self._bytes(self.plain.encode_ordinary(first)) + tail
        except _Unsplittable:
            if not _UNUSUAL.search(text) and _SPECIAL not in text:
                return self._bytes(self.plain.encode_ordinary(text))
        return self._bytes(self.whole.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def loaded(tokenizer: str, ranks: str, pattern: str) -> ByteBpe:
    """The encoder of a worker process; its cache serves all tasks that the process runs."""
    return ByteBpe(tokenizer, ranks, pattern)


def public_byte_bpe() -> tuple[str, str, str]:
    """The default vocabulary: its two files and the pattern of its pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids; only the first may be shorter than the capacity."""
    first = total % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def token_pieces(docs: DataFrame, vocabulary: tuple[str, str, str] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    vocabulary = vocabulary or public_byte_bpe()
    closing = np.array([CLOSING], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(*vocabulary)
        for batch in small_batches(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(text.as_py() or "") + closing
                rows += [(doc, i, s, n, zlib.crc32(ids[4 * s:4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4))]
            if rows:
                kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin of each size, place in its bin, fill of each bin); sizes are at most the capacity."""
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a bin has room r
    fill: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            number = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, number = capacity, len(fill)
            fill.append(0)
        bins[i], places[i] = number, fill[number]
        fill[number] += size
        left = room - size
        open_bins[left].append(number)
        rooms |= 1 << left
    return bins, places, fill


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> float:
    """The largest bound of dual-feasible functions on the number of bins, not rounded up."""
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.float64)
    size = np.arange(capacity + 1)
    best = float(count @ size) / capacity
    number, volume = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    for small in range(1, capacity // 2 + 1):  # sizes below count nothing, those above capacity - small a whole bin
        large = capacity - small
        best = max(best, (number[-1] - number[large + 1]) + (volume[large + 1] - volume[small]) / capacity)
    for k in range(1, 33):  # sizes rounded down to multiples of 1/k, where (k + 1) times the size is no whole number
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size / capacity, (scaled // capacity) / k)
        best = max(best, float(count @ value))
    return best


def _packer(last: bool, capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pieces: _pack_partition(pieces, last, capacity)


def _pack_partition(pieces: pd.DataFrame, last: bool, capacity: int) -> pd.DataFrame:
    sizes = pieces["length"].to_numpy(np.int64)
    bins, places, fill = best_fit_decreasing(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    given = np.zeros(len(fill), bool)
    if not last and len(fill) > np.ceil(bound - 1e-9):
        given[:] = True
    elif not last:
        given[int(np.argmin(fill))] = min(fill) < capacity
        if len(fill) - sizes.sum() / capacity > 1:  # the best for these pieces, but others might fill the gaps
            given |= np.array(fill) < capacity - capacity // NEARLY
    return pieces.assign(bin=bins, offset=places, given=given[bins])


def pack(pieces: DataFrame, partition: int = PARTITION, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` must be from 1 to the capacity."""
    pieces = written(pieces, "pieces")
    columns = pieces.columns
    packed = pieces.filter(F.col("length") == capacity).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, round_no, before = pieces.filter(F.col("length") < capacity), 0, None
    while True:
        partitions = max(1, -(-rest.count() // partition))
        last = partitions == 1 or (before is not None and partitions >= before)
        before = partitions
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema)
        # Rows are dealt in turn, whatever they hold, so that copies don't pile up in one partition.
        dealt = rest.withColumn("group", F.pmod(F.monotonically_increasing_id(), F.lit(partitions)))
        done = written(dealt.groupBy("group").applyInPandas(
            _packer(last, capacity),
            f"{schema}, group long, bin long, offset long, given boolean"), "packed")
        number = (F.lit(round_no) * 2**42 + F.col("group")) * 2**14 + F.col("bin")
        packed = packed.unionByName(done.filter("NOT given").select(*columns, number.alias("sequence_id"), "offset"))
        if last:
            return packed
        rest, round_no = done.filter("given").select(*columns), round_no + 1


def op4_best_fit_packing(docs: DataFrame) -> DataFrame:
    return pack(token_pieces(docs))
