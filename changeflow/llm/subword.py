"""Sub-word encoding and decoding with a merge-type vocabulary, by a score-ordered agenda.

The agenda holds adjacent pairs of symbols that form a piece; the pair with the best score, then the
leftmost, is merged first. Characters without a piece become bytes. Where no piece of the vocabulary
has a space mark behind another character, a merge can't cross the start of a run of space marks, so a text
is cut there and every part is encoded once and remembered. The new parts of some texts go through their
agendas together, a merge in each of them at a time. Each Arrow batch is checked against the sentencepiece
library: all parts seen for the first time, and the first whole text of every 512. A difference fails the job.

Defined results: a null text is an empty text without ids; rows may repeat; an empty table gives an empty
result. Memory is bounded by a slice of an Arrow batch and a cache of parts.

Where ids are only to be stored (``packed_ids``), the library itself encodes the same parts, each batch in one
call for those that are not remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .similar import Remembered, small_batches

MARK = "▁"
_SHORT = 48
_TOGETHER = 8_192  # runs whose agendas are held at once
_CACHED = 400_000  # words in each of two generations, below 200 MB each
_PARTS = re.compile(f"{MARK}+[^{MARK}]*")
_AT_ONCE = 2**20  # characters of the texts whose words are held at once
_CHECKED = 10_000
_ROWS = 2_048  # texts in a slice of op10, as the more there are, the fewer words are new to it


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def readable(raw: bytes) -> str:
    """Runs of bytes read as UTF-8, without the space before the first word."""
    text = raw.decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def numbers(decimals: bytes) -> list[int]:
    """Ids in decimal as numbers."""
    return list(map(int, decimals.split(b","))) if decimals else []


def joined(values: pa.Array, at: np.ndarray | pa.Array, ends: np.ndarray | pa.Array, between: bytes) -> pa.Array:
    """The values at some places, joined from each end to the next."""
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), values.take(pa.array(at)))
    return pc.binary_join(lists, pa.scalar(between, pa.large_binary()))


class RememberedParts:
    """As ``Remembered``, for ids in decimal and what they decode to, made in one call for all new parts of some texts."""

    def __init__(self, make: Callable[[list[str]], tuple[list[bytes], list[bytes]]], size: int = _CACHED):
        self.make, self.size = make, size
        self.recent: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def __len__(self) -> int:
        return len(self.recent[0])

    def of(self, parts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Both of every part."""
        decimals, raw = self.recent
        fresh = []
        for part in parts:
            if part not in decimals:
                if part in self.old[0]:
                    decimals[part], raw[part] = self.old[0][part], self.old[1][part]
                else:
                    fresh.append(part)
        if fresh:
            for held, made in zip(self.recent, self.make(fresh), strict=True):
                held.update(zip(fresh, made, strict=True))
        out = list(map(decimals.__getitem__, parts)), list(map(raw.__getitem__, parts))
        if len(self) >= self.size:
            self.old, self.recent = self.recent, ({}, {})
        return out

    def joined(self, texts: pa.ListArray) -> Iterator[tuple[bytes, bytes]]:
        """Both of every text, given by its parts, each different one of which is looked up once."""
        parts = texts.flatten().dictionary_encode()
        decimals, raw = (pa.array(values, pa.large_binary()) for values in self.of(parts.dictionary.to_pylist()))
        return zip(
            joined(decimals, parts.indices, texts.offsets, b",").to_pylist(), joined(raw, parts.indices, texts.offsets, b"").to_pylist(),
            strict=True)


class Agendas:
    """The agendas of many short runs, as columns of one array; each step merges the best pair of every run.

    Symbols are numbers: the characters of the pieces, then the longer pieces, then all other characters.
    """

    def __init__(self, rank: dict[str, float]):
        chars = sorted(set().union(*rank))
        self.symbols = [*chars, *(piece for piece in rank if len(piece) > 1)]
        number = {s: i for i, s in enumerate(self.symbols)}
        self.of_char = np.arange(0x110000) + len(self.symbols)
        self.of_char[[ord(c) for c in chars]] = np.arange(len(chars))
        place = {score: i for i, score in enumerate(sorted(set(rank.values())))}
        merges = sorted(
            (number[piece[:i]] << 32 | number[piece[i:]], number[piece], place[rank[piece]])
            for piece in rank for i in range(1, len(piece)) if piece[:i] in number and piece[i:] in number)
        # The last entry stands for a pair that forms no piece.
        self.none = len(place)
        self.pairs, self.merged, self.order = np.array([*merges, (2**63 - 1, -1, self.none)], np.int64).T.copy()

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The entries of pairs of symbols; -1 is no symbol."""
        pair = left << 32 | right
        entry = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[entry] == pair, entry, len(self.pairs) - 1)

    def merge(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left, run by run, and their number in every run."""
        lengths, n = np.fromiter(map(len, runs), np.int64, len(runs)), len(runs)
        rows = int(lengths.max()) + 2  # a row without symbols before and behind the characters
        bits = rows.bit_length()
        within = np.arange(rows)[None, :] < lengths[:, None]
        by_run = np.full((n, rows), -1)
        by_run[:, 1:][within[:, :-1]] = self.of_char[np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)]
        symbol = by_run.T.ravel()
        after, before = np.arange(n, (rows + 1) * n), np.arange(-n, (rows - 1) * n)
        entry = np.full(rows * n, len(self.pairs) - 1)
        entry[:-n] = self._found(symbol[:-n], symbol[n:])
        # A better score comes first, then the place to the left.
        agenda = self.order[entry] << bits | np.repeat(np.arange(rows), n)
        by_place = agenda.reshape(rows, n)
        while True:
            best = by_place.min(axis=0)
            run = np.flatnonzero(best >> bits < self.none)
            if not run.size:
                break
            left = (best[run] & (1 << bits) - 1) * n + run
            right = after[left]
            following, previous = after[right], before[left]
            symbol[left], symbol[right] = self.merged[entry[left]], -1
            after[left], before[following] = following, left
            agenda[right] = self.none << bits
            changed = np.concatenate([previous, left])
            entry[changed] = found = self._found(symbol[changed], symbol[np.concatenate([left, following])])
            agenda[changed] = self.order[found] << bits | changed // n
        by_run = symbol.reshape(rows, n).T
        kept = by_run >= 0
        return by_run[kept], kept.sum(axis=1)


class MergeModel:
    """Pieces and scores of a model file, and the agenda over them."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        self.pieces = [p.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.rank = {self.pieces[i]: -p.get_score(i) for i in plain}
        self.id_of = {self.pieces[i]: i for i in plain}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in ids if p.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown = p.unk_id()
        self.neighbours = {piece[i:i + 2] for piece in self.rank for i in range(len(piece) - 1)}
        self.cut = not any(MARK in piece.lstrip(MARK) for piece in self.rank)
        self.raw_of = [bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].replace(MARK, " ").encode() for i in ids]
        self.decimal_of = pa.array([str(i).encode() for i in ids], pa.large_binary())
        self.runs = Remembered(self.agenda)
        self.parts = RememberedParts(self._parts, _CACHED // 2)
        self.words = RememberedParts(lambda words: self._parts([MARK + word for word in words]))
        self.fresh: dict[str, bytes] = {}

    @cached_property
    def agendas(self) -> Agendas:
        return Agendas(self.rank)

    @cached_property
    def of_symbol(self) -> tuple[pa.Array, pa.Array]:
        """The ids of every symbol of ``agendas`` in decimal, and what they decode to."""
        return self._both([self._ids([s]) for s in self.agendas.symbols])

    def _both(self, lists: list[list[int]]) -> tuple[pa.Array, pa.Array]:
        return self.decimals(lists), pa.array([self.raw(ids) for ids in lists], pa.large_binary())

    def _ids(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            found = self.id_of.get(s)
            if found is not None:
                out.append(found)
            elif self.byte:
                out += [self.byte[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def agenda(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks already."""
        rank, size = self.rank, len(text)
        symbol = list(text)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            pair = text[i:i + 2]
            if pair in rank:
                heap.append((rank[pair], i, pair))
        heapq.heapify(heap)
        while heap:
            _, left, pair = heapq.heappop(heap)
            right = after[left]
            # A pair one of whose symbols has merged since then is out of date.
            if right >= size or not symbol[left] or symbol[left] + symbol[right] != pair:
                continue
            symbol[left], symbol[right] = pair, ""
            after[left] = following = after[right]
            if following < size:
                before[following] = left
                longer = pair + symbol[following]
                if longer in rank:
                    heapq.heappush(heap, (rank[longer], left, longer))
            previous = before[left]
            if previous >= 0:
                longer = symbol[previous] + pair
                if longer in rank:
                    heapq.heappush(heap, (rank[longer], previous, longer))
        return self._ids([s for s in symbol if s])

    def _runs(self, part: str) -> list[str]:
        """No merge joins two characters that are neighbours in no piece, so a long part is cut there too."""
        if len(part) <= _SHORT:
            return [part]
        cuts = [i + 1 for i in range(len(part) - 1) if part[i:i + 2] not in self.neighbours]
        return [part[a:b] for a, b in pairwise([0, *cuts, len(part)])]

    def _merged(self, runs: list[str]) -> tuple[pa.Array, pa.Array]:
        """The ids of short runs in decimal, and what they decode to."""
        symbols, left = self.agendas.merge(runs)
        ends = np.concatenate([[0], np.cumsum(left)])
        known = len(self.agendas.symbols)
        other = symbols >= known
        chars, place = np.unique(symbols[other], return_inverse=True)
        symbols[other] = known + place
        more = self._both([self._ids([chr(i - known)]) for i in chars.tolist()])
        decimals, raw = (pa.concat_arrays(values) for values in zip(self.of_symbol, more, strict=True))
        return joined(decimals, symbols, ends, b","), joined(raw, symbols, ends, b"")

    def _parts(self, parts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The ids of every part in decimal, and what they decode to; all short runs are merged together."""
        split = {part: self._runs(part) for part in parts if len(part) > _SHORT}
        runs = set(parts).difference(split).union(*split.values())
        long = [run for run in runs if len(run) > _SHORT]
        short = sorted(runs.difference(long), key=len)
        decimals, raw = (dict(zip(long, made.to_pylist(), strict=True)) for made in self._both([self.runs[run] for run in long]))
        for i in range(0, len(short), _TOGETHER):
            some = short[i:i + _TOGETHER]
            for held, made in zip((decimals, raw), self._merged(some), strict=True):
                held.update(zip(some, made.to_pylist(), strict=True))
        for part, cut in split.items():
            decimals[part], raw[part] = b",".join([decimals[run] for run in cut]), b"".join([raw[run] for run in cut])
        out = [decimals[part] for part in parts]
        self.fresh.update(zip(parts, out, strict=True))
        return out, [raw[part] for part in parts]

    def _odd_parts(self, text: str) -> list[str]:
        """The parts of any text."""
        marked = MARK + text.replace(" ", MARK)
        return [] if not text else _PARTS.findall(marked) if self.cut else [marked]

    def _single_spaced(self, text: str) -> bool:
        """Whether the parts of a text are its words, each behind one space mark."""
        return self.cut and text != "" and not (text[0] == " " or text[-1] == " " or "  " in text or MARK in text)

    def encoded(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of every text in decimal, and what they decode to."""
        simple = [self._single_spaced(t) for t in texts]
        words = pc.split_pattern(pa.array([t for t, s in zip(texts, simple, strict=True) if s], pa.large_string()), " ")
        parts = pa.array([self._odd_parts(t) for t, s in zip(texts, simple, strict=True) if not s], pa.list_(pa.large_string()))
        by_words, by_parts = self.words.joined(words), self.parts.joined(parts)
        return [next(by_words if s else by_parts) for s in simple]

    def encode(self, text: str) -> list[int]:
        return numbers(self.encoded([text])[0][0])

    def decimals(self, lists: list[list[int]]) -> pa.Array:
        """Every list of ids in decimal."""
        ids = np.fromiter(chain.from_iterable(lists), np.int64)
        return joined(self.decimal_of, ids, np.fromiter(accumulate(map(len, lists), initial=0), np.int64), b",")

    def raw(self, ids: list[int]) -> bytes:
        return b"".join([self.raw_of[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of the pieces."""
        return readable(self.raw(ids))

    def check(self, whole: str | None = None) -> None:
        """Compares what is new since the last check, and one whole text, with the library."""
        fresh, self.fresh = self.fresh, {}
        fresh.pop(MARK, None)
        wanted = self.library.encode([part[1:].replace(MARK, " ") for part in fresh], num_threads=1) if fresh else []
        for (part, ids), want in zip(fresh.items(), self.decimals(wanted).to_pylist(), strict=True):
            if ids != want:
                raise ValueError(f"ids of {part!r} differ from the library's {want.decode()}")
        if whole is not None:
            ids = self.library.encode(whole)
            if self.encode(whole) != ids or self.decode(ids) != self.library.decode(ids):
                raise ValueError("ids of a text differ from the library's")


@lru_cache(maxsize=2)
def loaded(path: str) -> MergeModel:
    """The model of a worker process; its caches serve all tasks that the process runs."""
    return MergeModel(path)


def encode_texts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded) of every row."""
    path = model or public_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(path)
        for batch in small_batches(batches):
            texts = [t.as_py() or "" for t in batch.column(1)]
            ids = [numbers(decimals) for some in _bounded(texts) for decimals, _ in own.encoded(some)]
            own.check(texts[0] if texts else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(i) for i in ids], pa.string())],
                names=["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def _bounded(texts: list[str], size: int = _AT_ONCE) -> Iterator[list[str]]:
    """Runs of the texts, each ended by the text with which it reaches ``size`` characters."""
    held, length = [], 0
    for text in texts:
        held.append(text)
        length += len(text)
        if length >= size:
            yield held
            held, length = [], 0
    if held:
        yield held


class PackedIds:
    """Ids in 16 bits from the library, which is called once for all parts of some texts that are not remembered."""

    def __init__(self, model: MergeModel, size: int = _CACHED):
        self.model, self.size = model, size
        self.recent: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _parts(self, text: str) -> list[str]:
        """The parts of a text as the library takes them, that is without the space mark that it puts before a text."""
        if not text or not self.model.cut:
            return [text] if text else []
        words = text.split(" ")
        if MARK not in text and "" not in words:
            return words
        return [part[1:].replace(MARK, " ") for part in _PARTS.findall(MARK + text.replace(" ", MARK))]

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}H", *ids)

    def pack(self, texts: list[str]) -> list[bytes]:
        """The ids of every text."""
        split = [self._parts(t) for t in texts]
        fresh = []
        for part in set().union(*split).difference(self.recent):
            known = self.old.get(part)
            if known is None:
                fresh.append(part)
            else:
                self.recent[part] = known
        for part, ids in zip(fresh, self.model.library.encode(fresh, num_threads=1) if fresh else [], strict=True):
            # To the library an empty text has no ids; here it is a space mark alone.
            self.recent[part] = self._packed(ids if part else self.model.agenda(MARK))
        out = [b"".join(map(self.recent.__getitem__, parts)) for parts in split]
        if len(self.recent) >= self.size:
            self.old, self.recent = self.recent, {}
        return out

    def check(self, text: str) -> None:
        """Compares the ids of a text's parts with those of the whole text."""
        if self.pack([text]) != [self._packed(self.model.library.encode(text))]:
            raise ValueError("ids of a text differ from the library's")


@lru_cache(maxsize=2)
def packer(path: str) -> PackedIds:
    """As ``loaded``."""
    return PackedIds(loaded(path))


def packed_ids(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(ids) of every row as little-endian 16-bit bytes, for vocabularies of up to 65,536 pieces."""
    path = model or public_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = packer(path)
        for batch in small_batches(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            ids = [i for some in _bounded(texts) for i in own.pack(some)]
            own.check(texts[0][:_CHECKED])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    return docs.select("text").mapInArrow(run, "ids binary")


def op10_sentencepiece(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Digests of the ids and of the decoded text, taken where the ids are."""
    path = model or public_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(path)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in small_batches(batches, _ROWS):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for some in _bounded(texts, 4 * _AT_ONCE):
                for decimals, raw in own.encoded(some):
                    rows.append((decimals.count(b",") + bool(decimals), sha(decimals), sha(readable(raw).encode())))
                own.check()
            for text in texts[::512]:
                own.check(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string())))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
