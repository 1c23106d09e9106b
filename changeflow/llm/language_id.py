"""Language identification by cross-parsing entropy.

For every label a suffix automaton of sample text is built. A text is parsed into the longest phrases that
occur in the sample, once per language; the number of phrases, times the logarithm of the sample's size,
over the length of the text is an estimate of its cross entropy, and the language with the smallest wins.

The model is learned from a bounded sample: of the labelled texts with crc32(doc_id as text) mod 4 other
than 2, each label gives ``SLOTS`` texts by a hash of their ids, ``SAMPLE`` characters of each. Its size does
not depend on the input. Everything else runs over whole texts: letters fold to lower case, each letter of the
samples has a class of its own whatever the number of labels and scripts, runs of other characters fold to one gap, and texts are parsed in stretches of ``STRETCH`` characters, all stretches of an
Arrow slice and all languages side by side.

Defined results: ``und`` and score 0 where a text is null or has no letter, or where nothing could be learned;
equal estimates go to the alphabetically first label; rows may repeat; a null ``doc_id`` is not held out; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similar import small_batches

SLOTS = 64
SAMPLE = 400
STRETCH = 512
_GAP = 0


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def samples(docs: DataFrame, slots: int = SLOTS, sample: int = SAMPLE) -> dict[str, list[str]]:
    """Sample texts of every label, at most ``slots`` each: stretches of ``sample`` characters, anywhere in their texts."""
    room = F.greatest(F.length("text") - sample, F.lit(0)) + 1
    at = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), room.cast("long")).cast("int") + 1
    order = F.xxhash64(F.lit("order"), "doc_id")
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        "lang", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).alias("slot"), F.struct(
            order.alias("order"), F.substring(F.col("text"), at, F.lit(sample)).alias("text")).alias("candidate"))
    picked = rows.groupBy("lang", "slot").agg(F.min("candidate").getField("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(picked.collect()):  # at most ``slots`` short texts per label
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def letter_classes(texts: list[str]) -> np.ndarray:
    """Class of every code point: 0 for other than letters, then the letters of the texts, then all others."""
    counts = Counter(c for t in texts for c in t.lower() if c.isalpha())
    own = {c: i + 1 for i, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
    rest = len(own) + 1
    table = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            table[point] = own.get(c.lower()[0], rest)
    return table


def classes_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all texts in one array, gaps of one, and the length of each text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    found = table[points]
    ends = np.cumsum(lengths)
    begins = ends - lengths
    stays = np.ones(len(found), bool)
    stays[1:] = (found[1:] != _GAP) | (found[:-1] != _GAP)
    stays[begins[lengths > 0]] = True
    total = np.concatenate([[0], np.cumsum(stays)])
    return found[stays], total[ends] - total[begins]


class SuffixAutomaton:
    """All substrings of a sequence; every state leads on by the symbols that follow it somewhere."""

    def __init__(self, sequence: list[int]):
        self.after: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for symbol in sequence:
            state = len(self.after)
            self.after.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and symbol not in self.after[at]:
                self.after[at][symbol] = state
                at = link[at]
            if at >= 0:
                to = self.after[at][symbol]
                if length[to] == length[at] + 1:
                    link[state] = to
                else:
                    copy = len(self.after)
                    self.after.append(dict(self.after[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at >= 0 and self.after[at].get(symbol) == to:
                        self.after[at][symbol] = copy
                        at = link[at]
                    link[to] = link[state] = copy
            last = state


def _packed(steps: list[tuple[int, dict[int, int]]], states: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(base, slots) of sparse steps: the step of ``state`` by ``symbol`` lies in slot ``base[state] + symbol``.

    A slot holds its state in the upper and the next state in the lower half, or -1. The rows of the states lie
    over each other, so the size follows the number of steps, not that of symbols.
    """
    total = sum(len(after) for _, after in steps)
    size = width + 4 * total
    slots, base = np.full(size + width, -1, np.int64), np.zeros(states, np.int32)
    rng = np.random.default_rng(1)
    many = sorted((x for x in steps if len(x[1]) > 1), key=lambda x: -len(x[1]))
    guesses = iter(())
    for state, after in many:
        symbols = np.fromiter(after, np.int64, len(after))
        while True:  # three slots of four stay free, and the longest rows go first
            at = next(guesses, None)
            if at is None:
                guesses = iter(rng.integers(0, size, 1 << 16).tolist())
            elif (slots[at + symbols] < 0).all():
                break
        slots[at + symbols] = state << 32 | np.fromiter(after.values(), np.int64, len(after))
        base[state] = at
    one = np.array([(state, *step) for state, after in steps if len(after) == 1 for step in after.items()], np.int64).reshape(-1, 3)
    free = width + np.flatnonzero(slots[width:size] < 0)[:len(one)]
    slots[free] = one[:, 0] << 32 | one[:, 2]
    base[one[:, 0]] = free - one[:, 1]
    return base, slots


class Model:
    """The steps of all languages in one sparse table; where a state has no step, a phrase begins at the root of its language."""

    def __init__(self, texts: dict[str, list[str]]):
        self.labels = sorted(texts)
        self.classes = letter_classes([t for ts in texts.values() for t in ts])
        self.width = int(self.classes.max(initial=0)) + 1
        steps, weights, self.starts, states = [], [], [], 0
        self.roots = np.zeros((self.width, len(self.labels)), np.int64)
        for i, label in enumerate(self.labels):
            sequence, _ = classes_of([" ".join(texts[label])], self.classes)
            after = SuffixAutomaton(sequence.tolist()).after
            n = len(after)
            self.roots[:, i] = states + n  # state n: nothing of a phrase has been read
            for symbol, to in after[0].items():
                self.roots[symbol, i] = states + to
            steps += [(states + state, {symbol: states + to for symbol, to in own.items()})
                      for state, own in enumerate(after) if state and own]  # no step leads back to the root
            weights.append(math.log2(len(sequence) + 2))
            self.starts.append(states + n)
            states += n + 1
        self.base, self.slots = _packed(steps, states, self.width)
        self.weights = np.array(weights)

    def phrases(self, sequence: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each text by each language; texts of no length have none."""
        parts = -(-lengths // STRETCH)
        text_of = np.repeat(np.arange(len(lengths)), parts)
        if not len(text_of):
            return np.zeros((len(lengths), len(self.labels)))
        within = np.arange(len(text_of)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(np.cumsum(lengths) - lengths, parts) + within * STRETCH
        size = np.minimum(STRETCH, np.repeat(lengths, parts) - within * STRETCH)
        order = np.argsort(-size, kind="stable")
        begin, size, text_of = begin[order], size[order], text_of[order]
        state = np.tile(np.array(self.starts, np.int64), (len(size), 1))
        count = np.zeros((len(size), len(self.labels)), np.int32)
        for step in range(int(size[0])):
            alive = int(np.searchsorted(-size, -step, "left"))  # stretches longer than this step come first
            symbol = sequence[begin[:alive] + step]
            found = self.slots[self.base[state[:alive]] + symbol[:, None]]
            begins = found >> 32 != state[:alive]
            count[:alive] += begins
            state[:alive] = np.where(begins, self.roots[symbol], found & 0xFFFFFFFF)
        out = np.zeros((len(lengths), len(self.labels)))
        np.add.at(out, text_of, count)
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        sequence, lengths = classes_of(texts, self.classes)
        letters = np.concatenate([[0], np.cumsum(sequence != _GAP)])
        ends = np.cumsum(lengths)
        has = letters[ends] > letters[ends - lengths]
        entropy = self.phrases(sequence, lengths) * self.weights / np.maximum(lengths, 1)[:, None]
        out = []
        for row, known in zip(entropy, has, strict=True):
            if not known or not self.labels:
                out.append(("und", 0.0))
                continue
            best = int(np.argmin(row))
            others = np.delete(row, best)
            out.append((self.labels[best], float(1 - row[best] / others.min()) if len(others) else 1.0))
        return out


def op3_language_id(docs: DataFrame) -> DataFrame:
    model = Model(samples(docs.select("doc_id", "text", "lang")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small_batches(batches, 1024):
            found = own.predict([t.as_py() or "" for t in batch.column(2)])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
