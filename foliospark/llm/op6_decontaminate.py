"""Benchmark decontamination by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import mix
from ._registry import query, table

Q = 8
#: Edits allowed per character of an item.
EDIT_RATE = 0.1
#: Characters of benchmark text that one scan of the documents looks for.
BLOCK_CHARS = 2_000_000
_PIECE = 1 << 16
_FILTER_BITS = 22
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _letter_table() -> np.ndarray:
    """Lower-case form of every letter and digit of the basic plane, 32 for all other characters."""
    out = np.full(1 << 16, 32, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_LETTERS = _letter_table()


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits in lower case with one space between words, and where each stood in the text."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.where(raw < 1 << 16, _LETTERS[np.minimum(raw, (1 << 16) - 1)], raw)
    gap = chars == 32
    stay = ~gap
    stay[1:] |= gap[1:] & ~gap[:-1]
    at = np.flatnonzero(stay)
    return chars[at], at


def grams(chars: np.ndarray) -> np.ndarray:
    """A polynomial of each run of Q characters, by doubling: runs of 2, 4 and 8 from two of half the length."""
    if chars.size < Q:
        return np.empty(0, np.uint64)
    out, width, base = chars.astype(np.uint64), 1, _BASE
    while width < Q:
        out = out[:-width] * base + out[width:]
        width, base = 2 * width, np.multiply(base, base)
    return out


def _cells(found: np.ndarray) -> np.ndarray:
    """Cell of the filter for each gram: the top bits of one more product; survivors alone are mixed."""
    return (found * _SPREAD) >> np.uint64(64 - _FILTER_BITS)


class Index:
    """Q-grams of the items of one block, with the edit budget and the count bound of each."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.chars = [], []
        for i, text in items:
            chars = normalise(text)[0]
            chars = chars[1:] if chars.size and chars[0] == 32 else chars
            chars = chars[:-1] if chars.size and chars[-1] == 32 else chars
            if chars.size:
                self.ids.append(i)
                self.chars.append(chars)
        sizes = np.array([c.size for c in self.chars], np.int64)
        # The lemma must ask for one shared gram at least.
        self.budget = np.clip(np.minimum((sizes * EDIT_RATE).astype(np.int64), (sizes - Q) // Q), 0, None)
        self.bound = np.maximum(1, sizes + 1 - Q - Q * self.budget)
        self.longest = int(sizes.max(initial=0))
        self.short = [k for k, n in enumerate(sizes) if n < Q]
        per_item = [grams(c) for c in self.chars]
        found = np.concatenate(per_item) if per_item else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(per_item)), [g.size for g in per_item]).astype(np.int64)
        place = np.concatenate([np.arange(g.size) for g in per_item]) if per_item else np.empty(0, np.int64)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[_cells(found)] = True
        found = mix(found)
        order = np.argsort(found, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(found[order], return_index=True, return_counts=True)

    def hits(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where grams of ``chars`` stand that an item has: position, item and place in the item of each pair."""
        found = grams(chars)
        at = np.flatnonzero(self.maybe[_cells(found)])
        if not at.size or not self.keys.size:
            return (np.empty(0, np.int64),) * 3
        seen = mix(found[at])
        slot = np.minimum(np.searchsorted(self.keys, seen), self.keys.size - 1)
        same = self.keys[slot] == seen
        at, slot = at[same], slot[same]
        many = self.count[slot]
        hit = np.repeat(self.first[slot] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
        return np.repeat(at, many), self.item[hit], self.place[hit]

    def suspects(self, texts: list[str]) -> np.ndarray:
        """Which texts, seen together, hold as many grams of some item as an occurrence has; none with one is missed."""
        if self.short or not len(self.ids):
            return np.full(len(texts), bool(self.ids))
        chars, at = normalise("\n".join(texts))
        begin = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        where, item, _ = self.hits(chars)
        text = np.searchsorted(begin, at[where], "right") - 1
        group, counts = np.unique(text * len(self.ids) + item, return_counts=True)
        out = np.zeros(len(texts), bool)
        out[group[counts >= self.bound[group % len(self.ids)]] // len(self.ids)] = True
        return out

    def regions(self, chars: np.ndarray) -> list[tuple[int, int]]:
        """``(item, first diagonal)`` of the bands that hold enough different q-grams of an item.

        An occurrence with at most ``budget`` edits keeps all but Q grams per
        edit, on diagonals no farther apart than the budget. Bands of twice
        that width, each overlapping half of the next, hold every such range.
        """
        where, item, place = self.hits(chars)
        enough = (np.bincount(item, minlength=len(self.ids)) >= self.bound)[item] if item.size else np.empty(0, bool)
        if not enough.any():
            return []
        where, item, place = where[enough], item[enough], place[enough]
        width = self.budget[item] + 1
        diagonal = where - place + self.longest
        band = diagonal // width + 1
        bands = int(band.max()) + 1
        key = ((item * bands + band) * (self.longest + 1)) + place
        key = np.unique(np.concatenate([key, key - (self.longest + 1)]))
        group, counts = np.unique(key // (self.longest + 1), return_counts=True)
        good = counts >= self.bound[group // bands]
        return [(int(g // bands), int((g % bands - 1) * (self.budget[g // bands] + 1)) - self.longest) for g in group[good]]

    def align(self, item: int, chars: np.ndarray, low: int) -> tuple[int, int, int] | None:
        """Edits, start and end of the best occurrence of an item on the diagonals of a band from ``low``."""
        pattern, budget = self.chars[item], int(self.budget[item])
        end = banded(pattern, chars, low, 2 * (budget + 1), budget)
        if end is None:
            return None
        edits, stop = end
        # Backwards from the end, to find the start.
        flipped = chars[max(0, stop - pattern.size - budget) : stop][::-1]
        back = banded(pattern[::-1], flipped, -budget, 2 * budget + 1, budget, anchored=True)
        return edits, stop - (back[1] if back else pattern.size), stop


def banded(pattern, chars, low: int, width: int, budget: int, anchored: bool = False) -> tuple[int, int] | None:
    """Fewest edits of ``pattern`` in ``chars`` on ``width`` diagonals from ``low``, and where it ends.

    The row of a pattern character is one array over the diagonals. Text
    before the occurrence is free unless ``anchored`` at the start.
    """
    m = pattern.size
    padded = np.zeros(m + width, np.uint32)
    first, last = max(0, low), min(chars.size, low + m + width)
    if last > first:
        padded[first - low : last - low] = chars[first:last]
    steps = np.arange(width)
    row = np.where(steps + low >= 0, steps + low, 1 << 20) if anchored else np.where(
        (steps + low >= 0) & (steps + low <= chars.size), 0, 1 << 20
    )
    for j in range(m):
        step = row + (padded[j : j + width] != pattern[j])
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - steps) + steps
        if row.min() > budget:
            return None
    ends = low + m + steps
    row = np.where((ends >= 0) & (ends <= chars.size), row, 1 << 20)
    best = int(row.argmin())
    return (int(row[best]), int(ends[best])) if row[best] <= budget else None


def occurrences(index: Index, text: str) -> list[tuple[int, int, int, int]]:
    """``(item, start, end, edits)`` of the benchmark items in a text, in code points of the text."""
    chars, at = normalise(text)
    found = {}
    lap = 2 * index.longest + 2 * Q
    for start in range(0, max(1, chars.size), _PIECE):
        piece = chars[start : start + _PIECE + lap]
        for item, low in index.regions(piece):
            hit = index.align(item, piece, low)
            if hit and hit[2] > hit[1]:
                spot = (item, start + hit[2])
                found[spot] = min(found.get(spot, (1 << 30, 0)), (hit[0], start + hit[1]))
        if piece.size < _PIECE + lap:
            break
    out = []
    for (item, end), (edits, begin) in sorted(found.items()):
        # Of overlapping occurrences of an item, the one with the fewest edits.
        if out and out[-1][0] == item and begin < out[-1][2]:
            if edits < out[-1][3]:
                out[-1] = (item, begin, end, edits)
            continue
        out.append((item, begin, end, edits))
    if index.short:
        plain = f" {''.join(map(chr, chars))} "
        for k in index.short:
            word = f" {''.join(map(chr, index.chars[k]))} "
            spot = plain.find(word)
            while spot >= 0:
                out.append((k, spot, spot + len(word) - 2, 0))
                spot = plain.find(word, spot + len(word) - 1)  # the space behind may be the one before the next
    return [
        (index.ids[k], int(at[min(b, at.size - 1)]), int(at[min(e, at.size) - 1]) + 1, edits) for k, b, e, edits in out
    ]


def found_in(index: Index, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """``(number, occurrences)`` of the texts that hold any; texts are filtered some together."""
    held, size = [], 0
    for k, text in enumerate([*texts, None]):
        if text:
            held.append(k)
            size += len(text)
        if held and (size >= _PIECE or k == len(texts)):
            for n, some in zip(held, index.suspects([texts[i] for i in held]), strict=True):
                if some and (hits := occurrences(index, texts[n])):
                    yield n, hits
            held, size = [], 0


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Occurrences of benchmark items in documents: ``doc_id, item_id, start, end, edits``.

    Texts are compared by letters and digits in lower case, with one space for
    whatever stands between words; positions are code points of the text as it
    is. An item occurs where at most a tenth of its characters need an edit,
    items shorter than a q-gram wherever they stand as whole words. Of
    overlapping occurrences of one item the one with the fewest edits counts,
    of equal ones the first to end; different items may overlap. Null or empty
    texts and items without a letter or digit match nothing. Repeated rows
    each give their own matches; rows without an id have null there.

    The benchmark is read in blocks of a bounded number of characters, each of
    which one scan of the documents looks for; nothing is shuffled.
    """
    out = None
    for index in _indexes(benchmark):

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                rows = [(ids[k].as_py(), *hit) for k, hits in found_in(index, batch.column("text").to_pylist()) for hit in hits]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start", "end", "edits"]
                )

        found = docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, item_id long, start long, end long, edits long")
        out = found if out is None else out.unionByName(found)
    return out


def _indexes(benchmark: DataFrame) -> Iterator[Index]:
    items = benchmark.select("item_id", "text").filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield Index(sorted(((r["item_id"], r["text"]) for r in part.distinct().collect()), key=str))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no benchmark item occurs, by the rules of ``leaks``."""
    for index in _indexes(benchmark):

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[k for k, _ in found_in(index, batch.column("text").to_pylist())]] = False
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


@query("op6_decontaminate")
def op6_decontaminate(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
