"""Benchmark decontamination: pigeonhole pieces, verified by bit-parallel edit distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import flat, sent, slices, stored

#: Word edits (insert, delete, replace) allowed, as a share of a test item's words.
ERROR_RATE = 0.2
#: Test items of fewer words are searched without edits: any edit would leave little of them.
EXACT_WORDS = 8
#: Fixed value: scripts written without spaces, in which each letter counts as a word.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: Fixed value: blocks that hold all of these letters (and others); most texts are passed over by this cheaper test.
UNSPACED_BLOCKS = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u19ff\u2e80-\ufaff\uff66-\uff9d\x{16fe0}-\x{3ffff}]"
#: Words of test items that one pass over the documents carries to every task.
PASS_WORDS = 2_000_000
#: Array values handled at a time.
CHUNK = 1 << 19

MATCH_SCHEMA = "doc_id bigint, item_id bigint, distance int, first_word int, end_word int, n_words int"


def match_words(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits, letters of scripts without
    spaces one by one; none for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    spaced = F.when(low.rlike(UNSPACED_BLOCKS), F.regexp_replace(low, f"({UNSPACED})", " $1 ")).otherwise(low)
    runs = F.array_remove(F.split(spaced, r"[^\p{L}\p{N}]+"), "")
    return F.transform(runs, lambda w: F.xxhash64(w))


def budget(n: int, rate: float) -> int:
    """Edits allowed in an item of n words."""
    return int(n * rate) if n >= EXACT_WORDS else 0


def pieces(n: int, rate: float) -> list[tuple[int, int]]:
    """Start and length of the (error budget + 1) pieces of an item of n words. An
    occurrence with that many errors at most leaves one piece untouched."""
    parts = budget(n, rate) + 1
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` consecutive values."""
    out = np.zeros(max(0, len(values) - width + 1), np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + values[k:k + len(out)]
        out ^= out >> np.uint64(29)
    return out


def myers(item: list[int], text: list[int], most: int) -> list[tuple[int, int]]:
    """(end, distance) wherever the item ends in the text with at most ``most`` edits.

    One bit of a Python integer per item word, so that any item length works.
    """
    m = len(item)
    peq: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        peq[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    found = []
    for end, w in enumerate(text, 1):
        eq = peq.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right = down | (full & ~(diagonal | up))
        left = up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = (right << 1) & full
        left = (left << 1) & full
        up = left | (full & ~(diagonal | right))
        down = right & diagonal
        if score <= most:
            found.append((end, score))
    return found


def best_match(item: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """Fewest edits (first such end, longest such start) and the words start..end of it."""
    ends = myers(item, text, most)
    if not ends:
        return None
    distance = min(d for _, d in ends)
    end = next(e for e, d in ends if d == distance)
    back = myers(item[::-1], text[:end][::-1], distance)
    length = min((n for n, d in back if d == distance), key=lambda n: (abs(n - len(item)), n))
    return distance, end - length, end


class Index:
    """Pieces of the test items, by length and hash of their first words."""

    def __init__(self, items: list[tuple[int, np.ndarray]], rate: float):
        self.items = [(i, w.tolist(), budget(len(w), rate)) for i, w in items]
        by_width = defaultdict(list)
        for k, (_, words) in enumerate(items):
            cut = pieces(len(words), rate)
            width = min(n for _, n in cut)
            for start, _ in cut:
                by_width[width].append((int(rolling(words[start:start + width], width)[0]), k, start))
        self.tables = []
        for width, rows in by_width.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            bits = max(16, int(len(keys) * 64).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables.append((width, keys, np.array([r[1:] for r in rows]), bits, seen))

    def search(self, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, distance, start, end): the best match of each item in each row."""
        windows = defaultdict(list)
        for width, keys, rows, bits, seen in self.tables:
            h = rolling(words, width)
            at = np.nonzero(seen[(h >> np.uint64(64 - bits)).astype(np.int64)])[0]
            first = np.searchsorted(keys, h[at], side="left")
            last = np.searchsorted(keys, h[at], side="right")
            row = np.searchsorted(offsets, at, side="right") - 1
            inside = (last > first) & (at + width <= offsets[row + 1])
            for p, r, a, b in zip(at[inside].tolist(), row[inside].tolist(), first[inside].tolist(), last[inside].tolist()):
                for k, start in rows[a:b].tolist():
                    n, most = len(self.items[k][1]), self.items[k][2]
                    low = p - start - most
                    windows[r, k].append((max(low, int(offsets[r])), min(low + n + 2 * most, int(offsets[r + 1]))))
        for (r, k), spans in windows.items():
            item_id, item, most = self.items[k]
            best = None
            for a, b in merged(spans):
                if found := best_match(item, words[a:b].tolist(), most):
                    d, s, e = found
                    shift = a - int(offsets[r])
                    best = min(best or (d, s + shift, e + shift), (d, s + shift, e + shift))
            if best:
                yield r, item_id, *best


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping windows joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_items(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, pass_words: int = PASS_WORDS) -> DataFrame:
    """Occurrences of test items (item_id, text) in documents (doc_id, text), with word
    edits up to ``rate`` of the item's words. Other columns are ignored.

    One row for each document and item found there, with the fewest edits and the place
    (first and end word, counted in runs of letters and digits). Items of under EXACT_WORDS
    words are found only as they stand.

    Items equal in their words are searched once. They travel to the tasks in passes of at
    most about ``pass_words`` words each (an item is never cut), so what is broadcast stays
    bounded however many items there are. The documents are scanned where they lie; only
    what is found is shuffled, to name its items. Null texts and texts without a letter or
    digit, of documents or items, match nothing. Items without an id are found like others
    (null item_id). Repeated documents or items give repeated rows.
    """
    spark = docs.sparkSession
    ready = items.select(F.col("item_id").cast("bigint").alias("item_id"), match_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    ready = stored(ready.withColumn("key", F.xxhash64("words")))
    distinct = ready.groupBy("key").agg(F.first("words").alias("words"))
    total = distinct.agg(F.sum(F.size("words"))).first()[0] or 0
    passes = total // pass_words + 1
    found = []
    searched = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), match_words(F.col("text")).alias("words"))
    for k in range(passes):
        # a pass holds the items of one hash class
        part = distinct.where(F.pmod("key", F.lit(passes)) == k).orderBy("key")
        rows = [(r.key, np.array(r.words, np.int64).view(np.uint64)) for r in part.toLocalIterator()]
        index = sent(spark, Index(rows, rate))
        found.append(searched.mapInArrow(_searcher(index), MATCH_SCHEMA.replace("item_id", "key")))
    hits = reduce(DataFrame.union, found)
    return hits.join(ready.select("key", "item_id"), "key").select(*[c.split()[0] for c in MATCH_SCHEMA.split(", ")])


def _searcher(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index()
        for batch in slices(batches, "words", CHUNK):
            words, offsets = flat(batch.column("words"))
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[r], item, d, a, b, int(offsets[r + 1] - offsets[r]))
                    for r, item, d, a, b in found.search(words.view(np.uint64), offsets)]
            names = ["doc_id", "key", "distance", "first_word", "end_word", "n_words"]
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
    return run


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` (all columns) without the documents that hold a test item. Documents
    without a doc_id are judged like all others: they go by their text."""
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text"))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), F.col("doc_id").isNull().alias("unnamed"))
    named, unnamed = rows.where("NOT unnamed"), rows.where("unnamed")

    def clean(part: DataFrame) -> DataFrame:
        hits = find_items(part.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), items)
        return part.join(hits.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")

    return clean(named).union(clean(unnamed))
