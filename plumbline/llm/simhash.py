"""Near duplicates by SimHash, compared bit plane by bit plane."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import jaccard
from plumbline.llm.common import stored
from plumbline.llm.graph import components

SEED = 42
#: Fingerprints link at so many differing bits or fewer.
RADIUS = 4
#: Fingerprints of one unit of comparison: a larger bucket is dealt out as pairs of parts.
PART = 4096
#: (query, plane word) items compared at a time.
ITEMS = 1 << 16
#: Aim for the mean number of fingerprints that share a candidate key: a word of lanes.
MEAN_BUCKET = 64

FP_SCHEMA = "doc_id bigint, fp bigint"


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words in lower case (repeats included); a shorter text is one run."""
    words = text.lower().split()  # of bytes: A-Z only, and the six white space bytes
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)] if words else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-width])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())),
                       np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """Bit j is set if it is set in over half of the hashes."""
    if len(hashes) < 2:
        return int(hashes.sum())
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int) -> int:
    """Of the shingle hashes, repeats included."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``; text may be null (fingerprint zero)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or b"", width) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")).mapInArrow(run, FP_SCHEMA)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows; bit i of a row's words is that bit of the i-th fingerprint (count divisible by 64)."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _add(a, b, c):
    """Carry-save addition of three bit vectors: sum and carry."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _over(ones, twos, fours, radius: int):
    """Lanes whose three-bit counter exceeds the radius (0 to 7)."""
    over, same = np.zeros_like(ones), ~np.zeros_like(ones)
    for plane, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            same = same & plane
        else:
            over |= same & plane
            same = same & ~plane
    return over


def close_lanes(planes: np.ndarray, queries: np.ndarray, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For item i, the lanes of plane word ``words[i]`` within ``radius`` of ``queries[i]``:
    indices of the items that have any, and their 64-bit lane masks.

    Eight planes at a time go through carry-save adders into three counter planes for all
    64 lanes of a word at once; an item is abandoned when all its lanes exceed the radius.
    """
    left = np.arange(len(words))
    ones = np.zeros(len(words), np.uint64)
    twos, fours, dead = ones.copy(), ones.copy(), ones.copy()
    zero, full = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)
    for first in range(0, 64, 8):
        x = []
        for j in range(first, first + 8):
            wanted = (queries[left] >> np.uint64(j)) & np.uint64(1)
            x.append(planes[j, words[left]] ^ (zero - wanted))
        ones, a = _add(ones, x[0], x[1])
        ones, b = _add(ones, x[2], x[3])
        twos, p = _add(twos, a, b)
        ones, a = _add(ones, x[4], x[5])
        ones, b = _add(ones, x[6], x[7])
        twos, q = _add(twos, a, b)
        fours, eights = _add(fours, p, q)
        dead |= eights | _over(ones, twos, fours, radius)
        keep = dead != full
        if not keep.all():
            left, ones, twos, fours, dead = left[keep], ones[keep], twos[keep], fours[keep], dead[keep]
    return left, ~dead


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i[k] with j[k] for every k; labels point at smaller or equal places."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def close_places(fps: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all fingerprints within ``radius`` of each other in each group (``starts``:
    first places, ending with the length), each pair once or twice, by parts."""
    sizes = np.diff(starts)
    n_words = -(-sizes // 64)
    word_start = np.concatenate(([0], np.cumsum(n_words)))
    group = np.repeat(np.arange(len(sizes)), sizes)
    lane = 64 * word_start[group] + np.arange(len(fps)) - starts[group]
    padded = np.zeros(64 * word_start[-1], np.uint64)
    padded[lane] = fps
    place = np.full(len(padded), -1)
    place[lane] = np.arange(len(fps))
    used = np.packbits(place >= 0, bitorder="little").view(np.uint64)
    planes = bit_planes(padded)
    own = lane // 64
    counts = word_start[group + 1] - own  # each is compared with its own word and those after
    at = 0
    while at < len(fps):
        to = int(np.searchsorted(np.cumsum(counts[at:]), ITEMS)) + at + 1
        rows = np.repeat(np.arange(at, min(to, len(fps))), counts[at:to])
        first = np.repeat(np.cumsum(counts[at:to]) - counts[at:to], counts[at:to])
        words = own[rows] + np.arange(len(rows)) - first
        item, mask = close_lanes(planes, fps[rows], words, radius)
        mask = mask & used[words[item]]
        hit = mask != 0
        item, mask = item[hit], mask[hit]
        bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, bit = np.nonzero(bits)
        yield rows[item[k]], place[64 * words[item[k]] + bit]
        at = to


def group_links(fps: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within ``radius`` in each group. One link for each
    fingerprint but the first of its component."""
    label = np.arange(len(fps))
    for i, j in close_places(fps, starts, radius):
        label = merge_labels(label, i, j)
    other = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[other], fps[label[other]]


def closest_pairs(fps: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each group every fingerprint with the one closest to it, if within ``radius``."""
    none = np.iinfo(np.int64).max
    best = np.full(len(fps), none)  # distance, then place
    for i, j in close_places(fps, starts, radius):
        i, j = i[i != j], j[i != j]
        far = np.bitwise_count(fps[i] ^ fps[j]).astype(np.int64) << 32
        np.minimum.at(best, j, far | i)
        np.minimum.at(best, i, far | j)
    own = np.nonzero(best != none)[0]
    x, y = fps[own], fps[best[own] & 0xFFFFFFFF]
    return np.minimum(x, y), np.maximum(x, y)


def apart_pairs(fps: np.ndarray, label: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each group all pairs within ``radius`` whose labels differ, by parts: fp, label, fp, label."""
    for i, j in close_places(fps, starts, radius):
        differ = label[i] != label[j]
        i, j = i[differ], j[differ]
        swap = (fps[i] > fps[j]) | ((fps[i] == fps[j]) & (label[i] > label[j]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        i, j = np.divmod(np.unique(i * len(fps) + j), len(fps))
        yield fps[i], label[i], fps[j], label[j]


def _masks(blocks: int, shared: int) -> list[int]:
    """Masks of every choice of ``shared`` among ``blocks`` nearly equal runs of the 64 bits."""
    cuts = [64 * b // blocks for b in range(blocks + 1)]
    run = [((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in range(blocks)]
    return [sum(run[b] for b in chosen) for chosen in combinations(range(blocks), shared)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def candidate_masks(count: int, radius: int) -> list[int]:
    """Two fingerprints within the radius agree on all bits of at least one mask.

    Cutting the bits in radius + s runs leaves s of them untouched; more runs give more,
    longer keys. s follows the number of fingerprints, so that buckets stay short at any
    size; every choice finds every link.
    """
    for shared in range(1, 5):
        bits = 64 * shared // (radius + shared)
        if count / 2.0 ** bits <= MEAN_BUCKET:
            break
    return _masks(radius + shared, shared)


def _met(rows: DataFrame, radius: int, of_groups: Callable[..., Iterator[tuple[np.ndarray, ...]]], out: list[str]) -> DataFrame:
    """What ``of_groups`` finds among distinct ``rows`` (fp, maybe more numbers), group by group: bigints ``out``.

    Fingerprints meet under candidate keys. A bucket of over PART of them is dealt out as
    all pairs of its parts, so a task compares at most two parts at a time.
    """
    own = rows.columns
    masks = candidate_masks(rows.count(), radius)
    keyed = rows.select(*own, F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / PART).cast("int"))
    part = F.pmod(F.xxhash64(*own), F.col("parts")).cast("int")
    units = (keyed.join(sizes, ["t", "key"]).withColumn("part", part)
             .select(*own, "t", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
             .select(*own, "t", "key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")))
    n = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((n + 4, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.array([c.to_numpy() for c in batch.columns], np.int64)], axis=1)
            cut = np.nonzero((rows[n:, 1:] != rows[n:, :-1]).any(axis=0))[0] + 1
            if not len(cut):
                rest = rows
                continue
            rest = rows[:, cut[-1]:]
            yield from found(rows[:n, :cut[-1]], np.concatenate(([0], cut)))
        if rest.shape[1]:
            yield from found(rest[:n], np.array([0, rest.shape[1]]))

    def found(ids: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for columns in of_groups(np.ascontiguousarray(ids[0]).view(np.uint64), *ids[1:], starts, radius):
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], out)

    keys = ["t", "key", "a", "b"]
    return (units.select(*own, *[F.col(k).cast("bigint") for k in keys]).repartition(*keys)
            .sortWithinPartitions(*keys).mapInArrow(run, ", ".join(f"{c} bigint" for c in out)).distinct())


def fingerprint_links(fps: DataFrame, radius: int,
                      of_groups: Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]] = group_links) -> DataFrame:
    """(u, v) links among distinct fingerprints (column fp) that connect exactly what
    pairs within ``radius`` bits connect; with ``closest_pairs`` only pairs that are so close."""
    return _met(fps, radius, lambda *group: iter([of_groups(*group)]), ["u", "v"])


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = RADIUS) -> DataFrame:
    """SimHash near-duplicate classes of ``docs`` (doc_id, text; other columns are ignored).

    Returns one row per input row: doc_id, fingerprint (16 hex digits), component_id, the
    smallest doc_id reachable over links of at most ``radius`` differing bits.

    Null or empty texts have fingerprint zero and link like any other. Equal fingerprints
    always link. Repeated rows give repeated rows. A null doc_id is kept and never chosen
    as a class's smallest; a class with no other id has a null component_id. An empty
    table gives an empty result.
    """
    fps = stored(fingerprints(docs, width))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(named)
    smallest = stored(named.groupBy("root").agg(F.min("least").alias("component_id")))  # so that the join can be split
    of_fp = named.join(smallest, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def close_sets(members: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): keys of ``members`` (key, fp) whose fingerprints are equal or, the closest of them in
    some bucket, within ``radius``. A fingerprint of several keys meets others by its least key."""
    least = stored(members.groupBy("fp").agg(F.min("key").alias("u")))
    equal = members.join(least, "fp").where("u < key").select("u", F.col("key").alias("v"))
    side = lambda fp, key: least.select(F.col("fp").alias(fp), F.col("u").alias(key))
    near = (fingerprint_links(least.select("fp"), radius, closest_pairs).toDF("a", "b")
            .join(side("a", "x"), "a").join(side("b", "y"), "b"))
    return equal.union(near.select(F.least("x", "y"), F.greatest("x", "y")))


def apart_sets(members: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): all keys of ``members`` (key, fp, label) whose fingerprints are equal or within
    ``radius`` and whose labels differ."""
    points = stored(members.select("fp", "label").distinct())
    met = stored(_met(points, radius, apart_pairs, ["fp", "label", "other_fp", "other_label"]))
    one = members.select("fp", "label", F.col("key").alias("u"))
    return met.join(one, ["fp", "label"]).join(one.toDF("other_fp", "other_label", "v"), ["other_fp", "other_label"]).select("u", "v")


def deduplicated(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` without near copies (see jaccard.deduplicated): every two sets of shingles whose
    fingerprints lie within RADIUS are of one class already, by the closest ones of each, or are
    compared as sets; and the sets whose fingerprints lie farther apart meet by their rarest
    shingles, so that no link is lost."""
    return jaccard.deduplicated(docs, width, majority, (close_sets, apart_sets))
