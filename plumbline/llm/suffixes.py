"""Repeated byte strings by block-wise suffix sorting with a difference cover.

Suffix buckets are the windows of one anchor at one distance from it, so bucket mates have
the anchor's bytes in common and differ elsewhere if at all. Blocks of whole buckets are
sorted one at a time: by the first eight bytes, then, for the long ties, by the rank of the
next cover place. Cover places are those whose distance from the anchor is, modulo
COVER, in a difference cover; their ranks (by RANKED bytes) are worked out once per block.
Only a quarter of the places is ranked at depth, and a block's size bounds memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.repeats import HOT_PARTS, PATH_BITS, Chunk, Kind, removals
from plumbline.llm.windows import RunHashes, mixed, spread

WINDOW_BYTES = 100
#: Bytes of an anchor.
ANCHOR_BYTES = 20
#: The cover's modulus and step: every difference modulo COVER is one of two of its members.
COVER, STEP = 64, 8
#: Bytes of a block of suffix buckets, but for a single larger bucket.
BLOCK_BYTES = 1 << 20

SUFFIX_SCHEMA = "anchor bigint, salt int, doc bigint, place bigint, shift int, at int, content binary"
RESULT_SCHEMA = ("doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<first_byte:int,end_byte:int>>, kept binary")

_SECOND = np.uint64(0xA0761D6478BD642F)  # odd
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.cumsum([0, *map(len, texts)]).astype(np.int64)
    return _BYTES[np.frombuffer(b"".join(texts), np.uint8)], offsets


def difference_cover() -> np.ndarray:
    """The residues 0 .. STEP - 1 and all multiples of STEP: d = STEP * ceil(d / STEP) - r."""
    return np.union1d(np.arange(STEP), np.arange(0, COVER, STEP))


#: From each residue to the next cover place, below STEP.
_NEXT = np.array([min((c - r) % COVER for c in difference_cover()) for r in range(COVER)])


def eights(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a big-endian number (zeros past the end)."""
    long = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= long[k:k + len(data)] << np.uint64(56 - 8 * k)
    return out


def equal_ranks(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys (most significant first), and the rank of each item among distinct ones."""
    by = np.lexsort(keys[::-1])
    new = np.zeros(len(by), np.int64)
    for k in keys:
        s = k[by]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new)
    return by, rank


def repeated_windows(contents: list[bytes], at: np.ndarray, group: np.ndarray, order: list[np.ndarray], width: int):
    """For each window of each content, whether an equal one of its group comes before it.

    ``at``: the anchor's place in each content. ``order``: arrays, per content, by which
    contents come (most significant first); windows of a content come by place.
    Returns content, place and verdict of all windows, in turn.
    """
    sizes = np.array([len(c) for c in contents], np.int64)
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contents), np.uint8)
    head = eights(data)
    anchor = base + at
    ranked = width - STEP
    # ranks of cover places
    rows = np.repeat(np.arange(len(sizes)), np.maximum(sizes - ranked + 1, 0))
    place = spread(base, np.maximum(sizes - ranked + 1, 0))
    covered = _NEXT[(place - anchor[rows]) % COVER] == 0
    place = place[covered]
    depth = [*range(0, ranked - 8, 8), ranked - 8]
    rank_at = np.zeros(len(data) + 1, np.int64)
    if len(place):
        rank_at[place] = equal_ranks([head[place + d] for d in depth])[1]
    # buckets of suffixes
    counts = np.maximum(sizes - width + 1, 0)
    row, start = np.repeat(np.arange(len(sizes)), counts), spread(base, counts)
    away = start - anchor[row]
    cover = start + _NEXT[away % COVER]
    keys = [group[row], away, head[start], rank_at[cover], head[start + width - 8]]
    by = np.lexsort([start, *(o[row] for o in order[::-1]), *keys[::-1]])
    same = np.ones(max(0, len(by) - 1), bool)
    for k in keys:
        s = k[by]
        same &= s[1:] == s[:-1]
    repeated = np.zeros(len(by), bool)
    repeated[by[1:]] = same
    return row, start - base[row], repeated


def _hot_windows(c: Chunk, hot: np.ndarray, width: int):
    """Windows of hot anchors' distinct paths: path, place, hash, and whether an equal one
    comes earlier in this chunk."""
    own = np.nonzero((c.lead == np.arange(len(c.lead))) & np.isin(c.anchor.view(np.int64), hot))[0]
    start, path = spread(c.first[own], c.count[own]), np.repeat(own, c.count[own])
    one = RunHashes(c.symbols).of(start, start + width)
    two = RunHashes(mixed(c.symbols), _SECOND).of(start, start + width)
    by = np.lexsort((start, path, c.order[path], two, one))
    later = np.zeros(len(by), bool)
    later[by[1:]] = (one[by[1:]] == one[by[:-1]]) & (two[by[1:]] == two[by[:-1]])
    return path, start, one, later


def _repeats_here(c: Chunk, hot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of hot anchors that the chunk itself shows to be repeats: they are not sent."""
    if not len(hot) or not len(c.lead):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, start, _, later = _hot_windows(c, hot, width)
    return start[later], start[later] + 1


def _suffixes(c: Chunk, open_paths: np.ndarray, hot: np.ndarray, width: int) -> pa.RecordBatch | None:
    """Bytes of open paths. Paths of hot anchors come window by window, each distinct window
    once per chunk, dealt by the window's hash."""
    if not len(open_paths):
        return None
    is_hot = np.isin(c.anchor[open_paths].view(np.int64), hot)
    path = open_paths[~is_hot]
    start, length, salt = c.first[path], c.count[path] + width - 1, np.zeros(len(path), np.int64)
    if is_hot.any():
        of, at, dealt, later = _hot_windows(c, hot, width)
        sent = ~later & np.isin(of, open_paths)
        path, start = np.concatenate([path, of[sent]]), np.concatenate([start, at[sent]])
        length = np.concatenate([length, np.full(int(sent.sum()), width)])
        salt = np.concatenate([salt, 1 + (dealt[sent] & np.uint64(HOT_PARTS - 1)).astype(np.int64)])
    raw = b"".join(c.texts)
    contents = [raw[a:a + n] for a, n in zip(start.tolist(), length.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(c.anchor[path].view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(c.order[path]), pa.array((c.number << PATH_BITS) + path),
         pa.array((start - c.first[path]).astype(np.int32)), pa.array((c.place_of_anchor[path] - start).astype(np.int32)), pa.array(contents, pa.binary())],
        ["anchor", "salt", "doc", "place", "shift", "at", "content"])


def _settle(t: pa.Table, width: int) -> pa.RecordBatch:
    anchor, salt, doc, place, shift, at = (t.column(i).to_numpy() for i in range(6))
    contents = t.column("content").to_pylist()
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])
    group = np.cumsum(new) - 1
    ends = np.cumsum([len(c) for c in contents])
    out = []
    low = 0
    while low < len(contents):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK_BYTES, side="right"))
        high = int(np.searchsorted(group, group[max(high - 1, low)], side="right" if high <= low + 1 or group[high - 1] == group[low] else "left"))
        part = slice(low, high)
        row, start, repeated = repeated_windows(contents[part], at[part].astype(np.int64), group[part], [doc[part], place[part], shift[part]], width)
        row, start = row[repeated] + low, start[repeated]
        cut = np.ones(len(row), bool)
        cut[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
        last = np.concatenate((np.nonzero(cut)[0][1:] - 1, [len(row) - 1])).astype(np.int64) if len(row) else np.zeros(0, np.int64)
        out.append((row[cut], start[cut], start[last] + 1))
        low = high
    row, first, last = (np.concatenate(x) for x in zip(*out))
    return pa.RecordBatch.from_arrays(
        [pa.array(place[row] >> PATH_BITS), pa.array((place[row] & ((1 << PATH_BITS) - 1)).astype(np.int32)),
         pa.array((shift[row] + first).astype(np.int32)), pa.array((shift[row] + last).astype(np.int32))], ["chunk", "path", "first", "last"])


def _documents(c: Chunk, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    doc = np.searchsorted(c.offsets, start, side="right") - 1
    low, high = np.searchsorted(doc, np.arange(len(c.texts)), "left"), np.searchsorted(doc, np.arange(len(c.texts)), "right")
    removed, spans, kept = [], [], []
    for d, text in enumerate(c.texts):
        base, at, pieces = int(c.offsets[d]), 0, []
        runs = [(int(a) - base, int(b) - base) for a, b in zip(start[low[d]:high[d]], end[low[d]:high[d]])]
        for a, b in runs:
            pieces.append(text[at:a])
            at = b
        pieces.append(text[at:])
        removed.append(sum(b - a for a, b in runs))
        spans.append([{"first_byte": a, "end_byte": b} for a, b in runs])
        kept.append(b"".join(pieces))
    kind = pa.list_(pa.struct([("first_byte", pa.int32()), ("end_byte", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(c.doc_ids, pa.int64()), pa.array(np.diff(c.offsets)), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
        ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeated_bytes(docs: DataFrame, width: int = WINDOW_BYTES, short: int = ANCHOR_BYTES) -> DataFrame:
    """Every row of ``docs`` (doc_id, text; other columns are ignored) without the bytes that
    a string of ``width`` bytes covers which also starts earlier: in a document with a
    smaller doc_id, or earlier in the same document (overlaps count).

    Returns doc_id, n_bytes, n_removed, spans (maximal removed runs) and kept (the other
    bytes). Matches never cross documents; strings are judged on the input. Null and empty
    texts have no bytes. A null doc_id is greater than all others. Of rows that share a
    doc_id, the one met first in the table comes first. Texts shorter than ``width`` stay.
    An empty table gives no rows.
    """
    kind = Kind(width, short, byte_symbols, within=True)
    return removals(docs, kind, SUFFIX_SCHEMA, ["anchor", "salt"], ["doc", "place", "shift"],
                    lambda c, p, hot: _suffixes(c, p, hot, width), lambda t: _settle(t, width), RESULT_SCHEMA, _documents,
                    lambda c, hot: _repeats_here(c, hot, width))
