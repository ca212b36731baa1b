"""Repeated word windows by minimizer winnowing, which stands in for a de Bruijn graph.

Windows of words that follow each other and share an anchor (their least word hash) are a
path, cut inside one chunk of text; a path is one row before anything is shuffled, and paths
meet in joins by anchor. An anchor with one digest of paths is settled as a whole; windows
of the others are compared singly by two 64-bit hashes, each with its source place. No
degrees of nodes are computed and no source words are read back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from plumbline.llm.repeats import PATH_BITS, Chunk, Kind, removals
from plumbline.llm.windows import RunHashes, mixed, spread

WINDOW_WORDS = 50
#: Words of an anchor.
ANCHOR_WORDS = 8
_SECOND = np.uint64(0xA0761D6478BD642F) | np.uint64(1)

EDGE_SCHEMA = "edge bigint, more bigint, doc bigint, place bigint, at int, sure boolean"
RESULT_SCHEMA = ("doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<first_word:int,end_word:int>>, kept binary")


def word_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word; bytes.split() cuts at just the six white space bytes."""
    digest, known = xxhash.xxh64_intdigest, {}
    out, offsets = [], [0]
    for text in texts:
        words = text.split()
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            out.append(h)
        offsets.append(len(out))
    return np.array(out, np.uint64), np.array(offsets, np.int64)


def _edges(c: Chunk, open_paths: np.ndarray, hot: np.ndarray, width: int) -> pa.RecordBatch | None:
    """The windows of open paths, by two hashes. Those that repeat one of a smaller doc_id in
    this chunk are sure already; they travel under a key of their own."""
    if not len(open_paths):
        return None
    start = spread(c.first[open_paths], c.count[open_paths])
    path = np.repeat(open_paths, c.count[open_paths])
    one = RunHashes(c.symbols).of(start, start + width)
    two = RunHashes(mixed(c.symbols), _SECOND).of(start, start + width)
    doc = c.order[path]
    by = np.lexsort((doc, two, one))
    new = np.ones(len(by), bool)
    new[1:] = (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])
    least = np.empty(len(by), np.int64)
    least[by] = doc[by][new][np.cumsum(new) - 1]
    sure = doc > least
    place = (c.number << PATH_BITS) + path
    one[sure] = mixed(place[sure].astype(np.uint64) + start[sure].astype(np.uint64) * _SECOND)
    return pa.RecordBatch.from_arrays(
        [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(doc), pa.array(place),
         pa.array((start - c.first[path]).astype(np.int32)), pa.array(sure)], ["edge", "more", "doc", "place", "at", "sure"])


def _settle(t: pa.Table) -> pa.RecordBatch:
    """Edges that start in a document with a smaller doc_id too."""
    edge, more, doc, place, at = (t.column(i).to_numpy() for i in range(5))
    sure = t.column("sure").to_numpy(zero_copy_only=False)
    own = np.nonzero(~sure)[0]  # sorted by edge, more, doc
    new = np.ones(len(own), bool)
    new[1:] = (edge[own][1:] != edge[own][:-1]) | (more[own][1:] != more[own][:-1])
    gone = sure.copy()
    if len(own):
        gone[own] = doc[own] > doc[own][new][np.cumsum(new) - 1]
    place, at = place[gone], at[gone]
    return pa.RecordBatch.from_arrays(
        [pa.array(place >> PATH_BITS), pa.array((place & ((1 << PATH_BITS) - 1)).astype(np.int32)), pa.array(at), pa.array(at + 1)],
        ["chunk", "path", "first", "last"])


def _documents(c: Chunk, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    doc = np.searchsorted(c.offsets, start, side="right") - 1
    low, high = np.searchsorted(doc, np.arange(len(c.texts)), "left"), np.searchsorted(doc, np.arange(len(c.texts)), "right")
    counts = np.diff(c.offsets)
    removed, spans, kept = [], [], []
    for d, text in enumerate(c.texts):
        words, base = text.split(), int(c.offsets[d])
        runs = [(int(a) - base, int(b) - base) for a, b in zip(start[low[d]:high[d]], end[low[d]:high[d]])]
        removed.append(sum(b - a for a, b in runs))
        spans.append([{"first_word": a, "end_word": b} for a, b in runs])
        for a, b in reversed(runs):
            del words[a:b]
        kept.append(b" ".join(words))
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(c.doc_ids, pa.int64()), pa.array(counts), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
        ["doc_id", "n_words", "n_removed", "spans", "kept"])


def remove_repeated_windows(docs: DataFrame, width: int = WINDOW_WORDS, short: int = ANCHOR_WORDS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text; other columns are ignored) without the words that
    a window of ``width`` words covers whose words also start, in this order, in a document
    with a smaller doc_id.

    Returns doc_id, n_words, n_removed, spans (removed runs of words) and kept (the other
    words, joined by one space, UTF-8). Words are runs of anything but space and \\t \\n \\v
    \\f \\r. Windows are judged on the input. Null and empty texts have no words. A null
    doc_id is greater than all others. Rows that share a doc_id do not repeat each other.
    Texts shorter than a window stay. An empty table gives no rows.
    """
    kind = Kind(width, short, word_symbols, within=False)
    return removals(docs, kind, EDGE_SCHEMA, ["edge"], ["more", "sure", "doc"],
                    lambda c, p, hot: _edges(c, p, hot, width), _settle, RESULT_SCHEMA, _documents)
