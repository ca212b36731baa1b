"""Repeated windows over all documents, by paths.

1. Documents are gathered in compressed chunks, written once to shared storage.
2. Each chunk sends one row per distinct path (anchor, digest, earliest place in the chunk).
3. Paths meet by anchor. Equal paths: all but the earliest are repeats as a whole. An anchor
   with one path only is a nonbranching stretch and settled; the first places of the
   different paths of a branching anchor stay open.
4. Windows of open paths are compared one by one (how, is the operator's choice).
5. Each chunk takes the verdicts on its paths and yields its documents.

An anchor that many different paths of one chunk share is hot: its paths meet by (anchor,
part of the digest) and are always open, so no anchor's paths come together in one task
in greater number than some per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored
from plumbline.llm.windows import merged_runs, paths, spread

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Paths of a chunk, chunks of a task: bits of their numbers.
PATH_BITS, TASK_BITS = 26, 16
#: Chunks looked at for hot anchors, the paths in them that make one hot, and how many
#: anchors may be called hot. These steer the work only, never the result.
LOOK_CHUNKS, HOT_PATHS, HOT_ANCHORS = 256, 1000, 1000
HOT_PARTS = 64
#: Stands for a null doc_id.
LAST = np.iinfo(np.int64).max

CHUNK_SCHEMA = "chunk bigint, doc_ids array<bigint>, sizes array<bigint>, blob binary"
PATH_SCHEMA = "anchor bigint, salt int, digest bigint, doc bigint, place bigint"
VERDICT_SCHEMA = "chunk bigint, path int, open boolean"
REMOVED_SCHEMA = "chunk bigint, path int, first int, last int"


@dataclass(frozen=True)
class Kind:
    """What a symbol is, and how long windows and anchors are. ``symbols`` turns texts into
    (uint64 symbols, offsets). ``within``: an earlier place in the same document counts."""

    width: int
    short: int
    symbols: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    within: bool


def gathered(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` (doc_id, text) as chunk rows of compressed texts, in shared storage. Nothing
    is shuffled; numbers of chunks are fixed by being written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << TASK_BITS
        pack = zstandard.ZstdCompressor(level=3)
        ids, texts, held, number = [], [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or b""
                if texts and held + len(text) > chunk_bytes:
                    yield chunk(task + number, ids, texts, pack)
                    ids, texts, held, number = [], [], 0, number + 1
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if texts:
            yield chunk(task + number, ids, texts, pack)

    def chunk(number, ids, texts, pack) -> pa.RecordBatch:
        arrays = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                  pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([pack.compress(b"".join(texts))], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["chunk", "doc_ids", "sizes", "blob"])

    ready = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    return stored(ready.mapInArrow(run, CHUNK_SCHEMA))


class Chunk:
    """A chunk's texts and paths. ``lead`` is, for each path, the earliest equal path here."""

    def __init__(self, row: dict, kind: Kind):
        self.number, self.doc_ids = row["chunk"], row["doc_ids"]
        raw = zstandard.ZstdDecompressor().decompress(row["blob"])
        ends = np.cumsum([0, *row["sizes"]])
        self.texts = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        self.symbols, self.offsets = kind.symbols(self.texts)
        self.doc, self.first, self.count, self.anchor, self.digest, self.place_of_anchor = paths(self.symbols, self.offsets, kind.width, kind.short)
        order = np.array([LAST if d is None else d for d in self.doc_ids], np.int64)
        self.order = order[self.doc]
        by = np.lexsort((np.arange(len(self.doc)), self.order, self.digest, self.anchor))
        a, d = self.anchor[by], self.digest[by]
        new = np.ones(len(by), bool)
        new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        self.lead = np.empty(len(by), np.int64)
        self.lead[by] = by[new][np.cumsum(new) - 1]


def _chunk_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for at in range(batch.num_rows):
        yield {c: batch.column(c)[at].as_py() for c in batch.schema.names}


def _hot_anchors(chunks: DataFrame, kind: Kind) -> np.ndarray:
    """Anchors of very many different paths, in some of the chunks."""
    step = max(1, chunks.count() // LOOK_CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _chunk_rows(batch):
                c = Chunk(row, kind)
                values, counts = np.unique(c.anchor[c.lead == np.arange(len(c.lead))], return_counts=True)
                often = counts >= 4
                yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["anchor", "n"])

    seen = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(step)) == 0).mapInArrow(run, "anchor bigint, n bigint")
    hot = seen.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_PATHS).orderBy(F.desc("n"), "anchor").limit(HOT_ANCHORS)
    return np.sort(np.array([r.anchor for r in hot.collect()], np.int64))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``keys``."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        new = np.zeros(max(0, table.num_rows - 1), bool)
        for k in keys:
            v = table.column(k).to_numpy()
            new |= v[1:] != v[:-1]
        cuts = np.nonzero(new)[0]
        if not len(cuts):
            rest = table
            continue
        at = int(cuts[-1]) + 1
        yield table.slice(0, at).combine_chunks()
        rest = table.slice(at)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _verdicts(chunks: DataFrame, kind: Kind, hot: np.ndarray) -> DataFrame:
    """Paths that repeat an earlier one as a whole, and open ones."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _chunk_rows(batch):
                c = Chunk(row, kind)
                own = np.nonzero(c.lead == np.arange(len(c.lead)))[0]
                anchor, digest = c.anchor[own].view(np.int64), c.digest[own].view(np.int64)
                salt = np.where(np.isin(anchor, hot), 1 + (digest & (HOT_PARTS - 1)), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(salt.astype(np.int32)), pa.array(digest), pa.array(c.order[own]),
                     pa.array((c.number << PATH_BITS) + own)], ["anchor", "salt", "digest", "doc", "place"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["anchor", "salt"]):
            anchor, salt, digest, doc, place = (t.column(i).to_numpy() for i in range(5))
            new_anchor = np.ones(len(anchor), bool)
            new_anchor[1:] = (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])
            new_path = new_anchor.copy()
            new_path[1:] |= digest[1:] != digest[:-1]
            group, path = np.cumsum(new_anchor) - 1, np.cumsum(new_path) - 1
            first_doc = doc[new_path][path]  # rows of a path come by doc, then place
            whole = ~new_path if kind.within else doc > first_doc
            n_paths = np.bincount(group, new_path)[group]
            starts = np.nonzero(new_anchor)[0]
            least, most = np.minimum.reduceat(doc, starts)[group], np.maximum.reduceat(doc, starts)[group]
            is_open = ~whole & ((salt > 0) | (n_paths > 1) & (kind.within | (least < most)))
            told = whole | is_open
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[told] >> PATH_BITS), pa.array((place[told] & ((1 << PATH_BITS) - 1)).astype(np.int32)), pa.array(is_open[told])],
                ["chunk", "path", "open"])

    keys = ["anchor", "salt"]
    return (chunks.mapInArrow(send, PATH_SCHEMA).repartition(*keys).sortWithinPartitions(*keys, "digest", "doc", "place")
            .mapInArrow(decide, VERDICT_SCHEMA))


def removals(docs: DataFrame, kind: Kind, open_schema: str, open_keys: list[str], open_order: list[str],
             open_rows: Callable[[Chunk, np.ndarray, np.ndarray], pa.RecordBatch | None],
             settle: Callable[[pa.Table], pa.RecordBatch], out_schema: str,
             shown: Callable[[Chunk, np.ndarray, np.ndarray], pa.RecordBatch],
             here: Callable[[Chunk, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """Run the five steps. ``open_rows`` gives the rows to compare of a chunk's open paths,
    ``settle`` turns whole groups (by ``open_keys``, sorted by ``open_order``) of them into
    rows of REMOVED_SCHEMA: windows first .. last - 1 of a path repeat earlier ones.
    ``shown`` gives a chunk's result rows from its removed runs of symbols, ``here`` windows
    (start, end) that need no comparison, as their chunk shows them to be repeats."""
    chunks = gathered(docs)
    hot = _hot_anchors(chunks, kind)
    verdicts = stored(_verdicts(chunks, kind, hot))
    asked = verdicts.where("open").groupBy("chunk").agg(F.collect_list("path").alias("paths"))
    # both joins keep every chunk, so that the one exchange of texts serves them both
    dealt = chunks.repartition("chunk")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in np.flatnonzero(batch.column("paths").is_valid().to_numpy(zero_copy_only=False)).tolist():
                row = next(_chunk_rows(batch.slice(at, 1)))
                c = Chunk(row, kind)
                found = open_rows(c, np.sort(np.array(row["paths"], np.int64)), hot)
                if found is not None and found.num_rows:
                    yield found

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, open_keys):
            yield settle(t)

    settled = (dealt.join(asked, "chunk", "left").mapInArrow(ask, open_schema).repartition(*open_keys)
               .sortWithinPartitions(*open_keys, *open_order).mapInArrow(judge, REMOVED_SCHEMA))
    whole = verdicts.where("NOT open").select("chunk", "path", F.lit(0).alias("first"), F.lit(-1).alias("last"))
    told = settled.union(whole).groupBy("chunk").agg(
        F.collect_list("path").alias("paths"), F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _chunk_rows(batch):
                c = Chunk(row, kind)
                p, a, b = (np.array(row[k] or [], np.int64) for k in ("paths", "firsts", "lasts"))
                b = np.where(b < 0, c.count[p], b) if len(p) else b
                # paths equal to an earlier one of this chunk: repeats, or judged as that one
                is_lead = c.lead == np.arange(len(c.lead))
                follows = ~is_lead & (not kind.within) & (c.order == c.order[c.lead])
                repeats = np.nonzero(~is_lead & ~follows)[0]
                start, end = [c.first[p] + a, c.first[repeats]], [c.first[p] + b, c.first[repeats] + c.count[repeats]]
                if follows.any() and len(p):
                    by = np.argsort(p, kind="stable")
                    f = np.nonzero(follows)[0]
                    low, high = np.searchsorted(p[by], c.lead[f], "left"), np.searchsorted(p[by], c.lead[f], "right")
                    said, own = by[spread(low, high - low)], np.repeat(f, high - low)
                    start.append(c.first[own] + a[said])
                    end.append(c.first[own] + b[said])
                if here:
                    more = here(c, hot)
                    start.append(more[0])
                    end.append(more[1])
                yield shown(c, *merged_runs(np.concatenate(start), np.concatenate(end) + kind.width - 1, c.offsets))

    return dealt.join(told, "chunk", "left").mapInArrow(finish, out_schema)
