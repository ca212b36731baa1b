"""Token ids, packed in rows of fixed length by best-fit decreasing."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte-level BPE ranks; any file of "base64 rank" lines serves.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer of that file cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Closes each document; the id left free by that file.
END_ID = 50256
ROW_TOKENS = 2048
#: Tokens that a task gathers before it packs them.
POOL_TOKENS = 1 << 20

PACK_SCHEMA = ("input_ids binary, position_ids binary, cu_seqlens array<int>, row_ids array<bigint>, "
               "doc_ids array<bigint>, starts array<int>, n_tokens int")


#: White space that the tokenizer's pattern is given in one run.
GAP = 1 << 16


def pieces(text: str) -> list[str]:
    """The text, cut inside runs of more than GAP white space characters, on which the
    tokenizer's pattern would recurse without bound."""
    cuts = [m.end() for m in re.finditer(r"\s{%d}" % GAP, text)] if len(text) > GAP else []
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]


def encoding(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Capacities:
    """Bins by free space, in a segment tree: how many bins lie below each node."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.below = [0] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _count(self, space: int, by: int) -> None:
        node = self.base + space
        while node:
            self.below[node] += by
            node >>= 1

    def put(self, number: int, space: int) -> None:
        self.bins[space].append(number)
        self._count(space, 1)

    def take_best(self, need: int) -> tuple[int, int] | None:
        """Remove a bin with the least space of at least ``need``: (bin, space)."""
        below, node = self.below, self.base + need
        if not below[node]:
            while node > 1 and (node & 1 or not below[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if below[2 * node] else 2 * node + 1
        space = node - self.base
        self._count(space, -1)
        return self.bins[space].pop(), space


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items (places in ``lengths``, each at most ``capacity``) by bin: longest first, each
    into the bin that it fills best."""
    free = Capacities(capacity)
    bins: list[list[int]] = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take_best(lengths[item])
        if found is None:
            bins.append([])
            found = len(bins) - 1, capacity
        number, space = found
        bins[number].append(item)
        free.put(number, space - lengths[item])
    return bins


def _columns(rows: list[list[tuple]], capacity: int, end_id: int, kind: str) -> pa.RecordBatch:
    ids, positions, cumulative, row_ids, doc_ids, starts, used = [], [], [], [], [], [], []
    for segments in rows:
        lengths = [len(s[3]) for s in segments]
        filled = sum(lengths)
        pad = capacity - filled
        ids.append(np.concatenate([*(s[3] for s in segments), np.full(pad, end_id, kind)]).astype(kind).tobytes())
        positions.append(np.concatenate([*(np.arange(n, dtype=kind) for n in lengths), np.zeros(pad, kind)]).tobytes())
        cumulative.append([0, *np.cumsum(lengths).tolist()])
        row_ids.append([s[0] for s in segments])
        doc_ids.append([s[1] for s in segments])
        starts.append([s[2] for s in segments])
        used.append(filled)
    arrays = [pa.array(ids, pa.binary()), pa.array(positions, pa.binary()), pa.array(cumulative, pa.list_(pa.int32())),
              pa.array(row_ids, pa.list_(pa.int64())), pa.array(doc_ids, pa.list_(pa.int64())),
              pa.array(starts, pa.list_(pa.int32())), pa.array(used, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, ["input_ids", "position_ids", "cu_seqlens", "row_ids", "doc_ids", "starts", "n_tokens"])


def pack(docs: DataFrame, row_tokens: int = ROW_TOKENS, ranks_path: str = RANKS, end_id: int = END_ID,
         pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """``docs`` (doc_id, text; other columns are ignored) as rows of ``row_tokens`` ids.

    input_ids: the row's ids as little-endian numbers (two bytes if ``end_id`` fits, else
    four), filled up with ``end_id`` past n_tokens. position_ids: likewise, starting from 0
    again at each segment. cu_seqlens: segment ends from 0. row_ids, doc_ids, starts: for
    each segment its input row, the row's doc_id and the place of its first token in that
    row's ids, so the ids of every row can be put together again exactly.

    Every row of ``docs`` gives its text's ids and ``end_id``; null and empty texts give
    just that. Runs of more than GAP white space characters are tokenized in parts. A document longer than a row is cut into whole rows and a rest. Each task
    packs pools of about ``pool_tokens`` ids from the documents that it reads, which bounds
    its memory (but for a single text) and needs no shuffle; a lost task repeats the same
    work. Repeated rows and null ids are packed like others; an empty table gives no rows.
    """
    kind = "<u2" if end_id < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pool, pooled, full = encoding(ranks_path), [], 0, []
        for batch in batches:
            texts, doc_ids, row_ids = batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("row_id").to_pylist()
            for at in range(batch.num_rows):
                text = str(texts[at].as_py() or b"", "utf-8", "replace")
                ids = np.array([*chain.from_iterable(tokens.encode_ordinary(part) for part in pieces(text)), end_id], np.uint32).astype(kind)
                whole = len(ids) - len(ids) % row_tokens
                for start in range(0, whole, row_tokens):
                    full.append([(row_ids[at], doc_ids[at], start, ids[start:start + row_tokens])])
                    if len(full) >= 256:
                        yield _columns(full, row_tokens, end_id, kind)
                        full = []
                if whole < len(ids):
                    pool.append((row_ids[at], doc_ids[at], whole, ids[whole:]))
                    pooled += len(ids) - whole
                if pooled >= pool_tokens:
                    yield from packed(pool)
                    pool, pooled = [], 0
        if full:
            yield _columns(full, row_tokens, end_id, kind)
        yield from packed(pool)

    def packed(pool: list[tuple]) -> Iterator[pa.RecordBatch]:
        bins = best_fit_decreasing([len(s[3]) for s in pool], row_tokens)
        for at in range(0, len(bins), 256):
            yield _columns([[pool[i] for i in chosen] for chosen in bins[at:at + 256]], row_tokens, end_id, kind)

    ready = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"),
                        F.monotonically_increasing_id().alias("row_id"))
    return ready.mapInArrow(run, PACK_SCHEMA)
