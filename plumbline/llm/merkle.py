"""Merkle manifest of a dataset by time-forward processing.

Nodes of the tree are labelled (last leaf below it, level): every node comes after its
children. An upward sweep sends each digest to its parent through a priority queue ordered
by label; a sweep in the reversed order sends each node's part of the proofs (siblings from
there to the root) down to the leaves. The queue's external part is Spark's sorted shuffle:
a task sweeps blocks of 2^BITS consecutive nodes, and what leaves a block is a row, labelled
(group, number), that the sorted shuffle of the next round delivers in order. Inside a block
the queue is a heap that never holds more than a few messages per level.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored
from plumbline.operators.skew import number_rows

#: Levels of a block: a task holds 2^BITS nodes of one block at a time.
BITS = 12
#: Rows tampered with: the unsigned CRC-32 of the decimal doc_id is divisible by this.
TAMPER = 7

NODE = "grp bigint, pos bigint, n bigint, digest string"
PROVEN = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    c = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf_digest(n_chars: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, start, row): ``start`` is the digest after tampering."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0, F.lit(False))
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    return (docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("lang").cast("string"),
                        F.col("n_chars").cast("bigint"), F.col("text").cast("string"))
            .withColumn("leaf", leaf_digest(F.col("n_chars"))).withColumn("changed", F.when(tampered, leaf_digest(more)))
            .select("doc_id", "lang", "leaf", F.coalesce("changed", "leaf").alias("start"), F.monotonically_increasing_id().alias("row")))


class Block:
    """Nodes of one aligned run of leaves up to ``height`` levels above them."""

    def __init__(self, digests: list[str], height: int):
        self.digests, self.height = digests, height
        self.children: dict[tuple[int, int], list[str]] = {}

    def _last(self, level: int, index: int) -> int:
        return min((index + 1) << level, len(self.digests)) - 1

    def upward(self) -> str:
        """The digest of the top node. Messages: (last leaf, level, index) of the parent, then the child's index and digest."""
        queue: list[tuple[int, int, int, int, str]] = []

        def send(level: int, index: int, digest: str) -> None:
            if level < self.height:
                heapq.heappush(queue, (self._last(level + 1, index >> 1), level + 1, index >> 1, index, digest))

        digest = self.digests[0]
        for at, digest in enumerate(self.digests):
            send(0, at, digest)
            while queue and queue[0][0] <= at:
                _, level, index, _, first = heapq.heappop(queue)
                parts = [first]
                while queue and queue[0][1:3] == (level, index):
                    parts.append(heapq.heappop(queue)[4])
                self.children[level, index] = parts
                digest = H(*parts)
                send(level, index, digest)
        return digest

    def downward(self, suffix: bytes) -> list[bytes]:
        """The proof suffix of every leaf, from that of the top node: the sweep reversed."""
        self.upward()
        out = [b""] * len(self.digests)
        queue = [(-self._last(self.height, 0), -self.height, 0, suffix)]
        while queue:
            _, level, index, suffix = heapq.heappop(queue)
            if not level:
                out[index] = suffix
                continue
            parts = self.children[-level, index]
            for k, _ in enumerate(parts):
                step = b"-" if len(parts) == 1 else (b"L" if k else b"R") + parts[1 - k].encode()
                child = 2 * index + k
                heapq.heappush(queue, (-self._last(-level - 1, child), level + 1, child, step + suffix))
        return out


def steps(suffix: bytes) -> tuple[list[tuple[str, str]], list[str]]:
    """A suffix read: (side, sibling) from the leaf up, then the digests after the end mark
    (root, subroot)."""
    path, at = [], 0
    text = suffix.decode()
    while text[at] != "=":
        side = text[at]
        path.append((side, "" if side == "-" else text[at + 1:at + 65]))
        at += 1 if side == "-" else 65
    return path, [text[k:k + 64] for k in range(at + 1, len(text), 64)]


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    for side, sibling in path:
        digest = H(sibling, digest) if side == "L" else H(digest, sibling)
    return digest


def _height(n: int) -> int:
    return min((n - 1).bit_length(), BITS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows of each (grp, block)."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        grp, block = batch.column("grp").to_numpy(), batch.column("block").to_numpy()
        if rest and batch.num_rows and (rest[-1].column("grp")[-1].as_py(), rest[-1].column("block")[-1].as_py()) != (grp[0], block[0]):
            yield pa.Table.from_batches(rest)
            rest = []
        first = 0
        for at in [*((grp[1:] != grp[:-1]) | (block[1:] != block[:-1])).nonzero()[0] + 1, batch.num_rows]:
            if at < batch.num_rows:
                yield pa.Table.from_batches([*rest, batch.slice(first, at - first)])
                rest, first = [], at
            elif at > first:
                rest.append(batch.slice(first, at - first))
    if rest:
        yield pa.Table.from_batches(rest)


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        n = block["n"][0].as_py()
        top = Block(block["digest"].to_pylist(), _height(n)).upward()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in ((block["grp"][0].as_py(), pa.int64()), (block["block"][0].as_py(), pa.int64()),
                                           (-(-n >> BITS), pa.int64()), (top, pa.string()))],
            ["grp", "pos", "n", "digest"])


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", BITS)).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rounds of blocks up to every group's root: what goes into each round, and the roots (n = 1) that each gives."""
    rounds, ended = [nodes], []
    while True:
        made = stored(_in_blocks(rounds[-1]).select("grp", "block", "pos", "n", "digest").mapInArrow(_up, NODE))
        ended.append(made.where("n = 1"))
        left = made.where("n > 1")
        if left.isEmpty():
            return rounds, ended
        rounds.append(left)


def descend(rounds: list[DataFrame], ended: list[DataFrame], roots: DataFrame,
            finish: Callable[[pa.Table, list[bytes]], pa.RecordBatch] | None = None, schema: str | None = None) -> DataFrame:
    """``roots`` (grp, suffix) sent down to the first round's nodes: (grp, pos, suffix), or
    what ``finish`` makes of the rows of a block and their suffixes."""
    def down(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            # the parent's message has no position and comes first
            rows, suffix = block.slice(1), block["suffix"][0].as_py()
            found = Block(rows["digest"].to_pylist(), _height(rows["n"][0].as_py())).downward(suffix)
            if last:
                yield finish(rows, found)
            else:
                yield pa.RecordBatch.from_arrays([rows["grp"].combine_chunks(), rows["pos"].combine_chunks(), pa.array(found, pa.binary())],
                                                 ["grp", "pos", "suffix"])

    above = None
    for at in range(len(rounds) - 1, -1, -1):
        sent = ended[at].join(roots, "grp").select("grp", "pos", "suffix")
        if above is not None:
            sent = sent.union(above)
        rows = rounds[at].withColumn("block", F.shiftright("pos", BITS))
        both = rows.unionByName(sent.withColumnRenamed("pos", "block"), allowMissingColumns=True)
        last = at == 0 and finish is not None
        above = (both.repartition("grp", "block").sortWithinPartitions("grp", "block", F.asc_nulls_first("pos"))
                 .mapInArrow(lambda batches, last=last: down(batches, last), schema if last else "grp bigint, pos bigint, suffix binary"))
        if at:
            above = stored(above)
    return above


def _proven(rows: pa.Table, suffixes: list[bytes]) -> pa.RecordBatch:
    proofs, subroots, roots, folded = [], [], [], []
    for start, suffix in zip(rows["start"].to_pylist(), suffixes):
        path, (root, subroot) = steps(suffix)
        proofs.append(H(*(s for _, s in path)))
        subroots.append(subroot)
        roots.append(root)
        folded.append(fold(start, path))
    return pa.RecordBatch.from_arrays(
        [rows["doc_id"].combine_chunks(), rows["digest"].combine_chunks(), *(pa.array(x, pa.string()) for x in (subroots, roots, proofs, folded)),
         pa.array([a == b for a, b in zip(folded, roots)], pa.bool_())],
        ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(docs: DataFrame) -> DataFrame:
    """Digest, proof and verification of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    leaf: digest of the row. subroot: root of its language's tree over leaves by doc_id; root:
    that of the tree over subroots by language (null first, bytewise). proof_sha256: digest
    of the siblings from leaf to root. folded_root: what the row's leaf and siblings give,
    with n_chars one larger in rows that are tampered with; verified: whether it is root.

    A language may hold any share of the rows: positions come from one range sort, and
    blocks have the same size whatever group they belong to. Rows of one doc_id follow each
    other by digest; equal rows get proofs of different places. Null is a language of its
    own; a null doc_id comes first and is never tampered with. Nulls, empty and very long
    texts are digested like others; further columns are ignored; an empty table gives none.
    """
    numbered = number_rows(stored(leaves(docs)), ["lang"], ["doc_id", "leaf", "row"], "pos")
    sizes = stored(numbered.groupBy("lang").agg(F.count("*").alias("n")))
    langs = stored(number_rows(sizes, [], ["lang"], "grp"))
    nodes = stored(numbered.join(langs.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
                   .select("grp", (F.col("pos") - 1).alias("pos"), "n", F.col("leaf").alias("digest"), "doc_id", "start"))
    rounds, ended = climb(nodes)
    subroots = reduce(DataFrame.union, ended).select((F.col("grp") - 1).alias("pos"), "digest")
    upper = stored(subroots.withColumn("grp", F.lit(0).cast("bigint")).withColumn("n", F.lit(langs.count()).cast("bigint")))
    above, top = climb(upper)
    root = reduce(DataFrame.union, top).select("grp", F.concat(F.lit("="), F.col("digest")).cast("binary").alias("suffix"))
    roots = (descend(above, top, root).join(upper.select("pos", "digest"), "pos")
             .select((F.col("pos") + 1).alias("grp"), F.concat("suffix", F.col("digest").cast("binary")).alias("suffix")))
    return descend(rounds, ended, stored(roots), _proven, PROVEN)


#: The same in DuckDB: levels one by one, then every row's way up.
MANIFEST_SQL = """
WITH RECURSIVE
d AS (SELECT doc_id, lang, n_chars,
      CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END ||
      CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END ||
      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
      CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
      list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
        lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
          lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)) AS crc
      FROM documents),
l AS (SELECT *, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
      sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END || tail) AS changed,
      coalesce(xor(crc, 4294967295::UBIGINT) % 7 = 0, FALSE) AS tampered FROM d),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS g_n, count(*) AS n FROM l GROUP BY lang),
p AS (SELECT doc_id, leaf, CASE WHEN tampered THEN changed ELSE leaf END AS start, g, n,
      row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
      FROM l JOIN langs ON l.lang IS NOT DISTINCT FROM langs.lang),
t AS (SELECT 0 AS level, g, pos, n, leaf AS digest FROM p
      UNION ALL
      SELECT level + 1, g, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1
      GROUP BY level, g, pos // 2, n),
s AS (SELECT g, digest AS subroot, (SELECT count(*) FROM langs) AS g_n FROM t WHERE n = 1),
r AS (SELECT 0 AS level, g AS pos, g_n AS n, subroot AS digest FROM s
      UNION ALL
      SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM r WHERE n > 1
      GROUP BY level, pos // 2, n),
w AS (SELECT doc_id, leaf, g, 0 AS part, 0 AS level, pos, n, start AS folded, '' AS proof FROM p
      UNION ALL
      SELECT w.doc_id, w.leaf, w.g,
             CASE WHEN w.n = 1 THEN 1 ELSE part END, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END,
             CASE WHEN w.n = 1 THEN w.g ELSE w.pos // 2 END, CASE WHEN w.n = 1 THEN (SELECT count(*) FROM langs) ELSE (w.n + 1) // 2 END,
             CASE WHEN w.n = 1 THEN folded WHEN w.pos % 2 = 1 THEN sha256(o.digest || folded) ELSE sha256(folded || coalesce(o.digest, '')) END,
             CASE WHEN w.n = 1 THEN proof ELSE proof || coalesce(o.digest, '') END
      FROM w LEFT JOIN (SELECT 0 AS o_part, level, g, pos, digest FROM t UNION ALL SELECT 1, level, -1, pos, digest FROM r) o
      ON w.n > 1 AND o.o_part = w.part AND o.level = w.level AND o.pos = xor(w.pos, 1) AND o.g = CASE WHEN w.part = 1 THEN -1 ELSE w.g END
      WHERE w.part = 0 OR w.n > 1)
SELECT w.doc_id, w.leaf, s.subroot, x.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = x.digest AS verified
FROM w JOIN s ON s.g = w.g CROSS JOIN (SELECT digest FROM r WHERE n = 1) x WHERE w.part = 1 AND w.n = 1
"""
