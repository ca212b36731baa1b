"""Grouped prefix join: documents whose sets of word shingles are similar.

All shingles have one order, rare ones first. Of two sets of similarity 4/5, the first fifth
or so of each (its prefix) holds a common shingle. Sets with one prefix and one size are a
group, and it is groups that meet under the shingles of their prefixes. Pairs of groups that
sizes or positions rule out are dropped; the rest is expanded to members, which a parity
sketch filters and their whole sets decide. Every filter is a necessary condition.

Groups meet twice. First each looks, at four shingles of its prefix, for the group most like
it; what these pairs link is one class. Then all groups meet at every shingle of their
prefixes, but only those of different classes, so that a class of very many near copies
costs no square of pairs.

A caller may have the sets fingerprinted and send pairs of its own to both meetings
(``Fingerprint``, ``Pairs``); they are decided on whole sets like all others.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import flat, sent, slices, stored
from plumbline.llm.graph import components

#: Least similarity: OVER / UNDER.
OVER, UNDER = 4, 5
#: Shingles are ordered by the counts of so many classes of hashes, then by hash: the order steers the work only.
CLASS_BITS = 22
#: Counts of classes travel in blocks of so many.
BLOCK = 1 << 16
#: Bits of the parity sketch that finds the most similar group.
MINI_BITS = 512
#: Shingles of a prefix (its least hashes) at which a group looks for the one most like it.
LEADS = 4
#: ... among so many before it in the order of sizes.
NEAR = 128
#: Entries that a task gathers before it sends them, and that a part of all hashes holds on average.
BUFFER, PART_ENTRIES = 1 << 19, 1 << 18
#: A shingle with more groups than this in a buffer is dealt out; in the first meeting to so many tasks.
CROWD, DEALT = 256, 256
#: Groups of one unit of comparison: a larger bucket is dealt out as pairs of parts.
PART = 512
#: Classes of text digests by which documents without a candidate are passed over.
TEXT_CLASSES = 1 << 22
#: Classes of documents by which those that surely stay pass without a join by name.
ROW_CLASSES = 1 << 20
#: Bytes of text that are in work at a time.
SLICE_BYTES = 1 << 22
#: Bytes and words of text that are hashed at a time; words of more bytes than LONG_WORD are hashed singly.
PIECE, KNOWN_WORDS, LONG_WORD = 1 << 16, 1 << 18, 64

#: Seed of the digests of texts: the one of Spark's own xxhash64.
SEED = 42

#: From the hashes of a set its fingerprint; from sets (key, fp) pairs (u, v) that may be similar, and from
#: sets (key, fp, label) all of different classes that may be.
Fingerprint = Callable[[np.ndarray], int]
Pairs = tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """Hashes of the words of a text: differences of running sums of (a number of the byte) times
    (a power of its place), so that all words come at once; long words singly."""

    def __init__(self):
        self.gaps = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
        self.letters = np.random.default_rng(SEED).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
        factors = np.array([[int(_STEP)], [pow(int(_STEP), -1, 1 << 64)]], np.uint64).repeat(PIECE + 1, axis=1)
        factors[:, 0] = 1
        self.powers, self.back = np.cumprod(factors, axis=1, dtype=np.uint64)

    def hashes(self, text: bytes) -> np.ndarray:
        low = text.lower()
        raw = np.frombuffer(low, np.uint8)
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = self.gaps[raw]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[::2], edges[1::2]
        out, at = np.zeros(len(starts), np.uint64), 0
        while at < len(starts):
            upto = min(max(int(np.searchsorted(ends, starts[at] + PIECE, side="right")), at + 1), at + KNOWN_WORDS)
            first, last = starts[at], ends[upto - 1]
            if last - first <= PIECE:
                sums = np.zeros(last - first + 1, np.uint64)
                np.cumsum(self.letters[raw[first:last]] * self.powers[:last - first], out=sums[1:])
                out[at:upto] = (sums[ends[at:upto] - first] - sums[starts[at:upto] - first]) * self.back[starts[at:upto] - first]
            at = upto
        out = (out ^ (out >> np.uint64(32))) * _MIX
        out ^= out >> np.uint64(29)
        for k in np.flatnonzero(ends - starts > LONG_WORD):
            out[k] = xxhash.xxh64_intdigest(low[starts[k]:ends[k]])
        return out


def shingle_hashes(text: bytes, width: int, known: Words) -> np.ndarray:
    """Hashes of all runs of ``width`` words in lower case (A-Z), repeats included; a shorter
    text is one run, one without words has none."""
    each = known.hashes(text)
    if not len(each):
        return each
    runs, size = max(1, len(each) - width + 1), min(width, len(each))
    out = np.full(runs, size, np.uint64)
    for k in range(size):
        out = out * _STEP + each[k:k + runs]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return out ^ (out >> np.uint64(29))


def shingle_set(text: bytes, width: int, known: Words) -> np.ndarray:
    """The distinct ones, ascending."""
    own = np.sort(shingle_hashes(text, width, known))
    return own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own


def prefix_length(n: int) -> int:
    """Of two similar sets, any order of all shingles puts a common one among so many first ones of each."""
    return n - -(-OVER * n // UNDER) + 1 if n else 0


def prefix(own: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set, by class rank, then hash."""
    order = np.argsort(ranks[(own >> np.uint64(64 - CLASS_BITS)).astype(np.int64)], kind="stable")
    return own[order[:prefix_length(len(own))]]


def parity(own: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the number of hashes in each of ``bits`` classes (a power of two), as bytes: sets
    differ in at least as many shingles as their sketches in bits."""
    counts = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool), bitorder="little")


def sketch_bits(n: int) -> int:
    return max(64, 1 << (2 * n - 1).bit_length()) if n else 64


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch of more bits brought down to ``size`` bytes."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least number of common shingles of similar sets of n and m."""
    return -(-OVER * (n + m) // (OVER + UNDER))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def class_ranks(texts: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """A rank for every class of shingles by how many of them there are over all documents, in
    steps of an eighth of an octave; and the number of shingles."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = np.zeros(1 << CLASS_BITS, np.uint32), Words()
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = [shingle_hashes(t.as_py(), width, known) for t in batch.column("text")]
            if sets:
                np.add.at(counts, (np.concatenate(sets) >> np.uint64(64 - CLASS_BITS)).astype(np.int64), np.uint32(1))
        yield from rows({b: part for b, part in enumerate(counts.reshape(-1, BLOCK)) if part.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, part in zip(batch.column("block"), batch.column("counts")):
                sums[b.as_py()] = sums.get(b.as_py(), 0) + np.frombuffer(zlib.decompress(part.as_py()), np.int64)
        yield from rows(sums)

    def rows(blocks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for b, part in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(part.astype(np.int64).tobytes(), 1)], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    out = np.zeros(((1 << CLASS_BITS) // BLOCK, BLOCK), np.int64)
    for r in texts.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).toLocalIterator():
        out[r.block] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return np.minimum(8 * np.log2(out.ravel() + 1), 255).astype(np.uint8), int(out.sum())


def _digest(values: np.ndarray, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(values.tobytes(), seed)


def described(texts: DataFrame, width: int, ranks_of: Callable[[], np.ndarray], fingerprint: Fingerprint) -> DataFrame:
    """Of every document: doc_id, key (its set), text_key, n, gid (its prefix and size), fp, sketches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = ranks_of(), Words()
        for batch in slices(batches, "text", SLICE_BYTES):
            numbers, sketches, minis = [], [], []
            for t in batch.column("text"):
                text = t.as_py()
                own = shingle_set(text, width, known)
                numbers.append((_digest(own), xxhash.xxh64_intdigest(text, SEED), len(own), _digest(prefix(own, ranks), len(own)), fingerprint(own)))
                sketches.append(parity(own, sketch_bits(len(own))).tobytes())
                minis.append(parity(own, MINI_BITS).tobytes())
            table = np.array(numbers, np.uint64).reshape(-1, 5).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in table.T.copy()), pa.array(sketches, pa.binary()), pa.array(minis, pa.binary())],
                ["doc_id", "key", "text_key", "n", "gid", "fp", "sketch", "mini"])

    return texts.mapInArrow(run, "doc_id bigint, key bigint, text_key bigint, n bigint, gid bigint, fp bigint, sketch binary, mini binary")


ENTRY = np.dtype([("h", np.uint64), ("gid", np.int64), ("n", np.int32), ("p", np.int32), ("lead", np.bool_)])


def entries(texts: DataFrame, width: int, ranks_of: Callable[[], np.ndarray], parts: int) -> DataFrame:
    """(part, crowd, rows): prefix entries of all groups by part of the hashes, packed.

    ``crowd`` rows hold shingles with very many groups and go anywhere, as it is known that
    several groups have them; two entries of each go to its part too, for those elsewhere.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known, held, size, turn = ranks_of(), Words(), [], 0, 0
        for batch in slices(batches, "text", SLICE_BYTES):
            for t in batch.column("text"):
                own = shingle_set(t.as_py(), width, known)
                if len(own):
                    first = prefix(own, ranks)
                    part = np.empty(len(first), ENTRY)
                    part["h"], part["gid"], part["n"], part["p"] = first, np.uint64(_digest(first, len(own))).view(np.int64), len(own), np.arange(len(first))
                    part["lead"] = False
                    part["lead"][np.argpartition(first, LEADS)[:LEADS] if len(first) > LEADS else slice(None)] = True
                    held.append(part)
                    size += len(part)
            if size >= BUFFER:
                turn += 1
                yield from packed(np.concatenate(held), turn)
                held, size = [], 0
        if held:
            yield from packed(np.concatenate(held), turn + 1)

    def packed(rows: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
        rows = _ordered(rows)
        starts, sizes = _runs(rows["h"])
        place = np.arange(len(rows)) - np.repeat(starts, sizes)
        crowded = np.repeat(sizes > CROWD, sizes)
        out = [(-1 - turn, True, rows[crowded & (place > 1)].tobytes())] if crowded.any() else []
        rows = rows[~crowded | (place < 2)]
        number = (rows["h"] // np.uint64(-(-2 ** 64 // parts))).astype(np.int64)
        starts, sizes = _runs(number)
        out += [(int(number[a]), False, rows[a:a + k].tobytes()) for a, k in zip(starts, sizes)]
        for at in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at:at + 256]), (pa.int64(), pa.bool_(), pa.binary()))], ["part", "crowd", "rows"])

    return texts.select("text").mapInArrow(run, "part bigint, crowd boolean, rows binary")


def _ordered(rows: np.ndarray) -> np.ndarray:
    """Entries by hash and group, each once."""
    rows = rows[np.lexsort((rows["gid"], rows["h"]))]
    new = (rows["h"][1:] != rows["h"][:-1]) | (rows["gid"][1:] != rows["gid"][:-1])
    return rows[np.concatenate(([True], new))] if len(rows) else rows


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal values."""
    starts = np.concatenate(([0], np.nonzero(values[1:] != values[:-1])[0] + 1)) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate((starts, [len(values)])))


def shared(sent_entries: DataFrame) -> DataFrame:
    """(h, gid, n, p, lead, crowd): the entries whose shingle several groups have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for part, crowd, rows in zip(*(batch.column(c) for c in ("part", "crowd", "rows"))):
                part, rows = part.as_py(), np.frombuffer(rows.as_py(), ENTRY)
                if crowd.as_py():
                    yield made(rows, True)
                    continue
                if part != at and held:
                    yield met(held)
                    held = []
                held.append(rows)
                at = part
        if held:
            yield met(held)

    def met(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = _ordered(np.concatenate(held))
        starts, sizes = _runs(rows["h"])
        return made(rows[np.repeat(sizes > 1, sizes)], False)

    def made(rows: np.ndarray, crowd: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(rows["h"]).view(np.int64)), *(pa.array(np.ascontiguousarray(rows[c])) for c in ("gid", "n", "p", "lead")), pa.array(np.full(len(rows), crowd))],
            ["h", "gid", "n", "p", "lead", "crowd"])

    return (sent_entries.repartition("part").sortWithinPartitions("part")
            .mapInArrow(run, "h bigint, gid bigint, n int, p int, lead boolean, crowd boolean"))


def _pairs_in_runs(run: np.ndarray, reach: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of rows in one run of equal values: all with j = i + 1, then
    j = i + 2, and so on, up to ``reach``."""
    at, step = np.arange(len(run) - 1), 1
    while len(at) and (reach is None or step <= reach):
        at = at[at + step < len(run)]
        at = at[run[at] == run[at + step]]
        yield at, at + step
        step += 1


def _whole_runs(batches: Iterator[pa.RecordBatch], by: list[str], most: int, cut_long: bool = False) -> Iterator[pa.Table]:
    """Sorted rows in tables of some ``most`` rows that cut no run of equal ``by`` (or, with
    ``cut_long``, only runs of more rows)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < most:
            continue
        table = pa.Table.from_batches(held)
        keys = [table[c].to_numpy() for c in by]
        same = np.logical_and.reduce([k == k[-1] for k in keys])
        cut = len(same) - int(same[::-1].argmin()) if not same.all() else len(same) if cut_long else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def nearest(rows: DataFrame) -> DataFrame:
    """(u, v): for every row of ``rows`` (h, salt, n, key, mini) the most similar sketch among those
    before it of the same h and salt, of a size that fits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches, ["h", "salt"], 1 << 16, cut_long=True):
            yield found(table)

    def found(table: pa.Table) -> pa.RecordBatch:
        h, salt, n, key = (table[c].to_numpy() for c in ("h", "salt", "n", "key"))
        mini = np.frombuffer(b"".join(table["mini"].to_pylist()), np.uint64).reshape(-1, MINI_BITS // 64)
        run = np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]))))
        best, whose = np.full(len(h), MINI_BITS + 1), np.full(len(h), -1)
        for i, j in _pairs_in_runs(run, NEAR):
            good = (UNDER * n[i] >= OVER * n[j]) & (key[i] != key[j])
            i, j = i[good], j[good]
            differ = np.bitwise_count(mini[i] ^ mini[j]).sum(axis=1, dtype=np.int64)
            better = differ < best[j]
            best[j[better]], whose[j[better]] = differ[better], i[better]
        j = np.nonzero(whose >= 0)[0]
        pairs = np.unique(np.column_stack([key[whose[j]], key[j]]), axis=0) if len(j) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1) if len(pairs) else pairs[:, 0]), pa.array(pairs.max(axis=1) if len(pairs) else pairs[:, 1])], ["u", "v"])

    return (rows.select("h", "salt", "n", "key", "mini").repartition("h", "salt").sortWithinPartitions("h", "salt", "n", "key")
            .mapInArrow(run, "u bigint, v bigint").distinct())


def group_pairs(rows: DataFrame) -> DataFrame:
    """(gid, label, other_gid, other_label): groups of ``rows`` (h, gid, label, n, p) that share h, belong
    to different classes, and have sizes and positions of similar sets."""
    sizes = stored(rows.groupBy("h").agg(F.count("*").alias("count"), F.min("label").alias("a"), F.max("label").alias("b")).where("a < b")
                   .select("h", F.ceil(F.col("count") / PART).cast("int").alias("parts")))
    units = (rows.join(sizes, "h").withColumn("part", F.pmod(F.xxhash64("gid", "label"), F.col("parts")).cast("int"))
             .select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
             .select("h", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "gid", "label", "n", "p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches, ["h", "a", "b"], 1 << 16):
            h, a, b, part, gid, label = (table[c].to_numpy() for c in ("h", "a", "b", "part", "gid", "label"))
            n, p = (table[c].to_numpy().astype(np.int64) for c in ("n", "p"))
            run = np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            order = np.lexsort((label, gid))
            new = np.concatenate(([True], (gid[order][1:] != gid[order][:-1]) | (label[order][1:] != label[order][:-1])))
            who, first = np.empty(len(gid), np.int64), order[new]  # groups by number
            who[order] = np.cumsum(new) - 1
            codes, size = [], 0
            for i, j in _pairs_in_runs(run):
                good = (label[i] != label[j]) & ((a[i] == b[i]) | (part[i] != part[j]))
                i, j = i[good], j[good]
                good = 1 + np.minimum(n[i] - p[i] - 1, n[j] - p[j] - 1) >= needed(n[i], n[j])
                x, y = who[i[good]], who[j[good]]
                codes.append(np.minimum(x, y) * len(first) + np.maximum(x, y))
                size += len(x)
                if size >= 1 << 20:
                    yield made(codes, first, gid, label)
                    codes, size = [], 0
            if size:
                yield made(codes, first, gid, label)

    def made(codes: list[np.ndarray], first: np.ndarray, gid: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
        x, y = (first[c] for c in np.divmod(np.unique(np.concatenate(codes)), len(first)))
        swap = (gid[x] > gid[y]) | ((gid[x] == gid[y]) & (label[x] > label[y]))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (gid[x], label[x], gid[y], label[y])], ["gid", "label", "other_gid", "other_label"])

    by = ["h", "a", "b"]
    return (units.repartition(*by).sortWithinPartitions(*by)
            .mapInArrow(run, "gid bigint, label bigint, other_gid bigint, other_label bigint").distinct())


def possible(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v, n, m, s, t) whose sketches s, t do not rule them out: (u, v)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for n, m, s, t in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "s", "t"))):
                size = min(len(s), len(t))
                a, b = folded(np.frombuffer(s, np.uint8), size), folded(np.frombuffer(t, np.uint8), size)
                differ = int(np.bitwise_count(a ^ b).sum())
                good.append(UNDER * min(n, m) >= OVER * max(n, m) and (OVER + UNDER) * differ <= (UNDER - OVER) * (n + m))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "u bigint, v bigint")


def whole_sets(texts: DataFrame, members: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(key, own): the sets of ``keys``, each from one text. Other texts are passed over by a
    table of fixed size."""
    chosen = stored(members.join(keys.distinct(), "key", "left_semi").select("key", "text_key"))
    wanted = np.zeros(TEXT_CLASSES, bool)
    for r in chosen.select(F.expr(f"pmod(text_key, {TEXT_CLASSES})").alias("c")).distinct().toLocalIterator():
        wanted[r.c] = True
    wanted_of = sent(texts.sparkSession, np.packbits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known, done = np.unpackbits(wanted_of()).view(bool), Words(), set()
        for batch in slices(batches, "text", SLICE_BYTES):
            rows = {}
            for t in batch.column("text"):
                text = t.as_py()
                text_key = xxhash.xxh64_intdigest(text, SEED)
                if wanted[text_key % TEXT_CLASSES] and text_key not in done:
                    rows[text_key] = shingle_set(text, width, known).view(np.int64)
            done |= rows.keys()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(rows), np.uint64).view(np.int64)), pa.array(list(rows.values()), pa.list_(pa.int64()))],
                                             ["text_key", "own"])

    return (texts.select("text").mapInArrow(run, "text_key bigint, own array<bigint>").join(chosen, "text_key")
            .dropDuplicates(["key"]).select("key", "own"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, a_at), (b, b_at) = flat(batch.column("a")), flat(batch.column("b"))
            good = []
            for k in range(batch.num_rows):
                x, y = a[a_at[k]:a_at[k + 1]], b[b_at[k]:b_at[k + 1]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append((OVER + UNDER) * common >= OVER * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return (pairs.join(sets.select(F.col("key").alias("u"), F.col("own").alias("a")), "u")
            .join(sets.select(F.col("key").alias("v"), F.col("own").alias("b")), "v").select("u", "v", "a", "b")
            .mapInArrow(run, "u bigint, v bigint"))


def _links(pairs: DataFrame, texts: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """Of pairs of keys (u, v) those whose sets are similar."""
    side = lambda key, n, s: members.select(F.col("key").alias(key), F.col("n").alias(n), F.col("sketch").alias(s))
    left = stored(possible(pairs.join(side("u", "n", "s"), "u").join(side("v", "m", "t"), "v").select("u", "v", "n", "m", "s", "t")))
    sets = stored(whole_sets(texts, members, left.select(F.explode(F.array("u", "v")).alias("key")), width))
    return stored(verified(left, sets))


def _classes(docs: DataFrame, width: int, link_empty: bool, fingerprint: Fingerprint = lambda own: 0, more: Pairs | None = None) -> DataFrame:
    """(doc_id, text_key, n, root, component_id) of every row, see similar_classes; ``root`` names the class."""
    texts = texts_of(docs)
    ranks, total = class_ranks(texts, width)
    ranks_of = sent(docs.sparkSession, ranks)
    rows = stored(described(texts, width, ranks_of, fingerprint))
    members = stored(rows.where("n > 0").select("key", "text_key", "n", "gid", "fp", "sketch", "mini").dropDuplicates(["key"]))
    parts = 1 << max(4, (total // UNDER // PART_ENTRIES).bit_length())
    met = stored(shared(entries(texts, width, ranks_of, parts)))

    groups = members.groupBy("gid").agg(F.min_by(F.struct("key", "mini"), "key").alias("least"))
    groups = stored(groups.select("gid", "least.key", "least.mini"))
    salt = F.when(F.col("crowd"), F.pmod(F.xxhash64("gid"), F.lit(DEALT))).otherwise(0)
    first = nearest(met.where("lead").withColumn("salt", salt).join(groups, "gid"))
    inside = members.join(groups.select("gid", F.col("key").alias("u")), "gid").where("u < key").select("u", F.col("key").alias("v"))
    pairs = first.union(inside)
    links = _links(stored(pairs.union(more[0](members.select("key", "fp"))).distinct() if more else pairs), texts, members, width)

    label = F.coalesce("root", "key")
    roots = stored(components(links).withColumnRenamed("node", "key"))
    named = stored(members.select("key", "gid", "n", "fp").join(roots, "key", "left").select("key", "gid", "n", "fp", label.alias("label")))
    classes = stored(named.groupBy("gid", "label").agg(F.first("n").alias("n")))
    split = classes.groupBy("gid").count().where("count > 1").select("gid")
    again = met.select("h", "gid", "p").join(classes, "gid").union(
        classes.join(split, "gid").select("gid", F.col("gid").alias("h"), F.lit(0).alias("p"), "label", "n").select("gid", "h", "p", "label", "n"))
    pairs = stored(group_pairs(again.select("h", "gid", "label", "n", "p")))
    one = named.select("gid", "label", F.col("key").alias("u"))
    two = named.select(F.col("gid").alias("other_gid"), F.col("label").alias("other_label"), F.col("key").alias("v"))
    expanded = pairs.join(one, ["gid", "label"]).join(two, ["other_gid", "other_label"]).select("u", "v")
    if more:
        expanded = stored(expanded.union(more[1](named.select("key", "fp", "label")))
                          .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    links = links.union(_links(expanded, texts, members, width))

    roots = components(links).withColumnRenamed("node", "key")
    least = rows.groupBy("key").agg(F.min("doc_id").alias("least"))
    least = stored(least.join(roots, "key", "left").select("key", "least", label.alias("root")))
    smallest = stored(least.groupBy("root").agg(F.min("least").alias("component_id")))
    found = rows.select("doc_id", "text_key", "key", "n").join(least.join(smallest, "root").select("key", "root", "component_id"), "key")
    alone = F.lit(False) if link_empty else F.col("n") == 0
    return found.select("doc_id", "text_key", "n", "root", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def similar_classes(docs: DataFrame, width: int = 5, link_empty: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; other columns
    are ignored): the smallest doc_id reachable over links of documents whose sets of
    ``width``-word shingles have a Jaccard similarity of at least 4/5.

    A text of fewer words is one shingle. Null texts and texts without words have the empty
    set and link with nothing, or, with ``link_empty``, with each other. Repeated rows give
    repeated rows. A null doc_id is never the smallest; a class with no other has a null
    component_id. An empty table gives an empty result. Shingles and sets are known by
    64-bit hashes.

    Bounds: what is sent to tasks are two tables of fixed size (ranks of classes of
    shingles, classes of wanted texts). Copies of a set are one member before anything is
    compared. Very long texts are held one at a time. Pairs of the second meeting are as
    many as there are groups of different classes that neither sizes nor positions tell
    apart; they are dealt out in units of at most two parts of PART groups.
    """
    return _classes(docs, width, link_empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def deduplicated(docs: DataFrame, width: int = 5, fingerprint: Fingerprint = lambda own: 0, more: Pairs | None = None) -> DataFrame:
    """``docs`` (all columns) without near copies: of each class of similar_classes, texts
    without words being one class, the document with the smallest doc_id stays.

    Rows equal in doc_id and text are one document and give one row, with the other columns
    of any of them; rows of one doc_id and different texts are judged each by its own class.
    Rows without a doc_id cannot be told apart from their copies by name and stay as they
    are. Most rows pass by a table of fixed size (classes of what goes or is repeated);
    only the rest is joined with the list of what goes, so few texts are shuffled.
    """
    found = stored(_classes(docs, width, True, fingerprint, more).where("doc_id IS NOT NULL").groupBy("doc_id", "text_key")
                   .agg(F.count("*").alias("copies"), F.min("root").alias("root"), F.min(F.col("doc_id") == F.col("component_id")).alias("least")))
    first = found.where("least").groupBy("root").agg(F.min("text_key").alias("first"), F.count("*").alias("texts"))
    several = stored(first.where("texts > 1").select("root", "first"))
    found = found.join(several, "root", "left").withColumn("stays", F.col("least") & (F.col("first").isNull() | (F.col("text_key") == F.col("first"))))
    found = stored(found.where("copies > 1 OR NOT stays").select("doc_id", "text_key", "stays"))
    place = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(ROW_CLASSES))
    marked = stored(found.select(place.alias("c")).distinct())  # ROW_CLASSES rows at most
    text_key = F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text_key.alias("text_key"))
    rows = rows.withColumn("c", F.when(F.col("doc_id").isNotNull(), place))
    passing = rows.join(F.broadcast(marked), "c", "left_anti").select("row.*")
    asked = (rows.join(F.broadcast(marked), "c", "left_semi")
             .join(found.where("NOT stays").select("doc_id", "text_key"), ["doc_id", "text_key"], "left_anti")
             .dropDuplicates(["doc_id", "text_key"]).select("row.*"))
    return passing.union(asked)


#: The same in DuckDB: every pair that shares a shingle is counted.
CLASSES_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[ 	-
]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE
      list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) END AS own FROM w),
e AS MATERIALIZED (SELECT doc_id, len(own) AS n, unnest(own) AS shingle FROM s),
links AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reached AS (SELECT u, v FROM links UNION SELECT reached.u, links.v FROM reached JOIN links ON reached.v = links.u)
SELECT doc_id, len(own)::BIGINT AS n_shingles, least(doc_id, coalesce(root, doc_id)) AS component_id
FROM s LEFT JOIN (SELECT u, min(v) AS root FROM reached GROUP BY u) ON u = doc_id
"""
