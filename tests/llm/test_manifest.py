"""The Merkle manifest and whitening against plain versions of them."""

import hashlib
import zlib

import numpy as np
import pytest

from plumbline.llm import merkle, whitening


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    values = (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def slow_tree(digests):
    """Root and every leaf's path [(sibling on the left?, sibling or None)], level by level."""
    paths, place, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, p in enumerate(place):
            other = p ^ 1
            paths[i].append((bool(p & 1), level[other] if other < len(level) else None))
            place[i] = p // 2
        level = [h(*level[k:k + 2]) for k in range(0, len(level), 2)]
    return level[0], paths


def slow_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    first = lambda v: (v is not None, v if v is not None else "")
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (first(r[0])[0], r[0] or 0, leaf(r)))
        trees.append((own, *slow_tree([leaf(r) for r in own])))
    root, upper = slow_tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), above in zip(trees, upper):
        for r, path in zip(own, paths):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            digest = leaf(r, int(changed))
            for left, sibling in path + above:
                digest = h(sibling, digest) if left else h(digest, sibling or "")
            out.append((r[0], leaf(r), subroot, root, h(*(s or "" for _, s in path + above)), digest, digest == root))
    return sorted(map(repr, out))


CASES = [
    ("one", [(5, "a", "en", "s", 1)]),
    ("many", [(i * 3 % 101, f"text {i}", ("en", "de", None, "é", "")[i % 5 if i % 3 else 0], "s" if i % 2 else None, i) for i in range(101)]),
    ("odd", [(None, None, None, None, None), (None, "", "en", "", 0), (1, "x", "en", "s", 1), (1, "x", "en", "s", 1), (1, "y", "en", "s", 1),
             (2 ** 63 - 1, "z" * 300_000, "en", "s", 2 ** 63 - 1), (-4, "\U0001f600 ü", "zz", "-", -1)]),
]


@pytest.mark.parametrize("bits", [1, 3, 12])
@pytest.mark.parametrize("name, rows", CASES)
def test_manifest(spark, monkeypatch, bits, name, rows):
    """Blocks of two and of eight leaves make several rounds; one block holds all in the third."""
    monkeypatch.setattr(merkle, "BITS", bits)
    docs = spark.createDataFrame([(*r, "d", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, pos int")
    got = [repr((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)) for r in merkle.manifest(docs).collect()]
    assert sorted(got) == slow_manifest(rows)


def test_manifest_of_nothing(documents):
    assert merkle.manifest(documents([])).collect() == []


def test_sweeps_hold_few_messages():
    """The queue's size follows the levels, not the leaves."""
    most = 0

    class Counted(list):
        def append(self, x):
            super().append(x)
    block = merkle.Block([h(str(i)) for i in range(1000)], 10)
    push = merkle.heapq.heappush
    try:
        def counted(queue, item):
            nonlocal most
            push(queue, item)
            most = max(most, len(queue))
        merkle.heapq.heappush = counted
        block.downward(b"=")
    finally:
        merkle.heapq.heappush = push
    assert most <= 2 * 10 + 2


def slow_whitened(rows, top=16, weigh=False):
    """rows: (id, integer vector)"""
    vectors = [v for _, v in rows] if weigh else list(dict.fromkeys(v for _, v in rows))
    x = np.array(vectors, object)
    n, sums = len(x), x.sum(axis=0)
    exact = (n * x - sums).astype(np.float64) / n
    e, v = np.linalg.eigh(exact.T @ exact / n)
    order = [i for i in np.argsort(-e)[:top] if e[i] > 1e-9]
    out = {}
    for i, own in rows:
        gap = n * np.array(own, object) - sums
        for k, c in enumerate(order, 1):
            out.setdefault((i, k), []).append((n, int((gap ** 2).sum()), (gap.astype(float) / n) @ v[:, c] / np.sqrt(e[c]), e[c] / e.sum()))
    return out


def check_whitened(got, want):
    assert len(got) == sum(map(len, want.values()))
    signs = {}
    for r in got:
        n, deviation, white, share = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.explained - share) <= 1e-9 * share and 0 <= r.identity_error <= 1e-8
        if abs(white) > 1e-6:
            assert signs.setdefault(r.component, np.sign(r.whitened * white)) == np.sign(r.whitened * white)
        assert abs(abs(r.whitened) - abs(white)) < 1e-7


def integer_rows(spark, rows):
    return spark.createDataFrame([(i, list(v), 9, "k") for i, v in rows], "vec_id bigint, x array<bigint>, n int, key string")


def test_whitening(spark):
    """Copies, a hot vector, a constant dimension, large offsets; with and without weights."""
    rng = np.random.default_rng(5)
    rows = [(i, (*(int(v) for v in rng.integers(-200, 200, 6) + 10 ** 9), 77)) for i in range(80)]
    rows += [(100 + i, rows[0][1]) for i in range(60)] + [(200, rows[3][1]), (200, rows[4][1])]
    for weigh in (False, True):
        got = whitening.whiten(integer_rows(spark, rows), top=4, weigh_copies=weigh)
        assert got.columns == ["vec_id", "key", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        want = slow_whitened(rows, 4, weigh)
        plain = [r for r in got.collect()]
        twice = [r for r in plain if r.vec_id == 200]
        check_whitened([r for r in plain if r.vec_id != 200], {k: v for k, v in want.items() if k[0] != 200})
        assert len(twice) == 8


def test_whitening_of_a_table(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, tuple(int(np.floor(64 * float(np.float64(np.float32(c))))) + 1_000_000 for c in r.embedding)) for r in vectors.collect()]
    check_whitened(whitening.whiten(whitening.integer_vectors(vectors).select("vec_id", "x")).collect(), slow_whitened(rows))


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    given = [(1, [0.5, 1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [1.0, -inf]), (6, [-0.01, 1e300]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [3.0, 1.0])]
    vectors = whitening.integer_vectors(spark.createDataFrame(given, "vec_id bigint, embedding array<double>"))
    x = {r.vec_id: r.x for r in vectors.collect()}
    assert x == {1: [1_000_032, 1_000_064], 6: [999_999, (1 << 53) + 1_000_000], 7: [], 8: [1_000_064, 1_000_128, 1_000_192], 9: [1_000_192, 1_000_064]}
    got = whitening.whiten(vectors.select("vec_id", "x")).collect()
    assert {r.vec_id for r in got} == {1, 6, 9} and all(r.deviation is None for r in got)
    one = whitening.whiten(vectors.where("vec_id = 1").select("vec_id", "x"))
    assert one.collect() == [] and whitening.whiten(vectors.limit(0).select("vec_id", "x")).collect() == []
