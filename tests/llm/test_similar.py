"""The grouped prefix join and the pipeline's near copies against brute-force Jaccard."""

import numpy as np
import pytest

from plumbline.llm import jaccard, simhash
from plumbline.llm.common import table


def slow_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def slow_classes(rows, link_empty=False):
    """(set size, smallest place) of each row, every pair compared."""
    sets = [slow_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            both = link_empty if not x and not y else x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)
            if both:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def slow_kept(rows):
    """The smallest id of each class."""
    rows = sorted(rows)
    return {rows[k][0] for k, (_, c) in enumerate(slow_classes(rows, True)) if c == k}


def copies_of_texts(seed=3):
    """Edited copies on both sides of the bound, a crowded group, short and empty texts."""
    rng = np.random.default_rng(seed)
    rows, i = [(0, ""), (1, " \t"), (2, "one"), (3, "One "), (4, "a b c d e f"), (5, "a b c d e g"), (6, "a b c d e")], 10
    for base in range(12):
        words = [f"w{base}x{k}" for k in range(int(rng.integers(20, 200)))]
        for _ in range(60 if base == 0 else 6):
            copy = list(words)
            for k in rng.integers(0, len(copy), int(rng.integers(0, 1 + len(copy) // 40))):
                copy[k] = f"e{rng.integers(10 ** 9)}"
            rows.append((i, " ".join(copy + ["all documents end in one and the same long line"])))
            i += 1
    return rows


def small_bounds(monkeypatch):
    """Small buffers, parts and units, few ranks: every path of the join is taken."""
    for name, value in {"PART": 8, "BUFFER": 300, "CROWD": 3, "DEALT": 3, "NEAR": 2, "TEXT_CLASSES": 64, "ROW_CLASSES": 64, "CLASS_BITS": 17, "PART_ENTRIES": 64,
                        "SLICE_BYTES": 2000, "KNOWN_WORDS": 50}.items():
        monkeypatch.setattr(jaccard, name, value)


@pytest.mark.parametrize("small", [False, True])
def test_classes(spark, documents, monkeypatch, small):
    if small:
        small_bounds(monkeypatch)
    rows = copies_of_texts() + [(500, None), (501, None), (502, "\u00c4 \u00e4"), (503, "\u00e4 \u00e4"), (504, "z " * 200_000), (505, "Z " * 200_001)]
    want = slow_classes(rows)
    got = jaccard.similar_classes(documents(rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == {(i, n, rows[c][0]) for (i, _), (n, c) in zip(rows, want)}


def test_classes_without_second_links_are_split_groups(spark, documents, monkeypatch):
    """With no first meeting at all the second one finds every link."""
    monkeypatch.setattr(jaccard, "nearest", lambda rows: rows.select(rows["key"].alias("u"), rows["key"].alias("v")).limit(0))
    rows = copies_of_texts(7)
    got = jaccard.similar_classes(documents(rows), link_empty=True)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, rows[c][0]) for (i, _), (_, c) in zip(rows, slow_classes(rows, True))}


def test_members_of_one_group(spark, documents, monkeypatch):
    """Sets with one prefix and size: alike and not alike, and linked only through others."""
    monkeypatch.setattr(jaccard, "prefix", lambda own, ranks: np.array([9], np.uint64))
    monkeypatch.setattr(jaccard, "prefix_length", lambda n: 1)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[:40 - 4 * (k % 6)] + [f"x{k % 6}y{j}" for j in range(4 * (k % 6))])) for k in range(12)]
    got = {r.doc_id: r.component_id for r in jaccard.similar_classes(documents(rows)).collect()}
    assert got == {i: rows[c][0] for (i, _), (_, c) in zip(rows, slow_classes(rows))}


def test_odd_rows(spark, documents):
    rows = [(None, "some words that stand here twice"), (7, "some words that stand here twice"), (7, "some words that stand here twice"), (7, "other"), (None, None)]
    got = sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.similar_classes(documents(rows)).collect())
    assert got == [("7", 1, 7), ("7", 2, 7), ("7", 2, 7), ("None", 0, None), ("None", 2, 7)]
    assert jaccard.similar_classes(documents([])).collect() == []


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_are_those_of_similarity_four_fifths(spark, documents, monkeypatch, small):
    if small:
        small_bounds(monkeypatch)
    rows = copies_of_texts()
    got = simhash.deduplicated(documents(rows))
    assert sorted(r.doc_id for r in got.collect()) == sorted(slow_kept(rows))


def test_rows_of_one_id_are_judged_by_their_texts(spark, documents):
    rows = [(2, "A"), (4, "A"), (4, "B"), (4, "B"), (5, "B"), (None, "A"), (None, "A")]
    got = simhash.deduplicated(documents(rows))
    assert sorted((repr(r.doc_id), r.text) for r in got.collect()) == [("2", "A"), ("4", "B"), ("None", "A"), ("None", "A")]


def test_fingerprints_find_near_copies(spark, documents, monkeypatch):
    """With the join by shingles cut off, what SimHash alone finds goes, if its set is similar."""
    monkeypatch.setattr(jaccard, "nearest", lambda rows: rows.select(rows["key"].alias("u"), rows["key"].alias("v")).limit(0))
    monkeypatch.setattr(jaccard, "group_pairs", lambda rows: rows.selectExpr("gid", "label", "gid AS other_gid", "label AS other_label").limit(0))
    words = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(words[:500 * k] + [f"x{k}"] + words[500 * k + 1:])) for k in range(6)] + [(9, "other words altogether")]
    assert {r.doc_id for r in simhash.deduplicated(documents(rows)).collect()} == {0, 9}
    assert slow_kept(rows) == {0, 9}


def test_equal_fingerprints_are_decided_on_sets(spark, documents, monkeypatch):
    monkeypatch.setattr(simhash, "majority", lambda own: 5)
    rows = copies_of_texts(5)
    assert sorted(r.doc_id for r in simhash.deduplicated(documents(rows)).collect()) == sorted(slow_kept(rows))


def test_close_sets(spark):
    """Only pairs within the radius; each set that has a close one gets one."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 20)
    fps = [int(base[k % 20]) ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 4)), replace=False)) for k in range(200)]
    got = {(r.u, r.v) for r in simhash.close_sets(spark.createDataFrame(list(enumerate(fps)), "key bigint, fp bigint")).collect()}
    assert got and all((fps[u] ^ fps[v]).bit_count() <= simhash.RADIUS for u, v in got)
    near = {v for v in range(200) for u in range(200) if u != v and (fps[u] ^ fps[v]).bit_count() <= simhash.RADIUS}
    assert near == {k for pair in got for k in pair}


def test_near_copies_of_a_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == slow_kept(rows)


def test_what_goes_has_a_near_copy(spark, sf):
    """Document 192 has fingerprints within 7 bits, but no other document of similarity 0.8: it stays."""
    docs = table(spark, sf, "documents")
    sets = {r.doc_id: slow_set(r.text or "") for r in docs.select("doc_id", "text").collect()}
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    for i in sets.keys() - kept:
        assert any(5 * len(sets[i] & s) >= 4 * len(sets[i] | s) for j, s in sets.items() if j != i), i
    assert 192 in kept


def test_fingerprints_within_the_radius_are_all_compared(spark, documents, monkeypatch):
    """With the join by shingles cut off, similar sets meet also where each has a closer one that is not."""
    monkeypatch.setattr(jaccard, "nearest", lambda rows: rows.select(rows["key"].alias("u"), rows["key"].alias("v")).limit(0))
    monkeypatch.setattr(jaccard, "group_pairs", lambda rows: rows.selectExpr("gid", "label", "gid AS other_gid", "label AS other_label").limit(0))
    fps = {60: 0, 30: 1, 61: 6, 31: 7, 62: 3, 32: 3}
    monkeypatch.setattr(simhash, "majority", lambda own: fps[len(own)])
    words = [f"w{k}" for k in range(64)]
    rows = [
        (1, " ".join(words)), (2, " ".join(f"b{k}" for k in range(34))), (3, " ".join(words + ["e0"])),
        (4, " ".join(f"d{k}" for k in range(35))), (5, " ".join(words + ["e1", "e2"])), (6, " ".join(f"f{k}" for k in range(36)))]
    assert slow_kept(rows) == {1, 2, 4, 6}
    assert sorted(r.doc_id for r in simhash.deduplicated(documents(rows)).collect()) == [1, 2, 4, 6]


@pytest.mark.parametrize("part", [3, 4096])
def test_apart_sets(spark, monkeypatch, part):
    """All pairs within the radius and of different labels, from buckets whole or dealt out."""
    monkeypatch.setattr(simhash, "PART", part)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 8)
    fps = [int(base[k % 8]) ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 4)), replace=False)) for k in range(150)]
    labels = [int(k) for k in rng.integers(0, 3, 150)]
    rows = [(k, fps[k], labels[k]) for k in range(150)]
    got = {(min(r), max(r)) for r in map(tuple, simhash.apart_sets(spark.createDataFrame(rows, "key bigint, fp bigint, label bigint")).collect())}
    assert got == {(u, v) for v in range(150) for u in range(v) if labels[u] != labels[v] and (fps[u] ^ fps[v]).bit_count() <= simhash.RADIUS}


def test_near_copies_under_one_id(spark, documents):
    """Different texts of one id and class are near copies of each other: one stays."""
    rows = [(4, "A b"), (4, "a B"), (4, "C"), (5, "a b"), (7, ""), (7, None), (7, " ")]
    got = sorted((r.doc_id, (r.text or "").strip().lower()) for r in simhash.deduplicated(documents(rows)).collect())
    assert got == [(4, "a b"), (4, "c"), (7, "")]
