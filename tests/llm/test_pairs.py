"""SimHash, decontamination, neighbours: against brute force."""

import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import decontaminate, neighbours, simhash
from plumbline.llm.common import table
from plumbline.llm.graph import components


def slow_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def slow_classes(fps, radius):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(spark, documents):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base), (3, base + " more"), (9, base.upper()), (None, base), (2, None), (8, ""), (1, " \t"), (1, " \t"),
            (20, "one"), (21, "One"), (22, "x " * 50000), (None, "only this one has no id at all")]
    got = simhash.near_duplicates(documents(rows)).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    classes = slow_classes(fps, 4)
    expected = []
    for (doc_id, _), fp, c in zip(rows, fps, classes):
        ids = [r[0] for r, k in zip(rows, classes) if k == c and r[0] is not None]
        expected.append((doc_id, f"{fp:016x}", min(ids, default=None)))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert simhash.near_duplicates(documents([])).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1), min_size=1, max_size=8), st.integers(0, 2 ** 32), st.integers(0, 7))
def test_bit_planes_find_what_counting_finds(bases, seed, radius):
    rng = np.random.default_rng(seed)
    fps = []
    for b in bases:
        for _ in range(rng.integers(1, 40)):
            fps.append(b ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 10)))))
    fps = np.array(fps, np.uint64)
    u, v = simhash.group_links(fps, np.array([0, len(fps)]), radius)
    place = {int(f): i for i, f in reversed(list(enumerate(fps)))}
    assert all(place[int(a)] >= 0 and place[int(b)] >= 0 for a, b in zip(u, v))
    groups = {}
    label = list(range(len(fps)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a
    for a, b in zip(u, v):
        x, y = find(place[int(a)]), find(place[int(b)])
        label[max(x, y)] = min(x, y)
    for i, c in enumerate(slow_classes([int(f) for f in fps], radius)):
        groups.setdefault(c, set()).add(find(place[int(fps[i])]))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_large_buckets_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)
    rng = np.random.default_rng(1)
    fps = sorted({int(b) ^ (1 << int(k)) for b in rng.integers(0, 2 ** 63, 5) for k in rng.integers(0, 63, 60)})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.fingerprint_links(df, 2)).collect()}
    classes = slow_classes(fps, 2)
    assert [roots.get(f, f) for f in fps] == [fps[c] for c in classes]


def test_all_sizes_of_keys_find_every_link():
    rng = np.random.default_rng(0)
    for count in (10, 10 ** 6, 10 ** 9, 10 ** 12):
        masks = simhash.candidate_masks(count, 4)
        for _ in range(200):
            differ = sum(1 << int(k) for k in rng.choice(64, 4, replace=False))
            assert any(m & differ == 0 for m in masks)


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 0, 200: 200, 201: 200}


def test_one_of_each_class_stays(spark, documents):
    base = " ".join(f"word{i}" for i in range(200))
    docs = documents([(5, base), (3, base), (3, base), (7, "quite another text, but a short one"), (None, base), (8, None)])
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(
        [(3, base), (7, "quite another text, but a short one"), (None, base), (8, None)], key=str)


def slow_distance(item, text):
    """Least edits between the item and any run of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=70), st.lists(st.integers(0, 3), max_size=90))
def test_bit_parallel_distance(item, text):
    found = decontaminate.myers(item, text, len(item))
    if text:
        assert min((d for _, d in found), default=len(item)) == min(slow_distance(item, text), len(item))
    best = decontaminate.best_match(item, text, len(item) // 2)
    if best:
        d, a, b = best
        assert slow_distance(item, text[a:b]) == d == slow_distance(item, text)


def test_items_are_found_with_edits(spark, documents):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron"
    words = item.split()
    swapped = words[:4] + ["WRONG"] + words[5:9] + words[10:]  # two edits of three allowed
    far = [w if i % 2 else "no" for i, w in enumerate(words)]
    docs = documents([(1, "x " * 30 + item.upper().replace(" ", ", ") + " y"), (2, "p " * 9 + " ".join(swapped)), (3, " ".join(far)), (4, None),
                      (5, ""), (6, "q " * 60000 + item), (None, item), (7, item), (7, item), (8, " ".join(words[:7]))])
    items = spark.createDataFrame([(10, item, 1), (11, None, 1), (12, "too short", 1), (None, "one two three four five six seven eight nine", 1)],
                                  "item_id bigint, text string, words int")
    got = sorted(((r.doc_id, r.item_id, r.distance, r.first_word, r.end_word) for r in decontaminate.find_items(docs, items).collect()), key=str)
    assert got == sorted([(1, 10, 0, 30, 45), (2, 10, 2, 9, 23), (6, 10, 0, 60000, 60015), (None, 10, 0, 0, 15), (7, 10, 0, 0, 15), (7, 10, 0, 0, 15)], key=str)
    one_by_one = decontaminate.find_items(docs, items, pass_words=10)
    assert sorted(((r.doc_id, r.item_id, r.distance, r.first_word, r.end_word) for r in one_by_one.collect()), key=str) == got
    left = decontaminate.decontaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 8]
    assert decontaminate.find_items(documents([]), items).count() == 0
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == docs.count()


def test_short_items_and_unspaced_scripts(spark, documents):
    """Items of one to seven words as they stand, letters without spaces one by one, equal items once each."""
    texts = {1: "Say a b c d e f g h now", 2: "a b c x d e f g", 3: "前面这是一个测试后面", 4: "这是 一 个测 试", 5: "这是一个错试", 6: "gfedcba a", 7: "ก่อนทดสอบครับ"}
    given_items = {n: " ".join("abcdefg"[:n]) for n in range(1, 8)} | {20: "这是一个测试", 21: "A, B", 22: "ทดสอบ", 23: "?!", 24: ""}
    items = spark.createDataFrame(list(given_items.items()), "item_id bigint, text string")

    def words(text):
        return re.findall(r"[\u4e00-\u9fff\u0e00-\u0e7f]|[^\W_\u4e00-\u9fff\u0e00-\u0e7f]+", re.sub(r"[\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]", " ", text.lower()))
    want = sorted((d, i) for d, t in texts.items() for i, item in given_items.items() if (w := words(item))
                  and any(words(t)[k:k + len(w)] == w for k in range(len(words(t)))))
    docs = documents(list(texts.items()))
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_items(docs, items).collect()) == want
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_items(docs, items, pass_words=4).collect()) == want
    assert (3, 20) in want and (7, 22) in want and (1, 7) in want and (2, 7) not in want


def test_neighbours_against_brute_force(spark, sf):
    vectors = table(spark, sf, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.select("vec_id", "embedding").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), tree_rows=60, query_rows=3).collect()
    hits = total = 0
    for q in np.nonzero(ids % 20 == 0)[0]:
        score = x @ x[q]
        best = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == ids[q])
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert all(abs(m[2] - score[ids == m[1]][0]) < 1e-12 for m in mine)
        hits, total = hits + len({m[1] for m in mine} & set(ids[best])), total + len(best)
    assert hits / total >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (None, [1.0, 1.0]), (8, [1.0]), (9, [-1.0, 0.5]), (9, [-1.0, 0.5])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in neighbours.nearest(df, df.where("vec_id = 0"), k=3).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 9, -1.0)]
    assert neighbours.nearest(df.limit(0), df).count() == 0
    assert neighbours.nearest(df, df.limit(0)).count() == 0
