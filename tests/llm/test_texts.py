"""Repeats, personal data, packing, mixing: against brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from plumbline.llm import mixing, packing, pii, repeats, substrings, suffixes
from plumbline.llm.common import table

LAST = 2 ** 63 - 1
LINE = " ".join(f"w{i}" for i in range(60))
TEXTS = [(None, LINE), (None, LINE), (-5, None), (-4, ""), (-3, "a b " * 120), (-2, "a b " * 120 + " c"), (10 ** 9, LINE + " x"), (10 ** 9 + 1, "y " + LINE),
         (10 ** 9 + 2, "x" * 5000), (10 ** 9 + 3, "ab" * 60 + LINE[:150] + "q" + LINE[50:300] + LINE[20:200]), (10 ** 9 + 4, "é" * 300)]


@pytest.fixture(params=["one chunk", "many chunks, hot anchors"])
def chunks(request, monkeypatch):
    if request.param != "one chunk":
        monkeypatch.setattr(repeats.gathered, "__defaults__", (30000,))
        monkeypatch.setattr(repeats, "HOT_PATHS", 8)


def some_documents(spark, sf, documents):
    docs = table(spark, sf, "documents").select("doc_id", "text").limit(150)
    return docs.union(documents(TEXTS).select("doc_id", "text"))


def test_repeated_word_windows(spark, sf, documents, chunks):
    docs = some_documents(spark, sf, documents).union(documents([(10 ** 9, LINE + " x")]).select("doc_id", "text"))
    rows = [(LAST if r.doc_id is None else r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
    least = {}
    for i, w in rows:
        for k in range(len(w) - 49):
            key = tuple(w[k:k + 50])
            least[key] = min(i, least.get(key, i))
    expected = Counter()
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 49):
            if least[tuple(w[k:k + 50])] < i:
                gone.update(range(k, k + 50))
        expected[i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    got = substrings.remove_repeated_windows(docs).collect()
    assert Counter((LAST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got) == expected
    assert all(r.n_removed == sum(s.end_word - s.first_word for s in r.spans) for r in got)


def test_repeated_bytes(spark, sf, documents, chunks):
    docs = some_documents(spark, sf, documents).where("doc_id IS NOT NULL")
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    seen, expected = set(), Counter()
    for i, w in rows:
        gone = np.zeros(len(w) + 2, np.int8)
        for k in range(len(w) - 99):
            if w[k:k + 100] in seen:
                gone[k + 1:k + 101] = 1
            seen.add(w[k:k + 100])
        expected[i, len(w), int(gone.sum()), int((np.diff(gone) == 1).sum()), bytes(x for x, g in zip(w, gone[1:]) if not g)] += 1
    got = suffixes.remove_repeated_bytes(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == expected


def test_repeats_of_nothing(spark, documents):
    assert substrings.remove_repeated_windows(documents([])).count() == 0
    assert suffixes.remove_repeated_bytes(documents([])).count() == 0
    twice = suffixes.remove_repeated_bytes(documents([(None, LINE), (None, LINE), (4, LINE), (4, LINE)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in twice) == [("4", 0), ("4", len(LINE)), ("None", len(LINE)), ("None", len(LINE))]


@pytest.mark.parametrize("remove", [substrings.remove_repeated_windows, suffixes.remove_repeated_bytes])
def test_texts_are_shuffled_once(spark, sf, remove):
    """Both joins of the chunks read one exchange of them."""
    got = remove(table(spark, sf, "documents"))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan.*\bblob#", plan)) == 1


def test_difference_cover():
    cover = suffixes.difference_cover()
    assert {(int(a) - int(b)) % suffixes.COVER for a in cover for b in cover} == set(range(suffixes.COVER))
    assert suffixes._NEXT.max() < suffixes.STEP


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits),
            "phone": 10 <= len(digits) <= 15}[kind]


def test_personal_data(spark, sf, documents):
    mine = [(None, None), (-1, ""), (-2, "a@b.c_d@e.f x@y..z 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255 4111 1111 1111 1111 12 -34 4111-1111-1111-1111-9 "
            "+1 (555) 123-4567 é𝔸+44 20 7946 0958. aaa@@b.c a@b.c.d@e.f.. +12345678901234567 0378282246310005 1..2.3.4.5 %a@b-c.de_%f@g.h"),
            (-3, "5" * 20000), (-4, "+0" + " " * 20000), (-6, "1 " * 9000), (-7, "+1 1 1 1 1 1 1 1 1 1 1."), (-7, "same id"), (-8, "a@b.c " * 400)]
    docs = table(spark, sf, "documents").select("doc_id", "text").union(documents(mine).select("doc_id", "text"))
    texts = Counter()
    for r in docs.collect():
        spans = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, r.text or "") if valid(k, m.group())]
        shown = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        texts[r.doc_id, hashlib.sha256(shown.encode()).hexdigest(), *(sum(s[3] == k for s in spans) for k in BASE)] += 1
    got = pii.find_personal_data(docs).collect()
    assert Counter((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == texts
    assert pii.find_personal_data(documents([])).count() == 0


def test_long_domains_and_very_many_spans(spark, documents):
    """A domain of 200,000 dots, two million dots without one, and 20,000 addresses in one text."""
    many = " ".join(f"a{i}@b.c" for i in range(20_000))
    got = {r.doc_id: r for r in pii.find_personal_data(documents([(1, "x@a" + ".b" * 200_000 + " y@z"), (2, "@a" + "." * 2_000_000), (3, many), (4, "q@r..s u@v.w.")])).collect()}
    assert got[1].n_email == 1 and got[1].spans == "email:0:400003" and got[2].n_email == 0
    places = [(m.start(), m.end()) for m in re.finditer(r"\S+", many)]
    assert got[3].spans == ",".join(f"email:{a}:{b}" for a, b in places) and got[3].n_email == 20_000
    assert got[4].spans == "email:7:12"


def test_more_kinds_need_consent(spark, documents):
    docs = documents([(1, "IBAN: GB82 WEST 1234 5698 7654 32, ssn: 123-45-6789. Dear Mr. John Smith"), (2, "GB00 WEST 1234 5698 7654 32 and 000-12-1234")])
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    assert got == {1: "iban:6:33,ssn:40:51,person:58:72", 2: ""}


def test_votes_are_weighed():
    counts = {"+0000": 50, "+++00": 40, "-000-": 60, "-00-0": 20}
    prior, tables = pii.reliabilities(counts)
    assert pii.posterior("+++00", prior, tables) > 0.9 and pii.posterior("-000-", prior, tables) < 0.1


def test_packed_rows_give_the_ids_back(spark, sf, documents):
    docs = table(spark, sf, "documents").select("doc_id", "text").limit(60).union(
        documents([(None, None), (-1, ""), (-2, "long text " * 9000), (-3, "twice"), (-3, "twice"), (-4, "<|endoftext|> ü𝔸")]).select("doc_id", "text"))
    rows = packing.pack(docs, row_tokens=256, pool_tokens=4096).collect()
    tokens, parts = packing.encoding(packing.RANKS), {}
    for r in rows:
        ids, positions = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 256 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens:] == packing.END_ID).all()
        for row, doc, start, a, b in zip(r.row_ids, r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (positions[a:b] == np.arange(b - a)).all()
            parts.setdefault((row, doc), []).append((start, ids[a:b]))
    texts = []
    for (_, doc), found in parts.items():
        ids = np.concatenate([p for _, p in sorted(found, key=lambda f: f[0])])
        assert ids[-1] == packing.END_ID
        texts.append((doc, tokens.decode(ids[:-1].tolist())))
    assert Counter(texts) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert packing.pack(documents([])).count() == 0


def test_very_long_white_space(spark, documents):
    """Two million blanks or line ends would exhaust the tokenizer's stack in one run."""
    texts = {1: " " * 2_000_000, 2: "a" + "\n" * 2_000_000 + " b", 3: "x" + " \t" * 80_000, 4: " " * packing.GAP + "y", 5: "c"}
    parts = {}
    for r in packing.pack(documents(list(texts.items()))).collect():
        ids = np.frombuffer(r.input_ids, "<u2")
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(doc, []).append((start, ids[a:b]))
    tokens = packing.encoding(packing.RANKS)
    assert {doc: tokens.decode(np.concatenate([p for _, p in sorted(found, key=lambda f: f[0])])[:-1].tolist()) for doc, found in parts.items()} == texts


def test_best_fit_decreasing():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 400).tolist()
    bins, slow = packing.best_fit_decreasing(lengths, 100), []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in slow if 100 - sum(b) >= n]
        if fits:
            max(fits, key=sum).append(n)
        else:
            slow.append([n])
    assert sorted(i for b in bins for i in b) == list(range(400))
    assert sorted(sum(lengths[i] for i in b) for b in bins) == sorted(map(sum, slow))


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= over


def test_mix(spark, documents):
    rng = np.random.default_rng(5)
    rows = [(int(i), "w " * int(rng.integers(0, 40)), "en", ["b", "a", "é", "z", None, "A"][int(rng.integers(0, 6)) if i % 3 else 0]) for i in range(400)]
    rows += [(None, "no id", "en", "b"), (None, None, "en", "b"), (7, "again and again", "en", "a"), (7, "again and again", "en", "a"), (999, "", "en", "empty")]
    docs = documents(rows)
    got = mixing.mix(docs, ranges=16).collect()
    size = lambda t: len((t or "").split())
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = slow_targets(sizes)
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, size(t), s) for i, t, _, s in rows)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-6 for r in mine)
        assert sum(r.taken for r in mine) == round(targets[s]) or abs(targets[s] % 1 - 0.5) < 1e-9
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, ranges=1000).collect()))
    assert mixing.mix(documents([])).count() == 0
    db = duckdb.connect()
    frame = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841
    db.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM frame")
    assert Counter(map(str, db.execute(mixing.MIX_SQL).fetchall())) == Counter(str((r.doc_id, r.size, r.source_size, r.target, r.taken)) for r in got)


def test_mixed_documents(spark, documents):
    docs = documents([(i, f"some words of document {i} " * (i % 5 + 1), "en", "abc"[i % 3]) for i in range(90)])
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    words, texts = Counter(), {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert texts[r.doc_id].split()[:len(r.text.split())] == r.text.split() and r.n_chars == len(r.text)
    assert {i: n for i, (_, n) in taken.items() if n} == dict(words)
    assert mixing.mixed_documents(documents([])).count() == 0
