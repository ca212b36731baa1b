"""Language, toxicity and the pipeline: held-out accuracy, gradients, odd rows."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontaminate, language, mixing, packing, toxicity
from plumbline.llm.catalog import held_out
from plumbline.llm.common import stored, table
from tests.llm.test_similar import slow_kept

ODD = [(None, "Some words without an id"), (1, None), (2, ""), (3, "123 456 !"), (4, "The end of the story. " * 6000), (4, "The end of the story."), (4, "The end of the story.")]


def test_gradients():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    codes, target = rng.integers(0, 20, (7, 5)), rng.integers(0, 3, 5)
    codes[5:, 2] = 256
    _, grad = net.gradients(codes, target)
    for k in net.w:
        for at in [tuple(rng.integers(0, n) for n in net.w[k].shape) for _ in range(6)] + ([(0, int(codes[1, 1]))] if k[0] == "x" else []):
            loss = []
            for step in (1e-2, -1e-2):
                net.w[k][at] += step
                loss.append(net.gradients(codes, target)[0])
                net.w[k][at] -= step
            assert abs((loss[0] - loss[1]) / 2e-2 - grad[k][at]) < 3e-3


def test_segments_cover_whole_texts():
    data = np.arange(150, dtype=np.uint8)
    codes, row = language.segments(data, np.array([0, 0, 70, 150]), 64)
    assert row.tolist() == [1, 1, 2, 2]
    assert np.concatenate([c[c < 256] for c in codes.T]).tolist() == data.tolist()


def test_language_of_held_out_documents(spark, documents):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    net = language.fit(docs.where(~held_out(F.col("doc_id"))), sample_docs=700, rounds=150)
    kept = docs.where(held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    got = language.identify(kept, net).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    odd = language.identify(documents(ODD), net)
    assert odd.count() == len(ODD)
    said = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in odd.collect()}
    assert said[1, None] == said[2, ""] == said[3, "123 456 !"] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in said.values()) and said[4, ODD[4][1]][0] == "en"
    assert language.identify(documents([]), net).count() == 0
    nothing = language.fit(documents([(1, None), (2, "text")]))
    assert {r.lang_pred for r in language.identify(documents(ODD), nothing).collect()} == {"und"}


def slow_segments(scores):
    """All maximal scoring segments, by their recursive definition."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 0 and (best is None or (s, -(j - i)) > (best[2], -(best[1] - best[0]))):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return slow_segments(scores[:i]) + [best] + [(a + j, b + j, c) for a, b, c in slow_segments(scores[j:])]


def test_maximal_segments():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 20, 30):
        for _ in range(20):
            scores = rng.normal(-0.1, 1, n)
            got, want = toxicity.segments(scores), slow_segments(list(scores))
            assert [g[:2] for g in got] == [w[:2] for w in want]
            assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_toxicity_of_held_out_documents(spark, documents):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(toxicity.labelled_documents(docs.where(~held_out(F.col("doc_id"))), labels))
    rows = toxicity.score(docs.where(held_out(F.col("doc_id"))), model).join(labels, "doc_id").select("score", "toxic").toPandas()
    rank = rows.score.rank()
    ones = rows.toxic == 1
    assert (rank[ones].mean() - (ones.sum() + 1) / 2) / (~ones).sum() > 0.85
    odd = toxicity.score(documents(ODD + [(9, "You idiot, you worthless clown")]), model).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert max(odd, key=lambda r: r.score).doc_id == 9
    nothing = toxicity.fit(toxicity.labelled_documents(documents(ODD), labels.limit(0)))
    assert toxicity.score(documents(ODD), nothing).count() == len(ODD)
    assert toxicity.score(documents([]), model).count() == 0


def test_stages_keep_columns_and_odd_rows(spark, documents, sf):
    line = " ".join(f"word{i}" for i in range(80))
    docs = documents(ODD + [(20, line, "en", "s"), (21, line, "en", "s"), (22, "Le chat et le chien de la maison", "fr", None)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        kept = {(r.doc_id, r.text) for r in out.collect()}
        assert kept <= {(r.doc_id, r.text) for r in docs.collect()} or name == "mix"
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        if name == "near_copies":
            assert (20, line) in kept and (21, line) not in kept


def test_pipeline(spark, sf):
    """Every stage against a plain version of it, each on what the stage before kept."""
    kept = [table(spark, sf, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], sf)))
    texts = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in kept[:4]]
    # language: only documents without a letter, or unclear ones, go
    assert all(any(c.isalpha() for c in t) for t in texts[1].values())
    assert texts[1].items() <= texts[0].items() and len(texts[1]) >= 0.98 * len(texts[0])
    # near copies: the smallest id of each class
    assert set(texts[2]) == slow_kept(list(texts[1].items()))
    # benchmark: the distance to every item, without the search for pieces
    words = lambda t: [hash(w) for w in re.findall(r"[^\W_]+", t.lower())]
    items = [words(r.text) for r in table(spark, sf, "benchmark").collect()]
    leaks = {i for i, t in texts[2].items() for item in items if len(item) >= 8 and decontaminate.myers(item, words(t), len(item) // 5)}
    assert set(texts[3]) == set(texts[2]) - leaks
    # mix: whole epochs and one cut document per source
    taken = {r.doc_id: r.taken for r in mixing.mix(kept[3]).collect()}
    shown = Counter()
    for r in kept[4].collect():
        shown[r.doc_id] += len(r.text.split())
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in shown.items() if n}
    # pack: the ids of every row come back
    tokens, parts = packing.encoding(packing.RANKS), {}
    for r in kept[5].collect():
        ids = np.frombuffer(r.input_ids, "<u2")
        for row, doc, start, a, b in zip(r.row_ids, r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault((row, doc), []).append((start, ids[a:b]))
    back = Counter((doc, tokens.decode(np.concatenate([p for _, p in sorted(found, key=lambda f: f[0])])[:-1].tolist())) for (_, doc), found in parts.items())
    assert back == Counter((r.doc_id, r.text) for r in kept[4].collect())
