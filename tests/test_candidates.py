"""Truth rows for choosing among candidate texts."""

import re

from pyspark.sql import functions as F

from plumbline.catalogue import APPLIANCE as CAT
from plumbline.functions import lookup
from plumbline.operators import candidates as X, extract as E

FOUR = "NAME: a\nMODEL: b\nVERSION: c\nBRAND: d"


def test_equal_texts_take_first_mode(spark):
    df = spark.createDataFrame([(1, [("a", "MODEL: x"), ("b", "MODEL: x")])], "doc int, texts array<struct<mode:string,text:string>>")
    assert X.best_page_text(df, ["doc"]).first()["mode"] == "a"
    assert X.longest_page_text(df, ["doc"]).first()["mode"] == "a"


def test_best_page_prefers_fields_over_length(spark):
    df = spark.createDataFrame([(1, [("long", "word " * 90), ("fields", "MODEL: x")])], "doc int, texts array<struct<mode:string,text:string>>")
    assert X.best_page_text(df, ["doc"]).first()["mode"] == "fields"
    assert X.longest_page_text(df, ["doc"]).first()["mode"] == "long"


def cands(spark, texts):
    rows = [(1, n, [(i + 1, line, 0.9) for i, line in enumerate(t.split("\n"))]) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc int, candidate_no int, lines array<struct<line_no:int,text:string,score:double>>")


def test_first_candidate_stops_early(spark):
    nine = FOUR + "\nS/N: 12345\nPOWER: 5W\nVOLTAGE: 3V\nFREQUENCY: 50Hz\nIP: X4"
    scored = X.score_candidates(cands(spark, [FOUR, nine]))
    assert X.best_candidate(scored.drop("lines"), ["doc"]).first()["candidate_no"] == 0
    scored = X.score_candidates(cands(spark, ["NAME: a", nine, nine]))
    assert X.best_candidate(scored.drop("lines"), ["doc"]).first()["candidate_no"] == 1


def test_line_filter(spark):
    df = spark.createDataFrame([(1, [(1, " a ", 0.3), (2, "b", 0.29), (3, " ", 0.9), (4, "c", None), (5, "d", 0.5)]), (2, [])],
                               "doc int, lines array<struct<line_no:int,text:string,score:double>>")
    got = {r["doc"]: (r["raw_text"], r["confidence"], [x["seq"] for x in r["kept"]]) for r in X.with_line_stats(df).collect()}
    assert got == {1: ("a\nd", 0.4, [1, 2]), 2: ("", 0.0, [])}


def test_drawing_choice(spark):
    long = "MODEL: b\nVERSION: c " + "x" * 90  # three fields with the model's twin
    rows = [(1, "MODEL: b\nVERSION: c", "MODEL: b\nVERSION: c", None), (2, long, "NAME: a", None),
            (3, FOUR + "x" * 80, FOUR, None), (4, "", FOUR, "engine lost")]
    df = spark.createDataFrame(rows, "id int, direct_text string, ocr_text string, ocr_error string")
    got = {r["id"]: (r["parse_mode"], len(r["warnings"])) for r in X.choose_drawing_text(df).collect()}
    assert got == {1: ("ocr", 1), 2: ("text", 1), 3: ("text", 0), 4: ("text", 2)}


def test_warnings(spark):
    df = spark.createDataFrame([(0, 0.5), (3, 0.65), (3, 0.64999)], "n long, c double")
    got = [r[0] for r in df.select(F.size(X.quality_warnings("n", "c"))).collect()]
    assert got == [2, 0, 0]


def test_empty_pages_count_as_zero(spark):
    line = "array<struct<line_no:int,text:string,score:double>>"
    pages = spark.createDataFrame([(1, [(1, "a", 0.9)]), (1, [(1, "b", 0.2), (2, " ", 0.9)]), (2, [(1, "c", 0.25)]), (3, [])], f"doc int, lines {line}")
    got = {r["doc"]: (r["confidence"], r["n_pages"]) for r in X.page_confidence(pages, ["doc"]).collect()}
    assert got == {1: (0.45, 2), 2: (0.25, 1), 3: (0.0, 1)}


def test_failed_recognition_keeps_the_text_layer(spark):
    df = spark.createDataFrame([("short", None, "boom")], "direct_text string, ocr_text string, ocr_error string")
    r = X.choose_drawing_text(df).first()
    assert r["parse_mode"] == "text" and r["raw_text"] == "short" and r["warnings"][1] == "PDF OCR失败，保留文字层结果：boom"


TEXTS = ["", None, FOUR, "MODEL\nQR\nB2\nMade in china", "Model NO: x9\r\nS/N  77 88 　 z\rRated Voltage : 22O V~", "IP\n\nX4\x0bBRAND NAME: q\fCODE 10012345",
         "能效标签 LABEL-ENERGY\n产品名称/NAME\n洗衣机", "model number Z-1\nRated Capacity of Wash : 5 kg", "MODELK x\nſerial no: 5k\nMODEL"]


def test_row_form_gives_the_same_hits(spark):
    """The expression used inside arrays against the columns; model twins count both."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    both = E.with_hits(df).select("id", "hits", F.array_sort(E.hits_in_row(F.col("text"))).alias("row_hits"), "text")
    for r in both.collect():
        assert sorted(r["hits"], key=lambda h: h["ord"]) == sorted(r["row_hits"], key=lambda h: h["ord"]), r["text"]
    counted = E.record_from_hits(both.withColumn("o", E.ords_of_hits(F.col("hits"), CAT)), CAT)
    assert all(r["o"] == r["ords"] for r in counted.collect())


def test_page_choice_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, [("a", "MODEL: x"), ("b", FOUR)]), (2, []), (3, None), (4, [("a", None)])],
                               "doc int, texts array<struct<mode:string,text:string>>")
    for got in (X.best_page_text(df, ["doc"]), X.rank_modes(df, ["doc"])):
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    ranked = sorted((r["doc"], r["rank"], r["mode"], r["n_fields"]) for r in X.rank_modes(df, ["doc"]).collect())
    assert ranked == [(1, 1, "b", 5), (1, 2, "a", 2), (4, 1, "a", 0)]
    assert sorted(r["doc"] for r in X.best_page_text(df, ["doc"]).collect()) == [1, 4]


def test_trie_finds_what_single_words_find():
    """One pattern against one test per word, over odd ends and letters with several cases."""
    words = list(dict.fromkeys(w.upper() for _, _, w in CAT.label_words))
    one = re.compile(lookup.word_trie(words), re.I)
    for word in words:
        for text in (word, word + " NO", word[:-1], word.lower() + "x", "x" + word):
            fits = [w for w in words if text.upper().startswith(w)]
            found = one.match(text)
            assert (found[0].upper() if found else "") == max(fits, key=len, default="")
