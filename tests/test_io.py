"""Sources, sinks and streaming on small local folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from plumbline.catalogue import APPLIANCE as CAT
from plumbline.fixed_values import HISTORY_HEADERS
from plumbline.operators import compare as C, history as H, records as R
from plumbline.sources import cases as K, records, sinks
from plumbline.streaming import ingest
from tests.test_compare import drawings_of, labels_of


def touch(root, *paths):
    for p in paths:
        full = os.path.join(root, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(p)


def test_case_scan_and_manifest(spark, folder):
    root = os.path.join(folder, "root")
    touch(root, "c1/Label1/note.txt", "c1/label2/b.png", "c1/label2/a.JPG", "c1/loose.jpg", "c1/z.PDF", "c1/sub/a.pdf",
          "c2/1.jpg", "c2/2.jpeg", "c2/3.bmp", "c2/4.tif", "c2/5.tiff", "c2/6.png", "c3/readme.md")
    manifest = os.path.join(folder, "manifest")
    got = {r["case_id"]: (r["drawing"], r["labels"]) for r in K.load_or_scan(spark, root, manifest).collect()}
    assert got == {"c1": ("c1/sub/a.pdf", ["c1/label2/a.JPG"]),
                   "c2": ("", ["c2/1.jpg", "c2/2.jpeg", "c2/3.bmp", "c2/4.tif", "c2/5.tiff"])}
    touch(root, "c4/new.pdf")
    assert K.load_or_scan(spark, root, manifest).count() == 2  # the manifest wins
    array = os.path.join(folder, "cases.json")
    with open(array, "w") as f:
        json.dump([{"case_id": "x", "drawing": "d.pdf", "labels": ["a", "b"]}], f)
    rows = K.manifest_labels(K.load_or_scan(spark, root, array)).collect()
    assert [(r["label_no"], r["label_file"]) for r in rows] == [(1, "a"), (2, "b")]


def test_read_files_and_dedupe(spark, folder):
    touch(folder, "a.pdf", "b.txt")
    with open(os.path.join(folder, "c.pdf"), "w") as f:
        f.write("a.pdf")
    files = K.read_files(spark, folder, "*.pdf")
    assert files.count() == 2
    got = {r["name"]: r["from_cache"] for r in K.dedupe_content(files, "name", F.col("content")).collect()}
    assert got == {"a.pdf": False, "c.pdf": True}


def detections(spark):
    labels = labels_of(spark, [(1, 1, {"brand": "A"}), (1, 2, {"brand": "B"})]).withColumn(
        "at", F.lit("2026-01-02 03:04:05.678901").cast("timestamp_ntz"))
    compared = C.compare_to_drawing(labels, drawings_of(spark, [(1, {"brand": "A"})]), CAT)
    return H.assemble(compared, CAT, "at", ["case_id", "label_no"])


def test_save_is_repeatable_and_lookup_prunes(spark, folder):
    hist, det = folder + "/history", folder + "/detail"
    rows = detections(spark)
    for _ in range(2):
        sinks.save_detections(rows, hist, det, "b1")
    sinks.save_detections(rows.filter("result = 'FAIL'"), hist, det, "b2")
    history = sinks.read_history(spark, hist)
    assert history.count() == 3 and history.filter("batch = 'b1'").count() == 2
    one = history.filter("result = 'PASS'").first()["detection_id"]
    assert one.startswith("OCR-20260102-030405-678901-")
    found = H.detail_of(sinks.read_table(spark, det), one)
    assert found.first()["label_fields"] == {"brand": "A"}
    assert "PartitionFilters: [isnotnull(detection_date" in found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_details_json_skips_bad_lines(spark, folder):
    path = folder + "/d.jsonl"
    with open(path, "w") as f:
        f.write('{"detection_id": "a"}\n\n{broken\n{"detection_id": "b"}\n')
    got = sinks.read_details(spark, path, "detection_id string").collect()
    assert sorted(r[0] for r in got) == ["a", "b"]


def test_history_csv_with_display_header(spark, folder):
    path = folder + "/h.csv"
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write(",".join(HISTORY_HEADERS.values()) + "\nid,t,d,l,PASS,1,0,0,p\n")
    assert sinks.read_history_csv(spark, path, display_headers=True).first()["result"] == "PASS"
    with pytest.raises(Exception):
        sinks.read_history_csv(spark, path).collect()  # a wrong header is an error, nothing is overwritten


def test_exports(spark, folder):
    df = spark.createDataFrame([(1, "x")], "a int, t string")
    sinks.write_csv(df, folder + "/csv")
    assert spark.read.option("header", True).csv(folder + "/csv").first()["t"] == "x"
    sinks.write_text(df, "t", folder + "/text")
    assert spark.read.text(folder + "/text").first()[0] == "x"
    sinks.write_tables({"one": df}, folder + "/tables")
    assert spark.read.parquet(folder + "/tables/one").count() == 1


def test_history_search(spark):
    df = spark.createDataFrame([(1, "drawing_1.pdf", "label_x7.jpg", "PASS"), (2, None, "Label_a.jpg", "FAIL"), (3, "d", None, "FAIL")],
                               "detection_id int, drawing_file string, label_file string, result string").withColumn("detection_time", F.col("detection_id"))
    def ids(**kw):
        return [r["detection_id"] for r in H.search(df, **kw).collect()]
    assert ids(pattern="label_.*7") == [1] and ids(pattern="label_.*7", literal=True) == []
    assert ids(verdict="FAIL") == [3, 2] and ids(verdict="PASS", limit=2, limit_first=True) == []


PATTERNS = ["label_", "LABEL_.*7", "draw|abel_1", "^label_1$", "l.b", "x?label", "(?x) l a b e l", "(label|none)_1", "[", "a{2}bel", "ſtaſ", "kiss", "é_1", "\\\\d_1", "b\\\\.jpg", ""]


def test_search_by_trigrams_finds_what_a_scan_finds(spark):
    names = ["label_1", "Label_17.jpg", "LABEL_2", "draw_1", "abel_1", "é_1", "aabel", "stas", "ſtas", "KISS", "kıſs", "ab", "", None, "label\\x.jpg", "9_1b.jpg"]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in names for b in names[::3])],
                                 "id int, drawing_file string, label_file string")
    postings = H.name_postings(rows, "id")
    for literal in (False, True):
        for pattern in PATTERNS:
            try:
                want = sorted(r["id"] for r in rows.filter(H.file_matches(pattern, literal)).collect())
            except Exception:
                continue  # no pattern at all
            assert sorted(r["id"] for r in H.name_matches(rows, postings, "id", pattern, literal).collect()) == want, pattern
    assert H.sure_trigrams("LABEL_.*7|drawing_1.\\\\.") == [["abe", "bel", "el_", "lab"], ["awi", "dra", "g_1", "ing", "ng_", "raw", "win"]]
    assert H.sure_trigrams("a.c") is None and H.sure_trigrams("abc|d") is None


def test_content_store_reads_new_contents_only(spark, folder, monkeypatch):
    texts = spark.createDataFrame([(1, "MODEL: a"), (2, "MODEL: b"), (3, "MODEL: a"), (4, None), (5, "")], "id int, text string")
    read = []
    keep = records.E.extract_fields

    def counted(df, *more):
        read.append(df.count())
        return keep(df, *more)
    monkeypatch.setattr(records.E, "extract_fields", counted)

    def run(rows, name):
        got = records.extract_with_store(rows, "id", "text", folder + "/store", run=name).collect()
        return {r["id"]: (r["known"], list(r["vals"])) for r in got}
    assert run(texts.filter("id <= 2"), "one") == {1: (False, ["a", "a"]), 2: (False, ["b", "b"])}
    want = {1: (True, ["a", "a"]), 2: (True, ["b", "b"]), 3: (True, ["a", "a"]), 4: (False, []), 5: (False, [])}
    assert run(texts, "two") == want
    assert run(texts, "two") == want  # a run under its name again adds nothing
    assert read == [2, 1, 1] and records.stored_records(spark, folder + "/store").count() == 3
    plan = records.stored_records(spark, folder + "/store").filter("content_sha256 = 'x'")
    assert "PushedFilters: [IsNotNull(content_sha256), EqualTo(content_sha256,x)" in plan._jdf.queryExecution().toString()


def test_stream_equals_batch(spark, folder):
    texts = spark.createDataFrame(
        [(1, 1, "a.jpg", "MODEL: A1\nBRAND: x"), (1, 2, "b.jpg", "MODEL: A2"), (2, 1, "c.jpg", "")],
        "case_id int, label_no int, label_file string, text string").withColumn(
        "detected_at", F.lit("2026-01-02 03:04:05").cast("timestamp"))
    texts.repartition(3).write.parquet(folder + "/in")
    drawings = drawings_of(spark, [(1, {"product_model": "A1"})])
    stream = spark.readStream.schema(texts.schema).parquet(folder + "/in")
    # The name picks the checkpoint, which may lie in a shared folder: one per run.
    name = "labels-" + os.path.basename(folder)
    query = ingest.detection_stream(stream, drawings, folder + "/h", folder + "/d", name,
                                    folder + "/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["label_file"], r["result"]) for r in sinks.read_history(spark, folder + "/h").collect())
    want = sorted((r["label_file"], r["verdict"]) for r in ingest.compare_batch(texts, drawings).collect())
    assert got == want and len(got) == 3


def test_records_round_trip(spark):
    labels = labels_of(spark, [(1, 1, {"brand": " Ａ ", "serial_no": "", "nope": "x"}), (1, 2, {})])
    first = labels.filter("label_no = 1").first()
    assert (first["ords"], first["vals"], first["norms"]) == ([23], ["A"], ["A"])
    back = R.from_long(R.to_long(labels, ["case_id", "label_no"], CAT), ["case_id", "label_no"], CAT)
    assert back.count() == 1 and back.first()["vals"] == ["A"]


def test_listing_shows_everything_under_any_root(spark, folder):
    root = os.path.join(folder, "root")
    touch(root, "c1/loose.png", "_case3/a.pdf", "c4/.hidden.jpg", "c5/x.pdf")
    os.makedirs(os.path.join(root, "c1/label_empty"))
    open(os.path.join(root, "c5/empty.png"), "w").close()
    for where in (root, "file://" + root, "file:" + root + "/"):
        files = sorted(r["path"] for r in K.list_files(spark, where).collect())
        assert files == ["_case3/a.pdf", "c1/loose.png", "c4/.hidden.jpg", "c5/empty.png", "c5/x.pdf"]
        cases = {r["case_id"]: (r["drawing"], r["labels"]) for r in K.scan_cases(K.list_tree(spark, where)).collect()}
        # c1: its label directory is empty, so its loose image is not taken
        assert cases == {"_case3": ("_case3/a.pdf", []), "c4": ("", ["c4/.hidden.jpg"]), "c5": ("c5/x.pdf", ["c5/empty.png"])}


def test_listing_by_tasks(spark, folder, monkeypatch):
    """10,000 directories, wide and deep, in rounds of few: what the file system itself says."""
    root = os.path.join(folder, "tree")
    for i in range(9_900):
        os.makedirs(os.path.join(root, f"w{i % 99}", f"d {i}"))
    os.makedirs(os.path.join(root, *(f"%{k};" for k in range(100))))
    touch(root, "w1/d 1/a.pdf", "w1/.x/_y", "%0;/%1;/b.png")
    want = {(os.path.relpath(os.path.join(at, n), root), kind) for at, dirs, files in os.walk(root) for names, kind in ((dirs, True), (files, False)) for n in names}
    monkeypatch.setattr(K, "LISTED_DIRS", 40)
    called = []
    monkeypatch.setattr(K, "_list_on_driver", lambda *a: called.append(a))
    got = K.list_tree(spark, root).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and not called


def test_listing_on_the_driver(spark, folder, monkeypatch):
    touch(folder, "a/b/c.pdf", "a/.d")
    os.makedirs(os.path.join(folder, "e"))
    want = sorted(map(tuple, K.list_tree(spark, folder).collect()))
    monkeypatch.setattr(K, "TASK_SCHEMES", ())
    monkeypatch.setattr(K, "LISTING_ROWS", 2)
    assert sorted(map(tuple, K.list_tree(spark, folder).collect())) == want


def test_rerun_with_fewer_dates_leaves_none_behind(spark, folder):
    rows = detections(spark)
    later = rows.withColumn("detection_date", F.date_add("detection_date", F.when(F.col("result") == "FAIL", 1).otherwise(0)))
    sinks.save_detections(later, folder + "/h", folder + "/d", "b1")
    sinks.save_detections(rows.filter("result = 'PASS'"), folder + "/h", folder + "/d", "b2")
    sinks.save_detections(later.filter("result = 'PASS'"), folder + "/h", folder + "/d", "b1")
    assert sorted((r["batch"], r["result"]) for r in sinks.read_history(spark, folder + "/h").collect()) == [("b1", "PASS"), ("b2", "PASS")]
    assert sinks.read_table(spark, folder + "/d").count() == 2
    assert sinks.remove_uncommitted(spark, folder + "/h") == 2  # both dates of the write that b1 replaced
    assert sinks.remove_uncommitted(spark, folder + "/h") == 0
    assert sinks.read_history(spark, folder + "/h").count() == 2


def test_torn_write_is_not_seen(spark, folder):
    """Rows without a commit, and a detail whose history was not written, change nothing that readers see."""
    rows = detections(spark)
    with pytest.raises(ValueError):
        sinks.read_history(spark, folder + "/h")
    sinks.save_detections(rows.filter("result = 'PASS'"), folder + "/h", folder + "/d", "b1")
    sinks.write_rows(rows, folder + "/d")
    sinks.write_rows(H.summary_rows(rows), folder + "/h")
    assert sinks.read_history(spark, folder + "/h").count() == sinks.read_table(spark, folder + "/d").count() == 1
    sinks.save_detections(rows, folder + "/h", folder + "/d", "b1")
    assert sinks.read_history(spark, folder + "/h").count() == sinks.read_table(spark, folder + "/d").count() == 2
    assert len(os.listdir(folder + "/h/commits")) <= 2  # one file, and its check sum


def test_lookup_opens_one_date(spark, folder):
    """Files of other dates are no Parquet at all, so opening one would fail."""
    rows = detections(spark)
    later = rows.withColumn("detection_date", F.date_add("detection_date", F.when(F.col("result") == "FAIL", 1).otherwise(0)))
    sinks.save_detections(later, folder + "/h", folder + "/d", "b1")
    one = sinks.read_history(spark, folder + "/h").filter("result = 'PASS'").first()["detection_id"]
    other = folder + "/d/data/detection_date=2026-01-03"
    for at, _, names in os.walk(other):
        for name in names:
            with open(os.path.join(at, name), "wb") as f:
                f.write(b"no parquet")
    assert H.detail_of(sinks.read_table(spark, folder + "/d"), one).first()["label_fields"] == {"brand": "A"}
    with pytest.raises(Exception):
        sinks.read_table(spark, folder + "/d").count() or sinks.read_table(spark, folder + "/d").collect()


def test_appended_tables(spark, folder):
    rows = detections(spark)
    for _ in range(2):
        sinks.append_history(rows, folder + "/h")
        sinks.append_details(rows, folder + "/d")
    assert sinks.read_history(spark, folder + "/h").count() == 4
    details = sinks.read_table(spark, folder + "/d", "json")
    assert details.count() == 4 and details.filter("label_fields['brand'] = 'B'").count() == 2


def test_details_of_saved_tables(spark, folder):
    sinks.save_detections(detections(spark), folder + "/h", folder + "/d", "b1")
    history, details = sinks.read_history(spark, folder + "/h"), sinks.read_table(spark, folder + "/d").drop("batch")
    more = history.union(history.withColumn("detection_id", F.lit("none")).limit(1))
    got = H.with_details(more, details.union(details)).collect()
    found = {r["detection_id"]: r["detail"] and r["detail"]["label_fields"]["brand"] for r in got}
    assert len(got) == 3 and sorted(map(str, found.values())) == ["A", "B", "None"] and found["none"] is None
