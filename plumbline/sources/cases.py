"""Cases from file listings and manifests; raw files by content."""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline import fixed_values as fv
from plumbline.catalogue import APPLIANCE, Catalogue
from plumbline.functions import text as T
from plumbline.operators import extract as E, records as R
from plumbline.operators.skew import join_unique
from plumbline.session import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # its task functions travel with the job

MANIFEST_SCHEMA = "case_id string, drawing string, labels array<string>"


LISTING = "path string, is_dir boolean"
#: File systems that tasks can list themselves.
TASK_SCHEMES = ("file", "hdfs", "s3", "gs", "abfs", "abfss")
#: Directories that a task lists for each one it is given before it leaves the rest to the next round.
LISTED_DIRS = 64
#: Rows handed over at a time by tasks, and by the driver for other file systems.
LISTING_ROWS = 10_000


def _list_below(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """(path, is_dir, open): entries of the given directories and of some below them; ``open``
    marks directories whose entries are still to be listed."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    fs, top = FileSystem.from_uri(uri)
    top = top.rstrip("/")
    rows: list[tuple[str, bool, bool]] = []
    for batch in batches:
        for given in batch.column("path").to_pylist():
            waiting, left = deque([given]), LISTED_DIRS
            while waiting and left:
                left -= 1
                at = waiting.popleft()
                for entry in fs.get_file_info(FileSelector(f"{top}/{at}" if at else top or "/")):
                    name = f"{at}/{entry.base_name}" if at else entry.base_name
                    is_dir = entry.type == FileType.Directory
                    if is_dir:
                        waiting.append(name)
                    else:
                        rows.append((name, False, False))
                if at != given:
                    rows.append((at, True, False))
                if len(rows) >= LISTING_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "is_dir", "open"])
                    rows = []
            rows += [(name, True, True) for name in waiting]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "is_dir", "open"])


def _list_by_tasks(spark: SparkSession, uri: str) -> DataFrame:
    """Frontier rounds: tasks list the directories that the round before left open."""
    open_dirs, rounds = spark.createDataFrame([("",)], "path string"), []
    while True:
        tasks = max(1, min(open_dirs.count() // 8 + 1, 4 * spark.sparkContext.defaultParallelism))
        found = saved(open_dirs.repartition(tasks).mapInArrow(lambda batches: _list_below(batches, uri), LISTING + ", open boolean"))
        rounds.append(found.select("path", "is_dir"))
        open_dirs = found.where("open").select("path")
        if open_dirs.isEmpty():
            return reduce(DataFrame.union, rounds)


def _list_on_driver(spark: SparkSession, fs, top, prefix: str) -> DataFrame:
    """For file systems that only the JVM knows: one call per directory, names part by part to shared storage."""
    parts, rows, waiting = [], [], [top]
    while waiting:
        for entry in fs.listStatus(waiting.pop()):
            path = entry.getPath()
            rows.append((path.toUri().getPath().removeprefix(prefix), entry.isDirectory()))
            if entry.isDirectory():
                waiting.append(path)
            if len(rows) == LISTING_ROWS:
                parts.append(saved(spark.createDataFrame(rows, LISTING)))
                rows = []
    return reduce(DataFrame.union, [*parts, spark.createDataFrame(rows, LISTING)])


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Relative paths of everything below ``root``, directories too (contents are not read).

    With or without a scheme in ``root``. Unlike Spark's own file index it shows empty
    files, empty directories and names with a leading ``_`` or ``.``. Directories are
    listed by tasks, round by round: each goes some directories deep and leaves the others
    to the next round, so neither a wide nor a deep tree passes the driver. File systems
    that only the JVM can open are listed on the driver.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(top)
    uri = top.toUri()
    if uri.getScheme() in TASK_SCHEMES:
        return _list_by_tasks(spark, f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getRawPath()}")
    return _list_on_driver(spark, fs, top, uri.getPath().rstrip("/") + "/")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Relative paths of all files below ``root``."""
    return list_tree(spark, root).filter("NOT is_dir").select("path")


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Raw documents: name, path, size, bytes and both digests."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).load(root))
    return files.select("path", T.file_name("path").alias("name"), "length", "content",
                        F.sha2("content", 256).alias("sha256"), F.sha1("content").alias("sha1"))


def has_suffix(path, suffixes: list[str]) -> Column:
    return T.file_suffix(path).isin(suffixes)


def images(files: DataFrame) -> DataFrame:
    return files.filter(has_suffix("path", fv.IMAGE_SUFFIXES))


def _case_files(files: DataFrame) -> DataFrame:
    """Entries inside a case directory, with their sort key. A listing without ``is_dir``
    holds files only."""
    is_dir = F.col("is_dir") if "is_dir" in files.columns else F.lit(False)
    parts = T.path_order("path")
    inner = files.withColumn("_parts", parts).withColumn("_is_dir", is_dir).filter(F.size("_parts") > 1)
    label_dir = F.when(((F.size("_parts") > 2) | F.col("_is_dir")) & F.lower(F.get("_parts", F.lit(1)))
                       .startswith(fv.LABEL_DIR_PREFIX), F.get("_parts", F.lit(1)))
    return inner.select("path", "_parts", "_is_dir", F.get("_parts", F.lit(0)).alias("case_id"),
                        label_dir.alias("label_dir"))


def choose_labels(files: DataFrame, cap: int = fv.MAX_LABELS_PER_CASE) -> DataFrame:
    """Label images of each case, numbered: (case_id, label_no, path).

    With label directories (empty ones count), the first image of each; else all loose images. The
    ``cap`` is the feature's own; ranking by it keeps only ``cap`` rows per case
    and task before the shuffle.
    """
    inside = _case_files(files)
    uses_dirs = inside.groupBy("case_id").agg(
        F.max(F.when(F.col("label_dir").isNotNull(), 1).otherwise(0)).alias("_dirs"))
    pictures = inside.filter(has_suffix("path", fv.IMAGE_SUFFIXES) & ~F.col("_is_dir"))
    firsts = (pictures.filter(F.col("label_dir").isNotNull())
              .groupBy("case_id", "label_dir").agg(F.min("_parts").alias("_parts"))
              .select("case_id", F.lit(1).alias("_dirs"), "_parts"))
    loose = pictures.select("case_id", F.lit(0).alias("_dirs"), "_parts")
    place = F.row_number().over(Window.partitionBy("case_id", "_dirs").orderBy("_parts"))
    ranked = (firsts.unionByName(loose).withColumn("label_no", place)
              .filter(F.col("label_no") <= cap))
    return (ranked.join(uses_dirs, ["case_id", "_dirs"])
            .select("case_id", "label_no", F.array_join("_parts", "/").alias("path")))


def scan_cases(files: DataFrame) -> DataFrame:
    """Manifest rows from a listing: first drawing and chosen labels of every case
    that has either. At most ``cap`` labels per case are ever gathered."""
    drawings = (_case_files(files).filter(has_suffix("path", fv.DRAWING_SUFFIXES) & ~F.col("_is_dir"))
                .groupBy("case_id").agg(F.array_join(F.min("_parts"), "/").alias("drawing")))
    labels = choose_labels(files).groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("label_no", "path")))["path"].alias("labels"))
    return (drawings.join(labels, "case_id", "full")
            .select("case_id", F.coalesce("drawing", F.lit("")).alias("drawing"),
                    F.coalesce("labels", F.array().cast("array<string>")).alias("labels")))


def read_manifest(spark: SparkSession, path: str, one_array: bool = True) -> DataFrame:
    """A manifest file (one JSON array) or a written manifest (JSON lines)."""
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", one_array).json(path)


def load_or_scan(spark: SparkSession, root: str, manifest: str) -> DataFrame:
    """The manifest wins; without one the listing is scanned and the manifest written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        scan_cases(list_tree(spark, root)).write.json(manifest)
    return read_manifest(spark, manifest, one_array=fs.getFileStatus(path).isFile())


def manifest_labels(manifest: DataFrame) -> DataFrame:
    return manifest.select("case_id", "drawing", F.posexplode("labels").alias("_i", "label_file")).select(
        "case_id", "drawing", (F.col("_i") + 1).alias("label_no"), "label_file")


def dedupe_content(docs: DataFrame, key: str, content: Column) -> DataFrame:
    """Digest, the document first holding it, and whether this one repeats it.

    Contents seen in very many documents are matched by broadcast (see skew).
    """
    hashed = docs.withColumn("content_sha256", F.sha2(content, 256))
    first = hashed.groupBy("content_sha256").agg(
        F.min(key).alias("first_" + key), F.count("*").alias("n_copies"))
    joined = join_unique(hashed, first, ["content_sha256"], "n_copies", [key])
    return joined.withColumn("from_cache", F.col(key) != F.col("first_" + key))


def extract_distinct(docs: DataFrame, key: str, text: str, cat: Catalogue = APPLIANCE) -> DataFrame:
    """Records of all documents, each distinct text extracted once and its record handed
    to the copies. Very frequent texts are met by broadcast, the others by digest."""
    marked = saved(dedupe_content(docs.select(key, text), key, F.col(text)))
    first = marked.filter(~F.col("from_cache")).dropDuplicates(["content_sha256"])
    own = E.extract_fields(first, cat, text).select("content_sha256", "n_copies", *R.RECORD)
    copies = marked.select(key, "content_sha256", "from_cache")
    return join_unique(copies, own, ["content_sha256"], "n_copies", [key]).drop("n_copies")


def new_content(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose digest is not processed yet (incremental runs)."""
    return docs.join(known.select("content_sha256").distinct(), "content_sha256", "left_anti")
