"""Mixing sources to target weights, with exact budgets per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: Ranges of the random key per source.
RANGES = 4096

#: The same mix for DuckDB, over ``documents``.
MIX_SQL = """
WITH sized AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
ranked AS (SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per),
fill AS (SELECT *, CAST(sum(s) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum(s) OVER (ORDER BY 2.0 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s_before,
    CAST(sum(w) OVER (ORDER BY 2.0 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_left
  FROM ranked),
level AS (SELECT max((1.5 * total - 2 * s_before) / w_left) AS lev FROM fill),
targets AS (SELECT source, s, least(2.0 * s, w * lev) AS target FROM fill CROSS JOIN level),
placed AS (
  SELECT z.doc_id, z.size, t.s AS source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.key, z.doc_id, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE size * (budget // source_size) + greatest(0, least(size, budget % source_size - before)) END AS taken
FROM placed
"""


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """``sizes`` (source, s: one row per source, summed before) with each source's target.

    Sources by code point, null last, take ``weights`` in turn. Target: min(epochs * s,
    weight * level), the level at which targets add up to ``share`` of all sizes: what
    capped sources leave over goes to the others by weight until none is above its cap.
    The sources are ordered in one task, which sees one small row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", weight.cast("bigint"))
    by_cap = Window.orderBy(F.lit(float(epochs)) * F.col("s") / F.col("w"), F.col("source").asc_nulls_last())
    fill = (ranked.withColumn("total", F.sum("s").over(Window.partitionBy()))
            .withColumn("s_before", F.coalesce(F.sum("s").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("w_left", F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))))
    left = share * F.col("total") - epochs * F.col("s_before")
    # by cap per weight, what is left for each unit of weight rises while sources below it
    # are capped and falls after: its greatest value is the level
    levelled = fill.withColumn("level", F.max(left / F.col("w_left")).over(Window.partitionBy()))
    target = F.least(F.lit(float(epochs)) * F.col("s"), F.col("w") * F.col("level"))
    return levelled.select("source", "s", target.alias("target"))


def random_key(doc_id: Column, text: Column) -> Column:
    """A digest of the doc_id, or of the text where there is none."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))))


def _placed(docs: DataFrame, weights: tuple[int, ...], share: float, epochs: int, ranges: int) -> DataFrame:
    """Each row's size and key, its source's size s and target, and the words before it."""
    sized = stored(docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("bigint").alias("size"),
                               random_key(F.col("doc_id"), F.col("text")).alias("key")))
    span = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * ranges / F.lit(1 << 32)).cast("int")
    sized = sized.withColumn("span", span)
    spans = sized.groupBy("source", "span").agg(F.sum("size").alias("inside"))
    aimed = targets(spans.groupBy("source").agg(F.sum("inside").alias("s")), weights, share, epochs)
    over_spans = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("earlier", F.coalesce(F.sum("inside").over(over_spans), F.lit(0)))
    spans = stored(spans.alias("p").join(aimed.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
                   .select(F.col("p.source").alias("in_source"), F.col("span").alias("in_span"), "earlier", "s", "target"))
    inner = Window.partitionBy("source", "span").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = sized.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return (ordered.join(spans, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("span") == F.col("in_span")))
            .withColumn("before", F.col("earlier") + F.col("before")).drop("in_source", "in_span", "earlier", "span"))


def _budget() -> Column:
    return F.round("target").cast("bigint")


def _whole() -> Column:
    """Whole epochs of the source."""
    return F.when(F.col("s") == 0, 0).otherwise(F.floor(_budget() / F.col("s"))).cast("bigint")


def _rest() -> Column:
    """Words of this row in the last, cut epoch."""
    rest = F.greatest(F.lit(0), F.least(F.col("size"), _budget() % F.col("s") - F.col("before")))
    return F.when(F.col("s") == 0, 0).otherwise(rest).cast("bigint")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS,
        ranges: int = RANGES) -> DataFrame:
    """How much of each document the mix takes. ``docs``: doc_id, text, source.

    Returns doc_id, source, size (words), source_size, target, taken. A source's budget is
    its rounded target: whole epochs of the source, then documents in the order of a random
    key (a digest of the doc_id) until the budget is reached; the document at the cut gives
    just the words missing. Reruns agree.

    The running sum is distributed: the key's first hex digits deal each source into
    ``ranges`` ranges; sums per range (combined before the shuffle) are accumulated over
    ranges, then each range is accumulated alone. Null and empty texts have size 0 and
    give 0 words; rows without source form the last source; documents without an id go
    by their text; equal rows are taken in any order, which gives the same rows. A source
    without words has target 0. An empty table gives an empty result.
    """
    placed = _placed(docs, weights, share, epochs, ranges)
    return placed.select("doc_id", "source", "size", F.col("s").alias("source_size"), "target",
                         (F.col("size") * _whole() + _rest()).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                    epochs: int = MOST_EPOCHS, ranges: int = RANGES) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a document comes once for each
    epoch that takes it whole; the one at its source's cut comes with just its first words
    up to the budget, joined by one space (n_chars follows). Documents without words come
    as often as the source has whole epochs, and once more before the cut.

    Each source's cut is one row, so the texts meet a table of one row per source. Rows
    equal in doc_id and size at the cut are all cut alike.
    """
    placed = _placed(docs, weights, share, epochs, ranges)
    last = F.max(F.when(_rest() > 0, F.struct("key", "doc_id", "size", _rest().alias("rest"))))
    cuts = placed.groupBy("source", "s", "target").agg(last.alias("last"))
    cuts = cuts.select(F.col("source").alias("_source"), F.struct(_whole().alias("whole"), "last").alias("_cut"))
    cuts = stored(cuts)
    rows = docs.select(F.struct("*").alias("row"))
    words = words_of(F.col("row.text"))
    mark = F.struct(random_key(F.col("row.doc_id"), F.col("row.text")).alias("key"), F.col("row.doc_id").alias("doc_id"), F.size(words).cast("bigint").alias("size"))
    at = F.struct("_cut.last.key", "_cut.last.doc_id", "_cut.last.size")
    joined = rows.join(cuts, F.col("row.source").eqNullSafe(F.col("_source"))).withColumn("mark", mark)
    before, at_cut = F.col("mark") < at, F.col("mark").eqNullSafe(at)
    rest = F.when(F.coalesce(at_cut, F.lit(False)), F.col("_cut.last.rest")).otherwise(F.col("mark.size"))
    times = F.col("_cut.whole") + F.when(F.col("_cut.last").isNull(), 0).otherwise((before | at_cut).cast("bigint"))
    epochs_of = joined.select("row", "_cut.whole", rest.alias("rest"), F.col("mark.size").alias("size"),
                              F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int")))).alias("epoch"))
    cut = (F.col("epoch") > F.col("whole")) & (F.col("rest") < F.col("size"))
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("rest").cast("int")), " ")).otherwise(F.col("row.text"))
    out = epochs_of.select("row", cut.alias("cut"), text.alias("text"))
    shown = {"text": F.col("text"), "n_chars": F.when(F.col("cut"), F.length("text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(shown[c] if c in shown else F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
