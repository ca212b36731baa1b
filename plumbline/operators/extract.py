"""Field extraction: text -> record.

A field takes its value from the first stage that finds one: a value on the
label word's own line, a value on one of the next lines, a pattern anywhere in
the text, a known phrase. All stages work inside the row on its array of lines,
so extraction adds no shuffle whatever the number or size of documents.

Each stage yields hits ``(ord, stage, pick, line, rank, value)``; the smallest
hit of a field wins, so ``pick, line, rank`` say which one comes first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.catalogue import APPLIANCE, Catalogue
from plumbline.functions import lookup, text as T
from plumbline.operators import records as R
from plumbline.operators.skew import BLOCK_ROWS

HIT = "array<struct<ord:int,stage:int,pick:int,line:int,rank:int,value:string>>"
INLINE, ADJACENT, PATTERN, PHRASE = 1, 2, 3, 4



def _first_group(text: Column, patterns: list[str]) -> Column:
    """First group of the first pattern found; every such group is non-empty."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def _hit(ord_, stage, pick, line, rank, value) -> Column:
    def num(x):
        return (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.struct(num(ord_).alias("ord"), F.lit(stage).alias("stage"), num(pick).alias("pick"),
                    num(line).alias("line"), num(rank).alias("rank"), value.alias("value"))


def _accept(hits: Column, cat: Catalogue) -> Column:
    """Tidy the values, drop empty and noise ones, cut the long ones."""
    tidied = F.transform(F.filter(hits, lambda h: h["value"].isNotNull()),
                         lambda h: h.withField("value", T.tidy_piece(h["value"])))
    kept = F.filter(tidied, lambda h: ~lookup.is_noise(h["value"], cat))
    return F.transform(kept, lambda h: h.withField("value", T.cut_value(h["value"])))


class LabelWords:
    """Label words (field position, rank, word) as one trie, and what each word it finds implies.

    The trie gives the longest word that starts a line; the other words that start it are
    that word's own beginnings, known beforehand. So a line is read once, whatever the
    number of words.
    """

    def __init__(self, words: list[tuple[int, int, str]]):
        self.rows = [(pos, rank, word.upper()) for pos, rank, word in words]
        tails = r"(?=\s*[:：]|\s)"
        self.pattern = f"(?iU)^({lookup.word_trie(dict.fromkeys(w for _, _, w in self.rows))}){tails}"
        every = dict.fromkeys(w for _, _, w in self.rows)
        self.chains = lookup.WordTable({w: self._table([r for r in self.rows if w.startswith(r[2])]) for w in every})
        self.table = self._table(self.rows)

    @staticmethod
    def _table(rows: list[tuple[int, int, str]]) -> Column:
        return F.array(*[F.struct(F.lit(pos).alias("ord"), F.lit(rank).alias("rank"), F.lit(len(word)).alias("n"),
                                  F.lit(word).alias("word")) for pos, rank, word in rows])

    def head(self, line: Column) -> Column:
        """The longest label word at the start of a line that something follows, else ''."""
        return F.regexp_extract(line, self.pattern, 1)

    def starting(self, line: Column) -> Column:
        """All words that start the line (x, head). A head whose upper case is no word (letters
        with several lower cases) is looked up word by word."""
        slow = F.filter(self.table, lambda w: F.upper(F.substring(line["x"], F.lit(1), w["n"])) == w["word"])
        return F.coalesce(self.chains.of(F.upper(line["head"])), slow)


def _word_hits(lines: Column, words: LabelWords, after: list[str], stage: int) -> Column:
    """Hits of all label words that start a line and are followed by a value."""
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"), words.head(x).alias("head")))

    def on_line(s):
        return F.transform(words.starting(s), lambda w: _hit(
            w["ord"], stage, 0, s["i"], w["rank"], _first_group(F.substr(s["x"], w["n"] + 1), after)))
    return F.flatten(F.transform(F.filter(numbered, lambda s: s["head"] != ""), on_line))


def inline_hits(lines, cat: Catalogue, after=None, stage: int = INLINE) -> Column:
    return _word_hits(T.col(lines), LabelWords(cat.label_words), after or fv.AFTER_WORD, stage)


def _keyed_lines(lines, cat: Catalogue) -> Column:
    """(i, x, pos, noise): line number, line, position of the field it names, whether it is noise."""
    return F.transform(T.col(lines), lambda x, i: T.let(T.label_key(x), lambda k: F.struct(
        i.alias("i"), x.alias("x"), lookup.key_position(x, k, cat).alias("pos"), lookup.noise_key(k, cat).alias("noise"))))


def adjacent_hits(keyed, cat: Catalogue, ahead: int = fv.LOOKAHEAD_LINES) -> Column:
    """A label line takes the first non-noise line below it, up to the next label line."""
    keyed = T.col(keyed)

    def below(s):
        window = F.slice(keyed, s["i"] + 2, F.lit(ahead))
        return F.get(F.filter(window, lambda b: b["pos"].isNotNull() | ~b["noise"]), F.lit(0))
    label_lines = F.filter(keyed, lambda s: s["pos"].isNotNull())
    found = F.transform(label_lines, lambda s: F.struct(
        s["pos"].alias("ord"), s["i"].alias("i"), below(s).alias("b")))
    return F.transform(found, lambda f: _hit(
        f["ord"], ADJACENT, 0, f["i"], 0, F.when(f["b"]["pos"].isNull(), f["b"]["x"])))


def _hint(pattern: str) -> str | None:
    """Literal every match of the pattern starts with, if it plainly has one."""
    lead = re.match(r"(?:\\b)?([A-Za-z]+|[一-鿿]+)(.?)", pattern)
    if lead is None or "|" in re.sub(r"\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\)", "", pattern):
        return None
    word = lead[1][:-1] if lead[2] in "?*{" and lead[2] else lead[1]
    return word or None


def _has_word(low: Column, words) -> Column:
    """Does the folded text hold one of the words?"""
    tests = [low.contains(w.lower()) for w in words]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _folded(text: Column) -> Column:
    """Lower case, with the letters case-insensitive patterns also take for i."""
    return F.lower(T.replace_each(text, {"ı": "i", "İ": "i"}))


def joined_lines(nfkc: Column, lines: Column, clean: Column) -> Column:
    """The lines of the cleaned text, one below the other. They are the clean lines of the
    text itself, unless cleaning turns a line break into a blank."""
    return F.when(nfkc.rlike("\\r(?!\\n)|[\f\x0b]"), F.array_join(T.split_lines(clean), "\n")).otherwise(F.array_join(lines, "\n"))


def pattern_hits(clean, found_ords, cat: Catalogue, joined: Column | None = None) -> Column:
    """First matching pattern of each field not found yet, over the joined lines."""
    joined = F.array_join(T.split_lines(clean), "\n") if joined is None else joined

    def found_at(pos: int):
        return lambda w: _hit(pos, PATTERN, w["n"], 0, 0, w["g"])

    def search(t):
        text, low, found = t["text"], t["low"], t["found"]
        hits = []
        for pos, f in enumerate(cat.fields):
            if not f.patterns:
                continue
            groups = []
            for n, pattern in enumerate(f.patterns):
                group = F.nullif(F.regexp_extract(text, "(?iU)" + pattern, 1), F.lit(""))
                hint = _hint(pattern)
                given = f.pattern_words[n] if n < len(f.pattern_words) else ()
                words = given or ((hint,) if hint else ())
                groups.append(F.when(_has_word(low, words), group) if words else group)
            if len(groups) == 1:
                hits.append(F.when(~F.array_contains(found, pos), _hit(pos, PATTERN, 0, 0, 0, groups[0])))
                continue
            tried = [F.when(g.isNotNull(), F.struct(F.lit(n).alias("n"), g.alias("g"))) for n, g in enumerate(groups)]
            first = F.when(~F.array_contains(found, pos), F.coalesce(*tried))
            hits.append(T.let(first, found_at(pos)))
        return F.array(*hits)
    text = T.let(joined, lambda t: F.struct(
        t.alias("text"), _folded(t).alias("low"), T.col(found_ords).alias("found")))
    return T.let(text, search)


def phrase_hits(clean, found_ords, cat: Catalogue) -> Column:
    """Known phrases for fields nothing else found. Values are taken as they are,
    except the project name, which is checked like any other."""
    clean, found = T.col(clean), T.col(found_ords)
    rules: dict[str, Column] = {
        "made_in": F.when(clean.rlike("(?iU)" + fv.MADE_IN_CHINA_PATTERN), fv.MADE_IN_CHINA_VALUE)}
    brand = F.lit(None).cast("string")
    for b in reversed(fv.KNOWN_BRANDS):
        brand = F.when(clean.rlike(rf"(?iU)\b{re.escape(b)}\b"), b).otherwise(brand)
    rules["brand"] = brand
    name = F.lit(None).cast("string")
    for pattern, value in reversed(fv.LABEL_NAME_RULES):
        name = F.when(clean.rlike("(?iU)" + pattern), value).otherwise(name)
    rules["label_name"] = name
    def search(low):
        return F.array(*[_hit(at, PHRASE, 0, 0, 0, F.when(
            ~F.array_contains(found, at) & _has_word(low, fv.PHRASE_WORDS[i]), v))
            for i, v in rules.items() if (at := cat.position.get(i)) is not None]).cast(HIT)
    plain = F.filter(T.let(_folded(clean), search), lambda h: h["value"].isNotNull())
    if "project_name" not in cat.position:
        return plain
    at = cat.position["project_name"]
    project = F.when(~F.array_contains(found, at),
                     _first_group(clean, ["(?U)" + fv.PROJECT_NAME_PATTERN]))
    return F.concat(plain, _accept(F.array(_hit(at, PHRASE, 0, 0, 0, project)), cat))


def first_hits(hits) -> Column:
    """The first hit of every field."""
    return T.let(T.col(hits), lambda all_hits: F.transform(
        F.array_distinct(all_hits["ord"]),
        lambda o: F.array_min(F.filter(all_hits, lambda h: h["ord"] == o))))


def with_text_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """``_lines``: clean lines; ``_clean``: the whole cleaned text; ``_joined``: its lines in one."""
    return (df.withColumn("_nfkc", T.nfkc(text))
              .withColumn("_lines", T.split_lines("_nfkc"))
              .withColumn("_clean", T.tidy("_nfkc"))
              .withColumn("_joined", joined_lines(F.col("_nfkc"), F.col("_lines"), F.col("_clean")))
              .drop("_nfkc"))


def with_hits(df: DataFrame, cat: Catalogue = APPLIANCE, text: str = "text") -> DataFrame:
    """Add ``hits``: the winning hit of every field found in the text."""
    out = with_text_columns(df, text)
    out = out.withColumn("_keyed", _keyed_lines("_lines", cat))
    near = F.concat(_accept(inline_hits("_lines", cat), cat),
                    _accept(adjacent_hits("_keyed", cat), cat))
    out = out.withColumn("_near", near).withColumn("_near", first_hits("_near"))
    out = out.withColumn("_near", F.concat("_near", _accept(
        pattern_hits("_clean", F.col("_near")["ord"], cat, F.col("_joined")), cat)))
    out = T.fence(out, "hits", F.concat("_near", phrase_hits("_clean", F.col("_near")["ord"], cat)))
    return out.drop("_lines", "_clean", "_joined", "_keyed", "_near")


def hits_in_row(text: Column, cat: Catalogue = APPLIANCE) -> Column:
    """The hits of ``with_hits`` as one expression, for texts inside an array."""
    def parts(n):
        return T.let(F.struct(T.split_lines(n).alias("lines"), T.tidy(n).alias("clean")), lambda p: F.struct(
            p["clean"].alias("clean"), joined_lines(n, p["lines"], p["clean"]).alias("joined"), near(p["lines"]).alias("near")))

    def near(lines):
        return T.let(_keyed_lines(lines, cat), lambda keyed: first_hits(F.concat(
            _accept(inline_hits(lines, cat), cat), _accept(adjacent_hits(keyed, cat), cat))))

    def rest(p):
        found = F.concat(p["near"], _accept(pattern_hits(p["clean"], p["near"]["ord"], cat, p["joined"]), cat))
        return T.let(found, lambda f: F.concat(f, phrase_hits(p["clean"], f["ord"], cat)))
    return T.let(T.let(T.nfkc(text), parts), rest)


def ords_of_hits(hits: Column, cat: Catalogue) -> Column:
    """Positions of the fields that the record of these hits fills, in order."""
    def filled(ords):
        if cat.twins is None:
            return F.array_sort(ords)
        a, b = (F.lit(cat.position[t]) for t in cat.twins)
        more = F.when(F.array_contains(ords, a) | F.array_contains(ords, b), F.array_union(ords, F.array(a, b))).otherwise(ords)
        return F.array_sort(more)
    return T.let(hits["ord"], filled)


def _backfill(by_position: Column, cat: Catalogue) -> Column:
    """The two model fields stand in for each other."""
    if cat.twins is None:
        return by_position
    a, b = (cat.position[t] for t in cat.twins)
    return T.let(by_position, lambda vals: F.transform(vals, lambda v, i: (
        F.when((v == "") & (i == a), F.get(vals, F.lit(b)))
         .when((v == "") & (i == b), F.get(vals, F.lit(a))).otherwise(v))))


def by_position(hits: Column, cat: Catalogue) -> Column:
    """Array with each field's hit value, '' where there is none."""
    every = F.sequence(F.lit(0), F.lit(len(cat) - 1))
    both = F.struct(hits["ord"].alias("ords"), hits["value"].alias("vals"))
    return T.let(both, lambda h: F.transform(every, lambda i: R.value_at(h["ords"], h["vals"], i)))


def record_from_hits(df: DataFrame, cat: Catalogue, hits: str = "hits") -> DataFrame:
    return R.with_record(df, _backfill(by_position(F.col(hits), cat), cat), cat, cleaned=True)


def same_texts(df: DataFrame, keys: list[str], number: str, labels: str = "labels", text: str = "text") -> DataFrame:
    """Rows (``number`` counts them within the keys from 1) whose text is the same become one:
    keys, text and ``labels``, the list of what other columns they have.

    A list holds the rows of at most BLOCK_ROWS numbers; a text that goes on has further rows.
    What is read from the text is then read once; ``each_row`` gives the rows back.
    """
    rest = [c for c in df.columns if c not in (*keys, text)]
    block = F.floor((F.col(number) - 1) / BLOCK_ROWS)
    return df.groupBy(*keys, block.alias("_block"), text).agg(F.collect_list(F.struct(*rest)).alias(labels)).drop("_block")


def each_row(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Every row that ``same_texts`` put into the lists, with the other columns beside it."""
    others = [c for c in df.columns if c != labels]
    return df.select(F.inline(labels), *others)


def extract_fields(df: DataFrame, cat: Catalogue = APPLIANCE, text: str = "text") -> DataFrame:
    """Add the record (ords, vals, norms) extracted from each row's text."""
    return record_from_hits(with_hits(df, cat, text), cat).drop("hits")


def with_page_headers(pages: DataFrame, keys: list[str], page_no: str, text: str = "text") -> DataFrame:
    """Each page's text between its own header line and that of the page after it.

    A header is a line like any other, so it takes what a label word at the end of a
    page announces, and no value reaches beyond it. Pages are numbered without gaps.
    """
    last = pages.groupBy(*keys).agg(F.max(page_no).alias("_last"))
    before, after = fv.PAGE_HEADER

    def header(number) -> Column:
        return F.concat(F.lit(before), number.cast("string"), F.lit(after))
    following = F.when(F.col(page_no) < F.col("_last"), F.concat(F.lit(fv.PAGE_SEPARATOR), header(F.col(page_no) + 1)))
    return (pages.join(last, keys)
            .withColumn(text, F.concat(header(F.col(page_no)), F.col(text), F.coalesce(following, F.lit(""))))
            .drop("_last"))


def extract_document_fields(pages: DataFrame, keys: list[str], page_no: str,
                            cat: Catalogue = APPLIANCE, text: str = "text",
                            headers: bool = False) -> DataFrame:
    """One record per document from its pages, each extracted on its own.

    Only the few hits of a page are shuffled, and folding them is a minimum with
    partial aggregation, so a document may have any number of pages. ``headers``
    gives what the joined text of all pages under their header lines gives; without
    it a page end just ends the search.
    """
    if headers:
        pages = with_page_headers(pages, keys, page_no, text)
    hit = F.col("_h")
    rows = (with_hits(pages, cat, text)
            .select(*keys, F.col(page_no).alias("_page"), F.explode("hits").alias("_h"))
            .select(*keys, hit["ord"].alias("ord"), F.struct(
                hit["stage"].alias("stage"), hit["pick"].alias("pick"), F.col("_page").alias("page"),
                hit["line"].alias("line"), hit["rank"].alias("rank"), hit["value"].alias("value"))
                .alias("_o")))
    first = rows.groupBy(*keys, "ord").agg(F.min("_o").alias("_o"))
    folded = first.groupBy(*keys).agg(F.collect_list(
        F.struct("ord", F.col("_o.value").alias("value"))).alias("hits"))
    documents = pages.select(*keys).distinct()
    none = F.array().cast("array<struct<ord:int,value:string>>")
    whole = documents.join(folded, keys, "left").withColumn("hits", F.coalesce("hits", none))
    return record_from_hits(whole, cat).drop("hits")


def stage_values(df: DataFrame, keys: list[str], stage: int, cat: Catalogue = APPLIANCE,
                 text: str = "text") -> DataFrame:
    """What one stage alone finds: (keys, field_name, value)."""
    out = with_text_columns(df, text)
    if stage == INLINE:
        hits = first_hits(_accept(inline_hits("_lines", cat), cat))
    elif stage == ADJACENT:
        out = out.withColumn("_keyed", _keyed_lines("_lines", cat))
        hits = first_hits(_accept(adjacent_hits("_keyed", cat), cat))
    elif stage == PATTERN:
        hits = _accept(pattern_hits("_clean", R.no_ords(), cat), cat)
    else:
        hits = phrase_hits("_clean", R.no_ords(), cat)
    return (out.select(*keys, F.explode(hits).alias("_h"))
               .select(*keys, lookup.field_name_at("_h.ord", cat).alias("field_name"),
                       F.col("_h.value").alias("value")))


# --- the six-field profile --------------------------------------------------------
# The line below first (three lines, label words skipped, the last label line wins),
# then the same line; no compatibility normalisation, no noise test.

def extract_six_fields(df: DataFrame, cat: Catalogue, text: str = "text") -> DataFrame:
    out = df.withColumn("_lines", T.plain_lines(text))
    out = out.withColumn("_keyed", F.transform("_lines", lambda x, i: F.struct(
        i.alias("i"), x.alias("x"),
        lookup.six_field_position(T.six_field_key(x), cat).alias("pos"))))
    keyed = F.col("_keyed")

    def below(s):
        window = F.slice(keyed, s["i"] + 2, F.lit(fv.SIX_FIELD_LOOKAHEAD_LINES))
        return F.get(F.filter(window, lambda b: b["pos"].isNull()), F.lit(0))["x"]
    label_lines = F.filter(keyed, lambda s: s["pos"].isNotNull())
    # A negative line number makes the last label line the first hit.
    near = F.transform(label_lines, lambda s: _hit(s["pos"], 1, 0, -s["i"], 0, below(s)))
    words = LabelWords([(p, n, w) for p, f in enumerate(cat.fields) for n, w in enumerate(f.aliases)])
    same = _word_hits(F.col("_lines"), words, fv.SIX_AFTER_WORD, 2)
    hits = F.filter(F.concat(near, same), lambda h: h["value"].isNotNull())
    out = T.fence(out, "hits", first_hits(hits))
    return (R.with_record(out, by_position(F.col("hits"), cat), cat, cleaned=True)
             .drop("_lines", "_keyed", "hits"))
