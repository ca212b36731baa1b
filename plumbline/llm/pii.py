"""Personal data by weak supervision: labelers vote on candidate spans, expectation
maximisation weighs their votes, and a classifier trained on that decides. DataFrame
functions only; tables of fixed size reach the driver."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

#: The base kinds, in order. The patterns match what the plain ones
#: (in the comments) match from left to right, without quadratic scans or deep recursion.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ where it has 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further kinds, which need the classifier's consent.
MORE = {
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?",
}
KINDS = [*BASE, *MORE]
#: Substrings without which a text cannot hold the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Gazetteers of words that announce a kind.
ANNOUNCE = {
    "email": r"(?i)(?:e-?mail|mailto|contact|kontakt|courriel|correo|write to)",
    "ip": r"(?i)(?:\bip\b|address|host|server|client|login)",
    "card": r"(?i)(?:card|karte|carte|tarjeta|visa|master|amex|payment)",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|handy|fono)",
    "ssn": r"(?i)(?:ssn|social|security|tax)",
    "iban": r"(?i)(?:iban|bank|account|konto|compte|cuenta)",
    "person": r"(?i)(?:name|sincerely|regards|signed|author|dear|lieber|cher|hola)",
}
#: Words that announce something else.
OTHERWISE = r"(?i)(?:version|\bv\.?|section|chapter|isbn|issn|commit|order|invoice|figure|release)\W*$"
#: Characters before and after a span that the labelers see.
BEFORE, AFTER = 30, 10
#: Classes of the word before a span, by hash.
WORD_CLASSES = 256
#: Spans of a text whose places are added up together.
BLOCK = 256
LABELERS = 5
ROUNDS = 100
SPAN = "start int, end int, value string, before string, after string"


def found_spans(text: Column, pattern: str, needs: str | None = None) -> Column:
    """Matches from left to right with their places in code points and their surroundings.

    Places follow from the lengths of the matches and of the pieces between them; both
    scans find the same matches. Each is evaluated once per text, not once per match.
    """
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
                         gaps.alias("gap"), F.slice(gaps, F.lit(2), F.lit((1 << 31) - 1)).alias("next"))
    parts = F.filter(parts, lambda z: z["value"].isNotNull())
    length = lambda z: (F.length(z["gap"]) + F.length(z["value"])).cast("int")

    def step(z, at):
        return F.struct((at + F.length(z["gap"])).cast("int").alias("start"), (at + length(z)).cast("int").alias("end"), z["value"].alias("value"),
                        F.substring(z["gap"], -BEFORE, BEFORE).alias("before"), F.substring(z["next"], 1, AFTER).alias("after"))
    empty = F.array().cast(f"array<struct<{', '.join(c.replace(' ', ':') for c in SPAN.split(', '))}>>")

    def in_block(spans, at):
        return F.aggregate(spans, empty, lambda done, z: F.concat(done, F.array(step(z, F.when(
            F.size(done) > 0, F.element_at(done, -1)["end"]).otherwise(at)))))

    # an array grows by copying: blocks keep that short in texts of very many spans
    def by_block(parts):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)))
        ends = lambda blocks: F.aggregate(blocks, F.array(F.lit(0)), lambda done, block: F.concat(done, F.array(
            F.element_at(done, -1) + F.aggregate(block, F.lit(0), lambda n, z: n + length(z)))))
        both = F.transform(F.array(blocks), lambda b: F.struct(b.alias("blocks"), ends(b).alias("at")))[0]
        return F.flatten(F.transform(F.array(both), lambda x: F.transform(x["blocks"], lambda block, i: in_block(block, F.get(x["at"], i))))[0])

    spans = F.transform(F.array(parts), lambda p: F.when(F.size(p) > BLOCK, by_block(p)).otherwise(in_block(p, F.lit(0))))[0]
    return F.when(text.contains(needs), spans).otherwise(empty) if needs else spans


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn test."""
    digits = F.filter(F.split(F.reverse(digits_of(value)), ""), lambda d: d != "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def iban_rest(value: Column) -> Column:
    """The number modulo 97, letters as 10 to 35, first four characters last."""
    plain = F.regexp_replace(value, "\x20", "")
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def is_valid(kind: str, value: Column) -> Column:
    """Whether a match passes its kind's test."""
    part = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    if kind == "ip":
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits_of(value)).between(14, 19) & luhn(value)
    if kind == "phone":
        return F.length(digits_of(value)).between(10, 15)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "iban":
        return iban_rest(value) == 1
    return F.lit(True)


def votes(kind: str, span: Column, valid: Column) -> Column:
    """One character per labeler: + for, - against, 0 no opinion."""
    for_, against, none = F.lit("+"), F.lit("-"), F.lit("0")
    distinct = F.size(F.array_distinct(F.split(digits_of(span["value"]), "")))
    return F.concat(
        F.when(valid, for_).otherwise(against),
        F.when(span["before"].rlike(ANNOUNCE[kind] + r"\W*\w*\W*$"), for_).otherwise(none),
        F.when(span["before"].rlike(r"[:=(<\"]\s*$"), for_).otherwise(none),
        F.when(span["before"].rlike(OTHERWISE), against).otherwise(none),
        F.when(span["after"].rlike(r"^[\w@/]") | span["before"].rlike(r"[\w@/]$"), against)
        .when((distinct < 4) & F.lit(kind in ("card", "phone", "ssn")), against).otherwise(none))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and, per row of ``docs`` (doc_id, text), all candidate spans: kind_no, start,
    end, valid, votes and the class of the word before."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = text.select("doc_id", *[found_spans(F.col("text"), p, NEEDS.get(k)).alias(k) for k, p in (BASE | MORE).items()])

    def judged(no: int, kind: str) -> Column:
        def row(s: Column) -> Column:
            valid = is_valid(kind, s["value"])
            word = F.lower(F.regexp_extract(s["before"], r"(\w+)\W*$", 1))
            return F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), valid.alias("valid"),
                            votes(kind, s, valid).alias("votes"), F.pmod(F.xxhash64(word), F.lit(WORD_CLASSES)).cast("int").alias("word"))
        return F.transform(kind, row)

    return found.select("doc_id", F.sort_array(F.concat(*[judged(i, k) for i, k in enumerate(KINDS)])).alias("spans"))


def reliabilities(counts: dict[str, int], rounds: int = ROUNDS) -> tuple[float, list[dict[str, tuple[float, float]]]]:
    """Expectation maximisation over vote patterns: the share of true spans and, for each
    labeler, the chance of each vote given a true and a false span."""
    prior = 0.7
    table = [{"+": (0.6, 0.2), "-": (0.1, 0.4), "0": (0.3, 0.4)} for _ in range(LABELERS)]
    for _ in range(rounds if counts else 0):
        mass = [{v: [0.5, 0.5] for v in "+-0"} for _ in range(LABELERS)]
        true = total = 0.0
        for pattern, n in counts.items():
            p = posterior(pattern, prior, table)
            true, total = true + n * p, total + n
            for i, v in enumerate(pattern):
                mass[i][v][0] += n * p
                mass[i][v][1] += n * (1 - p)
        prior = min(max((true + 1) / (total + 2), 0.01), 0.99)
        table = [{v: tuple(m[v][c] / sum(m[x][c] for x in "+-0") for c in (0, 1)) for v in "+-0"} for m in mass]
    return prior, table


def posterior(pattern: str, prior: float, table: list[dict[str, tuple[float, float]]]) -> float:
    a, b = math.log(prior), math.log(1 - prior)
    for i, v in enumerate(pattern):
        a, b = a + math.log(table[i][v][0]), b + math.log(table[i][v][1])
    return 1 / (1 + math.exp(min(max(b - a, -700), 700)))


class Judge:
    """What the votes and the surroundings say: log-odds by (kind, votes) and (kind, word class)."""

    def __init__(self, spans: DataFrame):
        """``spans``: kind_no, votes, word, one row per candidate. At most
        kinds x 3^LABELERS x WORD_CLASSES counted rows reach the driver."""
        rows = spans.groupBy("kind_no", "votes", "word").count().collect()
        counts: dict[str, int] = {}
        for r in rows:
            counts[r.votes] = counts.get(r.votes, 0) + r["count"]
        self.prior, self.table = reliabilities(dict(sorted(counts.items())))
        # the classifier: naive Bayes on kind and word before, trained on the posteriors
        self.weight: dict[str, float] = {}
        kind_mass: dict[int, list[float]] = {}
        word_mass: dict[tuple[int, int], list[float]] = {}
        for r in sorted(rows, key=lambda r: (r.kind_no, r.votes, r.word)):
            p = posterior(r.votes, self.prior, self.table)
            for mass in (kind_mass.setdefault(r.kind_no, [1.0, 1.0]), word_mass.setdefault((r.kind_no, r.word), [1.0, 1.0])):
                mass[0] += r["count"] * p
                mass[1] += r["count"] * (1 - p)
        odds = lambda m: math.log(m[0] / m[1])
        for r in rows:
            p = min(max(posterior(r.votes, self.prior, self.table), 1e-9), 1 - 1e-9)
            base = math.log(p / (1 - p))
            word = odds(word_mass[r.kind_no, r.word]) - odds(kind_mass[r.kind_no])
            self.weight[f"{r.kind_no}|{r.votes}|{r.word}"] = base + max(-2.0, min(2.0, word))

    def accepts(self, span: Column) -> Column:
        known = F.from_json(F.lit(json.dumps({k: v for k, v in self.weight.items() if v >= 0 and int(k.split("|")[0]) >= len(BASE)})), "map<string,double>")
        key = F.concat_ws("|", span["kind_no"].cast("string"), span["votes"], span["word"].cast("string"))
        return F.coalesce(F.element_at(known, key), F.lit(-1.0)) >= 0


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Personal data of every row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, and spans:
    base spans and those of MORE that the classifier accepts, by start, then kind. Base
    spans always stay. Null and empty texts have none. Repeated rows and null ids are
    searched like others; an empty table gives no rows.

    Candidates are written once to shared storage; votes are counted by pattern there,
    and the counts (a table of fixed size) train the judge. Rows are never shuffled.
    """
    rows = stored(candidates(docs))
    judge = Judge(rows.select(F.explode("spans").alias("s")).select("s.kind_no", "s.votes", "s.word"))
    base = F.filter("spans", lambda s: (s["kind_no"] < len(BASE)) & s["valid"])
    every = F.filter("spans", lambda s: F.when(s["kind_no"] < len(BASE), s["valid"]).otherwise(s["valid"] & judge.accepts(s)))
    count = lambda i: F.size(F.filter(base, lambda s: s["kind_no"] == i)).cast("bigint")
    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
                       F.sha2(shown(base), 256).alias("base_sha256"), shown(every).alias("spans"))
