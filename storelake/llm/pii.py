"""Personal data by weak supervision.

Patterns find candidates of four kinds. The strict ones, with their checks, are base
spans and always stay; looser ones find written-out addresses, national numbers and the
like. Five labelers (strict pattern, shape, gazetteer, context words, edges) vote for or
against each candidate or abstain. Expectation-maximisation over the counts of equal
votes estimates how reliable each labeler is for each kind, without labels. A naive Bayes
classifier of span features (length, digits, separators, neighbouring characters and
words) is then trained on the estimated probabilities, and decides on the loose
candidates. A strict match that fails its checks teaches, but never becomes a span.

Everything is SQL functions. Offsets come from the lengths of what lies between matches;
one row is a candidate, so a text may have any number. The driver sees sums by kind and
vote or feature only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelake.session import written

KINDS = ("email", "ip", "card", "phone")
#: Strict patterns (fixed values of the contract). Groups are possessive, which Java runs
#: without recursion, and a run of characters is tried from its beginning only (or from
#: the last match), which keeps the time linear; neither changes what is found.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for its strict pattern to be tried.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
LOOSE = {
    "email": r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{2,64}\x20?[\[(]at[\])]\x20?[A-Z0-9-]{2,63}"
             r"(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Z]{2,10}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9.])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
#: Gazetteers: what such data look like at their ends, and words that come before them.
KNOWN = {
    "email": r"(?i)\.(?:com|net|org|edu|gov|info|io|eu|de|fr|es|uk|it|nl|ch|at)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.|:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|3[0-9]|4[0-9]|52|55|61|81|86|91)|^\(?[2-9]",
}
WORDS_BEFORE = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse)\b",
    "card": r"(?i)\b(?:card|visa|credit|tarjeta|carte|karte)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|telefon|telefono|téléphone)\b",
}
WORDS_AGAINST = r"(?i)\b(?:version|isbn|issn|order|serial|section|chapter|page|figure|id)\W*$"
LABELERS = ("votes_strict", "votes_shape", "votes_gazetteer", "votes_context", "votes_edges")
FEATURES = ("size", "digits", "separators", "before", "after", "words")
BEFORE, AFTER = 32, 8
ROUNDS = 10


def found_by(kind: str, strict: bool, found: str, gaps: str) -> Column:
    """Matches with what stands before and after each, and the parts of their offsets.

    ``found`` and ``gaps`` name columns: the matches, and what is left of the text between
    them (one more). They are gone through side by side, so the work is linear in the text.
    """
    after = F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0)))
    # The third field has no name but its place.
    return F.transform(
        F.filter(F.arrays_zip(found, gaps, after), lambda z: z[found].isNotNull()),
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), i.alias("number"),
            F.char_length(z[gaps]).alias("gap"), z[found].alias("match"),
            F.right(z[gaps], F.lit(BEFORE)).alias("before"),
            F.left(z["2"], F.lit(AFTER)).alias("after")))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits."""
    reverse = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(reverse, lambda d: d != ""), lambda d, i: F.when(
        i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))),
                                 d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def passes(kind: Column, match: Column) -> Column:
    """The checks of a strict match."""
    digits = digits_of(match)
    size = F.length(digits)
    small = F.forall(F.split(match, r"\."), lambda p: F.lpad(
        F.ltrim(p, F.lit("0")), F.greatest(F.length(F.ltrim(p, F.lit("0"))), F.lit(3)), F.lit("0")
    ).rlike("^(?:[01][0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    return (F.when(kind == "email", True)
            .when(kind == "ip", small)
            .when(kind == "card", size.between(13, 19) & luhn(F.substring(digits, 1, 19)))
            .otherwise(size.between(9, 15)))


def votes() -> dict[str, Column]:
    """1 for, -1 against, 0 abstains."""
    kind, match, before, after = (F.col(c) for c in ("kind", "match", "before", "after"))

    def by_kind(values: dict[str, Column]) -> Column:
        out = F.lit(0)
        for name, value in values.items():
            out = F.when(kind == name, value).otherwise(out)
        return out

    def either(condition: Column, against: int = -1) -> Column:
        return F.when(condition, 1).otherwise(against)

    strict = F.when(F.col("strict"), either(F.col("base"))).otherwise(0)
    shape = by_kind({
        "email": either(match.rlike(r"^[A-Za-z0-9][^@]*@[^@]*\.[A-Za-z]{2,10}$"), 0),
        "ip": either(~match.rlike(r"(?:^|\.)0[0-9]")),
        "card": either(match.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1"
                                   r"[0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$")),
        "phone": either(match.rlike(r"[0-9][\x20().-]+[0-9]{3}[\x20.-]?[0-9]{2,4}$"), 0)})
    gazetteer = by_kind({k: either(match.rlike(p), 0 if k == "email" else -1)
                         for k, p in KNOWN.items()})
    context = F.when(before.rlike(WORDS_AGAINST), -1).when(
        by_kind({k: before.rlike(p).cast("int") for k, p in WORDS_BEFORE.items()}) == 1,
        1).otherwise(0)
    edges = either(~before.rlike(r"[\p{L}0-9_@#]$") & ~after.rlike(r"^[\p{L}0-9_@]"))
    return dict(zip(LABELERS, (strict, shape, gazetteer, context, edges), strict=True))


def span_features() -> dict[str, Column]:
    match, before, after = F.col("match"), F.col("before"), F.col("after")

    def class_of(char: Column) -> Column:
        return (F.when(char == "", "edge").when(char.rlike(r"\p{L}"), "letter")
                .when(char.rlike("[0-9]"), "digit").when(char.rlike(r"\s"), "space")
                .otherwise("mark"))

    size = F.char_length(match)
    values = (
        F.least(size, F.lit(40)) - F.least(size, F.lit(40)) % 4,
        F.least(F.length(digits_of(match)), F.lit(20)),
        F.least(F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")), F.lit(6)),
        class_of(F.right(before, F.lit(1))), class_of(F.left(after, F.lit(1))),
        F.col("votes_context"))
    return {k: v.cast("string") for k, v in zip(FEATURES, values, strict=True)}


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> dict[str, dict]:
    """Expectation-maximisation over ``patterns`` (kind, a column for each labeler, n).

    For each kind: the share of true candidates, and for each labeler how probable its
    votes are for true and for false ones. The first guess is the majority of the votes.
    """
    majority = sum((F.col(x) for x in LABELERS[1:]), F.col(LABELERS[0]))
    guess = F.when(majority > 0, 0.9).when(majority < 0, 0.1).otherwise(0.5)
    # At most 4 kinds times 3^5 votes: one task sums them, without a shuffle in each round.
    patterns = patterns.coalesce(1)
    learned: dict[str, dict] = {}
    for _ in range(rounds):
        true, false = F.col("n") * F.col("q"), F.col("n") * (1 - F.col("q"))
        sums = patterns.withColumn("q", guess).groupBy("kind").agg(
            F.sum(true).alias("true"), F.sum(false).alias("false"),
            *[F.sum(F.when(F.col(x) == vote, share).otherwise(0)).alias(f"{name}_{x}_{vote}")
              for x in LABELERS for vote in (-1, 0, 1)
              for name, share in (("true", true), ("false", false))]).collect()
        learned = {r["kind"]: {
            "prior": (r["true"] + 1) / (r["true"] + r["false"] + 2),
            "odds": {(x, vote): math.log((r[f"true_{x}_{vote}"] + 1) / (r["true"] + 3))
                     - math.log((r[f"false_{x}_{vote}"] + 1) / (r["false"] + 3))
                     for x in LABELERS for vote in (-1, 0, 1)}} for r in sums}
        guess = posterior(learned, LABELERS)
    return learned


def posterior(learned: dict[str, dict], columns: tuple[str, ...]) -> Column:
    """Probability that a candidate is true, from the odds of its columns' values."""
    out = F.lit(0.5)
    for kind, known in learned.items():
        logit = F.lit(math.log(known["prior"] / (1 - known["prior"])))
        for x in columns:
            odds = {value: o for (name, value), o in known["odds"].items() if name == x}
            part = F.lit(0.0)
            for value, o in odds.items():
                part = F.when(F.col(x) == F.lit(value), o).otherwise(part)
            logit = logit + part
        bounded = F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))
        out = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-bounded))).otherwise(out)
    return out


def span_classifier(candidates: DataFrame) -> dict[str, dict]:
    """Naive Bayes over the features, from the probabilities ``q`` of the candidates."""
    values = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("value"))
                                 for x in FEATURES])).alias("seen")
    sums = candidates.select("kind", "q", values).groupBy("kind", "seen").agg(
        F.sum("q").alias("true"), F.sum(1 - F.col("q")).alias("false")).collect()
    learned: dict[str, dict] = {}
    for kind in {r["kind"] for r in sums}:
        of_kind = [r for r in sums if r["kind"] == kind]
        one = [r for r in of_kind if r["seen"]["feature"] == FEATURES[0]]
        true, false = sum(r["true"] for r in one), sum(r["false"] for r in one)
        learned[kind] = {"prior": (true + 1) / (true + false + 2), "odds": {
            (r["seen"]["feature"], r["seen"]["value"]):
            math.log((r["true"] + 1) / (true + 2)) - math.log((r["false"] + 1) / (false + 2))
            for r in of_kind}}
    return learned


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of all texts (number null where nothing is found) with every candidate."""
    text = F.col("text")
    needs = {}
    for kind in KINDS:
        here = text.rlike("[0-9]") if NEEDED[kind] is None else text.contains(NEEDED[kind])
        needs[kind, True] = here & text.rlike(r"[0-9]\.[0-9]") if kind == "ip" else here
    needs |= {("email", False): text.contains("(") | text.contains("["),
              ("ip", False): text.contains(":"),
              ("card", False): text.rlike(r"[0-9]{4}\.[0-9]{4}\."),
              ("phone", False): text.rlike("[0-9]{3}[.-][0-9]{4}")}
    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    columns, parts = [], []
    for (kind, strict), needed in needs.items():
        pattern = (STRICT if strict else LOOSE)[kind]
        name = f"{kind}_{'strict' if strict else 'loose'}"
        # Most texts have no match; only those that have are split.
        columns.append(F.when(needed, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
                       .otherwise(none).alias(f"m_{name}"))
        parts.append((kind, strict, pattern, name))
    rows = rows.select("row", "doc_id", "text", *columns)
    rows = rows.select("row", "doc_id", *[f"m_{p[3]}" for p in parts], *[
        F.when(F.size(f"m_{name}") > 0, F.split(text, pattern, -1)).otherwise(none)
        .alias(f"g_{name}") for _, _, pattern, name in parts])
    found = F.concat(*[found_by(kind, strict, f"m_{name}", f"g_{name}")
                       for kind, strict, _, name in parts])
    return rows.select("row", "doc_id", F.explode_outer(found).alias("c")).select(
        "row", "doc_id", "c.*")


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   rounds: int = ROUNDS) -> DataFrame:
    """row, doc_id and every span found: kind, start, stop (characters), base, probability.

    A row without spans has one line with a null kind. base: found by the strict pattern
    and its checks. The others are added when the classifier gives them half or more and
    they do not overlap a base span. ``row`` numbers the rows of the input.
    """
    found = written(candidates(docs, id_col, text_col), "candidates")
    order = Window.partitionBy("row", "kind", "strict").orderBy("number")
    through = F.sum(F.col("gap") + F.char_length("match")).over(
        order.rowsBetween(Window.unboundedPreceding, 0))
    placed = found.filter("kind is not null").withColumn("stop", through).withColumn(
        "start", F.col("stop") - F.char_length("match")).withColumn(
        "base", F.col("strict") & passes(F.col("kind"), F.col("match")))
    # A run of digits of another length is no card at all, and so on.
    placed = placed.filter(F.col("base") | ~F.col("strict") | (F.col("kind") != "card")
                           | F.length(digits_of(F.col("match"))).between(13, 19))
    for name, vote in votes().items():
        placed = placed.withColumn(name, vote)
    for name, value in span_features().items():
        placed = placed.withColumn(f"f_{name}" if name in ("before", "after") else name, value)
    placed = written(placed, "votes")
    patterns = written(placed.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")),
                       "vote-patterns")
    probable = placed.withColumn("q", posterior(reliabilities(patterns, rounds), LABELERS))
    shown = [f"f_{x}" if x in ("before", "after") else x for x in FEATURES]
    featured = probable.select("row", "kind", "start", "stop", "base", "strict", "q", *[
        F.col(a).alias(b) for a, b in zip(shown, FEATURES, strict=True)])
    judged = featured.withColumn("probability", posterior(span_classifier(featured), FEATURES))
    # Both windows grow by a row at a time; one over the rows that follow would not.
    forth = Window.partitionBy("row").orderBy("start", "stop", F.desc("base"))
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("stop"))
    base_stop = F.max(F.when(F.col("base"), F.col("stop"))).over(
        forth.rowsBetween(Window.unboundedPreceding, -1))
    base_start = F.min(F.when(F.col("base"), F.col("start"))).over(
        back.rowsBetween(Window.unboundedPreceding, -1))
    spans = judged.withColumn("past", base_stop).withColumn("next", base_start).filter(
        F.col("base") | (~F.col("strict") & (F.col("probability") >= 0.5)
                         & ~F.coalesce(F.col("past") > F.col("start"), F.lit(False))
                         & ~F.coalesce(F.col("next") < F.col("stop"), F.lit(False))))
    rows = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"))
    return rows.join(spans.select("row", "kind", "start", "stop", "base", "probability"),
                     "row", "left")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans of each row.

    Spans are written as kind:start:stop, by kind in that order and then by start, joined by
    commas; base_sha256 is the digest of the base spans alone. Null and empty texts have no
    spans. Repeated rows and null ids stay as they are. Other columns are not read. An empty
    table gives an empty result.
    """
    kinds = F.array(*map(F.lit, KINDS))
    spans = personal_spans(docs, id_col, text_col)
    entry = F.struct(F.array_position(kinds, F.col("kind")).alias("place"), "start", "stop",
                     "kind", "base")
    rows = spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), entry))).alias("spans"))

    def shown(entries: Column) -> Column:
        return F.array_join(F.transform(entries, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    return rows.select("doc_id", *[f"n_{k}" for k in KINDS],
                       F.sha2(shown(F.filter("spans", lambda s: s["base"])), 256)
                       .alias("base_sha256"), shown(F.col("spans")).alias("spans"))
