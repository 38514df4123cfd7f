"""Personal data by weak supervision.

Exact patterns find the base spans, which always stay. Looser patterns offer further candidates
(bracketed e-mail addresses, national phone numbers, full IPv6 addresses, cards grouped by dots).
Five labelers vote on every candidate, base ones included: the exact pattern, shape, gazetteer, cue words before, and
neighbouring characters. Expectation-maximisation estimates from all votes of the corpus how reliable each labeler is
on each kind, and its posteriors train the final span classifier, a logistic regression over the one-hot votes
and over what no labeler sees: length, separators, words after and a label before the span. Only DataFrame functions run on the
executors; what the driver learns from is the table of distinct patterns of votes and features, which has at most
4 * 2 * 3^4 * 64 rows whatever the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import free_prefix, let

KINDS = ("email", "ip", "card", "phone")

# Runs are possessive and start where a run starts or the last match ended: same matches, linear time, no deep recursion.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARD = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+"}
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}\x20?[\[({{]\x20?(?:at|AT|@)\x20?[\])}}]\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:\.|[\[({{]\x20?(?:dot|DOT|\.)\x20?[\])}}])\x20?[A-Za-z0-9-]{{1,63}}){{1,4}}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{1,7}(?![0-9.])",
    "phone": r"(?<![0-9A-Za-z+(./-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])(?:[0-9]{2,4}[\x20.-]){1,3}[0-9]{2,5}(?![0-9A-Za-z/-]|[.][0-9])",
}
LOOSE_GUARD = {"email": r"[\[({]\x20?(?:at|AT|@)", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}\.[0-9]{4}", "phone": r"[0-9][\x20.)-]\x20?[0-9]{2,4}[\x20.-][0-9]"}
_OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"

#: Cue words of the context labeler (for, against), in the 40 characters before a span.
CUES = {
    "email": (r"(?i)mail|contact|write|reach|address|kontakt|correo|courriel", r"(?i)version|import|package"),
    "ip": (r"(?i)\bip\b|addr|host|server|login|client|visit|peer", r"(?i)version|release|section|chapter|abschnitt|v\.?$"),
    "card": (r"(?i)card|visa|master|amex|credit|pay|karte|tarjeta|carte|iban|account", r"(?i)isbn|issn|order|serial|tracking|doi|hash|\bid\b|token"),
    "phone": (r"(?i)phone|call|tel|fax|mobile|cell|whatsapp|contact|appel|llam|ruf", r"(?i)isbn|version|page|pp\.|vol|year|date|score|lines?\b"),
}
#: Gazetteers: endings of mail domains, issuer prefixes of cards, country codes of phones, private address blocks (against).
MAIL_ENDINGS = r"(?i)\.\s?(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|ch|at|nl|pl|ru|cn|jp|in|br|mx|ar|ca|us|au|c)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|36|38)"
COUNTRIES = r"^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-6][0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9])"
PRIVATE = r"^0*(?:10\.|127\.|0?\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|2(?:2[4-9]|[345][0-9])\.)"
#: How many values each feature of the classifier has: length, separators, cue words after, a label before.
FEATURES = (4, 4, 2, 2)


def _sums_before(values: Column) -> Column:
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("sum"))
    return F.aggregate(values, start, lambda acc, x: F.struct(F.array_append(acc["out"], acc["sum"]).alias("out"), (acc["sum"] + x).alias("sum")), lambda acc: acc["out"])


def _running(sizes: Column, step: int = 128) -> Column:
    """Sums of all elements before each, for an array of longs, by chunks so that long arrays stay cheap."""

    def by_chunks(sizes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / step)), lambda c: F.slice(sizes, (c * step + 1).cast("int"), step))

    def joined(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x))
        return let(_sums_before(totals), lambda offsets: F.flatten(F.transform(chunks, lambda c, i: F.transform(_sums_before(c), lambda x: x + F.get(offsets, i)))))

    return let(sizes, lambda s: F.when(F.size(s) > 0, let(by_chunks(s), joined)).otherwise(F.array().cast("array<bigint>")))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of 12 to 19 digits passes; false for other lengths."""

    def total(r: Column) -> Column:
        def part(i: Column) -> Column:
            d = F.substr(r, i, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, d).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d))

        return F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), lambda a, i: a + part(i))

    return F.when(F.length(digits).between(12, 19), let(F.reverse(digits), total) % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(s, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    if kind == "card":
        return _luhn(F.replace(F.replace(s, F.lit(" "), F.lit("")), F.lit("-"), F.lit("")))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0).cast("tinyint")


def _votes(kind: str, base: bool, s: Column, before: Column, after: Column) -> list[Column]:
    never = F.lit(False)
    digits = _digits(s)
    if kind == "email":
        shape = _vote(F.length(s).between(6, 100) & ~F.contains(s, F.lit("..")), F.regexp_like(s, F.lit(r"^[._%+-]|[.-]$")))
        listed = _vote(F.regexp_like(s, F.lit(MAIL_ENDINGS)), F.regexp_like(s, F.lit(r"(?i)\.(?:png|jpe?g|gif|js|css|html?)$")))
    elif kind == "ip":
        # Four single digits, or leading zeros, are rather a version or a section; an address of letters is none of those.
        shape = _vote(F.regexp_like(s, F.lit(r"[0-9]{2}\." if base else "[A-Fa-f]")), F.regexp_like(s, F.lit(r"^(?:[0-9]\.){3}[0-9]$|(?:^|\.)0[0-9]" if base else "^[0-9:]+$")))
        listed = _vote(F.regexp_like(s, F.lit(r"^[0-9]" if base else "^[23]")), F.regexp_like(s, F.lit(PRIVATE if base else r"(?i)^(?:f[cde]|0{1,4}:)")))
    elif kind == "card":
        shape = _vote(_luhn(digits), ~_luhn(digits))
        listed = _vote(F.regexp_like(digits, F.lit(ISSUERS)), F.regexp_like(digits, F.lit(r"^([0-9])\1*$")))
    else:
        shape = _vote(F.length(digits).between(9, 15), ~F.length(digits).between(7, 15) | F.regexp_like(s, F.lit(r"^(?:19|20)[0-9]{2}[-. ][01]?[0-9][-. ]")))
        listed = _vote(F.regexp_like(digits, F.lit(COUNTRIES)) if base else F.regexp_like(s, F.lit(r"^\(?0[1-9]|^\(?[2-9][0-9]{2}\)?[\x20.-]{0,2}[2-9][0-9]{2}[\x20.-][0-9]{4}$")), F.regexp_like(digits, F.lit(r"^([0-9])\1*$")))
    yes, no = CUES[kind]
    context = _vote(F.regexp_like(before, F.lit(yes)), F.regexp_like(before, F.lit(no)))
    edges = _vote(F.regexp_like(before, F.lit(r"(?:^|[\s(\[<:,;\"'])$")) & F.regexp_like(after, F.lit(r"^(?:$|[\s)\]>.,;:!?\"'])")), F.regexp_like(after, F.lit(r"^[A-Za-z0-9_/=&-]")) | F.regexp_like(before, F.lit(r"[A-Za-z0-9_/=&-]$")) if kind != "email" else never)
    return [F.lit(int(base)).cast("tinyint"), shape, listed, context, edges]


def _features(kind: str, s: Column, before: Column, after: Column) -> list[Column]:
    """What the classifier sees besides the votes; FEATURES has how many values each can have."""
    size = F.length(s)
    length = F.when(size <= 7, 0).when(size <= 12, 1).when(size <= 20, 2).otherwise(3)
    marks = F.regexp_replace(s, "[A-Za-z0-9_%+@]", "")
    others = F.length(F.replace(marks, F.left(marks, F.lit(1)), F.lit("")))
    separators = F.when(F.regexp_like(s, F.lit(r"[(\[{]")), 3).when(F.length(marks) == 0, 0).when(others == 0, 1).otherwise(2)
    words_after = F.regexp_like(after, F.lit(CUES[kind][0])).cast("int")
    label = F.regexp_like(before, F.lit(r"[:=]\s?$")).cast("int")
    return [x.cast("tinyint") for x in (length, separators, words_after, label)]


def _found(text: Column, kind: str, base: bool) -> Column:
    """Matches of a kind in one text, as an array of structs in order of place."""
    pattern, guard = (BASE if base else LOOSE)[kind], (GUARD if base else LOOSE_GUARD)[kind]
    has = F.regexp_like(text, F.lit(guard))
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("pieces"))

    def placed(p: Column) -> Column:
        steps = F.zip_with(F.slice(p["pieces"], F.lit(1), F.size(p["matches"])), p["matches"], lambda a, m: (F.length(a) + F.length(m)).cast("bigint"))
        return let(_running(steps), lambda starts: spans(p, starts))

    def spans(p: Column, starts: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            before = F.right(F.get(p["pieces"], i), F.lit(40))
            after = F.left(F.get(p["pieces"], i + 1), F.lit(40))
            start = F.get(starts, i) + F.length(F.get(p["pieces"], i))
            v = _votes(kind, base, m, before, after)
            return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), (start + F.length(m)).alias("end"), F.lit(base).alias("base"), F.array(*v).alias("votes"), F.array(*_features(kind, m, before, after)).alias("features"), (_valid(kind, m) if base else F.lit(True)).alias("valid"))

        return F.filter(F.transform(p["matches"], one), lambda x: x["valid"])

    return F.when(has, let(parts, placed)).otherwise(F.array())


def candidates(docs: DataFrame, text_col: str = "text", out_col: str = "candidates") -> DataFrame:
    """Adds the base spans and the further candidates that overlap none of them, sorted by place, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = free_prefix(docs.columns, "pii_")
    base, more = [f"{own}{k}" for k in KINDS], [f"{own}more_{k}" for k in KINDS]
    rows = docs.withColumns({c: _found(text, k, c in base) for c, k in zip(base + more, KINDS + KINDS, strict=True)})
    rows = rows.withColumns({f"{own}base": F.concat(*base), f"{own}others": F.concat(*more)})
    fresh = F.filter(f"{own}others", lambda x: ~F.exists(f"{own}base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    found = F.concat(f"{own}base", F.when(F.size(f"{own}others") > 0, fresh).otherwise(F.col(f"{own}others")))
    return rows.select(*(c for c in docs.columns if c != out_col), F.array_sort(found).alias(out_col))


@dataclass(frozen=True)
class Model:
    """Weights of the classifier: one intercept a kind, a weight for each labeler and vote, and for each feature, kind and
    value. reliabilities: for each kind and labeler, P(yes | personal) and P(no | not)."""

    intercepts: tuple[float, ...]
    weights: tuple[tuple[float, float, float], ...]
    feature_weights: tuple[tuple[tuple[float, ...], ...], ...]
    reliabilities: tuple[tuple[tuple[float, float], ...], ...]
    threshold: float = 0.9

    def probability(self, kind_no: Column, votes: Column, features: Column) -> Column:
        z = F.get(F.array(*map(F.lit, self.intercepts)), kind_no)
        for j, w in enumerate(self.weights):
            z = z + F.get(F.array(*map(F.lit, w)), F.get(votes, F.lit(j)).cast("int") + 1)
        for j, by_kind in enumerate(self.feature_weights):
            flat = [x for values in by_kind for x in values]
            z = z + F.get(F.array(*map(F.lit, flat)), kind_no * FEATURES[j] + F.get(features, F.lit(j)).cast("int"))
        return 1 / (1 + F.exp(-z))


#: A pattern: kind, votes, features, how often.
Pattern = tuple[int, tuple[int, ...], tuple[int, ...], int]


def estimate(patterns: list[Pattern], rounds: int = 50, prior: float = 0.5) -> tuple[list[float], list[list[list[list[float]]]]]:
    """Expectation-maximisation over the votes: posteriors of the patterns, and P(vote | class) by kind and labeler.

    Counts are smoothed towards labelers that are right three times in four, so classes keep their meaning
    and an unseen vote has no infinite weight. A labeler that abstains gives no evidence.
    """
    n_votes = len(patterns[0][1]) if patterns else 0
    counted: dict[tuple, int] = {}
    for kind, votes, _, n in patterns:
        counted[kind, votes] = counted.get((kind, votes), 0) + n
    like = [[[[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]] for _ in range(n_votes)] for _ in KINDS]
    rate = dict.fromkeys(range(len(KINDS)), prior)
    posterior: dict[tuple, float] = {}
    for _ in range(rounds):
        counts = [[[[5.0, 3.0, 2.0], [1.0, 3.0, 6.0]] for _ in range(n_votes)] for _ in KINDS]
        mass, size = dict.fromkeys(rate, 2.0), dict.fromkeys(rate, 4.0)
        for (kind, votes), n in counted.items():
            p = [math.log(1 - rate[kind]), math.log(rate[kind])]
            for j, v in enumerate(votes):
                for c in (0, 1) if v else ():  # who doesn't vote says nothing
                    p[c] += math.log(like[kind][j][c][v + 1])
            posterior[kind, votes] = q = 1 / (1 + math.exp(min(700, max(-700, p[0] - p[1]))))
            mass[kind] += n * q
            size[kind] += n
            for j, v in enumerate(votes):
                counts[kind][j][1][v + 1] += n * q
                counts[kind][j][0][v + 1] += n * (1 - q)
        like = [[[[x / sum(c) for x in c] for c in row] for row in by_kind] for by_kind in counts]
        rate = {k: mass[k] / size[k] for k in rate}
    return [posterior[kind, votes] for kind, votes, _, _ in patterns], like


def train(patterns: list[Pattern], threshold: float = 0.9, steps: int = 300, ridge: float = 1.0) -> Model:
    """Logistic regression on the posteriors, by gradient steps over the patterns (weights: their share of all)."""
    posterior, like = estimate(patterns)
    n_votes = len(patterns[0][1]) if patterns else 5
    total = sum(p[3] for p in patterns) or 1
    # One flat vector: intercepts, then votes, then features by kind.
    places, size = [], len(KINDS) + 3 * n_votes
    first = []
    for width in FEATURES:
        first.append(size)
        size += width * len(KINDS)
    for kind, votes, features, _ in patterns:
        places.append([kind, *(len(KINDS) + 3 * j + v + 1 for j, v in enumerate(votes)), *(first[j] + kind * FEATURES[j] + x for j, x in enumerate(features))])
    w = [0.0] * size
    for _ in range(steps):
        g = [ridge / total * x for x in w]
        for at, (_, _, _, n), q in zip(places, patterns, posterior, strict=True):
            z = sum(w[i] for i in at)
            d = (1 / (1 + math.exp(-max(-500, min(500, z)))) - q) * n / total
            for i in at:
                g[i] += d
        w = [x - y for x, y in zip(w, g, strict=True)]
    votes_w = tuple(tuple(w[len(KINDS) + 3 * j : len(KINDS) + 3 * j + 3]) for j in range(n_votes))
    features_w = tuple(tuple(tuple(w[at + k * width : at + (k + 1) * width]) for k in range(len(KINDS))) for at, width in zip(first, FEATURES, strict=True))
    return Model(tuple(w[: len(KINDS)]), votes_w, features_w, tuple(tuple((row[1][2], row[0][0]) for row in by_kind) for by_kind in like), threshold)


def fit(found: DataFrame, column: str = "candidates") -> Model:
    """The model learnt from the votes on all candidates of the corpus."""
    # Outer, with the nulls dropped after: else the optimiser filters by a second copy of the whole expression.
    spans = found.select(F.explode_outer(column).alias("c")).where("c IS NOT NULL")
    rows = spans.groupBy("c.kind_no", "c.votes", "c.features").agg(F.count(F.lit(1)).alias("n")).collect()
    return train(sorted((r["kind_no"], tuple(r["votes"]), tuple(r["features"]), r["n"]) for r in rows))


def with_spans(docs: DataFrame, text_col: str = "text", out_col: str = "spans", model: Model | None = None) -> DataFrame:
    """Adds an array of (start, kind_no, end, base, p): base spans, and candidates that the classifier takes.

    Places count code points, ends are exclusive. A null or empty text has no spans. Without a model one
    is learnt from these documents. Columns of the documents named like `out_col` are replaced.
    """
    own = free_prefix(docs.columns, "pii_") + "candidates"
    rows = candidates(docs.drop(out_col), text_col, own)
    model = model or fit(rows.select(own), own)
    scored = F.transform(own, lambda x: F.struct(x["start"].alias("start"), x["kind_no"].alias("kind_no"), x["end"].alias("end"), x["base"].alias("base"), model.probability(x["kind_no"], x["votes"], x["features"]).alias("p")))
    return rows.withColumn(out_col, F.filter(scored, lambda x: x["base"] | (x["p"] >= model.threshold))).drop(own)


def _name(kind_no: Column) -> Column:
    return F.get(F.array(*map(F.lit, KINDS)), kind_no)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", _name(x["kind_no"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per document: its id, n_email, n_ip, n_card, n_phone, base_sha256, spans. Counts are of base spans.

    Other columns are not read; rows with equal ids are reported one by one; an empty table gives no rows.
    """
    rows = with_spans(docs.select(id_col, text_col), text_col, "pii_spans", model).select(id_col, "pii_spans")
    rows = rows.withColumn("pii_base", F.filter("pii_spans", lambda x: x["base"]))
    kinds = F.transform("pii_base", lambda x: x["kind_no"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select(id_col, *counts, F.sha2(_joined(F.col("pii_base")), 256).alias("base_sha256"), _joined(F.col("pii_spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", model: Model | None = None, length_col: str | None = None) -> DataFrame:
    """The documents with every span replaced by <KIND>; of overlapping spans the first stands for all. Null texts stay null.

    `length_col`, if the documents have it, becomes the code points of a text that changed.
    """
    own = free_prefix(docs.columns, "pii_")
    held, flag = f"{own}spans", f"{own}changed"
    rows = with_spans(docs, text_col, held, model)
    # Joined spans: an overlapping one only extends the one before.
    start = F.struct(F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint>>").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        span = F.struct(x["start"].alias("start"), x["kind_no"].alias("kind_no"), x["end"].alias("end"))
        last = F.element_at(acc["out"], -1)
        longer = F.struct(last["start"].alias("start"), last["kind_no"].alias("kind_no"), F.greatest(last["end"], x["end"]).alias("end"))
        out = F.when(x["start"] < acc["at"], F.array_append(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), longer)).otherwise(F.array_append(acc["out"], span))
        return F.struct(out.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    rows = rows.withColumn(held, F.when(F.size(held) > 0, F.aggregate(held, start, step, lambda acc: acc["out"])))
    text, spans = F.col(text_col), F.col(held)
    kept = F.transform(spans, lambda x, i: F.concat(F.substr(text, F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0)).cast("int") + 1, (x["start"] - F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0))).cast("int")), F.lit("<"), F.upper(_name(x["kind_no"])), F.lit(">")))
    whole = F.concat(F.array_join(kept, ""), F.substr(text, F.element_at(spans, -1)["end"].cast("int") + 1))
    changed = spans.isNotNull() & text.isNotNull()
    rows = rows.withColumns({flag: changed, text_col: F.when(changed, whole).otherwise(text)})
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        rows = rows.withColumn(length_col, F.when(F.col(flag), F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return rows.select(*docs.columns)


#: The base spans, by SQL: matches and the pieces between them give the places.
BASE_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
patterns(kind, name) AS (VALUES (0, 'email'), (1, 'ip'), (2, 'card'), (3, 'phone')),
f AS (SELECT k, kind, name, CASE kind WHEN 0 THEN regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 1 THEN regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') WHEN 2 THEN regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+') ELSE regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]') END AS found,
        CASE kind WHEN 0 THEN string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 1 THEN string_split_regex(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') WHEN 2 THEN string_split_regex(text, '[0-9](?:[\x20-]?[0-9])+') ELSE string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') END AS pieces FROM d, patterns),
m AS (SELECT k, kind, name, found[j] AS s, CAST(list_sum(list_transform(pieces[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS start, regexp_replace(found[j], '[^0-9]', '', 'g') AS digits FROM f, unnest(range(1, len(found) + 1)) AS u(j)),
v AS (SELECT * FROM m WHERE CASE kind WHEN 0 THEN TRUE
        WHEN 1 THEN list_bool_and(list_transform(string_split(s, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(nullif(ltrim(x, '0'), '') AS INTEGER), 0) <= 255))
        WHEN 2 THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(digits, length(digits) - i, 1) AS INTEGER) ELSE (2 * CAST(substr(digits, length(digits) - i, 1) AS INTEGER)) // 10 + (2 * CAST(substr(digits, length(digits) - i, 1) AS INTEGER)) % 10 END)) % 10 = 0
        ELSE length(digits) BETWEEN 9 AND 15 END),
g AS (SELECT k, count(*) FILTER (kind = 0) AS e, count(*) FILTER (kind = 1) AS i, count(*) FILTER (kind = 2) AS c, count(*) FILTER (kind = 3) AS p, string_agg(name || ':' || start || ':' || (start + length(s)), ',' ORDER BY start, kind) AS spans FROM v GROUP BY k)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (k)
"""
