"""Personal data by weak supervision.  DataFrame operations only.

Candidate spans come from four fixed expressions (the *base* kinds) and from looser ones.  Four labelers
vote on every candidate: the strict form, a gazetteer, the words before it, the characters around it.
Expectation-maximisation over the counts of vote patterns (at most 3**4 per kind) estimates how reliable
each labeler is and the probability of each pattern; those probabilities are the soft labels of a naive
Bayes classifier over features of the span, which decides which looser candidates become spans.  Base
spans always stay.

Offsets are code points.  The expressions find what a leftmost non-overlapping search with the plain
forms finds, without its backtracking: a match can only begin where a run of its first class begins or
where the match before it ended.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.scratch import checkpointed

BASE_KINDS = ("email", "ip", "card", "phone")
LOOSE_KINDS = ("spoken_email", "local_phone", "national_id")
KINDS = (*BASE_KINDS, *LOOSE_KINDS)

EXPRESSIONS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?=[0-9\x20-]{14})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "spoken_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?i:dot)[\])]\x20?)[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# A text without any of these has no match of the kind.
NEEDED = {"email": "@", "phone": "+", "spoken_email": "[(", "national_id": "-", "ip": "."}
# Gazetteers.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "eu", "ch", "at")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
                 "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92")
# Words before a value that say what it is.
CONTEXT = {
    "email": "(?i)(e-?mail|contact|write to|kontakt|courriel|correo)",
    "ip": "(?i)(\\bip\\b|address|server|host|adresse|servidor)",
    "card": "(?i)(card|visa|credit|payment|karte|carte|tarjeta)",
    "phone": "(?i)(phone|\\btel\\b|call|mobile|fax|telefon|t.l.phone|tel.fono)",
    "spoken_email": "(?i)(e-?mail|contact|write to|kontakt|courriel|correo)",
    "local_phone": "(?i)(phone|\\btel\\b|call|mobile|fax|telefon|t.l.phone|tel.fono)",
    "national_id": "(?i)(ssn|social security|\\bid\\b|passport|ausweis|identit|seguridad)",
}
REACH = 40  # code points before a span that count as its context
NO, ABSTAIN, YES = 0, 1, 2
LABELERS = 4
EM_ROUNDS = 12
ACCEPT = 0.9


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, combine) -> Column:
    """``combine`` of every element of an array of int with all before it.

    Runs of about the square root of the length are folded by themselves and shifted by the result of the
    runs before, as a fold copies what it has so far at every step.
    """
    empty = F.array().cast("array<int>")
    fold = lambda xs: F.aggregate(xs, empty, lambda out, x: F.array_append(
        out, F.when(F.size(out) == 0, x).otherwise(combine(F.try_element_at(out, F.lit(-1)), x)).cast("int")))

    def cut(xs: Column) -> Column:
        length = F.ceil(F.sqrt(F.size(xs))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(xs), length), lambda at: F.slice(xs, at, length))

    def joined(runs: Column) -> Column:
        return _let(fold(F.transform(runs, lambda run: F.element_at(run, -1))), lambda ends: F.flatten(F.transform(
            runs, lambda run, k: F.when(k == 0, run).otherwise(F.transform(run, lambda x: combine(F.get(ends, k - 1), x).cast("int"))))))

    return _let(values, lambda xs: F.when(F.size(xs) == 0, empty).otherwise(
        _let(F.transform(cut(xs), fold), joined)))


def _matches(text: Column, kind: str) -> Column:
    """All matches of a kind as ``(m, start, end, before, after)``; the pieces between them give offsets and surroundings.

    ``before``: the last ``REACH`` code points before the match; ``after``: the first one after it.
    """
    expression = F.lit(EXPRESSIONS[kind])
    found = F.regexp_extract_all(text, expression, F.lit(0))
    between = F.split(text, expression, -1)
    none = F.array().cast("array<struct<m:string,start:int,end:int,before:string,after:string>>")

    def surrounded(x: Column) -> Column:
        # x: matches m with the piece b before each, and what follows each
        def of(ends: Column) -> Column:
            def one(p: Column, k: Column) -> Column:
                end = F.get(ends, k)
                # a match has four code points at least, so ten matches and pieces before reach far enough
                earlier = F.slice(x.pairs, F.greatest(k - 9, F.lit(1)), F.least(k, F.lit(10)))
                near = F.concat(F.array_join(F.transform(earlier, lambda q: F.concat(q.b, q.m)), ""), p.b)
                before = F.when(F.length(p.b) >= REACH, F.right(p.b, F.lit(REACH))).otherwise(F.right(near, F.lit(REACH)))
                return F.struct(p.m.alias("m"), (end - F.length(p.m)).alias("start"), end.alias("end"), before.alias("before"), F.get(x.after, k).alias("after"))

            return F.transform(x.pairs, one)

        return _let(_running(F.transform(x.pairs, lambda p: F.length(p.b) + F.length(p.m)), lambda s, v: s + v), of)

    def located(y: Column) -> Column:
        n = F.size(y.found)
        pairs = F.zip_with(y.found, F.slice(y.gaps, 1, n), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
        after = F.zip_with(F.slice(y.gaps, 2, n), F.slice(y.found, 2, n), lambda b, m: F.left(F.concat(b, F.coalesce(m, F.lit(""))), F.lit(1)))
        return F.when(n > 0, _let(F.struct(pairs.alias("pairs"), after.alias("after")), surrounded)).otherwise(none)

    whole = _let(F.struct(found.alias("found"), between.alias("gaps")), located)
    if kind in NEEDED:
        return F.when(reduce(or_, [F.contains(text, F.lit(c)) for c in NEEDED[kind]]), whole).otherwise(none)
    return whole


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn check digit."""
    backwards = F.split(F.reverse(digits), "")

    def weight(d: Column, k: Column) -> Column:
        value = d.cast("int")
        return F.when(k % 2 == 0, value).otherwise(value * 2 - F.when(value > 4, 9).otherwise(0))

    return F.aggregate(F.transform(backwards, weight), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """The rule a match of a base kind must pass."""
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: p.cast("double") <= 255)
    digits = _digits(m)
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _strict(kind: str, m: Column) -> Column:
    """Labeler 1: the strict form of the kind."""
    if kind in ("email", "spoken_email"):
        return ~m.rlike(r"\.\.|^[.-]") & (F.length(m) <= 254)
    if kind == "ip":
        return ~m.rlike(r"(^|\.)0[0-9]")
    if kind == "card":
        return m.rlike(r"^([0-9]+|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{2,7})$")
    if kind == "local_phone":
        return ~m.rlike(r"^\(?[01]")
    return F.lit(True)


def _known(kind: str, m: Column) -> Column:
    """Labeler 2: the gazetteer of the kind."""
    if kind in ("email", "spoken_email"):
        return F.lower(F.regexp_extract(m, "([A-Za-z0-9-]+)$", 1)).isin(*TOP_DOMAINS)
    if kind == "ip":
        return ~F.split(m, "\\.")[0].isin("0", "127", "255")
    if kind == "card":
        return F.substring(m, 1, 1).isin("3", "4", "5", "6")
    if kind == "phone":
        return F.substring(_digits(m), 1, 1).isin(*CALLING_CODES) | F.substring(_digits(m), 1, 2).isin(*CALLING_CODES)
    if kind == "national_id":
        return ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00")
    return ~F.substring(_digits(m), 4, 3).isin("000", "111")


def _class_of(char: Column) -> Column:
    return F.when(char == "", "end").when(char.rlike(r"^\s$"), "space").when(char.rlike(r"^[\p{L}\p{N}_]$"), "word").otherwise("sign")


def _form(kind: str, m: Column) -> Column:
    """The shape of a looser match, one of a small closed set: signs of a number, or local part and brackets of a spoken e-mail."""
    form = F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), r"[\p{L}_%+]+", "a")
    if kind != "spoken_email":
        return form  # 15 shapes of a local phone, one of a national id
    head = F.regexp_extract(F.regexp_replace(form, "[a9.-]{2,}", "w"), r"^[^\[(]*[\[(]a[\])]\x20?", 0)
    return F.concat(head, F.when(m.rlike(r"[\[(](?i:dot)[\])]"), F.lit("[")).otherwise(F.lit(".")))


def _candidate(kind: str, s: Column) -> Column:
    """A match with its votes and the features of the classifier."""
    left, right = F.right(s.before, F.lit(1)), s.after
    named = s.before.rlike(CONTEXT[kind])
    vote = lambda yes: F.when(yes, YES).otherwise(NO)
    votes = F.array(
        vote(_strict(kind, s.m)), vote(_known(kind, s.m)), F.when(named, YES).otherwise(ABSTAIN),
        F.when((_class_of(left) == "word") | (_class_of(right) == "word"), NO).otherwise(YES),
    )
    digits = F.length(_digits(s.m))
    features = F.array(
        F.concat(F.lit("length "), F.least(F.length(s.m).cast("int"), F.lit(40)).cast("string")),
        F.concat(F.lit("digits "), F.least(digits, F.lit(20)).cast("string")),
        F.concat(F.lit("left "), _class_of(left)), F.concat(F.lit("right "), _class_of(right)),
        F.concat(F.lit("named "), named.cast("string")),
        *([F.concat(F.lit("form "), _form(kind, s.m))] if kind in LOOSE_KINDS else []),
    )
    return F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end"), votes.alias("votes"), features.alias("features"))


def candidates(text: Column) -> Column:
    """All candidates of a text by start, then kind as listed; looser ones only where no base span lies.  Null: none."""
    whole = F.coalesce(text, F.lit(""))

    def of(kind: str) -> Column:
        found = F.filter(_matches(whole, kind), lambda s: _valid(kind, s.m))
        return F.transform(found, lambda s: F.struct(s.start.alias("start"), F.lit(KINDS.index(kind)).alias("n"), _candidate(kind, s).alias("s")))

    loose = lambda x: x.n >= len(BASE_KINDS)

    def free(found: Column) -> Column:
        # in order of starts: how far base spans before reach, and where the next base span starts
        reach = _running(F.transform(found, lambda x: F.when(loose(x), 0).otherwise(x.s.end)), F.greatest)
        following = F.reverse(_running(F.transform(F.reverse(found), lambda x: F.when(loose(x), (1 << 31) - 1).otherwise(x.start)), F.least))
        return _let(F.struct(reach.alias("reach"), following.alias("following")), lambda y: F.filter(
            found, lambda x, k: ~loose(x) | ((F.get(y.reach, k) <= x.start) & (F.get(y.following, k) >= x.s.end))))

    return F.transform(_let(F.array_sort(F.concat(*[of(k) for k in KINDS])), free), lambda x: x.s)


def _em(patterns: Column) -> Column:
    """Probabilities of the patterns (``votes``, ``n``) of one kind, in their order."""
    total = lambda rows, f: F.aggregate(rows, F.lit(0.0), lambda s, r: s + f(r))
    majority = F.transform(patterns, lambda r: F.lit(0.5) + (F.aggregate(r.votes, F.lit(0.0), lambda s, v: s + v) / LABELERS - 1) * 0.45)

    def step(p: Column, _: Column) -> Column:
        weighted = F.zip_with(patterns, p, lambda r, q: F.struct(r.votes.alias("votes"), (r.n * q).alias("a"), (r.n * (1 - q)).alias("b")))

        def updated(rows: Column) -> Column:
            def reliability(side: str) -> Column:
                # chance of each vote of each labeler in one class, one count added
                whole = total(rows, lambda r: r[side]) + 3.0
                return F.array(*[F.array(*[
                    (total(F.filter(rows, lambda r: r.votes[k] == v), lambda r: r[side]) + 1.0) / whole for v in (NO, ABSTAIN, YES)
                ]) for k in range(LABELERS)])

            prior = F.log((total(rows, lambda r: r.a) + 1.0) / (total(rows, lambda r: r.b) + 1.0))
            model = F.struct(reliability("a").alias("a"), reliability("b").alias("b"), prior.alias("prior"))
            return _let(model, lambda m: F.transform(rows, lambda r: 1 / (1 + F.exp(-(
                m.prior + sum(F.log(m.a[k][r.votes[k]] / m.b[k][r.votes[k]]) for k in range(LABELERS)))))))

        return _let(weighted, updated)

    return F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), majority, step)


def fit(found: DataFrame) -> dict[str, dict[str, float]]:
    """Weights of the span classifier per kind: ``prior`` and one per feature value.

    ``found`` has ``candidates``.  Counts cover all of them; only the looser kinds are weighed, and what
    reaches the driver is one number per kind and feature value, all of which are bounded (see ``_form``).
    """
    each = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    patterns = each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"))
    rows = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("rows"))
    posterior = rows.select("kind", F.explode(F.arrays_zip(F.col("rows.votes").alias("votes"), _em(F.col("rows")).alias("p"))).alias("x")).select(
        "kind", "x.votes", "x.p")
    soft = each.where(F.col("kind").isin(*LOOSE_KINDS)).groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(posterior), ["kind", "votes"])
    counts = soft.select(
        "kind", F.explode(F.array_append("features", F.lit("prior"))).alias("feature"), (F.col("n") * F.col("p")).alias("a"),
        (F.col("n") * (1 - F.col("p"))).alias("b"),
    ).groupBy("kind", "feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    table: dict[str, dict[str, tuple[float, float]]] = {}
    for r in counts.collect():
        table.setdefault(r.kind, {})[r.feature] = (r.a, r.b)
    return {kind: _weights(values) for kind, values in table.items()}


def _weights(values: dict[str, tuple[float, float]]) -> dict[str, float]:
    from math import log

    all_a, all_b = values["prior"]
    out = {"prior": log((all_a + 1) / (all_b + 1))}
    for name, (a, b) in values.items():
        if name != "prior":
            out[name] = log((a + 1) / (all_a + 2)) - log((b + 1) / (all_b + 2))
    return out


def chosen(found: Column, weights: dict[str, dict[str, float]]) -> Column:
    """Base spans, and looser candidates whose classifier probability is at least ``ACCEPT``; as (kind, start, end)."""
    def total(features: Column, w: dict[str, float]) -> Column:
        by_value = F.create_map(*[x for k, v in sorted(w.items()) for x in (F.lit(k), F.lit(v))])
        return F.aggregate(features, F.lit(w["prior"]), lambda s, f: s + F.coalesce(by_value[f], F.lit(0.0)))

    def score(c: Column) -> Column:
        value = F.lit(0.0)
        for kind in LOOSE_KINDS:
            if kind in weights:
                value = F.when(c.kind == kind, 1 / (1 + F.exp(-total(c.features, weights[kind])))).otherwise(value)
        return value

    kept = F.filter(found, lambda c: c.kind.isin(*BASE_KINDS) | (score(c) >= ACCEPT))
    return F.transform(kept, lambda c: F.struct(c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end")))


def pii_spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end) of every whole text; one row per row, repeated rows included.

    A null or empty text has no spans.  Spans of different kinds may overlap.  Only doc_id and text are
    read.  Candidates are written once and serve both the fit and the decision.
    """
    found = checkpointed(docs.select("doc_id", candidates(F.col("text")).alias("candidates")))
    return found.select("doc_id", chosen(F.col("candidates"), fit(found)).alias("spans"))


PIECE = 4096  # code points of the pieces into which a text is cut, so that a part is found without walking from its begin


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans are replaced once, together."""
    def replaced(x: Column) -> Column:
        def part(begin: Column, end: Column) -> Column:
            first, last = F.floor(begin / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
            head = lambda k, a, n: F.substring(F.coalesce(F.get(x.pieces, k), F.lit("")), a, n)
            return F.when(first == last, head(first, begin - first * PIECE + 1, end - begin)).otherwise(F.concat(
                head(first, begin - first * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(x.pieces, first + 2, last - first - 1), ""),
                head(last, F.lit(1), end - last * PIECE)))

        def one(s: Column, k: Column) -> Column:
            return F.concat(part(F.when(k == 0, 0).otherwise(F.get(x.reach, k - 1)), s.start), F.lit("<"), F.upper(s.kind), F.lit(">"))

        fresh = lambda s, k: (k == 0) | (s.start >= F.get(x.reach, k - 1))
        kept = F.transform(x.spans, lambda s, k: F.when(fresh(s, k), one(s, k)).otherwise(""))
        return F.concat(F.array_join(kept, ""), part(F.element_at(x.reach, -1), x.length))

    known = F.struct(
        spans.alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), F.length(text).alias("length"),
        _running(F.transform(spans, lambda s: s.end), F.greatest).alias("reach"))
    return F.when(F.size(spans) > 0, _let(known, replaced)).otherwise(text)


def redacted_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data taken out of ``text`` (null stays null) and ``n_chars`` counted anew; every row stays."""
    weights = fit(checkpointed(docs.select(candidates(F.col("text")).alias("candidates")).where(F.size("candidates") > 0)))
    out = docs.withColumn("_spans", chosen(candidates(F.col("text")), weights)).withColumn("text", redacted(F.col("text"), F.col("_spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
