"""Personal data by weak supervision, with DataFrame functions alone.

Fixed patterns give the base spans; looser patterns give further candidates. Labelers vote on each
candidate: its shape, a check of its digits, gazetteers of endings and prefixes, words before it, and what
touches it. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler
is and how likely each pattern is personal data; a logistic classifier over features of the span is trained
on these and decides which looser candidates are added. Base spans always stay.

Defined cases: a null text is an empty one without spans; spans of other kinds may overlap; a candidate that
overlaps a base span is not added; repeated rows come back each; an empty table gives an empty result and
a classifier that adds nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataward.functions.barrier import once
from dataward.llm.shared import extra_columns_dropped, written

KINDS = ["email", "ip", "card", "phone"]
# Possessive forms of the given patterns: they match the same texts, in linear time and without recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDED = {"email": r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: Looser candidates: mail addresses spelled out, phone numbers without a country, identity numbers.
LOOSE = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]++)++"
         r"|(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
         r"|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOOSE_NEEDED = r"[(\[]at[)\]]|[0-9][)\x20.-]\x20?[0-9]+[\x20.-][0-9]{4}"
MAIL_ENDINGS = ["com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "uk", "it", "nl", "ch", "at"]
PHONE_STARTS = ["+1", "+33", "+34", "+39", "+41", "+43", "+44", "+49", "+82"]
FOR_WORDS = r"(?i)mail|contact|write|phone|call|tel|fax|mobile|card|visa|pay|account|address|server|host|login|ssn|social"
AGAINST_WORDS = r"(?i)version|isbn|issn|order|invoice|part|serial|page|line|error|build|model|section|figure"
LABELERS = ["shape", "check", "gazetteer", "for_words", "against_words", "touching"]
BLOCK = 512


def _places(pieces: Column, found: Column) -> Column:
    """(start, end, value) of each match from the pieces between matches, in code points.

    Offsets are summed in blocks, so that a text with very many matches costs no square of their number.
    """
    items = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, v: F.struct(
        F.length(p).cast("long").alias("gap"), F.length(v).cast("long").alias("size"), v.alias("value")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(
        F.slice(items, b * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["size"]).alias("at"), F.concat(a["out"], F.array(F.struct(
            (a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")))).alias("out"))))
    joined = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), F.array(empty).alias("out")), lambda a, b: F.struct(
        (a["at"] + b["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(b["out"], lambda s: F.struct(
            (s["start"] + a["at"]).alias("start"), (s["end"] + a["at"]).alias("end"), s["value"].alias("value"))))).alias("out")),
        lambda a: F.flatten(a["out"]))
    return F.when(F.size(found) > 0, joined).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.split(F.reverse(digits), "(?<=.)(?=.)")
    return F.aggregate(F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        (d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int"))), F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(value, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 4).try_cast("int"), F.lit(0)) <= 255)
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _with_matches(df: DataFrame, pattern: dict[str, str], needed: dict[str, str]) -> DataFrame:
    """Adds array columns of (start, end, value), one for each pattern; each text is matched once."""
    cols = {}
    for k, p in pattern.items():
        there = F.col("text").rlike(needed[k])
        cols[f"_m_{k}"] = F.when(there, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
        cols[f"_p_{k}"] = F.when(there, F.split("text", p, -1)).otherwise(F.array().cast("array<string>"))
    df = once(df, cols)
    return df.select(*[c for c in df.columns if c not in cols], *[_places(F.col(f"_p_{k}"), F.col(f"_m_{k}")).alias(f"_s_{k}") for k in pattern])


def _votes(c: Column, text: Column) -> Column:
    """The candidate with the votes of all labelers: 1 for, -1 against, 0 none."""
    before = F.substring(text, F.greatest(c["start"] - 39, F.lit(1)).cast("int"), F.least(c["start"], F.lit(40)).cast("int"))
    after = F.substring(text, (c["end"] + 1).cast("int"), F.lit(1))
    value, kind = c["value"], c["kind"]
    digits = _digits(value)
    yes = lambda x: F.when(x, 1).otherwise(-1)
    votes = {
        "shape": F.when(c["base"], 1).otherwise(0),
        "check": F.when(kind == "email", F.lit(0)).when(kind == "card", 1).when(kind == "ip", yes(~value.rlike(r"(^|\.)0[0-9]"))).otherwise(yes(F.length(digits).between(10, 15))),
        "gazetteer": F.when(kind == "email", yes(F.lower(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1)).isin(MAIL_ENDINGS)))
        .when(kind == "phone", F.when(F.array_contains(F.array(*[value.startswith(p) for p in PHONE_STARTS]), True), 1).otherwise(0))
        .when(kind == "card", yes(F.substring(digits, 1, 1).isin("3", "4", "5", "6"))).otherwise(yes(~value.rlike(r"^(0|127|255)\."))),
        "for_words": F.when(before.rlike(FOR_WORDS), 1).otherwise(0),
        "against_words": F.when(before.rlike(AGAINST_WORDS), -1).otherwise(0),
        "touching": yes(~F.substring(before, -1, 1).rlike("[A-Za-z0-9]") & ~after.rlike("[A-Za-z0-9]")),
    }
    features = [
        F.least(F.floor(F.length(value) / 5), F.lit(6)).cast("int").alias("size"),
        F.floor(5 * F.length(digits) / F.length(value)).cast("int").alias("digits"),
        F.least(F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")), F.lit(6)).cast("int").alias("signs"),
    ]
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), kind.alias("kind"), c["base"].alias("base"),
                    *[votes[n].cast("int").alias(n) for n in LABELERS], *features)


def _base_spans(kind: str) -> Column:
    return F.transform(F.filter(F.col(f"_s_{kind}"), lambda s: _holds(kind, s["value"])), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(True).alias("base"), s["value"].alias("value")))


def _number_of(kind: str) -> Column:
    return F.size(F.filter("candidates", lambda c: c["base"] & (c["kind"] == kind))).cast("long").alias(f"n_{kind}")


def candidates(docs: DataFrame) -> DataFrame:
    """Adds ``candidates`` (start, end, kind, base, votes, features) to each row of ``docs`` with a text column."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    df = _with_matches(df, BASE | {"loose": LOOSE}, NEEDED | {"loose": LOOSE_NEEDED})
    df = once(df, {"_base": F.concat(*[_base_spans(k) for k in KINDS])})
    loose = F.filter(F.col("_s_loose"), lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    loose = F.transform(loose, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.when(s["value"].rlike("[(\\[]at"), "email").when(
            s["value"].rlike("^[0-9]{3}-[0-9]{2}-"), "identity").otherwise("phone").alias("kind"), F.lit(False).alias("base"), s["value"].alias("value")))
    kept = docs.columns
    return once(df.select(*kept, F.concat("_base", loose).alias("_all")), {
        "candidates": F.transform(F.col("_all"), lambda c: _votes(c, F.col("text")))}).select(*kept, "candidates")


@dataclass(frozen=True)
class Judge:
    """The trained classifier: weights by feature, and the reliabilities it was trained on."""

    weights: dict[str, float]
    reliability: dict[str, float]

    def probability(self, c: Column) -> Column:
        score = F.lit(self.weights.get("bias", -20.0))
        for name in _FEATURES:
            cases = {k: w for k, w in self.weights.items() if k.startswith(f"{name}=")}
            if cases:
                score = score + F.coalesce(F.element_at(F.create_map(*[x for k, w in cases.items() for x in (F.lit(k.split("=", 1)[1]), F.lit(w))]), c[name].cast("string")), F.lit(0.0))
        return 1 / (1 + F.exp(-score))


_FEATURES = ["kind", "size", "digits", "signs", "for_words", "against_words", "touching", "gazetteer"]


def estimated(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[list[float], dict[str, float]]:
    """EM over (votes, count): the chance that each pattern is personal data, and each labeler's reliability.

    A labeler that votes is right with its own probability, the same for both answers; silence says nothing.
    """
    right = [0.8] * len(LABELERS)
    prior = 0.5
    chance = [0.5] * len(patterns)
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        for i, (votes, _n) in enumerate(patterns):
            odds = math.log(prior / (1 - prior)) + sum(v * math.log(r / (1 - r)) for v, r in zip(votes, right, strict=True))
            chance[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        prior = min(0.99, max(0.01, sum(c * n for c, (_, n) in zip(chance, patterns, strict=True)) / total))
        for k in range(len(LABELERS)):
            agreed = sum(n * (c if v[k] > 0 else 1 - c) for c, (v, n) in zip(chance, patterns, strict=True) if v[k])
            spoke = sum(n for v, n in patterns if v[k])
            # Two imagined votes each way keep a labeler from being certain.
            right[k] = min(0.98, max(0.5, (agreed + 8) / (spoke + 10)))
    return chance, dict(zip(LABELERS, right, strict=True))


def trained(spans: DataFrame, steps: int = 300) -> Judge:
    """A judge from a frame with ``candidates``: only counts of vote and feature patterns reach the driver.

    There are at most a few thousand patterns, whatever the number of spans: all their parts are bounded.
    """
    names = list(dict.fromkeys([*LABELERS, *_FEATURES]))
    rows = spans.select(F.inline("candidates")).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    by_votes: dict[tuple[int, ...], int] = {}
    for r in rows:
        v = tuple(r[n] for n in LABELERS)
        by_votes[v] = by_votes.get(v, 0) + r["n"]
    patterns = sorted(by_votes.items())
    chance, reliability = estimated(patterns)
    target = {v: c for (v, _), c in zip(patterns, chance, strict=True)}
    examples: dict[tuple[str, ...], list[float]] = {}
    for r in rows:
        x = tuple(f"{n}={r[n]}" for n in _FEATURES)
        e = examples.setdefault(x, [0.0, 0.0])
        e[0] += r["n"]
        e[1] += r["n"] * target[tuple(r[n] for n in LABELERS)]
    total = sum(n for n, _ in examples.values())
    weights: dict[str, float] = {"bias": 0.0} if total else {}
    ordered = sorted(examples.items())
    for _ in range(steps if total else 0):
        step: dict[str, float] = {}
        for x, (n, hits) in ordered:
            s = weights["bias"] + sum(weights.get(f, 0.0) for f in x)
            error = (hits - n / (1 + math.exp(-max(-30.0, min(30.0, s))))) / total
            for f in (*x, "bias"):
                step[f] = step.get(f, 0.0) + error
        for f, g in step.items():
            weights[f] = weights.get(f, 0.0) + 1.0 * g - 1e-3 * weights.get(f, 0.0)
    return Judge(weights, reliability)


def judged(df: DataFrame, judge: Judge) -> DataFrame:
    """Keeps base candidates and those that the judge takes for personal data."""
    return df.withColumn("candidates", F.filter("candidates", lambda c: c["base"] | (judge.probability(c) >= 0.5)))


def _spelled(spans: Column) -> Column:
    order = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.coalesce(F.array_position(F.lit(KINDS), s["kind"]), F.lit(0)).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of ``docs`` (doc_id, text)."""
    found = written(candidates(extra_columns_dropped(docs, "doc_id", "text")).select("doc_id", "candidates"))
    out = judged(found, trained(found))
    base = F.filter("candidates", lambda c: c["base"])
    return out.select(
        "doc_id", *[_number_of(k) for k in KINDS],
        F.sha2(_spelled(base), 256).alias("base_sha256"), _spelled(F.col("candidates")).alias("spans"),
        F.size(F.filter("candidates", lambda c: ~c["base"])).cast("long").alias("n_added"))


def redacted(docs: DataFrame, mark: str = "[PRIVATE]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``; all columns stay, a null text stays null."""
    names = docs.columns
    slim = docs.select(F.col("text"))
    judge = trained(candidates(slim))
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs["text"].alias("text"))
    spans = F.array_sort(F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
    out = once(judged(candidates(whole), judge).select("_row", "text", spans.alias("_x")), {"_cut": _disjoint(F.col("_x"))})
    n = F.size("_cut")
    piece = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(
        F.col("text"), (F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(F.col("_cut"), F.greatest(i, F.lit(1)))["end"]) + 1).cast("int"),
        (F.when(i == n, F.length("text")).otherwise(F.try_element_at(F.col("_cut"), F.least(i + 1, F.greatest(n, F.lit(1))))["start"])
         - F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(F.col("_cut"), F.greatest(i, F.lit(1)))["end"])).cast("int")))
    text = F.when(F.col("_row.text").isNull(), F.lit(None)).when(n == 0, F.col("text")).otherwise(F.array_join(piece, mark))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names])


def _disjoint(spans: Column) -> Column:
    """Sorted spans, overlapping ones joined."""
    kind = "array<struct<start:bigint,end:bigint>>"
    return F.aggregate(spans, F.array().cast(kind), lambda done, s: F.when(
        (F.size(done) > 0) & (s["start"] < F.try_element_at(done, F.lit(-1))["end"]),
        F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
            F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], s["end"]).alias("end"))))
    ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
