"""Personal data by weak supervision: regular expressions, gazetteers and context vote on candidate
spans, expectation-maximisation estimates how far each can be trusted, and a span classifier is
trained on the estimates."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions.text import let
from draftlake.llm.common import SPANS, spans_of, whole
from draftlake.session import cut_lineage

#: Base kinds in their order. Possessive loops match what greedy ones match, without recursion; a
#: match of ``email`` or ``ip`` can only begin where a run begins or the match before it ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Given names of the gazetteer.
GIVEN_NAMES = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica "
    "Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Emma Olivia Sophia Hans Peter Wolfgang Ursula Monika "
    "Jean Pierre Marie Sophie Carlos Maria Jose Ana Luis Carmen Ahmed Fatima Mohammed Aisha Wei Yuki Priya Raj"
).split()

#: Top-level domains and first digits of issuers that the gazetteer knows.
DOMAINS = "com org net edu gov io co info biz de fr es it uk us eu ch at nl be pl ru cn jp in br ca au mx se no dk fi".split()
ISSUERS = r"^(?:4|5[1-5]|3[47]|6011|65|2[2-7]|35|30|36|38)"

#: Further candidates; none is reported unless the classifier accepts it.
EXTRA = {
    "email_text": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++",
    "ip6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone_local": r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?=[A-Z])(?<![\p{L}'-])(?:" + "|".join(GIVEN_NAMES) + r")\x20\p{Lu}\p{Ll}{2,20}(?![\p{L}'-])",
}

KINDS = [*BASE, *EXTRA]

#: Strings one of which a text must hold for a kind, and kinds that need a digit: texts without skip
#: the pattern, which cannot match there.
SIGNS = {"email": ["@"], "phone": ["+"], "email_text": ["at]", "at)"], "ip6": [":"], "ip": ["."], "national_id": ["-"]}
DIGITS = {"ip", "card", "phone", "phone_local", "national_id", "iban"}

#: Words before a span that speak for a kind, or against personal data.
CUES = {
    "email": "mail|contact|write|reach", "ip": "ip|address|host|client|server|from", "card": "card|visa|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax|cell", "email_text": "mail|contact|write|reach", "ip6": "ip|address|host|client|server",
    "phone_local": "phone|tel|call|mobile|fax|cell", "national_id": "ssn|social security|insurance", "iban": "iban|account|bank",
    "name": "name|mr|mrs|ms|dr|dear|author|contact|signed",
}
AGAINST = r"(?i)\b(?:version|isbn|issn|doi|order|invoice|total|page|chapter|model|part|article|section)\b[^\n]{0,12}$"

LABELERS = ("regex", "gazetteer", "context")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    d = F.reverse(F.split(digits, "(?<=.)(?=.)"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, x.cast("int") * 2).otherwise(x.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        short = F.transform(F.split(value, "\\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.coalesce(F.try_to_number(F.when(F.length(p) <= 3, F.concat(F.lit("0"), p)), F.lit("9999")), F.lit(999)) <= 255))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Base spans of one kind: matches that pass the checks of the kind; failing ones are dropped."""
    return F.filter(spans_of(text, BASE[kind]), lambda s: _passes(kind, s["value"]))


def _mod97(value: Column) -> Column:
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    step = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), lambda s, c: F.coalesce(step(s, c), F.lit(0)).cast("int"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def votes(kind: str, span: Column) -> list[Column]:
    """Votes of the three labelers: 1 for, -1 against, 0 abstains."""
    value, none = span["value"], F.lit(False)
    digits = F.regexp_replace(value, "[^0-9]", "")
    regex = {
        "iban": lambda: _vote(_mod97(value) == 1, _mod97(value) != 1),
        "national_id": lambda: _vote(~value.rlike("^(?:000|666|9)|-00-|-0000$"), value.rlike("^(?:000|666|9)|-00-|-0000$")),
        "phone_local": lambda: _vote(value.rlike(r"^\("), none), "name": lambda: _vote(none, none),
    }.get(kind, lambda: _vote(F.lit(True), none))()
    ending = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1)).isin(DOMAINS)
    local = value.rlike(r"^(?:0+|10|127|255|224|169\.254|192\.168)\.")
    gazetteer = {
        "email": lambda: _vote(ending, ~ending), "email_text": lambda: _vote(ending, ~ending), "ip": lambda: _vote(~local, local),
        "card": lambda: _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)), "name": lambda: _vote(F.lit(True), none),
        "phone": lambda: _vote(~digits.rlike("^0"), digits.rlike("^0")),
    }.get(kind, lambda: _vote(none, none))()
    cue = span["left"].rlike(r"(?i)\b(?:" + CUES[kind] + r")\b[^\n]{0,25}$")
    return [regex, gazetteer, _vote(cue, span["left"].rlike(AGAINST))]


def shape(kind: str, span: Column) -> list[Column]:
    """Features of the classifier besides the kind: length class, share of digits, neighbours."""
    value = span["value"]
    n, d = F.length(value), F.length(F.regexp_replace(value, "[^0-9]", ""))
    return [
        F.least(F.floor(n / 8), F.lit(3)).cast("int"), F.floor(d * 3 / n).cast("int"),
        F.when(span["left"].rlike(r"[\p{L}0-9]$"), 2).when(span["left"].rlike(r"\s$|^$"), 0).otherwise(1).cast("int"),
        F.when(span["right"].rlike(r"^[\p{L}0-9]"), 2).when(span["right"].rlike(r"^\s|^$"), 0).otherwise(1).cast("int"),
    ]


def candidates(text: Column) -> Column:
    """All candidates as array<struct<order,kind,start,end,votes,shape>>; base spans pass their checks."""

    def of(k: int, kind: str, digit: Column) -> Column:
        possible = digit if kind in DIGITS else F.lit(True)
        if kind in SIGNS:
            possible = possible & reduce(or_, [F.contains(text, F.lit(x)) for x in SIGNS[kind]])
        found = base_spans(text, kind) if kind in BASE else spans_of(text, EXTRA[kind])
        found = F.when(possible, found).otherwise(F.array().cast(SPANS))
        return F.transform(found, lambda s: F.struct(
            F.lit(k).alias("order"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.array(*votes(kind, s)).alias("votes"), F.array(*shape(kind, s)).alias("shape"),
        ))

    return let(text.rlike("[0-9]"), lambda digit: F.concat(*[of(k, kind, digit) for k, kind in enumerate(KINDS)]))


# ---- reliabilities and classifier, on counts of vote patterns ------------------------------------


def expectation_maximisation(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> tuple[list[float], list]:
    """(probability per pattern, reliabilities) from (kind, votes, count). Labelers are independent
    given the truth; P(vote | truth) is shared by the kinds, the prior is each kind's own. Smoothed
    counts keep every estimate inside (0, 1)."""
    n = len(LABELERS)
    table = [{y: {1: 0.6 if y else 0.15, -1: 0.1 if y else 0.5, 0: 0.3 if y else 0.35} for y in (0, 1)} for _ in range(n)]
    prior = [0.5] * len(KINDS)
    post = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (k, vs, _c) in enumerate(patterns):
            like = [math.prod([table[j][y][v] for j, v in enumerate(vs)]) * (prior[k] if y else 1 - prior[k]) for y in (0, 1)]
            post[i] = like[1] / (like[0] + like[1])
        for k in range(len(KINDS)):
            own = [(post[i], c) for i, (kk, _, c) in enumerate(patterns) if kk == k]
            prior[k] = (1 + sum(p * c for p, c in own)) / (2 + sum(c for _, c in own))
        for j in range(n):
            for y in (0, 1):
                seen = {v: 1.0 + (2.0 if v == (1 if y else -1) else 0.0) for v in (1, -1, 0)}
                for i, (_k, vs, c) in enumerate(patterns):
                    seen[vs[j]] += c * (post[i] if y else 1 - post[i])
                total = sum(seen.values())
                table[j][y] = {v: x / total for v, x in seen.items()}
    return post, table


def names_of_features(kind: str, shape_: tuple[int, ...], context: int) -> list[str]:
    return ["bias", f"kind {kind}", f"context {context}", *(f"shape {i} {v}" for i, v in enumerate(shape_))]


def train(rows: list[tuple[str, tuple[int, ...], tuple[int, ...], float, int]], rounds: int = 300) -> dict[str, float]:
    """Logistic regression of the estimated probabilities on the features (kind, context vote, shape),
    by gradient descent over counted patterns: (kind, votes, shape, probability, count)."""
    weights: dict[str, float] = {}
    total = sum(c for *_, c in rows) or 1
    items = [(names_of_features(k, s, v[-1]), p, math.sqrt(c) / math.sqrt(total)) for k, v, s, p, c in rows]
    scale = sum(c for *_, c in items) or 1
    for _ in range(rounds):
        step: dict[str, float] = {}
        for f, p, c in items:
            z = sum(weights.get(x, 0.0) for x in f)
            g = c / scale * (p - 1 / (1 + math.exp(-max(-30, min(30, z)))))
            for x in f:
                step[x] = step.get(x, 0.0) + g
        for x, g in step.items():
            weights[x] = weights.get(x, 0.0) + 2.0 * (g - 1e-4 * weights.get(x, 0.0))
    return weights


def fitted(found: DataFrame) -> tuple[dict[str, float], list]:
    """(weights, reliabilities) from rows with ``candidates``. The driver gets one row per pattern of
    kind, votes and shape: at most 10 x 27 x 144, whatever the corpus."""
    each = found.select(F.explode("candidates").alias("c")).groupBy("c.order", "c.votes", "c.shape").agg(F.count("*").alias("n"))
    rows = sorted((r.order, tuple(r.votes), tuple(r.shape), r.n) for r in each.collect())
    merged: dict[tuple, int] = {}
    for k, v, _, n in rows:
        merged[k, v] = merged.get((k, v), 0) + n
    keys = sorted(merged)
    post, table = expectation_maximisation([(k, v, merged[k, v]) for k, v in keys])
    chance = dict(zip(keys, post, strict=True))
    return train([(KINDS[k], v, s, chance[k, v], n) for k, v, s, n in rows]), table


def probability(weights: dict[str, float], c: Column) -> Column:
    """Probability of a candidate under the classifier."""
    parts = [F.lit(weights.get("bias", 0.0))]
    for kind in KINDS:
        parts.append(F.when(c["kind"] == kind, weights.get(f"kind {kind}", 0.0)).otherwise(0.0))
    for v in (-1, 0, 1):
        parts.append(F.when(F.element_at(c["votes"], -1) == v, weights.get(f"context {v}", 0.0)).otherwise(0.0))
    for i in range(4):
        for v in range(4):
            if w := weights.get(f"shape {i} {v}"):
                parts.append(F.when(F.get(c["shape"], F.lit(i)) == v, w).otherwise(0.0))
    z = parts[0]
    for p in parts[1:]:
        z = z + p
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, text: str = "text", *, threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with ``base`` and ``spans``: arrays of (order, kind, start, end), in the
    order of kind and start; offsets are code points with an exclusive end. With ``carry`` only these
    columns pass, and the candidates are written once for the fit and the scores; without it all
    columns pass, and texts are scanned for each.

    Base spans always stay. A further candidate joins them if the classifier gives it at least
    ``threshold`` and it overlaps no base span. Null text counts as empty; repeated rows get equal
    results; an empty table gives an empty table; extra columns pass through. Long texts stay linear:
    no pattern can backtrack over a run twice."""
    rest = [c for c in carry or docs.columns if c not in ("base", "spans")]
    found = docs.select(*rest, candidates(whole(text)).alias("__c"))
    if carry:
        found = cut_lineage(found)
    weights, _ = fitted(found.select(F.col("__c").alias("candidates")))
    lean = lambda a: F.array_sort(F.transform(a, lambda c: F.struct(c["order"], c["kind"], c["start"], c["end"])))
    base = F.filter("__c", lambda c: c["order"] < len(BASE))
    extra = F.filter("__c", lambda c: (c["order"] >= len(BASE)) & (probability(weights, c) >= threshold))
    split = found.select(*rest, base.alias("__b"), extra.alias("__e"))
    free = F.filter("__e", lambda c: ~F.exists("__b", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return split.select(*rest, lean(F.col("__b")).alias("base"), lean(F.concat("__b", free)).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans merge into
    the first."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("a"), s["end"].cast("int").alias("b"), s["kind"].alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        return F.when(x["a"] < s["at"], F.struct(F.greatest(s["at"], x["b"]).alias("at"), s["out"].alias("out"))).otherwise(F.struct(
            x["b"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, x["a"] - s["at"]), F.lit("<"), x["k"], F.lit(">")).alias("out")
        ))

    return F.aggregate(order, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


