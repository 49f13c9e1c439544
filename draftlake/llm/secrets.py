"""Secret scan with multipart credential linking: identifiers, secrets and endpoints of a text meet in
an interval join, and weak parts are reported only next to the parts that complete them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import SPANS, row_keys, spans_of, whole

#: Base kinds in their order; possessive loops match what greedy ones match.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
}
_ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""

#: Weak parts, never reported alone: identifiers, high-entropy tokens, endpoints.
WEAK = {
    "weak_id": r"""(?i:client_?id|user_?name|user|account|login|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}+""",
    "weak_secret": r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{32,}+={0,2}",
    "endpoint": r"""(?<![A-Za-z])(?:https?|ftp|jdbc:[a-z]++|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}+""",
}

#: Strings one of which a text must hold for a kind; texts without skip the pattern.
SIGNS = {"assign": ["=", ":"], "access": ["AKIA"], "weak_id": ["=", ":"], "endpoint": ["://"]}

#: What a part is in a credential.
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
#: Roles that must stand within reach of a weak part before it is reported.
NEEDS = {"weak_id": ("secret",), "weak_secret": ("id",), "endpoint": ("id", "secret")}
KINDS = [*BASE, *WEAK]
REACH = 300


def base_spans(text: Column, kind: str) -> Column:
    """Base spans of one kind. Assignments of fewer than six characters are dropped, not retried."""
    found = spans_of(text, BASE[kind])
    if kind == "assign":
        return F.filter(found, lambda s: F.length(F.regexp_extract(s["value"], _ASSIGNED, 1)) >= 6)
    return found


def parts(text: Column, kinds: list[str]) -> Column:
    """array<struct<start,order,kind,end>> of all parts of the kinds, by start and kind."""

    def of(kind: str) -> Column:
        found = base_spans(text, kind) if kind in BASE else spans_of(text, WEAK[kind])
        if kind in SIGNS:
            possible = reduce(or_, [F.contains(text, F.lit(x)) for x in SIGNS[kind]])
            found = F.when(possible, found).otherwise(F.array().cast(SPANS))
        return F.transform(found, lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")
        ))

    return F.array_sort(F.concat(*[of(k) for k in kinds]))


def linked_parts(each: DataFrame, key: list[str], *, reach: int = REACH) -> DataFrame:
    """Weak parts whose complements lie within ``reach`` code points in the same scope, from the end of
    the earlier to the begin of the later part (0 where they overlap).

    ``each`` has the scope's key and a part (start, order, kind, end). The interval join goes over
    cells of the width of the reach; a part enters every cell it covers. Per scope, role and cell only
    the first start and the last end are kept, since cells that both parts cover are always within
    reach, the cell before reaches by its last end and the cell behind by its first start. So a part
    meets two summaries per role and one per cell it covers, however many parts a scope holds, and no
    pairs of parts are made."""
    roles = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    low, high = F.floor(F.col("start") / reach), F.floor(F.col("end") / reach)
    covered = each.select(*key, "start", "end", F.element_at(roles, F.col("kind")).alias("role"), F.explode(F.sequence(low, high)).alias("cell"))
    cells = covered.groupBy(*key, "role", "cell").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    wants = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    weak = each.where(F.col("kind").isin(list(WEAK))).withColumn("needs", F.element_at(wants, F.col("kind")))
    probes = weak.select("*", F.explode("needs").alias("role")).select("*", F.explode(F.sequence(low - 1, high + 1)).alias("cell"))
    near = (F.col("first") <= F.col("end") + reach) & (F.col("last") >= F.col("start") - reach)
    met = probes.join(cells, [*key, "role", "cell"]).where(near)
    whole_ = met.groupBy(*key, "start", "order", "kind", "end", F.size("needs").alias("n")).agg(F.count_distinct("role").alias("met"))
    return whole_.where("met = n").select(*key, "start", "order", "kind", "end")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, reach: int = REACH) -> DataFrame:
    """Every row of ``docs`` with ``base`` and ``spans``: arrays of (start, order, kind, end), by start
    and kind; offsets are code points with an exclusive end. The scope of a link is one text.

    Base spans always stay; linked weak parts that overlap none of them are added. Null text counts as
    empty; null ids are allowed; rows that repeat id and text share their parts and get equal results;
    an empty table gives an empty table; extra columns pass through."""
    rest = [c for c in docs.columns if c not in ("base", "spans")]
    key = ["__i", "__h"]
    every = docs.select(*row_keys(doc_id, text), parts(whole(text), KINDS).alias("p"))
    weak = every.where(F.exists("p", lambda p: p["order"] >= len(BASE))).select(*key, F.explode(F.array_distinct("p")).alias("p")).select(*key, "p.*")
    found = linked_parts(weak, key, reach=reach).groupBy(*key).agg(F.collect_set(F.struct("start", "order", "kind", "end")).alias("__w"))
    rows = docs.select(*rest, *row_keys(doc_id, text), parts(whole(text), list(BASE)).alias("base"))
    joined = rows.join(found, key, "left")
    free = F.filter("__w", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    spans = F.when(F.col("__w").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", free)))
    return joined.select(*rest, "base", spans.alias("spans"))
