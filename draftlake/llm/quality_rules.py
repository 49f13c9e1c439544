"""Cross-document line frequency: lines that too many documents of a host share are removed, and
documents that hold little else are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions.text import let
from draftlake.llm.common import LONGS, WS, WS_CHARS, whole, words_of
from draftlake.session import cut_lineage

WINDOW = 8
#: Lines (8 bytes each, and their host) up to which a table of lines is broadcast.
BROADCAST_LINES = 1_000_000
SALTS = 32


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a window of eight words found twice or more in the text.

    Windows are 64-bit hashes built by doubling (two, four, eight words). Only texts with an equal
    pair of windows are sorted; equal neighbours give the places, and the gaps between places say
    how many words a window adds. Everything is linear or n log n in the row."""

    def pair(a: Column, gap: int, n: Column) -> Column:
        """Hash of every element with the one ``gap`` places on; ``n`` elements result."""
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(gap + 1), n), lambda x, y: F.xxhash64(x, y))

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.zip_with(places, F.slice(places, F.lit(2), F.size(places)),
                       lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)).cast("bigint")),
            F.lit(0).cast("bigint"), lambda s, x: s + x,
        )

    def places(order: Column) -> Column:
        twice = F.filter(order, lambda x, i: (F.get(order, i - 1)["k"] == x["k"]) | (F.get(order, i + 1)["k"] == x["k"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def of_windows(keys: Column) -> Column:
        order = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("bigint")).otherwise(
            let(order, lambda o: let(places(o), covered))
        )

    def hashed(h: Column) -> Column:
        n = F.size(h)
        return let(pair(h, 1, n - 1), lambda p: let(pair(p, 2, n - 3), lambda q: let(pair(q, 4, n - 7), of_windows)))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("bigint")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    )


def text_counts(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Counts of one text: words, their code points, symbols, repeated lines and repeated words."""
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.regexp_replace(text, WS, "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": repeated_words(words),
    }


def line_key(line: Column) -> Column:
    """Hash of the line in lower case, trimmed, with single spaces."""
    return F.xxhash64(F.lower(F.regexp_replace(F.btrim(line, F.lit(WS_CHARS)), WS, " ")))


def frequent_lines(distinct: DataFrame, *, max_share: float, max_docs: int, min_docs: int) -> DataFrame:
    """(host, key) of the hashed lines above a limit of their host: held by more than ``max_docs`` of
    its distinct documents, or by more than ``max_share`` of them and at least ``min_docs``.

    ``distinct`` has one row (host, doc, keys) per host and content: copies count once, so that they
    do not make their own lines boilerplate. Counts are summed before the shuffle."""
    docs = distinct.groupBy("host").agg(F.count("*").alias("docs"))
    counts = distinct.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    over = (F.col("n") > max_docs) | ((F.col("n") > F.col("docs") * max_share) & (F.col("n") >= min_docs))
    return counts.where(F.col("n") >= min(min_docs, max_docs + 1)).join(docs, "host").where(over).select("host", "key")


def held_lines(distinct: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc, frequent): the frequent lines of each distinct document that has any. Lines are rows, so
    neither side holds a list per host. Both the frequent lines and the result are broadcast up to a
    checked number of lines; beyond it the lines are joined by (host, line, salt) and a line of many
    documents is many tasks."""
    kept = cut_lineage(frequent)
    many = kept.count() > BROADCAST_LINES
    lines = distinct.select("host", "doc", F.explode("keys").alias("key"))
    if many:
        lines = lines.withColumn("salt", F.pmod(F.col("doc"), F.lit(SALTS)))
        salted = kept.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        found = lines.join(salted, ["host", "key", "salt"])
    else:
        found = lines.join(F.broadcast(kept), ["host", "key"])
    found = cut_lineage(found.groupBy("doc").agg(F.collect_set("key").alias("frequent")))
    total = found.agg(F.sum(F.size("frequent") + 2)).first()[0] or 0
    return F.broadcast(found) if total <= BROADCAST_LINES else found


def line_frequency(
    docs: DataFrame, text: str = "text", host: str = "source", *, max_share: float = 0.1, max_docs: int = 10_000,
    min_docs: int = 10, min_left: float = 0.2,
) -> DataFrame:
    """Every row of ``docs`` with a struct ``rules`` of the counts and the verdict, and ``clean_text``
    without the frequent lines: those that over ``max_share`` of the distinct documents of their host
    hold (at least ``min_docs``), or over ``max_docs`` of them, whatever the size of the host. Texts
    are not shuffled while the documents with frequent lines are few enough to be broadcast.

    A document is rejected if the base rules fail (under 20 words, or over 30 % of its words in
    repeated windows), or if under ``min_left`` of the characters of its lines stay (depleted).
    Null text counts as empty and fails the base rules; null hosts form one host; repeated rows are
    judged alike; extra columns pass through; an empty table gives an empty table."""
    host_key = F.coalesce(F.col(host).cast("string"), F.lit("\u0000"))
    split = docs.select(F.struct("*").alias("__row"), host_key.alias("__host"), whole(text).alias("__text"))
    split = split.withColumns({
        "__words": words_of(F.col("__text")),
        "__lines": F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != ""),
    })
    keyed = split.withColumns({
        "__counts": F.struct(*[c.alias(n) for n, c in text_counts(F.col("__text"), F.col("__words"), F.col("__lines")).items()]),
        "__keys": F.transform("__lines", lambda x: F.struct(line_key(x).alias("key"), F.length(F.btrim(x, F.lit(WS_CHARS))).alias("chars"))),
    })
    doc = F.xxhash64("__host", "__text")
    lines = split.select(F.col("__host").alias("host"), doc.alias("doc"), F.array_distinct(F.transform("__lines", line_key)).alias("keys"))
    distinct = cut_lineage(lines.groupBy("host", "doc").agg(F.any_value("keys").alias("keys")))
    hot = held_lines(distinct, frequent_lines(distinct, max_share=max_share, max_docs=max_docs, min_docs=min_docs))
    hot = hot.select(F.col("doc").alias("__doc"), F.col("frequent").alias("__frequent"))
    seen = keyed.withColumn("__doc", doc).join(hot, "__doc", "left").withColumn("__found", F.coalesce("__frequent", F.array().cast(LONGS)))
    total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda s, k: s + k["chars"])
    gone = F.filter("__keys", lambda k: F.array_contains("__found", k["key"]))
    judged = seen.withColumns({
        "__gone_lines": F.when(F.size("__found") == 0, 0).otherwise(F.size(gone)).cast("bigint"),
        "__gone_chars": F.when(F.size("__found") == 0, F.lit(0).cast("bigint")).otherwise(total(gone)),
        "__all_chars": total(F.col("__keys")),
        "__failed": (F.col("__counts.n_words") < 20) | (100 * F.col("__counts.n_repeat_words") > 30 * F.col("__counts.n_words")),
    })
    depleted = F.col("__all_chars") - F.col("__gone_chars") < F.col("__all_chars") * min_left
    stay = F.filter(F.split("__text", "\n"), lambda x: (F.btrim(x, F.lit(WS_CHARS)) == "") | ~F.array_contains("__found", line_key(x)))
    rules = F.struct(
        "__counts.*", F.col("__failed").alias("base_failed"), (~F.col("__failed") & ~depleted).alias("kept"),
        F.col("__gone_lines").alias("n_removed_lines"), F.col("__gone_chars").alias("removed_chars"), depleted.alias("depleted"),
    )
    rest = [c for c in docs.columns if c not in ("rules", "clean_text")]
    return judged.select(
        *[F.col("__row")[c].alias(c) for c in rest], rules.alias("rules"),
        F.when(F.size("__found") == 0, F.col("__text")).otherwise(F.array_join(stay, "\n")).alias("clean_text"),
    )
