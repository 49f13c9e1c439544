"""JOIN operators on the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions.numeric import n_rows
from draftlake.catalogue.registry import Tables, query
from draftlake.functions.numeric import f1
from draftlake.operators import joins as op
from draftlake.operators.mining import explode_words
from draftlake.functions.text import fold



def listed_words(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Folded words of the benchmark as listed tags, those of the documents as occurrences."""
    tags = lambda d, k: explode_words(d, [k]).select(k, fold(F.col("word")).alias("tag")).filter("tag <> ''")
    rows = tags(t.benchmark, "item_id").distinct()
    hits = tags(t.spread("documents"), "doc_id").withColumnRenamed("doc_id", "page_id")
    return rows, hits


@query(
    "link_keys",
    """
    WITH b AS (SELECT DISTINCT item_id, trim(regexp_replace(strip_accents(lower(w)), '[^0-9a-z]+', ' ', 'g')) AS tag
        FROM (SELECT item_id, unnest(string_split_regex(text, '\\s+')) AS w FROM benchmark)),
    d AS (SELECT doc_id, trim(regexp_replace(strip_accents(lower(w)), '[^0-9a-z]+', ' ', 'g')) AS tag
        FROM (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w FROM documents)),
    h AS (SELECT tag, count(*) AS links, count(DISTINCT doc_id) AS pages FROM d GROUP BY tag)
    SELECT item_id, b.tag, coalesce(links, 0) AS links, coalesce(pages, 0) AS pages
    FROM b LEFT JOIN h ON h.tag = b.tag WHERE b.tag <> ''
    """,
)
def link_keys(t: Tables) -> DataFrame:
    """JOIN-3, flagship: on which documents does each listed word occur, and how often."""
    rows, hits = listed_words(t)
    return op.link_tags(rows, hits)


@query(
    "unlinked_keys",
    """
    WITH b AS (SELECT DISTINCT item_id, trim(regexp_replace(strip_accents(lower(w)), '[^0-9a-z]+', ' ', 'g')) AS tag
        FROM (SELECT item_id, unnest(string_split_regex(text, '\\s+')) AS w FROM benchmark)),
    d AS (SELECT DISTINCT trim(regexp_replace(strip_accents(lower(w)), '[^0-9a-z]+', ' ', 'g')) AS tag
        FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM documents))
    SELECT item_id, tag FROM b WHERE tag <> '' AND tag NOT IN (SELECT tag FROM d)
    """,
)
def unlinked_keys(t: Tables) -> DataFrame:
    """JOIN-3: listed words that occur nowhere."""
    rows, hits = listed_words(t)
    return op.unlinked_rows(rows, hits)


@query(
    "part_links",
    """
    SELECT p_partkey, l_orderkey, l_linenumber, l_suppkey FROM part JOIN lineitem ON l_partkey = p_partkey
    """,
)
def part_links(t: Tables) -> DataFrame:
    """JOIN-3: the long form, one row per part and line that orders it."""
    rows = t.part.select("p_partkey", F.col("p_partkey").alias("tag"))
    hits = t.lineitem.select(F.col("l_partkey").alias("tag"), "l_orderkey", "l_linenumber", "l_suppkey")
    out = op.tag_links(rows, hits)
    return out.select("p_partkey", *[F.col(f"hit_{c}").alias(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey")])


@query(
    "page_listing",
    """
    SELECT e.event_id AS id, c.c_name AS filename, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, CAST(l.quality AS VARCHAR)) AS label,
      CAST(l.quality AS VARCHAR) AS model_label, coalesce(l.quality = 0 AND l.toxic = 0, false) AS needs_review,
      l.doc_id IS NOT NULL AS analysed, CAST(json_extract(props, '$.k') AS BIGINT) AS k
    FROM events e JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN labels l ON l.doc_id = e.event_id
    """,
)
def page_listing(t: Tables) -> DataFrame:
    """JOIN-1, SRC-5: events as pages of a customer's document, labels as their analysis."""
    pages = t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), F.col("event_id").alias("idx"),
        F.from_json("props", "k bigint")["k"].alias("k"),
    )
    docs = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("filename"), F.col("c_custkey").alias("created_at"))
    analysis = t.labels.select(
        F.col("doc_id").alias("page_id"), F.col("quality").cast("string").alias("label"), F.lit(0.5).alias("confidence"),
        (F.col("quality") == 0).alias("needs_review"), F.when(F.col("toxic") == 1, "toxic").alias("override_label"),
    )
    return op.list_pages(pages, docs, analysis).select(
        "id", "filename", "label", "model_label", "needs_review", "analysed", "k"
    )


@query(
    "membership",
    """
    SELECT o_orderkey AS id, o_custkey AS created_by FROM orders WHERE o_orderstatus <> 'P' AND (o_custkey = 7 OR o_orderkey IN
      (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7 AND l_linenumber >= 2))
    """,
)
def membership(t: Tables) -> DataFrame:
    """JOIN-2: orders as projects, suppliers on their lines as members with a role."""
    projects = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("created_by"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("purged_at"),
    )
    role = F.when(F.col("l_linenumber") == 1, "viewer").when(F.col("l_linenumber") == 2, "reviewer").otherwise("editor")
    members = t.lineitem.select(
        F.col("l_orderkey").alias("project_id"), F.col("l_suppkey").alias("user_id"), role.alias("role")
    )
    return op.visible_projects(projects, members, 7, role="editor", action="reviewer").select("id", "created_by")


@query(
    "unanimous_vote",
    """
    WITH g AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f FROM lineitem GROUP BY ALL
        HAVING count(*) >= 2 AND min(l_returnflag) = max(l_returnflag))
    SELECT l_orderkey, min(l_linenumber) AS l_linenumber, arg_min(f, l_linenumber) AS l_returnflag FROM g GROUP BY 1
    """,
)
def unanimous_vote(t: Tables) -> DataFrame:
    """JOIN-4: the first line number of an order whose readings agree."""
    return op.unanimous_vote(t.lineitem, ["l_orderkey"], "l_linenumber", "l_returnflag")


BOXES_SQL = """
    b AS (SELECT label AS page_id, vec_id * 12 + i AS box_id, 'w' || ((vec_id + i) % 3) AS text, round(abs(CAST(embedding[5 * i + 5] AS DOUBLE)), 6) AS c,
      round(CAST(embedding[5 * i + 1] AS DOUBLE) * 4000, 3) AS x0, round(CAST(embedding[5 * i + 2] AS DOUBLE) * 4000, 3) AS y0,
      round(abs(CAST(embedding[5 * i + 3] AS DOUBLE)) * 100, 3) AS dx, round(abs(CAST(embedding[5 * i + 4] AS DOUBLE)) * 100, 3) AS dy FROM embeddings, range(12) r(i)),
    o AS (SELECT page_id, box_id, text, c, x0, y0, x0 + 30 + dx AS x1, y0 + 20 + dy AS y1, row_number() OVER (PARTITION BY page_id ORDER BY c DESC, box_id) AS n FROM b)
"""


def embedded_boxes(t: Tables) -> DataFrame:
    """Twelve boxes of five components each from every vector."""
    e = F.col("embedding")

    def box(i: Column) -> Column:
        at = lambda k: F.get(e, i * 5 + k).cast("double")
        x, y = F.round(at(0) * 4000, 3), F.round(at(1) * 4000, 3)
        return F.struct(
            (F.col("vec_id") * 12 + i).alias("box_id"), F.concat(F.lit("w"), (F.col("vec_id") + i) % 3).alias("text"),
            F.round(F.abs(at(4)), 6).alias("confidence"), x.alias("x0"), y.alias("y0"),
            (x + 30 + F.round(F.abs(at(2)) * 100, 3)).alias("x1"), (y + 20 + F.round(F.abs(at(3)) * 100, 3)).alias("y1"),
        )

    return t.embeddings.select(F.col("label").alias("page_id"), F.inline(F.transform(F.sequence(F.lit(0), F.lit(11)), box)))


@query(
    "overlap_suppression",
    f"""
    WITH RECURSIVE {BOXES_SQL},
    r AS (
      SELECT page_id, n, [o] AS kept, box_id, c, true AS ok FROM o WHERE n = 1
      UNION ALL
      SELECT page_id, n, CASE WHEN ok THEN list_append(kept, me) ELSE kept END, box_id, c, ok FROM (
        SELECT o.page_id, o.n, o.box_id, o.c, r.kept, o AS me, len(list_filter(r.kept, lambda k:
          greatest(0, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0, least(k.y1, o.y1) - greatest(k.y0, o.y0)) / ((o.x1 - o.x0) * (o.y1 - o.y0)) > 0.5
          OR k.text = o.text AND greatest(0, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0, least(k.y1, o.y1) - greatest(k.y0, o.y0))
            / ((k.x1 - k.x0) * (k.y1 - k.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - greatest(0, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0, least(k.y1, o.y1) - greatest(k.y0, o.y0))) > 0.3)) = 0 AS ok
        FROM r JOIN o ON o.page_id = r.page_id AND o.n = r.n + 1)
    )
    SELECT page_id, box_id, c AS confidence FROM r WHERE ok
    """,
)
def overlap_suppression(t: Tables) -> DataFrame:
    """JOIN-5: boxes from all components, de-duplicated per label."""
    return op.suppress_overlaps(embedded_boxes(t), ["page_id"]).select("page_id", "box_id", "confidence")


@query(
    "nearest_line",
    """
    WITH m AS (SELECT s_nationkey AS nation, s_suppkey AS word_no, c_custkey AS segment_id, abs(s_suppkey - c_custkey) AS perp
      FROM supplier JOIN customer ON c_nationkey = s_nationkey AND abs(s_suppkey - c_custkey) <= 200
       AND s_acctbal - (c_acctbal - 500) BETWEEN 250 AND 750)
    SELECT nation, word_no, arg_min(segment_id, perp * 100000000 + segment_id) AS segment_id,
      CAST(min(perp) AS DOUBLE) AS perp FROM m GROUP BY ALL
    """,
)
def nearest_line(t: Tables) -> DataFrame:
    """JOIN-6: suppliers as dimension words, customers as horizontal lines of their nation's page."""
    words = t.supplier.select(
        F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("word_no"), F.col("s_acctbal").alias("cx"),
        F.col("s_suppkey").cast("double").alias("cy"), F.lit(0.0).alias("angle_deg"),
    )
    y = F.col("c_custkey").cast("double")
    segments = t.customer.select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("segment_id"),
        (F.col("c_acctbal") - 500).alias("x0"), y.alias("y0"), (F.col("c_acctbal") + 500).alias("x1"), y.alias("y1"),
    )
    return op.nearest_line(words, segments, ["nation"], max_gap=200.0, cell=512.0).select(
        "nation", "word_no", "segment_id", "perp"
    )


@query(
    "nearest_pair",
    """
    WITH m AS (SELECT s_nationkey AS nation, s_suppkey, s_acctbal AS bal, c_custkey, c_acctbal,
      row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_acctbal, c_custkey) AS r
      FROM supplier JOIN customer ON c_nationkey = s_nationkey)
    SELECT nation, s_suppkey, bal, c_custkey, c_acctbal AS nearest FROM m WHERE r = 1
    """,
)
def nearest_pair(t: Tables) -> DataFrame:
    """JOIN-6: the customer with the nearest balance in the supplier's nation, from ordered scans."""
    s = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"), "s_suppkey")
    c = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"), "c_custkey")
    return op.nearest_value(s, c, ["nation"], "bal", "s_suppkey", "c_custkey")


@query(
    "one_to_one",
    """
    WITH RECURSIVE p AS (SELECT s_nationkey AS nation, s_suppkey AS a, c_custkey AS b, abs(s_acctbal - c_acctbal) AS score
      FROM supplier JOIN customer ON c_nationkey = s_nationkey AND abs(s_acctbal - c_acctbal) <= 50),
    o AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score, a, b) AS n FROM p),
    r AS (SELECT nation, n, [a] AS la, [b] AS lb, a, b, score, true AS ok FROM o WHERE n = 1
      UNION ALL SELECT nation, n, CASE WHEN ok THEN list_append(la, a) ELSE la END, CASE WHEN ok THEN list_append(lb, b) ELSE lb END, a, b, score, ok FROM (
        SELECT o.*, r.la, r.lb, NOT list_contains(r.la, o.a) AND NOT list_contains(r.lb, o.b) AS ok FROM r JOIN o ON o.nation = r.nation AND o.n = r.n + 1))
    SELECT nation, a AS s_suppkey, b AS c_custkey, round(score, 4) AS score FROM r WHERE ok
    """,
)
def one_to_one(t: Tables) -> DataFrame:
    """JOIN-7: suppliers and customers of a nation matched greedily by balance."""
    s = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"), "s_suppkey")
    c = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"), "c_custkey")
    out = op.match_values(s, c, ["nation"], "bal", "s_suppkey", "c_custkey", tol=50.0)
    return out.withColumn("score", F.round("score", 4))


@query(
    "tolerance_share",
    """
    WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), c AS (SELECT * FROM events WHERE event_type = 'click'),
    a AS (SELECT count(*) AS n, count_if(EXISTS (SELECT 1 FROM c WHERE abs(epoch_us(c.ts) - epoch_us(p.ts)) <= 3600000000 AND abs(c.value - p.value) <= 1.0)) AS h FROM p),
    b AS (SELECT count(*) AS n, count_if(EXISTS (SELECT 1 FROM p WHERE abs(epoch_us(c.ts) - epoch_us(p.ts)) <= 3600000000 AND abs(c.value - p.value) <= 1.0)) AS h FROM c)
    SELECT a.n AS predicted, a.h AS near_truth, b.n AS truth, b.h AS found,
      round(2.0 * (a.h / a.n) * (b.h / b.n) / (a.h / a.n + b.h / b.n), 9) AS f1 FROM a, b
    """,
)
def tolerance_share(t: Tables) -> DataFrame:
    """JOIN-8, AGG-11: purchases near a click in time and value and the other way round."""
    e = t.events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value", "event_type")
    p, c = e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'")
    tol = {"us": 3600000000, "value": 1.0}
    count = lambda d, n: d.agg(n_rows().alias(n)).withColumn("one", F.lit(1))
    out = (
        count(p, "predicted")
        .join(count(op.within_box(p, c, [], tol, "event_id"), "near_truth"), "one")
        .join(count(c, "truth"), "one")
        .join(count(op.within_box(c, p, [], tol, "event_id"), "found"), "one")
    )
    score = f1(F.col("near_truth") / F.col("predicted"), F.col("found") / F.col("truth"))
    return out.withColumn("f1", F.round(score, 9)).drop("one")


@query(
    "point_in_polygon",
    """
    WITH q AS (SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, range(32) p(i)),
    v AS (SELECT r_regionkey AS region, CAST(0.08 AS DOUBLE) * r_regionkey - 0.2 AS cx FROM region),
    e AS (SELECT region, cx - 0.11 AS ax, CAST(0 AS DOUBLE) AS ay, cx AS bx, CAST(-0.2 AS DOUBLE) AS by_ FROM v
      UNION ALL SELECT region, cx, -0.2, cx + 0.11, 0 FROM v UNION ALL SELECT region, cx + 0.11, 0, cx, 0.2 FROM v
      UNION ALL SELECT region, cx, 0.2, cx - 0.11, 0 FROM v)
    SELECT vec_id, i AS point, region FROM q JOIN e ON (by_ > y) <> (ay > y) AND x < (ax - bx) * (y - by_) / (ay - by_) + bx
    GROUP BY ALL HAVING count(*) % 2 = 1
    """,
)
def point_in_polygon(t: Tables) -> DataFrame:
    """JOIN-9: all components of each vector as points, one diamond per region."""
    e = F.col("embedding")
    points = F.transform(F.sequence(F.lit(0), (F.size(e) / 2).cast("int") - 1), lambda i: F.struct(
        i.cast("bigint").alias("point"), F.get(e, i * 2).cast("double").alias("x"), F.get(e, i * 2 + 1).cast("double").alias("y")
    ))
    q = t.embeddings.select("vec_id", F.inline(points))
    cx = F.lit(0.08) * F.col("r_regionkey") - 0.2
    corner = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    ring = F.array(corner(cx - 0.11, 0.0), corner(cx, -0.2), corner(cx + 0.11, 0.0), corner(cx, 0.2))
    polys = t.region.select(F.col("r_regionkey").alias("region"), ring.alias("ring"))
    return op.points_in_polygons(q, polys, cell=0.1).select("vec_id", "point", "region")


@query(
    "enrich_conflicts",
    """
    WITH o AS (SELECT l_partkey, l_extendedprice / l_quantity / 1000 AS w, p_retailprice / 1000 AS s, p_partkey FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)
    SELECT CASE WHEN s BETWEEN 0.3 AND 6 THEN CASE WHEN abs(w - s) <= 0.03 THEN 'corroborated' ELSE 'conflicted' END ELSE 'extracted' END AS status,
      count(*) AS n, count_if(p_partkey IS NOT NULL) AS matched, round(min(CASE WHEN s BETWEEN 0.3 AND 6 AND abs(w - s) > 0.03 THEN s ELSE w END), 6) AS min_width
    FROM o GROUP BY 1
    """,
)
def enrich_conflicts(t: Tables) -> DataFrame:
    """JOIN-10: line prices as drawn widths, list prices as schedule widths."""
    null = F.lit(None).cast("double")
    openings = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("opening_id"), F.col("l_partkey").alias("tag"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("width_m"),
        F.lit("extracted").alias("width_status"), null.alias("height_m"), null.alias("sill_m"),
        F.array(F.lit("drawing")).alias("provenance"),
    )
    rows = t.part.select(
        F.col("p_partkey").alias("tag"), F.col("p_partkey").alias("row_id"), F.col("p_partkey").alias("order_no"),
        (F.col("p_retailprice") / 1000).alias("width"), null.alias("height"), null.alias("sill"),
    )
    enriched, _ = op.enrich_with_schedule(openings, rows)
    return enriched.groupBy(F.col("width_status").alias("status")).agg(
        n_rows().alias("n"), F.count_if("matched").alias("matched"), F.round(F.min("width_m"), 6).alias("min_width")
    )


@query(
    "diff_tables",
    """
    WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderpriority <> '5-LOW'),
    n AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 300000 THEN 'X' WHEN o_totalprice < 50000 THEN NULL ELSE o_orderstatus END AS v
          FROM orders WHERE o_orderpriority <> '1-URGENT')
    SELECT coalesce(o.k, n.k) AS k, o.v AS old_value, n.v AS new_value,
      CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'unchanged' ELSE 'changed' END AS change,
      o.k IS NULL OR (n.k IS NOT NULL AND o.v IS DISTINCT FROM n.v) AS user_confirmed
    FROM o FULL OUTER JOIN n ON o.k = n.k
    """,
)
def diff_tables(t: Tables) -> DataFrame:
    """JOIN-11: two snapshots of the orders compared by key."""
    o = t.orders.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("value"))
    edited = F.when(F.col("o_totalprice") > 300000, "X").when(F.col("o_totalprice") >= 50000, F.col("o_orderstatus"))
    n = t.orders.filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("k"), edited.alias("value"))
    return op.diff_facts(o, n, ["k"])


@query(
    "decisions_join",
    """
    WITH h AS (SELECT user_id AS root_id, event_id AS version_id, generate_subscripts(['a','b','c'], 1) - 1 AS hint_no,
        unnest([event_type || '-a', event_type || '-b', CAST(json_extract(props, '$.k') AS VARCHAR)]) AS hint FROM events),
    d AS (SELECT c_custkey AS root_id, unnest(['click-a', 'view-b', CAST(c_nationkey AS VARCHAR)]) AS hint, c_mktsegment AS decision FROM customer)
    SELECT h.root_id, version_id, hint_no, hint, decision, decision IS NULL AS open FROM h LEFT JOIN d USING (root_id, hint)
    """,
)
def decisions_join(t: Tables) -> DataFrame:
    """JOIN-12: hints inside event records with the decision of the same user, where there is one."""
    k = F.get_json_object("props", "$.k")
    hints = F.array(F.concat("event_type", F.lit("-a")), F.concat("event_type", F.lit("-b")), k)
    versions = t.events.select(
        F.col("user_id").alias("root_id"), F.col("event_id").alias("version_id"),
        F.array(F.struct(F.col("event_id").alias("page_id"), hints.alias("hints"))).alias("pages"),
    )
    decisions = t.customer.select(
        F.col("c_custkey").alias("root_id"),
        F.explode(F.array(F.lit("click-a"), F.lit("view-b"), F.col("c_nationkey").cast("string"))).alias("hint"),
        F.col("c_mktsegment").alias("decision"), F.col("c_custkey").alias("order_no"),
    )
    out = op.suggestions_with_decisions(versions, decisions)
    return out.select("root_id", "version_id", F.col("hint_no").cast("bigint"), "hint", "decision", "open")


@query(
    "override_rules",
    """
    WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
    j AS (SELECT o.*, o_orderstatus AS sc, p_type AS mc, s_suppkey FROM o LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 20000) ON o_orderkey = l_orderkey
      LEFT JOIN (SELECT * FROM part WHERE p_size > 3) ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey),
    c AS (SELECT 'unknown_surface' AS code, * FROM j WHERE sc IS NULL UNION ALL SELECT 'unknown_material', * FROM j WHERE mc IS NULL
      UNION ALL SELECT 'category_mismatch', * FROM j WHERE (sc = 'O') = (mc = 'ECONOMY') UNION ALL SELECT 'unknown_element', * FROM j WHERE s_suppkey IS NULL)
    SELECT code, l_linenumber, count(*) AS n FROM c GROUP BY ALL
    """,
)
def override_rules(t: Tables) -> DataFrame:
    """JOIN-13: lines as overrides of a surface (order) with a material (part) on an element (supplier)."""
    overrides = t.lineitem.select(
        F.col("l_orderkey").alias("surface"), F.col("l_partkey").alias("material"), F.col("l_suppkey").alias("element"), "l_linenumber"
    )
    surfaces = t.orders.filter("o_totalprice > 20000").select(
        F.col("o_orderkey").alias("surface"), F.when(F.col("o_orderstatus") == "O", "wall").otherwise("floor").alias("category")
    )
    materials = t.part.filter("p_size > 3").select(
        F.col("p_partkey").alias("material"), F.when(F.col("p_type") == "ECONOMY", "floor").otherwise("wall").alias("category")
    )
    elements = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("element"))
    return op.validate_overrides(overrides, surfaces, materials, elements).groupBy("code", "l_linenumber").agg(n_rows().alias("n"))


@query(
    "recursive_chain",
    """
    WITH RECURSIVE c AS (SELECT p_partkey AS name, p_partkey AS pos, 0 AS depth FROM part
      UNION ALL SELECT c.name, c.pos // 2, c.depth + 1 FROM c JOIN part p ON p.p_partkey = c.pos
        WHERE NOT (p.p_size > 40) AND c.pos > 0),
    e AS (SELECT name, arg_max(pos, depth) AS pos, max(depth) AS depth FROM c GROUP BY 1)
    SELECT name, CASE WHEN p_size > 40 THEN pos ELSE -1 END AS serving,
      CASE WHEN p_size > 40 AND depth = 0 THEN 'ok' ELSE 'degraded' END AS status, CASE WHEN p_size > 40 THEN CAST(depth AS BIGINT) END AS depth
    FROM e JOIN part ON p_partkey = pos
    """,
)
def recursive_chain(t: Tables) -> DataFrame:
    """JOIN-14: parts fall back to the part with half their key until a large one serves."""
    k = F.col("p_partkey")
    registry = t.part.select(
        k.alias("name"), F.when(k > 0, F.floor(k / 2)).alias("fallback"), (F.col("p_size") > 40).alias("usable")
    )
    return op.fallback_chain(registry, mock="-1").withColumn("serving", F.col("serving").cast("bigint"))
