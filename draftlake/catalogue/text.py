"""TXT operators on the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions.numeric import n_rows
from draftlake.catalogue.registry import Tables, query
from draftlake.functions.ordered import gap_islands, scan, time_block
from draftlake.functions.text import let, sums_before
from draftlake.operators import layout as lay
from draftlake.operators import mining as op


# One word per token of every line: 10 px per character, lines 20 px apart, words 12 px high.
PLACED_SQL = """
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    t AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS tok,
        generate_subscripts(string_split(line, ' '), 1) AS pos FROM l),
    w AS (SELECT *, {gap} * (pos - 1) + 10 * coalesce(sum(length(tok)) OVER (PARTITION BY doc_id, line_no
        ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0,
        trim(regexp_replace(strip_accents(lower(tok)), '[^0-9a-z]+', ' ', 'g')) AS f FROM t)
"""


def placed_pages(docs: DataFrame, gap: int = 10) -> DataFrame:
    """The placed words of each document as one array, in its row."""
    def of_line(line: Column, no: Column) -> Column:
        def placed(toks: Column) -> Column:
            spots = lambda before: F.transform(toks, lambda w, i: word(w, i, F.get(before, i), no))
            return F.filter(let(sums_before(F.transform(toks, F.length)), spots), lambda w: w["text"] != "")

        return let(F.split(line, " "), placed)

    def word(w: Column, i: Column, before: Column, no: Column) -> Column:
        x0, y0 = (i * gap + before * 10).cast("double"), (no * 20).cast("double")
        return F.struct(
            (no.cast("bigint") * 100000 + i).alias("word_no"), w.alias("text"), x0.alias("x0"), y0.alias("y0"),
            (x0 + F.length(w) * 10).alias("x1"), (y0 + 12).alias("y1"), F.lit(0.0).alias("angle_deg"),
        )

    return docs.select("doc_id", F.flatten(F.transform(F.split("text", "\n"), of_line)).alias("words"))


def placed_words(docs: DataFrame, gap: int = 10) -> DataFrame:
    # an outer generator has no inferred filter that would place the words once more
    return placed_pages(docs, gap).select("doc_id", F.inline_outer("words")).filter("word_no IS NOT NULL")


@query(
    "overlap_chunks",
    """
    WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents),
    s AS (SELECT doc_id, text, unnest(CASE WHEN n <= 1536 THEN [0]
        ELSE list_concat(range(0, n - 1536, 1228), [n - 1536]) END) AS start FROM d)
    SELECT doc_id, start, md5(substr(text, CAST(start + 1 AS BIGINT), 1536)) AS chunk_md5,
      row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS "window"
    FROM s
    """,
)
def overlap_chunks(t: Tables) -> DataFrame:
    """TXT-1: overlapping windows over whole texts."""
    c = op.overlap_chunks(t.spread("documents").select("doc_id", "text"))
    return c.select("doc_id", F.col("window").cast("bigint"), "start", F.md5("chunk").alias("chunk_md5"))


@query(
    "raster_tiles",
    """
    WITH d AS (SELECT doc_id, n_chars AS w, length(text) - length(replace(text, 'e', '')) AS h FROM documents),
    x AS (SELECT doc_id, len(CASE WHEN w <= 512 THEN [0] ELSE list_concat(range(0, w - 512, 409), [w - 512]) END) AS nx,
      greatest(w - 512, 0) AS last_x,
      len(CASE WHEN h <= 512 THEN [0] ELSE list_concat(range(0, h - 512, 409), [h - 512]) END) AS ny,
      greatest(h - 512, 0) AS last_y FROM d)
    SELECT doc_id, CAST(nx * ny AS BIGINT) AS tiles, last_x, last_y FROM x
    """,
)
def raster_tiles(t: Tables) -> DataFrame:
    """TXT-1: 2-D tiles of a raster as wide as a text is long and as high as it has letters e."""
    e = F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))
    d = t.spread("documents").select("doc_id", F.col("n_chars").alias("width"), e.cast("bigint").alias("height"))
    tiles = op.raster_tiles(d, "width", "height", tile=512)
    return tiles.groupBy("doc_id").agg(
        n_rows().alias("tiles"), F.max("x").alias("last_x"), F.max("y").alias("last_y")
    )


@query(
    "fold_groups",
    """
    WITH w AS (SELECT unnest(string_split_regex(text, '\\s+')) AS word FROM documents),
    v AS (SELECT trim(regexp_replace(strip_accents(lower(word)), '[^0-9a-z]+', ' ', 'g')) AS key, word, count(*) AS n
          FROM w WHERE word <> '' GROUP BY ALL)
    SELECT key, count(*) AS variants, CAST(sum(n) AS BIGINT) AS occurrences FROM v WHERE key <> '' GROUP BY key
    """,
)
def fold_groups(t: Tables) -> DataFrame:
    """TXT-2: spelling variants of every word of all documents."""
    return op.group_by_fold(op.explode_words(t.spread("documents"), ["doc_id"]), "word")


@query(
    "measurements",
    """
    WITH b AS (SELECT l_linenumber AS k, CAST(l_quantity AS BIGINT) AS q, l_partkey AS p FROM lineitem),
    r AS (SELECT CASE k WHEN 1 THEN 'm' WHEN 2 THEN 'cm' WHEN 3 THEN 'mm' WHEN 4 THEN 'm'
        WHEN 5 THEN 'ambiguous' WHEN 6 THEN 'ft-in' ELSE 'ambiguous' END AS unit,
      CASE k WHEN 1 THEN CAST(q AS DOUBLE) WHEN 2 THEN q * CAST(0.01 AS DOUBLE) WHEN 3 THEN p * CAST(0.001 AS DOUBLE)
        WHEN 4 THEN q + CAST(0.5 AS DOUBLE)
        WHEN 5 THEN (CASE WHEN p >= 1000 THEN p / CAST(1000 AS DOUBLE) ELSE p / CAST(100 AS DOUBLE) END)
        WHEN 6 THEN (q * CAST(12 AS DOUBLE) + 6 + CAST(0.5 AS DOUBLE)) * CAST(0.0254 AS DOUBLE)
        ELSE q + CAST(0.25 AS DOUBLE) END AS v,
      CASE WHEN k IN (5, 7) THEN 2 ELSE 1 END AS n FROM b)
    SELECT unit, count(*) AS n, min(v) AS min_m, max(v) AS max_m, CAST(sum(n) AS BIGINT) AS readings FROM r GROUP BY unit
    """,
)
def measurements(t: Tables) -> DataFrame:
    """TXT-3: dimension strings in seven notations composed from quantities and part keys. Equal strings
    are counted first, so each distinct one is parsed once."""
    q, p, k = F.col("l_quantity").cast("int"), F.col("l_partkey"), F.col("l_linenumber")
    text = (
        F.when(k == 1, F.format_string("%d m", q))
        .when(k == 2, F.format_string("wall %dcm long", q))
        .when(k == 3, F.format_string("%d mm", p))
        .when(k == 4, F.format_string("%d,50", q))
        .when(k == 5, F.format_string("%d", p))
        .when(k == 6, F.format_string("%d'-6 1/2\"", q))
        .otherwise(F.format_string("%d.250", q))
    )
    texts = t.spread("lineitem").groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("times"))
    return op.measurement_stats(op.mine_measurements(texts, ["times"]), times="times")


@query(
    "document_measurements",
    """
    WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '%s')) AS raw FROM documents),
    u AS (SELECT doc_id, raw, CASE WHEN regexp_matches(raw, '[''′]') THEN 'ft-in' WHEN raw LIKE '%%mm' THEN 'mm' WHEN raw LIKE '%%cm' THEN 'cm' WHEN raw LIKE '%%m' THEN 'm' END AS s,
      trim(regexp_replace(raw, '(mm|cm|m)$', '')) AS b FROM m),
    ok AS (SELECT * FROM u WHERE s = 'ft-in' OR regexp_full_match(b, '(\\d{1,3}([., ]\\d{3})+|\\d+)([.,]\\d+)?'))
    SELECT doc_id, coalesce(s, CASE WHEN regexp_full_match(b, '\\d{1,3}([.,]\\d{3})*(\\.\\d{3}(,\\d+)?|,\\d{3}(\\.\\d+)?)') THEN 'ambiguous'
        WHEN regexp_matches(b, '[.,]\\d{1,2}$') THEN 'm' ELSE 'ambiguous' END) AS unit,
      count(*) AS n, count(DISTINCT raw) AS distinct_raw FROM ok GROUP BY ALL
    """ % op.MEASURE_PATTERN.replace("'", "''"),
)
def document_measurements(t: Tables) -> DataFrame:
    """TXT-3: readings in running text, per document and unit, over whole texts."""
    mined = op.mine_measurements(t.spread("documents"), ["doc_id"])
    return mined.groupBy("doc_id", "unit").agg(n_rows().alias("n"), F.count_distinct("raw").alias("distinct_raw"))


@query(
    "scales",
    """
    WITH h AS (SELECT l_orderkey, l_linenumber * 1000000000000 + l_partkey * 10000 + l_suppkey AS line_no,
        CASE WHEN l_returnflag = 'A' THEN CAST(l_partkey AS DOUBLE) ELSE CAST(12.0 * l_linenumber / l_suppkey AS DOUBLE) END AS s
      FROM lineitem WHERE (l_returnflag = 'A' AND l_partkey BETWEEN 1 AND 10000) OR (l_returnflag = 'R' AND l_suppkey > 0))
    SELECT l_orderkey, count(*) AS candidates, arg_min(s, line_no) AS scale FROM h GROUP BY 1
    """,
)
def scales(t: Tables) -> DataFrame:
    """TXT-4: scale lines of an order: ratio, imperial, and unlabelled ones that do not count."""
    flag = F.col("l_returnflag")
    text = (
        F.when(flag == "A", F.format_string("ÖLÇEK: 1/%d", "l_partkey"))
        .when(flag == "R", F.format_string("Scale %d/%d\" = 1'-0\"", "l_suppkey", "l_linenumber"))
        .otherwise(F.format_string("Note 1:%d", "l_partkey"))
    )
    no = F.col("l_linenumber").cast("bigint") * 1000000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")
    lines = t.spread("lineitem").select("l_orderkey", text.alias("text"), no.alias("line_no"))
    return op.mine_scales(lines, ["l_orderkey"])


@query(
    "document_tags",
    """
    WITH w AS (SELECT upper(translate(unnest(string_split_regex(text, '\\s+')), 'iı', 'İI')) AS u FROM documents
      UNION ALL SELECT upper(substr(c_mktsegment, 1, 2)) || '-' || c_custkey FROM customer
      UNION ALL SELECT substr('KDPW', CAST(c_nationkey AS INT) % 4 + 1, 1) || ' 0' || c_custkey FROM customer),
    g AS (SELECT regexp_extract(u, '^([A-ZÇĞİÖŞÜ]{1,3})[-_ ]?(\\d{1,4}[A-Z]?)$', 1) AS p,
        ltrim(regexp_extract(u, '^([A-ZÇĞİÖŞÜ]{1,3})[-_ ]?(\\d{1,4}[A-Z]?)$', 2), '0') AS n
      FROM w WHERE regexp_matches(u, '^([A-ZÇĞİÖŞÜ]{1,3})[-_ ]?(\\d{1,4}[A-Z]?)$'))
    SELECT p || CASE n WHEN '' THEN '0' ELSE n END AS tag,
      CASE WHEN p IN ('K', 'D', 'KP') THEN 'door' WHEN p IN ('P', 'W', 'PN') THEN 'window' END AS kind,
      count(*) AS n FROM g GROUP BY ALL
    """,
)
def document_tags(t: Tables) -> DataFrame:
    """TXT-5: tags among all document words and among codes composed from customers."""
    words = op.explode_words(t.spread("documents"), ["doc_id"]).select(F.col("word").alias("text"))
    prefix = F.substr(F.lit("KDPW"), (F.col("c_nationkey") % 4 + 1).cast("int"), F.lit(1))
    codes = t.customer.select(
        F.inline(
            F.array(
                F.struct(F.concat(F.substring("c_mktsegment", 1, 2), F.lit("-"), F.col("c_custkey")).alias("text")),
                F.struct(F.concat(prefix, F.lit(" 0"), F.col("c_custkey")).alias("text")),
            )
        )
    )
    return op.mine_tags(words.unionAll(codes)).groupBy("tag", "kind").agg(n_rows().alias("n"))


@query(
    "repaired_tags",
    """
    WITH r AS (SELECT c_custkey, 'P' || translate(CAST(c_custkey AS VARCHAR), '0125', 'OIZS') AS reading, CAST(c_custkey AS VARCHAR) AS k FROM customer)
    SELECT c_custkey, reading, CASE
      WHEN regexp_matches(reading, '^[A-Z]{1,3}\\d{1,4}[A-Z]?$') THEN regexp_extract(reading, '^([A-Z]{1,3})(\\d{1,4}[A-Z]?)$', 1)
        || CASE ltrim(regexp_extract(reading, '^([A-Z]{1,3})(\\d{1,4}[A-Z]?)$', 2), '0') WHEN '' THEN '0'
           ELSE ltrim(regexp_extract(reading, '^([A-Z]{1,3})(\\d{1,4}[A-Z]?)$', 2), '0') END
      WHEN length(k) <= 4 THEN 'P' || k END AS tag
    FROM r
    """,
)
def repaired_tags(t: Tables) -> DataFrame:
    """TXT-6: digits replaced by look-alike letters, read back."""
    reading = F.concat(F.lit("P"), F.translate(F.col("c_custkey").cast("string"), "0125", "OIZS"))
    return op.repair_lookalikes(t.customer.select("c_custkey", reading.alias("reading")))


@query(
    "document_lines",
    "WITH" + PLACED_SQL.format(gap=10) + """,
    x AS (SELECT *, x0 + 10 * length(tok) AS x1 FROM w WHERE tok <> ''),
    c AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id, line_no ORDER BY x0) <= 10.8 THEN 0 ELSE 1 END AS cut FROM x),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, line_no ORDER BY x0) AS ln FROM c)
    SELECT doc_id, CAST(line_no * 20 AS DOUBLE) AS y0, CAST(min(x0) AS DOUBLE) AS x0, count(*) AS n_words,
      md5(string_agg(tok, ' ' ORDER BY x0)) AS text_md5
    FROM i GROUP BY doc_id, line_no, ln
    """,
)
def document_lines(t: Tables) -> DataFrame:
    """TXT-7: lines rebuilt from the placed words of whole documents."""
    lines = lay.lines_from_words(placed_pages(t.spread("documents")), ["doc_id"])
    return lines.select("doc_id", "y0", "x0", "n_words", F.md5("text").alias("text_md5"))


@query(
    "lines_by_gap",
    """
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR
        THEN 0 ELSE 1 END AS cut FROM events),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
    SELECT user_id, CAST(island AS BIGINT) AS island, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n
    FROM i GROUP BY ALL
    """,
)
def lines_by_gap(t: Tables) -> DataFrame:
    """TXT-7: the same gap rule on a user's events, split over days so a busy user is no bottleneck."""
    e = t.events.select("user_id", "ts", "event_id")
    marked = gap_islands(
        e, ["user_id"], ["ts", "event_id"], time_block(F.col("ts")), F.col("ts"),
        lambda before: F.col("ts") - before <= F.expr("INTERVAL 6 HOUR"),
    )
    return marked.groupBy("user_id", "island").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), n_rows().alias("n")
    )


LABELS = {"the": ["the"], "is": ["is", "est"], "of": ["of", "de"], "in": ["in", "en"], "and": ["and", "et", "und"]}


@query(
    "label_values",
    "WITH" + PLACED_SQL.format(gap=10) + """,
    h AS (SELECT doc_id, line_no, string_agg(tok, ' ' ORDER BY pos) AS text, arg_min(f, pos) AS head, count(*) AS n,
        trim(regexp_replace(strip_accents(lower(string_agg(tok, ' ' ORDER BY pos))), '[^0-9a-z]+', ' ', 'g')) AS whole
      FROM w WHERE tok <> '' GROUP BY doc_id, line_no),
    d(k, field) AS (VALUES ('the','the'),('is','is'),('est','is'),('of','of'),('de','of'),('in','in'),('en','in'),('and','and'),('et','and'),('und','and')),
    lab AS (SELECT h.*, coalesce(a.field, CASE WHEN n > 1 THEN b.field END) AS field, a.field IS NOT NULL AS is_whole FROM h
      LEFT JOIN d a ON a.k = whole LEFT JOIN d b ON b.k = head),
    ok AS (SELECT doc_id FROM lab WHERE field IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
    v AS (SELECT l.doc_id, l.field, l.line_no, arg_min(c.text, c.line_no) AS value FROM lab l JOIN ok USING (doc_id)
      JOIN lab c ON c.doc_id = l.doc_id AND c.line_no > l.line_no AND c.line_no * 20 - (l.line_no * 20 + 12) <= 36 AND NOT c.is_whole
      WHERE l.field IS NOT NULL GROUP BY ALL),
    f AS (SELECT doc_id, field, arg_min(value, line_no) AS value FROM v GROUP BY ALL)
    SELECT doc_id, count(*) AS n_fields, string_agg(field || '=' || md5(value), ';' ORDER BY field) AS fields
    FROM f GROUP BY doc_id HAVING count(*) >= 2
    """,
)
def label_values(t: Tables) -> DataFrame:
    """TXT-8: lines that start with a function word as labels, the nearest line as value."""
    single = placed_pages(t.spread("documents").withColumn("text", F.regexp_replace("text", " +", " ")))
    lines = lay.lines_from_words(single, ["doc_id"], packed=True)
    out = lay.label_values(lines, ["doc_id"], LABELS)
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), F.md5(e["value"])))
    return out.select("doc_id", F.size("fields").cast("bigint").alias("n_fields"), F.array_join(pairs, ";").alias("fields"))


HEADERS = {"a": ["the", "la", "der"], "b": ["of", "de", "die"], "c": ["and", "et", "und"], "d": ["in", "en"]}


@query(
    "table_cells",
    "WITH" + PLACED_SQL.format(gap=40) + """,
    x AS (SELECT * FROM w WHERE tok <> ''),
    k(f) AS (VALUES ('the'),('la'),('der'),('of'),('de'),('die'),('and'),('et'),('und'),('in'),('en')),
    hdr AS (SELECT doc_id, min(line_no) AS h FROM (SELECT doc_id, line_no FROM x SEMI JOIN k USING (f)
        GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY doc_id),
    r AS (SELECT DISTINCT x.doc_id, line_no FROM x JOIN hdr USING (doc_id) WHERE line_no >= h),
    g AS (SELECT *, CASE WHEN (line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no)) * 20 - 12 > 48 THEN 1 ELSE 0 END AS cut FROM r),
    z AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY line_no) AS cuts FROM g),
    y AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS row_index FROM z WHERE cuts = 0),
    c AS (SELECT x.doc_id, x0, row_number() OVER (PARTITION BY x.doc_id ORDER BY x0) - 1 AS col FROM x JOIN hdr ON hdr.doc_id = x.doc_id AND h = line_no),
    p AS (SELECT x.doc_id, row_index, x.x0, tok FROM x JOIN y USING (doc_id, line_no)),
    a AS (SELECT p.doc_id, row_index, p.x0, tok, col FROM p ASOF LEFT JOIN c ON c.doc_id = p.doc_id AND p.x0 + 6 >= c.x0),
    b AS (SELECT doc_id, row_index, coalesce(col, 0) AS col_index, md5(string_agg(tok, ' ' ORDER BY x0)) AS cell FROM a GROUP BY ALL)
    SELECT doc_id, col_index, count(*) AS cells, CAST(sum(row_index) AS BIGINT) AS row_sum, min(cell) AS first_md5 FROM b GROUP BY ALL
    """,
)
def table_cells(t: Tables) -> DataFrame:
    """TXT-9: widely spaced words as a table under the first line with two header words."""
    cells = lay.table_from_words(placed_pages(t.spread("documents"), gap=40), ["doc_id"], HEADERS)
    return cells.groupBy("doc_id", "col_index").agg(
        n_rows().alias("cells"), F.sum("row_index").alias("row_sum"), F.min(F.md5("value")).alias("first_md5")
    )


@query(
    "asof_header",
    """
    SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
      OVER (PARTITION BY user_id ORDER BY ts, event_id) AS signup_id FROM events
    """,
)
def asof_header(t: Tables) -> DataFrame:
    """TXT-9: as-of lookup on events: the last sign-up at or before each event."""
    e = t.events.select("event_id", "user_id", "ts", "event_type")
    mark = F.when(F.col("event_type") == "signup", F.col("event_id"))
    out = scan(e, ["user_id"], ["ts", "event_id"], time_block(F.col("ts")), last_seen={"signup_id": mark})
    return out.select("event_id", "user_id", "signup_id")


@query(
    "typed_cells",
    """
    SELECT l_orderkey AS sheet, ((l_partkey * 100000 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS row_index, 'P' || l_partkey % 1000 AS tag,
      'door_window' AS kind, CAST(l_quantity AS DOUBLE) * CAST(0.01 AS DOUBLE) AS width,
      CASE WHEN l_tax * 100 > 3.5 THEN CAST(l_linenumber * 5 AS DOUBLE) * CASE WHEN l_linenumber * 5 > 10 THEN CAST(0.01 AS DOUBLE) ELSE 1 END END AS height,
      CAST(l_linenumber AS DOUBLE) AS qty, l_returnflag AS material
    FROM lineitem
    """,
)
def typed_cells(t: Tables) -> DataFrame:
    """TXT-10: order lines as rows of a door schedule with a Turkish header row."""
    sheet, row = F.col("l_orderkey").alias("sheet"), (((F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("bigint")).alias("row_index")
    cells = lambda values: F.array(*[F.struct(F.lit(i).alias("col_index"), v.alias("value")) for i, v in enumerate(values)]).alias("cells")
    line = t.spread("lineitem").select(
        sheet, row,
        cells([
            F.concat(F.lit("p-0"), F.col("l_partkey") % 1000),
            F.format_string("%d,0", F.col("l_quantity").cast("int")),
            F.when(F.col("l_tax") * 100 > 3.5, F.format_string("%d", F.col("l_linenumber") * 5)).otherwise("-"),
            F.col("l_linenumber").cast("string"),
            F.col("l_returnflag"),
            F.lit(""),
        ]),
    )
    titles = ("Poz", "GENİŞLİK (cm)", "Yükseklik", "Adet", "Malzeme", "Not")
    head = t.lineitem.select(sheet).distinct().select("sheet", F.lit(-1).cast("bigint").alias("row_index"), cells([F.lit(x) for x in titles]))
    _, rows = lay.normalise_schedules(head.unionByName(line), ["sheet"])
    return rows.select(
        "sheet", "row_index", "tag", "kind", F.col("numeric")["width"].alias("width"),
        F.col("numeric")["height"].alias("height"), F.col("numeric")["qty"].alias("qty"),
        F.col("fields")["material"].alias("material"),
    )


@query(
    "word_features",
    """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS r FROM documents),
    t AS (SELECT doc_id, r, unnest(string_split_regex(line, '\\s+')) AS tok FROM l),
    w AS (SELECT *, trim(regexp_replace(strip_accents(lower(tok)), '[^0-9a-z]+', ' ', 'g')) AS f FROM t WHERE tok <> ''),
    r AS (SELECT doc_id, sum(n) AS long FROM (SELECT doc_id, r, count(*) AS n FROM w GROUP BY 1, 2) WHERE n >= 8 GROUP BY 1)
    SELECT doc_id, round(ln(1 + count(*)), 9) AS log_words,
      round(count_if(regexp_matches(tok, '\\d')) / count(*), 9) AS numeric_frac,
      round(sum(length(tok)) / count(*) / 10.0, 9) AS avg_word_len,
      round(coalesce(max(long), 0) / count(*), 9) AS long_line_words,
      round(ln(1 + count_if(f LIKE 'ada%') + count_if(f LIKE 'lot%') + count_if(f LIKE 'avenue%') + count_if(f LIKE 'street%')
        + count_if(f LIKE 'sokak%') + count_if(f LIKE 'cadde%') + count_if(f LIKE 'parsel%') + count_if(f LIKE 'vaziyet%')), 9) AS kw_site_plan,
      round(ln(1 + count_if(f LIKE 'page%') + count_if(f LIKE 'notes%') + count_if(f LIKE 'brief%') + count_if(f LIKE 'ozeti%')
        + count_if(f LIKE 'sartname%') + count_if(f LIKE 'specification%') + count_if(f LIKE 'notlari%') + count_if(f LIKE 'sayfa%')), 9) AS kw_text_document
    FROM w LEFT JOIN r USING (doc_id) GROUP BY doc_id
    """,
)
def word_features(t: Tables) -> DataFrame:
    """TXT-11: features of whole documents, one text line per row of words."""
    lines = F.split("text", "\n")
    words = F.flatten(
        F.transform(
            lines,
            lambda line, i: F.transform(
                F.filter(F.split(line, r"\s+"), lambda w: w != ""),
                lambda w: F.struct(
                    w.alias("text"), (i * 20).cast("double").alias("y0"), (i * 20 + 10).cast("double").alias("y1")
                ),
            ),
        )
    )
    f = op.word_features(t.spread("documents").select("doc_id", words.alias("words")))
    names = ["log_words", "numeric_frac", "avg_word_len", "long_line_words", "kw_site_plan", "kw_text_document"]
    return f.select("doc_id", *[F.round(n, 9).alias(n) for n in names])


@query(
    "rule_classes",
    """
    WITH p AS (SELECT CASE l_returnflag WHEN 'A' THEN 'sheet' WHEN 'N' THEN 'slide' ELSE CASE l_linestatus WHEN 'O' THEN 'docx' ELSE 'image' END END AS kind,
        l_quantity AS q, l_linenumber AS n FROM lineitem)
    SELECT kind, CASE kind WHEN 'docx' THEN 'text_document' WHEN 'sheet' THEN CASE WHEN n <= 2 THEN 'schedule' ELSE 'other' END
        WHEN 'slide' THEN CASE WHEN n > 3 THEN 'moodboard' ELSE 'text_document' END END AS label,
      CASE kind WHEN 'docx' THEN CAST(1 AS DOUBLE) WHEN 'sheet' THEN 1 WHEN 'slide' THEN 0.85 END AS confidence,
      CASE kind WHEN 'image' THEN 'raster' END AS source, count(*) AS n
    FROM p GROUP BY ALL
    """,
)
def rule_classes(t: Tables) -> DataFrame:
    """TXT-12: label and plan source of pages by rule."""
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "sheet").when(flag == "N", "slide").otherwise(
        F.when(F.col("l_linestatus") == "O", "docx").otherwise("image")
    )
    pages = t.lineitem.select(
        kind.alias("kind"), (F.col("l_linenumber") <= 2).alias("has_schedule_header"),
        F.when(F.col("l_linenumber") > 3, F.col("l_linenumber")).otherwise(0).alias("pictures"),
    )
    src = op.source_kind(F.col("kind"), F.lit(0), F.lit(0.0), F.lit(False), F.lit(True))
    return op.classify_by_rule(pages).groupBy(
        "kind", F.col("rule.label").alias("label"), F.col("rule.confidence").alias("confidence"), src.alias("source")
    ).agg(n_rows().alias("n"))


@query(
    "level_stack",
    """
    WITH r AS (SELECT o_custkey AS project_id, o_orderkey AS idx, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN CAST(1 AS DOUBLE)
        WHEN '2' THEN 0 WHEN '3' THEN 1000 WHEN '4' THEN NULL ELSE -2 END AS rank FROM orders),
    n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY rank NULLS LAST, idx) - 1 AS position,
        sum(CASE WHEN rank IS NULL OR rank = 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY rank NULLS LAST, idx) AS above,
        coalesce(max(CASE WHEN rank < 1000 THEN rank END) OVER (PARTITION BY project_id), -1) AS top,
        bool_or(rank IS NULL) OVER (PARTITION BY project_id) AS assumed FROM r)
    SELECT project_id, idx, rank, position, CASE WHEN rank IS NULL OR rank = 1000 THEN (top + above) * 3 ELSE rank * 3 END AS elevation_m, assumed
    FROM n
    """,
)
def level_stack(t: Tables) -> DataFrame:
    """TXT-13: storeys of a customer named after order priorities, stacked."""
    p = F.substring("o_orderpriority", 1, 1)
    name = (
        F.when(p == "1", "1. Kat Planı").when(p == "2", "ZEMİN KAT").when(p == "3", "Çatı")
        .when(p == "4", "Blok").otherwise("2. BODRUM")
    )
    levels = t.orders.select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("idx"), name.alias("level_name")
    )
    return op.stack_levels(levels).drop("level_name")
