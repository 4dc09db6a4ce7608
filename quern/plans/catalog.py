"""Queries over registers: documents built from customers that hold every kind of node, with nested headings, lists, tables and captions.

The other tables hold flat text only. A register has sections for market segments, each with a definition, a rule, accounts as a list, two
labelled tables that share identifiers, and a third that goes on without a label.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import chunks as C
from quern.operators import enrich as E
from quern.operators import features as X
from quern.operators import structure as S
from quern.plans import facts
from quern.plans.core import FOLD
from quern.plans.facts import HTML, QUANTITY
from quern.runtime import memo, stored, table
from quern.sources import graph

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Customers of one register.
CUSTOMERS = 2000
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_SEG = "upper(substr(seg, 1, 1)) || lower(substr(seg, 2))"
# the texts, in terms that both engines read: (part, kind, level, text, pages)
SECTION = (
    (0, "heading", 1, _SEG, 1),
    (1, "paragraph", None, f"{_SEG} || ' Trade Group (' || upper(substr(seg, 1, 3)) || ') means the buyers of ' || n_name || '. See Table A.' || k || ' and Section ' || k || '.'", 1),
    (2, "paragraph", None, "'All buyers must report by March 31 ' || (1990 + k) || ', except those of Table B.' || k || '. The limit is 25 percent of $' || k || ',500 million. It has effect in 10 days.'", 2),
    (3, "heading", 2, "'Accounts'", 1),
    (4, "list", None, "'list'", 0),
    (6, "caption", None, "'Table A.' || k || ' Balances'", 1),
    (11, "code", None, "'SELECT ' || k || ';'", 1),
    (12, "figure", None, "'Figure ' || k", 1),
)
_ITEM = "c_name || ' owes $' || bal || ' million since March ' || (1990 + c_custkey % 10) || '.'"
_MODEL, _CODE = "'CX-' || lpad(CAST(c_custkey AS {0}), 5, '0')", "'cx-' || lpad(CAST(c_custkey AS {0}), 5, '0') || '.'"
_DATE = "'199' || (c_custkey % 10) || '/0' || (1 + c_custkey % 9) || '/01'"
_BALANCE = "CASE WHEN debt THEN '' ELSE CAST(bal AS {0}) END"
#: Tables of a section: (part, which customers, caption, headers, cells). The second caption belongs to its table; the third table has none.
TABLES = (
    (7, "true", "CAST(NULL AS {0})", ("Model", "Ship date", "Balance"), (_MODEL, _DATE, _BALANCE)),
    (9, "c_custkey % 4 = 0", "'Table B.' || k || ' Contacts'", ("Part number", "Contact"), (_CODE, "c_name")),
    (10, "c_custkey % 4 = 2", "CAST(NULL AS {0})", ("Part number", "Contact"), (_CODE, "c_name")),
)


def customers(spark, sf_dir) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    number = F.expr("CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(SEGMENTS, 1)) + " END")
    both = c.join(n, F.expr("n_nationkey = c_nationkey"))
    bucket = F.floor(F.col("c_custkey") / CUSTOMERS).cast("long").cast("string")
    return both.select(
        F.concat_ws("/", F.lit("register"), F.col("c_nationkey").cast("string"), bucket).alias("document_id"), "n_name", number.alias("k"), F.col("c_mktsegment").alias("seg"),
        "c_custkey", "c_name", F.floor(F.abs("c_acctbal")).cast("long").alias("bal"), (F.col("c_acctbal") < 0).alias("debt"),
    ).where("k IS NOT NULL")


def tables_of(spark, sf_dir) -> DataFrame:
    """(document_id, k, part, caption, headers, rows): a section's customers make one table, so a register bounds its rows."""
    c, parts = customers(spark, sf_dir), []
    for part, who, caption, headers, cells in TABLES:
        values = F.array(*[F.expr(x.format("STRING")) for x in cells])
        g = c.where(who).groupBy("document_id", "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", values.alias("v")))), lambda x: x["v"]).alias("rows"))
        parts.append(g.select("document_id", "k", F.lit(part).alias("part"), F.expr(caption.format("STRING")).alias("caption"), F.array(*map(F.lit, headers)).alias("headers"), "rows"))
    return functools.reduce(DataFrame.unionByName, parts)


def items(spark, sf_dir) -> DataFrame:
    """What graph.project() takes."""
    c = customers(spark, sf_dir)
    pos = lambda k, part, item="0": F.expr(f"struct(CAST({k} AS INT) AS k, CAST({part} AS INT) AS part, CAST({item} AS BIGINT) AS item)")
    none, pages = F.lit(None).cast("struct<k:int,part:int,item:bigint>"), F.expr("array(k + 1)")
    row = lambda df, p, kind, level, layer, text, parent, at: df.select("document_id", p.alias("pos"), parent.alias("parent_pos"), F.lit(kind).alias("kind"), F.lit(level).cast("int").alias("level"), F.lit(layer).alias("content_layer"), text.alias("text"), at.cast("array<int>").alias("pages"))
    docs, sections = c.select("document_id", "n_name").distinct(), c.select("document_id", "n_name", "k", "seg").distinct()
    parts = [
        row(docs, pos(0, 0), "title", 0, "body", F.expr("n_name || ' Register'"), none, F.array(F.lit(1))),
        row(docs, pos(0, 1), "heading", 1, "furniture", F.expr("'Confidential ' || n_name"), none, F.array(F.lit(1))),
        *(row(sections, pos("k", part), kind, level, "body", F.expr(text), none, F.expr(("array()", "array(k + 1)", "array(k + 2, k + 1)")[n])) for part, kind, level, text, n in SECTION),
        row(c, pos("k", 5, "c_custkey"), "list_item", None, "body", F.expr(_ITEM), pos("k", 4), pages),
        row(tables_of(spark, sf_dir), pos("k", "part"), "table", None, "body", E.table_text(F.col("caption"), F.concat(F.array("headers"), F.col("rows"))), none, pages),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def nodes(spark, sf_dir) -> DataFrame:
    return graph.project(items(spark, sf_dir).withColumn("k", F.col("pos.k")).withColumn("part", F.col("pos.part")))


def tables(spark, sf_dir, found: DataFrame | None = None) -> DataFrame:
    """(document_id, ordinal, k, part, caption, headers, rows) of table nodes."""
    n = found if found is not None else nodes(spark, sf_dir)
    return n.where("kind = 'table'").select("document_id", "ordinal", "node_id", "k", "part").join(tables_of(spark, sf_dir), ["document_id", "k", "part"])


def _table_sql() -> str:
    out = []
    for part, who, caption, headers, cells in TABLES:
        head = "[" + ", ".join(f"'{h}'" for h in headers) + "]"
        values = "[" + ", ".join(x.format("VARCHAR") for x in cells) + "]"
        out.append(f"SELECT document_id, k, {part} AS part, {caption.format('VARCHAR')} AS caption, {head} AS headers, list({values} ORDER BY c_custkey) AS rows FROM cust WHERE {who} GROUP BY document_id, k")
    return " UNION ALL ".join(out)


CATALOG = f"""cust AS (SELECT 'register/' || c_nationkey || '/' || floor(c_custkey / {CUSTOMERS})::BIGINT AS document_id, n_name, list_position({list(SEGMENTS)}, c_mktsegment) AS k, c_mktsegment AS seg, c_custkey, c_name, floor(abs(c_acctbal))::BIGINT AS bal, c_acctbal < 0 AS debt
  FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment IN {SEGMENTS}),
tabs AS ({_table_sql()}),
raw AS (SELECT DISTINCT document_id, 0 AS k, 0 AS part, 0::BIGINT AS item, 'title' AS kind, 0 AS level, 'body' AS content_layer, n_name || ' Register' AS text, [1] AS pages FROM cust
  UNION ALL SELECT DISTINCT document_id, 0, 1, 0, 'heading', 1, 'furniture', 'Confidential ' || n_name, [1] FROM cust
  {' '.join(f"UNION ALL SELECT DISTINCT document_id, k, {part}, 0, '{kind}', {level if level else 'NULL'}, 'body', {text}, {('[]', '[k + 1]', '[k + 2, k + 1]')[n]} FROM cust" for part, kind, level, text, n in SECTION)}
  UNION ALL SELECT document_id, k, 5, c_custkey, 'list_item', NULL, 'body', {_ITEM}, [k + 1] FROM cust
  UNION ALL SELECT document_id, k, part, 0, 'table', NULL, 'body', concat_ws(chr(10), caption, array_to_string(headers, ' | '), array_to_string(list_transform(rows, lambda r: array_to_string(r, ' | ')), chr(10))), [k + 1] FROM tabs),
placed AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY k, part, item) - 1 AS ordinal FROM raw),
nodes AS (SELECT a.document_id, a.k, a.part, a.kind, a.level, a.content_layer, a.text, a.ordinal::BIGINT AS ordinal, b.ordinal::BIGINT AS parent, list_min(a.pages)::BIGINT AS page_start, list_max(a.pages)::BIGINT AS page_end,
  len(regexp_extract_all(a.text, '\\S+'))::BIGINT AS token_count, 'node_' || sha256(concat_ws(chr(0), 'quern.node.v1', a.document_id, a.ordinal, a.text)) AS node_id,
  row_number() OVER (PARTITION BY a.document_id, coalesce(b.ordinal, -1) ORDER BY a.ordinal) AS place
  FROM placed a LEFT JOIN placed b ON a.part = 5 AND b.part = 4 AND b.k = a.k AND b.document_id = a.document_id),
heads AS (SELECT document_id, ordinal AS start, level, trim(text) AS head FROM nodes WHERE kind IN ('title', 'heading') AND content_layer = 'body'),
scopes AS (SELECT a.*, coalesce((SELECT min(b.start) FROM heads b WHERE b.document_id = a.document_id AND b.start > a.start AND b.level <= a.level), 1099511627776) AS stop FROM heads a),
paths AS (SELECT n.document_id, n.ordinal, coalesce(list(s.head ORDER BY s.level) FILTER (WHERE s.head IS NOT NULL), []) AS heading_path
  FROM nodes n LEFT JOIN scopes s ON n.content_layer = 'body' AND s.document_id = n.document_id AND n.ordinal >= s.start AND n.ordinal < s.stop GROUP BY 1, 2),
tables AS (SELECT n.document_id, n.ordinal, n.node_id, n.k, n.part, t.caption, t.headers, t.rows FROM nodes n JOIN tabs t ON n.kind = 'table' AND t.document_id = n.document_id AND t.k = n.k AND t.part = n.part)"""


# structure


@query(f"WITH {CATALOG} SELECT n.document_id, n.ordinal, n.node_id, n.kind, n.level, n.content_layer, n.text, n.parent, n.place, n.page_start, n.page_end, n.token_count, (SELECT count(*) FROM nodes c WHERE c.document_id = n.document_id AND c.parent = n.ordinal) AS n_children FROM nodes n")
def register_nodes(spark, sf_dir):
    """Registers as nodes with levels, parents, places among siblings and page ranges."""
    n = nodes(spark, sf_dir)
    c = graph.children(n).select("document_id", "ordinal", F.size("children").cast("long").alias("n_children"))
    return n.join(c, ["document_id", "ordinal"], "left").na.fill(0, ["n_children"]).select("document_id", "ordinal", "node_id", "kind", "level", "content_layer", "text", "parent", "place", "page_start", "page_end", "token_count", "n_children")


@query(f"WITH {CATALOG} SELECT document_id, ordinal, array_to_string(heading_path, ' > ') AS heading_path, len(heading_path)::BIGINT AS depth FROM paths")
def register_paths(spark, sf_dir):
    """Headings of three levels above each node."""
    return graph.heading_paths(nodes(spark, sf_dir)).select("document_id", "ordinal", F.concat_ws(" > ", "heading_path").alias("heading_path"), F.size("heading_path").cast("long").alias("depth"))


_BROKEN = (
    ("cycle", "kind = 'list' AND k = 1", "parent", "ordinal + 1"),
    ("orphan", "kind = 'code'", "parent", "ordinal + 1000000"),
    ("own", "kind = 'figure'", "parent", "ordinal"),
    ("range", "kind = 'caption'", "page_end", "0"),
    ("half", "kind = 'title'", "page_end", "NULL"),
    ("kind", "kind = 'figure'", "kind", "'drawing'"),
    ("gap", "part = 12", "ordinal", "ordinal + 500"),
)


def _broken_sql() -> str:
    cols = ("ordinal", "node_id", "kind", "parent", "page_start", "page_end")
    return " ".join(f"UNION ALL SELECT '{name}/' || document_id, " + ", ".join(f"CASE WHEN {where} THEN {value} ELSE {c} END" if c == column else c for c in cols) + " FROM nodes" for name, where, column, value in _BROKEN)


@query(f"""WITH RECURSIVE {CATALOG}, v AS (SELECT document_id, ordinal, node_id, kind, parent, page_start, page_end FROM nodes {_broken_sql()}),
r AS (SELECT document_id, ordinal FROM v WHERE parent IS NULL UNION SELECT v.document_id, v.ordinal FROM r JOIN v ON v.document_id = r.document_id AND v.parent = r.ordinal)
SELECT document_id, count(*) AS n_nodes, count(*) - count(DISTINCT node_id) AS repeated_ids, min(ordinal) <> 0 OR max(ordinal) <> count(*) - 1 OR count(DISTINCT ordinal) <> count(*) AS gaps,
  count(*) FILTER (WHERE kind NOT IN {graph.KINDS}) AS unknown_kinds, count(*) FILTER (WHERE (page_start IS NULL) <> (page_end IS NULL)) AS half_ranges, count(*) FILTER (WHERE page_start > page_end OR page_start < 1) AS bad_ranges,
  count(*) FILTER (WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v p WHERE p.document_id = v.document_id AND p.ordinal = v.parent)) AS unknown_parents, count(*) FILTER (WHERE parent = ordinal) AS own_parents,
  count(*) FILTER (WHERE (document_id, ordinal) NOT IN (SELECT (document_id, ordinal) FROM r)) AS unreachable FROM v GROUP BY 1""")
def register_violations(spark, sf_dir):
    """What breaks the graphs of registers, and of copies of them that are broken in seven ways."""
    n = stored(nodes(spark, sf_dir).select("document_id", "ordinal", "node_id", "kind", "parent", "page_start", "page_end", "k", "part"), "register")
    copies = [n]
    for name, where, column, value in _BROKEN:
        kind = dict(n.dtypes)[column]
        copies.append(n.withColumns({column: F.expr(f"CAST(CASE WHEN {where} THEN {value} ELSE {column} END AS {kind})"), "document_id": F.concat(F.lit(f"{name}/"), "document_id")}))
    return graph.violations(stored(functools.reduce(DataFrame.unionByName, copies).drop("k", "part"), "broken"))


def _with_paths(spark, sf_dir) -> DataFrame:
    n = nodes(spark, sf_dir)
    return n.join(graph.heading_paths(n), ["document_id", "ordinal"])


def _near(kind: str, penalty: float, heading: bool, limit: int) -> str:
    same = " AND p.heading_path = q.heading_path" if heading else ""
    return f"""SELECT a.document_id, a.ordinal AS anchor, b.ordinal AS neighbour, abs(a.place - b.place) AS distance, round(pow({penalty}, abs(a.place - b.place)), 6) AS penalty
FROM nodes a JOIN nodes b ON a.document_id = b.document_id AND a.parent IS NOT DISTINCT FROM b.parent AND abs(b.place - a.place) BETWEEN 1 AND {limit}
JOIN paths p ON p.document_id = a.document_id AND p.ordinal = a.ordinal JOIN paths q ON q.document_id = b.document_id AND q.ordinal = b.ordinal WHERE a.kind = '{kind}' AND b.kind = '{kind}'{same}"""


@query(f"WITH {CATALOG} {_near('paragraph', S.SIBLING, True, 1)}")
def register_siblings(spark, sf_dir):
    """Paragraphs next to each paragraph among its parent's children, under the same headings."""
    return S.relatives(_with_paths(spark, sf_dir), "paragraph", 1, S.SIBLING, True)


@query(f"WITH {CATALOG} {_near('list_item', S.LIST, False, 2)}")
def list_neighbors(spark, sf_dir):
    """List items up to two places from each list item of the same list."""
    return S.relatives(_with_paths(spark, sf_dir), "list_item", 2, S.LIST, False)


# units

MERGED = f"""m_ AS (SELECT n.document_id, n.ordinal, n.kind, n.page_start, n.page_end, n.token_count, p.heading_path, n.text, row_number() OVER (PARTITION BY n.document_id ORDER BY n.ordinal) AS r
  FROM nodes n JOIN paths p ON p.document_id = n.document_id AND p.ordinal = n.ordinal WHERE n.content_layer = 'body' AND n.kind <> 'list' AND trim(n.text) <> ''),
f AS (SELECT document_id, r, ordinal, ordinal AS unit, token_count AS tokens, page_start AS low, page_end AS high, heading_path AS hp, kind IN ('paragraph', 'list_item') AND token_count < 64 AS open FROM m_ WHERE r = 1
  UNION ALL
  SELECT n.document_id, n.r, n.ordinal, CASE WHEN j THEN f.unit ELSE n.ordinal END, CASE WHEN j THEN f.tokens + n.token_count ELSE n.token_count END, CASE WHEN j THEN least(f.low, n.page_start) ELSE n.page_start END, CASE WHEN j THEN greatest(f.high, n.page_end) ELSE n.page_end END, n.heading_path, n.kind IN ('paragraph', 'list_item') AND n.token_count < 64
  FROM f JOIN m_ n ON n.document_id = f.document_id AND n.r = f.r + 1,
  LATERAL (SELECT f.open AND n.kind IN ('paragraph', 'list_item') AND n.token_count < 64 AND f.hp = n.heading_path AND f.tokens < 128 AND f.tokens + n.token_count <= 256 AND greatest(f.high, n.page_end) - least(f.low, n.page_start) <= 1 AS j))"""


@query(f"""WITH RECURSIVE {CATALOG}, {MERGED}
SELECT f.document_id, f.unit, count(*) AS n_nodes, string_agg(m_.text, chr(10) ORDER BY f.ordinal) AS text, sum(m_.token_count)::BIGINT AS token_count, min(m_.page_start) AS page_start, max(m_.page_end) AS page_end, array_to_string(any_value(m_.heading_path), ' > ') AS heading_path,
  string_agg(f.ordinal::VARCHAR, ',' ORDER BY f.ordinal) AS members FROM f JOIN m_ ON m_.document_id = f.document_id AND m_.ordinal = f.ordinal GROUP BY 1, 2""")
def register_units(spark, sf_dir):
    """Small neighbours under the same headings, at most a page apart, joined by a fold; with the nodes that each unit holds."""
    return C.merged_units(_with_paths(spark, sf_dir)).withColumns({"heading_path": F.concat_ws(" > ", "heading_path"), "members": F.concat_ws(",", F.col("members").cast("array<string>"))})


@query(f"""WITH RECURSIVE {CATALOG}, {MERGED}, u AS (SELECT document_id, unit, min(ordinal) AS first, max(ordinal) AS last FROM f GROUP BY 1, 2 HAVING count(*) > 1),
e AS (SELECT document_id, unit, first AS edge, -1 AS way FROM u UNION ALL SELECT document_id, unit, last, 1 FROM u)
SELECT e.document_id, e.unit, b.ordinal AS neighbour, b.kind, CASE b.kind WHEN 'paragraph' THEN 0.85 ELSE 0.9 END::DOUBLE AS penalty FROM e JOIN nodes a ON a.document_id = e.document_id AND a.ordinal = e.edge JOIN nodes b ON b.document_id = a.document_id AND b.parent IS NOT DISTINCT FROM a.parent AND b.place = a.place + e.way AND b.kind = a.kind
JOIN paths p ON p.document_id = a.document_id AND p.ordinal = a.ordinal JOIN paths q ON q.document_id = b.document_id AND q.ordinal = b.ordinal WHERE a.kind IN ('paragraph', 'list_item') AND (a.kind = 'list_item' OR p.heading_path = q.heading_path)""")
def unit_neighbors(spark, sf_dir):
    """Neighbours of merged units: outward of their first and last nodes only."""
    n = _with_paths(spark, sf_dir)
    return S.outward(C.merged_units(n), n)


# enrichment

CSENT = f"""{CATALOG}, told AS (SELECT * FROM nodes WHERE content_layer = 'body' AND trim(text) <> '' AND kind IN {X.SUMMARY_KINDS}),
lines_ AS (SELECT document_id, ordinal, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS l FROM told),
split_ AS (SELECT document_id, ordinal, l, list_filter(list_transform(string_split(regexp_replace(trim(line), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS p FROM lines_),
each_ AS (SELECT document_id, ordinal, l, generate_subscripts(p, 1) AS i, unnest(p) AS sentence FROM split_),
sentences AS (SELECT document_id, ordinal, row_number() OVER (PARTITION BY document_id, ordinal ORDER BY l, i) - 1 AS sentence_no, sentence FROM each_)"""
CFACTS = f"{CSENT}, marked AS" + facts.FACTS.split(", marked AS")[1]
QUANTITIES = f"""q AS (SELECT document_id, ordinal, sentence_no, unnest(regexp_extract_all(sentence, '{QUANTITY}', 1)) AS c, unnest(regexp_extract_all(sentence, '{QUANTITY}', 2)) AS v, unnest(regexp_extract_all(sentence, '{QUANTITY}', 3)) AS s, unnest(regexp_extract_all(sentence, '{QUANTITY}', 4)) AS u FROM facts WHERE place <= 2000),
qn AS (SELECT *, CASE c WHEN '$' THEN 'USD' WHEN '£' THEN 'GBP' WHEN '€' THEN 'EUR' WHEN '¥' THEN 'JPY' ELSE u END AS unit FROM q WHERE c <> '' OR u <> ''),
quants AS (SELECT DISTINCT document_id, ordinal, sentence_no, replace(v, ',', '') AS value, CASE lower(unit) WHEN 'percent' THEN '%' WHEN 'hour' THEN 'hours' WHEN 'day' THEN 'days' ELSE CASE WHEN len(unit) = 3 THEN upper(unit) ELSE unit END END AS unit, lower(s) AS scale FROM qn)"""
_A = E.ALIAS.replace("'", "''")
REFS = f"""refs AS (SELECT DISTINCT document_id, ordinal, lower(k_) AS kind, upper(k_[1]) || lower(k_[2:]) || ' ' || l_ AS reference FROM (SELECT document_id, ordinal, unnest(regexp_extract_all(text, '{E.REFERENCE}', 1)) AS k_, unnest(regexp_extract_all(text, '{E.REFERENCE}', 2)) AS l_ FROM nodes WHERE content_layer = 'body' AND trim(text) <> ''))"""
ENTITIES = f"""ents AS (SELECT document_id, ordinal, trim(n_) AS name, a_ AS alias FROM (SELECT document_id, ordinal, unnest(regexp_extract_all(text, '{_A}', 1)) AS n_, unnest(regexp_extract_all(text, '{_A}', 2)) AS a_, generate_subscripts(regexp_extract_all(text, '{_A}', 1), 1) AS at_ FROM told)
  QUALIFY row_number() OVER (PARTITION BY document_id, {FOLD.format('trim(n_)')}, {FOLD.format('a_')} ORDER BY ordinal, at_) = 1)"""
DEFS = f"""defs AS (SELECT document_id, ordinal, sentence_no, trim(regexp_extract(sentence, '{X.DEFINITION_PARTS}', 1)) AS subject, trim(regexp_extract(sentence, '{X.DEFINITION_PARTS}', 2)) AS object FROM facts WHERE defines AND place <= 2000 AND regexp_matches(sentence, '{X.DEFINITION_PARTS}'))"""
SUMMARIES = f"""sums AS (SELECT document_id, heading_path, min(ordinal) AS ordinal, string_agg(sentence, ' ' ORDER BY n) AS summary FROM (
  SELECT s.*, p.heading_path, row_number() OVER (PARTITION BY s.document_id, p.heading_path ORDER BY s.ordinal, s.sentence_no) AS n FROM sentences s JOIN paths p ON p.document_id = s.document_id AND p.ordinal = s.ordinal) WHERE n <= 2 GROUP BY 1, 2)"""
TROWS = """trows AS (SELECT document_id, ordinal, i AS row_index, 'Row ' || i || ': ' || array_to_string(list_transform(v, lambda c: CASE c WHEN '' THEN '[blank]' ELSE c END), ' | ') AS text, headers, v FROM (
  SELECT document_id, ordinal, headers, unnest(rows) AS v, generate_subscripts(rows, 1) AS i FROM tables) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ordinal, i) <= 2000)"""
FEATURES = f"""{CFACTS}, {QUANTITIES}, {REFS}, {ENTITIES}, {DEFS}, {SUMMARIES}, {TROWS},
feats AS (SELECT document_id, ordinal, 'outline' AS kind, trim(text) AS text, 0.45::DOUBLE AS importance FROM nodes WHERE content_layer = 'body' AND kind IN ('title', 'heading')
  UNION ALL SELECT document_id, ordinal, 'section_summary', summary, 0.65 FROM sums
  UNION ALL SELECT document_id, ordinal, CASE WHEN defines THEN 'definition' ELSE 'key_fact' END, sentence, CASE WHEN defines OR binds THEN 0.9 ELSE 0.78 END FROM facts WHERE place <= 2000
  UNION ALL SELECT document_id, ordinal, 'quantity', concat_ws(' ', value, nullif(scale, ''), unit), 0.82 FROM (SELECT DISTINCT document_id, ordinal, value, unit, scale FROM quants)
  UNION ALL SELECT document_id, ordinal, 'relationship', subject || ' defined as ' || object || '.', 0.88 FROM defs
  UNION ALL SELECT document_id, ordinal, 'relationship', 'Source passage references ' || reference || '.', 0.76 FROM refs
  UNION ALL SELECT document_id, ordinal, 'entity', name || ' (' || alias || ')', 0.84 FROM ents
  UNION ALL SELECT document_id, ordinal, 'relationship', alias || ' is an alias of ' || name || '.', 0.82 FROM ents
  UNION ALL SELECT document_id, ordinal, 'table_schema', coalesce(caption, 'Uncaptioned table') || '. Columns: ' || array_to_string(headers, ', ') || '. Rows: ' || len(rows) || '.', 0.92 FROM tables
  UNION ALL SELECT document_id, ordinal, 'relationship', coalesce(caption, 'Table') || ' has columns: ' || array_to_string(headers, ', ') || '.', 0.86 FROM tables
  UNION ALL SELECT document_id, ordinal, 'table_row', text, 0.88 FROM trows)"""
IDENTIFIED = f"""{FEATURES}, feat AS (SELECT f.*, coalesce(n.page_start, 0) AS page, 'feature_' || sha256(concat_ws(chr(0), 'quern.feature.v1', f.document_id, f.kind, n.node_id, f.text)) AS feature_id FROM feats f JOIN nodes n ON n.document_id = f.document_id AND n.ordinal = f.ordinal)"""


@query(f"WITH {CFACTS}, {QUANTITIES} SELECT * FROM quants")
def quantities(spark, sf_dir):
    """Quantities in the key facts of registers."""
    return E.quantities(E.key_facts(X.sentences(X.summarised(nodes(spark, sf_dir)))))


@query(f"WITH {CATALOG}, {REFS} SELECT * FROM refs")
def references(spark, sf_dir):
    """Explicit references of registers."""
    return E.references(X.body(nodes(spark, sf_dir)))


@query(f"WITH {CSENT}, {ENTITIES} SELECT * FROM ents")
def aliases(spark, sf_dir):
    """Names and their short forms, at the first node that gives them."""
    return X.entities(nodes(spark, sf_dir))


@query(f"WITH {CATALOG} SELECT DISTINCT document_id, ordinal, unnest(regexp_extract_all(text, '{E.DATE}')) AS mention FROM nodes WHERE content_layer = 'body'")
def date_mentions(spark, sf_dir):
    """Years and months that registers mention."""
    return E.dates(X.body(nodes(spark, sf_dir)))


@query(f"WITH {CFACTS}, {DEFS} SELECT document_id, ordinal, sentence_no, subject, object FROM defs")
def definition_parts(spark, sf_dir):
    """What is defined, and as what."""
    return X.definitions(E.key_facts(X.sentences(X.summarised(nodes(spark, sf_dir)))))


@query(f"WITH {CFACTS} SELECT document_id, ordinal, sentence_no, defines, counts, binds, excepts, regexp_matches(sentence, '{E.DATE}') AS dated FROM facts WHERE place <= 2000")
def fact_flags(spark, sf_dir):
    """What marks the key facts of registers."""
    f = E.key_facts(X.sentences(X.summarised(nodes(spark, sf_dir))))
    return f.select("document_id", "ordinal", "sentence_no", "defines", "counts", "binds", "excepts", F.col("sentence").rlike(E.DATE).alias("dated"))


@query(f"WITH {CSENT}, {SUMMARIES} SELECT document_id, array_to_string(heading_path, ' > ') AS heading_path, ordinal, summary FROM sums")
def section_summaries(spark, sf_dir):
    """The first two sentences under each heading path."""
    n = nodes(spark, sf_dir)
    return X.section_summaries(n, graph.heading_paths(n)).withColumn("heading_path", F.concat_ws(" > ", "heading_path"))


@query(f"WITH {CATALOG}, {TROWS} SELECT document_id, ordinal, row_index, text, v[list_position(headers, 'Balance')] AS balance FROM trows")
def table_rows(spark, sf_dir):
    """Rows of registers' tables as text, and one of their values by its label."""
    r = X.table_rows(tables(spark, sf_dir))
    return r.select("document_id", "ordinal", "row_index", "text", F.col("by_label")["Balance"].alias("balance"))


@memo
def features(spark, sf_dir) -> DataFrame:
    n = stored(nodes(spark, sf_dir), "register")
    return stored(X.identified(X.enriched(n, graph.heading_paths(n), tables(spark, sf_dir, n))), "features")


@query(f"WITH {IDENTIFIED} SELECT document_id, ordinal, kind, text, importance, page, feature_id FROM feat")
def enrich_document(spark, sf_dir):
    """Features of all nine kinds of every register."""
    return features(spark, sf_dir).drop("node_id")


@query(f"WITH {IDENTIFIED} SELECT document_id, place, feature_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY importance DESC, page, feature_id) AS place FROM feat) WHERE place <= 128")
def inline_features(spark, sf_dir):
    """The 128 most important features of each register."""
    return X.inline(features(spark, sf_dir)).select("document_id", "place", "feature_id")


@query(f"WITH {IDENTIFIED} SELECT f.kind, count(*) AS n, count(DISTINCT f.document_id) AS n_documents FROM feat f JOIN nodes n ON n.document_id = f.document_id AND n.ordinal = f.ordinal AND n.page_start <= 3 GROUP BY 1")
def authorised_counts(spark, sf_dir):
    """How many features of each kind have their source on the first three pages."""
    allowed = nodes(spark, sf_dir).where("page_start <= 3")
    return X.authorised(features(spark, sf_dir), allowed).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("n_documents"))


@query()
def feature_select(spark, sf_dir):
    """A compact choice of features for a question on each section of a register."""
    terms = lambda c: X.feature_terms(F.col(c)).alias("terms")
    asked = sections(spark, sf_dir).select("query_id", "document_id", terms("query"))
    # a feature's terms are taken before it meets the questions
    f = features(spark, sf_dir).select("document_id", "feature_id", terms("text").alias("own"), F.col("importance").alias("weight"), F.expr("size(split(trim(text), '\\\\s+'))").alias("token_count"), "page")
    both = asked.join(f, "document_id")
    found = both.select("query_id", "feature_id", F.array_sort(F.array_intersect("terms", "own")).alias("matched"), "weight", "token_count", "page")
    return X.select(found)


def sections(spark, sf_dir) -> DataFrame:
    """A question on each section: (query_id, document_id, k, query)."""
    s = customers(spark, sf_dir).select("document_id", "n_name", "k", "seg").distinct()
    number = F.expr("CAST(split(document_id, '/')[2] AS BIGINT) * 1000 + CAST(split(document_id, '/')[1] AS BIGINT) * 10 + k")
    return s.select(number.alias("query_id"), "document_id", "k", F.expr(QUESTION).alias("query"))


QUESTION = f"'Which ' || {_SEG} || ' buyers owe money since March 1996, and what is the blank Balance of Contact rows in Table A.' || k || ' and Table B.' || k || '?'"
SECTIONS = f"asked AS (SELECT DISTINCT string_split(document_id, '/')[3]::BIGINT * 1000 + string_split(document_id, '/')[2]::BIGINT * 10 + k AS query_id, document_id, k, {QUESTION} AS query FROM cust)"


# the whole of a register as one page, or one object

_TAG = "CASE WHEN n.kind = 'title' THEN 'h1' WHEN n.kind = 'heading' THEN 'h' || least(6, 1 + len(p.heading_path)) WHEN n.kind = 'list_item' THEN 'li' WHEN n.kind = 'caption' THEN 'figcaption' WHEN n.kind IN ('code', 'table') THEN 'pre' ELSE 'p' END"


@query(f"""WITH {CATALOG}, b AS (SELECT n.document_id, n.ordinal, n.kind, {_TAG} AS tag, {HTML.format('n.text')} AS body, n.node_id FROM nodes n JOIN paths p ON p.document_id = n.document_id AND p.ordinal = n.ordinal WHERE n.content_layer = 'body' AND n.kind <> 'list'),
o AS (SELECT document_id, '<nav>' || string_agg('<a href="#' || node_id || '">' || body || '</a>', '' ORDER BY ordinal) || '</nav>' AS nav FROM b WHERE kind IN ('title', 'heading') GROUP BY 1)
SELECT b.document_id, sha256(any_value(nav) || chr(10) || string_agg('<' || tag || ' id="' || node_id || '">' || body || '</' || tag || '>', chr(10) ORDER BY ordinal)) AS html_sha256, count(*) AS n_nodes FROM b JOIN o USING (document_id) GROUP BY 1""")
def semantic_html(spark, sf_dir):
    """Registers as HTML with an outline for navigation and headings by depth (its digest)."""
    return S.semantic_html(_with_paths(spark, sf_dir)).select("document_id", F.sha2("html", 256).alias("html_sha256"), "n_nodes")
