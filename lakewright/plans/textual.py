"""Queries for catalog, functions, documents, retrieval, checks and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import sqlite, text as X
from ..operators import chunking as C, history as H, retrieval as R, rules as U, verification as V
from ..operators.vectors import VectorIndex
from ..sources import pages as page_source, sinks, tables as T
from . import catalog, execute
from .guard import RULES, Guard, in_scope
from .registry import query
from .relational import WITH

NAMES = ("africa", "america", "asia", "europe", "middle east", "automobile", "building", "furniture", "household", "machinery")


def _load(s: SparkSession, d: str, name: str) -> DataFrame:
    return T.load(s, d, name)


# ------------------------------------------------------------------- catalog


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in sorted(T.TABLES)))
def catalog_row_counts(s, d):
    return catalog.row_counts({t: _load(s, d, t) for t in T.TABLES})


@query(
    WITH
    + ", v AS (SELECT DISTINCT 'region' AS label, region AS value FROM accounts UNION SELECT DISTINCT 'segment', segment FROM accounts UNION SELECT DISTINCT 'stage', stage FROM opportunities UNION SELECT DISTINCT 'activity_type', event_type FROM events UNION SELECT DISTINCT 'product_code', p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT label, value FROM v WHERE label IN (SELECT label FROM v GROUP BY label HAVING count(*) <= 30)"
)
def catalog_enums(s, d):
    return catalog.domains({name: make(s, d) for name, make in T.VIEWS.items()})


@query(
    WITH
    + "SELECT 'stage' AS label, stage AS value, row_number() OVER (ORDER BY coalesce(list_position(['Prospecting', 'Discovery', 'Evaluation', 'Proposal', 'Negotiation', 'Closed Won', 'Closed Lost'], stage), 99), stage)::INTEGER AS place FROM (SELECT DISTINCT stage FROM opportunities) x"
)
def catalog_enum_order(s, d):
    stages = T.opportunities(s, d).select(F.lit("stage").alias("label"), F.col("stage").alias("value")).distinct()
    return catalog.ordered(stages, {"stage": list(T.STAGES)})


_TEXTS = {"region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"], "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"]}


@query("WITH v AS (" + " UNION ".join(f"SELECT '{'events.event_type' if c == 'event_type' else c}' AS label, {c} AS value FROM {t} WHERE {c} IS NOT NULL" for t, columns in _TEXTS.items() for c in columns) + ") SELECT label, value FROM v WHERE label IN (SELECT label FROM v GROUP BY label HAVING count(*) <= 30)")
def catalog_text_domains(s, d):
    """The values of every text column of all tables that has few of them, in one pass."""
    return catalog.text_domains({t: _load(s, d, t) for t in T.TABLES}, qualified=("event_type",))


@query("SELECT row_number() OVER (ORDER BY list_position(['orders', 'customer', 'lineitem'], table_name) NULLS LAST, table_name)::INTEGER AS place, table_name, n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in sorted(T.TABLES)) + ") x")
def catalog_table_order(s, d):
    return catalog.table_order({t: _load(s, d, t) for t in T.TABLES}, ("orders", "customer", "lineitem"))


@query(
    " UNION ALL ".join(f"SELECT '{t}.{c}' AS key, count(*) AS n FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {rc} FROM {r})" for (t, c), (r, rc) in T.FOREIGN_KEYS.items())
)
def catalog_orphans(s, d):
    return catalog.orphans({t: _load(s, d, t) for t in T.TABLES})


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, unnest([{', '.join(repr(c) for c in columns)}]) AS column_name, unnest([{', '.join(f'count({c})' for c in columns)}]) AS filled FROM {t}" for t, columns in sorted(T.COLUMNS.items())))
def catalog_columns(s, d):
    return catalog.fill_counts({t: _load(s, d, t) for t in T.TABLES}).drop("type")


@query(
    "WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(html), '\\b[a-z_]+\\.[a-z_0-9]+\\b')) AS name FROM pages), x AS (SELECT string_split(name, '.')[1] AS table_name, string_split(name, '.')[2] AS column_name FROM n) SELECT table_name, column_name FROM x WHERE table_name = 'p' AND column_name <> 'html'"
)
def catalog_drift(s, d):
    """Names such as p.x in raw pages, where a table p is known to have no such
    column."""
    return catalog.drift(_load(s, d, "pages"), {"p": ["html"]}, "html")


# ------------------------------------------------------ guarded SQL, scope, cap


def _guard(s: SparkSession, d: str, scope: dict | None = None) -> Guard:
    """A guard over the views of one user, in a session of their own: views of
    another user's scope have the same names."""
    own = s.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, s.conf.get(key))
    T.register_views(own, d, scope)
    return Guard(own, {name: own.table(name).columns for name in T.VIEWS})


REPORT = "SELECT o.region, a.segment, count(*) AS deals, round(sum(CASE WHEN o.stage = 'Closed Won' THEN o.amount_usd ELSE 0 END), 2) AS bookings FROM opportunities o JOIN accounts a ON o.account_id = a.account_id WHERE o.close_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY o.region, a.segment"


@query(WITH + REPORT)
def guarded_report(s, d):
    """A text that passes the guard, run over the views."""
    return _guard(s, d).query(REPORT)


@query(WITH + "SELECT region, segment, count(*) AS deals FROM opportunities WHERE region IN ('EUROPE', 'ASIA') AND segment = 'BUILDING' GROUP BY region, segment")
def scoped_rows(s, d):
    """The same text for a restricted user: scope holds by the views."""
    guard = _guard(s, d, {"region": ["EUROPE", "ASIA"], "segment": ["BUILDING"]})
    return guard.query("SELECT region, segment, count(*) AS deals FROM opportunities GROUP BY region, segment")


AGGREGATES = "SELECT region, total(amount_usd) AS amount, length(group_concat(stage)) AS stages, max(max(opportunity_id), 10) AS last_id, total(amount_usd) FILTER (WHERE stage LIKE 'closed%') AS closed FROM opportunities GROUP BY region"


@query(
    WITH
    + "SELECT region, round(sum(amount_usd), 2) AS amount, length(string_agg(stage, ','))::INTEGER AS stages, greatest(max(opportunity_id), 10) AS last_id, round(sum(amount_usd) FILTER (stage LIKE 'Closed%'), 2) AS closed FROM opportunities GROUP BY region"
)
def guard_aggregates(s, d):
    """SQLite's own aggregates and its LIKE, through the guard."""
    found = _guard(s, d).query(AGGREGATES)
    return found.withColumns({"amount": F.round("amount", 2), "closed": F.round("closed", 2)})


@query(
    WITH
    + "SELECT account_id, substr(account_name, 1, 4) AS head, TRY_CAST(regexp_extract(account_name, '[0-9]+$') AS BIGINT) * 0 AS none, CAST(trunc(annual_revenue_usd) AS BIGINT) AS whole, greatest(account_id, 5) AS five, CAST(account_id AS VARCHAR) AS t FROM accounts WHERE segment IN ('BUILDING', 'FURNITURE')"
)
def guard_scalars(s, d):
    """Lenient casts, substr from place 0 and max of two values."""
    return _guard(s, d).query("SELECT account_id, substr(account_name, 0, 5) AS head, CAST(account_name AS INTEGER) AS none, CAST(annual_revenue_usd AS INTEGER) AS whole, max(account_id, 5) AS five, CAST(account_id AS TEXT) AS t FROM accounts WHERE segment LIKE 'BUILDING' OR segment LIKE 'furniture'", limit=None)


@query(
    WITH
    + "SELECT opportunity_id, strftime(date_trunc('month', created_date), '%Y-%m-%d') AS month, strftime(created_date - INTERVAL 7 DAY, '%Y-%m-%d') AS week, strftime(date_trunc('year', created_date) - INTERVAL 1 DAY, '%Y-%m-%d') AS year, strftime(created_date, '%Y/%m') AS ym FROM opportunities WHERE stage LIKE 'Closed%'"
)
def guard_dates(s, d):
    """Dates with modifiers, through the guard."""
    return _guard(s, d).query("SELECT opportunity_id, date(created_date, 'start of month') AS month, date(created_date, '-7 days') AS week, date(created_date, 'start of year', '-1 day') AS year, strftime('%Y/%m', created_date) AS ym FROM opportunities WHERE stage LIKE 'closed%'", limit=None)


@query(
    WITH
    + "SELECT opportunity_id, opportunity_id // 7 AS whole, opportunity_id % 7 AS rest, amount_usd / 7 AS share, (trunc(amount_usd)::BIGINT % 7)::DOUBLE AS left_over, CASE WHEN opportunity_id % 3 <> 0 THEN opportunity_id // (opportunity_id % 3) ELSE -1 END AS maybe, opportunity_id // 4 * 0.5 AS nested, NULL::DOUBLE AS nothing FROM opportunities WHERE opportunity_id // 2 % 2 = 0"
)
def guard_arithmetic(s, d):
    """Whole and real division and remainders, by zero too."""
    return _guard(s, d).query("SELECT opportunity_id, opportunity_id / 7 AS whole, opportunity_id % 7 AS rest, amount_usd / 7 AS share, amount_usd % 7 AS left_over, coalesce(opportunity_id / (opportunity_id % 3), -1) AS maybe, opportunity_id / 4 * 0.5 AS nested, amount_usd / 0 AS nothing FROM opportunities WHERE opportunity_id / 2 % 2 = 0", limit=None)


@query(
    WITH
    + "SELECT opportunity_id, coalesce(strftime(close_date, '%Y-%m-%d'), 'open') AS closed, CASE WHEN probability > 0.5 THEN CAST(opportunity_id AS VARCHAR) ELSE 'unlikely' END AS likely, account_id = 16 AS sixteen, false AS never, true AS always, strftime(close_date, '%Y-%m-%d') > '1996-1' AS late FROM opportunities WHERE account_id > 15 AND (close_date IS NULL OR strftime(close_date, '%Y-%m-%d') >= '1994') AND stage <> '5'"
)
def guard_mixed(s, d):
    """Operands of different types, by SQLite's affinity."""
    text = "SELECT opportunity_id, coalesce(close_date, 'open') AS closed, CASE WHEN probability > 0.5 THEN opportunity_id ELSE 'unlikely' END AS likely, account_id = '16' AS sixteen, account_id = 'sixteen' AS never, account_id < 'sixteen' AS always, close_date > '1996-1' AS late FROM opportunities WHERE account_id > '15' AND (close_date IS NULL OR close_date BETWEEN '1994' AND 'x') AND stage <> 5"
    return _guard(s, d).query(text, limit=None)


@query(
    WITH
    + "SELECT a.account_name AS named, o.stage AS stage, trim(a.account_name, 'Customer#0') AS bare, o.region FROM opportunities o JOIN accounts a ON o.account_id = a.account_id ORDER BY o.opportunity_id LIMIT 150 OFFSET 7"
)
def guard_names(s, d):
    """Names in double quotes, trim of given characters, LIMIT with an offset before it, a comment."""
    return _guard(s, d).query("""SELECT a."account_name" AS named, o."stage", trim(a.account_name, 'Customer#0') AS bare, o."region" FROM (SELECT * FROM opportunities) o JOIN accounts a ON o.account_id = a.account_id /* by "id" */ ORDER BY o."opportunity_id" LIMIT 7, 150""")


@query(
    WITH
    + "SELECT opportunity_id, strftime(created_date + CAST((7 - dayofweek(created_date)) % 7 AS INTEGER), '%Y-%m-%d') AS sunday, strftime(created_date, '%j|%w|%W') AS week, strftime(created_date::TIMESTAMP + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS later, '06:30:00' AS clock, epoch(created_date::TIMESTAMP) / 86400.0 + 2440588.25 AS jd FROM opportunities"
)
def guard_calendar(s, d):
    """Weekdays, weeks, fractions of days, and time of day."""
    return _guard(s, d).query("SELECT opportunity_id, date(created_date, 'weekday 0') AS sunday, strftime('%j|%w|%W', created_date) AS week, datetime(created_date, '+1.5 days') AS later, time(created_date, '+06:30') AS clock, julianday(datetime(created_date, '+18 hours')) AS jd FROM opportunities", limit=None)


@query(
    WITH
    + "SELECT region, segment, reason = '' AS ok, reason FROM (SELECT DISTINCT region, segment, CASE WHEN region NOT IN ('ASIA', 'EUROPE') THEN 'region is outside what the user may see: ' || region WHEN segment <> 'BUILDING' THEN 'segment is outside what the user may see: ' || segment ELSE '' END AS reason FROM accounts) x"
)
def guard_verdicts(s, d):
    """What the guard says of one text for each pair of a region and a segment,
    asked by a user who may see some of them. Pairs of two short lists of names."""
    guard = _guard(s, d)
    guard.rules = [*RULES, in_scope({"region": {"ASIA", "EUROPE"}, "segment": {"BUILDING"}})]
    pairs = guard.spark.table("accounts").select("region", "segment").distinct().collect()
    rows = []
    for region, segment in pairs:
        verdict = guard.check(f"SELECT count(*) FROM opportunities o WHERE o.region = '{region}' AND o.segment IN ('{segment}')")
        rows.append((region, segment, verdict.ok, verdict.reason))
    return s.createDataFrame(rows, "region string, segment string, ok boolean, reason string")


@query(WITH + "SELECT * FROM (SELECT opportunity_id, 'capped' AS kind FROM opportunities ORDER BY opportunity_id LIMIT 200) x UNION ALL SELECT * FROM (SELECT opportunity_id, 'own limit' FROM opportunities ORDER BY opportunity_id LIMIT 500) y")
def guard_limits(s, d):
    """A text without a limit gets one of 200 rows; one that limits itself keeps its own."""
    guard, text = _guard(s, d), "SELECT opportunity_id, '{}' AS kind FROM opportunities ORDER BY opportunity_id"
    return guard.query(text.format("capped")).union(guard.query(text.format("own limit") + " LIMIT 500"))


#: A text for a region, and a part of the reason why it is refused ('': it isn't).
JUDGED = (
    ("", "the query is empty"),
    ("SELECT '{0}'; DROP TABLE accounts", "one statement"),
    ("DELETE FROM accounts WHERE region = '{0}'", "only queries are allowed"),
    ("INSERT INTO accounts SELECT * FROM accounts WHERE region = '{0}'", "only queries are allowed"),
    ("SELECT reverse(region) FROM accounts WHERE region = '{0}'", "function not allowed: reverse"),
    ("SELECT first_value(region) OVER (ORDER BY account_id) FROM accounts WHERE region = '{0}'", "function not allowed: first_value"),
    ("SELECT a.stage FROM accounts a WHERE a.region = '{0}'", "no column stage in accounts; it is in opportunities"),
    ("SELECT z.region FROM accounts a WHERE a.region = '{0}'", "unknown table or alias: z"),
    ("SELECT region FROM customers WHERE region = '{0}'", "unknown table: customers"),
    ("SELECT region FROM other.accounts WHERE region = '{0}'", "named without a qualifier"),
    ("SELECT region FROM main_accounts WHERE region = '{0}'", "unknown table: main_accounts"),
    ("SELECT count(*) FROM accounts WHERE region = '{0}'", ""),
    ("WITH r AS (SELECT region FROM accounts WHERE region = '{0}') SELECT count(*) FROM r LIMIT 3", ""),
)


@query("SELECT r_name AS region, i AS text_no, part = '' AS ok, part AS reason FROM region, (VALUES " + ", ".join(f"({i}, '{part}')" for i, (_, part) in enumerate(JUDGED)) + ") t(i, part)")
def guard_rejections(s, d):
    """Verdicts on one text of each kind for each region; of a reason, the part that is expected."""
    guard = _guard(s, d)
    rows = []
    for (region,) in _load(s, d, "region").select("r_name").collect():  # a handful of names
        for i, (text, part) in enumerate(JUDGED):
            verdict = guard.check(text.format(region))
            rows.append((region, i, verdict.ok, part if part in verdict.reason else verdict.reason))
    return s.createDataFrame(rows, "region string, text_no int, ok boolean, reason string")


@query("SELECT item_id, trim(text) AS cleaned FROM benchmark")
def sql_cleanup(s, d):
    """Texts as a model writes them, in a fence, with a label and an end, and bare again."""
    fence = F.concat(F.lit("```sql\nSQL: "), F.trim("text"), F.lit(" ;\n```\n"))
    return _load(s, d, "benchmark").select("item_id", execute.clean_sql(fence).alias("cleaned"))


@query("SELECT event_id, CASE WHEN event_type NOT IN ('click', 'unknown') THEN event_type END AS kind, NULL::VARCHAR AS region, 'v' || floor(value)::INTEGER AS value FROM events")
def slots_normalised(s, d):
    """Proposals with slots that say nothing, made of events."""
    kind = F.when(F.col("event_type") == "click", " None ").otherwise(F.col("event_type"))
    slots = F.create_map(F.lit("kind"), kind, F.lit("region"), F.lit("N/A"), F.lit("value"), F.concat(F.lit("v"), F.floor("value").cast("int").cast("string")))
    left = U.normalised_slots(slots)
    return _load(s, d, "events").select("event_id", *(F.try_element_at(left, F.lit(k)).alias(k) for k in ("kind", "region", "value")))


@query("SELECT o_orderkey, true AS truncated FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200) x")
def row_cap_flag(s, d):
    return execute.capped(_load(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey"))


@query("SELECT value FROM (SELECT unnest([n_nationkey::VARCHAR, n_regionkey::VARCHAR]) AS value FROM nation) x")
def flat_cells(s, d):
    """All cells after a denied column is dropped."""
    return execute.flat_values(execute.shown(_load(s, d, "nation"), ("N_NAME",)))


@query("SELECT event_type, count(*) AS n, (count(*) > 20 OR " + " OR ".join("contains(event_type, '{}')".format(m.replace("'", "''")) for m in execute.NARRATION_MARKERS) + ") AS narrate FROM events GROUP BY event_type")
def narration_policy(s, d):
    per = _load(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return per.withColumn("narrate", execute.needs_narration(F.col("n"), F.col("event_type")))


# ----------------------------------------------------------- scalar functions


@query("SELECT p_partkey, lower(p_name) AS lo, upper(p_brand) AS up, length(p_name)::INTEGER AS len, replace(p_name, ' ', '_') AS under, substr(p_type, 1, 3) AS pre, trim('  ' || p_type || ' ') AS bare FROM part")
def fn_strings(s, d):
    return _load(s, d, "part").select(
        "p_partkey", F.lower("p_name").alias("lo"), F.upper("p_brand").alias("up"), F.length("p_name").alias("len"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("under"), F.substring("p_type", 1, 3).alias("pre"), F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("bare")
    )


@query("SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, coalesce(nullif(c_nationkey, 3), -1) AS n, CAST(c_custkey AS VARCHAR) AS t, TRY_CAST(c_mktsegment AS INTEGER) AS bad, ifnull(nullif(c_mktsegment, 'BUILDING'), '-') AS seg FROM customer")
def fn_numeric_null(s, d):
    return _load(s, d, "customer").select(
        "c_custkey", F.abs("c_acctbal").alias("a"), F.round("c_acctbal", 1).alias("r"), F.coalesce(F.nullif("c_nationkey", F.lit(3)), F.lit(-1)).alias("n"), F.col("c_custkey").cast("string").alias("t"), F.col("c_mktsegment").try_cast("int").alias("bad"), F.ifnull(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("-")).alias("seg")
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS week FROM orders")
def fn_dates(s, d):
    sqlite.register(s)
    _load(s, d, "orders").createOrReplaceTempView("q_orders")
    return s.sql(
        "select o_orderkey, date_text(cast(o_orderdate as string)) as day, datetime(cast(o_orderdate as string)) as stamp,"
        " date_text(cast(trunc(o_orderdate, 'month') as string)) as month, date_text(cast(date_add(o_orderdate, 7) as string)) as week from q_orders"
    )


@query("SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS t, strftime(ts, '%j-%w') AS d FROM events")
def fn_strftime(s, d):
    sqlite.register(s)
    _load(s, d, "events").createOrReplaceTempView("q_events")
    return s.sql("select event_id, strftime('%Y/%m/%d %H:%M:%S', cast(ts as string)) as t, strftime('%j-%w', cast(ts as string)) as d from q_events")


@query("SELECT o_orderkey, round(epoch(o_orderdate) / 86400.0 + 2440587.5, 4) AS jd FROM orders")
def fn_julianday(s, d):
    sqlite.register(s)
    _load(s, d, "orders").createOrReplaceTempView("q_orders")
    return s.sql("select o_orderkey, round(julianday(cast(o_orderdate as string)), 4) as jd from q_orders")


# ------------------------------------------------------------------ documents

SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?;:])[\\t\\n\\x0B\\f\\r ]+', '\\1' || chr(10), 'g'), chr(10)), lambda p: trim(p, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')), lambda p: p <> '')"


@query(f"SELECT doc_id, len({SENTENCES})::INTEGER AS n, coalesce(list_max(list_transform({SENTENCES}, lambda p: length(p))), 0)::INTEGER AS longest FROM documents")
def sentences(s, d):
    cut = _load(s, d, "documents").select("doc_id", X.sentences(F.col("text")).alias("p"))
    return cut.select("doc_id", F.size("p").alias("n"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).alias("longest"))


#: Greedy packing, sentence by sentence, of ``text`` in the table {0}: rows (doc_id, i, chunk).
PACKED = """sn AS (SELECT doc_id, {sentences} AS s FROM {table}),
pk AS (SELECT doc_id, s, 0::BIGINT AS i, '' AS open, NULL::VARCHAR AS chunk FROM sn
 UNION ALL SELECT doc_id, s, i + 1, CASE WHEN whole THEN s[i + 1] ELSE joined END, CASE WHEN whole THEN open END FROM (
  SELECT *, open <> '' AND length(joined) // 4 > 300 AS whole FROM (SELECT *, CASE WHEN open = '' THEN s[i + 1] ELSE open || ' ' || s[i + 1] END AS joined FROM pk WHERE i < len(s)) a) b),
ch AS (SELECT doc_id, i, chunk FROM pk WHERE chunk IS NOT NULL UNION ALL SELECT doc_id, i + 1, open FROM pk WHERE i = len(s) AND open <> '')"""


@query(
    f"WITH RECURSIVE {PACKED.format(sentences=SENTENCES, table='documents')}, n AS (SELECT doc_id, row_number() OVER w - 1 AS chunk_no, chr(10) || chunk AS text, coalesce(sum(length(chunk) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)) SELECT doc_id, chunk_no::INTEGER AS chunk_no, substr(sha1(doc_id || '|1|' || \"offset\"), 1, 12) AS chunk_id, \"offset\", greatest(1, length(text) // 4)::INTEGER AS tokens FROM n"
)
def chunk_ids(s, d):
    """Greedy packing, and ids made of document, page and offset."""
    chunks = C.chunk_documents(_load(s, d, "documents"))
    return chunks.select("doc_id", "chunk_no", "chunk_id", "offset", C.estimate_tokens(F.col("text")).alias("tokens"))


BLOCKS = f"regexp_extract_all(html, '(?s)<({C.BLOCK_TAGS})(?:\\s[^>]*)?>(.*?)</(?:{C.BLOCK_TAGS})>', {{}})"
HTML_LINES = f"""l0 AS (SELECT page_id, unnest({BLOCKS.format(1)}) AS tag, unnest({BLOCKS.format(2)}) AS inside, unnest(range(len({BLOCKS.format(1)})))::INTEGER AS line_no FROM pages),
l AS (SELECT page_id, line_no, trim(regexp_replace(regexp_replace(inside, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text, CASE WHEN tag = 'h1' THEN 16.0 WHEN tag = 'h2' THEN 14.0 WHEN tag LIKE 'h_' THEN 12.0 WHEN tag IN ('p', 'div') THEN 9.0 ELSE 7.0 END AS size, CASE WHEN starts_with(inside, '<b>') THEN 1.0 ELSE 0.0 END AS bold FROM l0),
t AS (SELECT * FROM l WHERE text <> ''), z AS (SELECT page_id, size, sum(length(text)) AS c FROM t GROUP BY ALL),
b AS (SELECT page_id, arg_min(size, (-c, size)) AS body FROM z GROUP BY page_id),
h AS (SELECT t.*, b.body, (size >= body + 1.2 OR (bold >= 0.8 AND length(text) <= 60 AND text NOT LIKE '%.')) AS is_heading FROM t JOIN b USING (page_id))"""


def _typed_lines(s: SparkSession, d: str) -> DataFrame:
    lines = C.html_lines(_load(s, d, "pages"))
    return lines.join(C.body_size(lines, "page_id"), "page_id").withColumn("is_heading", C.is_heading())


@query()
def page_lines(s, d):
    """All lines of the pages, by the stack of open tags, under their sections.
    Broken nesting is beyond patterns; the tests state what is read."""
    lines = page_source.page_lines(_load(s, d, "pages"))
    typed = lines.join(C.body_size(lines, "page_id"), "page_id").withColumn("is_heading", C.is_heading())
    return C.sections(typed, "page_id")


@query(f"WITH {HTML_LINES} SELECT page_id, body::DOUBLE AS body, count(*) FILTER (is_heading) AS headings, count(*) AS lines FROM h GROUP BY page_id, body")
def headings(s, d):
    return _typed_lines(s, d).groupBy("page_id", "body").agg(F.count_if("is_heading").alias("headings"), F.count("*").alias("lines"))


@query(
    f"WITH {HTML_LINES}, s AS (SELECT *, coalesce(last_value(CASE WHEN is_heading THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS section FROM h) SELECT page_id, section, count(*) AS n_lines, sum(length(text))::BIGINT AS chars FROM s WHERE NOT is_heading GROUP BY page_id, section"
)
def section_chunks(s, d):
    return C.sections(_typed_lines(s, d), "page_id").groupBy("page_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("chars"))


LINES = "SELECT doc_id, source, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line_no, trim(unnest(string_split(text, chr(10))), chr(9) || chr(11) || chr(12) || chr(13) || ' ') AS line FROM documents"


@query(
    f"WITH l AS ({LINES}), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source), n AS (SELECT source, line, count(DISTINCT doc_id) AS n_docs FROM l WHERE line <> '' AND length(line) <= 60 GROUP BY source, line) SELECT source, line, n_docs FROM n JOIN p USING (source) WHERE n_docs >= greatest(2, ceil(pages * 0.05))"
)
def furniture_lines(s, d):
    return C.furniture(_load(s, d, "documents"), "source", "doc_id", 0.05)


@query(
    f"WITH l AS ({LINES}), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source), n AS (SELECT source, line, count(DISTINCT doc_id) AS n_docs FROM l WHERE line <> '' AND length(line) <= 60 GROUP BY source, line), f AS (SELECT source, line FROM n JOIN p USING (source) WHERE n_docs >= greatest(2, ceil(pages * 0.05))) SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM l WHERE line <> '' AND NOT (length(line) < 60 AND regexp_matches(line, '(?i)^(.*\\|?\\s*)?page\\s*\\d+$')) AND (source IS NULL OR NOT EXISTS (SELECT 1 FROM f WHERE f.source = l.source AND f.line = l.line)) GROUP BY doc_id"
)
def body_lines(s, d):
    """What is left of documents without furniture and page numbers."""
    kept = C.body_lines(_load(s, d, "documents"), "source", "doc_id", 0.05)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))


TABLE_ROWS = f"""l AS ({LINES}), b AS (SELECT doc_id, line_no, line, trim(string_split(line, '|')[1]) = '' AS blank FROM l WHERE line LIKE '%|%'),
k AS (SELECT *, bool_or(NOT blank) OVER (PARTITION BY doc_id) AS any_key FROM b), r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS row_no FROM k WHERE NOT blank OR NOT any_key)"""


@query(
    f"WITH {TABLE_ROWS}, g AS (SELECT doc_id, (row_no - 2) // 6 AS chunk_no, count(*) AS n_rows, string_agg(line, chr(10) ORDER BY row_no) AS body FROM r WHERE row_no > 1 GROUP BY 1, 2) SELECT doc_id, chunk_no::BIGINT AS chunk_no, n_rows, md5(r.line || chr(10) || body) AS digest FROM g JOIN (SELECT * FROM r WHERE row_no = 1) r USING (doc_id)"
)
def table_chunks(s, d):
    return C.table_chunks(C.table_rows(_load(s, d, "documents"))).select("doc_id", "chunk_no", "n_rows", F.md5("text").alias("digest"))


@query(
    """WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
 b AS (SELECT doc_id, no, string_split(line, '|') AS cells, no % 3 = 0 AS tall, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS nth FROM ln WHERE contains(line, '|')),
 k AS (SELECT b.*, NOT (no % 3 = 1 AND EXISTS (SELECT 1 FROM b c WHERE c.doc_id = b.doc_id AND c.no = b.no - 1)) AS kept FROM b),
 c AS (SELECT doc_id, no, nth, i, cells[i] AS cell, list_sum([0] || list_transform(cells[:i - 1], lambda x: length(x) + 1)) AS x0 FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM b) u),
 h AS (SELECT doc_id, i - 1 AS col, x0, x0 + length(cell) AS x1 FROM c WHERE nth = 1),
 sp AS (SELECT doc_id, no, x0 + length(cell) - length(ltrim(cell)) AS x, trim(cell) AS text FROM c WHERE trim(cell) <> ''),
 pl AS (SELECT sp.*, (SELECT arg_min(col, CASE WHEN x0 - 1 <= x AND x < x1 + 1 THEN col ELSE 1000000 + abs(x0 - x) * 1000 + col END) FROM h WHERE h.doc_id = sp.doc_id) AS col FROM sp),
 ce AS (SELECT k.doc_id, k.no, col, string_agg(text, ' ' ORDER BY pl.no, x, text) AS text FROM k JOIN pl ON pl.doc_id = k.doc_id AND (pl.no = k.no OR k.tall AND pl.no = k.no + 1) WHERE kept GROUP BY ALL)
 SELECT k.doc_id, k.no AS row_no, h.col::INTEGER AS col, coalesce(text, '') AS text FROM k JOIN h ON h.doc_id = k.doc_id LEFT JOIN ce ON ce.doc_id = k.doc_id AND ce.no = k.no AND ce.col = h.col WHERE kept"""
)
def table_grid(s, d):
    """Tables of bar lines read by the places of their texts: ten units a line,
    and every third line found as a row that holds the next one too."""
    bars = _load(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.contains("line", F.lit("|")))
    cut = bars.withColumn("cells", F.split("line", r"\|"))
    start = F.expr("transform(cells, (c, i) -> struct(i as col, aggregate(slice(cells, 1, i), 0, (n, x) -> n + length(x) + 1) as x0, c as cell))")
    cells = cut.select("doc_id", "no", F.explode(start).alias("c")).select("doc_id", "no", "c.*")
    first = bars.groupBy("doc_id").agg(F.min("no").alias("no"))
    header = cells.join(first, ["doc_id", "no"]).select(F.col("doc_id").alias("page"), "col", "x0", (F.col("x0") + F.length("cell")).alias("x1"))
    top = (F.col("no") * 10.0).alias("y0")
    spans = cells.select(F.col("doc_id").alias("page"), (F.col("x0") + F.length("cell") - F.length(F.ltrim("cell"))).alias("x"), top, (F.col("no") * 10.0 + 8).alias("y1"), F.col("cell").alias("text"))
    rows = bars.select(F.col("doc_id").alias("page"), F.col("no").cast("long").alias("row_no"), top, (F.col("no") * 10.0 + F.when(F.col("no") % 3 == 0, 18).otherwise(8)).alias("y1"))
    return C.table_grid(spans, rows, header).withColumnRenamed("page", "doc_id")


ORDER = ("src3", "src1", "src2")


@query(
    f"WITH RECURSIVE {TABLE_ROWS}, g AS (SELECT doc_id, (row_no - 2) // 6 AS chunk_no, string_agg(line, chr(10) ORDER BY row_no) AS body FROM r WHERE row_no > 1 GROUP BY 1, 2), tb AS (SELECT doc_id, chunk_no, r.line || chr(10) || body AS text FROM g JOIN (SELECT * FROM r WHERE row_no = 1) r USING (doc_id)), pl AS (SELECT doc_id, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT contains(x, '|')), chr(10)) AS text FROM documents), {PACKED.format(sentences=SENTENCES, table='pl')}, al AS (SELECT doc_id, 0 AS part, chunk_no::BIGINT AS i, text FROM tb UNION ALL SELECT doc_id, 1, i, chr(10) || chunk FROM ch), n AS (SELECT doc_id, part, text, row_number() OVER w - 1 AS chunk_no, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM al WINDOW w AS (PARTITION BY doc_id ORDER BY part, i)) SELECT coalesce(list_position({list(ORDER)}, source) - 1, {len(ORDER)})::INTEGER AS place, coalesce(source, '-') AS doc, n.doc_id AS page, chunk_no::INTEGER AS chunk_no, CASE part WHEN 0 THEN 'table' ELSE 'text' END AS kind, substr(sha1(coalesce(source, '-') || '|' || n.doc_id || '|' || \"offset\"), 1, 12) AS chunk_id, \"offset\", md5(n.text) AS digest FROM n JOIN documents USING (doc_id)"
)
def page_chunks(s, d):
    """Sources as documents and their documents as pages, tables first on each."""
    pages = _load(s, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return C.page_chunks(pages, ORDER).withColumn("digest", F.md5("text")).drop("text")


@query("SELECT doc_id FROM documents WHERE (contains(lower(text), 'licensed under') OR contains(lower(text), 'released under')) AND (contains(lower(text), 'version 2.0') OR contains(lower(text), 'mit license'))")
def conflict_docs(s, d):
    return C.conflicts(_load(s, d, "documents"), ("licensed under", "released under"), ("version 2.0", "mit license")).select("doc_id")


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9](?:[ -]?[0-9]){12,15}'))::INTEGER AS runs FROM documents WHERE regexp_matches(text, '[0-9](?:[ -]?[0-9]){12,15}')")
def pii_docs(s, d):
    """Documents with digit runs as long as card numbers."""
    pattern = "[0-9](?:[ -]?[0-9]){12,15}"
    return _load(s, d, "documents").where(F.col("text").rlike(pattern)).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("runs"))


NORMAL = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
LEAKS = f"""lw AS (SELECT DISTINCT item_id, substr(t, i::INTEGER, 60) AS piece FROM (SELECT item_id, t, unnest(range(1, greatest(length(t) - 59, 1) + 1, 30)) AS i FROM (SELECT item_id, {NORMAL} AS t FROM benchmark) x WHERE length(t) >= 60) y),
n AS (SELECT doc_id, {NORMAL} AS t FROM documents), leaks AS (SELECT DISTINCT doc_id, item_id FROM n JOIN lw ON contains(t, piece))"""


@query(f"WITH {LEAKS} SELECT * FROM leaks")
def contamination(s, d):
    return V.leaks(_load(s, d, "documents"), _load(s, d, "benchmark"))


WORDS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "], w))"


@query(
    f"WITH {LEAKS}, l AS (SELECT doc_id, item_id, line_no, line, len(list_intersect({WORDS.format('line')}, {WORDS.format('b.text')})) AS shared FROM leaks JOIN ({LINES}) d USING (doc_id) JOIN benchmark b USING (item_id) WHERE line <> '') SELECT doc_id, item_id, arg_min(substr(line, 1, 180), (-shared, line_no)) AS snippet, max(shared)::INTEGER AS shared FROM l GROUP BY doc_id, item_id"
)
def best_snippet(s, d):
    """The line of a leaking document that shares most words with the item."""
    docs, items = _load(s, d, "documents"), _load(s, d, "benchmark")
    found = V.leaks(docs, items).join(C.lines(docs, "doc_id"), "doc_id").join(items.withColumnRenamed("text", "item"), "item_id")
    shared = F.size(F.array_intersect(X.content_words(F.col("line")), X.content_words(F.col("item"))))
    best = F.min_by(F.substring("line", 1, 180), F.struct(-F.col("shared"), F.col("line_no")))
    return found.withColumn("shared", shared).groupBy("doc_id", "item_id").agg(best.alias("snippet"), F.max("shared").alias("shared"))


@query(
    f"WITH {LEAKS}, x AS (SELECT doc_id, item_id, string_split(d.text, chr(10)) AS lines, left(trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')), 60) AS piece FROM leaks JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)), y AS (SELECT doc_id, item_id, lines, list_filter(lines, lambda l: NOT contains(lower(trim(regexp_replace(l, '\\s+', ' ', 'g'))), piece)) AS kept FROM x) SELECT doc_id, item_id, (len(lines) - len(kept))::INTEGER AS gone, md5(array_to_string(kept, chr(10))) AS digest FROM y"
)
def redactions(s, d):
    """Documents that leak, without the lines that hold the item's first piece."""
    docs, items = _load(s, d, "documents"), _load(s, d, "benchmark")
    piece = F.substring(X.normalised(F.col("item")), 1, V.WINDOW)
    found = V.leaks(docs, items).join(docs.select("doc_id", "text"), "doc_id").join(items.withColumnRenamed("text", "item"), "item_id")
    clean = V.redact(F.col("text"), piece)
    return found.select("doc_id", "item_id", (F.size(F.split("text", "\n")) - F.when(clean == "", 0).otherwise(F.size(F.split(clean, "\n")))).alias("gone"), F.md5(clean).alias("digest"))


# ------------------------------------------------------------------ retrieval

TOK = "regexp_extract_all(lower(text), '[a-z0-9_-]+')"
BM25 = f"""p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) x GROUP BY ALL),
dl AS (SELECT doc_id, len({TOK}) AS dl FROM documents), c AS (SELECT count(*) AS docs, avg(dl) AS avgdl FROM dl),
i AS (SELECT term, ln(docs - n + 0.5) - ln(n + 0.5) AS idf FROM (SELECT term, count(*) AS n FROM p GROUP BY term) y, c), m AS (SELECT avg(idf) AS mean_idf FROM i),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOK}) AS term FROM benchmark) z GROUP BY ALL),
w AS (SELECT query_id, q.term, qtf * CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS w FROM q JOIN i USING (term), m),
s AS (SELECT query_id, doc_id, round(sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN w USING (term) JOIN dl USING (doc_id), c GROUP BY ALL),
f AS (SELECT query_id, doc_id, coalesce(score, 0.0) AS score FROM (SELECT item_id AS query_id, doc_id FROM benchmark, documents) e LEFT JOIN s USING (query_id, doc_id)),
bm AS (SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM f) r WHERE rank <= 10)"""


def _items(s: SparkSession, d: str) -> DataFrame:
    return _load(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {BM25} SELECT query_id, rank, doc_id, score FROM bm")
def bm25_topk(s, d):
    return R.LexicalIndex.build(_load(s, d, "documents")).bm25(_items(s, d))


@query(f"SELECT count(*) AS n_docs, round(avg(len({TOK})), 6) AS avg_len, sum(len(list_distinct({TOK})))::BIGINT AS n_postings, (SELECT count(DISTINCT term) FROM (SELECT unnest({TOK}) AS term FROM documents) x) AS n_terms FROM documents")
def postings_stats(s, d):
    """What the persisted index says of the corpus."""
    stats = R.LexicalIndex.build(_load(s, d, "documents")).stats
    return stats.select(F.col("docs").alias("n_docs"), F.round("avgdl", 6).alias("avg_len"), "n_postings", "n_terms")


DENSE = """dn AS (SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM
 (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0) x) y WHERE rank <= 10)"""


def _dense(s: SparkSession, d: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50."""
    vectors = _load(s, d, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.dense(vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), queries)


@query(f"WITH {DENSE} SELECT query_id, rank, doc_id, score FROM dn")
def dense_topk(s, d):
    return _dense(s, d)


@query(f"WITH {DENSE} SELECT query_id, rank, doc_id, score FROM dn")
def vector_cells(s, d):
    """The same search through the stored collection with bounds."""
    vectors = _load(s, d, "embeddings")
    index = VectorIndex.build(vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")))
    return index.search(vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))


OVERLAP = f"""ov AS (SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM
 (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM p JOIN q USING (term) GROUP BY ALL) x) y WHERE rank <= 10)"""


@query(
    f"WITH {BM25}, {OVERLAP}, u AS (SELECT query_id, doc_id, rank, 'bm25' AS src FROM bm UNION ALL SELECT query_id, doc_id, rank, 'overlap' FROM ov), g AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max(CASE WHEN src = 'bm25' THEN rank END) AS bm25_rank, max(CASE WHEN src = 'overlap' THEN rank END) AS overlap_rank FROM u GROUP BY ALL) SELECT query_id, rank, doc_id, score, bm25_rank, overlap_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM g) z WHERE rank <= 7"
)
def rrf_fused(s, d):
    index, items = R.LexicalIndex.build(_load(s, d, "documents")), _items(s, d)
    return R.fuse({"bm25": index.bm25(items), "overlap": index.overlap(items)})


@query(
    f"WITH {BM25}, {LEAKS}, rel AS (SELECT DISTINCT item_id AS query_id, doc_id FROM leaks) SELECT r.query_id, round(coalesce(max(share), 1.0), 6) AS recall FROM (SELECT DISTINCT query_id FROM bm) r LEFT JOIN (SELECT rel.query_id, count(bm.doc_id) / count(*)::DOUBLE AS share FROM rel LEFT JOIN bm ON rel.query_id = bm.query_id AND rel.doc_id = bm.doc_id GROUP BY rel.query_id) x USING (query_id) GROUP BY r.query_id"
)
def ctx_recall(s, d):
    docs, items = _load(s, d, "documents"), _load(s, d, "benchmark")
    relevant = V.leaks(docs, items).select(F.col("item_id").alias("query_id"), "doc_id")
    return R.context_recall(R.LexicalIndex.build(docs).bm25(_items(s, d)), relevant)


@query(
    f"WITH {BM25}, {LEAKS}, h AS (SELECT bm.query_id, rank, (l.doc_id IS NOT NULL)::INTEGER AS hit FROM bm LEFT JOIN leaks l ON bm.query_id = l.item_id AND bm.doc_id = l.doc_id), cs AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM h) SELECT query_id, round(coalesce(avg(CASE WHEN hit = 1 THEN so_far / rank::DOUBLE END), 0.0), 6) AS precision FROM cs GROUP BY query_id"
)
def ctx_precision(s, d):
    docs, items = _load(s, d, "documents"), _load(s, d, "benchmark")
    relevant = V.leaks(docs, items).select(F.col("item_id").alias("query_id"), "doc_id")
    return R.context_precision(R.LexicalIndex.build(docs).bm25(_items(s, d)), relevant)


@query(
    f"WITH {BM25} SELECT query_id, md5(string_agg('--- doc: ' || bm.doc_id || ' | page: 1 | section: ' || coalesce(nullif(source, ''), '-') || ' ---' || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY rank)) AS digest FROM bm JOIN documents USING (doc_id) GROUP BY query_id"
)
def context_digest(s, d):
    """The passages of each query as they are handed on, hits merged with their
    documents by id."""
    docs = _load(s, d, "documents")
    hits = R.with_payload(R.LexicalIndex.build(docs).bm25(_items(s, d)), docs.select("doc_id", "text", F.col("source").alias("section")))
    blocks = R.context_blocks(hits.withColumns({"doc": F.col("doc_id"), "page": F.lit(1)}))
    return blocks.select("query_id", F.md5("context").alias("digest"))


_BARE = f"list_filter(list_transform(list_filter(regexp_split_to_array({{}}, '\\s+'), lambda w: length(w) > 3), lambda w: lower(regexp_replace(w, '{R.MARKS}', '', 'g'))), lambda w: {{}})"


@query(
    f"""WITH {BM25}, tz AS (SELECT query_id, rank, bm.doc_id, d.text, b.text AS question, list_filter(string_split(d.text, chr(10)), lambda x: trim(x) <> '') AS l FROM bm JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = bm.query_id),
 uz AS (SELECT *, CASE WHEN len(l) > 1 THEN l[2:] ELSE l END AS body FROM tz),
 vz AS (SELECT *, list_filter(body, lambda x: regexp_matches(x, '{R.NUMBERED_ROW}')) AS numbered, list_filter(body, lambda x: NOT regexp_matches(x, '{R.RULE_LINE}')) AS plain, {_BARE.format("question", "true")} AS asked FROM uz),
 wz AS (SELECT *, CASE WHEN len(numbered) > 0 THEN numbered WHEN len(plain) > 0 THEN plain ELSE body END AS chosen FROM vz),
 cz AS (SELECT query_id, rank, doc_id, i, chosen[i] AS line, list_sum([0] || list_transform(asked, lambda q: len(list_filter({_BARE.format("chosen[i]", "length(w) > 3")}, lambda o: contains(o, q) OR contains(q, o))))) AS shared FROM (SELECT *, unnest(range(1, len(chosen) + 1)) AS i FROM wz) z),
 bz AS (SELECT query_id, rank, arg_min(line, (-shared, i)) AS line FROM cz GROUP BY ALL)
 SELECT wz.query_id, wz.rank, wz.doc_id, substr(coalesce(bz.line, wz.text), 1, {R.SNIPPET}) AS snippet FROM wz LEFT JOIN bz ON wz.query_id = bz.query_id AND wz.rank = bz.rank"""
)
def passage_snippets(s, d):
    """What the composer shows of each hit."""
    docs = _load(s, d, "documents")
    hits = R.with_payload(R.LexicalIndex.build(docs).bm25(_items(s, d)), docs.select("doc_id", "text")).join(_items(s, d).withColumnRenamed("text", "question"), "query_id")
    return hits.select("query_id", "rank", "doc_id", R.snippet(F.col("text"), F.col("question")).alias("snippet"))


@query(
    f"WITH {BM25}, {LEAKS}, h AS (SELECT bm.query_id, rank, bm.doc_id, (l.doc_id IS NOT NULL)::INTEGER AS hit FROM bm LEFT JOIN leaks l ON bm.query_id = l.item_id AND bm.doc_id = l.doc_id), cs AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM h), pr AS (SELECT query_id, round(coalesce(avg(CASE WHEN hit = 1 THEN so_far / rank::DOUBLE END), 0.0), 6) AS precision, count(*) FILTER (hit = 1) AS found FROM cs GROUP BY query_id), wn AS (SELECT item_id, count(*) AS wanted FROM leaks GROUP BY item_id), e AS (SELECT query_id, precision, CASE WHEN wanted > 0 THEN round(found / wanted::DOUBLE, 6) END AS recall FROM pr LEFT JOIN wn ON query_id = item_id WHERE query_id IN (SELECT item_id FROM benchmark WHERE NOT (regexp_matches(text, '{V.PII.replace(chr(39), chr(39) * 2)}') OR regexp_matches(text, '{U.WRITE_INTENT}') OR ({' OR '.join(f"contains(lower(text), '{w}')" for w in U.VAGUE_TIME)}) AND NOT regexp_matches(text, '{U.EXPLICIT_TIME}')))) SELECT 'precision' AS metric, round(avg(precision), 3) AS mean, count(precision) AS n FROM e UNION ALL SELECT 'recall', round(avg(recall), 3), count(recall) FROM e"
)
def eval_report(s, d):
    """Means over the questions that the rules send to the passages, as is
    expected of all; recall is unknown where nothing is relevant."""
    docs, items = _load(s, d, "documents"), _load(s, d, "benchmark")
    relevant = sinks.stored(V.leaks(docs, items).select(F.col("item_id").alias("query_id"), "doc_id"), "relevant")
    hits = sinks.stored(R.LexicalIndex.build(docs).bm25(_items(s, d)), "hits")
    some = relevant.select("query_id", F.lit(True).alias("any")).distinct()
    nothing = F.lit(None).cast("string")
    decided = U.decide(F.col("text"), F.lit("RAG"), F.lit(0.9), nothing, nothing, nothing, NAMES)
    routes = _items(s, d).select("query_id", decided["final_route"].alias("route"), F.lit("RAG").alias("expected_route"))
    cases = R.context_precision(hits, relevant).join(R.context_recall(hits, relevant), "query_id").join(some, "query_id", "left").join(routes, "query_id")
    return R.eval_means(cases.withColumn("recall", F.when(F.col("any"), F.col("recall"))), ("recall", "precision"))


@query(f"WITH {DENSE} SELECT dn.query_id, round(avg(score), 5) AS relevancy, count(*) FILTER (v.label = q.label) AS same_label FROM dn JOIN embeddings v ON dn.doc_id = v.vec_id JOIN embeddings q ON dn.query_id = q.vec_id GROUP BY dn.query_id")
def relevancy(s, d):
    labels = _load(s, d, "embeddings").select("vec_id", "label")
    hits = _dense(s, d).join(labels.toDF("doc_id", "own"), "doc_id").join(labels.toDF("query_id", "asked"), "query_id")
    return hits.groupBy("query_id").agg(F.round(F.avg("score"), 5).alias("relevancy"), F.count_if(F.col("own") == F.col("asked")).alias("same_label"))


ASSISTANT = f"SELECT conv_id, turn, unnest({SENTENCES}) AS claim FROM conversations WHERE role = 'assistant'"


@query(
    f"WITH a AS ({ASSISTANT}), u AS (SELECT conv_id, list_distinct(flatten(list({WORDS.format('text')}))) AS words FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT conv_id, count(*) AS claims, round(avg(CASE WHEN len(list_intersect({WORDS.format('claim')}, coalesce(words, []))) > 0 THEN 1.0 ELSE 0.0 END), 6) AS faithfulness FROM a LEFT JOIN u USING (conv_id) GROUP BY conv_id"
)
def faithfulness(s, d):
    """Share of an assistant's sentences with support, here a content word of
    the user's own turns; no row without a claim."""
    turns = _load(s, d, "conversations")
    claims = turns.where("role = 'assistant'").select("conv_id", F.explode(X.sentences(F.col("text"))).alias("claim"))
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list(X.content_words(F.col("text"))))).alias("words"))
    joined = claims.join(asked, "conv_id", "left")
    supported = F.coalesce(F.size(F.array_intersect(X.content_words(F.col("claim")), F.col("words"))) > 0, F.lit(False))
    return joined.groupBy("conv_id").agg(F.count("*").alias("claims"), F.round(F.avg(F.when(supported, 1.0).otherwise(0.0)), 6).alias("faithfulness"))


# --------------------------------------------------------------------- numbers

NUM = "regexp_extract_all({}, '" + X.NUMBER.replace("{", "{{").replace("}", "}}") + "')"
STRIPPED = f"regexp_replace(regexp_replace(text, '{X.CITATION}', '', 'g'), '{X.LIST_MARKER}', chr(10), 'g')"
CLAIMS = f"""t AS (SELECT doc_id, source, unnest({NUM.format(STRIPPED)}) AS token, unnest(range(len({NUM.format(STRIPPED)})))::INTEGER AS pos FROM documents),
k AS (SELECT *, TRY_CAST(regexp_replace(token, '[,$%+]', '', 'g') AS DOUBLE) AS value, length(regexp_extract(token, '\\.([0-9]+)', 1))::INTEGER AS places FROM t)"""


@query(f"WITH {CLAIMS} SELECT doc_id, pos, token, value, places FROM k")
def number_tokens(s, d):
    return V.claims(_load(s, d, "documents"), "doc_id").drop("is_pct")


@query(
    f"WITH {CLAIMS}, a AS (SELECT DISTINCT TRY_CAST(regexp_replace(token, '[,$%+]', '', 'g') AS DOUBLE) AS value FROM (SELECT unnest({NUM.format('html')}) AS token FROM pages) x UNION SELECT n_chars::DOUBLE FROM documents) SELECT doc_id, token, min(pos) AS pos FROM k WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE round(a.value * pow(10, places)) = round(k.value * pow(10, places))) AND NOT (ends_with(token, '%') AND EXISTS (SELECT 1 FROM a WHERE round(a.value * pow(10, places + 2)) = round(k.value / 100 * pow(10, places + 2)))) GROUP BY doc_id, token"
)
def number_offenders(s, d):
    """Numbers in documents that neither a page nor a document size accounts
    for; a percentage also by a value a hundred times smaller."""
    docs = _load(s, d, "documents")
    allowed = V.sources(_load(s, d, "pages"), "html").union(docs.select(F.col("n_chars").cast("double"))).distinct()
    return V.offenders(V.claims(docs, "doc_id"), allowed, "doc_id")


# ----------------------------------------------------------- rules, follow-ups

TIME = U.EXPLICIT_TIME
POPULATION = "(?i)\\b(" + "|".join(NAMES) + ")\\b"


def _user_turns(s: SparkSession, d: str) -> DataFrame:
    return _load(s, d, "conversations").where("role = 'user'")


@query(
    f"SELECT conv_id, turn, regexp_matches(text, '{TIME}') AS has_time, regexp_matches(text, '{POPULATION}') AS has_population, ({' OR '.join(f"contains(lower(text), '{w}')" for w in U.VAGUE_TIME)}) AS vague, regexp_matches(text, '{U.WRITE_INTENT}') AS writes FROM conversations WHERE role = 'user'"
)
def question_flags(s, d):
    q = F.col("text")
    return _user_turns(s, d).select("conv_id", "turn", U.has_time(q).alias("has_time"), U.has_population(q, NAMES).alias("has_population"), X.any_of(q, U.VAGUE_TIME).alias("vague"), q.rlike(U.WRITE_INTENT).alias("writes"))


@query(
    f"SELECT conv_id, turn, CASE WHEN NOT regexp_matches(text, '{TIME}') THEN 'time_range' || CASE WHEN NOT regexp_matches(text, '{POPULATION}') THEN ',segment_or_region' ELSE '' END WHEN NOT regexp_matches(text, '{POPULATION}') THEN 'segment_or_region' ELSE '' END AS missing FROM conversations WHERE role = 'user'"
)
def slots_missing(s, d):
    """What a quantitative route would still have to ask for."""
    nothing = F.lit(None).cast("string")
    missing = U.missing_slots(F.col("text"), F.lit("SQL"), nothing, nothing, NAMES)
    return _user_turns(s, d).select("conv_id", "turn", F.array_join(missing, ",").alias("missing"))


@query(
    f"SELECT conv_id, turn, CASE WHEN NOT regexp_matches(text, '{TIME}') THEN '{U.QUESTIONS[U.TIME_RANGE]}' || CASE WHEN NOT regexp_matches(text, '{POPULATION}') THEN ' {U.QUESTIONS[U.POPULATION]}' ELSE '' END WHEN NOT regexp_matches(text, '{POPULATION}') THEN '{U.QUESTIONS[U.POPULATION]}' ELSE 'Could you say more precisely what you need?' END AS asked FROM conversations WHERE role = 'user'"
)
def clarifications(s, d):
    """What is asked back for the slots that a quantitative question leaves open."""
    nothing = F.lit(None).cast("string")
    missing = U.missing_slots(F.col("text"), F.lit("SQL"), nothing, nothing, NAMES)
    return _user_turns(s, d).select("conv_id", "turn", U.clarification(missing).alias("asked"))


@query(
    f"""WITH q AS (SELECT *, (turn % 10) / 10.0::DOUBLE AS confidence, CASE conv_id % 4 WHEN 0 THEN 'SQL' WHEN 1 THEN 'RAG' WHEN 2 THEN 'HYBRID' ELSE 'OFF_TOPIC' END AS route FROM conversations WHERE role = 'user'),
 f AS (SELECT *, CASE WHEN route = 'HYBRID' AND length(text) % 2 = 1 THEN 'RAG' ELSE route END AS eff, regexp_matches(text, '{TIME}') AS tm, regexp_matches(text, '{POPULATION}') AS pp,
 regexp_matches(text, '{V.PII.replace("'", "''")}') AS pii, regexp_matches(text, '{U.WRITE_INTENT}') AS wr, ({' OR '.join(f"contains(lower(text), '{w}')" for w in U.VAGUE_TIME)}) AS vg FROM q)
 SELECT conv_id, turn, CASE WHEN pii OR wr OR route = 'OFF_TOPIC' THEN 'REFUSE' WHEN eff <> route THEN 'RAG' WHEN eff IN ('SQL', 'HYBRID') AND NOT (tm AND pp) THEN 'ASK' WHEN vg AND NOT tm THEN 'ASK' WHEN confidence < 0.6 THEN 'ASK' ELSE eff END AS final_route,
 CASE WHEN pii THEN 'pii' WHEN wr THEN 'write' WHEN route = 'OFF_TOPIC' THEN 'off_topic' WHEN eff <> route THEN 'no_sql_half' WHEN eff IN ('SQL', 'HYBRID') AND NOT (tm AND pp) THEN 'missing_slot' WHEN vg AND NOT tm THEN 'vague_time' WHEN confidence < 0.6 THEN 'low_confidence' END AS rule_id FROM f"""
)
def route_rules(s, d):
    """The rule engine over all user turns, with proposals made from their ids."""
    route = F.element_at(F.array(*(F.lit(r) for r in ("SQL", "RAG", "HYBRID", "OFF_TOPIC"))), (F.col("conv_id") % 4 + 1).cast("int"))
    nothing, half = F.lit(None).cast("string"), F.when(F.length("text") % 2 == 0, F.lit("count deals"))
    decided = U.decide(F.col("text"), route, (F.col("turn") % 10) / 10.0, half, nothing, nothing, NAMES)
    return _user_turns(s, d).select("conv_id", "turn", decided.alias("r")).select("conv_id", "turn", "r.final_route", "r.rule_id")


@query(
    f"""WITH q AS (SELECT *, CASE conv_id % 5 WHEN 0 THEN 'all' WHEN 1 THEN 'EUROPE' WHEN 2 THEN 'AFRICA' WHEN 3 THEN 'mars' END AS slot FROM conversations WHERE role = 'user'),
 f AS (SELECT *, CASE WHEN slot <> 'mars' THEN slot END AS p, regexp_matches(text, '{POPULATION}') AS pp, regexp_matches(text, '{V.PII.replace("'", "''")}') AS pii, regexp_matches(text, '{U.WRITE_INTENT}') AS wr FROM q)
 SELECT conv_id, turn, CASE WHEN pii OR wr THEN 'REFUSE' WHEN p IS NULL AND NOT pp THEN 'ASK' WHEN p = 'AFRICA' THEN 'REFUSE' ELSE 'SQL' END AS final_route,
 CASE WHEN pii THEN 'pii' WHEN wr THEN 'write' WHEN p IS NULL AND NOT pp THEN 'missing_slot' WHEN p = 'AFRICA' THEN 'out_of_scope' END AS rule_id, CASE p WHEN 'all' THEN 'ASIA,EUROPE' ELSE p END AS scope FROM f"""
)
def scope_rules(s, d):
    """Proposals that name all, an allowed, a forbidden, a made-up or no region,
    for a user who may see two: 'all' is narrowed, a made-up one is cleared."""
    allowed = F.array(F.lit("EUROPE"), F.lit("ASIA"))
    slot = F.get(F.array(*(F.lit(x) for x in ("all", "EUROPE", "AFRICA", "mars", None))), (F.col("conv_id") % 5).cast("int"))
    turns = _user_turns(s, d).withColumn("slot", slot)
    decided = U.decide(F.col("text"), F.lit("SQL"), F.lit(0.9), F.lit(None).cast("string"), F.lit("2024"), F.col("slot"), NAMES, allowed)
    scope = F.array_join(U.narrowed_population(U.valid_population(F.col("slot"), NAMES), allowed), ",")
    return turns.select("conv_id", "turn", decided.alias("r"), scope.alias("scope")).select("conv_id", "turn", "r.*", "scope")


FOLLOW = "regexp_replace(lower(trim(text)), '\\?+$', '')"


@query(
    f"SELECT conv_id, turn, ({' OR '.join(f"starts_with({FOLLOW}, '{c}')" for c in U.CONNECTORS)} OR len(list_intersect(regexp_extract_all({FOLLOW}, '[a-z0-9]+'), ['it', 'that', 'those', 'this'])) > 0 OR (len(list_filter(regexp_split_to_array({FOLLOW}, '\\s+'), lambda w: w <> '')) <= 8 AND NOT regexp_matches(text, '{TIME}') AND NOT regexp_matches(text, '{POPULATION}') AND NOT ({' OR '.join(f"contains(lower(text), '{w}')" for w in U.STAGE_NAMES + U.PRODUCT_NAMES)}))) AS followup FROM conversations WHERE role = 'user'"
)
def followup_flags(s, d):
    return _user_turns(s, d).select("conv_id", "turn", U.is_followup(F.col("text"), NAMES).alias("followup"))


@query(
    f"WITH w AS (SELECT conv_id, turn, {WORDS.format('text')} AS w FROM conversations WHERE role = 'user') SELECT conv_id, turn, len(w)::INTEGER AS n_words, len(list_intersect(w, coalesce(lag(w) OVER (PARTITION BY conv_id ORDER BY turn), [])))::INTEGER AS n_shared FROM w"
)
def content_overlap(s, d):
    return U.overlap_with_previous(_load(s, d, "conversations"))


@query(
    f"WITH w AS (SELECT conv_id, turn, {WORDS.format('text')} AS w FROM conversations WHERE role = 'user'), m AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS src, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS merged FROM w) SELECT conv_id, turn, (len(src) = 0 OR len(list_intersect(src, merged)) / greatest(len(src), 1)::DOUBLE >= 0.6) AND (len(w) = 0 OR len(list_intersect(w, merged)) > 0) AS keeps, len(list_filter(merged, lambda x: NOT list_contains(src, x) AND NOT list_contains(w, x))) = 0 AS invents_nothing FROM m WHERE src IS NOT NULL AND merged IS NOT NULL"
)
def merge_guards(s, d):
    """The guards on three user turns in a row: source, reply, merge."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = _user_turns(s, d).select("conv_id", "turn", X.content_words(F.col("text")).alias("w"))
    three = words.withColumns({"src": F.lag("w").over(w), "merged": F.lead("w").over(w)}).where("src is not null and merged is not null")
    source, reply, merge = F.col("src"), F.col("w"), F.col("merged")
    return three.select("conv_id", "turn", U.keeps_content(source, reply, merge).alias("keeps"), U.invents_nothing(source, reply, merge).alias("invents_nothing"))


@query(
    "WITH p AS (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INTEGER AS back FROM p WHERE role = 'user' AND next_role = 'assistant') SELECT conv_id, turn, back, text AS question, answer FROM a WHERE back <= 2"
)
def last_turns(s, d):
    return U.last_turns(_load(s, d, "conversations"))


_STAGE = "list_filter([{}], lambda x: contains(lower({{}}), x))[1]".format(", ".join(f"'{x}'" for x in U.STAGE_NAMES))


@query(
    "WITH RECURSIVE "
    + WITH.removeprefix("WITH ")
    + f""", t AS (SELECT account_id AS conv_id, row_number() OVER (PARTITION BY account_id ORDER BY opportunity_id) AS turn, stage,
 CASE opportunity_id % 5 WHEN 0 THEN 'What closes a deal in ' || stage || ' for ' || region || '?' WHEN 1 THEN 'Show deals' WHEN 2 THEN 'what about ' || stage || '?' ELSE 'and ' || stage END AS text, opportunity_id % 5 NOT IN (0, 1) AS bare FROM opportunities),
 r AS (SELECT conv_id, 0::BIGINT AS turn, ''::VARCHAR AS effective, ''::VARCHAR AS how, false AS keeps_stale, NULL::VARCHAR AS pending, []::VARCHAR[] AS recent FROM (SELECT DISTINCT conv_id FROM t) x
 UNION ALL SELECT conv_id, turn, e, way, coalesce(stale, false), CASE WHEN NOT ok THEN e END, CASE WHEN ok THEN list_concat(recent, [e])[-2:] ELSE recent END FROM (
  SELECT *, regexp_matches(e, '{POPULATION}') AS ok, way <> 'clarified' AND len(list_filter(recent, lambda q: ({_STAGE.format("q")}) <> new AND contains(lower(e), {_STAGE.format("q")}))) > 0 AS stale FROM (
   SELECT t.conv_id, t.turn, r.recent, {_STAGE.format("t.text")} AS new, list_filter(r.recent, lambda q: ({_STAGE.format("q")}) <> {_STAGE.format("t.text")})[-1] AS old,
    CASE WHEN r.pending IS NOT NULL THEN 'clarified' WHEN t.bare AND old IS NOT NULL THEN 'substituted' ELSE 'new' END AS way,
    CASE way WHEN 'clarified' THEN r.pending || ' ' || t.text WHEN 'substituted' THEN regexp_replace(old, {_STAGE.format("old")}, t.stage, 'gi') ELSE t.text END AS e
   FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn + 1) a) b)
 SELECT conv_id, turn, effective, how, keeps_stale, pending IS NOT NULL AS pending FROM r WHERE turn > 0"""
)
def followup_fold(s, d):
    """Each account's deals as turns of a conversation: whole questions, bare
    stages that go on from the last ones, and some that must be asked back."""
    deals = T.opportunities(s, d)
    say = F.when(F.col("opportunity_id") % 5 == 0, F.concat(F.lit("What closes a deal in "), "stage", F.lit(" for "), "region", F.lit("?"))).when(F.col("opportunity_id") % 5 == 1, "Show deals")
    say = say.when(F.col("opportunity_id") % 5 == 2, F.concat(F.lit("what about "), "stage", F.lit("?"))).otherwise(F.concat(F.lit("and "), "stage"))
    turn = F.row_number().over(Window.partitionBy("account_id").orderBy("opportunity_id")).cast("long")
    turns = deals.select(F.col("account_id").alias("conv_id"), turn.alias("turn"), say.alias("text"))
    return H.folded(turns, r"(?i)\b(" + "|".join(NAMES) + r")\b")


@query()
def conversation_fold(s, d):
    """The same over the users' own turns; held against a plain loop in the tests."""
    return H.folded(_user_turns(s, d), U.EXPLICIT_TIME)


# -------------------------------------------------------- digest, trace, report


@query("SELECT r_name AS region, 'region=' || r_name || '; customers=' || count(*) AS digest FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY r_name LIMIT 6")
def result_digest(s, d):
    """The first rows of a result as name=value texts."""
    per = T.accounts(s, d).groupBy("region").agg(F.count("*").alias("customers")).orderBy("region").limit(6)
    return per.select("region", F.concat_ws("; ", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in per.columns)).alias("digest"))


@query("SELECT event_type, median(value) AS median_ms, max(value) AS max_ms, count(*) FILTER (value <= 10.0) AS within FROM events GROUP BY event_type")
def latency_summary(s, d):
    return _load(s, d, "events").groupBy("event_type").agg(F.median("value").alias("median_ms"), F.max("value").alias("max_ms"), F.count_if(F.col("value") <= 10.0).alias("within"))


@query("SELECT event_type AS route, count(*) AS n, round(sum(value), 2) AS ms FROM events GROUP BY event_type")
def trace_roundtrip(s, d):
    """Traces appended as JSON lines in two parts and read back."""
    events = _load(s, d, "events")
    traces = events.select(
        F.col("event_id").alias("trace_id"), F.col("user_id").alias("user"), F.col("event_type").alias("route"), F.col("props").alias("question"),
        F.create_map(F.lit("total"), F.col("value")).alias("timings"), F.array(F.struct(F.lit("execute").alias("name"), F.col("value").alias("ms"))).alias("stages"),
    )
    path = sinks.shared_path(s, "traces")
    for part in (0, 1):
        sinks.append_traces(traces.where(F.col("trace_id") % 2 == part), path)
    back = sinks.read_traces(s, path)
    return back.groupBy("route").agg(F.count("*").alias("n"), F.round(F.sum(F.col("timings")["total"]), 2).alias("ms"))


@query("SELECT 'read' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'with words', count(*) FROM documents WHERE trim(text) <> '' UNION ALL SELECT 'lines', sum(len(string_split(text, chr(10))))::BIGINT FROM documents WHERE trim(text) <> ''")
def stage_counts(s, d):
    """Rows that passed each stage of one plan, as Spark counted them, through the trace log."""
    log = sinks.StageLog(s)
    some = log.observe("with words", log.observe("read", _load(s, d, "documents").select("text")).where("trim(text) <> ''"))
    lines = log.observe("lines", some.select(F.explode(F.split("text", "\n")).alias("line")))
    with log.action("write"):
        lines.write.format("noop").mode("overwrite").save()
    path = sinks.shared_path(s, "stages")
    log.append(path)
    return sinks.read_stages(s, path).where("rows is not null").select("name", "rows")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS INTEGER))::BIGINT AS k FROM events GROUP BY event_type")
def event_properties(s, d):
    return _load(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("int")).alias("k"))
