"""Registered queries: the operators on the driver's tables, with SQL for each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import har, headers, ids, rewrite, score, shape, text, url
from .operators import families as fam
from .operators import answers, decisions, entities, navigation, operations, scoring, secrets, semantics, tasks, traces
from .operators import values as val
from .lineage import shared_folder, written
from .sources import declared, sanitize, tables
from .sources.tables import table
from .streaming import flows as streamed
from .streaming.routes import Routes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Quiet time after which an episode of the events table ends.
GAP = 6 * 3600 * 10**9


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# --- SQL pieces --------------------------------------------------------------------------------------------------

NS = ids.NAMESPACE
SQL_EXCHANGES = """x AS (
  SELECT 'u' || user_id AS session, event_id AS seq, epoch_us(ts) * 1000 AS t, epoch_us(ts) * 1000 + 20000000 AS "end",
    CASE WHEN event_type IN ('view','click') THEN 'GET' ELSE 'POST' END AS method, event_type AS kind, json_extract_string(props, '$.k') AS k,
    CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 302 ELSE 200 END AS status,
    CASE event_type WHEN 'click' THEN 'application/json' WHEN 'error' THEN 'text/plain' ELSE 'text/html' END AS media
  FROM events)"""
SQL_CLASS = """CASE WHEN {s} = '' THEN 'empty' WHEN regexp_full_match({s}, '[0-9]+') THEN 'int'
  WHEN regexp_full_match({s}, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') THEN 'uuid'
  WHEN regexp_full_match({s}, '[A-Za-z]+') THEN 'word' WHEN regexp_full_match({s}, '[0-9A-Za-z]+') THEN 'id'
  WHEN regexp_full_match({s}, '[0-9A-Za-z]+([-_][0-9A-Za-z]+)+') THEN 'slug'
  WHEN regexp_full_match({s}, '[^/]+\\.[0-9A-Za-z]{{1,5}}') THEN 'file:' || lower(regexp_extract({s}, '\\.([0-9A-Za-z]{{1,5}})$', 1))
  ELSE 'other' END"""
# the events' first segment is a word; the second is a number: a slot where it has three siblings
SQL_FAMILIES = (
    SQL_EXCHANGES
    + f""", kinds AS (SELECT method, kind, count(DISTINCT k) >= 3 AS many FROM x GROUP BY ALL),
o AS (
  SELECT x.*, '/' || x.kind || '/' || CASE WHEN many THEN '{{int}}' ELSE k END AS template, session || '#' || seq AS ref
  FROM x JOIN kinds USING (method, kind)),
f AS (SELECT *, substr(sha256('{NS}/family|' || method || ' app.test ' || template || ' ?{{v:string}} body:none:'), 1, 12) AS family FROM o)"""
)
SQL_STEPS = SQL_FAMILIES + """, s AS (
  SELECT *, row_number() OVER w - 1 AS pos, lag(family) OVER w AS previous FROM f WINDOW w AS (PARTITION BY session ORDER BY t, seq))"""
SQL_PAGES = """p AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages)"""


# --- observations of the events table ------------------------------------------------------------------------------


def observed(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.exchanges(spark, folder).withColumns(
        {
            "query_shape": F.lit("{v:string}"), "body_kind": F.lit("none"), "body_shape": F.lit(""), "error": F.lit(""),
            "ref": F.concat("session", F.lit("#"), F.col("seq").cast("string")), "static": text.static_media(F.col("media")),
        }
    )
    return fam.with_family(rows)


def stepped(spark: SparkSession, folder: str) -> DataFrame:
    return written(traces.steps(observed(spark, folder)))


def flows(s: DataFrame) -> DataFrame:
    """Value flows between steps, each step carrying its k both ways."""
    tied = F.coalesce(F.lag("t").over(traces.in_order()) == F.col("t"), F.lit(False))
    sources = s.withColumn("tied", tied).select("session", "pos", "t", F.col("end").alias("available"), F.col("k").alias("value"), "tied")
    return traces.value_flows(sources, s.select("session", "pos", "t", F.col("k").alias("value")))


SQL_FLOWS = SQL_STEPS + """, fl AS (
  SELECT r.session, r.k AS value, r.pos AS to_pos, arg_max(a.pos, (a."end", a.pos)) AS from_pos, r.t - max(a."end") AS delay
  FROM s r JOIN s a ON a.session = r.session AND a.k = r.k AND a."end" <= r.t AND a.pos <> r.pos
  GROUP BY r.session, r.k, r.pos, r.t)"""
SQL_EDGES = SQL_STEPS + """, l AS (
  SELECT a.family AS "from", b.family AS "to", b.session, b.pos, b.t - max(a.t) AS d, b.previous
  FROM s b JOIN s a ON a.session = b.session AND a.pos < b.pos GROUP BY a.family, b.family, b.session, b.pos, b.t, b.previous),
tot AS (SELECT family, count(*) AS n FROM s GROUP BY family),
ps AS (SELECT session, family, count(*) AS n FROM s GROUP BY ALL),
tg AS (SELECT a.family AS "from", b.family AS "to", CAST(sum(b.n) AS BIGINT) AS together, count(*) AS sessions FROM ps a JOIN ps b USING (session)
  WHERE a.family <> b.family OR b.n >= 2 GROUP BY ALL),
e AS (
  SELECT l."from", l."to", count(*) AS ordered, count(*) FILTER (previous = l."from") AS immediate, any_value(tot.n) - count(*) AS without,
    any_value(tg.together) AS together, any_value(tg.sessions) AS sessions, min(d) AS "least", quantile_disc(d, 0.5) AS "median", max(d) AS "most"
  FROM l JOIN tot ON tot.family = l."to" JOIN tg ON tg."from" = l."from" AND tg."to" = l."to" GROUP BY l."from", l."to")"""
SQL_EDGE_FLOWS = SQL_FLOWS + """, ef AS (
  SELECT a.family AS "from", b.family AS "to", count(DISTINCT (b.session, b.pos)) AS matches, count(DISTINCT value) AS "values", min(delay) AS "least", max(delay) AS "most"
  FROM fl JOIN s a ON a.session = fl.session AND a.pos = fl.from_pos JOIN s b ON b.session = fl.session AND b.pos = fl.to_pos GROUP BY ALL)"""
SQL_EPISODES = SQL_FAMILIES + f""", g AS (
  SELECT *, CASE WHEN t - lag(t) OVER w > {GAP} THEN 1 ELSE 0 END AS n, row_number() OVER w - 1 AS pos FROM f WINDOW w AS (PARTITION BY session ORDER BY t, seq)),
ep AS (SELECT *, CAST(sum(n) OVER (PARTITION BY session ORDER BY t, seq) AS BIGINT) AS episode FROM g)"""


@query("WITH " + SQL_EDGES + """
SELECT "to", rank, "from", ordered, immediate, "median", shown FROM (
  SELECT e.*, row_number() OVER (PARTITION BY "to" ORDER BY ordered DESC, immediate DESC, "from") AS rank,
    replace(names.template, '{int}', '{slot_1}') AS shown
  FROM e JOIN (SELECT family, any_value(template) AS template FROM f GROUP BY family) names ON names.family = e."to")
WHERE rank <= 5""")
def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Which families exist, what precedes each, how often and how long before."""
    s = stepped(spark, folder)
    best = Window.partitionBy("to").orderBy(F.desc("ordered"), F.desc("immediate"), "from")
    ranked = traces.edges(s).withColumn("rank", F.row_number().over(best)).where("rank <= 5")
    names = fam.families(s).select(F.col("family").alias("to"), "shown")
    return ranked.join(names, "to").select("to", "rank", "from", "ordered", "immediate", "median", "shown")


@query("WITH " + SQL_FAMILIES + """
SELECT family, method, 'app.test' AS host, template, replace(template, '{int}', '{slot_1}') AS shown, count(*) AS observations, count(DISTINCT session) AS sessions, false AS static
FROM f GROUP BY family, method, template""")
def request_families(spark: SparkSession, folder: str) -> DataFrame:
    return fam.families(observed(spark, folder))


@query("WITH " + SQL_FAMILIES + """, sl AS (
  SELECT family, 'path.1' AS location, k AS value, CASE WHEN strlen(k) = 1 THEN 'integer' ELSE 'number' END AS type, ref FROM f
  UNION ALL SELECT family, 'path.0', kind, 'string', ref FROM f
  UNION ALL SELECT family, 'query.v', k, CASE WHEN strlen(k) = 1 THEN 'string' ELSE 'integer' END, ref FROM f WHERE method = 'POST')
SELECT family, location, count(DISTINCT ref) AS observations, count(DISTINCT value) AS cardinality,
  CASE WHEN count(DISTINCT type) = 1 THEN min(type) WHEN bool_and(type IN ('integer', 'number')) THEN 'number' ELSE 'any' END AS type,
  array_to_string(list_slice(list_transform(list_sort(list_distinct(list({'h': sha256(value), 'v': value}))), lambda x: x.v), 1, 5), ',') AS examples
FROM sl GROUP BY family, location""")
def family_slots(spark: SparkSession, folder: str) -> DataFrame:
    rows = observed(spark, folder)
    one = F.length("k") == 1
    slot = lambda location, value, kind: F.struct(F.lit(location).alias("location"), value.alias("value"), kind.alias("type"))
    slots = F.array(
        slot("path.1", F.col("k"), F.when(one, "integer").otherwise("number")), slot("path.0", F.get("segments", F.lit(0)), F.lit("string")),
        F.when(F.col("method") == "POST", slot("query.v", F.col("k"), F.when(one, "string").otherwise("integer"))),
    )
    values = rows.select("family", "ref", F.inline(F.filter(slots, lambda x: x.isNotNull())))
    return fam.slot_stats(values).withColumn("examples", F.array_join("examples", ","))


@query("WITH " + SQL_FAMILIES + f""", v AS (SELECT *, substr(sha256('{NS}/variant|' || status || ' ' || media || ' none:'), 1, 12) AS variant FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY family, variant ORDER BY session, seq) AS i FROM v),
c AS (SELECT family, variant, min(status) AS status, min(media) AS media, count(*) AS count, array_to_string(list(ref ORDER BY i) FILTER (i <= 3), ',') AS examples FROM n GROUP BY family, variant)
SELECT *, row_number() OVER (PARTITION BY family ORDER BY count DESC, variant) AS rank FROM c""")
def response_variants(spark: SparkSession, folder: str) -> DataFrame:
    return fam.response_variants(observed(spark, folder)).withColumn("examples", F.array_join("examples", ","))


@query("WITH " + SQL_STEPS + " SELECT session, seq, pos, family, previous FROM s")
def trace_steps(spark: SparkSession, folder: str) -> DataFrame:
    return stepped(spark, folder).select("session", "seq", "pos", "family", "previous")


@query("WITH " + SQL_EPISODES + """
SELECT session, episode, min(t) AS start, max("end") AS "end", min(pos) AS first_step, max(pos) AS last_step, count(*) AS exchanges, count(DISTINCT family) AS families
FROM ep GROUP BY session, episode""")
def episodes_gap(spark: SparkSession, folder: str) -> DataFrame:
    return traces.episode_rows(traces.gap_episodes(observed(spark, folder), GAP))


@query("WITH " + SQL_EPISODES + """, w AS (
  SELECT *, min(t) OVER (PARTITION BY session, episode) AS s0, row_number() OVER (PARTITION BY session, episode ORDER BY t, seq) AS i FROM ep)
SELECT family, count(DISTINCT session) AS sessions, count(DISTINCT (session, episode)) AS episodes, count(*) FILTER (i = 1) AS starts, max(t - s0) AS latest FROM w GROUP BY family""")
def evidence_context(spark: SparkSession, folder: str) -> DataFrame:
    return traces.contexts(traces.gap_episodes(observed(spark, folder), GAP))


@query("WITH " + SQL_FLOWS + " SELECT session, value, from_pos, to_pos, delay FROM fl")
def value_flows(spark: SparkSession, folder: str) -> DataFrame:
    return flows(stepped(spark, folder))


@query("WITH " + SQL_EDGES + " SELECT * FROM e")
def sequence_edges(spark: SparkSession, folder: str) -> DataFrame:
    return traces.edges(stepped(spark, folder))


@query("""WITH s AS (SELECT conv_id AS session, turn AS pos, turn AS t, role AS family, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations),
l AS (SELECT a.family AS "from", b.family AS "to", b.session, b.pos, b.t - max(a.t) AS d, b.previous FROM s b JOIN s a ON a.session = b.session AND a.pos < b.pos GROUP BY a.family, b.family, b.session, b.pos, b.t, b.previous),
tot AS (SELECT family, count(*) AS n FROM s GROUP BY family), ps AS (SELECT session, family, count(*) AS n FROM s GROUP BY ALL),
tg AS (SELECT a.family AS "from", b.family AS "to", CAST(sum(b.n) AS BIGINT) AS together, count(*) AS sessions FROM ps a JOIN ps b USING (session) WHERE a.family <> b.family OR b.n >= 2 GROUP BY ALL)
SELECT l."from", l."to", count(*) AS ordered, count(*) FILTER (previous = l."from") AS immediate, any_value(tot.n) - count(*) AS without, any_value(tg.together) AS together,
  any_value(tg.sessions) AS sessions, min(d) AS "least", quantile_disc(d, 0.5) AS "median", max(d) AS "most"
FROM l JOIN tot ON tot.family = l."to" JOIN tg ON tg."from" = l."from" AND tg."to" = l."to" GROUP BY l."from", l."to" """)
def conversation_edges(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    s = traces.steps(c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("turn").alias("t"), F.col("role").alias("family")))
    return traces.edges(s)


@query("WITH " + SQL_EDGE_FLOWS + " SELECT * FROM ef")
def edge_flows(spark: SparkSession, folder: str) -> DataFrame:
    s = stepped(spark, folder)
    return traces.edge_flows(flows(s), s)


@query("WITH " + SQL_EDGES.replace(SQL_STEPS, SQL_EDGE_FLOWS) + """, r AS (
  SELECT e.*, matches, row_number() OVER (PARTITION BY e."to" ORDER BY matches IS NULL, ordered DESC, immediate DESC, e."from") AS rank, greatest(0, count(*) OVER (PARTITION BY e."to") - 5) AS omitted
  FROM e LEFT JOIN ef ON ef."from" = e."from" AND ef."to" = e."to")
SELECT "to", rank, "from", ordered, immediate, coalesce(matches, 0) AS matches, omitted FROM r WHERE rank <= 5""")
def evidence_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    s = stepped(spark, folder)
    return traces.neighbours(traces.edges(s), traces.edge_flows(flows(s), s))


@query("WITH " + SQL_EDGE_FLOWS + """, r AS (
  SELECT *, row_number() OVER (PARTITION BY "to" ORDER BY matches DESC, "from") AS rank, greatest(0, count(*) OVER (PARTITION BY "to") - 3) AS pruned FROM ef)
SELECT "to" AS consumer, "from" AS producer, matches, "values", rank, pruned FROM r WHERE rank <= 3""")
def prerequisites(spark: SparkSession, folder: str) -> DataFrame:
    s = stepped(spark, folder)
    return traces.producers(traces.edge_flows(flows(s), s))


SQL_VIEWS = SQL_EXCHANGES + """, d AS (SELECT *, sum(CASE WHEN kind = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t, seq) - 1 AS latest FROM x),
v AS (SELECT session, latest AS view, k, CASE WHEN strlen(k) = 1 THEN 'typed' WHEN k LIKE '%3' THEN 'user' ELSE 'link' END AS trigger FROM d WHERE kind = 'view'),
m AS (SELECT d.session, d.seq, d.kind, CAST(coalesce(max(v.view), any_value(d.latest)) AS INTEGER) AS view FROM d LEFT JOIN v ON v.session = d.session AND d.kind = 'click' AND v.k = d.k AND v.view <= d.latest GROUP BY d.session, d.seq, d.kind),
pv AS (SELECT m.session, m.seq, m.kind, m.view, v.trigger, m.kind = 'view' AS document FROM m LEFT JOIN v ON v.session = m.session AND v.view = m.view)"""


@query("WITH " + SQL_VIEWS + " SELECT session, seq, view, trigger, document FROM pv")
def page_views(spark: SparkSession, folder: str) -> DataFrame:
    return navigation.page_views(tables.navigation(spark, folder))


@query("WITH " + SQL_VIEWS + """, c AS (SELECT kind AS family, coalesce(trigger, 'untriggered') AS trigger, CASE WHEN document THEN 'document' WHEN kind = 'click' THEN 'fetch' ELSE '' END AS k FROM pv)
SELECT family, 'trigger' AS counted, trigger AS name, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT family, 'kind', k, count(*) FROM c WHERE k <> '' GROUP BY ALL""")
def browser_contexts(spark: SparkSession, folder: str) -> DataFrame:
    rows = navigation.page_views(tables.navigation(spark, folder)).join(tables.exchanges(spark, folder).select("session", "seq", F.get("segments", F.lit(0)).alias("family")), ["session", "seq"])
    kind = F.when(F.col("document"), "document").when(F.col("family") == "click", "fetch").otherwise("")
    return traces.browser_contexts(rows.select("family", "trigger", kind.alias("kind")))


@query("WITH " + SQL_STEPS + """, rf AS (
  SELECT r.session, r.k, r.t, r.pos AS to_pos, arg_max(a.pos, (a."end", a.pos)) AS from_pos, max(a."end") AS ready
  FROM s r JOIN s a ON a.session = r.session AND a.kind = 'signup' AND r.kind = 'view' AND a.k = r.k AND a."end" <= r.t GROUP BY r.session, r.k, r.t, r.pos)
SELECT session, 'https://app.test/view/' || k AS value, from_pos, to_pos, t - ready AS delay FROM rf
WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.session = rf.session AND o.kind = 'view' AND o.k = rf.k AND o.t >= rf.ready AND (o.t, o.pos) < (rf.t, rf.to_pos))""")
def redirect_flows(spark: SparkSession, folder: str) -> DataFrame:
    s = stepped(spark, folder)
    kind = F.get("segments", F.lit(0))
    target = F.when(kind == "signup", url.resolved(F.concat(F.lit("https://app.test/signup/"), "k"), F.concat(F.lit("../view/"), "k", F.lit("#top"))))
    tied = F.coalesce(F.lag("t").over(traces.in_order()) == F.col("t"), F.lit(False))
    return traces.redirect_flows(s.select("session", "pos", "t", F.col("end").alias("available"), F.concat(F.lit("https://app.test/"), kind, F.lit("/"), "k").alias("url"), target.alias("target"), tied.alias("tied")))


SQL_CARRIERS = SQL_FLOWS + """, ap AS (SELECT session, pos, 'body' AS part, 'id' AS place FROM s UNION ALL SELECT session, pos, 'set-cookie', 'k' FROM s WHERE kind = 'signup'),
bp AS (SELECT session, pos, 'path' AS part, '1' AS place FROM s UNION ALL SELECT session, pos, 'cookie', 'k' FROM s WHERE kind = 'purchase'
  UNION ALL SELECT session, pos, 'query', 'q' FROM s WHERE kind = 'click' UNION ALL SELECT session, pos, 'header', 'X-K' FROM s WHERE kind = 'error'),
pf AS (SELECT fl.*, a.family AS "from", b.family AS "to", ap.part AS from_part, ap.place AS from_place, bp.part AS to_part, bp.place AS to_place,
    CASE WHEN bp.part = 'cookie' AND ap.part = 'set-cookie' AND ap.place = bp.place THEN 'cookie' WHEN bp.part IN ('cookie', 'header') THEN 'header' WHEN bp.part IN ('query', 'path') THEN bp.part ELSE 'body' END AS carrier
  FROM fl JOIN s a ON a.session = fl.session AND a.pos = fl.from_pos JOIN s b ON b.session = fl.session AND b.pos = fl.to_pos
  JOIN ap ON ap.session = fl.session AND ap.pos = fl.from_pos JOIN bp ON bp.session = fl.session AND bp.pos = fl.to_pos),
cf AS (SELECT "from", "to", carrier, from_part, from_place, to_part, to_place, count(DISTINCT (session, to_pos)) AS matches, count(DISTINCT value) AS "values", bool_and(strlen(value) = 1) AS low_information,
    false AS ubiquitous, array_to_string(list_slice(list(CASE WHEN strlen(value) = 1 THEN value ELSE 'k0' || value || 'x' END ORDER BY session, to_pos, from_pos, value), 1, 3), ',') AS examples FROM pf GROUP BY ALL)"""


def carriers(s: DataFrame) -> DataFrame:
    """Flows of the events by carrier; numbers of two digits are ids of letters and digits, so that they say something."""
    one = F.length("k") == 1
    s = s.withColumn("k", F.when(one, F.col("k")).otherwise(F.concat(F.lit("k0"), "k", F.lit("x"))))
    kind = F.when(F.length("value") == 1, "integer").otherwise("string")
    flags = s.select(F.col("k").alias("value")).distinct().withColumns({"low_information": text.low_information(kind, F.col("value")), "ubiquitous": F.lit(False)})
    return traces.flow_carriers(traces.placed_flows(flows(s), tables.places(s)), s, flags)


@query("WITH " + SQL_CARRIERS + " SELECT * FROM cf")
def flow_carriers(spark: SparkSession, folder: str) -> DataFrame:
    return carriers(stepped(spark, folder)).withColumn("examples", F.array_join("examples", ","))


@query("WITH " + SQL_EDGES.replace(SQL_STEPS, SQL_CARRIERS) + """
SELECT cf."from", cf."to", carrier, from_place, to_place, matches, ordered FROM cf JOIN e ON e."from" = cf."from" AND e."to" = cf."to" WHERE NOT low_information OR (matches >= 2 AND matches * 10 >= ordered * 9)""")
def evidence_flows(spark: SparkSession, folder: str) -> DataFrame:
    s = stepped(spark, folder)
    shown = traces.visible_flows(carriers(s), traces.edges(s))
    return shown.select("from", "to", "carrier", "from_place", "to_place", "matches", "ordered")


SQL_GROUPS = SQL_EDGES.replace(SQL_STEPS, SQL_CARRIERS) + """, pg AS (
  SELECT cf."to" AS consumer, cf."from" AS producer, CASE WHEN carrier IN ('cookie', 'header', 'redirect') THEN carrier ELSE 'parameter' END AS kind, to_part || '.' || to_place AS key,
    from_part || '.' || from_place AS source, matches, ordered + without AS of, without, sessions
  FROM cf JOIN e ON e."from" = cf."from" AND e."to" = cf."to" WHERE NOT low_information AND cf."from" <> cf."to"),
gk AS (SELECT consumer, producer, kind, key, max(matches) AS m, any_value(of) AS of FROM pg GROUP BY ALL HAVING true),
g AS (SELECT p.consumer, p.producer, p.kind, array_to_string(list_sort(list(DISTINCT p.key)), ',') AS keys, array_to_string(list_sort(list(DISTINCT p.source)), ',') AS sources, max(p.matches) AS matches,
    (SELECT coalesce(array_to_string(list_sort(list(k.key) FILTER (k.m >= k.of)), ','), '') FROM gk k WHERE k.consumer = p.consumer AND k.producer = p.producer AND k.kind = p.kind) AS always,
    max(p.of) AS of, max(p.without) AS without, max(p.sessions) AS sessions FROM pg p GROUP BY p.consumer, p.producer, p.kind)""".replace("GROUP BY ALL HAVING true", "GROUP BY consumer, producer, kind, key")


def state_groups(spark: SparkSession, folder: str) -> DataFrame:
    s = stepped(spark, folder)
    return operations.prerequisite_groups(carriers(s), traces.edges(s))


@query("WITH " + SQL_GROUPS + " SELECT * FROM g")
def prerequisite_groups(spark: SparkSession, folder: str) -> DataFrame:
    return state_groups(spark, folder).withColumns({c: F.array_join(c, ",") for c in ("keys", "sources", "always")})


@query("WITH " + SQL_GROUPS + """, r AS (SELECT *, row_number() OVER (PARTITION BY consumer, kind ORDER BY matches DESC, producer) AS rank, greatest(0, count(*) OVER (PARTITION BY consumer, kind) - 3) AS pruned FROM g)
SELECT consumer, producer, kind, matches, rank, pruned, of - matches + without AS contradicting FROM r WHERE rank <= 3""")
def prerequisite_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return operations.ranked_prerequisites(state_groups(spark, folder)).select("consumer", "producer", "kind", "matches", "rank", "pruned", "contradicting")


@query("WITH " + SQL_GROUPS + """ SELECT a.consumer, a.producer, a.kind, array_to_string(list_sort(list(DISTINCT b.producer)), ',') AS alternates
FROM pg a JOIN pg b ON a.consumer = b.consumer AND a.key = b.key AND (a.producer <> b.producer OR a.kind <> b.kind) GROUP BY a.consumer, a.producer, a.kind""")
def prerequisite_alternates(spark: SparkSession, folder: str) -> DataFrame:
    return operations.alternates(state_groups(spark, folder)).withColumn("alternates", F.array_join("alternates", ","))


@query("WITH " + SQL_FAMILIES + """, sl AS (
  SELECT family, 'query.k' AS location, k AS value, 'string' AS type, ref FROM f UNION ALL SELECT family, 'query.kind', kind, 'string', ref FROM f UNION ALL SELECT family, 'query.q', session || '-' || k, 'string', ref FROM f UNION ALL SELECT family, 'path.1', k, 'string', ref FROM f)
SELECT family, location, count(DISTINCT ref) AS observations, count(DISTINCT value) AS cardinality FROM sl WHERE location LIKE 'query.%' GROUP BY ALL HAVING count(DISTINCT value) >= 3 AND count(DISTINCT value) * 2 >= count(DISTINCT ref)""".replace("GROUP BY ALL", "GROUP BY family, location"))
def free_text_slots(spark: SparkSession, folder: str) -> DataFrame:
    rows = observed(spark, folder)
    of = lambda location, value: F.struct(F.lit(location).alias("location"), value.alias("value"))
    slots = rows.select("family", "ref", F.lit("string").alias("type"), F.inline(F.array(of("query.k", F.col("k")), of("query.kind", F.get("segments", F.lit(0))), of("query.q", F.concat("session", F.lit("-"), "k")), of("path.1", F.col("k")))))
    return operations.free_text_slots(fam.slot_stats(slots)).select("family", "location", "observations", "cardinality")


@query("WITH " + SQL_FAMILIES + """
SELECT (SELECT count(*) FROM f) AS exchanges, (SELECT count(DISTINCT session) FROM f) AS sessions, (SELECT count(DISTINCT family) FROM f) AS families,
  (SELECT count(*) FROM f WHERE status >= 500) AS failures""")
def manifest_counts(spark: SparkSession, folder: str) -> DataFrame:
    return observed(spark, folder).agg(
        F.count("*").alias("exchanges"), F.count_distinct("session").alias("sessions"), F.count_distinct("family").alias("families"), F.count_if(F.col("status") >= 500).alias("failures")
    )


@query("WITH " + SQL_EPISODES + f""", k AS (SELECT DISTINCT family FROM f WHERE method = 'POST'),
v AS (SELECT session || '/' || episode AS view, bool_or(family IN (SELECT family FROM k)) AS c FROM ep GROUP BY ALL)
SELECT count(*) FILTER (c) AS covered, count(*) AS relevant, floor(count(*) FILTER (c) * 1000 / count(*)) / 1000 AS score FROM v""")
def coverage(spark: SparkSession, folder: str) -> DataFrame:
    rows = traces.gap_episodes(observed(spark, folder), GAP)
    views = rows.select(F.concat_ws("/", "session", F.col("episode").cast("string")).alias("view"), "family")
    return semantics.view_coverage(views, rows.where("method = 'POST'").select("family"))


@query("WITH " + SQL_FAMILIES + """, c AS (SELECT family, method, bool_or(media <> 'text/plain') AS has_content, bool_or(status = 302) AS sets_cookie FROM f GROUP BY ALL)
SELECT family, method, has_content, sets_cookie, CASE WHEN method = 'OPTIONS' OR (method IN ('GET','HEAD') AND NOT has_content AND NOT sets_cookie) THEN 'background' END AS role FROM c""")
def role_settle(spark: SparkSession, folder: str) -> DataFrame:
    rows = observed(spark, folder).groupBy("family", "method").agg(
        F.bool_and("static").alias("static"), F.bool_or(F.col("media") != "text/plain").alias("has_content"), F.bool_or(F.col("status") == 302).alias("sets_cookie"), F.lit(0).alias("feeds")
    )
    return semantics.settled_roles(rows).drop("static", "feeds")


# --- pages -------------------------------------------------------------------------------------------------------


@query("WITH " + SQL_PAGES + """
SELECT page_id, host, path, query, len(CASE WHEN path IN ('', '/') THEN [] ELSE string_split(ltrim(path[1:1], '/') || path[2:], '/') END) AS depth,
  coalesce(array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '')), ';'), '') AS pairs, string_split(url, '#')[1] AS bare
FROM p""")
def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.page_paths(spark, folder)
    pairs = F.array_join(F.transform(url.query_pairs(F.col("query")), lambda p: F.concat(p["name"], F.lit("="), p["value"])), ";")
    return rows.select("page_id", "host", "path", "query", F.size("segments").alias("depth"), pairs.alias("pairs"), url.without_fragment(F.col("url")).alias("bare"))


@query("WITH " + SQL_PAGES + """, k AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN ('_', '_t', 'cb', 'cachebust', 'cachebuster', 'nocache', 'rnd', 'rand', 'random', 'timestamp', 'ts'))) AS q FROM p)
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS stable FROM k""")
def url_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", url.stable_url(F.col("url")).alias("stable"))


SQL_SEGMENTS = SQL_PAGES + """, g AS (SELECT page_id, host, path, CASE WHEN path IN ('', '/') THEN [] ELSE string_split(path[2:], '/') END AS segs FROM p)"""


@query("WITH " + SQL_SEGMENTS + ", u AS (SELECT unnest(segs) AS s FROM g) SELECT class, count(*) AS n, count(DISTINCT s) AS different FROM (SELECT s, " + SQL_CLASS.format(s="s") + " AS class FROM u) GROUP BY class")
def segment_class(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.page_paths(spark, folder).select(F.explode("segments").alias("s"))
    return rows.groupBy(url.segment_class(F.col("s")).alias("class")).agg(F.count("*").alias("n"), F.count_distinct("s").alias("different"))


def _levels(depth: int) -> str:
    out = "WITH " + SQL_SEGMENTS + ", r0 AS (SELECT DISTINCT host, segs, '' AS made FROM g)"
    for d in range(depth):
        out += f""", c{d} AS (SELECT *, segs[{d + 1}] AS s, {SQL_CLASS.format(s=f'segs[{d + 1}]')} AS cls FROM r{d}),
n{d} AS (SELECT host, made, cls, count(DISTINCT s) AS n FROM c{d} WHERE s IS NOT NULL GROUP BY ALL),
r{d + 1} AS (SELECT c.host, c.segs, CASE WHEN s IS NULL THEN c.made WHEN n >= 3 AND c.cls NOT IN ('word', 'empty') THEN c.made || '/{{' || c.cls || '}}' ELSE c.made || '/' || s END AS made
  FROM c{d} c LEFT JOIN n{d} n ON n.host = c.host AND n.made = c.made AND n.cls = c.cls AND c.s IS NOT NULL)"""
    return out + f" SELECT 'GET' AS method, host, array_to_string(segs, '/') AS path, CASE WHEN made = '' THEN '/' ELSE made END AS template FROM r{depth}"


@query(_levels(3))
def route_templates(spark: SparkSession, folder: str) -> DataFrame:
    rows = fam.route_templates(tables.page_paths(spark, folder))
    return rows.select("method", "host", F.array_join("segments", "/").alias("path"), "template")


@query("WITH " + SQL_PAGES + """
SELECT count(*) FILTER (host = 'example.org' OR ends_with(host, '.example.org')) AS kept, count(*) FILTER (NOT (host = 'example.org' OR ends_with(host, '.example.org'))) AS skipped, count(*) AS exchanges FROM p""")
def host_filter(spark: SparkSession, folder: str) -> DataFrame:
    return fam.host_counts(tables.page_paths(spark, folder), ["Example.org."])


SQL_HAR = SQL_PAGES + """, h AS (SELECT *, CASE page_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/ld+json' WHEN 2 THEN 'image/png' ELSE '' END AS mime,
  CASE WHEN page_id % 7 = 0 THEN 'script' ELSE '' END AS rt, strlen(html) AS size FROM p JOIN (SELECT page_id AS i, html FROM pages) ON i = page_id),
c AS (SELECT *, CASE WHEN ends_with(lower(path), '/track') OR contains(lower(path), '/track/') THEN 'telemetry' WHEN rt = 'script' THEN 'script' WHEN page_id % 5 = 0 THEN 'document' WHEN page_id % 5 = 1 THEN 'api' WHEN page_id % 5 = 2 THEN 'media'
  WHEN regexp_matches(lower(path), '\\.html?$') THEN 'document' ELSE 'unknown' END AS class FROM h)"""


def har_rows(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("page_id") % 5
    mime = F.when(n == 0, "text/html; charset=utf-8").when(n == 1, "application/ld+json").when(n == 2, "image/png").otherwise("")
    rows = tables.page_paths(spark, folder).withColumn("mime", mime).withColumn("rt", F.when(F.col("page_id") % 7 == 0, "script").otherwise(""))
    return rows.withColumn("class", har.entry_class(F.col("host"), F.col("path"), F.col("rt"), F.col("mime"))).withColumn("size", F.octet_length("html"))


@query("WITH " + SQL_HAR + " SELECT page_id, class FROM c")
def har_classify(spark: SparkSession, folder: str) -> DataFrame:
    return har_rows(spark, folder).select("page_id", "class")


@query("WITH " + SQL_HAR + " SELECT class, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT host) AS hosts FROM c GROUP BY class")
def har_summary(spark: SparkSession, folder: str) -> DataFrame:
    return har_rows(spark, folder).groupBy("class").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.count_distinct("host").alias("hosts"))


@query("WITH " + SQL_HAR + " SELECT page_id, url FROM c WHERE class IN ('document', 'api', 'unknown') AND contains(host, 'blog')")
def har_select(spark: SparkSession, folder: str) -> DataFrame:
    return har_rows(spark, folder).where(F.col("class").isin("document", "api", "unknown") & F.col("host").contains("blog")).select("page_id", "url")


@query("WITH " + SQL_PAGES + " SELECT host, count(*) AS pages, row_number() OVER (ORDER BY count(*) DESC, host) AS rank FROM p GROUP BY host QUALIFY rank <= 10")
def top_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """The ten hosts with most pages: a report."""
    counts = tables.page_paths(spark, folder).groupBy("host").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "host").limit(10)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pages"), "host")))


@query("WITH " + SQL_PAGES + """, w AS (SELECT DISTINCT v FROM (SELECT unnest(string_split(path[2:], '/')) AS v FROM p) WHERE regexp_full_match(v, '[A-Za-z0-9_-]{6,}')
  UNION SELECT DISTINCT host_word FROM (SELECT unnest(string_split(host, '.')) AS host_word FROM p) WHERE regexp_full_match(host_word, '[A-Za-z0-9_-]{6,}')),
t AS (SELECT DISTINCT page_id AS ref, unnest(regexp_extract_all(html, '[A-Za-z0-9_-]+')) AS value FROM pages)
SELECT CAST(ref AS VARCHAR) AS ref, value FROM t WHERE value IN (SELECT v FROM w)""")
def text_hits(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.page_paths(spark, folder)
    words = rows.select(F.explode("segments").alias("value")).union(rows.select(F.explode(F.split("host", r"\."))))
    return val.text_hits(rows.select(F.col("page_id").cast("string").alias("ref"), F.col("html").alias("text")), words)


@query("WITH " + SQL_SEGMENTS + """, o AS (SELECT 'GET' AS role, host, segs[1] AS first, path AS family, CASE WHEN len(segs) > 2 THEN 'b' WHEN ends_with(path, '.html') THEN 'a' ELSE 'c' END AS v FROM g),
f AS (SELECT role, host, first, family, array_to_string(list_sort(list_distinct(list(v))), ',') AS k FROM o GROUP BY ALL),
m AS (SELECT role, host, first, k, min(family) AS operation, array_to_string(list_sort(list(family)), ' ') AS families, count(*) AS n FROM f GROUP BY ALL)
SELECT role, host, first, operation, families FROM m WHERE n > 1""".replace("list_distinct(list(v))", "list(DISTINCT v)").replace("GROUP BY ALL),\nm", "GROUP BY role, host, first, family),\nm"))
def operation_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.page_paths(spark, folder)
    variant = F.when(F.size("segments") > 2, "b").when(F.col("path").endswith(".html"), "a").otherwise("c")
    rows = rows.withColumn("v", variant).groupBy(F.col("method").alias("role"), "host", F.get("segments", F.lit(0)).alias("first"), F.col("path").alias("family")).agg(F.collect_set("v").alias("variants"))
    return semantics.page_merges(rows).withColumn("families", F.array_join("families", " "))


# --- keys of the order tables --------------------------------------------------------------------------------------

SQL_VALUES = """kv AS (
  SELECT 'ORD' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS value, 'list_orders' AS family, 'response' AS side, 'body' AS part, 'orders[].id' AS pattern, CAST(o_custkey AS VARCHAR) AS ref FROM orders
  UNION ALL SELECT 'CUS' || lpad(CAST(o_custkey AS VARCHAR), 7, '0'), 'list_orders', 'response', 'body', 'orders[].customer', CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'ORD' || lpad(CAST(l_orderkey AS VARCHAR), 7, '0'), 'get_order', 'request', 'path', '1', CAST(l_linenumber AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'PRT' || lpad(CAST(l_partkey AS VARCHAR), 7, '0'), 'get_order', 'response', 'body', 'lines[].part', CAST(l_orderkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'CUS' || lpad(CAST(c_custkey AS VARCHAR), 7, '0'), 'get_customer', 'request', 'path', '1', CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'PRT' || lpad(CAST(p_partkey AS VARCHAR), 7, '0'), 'get_part', 'request', 'query', 'part', CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT 'CUS' || lpad(CAST(o_custkey AS VARCHAR), 7, '0'), 'orders_of_customer', 'request', 'query', 'customer', CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'ORD' || lpad(CAST(l_orderkey AS VARCHAR), 7, '0'), 'cancel_order', 'request', 'body', 'order.id', CAST(l_linenumber AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'PRT' || lpad(CAST(l_partkey AS VARCHAR), 7, '0'), 'part_stock', 'request', 'path', '2', CAST(l_suppkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT o_orderstatus, 'list_orders', 'request', 'query', 'status', CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT l_linestatus, 'get_order', 'request', 'query', 'status', CAST(l_orderkey AS VARCHAR) FROM lineitem),
lk AS (SELECT value FROM kv GROUP BY value HAVING count(DISTINCT family) BETWEEN 2 AND 10 AND NOT bool_or(strlen(value) < 4)),
iv AS (SELECT DISTINCT value, side || '.' || family || '.' || part || '.' || pattern AS slot, side = 'request' AS consumer FROM kv
  WHERE ((side = 'request' AND part IN ('path', 'query', 'body')) OR (side = 'response' AND part IN ('body', 'text', 'location'))) AND value IN (SELECT value FROM lk)),
sv AS (SELECT slot, value FROM iv WHERE consumer),
sh AS (SELECT slot, CASE WHEN min(strlen(value)) = max(strlen(value)) THEN min(strlen(value)) ELSE 0 END AS n,
  bit_or(CASE WHEN regexp_matches(value, '[A-Z]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(value, '[a-z]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(value, '[0-9]') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(value, '[^A-Za-z0-9]') THEN 8 ELSE 0 END) AS m
  FROM sv GROUP BY slot)"""


def slot_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values of the slots that consume them."""
    return identities(spark, folder).where("consumer").select("slot", "value")


def identities(spark: SparkSession, folder: str) -> DataFrame:
    return written(val.identity_values(tables.key_values(spark, folder).withColumn("type", F.lit("string"))))


@query("WITH " + SQL_VALUES + f"""
SELECT substr(sha256('{NS}/link|' || value), 1, 12) AS link, value, 'string' AS types, count(*) AS count, count(DISTINCT family) AS n_families,
  array_to_string(list_sort(list(DISTINCT family)), ',') AS families, bool_or(strlen(value) < 4) AS low_information, count(DISTINCT family) > 10 AS ubiquitous
FROM kv GROUP BY value HAVING count(DISTINCT family) >= 2""")
def value_links(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.key_values(spark, folder).withColumn("type", F.lit("string"))
    return val.value_links(rows).withColumn("families", F.array_join("families", ","))


@query("WITH " + SQL_VALUES + """, r AS (SELECT value, family, side, part, pattern, ref, count(*) AS n FROM kv GROUP BY ALL)
SELECT value, family, side, part, pattern, CAST(sum(n) AS BIGINT) AS count, array_to_string(list_slice(list_sort(list(DISTINCT ref)), 1, 3), ',') AS examples FROM r GROUP BY value, family, side, part, pattern""")
def link_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return val.occurrences(tables.key_values(spark, folder)).withColumn("examples", F.array_join("examples", ","))


SQL_PAIRS = SQL_VALUES + """, jp AS (
  SELECT a.slot AS a, b.slot AS b, count(*) AS shared FROM sv a JOIN sv b ON a.value = b.value AND a.slot < b.slot JOIN sh x ON x.slot = a.slot JOIN sh y ON y.slot = b.slot
  WHERE x.n >= 6 AND x.n = y.n AND x.m < 8 AND y.m < 8 AND (x.m & y.m = x.m OR x.m & y.m = y.m)
  GROUP BY a.slot, b.slot HAVING count(*) >= 2 OR bool_or(strlen(a.value) >= 6 AND regexp_matches(a.value, '[A-Za-z]') AND regexp_matches(a.value, '[0-9]')))"""


@query("WITH " + SQL_PAIRS + " SELECT * FROM jp")
def joinable_slots(spark: SparkSession, folder: str) -> DataFrame:
    return val.joinable_slots(slot_values(spark, folder))


@query("WITH RECURSIVE " + SQL_PAIRS + """, e AS (SELECT a, b FROM jp UNION SELECT b, a FROM jp),
r AS (SELECT DISTINCT slot, slot AS c FROM sv UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.slot)
SELECT slot, min(c) AS key_class FROM r GROUP BY slot""")
def key_classes(spark: SparkSession, folder: str) -> DataFrame:
    rows = slot_values(spark, folder)
    return val.key_classes(rows, val.joinable_slots(rows))


@query("WITH RECURSIVE " + SQL_PAIRS + """, e AS (SELECT a, b FROM jp UNION SELECT b, a FROM jp),
r AS (SELECT DISTINCT slot, slot AS c FROM sv UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.slot), k AS (SELECT slot, min(c) AS key_class FROM r GROUP BY slot),
z AS (SELECT key_class, count(DISTINCT slot) AS slots, count(DISTINCT value) AS "values" FROM k JOIN sv USING (slot) GROUP BY key_class HAVING count(DISTINCT slot) > 1)
SELECT key_class, slots, "values", (SELECT count(DISTINCT p.slot) FROM iv p WHERE NOT p.consumer AND p.value IN (SELECT value FROM sv JOIN k USING (slot) WHERE k.key_class = z.key_class)) AS producers FROM z""")
def key_class_stats(spark: SparkSession, folder: str) -> DataFrame:
    every = identities(spark, folder)
    rows = every.where("consumer").select("slot", "value")
    return val.class_stats(val.key_classes(rows, val.joinable_slots(rows)), every)


@query("WITH " + SQL_VALUES + """, g AS (SELECT value, count(*) AS n, count(DISTINCT family) AS nf, bool_or(strlen(value) < 4) OR count(DISTINCT family) > 10 AS flagged FROM kv GROUP BY value HAVING count(DISTINCT family) >= 2),
o AS (SELECT DISTINCT family, value FROM kv), j AS (SELECT o.family, g.*, substr(sha256('""" + NS + """/link|' || g.value), 1, 12) AS link FROM o JOIN g USING (value)),
t AS (SELECT family, count(*) FILTER (NOT flagged) AS m, count(*) FILTER (flagged) AS hidden FROM j GROUP BY family)
SELECT family, row_number() OVER (PARTITION BY family ORDER BY nf DESC, n DESC, link) AS rank, link, value, n AS count, nf AS n_families, greatest(0, m - 5) AS omitted, hidden
FROM j JOIN t USING (family) WHERE NOT flagged QUALIFY rank <= 5""")
def evidence_links(spark: SparkSession, folder: str) -> DataFrame:
    return traces.evidence_links(val.value_links(tables.key_values(spark, folder).withColumn("type", F.lit("string"))))


@query("WITH " + SQL_PAIRS + """, h AS (
  SELECT a.slot AS a, b.slot AS b, list_position(['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f'], substr(sha256(a.value), 2, 1)) % 2 = 1 AS even
  FROM sv a JOIN sv b ON a.value = b.value AND a.slot < b.slot JOIN jp ON jp.a = a.slot AND jp.b = b.slot)
SELECT a, b, count(*) FILTER (even) AS even, count(*) FILTER (NOT even) AS odd, count(*) FILTER (even) > 0 AND count(*) FILTER (NOT even) > 0 AS reproduced FROM h GROUP BY a, b""")
def heldout_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = slot_values(spark, folder)
    return val.held_out(rows, val.joinable_slots(rows))


@query("WITH " + SQL_VALUES + """ SELECT slot, count(*) AS "values", any_value(sh.n) AS length, any_value(sh.m) AS mask FROM sv JOIN sh USING (slot) GROUP BY slot""")
def slot_shapes(spark: SparkSession, folder: str) -> DataFrame:
    return val.slot_shapes(slot_values(spark, folder))


@query("""WITH every AS (
  SELECT l_orderkey || '-' || l_linenumber AS ref, 'order' AS entity, CAST(l_orderkey AS VARCHAR) AS value FROM lineitem
  UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'customer', CAST(o_custkey AS VARCHAR) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'part', CAST(l_partkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'brand', p_brand FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'label', p_brand || '!' FROM lineitem JOIN part ON p_partkey = l_partkey), x AS (SELECT DISTINCT * FROM every),
s AS (SELECT a.entity AS a, b.entity AS b, a.value AS va, b.value AS vb, count(*) AS n FROM x a JOIN x b ON a.ref = b.ref AND a.entity <> b.entity GROUP BY ALL),
f AS (SELECT a, b, max(m) = 1 AS functional, sum(k) AS support FROM (SELECT a, b, va, count(*) AS m, count(*) FILTER (n >= 2) AS k FROM s GROUP BY a, b, va) GROUP BY a, b)
SELECT f.a, f.b, CAST(f.support AS BIGINT) AS support, coalesce(r.functional, false) AS one_to_one FROM f LEFT JOIN f r ON r.a = f.b AND r.b = f.a
WHERE f.functional AND f.support > 0 AND (NOT coalesce(r.functional, false) OR f.a < f.b)""")
def relations_functional(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), c("l_orderkey") == c("o_orderkey")).join(table(spark, folder, "part"), c("l_partkey") == c("p_partkey"))
    ref = F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string"))
    of = lambda name, value: F.struct(F.lit(name).alias("entity"), value.cast("string").alias("value"))
    seen = F.array(of("order", c("l_orderkey")), of("customer", c("o_custkey")), of("part", c("l_partkey")), of("brand", c("p_brand")), of("label", F.concat("p_brand", F.lit("!"))))
    return val.functional_relations(lines.select(ref.alias("ref"), F.inline(seen)))


@query("""SELECT CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber AS "from", l_partkey AS ref FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def refs_unresolved(spark: SparkSession, folder: str) -> DataFrame:
    refs = table(spark, folder, "lineitem").select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("from"), F.col("l_partkey").alias("ref"))
    return semantics.unresolved(refs, table(spark, folder, "part").where("p_size > 5").select(F.col("p_partkey").alias("ref"))).select("from", "ref")


@query("""WITH p AS (SELECT o_custkey AS node, CAST(count(*) AS VARCHAR) AS c FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1), n AS (SELECT o_custkey AS node, CAST(count(*) AS VARCHAR) AS c FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT coalesce(p.node, n.node) AS node, CASE WHEN p.node IS NULL THEN 'added' WHEN n.node IS NULL THEN 'removed' ELSE 'changed' END AS change FROM p FULL JOIN n ON p.node = n.node WHERE p.c IS DISTINCT FROM n.c""")
def ir_diff(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") != s).groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").cast("string").alias("content"))
    return semantics.node_diff(side("O"), side("F"))


@query("""WITH c AS (SELECT l_suppkey AS e, l_partkey AS f, count(*) AS n FROM lineitem GROUP BY ALL), e AS (SELECT e, sum(n) AS n FROM c GROUP BY e), f AS (SELECT f, sum(n) AS n FROM c GROUP BY f),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS correct, (SELECT sum(n * (n - 1) / 2) FROM f) AS given, (SELECT sum(n * (n - 1) / 2) FROM e) AS wanted)
SELECT CAST(correct AS BIGINT) AS correct, CAST(given AS BIGINT) AS given, CAST(wanted AS BIGINT) AS wanted, round(correct / given, 3) AS precision, round(correct / wanted, 3) AS recall FROM s""")
def identity_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("expected"), F.col("l_partkey").alias("found"))
    return semantics.identity_scores(rows)


# --- documents, labels, events as values ---------------------------------------------------------------------------


@query("""SELECT measure, count(*) FILTER (e AND p) AS correct, count(*) FILTER (p) AS given, count(*) FILTER (e) AS wanted,
  CASE WHEN count(*) FILTER (p) = 0 THEN 0 ELSE round(count(*) FILTER (e AND p) / count(*) FILTER (p), 3) END AS precision,
  CASE WHEN count(*) FILTER (e) = 0 THEN 0 ELSE round(count(*) FILTER (e AND p) / count(*) FILTER (e), 3) END AS recall
FROM (SELECT lang AS measure, quality = 1 AS e, n_chars > 500 AS p FROM labels JOIN documents USING (doc_id)) GROUP BY measure""")
def ir_metric(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return semantics.precision_recall(rows.select(F.col("lang").alias("measure"), (F.col("quality") == 1).alias("expected"), (F.col("n_chars") > 500).alias("predicted")))


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(text, '{text.JWT}', '{{{{redacted:jwt}}}}', 'g'), '{text.EMAIL}', '{{{{redacted:email}}}}', 'g') AS redacted FROM documents""")
def redact(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.redact_patterns(F.col("text")).alias("redacted"))


@query("""SELECT class, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT strlen(text) AS b, CASE WHEN strlen(text) <= 0 THEN 'empty' WHEN strlen(text) < 1024 THEN 'tiny' WHEN strlen(text) < 16384 THEN 'small'
  WHEN strlen(text) < 262144 THEN 'medium' WHEN strlen(text) < 4194304 THEN 'large' ELSE 'huge' END AS class FROM documents) GROUP BY class""")
def size_class(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.octet_length("text").alias("b"))
    return rows.groupBy(text.size_class(F.col("b")).alias("class")).agg(F.count("*").alias("n"), F.sum("b").alias("bytes"))


@query("""WITH v AS (SELECT json_extract_string(props, '$.k') AS value, 'integer' AS type FROM events UNION ALL SELECT event_type, 'string' FROM events UNION ALL SELECT CAST(user_id AS VARCHAR), 'string' FROM events)
SELECT type, value, count(*) AS n, CASE WHEN type = 'integer' THEN strlen(value) <= 3 ELSE strlen(value) < 4 END AS low FROM v GROUP BY ALL""")
def low_information(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    seen = lambda column, kind: e.select(column.cast("string").alias("value"), F.lit(kind).alias("type"))
    rows = seen(F.get_json_object("props", "$.k"), "integer").union(seen(F.col("event_type"), "string")).union(seen(F.col("user_id"), "string"))
    return rows.groupBy("type", "value").agg(F.count("*").alias("n")).withColumn("low", text.low_information(F.col("type"), F.col("value")))


@query("""SELECT tree, CAST(sum(files) AS BIGINT) AS files, sha256(string_agg(d, chr(10) ORDER BY p)) AS digest FROM (
  SELECT tree, p, count(*) AS files, p || ' ' || sha256(string_agg(l, chr(10) ORDER BY l)) AS d FROM (
    SELECT source AS tree, substr(sha256('doc-' || doc_id), 1, 3) AS p, 'doc-' || doc_id || ' ' || strlen(text) || ' ' || sha256(text) AS l FROM documents) GROUP BY tree, p) GROUP BY tree""")
def tree_digest(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return semantics.tree_digest(d.select(F.col("source").alias("tree"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("content_hash")))


@query("""WITH l AS (SELECT doc_id AS path, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT * FROM l WHERE contains(lower(line), 'this')) SELECT path, line_no, line, (SELECT count(*) FROM m) AS total FROM m ORDER BY path, line_no LIMIT 40""")
def search_lines(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    lines = d.select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return semantics.search_lines(lines, "This")


@query("""SELECT entity, name, CASE WHEN count(DISTINCT type) = 1 THEN min(type) ELSE 'any' END AS type, 0 AS nulls, count(DISTINCT event_id) AS observations FROM (
  SELECT event_id, event_type AS entity, unnest(json_keys(props)) AS name, CASE WHEN regexp_full_match(json_extract_string(props, '$.k'), '-?[0-9]+') THEN 'integer' ELSE 'string' END AS type FROM events) GROUP BY entity, name""")
def entity_fields(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    fields = F.explode(F.from_json("props", "map<string,string>"))
    rows = e.select("event_id", F.col("event_type").alias("entity"), fields.alias("name", "value"))
    kind = F.when(F.col("value").isNull(), "null").when(F.col("value").rlike(r"^-?[0-9]+\z"), "integer").otherwise("string")
    return semantics.entity_fields(rows.select("entity", "name", kind.alias("type"), F.col("event_id").alias("ref")))


@query("""WITH c AS (SELECT DISTINCT host, path FROM (SELECT source AS host, lang || '.k' || (doc_id % 3) || '.m' || (doc_id % 7) AS path FROM documents UNION SELECT source, lang || '.k' || (doc_id % 3) FROM documents UNION SELECT source, lang FROM documents))
SELECT a.host, a.path, arg_max(b.path, strlen(b.path)) AS parent FROM c a LEFT JOIN c b ON a.host = b.host AND starts_with(a.path, b.path || '.') GROUP BY a.host, a.path""")
def entity_nesting(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    k, m = F.concat(F.lit("k"), (F.col("doc_id") % 3).cast("string")), F.concat(F.lit("m"), (F.col("doc_id") % 7).cast("string"))
    rows = d.select(F.col("source").alias("host"), F.explode(F.array(F.concat_ws(".", "lang", k, m), F.concat_ws(".", "lang", k), F.col("lang"))).alias("path"))
    return semantics.nesting(rows.distinct())


@query("""WITH e AS (SELECT p_brand AS name, p_type AS item FROM part GROUP BY ALL), f AS (SELECT p_size AS id, p_type AS item FROM part GROUP BY ALL),
j AS (SELECT name, id, count(*) AS c FROM e JOIN f USING (item) GROUP BY ALL),
s AS (SELECT name, id, c / ((SELECT count(*) FROM e WHERE e.name = j.name) + (SELECT count(*) FROM f WHERE f.id = j.id) - c) AS overlap FROM j),
b AS (SELECT id, name, overlap FROM s WHERE overlap >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY overlap DESC, name) = 1)
SELECT id, name, overlap, row_number() OVER (PARTITION BY name ORDER BY overlap DESC, id) = 1 AS taken FROM b""")
def best_matches(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return semantics.best_matches(p.select(F.col("p_brand").alias("name"), F.col("p_type").alias("item")), p.select(F.col("p_size").alias("id"), F.col("p_type").alias("item")))


@query("""SELECT p_partkey, abs(p_retailprice - CAST(regexp_replace(shown, '[^0-9.-]', '', 'g') AS DOUBLE)) <= 0.01 + 1e-9 * greatest(1, abs(p_retailprice)) AS same_price, lower(trim(regexp_replace('  ' || p_name || '  X ', '\\s+', ' ', 'g'))) AS name
FROM (SELECT *, '$' || CAST(round(p_retailprice, 1) AS VARCHAR) AS shown FROM part)""")
def score_fields(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    shown = F.concat(F.lit("$"), F.round("p_retailprice", 1).cast("string"))
    same = score.numbers_equal(F.col("p_retailprice"), score.number(shown, currency=True), 0.01)
    return p.select("p_partkey", same.alias("same_price"), score.plain_text(F.concat(F.lit("  "), "p_name", F.lit("  X "))).alias("name"))


@query("WITH " + SQL_EXCHANGES + """, r AS (SELECT session, t, seq, 'request' AS part, method || ' /' || kind AS label FROM x UNION ALL SELECT session, "end", seq, 'response', CAST(status AS VARCHAR) FROM x)
SELECT session, t, seq, part, label FROM r""")
def timeline(spark: SparkSession, folder: str) -> DataFrame:
    x = tables.exchanges(spark, folder)
    asked = x.select("session", "t", "seq", F.lit("request").alias("part"), F.concat(F.col("method"), F.lit(" /"), F.get("segments", F.lit(0))).alias("label"))
    return asked.union(x.select("session", "end", "seq", F.lit("response"), F.col("status").cast("string"))).orderBy("session", "t", "seq", "part")


# --- decisions and revisions -----------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT l_orderkey AS task, l_linenumber % 3 AS input_hash, l_returnflag AS prompt, 'm' AS model, l_linestatus AS params FROM lineitem),
p AS (SELECT DISTINCT l_orderkey AS task, l_linenumber % 3 AS input_hash, l_returnflag AS prompt, 'm' AS model, l_linestatus AS params, l_returnflag || l_linestatus AS choice FROM lineitem WHERE l_quantity > 25)
SELECT t.task, t.input_hash, t.prompt, t.model, t.params, p.choice, p.choice IS NOT NULL AS reused FROM t LEFT JOIN p USING (task, input_hash, prompt, model, params)""")
def decision_reuse(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("task"), (F.col("l_linenumber") % 3).alias("input_hash"), F.col("l_returnflag").alias("prompt"), F.lit("m").alias("model"), F.col("l_linestatus").alias("params"),
        F.concat("l_returnflag", "l_linestatus").alias("choice"), "l_linenumber", "l_quantity",
    )
    return decisions.reuse(rows.select(*decisions.REUSE), rows.where("l_quantity > 25"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'unknown' ELSE p_brand END AS decision, CASE WHEN p_retailprice > 0 AND p_size > 10 AND p_size % 4 <> 0 THEN 'supported' ELSE 'rejected' END AS status FROM part""")
def decision_checks(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    choices = F.when(F.col("p_size") % 4 == 0, F.array(F.lit("unknown"))).otherwise(F.array(F.lit("unknown"), "p_brand", "p_type"))
    made = decisions.decide_first(p.withColumn("choices", choices).withColumn("evidence", F.array("p_name")))
    return decisions.checked(made, {"priced": "p_retailprice > 0", "large": "p_size > 10", "decided": "decision <> 'unknown'"}).select("p_partkey", "decision", "status")


@query("""WITH p AS (SELECT c_custkey AS node, c_mktsegment AS name, CASE WHEN c_nationkey < 5 THEN 'reviewed' ELSE 'proposed' END AS status FROM customer WHERE c_mktsegment <> 'BUILDING'),
n AS (SELECT c_custkey AS node, upper(c_name) AS name, 'supported' AS status FROM customer WHERE c_acctbal > 0 OR c_mktsegment = 'BUILDING')
SELECT coalesce(p.node, n.node) AS node, CASE WHEN n.node IS NULL OR p.status = 'reviewed' THEN p.name ELSE n.name END AS name, CASE WHEN n.node IS NULL OR p.status = 'reviewed' THEN p.status ELSE n.status END AS status
FROM p FULL JOIN n ON p.node = n.node""")
def ir_upsert(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    status = F.when(F.col("c_nationkey") < 5, "reviewed").otherwise("proposed")
    prior = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("name"), status.alias("status"))
    new = c.where("c_acctbal > 0 or c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node"), F.upper("c_name").alias("name"), F.lit("supported").alias("status"))
    return decisions.upsert(prior, new, ["node"])


@query("""SELECT family, array_to_string(list_sort(list(DISTINCT r)), ' ') AS refs FROM (
  SELECT n_regionkey AS family, 'nation:' || n_nationkey AS r FROM nation UNION ALL SELECT n_regionkey, 'supplier:' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey) GROUP BY family""")
def subject_index(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    s = table(spark, folder, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    parts = [("nation", n.select(F.col("n_regionkey").alias("family"), F.col("n_nationkey").alias("ref"))), ("supplier", s.select(F.col("n_regionkey").alias("family"), F.col("s_suppkey").alias("ref")))]
    return decisions.subjects(parts).withColumn("refs", F.array_join("refs", " "))


@query("SELECT text AS text, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.duplicates(table(spark, folder, "documents"), "text")


@query("""SELECT o_orderkey AS id, unnest(list_filter([CASE WHEN NOT o_totalprice > 50000 THEN 'small' END, CASE WHEN NOT o_orderstatus IN ('O', 'F') THEN 'status' END, CASE WHEN NOT (o_orderpriority <> '1-URGENT') THEN 'urgent' END], lambda x: x IS NOT NULL)) AS issue FROM orders""")
def validation_issues(spark: SparkSession, folder: str) -> DataFrame:
    rules = {"small": "o_totalprice > 50000", "status": "o_orderstatus in ('O', 'F')", "urgent": "o_orderpriority <> '1-URGENT'"}
    return decisions.issues(table(spark, folder, "orders"), "o_orderkey", rules)


@query("""WITH b AS (SELECT event_id AS ref, event_type AS family FROM events WHERE event_type <> 'signup'), a AS (SELECT event_id AS ref, CASE WHEN value > 100 THEN 'POST ' || event_type ELSE event_type END AS family FROM events)
SELECT coalesce(a.ref, b.ref) AS ref, b.family AS was, a.family AS now FROM b FULL JOIN a ON a.ref = b.ref WHERE a.family IS DISTINCT FROM b.family""")
def live_regrouped(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    before = e.where("event_type <> 'signup'").select(F.col("event_id").alias("ref"), F.col("event_type").alias("family"))
    now = F.when(F.col("value") > 100, F.concat(F.lit("POST "), "event_type")).otherwise(F.col("event_type"))
    return decisions.regrouped(before, e.select(F.col("event_id").alias("ref"), now.alias("family")))


@query("""WITH v AS (SELECT o_custkey AS subject, o_orderpriority AS name, count(*) AS votes FROM orders GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY subject ORDER BY votes DESC, name) AS rank FROM v QUALIFY rank <= 3""")
def ranked_names(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.ranked_names(table(spark, folder, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("name")), 3)


@query("""SELECT o_orderpriority AS kind, count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def hypothesis_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"))
    return decisions.report(rows, ["O", "F", "P"])


@query("""SELECT conv_id, turn, array_to_string(list_sort(['role=' || role, 't=' || turn]), ';') AS cookies FROM conversations""")
def cookie_pairs(spark: SparkSession, folder: str) -> DataFrame:
    sent = F.concat(F.lit("t="), F.col("turn").cast("string"), F.lit(" ; role ="), "role", F.lit("; flag"))
    pairs = F.transform(headers.cookies(sent), lambda p: F.concat(p["name"], F.lit("="), p["value"]))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(pairs, ";").alias("cookies"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'O' AS open FROM orders""")
def answer_dates(spark: SparkSession, folder: str) -> DataFrame:
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    open_ = score.truth(F.when(F.col("o_orderstatus") == "O", " Yes").otherwise("0"))
    return table(spark, folder, "orders").select("o_orderkey", score.date(shown).alias("day"), open_.alias("open"))


# --- descriptions ------------------------------------------------------------------------------------------------------


SQL_FEATURES = """WITH v AS (SELECT source AS family, CASE WHEN lang = 'en' THEN 'opaque' ELSE 'json' END AS kind,
  CASE lang WHEN 'en' THEN NULL WHEN 'fr' THEN '{"items":[{"id":"a"}],"n":1}' WHEN 'de' THEN '{"a":{"b":{"rows":[{"id":1}]},"tags":["x"]}}' ELSE '{"a":{"b":{"c":{"rows":[{"id":1}]}}},"rows":[[{"id":2}]]}' END AS body,
  CASE WHEN n_chars > 500 THEN 'text/html' ELSE 'image/png' END AS media, CASE WHEN n_chars < 1024 THEN 'tiny' ELSE 'small' END AS size_class FROM documents),
w AS (SELECT *, list_bool_or(list_transform(list_concat(json_extract(body, '$.*'), json_extract(body, '$.*.*'), json_extract(body, '$.*.*.*')), lambda x: json_type(x) = 'ARRAY' AND coalesce(json_type(x, '$[0]') = 'OBJECT', false))) AS listed FROM v)
SELECT family, bool_or(kind = 'json' AND listed) AS lists, bool_or(kind = 'json' AND NOT listed) AS objects,
  bool_or(kind = 'opaque' AND size_class <> 'tiny' AND media = 'text/html') AS pages, bool_or(kind = 'opaque' AND size_class <> 'tiny' AND media <> 'text/html') AS other FROM w GROUP BY family"""


@query(SQL_FEATURES)
def response_features(spark: SparkSession, folder: str) -> DataFrame:
    """What the responses of each source hold; the bodies nest lists at different depths."""
    d = table(spark, folder, "documents")
    lang, n = F.col("lang"), F.col("n_chars")
    body = F.when(lang == "fr", '{"items":[{"id":"a"}],"n":1}').when(lang == "de", '{"a":{"b":{"rows":[{"id":1}]},"tags":["x"]}}')
    body = F.when(lang == "en", None).otherwise(F.coalesce(body, F.lit('{"a":{"b":{"c":{"rows":[{"id":1}]}}},"rows":[[{"id":2}]]}')))
    rows = d.select(F.col("doc_id").cast("string").alias("ref"), F.col("source").alias("family"), F.when(lang == "en", "opaque").otherwise("json").alias("kind"), body.alias("text"), F.when(n > 500, "text/html").otherwise("image/png").alias("media"), F.when(n < 1024, "tiny").otherwise("small").alias("size_class"))
    found = operations.listed(shape.containers(rows.where("text is not null").select("ref", "text")))
    return operations.response_features(rows.join(found, "ref", "left"))


def order_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """(ref, host, text): for each customer a JSON body with its orders, and their lines below them; no table is sent through the driver, however small its file."""
    line = F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    note = F.when(~F.startswith("o_orderpriority", F.lit("1")), F.col("o_orderpriority"))
    order = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), note.alias("note"), F.struct(F.lit(1).alias("from"), "lines").alias("more"))
    orders = table(spark, folder, "orders").join(lines.hint("merge"), "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(order)).alias("orders"))
    body = F.to_json(F.struct(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).alias("customer"), "orders"), {"ignoreNullFields": "false"})
    return table(spark, folder, "customer").join(orders.hint("merge"), "c_custkey").select(F.col("c_custkey").cast("string").alias("ref"), F.col("c_mktsegment").alias("host"), body.alias("text"))


def order_structure(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The structure of order_bodies, found in one walk, and (ref, host, count) of each."""
    structure = written(shape.containers(order_bodies(spark, folder), beside="host"))
    return structure.drop("host"), structure.select("ref", "host").distinct().withColumn("count", F.lit(1))


SQL_BODIES = """c AS (SELECT c_custkey, c_mktsegment AS host, bool_or(n IS NULL) AS some_null, bool_or(n IS NOT NULL) AS some_text FROM customer JOIN (
    SELECT o_custkey, CASE WHEN o_orderpriority NOT LIKE '1%' THEN o_orderpriority END AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) ON o_custkey = c_custkey GROUP BY ALL),
fs AS (SELECT * FROM (VALUES ('body.orders[]', 'id', 'integer'), ('body.orders[]', 'status', 'string'), ('body.orders[]', 'total', 'number'), ('body.orders[].more.lines[]', 'part', 'integer'),
    ('body.orders[].more.lines[]', 'quantity', 'integer'), ('body.orders[].more.lines[]', 'price', 'number'), ('body.orders[].more.lines[]', 'flag', 'string')) v(container, field, type))"""


@query("WITH " + SQL_BODIES + """
SELECT host, container, field, type, 0 AS nulls, count(*) AS observations, min(c_custkey || '#response.' || container || '.' || field) AS first_source, count(*) AS n_sources FROM c, fs GROUP BY host, container, field, type
UNION ALL SELECT host, 'body.orders[]', 'note', CASE WHEN bool_or(some_text) THEN 'string' ELSE 'null' END, count(*) FILTER (some_null), count(*), min(c_custkey || '#response.body.orders[].note'), count(*)
FROM c WHERE some_null <> some_text GROUP BY host""")
def item_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of what the lists in nested bodies hold."""
    rows = entities.item_fields(*order_structure(spark, folder))
    return rows.withColumn("first_source", F.get("sources", F.lit(0))).drop("sources")


@query("WITH " + SQL_BODIES + """
SELECT DISTINCT host, container, CASE WHEN container LIKE '%lines[]' THEN 'body.orders[]' END AS parent, CASE WHEN container LIKE '%lines[]' THEN 'line,more' ELSE 'order' END AS names FROM c, fs""")
def item_entities(spark: SparkSession, folder: str) -> DataFrame:
    """What the lists in nested bodies hold, inside what, and what it may be called."""
    fields = written(entities.item_fields(*order_structure(spark, folder)))
    return entities.item_entities(fields).withColumn("names", F.array_join("names", ","))


@query("WITH " + SQL_BODIES + """
SELECT 'customer' AS entity, field, type, 0 AS nulls, count(*) AS observations, min(host || '/' || c_custkey || '#body.customer.' || field) AS first_source, count(*) AS n_sources FROM c, (VALUES ('id', 'integer'), ('name', 'string')) v(field, type) GROUP BY field, type
UNION ALL SELECT 'part', field, type, 0, count(*), min(host || '/' || c_custkey || '#' || container || '.' || field), count(*) FROM c JOIN fs ON container LIKE '%lines[]' GROUP BY field, type""")
def keyed_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the objects that hold a customer's and a part's key."""
    structure, bodies = order_structure(spark, folder)
    producers = bodies.select("host").distinct().select(F.col("host").alias("family"), F.inline(F.array(*[F.struct(F.lit(a).alias("entity"), F.lit(b).alias("path")) for a, b in (("customer", "body.customer.id"), ("part", "body.orders[].more.lines[].part"))])))
    rows = entities.keyed_fields(producers, structure, bodies.withColumnRenamed("host", "family"))
    return rows.withColumn("first_source", F.get("sources", F.lit(0))).drop("sources")


@query("""WITH RECURSIVE e AS (SELECT 'supplier ' || s_suppkey AS a, 'nation ' || s_nationkey AS b FROM supplier UNION SELECT 'nation ' || n_nationkey, 'region ' || n_regionkey FROM nation
  UNION SELECT 'region ' || r_regionkey, 'region ' || (r_regionkey + 1) FROM region WHERE r_name > 'ASIA'),
n AS (SELECT 'supplier ' || s_suppkey AS entity, s_acctbal > 8000 AS object FROM supplier UNION SELECT 'nation ' || n_nationkey, false FROM nation UNION SELECT 'region ' || r_regionkey, false FROM region),
r AS (SELECT entity FROM n WHERE object UNION SELECT n.entity FROM r JOIN e ON e.a = r.entity JOIN n ON n.entity = e.b) SELECT entity FROM r""")
def object_like(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda name: table(spark, folder, name)
    named = lambda kind, c: F.concat(F.lit(f"{kind} "), c.cast("string"))
    s, n, r = t("supplier"), t("nation"), t("region")
    edges = s.select(named("supplier", F.col("s_suppkey")).alias("from"), named("nation", F.col("s_nationkey")).alias("to")).union(n.select(named("nation", F.col("n_nationkey")), named("region", F.col("n_regionkey"))))
    edges = edges.union(r.where("r_name > 'ASIA'").select(named("region", F.col("r_regionkey")), named("region", F.col("r_regionkey") + 1)))
    nodes = s.select(named("supplier", F.col("s_suppkey")).alias("entity"), (F.col("s_acctbal") > 8000).alias("object"))
    nodes = nodes.union(n.select(named("nation", F.col("n_nationkey")), F.lit(False))).union(r.select(named("region", F.col("r_regionkey")), F.lit(False)))
    return operations.object_like(nodes, edges)


@query("""SELECT subject, 'E' || r AS alias, ref FROM (SELECT subject, ref, row_number() OVER (PARTITION BY subject ORDER BY ref) AS r FROM (SELECT DISTINCT o_custkey AS subject, o_orderkey AS ref FROM orders)) WHERE r <= 10""")
def evidence_aliases(spark: SparkSession, folder: str) -> DataFrame:
    return operations.aliases(table(spark, folder, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("ref")))


@query("WITH " + SQL_SEGMENTS + """, o AS (SELECT 'GET' AS role, host, segs[1] AS first, path AS family, CASE WHEN len(segs) > 2 THEN 'b' WHEN ends_with(path, '.html') THEN 'a' ELSE 'c' END AS v FROM g),
f AS (SELECT role, host, first, family, array_to_string(list_sort(list(DISTINCT v)), ',') AS k FROM o GROUP BY role, host, first, family)
SELECT role, host, first, array_to_string(list_sort(list(DISTINCT family)), ' ') AS families FROM f GROUP BY role, host, first HAVING count(DISTINCT k) > 1""")
def operation_misses(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.page_paths(spark, folder)
    variant = F.when(F.size("segments") > 2, "b").when(F.col("path").endswith(".html"), "a").otherwise("c")
    rows = rows.withColumn("v", variant).groupBy(F.col("method").alias("role"), "host", F.get("segments", F.lit(0)).alias("first"), F.col("path").alias("family")).agg(F.collect_set("v").alias("variants"))
    return operations.merge_misses(rows).withColumn("families", F.array_join("families", " "))


@query("""SELECT conv_id, array_to_string(list(role || CASE WHEN n = 0 THEN '' ELSE '[' || n || ']' END ORDER BY turn), ' ') AS names FROM (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS n FROM conversations) GROUP BY conv_id""")
def numbered_names(spark: SparkSession, folder: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("name"))))
    return table(spark, folder, "conversations").groupBy("conv_id").agg(turns.alias("p")).select("conv_id", F.array_join(url.numbered_names(F.col("p")), " ").alias("names"))


@query(r"""SELECT page_id, lower(regexp_extract(b, '^([a-zA-Z]+://[^/?]*)', 1)) || regexp_replace(regexp_extract(b, '^[a-zA-Z]+://[^/?]*([^?]*)', 1), '/+$', '') || regexp_extract(b, '(\?.*)$', 1) AS answer
FROM (SELECT page_id, string_split(url, '#')[1] AS b FROM pages)""")
def answer_urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", url.answer_url(F.col("url")).alias("answer"))


@query("WITH " + SQL_PAGES + """ SELECT page_id, coalesce(array_to_string(list_transform(string_split(query, '&'), lambda x: CASE WHEN x LIKE 'ref=%' THEN 'ref=REDACTED' ELSE x END), '&'), '') AS clean FROM p""")
def sanitized_queries(spark: SparkSession, folder: str) -> DataFrame:
    config = sanitize.Config(params=("ref",), params_with=("secret",))
    return tables.page_paths(spark, folder).select("page_id", sanitize.sanitized_query(F.col("query"), config).alias("clean"))


@query("""WITH h AS (SELECT conv_id, turn, unnest([{'w': 'request', 'n': 'Cookie', 'v': 'sid=' || turn, 'ok': role = 'user'}, {'w': 'response', 'n': 'Set-Cookie', 'v': 'REDACTED', 'ok': true}, {'w': 'request', 'n': 'X-Role', 'v': role, 'ok': false}]) AS x FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS file, turn AS sequence, 'request header Cookie' AS found FROM h WHERE x.n = 'Cookie' AND x.ok
UNION ALL SELECT CAST(conv_id AS VARCHAR), turn, turn || ' cookie(s)' FROM conversations WHERE turn > 2""")
def unsanitized_entries(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    asked = F.array(pair("Cookie", F.when(F.col("role") == "user", F.concat(F.lit("sid="), F.col("turn").cast("string"))).otherwise("")), pair("X-Role", F.col("role")))
    rows = c.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("sequence"), F.when(F.col("turn") > 2, F.col("turn").cast("int")).otherwise(0).alias("cookies"), asked.alias("request_headers"), F.array(pair("Set-Cookie", F.lit(sanitize.REDACTED))).alias("response_headers"))
    return sanitize.unsanitized(rows)


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) = floor(value) AS same FROM events""")
def json_answers(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    shown = F.concat(F.lit('{ "k" : '), F.floor("value").cast("string"), F.lit(".0 }"))
    return e.select("event_id", rewrite.same_json(F.col("props"), shown).alias("same"))


@query("""WITH f AS (SELECT lang || '/' || source || '/doc-' || doc_id AS path, strlen(coalesce(text, '')) AS size FROM documents), e AS (
  SELECT DISTINCT 'en/' || string_split(path, '/')[2] || '/' AS entry FROM f WHERE starts_with(path, 'en/') UNION ALL SELECT path || ' (' || size || ' bytes)' FROM f WHERE starts_with(path, 'en/'))
SELECT entry, greatest((SELECT count(*) FROM e) - 300, 0) AS more FROM e ORDER BY entry LIMIT 300""")
def tree_list(spark: SparkSession, folder: str) -> DataFrame:
    """The first 300 entries below a folder: a report."""
    d = table(spark, folder, "documents")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/doc-"), F.col("doc_id").cast("string"))
    return answers.listed(d.select(path.alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")), "en", recursive=True)


@query("""WITH c AS (SELECT o_custkey AS subject, o_orderpriority AS choice, count(*) AS given FROM orders GROUP BY ALL)
SELECT subject, choice, given, CAST(sum(given) OVER (PARTITION BY subject) AS BIGINT) AS all_given, round(given / sum(given) OVER (PARTITION BY subject), 3) AS confidence
FROM c QUALIFY row_number() OVER (PARTITION BY subject ORDER BY given DESC, choice) = 1""")
def answer_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return answers.agreement(table(spark, folder, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("choice")))


@query("WITH " + SQL_FAMILIES + """ SELECT family, method || ' app.test' || replace(template, '{int}', '{slot_1}') || '?v' AS label FROM (SELECT DISTINCT family, method, template FROM f)""")
def route_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = fam.families(observed(spark, folder))
    return rows.select("family", fam.route_label(F.col("method"), F.col("host"), F.col("shown"), F.array(F.lit("v"))).alias("label"))


@query("WITH " + SQL_CARRIERS + """ SELECT cf."from", cf."to", to_part, to_place, matches FROM cf WHERE to_part <> 'path' OR to_place = '1' AND cf."to" IN (SELECT family FROM f WHERE ends_with(template, '{int}'))""")
def flows_into_slots(spark: SparkSession, folder: str) -> DataFrame:
    s = stepped(spark, folder)
    slots = F.when(F.endswith("template", F.lit("}")), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return traces.into_slots(carriers(s), s.select("family", slots.alias("slots"))).select("from", "to", "to_part", "to_place", "matches")


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN '' WHEN octet_length(encode(text)) <= 40 THEN text ELSE left(text, CAST(list_max(list_filter(range(41), lambda i: octet_length(encode(left(text, i))) <= 40)) AS BIGINT)) END AS start FROM documents""")
def clipped_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's first 40 bytes, to the last whole character."""
    return table(spark, folder, "documents").select("doc_id", text.clipped(F.coalesce("text", F.lit("")), 40).alias("start"))


@query("WITH " + SQL_EPISODES + """, m AS (SELECT *, session || '#' || seq AS r, row_number() OVER (PARTITION BY session, episode ORDER BY t, seq) AS i FROM ep)
SELECT session, episode, array_to_string(list(r ORDER BY i) FILTER (i <= 3), ',') AS members, array_to_string(list_slice(list_sort(list_distinct(list(family))), 1, 3), ',') AS families, greatest(0, count(*) - 3) AS omitted FROM m GROUP BY session, episode""")
def episode_members(spark: SparkSession, folder: str) -> DataFrame:
    """The first exchanges and families of each episode."""
    rows = traces.episode_members(traces.gap_episodes(observed(spark, folder), GAP), 3)
    return rows.withColumns({c: F.array_join(c, ",") for c in ("members", "families")})


@query("WITH " + SQL_VIEWS + """, c AS (SELECT pv.kind AS family, pv.session, pv.view, x.t, trigger, CASE WHEN document THEN 'document' WHEN pv.kind = 'click' THEN 'fetch' ELSE '' END AS k FROM pv JOIN x ON x.session = pv.session AND x.seq = pv.seq),
b AS (SELECT session, view, min(t) AS begun FROM c WHERE trigger IS NOT NULL GROUP BY ALL),
t AS (SELECT family, coalesce(trigger, 'untriggered') AS name, count(*) AS n FROM c GROUP BY ALL), k AS (SELECT family, k AS name, count(*) AS n FROM c WHERE k <> '' GROUP BY ALL)
SELECT c.family, (SELECT string_agg(name || ':' || n, ',' ORDER BY n DESC, name) FROM t WHERE t.family = c.family) AS triggers, coalesce((SELECT string_agg(name || ':' || n, ',' ORDER BY n DESC, name) FROM k WHERE k.family = c.family), '') AS kinds,
  count(DISTINCT c.session) AS sessions, count(DISTINCT (c.session, c.view)) FILTER (trigger IS NOT NULL) AS episodes, quantile_disc(c.t - b.begun, 0.5) FILTER (trigger IS NOT NULL) AS since_trigger
FROM c LEFT JOIN b ON b.session = c.session AND b.view = c.view GROUP BY c.family""")
def browser_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """What started the page views of each kind of event, and how long before."""
    steps = written(tables.exchanges(spark, folder).select("session", "seq", "t", F.get("segments", F.lit(0)).alias("family")))
    rows = navigation.page_views(tables.navigation(spark, folder)).join(steps, ["session", "seq"])
    kind = F.when(F.col("document"), "document").when(F.col("family") == "click", "fetch").otherwise("")
    out = traces.browser_summaries(rows.select("family", "session", F.col("view").alias("episode"), "t", "trigger", kind.alias("kind")))
    shown = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string"))), ","), F.lit(""))
    return out.withColumns({"triggers": shown("triggers"), "kinds": shown("kinds")})


# --- streams over the events table ---------------------------------------------------------------------------------


def own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/weftlens-{uuid.uuid4().hex}"


def live_steps(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """The events as a stream that is put in order, to the end of all sessions; the folder, and the stream of ordered steps."""
    own, kind = own_folder(spark), F.get("segments", F.lit(0))
    x = tables.exchanges(spark, folder)
    target = F.when(kind == "signup", F.concat(F.lit("https://app.test/view/"), "k"))
    here = F.concat(F.lit("https://app.test/"), kind, F.lit("/"), "k")
    rows = x.select("session", "seq", "t", F.lit(False).alias("ended"), F.col("end").alias("available"), here.alias("url"), target.alias("target"), F.array("k").alias("carried"))
    rows.write.parquet(f"{own}/events")
    ends = rows.groupBy("session").agg(F.max("t").alias("t")).select("session", F.lit(None).cast("long").alias("seq"), "t", F.lit(True).alias("ended"))
    for c in rows.columns[4:]:
        ends = ends.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    ends.write.mode("append").parquet(f"{own}/events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{own}/events")
    streamed.append(streamed.ordered_steps(stream, "1 day"), f"{own}/steps", f"{own}/c-steps").awaitTermination()
    body = "available long, url string, target string, carried array<string>"
    return own, streamed.read_steps(spark, f"{own}/steps", body)


@query("WITH " + SQL_FLOWS + " SELECT session, value, from_pos, to_pos, delay FROM fl")
def live_value_flows(spark: SparkSession, folder: str) -> DataFrame:
    """The value flows of the events as a stream finds them."""
    own, steps = live_steps(spark, folder)
    steps = steps.withColumns({"given": F.col("carried"), "asked": F.col("carried")})
    streamed.append(streamed.value_flow_stream(steps), f"{own}/flows", f"{own}/c-flows").awaitTermination()
    return spark.read.schema(streamed.FLOWS).parquet(f"{own}/flows")


@query(ORACLE_SQL["redirect_flows"] + " AND t - ready <= 43200000000000")
def live_redirect_flows(spark: SparkSession, folder: str) -> DataFrame:
    """The redirects of the events that a request follows within twelve hours, as a stream finds them."""
    own, steps = live_steps(spark, folder)
    streamed.append(streamed.redirect_flow_stream(steps, 12 * 3600 * 10**9, "1 day"), f"{own}/flows", f"{own}/c-flows").awaitTermination()
    return spark.read.schema(streamed.FLOWS).parquet(f"{own}/flows")


@query("WITH " + SQL_FAMILIES + """
SELECT method, 'app.test' AS host, template, count(DISTINCT k) AS paths, count(*) AS observations FROM f GROUP BY method, template""")
def live_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Templates of the events' paths, maintained over three batches: by the day's first, second and last eight hours."""
    routes = Routes(spark, own_folder(spark))
    x = tables.exchanges(spark, folder).withColumn("_part", F.floor(F.hour(F.timestamp_micros(F.floor(F.col("t") / 1000))) / 8))
    for part in range(3):
        routes.apply(x.where(F.col("_part") == part).select("method", "host", "segments"), part)
    return routes.families()


# --- scores of descriptions: regions are runs, nations are what is expected, suppliers and customers by balance what is found -------------------


def descriptions(spark: SparkSession, folder: str) -> tuple[scoring.Expected, scoring.Found]:
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("run"), "n_nationkey", "n_name")
    band = lambda c, n: F.floor(F.col(c) / n).cast("string")
    c = table(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    c = written(c.select("run", "n_name", F.concat(F.lit("c"), "c_custkey").alias("family"), "c_custkey", "c_acctbal", F.col("c_mktsegment").alias("segment"), band("c_acctbal", 1000).alias("band"), F.concat(F.lit("o"), "c_mktsegment", band("c_acctbal", 500)).alias("id")))
    s = table(spark, folder, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    s = written(s.select("run", "n_name", F.concat(F.lit("s"), "s_suppkey").alias("ref"), "s_suppkey", "s_acctbal", band("s_acctbal", 1000).alias("band"), F.concat(F.lit("e"), band("s_acctbal", 1000)).alias("id")))
    label = F.when(F.col("segment") == "BUILDING", "background").when(F.col("segment") == "MACHINERY", "presentation").otherwise(F.col("segment"))
    named = nations.select("run", F.col("n_name").alias("entity"), F.col("n_nationkey").alias("place"))
    following = F.lead("entity").over(Window.partitionBy("run").orderBy("place"))
    expected = scoring.Expected(
        roles=c.where("c_acctbal > 0").select("run", "family", label.alias("role")),
        entities=named.withColumn("names", F.array("entity")),
        identity=s.where("s_acctbal >= 0").select("run", F.col("n_name").alias("entity"), "ref"),
        not_identity=s.where("s_acctbal < 0").select("run", "ref"),
        fields=c.where("c_acctbal > 9900").select("run", F.col("n_name").alias("entity"), F.col("segment").alias("field")).distinct(),
        relations=named.withColumn("target", following).where("target is not null").select("run", "entity", F.lit("next").alias("kind"), "target"),
        operations=named.select("run", F.col("entity").alias("operation"), "place", F.lit("HOUSEHOLD").alias("role")),
        families=c.where("c_acctbal > 5000").select("run", F.col("n_name").alias("operation"), "family"),
        inputs=s.select("run", F.col("n_name").alias("operation"), F.concat(F.lit("b"), "band").alias("slot")).distinct(),
        outputs=named.select("run", F.col("entity").alias("operation"), "entity", F.lit(True).alias("many")),
    )
    made = s.groupBy("run", "id").agg(F.min(F.col("band").cast("long")).alias("place"), F.min_by("n_name", "s_suppkey").alias("name"))
    found = scoring.Found(
        roles=c.select("run", "family", F.col("segment").alias("role"), F.when(F.col("c_acctbal") > 2000, "reviewed").otherwise("proposed").alias("status"), F.col("c_custkey").alias("place")),
        entities=made,
        identity=s.select("run", "id", "ref", F.concat(F.lit("f"), "n_name").alias("family")),
        fields=c.select("run", F.concat(F.lit("e"), "band").alias("id"), F.col("segment").alias("field")).distinct().withColumn("families", F.array(F.lit("f"))),
        relations=made.select("run", "id", F.lit("next").alias("kind"), F.concat(F.lit("e"), (F.col("place") + 1).cast("string")).alias("target")),
        operations=c.groupBy("run", "id").agg(F.min("c_custkey").alias("place"), F.min("segment").alias("role")),
        families=c.select("run", "id", "family"),
        inputs=c.select("run", "id", F.concat(F.lit("b"), "band").alias("slot")).distinct(),
        outputs=c.select("run", "id", F.concat(F.lit("e"), "band").alias("entity"), (F.col("segment") != "BUILDING").alias("many")).distinct(),
    )
    return expected, found


SQL_DESCRIPTIONS = """na AS (SELECT r_name AS run, n_nationkey AS place, n_name AS entity FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT run, entity AS nation, 'c' || c_custkey AS family, c_custkey, c_acctbal, c_mktsegment AS segment, CAST(floor(c_acctbal / 1000) AS BIGINT) AS band,
    'o' || c_mktsegment || CAST(floor(c_acctbal / 500) AS BIGINT) AS id FROM customer JOIN na ON c_nationkey = place),
s AS (SELECT run, entity AS nation, 's' || s_suppkey AS ref, s_suppkey, s_acctbal, CAST(floor(s_acctbal / 1000) AS BIGINT) AS band, 'e' || CAST(floor(s_acctbal / 1000) AS BIGINT) AS id FROM supplier JOIN na ON s_nationkey = place),
ei AS (SELECT run, nation AS entity, ref FROM s WHERE s_acctbal >= 0), ni AS (SELECT run, ref FROM s WHERE s_acctbal < 0),
ef AS (SELECT DISTINCT run, nation AS entity, segment AS field FROM c WHERE c_acctbal > 9900),
fe AS (SELECT run, id, min(band) AS place, arg_min(nation, s_suppkey) AS name FROM s GROUP BY run, id),
ff AS (SELECT DISTINCT run, 'e' || band AS id, segment AS field FROM c),
w AS (SELECT s.run, s.id, ei.entity, count(*) AS weight FROM s JOIN ei USING (run, ref) GROUP BY ALL),
b AS (SELECT w.run, w.id, w.entity, w.weight FROM w JOIN na USING (run, entity) QUALIFY row_number() OVER (PARTITION BY w.run, w.id ORDER BY weight DESC, place) = 1),
m AS (SELECT fe.run, fe.id, fe.name, b.entity, row_number() OVER (PARTITION BY fe.run, b.entity ORDER BY b.weight DESC, fe.place, fe.id) = 1 AND b.entity IS NOT NULL AS taken,
    b.entity IS NOT NULL OR EXISTS (SELECT 1 FROM s JOIN ni USING (run, ref) WHERE s.run = fe.run AND s.id = fe.id) AS scored FROM fe LEFT JOIN b ON b.run = fe.run AND b.id = fe.id),
lab AS (SELECT run, family, CASE segment WHEN 'BUILDING' THEN 'background' WHEN 'MACHINERY' THEN 'presentation' ELSE segment END AS role FROM c WHERE c_acctbal > 0),
eo AS (SELECT run, nation AS operation, family FROM c WHERE c_acctbal > 5000), eon AS (SELECT run, operation, count(*) AS n FROM eo GROUP BY ALL),
fo AS (SELECT run, id, min(c_custkey) AS place, min(segment) AS role, count(*) AS n FROM c GROUP BY run, id),
ov AS (SELECT c.run, c.id, eo.operation, count(*) AS k FROM c JOIN eo USING (run, family) GROUP BY ALL),
oj AS (SELECT ov.run, ov.id, ov.operation, k / (fo.n + eon.n - k) AS weight FROM ov JOIN fo ON fo.run = ov.run AND fo.id = ov.id JOIN eon ON eon.run = ov.run AND eon.operation = ov.operation WHERE 2 * k >= fo.n),
ob AS (SELECT oj.run, oj.id, oj.operation, weight FROM oj JOIN na ON na.run = oj.run AND na.entity = oj.operation QUALIFY row_number() OVER (PARTITION BY oj.run, oj.id ORDER BY weight DESC, place) = 1),
om AS (SELECT fo.run, fo.id, fo.role, ob.operation, ob.operation IS NOT NULL AND row_number() OVER (PARTITION BY fo.run, ob.operation ORDER BY weight DESC, fo.place, fo.id) = 1 AS taken,
    ob.operation IS NOT NULL OR NOT EXISTS (SELECT 1 FROM c WHERE c.run = fo.run AND c.id = fo.id AND c_acctbal <= 0) AS scored FROM fo LEFT JOIN ob ON ob.run = fo.run AND ob.id = fo.id)"""


@query("WITH " + SQL_DESCRIPTIONS + """, rl AS (
  SELECT DISTINCT x.entity, y.entity AS target, x.run FROM fe JOIN m a ON a.run = fe.run AND a.id = fe.id AND a.scored JOIN m z ON z.run = fe.run AND z.id = 'e' || (fe.place + 1) AND z.scored,
    LATERAL (SELECT fe.run AS run, coalesce(a.entity, '') AS entity) x, LATERAL (SELECT coalesce(z.entity, '') AS entity) y),
er AS (SELECT * FROM (SELECT run, entity, lead(entity) OVER (PARTITION BY run ORDER BY place) AS target FROM na) WHERE target IS NOT NULL),
sl AS (SELECT a.run, a.ref AS r1, b.ref AS r2, bool_or(a.nation = b.nation AND a.s_acctbal >= 0 AND b.s_acctbal >= 0) AS same FROM s a JOIN s b ON a.run = b.run AND a.id = b.id AND a.ref < b.ref GROUP BY ALL),
fl AS (SELECT coalesce(g.run, h.run) AS run, g.id IS NOT NULL AS g, h.field IS NOT NULL AS h FROM
  (SELECT m.run, m.entity, m.id, ff.field FROM m JOIN ff USING (run, id) WHERE m.taken AND EXISTS (SELECT 1 FROM ef WHERE ef.run = m.run AND ef.entity = m.entity)) g FULL JOIN ef h ON h.run = g.run AND h.entity = g.entity AND h.field = g.field),
si AS (SELECT DISTINCT run, nation AS operation, 'b' || band AS slot FROM s),
ip AS (SELECT coalesce(g.run, si.run) AS run, g.slot IS NOT NULL AS g, si.slot IS NOT NULL AS h FROM
  (SELECT DISTINCT om.run, om.operation, 'b' || c.band AS slot FROM om JOIN c USING (run, id) WHERE om.taken) g FULL JOIN si ON si.run = g.run AND si.operation = g.operation AND si.slot = g.slot),
op AS (SELECT DISTINCT om.run, om.operation, coalesce(m.entity, '') AS entity, c.segment <> 'BUILDING' AS many FROM om JOIN c USING (run, id) JOIN m ON m.run = om.run AND m.id = 'e' || c.band WHERE om.taken AND m.scored),
z AS (
  SELECT lab.run, 'roles' AS measure, CAST(sum(CASE WHEN c.c_acctbal > 2000 AND c.segment = lab.role THEN 1 ELSE 0 END) AS BIGINT) AS correct, CAST(sum(CASE WHEN c.c_acctbal > 2000 THEN 1 ELSE 0 END) AS BIGINT) AS predicted, count(*) AS expected
    FROM lab JOIN c USING (run, family) GROUP BY lab.run
  UNION ALL SELECT run, 'identity_joins', (SELECT count(*) FROM sl WHERE sl.run = r.run AND same), (SELECT count(*) FROM sl WHERE sl.run = r.run),
    (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM ei WHERE ei.run = r.run GROUP BY entity)) FROM (SELECT DISTINCT run FROM na) r
  UNION ALL SELECT run, 'entities', count(*) FILTER (taken), count(*) FILTER (scored), (SELECT count(*) FROM na WHERE na.run = m.run) FROM m GROUP BY run
  UNION ALL SELECT run, 'entity_names', count(*) FILTER (lower(name) = lower(entity)), count(*), count(*) FROM m WHERE taken GROUP BY run
  UNION ALL SELECT run, 'entity_fields', count(*) FILTER (g AND h), count(*) FILTER (g), count(*) FILTER (h) FROM fl GROUP BY run
  UNION ALL SELECT run, 'relations', (SELECT count(*) FROM rl JOIN er USING (run, entity, target) WHERE rl.run = r.run), (SELECT count(*) FROM rl WHERE rl.run = r.run), (SELECT count(*) FROM er WHERE er.run = r.run) FROM (SELECT DISTINCT run FROM na) r
  UNION ALL SELECT run, 'operations', count(*) FILTER (taken AND role = 'HOUSEHOLD'), count(*) FILTER (scored), (SELECT count(*) FROM na WHERE na.run = om.run) FROM om GROUP BY run
  UNION ALL SELECT r.run, 'operation_merges',
    (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM c JOIN eo USING (run, family) WHERE c.run = r.run GROUP BY c.id, eo.operation)),
    (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM c JOIN eo USING (run, family) WHERE c.run = r.run GROUP BY c.id)),
    (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM eon WHERE eon.run = r.run) FROM (SELECT DISTINCT run FROM na) r
  UNION ALL SELECT run, 'required_inputs', count(*) FILTER (g AND h), count(*) FILTER (g), count(*) FILTER (h) FROM ip GROUP BY run
  UNION ALL SELECT r.run, 'outputs', (SELECT count(*) FROM op WHERE op.run = r.run AND op.operation = op.entity AND op.many), (SELECT count(*) FROM op WHERE op.run = r.run), (SELECT count(*) FROM na WHERE na.run = r.run) FROM (SELECT DISTINCT run FROM na) r
  UNION ALL SELECT run, 'unscored', 0, count(*), 0 FROM (SELECT run FROM m WHERE NOT scored UNION ALL SELECT run FROM om WHERE NOT scored) GROUP BY run)
SELECT run, measure, correct, predicted, expected, CASE WHEN predicted = 0 THEN 0.0 ELSE round(correct / predicted, 3) END AS precision, CASE WHEN expected = 0 THEN 0.0 ELSE round(correct / expected, 3) END AS recall FROM z""")
def description_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every measure of the found descriptions of all regions."""
    return scoring.scores(*descriptions(spark, folder))


@query("WITH " + SQL_DESCRIPTIONS + """
SELECT run, id, entity AS expected, 'entity ' || CASE WHEN entity IS NULL THEN 'matches none' ELSE 'splits' END AS what FROM m WHERE scored AND NOT taken
UNION ALL SELECT run, NULL, entity, 'entity not found' FROM na WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.run = na.run AND m.entity = na.entity AND taken)
UNION ALL SELECT run, id, operation, 'operation ' || CASE WHEN operation IS NULL THEN 'matches none' ELSE 'splits' END FROM om WHERE scored AND NOT taken
UNION ALL SELECT run, NULL, entity, 'operation not found' FROM na WHERE NOT EXISTS (SELECT 1 FROM om WHERE om.run = na.run AND om.operation = na.entity AND taken)""")
def description_mistakes(spark: SparkSession, folder: str) -> DataFrame:
    """What was split, matched none, or wasn't found."""
    e, f = descriptions(spark, folder)
    return scoring.mistakes(e, written(scoring.match_entities(e, f)), written(scoring.match_operations(e, f)))


# --- answers with lists ----------------------------------------------------------------------------------------------------


SQL_ANSWERS = """RECURSIVE a AS (
  SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS want, list(CAST(round(shown, 2) AS DOUBLE) ORDER BY o_orderdate, o_orderkey) AS got,
    count(*) FILTER (o_orderstatus = 'P') AS extra FROM (SELECT *, o_totalprice + CASE WHEN o_orderpriority LIKE '1%' THEN 4000.0 WHEN o_orderpriority LIKE '2%' THEN -4500.0 ELSE 0.0 END AS shown FROM orders) GROUP BY o_custkey),
w AS (
  SELECT o_custkey, want, got AS rest, 0 AS i, true AS fits FROM a
  UNION ALL
  SELECT o_custkey, want, list_filter(rest, lambda x, j: j <> k), i + 1, fits AND k > 0 FROM (
    SELECT *, coalesce(list_position(list_transform(rest, lambda g: abs(g - want[i + 1]) <= 5000.0 + 1e-9 * greatest(1.0, abs(want[i + 1]))), true), 0) AS k FROM w WHERE i < len(want)))"""


@query("WITH " + SQL_ANSWERS + """
SELECT a.o_custkey, f.fits AS any_order, list_sort(a.want) = list_sort(a.got) AS exact,
  coalesce((SELECT bool_and(abs(a.want[j] - a.got[j]) <= 5000.0 + 1e-9 * greatest(1.0, abs(a.want[j]))) FROM range(1, len(a.want) + 1) t(j)), true) AS in_order, f.fits AND extra = 0 AS passed
FROM a JOIN w f ON f.o_custkey = a.o_custkey AND f.i = len(f.want)""")
def answer_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's prices as an answer lists them, with currency signs and within 5,000, against the prices themselves; an answer with other fields doesn't pass."""
    priority = F.substring("o_orderpriority", 1, 1)
    off = F.when(priority == "1", 4000.0).when(priority == "2", -4500.0).otherwise(0.0)
    shown = F.concat(F.lit("$ "), F.round(F.col("o_totalprice") + off, 2).cast("decimal(20,2)").cast("string"))
    rows = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"]).alias("want"),
        F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", shown.alias("shown")))), lambda x: x["shown"]).alias("got"),
        F.filter(F.collect_list("o_orderstatus"), lambda s: s == "P").alias("extra"),
    )
    close = lambda w, g: score.numbers_equal(w, score.number(g, currency=True), 5000.0)
    fits = score.first_fit(F.col("want"), F.col("got"), close)
    numbers = F.transform("got", lambda g: score.number(g, currency=True))
    rows = rows.withColumn("any_order", fits)
    return rows.select(
        "o_custkey", "any_order", rewrite.same_items(F.col("want"), numbers).alias("exact"), score.in_order(F.col("want"), F.col("got"), close).alias("in_order"),
        score.fields_pass(F.array("any_order"), F.col("extra"), F.lit(False)).alias("passed"),
    )


# --- secrets as a table ----------------------------------------------------------------------------------------------------


SQL_SECRETS = f"""e AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{text.EMAIL}')) AS value FROM documents),
s AS (SELECT value FROM e WHERE octet_length(encode(value)) >= 16 UNION SELECT left(text, 40) FROM benchmark WHERE octet_length(encode(left(text, 40))) >= 16)"""


@query("WITH " + SQL_SECRETS + """
SELECT value, count(*) AS documents, CAST(sum(CAST((length(text) - length(replace(text, value, ''))) / length(value) AS BIGINT)) AS BIGINT) AS places FROM documents JOIN s ON contains(text, value) GROUP BY value""")
def secret_places(spark: SparkSession, folder: str) -> DataFrame:
    """In how many documents each secret stands, and how often: mail addresses of the documents, and the beginnings of benchmark items."""
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    mails = d.select(F.explode(F.regexp_extract_all("text", F.lit(text.EMAIL), F.lit(0))).alias("value"))
    known = mails.union(table(spark, folder, "benchmark").select(F.substring("text", 1, 40))).distinct().where(F.octet_length("value") >= 16)
    found = secrets.occurrences(d, known.withColumn("label", F.lit("text"))).where("at >= 0")
    return found.groupBy(F.col("value").cast("string").alias("value")).agg(F.count_distinct("id").alias("documents"), F.count("*").alias("places"))


# --- closed-choice tasks: brands and sizes of parts are families of requests ---------------------------------------------------


SQL_ROLES = """f AS (SELECT p_brand || '/' || p_size AS family, CASE WHEN avg(p_retailprice) >= PRICE THEN 'POST' ELSE 'GET' END AS method, p_size < 12 AS l, p_size >= 12 AND p_size < 24 AS o, p_size >= 24 AND p_size < 36 AS p,
    p_size >= 36 AND p_size < 42 AS x, count(*) >= 4 AS slots, max(p_retailprice) > 1850 AS free, min(p_retailprice) < 950 AS cookies, p_size BETWEEN 20 AND 40 AS feeds, min(p_partkey) > 100 AS page_host FROM part GROUP BY p_brand, p_size),
r AS (SELECT *, l OR o OR p OR x AS content, method = 'GET' AS read FROM f),
s AS (SELECT *, NOT page_host AND (NOT read OR NOT content) AS beacon, NOT read AND NOT content AND page_host AS silent, slots AND NOT l AND NOT free AS one_first FROM r),
c AS (
  SELECT family, CASE WHEN one_first THEN 2 ELSE 1 END AS rank, 'collection_read' AS id FROM s WHERE content AND (l OR p)
  UNION ALL SELECT family, CASE WHEN one_first THEN 1 ELSE 2 END, 'item_read' FROM s WHERE content AND (slots OR o OR p)
  UNION ALL SELECT family, 3, 'mutation' FROM s WHERE NOT read UNION ALL SELECT family, 4, 'setup_state' FROM s WHERE cookies OR feeds UNION ALL SELECT family, 5, 'presentation' FROM s WHERE content
  UNION ALL SELECT family, CASE WHEN beacon OR silent THEN 0 ELSE 6 END, 'background' FROM s UNION ALL SELECT family, 7, 'unknown' FROM s)"""


def role_features(spark: SparkSession, folder: str, price: float) -> DataFrame:
    size, flag = F.col("p_size"), F.lit
    rows = table(spark, folder, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("_a"), F.min("p_retailprice").alias("_l"), F.max("p_retailprice").alias("_h"), F.count("*").alias("_n"), F.min("p_partkey").alias("_k"))
    some = lambda place, there: F.when(there, F.array(flag(place))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        F.concat("p_brand", flag("/"), size.cast("string")).alias("family"), F.when(F.col("_a") >= price, "POST").otherwise("GET").alias("method"), (size < 12).alias("lists"), size.between(12, 23).alias("objects"),
        size.between(24, 35).alias("pages"), size.between(36, 41).alias("other"), some("path.1", F.col("_n") >= 4).alias("path_slots"), some("query.q", F.col("_h") > 1850).alias("query_slots"),
        (F.col("_h") > 1850).alias("free_text"), (F.col("_l") < 950).alias("sets_cookies"), size.between(20, 40).cast("int").alias("feeds"), (F.col("_k") > 100).alias("page_host"),
    )


def role_tasks(spark: SparkSession, folder: str, price: float) -> DataFrame:
    rows = tasks.role_choices(role_features(spark, folder, price))
    shown = F.transform(F.concat("path_slots", "query_slots"), lambda p: F.struct(F.concat("family", F.lit("#"), p).alias("ref"), F.concat(F.lit("varies at "), p).alias("text")))
    return tasks.tasks(rows.withColumn("evidence", F.concat(F.array(F.struct(F.col("family").alias("ref"), F.col("method").alias("text"))), shown)), "classify_family", "family", "What does this family do for a person?")


@query("WITH " + SQL_ROLES.replace("PRICE", "1500") + " SELECT family, string_agg(id, ',' ORDER BY rank) AS choices FROM c GROUP BY family")
def role_choices(spark: SparkSession, folder: str) -> DataFrame:
    """What each family may be, best first."""
    rows = tasks.role_choices(role_features(spark, folder, 1500))
    return rows.select("family", F.array_join(F.transform("choices", lambda c: c["id"]), ",").alias("choices"))


@query("WITH RECURSIVE " + SQL_ROLES.replace("PRICE", "1500") + """, m AS (SELECT family, arg_min(id, rank) AS choice FROM c GROUP BY family),
b AS (SELECT p_brand || '/' || p_size AS family, CASE WHEN avg(p_retailprice) >= 1450 THEN 'POST' ELSE 'GET' END AS method FROM part GROUP BY p_brand, p_size)
SELECT 'classify_family:' || family || ':v1' AS task, 'decided' AS status, choice, f.method = b.method AS reused, CASE WHEN f.method = b.method THEN 0 ELSE 1 END AS calls FROM m JOIN f USING (family) JOIN b USING (family)""")
def decisions_again(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions after a change of some families: those whose task is as before are taken over, the others are asked again."""
    before = written(tasks.decide(role_tasks(spark, folder, 1450), tasks.first_choice, "first"))
    rows = tasks.decide(role_tasks(spark, folder, 1500), tasks.first_choice, "first", prior=before)
    return rows.select("task", "status", "choice", "reused", F.size("attempts").alias("calls"))


# --- declared documents: a scenario for each part ------------------------------------------------------------------------------


SQL_SCENARIOS = """n AS (SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS name, CASE WHEN p_retailprice > 1500 THEN 'P ' || p_partkey ELSE 'part-' || p_size || '-' || lower(left(p_brand, 5)) END AS id,
  CASE WHEN p_size < 5 THEN ' ' ELSE p_name END AS shown, p_size - 10 AS version, CASE WHEN p_size > 40 THEN 'judge' ELSE 'fields' END AS type, CASE WHEN p_size BETWEEN 20 AND 30 THEN -0.5 ELSE 0.5 END AS tolerance, p_size - 3 AS steps FROM part)"""


@query("WITH " + SQL_SCENARIOS + f"""
SELECT name, 'id' AS path, chr(39) || id || chr(39) || ' doesn' || chr(39) || 't match {declared.ID}' AS issue FROM n WHERE NOT regexp_full_match(id, '{declared.ID}')
UNION ALL SELECT name, 'name', 'is empty' FROM n WHERE trim(shown) = '' UNION ALL SELECT name, 'version', 'is less than 1' FROM n WHERE version < 1
UNION ALL SELECT name, 'evaluation.type', chr(39) || 'judge' || chr(39) || ' is not one of fields' FROM n WHERE type <> 'fields' UNION ALL SELECT name, 'evaluation.normalizers.x', 'is not a required field' FROM n
UNION ALL SELECT name, 'evaluation.normalizers.x.numeric_tolerance', 'is less than 0' FROM n WHERE tolerance < 0 UNION ALL SELECT name, 'limits.answer.max_steps', 'is less than 1' FROM n WHERE steps < 1
UNION ALL SELECT name, 'color', 'is not known' FROM n WHERE type <> 'fields'
UNION ALL SELECT name, 'id', 'id ' || id || ' is also in ' || first FROM (SELECT *, min(name) OVER (PARTITION BY id) AS first FROM n) WHERE name <> first""")
def declared_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of a scenario made of each part."""
    p, size = table(spark, folder, "part"), F.col("p_size")
    named = F.when(F.col("p_retailprice") > 1500, F.concat(F.lit("P "), "p_partkey")).otherwise(F.concat(F.lit("part-"), size.cast("string"), F.lit("-"), F.lower(F.substring("p_brand", 1, 5))))
    evaluation = F.struct(
        F.when(size > 40, "judge").otherwise("fields").alias("type"), F.array(F.lit("price")).alias("required_fields"),
        F.struct(F.struct(F.lit(True).alias("currency")).alias("price"), F.struct(F.when(size.between(20, 30), -0.5).otherwise(0.5).alias("numeric_tolerance")).alias("x")).alias("normalizers"),
    )
    text = F.to_json(F.struct(named.alias("id"), F.when(size < 5, " ").otherwise(F.col("p_name")).alias("name"), (size - 10).alias("version"), evaluation.alias("evaluation"), F.struct(F.struct((size - 3).alias("max_steps")).alias("answer")).alias("limits"), F.when(size > 40, "red").alias("color")))
    found = written(declared.read(p.select(F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("name"), text.alias("text")), declared.SCENARIO))
    return declared.issues(found, across=("id",))
