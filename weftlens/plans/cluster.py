"""The whole pass over recordings: observations, bodies, families, links, traces, page views, flows, edges and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bodies as body
from ..functions import text, url
from ..lineage import written
from ..operators import families, navigation, traces, values
from ..operators.observations import body_references, navigation_steps, observations, query_shape
from ..operators.observations import values as extracted


def with_bodies(observed: DataFrame, records: DataFrame) -> DataFrame:
    """Observations with body_kind, body_shape and size_class of the request, and response_kind and response_shape; an opaque body's shape is its media type."""
    shape = F.when(F.col("kind") == "opaque", F.col("media")).otherwise(F.col("shape"))
    asked = records.where("side = 'request'").select("ref", F.col("kind").alias("body_kind"), shape.alias("body_shape"), "size_class")
    given = records.where("side = 'response'").select("ref", F.col("kind").alias("response_kind"), shape.alias("response_shape"))
    rows = observed.join(asked, "ref", "left").join(given, "ref", "left")
    return rows.na.fill("none", ["body_kind", "response_kind"]).na.fill("", ["body_shape", "response_shape", "size_class"])


def with_episodes(named: DataFrame, gap: int) -> DataFrame:
    """Observations with episode and trigger: page views of sessions that have any, else stretches between pauses of more than `gap`."""
    views = navigation.page_views(navigation_steps(named)).select("session", "seq", F.col("view").alias("episode"), "trigger")
    seen = views.groupBy("session").agg((F.max("episode") >= 0).alias("_viewed"))
    viewed = named.join(views.join(seen.where("_viewed").select("session"), "session", "left_semi"), ["session", "seq"])
    quiet = named.join(seen.where("_viewed").select("session"), "session", "left_anti")
    return viewed.unionByName(traces.gap_episodes(quiet, gap).withColumn("trigger", F.lit("gap")))


def cluster(exchanges: DataFrame, hosts: list[str] | None = None, gap: int = 30 * 10**9, contents: DataFrame | None = None) -> dict[str, DataFrame]:
    """Outputs by name from exchanges of any number of recordings; only the given hosts, or all.

    contents: (sha256, content) of stored bodies; without them bodies are known by their media type only.  The result
    doesn't depend on the order of rows: ids are hashes of content, and lists are sorted.
    """
    observed = observations(exchanges).where(url.own_host(F.col("host"), hosts or []))
    stored = body_references(exchanges)
    stored = stored.join(contents, "sha256", "left") if contents is not None else stored.withColumn("content", F.lit(None).cast("binary"))
    records = written(body.body_records(stored).join(observed.select("ref"), "ref", "left_semi"))
    shaped = with_bodies(observed, records).withColumns({"query_shape": query_shape(F.col("query")), "static": text.static_media(F.col("media"))})
    named = written(families.with_family(shaped))
    steps = written(traces.steps(named))
    place = steps.select("ref", "session", "pos", "family")
    carried = extracted(observed, records.select("ref", "side", "scalars"))
    texts = values.scanned_bodies(records.where("side = 'response'"))
    hits = values.text_hits(texts, carried.where("side = 'request'")).withColumns({"side": F.lit("response"), "part": F.lit("text"), "path": F.lit(""), "pattern": F.lit(""), "type": F.lit("string")})
    hits = hits.withColumn("low_information", text.low_information(F.col("type"), F.col("value")))
    carried = written(carried.unionByName(hits).join(place, "ref"))
    # a response is usable once it has ended, or begun where the end isn't known, or else with its request
    available = F.coalesce("end", "answered", "t")
    tied = F.coalesce(F.lag("t").over(Window.partitionBy("session").orderBy("pos")) == F.col("t"), F.lit(False))
    timed = steps.select("session", "pos", "t", available.alias("available"), tied.alias("tied"))
    sources = carried.where("side = 'response'").select("session", "pos", "value").distinct().join(timed, ["session", "pos"])
    asked = carried.where("side = 'request'").select("session", "pos", "value").distinct().join(timed.select("session", "pos", "t"), ["session", "pos"])
    flows = written(traces.value_flows(sources, asked))
    targets = navigation_steps(named).select("session", "seq", F.col("redirect_to").alias("target"))
    redirects = traces.redirect_flows(steps.select("session", "seq", "pos", "url").join(targets, ["session", "seq"]).join(timed, ["session", "pos"]))
    placed = traces.placed_flows(flows, carried).unionByName(
        redirects.withColumns({"from_part": F.lit("location"), "from_place": F.lit("Location"), "to_part": F.lit("url"), "to_place": F.lit(""), "carrier": F.lit("redirect")})
    )
    located = carried.select("value", "type", "family", "side", "part", "pattern", "ref")
    links = written(values.value_links(located))
    edges = written(traces.edges(steps))
    carriers = written(traces.flow_carriers(placed, steps, links.select("value", "low_information", "ubiquitous")))
    shown = traces.visible_flows(carriers, edges).groupBy("from", "to").agg(F.max("matches").alias("matches"))
    episodes = written(with_episodes(named, gap))
    slotted = carried.where("side = 'request' and part in ('path', 'query', 'body')")
    return {
        "families": families.families(named),
        "bodies": families.request_bodies(named),
        "slots": families.slot_stats(slotted.select("family", F.concat_ws(".", "part", "pattern").alias("location"), "value", "type", "ref")),
        "variants": families.response_variants(named, kind="response_kind", shape="response_shape"),
        "links": links,
        "occurrences": values.occurrences(located),
        "steps": steps.select("session", "pos", "ref", "t", "family", "previous", "kind"),
        "carried": carried.select("ref", "session", "pos", "family", "side", "part", "pattern", "type", "value"),
        "responses": records.where("side = 'response'").select("ref", "kind", "media", "size_class", "tree", "shape").join(place.select("ref", "family"), "ref"),
        "episodes": traces.episode_rows(episodes).join(episodes.groupBy("session", "episode").agg(F.max("trigger").alias("trigger")), ["session", "episode"]),
        "views": episodes.select("session", "episode", "seq", "family", "trigger"),
        "flows": placed,
        "edges": edges,
        "edge_flows": carriers,
        "neighbours": traces.neighbours(edges, shown),
        "evidence_links": traces.evidence_links(links),
        "contexts": traces.contexts(episodes),
        "browser": traces.browser_contexts(episodes),
    }
