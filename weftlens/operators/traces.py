"""Sessions in order: steps, page views by quiet gaps, value flows, and edges between families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..lineage import beside, spread, written


def in_order() -> WindowSpec:
    return Window.partitionBy("session").orderBy("t", "seq")


def steps(observed: DataFrame) -> DataFrame:
    """Observations with pos (from 0) and the family of the last step before that has one, by session."""
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    return observed.withColumn("pos", F.row_number().over(in_order()) - 1).withColumn("previous", F.last("family", ignorenulls=True).over(before))


def gap_episodes(observed: DataFrame, gap: int) -> DataFrame:
    """Observations with episode: a new one after a pause of more than `gap`."""
    pause = F.col("t") - F.lag("t").over(in_order())
    return observed.withColumn("_new", F.when(pause > gap, 1).otherwise(0)).withColumn("episode", F.sum("_new").over(in_order())).drop("_new")


def episode_rows(with_episodes: DataFrame) -> DataFrame:
    rows = with_episodes.withColumn("pos", F.row_number().over(in_order()) - 1)
    return rows.groupBy("session", "episode").agg(
        F.min("t").alias("start"), F.max("end").alias("end"), F.min("pos").alias("first_step"), F.max("pos").alias("last_step"),
        F.count("*").alias("exchanges"), F.count_distinct("family").alias("families"),
    )


def value_flows(sources: DataFrame, receivers: DataFrame) -> DataFrame:
    """Which earlier response a request's value came from: the last one available by then that carried it.

    sources: (session, pos, t, available, value, tied) of responses, tied if an earlier step starts at t too; receivers: (session, pos, t, value) of requests.  A response
    whose first possible reader is its own request never counts.  One window over both, by session and value.
    """
    keyed = sources.select("session", "value", F.col("available").alias("at"), F.col("pos").alias("from_pos"), F.lit(None).cast("long").alias("to_pos"), F.col("t").alias("own"), "tied")
    asked = receivers.select("session", "value", F.col("t").alias("at"), F.lit(None).cast("long").alias("from_pos"), F.col("pos").alias("to_pos"), F.col("t").alias("own"), F.lit(False).alias("tied"))
    # an own request is the first reader exactly if the response takes no time and no earlier step starts in that moment
    kept = keyed.where((F.col("at") > F.col("own")) | F.col("tied"))
    rows = kept.unionByName(asked)
    order = Window.partitionBy("session", "value").orderBy("at", F.col("to_pos").isNotNull(), "from_pos", "to_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("from_pos").isNotNull(), F.struct("from_pos", "at")), ignorenulls=True).over(order)
    out = rows.withColumn("_last", last).where("to_pos is not null and _last is not null and _last.from_pos <> to_pos")
    return out.select("session", "value", F.col("_last.from_pos").alias("from_pos"), "to_pos", (F.col("at") - F.col("_last.at")).alias("delay"))


#: About so many steps x families are sorted by one task.
GRID_ROWS = 1 << 20


def lower_medians(counted: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, median): the lower median of values counted as (key, value, n); values are not negative.

    The half of each key's count is looked for among values without their last 32 bits, then without the last 16 among those
    that begin so, then among these: no step gathers more than a key's ranges of one size.  What is left to look for is a row a key, written, so values aren't sorted by key.
    """
    small = lambda df: beside(written(df))
    left = counted.groupBy(*key).agg(((F.sum("n") + 1) / 2).cast("long").alias("_k")).withColumn("_in", F.lit(0).cast("long"))
    for bits in (32, 16, 0):
        part = F.shiftright(F.col(value), bits)
        near = counted.join(small(left), key)
        if bits < 32:
            near = near.where(F.shiftright(F.col(value), bits + 16) == F.col("_in"))
        sums = near.groupBy(*key, "_k", part.alias("_part")).agg(F.sum("n").alias("_n"))
        upto = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("_sum", F.sum("_n").over(upto))
        here = sums.where((F.col("_sum") >= F.col("_k")) & (F.col("_sum") - F.col("_n") < F.col("_k")))
        left = here.select(*key, (F.col("_k") - F.col("_sum") + F.col("_n")).alias("_k"), F.col("_part").alias("_in"))
    return left.select(*key, F.col("_in").alias("median"))


def edges(stepped: DataFrame) -> DataFrame:
    """Per (from, to) of families in steps (session, pos, t, family, previous): how often `from` came before `to`, and how long before.

    ordered: steps of `to` with an earlier `from` in the session; immediate: with `from` just before; without: the other
    steps of `to` in all sessions; together: steps of `to` in sessions that have both.  Deltas are from the latest earlier `from`.
    Each step is paired with the families of its session, not with its steps: the latest earlier step of each comes
    from a running maximum, so the rows are steps x families.  Deltas are counted, never gathered.  Families are numbers until the end, and sessions
    are dealt over as many tasks as these rows need, so that no task sorts more of them as the input grows.
    """
    named = stepped.where("family is not null").select("session", "pos", "t", "family", "previous")
    ids = beside(written(named.select("family").distinct().withColumn("_id", F.monotonically_increasing_id())))
    number = lambda c, name: ids.select(F.col("family").alias(c), F.col("_id").alias(name))
    named = written(named.join(beside(number("family", "_f")), "family").join(beside(number("previous", "_p")), "previous", "left").select("session", "pos", "t", F.col("_f").alias("family"), F.col("_p").alias("previous")))
    per = written(named.groupBy("session", "family").agg(F.count("*").alias("_n")))
    size = per.groupBy("session").agg(F.sum("_n").alias("_n"), F.count("*").alias("_m")).agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0
    named = spread(named, "session", least=size // GRID_ROWS + 1)
    kinds = per.select("session", F.col("family").alias("from"))
    grid = named.join(kinds, "session")
    before = Window.partitionBy("session", "from").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_last", F.max(F.when(F.col("family") == F.col("from"), F.col("t"))).over(before))
    hits = grid.where("_last is not null")
    totals = beside(written(per.groupBy(F.col("family").alias("to")).agg(F.sum("_n").alias("to_total"))))
    pairs = per.select("session", F.col("family").alias("from"), F.col("_n").alias("_m")).join(per.select("session", F.col("family").alias("to"), "_n"), "session")
    pairs = beside(written(pairs.where("`from` <> to or _n >= 2").groupBy("from", "to").agg(F.sum("_n").alias("together"), F.count("*").alias("sessions"))))
    counted = written(
        hits.groupBy("from", F.col("family").alias("to"), (F.col("t") - F.col("_last")).alias("delta")).agg(
            F.count("*").alias("n"), F.count_if(F.col("previous") == F.col("from")).alias("immediate")
        )
    )
    out = counted.groupBy("from", "to").agg(
        F.sum("n").alias("ordered"), F.sum("immediate").alias("immediate"), F.min("delta").alias("least"), F.max("delta").alias("most")
    )
    out = out.join(lower_medians(counted, ["from", "to"], "delta"), ["from", "to"])
    out = out.join(totals, "to").join(pairs, ["from", "to"])
    for side in ("from", "to"):
        out = out.withColumnRenamed(side, "_id").join(beside(number(side, "_id")), "_id").drop("_id")
    return out.select(
        "from", "to", "ordered", "immediate", (F.col("to_total") - F.col("ordered")).alias("without"), "together", "sessions", "least", "median", "most"
    )


def edge_flows(flows: DataFrame, stepped: DataFrame) -> DataFrame:
    """Flows by (from, to) family: receivers, different values, and the share of the flows."""
    a = stepped.select("session", F.col("pos").alias("from_pos"), F.col("family").alias("from"))
    b = stepped.select("session", F.col("pos").alias("to_pos"), F.col("family").alias("to"))
    named = flows.join(a, ["session", "from_pos"]).join(b, ["session", "to_pos"])
    return named.groupBy("from", "to").agg(
        F.count_distinct(F.struct("session", "to_pos")).alias("matches"), F.count_distinct("value").alias("values"), F.min("delay").alias("least"), F.max("delay").alias("most")
    )


def placed_flows(flows: DataFrame, located: DataFrame) -> DataFrame:
    """Flows with the places of the value in the response and in the request, and the carrier.

    located: (session, pos, side, part, pattern, value) of everything that steps carry.  A cookie is the carrier where a
    response set it under the same name; a cookie from elsewhere came as a header.
    """
    here = located.select("session", "pos", "side", "part", "pattern", "value").distinct()
    source = here.where("side = 'response'").select("session", F.col("pos").alias("from_pos"), "value", F.col("part").alias("from_part"), F.col("pattern").alias("from_place"))
    target = here.where("side = 'request'").select("session", F.col("pos").alias("to_pos"), "value", F.col("part").alias("to_part"), F.col("pattern").alias("to_place"))
    rows = flows.join(source, ["session", "from_pos", "value"]).join(target, ["session", "to_pos", "value"])
    set_before = (F.col("from_part") == "set-cookie") & (F.col("from_place") == F.col("to_place"))
    part = F.col("to_part")
    carrier = F.when((part == "cookie") & set_before, "cookie").when(part.isin("cookie", "header"), "header").when(part.isin("query", "path"), part).otherwise("body")
    return rows.withColumn("carrier", carrier)


def redirect_flows(stepped: DataFrame, within: int | None = None) -> DataFrame:
    """(session, value, from_pos, to_pos, delay) of requests for the url that a response before redirected to; each redirect is used once.

    stepped: (session, pos, t, available, url, target, tied), target the absolute url of a redirecting response.  The last redirect to a url counts,
    and the first request for it takes it: by session and url, a request follows a redirect if nothing lies between them.  With `within`, a
    redirect can't be followed later than that after it was there.
    """
    sent = stepped.where("target is not null and (available > t or tied)")
    sources = sent.select("session", F.col("target").alias("value"), F.col("available").alias("at"), F.lit(0).alias("reads"), "pos")
    readers = stepped.select("session", F.col("url").alias("value"), F.col("t").alias("at"), F.lit(1).alias("reads"), "pos")
    order = Window.partitionBy("session", "value").orderBy("at", "reads", "pos")
    before = F.lag(F.struct("reads", "pos", "at")).over(order)
    # a request right after its own redirect, to its own url, doesn't take it
    rows = sources.union(readers).withColumn("_b", before).where("not coalesce(reads = 1 and _b.reads = 0 and _b.pos = pos, false)")
    rows = rows.withColumn("_b", before)
    out = rows.where("reads = 1 and _b.reads = 0").select("session", "value", F.col("_b.pos").alias("from_pos"), F.col("pos").alias("to_pos"), (F.col("at") - F.col("_b.at")).alias("delay"))
    return out if within is None else out.where(F.col("delay") <= within)


def flow_carriers(placed: DataFrame, stepped: DataFrame, flags: DataFrame, most: int = 3) -> DataFrame:
    """Flows by (from, to) family, carrier and places: receivers, different values, flags that all values have, and first examples.

    placed: placed_flows; flags: (value, low_information, ubiquitous).  Examples are values by receiver, source and value.
    """
    a = stepped.select("session", F.col("pos").alias("from_pos"), F.col("family").alias("from"))
    b = stepped.select("session", F.col("pos").alias("to_pos"), F.col("family").alias("to"))
    rows = placed.join(a, ["session", "from_pos"]).join(b, ["session", "to_pos"]).where("`from` is not null and to is not null").join(flags, "value", "left")
    key = ["from", "to", "carrier", "from_part", "from_place", "to_part", "to_place"]
    rows = rows.select(*key, "session", "from_pos", "to_pos", "value", *(F.coalesce(f, F.lit(False)).alias(f) for f in ("low_information", "ubiquitous")))
    rows = written(rows)
    stats = rows.groupBy(*key).agg(
        F.count_distinct("session", "to_pos").alias("matches"), F.count_distinct("value").alias("values"),
        F.bool_and("low_information").alias("low_information"), F.bool_and("ubiquitous").alias("ubiquitous"),
    )
    first = Window.partitionBy(*key).orderBy("session", "to_pos", "from_pos", "value")
    top = rows.select(*key, "session", "to_pos", "from_pos", "value").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most)
    listed = top.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda x: x["value"]).alias("examples"))
    return stats.join(listed, key)


def visible_flows(carriers: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Flows that evidence shows: without flags, or flagged but there in nine of ten ordered steps and twice at least."""
    rows = carriers.join(edge_rows.select("from", "to", "ordered"), ["from", "to"])
    return rows.where("not (low_information or ubiquitous) or (matches >= 2 and matches * 10 >= ordered * 9)")


def into_slots(carriers: DataFrame, routes: DataFrame) -> DataFrame:
    """Flows without those into a literal path segment, from flow_carriers and routes (family, slots): a fixed word isn't state."""
    rows = carriers.join(routes.select(F.col("family").alias("to"), "slots").distinct(), "to", "left")
    return rows.where((F.col("to_part") != "path") | F.coalesce(F.array_contains("slots", F.col("to_place").try_cast("int")), F.lit(True))).drop("slots")


def in_receiver_order(placed: DataFrame) -> DataFrame:
    """Flow instances as they are listed: by receiver, source, carrier, places and value."""
    return placed.orderBy("session", "to_pos", "from_pos", "carrier", "from_part", "from_place", "to_part", "to_place", "value")


def evidence_links(links: DataFrame, most: int = 5) -> DataFrame:
    """Each family's first `most` links without flags, from value_links: those of most families, then sightings, then by id; omitted and hidden are counted."""
    links = written(links.select("link", "value", "count", "n_families", "families", "low_information", "ubiquitous"))
    rows = links.select("link", "value", "count", "n_families", (F.col("low_information") | F.col("ubiquitous")).alias("_f"), F.explode("families").alias("family"))
    totals = rows.groupBy("family").agg(F.count_if(~F.col("_f")).alias("_n"), F.count_if("_f").alias("hidden"))
    best = Window.partitionBy("family").orderBy(F.desc("n_families"), F.desc("count"), "link")
    top = rows.where("not _f").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return top.join(totals, "family").select("family", "rank", "link", "value", "count", "n_families", F.greatest(F.lit(0), F.col("_n") - most).alias("omitted"), "hidden")


def browser_contexts(viewed: DataFrame) -> DataFrame:
    """(family, counted, name, n): how often a family's steps (family, trigger, kind) came in page views of each trigger, and with each request kind.

    Steps outside page views count as untriggered; an empty kind isn't counted.
    """
    named = viewed.where("family is not null")
    pairs = F.array(F.struct(F.lit("trigger").alias("counted"), F.coalesce("trigger", F.lit("untriggered")).alias("name")), F.struct(F.lit("kind").alias("counted"), F.col("kind").alias("name")))
    return named.select("family", F.inline(pairs)).where("name <> ''").groupBy("family", "counted", "name").agg(F.count("*").alias("n"))


def episode_members(with_episodes: DataFrame, most: int = 100) -> DataFrame:
    """(session, episode, members, families, omitted): the first `most` refs of an episode in order, its first `most` families by name, and how many refs are left out.

    Lists are cut before they are gathered, so an episode of any length is a list of bounded size.
    """
    key = ["session", "episode"]
    order = Window.partitionBy(*key).orderBy("t", "seq")
    ranked = with_episodes.select(*key, "t", "seq", "ref").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    refs = ranked.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "ref"))), lambda x: x["ref"]).alias("members"))
    named = with_episodes.where("family is not null").select(*key, "family").distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("family"))).where(F.col("_r") <= most)
    families = named.groupBy(*key).agg(F.array_sort(F.collect_list("family")).alias("families"))
    counts = with_episodes.groupBy(*key).agg(F.greatest(F.lit(0), F.count("*") - most).alias("omitted"))
    return counts.join(refs, key).join(families, key, "left").withColumn("families", F.coalesce("families", F.array().cast("array<string>")))


def browser_summaries(viewed: DataFrame) -> DataFrame:
    """Per family of steps (family, session, episode, t, trigger, kind): triggers and kinds with their counts, the largest first, sessions, episodes, and the median time since the page view began.

    There are few triggers and kinds, so their lists are short.  Times are counted, never gathered; the median is the lower one, and null where no step
    has a trigger.  Steps are written once, since several aggregates read them.
    """
    viewed = written(viewed.select("family", "session", "episode", "t", "trigger", "kind"))
    counted = browser_contexts(viewed)
    lists = counted.groupBy("family", "counted").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_o"), "name", "n"))).alias("l"))
    lists = lists.withColumn("l", F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))))
    sides = lists.groupBy("family").agg(*[F.max(F.when(F.col("counted") == c, F.col("l"))).alias(f"{c}s") for c in ("trigger", "kind")])
    named = viewed.where("family is not null")
    stats = named.groupBy("family").agg(F.count_distinct("session").alias("sessions"), F.count_distinct(F.when(F.col("trigger").isNotNull(), F.struct("session", "episode"))).alias("episodes"))
    begun = viewed.where("trigger is not null").groupBy("session", "episode").agg(F.min("t").alias("_begun"))
    since = written(named.where("trigger is not null").join(begun, ["session", "episode"]).groupBy("family", (F.col("t") - F.col("_begun")).alias("since")).agg(F.count("*").alias("n")))
    medians = lower_medians(since, ["family"], "since").withColumnRenamed("median", "since_trigger")
    return stats.join(sides, "family", "left").join(medians, "family", "left").select("family", "triggers", "kinds", "sessions", "episodes", "since_trigger")


def neighbours(edge_rows: DataFrame, flow_rows: DataFrame, most: int = 5) -> DataFrame:
    """Each family's first `most` predecessors: those with flows, then by ordered, immediate and name; with how many are left out."""
    rows = edge_rows.join(flow_rows.select("from", "to", "matches"), ["from", "to"], "left")
    best = Window.partitionBy("to").orderBy(F.col("matches").isNotNull().desc(), F.desc("ordered"), F.desc("immediate"), "from")
    every = Window.partitionBy("to")
    ranked = rows.withColumn("rank", F.row_number().over(best)).withColumn("omitted", F.greatest(F.lit(0), F.count("*").over(every) - most))
    return ranked.where(F.col("rank") <= most).select("to", "rank", "from", "ordered", "immediate", F.coalesce("matches", F.lit(0)).alias("matches"), "omitted")


def producers(flow_rows: DataFrame, most: int = 3) -> DataFrame:
    """For each receiving family the `most` families that feed it most, and how many were pruned."""
    best = Window.partitionBy("to").orderBy(F.desc("matches"), "from")
    ranked = flow_rows.withColumn("rank", F.row_number().over(best)).withColumn("pruned", F.greatest(F.lit(0), F.count("*").over(Window.partitionBy("to")) - most))
    return ranked.where(F.col("rank") <= most).select(F.col("to").alias("consumer"), F.col("from").alias("producer"), "matches", "values", "rank", "pruned")


def contexts(episodes: DataFrame) -> DataFrame:
    """Per family: in how many sessions and episodes, how often it starts one, and mean offset from the start."""
    first = Window.partitionBy("session", "episode").orderBy("t", "seq")
    rows = episodes.withColumn("_start", F.min("t").over(Window.partitionBy("session", "episode"))).withColumn("_n", F.row_number().over(first))
    return rows.groupBy("family").agg(
        F.count_distinct("session").alias("sessions"), F.count_distinct(F.struct("session", "episode")).alias("episodes"),
        F.count_if(F.col("_n") == 1).alias("starts"), F.max(F.col("t") - F.col("_start")).alias("latest"),
    )
