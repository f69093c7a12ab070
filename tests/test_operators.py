import random

from pyspark.sql import functions as F

from weftlens.operators import families, traces
from weftlens.operators import values as val

WORDS = ["search", "dp"]


def test_routes_fold_classes_apart(spark):
    rows = [("GET", "h", p.split("/")) for p in ("dp/1", "dp/2", "dp/3", "s/a1", "s/b2", "w/one", "w/two", "w/three", "f/a.png", "f/b.png", "f/c.png", "f/a.js", "x/1/y", "x/2/y", "x/3/z")]
    made = {"/".join(r.segments): (r.template, r.slots) for r in families.route_templates(spark.createDataFrame(rows, "method string, host string, segments array<string>")).collect()}
    assert made["dp/1"] == ("/dp/{int}", [1]) and made["s/a1"] == ("/s/a1", []) and made["w/one"] == ("/w/one", [])
    assert made["f/a.png"] == ("/f/{file:png}", [1]) and made["f/a.js"] == ("/f/a.js", []) and made["x/3/z"] == ("/x/{int}/z", [1])
    shown = spark.sql("SELECT '/a/{int}/b/{id}' AS t").select(families.display(F.col("t"))).first()[0]
    assert shown == "/a/{slot_1}/b/{slot_2}"


def brute_flows(steps):
    """Responses are read in order of availability; a response first read by its own request is lost."""
    out = []
    by_session = {}
    for s in steps:
        by_session.setdefault(s["session"], []).append(s)
    for session, mine in by_session.items():
        todo = sorted(range(len(mine)), key=lambda i: (mine[i]["available"], i))
        latest = {}
        for j, step in enumerate(mine):
            while todo and mine[todo[0]]["available"] <= step["t"]:
                i = todo.pop(0)
                if i != j:
                    for v in mine[i]["out"]:
                        latest[v] = i
            for v in step["in"]:
                if v in latest and latest[v] != j:
                    out.append((session, v, latest[v], j))
    return sorted(out)


def test_flows_equal_a_scan(spark):
    rng = random.Random(7)
    steps = []
    for s in range(30):
        t = 0
        for _ in range(12):
            t += rng.choice([0, 1, 1, 3])
            steps.append({"session": f"s{s}", "t": t, "available": t + rng.choice([0, 0, 1, 2, 6]), "in": rng.sample("abc", rng.randint(0, 2)), "out": rng.sample("abc", rng.randint(0, 2))})
    want = brute_flows(steps)
    pos, seen = {}, {}
    sources, receivers = [], []
    for step in steps:
        k = pos[step["session"]] = pos.get(step["session"], -1) + 1
        tied = seen.get(step["session"]) == step["t"]
        seen[step["session"]] = step["t"]
        sources += [(step["session"], k, step["t"], step["available"], v, tied) for v in step["out"]]
        receivers += [(step["session"], k, step["t"], v) for v in step["in"]]
    out = traces.value_flows(
        spark.createDataFrame(sources, "session string, pos long, t long, available long, value string, tied boolean"),
        spark.createDataFrame(receivers, "session string, pos long, t long, value string"),
    )
    assert sorted((r.session, r.value, r.from_pos, r.to_pos) for r in out.collect()) == want


def test_edges_count_absences(spark):
    rows = [("a", 0, 0, "X"), ("a", 1, 20, "Y"), ("a", 2, 100, "Y"), ("b", 0, 0, "Y"), ("c", 0, 0, "X"), ("c", 1, 300, "Y"), ("d", 0, 0, None), ("d", 1, 5, "X")]
    steps = traces.steps(spark.createDataFrame(rows, "session string, seq long, t long, family string"))
    found = {(r["from"], r["to"]): r for r in traces.edges(steps).collect()}
    e = found["X", "Y"]
    assert (e.ordered, e.immediate, e["without"], e.together, e.sessions) == (3, 2, 1, 3, 2)
    assert (e.least, e.median, e.most) == (20, 100, 300)
    assert found["Y", "Y"].ordered == 1 and ("Y", "X") not in found


def test_gap_is_strict(spark):
    rows = [("a", i, t, "F", t) for i, t in enumerate((1, 20, 50, 81))]
    out = traces.gap_episodes(spark.createDataFrame(rows, "session string, seq long, t long, family string, end long"), 30)
    assert [r.episode for r in out.orderBy("seq").collect()] == [0, 0, 0, 1]


def test_views_follow_a_plain_walk(spark):
    """Random sessions against a walk over the steps, one after another."""
    import random

    from weftlens.operators import navigation

    rng = random.Random(9)
    rows = []
    for s in range(30):
        t = 0
        for k in range(40):
            t += rng.choice([0, 1, 5, 31]) * 10**9
            document = rng.random() < 0.4
            rows.append((f"s{s}", k, t, rng.choice("abcd"), document, rng.choice("abcd") if document and rng.random() < 0.4 else None, rng.choice(["a", "b", "c", "x", "", None]), rng.choice(["none", "same-origin"]), rng.random() < 0.5, rng.choice(["navigate", ""])))
    want = {}
    for s in {r[0] for r in rows}:
        views, waiting, mine = [], {}, {}
        steps = [r for r in rows if r[0] == s]
        for r in steps:
            if r[4]:
                since = waiting.pop(r[3], None)
                if since and r[2] - since[1] <= navigation.REDIRECT_WINDOW:
                    views[since[0]][0], views[since[0]][2], mine[r[1]] = r[3], True, since[0]
                else:
                    mine[r[1]] = len(views)
                    views.append([r[3], r, False])
                if r[5]:
                    waiting[r[5]] = (mine[r[1]], r[2])
        begun = -1
        for r in steps:
            if r[4]:
                begun = max(begun, mine[r[1]])
            else:
                mine[r[1]] = next((v for v in range(begun, -1, -1) if r[6] and views[v][0] == r[6]), begun)
        cause = lambda v: None if v < 0 else "html" if not views[v][1][9] else "typed" if views[v][1][7] == "none" else "user" if views[v][1][8] else "redirect" if views[v][2] else "link"
        want |= {(s, k): (v, cause(v)) for k, v in mine.items()}
    df = spark.createDataFrame(rows, "session string, seq long, t long, url string, document boolean, redirect_to string, referer string, site string, user boolean, mode string")
    got = navigation.page_views(df.repartition(3)).collect()
    assert {(r.session, r.seq): (r.view, r.trigger) for r in got} == want and len(got) == len(rows)


def test_relations_with_many_values(spark):
    import itertools
    import random

    from weftlens.operators import values

    rng = random.Random(10)
    for seed in range(4):
        rows = [(f"r{k}", e, f"{e}{k // (2 + n) if e != 'd' else rng.randint(0, 3)}") for k in range(24) for n, e in enumerate("abcd") if rng.random() < 0.8]
        rows += [("r3", "c", "c-other")] if seed % 2 else []
        pairs = {}
        for x, y in itertools.permutations(set(rows), 2):
            if x[0] == y[0] and x[1] != y[1]:
                pairs.setdefault((x[1], y[1]), {}).setdefault(x[2], []).append(y[2])
        holds = {ab: sum(len(v) >= 2 for v in to.values()) for ab, to in pairs.items() if all(len(set(v)) == 1 for v in to.values())}
        want = {(a, b, n, (b, a) in holds) for (a, b), n in holds.items() if n and ((b, a) not in holds or a < b)}
        got = values.functional_relations(spark.createDataFrame(rows, "ref string, entity string, value string"))
        assert {tuple(r) for r in got.collect()} == want


def test_identity_values_and_pairs_of_slots_need_no_join_of_values(spark):
    rng = random.Random(3)
    slots, held = [f"s{k}" for k in range(6)], {(f"s{rng.randint(0, 5)}", f"ID{rng.randint(0, 60):06}") for _ in range(150)}
    values = spark.createDataFrame(sorted(held), "slot string, value string")
    got = {(r["a"], r["b"]): r["shared"] for r in val.joinable_slots(values).collect()}
    want = {(a, b): sum((a, v) in held and (b, v) in held for v in {v for _, v in held}) for a in slots for b in slots if a < b}
    assert got == {k: n for k, n in want.items() if n}
    halves = {(r["a"], r["b"]): r["even"] + r["odd"] for r in val.held_out(values, val.joinable_slots(values)).collect()}
    assert halves == got
    rows = spark.createDataFrame([("ID000001", "string", f, "request", "path", "1") for f in "fg"] + [("ID000002", "string", "f", "request", "path", "1")], "value string, type string, family string, side string, part string, pattern string")
    found = val.identity_values(rows)
    assert sorted(tuple(r) for r in found.collect()) == [("ID000001", "request.f.path.1", True), ("ID000001", "request.g.path.1", True)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_relations_are_settled_before_exchanges_meet_again(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        order = rng.randint(0, 90)
        rows += [(f"r{k}", "order", f"o{order}"), (f"r{k}", "customer", f"c{order % 7}"), (f"r{k}", "label", f"c{order % 7}!"), (f"r{k}", "part", f"p{rng.randint(0, 5)}")]
        if k % 50 == 0:
            rows += [(f"r{k}", "part", "extra")]
    out = val.functional_relations(spark.createDataFrame(rows, "ref string, entity string, value string"))
    seen = {}
    for ref, e, v in rows:
        if e == "order":
            seen.setdefault(v, set()).add(ref)
    support = sum(len(refs) >= 2 for refs in seen.values())
    assert sorted(tuple(r) for r in out.collect()) == [("customer", "label", 7, True), ("order", "customer", support, False), ("order", "label", support, False)]
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_occurrences_of_crowded_places_in_one_exchange_of_narrow_rows(spark):
    rng = random.Random(6)
    rows = [(f"v{k % 900}", "f", "request", "path", str(k % 2), f"r{rng.randint(0, 50)}") for k in range(3000)]
    rows += [("open", "f", "request", "query", "status", f"q{k}") for k in range(6000)] + [("open", "g", "request", "query", None, f"q{k % 2}") for k in range(4000)]
    rows += [("open", "f", "request", "query", "status", None), ("v1", "f", "request", "path", "1", None), ("", "f", "request", "path", "1", "r1")]
    want = {}
    for *key, ref in rows:
        if key[0]:
            want.setdefault(tuple(key), []).append(ref)
    want = {k: (len(refs), [r for r in sorted(set(refs), key=lambda r: (r is not None, r))[:3] if r is not None]) for k, refs in want.items()}
    out = val.occurrences(spark.createDataFrame(rows, "value string, family string, side string, part string, pattern string, ref string").repartition(3))
    got = out.collect()
    assert {tuple(r)[:5]: (r["count"], r.examples) for r in got} == want and len(got) == len(want)
    # values are sorted once, before they are written: no plan joins counts and examples of all of them
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def counting(df, seen):
    """df, with its rows added to an accumulator as often as they are read."""

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_evidence_reads_links_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [("ID000001", "string", f) for f in "ffg"] + [("ID000002", t, f) for t, f in (("string", "f"), ("integer", "g"), ("integer", "h"))] + [("7", "integer", f) for f in "fg"] + [("ID000003", "string", "f"), ("", "string", "f")]
    values = spark.createDataFrame(rows, "value string, type string, family string")
    links = {r["value"]: (r["count"], r.families, r.types, r.low_information) for r in val.value_links(counting(values, seen)).collect()}
    assert links == {"ID000001": (3, ["f", "g"], "string", False), "ID000002": (3, ["f", "g", "h"], "integer|string", False), "7": (2, ["f", "g"], "integer", True)}
    assert seen.value == len(rows)
    got = {(r.family, r["rank"], r["value"], r.omitted, r.hidden) for r in traces.evidence_links(val.value_links(counting(values, seen)), most=1).collect()}
    assert got == {("f", 1, "ID000002", 1, 1), ("g", 1, "ID000002", 1, 1), ("h", 1, "ID000002", 0, 0)} and seen.value == 2 * len(rows)


def test_browser_summaries_read_their_steps_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [("f", "s", 0, 5, "link", "document"), ("g", "s", 0, 9, "link", "fetch"), ("g", "s", -1, 1, None, ""), ("g", "r", 0, 3, "user", "fetch"), (None, "r", 0, 2, "user", "")]
    viewed = counting(spark.createDataFrame(rows, "family string, session string, episode int, t long, trigger string, kind string"), seen)
    got = {r.family: ([tuple(x) for x in r.triggers], r.sessions, r.episodes, r.since_trigger) for r in traces.browser_summaries(viewed).collect()}
    assert got == {"f": ([("link", 1)], 1, 1, 0), "g": ([("link", 1), ("untriggered", 1), ("user", 1)], 2, 2, 1)} and seen.value == len(rows)


def test_edges_of_many_tasks_sort_no_small_tables(spark, monkeypatch):
    rng = random.Random(8)
    steps, family = [], {}
    for s in range(12):
        for p in range(rng.randint(1, 9)):
            family[s, p] = rng.choice("abc")
            steps.append((f"s{s}", p, 10 * p + rng.randint(0, 5), family[s, p], family.get((s, p - 1))))
    df = spark.createDataFrame(steps, "session string, pos int, t long, family string, previous string")
    out = traces.edges(df)
    want = {}
    for s, p, t, to, previous in steps:
        for a in "abc":
            before = [x for x in steps if x[0] == s and x[1] < p and x[3] == a]
            if before:
                want.setdefault((a, to), []).append((t - before[-1][2], previous == a))
    want = {k: (len(v), sum(x for _, x in v), sorted(d for d, _ in v)[(len(v) - 1) // 2]) for k, v in want.items()}
    assert {(r["from"], r["to"]): (r.ordered, r.immediate, r["median"]) for r in out.collect()} == want
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(traces, "GRID_ROWS", 7)
    assert sorted(tuple(r) for r in traces.edges(df).collect()) == sorted(tuple(r) for r in out.collect())
