"""Matching and scores against plain loops over small descriptions."""

import random
from collections import Counter

from pyspark.sql import functions as F

from weftlens.operators import scoring, semantics


def tables(spark, seed):
    rng = random.Random(seed)
    slots, fams, fields = [f"s{k}" for k in range(14)], [f"f{k}" for k in range(12)], list("abcdef")
    e = {
        "roles": [("r", f, rng.choice(["search", "detail", "background"])) for f in fams[:9]],
        "entities": [("r", f"E{k}", k, [f"e{k}", "thing"]) for k in range(5)],
        "identity": [("r", f"E{k}", s) for k in range(3) for s in slots[4 * k : 4 * k + 3]],
        "not_identity": [("r", "s12")],
        "fields": [("r", f"E{k}", x) for k in (0, 2, 3, 4) for x in rng.sample(fields, 3)],
        "relations": [("r", "E0", "has", "E1"), ("r", "E1", "has", "E2")],
        "operations": [("r", f"O{k}", k, rng.choice(["search", "detail"])) for k in range(4)],
        "families": [("r", f"O{k}", f) for k in range(4) for f in fams[2 * k : 2 * k + 2]],
        "inputs": [("r", f"O{k}", rng.choice(slots)) for k in range(4)],
        "outputs": [("r", f"O{k}", f"E{k}", True) for k in range(3)],
    }
    ids = [f"x{k}" for k in range(8)]
    ops = [f"o{k}" for k in range(7)]
    f = {
        "roles": [("r", x, rng.choice(["search", "detail", ""]), rng.choice(["reviewed", "proposed"]), k) for k, x in enumerate(fams * 2)],
        "entities": [("r", i, 100 - k, rng.choice(["Thing", "E1", "none"])) for k, i in enumerate(ids)],
        "identity": [("r", i, s, rng.choice(fams)) for i in ids[:6] for s in sorted(rng.sample(slots, rng.randint(0, 3)))],
        "fields": [("r", i, x, [rng.choice(fams)]) for i in ids for x in rng.sample(fields, rng.choice([0, 3, 3]))],
        "relations": [("r", a, "has", b) for a in ids for b in ids if rng.random() < 0.2],
        "operations": [("r", i, k, rng.choice(["search", "detail"])) for k, i in enumerate(ops)],
        "families": [("r", i, x) for i in ops for x in sorted(rng.sample(fams, rng.randint(1, 3)))],
        "inputs": [("r", i, s) for i in ops for s in rng.sample(slots, 2)],
        "outputs": [("r", i, rng.choice([*ids, None]), rng.random() < 0.6) for i in ops for _ in range(2)],
    }
    se = {"roles": "family string, role string", "entities": "entity string, place long, names array<string>", "identity": "entity string, ref string", "not_identity": "ref string", "fields": "entity string, field string", "relations": "entity string, kind string, target string", "operations": "operation string, place long, role string", "families": "operation string, family string", "inputs": "operation string, slot string", "outputs": "operation string, entity string, many boolean"}
    sf = {"roles": "family string, role string, status string, place long", "entities": "id string, place long, name string", "identity": "id string, ref string, family string", "fields": "id string, field string, families array<string>", "relations": "id string, kind string, target string", "operations": "id string, place long, role string", "families": "id string, family string", "inputs": "id string, slot string", "outputs": "id string, entity string, many boolean"}
    frames = lambda data, schemas: {k: spark.createDataFrame(data[k], "run string, " + s) for k, s in schemas.items()}
    return e, f, scoring.Expected(**frames(e, se)), scoring.Found(**frames(f, sf))


def groups(rows, key, value):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r[value])
    return out


def jaccard(a, b):
    return len({*a} & {*b}) / len({*a} | {*b}) if {*a} | {*b} else 0


def brute(e, f):
    """(measure: (correct, predicted, expected)), and what each found entity and operation matches."""
    role = {x[1]: x[2] for x in e["roles"]}
    have = {}
    for _, family, r, status, _ in sorted(f["roles"], key=lambda r: r[4]):
        if status == "reviewed":
            have[family] = r
    out = {"roles": (sum(have.get(x) == r for x, r in role.items()), sum(bool(have.get(x)) for x in role), len(role))}
    ei, fi = groups(e["identity"], 1, 2), groups(f["identity"], 1, 2)
    ef, ff = groups(e["fields"], 1, 2), groups(f["fields"], 1, 2)
    owner = {r: n for n, refs in ei.items() for r in refs}
    known = {*owner, *(x[1] for x in e["not_identity"])}
    pairs = {(a, b) for refs in fi.values() for a in refs for b in refs if a < b and a in known and b in known}
    out["identity_joins"] = (sum(owner.get(a) == owner.get(b) is not None for a, b in pairs), len(pairs), sum(len(r) * (len(r) - 1) // 2 for r in ei.values()))

    def take(found, weigh, wanted):
        """name of each found thing, and which take it"""
        chosen = {}
        for i in found:
            best = max(((weigh(i, n), -k, n) for k, n in enumerate(wanted)), default=(0, 0, None))
            if best[0] > 0:
                chosen[i] = (best[2], best[0])
        taken = {}
        for i in sorted(chosen, key=lambda i: (-chosen[i][1], found.index(i))):
            taken.setdefault(chosen[i][0], i)
        return {i: n for i, (n, _) in chosen.items()}, taken

    ents = [x[1] for x in sorted(f["entities"], key=lambda x: x[2])]

    def weigh(i, n):
        w = len({*fi.get(i, [])} & {*ei.get(n, [])})
        if not w and not fi.get(i) and not ei.get(n):
            j = jaccard(ff.get(i, []), ef.get(n, []))
            w = j if j >= 0.5 else 0
        return w

    names, taken = take(ents, weigh, [x[1] for x in e["entities"]])
    scored = dict(names)
    for i in ents:
        made = {x[3] for x in f["identity"] if x[1] == i} | {y for x in f["fields"] if x[1] == i for y in x[3]}
        if i not in names and ({*fi.get(i, [])} & {x[1] for x in e["not_identity"]} or (made and all(role.get(y) == "background" for y in made))):
            scored[i] = ""
    out["entities"] = (len(taken), len(scored), len(e["entities"]))
    label, accept = {x[1]: x[3] for x in f["entities"]}, {x[1]: x[3] for x in e["entities"]}
    out["entity_names"] = (sum(label[i].lower() in [a.lower() for a in accept[n]] for n, i in taken.items()), len(taken), len(taken))
    out["entity_fields"] = tuple(map(sum, zip(*[(len({*ff.get(taken.get(n), [])} & {*want}), len(ff.get(taken.get(n), [])), len(want)) for n, want in ef.items()])))
    rel = {(scored[a], k, scored[b]) for _, a, k, b in f["relations"] if a in scored and b in scored}
    want = {x[1:] for x in e["relations"]}
    out["relations"] = (len(rel & want), len(rel), len(want))

    eo, fo = groups(e["families"], 1, 2), groups(f["families"], 1, 2)
    ops = [x[1] for x in f["operations"]]
    onames, otaken = take(ops, lambda i, n: jaccard(fo[i], eo[n]) if 2 * len({*fo[i]} & {*eo[n]}) >= len(fo[i]) else 0, [x[1] for x in e["operations"]])
    oscored = {*onames, *(i for i in ops if all(x in role for x in fo[i]))}
    wants, has = {x[1]: x[3] for x in e["operations"]}, {x[1]: x[3] for x in f["operations"]}
    out["operations"] = (sum(has[i] == wants[n] for n, i in otaken.items()), len(oscored), len(wants))
    inside = {x: n for n, xs in eo.items() for x in xs}
    two = lambda n: n * (n - 1) // 2
    mine = {i: [inside[x] for x in fo[i] if x in inside] for i in ops}
    out["operation_merges"] = (sum(two(n) for m in mine.values() for n in Counter(m).values()), sum(two(len(m)) for m in mine.values()), sum(two(len(x)) for x in eo.values()))
    ein, fin = groups(e["inputs"], 1, 2), groups(f["inputs"], 1, 2)
    ins = [(sum(s in ein.get(n, []) for s in fin.get(otaken.get(n), [])), len(fin.get(otaken.get(n), [])), len({*ein.get(n, [])})) for n in wants]
    out["required_inputs"] = tuple(map(sum, zip(*ins)))
    given = {(n, scored[x[2]], x[3]) for n, i in otaken.items() for x in f["outputs"] if x[1] == i and x[2] in scored}
    eout = {x[1:] for x in e["outputs"]}
    out["outputs"] = (len(given & eout), len(given), len(eout))
    out["unscored"] = (0, len(ents) - len(scored) + len(ops) - len(oscored), 0)
    return {k: v for k, v in out.items() if any(v)}, (scored, {*taken.values()}), (onames, {*otaken.values()})


def test_scores_against_loops(spark):
    for seed in range(3):
        e, f, expected, found = tables(spark, seed)
        want, ents, ops = brute(e, f)
        me, mo = scoring.match_entities(expected, found).cache(), scoring.match_operations(expected, found).cache()
        assert {r.id: r.entity or "" for r in me.collect() if r.scored} == ents[0] and {r.id for r in me.collect() if r.taken} == ents[1]
        assert {r.id: r.operation for r in mo.collect() if r.operation} == ops[0] and {r.id for r in mo.collect() if r.taken} == ops[1]
        got = {r.measure: (r.correct, r.predicted, r.expected) for r in scoring.scores(expected, found, me, mo).collect()}
        assert {k: v for k, v in got.items() if any(v)} == want
        lost = {(r.what, r.expected) for r in scoring.mistakes(expected, me, mo).collect() if "not found" in r.what}
        assert {n for w, n in lost if w.startswith("entity")} == {x[1] for x in e["entities"]} - {ents[0][i] for i in ents[1]}


def test_prerequisites_and_abstention(spark):
    p = [("r", "1", "search", "proposed", "cookie", "c", "p"), ("r", "2", "search", "rejected", "cookie", "c", "p"), ("r", "3", "background", "proposed", "cookie", "c", "p"), ("r", "4", "unknown", "proposed", "cookie", "c", "p"),
         ("r", "5", "search", "proposed", "query", "c", "p"), ("r", "6", "search", "proposed", "query", "c", "q"), ("r", "7", "search", "proposed", "query", "other", "q"), ("r", "8", None, "proposed", "query", "c", "q")]
    rows = spark.createDataFrame(p, "run string, id string, kind string, status string, carrier string, consumer string, producer string")
    accepted = spark.createDataFrame([("r", "cookie", None, ["search"]), ("r", "query", ["p", "z"], ["search", "detail"])], "run string, carrier string, producers array<string>, kinds array<string>")
    r = scoring.prerequisite_scores(rows, spark.createDataFrame([("r", "c")], "run string, family string"), accepted).first()
    assert (r.predicted, r.false_positives, r.background, r.rate) == (3, 1, 1, 0.333)
    d = [("r", "rule", "x", "unknown", "classify_family", "a"), ("r", "m", "unresolved", "", "classify_family", "a"), ("r", "m", "resolved", "unknown", "classify_family", "b"), ("r", "m", "resolved", "search", "classify_family", "a"), ("r", "m", "resolved", "unknown", "name", "a")]
    rows = spark.createDataFrame(d, "run string, model string, status string, choice string, type string, family string")
    r = scoring.abstentions(rows, spark.createDataFrame([("r", "a", "search")], "run string, family string, role string")).first()
    assert (r.tasks, r.unknown, r.unresolved, r.on_labelled, r.rate) == (4, 2, 1, 1, 0.75)


def test_best_matches_take_and_split(spark):
    e = spark.createDataFrame([("A", i) for i in "wxyz"] + [("B", i) for i in "pq"], "name string, item string")
    f = spark.createDataFrame([(1, i) for i in "wxy"] + [(2, i) for i in "wxyz"] + [(3, i) for i in "pk"] + [(4, i) for i in "pq"], "id long, item string")
    got = {(r.id, r.name, round(r.overlap, 2), r.taken) for r in semantics.best_matches(e, f).collect()}
    assert got == {(1, "A", 0.75, False), (2, "A", 1.0, True), (4, "B", 1.0, True)}


def test_pairs_together_are_counted_from_classes_of_slots(spark):
    rng = random.Random(5)
    held = {(run, i, ref) for run in "xy" for i in range(8) for ref in rng.sample(range(40), 9)}
    owner = {(run, ref): rng.choice(["p", "q", None]) for run in "xy" for ref in range(40)}
    slots = spark.createDataFrame([(run, f"i{i}", f"r{ref:02}", owner[run, ref]) for run, i, ref in sorted(held)], "run string, id string, ref string, _owner string")
    got = {r["run"]: (r["c"], r["p"]) for r in scoring._pairs_together(slots).groupBy("run").agg(F.sum("_c").alias("c"), F.sum("_p").alias("p")).collect()}
    for run in "xy":
        pairs = {(a, b) for r1, i, a in held for r2, j, b in held if r1 == r2 == run and i == j and a < b}
        assert got[run] == (sum(owner[run, a] is not None and owner[run, a] == owner[run, b] for a, b in pairs), len(pairs))


def test_a_large_id_makes_no_pairs(spark):
    slots = spark.range(200_000).select(F.lit("x").alias("run"), F.lit("i").alias("id"), F.col("id").cast("string").alias("ref"), F.lit("p").alias("_owner"))
    sums = scoring._pairs_together(slots).agg(F.sum("_c"), F.sum("_p")).first()
    assert tuple(sums) == (200_000 * 199_999 // 2,) * 2
