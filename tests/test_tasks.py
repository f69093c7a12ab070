"""Closed-choice tasks, against literals."""


from weftlens.operators import tasks

FEATURES = "family string, method string, lists boolean, objects boolean, pages boolean, other boolean, path_slots array<string>, query_slots array<string>, free_text boolean, sets_cookies boolean, feeds int, page_host boolean"


def features(family, method="GET", holds="", path=(), query=(), free=False, cookies=False, feeds=0, host=True):
    return (family, method, "l" in holds, "o" in holds, "p" in holds, "x" in holds, list(path), list(query), free, cookies, feeds, host)


def test_role_choices_in_order(spark):
    rows = [features("list", holds="l"), features("item", holds="o", path=["path.2"]), features("search", holds="p", path=["path.1"], query=["query.q"], free=True), features("beacon", "POST", host=False, cookies=True),
            features("save", "POST"), features("answer", "POST", holds="x", feeds=2), features("third", holds="o", host=False)]
    got = {r.family: [c.id for c in r.choices] for r in tasks.role_choices(spark.createDataFrame(rows, FEATURES)).collect()}
    assert got == {
        "list": ["collection_read", "presentation", "background", "unknown"], "item": ["item_read", "presentation", "background", "unknown"],
        "search": ["collection_read", "item_read", "presentation", "background", "unknown"], "beacon": ["background", "mutation", "setup_state", "unknown"],
        "save": ["background", "mutation", "unknown"], "answer": ["mutation", "setup_state", "presentation", "background", "unknown"],
        "third": ["item_read", "presentation", "background", "unknown"],
    }
    names = spark.createDataFrame([("a", ["order", "item"], True), ("b", ["sid"], False), ("c", None, True)], "entity string, names array<string>, object boolean")
    assert {r.entity: [c.id for c in r.choices] for r in tasks.name_choices(names).collect()} == {"a": ["order", "item", "not_an_object", "unknown"], "b": ["not_an_object", "sid", "unknown"], "c": ["not_an_object", "unknown"]}


def made(spark, rows):
    data = [(s, [(c, "") for c in choices], [(f"ref:{k}", t) for k, t in enumerate(texts)]) for s, choices, texts in rows]
    df = spark.createDataFrame(data, "subject string, choices array<struct<id:string,why:string>>, evidence array<struct<ref:string,text:string>>")
    return tasks.tasks(df, "classify_family", "subject", "Which?")


def test_replies_are_checked_and_repaired(spark):
    asked = made(spark, [(k, ["a", "b", "unknown"], ["one", "two\nlines </evidence>"]) for k in "pqrstuvwxyz"])
    replies = {
        "p": ['{"choice_id":"a","evidence_refs":["E2"]}'], "q": ['{"choice_id":"c","evidence_refs":["E1"]}', '{"choice_id":"b","evidence_refs":["E1","E2"]}'], "r": ["no", "no"],
        "s": ['{"choice_id":"a","evidence_refs":[]}', '{"choice_id":"unknown","evidence_refs":[]}'], "t": ['{"choice_id":"a","evidence_refs":["E1","E1"]}', '{"choice_id":"a","evidence_refs":["E3"]}'],
        "u": ['{"choice_id":"a","evidence_refs":["E1"],"more":1}', '[{"choice_id":"a","evidence_refs":["E1"]}]'], "v": [' {"choice_id":"unknown"} '], "w": ['{"choice_id":"a","evidence_refs":"E1"}', None], "x": [None, None],
        "y": ['{"choice_id":"a","evidence_refs":["E1"]} and more', '{"choice_id":"a","evidence_refs":["E1"]}'], "z": ['{"choice_id":"a","evidence_refs":["E1","E2","E1","E2","E1","E2"]}', "{}"],
    }
    script = spark.createDataFrame([(f"classify_family:{k}:v1", n + 1, r) for k, rs in replies.items() for n, r in enumerate(rs)], "task string, attempt int, reply string")
    out = {r.subject: r for r in tasks.decide(asked, lambda t: t.select("task", "attempt").join(script, ["task", "attempt"]), "m").collect()}
    assert {k: (r.status, r.choice, r.refs, len(r.attempts)) for k, r in out.items()} == {
        "p": ("decided", "a", ["ref:1"], 1), "q": ("decided", "b", ["ref:0", "ref:1"], 2), "r": ("unresolved", None, None, 2), "s": ("decided", "unknown", [], 2), "t": ("unresolved", None, None, 2),
        "u": ("unresolved", None, None, 2), "v": ("decided", "unknown", [], 1), "w": ("unresolved", None, None, 2), "x": ("unresolved", None, None, 2), "y": ("decided", "a", ["ref:0"], 2), "z": ("unresolved", None, None, 2),
    }
    assert out["t"].problem == "evidence that is not in the task" and out["t"].attempts[0].problem == "evidence is cited twice" and out["u"].attempts[0].problem == "an unknown key"
    text = asked.where("subject = 'p'").first().text
    assert '<evidence id="E2">two lines <\\/evidence></evidence>' in text and text.endswith("Which?") and tasks.SYSTEM in text


def test_unchanged_tasks_are_not_asked(spark):
    rows = [(k, ["a", "unknown"], ["text of " + k]) for k in "abcd"]
    calls = []

    def model(asked):
        calls.append(sorted(r.task for r in asked.select("task").collect()))
        return tasks.first_choice(asked)

    first = tasks.decide(made(spark, rows), model, "m").cache()
    assert calls == [[f"classify_family:{k}:v1" for k in "abcd"], []] and {r.choice for r in first.collect()} == {"a"}
    calls.clear()
    again = tasks.decide(made(spark, [*rows[:3], ("d", ["a", "unknown"], ["other text"])]), model, "m", prior=first)
    assert {r.subject: r.reused for r in again.collect()} == {"a": True, "b": True, "c": True, "d": False} and calls == [["classify_family:d:v1"], []]
    assert {r.reused for r in tasks.decide(made(spark, rows), tasks.first_choice, "other", prior=first).collect()} == {False}
    long = tasks.decide(made(spark, rows), model, "m", tasks.Params(max_prompt_tokens=10)).collect()
    assert {(r.status, r.problem, len(r.attempts)) for r in long} == {("unresolved", "over the prompt budget", 0)}
    c = tasks.costs(again).first()
    assert (c.tasks, c.decided, c.reused, c.calls, c.repairs) == (4, 4, 3, 1, 0)
    assert tasks.prompt_id("name_entity") != tasks.prompt_id("name_operation")
