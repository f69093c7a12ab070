"""Declared documents: every issue of each, against a literal list."""

import json

from weftlens.sources import declared

GOOD = {"id": "shop-1", "name": "Shop", "version": 1, "evaluation": {"type": "fields", "required_fields": ["price"], "normalizers": {"price": {"numeric_tolerance": 0.5}}}}


def found(spark, documents, declaration, **more):
    df = spark.createDataFrame([(n, t if isinstance(t, str) or t is None else json.dumps(t)) for n, t in documents], "name string, text string")
    rows = declared.read(df, declaration).cache()
    values = {r.name: json.loads(r.value) for r in rows.collect() if r.kind == "value"}
    return values, {(r.name, r.path, r.issue) for r in declared.issues(rows, **more).collect()}


def test_scenarios(spark):
    bad = {
        "id": "Shop 1", "name": "  ", "version": 0, "owner": "me", "har": "../x.har", "goal": "/etc/x", "tags": ["a", 1],
        "evaluation": {"type": "judge", "required_fields": ["a", "", "a"], "normalizers": {"b": {"case": "title", "whitespace": "none", "numeric_tolerance": -1, "url": "yes", "extra": 1}}},
        "limits": {"generate": {"max_steps": 0, "timeout_seconds": 1.5}, "answer": {"max_tokens": -1}},
    }
    values, issues = found(spark, [("good", GOOD), ("same", GOOD), ("bad", bad), ("text", "{nothing"), ("none", None), ("list", [1])], declared.SCENARIO, across=("id",))
    v = values["good"]
    assert v["har"] == "session.har" and v["limits"] == {"answer": {"max_steps": 20, "timeout_seconds": 90, "max_tokens": 0}, "generate": {"max_steps": 200, "timeout_seconds": 600, "max_tokens": 0}} and v["evaluation"]["allow_extra_fields"] is True
    assert {i[1:] for i in issues if i[0] == "bad"} == {
        ("id", f"'Shop 1' doesn't match {declared.ID}"), ("name", "is empty"), ("version", "is less than 1"), ("owner", "is not known"), ("har", "'../x.har' lies outside the folder"),
        ("goal", "'/etc/x' lies outside the folder"), ("tags[1]", "must be text"), ("evaluation.type", "'judge' is not one of fields"), ("evaluation.required_fields[1]", "is empty"),
        ("evaluation.required_fields[2]", "'a' is listed twice"), ("evaluation.normalizers.b", "is not a required field"), ("evaluation.normalizers.b.case", "'title' is not one of lower, upper"),
        ("evaluation.normalizers.b.whitespace", "'none' is not one of trim, collapse"), ("evaluation.normalizers.b.numeric_tolerance", "is less than 0"), ("evaluation.normalizers.b.url", "must be true or false"),
        ("evaluation.normalizers.b.extra", "is not known"), ("limits.generate.max_steps", "is less than 1"), ("limits.generate.timeout_seconds", "must be a whole number"), ("limits.answer.max_tokens", "is less than 0"),
    }
    assert {i for i in issues if i[0] in ("good", "same")} == {("same", "id", "id shop-1 is also in good")}
    assert {i[:2] for i in issues if i[0] in ("text", "none")} == {("text", ""), ("none", "")} and {i for i in issues if i[0] == "list"} == {("list", "", "must be an object")}
    assert "text" not in values
    empty = found(spark, [("e", {})], declared.SCENARIO)[1]
    assert {i[1:] for i in empty} == {("id", "is required"), ("name", "is required"), ("version", "is required"), ("evaluation.type", "is required"), ("evaluation.required_fields", "needs at least 1")}


def test_registries(spark):
    models = [{"id": "m", "adapter": "fake", "replies": ["x"]}, {"id": "m", "adapter": "llama", "model_path": "p", "seed": 3}, {"id": "n", "adapter": "llama", "replies": ["x"], "temperature": 3}, {"adapter": "other", "threads": 2, "context_size": -1}, {"id": "o", "adapter": "fake"}]
    _, issues = found(spark, [("r", {"models": models}), ("empty", {"models": []}), ("none", {})], declared.REGISTRY)
    assert {i[1:] for i in issues if i[0] == "r"} == {
        ("models[1].id", "'m' is used twice"), ("models[2].model_path", "is required"), ("models[2].replies", "is for the fake adapter only"), ("models[2].temperature", "is more than 2"), ("models[3].id", "is required"),
        ("models[3].adapter", "'other' is not one of fake, llama"), ("models[3].threads", "is for the llama adapter only"), ("models[3].context_size", "is less than 0"), ("models[3].context_size", "is for the llama adapter only"),
        ("models[4].replies", "needs at least 1"),
    }
    assert {i for i in issues if i[0] != "r"} == {("empty", "models", "needs at least 1"), ("none", "models", "is required")}


def test_descriptions_refer_to_what_is_there(spark):
    d = {
        "case": "c", "evidence": "run-1", "roles": {"search": ["f1", "f9"], "detail": ["f1"]}, "entities": [{"name": "Item", "identity": ["f1#request.path.2", "f1#request.path.7"], "relations": [{"kind": "has", "target": "Offer"}]}],
        "operations": [{"name": "o", "role": "search", "families": ["f2"], "outputs": [{"entity": "Item"}, {"entity": "Shop"}]}], "prerequisites": {"consumers": ["f3"], "accept": [{"carrier": "cookie", "kinds": []}]},
    }
    known = spark.createDataFrame([("family", "f1"), ("family", "f2"), ("slot", "f1#request.path.2"), ("run", "run-1")], "space string, ref string")
    values, issues = found(spark, [("d", d)], declared.DESCRIPTION, known=known)
    assert {i[1:] for i in issues} == {
        ("roles.search[1]", "unknown family f9"), ("roles.search", "family f1 is labelled detail too"), ("entities[0].identity[1]", "unknown slot f1#request.path.7"), ("entities[0].relations[0].target", "unknown entity Offer"),
        ("operations[0].outputs[1].entity", "unknown entity Shop"), ("prerequisites.consumers[0]", "unknown family f3"), ("prerequisites.accept[0].kinds", "needs at least 1"),
    }
    assert values["d"]["operations"][0]["outputs"][0] == {"entity": "Item", "many": False}


def test_yaml(spark):
    text = "id: a\nname: A\nversion: 1\nevaluation: {type: fields, required_fields: [x]}\n"
    try:
        import yaml  # noqa: F401
    except ImportError:
        assert {i[1] for i in found(spark, [("y", text)], declared.SCENARIO)[1]} == {""}
    else:
        assert found(spark, [("y", text)], declared.SCENARIO)[1] == set()


def test_a_small_file_of_documents_is_walked_by_all_tasks(spark):
    rows = spark.range(40).selectExpr("concat('d', id) AS name", "'{}' AS text").coalesce(1)
    found = declared.read(rows, declared.SCENARIO)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert found.where("kind = 'value'").select("name").distinct().count() == 40
