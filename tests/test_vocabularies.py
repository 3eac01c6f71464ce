"""Turtle files, vocabularies from them, prompts, and contradictions as classes."""

import random

import pytest
from pyspark.sql import functions as F

from quadloom.operators import conflicts, evidence, extraction, prompts, quads
from quadloom.plans import ontology
from quadloom.plans.ontology import uri
from quadloom.sources import formats, turtle

RDF, XSD = turtle.RDF, turtle.XSD


def test_turtle_syntax():
    text = r'''
    @prefix : <http://e/> . @base <http://b/x> .
    PREFIX k: <http://k/>
    # a comment
    :a a k:T , <y> ; k:p "one", 'two'@en-GB, """long "quoted"
line""", '''.rstrip() + " '''it''s''' " + r'''; k:q 1, -2.5, 3e4, true ; .
    <#f> k:n [ k:in "q\té" ; k:deep [] ] .
    _:n1 k:list ( 1 :b "c"^^k:d ) .
    [] k:x k:y\,z .
    [ k:alone 'x' ] .
    k:a.b k:é% .
    '''.replace("k:a.b k:é% .", "k:a.b k:é k:%41 .")
    got = turtle.parse_turtle(text, "f")
    t = {(s, p, o) for s, p, o, *_ in got}
    assert {("http://e/a", RDF + "type", "http://k/T"), ("http://e/a", RDF + "type", "http://b/y"), ("http://b/x#f", "http://k/n", "_:f.1"), ("_:f.1", "http://k/in", "q\té"), ("_:f.1", "http://k/deep", "_:f.2"), ("http://k/a.b", "http://k/é", "http://k/%41")} <= t
    kinds = {o: (kind, d, lang) for s, _, o, kind, d, lang in got if s == "http://e/a"}
    assert kinds["two"] == ("literal", RDF + "langString", "en-GB") and kinds['long "quoted"\nline'][1] == XSD + "string" and kinds["it''s"][0] == "literal"
    assert [kinds[x][1] for x in ("1", "-2.5", "3e4", "true")] == [XSD + x for x in ("integer", "decimal", "double", "boolean")]
    assert ("_:f.n1", "http://k/list", "_:f.3") in t and sum(p == RDF + "first" for _, p, _ in t) == 3 and sum(o == RDF + "nil" for _, _, o in t) == 1
    assert any(p == "http://k/x" and o == "http://k/y,z" for _, p, o in t) and any(p == "http://k/alone" for _, p, _ in t)
    assert turtle.parse_turtle("", "f") == []


@pytest.mark.parametrize("text", ["<a> <b>", "<a> <b> <c>", "k:a <b> <c> .", '"x" <b> <c> .', "<a> <b> <c> ; ; , .", "@prefix x <y> .", '<a> <b> "open .', "<a> 1 2 ."])
def test_what_is_not_turtle(text):
    with pytest.raises(ValueError, match="line 1"):
        turtle.parse_turtle(text, "f")


def test_files_dropped_in(spark, tmp_path):
    head = f"@prefix ks: <{ontology.SCHEMA_NS}> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
    (tmp_path / "base.ttl").write_text(head + 'ks:eats a ks:Predicate ; rdfs:label "eats" ; ks:domain "base" ; ks:synonym "Feeds on", "devours" ; ks:oppositePredicate ks:avoids ; ks:transitivePredicate true .')
    (tmp_path / "bad.ttl").write_text("this is not it .")
    (tmp_path / "notes.txt").write_text("<a> <b> <c> .")
    none = spark.createDataFrame([], "s string, p string, o string")
    load = lambda graph: ontology.bootstrap(turtle.read_turtle(spark, str(tmp_path)), graph)
    graph = load(none)
    assert graph.count() == 7 + 2 and load(graph).isEmpty()
    errors = turtle.read_turtle(spark, str(tmp_path)).where("error IS NOT NULL").collect()
    assert [(r.file.rsplit("/")[-1], r.s) for r in errors] == [("bad.ttl", None)]
    (tmp_path / "more.ttl").write_text(head + 'ks:avoids a ks:Predicate ; rdfs:label "avoids" ; ks:domain "animals" ; ks:materialityWeight "0.9" ; ks:synonym "devours" .\nks:holds ks:inversePredicate ks:held_by .')
    graph = graph.unionByName(load(graph))
    known = ontology.vocabulary(graph)
    assert {tuple(r) for r in known.predicates.collect()} == {(uri("eats"), "eats", "base", 0.5, True), (uri("avoids"), "avoids", "animals", 0.9, False)}
    assert {tuple(r) for r in known.synonyms.collect()} == {("eats", uri("eats")), ("avoids", uri("avoids")), ("feeds_on", uri("eats")), ("devours", uri("avoids"))}
    assert {tuple(r) for r in known.opposites.collect()} == {(uri("eats"), uri("avoids")), (uri("avoids"), uri("eats"))}
    assert known.inverses.count() == 2 and {r.predicate for r in known.functional.collect()} == {uri("amount"), uri("currency")} and known.transitive.first().predicate == uri("eats")


def test_prompts(spark, tmp_path):
    chunks = spark.createDataFrame([("c", 0, "x{y}" * 2000, "T", "web", ["a", "b"]), ("c", 1, None, None, "", [])], "content_id string, chunk_index int, chunk_text string, title string, source_type string, entities array<string>")
    mentions = spark.createDataFrame([("c", 0, 2, "Rome", "GPE"), ("c", 0, 1, "Ann", "PERSON")], "content_id string, chunk_index int, pos int, text string, label string")
    hinted = prompts.with_hints(chunks, mentions)
    (tmp_path / "base_entities.txt").write_text("E {{}} {context}|{text}")
    (tmp_path / "health_relations.txt").write_text("H {entities} / {predicates} / {text}{context}")
    held = prompts.templates(spark, str(tmp_path))
    assert sorted(held) == ["base_entities", "health_relations"]
    text = lambda df: [r.prompt for r in df.orderBy("chunk_index").collect()]
    one, two = text(prompts.prompts(hinted, "entities", held=held, domains=["health"]))
    hints = "\nNLP-detected entities (confirm, correct, or add to these):\n- Ann (PERSON)\n- Rome (GPE)\n"
    assert one == "E {} Title: T\nSource type: web\n" + hints + "|" + ("x{y}" * 2000)[:4000] and two == "E {} |"
    known = ontology.predicates(spark)
    one, _ = text(prompts.prompts(hinted, "relations", held=held, domains=["base", "health"], predicates=known, most_chars=3))
    assert one.startswith("H a, b / ") and one.endswith(" / x{y") and "treats" in one and "written in" not in one and one.index("causes") < one.index("treats")
    one, _ = text(prompts.prompts(hinted, "combined", held=held, predicates=known))
    assert "written in" in one and one.startswith("List the entities") and '{"entities": [], "relations": []}' in one and "Title: T" in one
    assert prompts.chosen("relations", held, ["technology"]) == (prompts.DEFAULTS["relations"], False)
    with pytest.raises(ValueError, match="kind"):
        prompts.prompts(chunks, "poems")
    with pytest.raises(ValueError, match="no field odd"):
        prompts.filled("{odd}", text=F.lit(""))


def test_contradiction_classes(spark):
    r = random.Random(2)
    rows = [("hot", "p", f"v{r.randrange(300)}", round(r.random(), 3)) for _ in range(900)] + [(f"s{k % 7}", "p", f"v{k}", 0.5) for k in range(12)] + [("one", "p", "v", 0.4), ("one", "p", "v", 0.6), ("null", "p", "a", None), ("null", "p", "b", 0.1)]
    df = spark.createDataFrame(rows, "s string, p string, o string, confidence double")
    best = {}
    for s, _, o, c in rows:
        if c is not None:
            best.setdefault(s, {})[o] = max(c, best.get(s, {}).get(o, 0))
    many = {s: v for s, v in best.items() if len(v) > 1}
    got = {x.s: x for x in conflicts.value_classes(df, top=4).collect()}
    assert {s: (x.n_values, x.n_pairs, [tuple(b) for b in x.best]) for s, x in got.items()} == {s: (len(v), len(v) * (len(v) - 1) // 2, sorted(v.items(), key=lambda i: (-i[1], i[0]))[:4]) for s, v in many.items()}
    classes = conflicts.value_classes(df).where("s <> 'hot'")
    pairs = sorted((x.s, x.o1, x.o2) for x in conflicts.pairs_of(classes, df).collect())
    assert pairs == sorted((s, a, b) for s, v in many.items() if s != "hot" for a in v for b in v if a < b)


def test_provenance_rows_and_point_reads(spark):
    triples = spark.createDataFrame([("h1", "a"), ("h2", "b")], "triple_hash string, s string")
    p = spark.createDataFrame([("h1", 1, "u1", "t", "x", 0.1), ("h1", 3, "u2", "t", "x", 0.2), ("h1", 2, "u3", "t", "x", 0.3)], "triple_hash string, ingested_at int, source_url string, source_type string, extractor string, confidence double")
    assert [r.source_url for r in evidence.provenance_rows(triples, p).collect()] == ["u2", "u3", "u1", None]
    assert [x.source_url for x in evidence.with_provenance(triples, p, newest_first=True).where("triple_hash = 'h1'").first().provenance] == ["u2", "u3", "u1"]
    assert [r.s for r in quads.by_hash(triples, "h2", "h9").collect()] == ["b"]
    assert quads.by_hashes(triples, spark.createDataFrame([("h1",), ("h1",), ("h7",)], "triple_hash string")).count() == 1
    assert quads.by_uri(spark.createDataFrame([("u",), ("v",)], "uri string"), "v", "w").count() == 1


def test_items_as_objects_and_bad_lines(spark, tmp_path):
    answer = '{"entities": {"0": {"uri": "x", "label": "X", "rdf_type": "T"}, "1": {"uri": "y", "label": "Y", "rdf_type": "T"}}, "relations": "none"}'
    got = extraction.items_of(spark.createDataFrame([("c", answer)], "content_id string, answer string")).collect()
    assert [(r.subject, r.shape) for r in got] == [("x", "entity"), ("y", "entity")]
    (tmp_path / "claims.jsonl").write_text('{"source_url": "u", "knowledge": [{"subject": "a", "predicate": "p", "object": "b"}]}\noops\n')
    rows = formats.read_claims(spark, str(tmp_path / "claims.jsonl")).collect()
    assert sorted((r.source_url or "", r.error or "") for r in rows) == [("", "oops"), ("u", "")]
    (tmp_path / "many.json").write_text('[\n {"k": 1},\n {"k": 2}\n]')
    assert sorted(r.k for r in formats.read_requests(spark, str(tmp_path / "many.json"), "k int", whole=True).collect()) == [1, 2]


def _generated(node) -> list[int]:
    """Rows that each Generate of an executed plan made."""
    name = node.nodeName()
    below = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
    own = [node.metrics().apply("numOutputRows").value()] if name == "Generate" else []
    return own + [n for x in below for n in _generated(x)]


def test_pairs_of_small_classes_are_not_copied(spark, monkeypatch):
    rows = [("g", f"s{i}", "p", f"v{j}", 0.5) for i in range(50) for j in range(3)] + [("g", "hot", "p", f"w{j:02}", 0.5) for j in range(40)]
    df = spark.createDataFrame(rows, "graph string, s string, p string, o string, confidence double")
    every = sorted([(f"s{i}", f"v{a}", f"v{b}") for i in range(50) for a in range(3) for b in range(a + 1, 3)] + [("hot", f"w{a:02}", f"w{b:02}") for a in range(40) for b in range(a + 1, 40)])
    pairs = conflicts.pairs_of(conflicts.value_classes(df), df)
    assert sorted((x.s, x.o1, x.o2) for x in pairs.collect()) == every
    assert sum(_generated(pairs._jdf.queryExecution().executedPlan())) <= len(rows)
    # A large class has several keys, a small one still one.
    monkeypatch.setattr(conflicts, "KEY_VALUES", 10)
    pairs = conflicts.pairs_of(conflicts.value_classes(df), df)
    assert sorted((x.s, x.o1, x.o2) for x in pairs.collect()) == every
    assert sum(_generated(pairs._jdf.queryExecution().executedPlan())) == 150 + 4 * 40
