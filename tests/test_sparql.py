"""Query text on a small graph."""

import pytest

from graphloom.plans import sparql


@pytest.fixture(scope="module")
def quads(spark):
    rows = [
        ("urn:e1", "urn:v#act", "flee", "g"), ("urn:e1", "urn:v#when", "1942", "g"), ("urn:e2", "urn:v#act", "hide", "g"), ("urn:e2", "urn:v#when", "1939", "g"),
        ("urn:e3", "urn:v#act", "flee", "g"), ("urn:e1", "urn:v#place", "urn:p1", "g"), ("urn:p1", "urn:v#label", "Lviv", "m"), ("urn:e1", sparql.RDF_TYPE, "urn:v#Event", "g"),
        ("urn:e1", "urn:v#act", "flee", "h"), ("urn:e2", "urn:v#act", "walk", "g"),
    ]
    return spark.createDataFrame(rows, "s string, p string, o string, g string")


def rows(text, quads, notes=None):
    return [tuple(r) for r in sparql.run("PREFIX v: <urn:v#> PREFIX xsd: <http://x#> " + text, quads, notes).collect()]


@pytest.mark.parametrize(
    "text,want",
    [
        ("SELECT ?a (COUNT(*) AS ?n) WHERE { GRAPH <g> { ?e v:act ?a } } GROUP BY ?a ORDER BY DESC(?n) ?a", [("flee", 2), ("hide", 1), ("walk", 1)]),
        ("SELECT ?e WHERE { ?e v:act 'flee' } ORDER BY ?e", [("urn:e1",), ("urn:e3",)]),
        ("SELECT ?e ?l WHERE { ?e v:act 'flee'@en . OPTIONAL { ?e v:place ?p . ?p v:label ?l } } ORDER BY ?e", [("urn:e1", "Lviv"), ("urn:e3", None)]),
        ("SELECT DISTINCT ?g WHERE { GRAPH ?g { ?e v:act 'flee' } } ORDER BY ?g", [("g",), ("h",)]),
        ("SELECT ?e WHERE { GRAPH <g> { ?e v:when ?y } FILTER(?y < 1940) }", [("urn:e2",)]),
        ("SELECT ?e WHERE { GRAPH <g> { ?e v:when ?y . FILTER(xsd:integer(?y) + 1 = 1943 && BOUND(?y)) } }", [("urn:e1",)]),
        ("SELECT ?e WHERE { { GRAPH <g> { ?e v:act 'hide' } } UNION { GRAPH <g> { ?e v:place ?p } } } ORDER BY ?e", [("urn:e1",), ("urn:e2",)]),
        ("SELECT ?e WHERE { GRAPH <g> { ?e v:act 'flee' } MINUS { GRAPH <g> { ?e v:place ?p } } }", [("urn:e3",)]),
        ("SELECT ?e WHERE { GRAPH <g> { ?e a v:Event ; v:act 'flee' , ?x . } }", [("urn:e1",)]),
        ("SELECT (GROUP_CONCAT(DISTINCT ?a ; separator='|') AS ?all) WHERE { GRAPH <g> { <urn:e2> v:act ?a } }", [("hide|walk",)]),
        ("SELECT ?a WHERE { GRAPH <g> { ?e v:act ?a } } GROUP BY ?a HAVING (COUNT(?e) > 1)", [("flee",)]),
        ("SELECT ?e WHERE { GRAPH <g> { ?e v:when ?y } } ORDER BY ?y LIMIT 1 OFFSET 1", [("urn:e1",)]),
        ("SELECT ?a WHERE { GRAPH <g> { ?e v:act ?a } FILTER(?a NOT IN ('flee', 'walk')) }", [("hide",)]),
        ("SELECT ?l WHERE { GRAPH <g> { ?e v:place ?p GRAPH <m> { ?p v:label ?l } } } # end", [("Lviv",)]),
        ("SELECT (REPLACE(STR(?e), '.*:', '') AS ?k) WHERE { VALUES (?e ?a) { (<urn:e2> 'hide') (<urn:e3> UNDEF) } GRAPH <g> { ?e v:act ?a } }", [("e2",)]),
        ("SELECT (COUNT(DISTINCT ?e) AS ?n) WHERE { GRAPH <g> { ?e v:act [] } }", [(3,)]),
    ],
)
def test_select(quads, text, want):
    assert rows(text, quads) == want


def test_ask_construct_notes(spark, quads):
    assert sparql.run("ASK { GRAPH <g> { ?e <urn:v#act> 'hide' } }", quads) is True
    assert sparql.run("ASK { ?e <urn:v#act> 'swim' }", quads) is False
    made = rows("CONSTRUCT { GRAPH <n> { ?e v:did ?a } } WHERE { GRAPH <g> { ?e v:act ?a FILTER(?a = 'hide') } }", quads)
    assert made == [("urn:e2", "urn:v#did", "hide", "n")]
    notes = spark.createDataFrame([("urn:e2", "urn:v#act", "hide", "urn:v#conf", "0.9")], "s string, p string, o string, ap string, ao string")
    assert rows("SELECT ?e ?c WHERE { << ?e v:act ?a >> v:conf ?c . FILTER(xsd:decimal(?c) > 0.5) }", quads, notes) == [("urn:e2", "0.9")]


@pytest.mark.parametrize("text", ["SELECT ?x WHERE { ?x w:y ?z }", "DESCRIBE <x>", "SELECT ?x { ?x <p> ?y . ?z <q> ?w }", "SELECT ?x WHERE { ?x <p> ?y", "SELECT ?x WHERE { OPTIONAL { ?x <p> ?y } }", "SELECT (NOPE(?x) AS ?y) { ?x <p> ?z }", "SELECT ?x { ?x ~ ?y }"])
def test_errors(quads, text):
    with pytest.raises(sparql.QueryError):
        sparql.run(text, quads)
