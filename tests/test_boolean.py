"""The query language, rule by rule."""

import pytest

from tesserae.plans import boolean as bq

ROWS = [
    (0, "Climate change is real", "en", ["maga", "eu"], "Greta Thunberg", "http://x.org"),
    (1, "Das Klima und die Straße", "de", ["klima"], "bob", None),
    (2, "fake news about covid vaccine", "en", [], None, "http://y"),
    (3, None, None, None, "Greta", ""),
    (4, "über ber 気候変動です", "de, fr", ["x"], "anna b", "u"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "_row_idx long, text string, language string, hashtags array<string>, author_name string, url string").cache()


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("", [0, 1, 2, 3, 4]), ("climat*", [0]), ("clim", []), ('"fake news" OR klima', [1, 2]), ("covid NOT (vaccine OR mask)", []), ("covid not mask", [2]),
        ("lang:de", [1, 4]), ("lang:fr", [4]), ('author:"Greta Thunberg"', [0]), ("author:greta", [0, 3]), ("hashtag:maga NOT lang:de", [0]), ("change NEAR real", [0]),
        ("real change", [0]), ("http://x", []), ("url:http://", [0, 2]), ("lang:", [3]), ("country:", [0, 1, 2, 3, 4]), ("ber", [4]), ("STRASSE", [1]), ("気候", [4]),
        ('"change is', [0]), ("NOT NOT climate", [0]), ("climate OR klima AND und", [0, 1]), ("(climate OR klima) und", [1]), ("unknown:climate", []),
    ],
)
def test_matches(rows, query, ids):
    assert sorted(r._row_idx for r in bq.matching(rows, query).collect()) == ids


@pytest.mark.parametrize("query", ["(a", "a)", "a OR", "NOT", "()", "OR a", "a AND OR b"])
def test_errors(query):
    with pytest.raises(bq.QueryError):
        bq.parse(query)


def test_composition_and_builder(rows):
    ids = lambda n: sorted(r._row_idx for r in bq.matching(rows, n).collect())
    assert ids(bq.compose(bq.parse(""), "and", bq.parse("climate"))) == [0]
    assert ids(bq.compose(bq.parse("lang:en"), "and_not", bq.parse("climate"))) == [2]
    tree = {"op": "AND", "children": [{"field": "lang", "value": "en"}, {"op": "OR", "children": [{"field": "text", "value": "fake news"}, {"field": "author", "value": "Greta Thunberg"}]}]}
    assert ids(bq.from_tree(tree)) == [0, 2]
    assert ids(bq.from_tree({"op": "NOT", "children": [{"field": "lang", "value": "en"}, {"field": "text", "value": "covid"}]})) == [0]
    assert ids(bq.from_tree({"op": "AND", "children": []})) == [0, 1, 2, 3, 4]


def test_one_filter_reaches_the_plan(rows):
    plan = bq.matching(rows, "climate OR lang:de")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") == 1 and "Python" not in plan
