import pytest

from tessera.errors import FilterSyntaxError
from tessera.functions import filters

ROWS = [(1, "a", 5, 1.5, True), (2, "b'c", 10, None, False), (3, None, None, 2.5, None), (4, "A", 7, -1.0, True)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, name string, n int, x double, flag boolean")


@pytest.mark.parametrize(
    "text, ids",
    [
        ("n = 5", {1}), ("n != 5", {2, 4}), ("n <> 5", {2, 4}), ("n >= 7", {2, 4}), ("NOT n = 5", {2, 4}), ("n in (5, 7)", {1, 4}), ("n NOT IN (5, 7)", {2}),
        ("n between 5 and 7", {1, 4}), ("n not between 5 and 7", {2}), ("name = 'b''c'", {2}), ("name = null", {3}), ("name != NULL", {1, 2, 4}), ("n > null", set()),
        ("flag = true AND n < 6 OR x = 2.5", {1, 3}), ("flag = true AND (n < 6 OR x = 2.5)", {1}), ("NOT flag = true AND n = 10", {2}), ("NOT (flag = true OR n = 10)", set()),
        ("n = '5'", set()), ("name = 5", set()), ("x = -1", {4}), ("x > 1e0", {1, 3}), ("n in (5, null)", {1}), ("n not in (5, null)", set()), ("n in ('a', 5)", {1}), ("  n=5  ", {1}),
    ],
)
def test_columns(rows, text, ids):
    assert {r.id for r in filters.apply(rows, text).collect()} == ids


@pytest.mark.parametrize("text", ["", "n", "n =", "n = 5 AND", "(n = 5", "n = 5)", "n ~ 5", "5 = n", "n = five", "n not = 5", "n in ()", "nowhere = 1", "n = 5 n = 6", "n between 5 or 6", "n = 'open"])
def test_syntax_errors(rows, text):
    with pytest.raises(FilterSyntaxError):
        filters.apply(rows, text)


def test_null_filter_keeps_all(rows):
    assert filters.apply(rows, None).count() == 4


def test_json_is_typed(spark):
    docs = ['{"k": 5, "s": "5", "b": true, "d": 1.5, "o": {"p": 7}}', '{"k": "5"}', '{"k": null}', "no json", None, '{"k": 5.0, "s": null}']
    df = spark.createDataFrame(list(enumerate(docs)), "id int, props string")
    found = lambda text: {r.id for r in filters.apply(df, text, filters.json_of("props")).collect()}
    assert found("k = 5") == {0, 5} and found("k = '5'") == {1} and found("s = '5'") == {0} and found("s = 5") == set()
    assert found("b = true") == {0} and found("d > 1") == {0} and found("o.p = 7") == {0} and found("NOT k = 5") == set()
    assert found("s != null") == {0}


def test_whole_json_numbers_are_exact(spark):
    df = spark.createDataFrame([(0, '{"k": 9007199254740993}'), (1, '{"k": 9007199254740992}'), (2, '{"k": 1e300}'), (3, '{"k": -1.5}'), (4, "{}")], "id int, props string")
    found = lambda text: {r.id for r in filters.apply(df, text, filters.json_of("props")).collect()}
    assert found("k = 9007199254740993") == {0} and found("k = 9007199254740992") == {1} and found("k > 9007199254740992") == {0, 2}
    assert found("k < 0") == {3} and found("k BETWEEN -2 AND 9007199254740992") == {1, 3} and found("k NOT BETWEEN -2 AND 9007199254740992") == {0, 2}
