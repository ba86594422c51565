import json

import pytest

from tessera import validate
from tessera.errors import CODES, VectorError
from tessera.sources.catalog import Catalog


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/db")


def kind(f, *args, **kw):
    with pytest.raises(VectorError) as e:
        f(*args, **kw)
    assert e.value.code == CODES[e.value.kind]
    return e.value.kind


def test_validation():
    for name in ("a" * 64, "my-collection", "my_collection", "docs123", "1"):
        assert validate.collection_name(name) == name
    for name in ("", "a" * 65, "-abc", "_abc", ".abc", "my collection", "col@name", "col#name", "é", "docs\n", None):
        assert kind(validate.collection_name, name) == "INVALID_NAME"
    assert [validate.dimension(d) for d in (1, 384, 4096)] == [1, 384, 4096]
    assert kind(validate.dimension, 0) == "DIM_TOO_SMALL" and kind(validate.dimension, 4097) == "DIM_TOO_LARGE"
    assert [validate.metric(m) for m in (0, 1, 2, "l2", "cosine", "dot")] == ["l2", "cosine", "dot"] * 2
    assert {kind(validate.metric, m) for m in (3, 255, "euclidean", "L2", True)} == {"INVALID_METRIC"}


def test_collections(catalog):
    catalog.create("zebra", 128, 0)
    catalog.create("alpha", 256, "dot", "")
    assert catalog.names() == ["alpha", "zebra"]
    assert kind(catalog.create, "zebra", 3) == "ALREADY_EXISTS"
    assert kind(catalog.create, "!!", 3) == "INVALID_NAME" and kind(catalog.create, "x", 0) == "DIM_TOO_SMALL" and kind(catalog.create, "x", 3, 9) == "INVALID_METRIC"
    s = catalog.stats("alpha")
    assert (s["dim"], s["metric"], s["vector_count"], s["model"]) == (256, "dot", 0, None)
    assert [r.name for r in catalog.describe().collect()] == ["alpha", "zebra"]
    catalog.drop("alpha")
    assert catalog.names() == ["zebra"] and kind(catalog.drop, "alpha") == "NOT_FOUND" and kind(catalog.stats, "alpha") == "NOT_FOUND"


def test_rows(catalog, spark):
    catalog.create("docs", 3)
    assert kind(catalog.insert, "none", "a", [1, 2, 3]) == "NOT_FOUND" and kind(catalog.insert, "docs", "a", [1, 2]) == "DIM_MISMATCH" and kind(catalog.insert, "docs", "a", []) == "DIM_TOO_SMALL"
    catalog.insert("docs", "doc:1", [1, 2, 3], json.dumps({"lang": "en", "n": 5}))
    catalog.insert("docs", "doc2", [0, 0, 1])
    catalog.insert("docs", "doc:1", [7, 8, 9], json.dumps({"lang": "de"}))
    assert catalog.get("docs", "doc:1") == [7, 8, 9] and kind(catalog.get, "docs", "x") == "NOT_FOUND"
    assert kind(catalog.insert, "docs", "doc2", [1, 1, 1], strict=True) == "ALREADY_EXISTS"
    batch = spark.createDataFrame([("doc2", [1.0, 0.0, 0.0], None), ("new", [0.0, 1.0, 0.0], '{"lang": "en"}')], "id string, vector array<float>, metadata string")
    assert {tuple(r) for r in catalog.upsert_batch("docs", batch).collect()} == {("doc2", False), ("new", True)}
    bad = spark.createDataFrame([("ok", [1.0, 0.0, 0.0]), ("bad", [1.0])], "id string, vector array<float>")
    assert kind(catalog.insert_batch, "docs", bad) == "DIM_MISMATCH" and catalog.stats("docs")["vector_count"] == 3
    assert [r.id for r in catalog.search("docs", [0, 1, 0], 1).collect()] == ["new"]
    assert [r.id for r in catalog.search("docs", [0, 1, 0], 5, "lang = 'de'").collect()] == ["doc:1"]
    assert kind(catalog.search, "docs", [1.0]) == "DIM_MISMATCH"
    catalog.delete("docs", ["new", "unknown"])
    before = sorted(catalog.state("docs").select("id", "vector").collect())
    catalog.compact("docs")
    assert sorted(catalog.state("docs").select("id", "vector").collect()) == before and [r.id for r in before] == ["doc2", "doc:1"]
    catalog.insert("docs", "new", [1, 1, 1])
    assert catalog.get("docs", "new") == [1, 1, 1]


def test_recreated_collections_start_empty_and_others_see_writes(spark, tmp_path):
    one, two = Catalog(spark, f"file://{tmp_path}/db", compact_after=3), Catalog(spark, f"file://{tmp_path}/db")
    one.create("docs", 2)
    for i in range(4):
        one.insert("docs", f"d{i}", [i, 1])
    assert len(two._manifest("docs")["segments"]) == 1 and two.stats("docs")["vector_count"] == 4
    two.drop("docs")
    one.create("docs", 5)
    assert one.stats("docs")["vector_count"] == 0
    one.compact("docs")


def test_cli(spark, tmp_path):
    import struct

    from tessera import cli

    said = []
    run = lambda *a: cli.main(["--data-dir", f"file://{tmp_path}/db", *a], spark, said.append)
    (tmp_path / "v.f32").write_bytes(struct.pack("<3f", 0.5, 0.25, 1))
    assert run("version") == 0 and run("create", "docs", "--dim", "3") == 0 and run("create", "docs", "--dim", "3") == 1
    assert run("insert", "docs", "--id", "a", "--file", f"{tmp_path}/v.f32") == 0
    assert run("get", "docs", "a") == 0 and said[-1] == "0.5,0.25,1"
    assert run("list") == 0 and said[-1] == "docs                    3  cosine   1 vectors"
    assert run("search", "docs", "--file", f"{tmp_path}/v.f32") == 0 and said[-1] == "a\t1"
    assert run("get", "docs", "b") == 1 and run("drop", "docs") == 0 and run("drop", "docs") == 1


def test_tiers(spark, tmp_path):
    """Logs become segments and segments are merged, small ones first; deletes are kept as
    long as older rows may be elsewhere."""
    c = Catalog(spark, f"file://{tmp_path}/db", compact_after=1, merge_after=3)
    c.create("docs", 2)
    rows = spark.range(3000).selectExpr("cast(id as string) id", "array(cast(id as float), cast(id * 7 % 13 as float)) vector")
    c.insert_batch("docs", rows)
    big = c._manifest("docs")["segments"][0]
    c.insert("docs", "x", [1, 2])
    c.delete("docs", ["5", "x"])
    c.insert("docs", "y", [1, 2])
    m = c._manifest("docs")
    assert big in m["segments"] and len(m["segments"]) <= 3 and not m["log"]
    assert c.stats("docs")["vector_count"] == 3000 and kind(c.get, "docs", "5") == "NOT_FOUND" and kind(c.get, "docs", "x") == "NOT_FOUND" and c.get("docs", "y") == [1, 2]
    assert [r.vector_count for r in c.describe().collect()] == [3000]
    c.compact("docs")
    assert len(c._manifest("docs")["segments"]) == 1 and c.log("docs").count() == 3000
    by_size = Catalog(spark, f"file://{tmp_path}/db2", rotate_bytes=1)
    by_size.create("docs", 2)
    by_size.insert("docs", "x", [1, 2])
    assert len(by_size._manifest("docs")["segments"]) == 1
