"""Records of JSON arrays read in small splits against the json module, on files made to mislead."""

import json
import random

import pytest

from corvane.plans import queries
from corvane.sources import decisions, json_array

WORDS = ["{", "}", "[", "]", '"', "\\", "},{", '"KARARLAR":[', "a", "\n", " ", "é", "日", '":[{"a":1}]', '\\"']


def value(rng, depth=0):
    kind = rng.random()
    if kind < 0.5 or depth > 3:
        return "".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))
    if kind < 0.6:
        return rng.randint(0, 99)
    if kind < 0.8:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["x", "KARARLAR", "y}"]): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}


@pytest.fixture
def tiny_splits(spark):
    sizes = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k, None) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def files(tmp_path):
    """Three files; brackets, quotes, escapes and the field's own name in strings, other arrays before and after, one array empty."""
    rng, want = random.Random(7), []
    for f in range(3):
        records = [{"KARAR_ID": str(i), "v": value(rng), **({"w": value(rng)} if i % 2 else {})} for i in range(0 if f == 1 else 25)]
        whole = {"pre": value(rng), "o": {"KARARLAR": [{"no": 1}]}, "KARARLAR": records, "post": [{"a": {}}], "z": value(rng)}
        (tmp_path / f"f{f}.json").write_text(json.dumps(whole, ensure_ascii=f == 0, indent=1 if f == 2 else None) + "\n" * (f % 2))
        want += records
    return tmp_path, want


def read(rows):
    found = sorted(rows.collect())
    assert [r.ord for r in found] == list(range(len(found)))
    return [json.loads(r.record) for r in found]


def test_records_cross_splits(spark, tiny_splits, files):
    folder, want = files
    size = sum(f.stat().st_size for f in folder.iterdir())
    assert json_array.splits(json_array.fixed_splits(spark), str(folder)).rdd.getNumPartitions() > size / 500
    assert read(json_array.records(spark, str(folder))) == want
    (folder / "root.json").write_text(json.dumps(want))
    assert read(json_array.records(spark, str(folder / "root.json"), None)) == want


def test_limit_reads_a_share(spark, tiny_splits, files):
    folder, want = files
    looked = {}
    for n in (1, 26, 100):
        seen = spark.sparkContext.accumulator(0)
        assert read(json_array.records(spark, str(folder), limit=n, read=seen)) == want[:n]
        looked[n] = seen.value
    assert looked[1] < looked[100] / 5 and looked[26] < looked[100]


def test_odd_files(spark, tiny_splits, tmp_path):
    """No array, an empty one, null, other elements, an escaped name, a name that can't be used; an empty folder's file."""
    for i, text in enumerate(["{}", '{"KARARLAR": []}', '{"KARARLAR": null}', '{"KARARLAR": [1, "{}", [{}], {"a": 1}, null]}', '{"\\u004bARARLAR": [{"a": 2}]} \n', "", "\n"]):
        (tmp_path / f"{i}.json").write_text(text)
    assert read(json_array.records(spark, str(tmp_path))) == [{"a": 1}, {"a": 2}]
    with pytest.raises(ValueError, match="name"):
        json_array.records(spark, str(tmp_path), "a}")


def test_equals_multi_line(spark, tiny_splits, tmp_path):
    """The loader's records are those of Spark's own reader, which takes a file as one row; an object read as text may be spaced otherwise."""
    rows = [{"KARAR": {"KARAR": "<p>é}</p>"}, "metadata": {"KARAR_ID": "1"}}, {"KARAR": "x{", "KARAR_ID": "2", "other": [1]}, {}] * 20
    (tmp_path / "a.json").write_text(json.dumps({"KARARLAR": rows}))
    whole = spark.read.schema(json_array.T.StructType([json_array.T.StructField("KARARLAR", json_array.T.ArrayType(decisions.RECORD))]))
    want = whole.option("multiLine", True).json(str(tmp_path / "a.json")).selectExpr("posexplode(KARARLAR) AS (ord, r)").select("ord", "r.*")
    got = decisions.json_records(spark, str(tmp_path / "a.json"))
    plain = lambda r: str(r.asDict(True) | {"KARAR": json.loads(r.KARAR) if (r.KARAR or "").startswith("{") else r.KARAR})
    assert sorted(map(plain, got.collect())) == sorted(map(plain, want.collect())) and got.count() == 60


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    assert sorted(queries.json_array_stream(spark, folder).collect()) == sorted(queries.load_json_decisions(spark, folder).collect())
