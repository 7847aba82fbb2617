import pytest
from pyspark.sql import functions as F

from siltstone.operators.packed import Grammar, known_of, packed_values, unpack_fields

KNOWN = ["Korea, Republic of", "Hospitality | tourism", "Real estate/Property", "Retail"]


def values(s, known=()):
    return [v for v, _ in Grammar(known).parse(s)]


@pytest.mark.parametrize(
    ("field", "expected"),
    [
        ("A, B;C | D\nE\tF / G", ["A", "B", "C", "D", "E", "F", "G"]),
        ('"A, B", C', ["A, B", "C"]),
        ("“A, B”;C", ["A, B", "C"]),
        ('"Say ""yes"" Ltd", B', ['Say "yes" Ltd', "B"]),
        ('["A \\"x\\" B", "C, D"]', ['A "x" B', "C, D"]),
        ("• A\n• B", ["A", "B"]),
        ("Korea, Republic of, Retail", ["Korea, Republic of", "Retail"]),
        ("Hospitality | tourism | Real estate/Property", ["Hospitality | tourism", "Real estate/Property"]),
        ("Acme, Inc., Beta, Ltd.; Gamma Pty Ltd", ["Acme, Inc.", "Beta, Ltd.", "Gamma Pty Ltd"]),
        ("A,, B,", ["A", "B"]),
        (" A  B ", ["A B"]),
        ("A, A", ["A", "A"]),
        ("n/a", []),
        (" - ", []),
        ("None", []),
        ("", []),
        ('"broken, B', ["broken", "B"]),
        ('"A" tail, B', ['A" tail', "B"]),
    ],
)
def test_grammar(field, expected):
    assert values(field, KNOWN) == expected


def test_malformed_is_flagged():
    assert [bad for _, bad in Grammar().parse('"broken, B')] == [True, False]
    assert [bad for _, bad in Grammar().parse("A, B")] == [False, False]


def test_very_long_field():
    assert len(values(",".join(f"v{i}" for i in range(20_000)))) == 20_000
    assert len(values('"' * 2_001)) <= 1


def test_nulls_versions_and_clashing_names(spark):
    rows = [(1, "A, B", "x", 1, "p"), (1, "A", "y", 2, "q"), (None, "C", None, 1, "r"), (2, None, "", 1, "s"), (3, "D", "D", None, "t")]
    df = spark.createDataFrame(rows, "id int, f1 string, f2 string, version int, value string")
    got = {tuple(r) for r in unpack_fields(df, "id", ["f1", "f2"], version="version").collect()}
    assert got == {(1, "f1", 1, "A", False), (1, "f2", 1, "y", False), (None, "f1", 1, "C", False), (3, "f1", 1, "D", False), (3, "f2", 1, "D", False)}


def test_without_version_every_row_counts(spark):
    df = spark.createDataFrame([(1, "A"), (1, "A")], "id int, f string")
    assert unpack_fields(df, "id", ["f"]).count() == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, f string, loaded_at timestamp")
    assert unpack_fields(df, "id", ["f"], version="loaded_at").count() == 0


def test_null_gives_empty_list(spark):
    df = spark.createDataFrame([(None,)], "f string").select(packed_values(F.col("f")).alias("v"))
    assert df.head()["v"] == []


def test_many_known_values_stay_a_table(spark):
    df = spark.createDataFrame([("f", f"v{i}") for i in range(5)] + [("f", None), (None, "x")], "field string, known_value string")
    assert sorted(known_of(df)["f"]) == [f"v{i}" for i in range(5)]
    assert known_of(df, limit=3).count() == 5


def test_known_values_of_any_number(spark, data):
    s, k = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("statements", "known_values"))
    fields = ["countries", "industry_sectors", "entities"]
    few, many = known_of(k), known_of(k, limit=1)
    assert isinstance(few, dict)
    assert not isinstance(many, dict)
    rows = lambda known: sorted(tuple(r) for r in unpack_fields(s, "statement_id", fields, known, "loaded_at").collect())
    assert rows(few) == rows(many)
    more = many.unionByName(spark.range(12_000).selectExpr("'countries' AS field", "concat('Land ', id, ', Upper') AS known_value"))
    x = spark.createDataFrame([(1, "Land 11, Upper, Land 12 | Land 5, Upper; -")], "id int, countries string")
    got = [r["value"] for r in unpack_fields(x, "id", ["countries"], known_of(more)).orderBy("pos").collect()]
    assert got == ["Land 11, Upper", "Land 12", "Land 5, Upper"]
