import pytest
from pyspark.sql import functions as F

from siltstone.functions import annotations as A
from siltstone.functions import text as X
from siltstone.operators import annotations as O
from siltstone.plans import annotated as Q

GOOD = {"label": "YES", "yes_text": "a"}
BROKEN = [
    {"label": None}, {"has_no_support_info": True}, {"label": "UNCLEAR", "yes_text": None, "unclear_text": "u", "has_no_support_info": True}, {"yes_text": "", "no_text": "b"}, {"no_text": "b"}, {"has_date": True}, {"date_text": "d"},
    {"viz_elem_label": True, "viz_elem_page": "1", "viz_elem_type": "t"}, {"viz_elem_label": True, "viz_elem_text": "x", "viz_elem_type": "t"}, {"viz_elem_label": True, "viz_elem_scanned": True, "viz_elem_page": "1"}, {"viz_elem_page": "1"},
    {"add_viz_elem_label": True}, {"add_viz_elem_label": True, "add_viz_elem_text": "x"}, {"add_viz_elem_label": True, "add_viz_elem_text": "x", "add_viz_elem_page": "1"}, {"add_viz_elem_scanned": True}, {"opt_3_explanation": "e", "joint_option": 2},
]


def test_each_rule_fires_in_its_order(spark):
    names = {k for b in BROKEN for k in b} | set(GOOD)
    kind = lambda k: "boolean" if k in A.FLAGS else "int" if k == "joint_option" else "string"
    schema = "n int, " + ", ".join(f"{k} {kind(k)}" for k in sorted(names))
    rows = [{"n": i} | dict.fromkeys(names) | GOOD | b for i, b in enumerate([*BROKEN, {}, {"opt_3_explanation": "e", "joint_option": 3}], 1)]
    df = spark.createDataFrame(rows, schema)
    got = {r["n"]: r["e"] for r in df.select("n", A.first_error({k: F.col(k) for k in names}).alias("e")).collect()}
    assert [got[i] and got[i]["rule"] for i in range(1, 19)] == [*range(1, 17), None, None]
    assert got[3]["message"] == A.RULES[2]
    # The earlier of two broken rules counts.
    both = spark.createDataFrame([{"n": 0} | dict.fromkeys(names) | GOOD | {"has_date": True, "viz_elem_page": "1"}], schema)
    assert both.select(A.first_error({k: F.col(k) for k in names})["rule"].alias("r")).head()["r"] == 6


def test_all_rules_fire_on_the_tables(spark, data):
    assert {r["rule"] for r in Q.validity_rules(spark, data).select("rule").distinct().collect()} >= {None, *range(1, 17)}


def test_groups_are_rejected_or_ended(spark):
    rows = [
        ("a", 0, None, None), ("a", 1, None, None), ("b", 0, None, None), ("b", 1, "bad", None), ("c", 0, "bad", "v"), ("c", 1, "bad", None), ("d", 0, None, None), ("d", 1, None, "v"),
        (None, 0, "bad", None), ("e", 0, "bad", None), ("e", 1, None, "v"),
    ]
    got = {(r["g"], r["o"]): r["state"] for r in O.sorted_out(spark.createDataFrame(rows, "g string, o int, e string, v string"), ["g"], "o", "e", "v").collect()}
    assert got == {("a", 0): "good", ("a", 1): "good", ("b", 0): "rejected", ("b", 1): "rejected", ("c", 0): "good", ("c", 1): "after", ("d", 0): "rejected", ("d", 1): "rejected", (None, 0): "rejected", ("e", 0): "rejected", ("e", 1): "rejected"}


def test_fields_and_options(spark):
    df = spark.createDataFrame([("yes", "Option 2", " "), ("", "3", "x"), (None, "option 4", None)], "f string, o string, t string")
    r = df.select(A.flag(F.col("f")).alias("f"), A.option(F.col("o")).alias("o"), A.typed("date_text", F.col("t")).alias("t")).collect()
    assert [tuple(x) for x in r] == [(True, 2, ""), (False, 3, "x"), (False, None, None)]
    with pytest.raises(Exception, match="not a yes or no"):
        spark.createDataFrame([("perhaps",)], "f string").select(A.flag(F.col("f"))).collect()


def test_labels_by_strategy(spark):
    df = spark.createDataFrame([(2, 2, 3, 2), (1, 2, 1, 0), (0, 2, 0, 0), (0, 0, 0, 0), (0, None, 0, 0)], "h int, k int, c int, y int")
    got = [tuple(r["y"]) for r in df.select(O.binary_labels(F.col("h"), F.col("k"), F.col("c"), F.col("y")).alias("y")).collect()]
    assert got[0] == (True, True, 1.0, True, False, 0.666667, False, False, False, False)
    assert got[1] == (True, False, 0.5, False, False, 0.0, False, False, True, False)
    assert got[2] == (False, False, 0.0, False, True, None, False, True, True, True)
    assert got[3] == got[4] == (False, False, 0.0, False, False, 0.0, True, True, True, True)


def test_chunks_are_placed(spark):
    e = spark.createDataFrame([(1, "The board met. No risk // fig.p3. risk was foun // tab.p1.http://x // y"), (2, ""), (3, None)], "id int, t string")
    s = spark.createDataFrame([(1, ["The board met", "No risk was found", "Other"]), (2, [])], "id int, sentences array<string>")
    c = O.chunks(e, ["id"], "t")
    assert [(r["origin"], r["chunk"]) for r in c.orderBy("chunk_no").collect()] == [("main_body", "The board met. No risk"), ("infographic", "risk was foun"), ("table", "http://x"), ("main_body", "y")]
    got = {(r["chunk_no"], r["piece"]): (r["sentence"], r["idx"], r["stage"]) for r in O.placed_chunks(c, ["id"], s, "id").collect()}
    assert got[0, 0] == ("The board met", 0, "exact")
    assert got[0, 1] == ("No risk", 1, "inside")
    assert got[1, 0] == ("risk was foun", 1, "inside")
    assert got[2, 0][0] == "http://x"


def test_offsets_give_the_characters(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text")
    both = d.select("text", X.sentences_of(F.col("text")).alias("s"), X.sentences_with_offsets("text").alias("o")).collect()
    assert len(both) > 50
    for r in both:
        assert [x["sentence"] for x in r["o"]] == r["s"]
        for x in r["o"]:
            raw = "".join(r["text"][i] for i in x["offsets"])
            assert "".join(" " if c.isspace() else c for c in raw) == x["sentence"]
            assert x["offsets"] == sorted(x["offsets"])


def test_year_must_be_a_whole_word(spark):
    df = spark.createDataFrame([("20201 workers",), ("2020 report",), ("2020",), ("(2021) report",)], "t string")
    assert [r["x"] for r in df.select(X.cleaned_sentence(F.col("t")).alias("x")).collect()] == ["workers", "2020 report", "2020", "(2021) report"]


def test_slugs_keep_plain_letters(spark):
    df = spark.createDataFrame([("Société  Générale – ﬁn_",), ("--a b--",), (None,)], "t string")
    assert [r["x"] for r in df.select(X.slug(F.col("t")).alias("x")).collect()] == ["societe-generale-fin", "a-b", None]
