import pytest
from pyspark.sql import functions as F

from siltstone.sources import files as S
from siltstone.streaming import sentences as M


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', [1.0, -1.0]), (2, None, [])], "id int, t string, p array<double>")
    S.write_csv(df, str(tmp_path / "x"))
    back = S.all_strings(str(tmp_path / "x"), spark).withColumn("p", S.list_column(F.col("p"), 2)).orderBy("id").collect()
    assert [(r["id"], r["t"], r["p"]) for r in back] == [("1", 'a "q", b', [1.0, -1.0]), ("2", "", [])]


def test_list_column_defaults(spark):
    df = spark.createDataFrame([(None,), ("[1, 2]",)], "t string").select(S.list_column(F.col("t"), 3).alias("x"))
    assert [r["x"] for r in df.collect()] == [[0.0, 0.0, 0.0], [1.0, 2.0]]


def test_years_and_unique(spark, tmp_path):
    for y, row in (("2020", "id,a\n1,x\n"), ("2021", "id,b\n2,y\n2,z\n")):
        (tmp_path / f"{y}.csv").write_text(row)
    df = S.yearly(spark, {y: str(tmp_path / f"{y}.csv") for y in ("2020", "2021")})
    assert {tuple(r) for r in df.select("id", "a", "b", "register_year").collect()} == {("1", "x", None, "2020"), ("2", None, "y", "2021"), ("2", None, "z", "2021")}
    with pytest.raises(ValueError, match="unique"):
        S.assert_unique(df, "id")


def test_pages_files_and_xml(spark, tmp_path):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "id int, n int, t string")
    assert {tuple(r) for r in S.joined_pages(pages, "id", "n", "t").collect()} == {(1, "a\n----\n\n//\n\n----\nb"), (2, "")}
    (tmp_path / "f.txt").write_text("some static stuff")
    assert S.binaries(spark, str(tmp_path)).head()["md5"] == "8c92ff476d38070f08169c80cbd00d4a"
    assert S.whole_texts(spark, str(tmp_path)).head()["text"] == "some static stuff"
    x = spark.createDataFrame([("<n:d xmlns:n='u'><p>1</p><p>2</p><q k='v'/></n:d>",), ("<broken",), (None,)], "x string").select(S.xml_as_json("x").alias("j"))
    assert [r["j"] for r in x.collect()] == ['{"d": {"p": ["1", "2"], "q": {"k": "v"}}}', None, None]


def test_html(spark):
    h = spark.createDataFrame([('<h2>A <b>(2024)</b></h2><a class="x" href="/one.pdf">Download</a><a href="/two">Other</a>',)], "h string")
    r = h.select(S.links(F.col("h")).alias("all"), S.links(F.col("h"), "Download").alias("d"), S.headings(F.col("h")).alias("h2")).head()
    assert (r["all"], r["d"], r["h2"]) == (["/one.pdf", "/two"], ["/one.pdf"], ["A (2024)"])


def test_branches_and_edits(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    S.write_branch(a, str(tmp_path), "main")
    b = S.upsert(S.read_branch(spark, str(tmp_path)), spark.createDataFrame([(2, "z"), (3, "w"), (1, None)], "id int, v string"), "id", ["v"])
    S.write_branch(b, str(tmp_path), "main")
    assert {tuple(r) for r in S.read_branch(spark, str(tmp_path)).collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert S.read_branch(spark, str(tmp_path), "main.before").count() == 2
    assert S.add_columns(a, spark.createDataFrame([(1, "k")], "id int, c string"), "id", {"c": ""}).where("c = ''").count() == 1
    assert S.with_defaults(a, {"n": 0}).columns == ["id", "v", "n"]
    wide = spark.createDataFrame([("s", 0, 1)], "t string, a int, b int")
    assert S.last_columns(wide, 2).head()["labels"] == [0, 1]


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name).collect()


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "One two. Three four", 0.2), (1, "Five six", 0.7), (2, None, -0.5)], "id int, t string, s double")
    rows.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000))).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("id int, t string, s double, at timestamp").parquet(str(tmp_path / "in"))
    assert sorted(r["sentence"] for r in run(M.sentence_stream(source(), "id", "t"), "s1")) == ["Five six", "One two", "Three four"]
    assert {(r["id"], r["score"]) for r in run(M.statement_max_stream(source().withColumn("l", F.lit("x")), "id", "l", "s"), "s2", "complete")} == {(1, 0.7), (2, 0.0)}
    assert len(run(M.scored_once(source(), ["id"], "at"), "s3")) == 2
    assert run(M.windowed_counts(source().withColumn("k", F.lit("x")), "at", "k"), "s4", "update")[-1]["n"] == 3
