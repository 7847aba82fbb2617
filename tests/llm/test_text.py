import pytest
from pyspark.sql import functions as F

from siltstone.llm.editor import KEEP, Editor, apply, mined_pairs, operations
from siltstone.llm.scans import ScanRepair, furniture, repaired, scanned_lines
from siltstone.llm.sentences import sentence_spans, sentence_units

PAGE = "\n----\n\n//\n\n----\n"


def cut(t):
    return [t[a:b] for a, b in sentence_spans(t)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("One here. Two here! Three? Four", ["One here.", "Two here!", "Three?", "Four"]),
        ("Dr. Who met Mr. J. Doe at 5 a.m. on Monday. Then he left.", ["Dr. Who met Mr. J. Doe at 5 a.m. on Monday.", "Then he left."]),
        ("We work in the U.S. The group grew.", ["We work in the U.S.", "The group grew."]),
        ("The U.S. arm paid 3.5 million, i.e. more.", ["The U.S. arm paid 3.5 million, i.e. more."]),
        ("He said: “We came. We saw.” More follows.", ["He said: “We came. We saw.”", "More follows."]),
        ('"Is it? It is." was the view of the board. Next one.', ['"Is it? It is." was the view of the board.', "Next one."]),
        ("«No. Ahora sí.» escribió la filial. Otra frase.", ["«No. Ahora sí.» escribió la filial.", "Otra frase."]),
        ("« Non. Oui. » a écrit le conseil. Fin !", ["« Non. Oui. » a écrit le conseil.", "Fin !"]),
        ("Am 5. Mai kam die Holding. Laut Nr. 4 bzw. Abs. 2 gilt das.", ["Am 5. Mai kam die Holding.", "Laut Nr. 4 bzw. Abs. 2 gilt das."]),
        ("「知らない。行動する。」と述べた。次の文！", ["「知らない。行動する。」と述べた。", "次の文！"]),
        ("“我们不知道。会行动。”经理说。下一句……然后结束。", ["“我们不知道。会行动。”经理说。", "下一句……然后结束。"]),
        ("वह आया। डॉ. Rao गए।", ["वह आया।", "डॉ. Rao गए।"]),
        ("ประโยคแรกยาว ประโยคที่สองยาว", ["ประโยคแรกยาว", "ประโยคที่สองยาว"]),
        ("قال د. علي نعم. هل جاء؟ نعم", ["قال د. علي نعم.", "هل جاء؟", "نعم"]),
        ("J. C. Doe, Ph.D., came at last.G. Roe left.", ["J. C. Doe, Ph.D., came at last.", "G. Roe left."]),
        ("The end of it.The next one", ["The end of it.", "The next one"]),
        ("a line\nthat goes on. Next", ["a line\nthat goes on.", "Next"]),
        ("Intro:\n• item one\n• item two\n\nAfter", ["Intro:", "item one", "item two", "After"]),
        ("before" + PAGE + "after", ["before", "after"]),
        ("It was ... and went on; so: yes.", ["It was ... and went on; so: yes."]),
        ("", []),
        (" \n ", []),
        (None, []),
    ],
)
def test_sentences(text, expected):
    assert cut(text) == expected


def test_spans_are_ordered_and_trimmed():
    t = ("A sentence here. “Quoted. More.” said he.\n\n- item\n- other\n" + PAGE) * 300
    at = 0
    for a, b in sentence_spans(t):
        assert at <= a < b
        assert t[a:b] == t[a:b].strip()
        at = b
    assert len(cut("word " * 50_000)) == 1
    assert len(cut("! " * 5_000)) >= 1


@pytest.mark.parametrize("n", [3, 4, 30, 500])
def test_long_quotations_are_one_unit(n):
    for q, z in ("“”", "«»", '""', "„“"):
        said = f"He said: {q}{'We came and saw it all. ' * n}We won.{z}"
        assert cut(said + " More follows.") == [said, "More follows."]


def test_stray_quotation_marks_end_nothing():
    assert cut("“One is open. Two here. Three here.") == ["“One is open.", "Two here.", "Three here."]


def test_units_table(spark):
    rows = [(1, "Go on. Come in.", "x"), (1, "Go on. Come in.", "x"), (2, None, "x"), (3, "", "x"), (None, "Halt.", "x")]
    got = sorted(map(str, sentence_units(spark.createDataFrame(rows, "id int, text string, sent_no string"), "id", "text").collect()))
    assert len(got) == 5
    assert sentence_units(spark.createDataFrame([], "id int, text string"), "id", "text").count() == 0


def test_operations():
    assert operations("retcntion", "retention") == [KEEP] * 3 + ["re"] + [KEEP] * 5
    assert operations("uniforrn", "uniform") == [KEEP] * 6 + ["rm", "d"]
    assert operations("abc", "xyz") is None


def test_editor_learns_confusions():
    plain = ["retention", "register", "person", "seafood", "center", "letter", "modern", "member", "remedy", "review", "level", "seven"]
    noisy = [(w.replace("e", "c", 1), w) for w in plain if "e" in w]
    e = Editor().train(noisy * 2, plain * 2)
    assert "effective" in [x for x, *_ in e.candidates("effcctive")]
    assert apply("Effcctivc", [(3, 4, "e"), (8, 9, "e")]) == "Effective"
    assert apply("EFF0RT", [(3, 4, "o")]) == "EFFORT"
    assert mined_pairs(["scafood"], plain) == [("scafood", "seafood")]


def pages():
    body = ["The board reviewed the long list of the suppl-", "iers in the second half of the year and com¬"]
    return "\n".join(["ACME | STATEMENT 2020", "", *body, "", "Page 1"]) + PAGE + "\n".join(["ACME | STATEMENT 2020", "pleted the self-", "assessment of 2019.", "", "Our structure", "", "2019", "palm oil 247", "Page 2"])


def test_furniture_and_divided_words():
    lines, out, divided, _ = scanned_lines(pages())
    assert sorted(lines[i] for i in out) == ["ACME | STATEMENT 2020", "ACME | STATEMENT 2020", "Page 1", "Page 2"]
    assert [(a, m, b) for _, _, a, m, b in divided] == [("suppl", "-", "iers"), ("com", "¬", "pleted"), ("self", "-", "assessment")]
    assert furniture([""]) == (set(), set())


def test_repaired_text():
    fixes = [{"line_no": 3, "kind": "hyphen", "a": "suppl", "fixed": "suppliers"}, {"line_no": 4, "kind": "hyphen", "a": "com", "fixed": "completed"}]
    got = repaired(pages(), fixes)
    assert got[0].startswith("The board reviewed the long list of the suppliers in the second half of the year and completed the self-")
    assert "Our structure" in got


def test_scan_repair(spark):
    good = "the board reviewed complaints and retention of suppliers in the second half of the year while the group assessed complaints "
    clean = [(good * 3, False)] * 40
    noisy = "The board rcviewed complaints and retcntion of suppl-\niers. The group asscssed complaints."
    scans = [("d", 1, noisy, "x"), ("d", 1, noisy, "x"), ("d", 2, None, "x"), ("d", 3, "", "x"), ("r", None, "the board", "x")]
    df = spark.createDataFrame(scans, "origin string, id long, text string, kind string")
    words = spark.createDataFrame([*clean, (noisy, True), (None, True)], "text string, scan boolean")
    found = ScanRepair(df, words)
    got = {(r["id"], r["line_no"], r["kind"], r["fixed"]) for r in found.found().collect()}
    assert (1, 1, "hyphen", "suppliers") in got
    assert {r[3] for r in got if r[2] == "misread"} <= {"reviewed", "retention", "assessed"}
    assert found.found().count() == len(got)
    assert found.paragraphs().where(F.col("id") == 1).count() >= 1


def test_scan_repair_of_nothing(spark):
    df = spark.createDataFrame([], "origin string, id long, text string")
    assert ScanRepair(df, spark.createDataFrame([], "text string, scan boolean")).found().count() == 0


def test_units_of_any_reach():
    from siltstone.llm.sentences import sentence_spans

    for n in (23, 30, 60, 500, 3000):
        t = "See " + "fig. " * n + "for more."
        assert len(sentence_spans(t)) == 1
        # Long units cost more than their ends are worth only where there are ends of a positive score.
        assert len(sentence_spans(t + " It ends here. Then more.")) == 3
    assert len(sentence_spans("It is so. " * 2000)) == 2000
