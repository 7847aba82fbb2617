from siltstone.plans import reference as R


def test_labels_of_every_sentence_are_collected(spark, data):
    got = R.QUERIES["group_collect_all"](spark, data)
    assert got.where("sentence_idx > 0").count() > 0
    assert got.count() == R._latest(spark, data).select("statement_id", "criterion", "sentence_idx").distinct().count()
    by_sentence = {(r["statement_id"], r["criterion"], r["sentence_idx"], *x.split("=")) for r in got.collect() for x in r["labels"].split(",")}
    by_annotator = set()
    for r in R.group_collect(spark, data).collect():
        for x in r["labels"].split(","):
            s, label = x.split("=")
            by_annotator.add((r["statement_id"], r["criterion"], int(s), str(r["annotator_idx"]), label))
    assert by_annotator == by_sentence
