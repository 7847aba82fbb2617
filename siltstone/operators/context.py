"""Word windows around sentences, from the array of a text's sentences: no row leaves its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positional_context(sentences: Column, words: int, left: str = "[L]", right: str = "[R]") -> Column:
    """array<struct<pos, context>>: each sentence between marks with up to words/2 words before and after it.

    Texts around it are joined with ". ", so the left side ends with an empty word and the right one begins with a dot; both
    count as words. An odd number gives the left side one more.
    """
    before, after = -(-words // 2), words // 2
    all_words = F.split(F.array_join(sentences, ". "), " ")
    counts = F.transform(sentences, lambda s: F.size(F.split(s, " ")))
    starts = F.aggregate(counts, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    packed = F.struct(all_words.alias("w"), starts.alias("o"), sentences.alias("s"))

    def one(p: Column, i: Column) -> Column:
        start, end = F.get(p["o"], i), F.get(p["o"], i + 1)
        n = F.size(p["w"])
        # The last word before keeps the dot of its sentence; an empty word follows it.
        head_n = F.least(start, F.lit(before - 1))
        head = F.when(i > 0, F.concat(F.slice(p["w"], start - head_n + 1, head_n), F.array(F.lit("")))).otherwise(F.array(F.lit("")))
        tail_n = F.least(n - end, F.lit(after - 1))
        tail = F.concat(F.array(F.lit(".")), F.when(end < n, F.slice(p["w"], end + 1, tail_n)).otherwise(F.array(F.lit(""))))
        mid = F.concat(F.lit(f"{left} "), F.get(p["s"], i), F.lit(f" {right}"))
        return F.trim(F.concat(F.array_join(head, " "), F.when(i > 0, F.lit(" ")).otherwise(F.lit("")), mid, F.array_join(tail, " ")))

    listed = F.transform(F.array(packed), lambda p: F.transform(F.sequence(F.lit(0), F.size(p["s"]) - 1), lambda i: F.struct(i.alias("pos"), one(p, i).alias("context"))))
    return F.when(F.size(sentences) > 0, F.get(listed, 0))


def with_context(df: DataFrame, key: str, sentences: str, words: int) -> DataFrame:
    """(key, pos, sentence, context) for each sentence."""
    x = df.select(key, F.col(sentences).alias("s")).where("size(s) > 0")
    x = x.select(key, F.explode(F.arrays_zip(F.col("s").alias("sentence"), positional_context(F.col("s"), words).alias("c"))).alias("e"))
    return x.select(key, F.col("e.c.pos").alias("pos"), F.col("e.sentence").alias("sentence"), F.col("e.c.context").alias("context"))


def plain_context(sentences: Column, words: int, left: str = "[L]", right: str = "[R]") -> Column:
    """array<string>: each sentence between marks and dots, with words/2 - 1 words on either side; the sentence alone if that is none.

    Words are pieces between white space. A sentence adds a word at least to its neighbours' text, so the words come from the
    nearest words/2 sentences.
    """
    half = max(words // 2 - 1, 0)
    pieces = lambda part: F.filter(F.split(F.array_join(part, ". "), r"\s+"), lambda w: w != "")
    if not half:
        return F.transform(sentences, F.trim)

    def one(s: Column, i: Column) -> Column:
        start = F.greatest(i - half, F.lit(0))
        before, after = pieces(F.slice(sentences, start + 1, i - start)), pieces(F.slice(sentences, i + 2, F.lit(half + 1)))
        head = F.slice(before, F.greatest(F.size(before) - half + 1, F.lit(1)), F.lit(half))
        return F.trim(F.concat(F.array_join(head, " "), F.lit(f".  {left} "), s, F.lit(f" {right}. "), F.array_join(F.slice(after, 1, half), " ")))

    return F.transform(sentences, one)


def first_context(sentences: Column, words: int, left: str = "[L]", right: str = "[R]") -> Column:
    """array<string>: as positional_context, but around the first place where the sentence's text stands in the joined text, even inside
    another sentence."""
    before, after = -(-words // 2), words // 2
    full = F.array_join(sentences, ". ")

    def one(s: Column) -> Column:
        p = F.instr(full, s)
        head, tail = F.split(F.substring(full, F.lit(1), p - 1), " "), F.split(F.substring(full, p + F.length(s), F.length(full)), " ")
        head = F.slice(head, F.greatest(F.size(head) - before + 1, F.lit(1)), F.lit(before))
        return F.trim(F.concat(F.array_join(head, " "), F.lit(f" {left} "), s, F.lit(f" {right}"), F.array_join(F.slice(tail, 1, after), " ")))

    return F.transform(sentences, one)
