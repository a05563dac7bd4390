"""Steps that large tables made slow: passes over a text, and work below a sort."""

import random

from pyspark.sql import functions as F

from glosspark.functions import normalize as N
from glosspark.functions import porter
from glosspark.plans import fixtures as FX


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_rules_take_few_passes(spark):
    rows = [(None,), ("",), (" \t",), ("The council, and Mr. Smith don't agree!  10% .,",), ("\ufeff  the european parliament  ",)]
    df = spark.createDataFrame(rows, "t string")
    plan = _plan(df.select(N.process_text(F.col("t")).alias("o")))
    assert plan.count("regexp_replace(") < 60            # 99 with a pass per end and mark
    got = [r.o for r in df.select(N.process_text(F.col("t")).alias("o")).collect()]
    assert got[:3] == ["", "", ""] and got[3] == "council , and mr . smith do not agree !10 percent . ,"
    assert got[4] == "the european parliament"


def test_titles_are_fixed_where_held(spark):
    from glosspark.functions import lexicon as L
    surname, title = next(iter(L.TITLE_BY_SURNAME.items()))
    df = spark.createDataFrame([(f" MR  {surname} x",), ("no  title",), ("mr",), (f"hmr {surname}",)], "t string")
    got = [r.o for r in df.select(N.fix_titles(F.col("t")).alias("o")).collect()]
    assert got == [f"{title} {surname} x", "no title", "mr", f"hmr {surname}"]


def test_words_without_a_suffix_letter_keep_their_form():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz019") for _ in range(rng.randint(1, 8))) + rng.choice(["", "7", "ing", "ization", "ly"]) for _ in range(3000)]
    short = [porter.stem(w) for w in words]
    kept, porter.LAST = porter.LAST, frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
    try:
        assert short == [porter.stem(w) for w in words]
    finally:
        porter.LAST = kept


def test_lines_are_sorted_before_they_are_rendered(spark, tmp_path):
    spark.createDataFrame([(i, f"a {i}\nb c") for i in range(30)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    lines = FX.raw_lines(spark, str(tmp_path))
    assert "upper(" in _plan(lines)                       # derived above the checkpoint, not below the sort
    got = [r.value for r in lines.orderBy("ord").collect()]
    assert len(got) == 60 and got[0] == "0_0\tA DESC-0" and got[3].startswith("1_1|B DESC-C")
