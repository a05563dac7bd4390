"""Golden normaliser strings (each row exercises a reference quirk)."""

import pytest
from pyspark.sql import functions as F

from glosspark.functions import normalize as N

GOLDEN = [
    (N.process_gloss_v1, "X-WE DESC-NOT USE HOUSE X-POSS DESC-IMPORTANT BUDGET , 10 % EUR500",
     "we not uthese houthese 's important budget, 10 % eur 500"),
    (N.process_gloss_v2, "X-WE DESC-NOT USE HOUSE X-POSS DESC-IMPORTANT BUDGET , 10 % EUR500",
     "we not uthese houthese 's important budget, 10 % eur 500"),
    (N.process_gloss_v1, "X-THEY SEE MINUTE DESC-PREVIOUS SIT X-IT", "x-they thesee minute previous sit it"),
    (N.process_gloss_v2, "X-THEY SEE MINUTE DESC-PREVIOUS SIT X-IT", "they thesee minute previous sit it"),
    (N.process_gloss_v1, "THESE X-Y X-YOU 20% SHE", "thethese they you 20 % she"),
    (N.process_gloss_v2, "THESE X-Y X-YOU 20% SHE", "thethese x-y you 20 % she"),
    (N.process_target_text, "We can't accept 10% , EUR 3.5 inthe plan .  Yes",
     "We cannot accept 10 %, eur 3. 5 in the plan. Yes"),
    (N.process_target_text, "Plinthe tothe end.", "Plin the to the end."),
    (N.post_process_text, "mr Bowles told european union budget .", "mrs Bowles told the european union the budget"),
    (N.post_process_text, "mrs ashton , commission via council!  a report ? Yes!!",
     "baroness ashton, the commission via council!a report?Yes"),
    (N.post_process_text, "the European Union parliament", "the European Union the parliament"),
    (N.process_text, "I'm sure the Commission can't, at 3.5%, accept EUR 20!",
     "i am sure commission cannot , at 3 . 5 percent , accept eur 20 !"),
    (N.process_text, "It's the reporter's view?yes", "it is reporter's view ?yes"),
    (N.post_process_gloss, "COMMISSION'S COMMISSIONS , commissions it's 3.5",
     "COMMISSION-POSS COMMISSION COMMISSIONS IT'S 35"),
    (N.preserve_gloss_notation, "﻿IX  BOOK ​ ++ CL:3 #JOHN ", "IX BOOK  ++ CL:3 #JOHN"),
    (N.process_english_text, "  Hello,,, World!!?  OK. ", "hello, world. ok."),
    (N.strip_spatial_markers, " X-rightIX-A+B X-left ", "IX A B"),
    (N.clean_text, "  A_B   c ", "a b c"),
    (N.process_gloss_target, "﻿ ix  book ", "IX BOOK"),
    (N.extract_generation, "  hello <|eot|> x\nsecond", "hello"),
]


@pytest.mark.parametrize("fn,inp,out", GOLDEN)
def test_golden(spark, fn, inp, out):
    got = spark.createDataFrame([(inp,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]
    assert got == out


def test_null_becomes_empty(spark):
    df = spark.createDataFrame([(None,)], "x string")
    row = df.select(N.process_gloss_v2("x").alias("a"), N.process_text("x").alias("b"),
                    N.process_target_text("x").alias("c")).first()
    assert (row.a, row.b, row.c) == ("", "", "")
