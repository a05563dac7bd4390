"""Quotation linking for mail-like conversations (native DataFrame operations only).

A line's quote level is the number of `>` in its leading marker. Consecutive lines of one
level are a passage; blank lines end it. Passages are normalised (lower case, every run of
other than letters and digits to one space) and hashed, whole and line by line, and joined to
the messages that hold the same words unquoted (as body, paragraph or line): first the
earliest message of the same conversation, else the earliest of all, always before the quoting
message in order of (conv_id, turn). The message that most of the level-1 passages' words
point to is the parent. Parents make threads; a thread in order of depth, then conv_id and
turn, has every message after the one it answers.

Originals are pre-aggregated to one row per hash before the join, so a line that a third of
all messages hold or quote multiplies nothing; positions in a thread come from a range sort and
the least position of each thread, so no thread is gathered in one task.

Defined cases: a null or empty text has an empty body and no passages; passages of other than
letters and digits link to nothing; rows with equal conv_id and turn are one message (their
quotes count together, each row keeps its body and has its own position); a message with a
null conv_id or turn links to nothing; an empty table gives no rows; other columns are kept,
whatever their names, but for those that the result itself has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.llm.common import checkpointed

MARKER = r"^(?:[ \t]*>)+"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _hash(words: Column) -> Column:
    return F.unhex(F.md5(words.cast("binary")))


def parse(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `body` (unquoted lines), `n_passages` (quoted runs of lines) and `units`:
    array<struct<level, weight, hash>>, what a message can be linked by. These are, of every
    quoted passage and own paragraph (level 0), the whole, weighing its lines and one more, and
    each line; and the body. Parts without letters and digits give no unit."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    marked = F.transform(lines, lambda s: F.struct(s.alias("line"), F.regexp_extract(s, MARKER, 0).alias("marker")))
    cut = F.transform(marked, lambda p: F.struct(
        p["line"], (F.length(p["marker"]) - F.length(F.replace(p["marker"], F.lit(">"), F.lit("")))).alias("level"),
        F.substr(p["line"], F.length(p["marker"]) + 1).alias("rest")))
    df = messages.withColumn("_cut", F.transform(cut, lambda p: F.struct(
        p["line"], p["level"], normalised(p["rest"]).alias("words"), (F.trim(p["rest"]) == "").alias("blank"))))
    # blank lines have no level: they belong to no run
    df = df.withColumn("_level", F.transform("_cut", lambda p: F.when(p["blank"], -1).otherwise(p["level"])))
    df = df.withColumn("_starts", F.filter(F.sequence(F.lit(1), F.size("_level")), lambda i: (
        (i == 1) | (F.element_at("_level", i) != F.element_at("_level", F.greatest(i - 1, F.lit(1)))))))
    df = df.withColumn("_runs", F.filter(F.transform("_starts", lambda s, k: F.struct(
        F.element_at("_level", s).alias("level"),
        F.slice("_cut", s, F.coalesce(F.get("_starts", k + 1), F.size("_level") + 1) - s).alias("cut"))), lambda r: r["level"] >= 0))
    own = F.filter("_cut", lambda p: p["level"] == 0)

    def words(cut: Column) -> Column:
        return F.filter(F.transform(cut, lambda p: p["words"]), lambda w: w != "")

    def unit(level, weight, text: Column) -> Column:
        return F.struct(level.cast("int").alias("level"), weight.cast("long").alias("weight"), _hash(text).alias("hash"))

    listed = F.transform("_runs", lambda r: F.struct(r["level"], F.size(r["cut"]).alias("size"), words(r["cut"]).alias("words")))
    of_runs = F.transform(F.filter(listed, lambda r: F.size(r["words"]) > 0), lambda r: F.concat(
        F.array(unit(r["level"], r["size"] + 1, F.array_join(r["words"], " "))), F.transform(r["words"], lambda w: unit(r["level"], F.lit(1), w))))
    of_body = F.transform(F.filter(F.array(F.array_join(words(own), " ")), lambda w: w != ""), lambda w: unit(F.lit(0), F.lit(0), w))
    return df.withColumns({
        "body": F.regexp_replace(F.array_join(F.transform(own, lambda p: p["line"]), "\n"), r"^\s+|\s+$", ""),
        "n_passages": F.size(F.filter("_runs", lambda r: r["level"] > 0)).cast("long"),
        "units": F.concat(of_body, F.flatten(of_runs)),
    }).drop("_cut", "_level", "_starts", "_runs")


def matches(parsed: DataFrame, conv="conv_id", turn="turn") -> DataFrame:
    """(c, t, level, weight, oc, ot, near) of every quoted unit that has an original."""
    units = (parsed.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.explode("units").alias("u")).filter("c is not null and t is not null")
             .select("c", "t", "u.level", "u.weight", "u.hash"))
    quoted = units.filter("level > 0").groupBy("c", "t", "level", "hash").agg(F.sum("weight").alias("weight"))
    here = units.filter("level = 0").groupBy("c", "hash").agg(F.min("t").alias("here"))
    first = here.groupBy("hash").agg(F.min(F.struct("c", F.col("here").alias("t"))).alias("first"))
    found = quoted.join(here, ["c", "hash"], "left").join(first, "hash", "left")
    near = F.coalesce(F.col("here") < F.col("t"), F.lit(False))
    far = F.coalesce(F.col("first") < F.struct("c", "t"), F.lit(False))
    return (found.filter(near | far)
            .select("c", "t", "level", "weight", near.cast("int").alias("near"),
                    F.when(near, F.col("c")).otherwise(F.col("first.c")).alias("oc"),
                    F.when(near, F.col("here")).otherwise(F.col("first.t")).alias("ot")))


def link(parsed: DataFrame, conv="conv_id", turn="turn") -> DataFrame:
    """(c, t, n_linked, pc, pt) of every message with a link: originals linked to (of any
    level), and the parent, null if only deeper levels link."""
    by_original = matches(parsed, conv, turn).groupBy("c", "t", "oc", "ot").agg(
        F.max("near").alias("near"), F.sum(F.when(F.col("level") == 1, F.col("weight"))).alias("w"))
    best = F.max(F.when(F.col("w").isNotNull(), F.struct("near", "w", "oc", "ot")))
    return (by_original.groupBy("c", "t").agg(F.count(F.lit(1)).alias("n_linked"), best.alias("b"))
            .select("c", "t", "n_linked", F.col("b.oc").alias("pc"), F.col("b.ot").alias("pt")))


def threads(parents: DataFrame) -> DataFrame:
    """(c, t, pc, pt) -> (c, t, rc, rt, depth): the root of each message's thread and its distance,
    by doubling the jumps; parents precede their replies, so it ends."""
    state = checkpointed(parents.select("c", "t", F.col("pc").alias("rc"), F.col("pt").alias("rt"), F.lit(1).cast("long").alias("depth")))
    while True:
        jump = state.select(F.col("c").alias("rc"), F.col("t").alias("rt"), F.col("rc").alias("c2"), F.col("rt").alias("t2"), F.col("depth").alias("d2"))
        if state.join(jump, ["rc", "rt"], "left_semi").limit(1).count() == 0:
            return state
        state = checkpointed(state.join(jump, ["rc", "rt"], "left").select(
            "c", "t", F.coalesce("c2", "rc").alias("rc"), F.coalesce("t2", "rt").alias("rt"),
            (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth")))


def reply_ordered(messages: DataFrame, conv="conv_id", turn="turn", text_col="text", keep_text: bool = True) -> DataFrame:
    """Every message with body, n_passages, n_linked, parent_conv, parent_turn, thread_conv,
    thread_turn, depth and position (from 0) in its thread; its text only with `keep_text`. The
    messages are read and parsed once; what is parsed goes to the checkpoint folder."""
    from glosspark.operators.ordinals import sorted_ordinal
    made = ["body", "n_passages", "n_linked", "parent_conv", "parent_turn", "thread_conv", "thread_turn", "depth", "position"]
    carried = [c for c in messages.columns if c not in (conv, turn, text_col, *made)]
    # other columns travel in one, so that none meets a name used here
    parsed = parse(messages.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(text_col).alias("x"),
                                   F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)]).alias("others")), "x")
    held = checkpointed(parsed if keep_text else parsed.drop("x"))
    links = checkpointed(link(held, "c", "t"))
    roots = threads(links.filter("pc is not null"))
    flat = held.drop("units").join(links, ["c", "t"], "left").join(roots, ["c", "t"], "left")
    flat = flat.withColumns({
        "n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"), "depth": F.coalesce("depth", F.lit(0)).cast("long"),
        "rc": F.when(F.col("depth").isNull(), F.col("c")).otherwise(F.col("rc")),
        "rt": F.when(F.col("depth").isNull(), F.col("t")).otherwise(F.col("rt")),
    })
    numbered = sorted_ordinal(flat, ["rc", "rt", "depth", "c", "t", "body"], "_ord")
    start = numbered.groupBy(F.col("rc").alias("sc"), F.col("rt").alias("st")).agg(F.min("_ord").alias("_start"))
    same = F.col("rc").eqNullSafe(F.col("sc")) & F.col("rt").eqNullSafe(F.col("st"))
    return numbered.join(start, same).select(
        F.col("c").alias(conv), F.col("t").alias(turn), *([F.col("x").alias(text_col)] if keep_text else []),
        *[F.col(f"others.c{i}").alias(c) for i, c in enumerate(carried)],
        "body", "n_passages", "n_linked", F.col("pc").alias("parent_conv"), F.col("pt").alias("parent_turn"), F.col("rc").alias("thread_conv"),
        F.col("rt").alias("thread_turn"), "depth", (F.col("_ord") - F.col("_start")).alias("position"))


def as_mail(chat: DataFrame, conv="conv_id", turn="turn", text_col="text") -> DataFrame:
    """A chat rendered as mail: each message quotes the turn before it, and that turn's own quote
    of the turn before that, one level deeper, above its own text. Other columns than the three
    are kept if their names are not `_q1` and `_q2`."""
    one = chat.groupBy(conv, turn).agg(F.min(text_col).alias("_q"))

    def before(k: int) -> DataFrame:
        return one.select(F.col(conv), (F.col(turn) + k).alias(turn), F.col("_q").alias(f"_q{k}"))

    def marked(text: Column, marker: str) -> Column:
        return F.regexp_replace(text, "(?m)^", marker)

    return (chat.join(before(1), [conv, turn], "left").join(before(2), [conv, turn], "left")
            .withColumn(text_col, F.concat_ws("\n", F.when(F.col("_q1").isNotNull(), marked(F.col("_q2"), ">> ")), marked(F.col("_q1"), "> "), F.col(text_col)))
            .drop("_q1", "_q2"))
