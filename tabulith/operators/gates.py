"""Quality gates of extracted tables: one aggregate over cells per table, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.cells import CONFUSED, ENCODED, has_sm_nd
from tabulith.functions.text import BLANKS, DIGIT, DIGITS, PUNCTUATION, counted, filled, is_ascii, matches, occurrences, repeats

TABLE = ["pdf_id", "page", "table_id"]
FEATURES = ("columns", "rows", "blank", "digits", "punctuation", "spaces", "encoded", "dotted", "length")

#: Classes of characters: for ASCII texts, and for all.
_NUMERIC = (r"[0-9!-/:-@\[-`{-~Ee]", rf"[{DIGITS}!-/:-@\[-`{{-~Ee±–]")
_SHOWN = ("[^\\t-\\r\\x1c-\\x20]", "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in BLANKS) + "]")
_DIGIT = ("[0-9]", DIGIT)


def mixed_cell(c: Column) -> Column:
    """Whether a mostly numeric cell holds what belongs to several: more dots or signs than one number has, or a repeated piece.

    Most cells are short ASCII with a dot at most: they are told by their length alone, and the
    patterns are kept for the rest.
    """
    plain = is_ascii(c)
    numeric = counted(c, *_NUMERIC) / F.greatest(F.lit(1), counted(c, *_SHOWN)) > 0.7
    signs, dashes = (F.when(plain, 0).otherwise(occurrences(c, x)) for x in "±–")
    brackets = F.when(F.contains(c, F.lit("(")), matches(c, r"(?d)\(.*?\)")).otherwise(0)
    dots = occurrences(c, ".") - signs - dashes - occurrences(c, "@") - brackets
    odd = filled(c) & numeric & ((dots >= 2) | (signs >= 2) | (dashes >= 2) | repeats(c, 5))
    return F.when(plain & (F.length(c) <= 5) & (occurrences(c, ".") < 2), False).otherwise(odd)


def _share(part: Column, of: Column) -> Column:
    return part / F.greatest(F.lit(1), of)


def table_quality(cells: DataFrame, **more: Column) -> DataFrame:
    """Per table: the four gates, whether it is bad, whether it names Sm-Nd, and the two acceptance decisions; and more aggregates over its cells.

    cells: pdf_id, page, table_id, rid, cid, value. A null value counts as empty. A table without
    rows in ``cells`` has no result. A table is accepted for extraction if it is good or names
    Sm-Nd, for fusion only if it is good.
    """
    v = F.coalesce(F.col("value"), F.lit(""))
    shown = filled(v)
    n = F.count_if(shown)
    spaces = _share(F.sum(F.when(shown, occurrences(v, " ")).otherwise(0)), F.sum(F.length(v)))
    plain = is_ascii(v)
    digit = F.when(plain, v.rlike("[0-9]")).otherwise(v.rlike(DIGIT))
    small = (n <= 20) | (F.max("rid") + 1 <= 5) | (F.max("cid") + 1 <= 3)
    got = cells.groupBy(*TABLE).agg(
        (small | (spaces > 0.4)).alias("bad_format"),
        F.bool_or(F.contains(v, F.lit("(cid:")) & v.rlike(ENCODED)).alias("bad_encoding"),
        F.bool_or(mixed_cell(v)).alias("bad_mixture"),
        (F.bool_or(~plain & v.rlike(CONFUSED)) | (_share(F.count_if(shown & ~digit), n) > 0.9)).alias("bad_text"),
        F.bool_or(has_sm_nd(v)).alias("has_header"),
        *[c.alias(name) for name, c in more.items()],
    )
    bad = F.col("bad_format") | F.col("bad_encoding") | F.col("bad_mixture") | F.col("bad_text")
    return got.withColumns({"bad": bad, "accepted_extract": ~bad | F.col("has_header"), "accepted_fuse": ~bad})


def table_features(cells: DataFrame) -> DataFrame:
    """Nine numbers of a table: its sizes in twenties, and means over its cells.

    Digits, punctuation, spaces, encodings, dots and lengths are counted in cells that are not blank.
    """
    v = F.coalesce(F.col("value"), F.lit(""))
    shown = filled(v)
    mean = lambda c: F.sum(F.when(shown, c).otherwise(0)) / F.count("*")
    return cells.groupBy(*TABLE).agg(
        ((F.max("cid") + 1) / 20).alias("columns"),
        ((F.max("rid") + 1) / 20).alias("rows"),
        (F.count_if(~shown) / F.count("*")).alias("blank"),
        mean(counted(v, *_DIGIT)).alias("digits"),
        mean(matches(v, PUNCTUATION)).alias("punctuation"),
        mean(occurrences(v, " ")).alias("spaces"),
        mean(F.contains(v, F.lit("(cid")).cast("int")).alias("encoded"),
        mean((occurrences(v, ".") > 1).cast("int")).alias("dotted"),
        mean(F.length(v)).alias("length"),
    )


def paper_marks(quality: DataFrame) -> DataFrame:
    """Per paper: whether an accepted table has an Sm-Nd header, and a mark for each table by page and table."""
    mark = (F.col("accepted_extract") & F.col("has_header")).cast("int")
    listed = F.array_sort(F.collect_list(F.struct("page", "table_id", mark.alias("mark"))))
    return quality.groupBy("pdf_id").agg((F.max(mark) == 1).alias("has_header"), F.transform(listed, lambda x: x.mark).alias("table_marks"))


def select_attempt(attempts: DataFrame) -> DataFrame:
    """Of the attempts at a table the first that is accepted: good, or with an Sm-Nd header. Tables without one are missing.

    attempts: pdf_id, page, table_id, attempt, bad, has_header. An attempt that failed has nulls.
    """
    kept = attempts.where(~F.col("bad") | F.col("has_header"))
    return kept.groupBy(*TABLE).agg(F.min(F.struct("attempt", "bad", "has_header")).alias("first")).select(*TABLE, "first.*")


def errors(attempts: DataFrame) -> DataFrame:
    """Attempts that gave no table, with their kind: nothing is swallowed."""
    return attempts.where(F.col("bad").isNull()).select(*TABLE, "attempt", F.coalesce("error", F.lit("unknown")).alias("error"))


def rule_agreement(quality: DataFrame, labels: DataFrame) -> DataFrame:
    """How often the gates agree with labelled error classes.

    labels: TABLE, available, encode, format, mixed. A bad format excuses the encoding gate, both
    excuse the mixture gate. Without an available label the shares are null.
    """
    rows = quality.join(labels.where("available"), TABLE)
    same = lambda gate, label: F.col(gate).cast("int") == F.col(label)
    share = lambda c: F.avg(c.cast("double"))
    return rows.agg(
        F.count("*").alias("n"),
        share(same("bad_format", "format")).alias("format"),
        share(same("bad_encoding", "encode") | F.col("bad_format")).alias("encode"),
        share(same("bad_mixture", "mixed") | F.col("bad_format") | F.col("bad_encoding")).alias("mixed"),
    )


def label_precision(quality: DataFrame, negatives: DataFrame) -> DataFrame:
    """The gates (but the text gate) against a list of bad tables: precision of what they pass, and accuracy."""
    listed = quality.join(negatives.select(*TABLE).distinct().withColumn("negative", F.lit(True)), TABLE, "left")
    good = ~(F.col("bad_format") | F.col("bad_encoding") | F.col("bad_mixture"))
    truth = F.col("negative").isNull()
    return listed.agg(
        F.count("*").alias("n"),
        F.try_divide(F.count_if(good & truth), F.count_if(good)).alias("precision"),
        F.avg((good == truth).cast("double")).alias("accuracy"),
    )
