"""Cleaning rules and their cascade (F06-F20): a rule is a name and a Column that is true where a row fails.

What several rules ask of a text (word lengths, punctuation marks) is measured once, in a projection below the rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions import text as X

Rule = tuple[str, Column]


@dataclass(frozen=True)
class Rules:
    """Rules in their order, and the text columns whose measures they use."""

    columns: tuple[str, ...]
    rules: tuple[Rule, ...]


def measured(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """rows with _sizes_<column>, the lengths of the column's words, and _marks_<column>, its punctuation marks."""
    sizes = {f"_sizes_{c}": F.transform(X.tokens(c), F.char_length) for c in columns}
    return rows.withColumns(sizes | {f"_marks_{c}": X.punct_count(c) for c in columns})


def n_words(c: str) -> Column:
    return F.size(f"_sizes_{c}")


def marks(c: str) -> Column:
    return F.col(f"_marks_{c}")


def outside(n: Column, low: float, high: float) -> Column:
    return (n < low) | (n > high)


def specific_punct(c: str, limit: int = 5, share: float = 0.5) -> Column:
    """Over `limit` of one of / | -, or over half the text digits and these."""
    many = (X.count_of(c, "/") > limit) | (X.count_of(c, r"\|") > limit) | (X.count_of(c, "-") > limit)
    return many | F.coalesce(X.ratio(X.count_of(c, r"[0-9\-|/]"), F.char_length(c)) > share, F.lit(False))


def word_lengths(c: str, longest: int = 150, low: float = 3, high: float = 20) -> Column:
    """A word beyond `longest`, or a mean length outside [low, high]."""
    sizes = F.col(f"_sizes_{c}")
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double")
    mean = total / (F.size(sizes).cast("double") + F.lit(1e-9))
    return (F.coalesce(F.array_max(sizes), F.lit(0)) > longest) | outside(mean, low, high)


def punct_load(c: str, share: float = 0.5, most: int = 10) -> Column:
    """Over `most` punctuation marks, or over that share of the text."""
    return (marks(c) > most) | F.coalesce(X.ratio(marks(c), F.char_length(c)) > share, F.lit(False))


def html(c: str) -> Column:
    return F.col(c).rlike("<.*?>") | F.col(c).contains("http://") | F.col(c).contains("https://")


def non_latin_share(c: str) -> Column:
    return X.ratio(X.count_of(c, "[^a-zA-Z]"), F.char_length(c))


def line_rules(c: str = "line", low: int = 4, high: int = 200) -> Rules:
    """The single-language rules in their order."""
    rules = (
        ("blank", n_words(c) == 0),
        ("word_count", outside(n_words(c), low, high)),
        ("specific_punct", specific_punct(c)),
        ("word_length", word_lengths(c)),
        ("punctuation", punct_load(c)),
        ("html", html(c)),
        ("special_char", F.col(c).contains("\\x")),
    )
    return Rules((c,), rules)


def either(rule, src: str, trg: str) -> Column:
    return rule(src) | rule(trg)


def cross_ratio(a: Column, b: Column, most: float) -> Column:
    """a / b or b / a beyond `most`; a side of 0 fails unless both are 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when((a == 0) | (b == 0), a != b).otherwise(F.greatest(a / b, b / a) > most)


def pair_punct(src: str, trg: str, least: int = 3, most: int = 12, share: float = 0.5, cross: float = 3.0) -> Column:
    """Of pairs with `least` marks on both sides: over `most`, over that share, or cross-ratio over `cross`."""
    s, t = marks(src), marks(trg)
    near = lambda a, b: a.cast("double") / (b.cast("double") + F.lit(1e-9))
    bad = (s > most) | (t > most) | (near(s, F.char_length(src)) > share) | (near(t, F.char_length(trg)) > share) | (near(s, t) > cross) | (near(t, s) > cross)
    return (s >= least) & (t >= least) & bad


def pair_rules(src: str = "src", trg: str = "trg", low: int = 4, high: int = 200, word_ratio: float = 1.8, char_ratio: float = 3.0) -> Rules:
    """The two-language rules in their order; a blank or equal pair stops at the first."""
    dense = lambda c: F.aggregate(f"_sizes_{c}", F.lit(0).cast("bigint"), lambda a, x: a + x)
    rules = (
        ("blank_or_same", (n_words(src) == 0) | (n_words(trg) == 0) | (F.col(src) == F.col(trg))),
        ("word_count", outside(n_words(src), low, high) | outside(n_words(trg), low, high)),
        ("word_ratio", cross_ratio(n_words(src), n_words(trg), word_ratio)),
        ("specific_punct", either(specific_punct, src, trg)),
        ("word_length", either(word_lengths, src, trg)),
        ("punctuation", pair_punct(src, trg)),
        ("html", either(html, src, trg)),
        ("special_char", either(lambda c: F.col(c).contains("\\x"), src, trg)),
        ("char_ratio", cross_ratio(dense(src), dense(trg), char_ratio)),
    )
    return Rules((src, trg), rules)


def first_failure(rules: tuple[Rule, ...]) -> Column:
    """The name of the first rule that a row fails; null for none. One CASE, so later rules are not evaluated."""
    out = None
    for name, fails in rules:
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out


def cascade(rows: DataFrame, rules: Rules, out: str = "reason") -> DataFrame:
    judged = measured(rows, rules.columns).withColumn(out, first_failure(rules.rules))
    return judged.drop(*(f"_{m}_{c}" for m in ("sizes", "marks") for c in rules.columns))


def report(judged: DataFrame, by: list[str], reason: str = "reason") -> DataFrame:
    """Rows of each reason and their share of the group (F18): sums first, then a window over a few rows."""
    counts = judged.groupBy(*by, F.coalesce(reason, F.lit("kept")).alias(reason)).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return counts.join(totals, by).withColumn("share", F.round(F.col("n") / F.col("total"), 6)).drop("total")


SCRIPTS = {"Latn": r"\p{IsLatin}", "Cyrl": r"\p{IsCyrillic}", "Grek": r"\p{IsGreek}", "Arab": r"\p{IsArabic}", "Deva": r"\p{IsDevanagari}", "Hani": r"\p{IsHan}", "Hebr": r"\p{IsHebrew}"}


def script_of(c: str, scripts: dict[str, str] | None = None) -> Column:
    """The script with most characters (the first of equals); None as a text if there is no such character (C14)."""
    scripts = scripts or SCRIPTS
    counted = F.array(*(F.struct(X.count_of(c, p).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("s")) for i, (name, p) in enumerate(scripts.items())))
    top = F.array_max(counted)
    return F.when(top["n"] > 0, top["s"]).otherwise("None")


def wrong_script(c: str, allowed: str = r"\p{IsLatin}\p{IsInherited}\p{IsCommon}", least: int = 1) -> Column:
    """At least so many characters outside the allowed scripts."""
    return X.count_of(c, f"[^{allowed}]") >= least


def clean_rows(rows: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """Ends stripped, newlines to blanks, rows with a side of one character or less dropped, unknown splits to
    train; `changed` tells whether a text was altered (F19)."""
    changed = F.lit(False)
    for c in columns:
        new = F.regexp_replace(X.strip(c), "\n", " ")
        changed = changed | (new != F.col(c))
        rows = rows.withColumn(f"_{c}", new)
    rows = rows.withColumn("changed", changed)
    for c in columns:
        rows = rows.withColumn(c, F.col(f"_{c}")).drop(f"_{c}").filter(F.char_length(c) > 1)
    known = F.lower(F.coalesce(split, F.lit(""))).isin("train", "test", "val", "dev")
    return rows.withColumn(split, F.when(known, F.lower(split)).otherwise("train"))


def drop_common_terms(rows: DataFrame, column: str, terms: list[str], sep: str = ";") -> DataFrame:
    """Rows none of whose variants is a common term."""
    return rows.filter(~F.arrays_overlap(F.transform(F.split(column, sep), lambda t: F.trim(t)), F.array(*map(F.lit, terms))))
