"""Sentence splitting without a given list of abbreviations (C16), after Kiss and Strunk (2006).

What ends a sentence is learned from the texts: words that nearly always carry a period are abbreviations, words that
follow clear ends are starters, pairs that stand together across a period are collocations. All of it is counts that
Spark sums by word, and log-likelihood ratios of these counts; no table is held by the driver. Only the tokens that carry a period meet what was
learned, by key; a text meets only the places where it is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions import text as X
from lineweave.session import written

#: The thresholds of the published method.
ABBREVIATION, COLLOCATION, STARTER, CERTAIN = 0.3, 7.88, 30.0, 0.99
#: A numeric token counts as this one type.
NUMBER = "##number##"
OPENING, CLOSING = r"^[\p{Ps}\p{Pi}\"'`¿¡-]+", r"[\p{Pe}\p{Pf}\"'`]+$"


def words_of(text: str | Column) -> Column:
    """What stands between white space, in order, as structs: raw; body, without quotation marks and brackets at its ends;
    kind: the lower-cased body without a last period, numbers as one; stop: its last mark if that is `.`, `!` or `?`;
    upper and lower: how its first letter is written."""

    def one(w: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(w, OPENING, ""), CLOSING, "")
        stop = F.regexp_extract(body, r"([.!?])$", 1)
        plain = F.lower(F.when(stop == ".", F.substring(body, 1, F.char_length(body) - 1)).otherwise(F.regexp_replace(body, r"[.!?,;:]+$", "")))
        kind = F.when(plain.rlike(r"^[-+]?\d[\d.,]*$"), NUMBER).otherwise(plain)
        first = F.regexp_extract(body, r"(\p{L})", 1)
        return F.struct(w.alias("raw"), kind.alias("kind"), stop.alias("stop"), first.rlike(r"^\p{Lu}").alias("upper"), first.rlike(r"^\p{Ll}").alias("lower"))

    return F.transform(X.tokens(text), one)


def tokens(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, at, kind, stop, upper, lower, next, next_upper, next_lower, prior): each token of each text with the next one's
    kind and writing, and the stop of the one before (null at either end)."""
    own = texts.select(*key, words_of(text).alias("w"))
    step = lambda x, i: F.struct(
        i.alias("at"), x["kind"].alias("kind"), x["stop"].alias("stop"), x["upper"].alias("upper"), x["lower"].alias("lower"), F.get("w", i + 1)["kind"].alias("next"),
        F.get("w", i + 1)["upper"].alias("next_upper"), F.get("w", i + 1)["lower"].alias("next_lower"), F.when(i > 0, F.get("w", i - 1)["stop"]).alias("prior"),
    )
    return own.select(*key, F.explode(F.transform("w", step)).alias("t")).select(*key, "t.*")


def counted(texts: DataFrame, text: str = "text") -> DataFrame:
    """(kind, stop, n): how many tokens of all texts are written alike. What stands between white space is counted as it is, so only
    distinct writings are taken apart."""
    raw = texts.select(F.explode(X.tokens(text)).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return raw.select(F.get(words_of("raw"), 0).alias("w"), "n").select("w.kind", "w.stop", "n")


def log_of(p: Column) -> Column:
    return F.ln(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300)))


def likelihood(k: Column, n: Column, p: Column) -> Column:
    """The log of the probability of k of n, 0 log 0 being 0."""
    return F.when(k > 0, k * log_of(p)).otherwise(0.0) + F.when(n > k, (n - k) * log_of(1 - p)).otherwise(0.0)


def abbreviation_scores(toks: DataFrame) -> DataFrame:
    """(kind, with_period, without, score): how strongly a type is bound to its period. toks: kind, stop, and where rows stand for
    several tokens n.

    The ratio is that of a period by chance (its share of all tokens) against CERTAIN; it is scaled by 1 / e**length, by the periods
    (inner ones and one more) and by 1 / length**without, length being the characters that are no periods.
    """
    n = F.col("n") if "n" in toks.columns else F.lit(1).cast("long")
    many = lambda c: F.sum(F.when(c, n).otherwise(0))
    types = toks.groupBy("kind").agg(many(F.col("stop") == ".").alias("with_period"), many(F.col("stop") != ".").alias("without"))
    sums = types.agg(F.sum("with_period").alias("_stops"), F.sum(F.col("with_period") + F.col("without")).alias("_all"))
    rows = types.filter("with_period > 0").crossJoin(F.broadcast(sums))  # one row
    n, k = (F.col("with_period") + F.col("without")).cast("double"), F.col("with_period").cast("double")
    ratio = -2 * (likelihood(k, n, F.col("_stops") / F.col("_all")) - likelihood(k, n, F.lit(CERTAIN)))
    length = F.char_length(F.regexp_replace("kind", r"\.", "")).cast("double")
    periods = F.char_length("kind") - length + 1
    score = ratio * F.exp(-length) * periods * F.pow(F.greatest(length, F.lit(1.0)), -F.col("without").cast("double"))
    word = F.col("kind").rlike(r"\p{L}")
    return rows.select("kind", "with_period", "without", F.when(word, score).otherwise(0.0).alias("score"))


def bound(both: Column, first: Column, second: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of a pair: second follows first `both` times, first and second come so often, of n."""
    both, first, second, n = (c.cast("double") for c in (both, first, second, n))
    p, p1, p2 = second / n, both / first, F.when(n > first, (second - both) / (n - first)).otherwise(0.0)
    rest, others = n - first, second - both
    return 2 * (likelihood(both, first, p1) + likelihood(others, rest, p2) - likelihood(both, first, p) - likelihood(others, rest, p))


def learned(texts: DataFrame, text: str = "text") -> dict[str, DataFrame]:
    """abbreviations (kind), starters (kind), collocations (kind, next) and casing (kind, counts of writings inside sentences and
    at their begins), each written once."""
    toks = written(tokens(texts, [], text), "tokens")
    abbreviations = written(abbreviation_scores(toks).filter(F.col("score") >= ABBREVIATION).select("kind"), "abbreviations")
    marked = toks.join(abbreviations.withColumn("abbreviated", F.lit(True)), "kind", "left")
    initial = F.col("kind").rlike(r"^\p{L}$")
    marked = marked.withColumn("doubtful", F.col("abbreviated").isNotNull() | initial | (F.col("kind") == NUMBER))
    ends = F.col("stop").isin("!", "?") | ((F.col("stop") == ".") & ~F.col("doubtful"))
    follows = marked.filter("next IS NOT NULL").select("kind", "stop", "next", "next_upper", "next_lower", "doubtful", ends.alias("ends"))
    follows = written(follows, "follows")
    n = F.broadcast(follows.agg(F.count("*").alias("_n"), F.count_if("ends").alias("_ends")))  # one row
    after = follows.groupBy("next").agg(
        F.count("*").alias("n"), F.count_if("ends").alias("begins"),
        F.count_if(F.col("ends") & F.col("next_upper")).alias("upper_begin"), F.count_if(F.col("ends") & F.col("next_lower")).alias("lower_begin"),
        F.count_if((F.col("stop") == "") & F.col("next_upper")).alias("upper_inside"), F.count_if((F.col("stop") == "") & F.col("next_lower")).alias("lower_inside"),
    ).withColumnRenamed("next", "kind")
    after = written(after, "after")
    scored = after.filter("begins > 0").crossJoin(n).filter(F.col("begins") * F.col("_n") > F.col("n") * F.col("_ends"))
    starters = scored.filter((bound(F.col("begins"), F.col("_ends"), F.col("n"), F.col("_n")) >= STARTER) & F.col("kind").rlike(r"^\p{L}")).select("kind")
    pairs = follows.filter((F.col("stop") == ".") & F.col("doubtful")).groupBy("kind", "next").agg(F.count("*").alias("both")).filter("both > 1")
    firsts = follows.groupBy("kind").agg(F.count("*").alias("first"))
    met = pairs.join(firsts, "kind").join(after.select(F.col("kind").alias("next"), F.col("n").alias("second")), "next").crossJoin(n)
    met = met.filter(F.col("both") * F.col("_n") > F.col("first") * F.col("second"))
    together = met.filter((bound(F.col("both"), F.col("first"), F.col("second"), F.col("_n")) >= COLLOCATION)).select("kind", "next")
    together = together.join(starters.select(F.col("kind").alias("next")), "next", "left_anti")
    return {"abbreviations": abbreviations, "starters": written(starters, "starters"), "collocations": written(together, "collocations"), "casing": after}


def sentences(texts: DataFrame, key: list[str], text: str = "text", model: dict[str, DataFrame] | None = None) -> DataFrame:
    """(key, place, sentence): the sentences of each text, words joined by blanks; place counts from 0.

    `!` and `?` end a sentence. So does a period, unless it is that of an abbreviation, initial or number whose next word
    does not look like a begin: a begin is a starter, or a word with a capital that is also written small, but never with
    a capital inside sentences. A collocation is never parted. key is unique; texts without words have no sentence.
    The model is learned from the texts unless given.
    """
    model = model or learned(texts, text)
    toks = tokens(texts, key, text).filter("next IS NOT NULL AND stop <> ''")
    flag = lambda name, as_: model[name].withColumn(as_, F.lit(True))
    of_next = model["starters"].select(F.col("kind").alias("next"), F.lit(True).alias("starter"))
    casing = model["casing"].select(F.col("kind").alias("next"), "upper_inside", (F.col("lower_inside") + F.col("lower_begin")).alias("small"))
    sure = toks.filter("stop <> '.'").select(*key, "at")
    rows = toks.filter("stop = '.'").join(flag("abbreviations", "abbreviated"), "kind", "left").join(flag("collocations", "together"), ["kind", "next"], "left")
    rows = rows.join(of_next, "next", "left").join(casing, "next", "left")
    doubtful = F.col("abbreviated").isNotNull() | F.col("kind").rlike(r"^\p{L}$") | (F.col("kind") == NUMBER)
    single = F.col("kind").rlike(r"^\p{L}$")
    begin = (F.col("starter").isNotNull() & ~single & F.col("next_upper")) | (F.col("next_upper") & (F.coalesce("small", F.lit(0)) > 0) & (F.coalesce("upper_inside", F.lit(0)) == 0))
    found = rows.filter(~doubtful | (F.col("together").isNull() & begin)).select(*key, "at")
    cuts = sure.unionByName(found).groupBy(*key).agg(F.array_sort(F.collect_list("at")).alias("cuts"))
    whole = texts.select(*key, X.tokens(text).alias("w")).filter(F.size("w") > 0).join(cuts, key, "left")
    edges = F.concat(F.array(F.lit(-1)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.size("w") - 1))
    parts = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: F.array_join(F.slice("w", F.get(edges, k - 1) + 2, F.get(edges, k) - F.get(edges, k - 1)), " "))
    return whole.select(*key, F.posexplode(parts).alias("place", "sentence"))

