"""Column builders over text: tokens, counts, cleaning (C01-C21). All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation as a character class.
PUNCT = r"[!-/:-@\[-`{-~]"
#: Marks stripped from word ends besides ASCII punctuation.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~—–“”‘’«»।॥"
BLANK = r"[ \t\n\x0B\f\r]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """White space off both ends; trim() would leave tabs."""
    return F.regexp_replace(col(c), rf"^{BLANK}|{BLANK}$", "")


def tokens(c: Column | str) -> Column:
    """Parts between white space; none for a blank text."""
    return F.filter(F.split(col(c), BLANK), lambda x: x != "")


def count_of(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern)).cast("bigint")


def punct_count(c: Column | str) -> Column:
    return count_of(c, PUNCT)


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def longest_word(c: Column | str) -> Column:
    return F.coalesce(F.array_max(F.transform(tokens(c), F.char_length)), F.lit(0))


def mean_word_length(c: Column | str) -> Column:
    """Characters in words / (words + 1e-9)."""
    words = tokens(c)
    total = F.aggregate(F.transform(words, F.char_length), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return total.cast("double") / (F.size(words).cast("double") + F.lit(1e-9))


def dense_length(c: Column | str) -> Column:
    """Characters that are not white space."""
    return F.char_length(F.regexp_replace(col(c), BLANK, "")).cast("bigint")


def strip_punct(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(MARKS))


def strip_html(c: Column | str) -> Column:
    """Tags, then urls taken out (both: the second works on what the first left)."""
    return F.regexp_replace(F.regexp_replace(col(c), "<.*?>", ""), r"https?://\S+", "")


def decode_pieces(c: Column | str) -> Column:
    """Sentence pieces to text: blanks go, piece marks become blanks."""
    joined = F.replace(F.replace(col(c), F.lit(" "), F.lit("")), F.lit("▁▀"), F.lit(""))
    return F.ltrim(F.replace(joined, F.lit("▁"), F.lit(" ")))


def numbers(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"(\d+(?:,*\d+)*)"), F.lit(1))


def words_and_marks(c: Column | str) -> Column:
    """Lower-cased words (letters, marks, digits, apostrophes) and single other signs."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{L}\p{M}\p{N}']+|[^\s\p{L}\p{M}\p{N}])"), F.lit(1))


#: The replacements of the mteval-13a tokenizer, in their order.
STEPS_13A = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def tokenize_13a(c: Column | str) -> Column:
    """The tokens that BLEU counts (Papineni et al., 2002; the mteval-13a rules), lower-cased."""
    text = F.concat(F.lit(" "), F.lower(F.regexp_replace(col(c), "\n", " ")), F.lit(" "))
    return tokens(reduce(lambda x, s: F.regexp_replace(x, *s), STEPS_13A, text))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that any SQL engine can repeat: 32 bits of the md5 of the parts, colon-joined."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def seeded_order(seed: str, *parts: Column) -> Column:
    """The md5 that orders rows for splits and samples."""
    return F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))


#: Which way marks cling: to the word before, to the one after, to either one, or to none.
CLINGING = {".": "before", ",": "before", "!": "before", "?": "before", "(": "after", ")": "before", "<": "after", ">": "before", "'": "either", '"': "either", "-": "none"}
#: White space beyond ASCII too, inside a character class.
SPACES = r"\s\p{Z}\x85\x1c-\x1f"


def validate_rules(rules: dict[str, str] | list[tuple[str, str]]) -> dict[str, str]:
    """Normaliser rules: single characters, none of them white space, none twice."""
    pairs = list(rules.items()) if isinstance(rules, dict) else list(rules)
    marks = [m for m, _ in pairs]
    bad = [m for m in marks if len(m) != 1 or m.isspace()]
    if bad or len(set(marks)) < len(marks):
        raise ValueError(f"each rule needs one character of its own that is no white space: {bad or marks}")
    if unknown := {k for _, k in pairs} - {"before", "after", "either", "none"}:
        raise ValueError(f"unknown clinging: {unknown}")
    return dict(pairs)


def char_class(marks: str) -> str:
    return "".join("\\" + m for m in marks)


def normalise_punctuation(c: Column | str, rules: dict[str, str] | None = None) -> Column:
    """Spacing of single punctuation marks by their clinging, ends stripped, white space single.

    A mark with another one next to it, white space aside, stays as it is. A mark that may cling either way keeps the side
    that its spacing shows; at an end of the text it loses all spacing.
    """
    rules = validate_rules(CLINGING if rules is None else rules)
    every = char_class("".join(rules))
    single = lambda marks: rf"(?<![{every}{SPACES}])[{SPACES}]*([{marks}])[{SPACES}]*(?![{every}{SPACES}])"
    edges = lambda x: F.regexp_replace(x, rf"^[{SPACES}]+|[{SPACES}]+$", "")
    out = edges(F.regexp_replace(col(c), rf"[{SPACES}]+", " "))
    for kind, new in (("before", "$1 "), ("after", " $1"), ("none", " $1 ")):
        marks = char_class("".join(m for m, k in rules.items() if k == kind))
        if marks:
            out = edges(F.regexp_replace(out, single(marks), new))
    marks = char_class("".join(m for m, k in rules.items() if k == "either"))
    if marks:
        out = F.regexp_replace(out, rf"^([{marks}]) +(?![{every}])", "$1")
        out = F.regexp_replace(out, rf"(?<![{every} ]) +([{marks}])$", "$1")
    return F.regexp_replace(out, r" +", " ")


def strip_language_code(c: Column | str) -> Column:
    """A sentence end and language code (`</s> eng_Latn`) off the end."""
    return F.regexp_replace(col(c), r" ?</s> ?[a-zA-Z]{3}_[a-zA-Z]{4}$", "")


def contains_letter(c: Column | str) -> Column:
    return col(c).rlike(r"\p{L}")


def starts_with_capital(c: Column | str) -> Column:
    return col(c).rlike(r"^\p{Lu}")
