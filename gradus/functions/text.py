"""Column functions over text: tokens, readability, language, normal forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
WORD_START, WORD_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# Vowels (Latin and Cyrillic), sentence ends, and the grade range of each cognitive level.
VOWELS = "[aeiouAEIOUyYаеиоуАЕИОУ]+"
GRADE_TARGETS = {"unistructural": (4, 10), "multistructural": (6, 12), "relational": (8, 14), "extended_abstract": (10, 16)}
# Words and letters that tell Serbian from English.
SR_LETTERS = "[čćžšđČĆŽŠĐ]"
CYRILLIC = "[Ѐ-ӿ]"
SR_WORDS = ["je", "su", "nije", "jeste", "koji", "koja", "koje", "sa", "kao", "ali", "ili", "ovo", "onaj", "takođe", "pojam", "primer"]
EN_WORDS = ["the", "of", "and", "is", "are", "that", "this", "with", "from", "which", "because"]
# Typographic characters and their plain forms.
TYPOGRAPHY = {"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "…": "...", "•": "-", " ": " ", "−": "-", "ﬁ": "fi", "ﬂ": "fl"}


def tokens(c: Column, lower: bool = True) -> Column:
    """Runs of letters, digits and underscores; null for null."""
    return F.regexp_extract_all(F.lower(c) if lower else c, F.lit(TOKEN), 0)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def count_sentences(c: Column) -> Column:
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.regexp_count(c, F.lit("[.!?]+"))))


def count_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0))


def count_syllables(c: Column) -> Column:
    """Vowel groups of each word, one at least. No group reaches beyond its word, so these are the groups of the text and the words without a vowel."""
    bare = rf"{WORD_START}[\p{{L}}\p{{N}}_&&[^{VOWELS[1:-2]}]]++{WORD_END}"
    return F.coalesce(F.regexp_count(c, F.lit(VOWELS)) + F.regexp_count(c, F.lit(bare)), F.lit(0))


def rounded(c: Column, digits: int) -> Column:
    """A double rounded as DuckDB does it: the nearest whole number of units, halves away from zero. (Spark's `round` looks at the decimal digits instead, and near a half the two differ.)"""
    return F.round(c * 10.0**digits, 0) / 10.0**digits


def flesch_ease(sentences: Column, words: Column, syllables: Column) -> Column:
    value = 206.835 - 1.015 * (words / F.nullif(sentences, F.lit(0))) - 84.6 * (syllables / F.nullif(words, F.lit(0)))
    return rounded(value, 1)


def kincaid_grade(sentences: Column, words: Column, syllables: Column) -> Column:
    value = 0.39 * (words / F.nullif(sentences, F.lit(0))) + 11.8 * (syllables / F.nullif(words, F.lit(0))) - 15.59
    return rounded(value, 1)


def grade_bucket(grade: Column) -> Column:
    return F.when(grade < 6, "easy").when(grade < 12, "medium").when(grade.isNotNull(), "hard")


def grade_fit(grade: Column, level: Column) -> Column:
    """Whether a grade lies in the range of a cognitive level."""
    low = reduce(lambda w, kv: w.when(level == kv[0], kv[1][0]), GRADE_TARGETS.items(), F.when(F.lit(False), 0))
    high = reduce(lambda w, kv: w.when(level == kv[0], kv[1][1]), GRADE_TARGETS.items(), F.when(F.lit(False), 0))
    return F.when(grade.isNull() | low.isNull(), "unknown").when(grade < low, "too_easy").when(grade > high, "too_hard").otherwise("in_range")


def detect_language(c: Column) -> Column:
    """'sr' or 'en' from the first 5,000 characters: letters, then common words."""
    sample = F.substring(c, 1, 5000)
    hits = lambda listed: F.regexp_count(F.lower(sample), F.lit(f"{WORD_START}(?:{'|'.join(listed)}){WORD_END}"))
    letters = F.regexp_count(sample, F.lit(SR_LETTERS))
    serbian = letters + hits(SR_WORDS)
    yes = sample.rlike(CYRILLIC) | (letters >= 2) | ((serbian > hits(EN_WORDS)) & (serbian >= 1))
    return F.when(F.coalesce(yes, F.lit(False)), "sr").otherwise("en")


def normalize_concept(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")


def crude_stem(w: Column) -> Column:
    """Strip the first of ies, es, s, ing, ed that leaves more than two letters."""
    out = F.when(F.lit(False), w)
    for suffix in ("ies", "es", "s", "ing", "ed"):
        out = out.when((F.length(w) > len(suffix) + 2) & w.endswith(suffix), F.substring(w, F.lit(1), F.length(w) - len(suffix)))
    return out.otherwise(w)


def stemmed(c: Column) -> Column:
    """Stemmed plain words of a phrase."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), " "), lambda w: w != "")
    return F.transform(words, crude_stem)


def make_iri(c: Column, prefix: str = "") -> Column:
    """An identifier from text: other characters become one underscore, a leading digit gets N_."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_"), "_+", "_"), "^_+|_+$", "")
    clean = F.when(clean.rlike("^[0-9]"), F.concat(F.lit("N_"), clean)).otherwise(clean)
    if prefix:
        return F.when(F.coalesce(c, F.lit("")) == "", prefix + "Unknown").otherwise(F.concat(F.lit(prefix), clean))
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown").when(clean == "", "Unknown").otherwise(clean)


def escape_literal(c: Column) -> Column:
    """Backslash, quote, line feed, carriage return and tab escaped."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def latinize(c: Column) -> Column:
    """Typographic characters to plain ones; what is then outside Latin-1 becomes a question mark."""
    for raw, plain in TYPOGRAPHY.items():
        c = F.replace(c, F.lit(raw), F.lit(plain))
    return F.regexp_replace(c, r"[^\x{0000}-\x{00FF}]", "?")


def strip_markers(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("<hl>"), F.lit(" ")), r"\s+", " "))


def slide_heading(c: Column) -> Column:
    """The first line with text, if it looks like a heading: 3 to 80 characters, ten words at most, no final stop, no lower-case start."""
    line = F.get(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    fits = (F.length(line).between(3, 80)) & (F.size(F.split(F.regexp_replace(line, r"\s+", " "), " ")) <= 10) & ~line.endswith(".") & ~line.rlike(r"^\p{Ll}")
    return F.when(fits, line)


def offsets_of(c: Column, needle: Column, most: int = 200) -> Column:
    """0-based places of a literal needle, not overlapping, the first `most`."""
    pieces = F.split(c, F.concat(F.lit(r"\Q"), needle, F.lit(r"\E")))
    ends = F.transform(F.slice(pieces, 1, most), lambda p: F.length(p))
    run = F.transform(ends, lambda x, i: F.aggregate(F.slice(ends, F.lit(1), i + 1), F.lit(0), lambda s, v: s + v) + i * F.length(needle))
    return F.when(F.size(pieces) > 1, F.slice(run, F.lit(1), F.least(F.size(pieces) - 1, F.lit(most)))).otherwise(F.array().cast("array<int>"))


def exact_mean(c: Column, digits: int) -> Column:
    """Mean of a double column rounded half up to `digits`, from a sum of millionths: the same in whatever order rows are added."""
    unit = F.lit(10 ** (6 - digits))
    total, n = F.sum(F.round(c * 1e6).cast("long")), F.count(c)
    return F.call_function("div", total * 2 + n * unit, n * unit * 2) / F.lit(10.0**digits)


def exact_mean_sql(x: str, digits: int, where: str = "") -> str:
    """The same in DuckDB."""
    unit = 10 ** (6 - digits)
    return f"((sum(round(({x}) * 1e6)::BIGINT){where}::BIGINT * 2 + count({x}){where} * {unit}) // (count({x}){where} * {2 * unit}))::DOUBLE / {10.0**digits}"
