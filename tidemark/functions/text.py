"""Words, queries and labels of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never count as terms when documents are mined.
STOP_WORDS = "the a an and or to of in on for is it that this with as be at by from".split()


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def terms(text: Column) -> Column:
    """words() of at least two bytes that aren't stop words."""
    return F.filter(words(text), lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOP_WORDS))


def capped(text: Column, most: int, mark: str = "...") -> Column:
    """At most `most` characters, the last ones a mark where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark))).otherwise(text)


def slug(text: Column, most: int = 48) -> Column:
    """Lower case, other characters than letters and digits as single hyphens, cut to `most`."""
    made = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.regexp_replace(F.substring(made, 1, most), r"-+$", "")


def first_sentence(text: Column, most: int = 120) -> Column:
    """The first sentence of the first line of prose, which is one that begins with a letter."""
    line = F.regexp_extract(text, r"(?m)^([\p{L}].*)$", 1)
    return F.substring(F.regexp_replace(line, r"(?s)([.!?])\s.*$", "$1"), 1, most)


def glob_pattern(glob: str) -> str:
    """A repository filter as a LIKE pattern: * is any text, and a name without * matches anywhere."""
    return glob.replace("*", "%") if "*" in glob else f"%{glob}%"
