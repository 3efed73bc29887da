"""Column functions over text and token arrays; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: English function words (fixed values, an often used short list).
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "is", "it", "that", "this", "was", "for", "with", "as", "by", "are", "be", "at", "from")
#: Words that stay even though they are function words (fixed values).
NEGATIONS = ("but", "cannot", "hardly", "however", "neither", "never", "no", "nor", "not", "although", "without", "yet")
#: Letters of words in patterns.
_WORD = r"[\p{L}\p{N}_]"


def clean_book(c: Column) -> Column:
    """Letters, digits and white space, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", "")), r"\s+", " "))


def words(c: Column) -> Column:
    """Tokens of clean_book."""
    return F.filter(F.split(clean_book(c), " "), lambda w: w != "")


def lm_tokens(c: Column) -> Column:
    """Words with inner apostrophes or hyphens, and single other signs."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"({_WORD}+(?:['’\-]{_WORD}+)*|[^\p{{L}}\p{{N}}_\s])"), 1)


def sentiment_tokens(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """a-z tokens and n't, without stop words but with negations; all tokens if
    none would be left."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"(n't|[a-z]+(?:'[a-z]+)*)"), 1)
    kept = F.filter(tokens, lambda w: ~w.isin(*stop) | w.isin(*NEGATIONS) | F.endswith(w, F.lit("n't")))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def sentences(c: Column) -> Column:
    """Pieces that end with . ! or ? before white space."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens; none if there are fewer. Give it a column, not an
    expression: the column is read for each run."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.slice(tokens, i, n))).otherwise(F.array().cast("array<array<string>>"))


def joined_ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, each joined by blanks. Give it a column, not an
    expression."""
    if n == 1:
        return tokens
    count = F.size(tokens) - (n - 1)
    run = lambda i: F.concat_ws(" ", *(F.get(tokens, i + k) for k in range(n)))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), run)).otherwise(F.array().cast("array<string>"))


def char_ngrams(chars: Column, n: int) -> Column:
    """All runs of n characters, from the array of a text's characters."""
    return F.transform(ngrams(chars, n), lambda g: F.array_join(g, ""))


def fold_polish(c: Column) -> Column:
    """Polish letters without their marks."""
    return F.translate(c, "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ")


def normalised_levenshtein(a: Column, b: Column) -> Column:
    """Similarity 1 - distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Sum of the lesser counts of each element of two arrays."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Overlap over union of two bags; 1 for two empty ones."""
    both = multiset_overlap(a, b)
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def bag_cosine(a: Column, b: Column) -> Column:
    """Overlap over the geometric mean of the sizes."""
    return multiset_overlap(a, b) / F.sqrt((F.size(a) * F.size(b)).cast("double"))


def hamming(a: Column, b: Column) -> Column:
    """Places that differ, and those that only one text has."""
    n = F.least(F.length(a), F.length(b))
    differ = F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))).otherwise(0)
    return differ + F.greatest(F.length(a), F.length(b)) - n


def characters(c: Column) -> Column:
    """The code points of a text."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def book_body(c: Column, start: str, end: str) -> Column:
    """What stands between the line that has ``start`` and the text ``end``."""
    after = F.when(F.instr(c, start) > 0, F.substring(c, F.instr(c, start) + F.lit(len(start)), F.length(c))).otherwise(c)
    line = F.when(F.instr(c, start) > 0, F.substring(after, F.instr(after, "\n") + 1, F.length(after))).otherwise(after)
    return F.trim(F.when(F.instr(line, end) > 0, F.substring(line, F.lit(1), F.instr(line, end) - 1)).otherwise(line))
