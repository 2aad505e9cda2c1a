r"""Text functions as column expressions: tokens, cleaning, ordered pattern cascades.

Patterns run in Java's dialect. (?d) makes . and $ know \n as the only line terminator, (?U) makes \s, \d, \w and \b
know all of Unicode.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .columns import col, one_of

#: Unicode white space, with the four separators U+001C to U+001F.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[ {BLANKS}]+"
#: Characters that are stripped from a token's ends. Fixed values.
PUNCTUATION = "!\"#$%&'()*+, -./:;<=>?@[\\]^_`{|}~"
LOOSE_PUNCTUATION = ".,!?;:\"'()[]{}<>-–—"
LETTERS = r"^\p{L}+$"


def tokens(text: Column | str) -> Column:
    """The runs of a text between white space; null: none."""
    # one pass makes all white space blanks, so that the split needs no pattern
    plain = F.translate(F.coalesce(col(text), F.lit("")), BLANKS, " " * len(BLANKS))
    return F.filter(F.split(plain, " "), lambda t: t != "")


def stripped(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(text), rf"^{SPACE}|{SPACE}$", "")


def strip_punctuation(token: Column, chars: str = PUNCTUATION) -> Column:
    return F.btrim(token, F.lit(chars))


def nfkc(text: Column) -> Column:
    """Compatibility normal form; null: empty. Spark has no such function, but brings the library that has, whose Unicode may be newer than Python's."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))


def valid_token(token: Column, least: int = 3) -> Column:
    """Letters only, `least` or more."""
    return token.rlike(LETTERS) & (F.length(token) >= least)


def tone_tokens(text: Column | str, stops: Iterable[str], normalise: bool = True) -> Column:
    """Lower-case tokens of three or more letters that are no stopwords. normalise: NFKC of each token first."""
    stop = one_of(stops)
    own = tokens(text)
    # a normal form may hold a blank, which splits no token, but never a new line
    own = F.split(nfkc(F.array_join(own, "\n")), "\n") if normalise else own
    return F.filter(F.transform(own, F.lower), lambda t: valid_token(t) & ~stop(t))


def loose_tokens(text: Column | str) -> Column:
    """Lower-case tokens without punctuation at their ends that hold a letter."""
    own = F.transform(tokens(F.lower(col(text))), lambda t: strip_punctuation(t, LOOSE_PUNCTUATION))
    return F.filter(own, lambda t: t.rlike(r"\p{L}"))


def join_broken_words(text: Column) -> Column:
    """Undoes hyphenation and wrapping at line ends."""
    text = F.regexp_replace(text, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    return F.regexp_replace(text, r"([a-z])\n([a-z])", "$1 $2")


def remove_boilerplate(text: Column, patterns: Sequence[str] = V.BOILERPLATE_PATTERNS) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, f"(?imdU){p}", " ")
    return text


def strip_links(text: Column) -> Column:
    """Web and mail addresses become a space."""
    text = F.regexp_replace(text, r"(?U)https?://\S+|www\.\S+", " ")
    return F.regexp_replace(text, r"(?U)\S+@\S+\.\S+", " ")


def letters_only(text: Column) -> Column:
    """Lower case; all but a to z is white space, single and trimmed."""
    text = F.regexp_replace(F.lower(F.regexp_replace(text, r"[^\x00-\x7F]+", " ")), r"[^a-z\s]", " ")
    return F.trim(F.regexp_replace(text, r"\s{2,}", " "))


def clean_tokens(text: Column | str, stops: Iterable[str] = (), normalise: bool = True) -> Column:
    """The cleaning of page text: normal form, joined words, no boilerplate, no addresses, a to z only; tokens of three or more letters that
    are neither English nor report stopwords nor in `stops`."""
    text = nfkc(col(text)) if normalise else col(text)
    text = letters_only(strip_links(remove_boilerplate(join_broken_words(F.coalesce(text, F.lit(""))))))
    stop = one_of({*V.ENGLISH_STOPWORDS, *V.DOMAIN_STOPWORDS, *stops})
    own = F.transform(tokens(text), strip_punctuation)
    return F.filter(own, lambda t: valid_token(t) & ~stop(t))


def index_tokens(text: Column | str, stops: Iterable[str], lemmas: Mapping[str, str] | None = None) -> Column:
    """The cleaning of the severity index: addresses go, a to z only, tokens of three or more letters that are no stopwords, then their lemmas."""
    own = F.lower(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)http\S+|www\S+", " "))
    stop = one_of(stops)
    # what is no letter parts tokens, as white space does: no other pass is needed
    kept = F.filter(F.split(F.regexp_replace(own, r"[^a-z]+", " "), " "), lambda t: (F.length(t) >= 3) & ~stop(t))
    if not lemmas:
        return kept
    known = F.create_map(*(F.lit(x) for kv in sorted(lemmas.items()) for x in kv))
    return F.transform(kept, lambda t: F.coalesce(F.element_at(known, t), t))


def without_stopwords(text: Column | str, stops: Iterable[str]) -> tuple[Column, Column, Column]:
    """The text without its stopwords (case and punctuation stay), and its number of tokens before and after."""
    stop = one_of(s.lower() for s in stops)
    before = tokens(text)
    after = F.filter(before, lambda t: ~stop(F.lower(t)))
    return F.concat_ws(" ", after), F.size(before).cast("long"), F.size(after).cast("long")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n neighbouring words, joined by a space; fewer words: none."""
    if n == 1:
        return words
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
    found = F.transform(at, lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(n))))
    return F.when(F.size(words) >= n, found).otherwise(F.slice(found, 1, 0))


def bigrams(words: Column) -> Column:
    """ngrams(words, 2) of words that aren't null, in one pass over two slices instead of by places."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def any_pattern(text: Column, patterns: Iterable[str], flags: str = "(?id)") -> Column:
    """Does any of the patterns match anywhere? One alternation, so that the text is searched once."""
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def first_of(text: Column, patterns: Sequence[str], flags: str = "(?idU)") -> Column:
    """Group 1 of the first pattern that matches anywhere (the order of patterns counts, not that of places); null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, flags + p, 1), F.lit("")) for p in patterns))


def lines(text: Column | str) -> Column:
    return F.split(F.coalesce(col(text), F.lit("")), "\n")


def lines_with(text: Column | str, words: Iterable[str], case: bool = False) -> Column:
    """The stripped lines that hold any of the words."""
    known = [w if case else w.lower() for w in words]

    def hit(x: Column) -> Column:
        x = x if case else F.lower(x)
        out = F.lit(False)
        for w in known:
            out = out | x.contains(w)
        return out

    return F.transform(F.filter(lines(text), hit), stripped)


def numbered_titles(text: Column, word: str, number: str) -> Column:
    """array<struct<number, title>> of 'word number: title' headings, in order."""
    p = rf"(?idU){word}\s*({number})\s*[:\-]\s*([^\n]+)"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(p), 1).alias("number"), F.regexp_extract_all(text, F.lit(p), 2).alias("title"))
    return F.transform(both, lambda s: F.struct(s["number"].alias("number"), stripped(s["title"]).alias("title")))
