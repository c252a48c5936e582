"""Text cleaning as Catalyst expressions (T1, T2; F11, F13-F18, F20).

The reference runs an HTML parser, a sentence/word tokeniser and a stemmer
row by row in one Python process.  Here each step is a built-in column
expression on every executor (functions over arrays are interpreted, the
others are generated code):

    strip_html -> collapse whitespace -> drop links -> split on spaces
    -> keep tokens with an ASCII letter -> delete ASCII punctuation, lowercase
    -> stem (``functions.stem``, once for each distinct token) -> join with single spaces
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stem import let, stem_tokens  # noqa: F401 (let is part of this module's interface)

# Code points of the named entities of HTML, from the standard library.
ENTITY_CODES = {**name2codepoint, "apos": 39}
# The regular expressions.  A tag begins with a letter, '/' or '!' after '<'.
SCRIPT_RE = r"(?is)<script[^>]*>.*?</script[^>]*>"
STYLE_RE = r"(?is)<style[^>]*>.*?</style[^>]*>"
COMMENT_RE = r"(?s)<!--.*?-->"
TAG_RE = r"<[a-zA-Z/!][^>]*>"
# white space that is not one space already
SPACE_RE = r"[\t\n\x0B\f\r\p{Z}&&[^ ]][\t\n\x0B\f\r\p{Z}]*+| [\t\n\x0B\f\r\p{Z}]++"
LINK_RE = r"https?://[^ ]+"
LETTER_RE = r"[a-zA-Z]"
PUNCT_RE = r"\p{Punct}"
# punctuation that separates words even without a space: brackets, quotes, ; @ # $ % & ? !, dashes, dots in a row
APART_RE = r"[\[\](){}<>;@#$%&?!\"]|--+|\.\.\.+"
# a comma or colon, unless a digit follows
COMMA_RE = r"[:,]([^0-9]|$)"
# the ending of a contraction is a word of its own (the first look is at one character, which most places fail)
ENDING_RE = r"(?i)(?=['n])('ll|'re|'ve|n't|'s|'m|'d)([^a-zA-Z]|$)"
# a whole space-delimited token without an ASCII letter, after its space
NO_LETTER_TOKEN_RE = r" [^a-zA-Z ]++(?![^ ])"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_html(col) -> Column:
    """drop script/style blocks and comments, turn tags into spaces,
    decode entities once.  Rows without '<' or '&' skip the
    regular expressions."""
    c = _c(col)
    s = F.regexp_replace(c, SCRIPT_RE, " ")
    s = F.regexp_replace(s, STYLE_RE, " ")
    s = F.regexp_replace(s, COMMENT_RE, " ")
    s = F.regexp_replace(s, TAG_RE, " ")
    s = F.when(s.contains("&"), decode_entities(s)).otherwise(s)
    return F.when(c.contains("<") | c.contains("&"), s).otherwise(c)


def decode_entities(col) -> Column:
    """Numeric (decimal, hexadecimal) and named character references, each
    decoded once; a reference to no character becomes U+FFFD, and what is no
    reference stays as it is."""
    names = F.create_map(*[F.lit(x) for kv in sorted(ENTITY_CODES.items()) for x in kv])

    def part(p, i):
        decimal = F.regexp_extract(p, "^#([0-9]{1,7});", 1)
        hexa = F.regexp_extract(p, "^#[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(decimal != "", decimal.try_cast("int")).when(hexa != "", F.conv(hexa, 16, 10).try_cast("int")).otherwise(
            F.try_element_at(names, F.regexp_extract(p, "^([a-zA-Z][a-zA-Z0-9]*);", 1)))
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.when((i == 0), p).when(code.isNull(), F.concat(F.lit("&"), p)).otherwise(
            F.concat(char, F.regexp_replace(p, "^[^;]*;", "")))

    return F.array_join(F.transform(F.split(col, "&"), part), "")


def collapse_spaces(col) -> Column:
    """every run of whitespace becomes one space."""
    return F.regexp_replace(_c(col), SPACE_RE, " ")


def drop_links(col) -> Column:
    """remove http(s) links (after spacing is standardised)."""
    return F.regexp_replace(_c(col), LINK_RE, "")


def normalized_text(col) -> Column:
    """F11 -> F13 -> F14, in the reference's order (Q19)."""
    return drop_links(collapse_spaces(strip_html(col)))


def word_tokens(col) -> Column:
    """F16-F18 on already normalised (single-spaced) text: the tokens are the
    words that contain an ASCII letter, with ASCII punctuation deleted,
    lowercased.  Brackets, quotes, separating punctuation, dashes and the
    endings of contractions part words like spaces do.

    Done on the whole text (two regular-expression passes per document, then
    a split) rather than per token: deleting punctuation never adds or
    removes a letter or a space, so it commutes with the split and the
    letter test."""
    s = F.regexp_replace(_c(col), APART_RE, " ")
    s = F.regexp_replace(s, COMMA_RE, " $1")
    s = F.regexp_replace(s, ENDING_RE, " $1$2")
    s = F.regexp_replace(s, PUNCT_RE, "")
    s = F.regexp_replace(F.concat(F.lit(" "), s), NO_LETTER_TOKEN_RE, "")
    return F.array_remove(F.split(F.lower(s), " "), "")


def clean_tokens(col) -> Column:
    """T1 up to tokens, unstemmed."""
    return word_tokens(normalized_text(col))


def stemmed_tokens(col) -> Column:
    """T1 tokens stemmed in place (few rows; corpora go through ``stem.stemmed_vocabulary``)."""
    return stem_tokens(clean_tokens(col))


def clean_message(col) -> Column:
    """The cleaned, stemmed message as one space-joined phrase (few rows, as above)."""
    return F.array_join(stemmed_tokens(col), " ")


def keyword_tokens(col) -> Column:
    """A taxonomy name through the same token rules as messages
    (so both sides always agree, Q6); no markup or link handling."""
    return stem_tokens(word_tokens(collapse_spaces(col)))


def tidy_split(col, sep: str = ",", keep: bool = False) -> Column:
    """F12 / D4 as an array expression to explode: split a delimited string,
    strip spaces and the characters ``[ ] '``; with ``keep`` the original
    string is added first when it splits into more than one value."""
    c = _c(col)
    parts = F.split(c, sep if sep not in ".^$|?*+()[]{}\\" else "\\" + sep)
    cleaned = F.transform(parts, lambda p: F.trim(F.translate(p, "[]'", "")))
    if not keep:
        return cleaned
    whole = F.trim(F.translate(c, "[]'", ""))
    return F.when(F.size(parts) > 1, F.concat(F.array(whole), cleaned)).otherwise(cleaned)
