"""Column functions on text: tokens, normal forms, matches, snippets."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words.
STOP_WORDS = tuple(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)
#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: All white space of Unicode, and the separators 1C to 1F.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _accents() -> tuple[str, str]:
    """Letters that decompose into a letter and marks, with that letter; and the marks, which go."""
    letters, plain, marks = [], [], []
    for c in map(chr, range(0x80, 0x10000)):
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        base = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if c == c.lower() and unicodedata.category(c) == "Ll" and len(base) == 1 and base[0] != c:
            letters.append(c)
            plain.append(base[0])
    return "".join(letters + marks), "".join(plain)


_ACCENTED, _PLAIN = _accents()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; inside a lambda a plain expression is worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends, where ``trim`` alone takes spaces."""
    return F.btrim(text, F.lit(WHITE))


def blank(text: Column) -> Column:
    """Whether there is nothing but white space; null for null."""
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def nonempty(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def whitespace_tokens(text: Column) -> Column:
    """Runs of characters that aren't white space, in Unicode's sense."""
    return nonempty(F.split(text, r"(?U)\s+"))


def scan_tokens(text: Column) -> Column:
    """Lower-cased white-space tokens, repeats kept."""
    return whitespace_tokens(F.lower(text))


def term_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def query_tokens(text: Column) -> Column:
    """White-space tokens without non-word characters and underscores at their ends."""
    return nonempty(F.transform(whitespace_tokens(text), lambda t: F.regexp_replace(t, r"(?U)^[\W_]+|[\W_]+$", "")))


def fold_accents(text: Column) -> Column:
    """Lower case, accents and other marks removed, whether they are part of the letter or follow it."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def folded_tokens(text: Column) -> Column:
    """Runs of letters and digits, case and accents folded."""
    return F.regexp_extract_all(fold_accents(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def without_stop_words(tokens: Column, words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Tokens that aren't stop words, in order, repeats kept."""
    return F.filter(tokens, lambda t: ~F.lower(t).isin(*words))


def token_count(text: Column) -> Column:
    return F.size(whitespace_tokens(text))


def truncate_tokens(text: Column, most: int) -> Column:
    """The text itself if it has at most so many tokens, else its first ones joined by spaces."""
    tokens = whitespace_tokens(text)
    return F.when(F.size(tokens) <= most, text).otherwise(F.array_join(F.slice(tokens, 1, most), " "))


def compact_sentence(text: Column, most: int) -> Column:
    """The first non-empty piece between ". ", trimmed and cut to the budget; the text itself if there is none."""
    first = strip(F.get(nonempty(F.split(text, r"\. ")), F.lit(0)))
    return F.coalesce(F.when(token_count(first) > most, truncate_tokens(first, most)).otherwise(first), text)


def lexical_form(text: Column, lower: bool = True, strip_punctuation: bool = True, collapse: bool = True) -> Column:
    out = F.lower(text) if lower else text
    out = F.translate(out, PUNCTUATION, "") if strip_punctuation else out
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " ")) if collapse else out


def normal_words(text: Column) -> Column:
    """Lower-cased words without other than word characters, of more than two characters."""
    return F.filter(F.transform(whitespace_tokens(F.lower(text)), lambda w: F.regexp_replace(w, r"[^a-z0-9]", "")), lambda w: F.length(w) > 2)


def collapsed(text: Column) -> Column:
    return F.array_join(whitespace_tokens(text), " ")


def substring_count(text: Column, token: Column) -> Column:
    """How often a token stands in a text, places not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)).cast("int")


def first_match(text: Column, tokens: Column) -> Column:
    """(start, end) of the earliest place of any token, ties to the earlier token; null if there is none."""
    places = let(F.lower(text), lambda low: F.transform(tokens, lambda t, i: F.struct((F.call_function("locate", t, low) - 1).alias("start"), i.alias("i"), F.length(t).alias("n"))))
    best = F.array_min(F.filter(places, lambda p: p.start >= 0))
    return F.when(best.isNotNull(), F.struct(best.start.alias("start"), (best.start + best.n).alias("end")))


def snippet(text: Column, span: Column, most: int) -> Column:
    """Up to ``most`` characters around a match, the text's first ones without a match."""
    half = most // 2
    start = F.greatest(span.start - half, F.lit(0))
    end = F.least(span.end + half, F.length(text))
    return F.when(span.isNull(), F.substring(text, 1, most)).otherwise(F.substring(text, start + 1, end - start))


def span_text(text: Column, start: Column, end: Column) -> Column:
    """The slice of a valid span, else the whole text."""
    return F.when((start < 0) | (end <= start), text).otherwise(F.substring(text, start + 1, end - start))


def redact_uri(uri: Column) -> Column:
    """The URI without user and password; query and fragment stay."""
    return F.regexp_replace(uri, r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/?#]*@", "$1")


def first_speaker(text: Column, prefix: str = "Speaker 0:") -> Column:
    """Only the lines of the first speaker, without the prefix, if there are any; else the text."""
    lines = F.filter(F.split(text, "\r\n|\n|\r"), lambda x: x.startswith(prefix))
    said = F.transform(lines, lambda x: strip(F.substr(x, F.lit(len(prefix) + 1))))
    return F.when(F.size(lines) > 0, F.array_join(said, "\n")).otherwise(text)


def normal_transcript(text: Column) -> Column:
    return collapsed(F.regexp_replace(F.lower(text), r"(?U)[^a-z0-9\s]", ""))


#: How street words are spelt out in addresses.
STREET_WORDS = {"st": "street", "rd": "road", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "apt": "apartment", "ste": "suite"}


def normal_entity(value: Column, kind: Column) -> Column:
    """Entity values made comparable, by kind: date, total, company, address, or any other."""
    v = F.array_join(nonempty(F.split(F.lower(value), r"(?U)\s+")), " ")
    date = F.regexp_replace(F.regexp_replace(v, r"[/\-.]", "-"), r"^(date:?\s*)", "")
    total = F.regexp_replace(F.regexp_replace(v, "[$£€¥]", ""), r"^(total:?\s*|amount:?\s*|sum:?\s*)", "")
    number = F.regexp_extract(total, r"[\d,]+\.?\d*", 0)
    total = F.when(number != "", F.replace(number, F.lit(","), F.lit(""))).otherwise(total)
    company = F.regexp_replace(v, r"\s+(inc\.?|ltd\.?|llc\.?|corp\.?|co\.?)$", "")
    address = v
    for short, long in STREET_WORDS.items():
        address = F.regexp_replace(address, rf"\b{short}\.?\b", long)
    return F.when(F.coalesce(value, F.lit("")) == "", "").when(kind == "date", date).when(kind == "total", total).when(kind == "company", company).when(kind == "address", address).otherwise(v)


#: Default patterns of receipt entities.
ENTITY_PATTERNS = {
    "date": r"(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})",
    "total": r"(?:total|amount|sum)[\s:]*[$£€]?\s*[\d,]+\.?\d*",
    "company": r"^[A-Z][A-Za-z\s&]+(?:Inc\.?|Ltd\.?|LLC|Corp\.?)?",
    "address": r"\d+\s+[A-Za-z\s]+(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Drive|Dr)",
}


def find_entity(text: Column, kind: str) -> Column:
    """The first match of a kind's pattern, trimmed; empty without one."""
    return strip(F.regexp_extract(text, "(?im)" + ENTITY_PATTERNS[kind], 0))


def json_items(output: Column) -> Column:
    """The items of a JSON list in a model's output, also if quotes were escaped or the list is a string itself."""
    items = "array<string>"
    inner = F.get(F.from_json(F.concat(F.lit("["), output, F.lit("]")), items), F.lit(0))
    return F.coalesce(F.from_json(output, items), F.from_json(F.replace(output, F.lit('\\"'), F.lit('"')), items), F.from_json(inner, items))


def without_patterns(text: Column, patterns: tuple[str, ...]) -> Column:
    """Text without what the patterns match, white space collapsed."""
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return collapsed(text)
