"""Text functions as Column expressions: they stay inside generated code and are pushed about by Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are never terms.
STOP_WORDS = (
    "der die das den dem des ein eine einer eines einem einen und oder aber nicht ist sind war waren wird werden "
    "wie was wer wo wann warum welche welcher welches mit von zu zum zur auf aus bei für über unter nach vor "
    "im in an am es sie er ich wir ihr sich auch noch nur schon sehr mehr kann können soll sollen hat haben "
    "dieser diese dieses gibt text dokument paper artikel seite seiten "
    "the a an and or but not is are was were be been what which who where when why how with from to of on "
    "at by for about into this that these those it its they them there their can could should would does "
    "do did has have had document article page pages"
).split()
#: Patterns shared by the Column functions, the kernels and the SQL oracles.
TOKEN = r"[\p{L}\p{N}]{3,}"
ENDING = r"^(.{4,}?)(?:ern|en|er|es|e|n|s)$"
DOT_LEADER = r"(?:\.\s?){4,}\s*\d{1,4}\b|…\s*\d{1,4}\b"
TOC_HEADING = r"(?i)^\s*(?:inhaltsverzeichnis|inhalt|table of contents|contents|sommaire)\b"
NUMBERED_LINE = r"\p{L}{3}.*\s\d{1,4}$"
LEADING_NUMBER = r"(?i)^\s*(?:(?:kapitel|kap\.?|chapter|chap\.?|ch\.?|teil|part|band|vol\.?|volume|abschnitt|section)\s*)?([0-9]{1,3}|[ivxlc]{1,6})(?:[\s._\-–:)]|$)"
SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once a row: a lambda's variable is bound, where an expression that stands in
    several places, or inside a lambda, may be evaluated again for each."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def stripped(text: Column) -> Column:
    """Without white space at either end; trim() would take off spaces only."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of three letters or digits and more, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1), lambda t: ~t.isin(STOP_WORDS))


def search_key(token: Column) -> Column:
    """The token with umlauts spelled out and one ending off, if four characters remain."""
    plain = token
    for letter, spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        plain = F.replace(plain, F.lit(letter), F.lit(spelled))
    return F.regexp_replace(plain, ENDING, "$1")


def term_keys(text: Column) -> Column:
    """The keys of the text's tokens in order, repeats kept."""
    return F.transform(tokens(text), search_key)


def norm_word(word: Column) -> Column:
    """Lower case, each run of digits one #."""
    return F.regexp_replace(F.lower(word), r"\d+", "#")


def normalized_words(text: Column) -> Column:
    """Lower case, hyphens at line ends closed up, runs of letters and digits."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), rf"-{SPACE}+", ""), F.lit(r"([\p{L}\p{N}]+)"), 1)


def leaders(text: Column) -> Column:
    return F.regexp_count(text, F.lit(DOT_LEADER))


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")


def ends_in_number(line: Column) -> Column:
    """Three letters somewhere, a number at the end. The end is looked at first: the whole pattern goes back and forth in
    every line that has letters."""
    return line.rlike(r"\s\d{1,4}$") & line.rlike(NUMBERED_LINE)


def numbered_lines(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: ends_in_number(x)))


def is_toc_page(text: Column) -> Column:
    """Five dot leaders; or six lines of which three fifths end in a number; or a contents heading with a few of either."""
    signs = F.struct(leaders(text).alias("dots"), F.transform(lines(text), lambda x: ends_in_number(x)).alias("lines"), text.rlike(TOC_HEADING).alias("headed"))
    counted = let(signs, lambda s: F.struct(s["dots"].alias("dots"), F.size(s["lines"]).alias("n"), F.size(F.filter(s["lines"], lambda x: x)).alias("numbered"), s["headed"].alias("headed")))
    return let(counted, lambda c: (c["dots"] >= 5) | ((c["n"] >= 6) & (c["numbered"] / c["n"] >= 0.6)) | (c["headed"] & ((c["dots"] >= 2) | (c["numbered"] >= 4))))


def parse_pages(value: Column) -> Column:
    """The first number of a page-count field, if positive."""
    return F.nullif(F.regexp_extract(value.cast("string"), r"\d+", 0).try_cast("int"), F.lit(0))


def roman_value(numeral: Column) -> Column:
    """Each letter counts against the total if a larger one follows."""
    value = lambda c: F.element_at(F.create_map(*(F.lit(x) for x in ("i", 1, "v", 5, "x", 10, "l", 50, "c", 100))), c)
    letters = F.transform(F.filter(F.split(F.lower(numeral), ""), lambda c: c != ""), value)
    following = F.concat(F.slice(letters, 2, F.greatest(F.size(letters) - 1, F.lit(0))), F.array(F.lit(0)))
    return F.aggregate(F.zip_with(letters, following, lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda s, x: s + x)


def leading_number(title: Column) -> Column:
    """Chapter or part number at the start of a title, arabic or roman, or null."""
    found = F.nullif(F.regexp_extract(title, LEADING_NUMBER, 1), F.lit(""))
    return F.when(found.rlike("^[0-9]"), found.try_cast("int")).when(found.isNotNull(), roman_value(found))


def embedding_text(book_title: Column, chapter: Column, text: Column, prefix: str = "") -> Column:
    """Prefix, "title — chapter" on a line of its own (empty parts left out), text."""
    head = F.array_join(F.filter(F.array(book_title, chapter), lambda x: x.isNotNull() & (x != "")), " — ")
    return F.concat(F.lit(prefix), F.when(head != "", F.concat(head, F.lit("\n"))).otherwise(""), text)


def authors_json(authors: Column) -> Column:
    return F.to_json(authors)


def authors_of(value: Column) -> Column:
    """The array in a JSON text; anything else gives an empty one."""
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def creator_names(creators: Column) -> Column:
    """creators: array of (last, first); "Last, First", or the one name there is."""
    return F.filter(F.transform(creators, lambda c: F.concat_ws(", ", F.nullif(c["last"], F.lit("")), F.nullif(c["first"], F.lit("")))), lambda x: x != "")


def year_of(date: Column) -> Column:
    """The first four characters, if they are digits."""
    return F.regexp_extract(date, r"^\d{4}", 0).try_cast("int")


def natural_key(text: Column, pad: int = 12) -> Column:
    """Sorts like a reader would: accents and case off, numbers by value. A fixed total order."""
    folded = F.lower(F.translate(text, "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñ", "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNn"))
    padded = F.regexp_replace(folded, r"(\d+)", "0" * pad + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{pad}}})(?!\d)", "$1")


def tenths(value: Column) -> Column:
    """Ten times the value, rounded to the nearest whole number, halves to the even one: decided on the exact product, which
    8 and 2 times the value make up, and not on its rounded double."""
    product = value * 8 + value * 2
    rest = value * 2 - (product - value * 8)
    half = product - F.floor(product) == 0.5
    return F.when(half & (rest > 0), F.ceil(product).cast("double")).when(half & (rest < 0), F.floor(product).cast("double")).otherwise(F.rint(product))


def size_text(size: Column) -> Column:
    """A number of bytes for people: whole below 1024 bytes and from 10 of a unit on, else with one decimal. Halves go to
    the even digit, as in printf; format_string() would round them up, and its digits are not the exact value's."""
    step = F.when(size < 1 << 10, 0).when(size < 1 << 20, 1).when(size < 1 << 30, 2).otherwise(3)
    value = size / F.pow(F.lit(1024.0), step)
    shown = F.when((step > 0) & (value < 10), F.format_string("%.1f", tenths(value) / 10)).otherwise(F.format_string("%.0f", F.rint(value)))
    return F.when(size.isNull() | F.isnan(size.cast("double")), "–").otherwise(F.concat_ws(" ", shown, F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), step + 1)))
