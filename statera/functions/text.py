"""Column expressions that clean and measure text. All of them stay inside the JVM except NFC."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import matches

# The white space that counts everywhere in this library (the Unicode set, not only
# the ASCII set of Java's \s), as a regex class and as a trim list.
WS = (
    r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
WS_CHARS = (
    " \t\n\r\f\u000b\u001c\u001d\u001e\u001f\u0085       "
    "          　"
)

# Characters that NFC may change (marks, conjoining jamo, singletons, exclusions).
# A superset is enough: rows without any of them skip Python.
NFC_CANDIDATE = (
    r"[\p{M}\x{0374}\x{037E}\x{0387}\x{0958}-\x{095F}\x{09DC}-\x{09DF}\x{0A33}-\x{0A5E}"
    r"\x{0B5C}\x{0B5D}\x{0F43}-\x{0FB9}\x{1100}-\x{11FF}\x{1F71}-\x{1FFD}\x{2000}\x{2001}"
    r"\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}\x{F900}-\x{FB4F}"
    r"\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]"
)

# Entities decoded by the corpus normaliser, in this order.
CORPUS_ENTITIES = {
    "&nbsp;": " ",
    "&amp;": "&",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
}

# Entities decoded when markup is turned into text (``&amp;`` must stay last).
MARKUP_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&#34;": '"',
    "&sect;": "§",
    "&auml;": "ä",
    "&ouml;": "ö",
    "&uuml;": "ü",
    "&Auml;": "Ä",
    "&Ouml;": "Ö",
    "&Uuml;": "Ü",
    "&szlig;": "ß",
    "&ndash;": "–",
    "&mdash;": "—",
    "&bdquo;": "„",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&euro;": "€",
    "&amp;": "&",
}

# Where a mail signature starts, tried in this order.
SIGNATURE_MARKERS = (
    "-- ",
    "___",
    "Sent from",
    "Get Outlook for",
    "Von meinem iPhone gesendet",
    "Von meinem Android-Gerät gesendet",
)


def unicode_ws(pattern: str) -> str:
    """Give ``\\s`` in a pattern its Unicode meaning."""
    return pattern.replace(r"\s", WS)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    return strip(F.regexp_replace(c, WS + "+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, WS + "+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def cut(c: Column, n: int, ellipsis: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ellipsis))).otherwise(c)


def fixed(c: Column, digits: int) -> Column:
    """Fixed-point form; ties go to the even digit."""
    return F.format_string(f"%.{digits}f", F.bround(c, digits))


_SPECIAL = frozenset(r"\.^$|?*+()[]{}&-~#")


def _quoted(ch: str) -> str:
    return "\\" + ch if ch in _SPECIAL else ch


def trie_pattern(needles: Iterable[str]) -> str:
    """One pattern for a list of words, factored by their common beginnings: at a place in a text it goes down one path, so the
    length of the list hardly matters. Of words that begin alike it matches the longest. An empty word is refused."""
    root: dict = {}
    for word in needles:
        if not word:
            raise ValueError("an empty keyword is in every text")
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def part(node: dict) -> str:
        ways = [_quoted(ch) + part(node[ch]) for ch in sorted(node) if ch]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return f"{body}?" if "" in node else body

    first = "".join(_quoted(ch) for ch in sorted(root))
    return f"(?=[{first}]){part(root)}" if root else "(?!)"


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    """True when one of a list of words occurs in the text: one pass over the text for the whole list."""
    needles = list(needles)
    return c.rlike(trie_pattern(needles)) if needles else F.lit(False)


def keyword_hits(c: Column, needles: Iterable[str]) -> Column:
    """array<struct<start,stop,text>>: the places of the words of a list, left to right and without overlaps; of words
    that begin at one place the longest. One pass for the whole list."""
    return matches(c, trie_pattern(needles))


def nfc(c: Column) -> Column:
    """NFC. Only texts that may change travel to Python; the rest go as nulls."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    # Everything below U+0300 is stable under NFC, so most texts end at the first, cheap test.
    may_change = c.rlike(r"[^\x{0000}-\x{02FF}]") & c.rlike(NFC_CANDIDATE)
    return F.coalesce(run(F.when(may_change, c)), c)


def normalize_text(c: Column, use_nfc: bool = True) -> Column:
    """Corpus normalisation: NFC, entities, tags, white space, legal spacing."""
    out = F.coalesce(c, F.lit(""))
    if use_nfc:
        out = nfc(out)
    for entity, char in CORPUS_ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, "<[^>]+>", "")
    for old, new in (("\r\n", "\n"), ("\r", "\n"), ("\t", " ")):
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, " {2,}", " ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    out = F.regexp_replace(out, f"§{WS}+([0-9]+)", "§$1")
    out = F.regexp_replace(out, f"(Abs|Nr)\\.{WS}+([0-9]+)", "$1. $2")
    return strip(out)


def normalize_answer(c: Column, german: bool = True, abbreviations: dict[str, str] | None = None) -> Column:
    """Answer normalisation: white space, typographic signs, doubled section signs, abbreviations."""
    out = collapse_ws(c)
    for old, new in (("„", '"'), ("“", '"'), ("‚", "'"), ("‘", "'"), ("–", "-"), ("—", "-")):
        out = F.replace(out, F.lit(old), F.lit(new))
    if german:
        out = F.replace(out, F.lit("§§"), F.lit("§ "))
    for short, full in (abbreviations or {}).items():
        out = F.replace(out, F.lit(short), F.lit(full))
    return out


def decode_markup(c: Column) -> Column:
    out = c
    for entity, char in MARKUP_ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.when(c.contains("&"), out).otherwise(c)


# Invisible parts of a page. They become an empty tag so that the text on both sides stays apart.
INVISIBLE = (
    r"(?is)<script\b[^>]*>.*?</script[^>]*>|<style\b[^>]*>.*?</style[^>]*>"
    r"|<template\b[^>]*>.*?</template[^>]*>|<!--.*?-->"
)


def text_nodes(c: Column) -> Column:
    """Stripped non-empty text nodes of a page, in order."""
    visible = F.replace(F.regexp_replace(c, INVISIBLE, "<!>"), F.lit("&nbsp;"), F.lit(" "))
    nodes = F.transform(F.split(visible, "<[^>]+>"), strip)
    return F.filter(nodes, lambda n: n != "")


def html_to_text(c: Column, separator: str = "\n") -> Column:
    return decode_markup(F.array_join(text_nodes(c), separator))


def clean_mail_body(c: Column) -> Column:
    lines = F.filter(F.split(c, "\n"), lambda line: ~F.startswith(strip(line), F.lit(">")))
    out = F.array_join(lines, "\n")
    for marker in SIGNATURE_MARKERS:
        out = F.substring_index(out, marker, 1)
    return strip(out)


def strip_page_furniture(c: Column) -> Column:
    out = F.regexp_replace(c, WS + "+", " ")
    return strip(F.regexp_replace(out, f"Seite{WS}+[0-9]+{WS}+von{WS}+[0-9]+", ""))


# Marker words of the German check. The capitalised three can never match a
# lower-cased sample; they are kept so that the list is whole.
GERMAN_MARKERS = (
    "der", "die", "das", "und", "für", "auf", "mit", "wird",
    "können", "müssen", "soll", "nach", "über", "durch",
    "Artikel", "Verordnung", "Richtlinie", "gemäß", "sowie",
)


def detect_german(c: Column, sample_chars: int | None = None, min_hits: int = 3, min_chars: int = 50) -> Column:
    """``de`` if enough marker words stand in the text; ``sample_chars`` looks at its beginning only."""
    seen = c if sample_chars is None else F.substring(c, 1, sample_chars)
    sample = F.concat(F.lit(" "), F.lower(seen), F.lit(" "))
    hits = F.lit(0)
    for w in GERMAN_MARKERS:
        hits = hits + sample.contains(f" {w} ").cast("int")
    long_enough = F.coalesce(F.length(c), F.lit(0)) >= min_chars
    return F.when(long_enough & (hits >= min_hits), F.lit("de")).otherwise(F.lit("other"))


def classify_doc_type(concepts: Column) -> Column:
    def has(word: str) -> Column:
        return F.coalesce(F.exists(concepts, lambda x: F.lower(x).contains(word)), F.lit(False))

    return (
        F.when(has("directive"), "eu_directive")
        .when(has("decision"), "eu_decision")
        .otherwise("eu_regulation")
    )


def classify_source(doc_type: Column, url: Column, law: Column) -> Column:
    link = F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when((F.coalesce(doc_type, F.lit("unknown")) == "eurlex") | link.contains("eurlex"), "eurlex")
        .when(F.coalesce(law, F.lit("")) != "", "gesetze_github")
        .when(link.contains("gesetze"), "gesetze_github")
        .otherwise("unknown")
    )
