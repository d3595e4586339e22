"""Language and domain packs: plain data that column expressions are built from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, normalize_answer, unicode_ws


@dataclass(frozen=True)
class LanguagePack:
    name: str
    german_signs: bool = False
    abbreviations: dict[str, str] = field(default_factory=dict)

    def normalize(self, c: Column) -> Column:
        return normalize_answer(c, self.german_signs, self.abbreviations)


@dataclass(frozen=True)
class DomainPack:
    name: str
    citation_patterns: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()

    def citations(self, c: Column) -> Column:
        """Sorted distinct matches of all patterns (overlapping patterns each count)."""
        if not self.citation_patterns:
            return F.array().cast("array<string>")
        found = [F.regexp_extract_all(c, F.lit(unicode_ws(p)), F.lit(0)) for p in self.citation_patterns]
        return F.array_sort(F.array_distinct(F.concat(*found)))

    def has_citation(self, c: Column) -> Column:
        if not self.citation_patterns:
            return F.lit(False)
        return c.rlike("|".join(f"(?:{unicode_ws(p)})" for p in self.citation_patterns))

    def is_statement(self, c: Column) -> Column:
        return self.has_citation(c) | contains_any(c, self.keywords)


GERMAN = LanguagePack(
    "German",
    german_signs=True,
    # Abbreviations and their long forms, replaced in this order.
    abbreviations={
        "Abs.": "Absatz",
        "i.V.m.": "in Verbindung mit",
        "ggf.": "gegebenenfalls",
        "z.B.": "zum Beispiel",
        "u.a.": "unter anderem",
        "bzw.": "beziehungsweise",
    },
)
MULTILINGUAL = LanguagePack("Multilingual")

GERMAN_LEGAL = DomainPack(
    "German Legal",
    # Citation forms of German law.
    citation_patterns=(
        r"§\s*\d+",
        r"Art\.\s*\d+",
        r"Abs\.\s*\d+",
        r"\b(?:BGB|StGB|ZPO|GG|HGB|AktG|InsO|UrhG|PatG)\b",
        r"\b(?:BGH|BVerfG|BAG|BFH|BSG|BVerwG|VGH|OLG|LG|AG)\b",
        r"(?:BGH|BVerfG|BAG|BFH|BSG|BVerwG)\s+[IVX]+\s+[A-Z]+\s+\d+/\d+",
        r"§\s*\d+(?:\s+Abs\.\s*\d+)?(?:\s+[A-Z]{2,})?",
        r"Art\.\s*\d+(?:\s+Abs\.\s*\d+)?(?:\s+[A-Z]{2,})?",
    ),
    # Words that mark a legal statement.
    keywords=(
        "haftet", "verpflichtet", "schuldet",
        "Anspruch", "berechtigt", "Recht", "Pflicht",
        "gilt", "ist zu", "muss", "kann", "darf",
        "klagen", "Klage", "Vertrag", "Haftung",
        "Urteil", "Beschluss", "entschieden",
        "Schuldner", "Gläubiger", "Kläger", "Beklagter",
    ),
)
GENERIC = DomainPack("Generic (No Domain)")

_PRESETS: dict[str, tuple[LanguagePack, DomainPack]] = {
    "legal.german": (GERMAN, GERMAN_LEGAL),
    "german_legal": (GERMAN, GERMAN_LEGAL),
    "generic.german": (GERMAN, GENERIC),
    "generic": (MULTILINGUAL, GENERIC),
    "default": (GERMAN, GERMAN_LEGAL),
}


def preset(name: str) -> tuple[LanguagePack, DomainPack]:
    if name not in _PRESETS:
        raise KeyError(f"unknown preset {name!r}; known: {', '.join(sorted(_PRESETS))}")
    return _PRESETS[name]


def register_domain(name: str, language: LanguagePack, patterns=(), keywords=()) -> None:
    _PRESETS[name] = (language, DomainPack(name, tuple(patterns), tuple(keywords)))


def list_presets() -> dict[str, str]:
    return {k: f"{lang.name} - {dom.name}" for k, (lang, dom) in _PRESETS.items()}
