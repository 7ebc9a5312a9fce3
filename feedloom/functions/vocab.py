"""Vocabularies as data, and tests for their terms.

Terms are matched in lower case. One with a space in it, or of more than 3 bytes, is found anywhere; a shorter one only between signs that
are neither ASCII letters, digits nor underscores.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _terms(s: str) -> tuple[str, ...]:
    return tuple(sorted({t.strip().lower() for t in s.split("|") if t.strip()}))


NEWS = {
    "refugee": _terms("asylum|families|family|flygtning|refugee|temporary protection|viborg|asylum application|asylum support|refugee visa"),
    "visa": _terms("blive i eu|opholdstilladelse|visum|visumforlængelse"),
    "ukraine": _terms("ukraina|ukraine|ukrainer|ukrainsk|flygtninge fra ukraine|ukrainere|ukrainske|ukrainsk diaspora|ukrainske familier"),
    "denmark": _terms("aalborg|aarhus|arbejde|asyl|bolig|borgere|danmark|danske|integration|kommune|københavn|lov|opholdstilladelse|politik|region|udlændinge|viborg|visum|økonomi"),
    "conflict": _terms("bomb|invasion|krig|krigen|missil|putin|russisk|war|zelensky"),
    "tech": _terms("ai|artificial intelligence|cloud|cyber|data|deep learning|forskning|hardware|innovation|it|llm|machine learning|maskinlæring|patent|research|robot|software|startup|teknologi"),
    "ai": _terms("ai|artificial intelligence|large language model|llm|maskinlæring|neuralt netværk"),
    "medical": _terms("behandling|biotek|klinisk forsøg|lægemidler|medicin|pharma|treatment|vaccine"),
    "exclude": _terms("film|fodboldresultat|horoskop|kendis|madopskrift|musik|sportsresultat|tv-program|vejr"),
    "europe": _terms("eu|eu-lande|europa|europeisk|european"),
    "youth": _terms(
        "angst|app|blogger|content creator|cv|cybermobning|dating|discord|efterskole|esport|festival|fritid|gaming|gap year|gymnasium|influencer|instagram|job|koncert|kæreste"
        "|mental sundhed|mobil|mobning|mode|musik|netflix|podcast|praktikplads|selvværd|skole|snapchat|social media|sommerjob|sport|spotify|streaming|stress|studerende"
        "|studievejledning|teenager|tiktok|trend|twitch|uddannelse|uddannelsesvalg|ungdom|ungdomsarbejde|ungdomskultur|unge|venskab|viral|vlogger|youtube"
    ),
    "parent": _terms(
        "allergi|astma|baby|babyproofing|barsel|boligsøgning|bullying|børn|børnebidrag|børnehave|børnelæge|børnepenge|børnevenlig|børnevenlig bolig|børns udvikling|cybersikkerhed"
        "|dagpleje|digital opdragelse|familie|familieaktiviteter|familieydelse|familieøkonomi|far|ferie|forældre|forældreinddragelse|forældremyndighed|forældremøde|fritidsordning"
        "|fædregruppe|fødsel|graviditet|inklusion|legeplads|læsning|matematik|mobning|mor|motorik|museum|mødregruppe|online sikkerhed|opdragelse|orlov|samvær|sfo|sikkerhed hjemme"
        "|skilsmisse|skole|skolevægring|skærmtid|småbørn|sprog|sundhedspleje|særlige behov|teenager|vaccination|zoo"
    ),
    "culture": _terms(
        "arkitektur|arv|ballet|bibliotek|bog|dansk design|dansk film|dansk kultur|design|designmuseum|documentary|festival|film|filminstruktør|folkefest|forfatter|galleri|historie|jazz"
        "|klassisk musik|koncert|kortfilm|kultur|kulturel|kulturformidling|kulturhus|kulturnat|kunst|kunstmuseum|litteratur|museum|møbler|opera|scene|skuespil|teater|traditioner|traditions|udstilling"
    ),
    "sports": _terms(
        "aktiv|atletik|badminton|basketball|børnesport|coaching|crossfit|cykling|em|fitness|fodbold|gymnastik|handicapidræt|hold|håndbold|idræt|idrætsforening|inklusion i sport|instruktør|klub"
        "|konkurrence|løb|marathon|mesterskab|motion|olympiske|parasport|sport|styrketræning|sundhed|svømning|tennis|tilgængelighed|triathlon|træning|ungdomsidræt|vm|volleyball"
    ),
    "politics": _terms("minister|politik|regering|økonomi"),
    "economy": _terms("aktier|bank|business|marked|økonomi"),
    "environment": _terms("climate|environment|grøn|klima|miljø"),
    "education": _terms("education|uddannelse|universitet"),
}


def words_and_parts(terms: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Terms that are whole words, and those found anywhere. A term that holds another of the latter adds nothing and is left out."""
    whole = [t for t in terms if len(t.encode()) <= 3 and " " not in t]
    parts = [t for t in terms if t not in whole]
    return whole, [t for t in parts if not any(o != t and o in t for o in parts)]


def contains_any(lower_text: Column, terms: tuple[str, ...]) -> Column:
    """Whether a text, which is in lower case already, has one of the terms. A whole word is looked for by a regular expression, which is slow,
    only in texts that have its letters, but not between spaces."""
    whole, parts = words_and_parts(terms)

    def has(sought: list[str]) -> Column:
        return F.exists(F.array(*map(F.lit, sought)), lambda t: F.contains(lower_text, t))

    found = has(parts) if parts else F.lit(False)
    if whole:
        apart = rf"(?<![0-9A-Za-z_])(?:{'|'.join(map(re.escape, whole))})(?![0-9A-Za-z_])"
        found = found | has(whole) & (has([f" {t} " for t in whole]) | lower_text.rlike(apart))
    return found


def contains_any_sql(lower_text: str, terms: tuple[str, ...]) -> str:
    """The same in DuckDB SQL."""
    whole, parts = words_and_parts(terms)
    found = []
    if whole:
        found.append(f"regexp_matches({lower_text}, '(?:^|[^0-9A-Za-z_])(?:{'|'.join(map(re.escape, whole))})(?:[^0-9A-Za-z_]|$)')")
    found += [f"contains({lower_text}, '{t}')" for t in parts]
    return "(" + (" or ".join(found) or "false") + ")"
