"""Function words of the four languages, and counting them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent words of each language that the other three don't have.
FUNCTION_WORDS = {
    "en": "the of and to is it that for with this from are were which have has had not what how when why should does do can could would each every than then they there their we you your our its into about after before because while until although whereas if but be been by at as".split(),
    "de": "der das und ist nicht ein eine einen einem einer den dem die mit für auf von zu zum zur wir ich sie wie wann warum dass weil wenn bei nach vor aus auch noch nur kann sollte wird werden haben habe über unter sich im oder aber ohne solange sobald obwohl damit sowie seit trotz bitte".split(),
    "fr": "le les et est une du dans pour pas qui au aux avec ce cette ces par nous vous je il elle ils elles sont était pourquoi comment quand dois faut parce puisque tandis dès malgré après sans sous leur leurs mais ou où même été être avoir avons".split(),
    "es": "el los las y una del por para con lo pero su sus ha hemos esto esta este está qué cómo cuándo porque aunque mientras cuanto ya hay sin sobre desde muy también fue era sigue puede debe usted ustedes hasta según".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)
UNKNOWN = "und"
#: More such words, which name no language alone in a list of few.
MORE_WORDS = {
    "en": "an he she him her his me my or so if no yes any all some more only just very here one two both between without under through again since been being will us who whom whose".split(),
    "de": "ja nein kein keine so da man mir mich ihr ihm uns euch es dieser diese dieses jeder jede alle mehr sehr hier zwei zwischen durch gegen bis seitdem dabei dazu worauf wer wen wem welche damals an in am um des als".split(),
    "fr": "à la de des en un que se on ne si tout toute toutes tous cela ça oui non deux quoi lors entre chaque très plus moins encore puis leur mon ma mes ton son sa ses aussi alors qu".split(),
    "es": "la de en un que se si no sí todo toda todos todas cada dos más menos entre luego entonces me te nos mi tu al ni le les son eso ese esa esos cual quien donde durante tras según mismo".split(),
}


def _letters() -> dict[str, str]:
    """Word to the places of its languages as letters, and that of its only one as a capital as well."""
    every = {lang: {*FUNCTION_WORDS[lang], *MORE_WORDS[lang]} for lang in FUNCTION_WORDS}
    return {w: "".join(chr(97 + k) for k, own in enumerate(every.values()) if w in own) + "".join(chr(65 + k) for k, own in enumerate(every.values()) if w in own and sum(w in x for x in every.values()) == 1) for w in set().union(*every.values())}


def word_hits(text: Column) -> dict[str, Column]:
    """For each language, how many of its function words the text holds; 0 for null."""
    words = F.split(F.lower(text), r"[^\p{L}']+")
    return {lang: F.coalesce(F.size(F.array_intersect(words, F.array(*map(F.lit, own)))), F.lit(0)) for lang, own in FUNCTION_WORDS.items()}


def leading(hits: dict[str, Column]) -> Column:
    """The language with most hits, the first in ``LANGUAGES`` on ties; ``UNKNOWN`` without any."""
    best = F.greatest(*hits.values())
    out = F.when(best <= 0, UNKNOWN)
    for lang, n in hits.items():
        out = out.when(n == best, lang)
    return out


_PLACES = _letters()
#: The only word that is a plain letter, counted between blanks.
_AND = _PLACES.pop("y")
#: What stands between words; single letters are no words, since they may be names or spelled out, but for an accented one.
_BETWEEN = re.compile(r"[\s,.;:!?¿¡()\[\]{}\"“”„«»‹›*_#<>|=/\\+~^`'’‘…–—\-0-9]+").split


def count_hits(text: str) -> tuple[dict[str, int], dict[str, int]]:
    """How many words, whatever stands beside them, are function words of each language, and how many of it alone."""
    return count_words(text.lower().split())


def count_words(words: list[str]) -> tuple[dict[str, int], dict[str, int]]:
    """``count_hits`` of a text in lower case, parted at blanks."""
    hits = hit_letters(words)
    return dict(zip(LANGUAGES, counted(hits), strict=True)), dict(zip(LANGUAGES, counted(hits, alone=True), strict=True))


def hit_letters(words: list[str]) -> str:
    """The places of the languages of each function word, as letters, and as a capital that of its only one."""
    beside = " ".join([w for w in words if not w.isalpha()])
    return "".join(filter(None, map(_PLACES.get, words))) + "".join(filter(None, map(_PLACES.get, _BETWEEN(beside)))) + words.count("y") * _AND


def counted(hits: str, alone: bool = False) -> list[int]:
    """How many of ``hit_letters`` each language has, in order of ``LANGUAGES``; ``alone``: how many are its alone."""
    return [hits.count(c) for c in ("ABCD" if alone else "abcd")]


def language_of(hits: dict[str, int], least: int = 1, margin: float = 1.0) -> str:
    """The language with most hits if it has ``least`` of them and ``margin`` times as many as any other, else ``UNKNOWN``."""
    first, second = sorted(hits.values(), reverse=True)[:2]
    if first < least or first < margin * second or (first == second):
        return UNKNOWN
    return max(hits, key=hits.get)
