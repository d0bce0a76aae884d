"""Languages of prose by dictionaries of function words and by script."""

from __future__ import annotations

import functools
import re
from collections import Counter

import ahocorasick
import regex

#: Frequent words that tell the languages of the prompts apart.
FUNCTION_WORDS = {
    "en": "the of and to is are was were be been with for that this it its as by not at from which when who has have had will would could should than then so their our we you they he she an or but if all any each more most other some such only after before while because did does do there here what how why where one two please thank your my his her them us me into about over out up very",
    "de": "der die das und ist ein eine einer einem einen den dem des zu zum zur mit für auf von nicht sich bei im am war waren wurde wurden werden wird dass als auch nach aus wir sie es er ich ihr ihre ihren unsere sind hat haben hatte oder aber wenn noch nur schon sehr mehr alle jede jeden keine kein um vor über durch gegen ohne bis weil während bitte vielen dank sein seine können könnte wie was wo in",
    "fr": "le la les un une et est sont pour dans du au aux que qui ne pas par sur avec sans ce cette ces se ont été était étaient nous vous il elle ils elles on leur leurs notre votre mais ou où plus très bien tout tous toute chaque avant après pendant car donc comme si en y rien aucun quelques être avoir fait je tu mon ma mes sa son ses des de",
    "es": "el los las y es son por para con del al que se no lo su sus un una unas unos fue fueron nos más en sin como ha han este esta estos estas pero o muy todo todos cada antes después mientras porque cuando donde qué quien ya también ser estar hay era eran le les nada nadie aún todavía yo mi mis tu me de la",
}
#: Frequent words of further languages that no list above holds.
FURTHER_WORDS = {
    "nl": "het een van en op ze toen omdat dat niet met voor zijn werd wordt ook aan naar maar deze heeft hebben uit nog wel geen door hun ik jij wij jullie je dit daar hier kan moet zal zou bij onze om te tot veel meer alle",
    "it": "il lo gli che non una della delle nel nella sono è anche più questo questa ha hanno alla dei di è stato stata nostro nostra loro molto come quando perché senza prima dopo ogni sulla dal dalla",
    "pt": "não uma com os as dos das em na ao à mais foi são também muito seu sua pelo pela você eu nós ele ela eles quando porque até sem depois antes isso este esta cada",
    "pl": "nie się że jest na do w i oraz przez dla od po jak ale który która są było był była być ten ta to też już tylko przed bez może nasz ich jego jej",
    "sv": "och att det som en är på av för med inte till den har var ett jag vi ni de om efter från kan ska blir mycket alla utan innan eller när",
}
NAMES = {
    "en": "english englisch englische anglais inglés ingles",
    "de": "german deutsch deutsche allemand alemán aleman",
    "fr": "french französisch franzoesisch französische français francais francés frances",
    "es": "spanish spanisch spanische espagnol español espanol castellano",
    "it": "italian italienisch italien italiano",
    "pt": "portuguese portugiesisch portugais portugués",
    "pl": "polish polnisch polonais polaco",
    "sv": "swedish schwedisch suédois sueco",
    "nl": "dutch niederländisch néerlandais neerlandés holandés",
    "ru": "russian russisch russe ruso",
    "ja": "japanese japanisch japonais japonés",
    "zh": "chinese chinesisch chinois chino",
}
_LANGUAGE_OF = {w: code for code, words in NAMES.items() for w in words.split()}
_SCRIPTS = (("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("zh", regex.compile(r"\p{Han}")), ("ko", regex.compile(r"\p{Hangul}")), ("ru", regex.compile(r"\p{Cyrillic}")), ("ar", regex.compile(r"\p{Arabic}")), ("hi", regex.compile(r"\p{Devanagari}")), ("el", regex.compile(r"\p{Greek}")))
_WORD = regex.compile(r"\p{L}+(?=['’]\p{L})['’]|\p{L}+")
_ASKS = regex.compile(
    r"(?i)\b(?:translat\w*|answer\w*|repl(?:y|ies)|respond\w*|respon\w*|respuesta\w*|write|écri\w+|escrib\w+|schreib\w*|übersetz\w*|übertrag\w*|antwort\w*|tradui\w*|traduc\w*|traduz\w*|répon\w+|rédig\w+|contest\w+)\b[^.\n!?:]{0,40}?\b(" + "|".join(sorted(_LANGUAGE_OF, key=len, reverse=True)) + r")\b"
)


def _weights() -> dict[str, dict[str, float]]:
    table: dict[str, dict[str, float]] = {}
    for code, words in FUNCTION_WORDS.items():
        for w in set(words.split()):
            table.setdefault(w, {})[code] = 1.0
    return {w: {c: 1.0 / len(by) ** 2 for c in by} for w, by in table.items()}


_WEIGHT = _weights()
_ELISION = {"l'": "fr", "d'": "fr", "qu'": "fr", "n'": "fr", "s'": "fr", "j'": "fr", "c'": "fr", "m'": "fr"}
_LETTERS = (("de", regex.compile(r"ß|ä|ö|ü")), ("fr", regex.compile(r"ç|è|ê|à|ù|œ|î|ô|û")), ("es", regex.compile(r"ñ|¿|¡|[íóúá]")))


_FURTHER = {code: frozenset(words.split()) - _WEIGHT.keys() for code, words in FURTHER_WORDS.items()}
_FOREIGN = re.compile("[\u0370-\uffff]")


def _counts(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower().replace("’", "'")))


def scores(text: str, counts: Counter | None = None) -> tuple[dict[str, float], int]:
    """Evidence for each language of the prompts, and the number of words."""
    counts = _counts(text) if counts is None else counts
    found: dict[str, float] = {}
    for w in counts.keys() & _WEIGHT.keys():
        for code, x in _WEIGHT[w].items():
            found[code] = found.get(code, 0.0) + x * counts[w]
    for w in counts.keys() & _ELISION.keys():
        found[_ELISION[w]] = found.get(_ELISION[w], 0.0) + counts[w]
    if not text.isascii():
        for code, letters in _LETTERS:
            if n := len(letters.findall(text.lower())):
                found[code] = found.get(code, 0.0) + 0.5 * n
    return found, counts.total()


def _further(counts: Counter, best: float) -> str | None:
    """A further language that has clearly more evidence than any of the prompts' languages."""
    found = {code: sum(counts[w] for w in counts.keys() & words) for code, words in _FURTHER.items()}
    code = max(found, key=lambda c: (found[c], c))
    others = sorted(found.values())[-2]
    return code if found[code] >= max(3, 0.12 * counts.total(), 1.5 * best, 1.2 * others) else None


def language_of(text: str, least: float = 1.0) -> str | None:
    """The language of prose, or null if it does not tell."""
    if not text.isascii() and _FOREIGN.search(text):
        letters = sum(map(str.isalpha, text))
        for code, script in _SCRIPTS:
            if len(script.findall(text)) > 0.4 * letters:
                return code
    counts = _counts(text)
    found, words = scores(text, counts)
    ranked = sorted(found.items(), key=lambda x: -x[1])
    first = ranked[0][1] if ranked else 0.0
    if other := _further(counts, first):
        return other
    second = ranked[1][1] if len(ranked) > 1 else 0.0
    if not ranked or first < least or first < 0.08 * words or first < 1.4 * second:
        return None
    return ranked[0][0]


@functools.cache
def _names() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for name in _LANGUAGE_OF:
        found.add_word(name, True)
    found.make_automaton()
    return found


def asked_language(prompt: str) -> str | None:
    """The language that a prompt asks its answer to be in, if it does."""
    asked = _ASKS.findall(prompt) if next(_names().iter(prompt.lower()), None) else None
    return _LANGUAGE_OF[asked[-1].lower()] if asked else None
