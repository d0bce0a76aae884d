"""Personal information inside free text: found through disguises, replaced by typed placeholders in the source text.

Offset-preserving deobfuscation: small transducers rewrite a text into a normal form (compatibility characters, homoglyphs of
Latin letters, invisible characters, spelled digits, at/dot disguises) and keep for every output character the span of source
characters it stands for. Identifiers are detected in the normal form; their spans are mapped back, so a placeholder
replaces exactly the disguised source text and everything else stays as it is.

Names need a lexicon: ``name_lexicon`` learns given and family names over all texts from what follows unmistakable
introductions ("customer:", "my name is", "signed by", titles), counted by name, and ``find`` takes a properly written
name where an introduction or the lexicon supports both of its parts. A lexicon of at most ``LEXICON`` entries goes to the
tasks; texts are joined with a larger one (``scan_learned``), to the same result.

Defined results: null texts have none; a name inside an e-mail address does not count; overlapping finds go to the
first kind of ``KINDS``; repeated rows are reported each; long texts are read whole.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "id_number", "phone", "address", "name")
LEXICON = 200_000

#: Look-alikes of Latin letters, folded only inside words that hold Latin letters or digits.
_LOOKALIKE = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅαοτνρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTXIJSaotvpukABEZHIKMNOPTYX", strict=True))
_HIDDEN = frozenset("­​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣﻿")
#: Digits in words.
_DIGITS = {w: str(d) for d, words in enumerate(("zero oh null nul zéro cero", "one eins un une uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")) for w in words.split()}
_LETTERS = re.compile(r"[^\W\d_]+")
_SPELLED = regex.compile(r"(?i)\b(?:(?:plus\s+)?(?:" + "|".join(_DIGITS) + r")\b[\s,.-]*){7,}")
_AT = r"(?:\s*@\s*|\s*[\[({<]\s*(?:at|arroba|arobase|ät)\s*[\])}>]\s*)"
_AT_WORD = r"(?:\s+(?:at|arroba|arobase)\s+)"
_DOT = r"(?:\.|\s*[\[({<]\s*(?:dot|punkt|punto|point)\s*[\])}>]\s*)"
_DOT_WORD = r"(?:\s+(?:dot|punkt|punto|point)\s+)"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
_LOCAL = r"[\p{L}\p{N}_%+'-]+"
_TLD = r"\p{L}{2,24}"
_EMAIL = regex.compile(
    rf"(?i)(?<![\p{{L}}\p{{N}}._%+-])(?:"
    rf"{_LOCAL}(?:\.{_LOCAL})*@{_LABEL}(?:\.{_LABEL})*\.{_TLD}"
    rf"|{_LOCAL}(?:{_DOT}{_LOCAL})*{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}{_TLD}"
    rf"|{_LOCAL}(?:(?:{_DOT}|{_DOT_WORD}){_LOCAL})*(?:{_AT}|{_AT_WORD}){_LABEL}(?:(?:{_DOT}|{_DOT_WORD}){_LABEL})*{_DOT_WORD}{_TLD}"
    rf")(?![\p{{L}}\p{{N}}@])"
)

_NO = r"(?<![\p{L}\p{N}])"
_END = r"(?![\p{L}\p{N}])"
_SEP = r"[ .\-/]?"
_IDS = regex.compile(
    _NO + r"(?:"
    r"(?:passport|reisepass|passnummer|pass|pasaporte|passeport)\s*(?:no\.?|nr\.?|number|nummer|numéro|número|n[º°o]\.?|#|:|is|ist|est|es)?\s*:?\s*(?=[\p{L}\p{N}]*\d)[A-Z]{0,2}\d{6,9}[A-Z]?"
    r"|(?:social security(?: number| no\.?)?|ssn|sozialversicherungsnummer|tax id(?:entification)?(?: number| no\.?)?|tin|itin|steuer-?id(?:entifikationsnummer)?|steuernummer|idnr\.?|steuerliche identifikationsnummer|national insurance(?: number| no\.?)?|nino|personalausweis(?:nummer)?|ausweisnummer|identity card(?: number| no\.?)?|id card(?: number| no\.?)?|numéro fiscal|numéro de sécurité sociale|sécurité sociale|número de la seguridad social|carte d'identité|documento nacional|dni|nif|nie|n\.?i\.?r\.?|national id(?:entity)?(?: number| no\.?)?|personal (?:identity |identification )?number|id number|identification number|identitätsnummer|numéro d'identité|número de identidad|pesel|bsn|cpf|codice fiscale)\s*(?:no\.?|nr\.?|number|nummer|n[º°o]\.?|#|is|ist|est|es|lautet)?\s*:?\s*(?=[^\p{L}]*\d)[A-Z]{0,2}\s?\d(?:[ .\-/]?\d){5,14}(?:[ -]?[A-Z])?"
    r"|\d{3}-\d{2}-\d{4}"
    r"|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]"
    r"|QQ\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]"
    r"|\d{8}-?[A-HJ-NP-TV-Z](?!\p{L})"
    r"|[XYZ]-?\d{7}-?[A-Z]"
    r"|[12]\s\d{2}\s(?:0[1-9]|1[0-2])\s(?:\d{2}|2[AB])\s\d{3}\s\d{3}(?:\s\d{2})?"
    r")" + _END,
    flags=regex.I,
)
#: A number after these words is no telephone number.
_NOT_PHONE = regex.compile(r"(?i)(?:order|orders|serial|version|build|reference|ref|tracking|invoice|ticket|case|id|article|part|sku|model|server|host|ip|error|code|trace|commit|release|bestellung|auftrag|rechnung|seriennummer|sendung|commande|référence|facture|colis|pedido|referencia|factura|envío|serie|versión|nummer der sendung|v|no\.)\s*(?:no\.?|nr\.?|number|nummer|#|:|=)?\s*$")
_PHONE = regex.compile(
    r"(?<![\p{L}\p{N}.\-/=+])(?:"
    r"(?:\+|00)\s?[1-9]\d{0,2}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}"
    r"|\(0?\d{2,5}\)[ .\-]?\d{2,4}(?:[ .\-]?\d{2,5}){1,3}"
    r"|0\d{1,4}[ /\-]\d{2,8}(?:[ \-]\d{2,5}){0,4}"
    r"|0[1-9](?:[ .]\d{2}){4}"
    r"|[2-9]\d{2}[ .\-]\d{3}[ .\-]\d{4}"
    r"|[2-9]\d{2}[2-9]\d{6}"
    r"|0\d{9,10}"
    r"|[6-9]\d{2} \d{3} \d{3}"
    r"|[89]\d \d{3} \d{2} \d{2}"
    r"|[89]\d{2} \d{2} \d{2} \d{2}"
    r")(?![\p{L}\p{N}]|[.\-/:]\d)"
)

#: Words for a street that stand behind its name (English), end its name or stand behind it (German, Dutch),
STREETS_AFTER = "street st road rd avenue ave lane ln boulevard blvd drive dr court ct place pl square sq way terrace ter close crescent cres gardens gdns row hill walk parkway pkwy highway hwy mews grove rise circle cir trail alley quay wharf green park".split()
STREETS_JOINED = "straße strasse str. weg gasse allee platz kamp ring damm ufer steig stieg stiege pfad graben chaussee twiete anger winkel markt zeile wall hof berg brücke bruecke tor feld garten rain grund busch brink deich hang reihe promenade siedlung kai straat laan plein gracht kade dijk".split()
#: those between a number and a name (French), those before a name and a number (Spanish, Italian, Polish, Portuguese), and
#: prepositions that begin a German address before a postcode.
STREETS_NUMBERED = "rue avenue av. boulevard bd bd. chemin allée allées place impasse quai route cours square passage sentier ruelle voie faubourg promenade esplanade villa cité montée venelle".split()
STREETS_BEFORE = "calle c/ avda avda. avenida av. plaza pza pza. pl. paseo pº camino cno cno. ronda carrera travesía carretera ctra ctra. glorieta cuesta callejón rambla vía via viale piazza corso largo vicolo ulica ul. aleja al. plac rua travessa praça".split()
STREETS_AT = "am an auf im in zum zur unter hinter vor".split()
_CAP = r"\p{Lu}[\p{L}'’]*(?:-\p{Lu}[\p{L}'’]*)*"
_either = lambda words, title=False: "|".join(regex.escape(w.title() if title else w) for w in sorted(words, key=len, reverse=True))
_EN_STREET = rf"(?:{_either(STREETS_AFTER, True)})"
_ADDRESS = regex.compile(
    r"(?<![\p{L}\p{N}])(?:"
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s*\d+\s?[A-Za-z]?,\s*)?\d{{1,5}}\s?[A-Za-z]?,?\s+(?:{_CAP}\s+){{1,3}}{_EN_STREET}\b\.?"
    rf"|(?:\p{{Lu}}\p{{Ll}}+\s+|Am\s+|An der\s+|An den\s+|Auf der\s+|Auf dem\s+|Im\s+|In der\s+|Zum\s+|Zur\s+|Unter den\s+|Hinter der\s+){{0,2}}\p{{Lu}}[\p{{L}}-]*(?:{_either(STREETS_JOINED)})\s+\d{{1,4}}\s?[a-z]?\b(?!\s*(?:Stück|Prozent|Euro|Minuten|Sekunden|Stunden))"
    r"|\p{Lu}[\p{L}-]+(?:er|e|es)?\s+(?:Straße|Strasse|Str\.|Weg|Gasse|Allee|Platz|Ring|Damm|Ufer|Steig|Stieg|Pfad|Graben|Chaussee|Markt|Wall|Hof|Berg|Kamp|Kai)\s+\d{1,4}\s?[a-z]?\b"
    r"|(?:Am|An der|An den|Auf der|Auf dem|Im|In der|In den|Zum|Zur|Unter den|Hinter der|Vor dem)\s+(?:\p{Lu}\p{Ll}+\s+)?\p{Lu}\p{Ll}{3,}\s+\d{1,3}\s?[a-z]?(?=\s*,\s*\d{5}\b)"
    r"|\d{1,4}\s*(?:bis|ter|quater|[A-D])?,?\s+(?i:rue|avenue|av\.|boulevard|bd\.?|chemin|allée|allées|place|impasse|quai|route|cours|square|passage|sentier|ruelle|voie|faubourg|promenade|esplanade|villa|cité|montée|venelle)\s+(?:(?:de|du|des|de\s+la|de\s+l['’]|d['’]|aux?|à\s+la|les?|la)\s*)*[\p{L}'’-]+(?:[\s-](?:de|du|des|la|le|les|d['’]|l['’]|\p{Lu})[\p{L}'’-]*)*"
    r"|(?i:calle|c/|avda\.?|avenida|av\.|plaza|pza\.?|pl\.|paseo|pº|camino|cno\.?|ronda|carrera|travesía|carretera|ctra\.?|glorieta|cuesta|callejón|rambla|vía)\s*(?:(?:de|del|los|las|la|el)\s+)*\p{Lu}[\p{L}'’-]*(?:\s+(?:de|del|los|las|la|el|y|\p{Lu}[\p{L}'’-]*))*,?\s+(?:n[º°o]\.?\s*)?\d{1,4}(?:\s*,?\s*\d{1,2}[º°ª]\s*[A-Z]?\b)?"
    r"|(?:Via|Viale|Piazza|Corso|Largo|Vicolo|Ulica|[Uu]l\.|Aleja|[Aa]l\.|Plac|Rua|Travessa|Praça)\s+(?:(?:del|della|dei|delle|di|da|das|do|dos|de)\s+)?\p{Lu}[\p{L}'’-]*(?:\s+\p{Lu}[\p{L}'’-]*){0,3},?\s+\d{1,4}\s?[a-zA-Z]?\b"
    r")"
)
_SIX_DIGITS = re.compile(r"[0-9](?:[\s.\-/]?[0-9]){5}")
_NINE_DIGITS = re.compile(r"[0-9](?:[\s.\-/()]{0,3}[0-9]){8}")

#: Words before a name that leave no doubt: labels (before a colon or equals sign), keys of JSON, phrases, titles,
#: and phrases after a name.
LABELS = "customer client cliente clienta kunde kundin contact kontakt contacto name nom nombre patient employee user owner sender recipient attn attention signed".split()
KEYS = "full_name fullname name customer contact".split()
PHRASES = (
    "my name is|i am|i'm|this is|signed by|spoke with|spoke to|speak to|speak with|talked to|talked with|met with|ask for|on behalf of|written by|sent by|kind regards,|best regards,|regards,|sincerely,|yours,|best,|cheers,|thanks,|"
    "mein name ist|ich bin|ich heiße|gesprochen mit|sprach mit|gezeichnet|unterschrieben von|mit freundlichen grüßen,|mit freundlichen grüßen|viele grüße,|viele grüße|beste grüße,|beste grüße|im auftrag von|"
    "je m'appelle|je suis|mon nom est|signé|signé par|parlé avec|parlé à|cordialement,|cordialement|bien à vous,|bien à vous|salutations,|salutations|de la part de|"
    "me llamo|soy|mi nombre es|firmado|firmado por|hablé con|saludos,|saludos|atentamente,|atentamente|un saludo,|un saludo|de parte de"
).split("|")
TITLES = "dr prof mr mrs ms mx herr herrn frau mme mlle monsieur madame sra sr señor señora don doña ing dipl".split()
AFTER = "promised me|called me|wrote to me|was very helpful|war sehr hilfreich|a été très|fue muy|hat mir|m'a promis|me prometió|me llamó".split("|")
_TITLE = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Mx|Herrn?|Frau|Mme|Mlle|Monsieur|Madame|Sra|Sr|Señora?|Don|Doña|Ing|Dipl)\b\.?\s+)"
_PART = r"\p{L}[\p{L}'’]+(?:-\p{L}[\p{L}'’]+)*"
_PARTS = regex.compile(_PART)
_NAME = rf"(?:{_PART},\s*(?:{_PART}|\p{{L}}\.)|(?:{_PART}|\p{{L}}\.)\s+(?:\p{{L}}\.\s*){{0,2}}{_PART}(?:\s+(?:de|del|von|van|der|y|la)\s+{_PART})?)"
_AFTER_LABEL = regex.compile(rf"\s*[:=]\s*[\"“]?\s*{_TITLE}*(?P<n>{_NAME})")
_AFTER_KEY = regex.compile(rf"\"\s*:\s*\"\s*{_TITLE}*(?P<n>{_NAME})")
_AFTER_PHRASE = regex.compile(rf"\s+{_TITLE}*(?P<n>{_NAME})")
_AFTER_TITLE = regex.compile(rf"{_TITLE}+(?P<n>{_NAME})")
_BEFORE = regex.compile(rf"(?<![\p{{L}}])(?P<n>{_NAME})\s+$")
_LABEL, _KEY, _PHRASE, _TITLES, _AFTER_NAME, _NUMBERED, _BEFORE_NUMBER, _AFTER_NUMBER, _JOINED, _PREPOSITION, _DIGIT_WORD, _AT_SIGN, _AT_WORDS, _DOT_WORDS = (1 << k for k in range(14))


_STREETS = _NUMBERED | _BEFORE_NUMBER | _AFTER_NUMBER | _PREPOSITION
_SOME_DIGIT = re.compile(r"[0-9]")
_NUMBER_BEFORE = re.compile(r"[0-9]\s*(?:bis|ter|quater|[A-D])?,?\s+$")
_POSTCODE = re.compile(r",\s*[0-9]{5}")


@functools.cache
def _triggers() -> ahocorasick.Automaton:
    """Every literal that may begin a find, with what it may be and its length: a text is read once to know which patterns to try."""
    kinds: dict[str, int] = {}
    lists = ((_LABEL, LABELS), (_KEY, [f'"{k}' for k in KEYS]), (_PHRASE, PHRASES), (_TITLES, TITLES), (_AFTER_NAME, AFTER), (_NUMBERED, STREETS_NUMBERED), (_BEFORE_NUMBER, STREETS_BEFORE), (_AFTER_NUMBER, STREETS_AFTER), (_JOINED, STREETS_JOINED), (_PREPOSITION, STREETS_AT), (_DIGIT_WORD, _DIGITS), (_AT_SIGN, "@"), (_AT_WORDS, ("at", "arroba", "arobase", "ät")), (_DOT_WORDS, ("dot", "punkt", "punto", "point")))
    for kind, words in lists:
        for w in words:
            kinds[w] = kinds.get(w, 0) | kind
    found = ahocorasick.Automaton()
    for w, kind in kinds.items():
        found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


_ANY_NAME = regex.compile(rf"(?<![\p{{L}}@.'’-])(?P<n>{_NAME})(?![\p{{L}}@])")
_SPLIT = regex.compile(r"[\s,]+")
_NAME_WORD = regex.compile(r"\p{L}+(?:['’-]\p{L}+)*")
_NOT_ID = regex.compile(r"(?i)(?:order|serial|reference|tracking|build|version)\s*(?:no\.?|number|#|:)?\s*$")

#: Words that are no part of a name where one is expected.
_NO_NAME = frozenset(
    "the a an and or of to in on at for with from by is are was were be not no our your my his her their its we you they he she it this that these those i me us them as so very too also about after before when while "
    "der die das und ist ein eine wir sie es er ich nicht mit für von zu auf aus bei nach über unter "
    "le la les un une et est pour dans du au aux que qui ne pas par sur avec je tu il elle nous vous ils elles mon ma mes "
    "el los las y es por para con del al que se lo su una fue yo mi mis nos les "
    "customer client name none null given unknown team support service group desk order model edition theme message report answer please sorry here there street road lane avenue garden main monday tuesday wednesday thursday friday saturday sunday "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miércoles jueves viernes sábado domingo "
    "january february march april may june july august september october november december".split()
)


@functools.cache
def _plain(c: str) -> str:
    """What a character becomes in the normal form; look-alikes, which depend on their word, come out as \x00."""
    if c.isascii() or c in "ºª":
        return c
    if c in _HIDDEN:
        return ""
    if c in _LOOKALIKE:
        return "\0"
    if c.isspace():
        return " "
    plain = unicodedata.normalize("NFKC", c)
    return "-" if plain in "‐‑‒–−" else plain


class Normal:
    """The normal form of a text and, for every character of it, its span in the source."""

    __slots__ = ("ends", "hits", "starts", "text")

    def __init__(self, source: str):
        self.text, self.starts, self.ends = source, None, None
        if not source.isascii() and any(_plain(c) != c for c in set(source)):
            self._fold(source)
        self.hits = self._hits()
        if sum(kind & _DIGIT_WORD != 0 for kind, _, _ in self.hits) >= 7 and self._spell():
            self.hits = self._hits()

    def _hits(self) -> list[tuple[int, int, int]]:
        """(kinds, start, end) of every trigger in the text."""
        low = self.text.lower()
        if len(low) != len(self.text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in self.text)
        return [(kind, end + 1 - size, end + 1) for end, (kind, size) in _triggers().iter(low)]

    def _fold(self, source: str) -> None:
        out: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        for i, c in enumerate(source):
            if c in _HIDDEN:
                if ends:
                    ends[-1] = i + 1
                continue
            for x in _plain(c) if c not in _LOOKALIKE else c:
                out.append(x)
                starts.append(i)
                ends.append(i + 1)
        text = "".join(out)
        if any(x in _LOOKALIKE for x in set(text)):
            for m in regex.finditer(r"[\p{L}\p{N}]+", text):
                word = m.group()
                if regex.search(r"[\p{Latin}0-9]", word) and all(x in _LOOKALIKE or not regex.match(r"[\p{Cyrillic}\p{Greek}]", x) for x in word):
                    for k in range(m.start(), m.end()):
                        out[k] = _LOOKALIKE.get(out[k], out[k])
            text = "".join(out)
        self.text, self.starts, self.ends = text, starts, ends

    def _spell(self) -> bool:
        """Runs of seven or more spelled digits as digits."""
        found = list(_SPELLED.finditer(self.text))
        if not found:
            return False
        n = len(self.text)
        starts = self.starts if self.starts is not None else list(range(n))
        ends = self.ends if self.ends is not None else list(range(1, n + 1))
        text, s, e, at = [], [], [], 0
        for m in found:
            text.append(self.text[at : m.start()])
            s += starts[at : m.start()]
            e += ends[at : m.start()]
            for w in regex.finditer(r"\p{L}+", m.group()):
                low = w.group().lower()
                digit = "+" if low == "plus" else _DIGITS[low]
                text.append(digit)
                s.append(starts[m.start() + w.start()])
                e.append(ends[m.start() + w.end() - 1])
            at = m.end()
            if at and self.text[at - 1].isspace():
                text.append(" ")
                s.append(starts[at - 1])
                e.append(ends[at - 1])
        self.text, self.starts, self.ends = "".join(text) + self.text[at:], s + starts[at:], e + ends[at:]
        return True

    def has(self, kind: int) -> bool:
        return any(k & kind for k, _, _ in self.hits)

    def may_hold_email(self) -> bool:
        """Whether there is an at sign, a bracketed word for it, or such a word and a word for the dot."""
        text, at = self.text, False
        for kind, start, end in self.hits:
            if kind & _AT_SIGN:
                return True
            if kind & _AT_WORDS and start and not text[start - 1].isalnum() and not text[end : end + 1].isalnum():
                if text[:start].rstrip()[-1:] in ("[", "(", "{", "<"):
                    return True
                at = True
        return at and self.has(_DOT_WORDS)

    def may_hold_address(self) -> bool:
        """Whether some word for a street stands where an address has it, next to a number."""
        text = self.text
        for kind, start, end in self.hits:
            if kind & _JOINED and text[end : end + 1].isspace() and text[end : end + 20].lstrip()[:1].isdigit():
                return True
            if not kind & _STREETS or (start and text[start - 1].isalnum()):
                continue
            if kind & _AFTER_NUMBER and text[start].isupper() and not text[end : end + 1].isalnum() and _SOME_DIGIT.search(text, max(0, start - 120), start):
                return True
            if kind & _NUMBERED and text[end : end + 1].isspace() and _NUMBER_BEFORE.search(text[max(0, start - 24) : start]):
                return True
            if kind & _BEFORE_NUMBER and _SOME_DIGIT.search(text, end, end + 120):
                return True
            if kind & _PREPOSITION and text[start].isupper() and text[end : end + 1].isspace() and _POSTCODE.search(text, end, end + 120):
                return True
        return False

    def source_span(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return self.starts[start], self.ends[end - 1]


def _parts(name: str) -> tuple[str, str] | None:
    """(given, family) of the text of a name, folded; family names may come first before a comma."""
    if "," in name:
        family, given = (x.strip() for x in name.split(",", 1))
        given = _SPLIT.split(given)[0]
    else:
        words = _SPLIT.split(name.strip())
        given, family = words[0], words[-1]
    given, family = given.rstrip(".").casefold(), family.rstrip(".").casefold()
    if len(family) < 3 or family in _NO_NAME or (len(given) > 1 and given in _NO_NAME) or any(c.isdigit() for c in name):
        return None
    return given, family


def _proper(name: str) -> bool:
    words = [w for w in _SPLIT.split(name) if w]
    return all(w[0].isupper() or w.casefold() in ("de", "del", "von", "van", "der", "y", "la") for w in words)


def blank(text: str, spans: list[tuple[int, int]]) -> str:
    """The text, as long as it was, with nothing left at the spans."""
    for start, end in spans:
        text = text[:start] + "\0" * (end - start) + text[end:]
    return text


def _introductions(normal: Normal, text: str) -> Iterator[tuple[int, int]]:
    """Spans of what may be a name after (or before) an introduction; ``text`` is the normal text with finds blanked out."""
    for kind, start, end in normal.hits:
        m = None
        if kind & _LABEL and (m := _AFTER_LABEL.match(text, end)):
            yield m.span("n")
        if kind & _KEY and (m := _AFTER_KEY.match(text, end)):
            yield m.span("n")
        if kind & _PHRASE and (m := _AFTER_PHRASE.match(text, end)):
            yield m.span("n")
        if kind & _TITLES and not (start and text[start - 1].isalpha()) and (m := _AFTER_TITLE.match(text, start)):
            yield m.span("n")
        if kind & _AFTER_NAME and not text[end : end + 1].isalnum():
            low = max(0, start - 120)
            for m in _BEFORE.finditer(text, low, start, overlapped=True):
                if (low == 0 or m.start() > low) and _SPLIT.split(m.group("n"))[0].rstrip(".").lower() not in TITLES:
                    yield m.span("n")


_INTRODUCING = _LABEL | _KEY | _PHRASE | _TITLES | _AFTER_NAME


def introduced(source: str) -> Iterator[tuple[str, str]]:
    """(given, family) of the properly written names that an introduction supports."""
    normal = Normal(source)
    if not normal.has(_INTRODUCING):
        return
    text = normal.text
    if normal.may_hold_email():
        text = blank(text, [m.span() for m in _EMAIL.finditer(text)])
    if normal.may_hold_address():
        text = blank(text, [m.span() for m in _ADDRESS.finditer(text)])
    for start, end in dict.fromkeys(_introductions(normal, text)):
        if _proper(name := text[start:end]) and (parts := _parts(name)):
            yield parts


def learned_names(df: DataFrame, columns: list[str], least: int = 2) -> DataFrame:
    """``role, word, n``: given (g) and family names (f), folded, seen at least ``least`` times after an introduction, in all texts."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for column in batch.columns:
                for t in column.to_pylist():
                    if t:
                        for given, family in introduced(t):
                            seen["g", given] += len(given) > 1
                            seen["f", family] += 1
        keys = [k for k, n in seen.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["role", "word", "n"])

    counts = df.select(*columns).mapInArrow(per_task, "role string, word string, n long").groupBy("role", "word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least)


def _by_role(found: list) -> tuple[frozenset, frozenset]:
    return frozenset(r.word for r in found if r.role == "g"), frozenset(r.word for r in found if r.role == "f")


@functools.lru_cache(maxsize=4)
def _automaton(words: frozenset[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, True)
    found.make_automaton()
    return found


def find(source: str, given: frozenset = frozenset(), family: frozenset = frozenset()) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the source, in order, not overlapping."""
    normal = Normal(source)
    text = normal.text
    found: list[tuple[str, int, int]] = []

    def take(kind: str, spans: list[tuple[int, int]]) -> None:
        nonlocal text
        found.extend((kind, *s) for s in spans)
        text = blank(text, spans)

    if normal.may_hold_email():
        take("email", [m.span() for m in _EMAIL.finditer(text)])
    if _SIX_DIGITS.search(text):
        take("id_number", [m.span() for m in _IDS.finditer(text) if not _NOT_ID.search(text[max(0, m.start() - 20) : m.start()])])
        phones = []
        for m in _PHONE.finditer(text.replace("=", " ")) if _NINE_DIGITS.search(text) else ():
            digits = sum(c.isdigit() for c in m.group())
            before = text[max(0, m.start() - 24) : m.start()]
            if 9 <= digits <= 15 and not _NOT_PHONE.search(before):
                phones.append(m.span())
        take("phone", phones)
    if normal.may_hold_address():
        take("address", [m.span() for m in _ADDRESS.finditer(text)])
    names: list[tuple[int, int]] = []
    for start, end in sorted(set(_introductions(normal, text))) if normal.has(_INTRODUCING) else ():
        parts = _parts(text[start:end])
        if parts is None or any(s < end and start < e for s, e in names):
            continue
        known = parts[1] in family or parts[0] in given or (parts[1] in given and parts[0] in family)
        if _proper(text[start:end]) or (known and parts[1] in family and (parts[0] in given or len(parts[0]) == 1)):
            names.append((start, end))
    if family and next(_automaton(family).iter(text.casefold()), None):
        for m in _ANY_NAME.finditer(text, overlapped=True):
            start, end = m.span("n")
            parts = _parts(text[start:end])
            if parts is None or parts[1] not in family or any(s < end and start < e for s, e in names):
                continue
            if parts[0] in given or (len(parts[0]) == 1 and text[start].isupper()):
                names.append((start, end))
    take("name", sorted(names))
    return sorted(((k, *normal.source_span(s, e)) for k, s, e in found), key=lambda x: x[1])


_NAME_END = regex.compile(rf"(?<![\p{{L}}@.'’-])(?P<n>{_NAME})[^\p{{L}}\p{{N}}]*$")
_PLACE = regex.compile(r"^[\s\p{P}]*(?:\d{4,5}\s+)?(?:(?:\p{Lu}|\d)[\p{L}\p{N}'’.-]*(?:[\s,]+|$)){0,4}[\s\p{P}]*$")
_CONTENT = regex.compile(r"[\p{L}\p{N}]")


def last_detail(source: str) -> tuple[bool, str, str]:
    """How a text ends: (whether with a contact detail, and else the given and family name it may end with, or '')."""
    if found := find(source):
        kind, _, end = found[-1]
        rest = source[end:]
        if _PLACE.match(rest) if kind == "address" else not _CONTENT.search(rest):
            return True, "", ""
    text = Normal(source[-200:]).text
    for m in _NAME_END.finditer(text, overlapped=True):
        if parts := _parts(m.group("n")):
            if len(parts[0]) > 1 or m.group("n")[0].isupper():
                return False, *parts
    return False, "", ""


def redact(source: str, found: list[tuple[str, int, int]]) -> str:
    """The source with each find replaced by its placeholder."""
    out, at = [], 0
    for kind, start, end in found:
        if start < at:
            continue
        out += [source[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + source[at:]


def scan(df: DataFrame, row_id: str, columns: list[str], lexicon: tuple[frozenset, frozenset]) -> DataFrame:
    """``row_id, field, kinds, redacted``: one row per text that is not null."""
    given, family = lexicon

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            for k, name in enumerate(columns, 1):
                for i, t in zip(ids, batch.column(k).to_pylist(), strict=True):
                    if t is None:
                        continue
                    got = find(t, given, family)
                    rows.append((i, name, sorted({g[0] for g in got}), redact(t, got) if got else t))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.string())], ["row_id", "field", "kinds", "redacted"])

    return df.select(F.col(row_id).cast("long").alias("row_id"), *columns).mapInArrow(per_task, "row_id long, field string, kinds array<string>, redacted string")


def _candidates(text: str) -> set[tuple[str, str]]:
    """(role, word) of everything in a text that the lexicon may know: all that ``find`` may look up there."""
    plain = Normal(text).text
    words = {w for x in (*_NAME_WORD.findall(plain), *_PARTS.findall(plain)) for w in (x, *x.split("-"))}
    return {(role, w.casefold()) for w in words if len(w) > 1 for role in "gf"}


def scan_learned(df: DataFrame, row_id: str, columns: list[str], least: int = 2) -> DataFrame:
    """``scan`` with all learned names: sent to the tasks if they are few, else each text meets those it holds in a join."""
    learned = learned_names(df, columns, least)
    few = learned.limit(LEXICON + 1).collect()
    if len(few) <= LEXICON:
        return scan(df, row_id, columns, _by_role(few))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *c) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for c in sorted(_candidates(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["k", "role", "word"])

    texts = df.select(F.col(row_id).cast("long").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("t")) for c in columns])).alias("x")).select("row_id", "x.*").where("t is not null").withColumn("k", F.sha2(F.col("t").cast("binary"), 256))
    held = texts.select("k", "t").dropDuplicates(["k"]).mapInArrow(words, "k string, role string, word string")
    known = held.join(learned.select("role", "word"), ["role", "word"]).groupBy("k").agg(F.collect_set(F.when(F.col("role") == "g", F.col("word"))).alias("g"), F.collect_set(F.when(F.col("role") == "f", F.col("word"))).alias("f"))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, name, t, g, f in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                got = find(t, frozenset(g or ()), frozenset(f or ()))
                rows.append((i, name, sorted({x[0] for x in got}), redact(t, got)))
            kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["row_id", "field", "kinds", "redacted"])

    return texts.join(known, "k", "left").select("row_id", "field", "t", "g", "f").mapInArrow(per_task, "row_id long, field string, kinds array<string>, redacted string")
