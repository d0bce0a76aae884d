"""Prompt and response pairs whose answer is defective: empty, refusal, copy, truncated or in the wrong language.

Copies are found by compressing the answer with its prompt as a zstandard dictionary: what is left of an answer that gives the
prompt back is next to nothing. Refusals and languages are found by dictionaries, truncations by the terminal-context model
of ``truncation`` over the answers themselves. An answer has one defect, the first of the order above.

The reading of rows is map-only; the terminal contexts are aggregated by context before they meet the open endings.

Defined results: an answer is empty if it is null or without content and its side has no tool calls; an answer of a row whose
prompt is null is not judged as a copy or by language; short labels and structured answers have no language; repeated
rows are reported each.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swaplens.llm import pii, truncation
from swaplens.llm.languages import FUNCTION_WORDS, asked_language, language_of, scores

#: Placeholders that stand for no answer.
PLACEHOLDERS = frozenset("n/a|na|n.a.|null|none|nil|nan|undefined|empty|no content|no response|no answer|no output|empty response|empty answer|no text|blank|missing|tbd|todo|placeholder|kein inhalt|keine antwort|leer|sin contenido|sin respuesta|vacío|pas de contenu|pas de réponse|sans réponse|aucune réponse|vide".split("|"))
_CONTENT = regex.compile(r"[\p{L}\p{N}]")
_TAGS = re.compile(r"<[^<>]{0,200}>|```[a-z]*|&nbsp;|&#\d+;")

#: How an assistant declines, by language.
_OBJECT_EN = r"(?:that|this|it|you|these|those|the|such|your|any|an|a|here|on|with|to|help|assist|answer|comply|process|produce|provide|write|writing|work|carry|complete|fulfil\w*|do|doing|give|giving|be|discuss|engage|continue|respond|create|generate|share|support|go|take|handle|deal|read|look|review|translate|summari[sz]e|classify|rewrite|explain|extract|try|trying|proceed|meet|accept|attempt|perform|offer|say|tell|make|pursue|serve|address|touch|follow)\b"
REFUSALS = {
    "en": [
        rf"\b(?:i|we)\s*(?:can\s?not|can'?t|could not|couldn'?t|will not|won'?t|wouldn'?t|do not want to|don'?t want to|may not|am not able to|'?m not able to|are not able to|am unable to|'?m unable to|are unable to|am not allowed to|'?m not allowed to|am not in a position to|'?m not in a position to|would rather not|'?d rather not|prefer not to|'?d prefer not to|would prefer not to|must decline|must refuse|have to decline|have to refuse|have to refrain|need to decline|need to refuse|decline|refuse|must refrain|am going to pass|'?m going to pass|'?ll have to pass|will have to pass)\s*,?\s*(?:to\s+|from\s+|be\s+)?{_OBJECT_EN}",
        r"\bit(?:'?s| is|\s?isn'?t| is not)\s*(?:not\s+|im)?possible for (?:me|us) to\b",
        r"\b(?:this|that|it)(?:'?s| is)? (?:not something|nothing) (?:i|we) (?:can|could|will|am|'m)\b",
        r"\b(?:outside|beyond|against)(?: of)? (?:what|that which|my|our)\b[^.!?]{0,30}?\b(?:allowed|able|can|may|permitted|guidelines|rules|policy|policies|remit|scope|limits|abilities)\b",
        r"\bi (?:must|have to|need to|'ll have to|will have to) (?:say no|pass|leave (?:this|that|it))\b",
        r"\b(?:contrary to|against|goes against|conflicts with|violates) (?:my|our) (?:\w+ )?(?:guidelines|rules|policy|policies|instructions|principles)\b",
        r"\bno (?:answer|reply|text) (?:can|will) be (?:given|provided|produced)\b",
        r"\b(?:i|we) (?:choose|prefer|decide|elect|opt|have chosen|have decided) not to\b",
        r"\b(?:i|we) (?:do not|don't|lack) (?:have )?the (?:capability|capabilities|ability|permission|authori[sz]ation)\b",
        r"\bi'?m afraid (?:i|we) (?:can\s?not|can't|won't|will not|must decline)\b",
        r"^(?:sorry|apologies|i'm sorry|i am sorry|unfortunately|i'm afraid)\s*[,.:;–—-]*\s*(?:but )?no\s*[.!]*$",
    ],
    "de": [
        r"\b(?:mir|uns) ist (?:es|das|dies)\b[^.!?]{0,50}?\b(?:nicht|kaum) (?:möglich|erlaubt|gestattet)\b",
        r"\b(?:gegen|widerspricht|verstößt gegen)\b[^.!?]{0,20}?\b(?:meine|meinen|unsere|unseren)\b[^.!?]{0,20}?\b(?:richtlinien|vorgaben|regeln|anweisungen|grundsätze\w*)\b",
        r"\b(?:außerhalb dessen|übersteigt das|geht über das|jenseits dessen|überschreitet)\b[^.!?]{0,40}?\b(?:darf|kann|erlaubt|möglich)\b",
        r"\b(?:ich|wir)\s+(?:kann|können|darf|dürfen|möchte|möchten|werde|werden|will|wollen)\b[^.!?]{0,80}?\b(?:nicht|kein\w*|ablehnen|absehen|verzichten)\b",
        r"\b(?:kann|können|darf|möchte|werde|will) (?:ich|wir)\b[^.!?]{0,80}?\b(?:nicht|kein\w*|ablehnen|absehen|verzichten)\b",
        r"\b(?:ich|wir) (?:bin|sind)\b[^.!?]{0,40}?\bnicht (?:in der lage|befugt|berechtigt|imstande)\b",
        r"\bist (?:es )?(?:mir|uns)\b[^.!?]{0,50}?\b(?:nicht möglich|unmöglich|nicht erlaubt|nicht gestattet)\b",
        r"\bes ist (?:mir|uns)\b[^.!?]{0,50}?\b(?:nicht möglich|unmöglich|nicht erlaubt|nicht gestattet)\b",
        r"\b(?:ich|wir) (?:muss|müssen|lehne|lehnen)\b[^.!?]{0,60}?\b(?:ablehnen|ab|absehen|verzichten|passen)\b",
        r"\bmuss (?:ich|wir)\b[^.!?]{0,60}?\b(?:ablehnen|absehen|verzichten|passen)\b",
        r"^(?:das ist |dies ist )?(?:leider|bedauerlicherweise|tut mir leid)\s*[,.:;–—-]*\s*(?:das ist )?(?:nein|ausgeschlossen|nicht möglich|unmöglich|nicht machbar)\s*[.!]*$",
    ],
    "fr": [
        r"\bne (?:m'est|nous est) (?:malheureusement )?pas (?:possible|permis)\b",
        r"\bje n(?:e |')\w+rai pas\b",
        r"\bm'abstenir\b",
        r"\b(?:contraire|contraires) à (?:mes|nos) (?:consignes|règles|instructions|principes|directives)\b",
        r"\b(?:dépasse|sort de|en dehors de|hors de|au-delà de) ce (?:que|qui)\b[^.!?]{0,30}?\b(?:permis|autorisée?|peux|puis|faire|possible|pouvoir)\b",
        r"\bje (?:ne )?(?:peux|puis|pourrai|suis|veux|vais|souhaite|saurais)\s+(?:malheureusement )?pas\b",
        r"\bje (?:ne )?suis (?:malheureusement )?pas en mesure\b",
        r"\b(?:il m'est|il ne m'est|cela m'est|ça m'est)\s+(?:malheureusement )?(?:impossible|pas possible)\b",
        r"\bje (?:dois|préfère|me vois contrainte?|suis contrainte?|suis obligée?)\s+(?:malheureusement )?(?:de |ne pas|refuser|décliner|m'abstenir)",
        r"\bje (?:refuse|décline|m'abstiens)\b",
        r"\bne (?:peux|puis)-je pas\b",
        r"^(?:désolée?|malheureusement|je regrette)\s*[,.:;–—-]*\s*(?:mais )?(?:non|c'est impossible|impossible)\s*[.!]*$",
    ],
    "es": [
        r"\b(?:contrari[oa] a|en contra de) (?:mis|nuestras) (?:normas|reglas|instrucciones|directrices|políticas|pautas)\b",
        r"\bno (?:escribiré|haré|responderé|entregaré|redactaré|traduciré|resumiré|atenderé|contestaré|procesaré)\b",
        r"\b(?:fuera de lo que|excede lo que|más allá de lo que|supera lo que)\b[^.!?]{0,30}?\b(?:puedo|permitido|permite|hacer|autorizad[oa])\b",
        r"\b(?:yo )?no (?:puedo|podré|me es posible|voy a poder|voy a|quiero|estoy en condiciones|estoy autorizad[oa]|me está permitido|soy capaz|podemos)\b",
        r"\bme (?:es|resulta) imposible\b",
        r"\b(?:debo|tengo que|prefiero|he de)\s+(?:rechazar|declinar|negarme|abstenerme|no)\b",
        r"\bme (?:niego|abstengo)\b",
        r"\b(?:eso|esto|ello) no (?:lo|la) (?:haré|puedo hacer|voy a hacer|escribiré|responderé)\b",
        r"^(?:lo siento|lamentablemente|desgraciadamente)\s*[,.:;–—-]*\s*(?:pero )?(?:no|es imposible|imposible)\s*[.!]*$",
    ],
}
_REFUSAL = {code: regex.compile("(?i)" + "|".join(f"(?:{x})" for x in patterns)) for code, patterns in REFUSALS.items()}
#: What is said around a refusal (thanks, regrets, the request again, reasons, offers), by language.
_AROUND = regex.compile(
    r"(?i)\b(?:thanks?|sorry|apologi[sz]e|apologies|regret|unfortunately|appreciate|(?:you|your) (?:ask(?:ed)?|want(?:ed)?|request(?:ed)?|request|question|message|understanding|patience|interest)|(?:this|the|such a|that) (?:request|topic|kind of)|guidelines|polic(?:y|ies)|principles|(?:not )?(?:allowed|permitted) to|(?:harm(?:ful)?|unsafe|inappropriate|misuse)|(?:i|we)(?:'m| am|'d| would| are)? (?:be )?(?:happy|glad|can help|could help|can offer|hope|understand|know|have to|must|need to|follow|take|avoid|believe)|instead|please (?:consult|contact|ask|turn|reach)|feel free|the reason"
    r"|danke|vielen dank|leid|entschuldig\w*|bedau[er]\w*|leider|(?:ihre|deine|diese|die) (?:anfrage|frage|bitte|nachricht)|(?:sie|du) (?:haben|hast|möchten|möchtest|wollen|willst|bitten|bittest)|richtlinien|vorgaben|grundsätze\w*|stattdessen|gerne?|verständnis|der grund|(?:ich|wir) (?:hoffe|verstehe|muss|müssen|halte|vermeide)|wenden sie sich"
    r"|merci|désolée?|regrette|malheureusement|(?:votre|ta|cette) (?:demande|question|message)|(?:vous m'avez|vous avez|tu m'as|vous me|tu me|vous souhaitez) |consignes|directives|volontiers|compréhension|la raison|à la place|je (?:comprends|dois|reste|préfère|sais|peux)"
    r"|gracias|siento|lamento|disculpa\w*|desafortunadamente|lamentablemente|(?:su|tu|esta) (?:solicitud|petición|pregunta|mensaje)|(?:me has|me ha|usted me|quieres|quiere) |directrices|normas|políticas|en su lugar|con gusto|comprensión|la razón|el motivo|(?:entiendo|comprendo|espero|puedo ayudar))\b"
)
_SENTENCE = regex.compile(r"(?<=[.!?。])\s+")
_QUOTED = regex.compile(r"[“„«\"][^“”„«»\"]{12,}[”“»\"]|^>.*$", regex.M)
_CODE = re.compile(r"```[\s\S]*?(?:```|$)|`[^`\n]*`|https?://\S+|\S+@\S+")
_TURN = re.compile(r"(?:^|\n)\[(?:user|system|assistant|tool)[^\]\n]*\]\s*", re.I)


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    bare = _TAGS.sub("", text)
    if not _CONTENT.search(bare):
        return True
    inner = _EDGES.sub("", bare).lower()
    return inner in PLACEHOLDERS or inner.replace("/", "") in PLACEHOLDERS


def is_refusal(text: str) -> bool:
    """Declines in the first person, and does little else: a short answer in its first sentences, any answer if at most half
    of its words are neither in declining sentences nor in what is said around them."""
    plain = text.replace("’", "'").replace("`", "'")
    words = plain.split()
    if len(words) <= 60 and _declines(" ".join(_SENTENCE.split(" ".join(words).strip("*_\"“”'>"))[:2])):
        return True
    if not _declines(" ".join(words)):
        return False
    sentences = [" ".join(x.split()) for x in _SENTENCE.split(_QUOTED.sub(" ", plain))]
    declining = [_declines(x) for x in sentences]
    rest = sum(len(x.split()) for x, no in zip(sentences, declining, strict=True) if not no and not _AROUND.search(x))
    return any(declining) and rest <= 0.5 * sum(len(x.split()) for x in sentences)


#: Some part of each way to decline; a text without any does not.
_DECLINING = re.compile(r"n't|n’t|\b(?:can ?not|not|unable|declin|refus|refrain|pass\b|impossib|nothing|outside|beyond|against|contrary|conflict|violat|no\b|leave|lack|nicht|kein|ablehn|absehen|verzicht|unmöglich|möglich|gegen|widerspr|verstößt|außerhalb|übersteigt|geht über|jenseits|überschr|lehne|ausgeschl|pas\b|m'abst|contraire|dépasse|sort de|en dehors|hors de|au-delà|déclin|dois|préfère|vois|contraint|obligé|non\b|contrari|en contra|fuera|excede|más allá|supera|imposib|debo|tengo que|prefiero|he de|niego|abst)", re.I)


def _declines(text: str) -> bool:
    return bool(_DECLINING.search(text)) and any(p.search(text) for p in _REFUSAL.values())


_MARKS = regex.compile(r"[\s\p{P}\p{S}\p{Cf}]+")
_EDGES = regex.compile(r"^[\s\p{P}\p{S}\p{Cf}]+|[\s\p{P}\p{S}\p{Cf}]+$")


@functools.lru_cache(maxsize=2048)
def _folded(text: str) -> str:
    return _MARKS.sub(" ", text).strip().casefold()


def left_alone(answer: str) -> float:
    """Share of the answer's bytes that remain when it is compressed by itself."""
    data = _folded(answer).encode()
    return max(0, len(zstandard.ZstdCompressor(level=9, write_content_size=False).compress(data)) - 9) / max(1, len(data))


def left_of_copy(prompt: str, answer: str) -> float:
    """Share of the answer's bytes that remain when it is compressed with the prompt as its dictionary."""
    data = _folded(answer).encode()
    base = _folded(prompt).encode()
    if not data or len(base) < 8:
        return 1.0
    plan = zstandard.ZstdCompressionDict(base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = len(zstandard.ZstdCompressor(level=9, dict_data=plan, write_content_size=False).compress(data))
    return max(0, size - 9) / len(data)


#: Sentences that only hand a text over, by their beginnings.
_FRAME = regex.compile(
    r"(?i)^\W*(?:sure|certainly|of course|here (?:is|are|it|you)|you (?:wrote|asked|said|sent)|your (?:request|question|message|prompt|text)|the (?:request|question|prompt|text|message) (?:was|is|reads)|as (?:requested|you asked)|i (?:hope|have repeated|repeat|received)|let me (?:know|repeat)|thank you|thanks|please (?:let|tell)|is there anything|happy to|glad to|input|prompt|question|answer|response|output|original"
    r"|gerne?|natürlich|selbstverständlich|hier (?:ist|sind|der|die|das)|(?:ihre|deine) (?:anfrage|frage|nachricht|eingabe)|sie (?:schrieben|fragten)|ich (?:hoffe|wiederhole)|vielen dank|danke|bitte (?:geben|sagen|lassen)|kann ich|eingabe|frage|antwort"
    r"|bien sûr|volontiers|certainement|voici|voilà|votre (?:demande|question|message)|vous avez (?:écrit|demandé)|j'espère|merci|n'hésitez|dites-moi|demande|réponse"
    r"|claro|por supuesto|con gusto|aquí (?:está|tiene|tienes|va)|su (?:solicitud|pregunta|mensaje)|tu (?:solicitud|pregunta|mensaje)|usted escribió|espero|gracias|no dude|pregunta|respuesta)\b"
)
_PIECES = regex.compile(r"(?<=[.!?。:])\s+|\n+")


def is_copy(prompt: str, answer: str, most: float = 0.3) -> bool:
    """Gives the prompt back: nearly nothing of the answer is new, which its own repetitions don't explain, and it is
    about as long as the prompt or its last turn; or it is longer, holds the prompt, and what it adds only hands it over."""
    turns = [t for t in _TURN.split(prompt) if t.strip()]
    a = len(_folded(answer))
    for given in dict.fromkeys([prompt, turns[-1] if turns else prompt]):
        b = len(_folded(given))
        if not b or a < 0.7 * b:
            continue
        if a <= 1.6 * b + 40:
            left = left_of_copy(given, answer)
            if left <= most * min(1.0, a / b) and left <= 0.5 * left_alone(answer):
                return True
        if a > b and b >= 40 and left_of_copy(answer, given) <= 0.1:
            whole = f" {_folded(given)} "
            added = [x for x in _PIECES.split(answer) if (f := _folded(x)) and f" {f} " not in whole and left_of_copy(given, x) > 0.4]
            if all(_FRAME.search(x) for x in added):
                return True
    return False


def _instruction(prompt: str) -> str:
    turns = [t for t in _TURN.split(prompt) if t.strip()]
    return turns[-1] if turns else prompt


@functools.lru_cache(maxsize=2048)
def _own_language(prompt: str) -> str | None:
    return language_of(_CODE.sub(" ", _instruction(prompt))) or language_of(_CODE.sub(" ", prompt))


_asked = functools.lru_cache(maxsize=2048)(asked_language)


def is_wrong_language(prompt: str, answer: str) -> bool:
    """Prose in another language than the one asked for, or else than the prompt's."""
    asked = _asked(prompt)
    prose = _CODE.sub(" ", answer)
    if prose.lstrip()[:1] in "{[" and re.search(r'":', prose):
        return False
    own = _QUOTED.sub(" ", prose)
    if len(own.split()) < 4:
        own = prose
    got = language_of(own)
    if got is None:
        return False
    if asked:
        return got != asked
    wanted = _own_language(prompt)
    if wanted is None or wanted == got:
        return False
    if got not in FUNCTION_WORDS:
        return True  # told by its script
    found, words = scores(own)
    return words >= 4 and found.get(got, 9.0) > 1.5 * found.get(wanted, 0.0) + 0.5


FACTS = "row_id long, side string, defect string, state string, marked boolean, before string, last string, given string, family string"


def judge(prompt: str | None, answer: str | None, tools: bool) -> tuple[str | None, tuple]:
    """(defect other than truncated or null, ending)."""
    none = ("complete", False, "", "")
    if is_empty(answer):
        return (None if tools else "empty"), none
    if is_refusal(answer):
        return "refusal", none
    if prompt and is_copy(prompt, answer):
        return "copy", none
    wrong = prompt is not None and is_wrong_language(prompt, answer)
    return ("wrong_language" if wrong else None), truncation.ending(answer)


def pair_facts(df: DataFrame) -> DataFrame:
    """One row per answer of a row with status ok: its defect so far, and its ending; for an open ending that a name may close, its
    given and family name."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, prompt, base, base_tools, target, target_tools in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for side, text, tools in (("baseline", base, base_tools), ("target", target, target_tools)):
                    defect, end = judge(prompt, text, bool(tools))
                    detail, *name = pii.last_detail(text) if end[0] == "open" else (False, "", "")
                    if detail:
                        end = ("complete", False, "", "")
                    rows.append((i, side, defect, *end, *name))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in FACTS.split(", ")])

    ok = df.where("status = 'ok'")
    calls = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x.isNotNull())), F.lit(0)) > 0
    given = ok.select(F.col("row_id").cast("long").alias("row_id"), "prompt_text", "baseline_text", calls("baseline_tool_calls").alias("bt"), "target_text", calls("target_tool_calls").alias("tt"))
    return given.mapInArrow(per_task, FACTS)


def closed_by_names(facts: DataFrame, learned: DataFrame) -> DataFrame:
    """``facts`` without the open endings that a learned name closes: these need no full stop. Only endings that may be names are joined."""
    named = F.coalesce((F.col("state") == "open") & (F.col("family") != ""), F.lit(False))
    family = learned.where("role = 'f'").select(F.col("word").alias("f"), F.lit(True).alias("f_known"))
    given = learned.where("role = 'g'").select(F.col("word").alias("g"), F.lit(True).alias("g_known"))
    met = facts.where(named).join(family, F.col("family") == F.col("f"), "left").join(given, F.col("given") == F.col("g"), "left")
    closed = F.col("f_known") & (F.col("g_known") | (F.length("given") == 1))
    met = met.withColumn("state", F.when(closed, "complete").otherwise(F.col("state")))
    return facts.where(~named).unionByName(met.drop("f", "f_known", "g", "g_known"))


def defective_pairs(facts: DataFrame, contexts: DataFrame, least: float = 0.35) -> DataFrame:
    """``row_id, side, defect``."""
    judged = truncation.with_chance(facts.withColumn("at_limit", F.lit(False)), contexts)
    cut = (F.col("state") == "broken") | ((F.col("state") == "open") & (F.col("chance") < least))
    first = F.col("defect").isin("empty", "refusal", "copy")
    defect = F.when(first, F.col("defect")).when(cut, F.lit("truncated")).otherwise(F.col("defect"))
    return judged.select("row_id", "side", defect.alias("defect")).where("defect is not null")
