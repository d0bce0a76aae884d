import pytest

from swaplens.llm import broken_pairs, pii, truncation

PROMPT = "Give the gist of the following notes in a few sentences.\n\nThe report lists 20 rows and groups them by category. Nobody noticed the longer preamble until Monday."


@pytest.mark.parametrize("text", [None, "", " \n", "​﻿", "...", "—", '""', "<p></p>", "```\n```", "(no content)", "N/A", "null", "[empty response]", "{}"])
def test_empty(text):
    assert broken_pairs.judge(PROMPT, text, False)[0] == "empty" and broken_pairs.judge(PROMPT, text, True)[0] is None


@pytest.mark.parametrize("text", ["I'm sorry, but I can't help with that.", "I CANNOT ANSWER THIS.", "Es tut mir leid, aber ich kann dazu keine Antwort geben.", "Je ne peux pas répondre à cela.", "Lo siento, pero no puedo ayudar con eso.", "Unfortunately this falls outside what I’m allowed to do."])
def test_refusals(text):
    assert broken_pairs.judge(PROMPT, text, False)[0] == "refusal"


@pytest.mark.parametrize("text", ["I'm sorry that the parcel is late; it leaves the depot today.", "The customer writes that she cannot help the delay and is sorry for it.", "Nobody could explain the warranty, but the report was complete."])
def test_no_refusals(text):
    assert broken_pairs.judge(PROMPT, text, False)[0] is None


def test_copies():
    for text in (PROMPT, PROMPT.lower(), "> " + PROMPT.replace("\n", "\n> "), f'"{PROMPT}"', PROMPT.replace("gist ", "")):
        assert broken_pairs.judge(PROMPT, text, False)[0] == "copy"
    assert broken_pairs.judge(PROMPT, "Nobody noticed the longer preamble until Monday. It helps to compare each category on its own.", False)[0] is None


def test_repetition_is_no_copy():
    prompt = "Translate into French: " + " ".join(f"Support answered within {k} minutes and was very kind." for k in range(6))
    answer = " ".join(f"Der Support antwortete innerhalb von {k} Minuten und war sehr freundlich." for k in range(6))
    assert broken_pairs.judge(prompt, answer, False)[0] == "wrong_language"


@pytest.mark.parametrize(
    ("prompt", "answer", "wrong"),
    [
        (PROMPT, "Les notes décrivent un changement de modèle dont les effets sont apparus tard.", True),
        (PROMPT + "\nPlease answer in French.", "Les notes décrivent un changement de modèle dont les effets sont apparus tard.", False),
        (PROMPT + "\nPlease answer in French.", "The notes describe a change of the model whose effects were late.", True),
        ("Translate into Spanish: The invoice shows the wrong tax rate.", "Die Rechnung zeigt den falschen Steuersatz.", True),
        ("Traduce al francés: La factura muestra un tipo equivocado.", "La facture indique un mauvais taux de taxe.", False),
        (PROMPT, "question", False),
        (PROMPT, '{"service": "a", "der": "die das und ist"}', False),
        (PROMPT, "録音された応答は30件あります。", True),
    ],
)
def test_languages(prompt, answer, wrong):
    assert (broken_pairs.judge(prompt, answer, False)[0] == "wrong_language") is wrong


def test_table(spark):
    whole = "The report lists the rows and groups them by category. Most rows are fine."
    rows = [(1, "ok", PROMPT, whole, "The report lists the rows and gro", None, []), (2, "error", PROMPT, None, None, None, None), (3, "ok", None, whole, None, None, [("f", "{}", "i"), None]), (4, "ok", PROMPT, whole * 2000, whole, None, None), (5, "ok", PROMPT, '{"a": 1, "b', "complaint", None, None), (5, "ok", PROMPT, '{"a": 1, "b', "complaint", None, None)]
    calls = "array<struct<name:string,arguments_json:string,id:string>>"
    df = spark.createDataFrame(rows, f"row_id long, status string, prompt_text string, baseline_text string, target_text string, baseline_tool_calls {calls}, target_tool_calls {calls}").selectExpr("*", "'x' defect")

    def found(frame):
        facts = broken_pairs.closed_by_names(broken_pairs.pair_facts(frame), pii.learned_names(frame, ["prompt_text"]))
        answers = frame.where("status = 'ok'").selectExpr("explode(array(baseline_text, target_text)) text")
        return sorted(tuple(r) for r in broken_pairs.defective_pairs(facts, truncation.ending_contexts(answers, "text", facts)).collect())

    assert found(df) == [(1, "target", "truncated"), (5, "baseline", "truncated"), (5, "baseline", "truncated")]
    assert found(df.limit(0)) == []


LONG_REFUSAL = "Thank you for your message and for the notes. I understand that you want a short gist of them for the meeting. After reading them I have to tell you that I cannot help with this request. The reason is that the notes name people whose consent to such a use is not known, and I follow principles that protect them. I must treat every such text alike, whoever sends it and whatever it is meant for. I hope you understand. Please ask the people named for their consent, and feel free to come back with another text."


@pytest.mark.parametrize("text", [LONG_REFUSAL, "Thank you for the notes. You asked me for the gist of them. I'm afraid I can't help with that.", "Vielen Dank für die Notizen. Sie haben mich um eine Zusammenfassung gebeten. Das kann ich leider nicht übernehmen."])
def test_refusals_that_decline_late_or_at_length(text):
    assert broken_pairs.judge(PROMPT, text, False)[0] == "refusal"


def test_an_answer_that_also_declines_something_is_no_refusal():
    text = "The report lists twenty rows and groups them by category. Nobody noticed the longer preamble until Monday. The rows of the second group hold the late parcels, the third one the returns. I can't say which category is the largest."
    assert not broken_pairs.is_refusal(text) and not broken_pairs.is_refusal(text + " " + text)


@pytest.mark.parametrize("text", ["Sorry, no.", "I'm afraid I cannot.", "That request is one I choose not to answer.", "As an AI language model, I do not have the capability.", "Lo siento, pero eso no lo haré.", "Leider ausgeschlossen.", "Désolé, mais non."])
def test_short_refusals(text):
    assert broken_pairs.judge(PROMPT, text, False)[0] == "refusal"


def test_a_copy_between_polite_sentences():
    assert broken_pairs.judge(PROMPT, f"Sure, here is your text. {PROMPT} I hope this is what you wanted. Please let me know if you need more.", False)[0] == "copy"
    assert broken_pairs.judge(PROMPT, f"{PROMPT}\n\nIn short, the labels grew by a third and the rows of the second group were late, which nobody had seen.", False)[0] is None


@pytest.mark.parametrize("text", ["Het rapport somt twintig rijen op en groepeert ze per categorie. Niemand merkte de langere inleiding op.", "Raport wymienia dwadzieścia wierszy i grupuje je według kategorii, ale nikt nie zauważył, że wstęp jest dłuższy.", "Il rapporto elenca venti righe e le raggruppa per categoria, ma nessuno ha notato che il preambolo è più lungo."])
def test_further_languages(text):
    assert broken_pairs.judge(PROMPT, text, False)[0] == "wrong_language"
