import pytest

from swaplens.llm import pii

LEXICON = (frozenset({"hugo", "amara"}), frozenset({"stanvick", "ibarrola-finch"}))

FOUND = [
    ("write to hugo.x+y@mail.example today", "email", "hugo.x+y@mail.example"),
    ("hugo dot quill at mail dot example", "email", "hugo dot quill at mail dot example"),
    ("clara [at] example.net", "email", "clara [at] example.net"),
    ("huɡo​@mаil.example".replace("ɡ", "g"), "email", "hugo​@mаil.example"),  # hidden character and Cyrillic a
    ("call +44 7700 900935.", "phone", "+44 7700 900935"),
    ("tel (221) 555-0199, late", "phone", "(221) 555-0199"),
    ("030/23125065", "phone", "030/23125065"),
    ("my number: zero seven seven zero zero nine zero zero nine six two ok", "phone", "zero seven seven zero zero nine zero zero nine six two"),
    ("passport X6297001K", "id_number", "passport X6297001K"),
    ("QQ 46 54 13 C", "id_number", "QQ 46 54 13 C"),
    ("978-58-9218", "id_number", "978-58-9218"),
    ("Steuer-ID 18 687 764 400", "id_number", "Steuer-ID 18 687 764 400"),
    ("at 41 Old Brewer Lane, Mills", "address", "41 Old Brewer Lane"),
    ("Obere Hofstraße 182, 60122 X", "address", "Obere Hofstraße 182"),
    ("15 bis chemin de la Grève, M", "address", "15 bis chemin de la Grève"),
    ("C/ de los Olmos 191, 4º C, V", "address", "C/ de los Olmos 191, 4º C"),
    ("I met HUGO STANVICK there", "name", "HUGO STANVICK"),
    ("customer: hugo stanvick came", "name", "hugo stanvick"),
    ("Stanvick, Amara wrote", "name", "Stanvick, Amara"),
    ("A. Ibarrola-Finch", "name", "A. Ibarrola-Finch"),
]


@pytest.mark.parametrize(("text", "kind", "part"), FOUND)
def test_found_at_its_source_span(text, kind, part):
    got = pii.find(text, *LEXICON)
    assert [(k, text[s:e]) for k, s, e in got] == [(kind, part)]
    assert pii.redact(text, got) == text.replace(part, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", ["pip install widget@1.2.3", "registry.test/app@sha256:ab12f0", "Order 4415-0098-2231 is open", "Serial 0199-00-44-17 on the box", "Build 20.10.3.1155", "Server 10.20.30.40 timed out", "Version 1.555.0142", "Tracking JX 4471 0092 118", "Reference 2026-0611-0907.", "Reply to {customer_email} please", "[NAME] asked again", "Mara Stovetop is our cheapest model", "Main Street is the name of the theme", "Meet at gate 14, hall 3.", "hugo.stanvick@mail.example"[:4] + " said so", "phone: none given", "", "x" * 300_000])
def test_decoys(text):
    assert pii.find(text, *LEXICON) == []


def test_names_in_addresses_of_mail_do_not_count():
    assert [k for k, *_ in pii.find("hugo stanvick@example.org", *LEXICON)] == ["email"]


def test_table(spark):
    rows = [(1, "customer: Hugo Stanvick", None, "x"), (2, "signed by Hugo Stanvick", "Hugo Stanvick", "x"), (2, "signed by Hugo Stanvick", "Hugo Stanvick", "x"), (3, None, "", "x")]
    df = spark.createDataFrame(rows, "row_id long, a string, b string, kinds string")
    learned = {(r.role, r.word, r.n) for r in pii.learned_names(df, ["a", "b"]).collect()}
    assert learned == {("g", "hugo", 3), ("f", "stanvick", 3)}
    lexicon = (frozenset({"hugo"}), frozenset({"stanvick"}))
    got = sorted((r.row_id, r.field, tuple(r.kinds), r.redacted) for r in pii.scan(df, "row_id", ["a", "b"], lexicon).collect())
    assert got == [(1, "a", ("name",), "customer: [NAME]"), (2, "a", ("name",), "signed by [NAME]"), (2, "a", ("name",), "signed by [NAME]"), (2, "b", ("name",), "[NAME]"), (2, "b", ("name",), "[NAME]"), (3, "b", (), "")]
    assert pii.scan_learned(df.limit(0), "row_id", ["a", "b"]).count() == 0


@pytest.mark.parametrize("text", ["My name is Orsolya Vetterlund and I wait.", "Customer: Orsolya Vetterlund", "signed by Orsolya Vetterlund"])
def test_introduced_names_need_no_lexicon(text):
    for lexicon in (LEXICON, (frozenset(), frozenset())):
        assert [(k, text[s:e]) for k, s, e in pii.find(text, *lexicon)] == [("name", "Orsolya Vetterlund")]


def test_a_lexicon_beyond_the_bound_gives_the_same(spark, monkeypatch):
    rows = [(k, f"customer: {g} {f}", f"I met {g} {f} and Ada Quell-Norring there", "x") for k, (g, f) in enumerate([("Hugo", "Stanvick"), ("Hugo", "Stanvick"), ("Amara", "Ibarrola-Finch"), ("Amara", "Ibarrola-Finch"), ("Ada", "Quell-Norring"), ("Ada", "Quell-Norring"), ("Orla", "Single")])] + [(1, None, "O'Hara, Hugo", "x"), (8, "", "Plain text", "x")]
    df = spark.createDataFrame(rows, "row_id long, a string, b string, kinds string")
    found = lambda: sorted((r.row_id, r.field, tuple(r.kinds), r.redacted) for r in pii.scan_learned(df, "row_id", ["a", "b"]).collect())
    small = found()
    monkeypatch.setattr(pii, "LEXICON", 1)
    assert found() == small
    assert (0, "b", ("name",), "I met [NAME] and [NAME] there") in small and (6, "a", ("name",), "customer: [NAME]") in small


@pytest.mark.parametrize(("kind", "part"), [("phone", "six one two four seven eight nine two one two"), ("phone", "zéro six un deux quatre sept huit neuf un deux"), ("phone", "OH SIX ONE TWO FOUR SEVEN EIGHT NINE ONE TWO"), ("id_number", "DNI seis uno dos cero cuatro siete ocho nueve")])
def test_spelled_digits_without_zero_three_or_five(kind, part):
    text = f"Please note: {part}, thank you."
    assert [k for k, *_ in pii.find(text, *LEXICON)] == [kind]
    assert pii.redact(text, pii.find(text, *LEXICON)).startswith(f"Please note: [{kind.upper()}]")


@pytest.mark.parametrize(("text", "kind", "part"), [("call 612 345 678 now", "phone", "612 345 678"), ("tel 91 234 56 78", "phone", "91 234 56 78"), ("lives at Via Roma 12, Milano", "address", "Via Roma 12"), ("Ulica Długa 5", "address", "Ulica Długa 5"), ("ID number 12-3456-789", "id_number", "ID number 12-3456-789")])
def test_national_forms(text, kind, part):
    assert [(k, text[s:e]) for k, s, e in pii.find(text, *LEXICON)] == [(kind, part)]


@pytest.mark.parametrize(("text", "want"), [("Please call back. Regards, Orsolya Vetterlund", (True, "", "")), ("We met Hugo Stanvick", (False, "hugo", "stanvick")), ("write to a@b.example", (True, "", "")), ("the report lists rows of the", (False, "", "")), ("It is at 41 Old Brewer Lane, Mills", (True, "", ""))])
def test_last_detail(text, want):
    assert pii.last_detail(text) == want
