import pytest

from swaplens.llm import spam

PROSE = "The team replays its traffic every Monday. Nobody had expected that the labels would grow. We compared the answers and wrote a short note about it. "
SPAM = {
    "links": "\n".join(f"https://www.deals{k}.example/offers/{k}" for k in range(30)),
    "titled": "\n".join(f"- [cheap tokens](http://mart.example/{k})" for k in range(20)),
    "menu": " | ".join(["Home", "Deals", "Pricing", "Login", "FAQ"] * 9),
    "tags": "\n".join(f"Item {k} | best llm, cheap tokens, prompt cache" for k in range(15)),
    "hashtags": "#cheap_tokens #bestllm #promptcache " * 20,
    "stuffed": "buy replay tool here compare replay tool now best replay tool fast " * 12,
    "chinese": "\n".join("便宜模型 便宜模型 便宜模型 最佳模型 便宜模型 便宜模型。" for _ in range(12)),
    "places": "\n".join(f"llm api near Town{k % 7}" for k in range(30)),
}
FINE = {
    "prose": PROSE * 5,
    "references": PROSE * 5 + "\nReferences\n" + "\n".join(f"https://a.example/{k}" for k in range(5)),
    "log": "\n".join(f"2026-06-11 17:{k % 60:02d} ticket-router INFO status=200 ms={k * 7}" for k in range(40)),
    "table": "model;in;out;ms\n" + "\n".join(f"tarn-8b;{k};{k * 3};{k * 9}" for k in range(40)),
    "code": "```python\n" + "for item in group:\n    best = item\n" * 20 + "```",
    "glossary": "\n".join(f"Term{k}: the {w} that is used when a row is read from the store." for k, w in enumerate("name key rate label score model row table column file".split())),
    "russian": "Отчёт содержит 5703 строк. Задержка сервиса выросла до 32 секунд. " * 12,
    "hindi": "रिपोर्ट में 4355 पंक्तियाँ हैं। लागत 93 प्रतिशत बढ़ी। " * 12,
    "japanese": "録音された応答は36件あります。再生はチームが担当します。" * 9,
}


def shares(spark, docs):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, symbols string")
    pages = spam.page_units(df, "doc_id", "text")
    return {r.doc_id: r.spam_share for r in spam.page_shares(pages, spam.train(pages)).collect()}


def test_pages(spark):
    docs = [*SPAM.values(), *FINE.values(), PROSE + "\n" + SPAM["menu"] * 3, None, "", "  \n ", PROSE * 3000]
    got = shares(spark, docs)
    for i, name in enumerate([*SPAM, *FINE]):
        assert (got[i] > 0.5) == (name in SPAM), (name, got[i])
    n = len(SPAM) + len(FINE)
    assert got[n] > 0.5 and not {n + 1, n + 2, n + 3} & got.keys() and got[n + 4] < 0.1


def test_empty_table(spark):
    assert shares(spark, [None]) == {}


@pytest.mark.parametrize("length", [1, 2, 50])
def test_viterbi_matches_brute_force(length):
    import itertools

    import numpy as np

    emit, move = (np.log(t) for t in spam.start_model())
    seen = bytes((k * 5) % len(spam.SYMBOLS) for k in range(min(length, 5)))
    best = max(itertools.product(range(len(spam.STATES)), repeat=len(seen)), key=lambda p: emit[p[0], seen[0]] + sum(move[a, b] + emit[b, s] for a, b, s in zip(p, p[1:], seen[1:], strict=False)))
    got = spam.viterbi(seen, emit, move)
    score = lambda p: emit[p[0], seen[0]] + sum(move[a, b] + emit[b, s] for a, b, s in zip(p, p[1:], seen[1:], strict=False))
    assert score(list(got)) == pytest.approx(score(best))
