import pytest

from swaplens.llm import truncation


@pytest.mark.parametrize(
    ("text", "state"),
    [
        ("All done.", "complete"), ("Fertig!“", "complete"), ("再生が完了しました。", "complete"), ('[{"a": 1}]', "complete"), ('[{"a": "x.', "broken"), ("```sh\nls\n```", "complete"), ("See:\n```sh\nls", "broken"),
        ("Prices rose. [1]", "complete"), ("Prices rose.\n\n***", "complete"), ("Prices rose. 🙂", "complete"), ("The cost colu", "open"), ("To be contin�", "broken"), ("praise", "open"),
    ],
)
def test_endings(text, state):
    assert truncation.ending(text)[0] == state


def cuts(spark, texts):
    df = spark.createDataFrame([(i, s, t, "clash") for i, (s, t) in enumerate(texts)], "response_id long, source string, text string, chance string")
    facts = truncation.endings(df, "response_id", "source", "text")
    return {r.response_id: r for r in truncation.cut_records(facts, truncation.ending_contexts(df, "text", facts)).collect()}, df


def test_limits_contexts_and_report(spark):
    words = "the report lists all rows of the day and groups them by category for the team in the north".split()
    texts = []
    for k in range(160):
        body = " ".join(words[(k + j) % len(words)] for j in range(20 + k % 37))
        texts.append(("a", (body * 3)[:80]))  # a limit of 80
        texts.append(("b", body.capitalize() + f" {k}."))
    texts += [("b", f"{w} of the day.\n- rows without a target\n- mean of both sides") for w in ("List", "Table", "Sum", "Part", "Rest")]
    texts += [("b", None), ("b", ""), (None, "No source here."), ("b", "praise"), ("b", "long. " * 30_000)]
    got, df = cuts(spark, texts)
    assert sum(got[i].cut for i in range(0, 320, 2)) >= 155 and sum(got[i].cut for i in range(1, 320, 2)) == 0
    assert not any(got[i].cut for i in range(320, 325)) and 325 not in got and 326 not in got and not got[328].cut and not got[329].cut
    hazards = truncation.length_hazards(truncation.endings(df, "response_id", "source", "text")).where("significant").collect()
    assert {("a", "chars", 80), ("a", "bytes", 80)} <= {(h.source, h.unit, h.length) for h in hazards}
    facts = truncation.endings(df, "response_id", "source", "text")
    report = {r.source: r for r in truncation.source_report(df, "source", truncation.cut_records(facts, truncation.ending_contexts(df, "text", facts))).collect()}
    assert report["a"].records == 160 and report["a"].share > 0.95 and report["b"].cut == 0 and report[None].records == 1


def test_empty_table(spark):
    got, _ = cuts(spark, [("a", None)])
    assert got == {}
