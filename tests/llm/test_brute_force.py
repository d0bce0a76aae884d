"""Sketches and leaks over the small tables against exact counts."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

from swaplens.llm import queries


def test_p2_bounds_hold_for_every_group_and_day(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir}/row_latencies.parquet").to_pandas()
    rows = rows.astype({"baseline_model": object})
    rows["baseline_model"] = rows["baseline_model"].where(rows["baseline_model"].notna(), None)
    values = defaultdict(list)
    for a, b, d, v in zip(rows["baseline_model"], rows["target_model"], rows["run_day"], rows["baseline_latency_s"], strict=True):
        for day in (d, None):
            values[a, b, day].append(v)
    got = {(r.baseline_model, r.target_model, r.run_day): r for r in queries.p2_percentiles(spark, sf_dir).collect()}
    assert got.keys() == values.keys()
    for key, raw in values.items():
        known = np.sort([v for v in raw if v is not None and v == v])
        r = got[key]
        assert (r.n, r.nulls) == (len(known), len(raw) - len(known))
        for p in (50, 90, 95, 99) if len(known) else ():
            true = known[-(-p * len(known) // 100) - 1]
            assert r[f"p{p}_low"] <= true <= r[f"p{p}_high"]
            assert abs(np.searchsorted(known, r[f"p{p}"], "right") - np.searchsorted(known, true, "right")) <= max(r[f"p{p}_rank_error"], 0)


def test_p9_finds_every_long_verbatim_passage(spark, sf_dir):
    words = lambda t: re.findall(r"[^\W_]+", re.sub(r"<[^>]+>", " ", t or "").lower())
    items = {r["item_id"]: words(r["text"]) for r in pq.read_table(f"{sf_dir}/eval_items.parquet").to_pylist()}
    grams = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 19):
            grams[tuple(w[k : k + 20])].add(i)
    want = set()
    for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        w = words(r["text"])
        want |= {(r["doc_id"], i) for k in range(len(w) - 19) for i in grams.get(tuple(w[k : k + 20]), ())}
    got = {(r.doc_id, r.item_id) for r in queries.p9_found(spark, sf_dir).collect()}
    assert want <= got and len(want) > 0
    shared = Counter(d for d, _ in got)
    assert max(shared.values()) < 20


def test_p8_ids_are_those_of_the_library(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    want = dict(zip(texts, (e.ids for e in reference.encode_batch(list(texts.values()), add_special_tokens=False)), strict=True))
    assert {r.doc_id: list(r.ids) for r in queries.p8_ids(spark, sf_dir).collect()} == want
