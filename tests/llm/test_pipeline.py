"""The corpus pipeline stage by stage against plain versions, on the smallest tables."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from lorebase.llm import near_dup, queries, secret_scan, toxicity
from lorebase.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plain_mix(rows):
    """(doc_id, size, source_size, target, taken) by a loop over each source in key order."""
    sizes = [(i, s, len((t or "").encode().split())) for i, s, t in rows]
    total = Counter()
    for _, s, n in sizes:
        total[s] += n
    weight = dict(zip(sorted(total, key=lambda s: (s is None, s or "")), itertools.cycle((5, 2, 1))))
    target, open_, left = {}, set(total), float(sum(total.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in above} if above else share
        left -= sum(3.0 * total[s] for s in above)
        open_ = open_ - above if above else set()
    out = []
    for s in total:
        budget = round(target[s])
        epochs, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        for _, i, n in sorted((hashlib.md5(str("" if i is None else i).encode()).hexdigest(), i, n) for i, own, n in sizes if own == s):
            out.append((i, s, n, total[s], epochs * n + max(0, min(n, rest))))
            rest -= n
    return out, target


def run_stages(spark, docs, sf, folder):
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        held[name] = (docs, docs := spark.read.parquet(f"{folder}/{name}"))
    return held


def test_stages(spark, tmp_path):
    held = run_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF, tmp_path)
    before, after = ({x.doc_id: x for x in d.collect()} for d in held["toxicity"])
    net = toxicity.train_toxicity(held["toxicity"][0], spark.read.parquet(f"{SF}/labels.parquet"), ~queries.held_out(5, 0))
    score = net.score(pa.array([x.text for x in before.values()]), net.fold())
    assert after == {i: x for (i, x), p in zip(before.items(), score, strict=True) if p < 0.5} and len(after) > 0.5 * len(before)
    before, after = ({x.doc_id: x for x in d.collect()} for d in held["near_dedup"])
    kept = {x.doc_id for x in near_dup.near_duplicates(held["near_dedup"][0], words=5).collect() if x.kept}
    assert set(after) == kept and set(after) < set(before)
    before, after = ({x.doc_id: x.text for x in d.collect()} for d in held["decontamination"])
    items = [x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(before) - set(after) == {i for i, t in before.items() if any(x in (t or "") for x in items)}
    before, after = ({x.doc_id: x.text for x in d.collect()} for d in held["secrets"])
    assert after == {i: secret_scan.redact(t, secret_scan.find_spans(t)[1]) if t else t for i, t in before.items()}
    assert not any(secret_scan.find_spans(t)[0] for t in after.values())
    docs, mixed = (d.collect() for d in held["mixing"])
    want, target = plain_mix([(x.doc_id, x.source, x.text) for x in docs])
    assert sorted((x.doc_id, x.source, x.size, x.source_size, x.taken) for x in mixed) == sorted(w for w in want if w[4] > 0 or w[2] == 0)
    assert all(abs(x.target - target[x.source]) < 1e-6 for x in mixed)


def test_odd_rows_go_through(spark, tmp_path):
    """Null, empty, long, repeated and nameless rows, columns that clash, an empty table."""
    r = random.Random(31)
    words = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    long, twice = words(60_000), words(90)
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, twice), (5, twice), (6, twice), (7, twice + " end"), (None, twice), (None, None), (8, "token = abcdef123456"), (9, words(20)), (9, words(30)), (10, "\u00e9\U0001f600")]
    schema = "score string, predicted string, doc_id long, text string, source string, size string, taken long, node string, n_chars int, component_id string"
    docs = spark.createDataFrame([("s", "p", i, t, "a" if k % 3 else None, "z", 1, "n", 7, "c") for k, (i, t) in enumerate(rows)], schema)
    spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "in/labels.parquet"))
    spark.createDataFrame([(1, words(12)), (2, None), (3, ""), (None, twice)], "item_id long, text string").write.parquet(str(tmp_path / "in/benchmark.parquet"))
    held = run_stages(spark, docs.where("doc_id <> 4 or doc_id is null").union(docs.where("doc_id = 4")), str(tmp_path / "in"), tmp_path)
    for name in ("near_dedup", "decontamination", "secrets"):
        first, last = (d.collect() for d in held[name])
        assert all(x.score == "s" and x.predicted == "p" and x.size == "z" and x.node == "n" for x in last)
        if name == "near_dedup":
            before, after = (Counter((x.doc_id, x.text) for x in d) for d in (first, last))
            assert not after - before and not {6, 7} & {i for i, _ in after}
            assert all(after[k] == before[k] for k in before if k[0] not in (6, 7))
        else:
            assert len(first) == len(last)
    assert not any("abcdef123456" in (x.text or "") for x in held["secrets"][1].collect())
    mixed = held["mixing"][1].collect()
    assert len({x.doc_id for x in mixed}) >= 1 and all(0 <= x.taken <= 3 * x.size for x in mixed)
    for name, (_, out) in run_stages(spark, docs.where("false"), str(tmp_path / "in"), tmp_path / "none").items():
        assert out.count() == 0, name


def test_run_leaves_one_table(spark):
    """The tables of stages that are done go: only what the last stage reads is left."""
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, SF)
    left = {n.rpartition("-")[0] for n in set(os.listdir(folder)) - before}
    assert left <= {"secrets", "sizes"} and rows.count() > 0


def test_run_is_repeatable(spark):
    first, second = (sorted(map(repr, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert first == second


def test_all_queries_are_listed():
    import __spark_entry__

    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{n}" for n in range(1, 11)} and set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
