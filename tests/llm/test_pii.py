"""The pattern-identifier graph: what it finds, what it leaves, its scores recomputed."""

import math
from collections import defaultdict

import pytest

from tuneweave.llm import pii

SCHEMA = "doc_id long, text string"


def spans(spark, tmp_path, texts, name):
    path = str(tmp_path / name)
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3).write.parquet(path)
    return {r.doc_id: r.spans for r in pii.report(spark.read.parquet(path)).collect()}


@pytest.mark.parametrize("unseen", [10, 60, 300])
def test_all_unseen_are_found(spark, tmp_path, unseen):
    texts = [f"please call me at +1 (555) 123-{4000 + i} any time" for i in range(100)]
    texts += [f"please call me at 0301-55{i:04d} any time" for i in range(unseen)]
    got = spans(spark, tmp_path, texts, f"u{unseen}")
    assert all(got[i] == "phone:18:35" for i in range(100))
    assert all(got[100 + i] == "phone:18:29" for i in range(unseen))


def test_wrong_contexts_add_nothing(spark, tmp_path):
    # a context of two kinds, one with little evidence, and one far more often about other things
    texts = [f"see also a{i}@mail.example.org for more" for i in range(50)]
    texts += [f"see also 10.1.{i}.7 for more" for i in range(50)]
    texts += [f"see also 77001{i} for more" for i in range(20)]
    texts += [f"of the +1 (555) 321-{4000 + i} in it" for i in range(4)] + [f"of the 99120{i} in it" for i in range(9)]
    texts += [f"it was +1 (555) 456-{4000 + i} and so" for i in range(20)] + [f"it was 4410{i:04d} and so" for i in range(900)]
    got = spans(spark, tmp_path, texts, "wrong")
    for i, t in enumerate(texts):
        assert got[i] == pii.KINDS[0] + f":9:{t.index(' for')}" if "@" in t else got[i].split(":")[0] in ("", "ip", "phone")
        assert got[i] == "" or "@" in t or "+1" in t or "10.1." in t


def test_graph_scores_equal_plain_python(spark):
    rows = []
    for i in range(60):  # item, kind, patterns
        kind = (0 if i % 7 else 3) if i < 25 else -1
        rows.append((kind, i, [i % 3, 10 + i % 4, 20 + i % 11]))
    rows += [(0, 3, [1, 40]), (2, 3, [40]), (-1, 61, [0, 10]), (-1, 61, [0, 10])]
    edges = {(k, i, p) for k, i, ps in rows for p in ps}
    links = {(i, p) for _, i, p in edges}
    seeds = {(i, k) for k, i, _ in edges if k >= 0}
    items = defaultdict(set)
    for i, p in links:
        items[p].add(i)
    belief = {s: 1.0 for s in seeds}
    for _ in range(pii.ROUNDS):
        reliable = {}
        for p, of in items.items():
            by = defaultdict(list)
            for (i, k), b in belief.items():
                if i in of:
                    by[k].append(b)
            met, known = sum(map(len, by.values())), sum(map(sum, by.values()))
            for k, bs in by.items():
                e = sum(bs)
                against = max(len(of) - met, 0) * max(min(1.0, pii.DOUBT / e), pii.LEAST_DOUBT)
                if e >= pii.MIN_EVIDENCE and e / (known + against + 0.5) >= pii.MIN_RELIABLE:
                    reliable[p, k] = e / (known + against + 0.5)
        scores = defaultdict(dict)
        for i, p in links:
            if i not in {s for s, _ in seeds}:
                for (q, k), r in reliable.items():
                    if q == p:
                        scores[i][k] = scores[i].get(k, 1.0) * (1 - r)
        found = {}
        for i, of in scores.items():
            b, k = max((1 - x, -k) for k, x in of.items())
            if b >= pii.MIN_BELIEF:
                found[i, -k] = b
        belief = {s: 1.0 for s in seeds} | found
    seen = spark.createDataFrame(rows, "kind int, item long, patterns array<long>").repartition(3)
    patterns, got = pii.bootstrap(seen)
    assert {(r.pattern, r.kind): r.reliable for r in patterns.collect()} == pytest.approx(reliable)
    assert {(r.item, r.kind): r.belief for r in got.collect()} == pytest.approx(found)
    assert math.isfinite(sum(found.values()))


def test_overlaps_by_bisection():
    text = " ".join(f"x{i}@a.org 10.0.0.{i % 256} 12345{i}" for i in range(3_000))
    base = pii.base_spans(text)
    seen = pii.occurrences(text, base)
    taken = [(a, b) for a, _, b in base]
    other = [o for o in seen if o["kind"] < 0]
    assert len(other) == 3_000 and all(text[o["start"]:o["end"]].startswith("12345") for o in other)
    assert len(seen) == len(taken) + 3_000
