"""NRA search against exhaustive scoring in plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from tuneweave.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, lang string, item_id long, rid string, level int, n_chars long"
ITEMS = "item_id long, text string, rid long, term string"


def cut(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    words = [(d, Counter(cut(t)), len(cut(t))) for d, t, *_ in docs]
    words = [x for x in words if x[2]]
    total, n_docs = sum(x[2] for x in words), len(words)
    df = Counter(t for _, c, _ in words for t in c)
    out = []
    for item, text, *_ in items:
        scores = []
        for d, c, n in words:
            m = 75 + (25 * n * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(cut(text)).items() if t in c)
            if s:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    vocabulary = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(400)]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 80)))) for i in range(300)]
    docs += [(i, docs[7][1]) for i in range(300, 360)]  # more copies than ranks
    docs += [(8, docs[8][1]), (8, docs[8][1]), (None, docs[9][1]), (None, "w1 w2 only"), (400, None), (401, ""), (402, " .,;\n"),
             (403, "É w1 W1-w2_W3 \U0001F600w1"), (404, "w1 " * 50_000 + "w2 rare"), (405, "x" * 30_000)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 30)))) for i in range(12)]
    items += [(20, docs[7][1]), (20, docs[7][1]), (None, "w1 w1 w2"), (21, None), (22, ""), (23, "nowhere to be found"),
              (24, "RARE"), (25, "É W1 \U0001F600w1")]
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, "en", 1, "x", 2, 3) for r in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(*r, 1, "x") for r in items], ITEMS).repartition(2)
    return sorted(map(tuple, ranked.search(d, q).collect()), key=str)


def test_search_equals_exhaustive_scoring(spark, rows):
    assert run(spark, *rows) == brute(*rows)


def test_depth_of_rounds_does_not_change_results(spark, rows, monkeypatch):
    docs, items = rows[0][:120], rows[1][:5]
    monkeypatch.setattr(ranked, "OPEN", 0.95)
    monkeypatch.setattr(ranked, "CLOSED", 0.9)
    assert run(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(ranked, "LAST", 2.0)  # all lists in one round
    assert run(spark, docs, items) == brute(docs, items)


def test_bounds_hold_in_every_round(spark, rows, monkeypatch):
    """Lower bounds never exceed a score, upper bounds never fall short of it, and no
    document of the answer is dropped."""
    docs, items = rows
    answer = {}
    for item, _, d, s in brute(docs, items, 10 ** 6):
        answer.setdefault(item, {})[d] = s
    seen = []
    read = ranked._read

    def watched(index, plan, state, *rest):
        out = ranked.materialize(read(index, plan, state, *rest), "watched")
        ids = index.items.join(plan.select("iid", "rest"), "iid")
        seen.append([tuple(r) for r in out.join(index.docs, "rid").join(ids, "iid")
                     .select("item_id", "doc_id", "lower", "rest").collect()])
        return out

    monkeypatch.setattr(ranked, "_read", watched)
    final = run(spark, docs, items)
    assert len(seen) > 1
    unique = {d for d, *_ in docs if sum(1 for e, *_ in docs if e == d) == 1}
    for rows_ in seen:
        for item, d, lower, rest in rows_:
            if d in unique and item != 20:
                assert lower <= answer[item][d] <= lower + rest
        kept = {(item, d) for item, d, *_ in rows_}
    assert {(item, d) for item, _, d, _ in final} <= kept


def test_empty_tables(spark, rows):
    assert run(spark, [], rows[1]) == []
    assert run(spark, rows[0][:5], []) == []
    assert run(spark, [(1, None), (2, " ")], rows[1]) == []
