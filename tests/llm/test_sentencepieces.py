"""Merge rounds against the installed library, which is an exact oracle."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tuneweave.llm import sentencepieces
from tuneweave.llm.sentencepieces import Pieces, decode, digests, encode, model_path

SCHEMA = "doc_id long, text string, ids string, decoded long, lang string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def texts(library):
    rnd = random.Random(7)
    names = [library.id_to_piece(i) for i in range(259, library.vocab_size())]
    letters = "abcdeinrst ABC  \n\t\u2581\u00e9\U0001F600\u4e2d\u6587.,-'\x00\u0438\u043daaaa"
    out = [None, "", " ", "   ", "\u2581", "\n", "\x00", "aaaaaaa", "<0x41></s><s><unk>", "\ufb01 A\u030a"]
    out += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(1_000)]
    out += ["".join(rnd.choice("abeinrst") for _ in range(rnd.randint(1, 300))) for _ in range(300)]
    out += ["".join(rnd.choice(names) for _ in range(rnd.randint(1, 12))) for _ in range(3_000)]
    out += [x * n for x in ("a", "ab", "ing", " ", "\u2581", "\n") for n in (2, 3, 15, 31, 200)]
    return out + ["the river of stones " * 20_000, "x" * 50_000]


def test_kernel_equals_library(library, texts):
    plain = [t or "" for t in texts]
    pieces = Pieces(model_path())
    import numpy as np

    got = [np.frombuffer(x, np.int32).tolist() for x in pieces.encode(plain)]
    assert got == library.encode(plain, num_threads=1)
    again = [np.frombuffer(x, np.int32).tolist() for x in pieces.encode(plain)]  # from the memo
    assert again == got


def test_decoding_any_ids(library):
    rnd = random.Random(3)
    pieces = Pieces.of(model_path())
    for _ in range(5_000):
        ids = [rnd.choice([rnd.randrange(32_000), rnd.randrange(3, 259), rnd.randrange(3)]) for _ in range(rnd.randint(0, 9))]
        assert pieces.decode(ids) == library.decode(ids), ids


def test_query_columns_and_edges(spark, library, texts):
    rows = [(i, t, "clash", 1, None) for i, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None), (5, texts[40], None, None, None), (5, texts[40], None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, digests(encode(docs, decoded=True)).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = decode(encode(docs)).filter("doc_id is not null").toPandas().drop_duplicates()
    for i, t in zip(back.doc_id, back.text):
        if i != 5:
            assert t == library.decode(library.encode(texts[i] or "")), i
    none = spark.createDataFrame([], SCHEMA)
    assert digests(encode(none, decoded=True)).collect() == []
    assert decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()[0].text is None


def test_small_slices(spark, library, texts, monkeypatch):
    monkeypatch.setattr(sentencepieces, "SLICE", 50)
    monkeypatch.setattr(sentencepieces, "WORDS", 20)
    pieces = Pieces(model_path())
    import numpy as np

    for t in texts[:400]:
        assert np.frombuffer(pieces.encode([t or ""])[0], np.int32).tolist() == library.encode(t or "")
