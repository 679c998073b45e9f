"""Words of a text, and what counts as one without letters."""

from tuneweave.llm import langid


def test_words_are_letters_and_their_marks():
    assert langid.text_words("Don't 2nd x_y") == ["don", "t", "nd", "x", "y"]
    assert langid.text_words("\u00bd \u00b2 \u2163 \u0661") == []
    assert langid.text_words("\u0939\u093f\u0928\u094d\u0926\u0940 \u0301 a\u0301b") == ["\u0939\u093f\u0928\u094d\u0926\u0940", "a\u0301b"]
    assert langid.text_words("Stra\u00dfe \u00c9T\u00c9 \u4e2d\u6587") == ["stra\u00dfe", "\u00e9t\u00e9", "\u4e2d\u6587"]


def test_texts_without_a_letter_are_und(spark):
    rows = [(i, "the river and the stone of the house", "en") for i in range(20)]
    rows += [(100 + i, "der Fluss und der Stein vor dem Haus", "de") for i in range(20)]
    odd = ["\u00bd \u00b2", "", None, " 123 _ ", "\u0301\u0302", "\u2163"]
    docs = spark.createDataFrame(rows + [(200 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in langid.identify(docs, F.col("doc_id") % 5 == 0).collect()}
    assert [got[200 + i].lang_pred for i in range(len(odd))] == ["und"] * len(odd)
    assert got[5].lang_pred == "en" and got[105].lang_pred == "de"
