import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.llm import language as lg
from rankforge.llm.common import table

from .edges import ROWS, documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, SF, "documents")
    return lg.fit(docs.filter(~lg.held_out("doc_id")))


def test_held_out_accuracy(spark, model):
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "lang", lg.held_out("doc_id").alias("h"), lg.label(F.col("text"), model).alias("l")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    told = [r for r in rows if r.h]
    assert len(told) > 100
    assert np.mean([r.l.lang_pred == r.lang for r in told]) >= 0.97
    assert all(0 <= r.l.score <= 1 for r in rows)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    counts = np.array([0, 1, 6, 3, 0, 5])
    s = rng.normal(size=(counts.sum(), 3))
    got, at = lg.viterbi(s, counts, 1.1), 0
    for n in counts:
        part = s[at:at + n]
        worth = lambda p: sum(part[i, x] for i, x in enumerate(p)) - 1.1 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(itertools.product(range(3), repeat=int(n)), key=worth)
        assert tuple(got[at:at + n]) == best
        at += n


def test_mixed_text_gives_spans(spark, model):
    docs = table(spark, SF, "documents").filter("lang in ('de', 'en') and length(text) > 600")
    de, en = (docs.filter(F.col("lang") == x).orderBy("doc_id").first().text[:400] for x in ("de", "en"))
    df = spark.createDataFrame([(en + "\n" + de,)], "text string")
    got = df.select(lg.label(F.col("text"), model).alias("l")).first().l
    spans = [s for s in got.spans if s.stop - s.start > 40]
    assert [s.lang for s in spans] == ["en", "de"]
    assert abs(spans[1].start - 401) < 40
    assert 0.3 < got.score < 0.7


def test_scripts_narrow_the_languages(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("добрый день как дела", "ru"), ("good day how are you", "en")] * 5)]
    m = lg.fit(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    w = lg.words(["привет day"])
    s = lg.word_scores(w, m, 8.0)
    en, ru = m.langs.index("en"), m.langs.index("ru")
    assert s[0, en] == -16 and s[1, ru] == -16 and s[0, ru] == s[1, en] == 0


def test_edges(spark, model):
    got = documents(spark, clash=True).select("doc_id", "text", lg.label(F.col("text"), model).alias("l")).collect()
    assert len(got) == len(ROWS)
    for r in got:
        letters = sum(c.isalpha() for c in r.text or "")
        assert (r.l.lang_pred == "und") == (letters == 0)
        assert letters or (r.l.score == 0 and r.l.spans == [])
        for s in r.l.spans:
            assert r.text[s.start].isalpha() and r.text[s.stop - 1].isalpha()
    none = lg.fit(documents(spark, []))
    assert none.langs == []
    assert {r.lang_pred for r in lg.identify(documents(spark), none).collect()} == {"und"}
    assert lg.identify(documents(spark, []), model).count() == 0


def test_spoken_rejects_only_letterless_rows(spark, model):
    df = documents(spark, clash=True)
    for m in (model, lg.Model([], model.table, model.allowed)):
        out = lg.spoken(df, m)
        assert out.columns == df.columns
        assert out.count() == sum(any(c.isalpha() for c in r[1] or "") for r in ROWS)


def test_marks_make_no_word_and_lowering_keeps_places(spark, model):
    """A text of combining marks has no letter; one letter that lowers to two
    characters does not leave the rest of its text in capitals."""
    rows = [(1, "\u0301"), (2, "\u0301 \u0300\u0308 1"), (3, "e\u0301"), (4, None), (5, "")]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "k int, text string").select("k", lg.label(F.col("text"), model).alias("l")).collect()}
    assert [got[k].lang_pred for k in (1, 2, 4, 5)] == ["und"] * 4 and got[3].lang_pred != "und"
    assert got[1].score == got[2].score == 0 and got[1].spans == []
    w = lg.words(["\u0301 AB \u0300 cd", "\u0130 THE THE"])
    assert w.counts.tolist() == [2, 3] and w.start.tolist() == [2, 7, 0, 2, 6] and w.size.tolist() == [2, 2, 1, 3, 3]
    plain = lg.words(["i the the"])
    assert w.feature[w.first[3]:w.first[3] + 3].tolist() == plain.feature[plain.first[1]:plain.first[1] + 3].tolist()
    assert sorted(r.text for r in lg.spoken(spark.createDataFrame(rows, "k int, text string"), model).collect()) == ["e\u0301"]
