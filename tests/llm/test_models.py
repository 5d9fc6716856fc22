"""Trained operators: accuracy on rows that were held out, and edge cases."""

import random
import zlib

import numpy as np
import pytest

from millrace.llm import common, language, quality, toxicity

from .conftest import WORDS, sentence


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    insults = ["vermin", "halfwit", "wretched"]
    rows, labels = [], []
    for i in range(900):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        words = sentence(rng, rng.randint(5, 120)).split()
        if toxic:
            for _ in range(1 + len(words) // 60):
                words[rng.randrange(len(words))] = rng.choice(insults)
        if bad:
            words = [w + rng.choice(["$$$", "###"]) for w in words]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(900, None, "en", "s", 0), (901, "", None, "s", 0), (902, "12 34 !!", "en", "s", 0), (903, "word " * 20000, "en", "s", 0)]
    labels += [(900, 1, 0), (1, None, None), (5, 1, 0), (None, 1, 1), (99999, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k: (q, t) for k, q, t in labels[:900]}


@pytest.mark.parametrize(("op", "column"), [(quality, 0), (toxicity, 1)])
def test_accuracy_on_held_out_rows(labelled, op, column):
    docs, labels, truth = labelled
    got = {r.doc_id: r for r in op.score(docs, op.train(docs, labels)).collect()}
    assert len(got) == 904 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == held(i) for i, r in got.items())
    out = [i for i in range(900) if held(i)]
    assert np.mean([got[i].predicted == truth[i][column] for i in out]) > 0.9
    assert all(r.predicted == (r.score >= (0.7, 0.3)[column]) for r in got.values())


@pytest.mark.parametrize("op", [quality, toxicity])
def test_without_labels_or_rows(spark, labelled, op, empty):
    docs, labels, _ = labelled
    none = op.score(docs, op.train(docs, labels.limit(0)))
    assert none.select("score").distinct().count() == 1
    assert op.score(empty, op.train(empty, labels)).count() == 0
    one = op.train(docs, spark.createDataFrame([(0, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int"))
    assert op.score(docs, one).first().score == 1.0


def test_good_rows_keep_their_columns(labelled):
    docs, labels, truth = labelled
    model = quality.train(docs, labels)
    kept = quality.select_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score(docs, model).collect() if r.predicted == 1}


def test_misspelt_insults_share_subwords():
    rng = random.Random(3)
    texts = [sentence(rng, 30) for _ in range(400)]
    y = np.array([float(k % 2) for k in range(400)])
    texts = [t.replace(" ", " worthless ", 1) if v else t for t, v in zip(texts, y)]
    m = toxicity.Model(texts, y)
    clean = "the of and to in is you that it he"
    assert m.score(clean, {}) < 0.3 < m.score(clean + " wortthless one", {})


def test_insults_late_in_unbroken_runs():
    rng = random.Random(5)
    han = ["".join(chr(0x4E00 + rng.randrange(300)) for _ in range(2)) for _ in range(20)]

    def unbroken(bad):
        t = [rng.choice(han) for _ in range(rng.randint(40, 120))]
        return "".join(t[:30] + ["\u7f75\u4eba\u8822\u8ca8"] * bad + t[30:])

    def joined(bad):
        w = sentence(rng, 30).split()
        return rng.choice(",/_").join(w[:20] + ["halfwit"] * bad + w[20:])

    for make in (unbroken, joined):
        y = np.array([float(k % 2) for k in range(800)])
        texts = [make(int(v)) for v in y]
        m = toxicity.Model(texts[:500], y[:500])
        assert np.mean([(m.score(t, {}) >= 0.3) == v for t, v in zip(texts[500:], y[500:])]) > 0.9


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 59, 60, 61, 80, 81, 1000])
def test_pieces_hold_the_whole_run(n):
    run = "".join(chr(0x4E00 + k) for k in range(n))
    pieces = toxicity.pieces(run)
    assert all(len(p) <= 40 for p in pieces) and {run[i : i + 5] for i in range(max(n - 4, 0))} == {p[i : i + 5] for p in pieces for i in range(len(p) - 4)}
    assert set(run) == set("".join(pieces))


LANGS = {"en": WORDS, "xx": "qua zup vok zur mip qual zupo voki".split(), "yy": "ñandu señor año niño mañana otoño".split()}


def test_languages(spark, empty):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        lang = rng.choice(list(LANGS))
        rows.append((i, " ".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(3, 40))), lang if i % 11 else None, lang))
    rows += [(600, None, "en", ""), (601, "", "en", ""), (602, "123 !? 漢", "en", ""), (603, "123 ...", "en", ""), (None, "the of", "en", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.train(docs, sample=100)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert len(got) == len(rows) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (600, 601, 603))
    assert got[602].lang_pred in LANGS and got[None].held_out
    assert np.mean([got[i].lang_pred == rows[i][3] for i in range(600) if held(i)]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, "漢字 漢字 漢字")], "doc_id long, text string")
    assert language.predict(odd, model, reject=True).first().lang_pred == "und"
    assert language.predict(empty, language.train(empty)).count() == 0
    assert language.predict(docs, language.train(empty)).filter("lang_pred <> 'und'").count() == 0


def test_every_language_gets_centroids(spark):
    rows = [(k, f"only{k % 410} words", f"l{k % 410}") for k in range(410 * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.train(docs, sample=20, centroids=1)
    assert set(model["langs"]) == {lang for k, _, lang in rows if not held(k)} and len(model["langs"]) > 400


def test_bounded_sample_is_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    a = {r.doc_id for r in common.bounded_sample(df, 500, "x").collect()}
    assert 400 < len(a) < 600 and a == {r.doc_id for r in common.bounded_sample(df.repartition(3), 500, "x").collect()}
