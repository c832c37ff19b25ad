"""Quality and toxicity: held-out accuracy, and defined results on awkward rows."""

import math
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest

import veclens.llm as llm
from veclens.llm import nbsvm, toxicity
from veclens.llm.texts import flat

BIG = "/root/testdata/sf0.01"


def held_out(spark, name, label, folds, fold, sf_dir=BIG):
    got = llm.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert got.score.between(0, 1).all()
    own = np.array([zlib.crc32(str(i).encode()) % folds == fold for i in got.doc_id])
    assert (got.held_out == own).all()
    joined = got.merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    return joined[joined.held_out], joined.held_out.sum(), label


def test_quality_on_held_out_rows(spark):
    rows, n, _ = held_out(spark, "op7_nbsvm", "quality", 5, 0)
    assert n > 50
    assert (rows.predicted == (rows.score >= 0.3)).all()
    assert ((rows.predicted == 1) == (rows.quality == 1)).mean() > 0.95


def test_toxicity_on_held_out_rows(spark):
    rows, n, _ = held_out(spark, "op5_toxicity", "toxic", 3, 1)
    assert n > 80
    assert (rows.predicted == (rows.score >= 0.7)).all()
    assert ((rows.predicted == 1) == (rows.toxic == 1)).mean() > 0.93
    assert (rows.predicted[rows.toxic == 0] == 1).mean() < 0.05


def test_scores_do_not_depend_on_other_columns_or_partitions(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    model = nbsvm.fit_quality(docs, nbsvm.train_labels(spark, BIG))
    again = nbsvm.fit_quality(docs.repartition(5), nbsvm.train_labels(spark, BIG))
    assert (model.weights == again.weights).all() and model.slope == again.slope
    awkward = brute.awkward(spark)
    got = nbsvm.score_quality(awkward, model).collect()
    assert len(got) == len(brute.awkward_rows()) and all(0 <= row.score <= 1 for row in got)
    assert nbsvm.score_quality(brute.empty(spark), model).count() == 0
    assert nbsvm.keep_good(brute.empty(spark), model, 0.3).count() == 0
    kept = nbsvm.keep_good(awkward, model, 0.0)
    assert kept.columns == awkward.columns and kept.count() == len(brute.awkward_rows())


def test_fitting_without_labels(spark):
    labels = spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    model = nbsvm.fit_quality(brute.awkward(spark), labels)
    assert {row.score for row in nbsvm.score_quality(brute.awkward(spark), model).collect()} == {0.5}
    lexicon = toxicity.learn_lexicon(brute.awkward(spark), labels)
    got = toxicity.score_toxicity(brute.awkward(spark), lexicon).collect()
    assert lexicon.terms == {} and len(got) == len(brute.awkward_rows()) and all(row.score < 0.5 for row in got)
    assert toxicity.score_toxicity(brute.empty(spark), lexicon).count() == 0


def test_features_do_not_cross_rows():
    texts = ["One two three.", "", "One two three.", "three. One", None]
    rows = nbsvm.gram_features(*flat(pa.array(texts)))
    assert rows[0].tolist() == rows[2].tolist() and len(rows[1]) == len(rows[4]) == 0
    alone = nbsvm.gram_features(*flat(pa.array(["three. One"])))[0]
    assert rows[3].tolist() == alone.tolist()


MASK = 2**64 - 1


def mixed_by_hand(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & MASK
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & MASK
    return x ^ x >> 33


def word_by_hand(word):
    odd = 0x9E3779B97F4A7C15
    total = sum(mixed_by_hand((byte + 1) * odd & MASK) * pow(odd, i, 1 << 64) for i, byte in enumerate(word))
    return mixed_by_hand(total + len(word) * odd & MASK)


def shape_by_hand(word, before):
    ups = sum(65 <= byte <= 90 for byte in word)
    lows = sum(97 <= byte <= 122 or byte >= 128 for byte in word)
    case = 0 if not ups + lows else 1 if not ups else 2 if ups == 1 and 65 <= word[0] <= 90 else 3 if not lows else 4
    last = chr(word[-1])
    ending = 1 if last in "0123456789" else nbsvm.ENDINGS.index(last) + 2 if last in nbsvm.ENDINGS else 0
    size = sum(len(word) >= least for least in (2, 4, 8, 16))
    return ((case * 32 + ending) * 5 + size) * 2 + (word == before)


def score_by_hand(model, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    names = [word_by_hand(bytes(b + 32 if 65 <= b <= 90 else b for b in word)) for word in words]
    shapes = [shape_by_hand(word, before) for word, before in zip(words, [None, *words], strict=False)]
    found = set()
    for kind, numbers in enumerate((names, shapes)):
        for i in range(len(numbers)):
            rolled = 0
            for n, number in enumerate(numbers[i : i + 3]):
                rolled = mixed_by_hand(rolled + number + 1 + 3 * kind + n & MASK)
                found.add(rolled % nbsvm.FEATURES)
    margin = sum(model.weights[i] for i in sorted(found)) / math.sqrt(max(len(found), 1)) + model.bias
    return 1 / (1 + math.exp(-(model.slope * margin + model.shift)))


def test_quality_scores_equal_a_plain_scorer(spark, sf_dir):
    """Every row of a table, and awkward rows, under the fitted model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = nbsvm.fit_quality(docs, nbsvm.train_labels(spark, sf_dir))
    assert np.count_nonzero(model.weights) > 1000
    for frame in (docs, brute.awkward(spark).select("doc_id", "text")):
        expected = sorted((repr(row.doc_id), round(score_by_hand(model, row.text), 9)) for row in frame.collect())
        got = sorted((repr(row.doc_id), round(row.score, 9)) for row in nbsvm.score_quality(frame, model).collect())
        assert [row[0] for row in got] == [row[0] for row in expected]
        assert [row[1] for row in got] == pytest.approx([row[1] for row in expected], abs=1e-8)


def test_words_alone_tell_texts_apart(spark):
    """Two vocabularies with the same shapes, which shapes alone cannot part; and a bound on n-grams takes fewer rows."""
    rng = np.random.default_rng(5)
    vocabulary = [["abcd", "efgh", "ijkl", "mnop"], ["dcba", "hgfe", "lkji", "ponm"]]
    rows = [(i, " ".join(rng.choice(vocabulary[i % 2], 12))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id bigint, quality int")
    for bound in (nbsvm.FIT_GRAMS, 1500):
        model = nbsvm.fit_quality(docs, labels, grams=bound)
        scores = {row.doc_id: row.score for row in nbsvm.score_quality(docs, model).collect()}
        assert all((scores[i] > 0.5) == (i % 2 == 1) for i in range(100, 200))


def test_driver_gets_no_ngrams(spark, monkeypatch):
    """What the fit brings to the driver is a few numbers a row and the model, however long the texts are."""
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, " ".join(map(str, rng.integers(0, 50 + i % 2, 2000)))) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    fetched, frame = [], type(docs)
    to_arrow = frame.toArrow

    def noted(df):
        fetched.append(to_arrow(df))
        return fetched[-1]

    monkeypatch.setattr(frame, "toArrow", noted)
    model = nbsvm.fit_quality(docs, labels)
    assert sum(table.nbytes for table in fetched) < 40 * 100
    assert model.weights.any() and len(model.weights) == nbsvm.FEATURES


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(2)
    rows, target = [], []
    for i in range(300):
        y = 1 if i % 2 else -1
        rows.append(np.unique(np.concatenate([rng.integers(0, 50, 6), [50 if y > 0 else 51]])))
        target.append(y)
    values = [np.ones(len(row)) for row in rows]
    weights = nbsvm.dual_coordinate_descent(rows, values, np.array(target, float), 52)
    margin = np.array([weights[row].sum() + weights[-1] for row in rows])
    assert (np.sign(margin) == target).all()
    # the hinge-loss optimum: no small step in any direction lowers the objective
    def objective(w):
        m = np.array([w[row].sum() + w[-1] for row in rows])
        return 0.5 * w @ w + np.maximum(0, 1 - np.array(target) * m).sum()

    best = objective(weights)
    assert all(objective(weights + 0.02 * rng.normal(size=len(weights))) > best - 1e-2 for _ in range(50))


@pytest.mark.parametrize("text", ["you 1D10T", "an іdіоt!", "ｉｄｉｏｔ", "id​iot", "IDIOTS"])
def test_lookalikes_are_found(text):
    lexicon = toxicity.Lexicon({"idiot": 5.0}, curve=(-3.0, 2.0, 0.5))
    automaton = lexicon.automaton()
    assert lexicon.features(text, automaton)[0] > 0
    assert lexicon.features("videotape patriot", automaton) == (0.0, 0.0)


def test_exception_phrases_spare_a_term():
    lexicon = toxicity.Lexicon({"trash": 5.0}, exceptions=["trash can"])
    automaton = lexicon.automaton()
    assert lexicon.features("the trash can here", automaton) == (0.0, 0.0)
    assert lexicon.features("the trash can and trash", automaton)[0] > 0
    assert lexicon.features("trash talk", automaton)[0] > 0


def test_longer_texts_score_lower():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, curve=(-3.0, 0.5, 1.0))
    automaton = lexicon.automaton()
    short, long = (np.array([lexicon.features("idiot " + "word " * n, automaton)]) for n in (5, 5000))
    assert lexicon.score(short)[0] > lexicon.score(long)[0]


def plain_score(lexicon, text):
    """The score of one text by looking at every word and every phrase, without an automaton."""
    import unicodedata

    table = toxicity.HOMOGLYPHS | toxicity.DIGITS
    text = unicodedata.normalize("NFKC", text or "").lower()
    text = "".join("" if c in toxicity.INVISIBLE else " " if c in toxicity.SEPARATORS else table.get(c, c) for c in text)
    words = text.split()
    spared = set()
    for phrase in lexicon.exceptions:
        own = phrase.split(" ")
        spared |= {(i, i + len(own)) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own}
    total = 0.0
    for i, word in enumerate(words):
        fitting = [t for t in lexicon.terms if (t[:-1] == word if t.endswith(" ") else word.startswith(t))]
        if fitting and not any(a <= i < b for a, b in spared):
            total += lexicon.terms[max(fitting, key=len)]
    bias, one, share = lexicon.curve
    per_word = np.log1p(100 * total / max(len(words), 1)) if total else 0.0
    return 1 / (1 + np.exp(-(bias + one * np.log1p(total) + share * per_word)))


def test_toxicity_equals_a_plain_scorer(spark):
    """All rows of the table and the awkward rows, under a learned lexicon and under one with short words and phrases."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet").where(nbsvm.id_fold(3) != 1)
    learned = toxicity.learn_lexicon(docs, labels)
    assert learned.terms
    made = toxicity.Lexicon(
        {"one ": 1.0, "chang": 2.0, "tail": 0.5, "line ": 0.7, "zzzz": 1.5}, ["one two", "line a", "x one"], (-1.0, 0.6, 0.2)
    )
    for lexicon, frame in ((learned, docs), (learned, brute.awkward(spark)), (made, brute.awkward(spark))):
        rows = [(row.doc_id, row.text) for row in frame.select("doc_id", "text").collect()]
        expected = sorted(((i, plain_score(lexicon, text)) for i, text in rows), key=repr)
        got = sorted(((row.doc_id, row.score) for row in toxicity.score_toxicity(frame, lexicon).collect()), key=repr)
        assert [i for i, _ in got] == [i for i, _ in expected]
        assert sorted(s for _, s in got) == pytest.approx(sorted(s for _, s in expected))


def test_terms_are_chosen_over_all_candidates(spark):
    """Short words and rare terms are found beside any number of ordinary words; exception phrases of any length."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        words = [f"word{j}x" for j in rng.integers(0, 6000, 60)]
        if i % 4 == 0:
            words[5:5] = ["ugh"] if i % 8 else ["b4dlyquitelongword" + "o" * 200, "vile"]
        elif i % 4 == 1:
            words[5:5] = ["k" * 90, "vile"]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    lexicon = toxicity.learn_lexicon(docs, labels)
    assert "ugh " in lexicon.terms
    assert any("badiyquiteiongword".startswith(term.rstrip()) for term in lexicon.terms)
    assert "vile" not in lexicon.terms  # as frequent in clean rows
