import random

import numpy as np

from loomline.llm.subjects import Rows, mixtures, sentences, subject_areas, updated

TOPICS = {"law": "court judge appeal verdict clause lawyer trial jury statute brief", "music": "violin chord encore singer rhythm score drum tune melody choir", "food": "dough oven spice broth menu recipe pastry whisk caramel soup"}
SMALL_TALK = ["good morning everybody", "we can pick this up later", "let me share that in a second"]


def corpus(n, seed):
    rnd = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        subjects = rnd.sample(list(TOPICS), rnd.choice([0, 1, 1, 2]))
        ss = [rnd.choice(SMALL_TALK) for _ in range(3)]
        for s in subjects:
            ss += ["The {} was about the {} and then the {}".format(*rnd.sample(TOPICS[s].split(), 3)) for _ in range(6)]
        if len(subjects) == 1 and rnd.random() < 0.5:
            other = rnd.choice([s for s in TOPICS if s not in subjects])
            ss.append("A {} beside the {}".format(*rnd.sample(TOPICS[other].split(), 2)))
        rnd.shuffle(ss)
        docs.append((i, ". ".join(ss) + ".", "x"))
        truth[i] = set(subjects)
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus(600, 1)
    labels = [(i, a, s) for i in range(0, 600, 6) for s in truth[i] for a in ("a1", "a2")] + [(0, "a3", "food"), (7, "a1", "nonsense"), (None, None, None)]
    d = spark.createDataFrame([*docs, (9001, None, ""), (9002, "", ""), (9003, "12 !!", "")], "doc_id bigint, text string, share string")
    la = spark.createDataFrame(labels, "doc_id bigint, annotator string, subject string")
    su = spark.createDataFrame([(s, s) for s in TOPICS] + [(None, "x")], "subject string, description string")
    got = {}
    for r in subject_areas(d, la, su).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in truth if i % 6]
    assert sum(got.get(i, set()) == truth[i] for i in held) / len(held) > 0.95
    assert not {9001, 9002, 9003} & set(got)
    assert subject_areas(d.limit(0), la, su).count() == subject_areas(d, la, su.limit(0)).count() == 0
    assert subject_areas(d.limit(30), la.limit(0), su).count() >= 0


def test_updates_reduce_the_error():
    rnd = np.random.default_rng(0)
    w, h = rnd.random((40, 3)), rnd.random((3, 2000)) * (rnd.random((3, 2000)) < 0.05)
    dense = w @ h
    row, col = np.nonzero(dense)
    x = Rows(col, dense[row, col], np.cumsum(np.bincount(row, minlength=40)))
    assert np.allclose(x.dot(h.T), dense @ h.T) and np.allclose(x.product(w, 2000), dense.T @ w)
    ht = np.zeros((1 << 15, 3))
    ht[:2000] = h.T
    got = mixtures(x, ht)
    assert np.linalg.norm(dense - got @ h) < 0.15 * np.linalg.norm(dense)


def test_alternating_updates_converge():
    rnd = np.random.default_rng(1)
    w, h = rnd.random((60, 3)), rnd.random((3, 500)) * (rnd.random((3, 500)) < 0.3)
    x = w @ h
    row, col = np.nonzero(x)
    rows = Rows(col, x[row, col], np.cumsum(np.bincount(row, minlength=60)))
    ht, errors = rnd.random((500, 3)), []
    for _ in range(30):
        got = mixtures(rows, ht)
        errors.append(np.linalg.norm(x - got @ ht.T))
        ht = updated(ht, rows.product(got, 500), got.T @ got)
    assert errors[-1] < 0.05 * errors[0] and ht.min() >= 0


def test_more_subjects_than_usual(spark):
    subjects = [a + b + "ra" for a in ("ka", "lo", "mi", "su", "ve", "do", "ni", "pa", "ge") for b in ("ran", "tel", "vor", "dix", "bus", "hem", "jol", "quy", "wos", "fap")]
    docs = [(i, " ".join(f"The {s}word beside the {s}thing." for _ in range(4)), s) for i in range(450) for s in [subjects[i % 90]]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, own string")
    la = spark.createDataFrame([(i, "a", s) for i, _, s in docs[:180]], "doc_id bigint, annotator string, subject string")
    su = spark.createDataFrame([(s, s) for s in subjects], "subject string, description string")
    got = {(r.doc_id, r.subject) for r in subject_areas(d, la, su).collect()}
    assert len(got & {(i, s) for i, _, s in docs}) > 0.95 * 450 and len(got) < 1.05 * 450


def test_sentences():
    assert [" ".join(s) for s in sentences("# Title\n\n[00:00:01] Speaker 1: One two. Three four!\nA: five six")] == ["one two", "three four", "five six"]
    assert 7 <= len(sentences("word " * 100)) <= 8 and sentences("") == [] and sentences("**Speaker 1** · 00:07\nhi there") == [["hi", "there"]]
