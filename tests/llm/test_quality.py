import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import quality
from tests.llm.tables import rows, table, words


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])


def test_held_out(spark):
    r = random.Random(9)
    docs, labels = [], []
    for k in range(600):
        good = r.random() < 0.7
        text = words(r, r.randint(20, 120))
        docs.append((k, text if good else r.choice((text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join(w for w in text.split()[:5] for _ in range(20))))))
        labels.append((k, int(good), 0))
    found = quality.classify(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {d: y for d, y, _ in labels}
    held = [(x["score"], truth[x["doc_id"]]) for x in found if x["held_out"]]
    assert len(found) == 600 and {x["doc_id"] for x in found if x["held_out"]} == {d for d, _ in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert auc(held) > 0.97 and np.mean([(s >= 0.7) == y for s, y in held]) > 0.93
    assert all(0 <= x["score"] <= 1 for x in found)


def test_held_out_labels_teach_nothing(spark):
    docs = [(k, words(random.Random(k), 30 + k)) for k in range(80)]
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    scores = []
    for wrong in (0, 1):
        labels = [(k, (k % 2) ^ (wrong and held(k)), None) for k in range(80)]
        scores.append(sorted((x["doc_id"], x["score"]) for x in quality.classify(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()))
    assert scores[0] == scores[1]


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (40, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    found = quality.classify(table(spark, rows()), labels).collect()
    assert len(found) == len(rows()) and all(0 <= x["score"] <= 1 for x in found)
    assert {x["score"] for x in quality.classify(table(spark, rows()), labels.filter(F.lit(False))).collect()} == {0.5}
    assert quality.classify(table(spark, []), labels).collect() == []


def test_against_a_direct_fit(spark):
    """Every score against a ridge fit by least squares on all labelled rows at once and an isotonic curve by its min-max formula."""
    r = random.Random(14)
    docs = [(k, words(r, r.randint(5, 90)) if k % 3 else " | ".join(words(r, 4) for _ in range(r.randint(2, 20)))) for k in range(240)] + [(500, None), (501, "")]
    labels = [(k, int(k % 3 > 0) ^ (r.random() < 0.1), 0) for k in range(240)]
    found = {x["doc_id"]: x["score"] for x in quality.classify(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), components=32).collect()}
    x = quality.statistics([(t or "").encode() for _, t in docs]).astype(np.float32).astype(float)
    y = {d: q for d, q, _ in labels}
    teach = [k for k, (d, _) in enumerate(docs) if d in y and zlib.crc32(str(d).encode()) % 4 != 2]
    project = quality.Projection(x[teach].mean(0), x[teach].std(0), 32, quality.GAMMA, quality.SEED)
    z, target = project(x), np.array([float(y[docs[k][0]]) for k in teach])
    augmented = np.vstack([z[teach], np.sqrt(quality.RIDGE) * np.eye(z.shape[1])])
    weights = np.linalg.lstsq(augmented, np.concatenate([target, np.zeros(z.shape[1])]), rcond=None)[0]
    raw = np.clip((z @ weights - quality.LOW) / (quality.HIGH - quality.LOW), 0, 1)
    at = np.minimum((raw[teach] * quality.BINS).astype(int), quality.BINS - 1)
    bins = np.unique(at)
    n, good = np.array([(at == b).sum() for b in bins]), np.array([target[at == b].sum() for b in bins])
    level = [max(min(good[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(bins))) for a in range(i + 1)) for i in range(len(bins))]
    knots, values = [], []
    for v in sorted(set(np.round(level, 12))):
        own = np.round(level, 12) == v
        knots.append(((bins[own] + 0.5) / quality.BINS * n[own]).sum() / n[own].sum())
        values.append(v)
    expected = np.interp(raw, knots, values) * 0.999 + raw * 0.001
    assert max(abs(found[d] - e) for (d, _), e in zip(docs, expected, strict=True)) < 1e-6


def test_isotonic():
    knots, values = quality.isotonic(np.arange(6.0), np.array([2.0, 2, 2, 2, 2, 2]), np.array([0.0, 2, 0, 1, 2, 2]))
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()


def test_statistics_of_one_text_do_not_depend_on_others():
    texts = [(t or "").encode() for _, t in rows()]
    assert np.allclose(quality.statistics(texts), np.vstack([quality.statistics([t]) for t in texts]))
