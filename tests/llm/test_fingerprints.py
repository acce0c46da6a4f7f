import random
from collections import Counter, defaultdict

import numpy as np

from millrace.llm import fingerprints as fp
from tests.llm.tables import rows, table, words


def test_peeling_recovers_the_difference():
    r = random.Random(2)
    pool = np.random.default_rng(1).integers(1, 2**63, 4000, np.uint64)
    for cells in (6, 24):
        a, b = [], []
        for _ in range(40):
            common = r.sample(range(4000), r.randint(0, 300))
            rest = [k for k in r.sample(range(4000), r.randint(0, 200)) if k not in common]
            cut = r.randint(0, len(rest))
            a.append(common + rest[:cut])
            b.append(common + rest[cut:])
        flat = [(pool[[k for s in x for k in s]], np.concatenate([[0], np.cumsum([len(s) for s in x])])) for x in (a, b)]
        of, digest, sign = fp.differences(*flat, cells=cells)
        found = defaultdict(set)
        for k, d, s in zip(of.tolist(), digest.tolist(), sign.tolist(), strict=True):
            found[k, s].add(d)
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            assert found[k, 1] == set(pool[list(set(x) - set(y))].tolist()) and found[k, -1] == set(pool[list(set(y) - set(x))].tolist())


def test_without_tries_the_exact_difference_is_taken():
    r = np.random.default_rng(0).integers(1, 2**63, 200, np.uint64)
    a, b = (r[:150], np.array([0, 150])), (r[50:], np.array([0, 150]))
    assert fp.likeness(a, b)[0] == 0.5
    of, _, sign = fp.differences(a, b, cells=6, tries=1)
    assert Counter(sign.tolist()) == {1: 50, -1: 50} and set(of.tolist()) == {0}


def test_fingerprint(spark):
    docs = rows()
    found = fp.fingerprint(table(spark, docs), parts=3).collect()
    order = sorted(((d, t or "") for d, t in docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    expected = Counter()
    for k, (d, t) in enumerate(order):
        expected[d, len(t), fp.edited(t, order[(k + 1) % len(order)][1])] += 1
    assert Counter((x["doc_id"], x["n_chars"], x["edited"]) for x in found) == expected
    texts = defaultdict(set)
    for d, t in docs:
        texts[d].add(t or "")
    prints = defaultdict(set)
    for x in found:
        assert 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
        if len(texts[x["doc_id"]]) == 1:
            prints[next(iter(texts[x["doc_id"]]))].add(x["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len(set.union(*prints.values())) == len({t.strip() for t in prints})


def test_hot_ids(spark):
    """A doc_id and null with a third of all rows each, equal texts among them: every row is followed by the next by doc_id, then text, and no stretch holds an id's rows."""
    r = random.Random(12)
    docs = [(7, words(r, 3) if k % 4 else "the same text") for k in range(400)] + [(None, words(r, 3)) for _ in range(400)] + [(1000 + k, words(r, 3)) for k in range(400)] + [(-5, ""), (-5, None)]
    far = [(2**60 + 3 * k, words(r, 3)) for k in range(300)]  # a double does not hold these
    for some in (docs, docs[:400], docs[400:800], docs[:800], far):
        dealt = Counter((x["stretch"], x["doc_id"]) for x in fp.neighbours(table(spark, some), parts=4).filter("seen = 0").collect())
        assert sum(dealt.values()) == len(some) and max(dealt.values()) < 250
        found = fp.fingerprint(table(spark, some), parts=4).collect()
        order = sorted(((d, t or "") for d, t in some), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
        expected = Counter((d, fp.edited(t, order[(k + 1) % len(order)][1])) for k, (d, t) in enumerate(order))
        assert Counter((x["doc_id"], x["edited"]) for x in found) == expected


def test_likeness_against_sets(spark):
    """Every row's two likenesses and fingerprints against plain sets of its paragraphs; fingerprints alone give the likeness where the difference is small."""
    docs = [(k, t) for k, (_, t) in enumerate(rows())]
    found = {x["doc_id"]: x for x in fp.fingerprint(table(spark, docs), parts=2).collect()}

    def digests(text):
        return set(fp.paragraphs([text.encode()])[0].tolist())

    def near(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, t in docs:
        own, new, after = digests(t or ""), digests(found[k]["edited"]), digests(docs[(k + 1) % len(docs)][1] or "")
        assert abs(found[k]["near_edited"] - near(own, new)) < 1e-12 and abs(found[k]["near_next"] - near(own, after)) < 1e-12
        one, two = fp.sketch_of(found[k]["fingerprint"]), fp.sketch_of(found[k]["edited_fingerprint"])
        of, digest, sign, left = fp.sketch_differences([one], [two])
        if not len(left):
            assert {d for d, s in zip(digest.tolist(), sign.tolist(), strict=True) if s > 0} == own - new
            assert {d for d, s in zip(digest.tolist(), sign.tolist(), strict=True) if s < 0} == new - own
    assert any(len(digests(t or "")) > 24 for _, t in docs)


def test_likeness_of_an_edit():
    r = random.Random(4)
    a, b = words(r, 400), words(r, 400)
    one, two, three = (fp.paragraphs([x.encode()]) for x in (a, fp.edited(a, b), b))
    assert 0.2 < fp.likeness(one, two)[0] < 0.5 and fp.likeness(one, three)[0] < 0.05 and fp.likeness(one, one)[0] == 1
    empty = fp.paragraphs([b""])
    assert fp.likeness(empty, empty)[0] == 1 and fp.likeness(empty, one)[0] == 0


def test_few_rows(spark):
    assert fp.fingerprint(table(spark, [])).collect() == []
    one = fp.fingerprint(table(spark, [(7, "abcd")])).first()
    assert one["edited"] == "abab"


def test_kept_sketches_subtract(spark):
    r = random.Random(6)
    texts = [(k, "\n".join(words(r, 6).replace("\n", " ") for _ in range(30))) for k in range(4)]
    texts += [(4 + k, t.replace("a", "b", 2)) for k, t in texts]  # another version of each
    found = {x["doc_id"]: x for x in fp.fingerprint(table(spark, texts)).collect()}
    first, second = ([bytes(found[k + shift]["sketch"]) for k in range(4)] for shift in (0, 4))
    of, digest, sign, left = fp.sketch_differences(first, second)
    flat = [fp.paragraphs([texts[k + shift][1].encode() for k in range(4)]) for shift in (0, 4)]
    expected = set(zip(*(x.tolist() for x in fp.differences(*flat)), strict=True))
    assert not len(left) and set(of.tolist()) == {0, 1, 2, 3} and set(zip(of.tolist(), digest.tolist(), sign.tolist(), strict=True)) == expected
    other = first[1:] + first[:1]  # other texts: too much differs
    assert set(fp.sketch_differences(first, other)[3].tolist()) == {0, 1, 2, 3}
    edited = fp.sketches(*fp.paragraphs([found[k]["edited"].encode() for k in range(4)]))
    assert edited == [bytes(found[k]["edited_sketch"]) for k in range(4)]
