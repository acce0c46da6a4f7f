import random

import pytest

from millrace.operators.passages import holding


@pytest.mark.parametrize("seed", range(2))
def test_holding(spark, seed):
    r = random.Random(seed)
    make = lambda n, letters="ab é\n𝔘": "".join(r.choice(letters) for _ in range(n))
    shared = make(40)
    passages = [make(n) for n in (200, 95, 63, 62, 40, 15, 14, 5, 1)] + [shared + make(60) for _ in range(3)] + [shared + make(10), f"  {make(80)} ", "", "    "]
    items = [(k, p) for k, p in enumerate(passages)] + [(0, make(70)), (3, None), (None, make(70))]
    docs = [(k, make(r.randint(0, 90)) + (r.choice(items)[1] or "").strip(" ") + make(r.randint(0, 90))) for k in range(60)]
    docs += [(70, None), (71, ""), (None, passages[1] + "x"), (72, "x" + passages[0] + passages[0]), (72, passages[2]), (73, passages[0][1:]), (74, "y" * 20_000 + passages[1])]
    found = [tuple(x) for x in holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item_id").collect()]
    expected = {(d, i) for d, t in docs for i, p in items if t is not None and p is not None and p.strip(" ") in t}
    assert len(found) == len(set(found)) and set(found) == expected


def test_registered_query_finds_what_lines_miss(spark):
    from millrace.plans import registry

    found = {tuple(x) for x in registry.queries()["benchmark_passages"](spark, "/root/testdata/sf0.001").select("doc_id", "item_id").collect()}
    assert found == {(64, 16), (188, 33), (52, 39)}
