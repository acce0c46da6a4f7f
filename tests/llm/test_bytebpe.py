from collections import Counter

import numpy as np
import public_tokenizers

from millrace.llm import bytebpe
from tests.llm.tables import rows, table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_encode_and_decode(spark):
    docs = rows()
    found = bytebpe.decode(bytebpe.encode(table(spark, docs), RANKS, PATTERN), RANKS, PATTERN).collect()
    whole = bytebpe.encoding(RANKS, PATTERN)
    assert Counter((x["doc_id"], bytes(x["ids"]), bytes(x["decoded"])) for x in found) == Counter((d, np.array(whole.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in docs)


def test_parts_are_safe():
    whole = bytebpe.encoding(RANKS, PATTERN)
    for _, text in rows():
        for size in (1, 7, 50):
            some = bytebpe.parts(text or "", size)
            assert "".join(some) == (text or "")
            assert [i for p in some for i in whole.encode_ordinary(p)] == whole.encode_ordinary(text or "")


def test_empty_table(spark):
    assert bytebpe.encode(table(spark, []), RANKS, PATTERN).collect() == []
