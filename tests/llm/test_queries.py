"""Every registered query of the subpackage, as the entry module gives it: against its SQL in DuckDB, or against brute force."""

import duckdb
import pytest

import __spark_entry__
from tests.llm.tables import rows
from tests.llm.test_veccodes import vectors as odd_vectors

SMALL = "/root/testdata/sf0.001"
OWN = sorted(k for k in __spark_entry__.queries() if k.startswith("op") and k[2].isdigit())


@pytest.mark.parametrize("name", sorted(set(OWN) & set(__spark_entry__.oracle_sql())))
def test_against_sql(spark, tmp_path, name):
    """On the smallest tables, and on one with nulls, empty and long texts, ties and repeated texts."""
    odd = [(k, t, "xx") for k, (_, t) in enumerate(rows())]
    spark.createDataFrame(odd, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    vectors = "vec_id long, embedding array<double>, label int"
    spark.createDataFrame(odd_vectors(150, 8), vectors).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    for folder, files in ((SMALL, ""), (str(tmp_path), "/*.parquet")):
        con = duckdb.connect()
        for view in ("documents", "embeddings"):
            con.sql(f"CREATE VIEW {view} AS SELECT * FROM '{folder}/{view}.parquet{files}'")
        wanted = con.sql(__spark_entry__.oracle_sql()[name])
        columns = sorted(wanted.columns)
        df = __spark_entry__.queries()[name](spark, folder)
        assert sorted(df.columns) == columns
        kinds = dict(zip(wanted.columns, map(str, wanted.types), strict=True))
        names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
        assert {c: names[k] for c, k in df.dtypes} == kinds
        found = sorted(([r[c] for c in columns] for r in df.collect()), key=repr)
        assert found == sorted(([r[wanted.columns.index(c)] for c in columns] for r in wanted.fetchall()), key=repr)


def test_all_are_registered():
    assert [int(k[2:].split("_")[0]) for k in sorted(OWN, key=lambda k: int(k[2:].split("_")[0]))] == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(set(OWN) - set(__spark_entry__.oracle_sql())))
def test_one_result_for_each_document(spark, name):
    ids = sorted(x["doc_id"] for x in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect())
    found = __spark_entry__.queries()[name](spark, SMALL).select("doc_id").collect()
    assert sorted(x["doc_id"] for x in found) == ids if name[:4] != "op1_" else sorted({x["doc_id"] for x in found}) == ids


def test_counts_of_personal_data(spark):
    """The registered query's counts and hashes against plain patterns; n_spans counts what the field adds too."""
    from hashlib import sha256

    from tests.llm.test_pii import plain

    texts = {x["doc_id"]: x["text"] or "" for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for x in __spark_entry__.queries()["op4_pii_semi_markov"](spark, SMALL).collect():
        base = plain(texts[x["doc_id"]])
        assert x["base_sha256"] == sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [x[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        spans = x["spans"].split(",") if x["spans"] else []
        assert x["n_spans"] == len(spans) == len(set(spans)) and {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans)
