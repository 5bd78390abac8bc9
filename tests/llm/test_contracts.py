"""Queries of the training-data operators against their SQL in DuckDB, and hostile inputs for each operator."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from spindrift.llm import components, encoding, leakage, mixture, names, near_records, plain_form, queries, subjects, survivor

DIR = "/root/testdata/sf0.001"
#: Names that the operators use inside.
CLASHING = ("n", "w", "u", "v", "p", "k", "m", "q", "key", "label", "node", "cls", "check", "cell", "total", "at", "feat", "token", "gram", "value", "field", "shard", "block", "copies", "all", "opts", "path", "r", "h", "words", "sizes", "weight", "near", "part")


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows), sorted(cols)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS FROM '{DIR}/{f}'")
    df, want = queries.QUERIES[name](spark, DIR), con.sql(queries.SQL[name])
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(want.fetchall(), want.columns)


def _more(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])


def _same(a, b):
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(a) == key(b)


LONG = "wort " * 40_000


def test_columns_with_clashing_names(spark):
    links = spark.createDataFrame([("a", "b"), ("b", None), (None, None), ("c", "c"), ("b", "d"), ("b", "d")], "s string, t string")
    _same(components.connected_components(links, "s", "t"), components.connected_components(_more(links), "s", "t"))
    texts = spark.createDataFrame([(1, "ａ" * 3), (None, "x​y"), (2, None), (3, ""), (3, ""), (4, LONG)], "id bigint, t string")
    _same(plain_form.plain_forms(texts, "id", ["t"]), plain_form.plain_forms(_more(texts), "id", ["t"]))
    cells = spark.createDataFrame([("Größe",), ("Größe",), ("GrÃ¶ÃŸe",), (None,), ("",), ("é " + LONG,)], "t string")
    _same(encoding.restore_values(cells, ["t"]), encoding.restore_values(_more(cells), ["t"]))
    assert {r.restored for r in encoding.restore_values(cells, ["t"]).collect()} == {"Größe"}
    fp = spark.createDataFrame([(1, [1, 2, 3, 4], 1.0), (2, [1, 2, 3, 4], 2.0), (2, [1, 2, 3, 9], 2.0), (None, [1], 1.0), (3, None, None)], "id bigint, fp array<bigint>, d double")
    pairs = lambda df: near_records.expand_pairs(*near_records.near_duplicates(df, "id", F.col("fp"), position=F.col("d"), within=5.0, threshold=0.5), 5.0)
    _same(pairs(fp), pairs(_more(fp)))
    assert pairs(fp.limit(0)).count() == 0


def test_document_operators_take_hostile_tables(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma. Delta epsilon zeta.", "s"), (1, "Alpha beta gamma. Delta epsilon zeta.", "s"), (2, None, None), (3, "", "s"), (None, "Alpha", "s"), (4, LONG, "s")], "doc_id bigint, text string, source string")
    items = spark.createDataFrame([(7, "wort " * 20), (8, None), (None, "wort " * 20), (9, "")], "item_id bigint, passage string")
    got = leakage.leaked_passages(_more(docs), _more(items), exact=12)
    assert {(r.doc_id, r.item_id, r.exact_words) for r in got.collect()} == {(4, 7, 20)}
    _same(got, leakage.leaked_passages(docs, items, exact=12))
    labels = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (None, 5, "b"), (4, None, "b"), (99, 5, None)], "doc_id bigint, subject_id int, annotator string")
    _same(subjects.subjects_of_documents(docs, labels), subjects.subjects_of_documents(_more(docs), _more(labels)))
    assert subjects.subjects_of_documents(docs.limit(0), labels).count() == 0
    goals = spark.createDataFrame([("s", 1.0, 2), ("s", 1.0, 2), (None, 0.5, 1), ("t", None, 1), ("z", 0.2, 0)], "source string, target_share double, max_repeats int")
    drawn = mixture.mix(_more(docs), _more(goals)).collect()
    assert drawn and {r.source for r in drawn} == {"s"} and max(r.copies for r in drawn) <= 2
    assert mixture.mix(docs.limit(0), goals).count() == mixture.mix(docs, goals.limit(0)).count() == 0


def test_record_operators_take_hostile_tables(spark):
    spell = spark.createDataFrame([("f", "Maria Belkandor", 1), ("f", "Belkandor, Maria", 2), ("f", None, 1), (None, "Maria", 1), ("f", "", 3), ("f", "—", 1), ("f", LONG, 1)], "field string, name string, n bigint")
    a = {r.name: r.entity for r in names.link_spellings(spell).collect() if r.field}
    b = {r.name: r.entity for r in names.link_spellings(spell.select("*", *[F.lit(1).alias(c) for c in ("node", "key", "tokens", "w", "entity")])).collect() if r.field}
    assert a == b and a["Maria Belkandor"] == a["Belkandor, Maria"] != a["—"]
    cols = {f for fs in survivor.BUNDLES.values() for f in fs} | {"last_scanned"}
    T = spark.read.parquet(f"{DIR}/tracks.parquet").select(*cols) if os.path.isdir(DIR) else None
    if T is not None:
        M = spark.createDataFrame([("g", r.filepath) for r in T.select("filepath").limit(5).collect()] + [("g", None), (None, "x"), ("h", "/none")], "group_id string, filepath string")
        _same(survivor.surviving_records(M, T), survivor.surviving_records(_more(M), _more(T)))
        assert survivor.surviving_records(M, T).count() == 1 and survivor.surviving_records(M.limit(0), T).count() == 0
