"""The pipeline stage by stage against brute force, and the SQL of the operators' queries."""

import re

import duckdb
import pytest

import corpus_pipeline
from quern.llm import mixing, packing, queries, store

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {x.doc_id: x.text or "" for x in docs.select("doc_id", "text").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = dict(kept)
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept = {x.doc_id: x.text or "" for x in docs.select("doc_id", "text").collect()}
        assert kept.items() <= before.items()
        if name == "quality_rules":
            assert all(len(re.findall(r"[^\x20\x09-\x0D]+", t)) >= 50 for t in kept.values())
        if name == "exact_dedup":
            best = {}
            for i, t in before.items():
                key = t.encode().lower()
                best[key] = max(best.get(key, i), i)
            assert set(kept) == set(best.values())
        if name == "mixing":
            assert kept == before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {x.doc_id for x in packed} == set(kept)
    assert len(kept) > 50
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length").collect())) == sorted((x.doc_id, x.piece, x.length) for x in packed)


def test_sequences_follow_the_mix(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 150, raising=False)
    sizes = {"hot": 900, "web": 400, None: 200}
    rows = [(1000 * k + i, f"{s} text " * (1 + i % 40) * (1 + k)) for k, s in enumerate(sizes) for i in range(sizes[s])]
    docs = spark.createDataFrame([(i, t, list(sizes)[i // 1000]) for i, t in rows], "doc_id long, text string, source string")
    packed = corpus_pipeline.packing(spark, docs, SF).orderBy("sequence_id", "offset").collect()
    assert sorted(x.doc_id for x in packed) == sorted(i for i, _ in rows)
    ends = {}
    for x in packed:
        assert x.offset == ends.get(x.sequence_id, 0)
        ends[x.sequence_id] = x.offset + x.length
    assert max(ends.values()) <= 2048
    weight = {s: n**0.5 / sum(m**0.5 for m in sizes.values()) for s, n in sizes.items()}
    of = [list(sizes)[x.doc_id // 1000] for x in packed]
    runs = [x.sequence_id >> 40 for x in packed]
    ends = [i for i in range(1, 900) if runs[i] != runs[i - 1]]  # a source runs out after 940 documents
    assert len(ends) >= 4
    for n in ends:
        for s, w in weight.items():
            assert abs(of[:n].count(s) - w * n) < 2 * 16


def test_packing_follows_the_mixing_stage(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 150)
    sizes = {"hot": 900, "web": 400, None: 200}
    rows = [(1000 * k + i, f"{s} text " * (1 + i % 40), s) for k, s in enumerate(sizes) for i in range(sizes[s])]
    docs = store.written(spark.createDataFrame(rows, "doc_id long, text string, source string"), "docs")

    def sources(mixed):
        packed = corpus_pipeline.packing(spark, mixed, SF).orderBy("sequence_id", "offset").collect()
        assert sorted(x.doc_id for x in packed) == sorted(i for i, _, _ in rows)
        return [list(sizes)[x.doc_id // 1000] for x in packed]

    def share(found, n, source):
        return found[:n].count(source) / n

    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, SF)
    roots = sum(n**0.5 for n in sizes.values())
    assert abs(share(sources(store.written(mixed, "mixed")), 600, "hot") - 900**0.5 / roots) < 0.06
    assert share(sources(docs), 600, "hot") > 0.9  # left out, the order of the files is not mixed
    other = mixing.in_order(docs, {"hot": 1, "web": 8, None: 1})
    assert abs(share(sources(store.written(other, "mixed")), 400, "web") - 0.8) < 0.08
    want = [x.doc_id for x in mixing.mix_sources(docs).orderBy("slot", "place").collect()]
    mixed = store.written(mixed, "mixed")
    ranked = mixing.by_files(mixed.select("doc_id", *(c.alias(k) for k, c in mixing.file_places(mixed).items())))
    assert [x.doc_id for x in ranked.orderBy("slot", "place").collect()] == want


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (1, "two words"), (2, text + " end"), (2, text + " end"), (None, None), (None, ""), (3, "w " * 60), (None, " ".join(f"v{i}" for i in range(90)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot int, __block string, row int"
    docs = spark.createDataFrame([(i, t, "en", None, 1, 2, "b", 3) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.schema == spark.createDataFrame([], schema).schema, name
        docs = spark.createDataFrame(docs.collect(), schema)
    assert sorted((str(x.doc_id), x.text[:2]) for x in docs.collect()) == [("1", "w0"), ("None", "v0")]
    assert corpus_pipeline.packing(spark, docs, SF).count() == 2
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = queries.queries()[name](spark, SF)
    want = c.sql(queries.oracle_sql()[name])
    order = sorted(want.columns)
    assert sorted(map(tuple, found.select(*order).collect())) == sorted(want.project(", ".join(order)).fetchall())
