"""The pipeline's decisions on a small table, stage by stage, against plain versions."""

import hashlib

import pytest

import corpus_pipeline
from storyloom.llm import containment, simhash
from storyloom.llm.queries import QUERIES, model_path
from test_simhash import plain_components

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_versions(spark, tmp_path):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = {r.doc_id: r for r in docs.collect()}
        assert len(rows) == docs.count()
        if name == "language_id":
            assert rows == {d: r for d, r in kept.items() if any(c.isalpha() for c in r.text or "")}
        elif name == "simhash_near_dedup":
            found = plain_components([(d, simhash.fingerprint(r.text)) for d, r in kept.items()])
            assert rows == {d: kept[d] for d, _, c in found if d == c}
        elif name == "benchmark_decontamination":
            items = [containment.shingle_set(containment.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            clean = {d for d, r in kept.items() if not any(len(i & containment.shingle_set(containment.words_of(r.text))) >= 0.8 * len(i) for i in items if i)}
            assert rows == {d: kept[d] for d in clean} and len(clean) < len(kept)
        else:
            assert rows.keys() == kept.keys() and any(rows[d].text != kept[d].text for d in rows)
            assert all(r.n_chars == len(r.text) for r in rows.values())
        kept = rows
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = sorted((d, hashlib.sha256(r.text.encode()).hexdigest(), len(library.encode(r.text)) + 2) for d, r in kept.items())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted((r.doc_id, r.decoded_sha256, r.n_tokens) for r in last.collect()) == want
    assert sorted((r.doc_id, r.decoded_sha256, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd_docs.columns
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert len(rows) == docs.count()


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("op7_", "op10_", "op11_", "op13_"))])
def test_query_returns_all_rows(spark, name):
    table = "pages" if name.startswith("op2_") else "documents"
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
