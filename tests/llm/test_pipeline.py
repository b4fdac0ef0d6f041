"""The pipeline against a brute-force version of every stage."""

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm.test_containment import slow_hits
from tests.llm.test_line_recall import slow_dedup
from tests.llm.test_near_copies import slow_kept
from tests.llm.test_rules import slow_measure


def test_run_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {k: t for k, t in docs.items() if slow_measure(t)[6]}
    docs = {k: t for k, t in slow_dedup(docs).items() if t}
    docs = {k: docs[k] for k in slow_kept(docs)}
    hit = {r[0] for r in slow_hits(docs, items)}
    docs = {k: t for k, t in docs.items() if k not in hit}
    plain = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.ids for r in got} == {k: plain.encode(t) for k, t in docs.items()}
    assert len(got) == len(docs) and all(r.parity and r.round_trip for r in got)


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        rows = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, rows, sf_dir)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert result.columns == rows.columns, name
                rows = result
        assert result.count() == (docs.count() and 2)
