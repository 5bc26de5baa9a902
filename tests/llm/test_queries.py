"""Registered queries against their SQL, and the pipeline against a plain version."""

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SMALL
from gradewell.llm import queries as R
from gradewell.llm.lines import line_key
from gradewell.llm.simhash import fingerprint
from oracle_check import compare, connect


@pytest.mark.parametrize("name", sorted(R.ORACLES))
def test_query_matches_oracle(spark, name):
    assert compare(R.QUERIES[name](spark, SMALL), connect(SMALL), R.ORACLES[name]) is None


def test_pipeline_matches_a_plain_version(spark):
    docs = R.table(spark, SMALL, "documents")
    good = corpus_pipeline.quality_stage(spark, docs, SMALL)
    assert good.columns == docs.columns
    rows = {r["doc_id"]: r["text"] or "" for r in good.collect()}
    counts = {}
    for text in rows.values():
        for k in {line_key(x.encode()) for x in text.split("\n")} - {b""}:
            counts[k] = counts.get(k, 0) + 1
    cut = {d: "\n".join(x for x in t.split("\n") if counts.get(line_key(x.encode()), 0) < 10) for d, t in rows.items()}
    prints = {d: fingerprint(t) for d, t in cut.items()}
    root = {d: d for d in cut}
    for _ in range(len(cut)):
        least = {d: min(root[e] for e in cut if bin(prints[d] ^ prints[e]).count("1") <= 4) for d in cut}
        if least == root:
            break
        root = least
    kept = {d: cut[d] for d in cut if root[d] == d}
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    expected = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in kept.items()}
    out = corpus_pipeline.run(spark, SMALL).toPandas()
    assert out.groupby("doc_id")["length"].sum().to_dict() == expected
    for _, pieces in out.sort_values("offset").groupby("sequence_id"):
        assert pieces["offset"].tolist() == np.concatenate([[0], np.cumsum(pieces["length"])[:-1]]).tolist() and pieces["length"].sum() <= 4096


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, "en", "s", None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "a b c\n" * 50, "en", "s", 1)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, SMALL)
            if name != "packing":
                assert table.columns == docs.columns
        table.collect()
