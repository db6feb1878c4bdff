import os

import pytest

from attestor.llm.queries import ORACLE_SQL, QUERIES
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_duckdb(spark, name):
    oracle.agree(spark, QUERIES[name], ORACLE_SQL[name])


def test_op2_agrees_with_the_library(spark):
    import hashlib

    from tokenizers import Tokenizer

    from attestor.llm import bpe

    t = Tokenizer.from_file(bpe.vocabulary_path())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect()}
    for r in QUERIES["op2_bpe"](spark, oracle.DATA).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op1_and_op5_hold_out_what_the_contract_says(spark):
    import zlib

    for name, n, k, least in (("op1_quality", 3, 1, 0.5), ("op5_toxicity", 4, 2, 0.3)):
        rows = QUERIES[name](spark, oracle.DATA).collect()
        assert len(rows) == spark.read.parquet(f"{oracle.DATA}/documents.parquet").count()
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)


def test_op4_columns(spark):
    from tests.llm.test_url_filter import by_hand

    urls = {r.page_id: r.url for r in spark.read.parquet(f"{oracle.DATA}/pages.parquet").collect()}
    rows = QUERIES["op4_url_filter"](spark, oracle.DATA).collect()
    assert len(rows) == len(urls)
    assert all((r.host, r.path, r.rule) == by_hand(urls[r.page_id]) and r.verdict in ("allow", "block") for r in rows)
