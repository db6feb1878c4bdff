import hashlib

import pytest
from pyspark.sql import functions as F

from attestor.functions import ids, scoring
from attestor.functions import text as tx


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, expected", [
    ("plain text", "plain text"),
    ('["From: a\\nTo: b"]', "From: a\nTo: b"),
    ('["a", "b"]', "a\nb"),
    ('[1, "a"]', '[1, "a"]'),
    ("line one\\nline two", "line one\nline two"),
    ("it\\'s", "it's"),
    ("[\"it\\'s here\"]", "it's here"),
    ("", ""),
])
def test_normalise_content(spark, raw, expected):
    text = tx.normalise_content(F.col("t"))
    df = spark.createDataFrame([(raw,)], "t string").select(text.alias("t"))
    assert df.first().t == expected
    assert df.select(text.alias("t")).first().t == expected


@pytest.mark.parametrize("domain, root", [("redwood.com", "redwood"), ("mail.redwood.ai", "redwood"), ("redwood-inference.com", "redwood"), ("io.ai", ""), ("", "")])
def test_organisation_root(spark, domain, root):
    assert one(spark, tx.organisation_root(F.lit(domain))) == root


@pytest.mark.parametrize("handle, bot", [("deploy-bot", True), ("infra-jenkins-bot", True), ("ci-runner", True), ("sam", False), ("maya", False), ("marta_kyc", False)])
def test_bots(spark, handle, bot):
    assert one(spark, tx.looks_like_bot(F.lit(handle))) is bot


@pytest.mark.parametrize("cap, expected", [(400, "a@x.com;b@y.com"), (15, "a@x.com;b@y.com"), (14, "a@x.com"), (7, "a@x.com"), (3, "")])
def test_pack_keeps_whole_values(spark, cap, expected):
    assert one(spark, tx.pack(F.array(F.lit("a@x.com"), F.lit("b@y.com")), cap)) == expected


def test_casefold_joins_spellings(spark):
    assert one(spark, tx.casefold(F.lit("StraßE"))) == "StraßE".casefold()
    assert one(spark, tx.name_tokens(F.lit("Alyssa B. Chen"))) == ["alyssa", "chen"]


@pytest.mark.parametrize("address, expected", [("A@X.com", "a@x.com"), ("n.f@n.f@redwood.com", "n.f@redwood.com"), (None, "")])
def test_address(spark, address, expected):
    assert one(spark, tx.normalise_address(F.lit(address).cast("string"))) == expected


@pytest.mark.parametrize("token, name, fits", [("sam", "Soham R", True), ("serg", "sergio.alvarez@redwood.ai", True), ("ben", "Barbara", False)])
def test_short_form(spark, token, name, fits):
    assert one(spark, tx.is_short_form(F.lit(token), F.lit(name))) is fits


@pytest.mark.parametrize("question, expected", [
    ('what about "rollback plan" now', ["rollback plan"]),
    ("what is it", ["what", "is", "it"]),
    ("Atlas atlas q3 2", ["atlas", "q3"]),
    ('an "open phrase', ["open", "phrase"]),
    ("", []),
])
def test_question_terms(spark, question, expected):
    assert one(spark, tx.question_terms(F.lit(question))) == expected


def test_tickets(spark):
    keep = "PROJ-412 ENG-1 INC-9821 AB-123456 INT-4501 SLA-99 FP-16 GPU-4 ENG-1999 PROJ-2024 ENG-2100 COVID-19".split()
    drop = "AES-256 SHA-1 RSA-2048 TLS-13 ISO-27001 CVE-2026 SEV-1 UTF-8 HTTP-2 USD-100 INC-2026 REL-1999 FY-2025".split()
    found = one(spark, tx.ticket_keys(F.array(*(F.lit(k) for k in [*keep, *drop, "proj-412"]))))
    assert found == keep


@pytest.mark.parametrize("answer, value, said", [("She is Director of Trust & Security", "Director, Trust & Security, Redwood", True), ("open", "", False), ("it is closed", "open", False), ("the Open door", "open", True)])
def test_states(spark, answer, value, said):
    assert one(spark, tx.states(F.lit(answer), F.lit(value))) is said


def test_ids_are_the_first_bytes_of_sha256(spark):
    def by_hand(payload):
        return int.from_bytes(hashlib.sha256(payload.encode()).digest()[:8], "big") & (2**63 - 1)

    for key in ("PROJ-1", "ä ö", "x" * 500):
        assert one(spark, ids.node_id("Ticket", F.lit(key))) == by_hand(f"Ticket\x1f{key}")
    assert one(spark, ids.edge_id("REFERENCES", F.lit(5), F.lit(7), "s")) == by_hand("REFERENCES\x1f5\x1f7\x1fs")
    assert one(spark, ids.canonical_key("Channel", F.lit("  Eng \n Runtime "))) == "eng runtime"
    assert one(spark, ids.canonical_key("Document", F.lit(" A  b "))) == "A b"
    assert one(spark, ids.canonical_key("Document", F.lit("  "))) is None
    assert one(spark, ids.canonical_key("Document", F.lit("a\x1fb"))) is None


def test_weights_of_facts_that_may_not_change(spark):
    parts = [F.lit(x) for x in (1.0, 0.5, 0.7, 1.0)]
    assert one(spark, scoring.weighted(*parts, F.lit(False))) == pytest.approx(0.45 + 0.125 + 0.14 + 0.1)
    assert one(spark, scoring.weighted(*parts, F.lit(True))) == pytest.approx(0.45 + 0.065 + 0.084 + 0.3)
