"""The parsers, case by case."""

import pytest
from pyspark.sql import functions as F

from attestor.operators import parsing


def said(parse, text, title=""):
    found, facts = parse(title, text)
    for surface, _, _, at, _ in found:
        assert text[at : at + len(surface)] == surface
    return [(s, role, told) for s, _, role, _, told in found], facts


def test_mail_headers():
    text = 'From: "Alyssa Chen" <Alyssa@Cascade.com>\nTo: m.k@Redwood.com, Tom Becker <tom@x.io>; "" <b@x.com>\nBcc: A B <a@b.co>\nSubject: first\nSubject: PROJ-1\n \nDate: then\n\nFrom: Quoted <q@q.com>'
    found, facts = said(parsing.parse_mail, text)
    assert found == [
        ("Alyssa Chen", "email_from", {"email": "alyssa@cascade.com", "domain": "cascade.com"}),
        ("Tom Becker", "email_to", {"email": "tom@x.io", "domain": "x.io"}),
        ("m.k@Redwood.com", "email_to", {"email": "m.k@redwood.com", "domain": "redwood.com"}),
        ("b@x.com", "email_to", {"email": "b@x.com", "domain": "x.com"}),
        ("A B", "email_cc", {"email": "a@b.co", "domain": "b.co"}),
    ]
    # a line of blanks does not end the block, an empty one does
    assert facts == {"subject": "PROJ-1", "date": "then"}


@pytest.mark.parametrize("value, want", [
    ("", []),
    ("nobody", []),
    ("A <a@b.com", ["a@b.com"]),
    ("A <no at>", []),
    ("A <a@b c.com>", []),
    ("<a@b.com>", ["a@b.com"]),
    ("x, A B <a@b.com> C <c@d.com>", ["A B", "C"]),
    ("A <x> <a@b.com>", ["a@b.com"]),
    ("Jo <jo@x.com> jo@x.com", ["Jo", "jo@x.com"]),
])
def test_recipients(value, want):
    assert [s for _, s, _ in parsing.recipients(value)] == want


def test_chat_speakers_and_fences():
    text = "sasha: hi @kevin and <@maria>\n```\nbob: in code @eve\n```\ndeploy-bot:\tdone\nNote: no\nx: short\nam: ok ``` open @zed"
    found, facts = said(parsing.parse_chat, text, " general ")
    assert [(s, r) for s, r, _ in found] == [("sasha", "speaker"), ("deploy-bot", "speaker"), ("am", "speaker"), ("kevin", "at_mention"), ("maria", "at_mention"), ("zed", "at_mention")]
    assert facts == {"channel": "general"} and found[0][2] == {"handle": "sasha", "channel": "general"}
    assert said(parsing.parse_chat, "x", " ") == ([], {})
    assert [k for _, k, *_ in parsing.parse_chat("", "deploy-bot: x\nann: y")[0]] == ["bot", "person"]


def test_meetings():
    text = "Date: 2025-03-27\nTime: 15:00 UTC\nAttendees: Maya Patel (Redwood Sales Lead); Bare Name; Sofia Alv...; Jonas (Acme); Two (A; B)\nAttendees: Nobody Else\nDate: 2025-03-28"
    found, facts = said(parsing.parse_meeting, text)
    assert found == [
        ("Maya Patel", "attendee", {"affiliation": "Redwood Sales Lead", "organisation": "Redwood", "role": "Sales Lead"}),
        ("Bare Name", "attendee", {}),
        ("Jonas", "attendee", {"affiliation": "Acme", "organisation": "Acme"}),
        ("Two", "attendee", {"affiliation": "A; B", "organisation": "A;", "role": "B"}),
    ]
    assert facts == {"date": "2025-03-28", "time": "15:00 UTC", "organisations": "A;;Acme;Redwood"}
    assert said(parsing.parse_meeting, "Attendees:\nnone") == ([], {})


@pytest.mark.parametrize("text, want", [
    ("description:\nabc\ntasks:\nx", {"block_description_chars": "3", "block_tasks_chars": "1", "blocks": "description;tasks"}),
    ("summary: on the line\nnotes:  \n  a b \n\nSteps:\nc", {"block_notes_chars": "14", "blocks": "notes"}),
    ("tasks:\n\n", {"blocks": "tasks"}),
    ("Description:\nx\nother:\ny", {}),
    ("transcript:\na\ntranscript:\nbcd", {"block_transcript_chars": "3", "blocks": "transcript;transcript"}),
    ("", {}),
])
def test_blocks(text, want):
    assert parsing.parse_blocks("", text) == ([], want)


def test_references():
    assert parsing.references("see ENG-4129, XPROJ-1234567 a (https://x.io/a,b). and http://y.z/,") == [("ENG-4129", "ticket", 4, 12), ("https://x.io/a,b", "url", 31, 47), ("http://y.z/", "url", 54, 66)]


def test_bodies_are_normalised(spark):
    docs = spark.createDataFrame([(1, "slack", None, '["ann: hi", "bob: yo"]'), (2, "gmail", "t", None), (3, "jira", "t", "a\\ndescription:\\nxyz")], "doc_id long, source_type string, title string, body string")
    got = {r.doc_id: r for r in parsing.parse_documents(docs).collect()}
    assert [m.surface for m in got[1].mentions] == ["ann", "bob"] and got[2].mentions == []
    assert got[3].attributes == {"blocks": "description", "block_description_chars": "3"}


def test_null_handles_and_emails(spark):
    docs = spark.createDataFrame([(1, "slack", "c", "ann: hi"), (2, "gmail", "t", "To: a@b.co")], "doc_id long, source_type string, title string, body string")
    rows = parsing.mentions_of(parsing.parse_documents(docs)).select("dsid", "channel", "email", "handle").orderBy("dsid").collect()
    assert [tuple(r) for r in rows] == [(1, "c", None, "ann"), (2, None, "a@b.co", None)]


@pytest.mark.parametrize("said, want", [
    ("Tue, 3 Jun 2025 09:12:00 +0200", 1748934720), ("3 Jun 2025 09:12:00 +0000", 1748941920), ("2025-06-03T09:12:00+00:00", 1748941920), ("2025-06-03T09:12:00", 1748941920),
    ("2025-06-03 09:12:00", 1748941920), (" 2025-06-03 09:12 ", 1748941920), ("2025-06-03", 1748908800), ("3 June", None), ("", None), (None, None), ("Tue, Jun 3, 2025 at 9:12 AM", None),
])
def test_dates(spark, said, want):
    df = spark.createDataFrame([(said,)], "d string")
    assert df.select(parsing.to_epoch(F.col("d"))).first()[0] == want


def test_the_shape_of_mail_clients(spark):
    df = spark.createDataFrame([("Tue, Jun 3, 2025 at 9:12 AM",)], "d string")
    assert df.select(parsing.to_epoch(F.col("d"), mail_shape=True)).first()[0] == 1748941920
