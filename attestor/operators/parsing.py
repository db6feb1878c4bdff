"""Source parsers: a document's text to its mentions, references and attributes.

A text is read as lines with offsets, each line as a field and its value, values by small scanners. Places are not among
what Spark's regular expressions return, so this runs over Arrow batches; everything after it is joins and aggregates.
Offsets are code points of the normalised text, from 0, half-open.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import BOT_TOKENS, normalise_content
from attestor.sources.shared import dealt

# Field names, block labels and the shapes of tokens, which results depend on.
RECIPIENTS = {"From": "email_from", "To": "email_to", "Cc": "email_cc", "Bcc": "email_cc"}
MAIL_FACTS = ("Date", "Subject")
MEETING_FACTS = ("Date", "Time", "Duration")
BLOCKS = ("description", "tasks", "summary", "transcript", "notes", "use_case_summary")
HANDLE = re.compile(r"[a-z0-9][a-z0-9._-]{1,30}")
ADDRESS = re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b")
TARGETS = {"ticket": re.compile(r"\b[A-Z]{2,10}-\d{1,6}\b"), "url": re.compile(r"https?://[^\s<>()\[\]{}\"']+")}
URL_TAIL = ".,);"

#: surface, kind, role, start, attributes; the end follows from the surface.
Mention = tuple[str, str, str, int, dict[str, str]]


def lines_of(text: str) -> Iterator[tuple[int, str]]:
    """Each line and where it begins."""
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1


def field_of(at: int, line: str) -> tuple[str, int, str]:
    """The name before the first colon, and the value after it and its blanks with its place; no name without a colon."""
    name, colon, rest = line.partition(":")
    value = rest.lstrip(" \t")
    return (name if colon else "", at + len(line) - len(value), value)


def is_bot(handle: str) -> bool:
    h = handle.casefold()
    return h.endswith("bot") or not set(BOT_TOKENS).isdisjoint(re.split("[^a-z]+", h))


def recipients(value: str) -> Iterator[tuple[int, str, str]]:
    """Place, surface and address of each recipient of a header: names before an address in brackets; then addresses that
    are not part of such a pair."""
    rest, floor, at = list(value), 0, value.find("<")
    while at >= 0:
        stop = next((i for i in range(at + 1, len(value)) if value[i] in "<>" or value[i].isspace()), len(value))
        local, _, host = value[at + 1 : stop].partition("@")
        if stop < len(value) and value[stop] == ">" and local and host:
            begin = max(floor, 1 + max(value.rfind(c, 0, at) for c in "<>,;\r"))
            name = value[begin:at].strip(" \t\"")
            if name:
                yield value.index(name, begin), name, value[at + 1 : stop]
                rest[begin : stop + 1] = " " * (stop + 1 - begin)
            floor = stop + 1
        at = value.find("<", at + 1)
    for m in ADDRESS.finditer("".join(rest)):
        yield m.start(), m[0], m[0]


def parse_mail(title: str, text: str) -> tuple[list[Mention], dict[str, str]]:
    """The header block: from the first header line to the first empty line after it. Of a fact said twice the last counts."""
    mentions, facts, begun = [], {}, False
    for at, line in lines_of(text):
        name, place, value = field_of(at, line)
        begun = begun or name in RECIPIENTS or name in MAIL_FACTS
        if begun and not line:
            break
        if name in MAIL_FACTS and value.strip():
            facts[name.lower()] = value.strip()
        for start, surface, address in recipients(value) if name in RECIPIENTS else ():
            address = address.lower()
            mentions.append((surface, "person", RECIPIENTS[name], place + start, {"email": address, "domain": address.partition("@")[2]}))
    return mentions, facts


def without_fences(text: str) -> str:
    """The text with closed code fences blanked, in the same places."""
    parts = text.split("```")
    closed = len(parts) - 1 - (len(parts) - 1) % 2  # pieces after the last pair of marks stand
    out = [parts[0]]
    for i in range(1, len(parts)):
        if i > closed:
            out.append("```" + parts[i])
        else:
            out.append("\0" * (len(parts[i]) + 6) if i % 2 else parts[i])
    return "".join(out)


def parse_chat(title: str, text: str) -> tuple[list[Mention], dict[str, str]]:
    """Speakers at line starts, then @handles, outside code fences; the title is the channel."""
    channel = {"channel": title.strip()} if title.strip() else {}
    seen, found = without_fences(text), []
    for at, line in lines_of(seen):
        name, _, _ = field_of(at, line)
        if HANDLE.fullmatch(name) and line[len(name) + 1 : len(name) + 2] in (" ", "\t"):
            found.append((name, "speaker", at))
    at = seen.find("@")
    while at >= 0:
        if m := HANDLE.match(seen, at + 1):
            found.append((m[0], "at_mention", at + 1))
        at = seen.find("@", at + 1)
    mentions = [(h, "bot" if is_bot(h) else "person", role, place, {"handle": h, **channel}) for h, role, place in found]
    return mentions, channel


def attendees(value: str) -> Iterator[tuple[int, str, str]]:
    """Place, name and affiliation (or nothing) of each entry of `Name (Affiliation); Name; ...`. A semicolon inside
    parentheses separates nothing; of an entry that goes on after its parentheses, what follows is the name."""
    begin, said, open_at = 0, "", None
    for i, c in enumerate(value + ";"):
        if c == "(" and open_at is None:
            open_at = i
        elif c == ")" and open_at is not None:
            said, name_end, open_at = value[open_at + 1 : i], open_at, None
            if value[i + 1 :].lstrip()[:1] not in ("", ";"):
                begin, said = i + 1, ""
        elif c == ";" and (open_at is None or i == len(value)):
            if open_at is not None:  # never closed
                begin, said = open_at + 1, ""
            entry = value[begin : name_end if said or value[begin:i].rstrip().endswith(")") else i]
            if name := entry.strip():
                yield begin + entry.index(name), name, said.strip()
            begin, said, open_at = i + 1, "", None


def parse_meeting(title: str, text: str) -> tuple[list[Mention], dict[str, str]]:
    """Date, time, duration; the first line of attendees, without names that were cut off. An affiliation's first word is the
    organisation, the others the role."""
    facts, listed = {}, None
    for at, line in lines_of(text):
        name, place, value = field_of(at, line)
        if name in MEETING_FACTS and value:
            facts[name.lower()] = value.strip()
        if name == "Attendees" and value and listed is None:
            listed = place, value
    mentions = []
    for start, name, affiliation in attendees(listed[1]) if listed else ():
        if not name.endswith("..."):
            organisation, _, role = affiliation.partition(" ")
            told = {"affiliation": affiliation, "organisation": organisation, "role": role}
            mentions.append((name, "person", "attendee", listed[0] + start, {k: v for k, v in told.items() if v}))
    if organisations := sorted({m[4]["organisation"] for m in mentions if "organisation" in m[4]}):
        facts["organisations"] = ";".join(organisations)
    return mentions, facts


def parse_blocks(title: str, text: str) -> tuple[list[Mention], dict[str, str]]:
    """The labelled blocks of a structured document, a label alone on its line: their names, and the length of each that
    says something. No mentions."""
    labels, sizes, begin = [], {}, 0

    def close(end: int) -> None:
        if labels and (said := text[begin:end].strip()):
            sizes[f"block_{labels[-1]}_chars"] = str(len(said))

    for at, line in lines_of(text):
        name, _, value = field_of(at, line)
        if name in BLOCKS and not value:
            close(at)
            labels.append(name)
            begin = at + len(line)
    close(len(text))
    return [], {**sizes, **({"blocks": ";".join(labels)} if labels else {})}


#: The parser of each source type; parse_blocks takes the rest.
PARSERS: dict[str, Callable] = {"gmail": parse_mail, "slack": parse_chat, "fireflies": parse_meeting}


def references(text: str) -> list[tuple[str, str, int, int]]:
    """Ticket keys, then URLs. A URL's trailing punctuation is not part of its target, but of its span."""
    return [(m[0].rstrip(URL_TAIL) if kind == "url" else m[0], kind, *m.span()) for kind, shape in TARGETS.items() for m in shape.finditer(text)]


_MENTION = "array<struct<surface: string, kind: string, role: string, start: int, end: int, attributes: map<string, string>>>"
_REFERENCE = "array<struct<target: string, kind: string, start: int, end: int>>"


def parse_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source_type, title, body) to doc_id, source_type, title, mentions, references, attributes. Bodies are
    normalised first; mentions whose span does not hold their surface are left out."""
    strings = pa.map_(pa.string(), pa.string())
    mention = pa.list_(pa.struct([("surface", pa.string()), ("kind", pa.string()), ("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("attributes", strings)]))
    reference = pa.list_(pa.struct([("target", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            found, refs, attributes = [], [], []
            for source, title, body in zip(*(b.column(c).to_pylist() for c in ("source_type", "title", "body"))):
                ms, attrs = PARSERS.get(source, parse_blocks)(title or "", body)
                kept = [(s, kind, role, at, at + len(s), list(told.items())) for s, kind, role, at, told in ms if body[at : at + len(s)] == s]
                found.append([dict(zip(("surface", "kind", "role", "start", "end", "attributes"), m)) for m in kept])
                refs.append([dict(zip(("target", "kind", "start", "end"), r)) for r in references(body)])
                attributes.append(list(attrs.items()))
            cols = [pa.array(found, mention), pa.array(refs, reference), pa.array(attributes, strings)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source_type", "title")), *cols], ["doc_id", "source_type", "title", "mentions", "references", "attributes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source_type string, title string, mentions {_MENTION}, references {_REFERENCE}, attributes map<string, string>"
    body = normalise_content(F.coalesce("body", F.lit(""))).alias("body")
    return dealt(docs.select("doc_id", "source_type", "title", "body")).select("doc_id", "source_type", "title", body).mapInArrow(run, schema)


def mentions_of(parsed: DataFrame, cap: int = 400) -> DataFrame:
    """One row a mention, the first of each document in parse order."""
    rows = parsed.select(F.col("doc_id").alias("dsid"), F.element_at("attributes", "channel").alias("channel"), F.posexplode("mentions").alias("place", "m")).where(F.col("place") < cap)
    email = F.element_at("m.attributes", "email")
    return rows.select("dsid", "channel", "m.surface", "m.kind", "m.role", "m.start", "m.end", email.alias("email"), F.element_at("m.attributes", "handle").alias("handle"))


#: Shapes of dates in documents, tried in order; a day of the week before a date says nothing more.
DATE_SHAPES = ("d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
#: The shape that mail clients show; off by default, as the corpus' own tools did not read it.
MAIL_SHAPE = "MMM d, yyyy 'at' h:mm a"


def to_epoch(c, mail_shape: bool = False):
    """Seconds since 1970 of a date in any known shape, or null; without a zone it is UTC."""
    shapes = [*DATE_SHAPES, *([MAIL_SHAPE] if mail_shape else [])]
    date = F.regexp_replace(F.substring(F.trim(c), 1, 40), "^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? ", "")
    return F.coalesce(*(F.unix_timestamp(F.try_to_timestamp(date, F.lit(s))) for s in shapes))
