"""Text functions as Column expressions. Each `sql_` function is the same expression in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of a mail domain that name no organisation.
DOMAIN_NOISE = "com net org io ai co dev app cloud inc corp group mail email www us uk eu".split()
#: Words that mark an automated account.
BOT_TOKENS = "bot ci jenkins deploy build alert alerts webhook pipeline cron monitor pagerduty nagios".split()
#: Prefixes that look like a ticket's and are none; those whose year-like numbers are dates.
NOT_TICKETS = (
    "AES SHA MD RSA ECDSA HMAC SSL TLS SSH GPG UTF ISO RFC ASCII HTTP HTTPS IPV IEEE ANSI "
    "SOC PCI HIPAA GDPR FIPS NIST CVE CWE CVSS SEV USD EUR GBP UTC GMT"
).split()
DATE_PREFIXES = "INC REL Q FY H CY W SPRINT".split()
#: Words that a question is not searched by.
STOPWORDS = """
a an the and or but nor not no so yet is am are was were be been being do does did doing have has had having
i you he she it we they me him her us them my your his its our their mine yours hers ours theirs
this that these those what which who whom whose when where why how
in on at to for with from by of about into over under above below between through during before after up down out off
again further then there here as if else than because while although though until unless since
all any both each few more most other some such only own same too very can will just should now
""".split()
#: Endings that do not tell organisations apart, removed in this order.
ORGANISATION_SUFFIXES = (" inc", " ltd", " llc", " corp", " inference", " systems")
ROOT_PREFIX_MIN, SHORT_FORM_MIN, FREE_TERM_MIN = 5, 3, 2


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def words(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def casefold(c: Column) -> Column:
    """Lower case with ß as ss: one definition for every comparison that ignores case."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def sql_casefold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalise_name(c: Column) -> Column:
    return casefold(collapse(c))


def email_local_part(c: Column) -> Column:
    return casefold(F.substring_index(c, "@", 1))


def email_domain(c: Column) -> Column:
    """What follows the first @, or the empty text."""
    return F.when(F.instr(c, "@") > 0, casefold(F.regexp_extract(c, r"(?s)^[^@]*@(.*)$", 1))).otherwise("")


def sql_email_domain(x: str) -> str:
    return f"case when instr({x}, '@') > 0 then {sql_casefold(f'substr({x}, instr({x}, chr(64)) + 1)')} else '' end"


def organisation_root(domain: Column) -> Column:
    """The first label of a domain that names somebody: longer than a character and no noise."""
    parts = F.filter(F.split(casefold(domain), r"[.\-]+"), lambda p: (F.length(p) > 1) & ~p.isin(DOMAIN_NOISE))
    return F.coalesce(F.get(parts, F.lit(0)), F.lit(""))


def sql_organisation_root(x: str) -> str:
    return f"coalesce(list_filter(regexp_split_to_array({sql_casefold(x)}, '[.\\-]+'), lambda p: length(p) > 1 and p not in ({quoted(DOMAIN_NOISE)}))[1], '')"


def name_tokens(c: Column) -> Column:
    """Distinct runs of a-z longer than a character, in order of appearance."""
    return F.array_distinct(F.filter(F.split(casefold(c), "[^a-z]+"), lambda t: F.length(t) > 1))


def sql_name_tokens(x: str) -> str:
    """Sorted, as DuckDB's list_distinct keeps no order."""
    return f"list_sort(list_distinct(list_filter(regexp_split_to_array({sql_casefold(x)}, '[^a-z]+'), lambda t: length(t) > 1)))"


def looks_like_bot(c: Column) -> Column:
    h = casefold(c)
    return h.endswith("bot") | F.arrays_overlap(F.split(h, "[^a-z]+"), words(BOT_TOKENS))


def normalise_address(c: Column) -> Column:
    """Lower case; of an address with several @, the first local piece and the last domain."""
    e = F.trim(casefold(F.coalesce(c, F.lit(""))))
    many = F.length(e) - F.length(F.replace(e, F.lit("@"), F.lit(""))) > 1
    return F.when(many, F.concat(F.substring_index(e, "@", 1), F.lit("@"), F.substring_index(e, "@", -1))).otherwise(e)


def sql_normalise_address(x: str) -> str:
    e = f"trim({sql_casefold(f'coalesce({x}, {chr(39) * 2})')})"
    return f"case when len(string_split({e}, '@')) > 2 then string_split({e}, '@')[1] || '@' || string_split({e}, '@')[-1] else {e} end"


def pack(values: Column, cap: int) -> Column:
    """Values joined by ; up to the first that would make the text longer than cap."""
    def add(acc: Column, v: Column) -> Column:
        grown = F.length(acc.text) + F.length(v) + F.when(acc.n > 0, 1).otherwise(0)
        stop = acc.stop | (grown > cap)
        text = F.when(stop, acc.text).when(acc.n > 0, F.concat(acc.text, F.lit(";"), v)).otherwise(v)
        return F.struct(text.alias("text"), (acc.n + F.when(stop, 0).otherwise(1)).alias("n"), stop.alias("stop"))

    begin = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("stop"))
    return F.aggregate(values, begin, add, lambda acc: acc.text)


def same_organisation(a: Column, b: Column) -> Column:
    """Equal roots, or the shorter, if long enough, begins the longer. Blank roots match nothing."""
    begins = (F.least(F.length(a), F.length(b)) >= ROOT_PREFIX_MIN) & (F.startswith(a, b) | F.startswith(b, a))
    return (a != "") & (b != "") & ((a == b) | begins)


def sql_same_organisation(a: str, b: str) -> str:
    return f"({a} <> '' and {b} <> '' and ({a} = {b} or (least(length({a}), length({b})) >= {ROOT_PREFIX_MIN} and (starts_with({a}, {b}) or starts_with({b}, {a})))))"


def short_form_pattern(token: Column) -> Column:
    return F.array_join(F.filter(F.split(casefold(token), ""), lambda x: x != ""), ".*")


def short_form_parts(name: Column) -> Column:
    parts = name_tokens(name)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(casefold(name)))


def is_short_form(token: Column, name: Column) -> Column:
    """Whether the token's letters occur in order inside one token of the name."""
    pattern = short_form_pattern(token)
    return F.exists(short_form_parts(name), lambda p: F.rlike(p, pattern))


def sql_is_short_form(token: str, name: str) -> str:
    parts = sql_name_tokens(name)
    pattern = f"array_to_string(string_split({sql_casefold(token)}, ''), '.*')"
    return f"len(list_filter(case when len({parts}) > 0 then {parts} else [{sql_casefold(name)}] end, lambda p: regexp_matches(p, {pattern}))) > 0"


def normalise_predicate(c: Column) -> Column:
    return collapse(F.regexp_replace(casefold(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]+", " "))


def sql_normalise_predicate(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({sql_casefold(f'coalesce({x}, {chr(39) * 2})')}, '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def normalise_object(c: Column) -> Column:
    out = normalise_predicate(c)
    for s in ORGANISATION_SUFFIXES:
        out = F.regexp_replace(out, f"{s}$", "")
    return out


def sql_normalise_object(x: str) -> str:
    out = sql_normalise_predicate(x)
    for s in ORGANISATION_SUFFIXES:
        out = f"regexp_replace({out}, '{s}$', '')"
    return out


def states(answer: Column, value: Column) -> Column:
    """Whether an answer says a value: as a substring, or by three quarters of its two or more longer tokens."""
    text, v = casefold(F.coalesce(answer, F.lit(""))), F.trim(F.coalesce(value, F.lit("")))
    tokens = F.array_distinct(F.filter(F.split(casefold(v), "[^a-z0-9]+"), lambda t: F.length(t) > 2))
    present = F.size(F.filter(tokens, lambda t: F.contains(text, t)))
    loose = (F.size(tokens) >= 2) & (present >= F.size(tokens) * 0.75)
    return (v != "") & (text != "") & (F.contains(text, casefold(v)) | loose)


def terms(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(casefold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def sql_terms(x: str) -> str:
    return f"list_filter(regexp_split_to_array({sql_casefold(f'coalesce({x}, {chr(39) * 2})')}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def question_terms(c: Column) -> Column:
    """Phrases between double quotes, then the other terms without stopwords and single characters; all of them
    if that leaves nothing and there is no phrase. Distinct, in order."""
    c = F.translate(F.coalesce(c, F.lit("")), "“”", '""')
    parts = F.split(c, '"')
    # an odd piece is between two quotes only if a further quote closes it
    inner = F.filter(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (i < F.size(parts) - 1), F.array_join(terms(x), " ")).otherwise("")), lambda x: x != "")
    free = terms(F.array_join(F.transform(parts, lambda x, i: F.when((i % 2 == 0) | (i == F.size(parts) - 1), x).otherwise(" ")), " "))
    kept = F.filter(free, lambda t: (F.length(t) >= FREE_TERM_MIN) & ~t.isin(STOPWORDS))
    return F.array_distinct(F.concat(inner, F.when((F.size(inner) > 0) | (F.size(kept) > 0), kept).otherwise(free)))


def ticket_keys(targets: Column) -> Column:
    """Upper-case ticket keys, without look-alikes and dates; distinct, in order."""
    prefix = lambda k: F.substring_index(k, "-", 1)
    number = lambda k: F.substring_index(k, "-", -1)
    dated = lambda k: prefix(k).isin(DATE_PREFIXES) & F.rlike(number(k), F.lit("^(199[0-9]|20[0-9][0-9]|2100)$"))
    return F.array_distinct(F.filter(F.transform(targets, F.upper), lambda k: ~prefix(k).isin(NOT_TICKETS) & ~dated(k)))


def normalise_content(c: Column) -> Column:
    """A stored body as text: JSON strings and lists of strings are decoded (lists joined by newlines, anything else
    stays), then leftover escapes are replaced and a leftover wrapper is removed. Applying it twice changes nothing."""
    listed = F.from_json(c, "array<string>")
    # from_json turns numbers into strings, so the elements' own JSON must all begin with a quote
    raw = F.get_json_object(c, "$[*]")
    items = F.regexp_replace(c, r'"(?:[^"\\]|\\.)*+"', '""')
    strings = F.rlike(items, F.lit(r'^\s*\[\s*""(?:\s*,\s*"")*\s*\]\s*$')) & raw.isNotNull()
    text = F.when(c.startswith("[") & strings & F.coalesce(F.size(listed) > 0, F.lit(False)), F.array_join(listed, "\n")).otherwise(c)
    for escaped, plain in ((r"\r\n", "\n"), (r"\n", "\n"), (r"\t", "\t"), (r"\'", "'"), (r"\"", '"')):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    cut = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (
        F.when(cut.startswith('["') & cut.endswith('"]'), F.substring(cut, F.lit(3), F.length(cut) - 4))
        .when(cut.startswith('"') & cut.endswith('"') & (F.length(cut) > 1), F.substring(cut, F.lit(2), F.length(cut) - 2))
        .otherwise(text)
    )
