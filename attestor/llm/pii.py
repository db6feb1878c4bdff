"""Operator 3, PII: surrogate generation.

Detected entities (mail and network addresses, phone, card, account and social security numbers, keys, secrets,
people's names) get keyed replacements. Number-like and key-like entities go through a keyed
Feistel permutation of their own class, so case, digits, separators and length stay and different originals get
different replacements by construction; card and account checksums are made valid again, network addresses stay in
their kind of network, social security numbers stay possible ones. Names are made of syllables of the same script with
endings of the same gender, one word for each word, which can collide.

The key comes from the caller or from `spark.attestor.pii.key`; without one nothing is replaced (ValueError).

People: a name is found by a title; a full name found so is found without one too in the same text. A surname under a title
is the one person of the text with that surname, if there is one, else a person of its own. The title is not part of the
person: one person under two titles has one replacement, of the gender that the titles and given names tell together.

Coreference: the replacement depends on the key, the kind and the normalised entity only, so one entity has one
replacement in all documents. Distinctness: the distinct entities of the whole corpus are given their replacements in a
table; where two share one, or one equals an original of its kind, all but the first try again with the next attempt
number, which makes names longer, until none is left. Only those exceptions, and people whose mentions differ in gender, go
on to the rewriting pass: broadcast if counted within the bound, else joined to the texts that mention them.

Defined cases: null stays null, an empty text empty; texts are searched whole; rows that share a doc_id, or have none, are
rewritten each; other columns stay as they are (`replace`); an empty table gives an empty result.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from attestor.llm.common import BROADCAST_ROWS, discard, in_shards, save, table, tuned

#: The setting that holds the key, and the key of the registered queries, whose results must not change.
KEY_SETTING, QUERY_KEY = "spark.attestor.pii.key", b"attestor query key"
#: Characters of a secret that are permuted at once.
PIECE = 40

# ---- names ------------------------------------------------------------------------------------------------------

#: Given names that tell a gender.
GIVEN = {
    "f": "Ada Anna Beate Carla Dora Edith Elena Eva Frida Greta Hanna Ida Jana Klara Lena Maria Marta Nora Olga Paula Rita Sofia Thea Ulla Vera Wanda Анна Вера Галина Дарья Елена Зоя Ирина Лариса Мария Нина Ольга Άννα Ελένη Μαρία Σοφία Δήμητρα Ειρήνη".split(),
    "m": "Adam Bruno Carl Dirk Emil Franz Georg Hugo Igor Jan John Karl Leon Max Nils Otto Paul Peter Rolf Sven Theo Udo Viktor Willi Антон Борис Виктор Глеб Денис Егор Игорь Кирилл Лев Максим Олег Γιώργος Νίκος Πέτρος Κώστας Αντώνης Μάριος".split(),
}
#: Titles before a name and the gender that they tell; those after a Chinese one; frequent Chinese surnames.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Mister": "m", "Sir": "m", "Lady": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f",
    "Señor": "m", "Señora": "f", "Sra": "f", "Sr": "m", "Don": "m", "Doña": "f", "Signor": "m", "Signora": "f", "Dr": "n", "Prof": "n", "Professor": "n", "Г-н": "m", "Г-жа": "f", "Κύριος": "m", "Κυρία": "f",
}
AFTER = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f"}
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾萧田董"
#: Syllables: beginnings and vowels, then endings of given and family names by gender.
SCRIPTS = {
    "latin": ("b d f g h j k l m n p r s t v w br dr fl gr kl kr pl st tr".split(), "a e i o u".split(), {"f": ["na", "ra", "lia", "sa"], "m": ["n", "rt", "ld", "s"], "n": ["y", "ri", "le", "x"]}, dict.fromkeys("fmn", "mann er ler sen berg feld ton ow ard ell ier ez".split())),
    "cyrillic": (list("бвгдзклмнпрст"), list("аеиоу"), {"f": ["на", "ра", "ля"], "m": ["н", "р", "слав"], "n": ["ша", "ля", "ня"]}, {"f": ["ова", "ина", "ева"], "m": ["ов", "ин", "ев"], "n": ["енко", "ук", "ян"]}),
    "greek": (list("βγδκλμνπρστ"), list("αειου"), {"f": ["νη", "λα", "ρω"], "m": ["νος", "ρης", "λας"], "n": ["λι", "νω", "ρυ"]}, {"f": ["ίδου", "άκη", "οπούλου"], "m": ["ίδης", "άκης", "όπουλος"], "n": ["ου", "έα", "ιάδη"]}),
}
#: First and last code points of other scripts' letters.
RANGES = {
    "han": (0x4E00, 0x9FA5), "hiragana": (0x3041, 0x3096), "katakana": (0x30A1, 0x30FA), "hangul": (0xAC00, 0xD7A3), "hebrew": (0x05D0, 0x05EA), "arabic": (0x0621, 0x064A),
    "armenian": (0x0561, 0x0586), "georgian": (0x10D0, 0x10F0), "devanagari": (0x0905, 0x0939), "bengali": (0x0985, 0x09B9), "tamil": (0x0B85, 0x0BB9), "thai": (0x0E01, 0x0E30),
}
#: Characters of Chinese given names by gender.
HAN_GIVEN = {"f": "芳丽娜敏静秀娟艳霞梅兰玉", "m": "伟强磊军勇杰涛超刚辉鹏斌", "n": "文华宁平安林清新云晨光明"}
_GENDER = {x.casefold(): g for g, names in GIVEN.items() for x in names}


def script_of(text: str) -> str:
    c = next((ord(x) for x in text if x.isalpha()), 65)
    if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
        return "greek"
    if 0x400 <= c < 0x530:
        return "cyrillic"
    return next((name for name, (lo, hi) in RANGES.items() if lo <= c <= hi), "latin")


@lru_cache(None)
def _letters(script: str) -> str:
    lo, hi = RANGES[script]
    return "".join(chr(c) for c in range(lo, hi + 1) if unicodedata.category(chr(c)) == "Lo")


def _made_word(script: str, gender: str, family: bool, size: int, n: int, more: int) -> str:
    """A name word from the digits of n; size: characters of the original, more: syllables or letters beyond the usual."""
    def draw(options):
        nonlocal n
        n, i = divmod(n, len(options))
        return options[i]

    if script in SCRIPTS:
        begin, vowels, given, families = SCRIPTS[script]
        told = "".join(draw(begin) + draw(vowels) for _ in range((2 if size > 4 else 1) + more))
        return (told + draw((families if family else given)[gender])).capitalize()
    if script == "han":
        told = draw(SURNAMES) if family else ""
        told += "".join(draw(HAN_GIVEN[gender]) for _ in range(min(1, size - len(told))))
        return told + "".join(draw(_letters("han")) for _ in range(max(0, size - len(told)) + more))
    return "".join(draw(_letters(script)) for _ in range(size + more))


# ---- detection --------------------------------------------------------------------------------------------------

_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_NAME = rf"(?!(?:{_TITLE})\b)[^\W\d_a-z][^\W\d_]+"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Kind and pattern; a place goes to the first kind that matches there.
PATTERNS = [
    ("email", r"[^\W_][\w.+%-]{0,63}@(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.){1,8}[^\W\d_]{2,24}"),
    ("secret", r"(?<![^\W_])(?i:password|passwd|pwd|secret|token|api_?key|access_?key)(?P<gap>\s{0,3}[=:]\s{0,3}[\"']?)(?P<secret>[A-Za-z0-9+/_-]{8,}+(?:[.=]++[A-Za-z0-9+/_-]++)*+=*+)"),
    ("aws", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ipv6", rf"(?<![\w:])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,7}}:(?:{_HEX}(?::{_HEX}){{0,6}})?|::{_HEX}(?::{_HEX}){{0,6}})(?![\w:])"),
    ("ipv4", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("card", r"(?<![\d])\d(?:[ -]?\d){12,18}(?![\d])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])"),
    ("name", rf"(?<!\w)(?P<title>(?:(?:{_TITLE})\.?[ ])+)(?P<name>{_NAME}(?:[ -]{_NAME})*)(?!\w)|(?P<han>[{SURNAMES}][\u4e00-\u9fa5]{{1,2}})(?P<after>{'|'.join(AFTER)})"),
]


@lru_cache(1)
def _pattern() -> re.Pattern:
    return re.compile("|".join(f"(?P<k_{k}>{p})" for k, p in PATTERNS))


#: Without one of these a text holds no entity.
_GATE = re.compile(r"[0-9@=:]|(?<!\w)(?:" + "|".join(TITLES) + r")\.? |" + "|".join(AFTER))


class Mention(NamedTuple):
    """A place of an entity. gender: of a name, by its own title or words; last: only the person's surname stands there."""

    start: int
    end: int
    kind: str
    said: str
    entity: str
    gender: str | None = None
    last: bool = False


def luhn_ok(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def iban_rest(entity: str) -> int:
    """The number that a valid account number leaves 1 of."""
    return int("".join(str(int(c, 36)) for c in entity[4:] + entity[:4])) % 97


def ssn_ok(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _address(said: str):
    try:
        return ipaddress.ip_address(said)
    except ValueError:
        return None


def find(text: str | None) -> list[Mention]:
    """The mentions, by place. Addresses of this machine or of none are nobody's."""
    if not text or not _GATE.search(text):
        return []
    out, names = [], []
    for m in _pattern().finditer(text):
        kind = m.lastgroup if m.lastgroup.startswith("k_") else next(k for k in m.groupdict() if k.startswith("k_") and m[k] is not None)
        kind, (start, end) = kind[2:], m.span()
        if kind == "name":
            start, end = m.span("name" if m["han"] is None else "han")
            told = AFTER[m["after"]] if m["han"] else next((g for t in m["title"].split() if (g := TITLES[t.rstrip(".")]) != "n"), "n")
            names.append((start, end, text[start:end], told))
            continue
        if kind == "secret":
            start, end = m.span("secret")
        said = text[start:end]
        if kind in ("ipv4", "ipv6") and ((ip := _address(said)) is None or ip.is_loopback or ip.is_unspecified or int(ip) == 0xFFFFFFFF):
            continue
        if kind == "card" and not luhn_ok(re.sub(r"\D", "", said)):
            kind = "number"
        elif kind == "iban" and iban_rest(normalised(kind, said)) != 1:
            kind = "account"
        elif kind == "ssn" and not ssn_ok(normalised(kind, said)):
            kind = "number"
        out.append(Mention(start, end, kind, said, normalised(kind, said)))
    return sorted(out + people(text, names, out)) if names else out


def people(text: str, names: list[tuple[int, int, str, str]], others: list[Mention]) -> list[Mention]:
    """The mentions of people: names under a title (start, end, name, the title's gender), full names of those without one
    where nothing else was found, and surnames as the person of this text that has them."""
    full = sorted({said for *_, said, _ in names if " " in said}, key=len, reverse=True)
    if full:
        taken = [(a, b) for a, b, *_ in [*names, *others]]
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, full)) + r")(?!\w)", text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                names.append((*m.span(), m[0], "n"))
    surnames: dict[str, set[str]] = {}
    for said in full:
        surnames.setdefault(normalised("name", said.split()[-1]), set()).add(normalised("name", said))
    out = []
    for start, end, said, told in names:
        entity = normalised("name", said)
        owners = surnames.get(entity, ()) if " " not in said else ()
        last = len(owners) == 1
        if last:
            (entity,) = owners
        out.append(Mention(start, end, "name", said, entity, _gender(told, entity), last))
    return out


def _gender(told: str, entity: str) -> str:
    return _GENDER.get(re.split("[ -]", entity)[0], "n") if told == "n" else told


def normalised(kind: str, said: str) -> str:
    """What two mentions of one entity have in common: addresses and names ignore case, numbers their separators, names runs
    of blanks."""
    if kind == "email":
        return said.lower()
    if kind == "ipv6":
        return ":".join(f"{int(ipaddress.IPv6Address(said)) >> s & 65535:x}" for s in range(112, -1, -16))
    if kind in ("phone", "card", "number", "iban", "account", "ssn"):
        return re.sub(r"[^0-9A-Za-z+]", "", said)
    return " ".join(said.split()).casefold() if kind == "name" else said


# ---- keyed replacements -----------------------------------------------------------------------------------------

def _prf(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(parts).encode(), "sha256")[:16], "big")


def walked(key: bytes, tweak: str, value: int, size: int, fits) -> int:
    """A keyed permutation of the values below size for which `fits` holds, value among them."""
    while True:
        value = permuted(key, tweak, value, size)
        if fits(value):
            return value


#: Blocks of network addresses that are not like others; an address stays in the smallest that holds it.
BLOCKS = [ipaddress.ip_network(x) for x in (
    "0.0.0.0/0 0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 "
    "198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4 ::/0 ::/8 2000::/3 2001:db8::/32 fc00::/7 fe80::/10 ff00::/8"
).split()]


def _block(version: int, value: int):
    inside = [n for n in BLOCKS if n.version == version and n.network_address <= (ip := (ipaddress.IPv4Address if version == 4 else ipaddress.IPv6Address)(value)) <= n.broadcast_address]
    return max(inside, key=lambda n: n.prefixlen)


def permuted_address(key: bytes, tweak: str, value: int, version: int) -> int:
    """A keyed permutation of the addresses of a block that are in no smaller one."""
    block = _block(version, value)
    base = int(block.network_address)
    return base + walked(key, tweak + str(block), value - base, block.num_addresses, lambda v: _block(version, base + v) is block)


def permuted(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of range(size): ten Feistel rounds over two unequal halves (a, b) of a mixed radix."""
    if size < 2:
        return 0
    a = int(size**0.5) if size < 1 << 52 else 1 << (size.bit_length() // 2)
    b = -(-size // a)
    while True:  # values beyond the range walk on until they are inside
        left, right = divmod(value, b)
        for i in range(5):
            left = (left + _prf(key, tweak, f"l{i}", str(right)) % a) % a
            right = (right + _prf(key, tweak, f"r{i}", str(left)) % b) % b
        value = left * b + right
        if value < size:
            return value


_CLASSES = [("0123456789", "0"), ("abcdefghijklmnopqrstuvwxyz", "a"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A")]
_CLASS_OF = {c: (i, chars.index(c)) for i, (chars, _) in enumerate(_CLASSES) for c in chars}


def same_format(key: bytes, tweak: str, text: str, hexadecimal: bool = False) -> str:
    """A permutation of the texts of this format: a digit stays a digit, a letter keeps its case, the rest stays."""
    if hexadecimal:
        chars = "0123456789abcdef"
        slots = [(i, chars, chars.index(c)) for i, c in enumerate(text)]
    else:
        slots = [(i, _CLASSES[_CLASS_OF[c][0]][0], _CLASS_OF[c][1]) for i, c in enumerate(text) if c in _CLASS_OF]
    size = value = 0
    if slots:
        size, value = 1, 0
        for _, chars, v in slots:
            value, size = value * len(chars) + v, size * len(chars)
    shape = "h" * len(text) if hexadecimal else "".join(_CLASSES[_CLASS_OF[c][0]][1] if c in _CLASS_OF else c for c in text)
    value, out = permuted(key, tweak + shape, value, size) if slots else 0, list(text)
    for i, chars, _ in reversed(slots):
        value, v = divmod(value, len(chars))
        out[i] = chars[v]
    return "".join(out)


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0, gender: str | None = None) -> str:
    """The replacement of a normalised entity. Equal to it only by a chance that the collision check removes."""
    tweak = f"{kind}/{attempt}/"
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        labels = domain.split(".")
        # the host's labels change together, the last label (com, de, ...) stays
        return same_format(key, tweak + "l" + domain, _plain(local)) + "@" + same_format(key, tweak + "d", _plain(".".join(labels[:-1]))) + "." + labels[-1]
    if kind == "ipv4":
        return str(ipaddress.IPv4Address(permuted_address(key, tweak, int(ipaddress.IPv4Address(entity)), 4)))
    if kind == "ipv6":
        value = permuted_address(key, tweak, int(ipaddress.IPv6Address(entity)), 6)
        return ":".join(f"{value >> s & 65535:x}" for s in range(112, -1, -16))
    if kind == "card":  # the first digit names the network, the last one is the check digit
        body = entity[0] + same_format(key, tweak + entity[0], entity[1:-1])
        return body + next(d for d in "0123456789" if luhn_ok(body + d))
    if kind == "ssn":
        return f"{walked(key, tweak, int(entity), 10**9, lambda v: ssn_ok(f'{v:09d}')):09d}"
    if kind == "phone" and entity.startswith("+"):  # the country stays
        code = 2 if entity[1] in "17" else 3
        return entity[:code] + same_format(key, tweak + entity[:code], entity[code:])
    if kind == "aws":
        return entity[:4] + same_format(key, tweak, entity[4:])
    if kind == "iban":  # the country stays, the two digits after it are the check
        body = same_format(key, tweak + entity[:2], entity[4:])
        return f"{entity[:2]}{98 - iban_rest(entity[:2] + '00' + body):02d}{body}"
    if kind == "account":
        return entity[:2] + same_format(key, tweak + entity[:2], entity[2:])
    if kind == "secret":
        # long ones piece by piece, each under what stands before it: no character stays by its place, and time is linear
        hexadecimal, before, out = bool(re.fullmatch("[0-9a-f]+", entity)), "", []
        for i in range(0, len(entity), PIECE):
            piece = entity[i : i + PIECE]
            out.append(same_format(key, tweak + before, piece, hexadecimal))
            before = hmac.digest(key, (before + piece).encode(), "sha256").hex()
        return "".join(out)
    if kind == "name":
        script, words = script_of(entity), re.split("([ -])", entity)
        surname = entity.rfind(" ") + 1  # words from there on are the family's
        out, at = [], 0
        for i, w in enumerate(words):
            out.append(w if i % 2 else _made_word(script, gender or "n", at >= surname, len(w), _prf(key, tweak, entity, str(i)), attempt))
            at += len(w)
        return "".join(out)
    return same_format(key, tweak, entity)


def _plain(text: str) -> str:
    """Letters outside ASCII as keyed ASCII would not be reversible; they are spelled by their code points."""
    return "".join(c if c.isascii() else f"x{ord(c):x}" for c in text)


def in_format(mention: Mention, replacement: str) -> str:
    """The replacement written as this mention was: separators of numbers, case, a surname alone."""
    said, kind = mention.said, mention.kind
    if kind in ("phone", "card", "number", "iban", "account", "ssn"):
        fresh = iter(replacement)
        return "".join(next(fresh) if c.isalnum() or c == "+" else c for c in said)
    if mention.last:
        replacement = replacement.rsplit(" ", 1)[1]
    return replacement.upper() if kind in ("email", "ipv6", "name") and said.isupper() else replacement


# ---- over a DataFrame -------------------------------------------------------------------------------------------

def secret_key(spark: SparkSession, key: bytes | None) -> bytes:
    """The caller's key, else the session's."""
    found = key or (spark.conf.get(KEY_SETTING, None) or "").encode()
    if not found:
        raise ValueError(f"a key is needed: pass one or set {KEY_SETTING}")
    return found


def mentions(docs: DataFrame) -> DataFrame:
    """k (a hash of the text), start, end, kind, entity, gender of each mention."""
    names = ["k", "start", "end", "kind", "entity", "gender"]
    types = [pa.int64()] * 3 + [pa.string()] * 3

    def run(batches):
        for b in batches:
            rows = [(k, m.start, m.end, m.kind, m.entity, m.gender) for k, t in zip(b.column("k").to_pylist(), b.column("text").to_pylist()) for m in find(t)]
            cols = [*zip(*rows)] or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return docs.select(F.xxhash64("text").alias("k"), "text").mapInArrow(run, "k long, start long, end long, kind string, entity string, gender string")


def entities_of(told: DataFrame) -> DataFrame:
    """kind, entity, gender (of a person: what all mentions tell together), mixed (its mentions tell different ones)."""
    has = lambda g: F.max((F.col("gender") == g).cast("int"))
    rows = told.groupBy("kind", "entity").agg(*(has(g).alias(g) for g in "fmn"))
    gender = F.when(F.col("f").isNull(), None).when((F.col("f") == 1) & (F.col("m") == 0), "f").when((F.col("m") == 1) & (F.col("f") == 0), "m").otherwise("n")
    return rows.select("kind", "entity", gender.alias("gender"), F.coalesce(F.col("f") + F.col("m") + F.col("n") > 1, F.lit(False)).alias("mixed"))


_ASSIGNED = ["kind", "entity", "gender", "mixed", "attempt"]


def _assign(entities: DataFrame, key: bytes) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("kind", "entity", "attempt", "gender"))))
            told = [surrogate(key, *r) for r in rows]
            same = [normalised(r[0], t) for r, t in zip(rows, told)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _ASSIGNED), pa.array(told, pa.string()), pa.array(same, pa.string())], [*_ASSIGNED, "surrogate", "same"])

    return entities.select(*_ASSIGNED).mapInArrow(run, "kind string, entity string, gender string, mixed boolean, attempt int, surrogate string, same string")


def assignments(entities: DataFrame, key: bytes, rows: int | None = None) -> DataFrame:
    """kind, entity, gender, mixed, attempt, surrogate for each distinct entity: no two of one kind share a replacement
    (they must differ in what is written, so neither separators nor case count), and none is an original."""
    given = save(_assign(entities.withColumn("attempt", F.lit(0)), key), "surrogates", rows)
    originals = save(given.select("kind", F.col("entity").alias("same")), "originals", rows)
    while True:
        # the first of those that share a replacement keeps it; a low attempt goes before a high one
        first = given.groupBy("kind", "same").agg(F.min(F.struct("attempt", "entity")).alias("keeps"), F.count("*").alias("n"))
        shared = given.join(first.where("n > 1"), ["kind", "same"]).where(F.struct("attempt", "entity") != F.col("keeps"))
        taken = given.join(originals, ["kind", "same"], "left_semi")
        again = save(shared.select(*_ASSIGNED).unionByName(taken.select(*_ASSIGNED)).distinct(), "again", rows)
        if again.isEmpty():
            return given
        retried = _assign(again.withColumn("attempt", (F.col("attempt") + 1).cast("int")), key)
        before, given = given, save(given.join(again.select("kind", "entity"), ["kind", "entity"], "left_anti").unionByName(retried), "surrogates", rows)
        discard(before)
        discard(again)


Exceptions = dict[tuple[str, str], tuple[int, str | None]]


def rewrite(text: str | None, exceptions: Exceptions, key: bytes) -> tuple[str | None, list[str]]:
    """The text with its replacements, and the kinds replaced. exceptions: attempt and gender of an entity where they are
    not 0 and the mention's."""
    found = find(text)
    if not found:
        return text, []
    out, at = [], 0
    for m in found:
        attempt, gender = exceptions.get((m.kind, m.entity), (0, m.gender))
        out += [text[at : m.start], in_format(m, surrogate(key, m.kind, m.entity, attempt, gender))]
        at = m.end
    return "".join([*out, text[at:]]), [m.kind for m in found]


def replace(docs: DataFrame, key: bytes | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """docs with all their columns, `text` rewritten, and `_kinds`, an array of the kinds replaced in it."""
    spark = tuned(docs.sparkSession)
    key = secret_key(spark, key)
    told = save(mentions(in_shards(docs)), "mentions")
    count = told.count()
    odd = assignments(entities_of(told), key, count).where("attempt > 0 or mixed").select("kind", "entity", "attempt", "gender")
    exceptions = save(odd, "exceptions", count)
    per_row = exceptions.count() > bound
    if per_row:
        by_text = told.select("k", "kind", "entity").distinct().join(exceptions, ["kind", "entity"])
        by_text = by_text.groupBy(F.col("k").alias("_k")).agg(F.collect_list(F.struct("kind", "entity", "attempt", "gender")).alias("_exceptions"))
        rows = docs.withColumn("_k", F.xxhash64("text")).join(by_text, "_k", "left").select(*docs.columns, "_exceptions")
        sent = spark.sparkContext.broadcast({})
    else:
        rows, sent = docs, spark.sparkContext.broadcast({(r.kind, r.entity): (r.attempt, r.gender) for r in exceptions.toLocalIterator()})

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            own = b.column("_exceptions").to_pylist() if per_row else [None] * b.num_rows
            maps = ({(x["kind"], x["entity"]): (x["attempt"], x["gender"]) for x in o} if o else sent.value for o in own)
            done = [rewrite(t, e, key) for t, e in zip(b.column(at).to_pylist(), maps)]
            cols = [pa.array([t for t, _ in done], pa.string()) if i == at else c for i, c in enumerate(b.columns) if b.schema.names[i] != "_exceptions"]
            names = [x for x in b.schema.names if x != "_exceptions"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([k for _, k in done], pa.list_(pa.string()))], [*names, "_kinds"])

    return rows.mapInArrow(run, StructType([*docs.schema.fields, StructField("_kinds", ArrayType(StringType()))]))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replace(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    return rows.select("doc_id", "text", F.size("_kinds").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("_kinds")), ",").alias("kinds"))
