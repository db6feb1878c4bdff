import hashlib
import random

import pytest
from tokenizers import Tokenizer

from attestor.llm import bpe

DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.vocabulary_path())


def texts():
    rng = random.Random(5)
    alphabet = "abcXYZ'stre ve\n\t  éÉñßǅΣσİ½²Ⅷ٣中文́  !?.<>|_-\x1c\x85😀"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    return made + ["", None, "a<|endoftext|>b <|startoftext|>", "x" * 3000, "ab" * 700 + "!" * 300, "the cat sat on the mat. " * 2000, "'S'T it's", "ΑΣ Σ İX"]


@pytest.mark.parametrize("lexicon_words", [0, 50, 100_000])
def test_agrees_with_the_library(spark, tokenizer, lexicon_words):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, DOC).repartition(3)
    ids = {r.doc_id: r.ids for r in bpe.encode(df, bpe.vocabulary_path(), lexicon_words).collect()}
    for i, t in rows:
        assert ids[i] == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, bpe.vocabulary_path(), lexicon_words), bpe.vocabulary_path()).collect()}
    for i, t in rows:
        assert back[i] == tokenizer.decode(ids[i], skip_special_tokens=False)


def test_digests_null_ids_and_clashes(spark, tokenizer):
    rows = [(None, "one two", "x"), (4, None, "y"), (4, "one two", "z")]
    df = spark.createDataFrame(rows, DOC + ", ids string")
    got = {(r.doc_id, r.n_tokens): (r.ids_sha256, r.decoded_sha256) for r in bpe.encode(df, bpe.vocabulary_path(), digests=True).collect()}
    e = tokenizer.encode("one two", add_special_tokens=False)
    want = tuple(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, e.ids)), tokenizer.decode(e.ids, skip_special_tokens=False)))
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {(None, len(e.ids)): want, (4, len(e.ids)): want, (4, 0): (empty, empty)}


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], DOC), bpe.vocabulary_path(), digests=True).count() == 0


def test_transducer_is_minimal_and_shares_suffixes(tmp_path):
    words = sorted({w.encode() for w in ("walking", "talking", "walked", "talked", "king", "ed", "a", "ab", "abc")})
    built = bpe.Transducer.build(words, [[i, i] for i in range(len(words))])
    (tmp_path / "f").write_bytes(built.dump())
    read = bpe.Transducer.load(str(tmp_path / "f"))
    assert read.rows([*words, b"", b"wal", b"abcd", b"zz"]).tolist() == [*range(len(words)), -1, -1, -1, -1]

    # as many states as there are different sets of endings
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(read.final) == len(endings)


def test_encoders_are_kept_by_vocabulary(monkeypatch):
    class Source:
        def __init__(self, value):
            self.value = value

    made = []
    monkeypatch.setattr(bpe, "Encoder", lambda source, lexicon: made.append(source) or source)
    bpe._encoders.clear()
    assert [bpe._encoder(Source(x), None) for x in (b"a", b"a", b"b")] == [b"a", b"a", b"b"] and made == [b"a", b"b"]
    bpe._encoders.clear()
