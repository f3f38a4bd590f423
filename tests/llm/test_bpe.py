"""BPE transducer against the tokenizers library."""

import hashlib
import random
import struct

import pytest

from driftwise.llm import bpe
from driftwise.llm.common import table
from tests.conftest import SMALL
from tests.llm import edge

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    path = bpe.default_path()
    with open(path, "rb") as f:
        return bpe.load(f.read()), tokenizers.Tokenizer.from_file(path)


def ids_of(tok, text):
    return tok.encode(text, add_special_tokens=False).ids


def test_random_texts_whole_and_in_pieces(pair):
    vocab, tok = pair
    rng = random.Random(3)
    parts = [*"aab  \n\t'slltdrevm.,!?0123é²½Ⅷ٣ñ中字  \x1c\x85\U0001f600_ǅ<|>", "<|endoftext|>", "<|endof", "the", " of", "'ll"]
    for _ in range(600):
        text = "".join(rng.choices(parts, k=rng.choice([1, 3, 10, 40, 200])))
        want = ids_of(tok, text)
        assert bpe.unpack(bpe.encode_text(vocab, text)) == want
        enc, out, i = bpe.StreamEncoder(vocab), b"", 0
        while i < len(text):
            k = rng.randint(1, 7)
            out += enc.feed(text[i:i + k])
            i += k
        out += enc.finish()
        assert bpe.unpack(out) == want
        assert bpe.decode_ids(vocab, out) == tok.decode(want, skip_special_tokens=False) == text


@pytest.mark.parametrize("unit", ["a", "the", " ", "\n ", "1", "!", "é", "abcdefgh", "=-"])
def test_long_runs_stay_in_constant_memory(pair, unit):
    vocab, tok = pair
    text = "x " + unit * 20_000 + " y" + unit * 5000
    enc, out, held = bpe.StreamEncoder(vocab), [], 0
    for i in range(0, len(text), 1000):
        out.append(enc.feed(text[i:i + 1000]))
        held = max(held, len(enc.tail) + (len(enc.run.held) if enc.run else 0))
    out.append(enc.finish())
    assert bpe.unpack(b"".join(out)) == ids_of(tok, text)
    assert held <= 4 * bpe.LONG


def test_transducer_holds_the_sufficient_lookahead(pair):
    vocab, _ = pair
    rng = random.Random(8)
    for letters in ("ab", "aeinorst", "the quick brown"):
        data = "".join(rng.choice(letters) for _ in range(9000)).encode()
        run = bpe.Transducer(vocab)
        out = b"".join(run.feed(data[i:i + 77]) for i in range(0, len(data), 77)) + run.finish()
        assert bpe.unpack(out) == vocab.merge(data)
    assert 0 < vocab.lookahead < bpe.LONG


def test_walk_is_merge(pair):
    vocab, _ = pair
    rng = random.Random(5)
    for _ in range(3000):
        data = bytes(rng.choice(b"  abcdeinorst.\xc3\xa9\xff") for _ in range(rng.randint(0, 30)))
        assert vocab.walk(data) == vocab.merge(data)


def test_decoder_replaces_broken_utf8_like_the_library(pair):
    vocab, tok = pair
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert bpe.decode_ids(vocab, struct.pack("<20I", *ids)) == tok.decode(ids, skip_special_tokens=False)


def digests(tok, text):
    ids = ids_of(tok, text)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_digests(spark, pair):
    docs = table(spark, SMALL, "documents")
    want = {r.doc_id: digests(pair[1], r.text or "") for r in docs.collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(docs).collect()} == want
    path = bpe.default_path()
    packed = docs.selectExpr("doc_id", "cast(text as binary) as __text")
    apart = {r.doc_id: r["__decoded"] for r in bpe.decode(bpe.encode(packed, path), path).collect()}
    assert apart == {r.doc_id: r.text for r in docs.collect()}
    rows = sorted((r[0] or 0, *digests(pair[1], r[1] or "")) for r in edge.rows())
    assert sorted((r[0] or 0, *r[1:]) for r in bpe.token_digests(edge.documents(spark)).collect()) == rows
    assert bpe.token_digests(edge.none(spark)).collect() == []
