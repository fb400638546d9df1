"""The transducer against the tokenizers library, whole and in chunks."""

import random

import pytest

from umbra.llm.bpe import Decoder, Encoder, PieceCache, Vocabulary, encode, encode_chunks, encode_documents

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return Vocabulary(PATH), Tokenizer.from_file(PATH)


def texts():
    r = random.Random(1)
    out = ["", "aaaa" * 50, "<|endoftext|>hi <|endoftext|> there", "  \n\n  x  ", " " * 300, "don't we'll 'S 're", "a<|endoftext", "½² 12345", "\x00\x01 　x", "\r\n\t y", "🏴‍☠️ zażółć"]
    out += ["".join(r.choice(" abcdeth'sln\n.,1éßé<|>中 ") for _ in range(r.randint(0, 60))) for _ in range(400)]
    out += ["".join(r.choice("ab") for _ in range(r.randint(100, 900))) + "".join(r.choice("the in of") for _ in range(300)) for _ in range(40)]
    return out


def test_encodes_and_decodes_as_the_library_does(both):
    v, t = both
    cache = PieceCache(v, limit=50)
    for x in texts():
        ids = encode(v, cache, x)
        assert ids == t.encode(x, add_special_tokens=False).ids
        machine = Decoder(v)
        assert machine.feed(ids) + machine.finish() == x == t.decode(ids, skip_special_tokens=False)


def test_chunks_give_the_same_ids(both):
    v, t = both
    r = random.Random(2)
    for x in texts()[::3]:
        n = r.randint(1, 9)
        ids = [i for some in encode_chunks(v, [x[i : i + n] for i in range(0, len(x), n)]) for i in some]
        assert ids == t.encode(x, add_special_tokens=False).ids


def test_long_pieces_in_chunks(both, monkeypatch):
    v, t = both
    monkeypatch.setattr("umbra.llm.bpe.LONG", 20)
    r = random.Random(3)
    runs = ["thequick" * 9, "7" * 50, "!?'" * 20, " " * 45, "\n" * 30, " \n\t" * 15, "é中" * 30, "'s", "'re", " ", "a", "'", "<|endoftext|>", "x", "½", "\u3000" * 40]
    for _ in range(400):
        x = "".join(r.choice(runs) for _ in range(r.randint(1, 8)))
        n = r.choice([1, 2, 3, 7, 25, 60])
        ids = [i for some in encode_chunks(v, [x[i : i + n] for i in range(0, len(x), n)]) for i in some]
        assert ids == t.encode(x, add_special_tokens=False).ids, (x, n)


def test_memory_does_not_grow_with_a_piece(both):
    v, t = both
    cache, most = PieceCache(v, limit=100), 0
    r = random.Random(4)
    words = ["the", "quick", "brown", "fox", "aaaa", "zq"]
    part = "".join(r.choice(words) for _ in range(40_000))

    def chunks():
        for at in range(0, len(part), 1000):
            yield part[at : at + 1000]

    ids = []
    for some in encode_chunks(v, chunks(), cache):
        most = max(most, len(some))
        ids += some
    assert ids == t.encode(part, add_special_tokens=False).ids and most < 2000


def test_decoder_takes_ids_one_by_one(both):
    v, t = both
    x = "é中🏴 <|endoftext|>"
    machine = Decoder(v)
    assert "".join(machine.feed([i]) for i in t.encode(x).ids) + machine.finish() == x


def test_memory_of_the_transducer_is_bounded(both):
    v, _ = both
    encoder, most = Encoder(v), 0
    for _ in range(300):
        encoder.feed(b"thequickbrownfoxaaaa")
        most = max(most, len(encoder.tail))
    assert most <= 8 * v.longest < v.lookahead()


def test_documents_with_nulls_repeats_and_clashes(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "hi there", 6), (2, "", 7)]
    out = encode_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    assert sorted((r.n_tokens, r.decoded) for r in out) == [(0, ""), (0, ""), (0, ""), (2, "hi there")]
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
