"""Token counts and the piece codec against the libraries, and exact round trips."""

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import PROSE, rows_of
from veilspan.llm import piece_codec, token_cache

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PLAIN = sentencepiece.SentencePieceProcessor(model_file=MODEL)
STRANGE = [
    "", " ", "  ", "a  b   c", " lead", "trail ", "\n\n x\t y ", "<s></s> <unk> <0x41>", "日本語 text 😀", "ÿ\x00z",
    "▁x", "▁▁a ▁ b", "\r\n", "x" * 500, "   a   ",
]


def test_counts_of_the_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = token_cache.token_counts(spark, docs, MODEL, str(tmp_path / "cache"))
    expected = []
    for r in docs.collect():
        n = len(PLAIN.encode(r.text))
        expected.append((r.doc_id, len(r.text.encode()), n, n > 4096))
    assert rows_of(got, *got.columns) == sorted(expected, key=repr)


def test_only_misses_are_encoded(spark, docs_of, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    first = docs_of("one text", "one text", "two texts")
    token_cache.token_counts(spark, first, MODEL, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    # a stored count is believed: it is not worked out again
    name = token_cache.tokenizer_digest(MODEL)
    known = spark.createDataFrame([("three",)], "t string").selectExpr(
        f"'{name}' AS tokenizer", "unhex(sha2(t, 256)) AS digest", "99L AS n_tokens"
    )
    known.write.mode("append").parquet(cache)
    got = token_cache.token_counts(spark, docs_of("three", "one text", "four"), MODEL, cache, limit=98)
    assert {r.doc_id: (r.n_tokens, r.over_limit) for r in got.collect()} == {
        0: (99, True), 1: (len(PLAIN.encode("one text")), False), 2: (len(PLAIN.encode("four")), False)
    }
    assert spark.read.parquet(cache).count() == 4
    # another tokenizer has counts of its own
    other = public_tokenizers.path("byte_bpe_50k.json")
    got = token_cache.token_counts(spark, docs_of("three", "<|endoftext|>"), other, cache).collect()
    own = Tokenizer.from_file(other)
    assert {r.doc_id: r.n_tokens for r in got} == {
        i: len(own.encode(t, add_special_tokens=False).ids) for i, t in enumerate(("three", "<|endoftext|>"))
    }


def test_counts_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    got = token_cache.token_counts(spark, odd_docs, MODEL, str(tmp_path / "a")).collect()
    by_key = {r.doc_id: r for r in got}
    assert len(got) == 8 and (by_key[0].n_bytes, by_key[0].n_tokens) == (0, 0)
    assert by_key[3].over_limit and by_key[4].n_tokens == len(PLAIN.encode(PROSE))
    assert token_cache.token_counts(spark, no_docs, MODEL, str(tmp_path / "b")).count() == 0


def test_codec_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = piece_codec.encode_pieces(docs, MODEL)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.collect():
        assert r.ids == PLAIN.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.parity and r.round_trip
    back = piece_codec.decode_pieces(tokens, MODEL)
    assert {r.doc_id: r.text for r in back.collect()} == texts


def test_codec_on_strange_texts(docs_of):
    for r in piece_codec.encode_pieces(docs_of(*STRANGE), MODEL).collect():
        text = STRANGE[r.doc_id]
        assert r.ids == PLAIN.encode(text) and r.parity
        assert r.round_trip == (PLAIN.decode(r.ids) == text) == ("▁" not in text)


def test_codec_forgets_words(monkeypatch):
    codec = piece_codec.Codec(MODEL, 1)
    monkeypatch.setattr(piece_codec, "KNOWN_WORDS", 5)
    for text in STRANGE + [PROSE, PROSE.upper(), PROSE]:
        ((ids, same, _),) = codec.encode([text])
        assert same and len(ids) == 4 * len(PLAIN.encode(text))


def test_codec_on_odd_rows(odd_docs, no_docs):
    got = piece_codec.encode_pieces(odd_docs, MODEL).collect()
    assert len(got) == 8 and all(r.parity and r.round_trip for r in got)
    assert {tuple(r.ids) for r in got if r.doc_id in (0, 1)} == {()}
    assert piece_codec.encode_pieces(no_docs, MODEL).count() == 0
    assert piece_codec.decode_pieces(piece_codec.encode_pieces(no_docs, MODEL), MODEL).count() == 0


def test_unigram_models_keep_their_scores():
    """A small unigram model written by hand, with white space squeezed and byte fallback."""

    def message(*parts):
        out = b""
        for number, value in parts:
            if isinstance(value, bytes):
                out += bytes([*varint(number << 3 | 2), *varint(len(value))]) + value
            elif isinstance(value, float):
                import struct

                out += bytes(varint(number << 3 | 5)) + struct.pack("<f", value)
            else:
                out += bytes([*varint(number << 3), *varint(value)])
        return out

    def varint(n):
        out = []
        while n >= 128:
            out.append(n & 127 | 128)
            n >>= 7
        return [*out, n]

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("▁ab", -5.5, 1), ("ba", -4.5, 1)]
    data = b"".join(message((1, message((1, t.encode()), (2, s), (3, k)))) for t, s, k in pieces)
    data += message((2, message((3, 1), (35, 1))), (3, message((3, 1), (4, 1), (5, 1))))
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    fast = piece_codec.build(data)
    for text in ("ab", "abba  ab ", "a b", "ba ab", "abé", "cab"):
        assert fast.encode(text, add_special_tokens=False).ids == model.encode(text), text


def test_a_wrong_id_is_seen():
    """What is decoded are the ids of the text."""
    codec = piece_codec.Codec(MODEL, 1)
    ((ids, same, back),) = codec.encode(["old harbour"])
    assert same and back
    codec.known["harbour"] = codec.known["old"]
    ((wrong, same, back),) = codec.encode(["old harbour"])
    assert wrong != ids and not same and not back
    codec.known["harbour"] = b""
    assert codec.encode(["old harbour"])[0][1:] == (False, False)


def test_own_bytes_decode_as_the_library_does():
    codec = piece_codec.Codec(MODEL, 1)
    texts = [*[t for t in STRANGE if t], "é😀 " * 50, " two  blanks ", "a\n\nb", "<unk> <0x41>"]
    for text, ids in zip(texts, codec._by_word(texts), strict=True):
        assert codec.gives([ids], [text]) == [codec.decode([ids])[0] == text]
        assert codec.gives([ids[:-1]], [text]) == [codec.decode([ids[:-1]])[0] == text]
