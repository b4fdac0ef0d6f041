"""SentencePiece models run by the tokenizers library.

The model file (a protobuf) is parsed field by field, and its normaliser, white space
marker, scores and byte fallback are rebuilt from it. Unigram models keep their scores;
for BPE models the merges follow from the scores. Batches are encoded by several
threads. Parity with the sentencepiece library is verified for every text.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MARK = "▁"
# Kinds of pieces and models in the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters encoded at once; their token lists are all that is held besides a batch.
SLICE_CHARS = 2 * 1024 * 1024
DECODE_ROWS = 512
#: Words whose ids a worker keeps.
KNOWN_WORDS = 200_000
ROW = 256
WORD = re.compile(" +[^ ]*")

SCHEMA = "ids array<int>, n_tokens long, parity boolean, round_trip boolean"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield tag >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces ``(text, score, kind)`` and what the tokenizer needs of the two settings messages."""
    model = {
        "pieces": [], "type": UNIGRAM, "byte_fallback": False, "suffix": False,
        "charsmap": b"", "prefix": True, "squeeze": True, "escape": True,
    }
    for number, value in fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model["pieces"].append((text, score, kind))
        elif number == 2:
            for n, v in fields(value):
                name = {3: "type", 24: "suffix", 35: "byte_fallback"}.get(n)
                if name:
                    model[name] = v if name == "type" else bool(v)
        elif number == 3:
            for n, v in fields(value):
                name = {2: "charsmap", 3: "prefix", 4: "squeeze", 5: "escape"}.get(n)
                if name:
                    model[name] = v if name == "charsmap" else bool(v)
    return model


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, the best-scored result first."""
    known = {text: (i, score) for i, (text, score, kind) in enumerate(pieces) if kind == NORMAL}
    found = []
    for text, (i, score) in known.items():
        for cut in range(1, len(text)):
            left, right = text[:cut], text[cut:]
            if left in known and right in known:
                found.append((-score, i, known[left][0], known[right][0], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build(data: bytes):
    """A ``tokenizers.Tokenizer`` that encodes and decodes as the model does."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    model = parse_model(data)
    pieces = model["pieces"]
    if model["suffix"]:
        raise ValueError("models with the marker at the end of words are not supported")
    unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    if model["type"] == UNIGRAM:
        # pieces that text can never give must not be matched in it
        lowest = min(s for _, s, k in pieces if k == NORMAL) - 100.0
        vocabulary = [(t, s if k in (NORMAL, UNKNOWN, USER_DEFINED) else lowest) for t, s, k in pieces]
        core = models.Unigram(vocabulary, unknown, model["byte_fallback"])
    elif model["type"] == BPE:
        core = models.BPE(
            {t: i for i, (t, _, _) in enumerate(pieces)},
            _merges(pieces),
            unk_token=pieces[unknown][0],
            fuse_unk=True,
            byte_fallback=model["byte_fallback"],
        )
    else:
        raise ValueError("only unigram and BPE models are supported")
    tokenizer = Tokenizer(core)
    steps = []
    if model["charsmap"]:
        steps.append(normalizers.Precompiled(model["charsmap"]))
    if model["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["prefix"]:
        steps.append(normalizers.Prepend(MARK if model["escape"] else " "))
    if model["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        + ([decoders.Strip(" ", 1, 0)] if model["prefix"] else [])
    )
    own = [AddedToken(t, normalized=False, special=False) for t, _, k in pieces if k == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    return tokenizer


def splits_at_marks(model: dict) -> bool:
    """Whether a text's ids are those of its words, one after another.

    That is so if no piece reaches over the start of a run of markers: then neither the
    merges nor the best path of a unigram model join what stands before and after it.
    """
    usable = [t for t, _, k in model["pieces"] if k in (NORMAL, USER_DEFINED)]
    inner = any(b == MARK != a for t in usable for a, b in zip(t, t[1:], strict=False))
    plain = not (model["charsmap"] or model["squeeze"]) and model["prefix"] and model["escape"]
    return plain and not inner and MARK in usable


class Codec:
    """One model in both libraries, with the ids of words seen lately."""

    def __init__(self, path: str, threads: int) -> None:
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        model = parse_model(data)
        self.threads = threads
        self.fast = build(data)
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.by_word = splits_at_marks(model)
        self.pieces = np.array(
            [bytes([int(t[1:-1], 16)]) if k == BYTE else t.encode() for t, _, k in model["pieces"]], dtype=object
        )
        self.starts = np.array([t.startswith(MARK) for t, _, _ in model["pieces"]])
        mark = np.array([self.plain.piece_to_id(MARK)], dtype=np.int32)
        #: Ids of a word as int32 bytes; a space with nothing behind it is an empty word.
        self.known: dict[str, bytes] = {"": mark.tobytes()}
        #: What each piece stands for in a text.
        self.shown = np.array([p.replace(MARK.encode(), b" ") for p in self.pieces], dtype=object)
        self.prefix = model["prefix"]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.fast.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts by the tokenizers library."""
        return self.fast.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)

    def gives(self, ids: list[np.ndarray], texts: list[str]) -> list[bool]:
        """Whether ids decode to texts.

        The bytes of a text's pieces, joined, mostly settle it; where they are not the text's, the
        library decodes the ids.
        """
        made = (b"".join(self.shown[x].tolist()) for x in ids)
        same = [(m[1:] if self.prefix and m[:1] == b" " else m) == t.encode() for m, t in zip(made, texts, strict=True)]
        open_ = [i for i, s in enumerate(same) if not s]
        for i, back in zip(open_, self.decode([ids[i] for i in open_]), strict=True):
            same[i] = back == texts[i]
        return same

    def _learn(self, words: list[str]) -> None:
        """Enter the ids of new words: in long rows of words, cut where a word's first piece is."""
        plain = [w for w in words if w[:1] != " " and w]
        for at in range(0, len(plain), ROW * 64):
            rows = [plain[i : i + ROW] for i in range(at, min(at + ROW * 64, len(plain)), ROW)]
            texts = [" ".join(r) for r in rows]
            for row, text, ids in zip(rows, texts, self._ids(texts), strict=True):
                made = b"".join(self.pieces[ids]).replace(MARK.encode(), b" ")[1:]
                cuts = np.flatnonzero(self.starts[ids])
                if len(cuts) != len(row) or made != text.encode():
                    self._learn_each(row)
                    continue
                data, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                self.known.update((w, data[ends[i] : ends[i + 1]]) for i, w in enumerate(row))
        self._learn_each([w for w in words if w[:1] == " "])

    def _learn_each(self, words: list[str]) -> None:
        self.known.update((w, x.tobytes()) for w, x in zip(words, self._ids(words), strict=True))

    def _by_word(self, texts: list[str]) -> list[np.ndarray]:
        split = [_words(t) for t in texts]
        every = set(chain.from_iterable(split))
        new = list(every - self.known.keys())
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known = {w: self.known[w] for w in (every & self.known.keys()) | {""}}
        self._learn(new)
        ids_of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids_of, words)), dtype=np.int32) for words in split]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """Ids (int32 bytes), parity, and whether the ids give the text back."""
        mine = self._by_word(texts) if self.by_word else self._ids(texts)
        back = self.gives(mine, texts)
        theirs = self.plain.encode(texts, num_threads=self.threads)
        return [
            (ids.tobytes(), len(ids) == len(same) and bool((ids == np.array(same, dtype=np.int32)).all()), b)
            for ids, b, same in zip(mine, back, theirs, strict=True)
        ]


def _words(text: str) -> list[str]:
    """The parts of a text that are encoded for themselves; a space stands between any two."""
    if "  " not in text and MARK not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    # a part keeps all spaces (or markers) in front of it but the first
    return [w[1:] for w in WORD.findall(" " + text.replace(MARK, " "))]


@lru_cache(maxsize=4)
def load(path: str, threads: int) -> Codec:
    return Codec(path, threads)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > SLICE_CHARS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def encode_pieces(
    docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", threads: int = 2
) -> DataFrame:
    """Token ids of every text, without begin or end marks.

    Gives ``key``, ``ids``, ``n_tokens``, ``parity`` and ``round_trip`` (the ids decode to the
    text; a marker character inside a text comes back as a space, and models that squeeze
    white space or change letters do not always allow it).

    If no piece of the model reaches over a space, each distinct word of a batch is encoded
    once and a text's ids are those of its words. ``parity`` says that the sentencepiece
    library gives the same ids for the text as a whole; it is worked out for every text.

    ``round_trip`` comes from decoding the ids of the whole text. Null and empty texts have no ids.
    Repeated keys give a row each, an empty table gives an empty one, other columns are not read. ``model_path`` must be readable on every executor.
    """

    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        codec = load(model_path, threads)
        for keys, raws in batches:
            at = 0
            for part in _slices([(r or b"").decode("utf-8", "replace") for r in raws]):
                ids, same, back = map(list, zip(*codec.encode(part), strict=True))
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield [keys[at : at + len(part)], pa.ListArray.from_arrays(ends, values), pa.array(sizes), same, back]
                at += len(part)

    kind = docs.schema[key].dataType.simpleString()
    return map_texts(docs, [key, text], work, f"`{key}` {kind}, {SCHEMA}")


def decode_pieces(
    tokens: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids", threads: int = 2
) -> DataFrame:
    """``key`` and the ``text`` that the ids stand for, by the tokenizers library.

    Null and empty ids give an empty text. Repeated keys give a row each, an empty table gives an
    empty one, other columns are not read.
    """

    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        codec = load(model_path, threads)
        for keys, lists in batches:
            for at in range(0, len(keys), DECODE_ROWS):
                part = [x or [] for x in lists[at : at + DECODE_ROWS]]
                yield [keys[at : at + DECODE_ROWS], codec.fast.decode_batch(part, skip_special_tokens=False)]

    kind = tokens.schema[key].dataType.simpleString()
    chosen = tokens.select(F.col(key), F.col(ids).cast("array<int>").alias(ids))
    return map_texts(chosen, [key, ids], work, f"`{key}` {kind}, text string")
