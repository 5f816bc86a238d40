"""Library tokenizers with a memory of words: the same ids as for whole texts, several times faster."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute

MEMO = 300_000  # words that a Python worker remembers; then it starts anew
#: The same for pieces: one counts by its characters and ``PIECE_COST``; about 400,000 fit, 65 MB of a worker that other
#: steps use as well. A full memory loses its older half.
PIECES_HELD, PIECE_COST = 11_000_000, 16

#: Letters and digits among the characters up to U+02C1, the same in every version of Unicode.
_L, _N = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ˁ", r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: The pre-tokenizer's pattern, written for texts without the characters of ``_RARE``.
_PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_RARE = re.compile(r"[^\x00-\x1b\x20-ˁ‐-‧€]")


class _Memo:
    """Values of words; unknown ones are asked for in one call per batch."""

    def __init__(self, ask):
        self.ask, self.known = ask, {}

    def learn(self, words) -> dict:
        asked = set(words)
        if len(self.known) + len(asked) > MEMO:
            self.known = {}
        missing = list(asked.difference(self.known))
        if missing:
            self.known.update(zip(missing, self.ask(missing), strict=True))
        return self.known


class _Pieces(dict):
    """Ids of pieces; a piece is asked for when it is first looked up, so a known one costs one look-up."""

    def __init__(self, ask):
        self.ask, self.held = ask, 0

    def __missing__(self, piece: str) -> bytes:
        cost = len(piece) + PIECE_COST
        while self and self.held + cost > PIECES_HELD:
            for old in list(islice(self, (len(self) + 1) // 2)):
                del self[old]
                self.held -= len(old) + PIECE_COST
        self.held += cost
        ids = self[piece] = self.ask(piece)
        return ids


def _printable_bytes() -> dict[int, int]:
    """Byte to character as byte-level BPE spells its vocabulary: printable Latin-1 stays, the rest follow U+0100."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in stays]
    return {b: b for b in stays} | {b: 256 + i for i, b in enumerate(moved)}


def _is_plain(definition: dict) -> bool:
    """Whether a text's ids are those of its byte-level pieces, one by one."""
    split, model = definition.get("pre_tokenizer") or {}, definition["model"]
    around = [definition.get(k) for k in ("normalizer", "post_processor", "truncation", "padding")]
    marks = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")]
    return (
        not any(around) and not any(marks) and model.get("type") == "BPE"
        and split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
    )


class ByteBpe:
    """Ids of a byte-level BPE of the tokenizers library, as little-endian unsigned 32-bit integers.

    Merges never cross the pieces of the pre-tokenizer, so a text's ids are those of its pieces. The
    library's model encodes each piece that is not remembered. Texts with characters beyond Latin and
    common punctuation, or with the string of an added token, go to the library as a whole; so do all texts
    if the definition has more than a plain byte-level split before a plain model.
    """

    def __init__(self, definition: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition.decode())
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.spelled = _printable_bytes()
        self.pieces = _Pieces(self._piece)
        self.plain = _is_plain(json.loads(definition))

    def _piece(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self.spelled)
        ids = [t.id for t in self.library.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, text: str) -> bytes:
        if not self.plain or _RARE.search(text) or any(a in text for a in self.added):
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._ids(t) for t in texts]


_WORKER: dict = {}


def in_worker(kind, definition: bytes):
    """The tokenizer of this Python worker; kept with its memory for the worker's later tasks."""
    known = _WORKER.get(kind)
    if known is None or known[0] != definition:
        known = _WORKER[kind] = (definition, kind(definition))
    return known[1]


class PieceCounts:
    """Numbers of pieces by a sentencepiece model.

    A space becomes the mark that starts a piece. If no piece of the model has the mark behind another
    character, no piece spans two words, and the count of a text is the sum over its words. Texts with
    spaces in a row or at an end, or with the mark itself, go to the library as a whole.
    """

    MARK = "\u2581"

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spans = re.compile(f"[^{self.MARK}]{self.MARK}")
        self.by_word = not any(spans.search(self.library.id_to_piece(i)) for i in range(self.library.get_piece_size()))
        self.words = _Memo(self._ask)

    def _ask(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(texts, num_threads=1)]

    def _plain(self, text: str) -> bool:
        return self.by_word and "  " not in text and text[:1] != " " and text[-1:] != " " and self.MARK not in text

    def count(self, texts: list[str]) -> list[int]:
        split = [t.split(" ") if self._plain(t) else None for t in texts]
        words = self.words.learn(chain.from_iterable(w for w in split if w))
        return [self._ask([t])[0] if w is None else sum(map(words.__getitem__, w)) for t, w in zip(texts, split, strict=True)]


def small_batches(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that a task holds few Python values at a time."""
    for batch in batches:
        for a, b in slices(pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist(), most):
            yield batch.slice(a, b - a)


def slices(lengths, most: int):
    """Consecutive ranges of rows whose lengths add up to ``most`` or so, one row at least."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths)
