"""Language of words and documents by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtlake.llm.common import below_share, stored
from courtlake.llm.token_memo import slices

BUCKETS = 1 << 16  # hashed letter n-grams, one table for 3-grams and one for 4-grams
LEXICON = 500  # commonest words of each language in the sample that have a weight of their own
BLOCK = 64  # words that the forward-backward pass takes at a time in each stretch
CHARS = 1_000_000
PIECE = 1_000_000  # letters or words, times languages, whose scores are held at a time

#: Defaults of ``train``: documents of each language at most, and characters of each document's stretch.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 400, 1400
STEPS, SEQUENCES, LENGTH, RATE = 250, 48, 64, 0.5

_LETTER = re.compile(r"[^\W\d_]")
#: Byte to letter code: ASCII letters and all bytes of other characters; 0 for what separates words.
_CODES = np.array([c if 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint64)
_PLACE = np.random.default_rng(5).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Words:
    """The words of some texts: features by letter, and where words and texts begin."""

    three: np.ndarray  # bucket of the 3-gram around each letter; at the edges it is an affix
    four: np.ndarray
    first: np.ndarray  # the first letter of each word
    whole: np.ndarray  # hash of each word
    counts: np.ndarray  # words of each text


def words_of(texts: list[str]) -> Words:
    data = np.frombuffer(("\0\0" + "\0\0".join(texts) + "\0\0").lower().encode(), np.uint8)
    codes = _CODES[data]
    at = np.flatnonzero(codes)
    c, left, right, next_right = codes[at], codes[at - 1], codes[at + 1], codes[np.minimum(at + 2, len(codes) - 1)]
    next_right = np.where(right > 0, next_right, 0)
    gram = (left << np.uint64(16)) | (c << np.uint64(8)) | right
    shift = np.uint64(48)
    three = ((gram * _A) >> shift).astype(np.int64)
    four = ((((gram << np.uint64(8)) | next_right) * _B) >> shift).astype(np.int64)
    first = np.flatnonzero(left == 0)
    lengths = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    whole = np.add.reduceat((c + np.uint64(1)) * _PLACE[np.minimum(place, 63)], first) if len(first) else np.empty(0, np.uint64)
    # a text's end: two zero bytes; words are counted by the text that holds their first letter
    sizes = np.fromiter((len(t.lower().encode()) for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 2) + 2
    counts = np.diff(np.searchsorted(at[first], ends), prepend=0)
    return Words(three, four, first, whole, counts)


@dataclass
class Field:
    """Weights of the features by language, and of the transitions."""

    labels: list[str]
    three: np.ndarray
    four: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    word: np.ndarray  # a weight row per word of the lexicon, and a last row of zeros
    transitions: np.ndarray

    def in_lexicon(self, whole: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.lexicon, whole), max(len(self.lexicon) - 1, 0))
        return np.where(self.lexicon[at] == whole, at, len(self.lexicon)) if len(self.lexicon) else np.zeros(len(whole), int)

    def emissions(self, words: Words, a: int, b: int) -> np.ndarray:
        """Scores of the words from ``a`` to ``b``; a word longer than a piece is summed piece by piece."""
        first, end, most = words.first[a:b], np.append(words.first, len(words.three))[a + 1 : b + 1], max(1, PIECE // len(self.labels))
        out = self.word[self.in_lexicon(words.whole[a:b])]
        for i, j in _ranges(end - first, most):
            for low in range(first[i], end[j - 1], most):
                high = min(low + most, end[j - 1])
                letters = self.three[words.three[low:high]] + self.four[words.four[low:high]]
                out[i:j] += np.add.reduceat(letters, np.maximum(first[i:j] - low, 0), axis=0)
        return out

    def shares(self, texts: list[str]) -> np.ndarray:
        """Expected share of each language among the words of each text; zeros without words.

        Memory is bounded by words times languages, whatever the length of a text or the number of languages.
        """
        words, k = words_of(texts), len(self.labels)
        most = max(1, PIECE // k // BLOCK) * BLOCK
        first, sums = np.cumsum(words.counts) - words.counts, np.zeros((len(texts), k))
        for i, j in _ranges(words.counts, most):
            a, b = first[i], first[j - 1] + words.counts[j - 1]
            if b - a > most:
                sums[i] = self._long(words, a, b, most)
            else:
                sums[i:j] = marginal_sums(self.emissions(words, a, b), self.transitions, words.counts[i:j])
        return sums / np.maximum(words.counts, 1)[:, None]

    def _long(self, words: Words, a: int, b: int, most: int) -> np.ndarray:
        """``marginal_sums`` of one text in pieces: states are carried over them, then each runs by itself."""
        pieces = [(c, min(c + most, b)) for c in range(a, b, most)]
        products = [whole_product(self.emissions(words, *piece), self.transitions) for piece in pieces]
        before, after = [np.ones(len(self.labels))], [np.ones(len(self.labels))]
        for p in products[:-1]:
            before.append(_unit(before[-1] @ p, 0))
        for p in reversed(products[1:]):
            after.append(_unit(p @ after[-1], 0))
        parts = zip(pieces, before, reversed(after), strict=True)
        return sum(marginal_sums(self.emissions(words, *piece), self.transitions, np.array([piece[1] - piece[0]]), s, t)[0] for piece, s, t in parts)


def _ranges(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges that cover ``sizes``, of sum ``most`` or less, or of one entry."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _likelihoods(emissions: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(emissions - emissions.max(axis=-1, keepdims=True), -60)).astype(np.float64)


def _unit(x: np.ndarray, axes) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def _products(e: np.ndarray, step: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """What each block of words makes of any state before it, up to a factor."""
    product = np.broadcast_to(np.eye(len(step)), (len(e), *step.shape)).copy()
    for t in range(BLOCK):
        product = np.where(valid[:, t, None, None], _unit((product @ step) * e[:, t, None, :], (1, 2)), product)
    return product


def whole_product(emissions: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """What a run of words makes of any state before it, up to a factor."""
    step, n = np.exp(transitions - transitions.max()).astype(np.float64), len(emissions)
    places = np.arange(-(-n // BLOCK) * BLOCK).reshape(-1, BLOCK)
    out = np.eye(len(step))
    for product in _products(_likelihoods(emissions[np.minimum(places, n - 1)]), step, places < n):
        out = _unit(out @ product, (0, 1))
    return out


def marginal_sums(emissions: np.ndarray, transitions: np.ndarray, counts: np.ndarray, left: np.ndarray | float = 1.0, right: np.ndarray | float = 1.0) -> np.ndarray:
    """Per text, the sum over its words of the label probabilities by forward-backward.

    ``left`` and ``right`` are the states that other pieces of the texts hand over at their ends. Texts are
    cut into blocks. A block's product of transition matrices says what it makes of any state before it; those products are chained along each text, and then all blocks run side by side from
    their true states. This is the plain algorithm in another order, for texts of any length.
    """
    k, step = len(transitions), np.exp(transitions - transitions.max()).astype(np.float64)
    blocks = -(-counts // BLOCK)
    n = int(blocks.sum())
    if not n:
        return np.zeros((len(counts), k))
    owner, first = np.repeat(np.arange(len(counts)), blocks), np.cumsum(blocks) - blocks
    inner = np.arange(n) - first[owner]
    start = (np.cumsum(counts) - counts)[owner] + inner * BLOCK
    length = np.minimum(counts[owner] - inner * BLOCK, BLOCK)
    places = start[:, None] + np.arange(BLOCK)
    valid = np.arange(BLOCK) < length[:, None]
    e = _likelihoods(emissions[np.where(valid, places, 0)])

    product = _products(e, step, valid)
    before, after = np.ones((n, k)), np.ones((n, k))
    before[inner == 0], after[inner == blocks[owner] - 1] = left, right
    for j in range(1, int(blocks.max())):
        here = first[blocks > j] + j
        before[here] = _unit(np.einsum("bi,bij->bj", before[here - 1], product[here - 1]), 1)
    for j in range(int(blocks.max()) - 1, 0, -1):
        here = first[blocks > j] + j
        after[here - 1] = _unit(np.einsum("bij,bj->bi", product[here], after[here]), 1)

    forward, state = np.empty((BLOCK, n, k)), before
    for t in range(BLOCK):
        state = np.where(valid[:, t, None], _unit((state @ step) * e[:, t], 1), state)
        forward[t] = state
    sums, state = np.zeros((n, k)), after
    for t in range(BLOCK - 1, -1, -1):
        sums += np.where(valid[:, t, None], _unit(forward[t] * state, 1), 0)
        state = np.where(valid[:, t, None], _unit((e[:, t] * state) @ step.T, 1), state)
    out = np.zeros((len(counts), k))
    np.add.at(out, owner, sums)
    return out


def _gradient(emissions: np.ndarray, transitions: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood of sequences of one length: by word and label, and by transition."""
    n, length, k = emissions.shape
    step, e = np.exp(transitions - transitions.max()), _likelihoods(emissions)
    forward, backward = np.empty(e.shape), np.ones(e.shape)
    state = np.ones((n, k))
    for t in range(length):
        forward[:, t] = state = _unit((state @ step) * e[:, t], 1)
    for t in range(length - 1, 0, -1):
        backward[:, t - 1] = _unit((e[:, t] * backward[:, t]) @ step.T, 1)
    truth = np.eye(k)[labels]
    words = truth - _unit(forward * backward, 2)
    pairs = _unit(forward[:, :-1, :, None] * step * (e * backward)[:, 1:, None, :], (2, 3))
    return words, np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:]) - pairs.sum(axis=(0, 1))


def fit(stretches: list[str], labels: list[str]) -> Field:
    """Learn from stretches of text in one language each, by stochastic gradient ascent with Adagrad.

    Training sequences are code-switched: runs of 4 to 30 words from random stretches follow each other,
    so the transitions learn that languages do switch, but seldom.
    """
    names = sorted(set(labels))
    words, draw, k = words_of(stretches), np.random.default_rng(3), len(names)
    counts, label_of = words.counts, np.array([names.index(x) for x in labels])
    word_label = np.repeat(label_of, counts)
    common = [np.unique(words.whole[word_label == i], return_counts=True) for i in range(k)]
    lexicon = np.unique(np.concatenate([v[np.lexsort((v, -c))[:LEXICON]] for v, c in common]))
    tables = [np.zeros((BUCKETS, k), np.float32), np.zeros((BUCKETS, k), np.float32), np.zeros((len(lexicon) + 1, k), np.float32), np.zeros((k, k), np.float32)]
    squares = [np.full(t.shape, 0.1, np.float32) for t in tables]
    field = Field(names, tables[0], tables[1], lexicon, tables[2], tables[3])
    lex = field.in_lexicon(words.whole)
    starts, usable = np.cumsum(counts) - counts, np.flatnonzero(counts)
    by_label = [usable[label_of[usable] == i] for i in range(k)]
    by_label = [b for b in by_label if len(b)]
    letters = np.diff(words.first, append=len(words.three))

    def sequence() -> np.ndarray:
        out: list[int] = []
        while len(out) < LENGTH:
            text = draw.choice(by_label[draw.integers(len(by_label))])
            run = min(int(draw.integers(4, 31)), counts[text])
            a = starts[text] + draw.integers(0, counts[text] - run + 1)
            out += range(a, a + run)
        return np.array(out[:LENGTH])

    for _ in range(STEPS if by_label else 0):
        chosen = np.concatenate([sequence() for _ in range(SEQUENCES)])
        reach = letters[chosen]
        owner = np.repeat(np.arange(len(chosen)), reach)
        at = np.repeat(words.first[chosen] - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())
        letter_scores = field.three[words.three[at]] + field.four[words.four[at]]
        emissions = np.add.reduceat(letter_scores, np.cumsum(reach) - reach, axis=0) + field.word[lex[chosen]]
        by_word, by_pair = _gradient(emissions.reshape(SEQUENCES, LENGTH, k).astype(np.float64), field.transitions, word_label[chosen].reshape(SEQUENCES, LENGTH))
        by_word = by_word.reshape(-1, k) / SEQUENCES
        for table, square, index, gradient in (
            (tables[0], squares[0], words.three[at], by_word[owner]), (tables[1], squares[1], words.four[at], by_word[owner]), (tables[2], squares[2], lex[chosen], by_word),
        ):
            rows, inverse = np.unique(index, return_inverse=True)
            total = np.stack([np.bincount(inverse, gradient[:, j], len(rows)) for j in range(k)], axis=1)
            square[rows] += total**2
            table[rows] += RATE * total / np.sqrt(square[rows])
        tables[2][-1] = 0  # words beyond the lexicon
        gradient = by_pair / SEQUENCES
        squares[3] += gradient**2
        tables[3] += RATE * gradient / np.sqrt(squares[3])
    return field


def train(
    documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_documents: int = SAMPLE_DOCUMENTS, sample_chars: int | None = SAMPLE_CHARS
) -> Field | None:
    """Fit on ``sample_documents`` documents of each language, of least md5 of key and text; None without any.

    A long text gives a stretch of ``sample_chars`` characters from a place that depends on that md5, or is
    taken whole if that is None. Rows with a null language or text are not used. Counts per language set a
    hash threshold first.
    """
    order = Window.partitionBy("label").orderBy("hash", "text")
    rows = documents.select(F.col(lang).alias("label"), F.col(text).alias("text"), F.md5(F.concat_ws(":", F.col(key).cast("string"), F.md5(F.col(text)))).alias("hash"))
    rows = rows.where(F.col("label").isNotNull() & F.col("text").isNotNull())
    totals = stored(rows.groupBy("label").agg(F.count("*").alias("rows")), "languages")  # of known size: no shuffle of texts
    rows = rows.join(totals, "label").where(below_share(F.col("hash"), sample_documents, F.col("rows")))
    if sample_chars is not None:
        place = F.conv(F.substring("hash", 17, 6), 16, 10).cast("double") / float(16**6)
        start = F.floor(F.greatest(F.length("text") - sample_chars, F.lit(0)) * place).cast("int") + 1
        rows = rows.select("label", "hash", F.substr(F.col("text"), start, F.lit(sample_chars)).alias("text"))
    sample = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_documents).select("label", "hash", "text").toArrow()
    if not len(sample):
        return None
    sample = sample.sort_by([("label", "ascending"), ("hash", "ascending"), ("text", "ascending")])
    return fit(sample.column("text").to_pylist(), sample.column("label").to_pylist())


def _labeller(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Field | None = field.value
        for batch in batches:
            texts, names, scores = batch.column("text"), [], []
            for a, b in slices(pa.compute.binary_length(texts).to_pylist(), CHARS):
                part = texts.slice(a, b - a).to_pylist()
                shares = model.shares(part) if model else np.zeros((len(part), 1))
                for text, share in zip(part, shares, strict=True):
                    sure = model is not None and share.sum() > 0 and _LETTER.search(text)
                    names.append(model.labels[int(share.argmax())] if sure else "und")
                    scores.append(min(1.0, float(share.max())) if sure else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["kept", "lang_pred", "score"])

    return run


def languages(documents: DataFrame, field: Field | None, keep: list[str], text: str = "text") -> DataFrame:
    """One row per document: ``kept`` (a struct of the ``keep`` columns), lang_pred, score.

    Every word of the whole text is labelled by forward-backward over the text's words; lang_pred is the
    language with the largest expected share of the words, and score that share. A word's score in a
    language adds up its letter 3-grams and 4-grams (at its edges they are affixes) and its entry in the
    lexicon. Null and empty texts, texts without a letter, and all texts if there was nothing to learn
    from are ``und`` with score 0. Of equal shares the first language by name wins.
    """
    shared = documents.sparkSession.sparkContext.broadcast(field)  # fixed size: tables of hashed features
    rows = documents.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(_labeller(shared), f"kept {rows.schema['kept'].dataType.simpleString()}, lang_pred string, score double")
