"""A small model that tells sentences of a natural language from other text, learned from
documents labelled as a whole.

A text is cut into chunks: lines, then sentences of a line, then stretches of at most
``CHUNK_WORDS`` words. Each chunk gets hashed features (words, endings, pairs of word classes,
shape). A chunk's score goes through a logistic function to its probability of being connected
sentences; the share of a document's non-blank characters that belong to sentences is the mean of
these, weighted by characters. Weights are fitted so that documents labelled prose have a share of
a half or more and others less, with part of every label held back for raters who err.

Many texts are encoded at once: Python cuts them into tokens, each distinct token is looked at once
(``Words``), and everything else is array operations over all tokens of the batch.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np

DIMENSIONS = 1 << 16
CHUNK_WORDS = 24
#: Trust in a label; the rest allows for wrong ones.
TRUST = 0.97
STEEPNESS = 5.0
#: From so many copies of a chunk in a document on, the chunk is repetition and no sentence.
REPEATS = 5
#: Distinct tokens remembered before the memory is begun anew, and characters encoded at once.
MOST_WORDS = 400_000
BATCH_CHARS = 2_000_000

_ENDS = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[^\w\s]|_", re.UNICODE)
_MARKER = re.compile(r"\A\s*(?:>+\s*|[-*•+]\s+(?:\[[ xX]\]\s+)?|\(?\d{1,4}[.)]\s+|#{1,6}\s+)")


def chunks(text: str) -> list[tuple[str, list[str], bool]]:
    """(chunk, its tokens, whether its line carries a marker)."""
    out = []
    for line in text.splitlines():
        if not line or line.isspace():
            continue
        bare = _MARKER.sub("", line)
        marked = len(bare) != len(line)
        for part in _ENDS.split(bare):
            words = _WORD.findall(part)
            if len(words) <= CHUNK_WORDS * 3 // 2:
                if words:
                    out.append((part, words, marked))
                continue
            ends = [m.end() for m in _WORD.finditer(part)]
            cut = 0
            for k in range(0, len(words), CHUNK_WORDS):
                to = ends[min(k + CHUNK_WORDS, len(words)) - 1] if k + CHUNK_WORDS < len(words) else len(part)
                out.append((part[cut:to], words[k : k + CHUNK_WORDS], marked))
                cut = to
    return out


def _bucket(kind: np.ndarray | int, a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """Features of a kind with two numbers, hashed into the dimensions."""
    b = np.atleast_1d(np.asarray(b, np.uint64)) + np.uint64(kind)
    x = (np.atleast_1d(np.asarray(a, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(DIMENSIONS)).astype(np.int32)


class Words(dict):
    """Tokens by number, with what the features need of each, computed once."""

    def __init__(self, common: set[str]):
        self.common, self.rows, self.lower = common, [], {}
        self.table = np.zeros((0, 7), np.int64)

    def __missing__(self, word: str) -> int:
        low = word.lower()
        alpha = low[0].isalpha()
        known = low in self.common
        kind = low if known else "0" if low.isdigit() else low if not alpha else "~" + low[-2:] if len(low) > 3 else "~"
        number = self.lower.setdefault(low, len(self.lower) + 1)
        self.rows.append((zlib.crc32(low.encode()), zlib.crc32(low[-3:].encode()) if len(low) > 4 else -1, zlib.crc32(kind.encode()), len(word) if alpha else 0, alpha and known, len(word), number if not low.isdigit() else 0))
        self[word] = len(self.rows) - 1
        return self[word]

    def attributes(self) -> np.ndarray:
        """Of each token: word, ending and class as hashes, letters, whether common, characters, and
        a number that all numerals share."""
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.int64).reshape(-1, 7)])
        return self.table

    def fresh(self) -> Words:
        return self if len(self.rows) <= MOST_WORDS else Words(self.common)


class Coded(NamedTuple):
    """Features (chunk, where, value) of the chunks, and of each chunk its document, characters, and
    whether it may count as a sentence."""

    chunk: np.ndarray
    where: np.ndarray
    value: np.ndarray
    doc: np.ndarray
    weight: np.ndarray
    fresh: np.ndarray


_OPEN, _SHUT = zlib.crc32(b"^"), zlib.crc32(b"$")
_W, _S, _B, _SHAPES = 1, 2, 3, 10


def encode(texts: list[str], words: Words) -> Coded:
    look = words.__getitem__
    tokens, sizes, docs, ends, flags, copies = [], [], [], [], [], []
    spans = []
    for d, text in enumerate(texts):
        first = len(sizes)
        for part, own, marked in chunks(text):
            tokens.extend(map(look, own))
            sizes.append(len(own))
            bare = part.strip()
            last = bare[-1:]
            ends.append(97 if last.isalnum() else ord(last))
            flags.append((("  " in bare or "\t" in bare), marked, part[:1].isspace()))
        docs += [d] * (len(sizes) - first)
        spans.append((first, len(sizes)))
    table = words.attributes()
    tok, n = np.array(tokens, np.int64), np.array(sizes, np.int64)
    count = len(n)
    stop = np.cumsum(n)
    begin = stop - n
    numbers = table[tok, 6].astype(np.int32) if len(tok) else np.zeros(0, np.int32)
    for a, b in spans:
        if b - a == 1:
            copies.append(1)
            continue
        keys = [numbers[i:j].tobytes() for i, j in zip(begin[a:b], stop[a:b])]
        seen = Counter(keys)
        copies += [seen[k] for k in keys] if len(seen) < len(keys) else [1] * len(keys)
    chunk = np.repeat(np.arange(count), n)
    sums = lambda x: np.bincount(chunk, weights=x, minlength=count)
    word, tail, kind, letters, common, length, _ = table[tok].T if len(tok) else np.zeros((7, 0), np.int64)
    solid, alpha = sums(length), sums(letters)
    n_alpha, n_common = sums(letters > 0), sums(common)
    pairs = np.sort(chunk * (len(words.lower) + 1) + numbers)
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:] != pairs[:-1]
    distinct = np.bincount(pairs[new] // (len(words.lower) + 1), minlength=count) if len(pairs) else np.zeros(count)
    one = np.maximum(n, 1)
    step = lambda x, k: np.minimum(k - 1, (x * k).astype(np.int64))
    shared = step(n_common / np.maximum(n_alpha, 1), 10)
    flag = np.array(flags, np.int64).reshape(-1, 3)
    copied = np.array(copies, np.int64)
    shape = [
        np.minimum(12, n // 2), step(alpha / np.maximum(solid, 1), 8), shared, step(distinct / one, 6), np.minimum(12, (alpha / np.maximum(n_alpha, 1)).astype(np.int64)),
        np.minimum(3, copied - 1), np.array(ends, np.int64), flag[:, 0], flag[:, 1], flag[:, 2], np.minimum(6, n // 4) * 16 + shared // 2,
    ]
    before = np.empty(len(tok), np.int64)
    before[1:] = kind[:-1]
    before[begin] = _OPEN
    long = np.flatnonzero(tail >= 0)
    unit = 6.0 / (n + 4)
    every = np.arange(count)
    where = [_bucket(_W, word), _bucket(_S, tail[long]), _bucket(_B, before, kind), _bucket(_B, kind[stop - 1], _SHUT), *[_bucket(_SHAPES + k, v) for k, v in enumerate(shape)]]
    owner = [chunk, chunk[long], chunk, every, *[every] * len(shape)]
    value = [unit[chunk], unit[chunk[long]], unit[chunk], unit, *[np.full(count, 0.5)] * len(shape)]
    return Coded(np.concatenate(owner).astype(np.int32), np.concatenate(where), np.concatenate(value), np.array(docs, np.int64), solid, copied < REPEATS)


def chunk_scores(coded: Coded, theta: np.ndarray) -> np.ndarray:
    score = np.bincount(coded.chunk, weights=theta[coded.where] * coded.value, minlength=len(coded.weight)) + theta[-1]
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def shares(texts: list[str], words: Words, theta: np.ndarray) -> np.ndarray:
    """Share of each text's non-blank characters that belong to sentences; 0 for a blank text."""
    out, at = np.zeros(len(texts)), 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH_CHARS):
            size += len(texts[to])
            to += 1
        coded = encode(texts[at:to], words)
        total = np.bincount(coded.doc, weights=coded.weight, minlength=to - at)
        part = np.bincount(coded.doc, weights=coded.weight * coded.fresh * chunk_scores(coded, theta), minlength=to - at)
        out[at:to] = part / np.maximum(total, 1)
        at = to
    return out


def fit(coded: Coded, prose: np.ndarray, rounds: int = 400, penalty: float = 1e-3, rate: float = 0.1) -> np.ndarray:
    """Weights from whole-document labels (shares of raters that say prose), by gradient steps
    with adaptive rates. Deterministic."""
    n_docs, n_chunks = len(prose), len(coded.weight)
    if not n_docs:
        return np.zeros(DIMENSIONS + 1)
    total = np.maximum(np.bincount(coded.doc, weights=coded.weight, minlength=n_docs), 1)
    part = coded.weight / total[coded.doc]
    target = (1 - TRUST) + (2 * TRUST - 1) * prose
    balance = np.where(prose >= 0.5, 0.5 / max(1, (prose >= 0.5).sum()), 0.5 / max(1, (prose < 0.5).sum())) * n_docs
    theta, mean, square = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for t in range(1, rounds + 1):
        p = chunk_scores(coded, theta)
        s = np.bincount(coded.doc, weights=part * p, minlength=n_docs)
        q = 1 / (1 + np.exp(-STEEPNESS * (s - 0.5)))
        slope = balance * (q - target) * STEEPNESS / n_docs
        g = slope[coded.doc] * part * p * (1 - p)
        grad = np.zeros(DIMENSIONS + 1)
        grad[:-1] = np.bincount(coded.where, weights=g[coded.chunk] * coded.value, minlength=DIMENSIONS)
        grad[-1] = g.sum()
        grad += penalty * theta / max(1, n_docs) ** 0.5
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta = theta - rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
    assert len(theta) == DIMENSIONS + 1 and n_chunks == len(p)
    return theta
