"""Character-level bidirectional LSTM with CRF transitions, in numpy.

One model serves training (pii_train.py) and tagging (pii.py).  A character enters as a row of
a learned table, chosen by its folded form, plus a row for each of four flags: upper case,
accented, part of a known given name, part of a known family name.  The two LSTM directions
give a score per tag, the CRF adds tag transitions, and Viterbi finds the best tag sequence.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa

from lodestone.llm import textcodes as tc

KINDS = ("email", "phone", "id_number", "address", "name")
TAGS = 1 + 2 * len(KINDS)  # 0 outside, 1 + 2k begins kind k, 2 + 2k goes on with it
ALPHABET = "\n abcdefghijklmnopqrstuvwxyz0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PAD, LETTER, OTHER = 0, len(ALPHABET) + 1, len(ALPHABET) + 2
SYMBOLS = OTHER + 1
FLAGS = 4
WEIGHTS = Path(__file__).with_name("pii_weights.npz")


@lru_cache(maxsize=1)
def _fold() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, flag bits and folded code point of each code point below 0x2100; more are OTHER or LETTER."""
    n = 0x2100
    symbol, flags, base = np.full(n, OTHER, np.int64), np.zeros(n, np.int64), np.arange(n, dtype=np.uint32)
    index = {c: i + 1 for i, c in enumerate(ALPHABET)}
    for cp in range(n):
        ch = chr(cp)
        plain = unicodedata.normalize("NFD", ch)[0]
        low = plain.lower()[0]
        if ch == "\n":
            symbol[cp] = index["\n"]
        elif ch.isspace():
            symbol[cp] = index[" "]
        elif unicodedata.category(ch) == "Pd":
            symbol[cp] = index["-"]
        elif ch in "‘’":
            symbol[cp] = index["'"]
        else:
            symbol[cp] = index.get(low, LETTER if ch.isalpha() else OTHER)
        flags[cp] = (ch.isupper()) + 2 * (plain != ch)
        if ch.isalpha():
            base[cp] = ord(low)
    return symbol, flags, base


def folded(codes: np.ndarray) -> np.ndarray:
    """Code points with accents and case removed."""
    _, _, base = _fold()
    return np.where(codes < len(base), base[np.minimum(codes, len(base) - 1)], codes)


def name_hashes(parts: list[str]) -> np.ndarray:
    """Sorted hashes of the letter runs of three or more letters in known name parts."""
    if not parts:
        return np.zeros(0, np.uint64)
    return np.unique(word_hashes(pa.array(parts, pa.string()))[0])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each letter run of three or more letters in the texts, and the number of its text."""
    codes, begins = tc.codes_of(texts)
    hashes, starts, lengths = _runs(folded(codes), begins)
    return hashes[lengths >= 3], (np.searchsorted(begins, starts, "right") - 1)[lengths >= 3]


def _runs(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = tc.kinds(codes) == tc.LETTER
    edge = np.zeros(len(codes) + 1, bool)
    edge[begins] = True
    left, right = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    start = np.flatnonzero(inside & (~left | edge[:-1]))
    end = np.flatnonzero(inside & (~right | edge[1:])) + 1
    prefix = tc.prefix_hash(codes)
    return tc.span_hash(prefix, start, end), start, end - start


def inputs(codes: np.ndarray, begins: np.ndarray, given: np.ndarray, family: np.ndarray) -> np.ndarray:
    """symbol * 16 + flags of each character."""
    symbol, flags, base = _fold()
    small = np.minimum(codes, len(base) - 1)
    known = codes < len(base)
    s = np.where(known, symbol[small], np.where(tc.kinds(codes) == tc.LETTER, LETTER, OTHER))
    f = np.where(known, flags[small], 0)
    hashes, start, length = _runs(folded(codes), begins)
    bits = 4 * np.isin(hashes, given) + 8 * np.isin(hashes, family)
    hit = np.flatnonzero(bits)
    for b, a, n in zip(bits[hit], start[hit], length[hit]):
        f[a : a + n] |= b
    return s * 16 + f


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


@lru_cache(maxsize=1)
def weights() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as z:
        return dict(z)


#: Tags in the order of Viterbi's arrays: outside, beginnings, goings-on.
ORDER = np.array([0, *range(1, TAGS, 2), *range(2, TAGS, 2)])
HEADS = 1 + len(KINDS)
NEVER = np.float32(-1e4)


class Tagger:
    """Scores and best tags of windows; all arrays are (steps, ..., rows).

    sigmoid(z) = (tanh(z / 2) + 1) / 2: halving those gates' weights leaves one tanh for all, and
    states are kept doubled, so that no gate is halved on its own.  Each gate has an array of its
    own, because short steps over parts of rows cost more than their arithmetic.
    """

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = {k: v.astype(np.float32) for k, v in params.items()}
        H = self.p["rec0"].shape[0]
        half = np.array([0.5, 0.5, 0.5, 1], np.float32)[:, None, None]
        gates = lambda w: np.ascontiguousarray(w.reshape(len(w), 4, H).transpose(1, 0, 2)) * half
        bits = ((np.arange(16)[:, None] >> np.arange(FLAGS)) & 1).astype(np.float32)
        self.rec = [gates(self.p[f"rec{d}"]) * np.float32(0.5) for d in (0, 1)]
        self.table = [gates((self.p[f"char{d}"][:, None, :] + bits @ self.p[f"flag{d}"]).reshape(SYMBOLS * 16, -1)) for d in (0, 1)]
        self.out = [np.ascontiguousarray((self.p[f"out{d}"] * np.float32(0.5))[:, ORDER]) for d in (0, 1)]
        # a kind goes on only behind its beginning or itself
        trans, start = self.p["trans"][ORDER][:, ORDER].copy(), self.p["start"][ORDER].copy()
        start[HEADS:] = NEVER
        for k in range(len(KINDS)):
            others = np.ones(TAGS, bool)
            others[[1 + k, HEADS + k]] = False
            trans[others, HEADS + k] = NEVER
        self.trans, self.start = trans, start

    @classmethod
    def load(cls) -> Tagger:
        return cls(weights())

    def _direction(self, d: int, x: np.ndarray) -> np.ndarray:
        """Doubled states of direction d (steps, rows, hidden); x is (steps, rows).

        All work arrays are made once: a step is short, and fresh memory would cost more than it.
        """
        steps, rows = x.shape
        U, table = self.rec[d], self.table[d]
        H = U.shape[1]
        states = np.empty((steps, rows, H), np.float32)
        z, zu = np.empty((4, rows, H), np.float32), np.empty((4, rows, H), np.float32)
        h, c, t2 = (np.zeros((rows, H), np.float32) for _ in range(3))
        i, f, o, g = z
        sigmoids = z[:3]
        live = (x != 0).astype(np.float32)[:, :, None]
        padded = np.flatnonzero(~(x != 0).all(1))
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            np.take(table, x[t], axis=1, out=z, mode="clip")
            np.matmul(h, U, out=zu)
            z += zu
            np.tanh(z, out=z)
            sigmoids += 1
            c *= f
            i *= g
            c += i
            c *= np.float32(0.5)
            if d and len(padded) and t >= padded[0]:  # padding stands at the end, so the backward direction begins with it
                c *= live[t]
            np.tanh(c, out=t2)
            h = states[t]
            np.multiply(o, t2, out=h)
        return states

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(steps, TAGS in ORDER, rows) from inputs (steps, rows), 0 being padding."""
        steps, rows = x.shape
        out = np.zeros((steps * rows, TAGS), np.float32) + self.p["bias"][ORDER]
        for d in (0, 1):
            out += self._direction(d, x).reshape(steps * rows, -1) @ self.out[d]
        return np.ascontiguousarray(out.reshape(steps, rows, TAGS).transpose(0, 2, 1))

    def _forward(self, e: np.ndarray, live: np.ndarray, first: np.ndarray, keep: bool):
        """Best scores of paths that end in each tag, (tags, starts, rows), and those of all steps
        if asked.  ``first`` (tags, starts, rows) is what a path scores before it meets e[0]."""
        T = self.trans
        to_head = T[:, :HEADS, None, None]
        begins = T[np.arange(1, HEADS), np.arange(HEADS, TAGS)][:, None, None]
        goes_on = T[np.arange(HEADS, TAGS), np.arange(HEADS, TAGS)][:, None, None]
        best = first + e[0][:, None, :]
        every = np.empty((len(e), *best.shape), np.float32) if keep else None
        work, top = np.empty((TAGS, HEADS, *best.shape[1:]), np.float32), np.empty_like(best)
        whole = live.all(1)
        if keep:
            every[0] = best
        for t in range(1, len(e)):
            np.add(best[:, None], to_head, out=work)
            np.maximum.reduce(work, axis=0, out=top[:HEADS])
            np.maximum(best[1:HEADS] + begins, best[HEADS:] + goes_on, out=top[HEADS:])
            top += e[t][:, None, :]
            if not whole[t]:
                np.copyto(top, best, where=~live[t])
            best, top = top, best
            if keep:
                every[t] = best
        return best, every

    def transfers(self, e: np.ndarray, live: np.ndarray) -> np.ndarray:
        """(rows, tag before, last tag): the best score of each part of a text between any two tags;
        the last of the tags before stands for the beginning of a text."""
        first = np.repeat(np.concatenate([self.trans.T, self.start[:, None]], axis=1)[:, :, None], e.shape[2], axis=2)
        return self._forward(e, live, first, False)[0].transpose(2, 1, 0)

    def best(self, e: np.ndarray, live: np.ndarray, before: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Best tags (steps, rows), in the numbering of the labels; steps beyond a row's end repeat
        its last one.  ``before`` and ``last`` (in ORDER) are the tag in front, -1 at the beginning of a
        text, and the tag at the end, if it is known."""
        rows = e.shape[2]
        first = np.repeat(self.start[:, None], rows, axis=1) if before is None else np.where(before < 0, self.start[:, None], self.trans.T[:, before])
        end, every = self._forward(e, live, first[:, None, :], True)
        at = end[:, 0].argmax(0) if last is None else last
        tags = np.empty((len(e), rows), np.int8)
        tags[-1] = at
        for t in range(len(e) - 1, 0, -1):
            from_ = (every[t - 1][:, 0] + self.trans[:, at]).argmax(0)
            at = np.where(live[t], from_, at)
            tags[t - 1] = at
        return ORDER.astype(np.int8)[tags]
