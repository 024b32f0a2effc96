"""Token ids of whole Arrow columns by a public BPE vocabulary, one vocabulary lookup per distinct word.

The word BPE splits a text into letter runs, single digits, sign runs and English endings before it merges, and merges each of
these alone.  So the splitting is done here on bytes, and only words not seen before go to the tokenizer.  A text with a
character outside ASCII and the Latin letters of U+00C0..U+017F, or with a control token's string, goes to it whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quartzite.llm.scan import CHUNK, LOWER, NON_SPACE, pieces, same_spans, span_hashes, text_chunks

#: Distinct words that a Python worker remembers, some 150 bytes each; at this number it starts anew.
CACHE_WORDS = 250_000

LETTER, DIGIT, SPACE, OTHER = 1, 2, 0, 3
_KIND = np.full(256, OTHER, np.uint8)
_KIND[97:123] = LETTER
_KIND[65:91] = LETTER
_KIND[128:] = LETTER
_KIND[48:58] = DIGIT
_KIND[9:14] = SPACE
_KIND[32] = SPACE
_ODD = np.zeros(256, bool)
_ODD[[0xC2, *range(0xC6, 0x100)]] = True


class WordBPE:
    """Encoder equal to `Tokenizer.encode(text, add_special_tokens=False).ids` for the vocabulary file at `path`."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each hold memory, too
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.control = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        ends = [i for t, i in self.whole.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.is_end = np.zeros(max(ends) + 1 + len(self.control), bool)
        self.is_end[ends] = True
        self._reset()

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 16, np.int32), 0
        self.first, self.count, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _learn(self, keys: list[bytes]) -> None:
        words = [k.decode() for k in keys]
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            for enc, j in zip(self.whole.encode_batch_fast([" ".join(part[j : j + 100]) for j in range(0, len(part), 100)], add_special_tokens=False), range(0, len(part), 100), strict=True):
                ids = np.array(enc.ids, np.int32)
                at = np.flatnonzero(self.is_end[ids]) + 1
                if len(at) != len(part[j : j + 100]):  # can't be told apart: one by one
                    each = [np.array(self.whole.encode(w, add_special_tokens=False).ids, np.int32) for w in part[j : j + 100]]
                    ids, at = np.concatenate(each), np.cumsum([len(x) for x in each])
                n, m = len(at), len(ids)
                while self.n + n > len(self.first):
                    self.first, self.count = np.concatenate([self.first, self.first]), np.concatenate([self.count, self.count])
                while self.n_ids + m > len(self.ids):
                    self.ids = np.concatenate([self.ids, self.ids])
                self.ids[self.n_ids : self.n_ids + m] = ids
                starts = np.concatenate([[0], at[:-1]])
                self.first[self.n : self.n + n], self.count[self.n : self.n + n] = self.n_ids + starts, at - starts
                self.n, self.n_ids = self.n + n, self.n_ids + m
        self.index.update(zip(keys, range(self.n - len(words), self.n), strict=True))

    def _plain(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Per document: every byte is one that this class splits itself."""
        bad = _ODD[raw]
        lead = np.flatnonzero((raw == 0xC3) | (raw == 0xC4))
        nxt = raw[np.minimum(lead + 1, len(raw) - 1)] if len(lead) else lead
        bad[lead[((raw[lead] == 0xC3) & ((nxt == 0x97) | (nxt == 0xB7))) | ((raw[lead] == 0xC4) & (nxt == 0xB0))]] = True
        ok = np.ones(len(offs) - 1, bool)
        ok[np.searchsorted(offs, np.flatnonzero(bad), side="right") - 1] = False
        data = raw.tobytes()
        for c in self.control:
            at = data.find(c)
            while at >= 0:
                ok[np.searchsorted(offs, at, side="right") - 1] = False
                at = data.find(c, at + 1)
        return ok

    @staticmethod
    def _lower(raw: np.ndarray, offs: np.ndarray, ok: np.ndarray) -> np.ndarray:
        low = LOWER[raw]
        lead = np.flatnonzero(raw == 0xC3) + 1
        lead = lead[lead < len(raw)]
        up = lead[(raw[lead] >= 0x80) & (raw[lead] <= 0x9E) & (raw[lead] != 0x97)]
        low[up] += 0x20
        for d in np.unique(np.searchsorted(offs, np.flatnonzero((raw == 0xC4) | (raw == 0xC5)), side="right") - 1):
            if ok[d]:
                low[offs[d] : offs[d + 1]] = np.frombuffer(raw[offs[d] : offs[d + 1]].tobytes().decode().lower().encode(), np.uint8)
        return low

    @staticmethod
    def _split(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the parts that are merged alone."""
        kind = _KIND[low]
        border = np.empty(len(kind), bool)
        border[0] = True
        border[1:] = kind[1:] != kind[:-1]
        border[kind == DIGIT] = True
        border[offs[:-1][offs[:-1] < len(low)]] = True
        at = np.flatnonzero(border)
        ends = np.append(at[1:], len(low))
        word = kind[at] != SPACE
        s, e = at[word], ends[word]
        mark = np.flatnonzero((low[s] == 0x27) & (e - s == 1))  # an apostrophe alone, and letters right behind it
        if len(mark):
            mark = mark[mark + 1 < len(s)]
            mark = mark[(s[mark + 1] == e[mark]) & (kind[s[mark + 1]] == LETTER) & ~np.isin(e[mark], offs)]
            b1 = low[s[mark + 1]]
            b2 = np.where(e[mark + 1] - s[mark + 1] > 1, low[np.minimum(s[mark + 1] + 1, len(low) - 1)], 0)
            n = np.where(np.isin(b1, np.frombuffer(b"stmd", np.uint8)), 1, 0)
            for x in (b"re", b"ve", b"ll"):
                n = np.where((b1 == x[0]) & (b2 == x[1]), 2, n)
            e[mark] += n
            s[mark + 1] += n
            full = s < e
            s, e = s[full], e[full]
        return s, e

    def words(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in the vocabulary cache, document) of the parts of all plain documents, and which documents are plain."""
        ok = self._plain(raw, offs)
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), ok
        low = self._lower(raw, offs, ok)
        s, e = self._split(low, offs)
        doc = np.searchsorted(offs, s, side="right") - 1
        if not ok.all():
            s, e, doc = s[ok[doc]], e[ok[doc]], doc[ok[doc]]
        if not len(s):
            return np.zeros(0, np.int64), doc, ok
        _, where, back = np.unique(span_hashes(low, s, e), return_index=True, return_inverse=True)
        data, places = low.tobytes(), list(zip(s[where].tolist(), e[where].tolist(), strict=True))
        same = same_spans(low, s, e, s[where][back], e[where][back])
        if not same.all():  # two words of one hash: their documents go to the tokenizer whole
            ok = ok.copy()
            ok[doc[~same]] = False
            s, e, doc, back = s[ok[doc]], e[ok[doc]], doc[ok[doc]], back[ok[doc]]
        if len(self.index) > CACHE_WORDS:
            self._reset()
        words = [data[a:b] for a, b in places]
        got = [self.index.get(x, -1) for x in words]
        new = [i for i, x in enumerate(got) if x < 0]
        if new:
            self._learn([words[i] for i in new])
            for i in new:
                got[i] = self.index[words[i]]
        return np.array(got, np.int64)[back], doc, ok

    def counts(self, raw: np.ndarray, offs: np.ndarray, whole: bool = False) -> np.ndarray:
        """Tokens per document."""
        if len(offs) == 2 and len(raw) > 2 * CHUNK and not whole:  # blanks never join tokens
            return np.sum([self.counts(raw[a:b], np.array([0, b - a]), True) for a, b in pieces(raw, NON_SPACE, CHUNK)], axis=0)
        at, doc, ok = self.words(raw, offs)
        out = np.bincount(doc, weights=self.count[at], minlength=len(offs) - 1).astype(np.int64)
        for d in np.flatnonzero(~ok):
            out[d] = len(self._encode(raw, offs, d))
        return out

    def _encode(self, raw: np.ndarray, offs: np.ndarray, d: int) -> list[int]:
        return self.whole.encode(raw[offs[d] : offs[d + 1]].tobytes().decode(), add_special_tokens=False).ids

    def encode(self, raw: np.ndarray, offs: np.ndarray, whole: bool = False) -> list[np.ndarray]:
        """Ids of each document."""
        if len(offs) == 2 and len(raw) > 2 * CHUNK and not whole:
            out, n = np.empty(len(raw) // 4, np.int32), 0
            for a, b in pieces(raw, NON_SPACE, CHUNK):
                ids = self.encode(raw[a:b], np.array([0, b - a]), True)[0]
                if n + len(ids) > len(out):
                    out.resize(n + len(ids) + len(out) // 4, refcheck=False)
                out[n : n + len(ids)] = ids
                n += len(ids)
            return [out[:n]]
        at, doc, ok = self.words(raw, offs)
        n = self.count[at]
        first = np.cumsum(n) - n
        flat = self.ids[np.arange(int(n.sum())) + np.repeat(self.first[at] - first, n)] if len(at) else np.zeros(0, np.int32)
        per = np.bincount(doc, weights=n, minlength=len(offs) - 1).astype(np.int64)
        ends = np.cumsum(per)
        return [flat[ends[d] - per[d] : ends[d]] if ok[d] else np.array(self._encode(raw, offs, d), np.int32) for d in range(len(offs) - 1)]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    """One encoder, and so one cache, for each Python worker."""
    return WordBPE(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(batch_col: pa.Array, path: str) -> Iterator[tuple[int, list[Iterable[np.ndarray]]]]:
    """(first row, ids of each row in one or more parts) of runs of rows; a very long text is encoded as its parts are asked for."""
    bpe = word_bpe(path)
    for i, _, raw, offs in text_chunks(batch_col):
        if len(offs) == 2 and len(raw) > 2 * CHUNK:
            yield i, [(bpe.encode(raw[a:b], np.array([0, b - a]), True)[0] for a, b in pieces(raw, NON_SPACE, CHUNK))]
        else:
            yield i, [(ids,) for ids in bpe.encode(raw, offs)]
