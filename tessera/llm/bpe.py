"""Byte-pair encoding by dynamic programming over prefixes.

Of every prefix of a word, the encoding's last token is stored, and with it the
exact number of tokens. A prefix of length i ends in the one token t whose start
is the end of an encoded prefix with which t is compatible: two tokens are
compatible if encoding their joined bytes gives the two back. So each word is
encoded together with all its prefixes, and no prefix is encoded again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

#: The characters of Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0  -     　"
#: White space with the text behind it: no pre-tokenizer here joins what these part.
chunks_of: Callable[[str], list[str]] = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    itself where printable in Latin-1, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


#: Pairs of tokens whose compatibility is remembered at most.
MOST_PAIRS = 1_000_000
#: Tables of the first symbols of longer words that are remembered at most.
HEAD, MOST_HEADS = 7, 200_000
#: What a word's first token follows, in place of a token; -1 is what has no token.
_NOTHING = -2


class PrefixBpe:
    """Tokens of single pre-tokenized words, given as strings of symbols.

    vocab: token -> id; merges: pairs by falling priority; end: what the last
    symbol of a word carries, as "</w>", or nothing.
    """

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str = ""):
        self.end = end
        self.rank = {tuple(p): i for i, p in enumerate(merges)}
        self.text = {i: t for t, i in vocab.items()}
        inner = {t: i for t, i in vocab.items() if not (end and t.endswith(end))}
        last = {t[: -len(end)]: i for t, i in vocab.items() if end and t.endswith(end)} if end else inner
        self.inner, self.last = self._suffixes(inner), self._suffixes(last)
        self._fits: dict[int, bool] = {}
        self._heads: dict[str, tuple] = {}
        self._tokens, self._begins = inner, {t[:k] for t in inner for k in range(len(t) + 1)}
        # A state: its text, the states that follow by symbols, and the tokens that end
        # the text, as (id, length), longest first. Its text begins a token.
        self._states: dict[str, tuple[str, dict, tuple]] = {}
        self._start = self._state("")

    @staticmethod
    def _suffixes(tokens: dict[str, int]) -> dict[str, int]:
        """Each token's id, and -1 for what only ends tokens."""
        out = dict(tokens)
        for t in tokens:
            for k in range(1, len(t)):
                out.setdefault(t[k:], -1)
        return out

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair merging, for pairs of tokens."""
        while len(symbols) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            symbols = symbols[:i] + [symbols[i] + symbols[i + 1]] + symbols[i + 2 :]
        return symbols

    def _state(self, text: str) -> tuple[str, dict, tuple]:
        """The state of the longest end of text that begins a token."""
        while text not in self._begins:
            text = text[1:]
        known = self._states.get(text)
        if known is None:
            ends = ((text[k:], len(text) - k) for k in range(len(text)))
            known = self._states[text] = text, {}, tuple((self._tokens[t], n) for t, n in ends if t in self._tokens)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        if a == _NOTHING:  # a token alone: whether its text is encoded as itself
            return self.merged([*self.text[b]]) == [self.text[b]]
        x, y = self.text[a], self.text[b]
        bare = y[: -len(self.end)] if self.end and y.endswith(self.end) else y
        symbols = [*x, *bare]
        symbols[-1] += y[len(bare) :]
        return self.merged(symbols) == [x, y]

    def table(self, word: str, whole: bool = True) -> tuple[list[int], list[int]]:
        """(last token, number of tokens) of every prefix, the empty one first; the
        whole word's end symbol carries ``end`` if whole."""
        n, heads = len(word), self._heads
        i = HEAD if n > HEAD else 0
        known = heads.get(word[:i])
        if known is None:
            known = self._start, [_NOTHING], [0]
            if i:
                if len(heads) >= MOST_HEADS:
                    heads.clear()
                known = heads[word[:i]] = self._further(word[:i], *known)
        _, last, count = self._further(word[i:], *known)
        last[0] = -1
        if self.end and whole and n:
            last[n], count[n] = -1, 0
            for j in range(n - 1, -1, -1):
                t = self.last.get(word[j:])
                if t is None:
                    break
                if t >= 0 and (not j or last[j] >= 0 and self._compatible(last[j], t)):
                    last[n], count[n] = t, count[j] + 1
                    break
        return last, count

    def _further(self, word: str, state: tuple, last: list[int], count: list[int]) -> tuple[tuple, list[int], list[int]]:
        """The state and the table of a word so far (last begins with _NOTHING), after
        further symbols."""
        fits, last, count = self._fits, last[:], count[:]
        for symbol in word:
            after = state[1].get(symbol)
            if after is None:
                after = state[1][symbol] = self._state(state[0] + symbol)
            state = after
            for t, length in state[2]:
                before = last[-length]
                key = before << 20 | t
                ok = fits.get(key)
                if ok is None:
                    if len(fits) >= MOST_PAIRS:
                        fits.clear()
                    ok = fits[key] = before != -1 and self._compatible(before, t)
                if ok:
                    n = count[-length] + 1
                    break
            else:
                t, n = -1, 0
            last.append(t)
            count.append(n)
        return state, last, count

    def encode(self, word: str) -> list[int]:
        last, _ = self.table(word)
        out, i = [], len(word)
        while i:
            t = last[i]
            out.append(t)
            i -= len(self.text[t]) - (len(self.end) if i == len(word) else 0)
        return out[::-1]


def load(path: str) -> tuple[PrefixBpe, dict[str, int]]:
    """The model of a tokenizers .json file, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return PrefixBpe(model["vocab"], merges, model.get("end_of_word_suffix") or ""), {t["content"]: t["id"] for t in spec["added_tokens"]}

_ODD = re.compile(f"[{WHITE.replace(' ', '')}]".replace("\t-\r", "\t\x0b-\r") + r"|[ \n]{2}|\A[ \n]|[ \n]\Z")


class ChunkMemo:
    """A bounded memo of what is worked out for each chunk (white space and the
    text behind it) of a text. The bound is on memory only: what has gone is
    worked out again. With twice, a full memo is kept beside the next one, and what
    is asked for again moves over."""

    def __init__(self, work: Callable[[str], object], most: int = 400_000, longest: int = 64, twice: bool = False):
        memo = self

        class _Memo(dict):
            old: dict = {}

            def __missing__(self, key):
                value = self.old.get(key)
                if value is None:
                    value = work(self.chunk(key))
                if len(key) <= longest:
                    if len(self) >= most:
                        if twice:
                            self.old = dict(self)
                        self.clear()
                    self[key] = value
                return value

        class _Plain(_Memo):
            chunk = staticmethod(lambda key: key)

        class _Spaced(_Memo):
            chunk = staticmethod(lambda key: key if key[0] == "\n" else " " + key)

        memo.plain, memo.spaced = _Plain(), _Spaced()

    def __call__(self, text: str) -> list:
        """What each chunk of the text gives, in order."""
        if _ODD.search(text) or not text:
            return list(map(self.plain.__getitem__, chunks_of(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return [self.plain[first], *map(self.spaced.__getitem__, rest)]
