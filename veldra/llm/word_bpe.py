"""Byte-pair encoding by words: the results of the tokenizers library, at the price of a look-up a word.

The vocabulary files of this kind drop white space and never merge across it, so a text's ids are those of its
white-space-separated words, one after the other. Words seen before are found all together: up to 15 bytes of a word
and its length are two numbers, looked up with numpy in an open-addressed table, so a text's words are never Python
objects. New ones are merged together, many words at once. Words beyond Latin letters, or with an added token, go to
the library.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
_LATIN = re.compile("[\x00-įı-ɏ]*")
_FIRST = np.int64(1) << np.int64(62)
_GAP = np.isin(np.arange(256), [32, *range(9, 14)])
_SHORT = 15  # bytes of a word that two numbers hold, with its length
_BYTES_OF = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _byte_chars() -> list[str]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    out = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


def words_of(text: str) -> list[str]:
    """White-space-separated words; the separators U+001C to U+001F are no white space to the library."""
    return [w for w in _SPACE.split(text) if w] if _ODD.search(text) else text.split()


class WordEncoder:
    """Encodes texts into little-endian unsigned 32-bit ids.

    cache_words bounds the dictionary (when full, it keeps the words that were met again since) and, with half as many,
    the words' pieces; longest is the length in bytes beyond which a
    word goes to the library instead and is not kept.
    """

    def __init__(self, path: str, cache_words: int = 500_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        steps = [s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        self.pattern = regex.compile(f"{steps[0]}|\n")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in chars], dtype=np.int64)
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self._index(pairs)
        self.cache_words, self.longest = cache_words, longest
        self.forget()

    def _index(self, pairs: np.ndarray) -> None:
        """An open-addressed table from a pair of ids to the rank of its merge."""
        bits = max(12, int(np.ceil(np.log2(len(pairs) * 8 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        key = pairs[:, 0] << 32 | pairs[:, 1]
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[at[todo]] < 0
            _, first = np.unique(np.where(free, at[todo], -1 - todo), return_index=True)
            won = todo[first][free[first]]
            self.keys[at[won]], self.ranks[at[won]] = key[won], won
            todo = np.setdiff1d(todo, won)
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.ranks[at], _FIRST >> 33)
        more = np.flatnonzero((got != key) & (got >= 0))
        while len(more):
            at[more] = (at[more] + 1) & self.mask
            got = self.keys[at[more]]
            hit = got == key[more]
            out[more[hit]] = self.ranks[at[more[hit]]]
            more = more[~hit & (got >= 0)]
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (no word is empty), by merging the best pair of every word in each round."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[flat[ends]]
        none = _FIRST >> 33
        word = np.repeat(np.arange(n), size)
        rank = np.full(len(sym), none)
        if len(sym) > 1:
            rank[:-1] = self._rank(sym[:-1], sym[1:])
        rank[ends] = none
        done_word, done_sym = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), starts)
            live = best >> 32 < none
            if not live.all():
                over = ~np.repeat(live, np.diff(np.r_[starts, len(sym)]))
                done_word.append(word[over])
                done_sym.append(sym[over])
                sym, word, rank = sym[~over], word[~over], rank[~over]
                if not len(sym):
                    break
                starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                best = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), starts)
            at = best & 0xFFFFFFFF
            sym[at] = self.made[best >> 32]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            sym, word, rank = sym[keep], word[keep], rank[keep]
            nxt = np.minimum(at + 1, len(sym) - 1)
            inside = (nxt > at) & (word[nxt] == word[at])
            rank[at] = np.where(inside, self._rank(sym[at], sym[nxt]), none)
            before = at[(at > 0) & (word[at - 1] == word[at])]
            rank[before - 1] = self._rank(sym[before - 1], sym[before])
        words_done, ids = np.concatenate(done_word), np.concatenate(done_sym).astype("<u4")
        order = np.argsort(words_done, kind="stable")
        data = ids[order].tobytes()
        to = (np.cumsum(np.bincount(words_done, minlength=n)) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *to], to)]

    def _by_library(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, missing: list[str]) -> dict[str, bytes]:
        """The ids of words that are not in the dictionary."""
        plain, other = missing, []
        joined = "\n".join(missing)
        # words are looked at one by one only where one of them all is long, of other letters, or holds an added token
        if max(map(len, missing)) > self.longest or not _LATIN.fullmatch(joined) or self.added.search(joined):
            plain = []
            for w in missing:
                (plain if len(w) <= self.longest and _LATIN.fullmatch(w) and not self.added.search(w) else other).append(w)
            joined = "\n".join(plain)
        out = dict(zip(other, self._by_library(other))) if other else {}
        if plain:
            parts = self.pattern.findall(joined.lower() + "\n")
            distinct = set(parts)
            new = distinct.difference(self.pieces)
            self.pieces_again |= distinct - new
            new = list(new)
            if new:
                if len(self.pieces) + len(new) > self.cache_words // 2:
                    self.pieces = self._kept(self.pieces, self.pieces_again, distinct | {"\n"})
                    self.pieces_again = set()
                self.pieces.update(zip(new, self.merge(list(map(str.encode, new)))))
            got = list(map(self.pieces.__getitem__, parts))
            size = np.fromiter(map(len, got), np.int64, len(got))
            cut = [0, *np.cumsum(size)[size == 0].tolist()]  # ends of words: of all parts, only the line feed has no ids
            data = b"".join(got)
            out.update(zip(plain, map(data.__getitem__, map(slice, cut, cut[1:]))))
        return out

    def forget(self) -> None:
        """Empties the dictionary, so that a worker that goes on to other work holds none."""
        self.pieces: dict[str, bytes] = {"\n": b""}
        self.pieces_again: set[str] = set()  # pieces met in more than one batch since they were last full
        self.cache, self.again = Known(), set()

    def _kept(self, known: dict[str, bytes], again: set[str], now: set[str]) -> dict[str, bytes]:
        """What stays of full pieces: those of now, and those met again if they leave half of the room free."""
        stay = again | now if 4 * len(again) <= self.cache_words else now
        return {w: known[w] for w in stay if w in known}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes; a null text has none."""
        return [ids for part in self.encoded(pa.array(texts, pa.large_string())) for ids in part]

    def encoded(self, texts: pa.Array, piece: int = 1 << 19) -> Iterator[list[bytes]]:
        """The ids of the texts of an Arrow array, some texts at a time, read where they lie."""
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + piece, side="right")) - 1)
            if at[j] - at[i] <= piece:
                yield self._encode_block(data[at[i] : at[j]], at[i : j + 1] - at[i])
            else:  # one text, in parts that end at white space
                parts, pos = [], int(at[i])
                while pos < at[j]:
                    stop = min(pos + piece, int(at[j]))
                    while stop < at[j] and not _GAP[data[stop - 1]]:
                        ahead = np.flatnonzero(_GAP[data[stop : min(stop + piece, int(at[j]))]])
                        stop = stop + int(ahead[0]) + 1 if len(ahead) else min(stop + piece, int(at[j]))
                    parts += self._encode_block(data[pos:stop], np.array([0, stop - pos]))
                    pos = stop
                yield [b"".join(parts)]
            i = j

    def _encode_block(self, buf: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The ids of texts that lie one behind the other, from cut to cut. White space beyond ASCII is left in the
        words, which are split at it when they are learnt."""
        if not len(buf):
            return [b""] * (len(cuts) - 1)
        word = ~_GAP[buf]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = cuts[(cuts > 0) & (cuts < len(buf))]
        first[inner], last[inner - 1] = word[inner], word[inner - 1]
        start = np.flatnonzero(first)
        size = np.flatnonzero(last) + 1 - start
        eights = np.ndarray(len(buf) + 8, "<u8", np.r_[buf, np.zeros(16, np.uint8)], 0, (1,))
        low = eights[start] & _BYTES_OF[np.minimum(size, 8)]
        high = eights[np.minimum(start + 8, len(buf))] & _BYTES_OF[np.clip(size - 8, 0, 8)]
        long = np.flatnonzero(size > _SHORT)
        high |= size.astype(np.uint64) << np.uint64(56)
        rows = self.cache.find(low, high)
        names = [buf[start[k] : start[k] + size[k]].tobytes() for k in long.tolist()]
        rows[long] = [self.cache.long.get(n, -1) for n in names]
        new = np.flatnonzero(rows < 0)
        self.cache.met[rows if not len(new) else rows[rows >= 0]] = True
        if len(new):
            short = new[size[new] <= _SHORT]
            order = short[np.lexsort((low[short], high[short]))]
            once = order[np.r_[True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])]] if len(order) else order
            other = sorted({n for n, r in zip(names, rows[long].tolist()) if r < 0})
            line, n = size[once] + 1, len(once) + len(other)
            at = np.repeat(start[once] - (np.cumsum(line) - line), line)
            at += np.arange(len(at))
            lines = np.r_[buf, np.uint8(0)][at]
            lines[np.cumsum(line) - 1] = 10  # line feeds between the runs, which hold none
            runs = [*lines[:-1].tobytes().decode().split("\n"), *[w.decode() for w in other]] if len(once) else [w.decode() for w in other]
            if len(self.cache) + n > self.cache_words:
                self.cache.shrink(rows, self.cache_words * 3 // 4)
                rows = self.cache.find(low, high)
                rows[long] = [self.cache.long.get(n, -1) for n in names]
            self.cache.add(low[once], high[once], other, self._ids(runs))
            gone = np.flatnonzero(rows < 0)
            rows[gone] = self.cache.find(low[gone], high[gone])
            rows[long] = [self.cache.long[n] for n in names]
        data, ends = self.cache.ids_of(rows)
        ends = np.r_[0, ends][np.searchsorted(start, cuts)] * 4
        for n in [n for n in names if len(n) > self.longest]:
            self.cache.long.pop(n, None)  # its ids go when the dictionary is next made smaller
        return [data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def _ids(self, runs: list[str]) -> list[bytes]:
        """The ids of distinct runs between ASCII white space, which other white space may cut into words."""
        if "\n".join(runs).split() == runs:
            return list(map(self.learn(runs).__getitem__, runs))
        split = [words_of(t) for t in runs]
        words = list(dict.fromkeys(w for s in split for w in s))
        got = self.learn(words) if words else {}
        return [b"".join(map(got.__getitem__, s)) for s in split]


class Known:
    """Words and their ids: a table from the two numbers of a short word, and a dictionary of long ones, to rows."""

    def __init__(self):
        self.slots, self.long = np.full(1 << 12, -1, np.int32), {}
        self.low, self.high = np.zeros(1 << 11, np.uint64), np.zeros(1 << 11, np.uint64)
        self.at, self.met = np.zeros((1 << 11) + 1, np.int64), np.zeros(1 << 11, bool)
        self.ids, self.rows = np.zeros(1 << 13, "<u4"), 0

    def __len__(self) -> int:
        return self.rows

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ high * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The row of each word, -1 for one that isn't held."""
        slot = self._slot(low, high)
        rows = self.slots[slot]
        more = np.flatnonzero((rows >= 0) & ((self.low[rows] != low) | (self.high[rows] != high)))
        while len(more):
            slot[more] = (slot[more] + 1) & (len(self.slots) - 1)
            rows[more] = got = self.slots[slot[more]]
            more = more[(got >= 0) & ((self.low[got] != low[more]) | (self.high[got] != high[more]))]
        return rows

    def _place(self, rows: np.ndarray) -> None:
        """Puts rows of short words that aren't held into the table."""
        slot = self._slot(self.low[rows], self.high[rows])
        while len(rows):
            free = np.flatnonzero(self.slots[slot] < 0)
            self.slots[slot[free]] = rows[free]
            left = self.slots[slot] != rows
            rows, slot = rows[left], (slot[left] + 1) & (len(self.slots) - 1)

    def add(self, low: np.ndarray, high: np.ndarray, long: list[bytes], ids: list[bytes]) -> None:
        """New rows: short words by their numbers, then long ones; ids in that order."""
        n, data = self.rows + len(ids), np.frombuffer(b"".join(ids), "<u4")
        if n > len(self.low):
            room = 1 << (n - 1).bit_length()
            for name in ("low", "high", "met"):
                old = getattr(self, name)
                setattr(self, name, np.r_[old, np.zeros(room - len(old), old.dtype)])
            self.at = np.r_[self.at, np.zeros(room + 1 - len(self.at), np.int64)]
        used = int(self.at[self.rows])
        if used + len(data) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(max(len(data), len(self.ids) // 2), "<u4")]
        self.ids[used : used + len(data)] = data
        self.at[self.rows + 1 : n + 1] = used + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4
        short = np.arange(self.rows, self.rows + len(low), dtype=np.int32)
        self.low[short], self.high[short] = low, high
        self.low[short[-1] + 1 if len(short) else self.rows : n] = 0
        self.high[short[-1] + 1 if len(short) else self.rows : n] = 0
        self.met[self.rows : n] = False
        self.long.update(zip(long, range(self.rows + len(low), n)))
        self.rows = n
        if 2 * n > len(self.slots):
            self.slots = np.full(1 << (4 * n - 1).bit_length() - 1, -1, np.int32)
            short = np.flatnonzero(self.high[:n]).astype(np.int32)
        self._place(short)

    def shrink(self, now: np.ndarray, most: int) -> None:
        """Keeps the words of now, and those met since the last time if they are at most so many."""
        stay = self.met[: self.rows].copy()
        if stay.sum() > most:
            stay[:] = False
        stay[now[now >= 0]] = True
        size = np.diff(self.at[: self.rows + 1])[stay]
        rank = np.cumsum(stay) - 1
        old, n = np.flatnonzero(stay), int(stay.sum())
        ids = np.frombuffer(self.ids_of(old)[0], "<u4").copy()
        self.long = {w: int(rank[r]) for w, r in self.long.items() if stay[r]}
        self.low[:n], self.high[:n], self.met[: self.rows] = self.low[old], self.high[old], False
        self.at[1 : n + 1] = np.cumsum(size)
        self.ids[: len(ids)], self.rows = ids, n
        self.slots[:] = -1
        self._place(np.flatnonzero(self.high[:n]).astype(np.int32))

    def ids_of(self, rows: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids of the rows, one behind the other, and where each row's end."""
        size = self.at[rows + 1] - self.at[rows]
        ends = np.cumsum(size)
        at = np.repeat(self.at[rows] - (ends - size), size)
        at += np.arange(len(at))
        return self.ids[at].tobytes(), ends


_MADE: deque[WordEncoder] = deque(maxlen=2)


@lru_cache(maxsize=2)
def encoder(path: str, cache_words: int = 500_000) -> WordEncoder:
    """One encoder for each Python worker, vocabulary and size of the dictionary."""
    _MADE.append(WordEncoder(path, cache_words))
    return _MADE[-1]


def forget_all() -> None:
    """Empties the dictionaries of all this worker's encoders."""
    for e in _MADE:
        e.forget()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
