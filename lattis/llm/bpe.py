"""BPE encoding and decoding with a streaming transducer of bounded lookahead.

The tokenizer file (a public ``tokenizers`` JSON: NFC, lower case, words cut by a fixed
pattern, byte-level symbols, a suffix that marks the last symbol of a word) is read from
a path parameter and never copied.

Encoding.  For a list of merges the token that ends at a position of a word depends on
the prefix alone: it is the one token ``t`` that is a suffix of the prefix and that stays
separate from the token before it when the two are merged together (*compatible*).  The
transducer keeps this last token for each position.  No token is longer than
``lookahead`` symbols (computed from the merge list), hence whatever follows continues
from one of the last ``lookahead`` positions; what the back pointers of all these have in
common can no longer change.  That part is emitted at once and forgotten, so memory stays
constant however long a word or a text is.

Decoding.  ``decode`` gives the library's text for a tokenizer without decoder: token
strings joined by a space.  ``Decoder`` turns ids back into text incrementally: symbols
to bytes, bytes to text by a UTF-8 state machine that holds at most three bytes.

Null text counts as empty; empty text has no tokens (hash of nothing); repeated rows each get their row;
columns beyond those kept and the text are not looked at.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: White space as the pattern's engine knows it (Unicode White_Space).
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Words kept by each generation of the cache, and the longest word kept.
CACHE_WORDS, CACHE_LENGTH = 100_000, 48
#: A rank after all others.
NEVER = 2**31 - 1
#: Pairs of tokens whose compatibility is kept.
CACHE_PAIRS = 120_000
#: Length of the longer of the two prefixes of a word whose states are kept too, in bytes.
PREFIX = 10
#: Characters of a text that are worked on at a time.
BLOCK = 1 << 20

_space = re.compile(f"[{SPACE}]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(extra)) for b in range(256)]


def word_pattern(top: int) -> re.Pattern:
    letters, numbers = (char_class(kind, top) for kind in "LN")
    space = "".join(c for c in SPACE if ord(c) <= top)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


#: Letters and numbers that Unicode 16.0 added, for a Python whose tables are older.
ADDED = {
    "L": (
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
        (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
        (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ),
    "N": ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)),
}
#: Small letters of capitals that are newer than Python's tables.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_newer = re.compile("[" + "".join(map(chr, LOWER)) + "]")


def char_class(kind: str, top: int) -> str:
    """Ranges of the characters whose category starts with ``kind``, for a pattern's class."""
    out, start, added = [], None, {c for a, b in ADDED[kind] for c in range(a, b + 1)}
    for i in range(top + 2):
        inside = i <= top and (i in added or unicodedata.category(chr(i))[0] == kind)
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(i - 1))}")
            start = None
    return "".join(out)


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: s for s, i in chain(vocab.items(), self.special.items())}
        self.string_list = [strings.get(i, "") for i in range(max(strings) + 1)]
        self.decimal = [str(i) for i in range(len(self.string_list))]
        #: Pairs of tokens are keyed by one number, ``left * size + right``.
        self.size = len(self.string_list)
        #: Rank of a merge by its pair.
        self.merges: dict[int, int] = {}
        rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for at, pair in enumerate(model["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            new, (x, y) = vocab[x + y], (vocab[x], vocab[y])
            if self.merges.setdefault(x * self.size + y, at) == at and new not in rank:
                rank[new], parts[new] = at, (x, y)
        symbols = byte_symbols()
        self.back = {s: b for b, s in enumerate(symbols)}
        #: A symbol of a word is a byte, plus 256 if it is the word's last.
        last = 256 if self.suffix else 0
        self.last = last
        atoms: dict[int, tuple[int, ...]] = {}
        for b, s in enumerate(symbols):
            for key, name in ((b, s), (b + last, s + self.suffix)):
                if name in vocab:
                    atoms[vocab[name]] = (key,)
        for new, (a, b) in parts.items():  # by rank
            if new not in atoms and a in atoms and b in atoms:
                atoms[new] = atoms[a] + atoms[b]
        #: What stands at one edge while a token is built, innermost first: the token, and the rank at which it is absorbed.
        #: Those of one token and edge lie between its place in ``right`` or ``left`` and the next place.
        self.edge, self.until = array("i"), array("i")
        self.right, self.left = (self._spines(side, atoms, parts, rank) for side in (1, 0))
        #: Tokens that their own symbols merge to, in a tree by symbols from the last to the first: the next node by
        #: ``node * 512 + symbol``, and the token that ends at a node, if any.
        self.tree: dict[int, int] = {}
        self.ends: list[int | None] = [None]
        self.known = {x[0] for x in atoms.values() if len(x) == 1}
        self.lookahead = 1
        for i, syms in atoms.items():
            if len(syms) == 1 or self._fits(*parts[i], inner=True):
                node = 0
                for x in reversed(syms):
                    node = self.tree.setdefault(node * 512 + x, len(self.ends))
                    if node == len(self.ends):
                        self.ends.append(None)
                self.ends[node] = i
                self.lookahead = max(self.lookahead, len(syms))
        self.compatible: dict[int, bool] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.prefixes: dict[bytes, tuple] = {}
        #: The pattern for all characters, and the same for texts of characters below 256.
        self.words, self.latin = (word_pattern(top) for top in (sys.maxunicode, 255))
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _spines(self, side: int, atoms: dict, parts: dict, rank: dict) -> array:
        """Places in ``edge`` and ``until`` of what stands at one edge of each token."""
        places = array("i")
        for token in range(self.size):
            places.append(len(self.edge))
            out, until = [], NEVER
            while token in atoms:
                out.append((token, until))
                if len(atoms[token]) == 1:
                    break
                until, token = rank[token], parts[token][side]
            for token, until in reversed(out):
                self.edge.append(token)
                self.until.append(until)
        places.append(len(self.edge))
        return places

    def _raw(self, token: int) -> bytes:
        s = self.string_list[token]
        end = bool(self.suffix) and s.endswith(self.suffix)
        return bytes(self.back[c] for c in (s[: -len(self.suffix)] if end else s)) + (b"\xff" if end else b"")

    def _fits(self, a: int, b: int, inner: bool = False) -> bool:
        """Whether nothing merges across the border of two tokens while both are built.

        ``inner``: whether they meet whole, so that the merge of the two themselves is the first.
        """
        edge, until, merges, size = self.edge, self.until, self.merges, self.size
        i, j = self.right[a], self.left[b]
        i_top, j_top = self.right[a + 1] - 1, self.left[b + 1] - 1
        while True:
            x_until, y_until = until[i], until[j]
            top = i == i_top and j == j_top
            if top and inner:
                return True
            found = merges.get(edge[i] * size + edge[j])
            # of equal ranks the leftmost merges first: a's own before, b's own after the border
            if found is not None and found < x_until and found <= y_until:
                return False
            if top:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _extend(self, symbols: list[int], starts: list[int], tokens: list[int], before: int) -> None:
        """Start and id of the last token of each prefix of ``symbols`` that has none yet."""
        compatible, tree, ends, size = self.compatible, self.tree, self.ends, self.size
        for end in range(len(tokens), len(symbols) + 1):
            node, start = 0, end
            while start:
                start -= 1
                node = tree.get(node * 512 + symbols[start])
                if node is None:
                    start = 0
                    t = -1
                    break
                t = ends[node]
                if t is None:
                    continue
                left = tokens[start] if start else before
                if left < 0:
                    if start:
                        continue
                    break
                fits = compatible.get(left * size + t)
                if fits is None:
                    if len(compatible) > CACHE_PAIRS:
                        compatible.clear()
                    fits = compatible[left * size + t] = self._fits(left, t)
                if fits:
                    break
            starts.append(start)
            tokens.append(t)

    def word_stream(self, word: bytes) -> Iterator[list[int]]:
        """Tokens of one word, emitted as soon as they are stable."""
        n, end = self.lookahead, len(word)
        symbols: list[int] = []  # from the first that is not emitted on
        starts, tokens, before = [0], [-1], -1  # of the last token of each prefix; the one emitted last
        for m in (PREFIX, PREFIX // 2):
            if m < end and (head := self.prefixes.get(word[:m])):
                symbols, starts, tokens = map(list, head)  # the state after a prefix depends on it alone
                break
        else:
            m = 0
        for k in (PREFIX // 2, PREFIX):
            if m < k < end:
                symbols += filter(self.known.__contains__, word[m:k])
                self._extend(symbols, starts, tokens, before)
                if len(self.prefixes) >= CACHE_WORDS // 2:
                    self.prefixes.clear()
                self.prefixes[word[:k]] = (tuple(symbols), tuple(starts), tuple(tokens))
                m = k
        for at in range(0, end, 4 * n):
            # what is not in the vocabulary leaves no token, as in the library
            symbols += filter(self.known.__contains__, word[at or m : at + 4 * n] if at + 4 * n < end else [*word[at or m : end - 1], *(x + self.last for x in word[-1:])])
            self._extend(symbols, starts, tokens, before)
            if at + 4 * n < end:
                stable = self._common(starts, tokens, max(1, len(symbols) - n))
                if stable:
                    yield self._path(starts, tokens, stable)
                    before = tokens[stable]
                    del symbols[:stable]
                    starts = [0] + [x - stable for x in starts[stable + 1 :]]
                    tokens = [-1] + tokens[stable + 1 :]
        yield self._path(starts, tokens, len(symbols))

    @staticmethod
    def _common(starts: list[int], tokens: list[int], window: int) -> int:
        """The last position that the paths from all positions of the window share."""
        live = {p for p in range(window, len(starts)) if tokens[p] >= 0}
        while len(live) > 1:
            p = max(live)
            live.discard(p)
            if starts[p] <= 0:
                return 0
            live.add(starts[p])
        return live.pop() if live else 0

    @staticmethod
    def _path(starts: list[int], tokens: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(tokens[end])
            end = starts[end]
        return out[::-1]

    def forget(self) -> None:
        """Drop what is only kept for speed."""
        self.young, self.old, self.prefixes, self.compatible = {}, {}, {}, {}

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            ids = tuple(chain.from_iterable(self.word_stream(word.encode("utf-8"))))
        if len(word) <= CACHE_LENGTH:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def encode_stream(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, in lists that stand for at most ``BLOCK`` characters or so."""
        for block in blocks(text):
            for piece in self.specials.split(block) if self.specials else [block]:
                if piece in self.special:
                    yield [self.special[piece]]
                elif piece:
                    if not piece.isascii():
                        piece = unicodedata.normalize("NFC", piece)
                        if not below_256(piece):
                            piece = piece.replace("Σ", "σ")
                            if _newer.search(piece):
                                piece = piece.translate(LOWER)
                    piece = piece.lower()
                    words = (self.latin if below_256(piece) else self.words).findall(piece)
                    got = list(map(self.young.get, words))
                    if None in got:
                        got = [self._word(w) if ids is None else ids for w, ids in zip(words, got)]
                    yield list(chain.from_iterable(got))

    def encode(self, text: str) -> list[int]:
        return [i for part in self.encode_stream(text) for i in part]

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decode for a file without decoder."""
        return " ".join(map(self.string_list.__getitem__, ids))


def below_256(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """A text in pieces that end after white space, which no word crosses."""
    start = 0
    while len(text) - start > size:
        m = _space.search(text, start + size)
        if m is None:
            break
        yield text[start : m.end()]
        start = m.end()
    yield text[start:] if start else text


class Decoder:
    """Ids to text, step by step: what is not yet a whole character waits for the next id."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.utf8 = bpe, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        out, special = [], self.bpe.special
        for i in ids:
            if not 0 <= i < self.bpe.size:
                raise KeyError(i)
            s = self.bpe.string_list[i]
            if s in special:
                out.append(self.utf8.decode(b"", True) + s)
                continue
            raw = self.bpe._raw(i)
            out.append(self.utf8.decode(raw.rstrip(b"\xff")))
            if raw.endswith(b"\xff"):
                out.append(" ")
        if final:
            out.append(self.utf8.decode(b"", True))
        return "".join(out)


def encode_texts(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """Every row's ``keep`` columns with ``ids`` (array of ints) and ``decoded`` (string)."""

    def make():
        bpe = loaded(path)

        def work(texts):
            ids = [bpe.encode((t or b"").decode("utf-8", "replace")) for t in texts]
            return [ids, [bpe.decode(x) for x in ids]]

        return work

    return map_texts(df, keep, text, make, "ids array<int>, decoded string")


def digested(bpe: Bpe, raw: bytes | None, put: Callable[[list[int]], object] = len) -> tuple[int, str, str]:
    """Number of ids of a text, digests of them and of the decoded text; ``put`` is given the ids as they come."""
    decimal, strings = bpe.decimal.__getitem__, bpe.string_list.__getitem__
    n, ids_hash, text_hash, glue = 0, hashlib.sha256(), hashlib.sha256(), b""
    for ids in bpe.encode_stream((raw or b"").decode("utf-8", "replace")):
        if ids:
            ids_hash.update(glue + " ".join(map(decimal, ids)).encode())
            text_hash.update(glue + " ".join(map(strings, ids)).encode())
            n, glue = n + len(ids), b" "
            put(ids)
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def digest_texts(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """As ``encode_texts``, with digests in place of the ids and the decoded text."""

    def make():
        bpe = loaded(path)
        return lambda texts: list(zip(*(digested(bpe, t) for t in texts))) if texts else [[], [], []]

    return map_texts(df, keep, text, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def tokenize(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """Every row's ``keep`` columns with ``ids``, their number, and digests of ids and decoded text."""

    def make():
        bpe = loaded(path)

        def work(texts):
            values, places = array("i"), array("i", [0])  # no Python number for each id
            found = []
            for t in texts:
                found.append(digested(bpe, t, values.extend))
                places.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(np.array(places, np.int32)), pa.array(np.array(values, np.int32)))
            return [ids, *(zip(*found) if found else ([], [], []))]

        work.close = bpe.forget  # the worker lives on for other stages
        return work

    return map_texts(df, keep, text, make, "ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One tokenizer for each worker process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]
