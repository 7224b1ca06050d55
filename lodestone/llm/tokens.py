"""Token ids and counts by the tokenizers library, with a cache for repeated pieces.

A text is cut at spaces where the tokenizer's own pre-tokenization always cuts
too, so a piece has the same ids wherever it stands.  The library encodes each
pre-token once; texts that hold control strings or odd white space, and pieces
in other scripts than Latin, go through the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from lodestone.llm import bytescan

#: Space-separated pieces and pre-tokens that one worker keeps; about 200 bytes each.
CACHE_PIECES = 250_000
CACHE_WORDS = 400_000
#: Pieces whose ids one worker keeps.
CACHE_IDS = 600_000
#: Characters of text that are looked up at once.
STEP_CHARS = 2_000_000

_LOADED: dict = bytescan.KEPT

#: Pieces of these characters are cut into pre-tokens here; all others by the library.
PLAIN = re.compile(r"[\n\x21-\x7eÀ-ÖØ-öø-ÿ]*")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The pre-token patterns of the two vocabularies, over those characters.
KEEP_SPACE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
DROP_SPACE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def as_letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(BYTE_LETTERS)


def default_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer of a file, once per process, without threads of its own."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[path] = tokenizer
    return _LOADED[path]


class _Pieces:
    """What both engines share: the library, its control strings, cutting a piece into pre-tokens."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.control = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        lone, wide = self.tokenizer.encode_batch(["a b", "a\nb"], add_special_tokens=False)
        self.spaces_matter = lone.ids != wide.ids

    def pre_tokens(self, piece: str) -> list[str]:
        return KEEP_SPACE.findall(piece) if self.spaces_matter else DROP_SPACE.findall(piece.lower())

    def controlled(self, text: str) -> bool:
        return any(c in text for c in self.control)


class PieceEncoder(_Pieces):
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Where the vocabulary keeps white space (a byte-level one) a piece carries
    the space before it, the first piece of a line is kept as a line break and
    its word, and longer runs of white space send the text through the library
    whole.  New pieces go through the library many at a time, parted by a
    string that is one token and occurs in none of them.
    """

    def __init__(self, path: str, limit: int = CACHE_IDS):
        super().__init__(path)
        self.limit = limit
        self.ids: dict[str, bytes] = {} if self.spaces_matter else {"": b""}
        self.part, self.part_id = ("\n", self._single("\n")) if self.spaces_matter else self._rare()
        self.line = np.array([self.part_id], dtype="<u4").tobytes()

    def _single(self, text: str) -> int:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return ids[0] if len(ids) == 1 else -1

    def _rare(self) -> tuple[str, int]:
        """A character outside ``PLAIN`` that is one token wherever it stands alone."""
        for code in range(0xA1, 0x3000):
            if not PLAIN.fullmatch(chr(code)) and chr(code).lower() == chr(code):
                one = self._single(chr(code))
                if one >= 0 and self.tokenizer.encode(f"a {chr(code)} b", add_special_tokens=False).ids[1] == one:
                    return f" {chr(code)} ", one
        return "", -1

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in out]

    def _odd(self, piece: str) -> bool:
        """Whether white space stands next to a cut, where the library might cut elsewhere."""
        word = piece.removeprefix("\n")
        return self.spaces_matter and (not word or word[0].isspace() or word[-1].isspace())

    def _cut(self, text: str) -> list[str]:
        if self.spaces_matter:
            return ("\n" + text).replace("\n", " \n")[1:].split(" ")
        return (text.lower() if text.isascii() else text).replace("\n", " ").split(" ")

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        lead, out = " " if self.spaces_matter else "", {}
        plain = []
        for piece in pieces:
            word = piece[1:] if piece[0] == "\n" else lead + piece
            if self.part_id >= 0 and PLAIN.fullmatch(word, len(lead) if word[0] == " " else 0):
                plain.append((piece, word))
            else:
                out[piece] = self._whole([word])[0]
        for at in range(0, len(plain), 200):
            some = plain[at : at + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([self.part.join([w for _, w in some]) + self.part], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.part_id)
            if len(ends) == len(some):
                raw, start = ids.tobytes(), 0
                for (piece, _), end in zip(some, ends.tolist(), strict=True):
                    out[piece] = raw[4 * start : 4 * end]
                    start = end + 1
            else:
                out.update(zip([p for p, _ in some], self._whole([w for _, w in some]), strict=True))
        if self.spaces_matter:
            for piece, ids in out.items():
                if piece[0] == "\n":
                    out[piece] = self.line + ids
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; same as the library's for the whole text."""
        out: list[bytes] = []
        start = chars = 0
        for k, text in enumerate(texts):
            chars += len(text)
            if chars >= STEP_CHARS:
                out += self._some(texts[start : k + 1])
                start, chars = k + 1, 0
        return out + self._some(texts[start:])

    def _some(self, texts: list[str]) -> list[bytes]:
        known = self.ids
        rows: list[tuple | None] = []
        unseen: set[str] = set()
        for text in texts:
            if not text or self.controlled(text) or (self.spaces_matter and self.part_id < 0):
                rows.append(None)
                continue
            pieces = self._cut(text)
            ids = list(map(known.get, pieces))
            gaps = []
            if None in ids:
                gaps = [(k, pieces[k]) for k, x in enumerate(ids) if x is None]
                new = {p for _, p in gaps}
                if any(map(self._odd, new)):
                    rows.append(None)
                    continue
                unseen |= new
            rows.append((ids, gaps))
        fresh = self._learn(unseen)
        out = []
        for text, row in zip(texts, rows, strict=True):
            if row is None:
                out.append(self._whole([text])[0] if text else b"")
                continue
            ids, gaps = row
            for k, piece in gaps:
                ids[k] = fresh[piece]
            out.append(b"".join(ids)[4 * self.spaces_matter :])
        room = self.limit - len(known)
        known.update(fresh if len(fresh) <= room else dict(list(fresh.items())[: max(0, room)]))
        return out


def encoder(path: str) -> PieceEncoder:
    """One encoder per process and file."""
    key = ("encoder", path)
    if key not in _LOADED:
        _LOADED[key] = PieceEncoder(path)
    return _LOADED[key]


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that, standing alone as a pre-token, encode as exactly one token.

    Proved by encoding each of them with the library, so merges that lead
    elsewhere and strings that the normalizer changes are left out.
    """
    tokenizer = load(path)
    letters = {v: k for k, v in BYTE_LETTERS.items()}
    texts = []
    for piece in tokenizer.get_vocab():
        try:
            word = bytes(letters[c] for c in piece.removesuffix("</w>")).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if word and PLAIN.fullmatch(word) and DROP_SPACE.findall(word.lower()) == [word]:
            texts.append(word)
    proved = []
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        for text, got in zip(part, tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
            if len(got.ids) == 1:
                proved.append(text)
    return frozenset(proved)


class TokenCounter(_Pieces):
    """Token counts of whole texts by the whole-token shortcut.

    Pre-tokens in ``proved`` count one; the library merges only the rest, each
    once while the cache holds it.  For vocabularies that drop white space.
    """

    def __init__(self, path: str, proved: frozenset[str], pieces: int = CACHE_PIECES, words: int = CACHE_WORDS):
        super().__init__(path)
        if self.spaces_matter:
            raise ValueError("the whole-token shortcut needs a vocabulary that drops white space")
        self.proved, self.piece_limit, self.word_limit = proved, pieces, words
        self.pieces: dict[str, int] = {"": 0}
        self.merged: dict[str, int] = {}

    def _library(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, word: str) -> int:
        n = self.merged.get(word)
        if n is None:
            n = len(self.model.tokenize(as_letters(word)))
            if len(self.merged) < self.word_limit:
                self.merged[word] = n
        return n

    def _piece(self, piece: str) -> int:
        if not PLAIN.fullmatch(piece):
            return self._library([piece])[0]
        proved = self.proved
        return sum([1 if w in proved else self._merge(w) for w in self.pre_tokens(piece)])

    def text(self, text: str) -> int:
        if self.controlled(text):
            return self._library([text])[0]
        cache = self.pieces
        pieces = text.split(" ")
        counts = list(map(cache.get, pieces))
        if None in counts:
            for k, n in enumerate(counts):
                if n is None:
                    piece = pieces[k]
                    n = cache.get(piece)
                    if n is None:
                        n = self._piece(piece)
                        if len(cache) < self.piece_limit:
                            cache[piece] = n
                    counts[k] = n
        return sum(counts)

    def batch(self, texts: list[str]) -> list[int]:
        return [self.text(t) for t in texts]
