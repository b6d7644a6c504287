"""Token ids of whole texts with a public tokenizer, remembering the words met before.

The tokenizers cut a text into pieces before they look at the vocabulary, and
no merge crosses a cut. A text is cut here only where the tokenizer cuts as
well: before a space that follows a word, and between letters and the ASCII
signs after them. A word of letters is one piece and goes straight to the
tokenizer's model, its letters written as the tokenizer writes them; all else
takes the tokenizer's whole way. Ids are kept as bytes, a word's with and without the signs
after it. What is remembered is bounded in bytes, in two generations: when the
younger is full it becomes the elder, and of that only what is met again is
carried on.

Texts are taken some at a time: Arrow cuts them at spaces and tells their words
apart, each different one is looked up once, and Arrow puts the ids in the
words' places.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sitelens.llm.common import FORGET

#: White space by Unicode's property, which the tokenizers' patterns use.
SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0                　"
)
#: One space belongs to the word that follows, other white space is its own piece.
PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Besides the space and the line feed; any of them is rare.
RARE = SPACE.replace(" ", "").replace("\n", "")
RARE_ASCII = "\t\x0b\x0c\r"
WORDS, WHITE = re.compile(f"[^{SPACE}]+"), re.compile(f"[{SPACE}]")
#: Python's split() takes these for white space, the tokenizers don't.
CONTROL = re.compile("[\x1c-\x1f]")
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SURE = "؀"  # letters below are letters in every version of Unicode
#: Bytes of memory for words and their parts, and what an entry takes beside its letters and ids.
MEMORY, ENTRY = 192 << 20, 190

#: Code points of the texts taken at a time.
TAKEN = 8 << 20
#: Different words looked up between two looks at the memory.
MET = 10_000
#: Longer words are not remembered: they hardly come again.
LONG = 200


class Known(dict):
    """Ids by text; one that is not there comes from the generation before, or is made."""

    def __init__(self, make: Callable[[str], bytes], elder: dict[str, bytes]):
        self.make, self.elder, self.held = make, elder, 0

    def __missing__(self, text: str) -> bytes:
        got = self.elder.get(text)
        if got is None:
            got = self.make(text)
        # Words with signs after them or line feeds inside are put together of others again.
        if len(text) < LONG and (text[-1:] not in SIGNS or len(text) == 1) and "\n" not in text[1:]:
            self[text] = got
            self.held += ENTRY + len(text) + len(got)
        return got


class Pieces:
    """Ids of a text as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str, spaced: bool, width: int = 4, limit: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.spaced, self.limit = spaced, limit
        self.ids = [i.to_bytes(width, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.letters = {ord(c): self.written(c) for c in map(chr, range(ord(SURE))) if c.isalpha() and c != "İ"}
        self.opening = self.written(" ") if spaced else ""
        plain = string.ascii_letters.translate(self.letters)
        self.ascii = next((f for f in (str, str.lower) if f(string.ascii_letters) == plain), self.translated)
        self.words, self.parts = Known(self.encode_word, {}), Known(self.encode_part, {})
        self.before = 0

    @property
    def held(self) -> int:
        """Bytes remembered, of both generations."""
        return self.before + self.words.held + self.parts.held

    def written(self, sign: str) -> str:
        """How the tokenizer writes a sign before it asks the model."""
        normalizer = self.tokenizer.normalizer
        sign = normalizer.normalize_str(sign) if normalizer else sign
        ((sign, _),) = self.tokenizer.pre_tokenizer.pre_tokenize_str(sign)
        return sign

    def encode(self, piece: str) -> bytes:
        return b"".join([self.ids[i] for i in self.tokenizer.encode(piece, add_special_tokens=False).ids])

    def translated(self, word: str) -> str:
        return word.translate(self.letters)

    def encode_letters(self, word: str, opening: str) -> bytes:
        word = self.ascii(word) if word.isascii() else self.translated(word)
        return b"".join([self.ids[t.id] for t in self.model.tokenize(opening + word)])

    def lead(self, word: str) -> str:
        return " " + word if self.spaced else word

    def ends(self, word: str) -> tuple[str, str] | None:
        """(letters or digits, ASCII signs after them), or None where that might not be a cut."""
        core = word.rstrip(SIGNS)
        if core.isalnum() and (core.isascii() or max(core) < SURE and "İ" not in core):
            return core, word[len(core) :]
        return None

    def encode_word(self, word: str) -> bytes:
        """Ids of a word that a space stands before, if the tokenizer takes spaces into words."""
        if not word:
            return b""
        if word.isascii() and word.isalpha():
            return self.encode_letters(word, self.opening)
        if word[0] == "\n":  # only `split` writes such, for a line feed without a space before
            return self.encode_all(word)
        cut = self.ends(word)
        if cut and cut[1]:
            return self.words[cut[0]] + self.parts[cut[1]]
        if cut and word.isalpha():
            return self.encode_letters(word, self.opening)
        if self.spaced and not cut and WHITE.search(word):
            return self.encode_all(" " + word)
        return self.encode(self.lead(word))

    def encode_part(self, piece: str) -> bytes:
        """Ids of a piece that no space stands before."""
        cut = self.ends(piece)
        if cut and cut[1]:
            return self.parts[cut[0]] + self.parts[cut[1]]
        if cut and piece.isalpha():
            return self.encode_letters(piece, "")
        return self.encode(piece)

    def encode_all(self, text: str) -> bytes:
        found = PIECES.findall(text)
        return b"".join([self.words[p[1:]] if p[0] == " " and p[-1] not in SPACE else self.parts[p] for p in found])

    def turn(self) -> None:
        """If memory is full, what was met since the last turn is the elder generation now; the one before it is dropped."""
        if self.words.held + self.parts.held <= self.limit // 2:
            return
        self.before = self.words.held + self.parts.held
        self.words.elder, self.parts.elder = {}, {}
        self.words, self.parts = Known(self.encode_word, self.words), Known(self.encode_part, self.parts)

    def split(self, text: str) -> tuple[bytes, str | None]:
        """Ids of what comes first, and the words that follow, a space between any two."""
        if not text:
            return b"", None
        self.turn()
        if not self.spaced:
            if any(c in text for c in (RARE_ASCII if text.isascii() else RARE)) or CONTROL.search(text):
                return b"", " ".join(WORDS.findall(text))
            return b"", text.replace("\n", " ")
        # Where a space follows white space, splitting at single spaces would cut a run in two.
        rare = RARE_ASCII if text.isascii() else RARE
        if "  " in text or "\n " in text or " \n" in text or text[-1] == " " or any(c in text for c in rare):
            return self.encode_all(text), None
        # Two line feeds are a piece each before a word, but not three, nor two at the end.
        if "\n\n\n" not in text and text[-2:] != "\n\n":
            text = text.replace("\n", " \n")
        first, gap, rest = text.partition(" ")
        return self.encode_all(first), rest if gap else None

    def together(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text."""
        firsts, rests = zip(*map(self.split, texts))
        lists = pc.split_pattern(pa.array(rests, pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        words = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py()
        # No words and the empty word alone read the same.
        words = words.split(" ") if len(coded) else []
        found: list[bytes] = []
        for at in range(0, len(words), MET):
            self.turn()
            found += map(self.words.__getitem__, words[at : at + MET])
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        data = memoryview(data) if data else b""
        return (first + data[a:b] for first, a, b in zip(firsts, ends, ends[1:]))

    def each(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text in turn; a null one has none."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(text or "")
            if size >= TAKEN:
                yield from self.together(held)
                held, size = [], 0
        if held:
            yield from self.together(held)

    def __call__(self, text: str | None) -> bytes:
        return next(self.each([text]))


_KEPT: dict[tuple[str, bool, int], Pieces] = {}
FORGET.append(_KEPT.clear)


def pieces(path: str, spaced: bool, width: int = 4) -> Pieces:
    """One per worker process; what it learnt serves the tasks that follow there, until `make_room`."""
    key = (tokenizer_path(path), spaced, width)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Pieces(*key)
    return _KEPT[key]


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file of the installed package lies; an absolute path is used as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
