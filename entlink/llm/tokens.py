"""Token ids of many texts by the tokenizers library, with a memo of whole words.

Both kinds of vocabulary used here cut a text at white space before they merge, so a text can be
cut at spaces first and equal pieces need to be encoded once. A text for which such a cut could
differ from the library's own goes to the library whole:

* word-end vocabularies (white space dropped, lower case): cut at ASCII white space;
* byte-level vocabularies (a word owns the one space before it): cut before each space and line end;
  a text with runs of white space (but for two line ends within it) or other white space goes whole.

Of the pieces not yet in the memo, words of Latin letters go straight to the library's merge model,
since its normalizer and its own cutting leave them as they are; all others go through all of it.
A word-end vocabulary cuts plain pieces (``a.96@b``) further, so those are put together from their parts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

from .common import worker_state

_ODD = re.compile("[" + "".join(map(chr, [0x9, 0xB, 0xC, 0xD, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, *range(0x205F, 0x2070), 0x3000, 0xFEFF])) + "]")
_WORD = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?]*)")


_LONG = 64  # characters of a piece that is not kept
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_TAIL = ".,;:!?"
_PLAIN = re.compile(f"[\x21-\x7e{_LETTER}]+")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")  # how word-end vocabularies cut a plain piece in small letters
_WORD_END_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Memo(dict):
    def __init__(self, learn: Callable[[str], bytes]):
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        ids = self.learn(piece)
        if len(piece) <= _LONG:
            self[piece] = ids
        return ids


class Encoder:
    """``encode(texts)`` gives for each text its ids as little-endian unsigned 16- or 32-bit integers.

    The memo has two generations of ``memo_size`` pieces of at most 64 characters, the older of which
    goes when the newer is full, so it stays below about 120 MB; longer pieces are encoded each time.
    """

    def __init__(self, path: str, memo_size: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        pre, norm = spec.get("pre_tokenizer") or {}, json.dumps(spec.get("normalizer"))
        self.byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm == "null"
        self.word_end = '"Removed"' in json.dumps(pre) and "\\\\s" in norm and "Lowercase" in norm
        self.by_parts = self.word_end and _WORD_END_CUT in [x.get("pattern", {}).get("Regex") for x in pre.get("pretokenizers", [pre])]
        self.special = tuple(x["content"] for x in spec.get("added_tokens", []))
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = "<u2" if self.code == "H" else "<u4"
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in [32, *range(65, 91), *range(97, 123), *range(0xC0, 0x100)]}
        self.space = " " if self.byte_level else ""
        self.memo_size, self.memo, self.old, self.marks = memo_size, _Memo(self._learn), {}, {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[str] | None:
        """Pieces, or None if the text must go whole.

        Of a byte-level text the first piece stands apart, those that begin with a line end have
        no space, and all others are without their space.
        """
        if any(x in text for x in self.special):
            return None
        if self.word_end:
            try:
                text.encode("latin-1")
                text = text.lower()  # one character at a time, as the library does it
            except UnicodeEncodeError:
                pass
            for c in "\t\n\r\x0b\x0c":
                text = text.replace(c, " ")
            return text.split(" ")
        if not self.byte_level or "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text.endswith("\n\n") or _ODD.search(text):
            return None
        return text.replace("\n", " \n").split(" ")

    def _learn(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is not None:
            return ids
        if piece.isascii() and piece.isalpha():
            word = piece.lower() if self.word_end else self.space + piece
            return array(self.code, [x.id for x in self.model.tokenize(word if self.word_end else word.translate(self.letters))]).tobytes()
        if self.word_end and (stem := piece.rstrip(_TAIL)).isascii() and stem.isalpha():
            return self.memo[stem] + self._mark(piece[len(stem) :])
        line = piece[:1] == "\n"
        if not (m := _WORD.fullmatch(piece, line)):
            if self.by_parts and len(piece) <= _LONG and _PLAIN.fullmatch(piece):
                return b"".join([self.memo[x] if x.isalpha() else self._mark(x) for x in _PARTS.findall(piece.lower())])
            return self._whole([piece if line else self.space + piece])[0]
        stem, tail = m.groups()
        if tail and not line:
            return self.memo[stem] + self._mark(tail)  # a mark after a letter begins a new word for either vocabulary
        word = stem.lower() if self.word_end else stem if line else self.space + stem
        ids = array(self.code, [x.id for x in self.model.tokenize(word if word.isascii() and word[0] != " " else word.translate(self.letters))]).tobytes()
        return self._mark("\n") + ids + (self._mark(tail) if tail else b"") if line else ids

    def _mark(self, text: str) -> bytes:
        if text not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[text] = self._whole([text])[0]
        return self.marks[text]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """A null text counts as empty."""
        out: list[bytes] = [b""] * len(texts)
        for i, text in enumerate(texts):
            if not text:
                continue
            if (pieces := self._pieces(text)) is None:
                out[i] = self._whole([text])[0]
                continue
            if len(self.memo) > self.memo_size:
                self.old, self.memo = self.memo, _Memo(self._learn)
            ids = b"".join(map(self.memo.__getitem__, pieces[1:] if self.byte_level else pieces))
            out[i] = self._first(pieces[0]) + ids if self.byte_level else ids
        return out

    def _first(self, piece: str) -> bytes:
        """Ids of a text's first piece, which has no space before it."""
        return self._whole([piece])[0] if piece else b""


def encoder(path: str) -> Encoder:
    """The Python worker's own."""
    return worker_state(path, lambda: Encoder(path))
