"""Encoding whole texts with a public tokenizer, part by part with a bounded cache.

The tokenizer itself encodes every part; texts are cut only where its pre-tokenizer always begins a token:

* after a run of Latin letters that no byte of a longer character follows;
* after ASCII punctuation (no apostrophe) that a letter, a digit, a space, a line feed or the end follows;
* after a single line feed between such parts;
* else (digits, other scripts, runs of white space) at the next white space for word tokenizers, which drop it,
  or at the next space that surely has no white space behind it for byte-level ones, which join it to what follows.

Texts that may hold the string of a special token are cut at white space alone.
"""

from __future__ import annotations

import os
import re
from array import array

from ._flat import stash

#: Parts of a cache generation; two generations at most are held.
CACHE = 400_000

LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++"
MARKS = rb"[!-&(-/:-@\[-`{-~]++"
#: A space that surely no white space follows: the next byte begins a visible character.
FIRM_SPACE = rb"(?= [\x21-\x7e\xc3-\xe0\xe4-\xf4])"
BYTE_PARTS = rb" ?" + LETTERS + rb"(?![\x80-\xff])| ?" + MARKS + rb"(?=[A-Za-z0-9 \n]|\Z)|\n(?=[A-Za-z])|[\s\S]+?(?:" + FIRM_SPACE + rb"|\Z)"
WORD_PARTS = LETTERS + rb"(?![\x80-\xff])|" + MARKS + rb"(?=[A-Za-z0-9 \n]|\Z)|[^\x20\x09-\x0d]+"
#: One token of the pre-tokenizer for certain.
SINGLE = rb" ?(?:" + LETTERS + rb"|" + MARKS + rb")"


def byte_alphabet() -> dict[int, int]:
    """The character that byte-level tokenizers use for each byte: itself if visible, else from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(rest)}


class _Cache(dict):
    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, part: bytes) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.encode(part)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[part] = ids
        return ids


class Encoder:
    """ids(text bytes) -> little-endian unsigned 32-bit ids, as the tokenizer in the file gives them."""

    def __init__(self, path: str, words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        single, alphabet, bpe = re.compile(SINGLE).fullmatch, byte_alphabet(), model.model.tokenize
        space = chr(alphabet[32])

        def encode(part: bytes) -> bytes:
            if single(part) and b"<|" not in part:  # the model's own step alone, a quarter of the time
                if part.isascii():  # visible characters stand for themselves, and only a first space does not
                    own = space + part[1:].decode() if part[0] == 32 else part.decode()
                    own = own.lower() if words else own
                else:
                    own = (part.decode().lower().encode() if words else part).decode("latin-1").translate(alphabet)
                return array("I", [x.id for x in bpe(own)]).tobytes()
            return array("I", model.encode(part.decode(), add_special_tokens=False).ids).tobytes()

        self.words, self.cache = words, _Cache(encode)
        self.parts = re.compile(WORD_PARTS if words else BYTE_PARTS).findall
        self.firm = re.compile(FIRM_SPACE).split

    def ids(self, text: bytes) -> bytes:
        if b"<|" in text:
            found = text.split() if self.words else self.firm(text)
        else:
            found = self.parts(text.lower() if self.words else text)
        return b"".join(map(self.cache.__getitem__, found))


def id_width(path: str, end_id: int) -> int:
    """Bytes that hold every id of the tokenizer in the file, and the end id: 2 or 4."""
    from tokenizers import Tokenizer

    most = max(end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())
    return 2 if most < 1 << 16 else 4


def encoder(path: str, words: bool) -> Encoder:
    """One for each worker process and file."""
    kept = stash()
    if ("encoder", path, words) not in kept:
        kept["encoder", path, words] = Encoder(path, words)
    return kept["encoder", path, words]
