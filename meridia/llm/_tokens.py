"""Token ids of whole texts as bytes of little-endian 32-bit numbers, by the tokenizers library."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

#: Characters of one call on a text that takes the library's own way.
CHUNK = 500_000
_CHUNK_END = re.compile(r"(?<=[!-~]) (?=[0-9A-Za-z])")
#: Texts of these characters only are cut into pieces here, exactly as the tokenizers cut them.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The cutting patterns of the two public tokenizers, over plain characters.
BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")


#: Pieces of one generation; of two at most, what is not asked for again goes with the older.
PIECES = 150_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


class PieceIds(dict):
    """The ids, as bytes, of each piece of a text; the library's model is asked once for a piece while it is remembered."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters, self.older = model, _byte_letters(), {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()
        if len(self) >= PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """Encodes texts with a public tokenizer file. Plain texts are cut into pieces here, and known pieces are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        name = str(self.tokenizer.pre_tokenizer)
        if name.startswith("ByteLevel") and "use_regex=True" in name and "add_prefix_space=False" in name and self.tokenizer.normalizer is None:
            self.cut, self.lower = BYTE_LEVEL, False
        elif "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in name and "NFC" in str(self.tokenizer.normalizer):
            self.cut, self.lower = WORD_LEVEL, True
        else:
            self.cut, self.lower = None, False
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = PieceIds(self.tokenizer.model)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _direct(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > CHUNK and (m := _CHUNK_END.search(text, at + CHUNK)):
                end = m.start()
            out.append(array("I", self.tokenizer.encode_batch_fast([text[at:end]], add_special_tokens=False)[0].ids).tobytes())
            at = end
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if self.cut is None or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self._direct(text)
        return b"".join(map(self.known.__getitem__, self.cut.findall(text.lower() if self.lower else text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker, kept from task to task with the pieces it knows."""
    return Encoder(path)
