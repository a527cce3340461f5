"""Token ids of whole texts by the tokenizers library, with each worker remembering short pieces.

Both vocabularies in use split a text at white space before they merge anything, so the ids of a
text are those of its pieces (a word with the white space before it) one after the other. Texts are cut
with Arrow, many at a time; only pieces that differ are looked up, and those that a worker has not met are
encoded: plain words by the tokenizer's model alone, others by the whole tokenizer. The memo is of bounded
size. A text with white space other than blank, tab, line feed and carriage return, or with a control string of
the vocabulary, is encoded in one go. tests/llm checks equality with plain whole-text encoding.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces a worker remembers at most, and the longest one that it remembers.
MEMO, MEMO_CHARS = 800_000, 48
_PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_ODD_SPACE = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"
#: White space that blanks and line feeds alone do not cut as the vocabulary does, and the sign for a text's start.
_RUNS = r"  |[\t\r\x00]| \n|\n |\n\n\n|\n\n\z"
_START = "\0"
#: Bytes of text that are encoded together, about.
BLOCK = 8 << 20
#: Marks that both vocabularies part from a letter before them.
_MARKS = ".,!?*$%&#|;:"
_ENCODERS: dict[str, Encoder] = {}


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies on this machine; every worker has its own installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str) -> Encoder:
    """The worker's encoder for a vocabulary file; its memo lives as long as the worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(vocabulary(name))
    return _ENCODERS[name]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about BLOCK bytes of text."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK, side="right")))
            yield batch.slice(at, end - at)
            at = end


class _Memo(dict):
    """Ids by piece, in two generations: what is used again moves to the young one (this dict);
    when that is full it becomes the old one, and the old one is dropped."""

    def __init__(self, ask, limit: int) -> None:
        self.ask, self.limit, self.old = ask, limit // 2, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            stem = piece.rstrip(_MARKS)
            # a letter that is lowered to a letter and a mark would join the mark to what follows
            if 0 < len(stem) < len(piece) and stem[-1] < "\u0250" and stem[-1].isalpha() and len(stem[-1].lower()) == 1:
                ids = self[stem] + self[piece[len(stem) :]]
            else:
                ids = self.ask(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write a byte: printable ones as they are, others from U+0100 on."""
    printable, others = {*range(33, 127), *range(161, 173), *range(174, 256)}, iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


class Encoder:
    def __init__(self, path: str, memo: int = MEMO) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.control = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = _Memo(self._piece, memo)
        #: Where white space is dropped and letters are lowered, pieces are words alone.
        self.words_only = self.tokenizer.normalizer is not None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; none for a null text."""
        found = self.encode_array(pa.array(texts, pa.string()))
        values, at = found.values.to_numpy(), found.offsets.to_numpy()
        return [values[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]

    def encode_array(self, texts: pa.Array, end_id: int | None = None) -> pa.ListArray:
        """Ids of each text as a list column, with end_id after each; a null text is empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _ODD_SPACE)
        for x in self.control:
            whole = pc.or_(whole, pc.match_substring(texts, x, ignore_case=True))
        apart = whole if self.words_only else pc.or_(whole, pc.match_substring_regex(texts, _RUNS))
        even = pc.if_else(apart, "", texts)
        if self.words_only:
            pieces = pc.ascii_split_whitespace(pc.if_else(pc.string_is_ascii(even), pc.ascii_lower(even), even))
        else:
            pieces = pc.split_pattern(pc.binary_join_element_wise(_START, pc.replace_substring(even, "\n", " \n"), ""), " ")
        coded = pieces.flatten().dictionary_encode()
        known = [self.memo[x] if x else b"" for x in map(self._key, coded.dictionary.to_numpy(zero_copy_only=False))]
        ids = _id_lists(known).take(coded.indices)
        at = ids.offsets.to_numpy()[pieces.offsets.to_numpy()].astype(np.int64)
        values = ids.values.to_numpy()[at[0] : at[-1]]
        at = at - at[0]
        # what was encoded apart, and the end ids, go in at the ends of their texts
        added = [b""] * len(texts)
        for i in np.flatnonzero(apart.to_numpy(zero_copy_only=False)):
            text = texts[i].as_py()
            added[i] = self._ask(text) if whole[i].as_py() else b"".join(map(self.memo.__getitem__, _PIECE.findall(text)))
        if end_id is not None:
            end = end_id.to_bytes(4, "little")
            added = [x + end for x in added]
        more = np.array([len(x) // 4 for x in added], np.int64)
        values = np.insert(values, np.repeat(at[1:], more), np.frombuffer(b"".join(added), np.int32))
        offsets = at + np.concatenate([[0], np.cumsum(more)])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))

    def _key(self, piece: str) -> str:
        """The text that a cut piece stands for: with the blank it was cut at, if there was one."""
        if self.words_only or piece[:1] == "\n":
            return piece
        return piece[1:] if piece[:1] == _START else " " + piece

    def _piece(self, piece: str) -> bytes:
        word = piece[1:] if piece[:1] == " " and not self.words_only else piece
        # letters up to Armenian are letters in all versions of Unicode in use
        if word.isalpha() and max(word) < "\u0590" and (not self.words_only or (word == word.lower() and unicodedata.is_normalized("NFC", word))):
            written = piece if word is piece and word.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        return self._ask(piece)

    def _ask(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def _id_lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
