"""Token ids of whole texts by the tokenizers library, each distinct chunk of a batch encoded once.

Texts are cut only where a token always ends, so the ids are those of the whole text: for vocabularies that drop
white space at every ASCII space, for byte-level ones before a space that stands between two letters of any kind but
white space. Texts in which spaces stand otherwise, or that hold the string of a special token, are encoded whole.
Special tokens are treated as the library does by default: their strings in a text become their one id.
"""

from __future__ import annotations

import os
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from voxelspan.llm.common import words_of

#: Distinct chunks a Python worker remembers, some 40 MB; others are encoded again in each batch.
REMEMBERED = 200_000
#: Marks that may follow a word's letters: ASCII's but the apostrophe.
MARKS = string.punctuation.replace("'", "")
#: A space at an end of the text or beside white space, by Unicode's White_Space.
_ODD_SPACE = r"^ | $| [\s\pZ\x{0B}\x{85}]|[\s\pZ\x{0B}\x{85}] "
_ENCODERS: dict = {}


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[starts[c]:starts[c] + lengths[c]] for c in codes, one after another, and their ends."""
    n = lengths[codes]
    ends = np.cumsum(n)
    at = np.repeat(starts[codes] - (ends - n), n)
    at += np.arange(len(at))
    return flat[at], ends


class Encoder:
    """encode(texts): ids of all texts after one another (uint32), and offsets of the texts in them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.spaced = "ByteLevel" == type(self.library.pre_tokenizer).__name__  # tokens carry the space before them
        self.seen: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {k: byte_level.pre_tokenize_str(chr(k))[0][0] for k in range(0xA1, 0x100)}  # the vocabulary's letters for Latin-1 ones

    def _chunks(self, chunks: list[str], lead: str) -> list[bytes]:
        found = [self.seen.get(lead + c) for c in chunks]
        missing = [i for i, x in enumerate(found) if x is None]
        slow = []
        mark = "Ġ" if lead else ""
        for i in missing:
            c = chunks[i]
            word = c.rstrip(MARKS)
            if word.isalpha() and (word.isascii() or max(word) <= "ÿ"):  # one word for the merges, nothing to normalise but case
                letters = (mark + word if self.spaced else word.lower()) if word.isascii() else (mark + word.translate(self.bytes) if self.spaced else word.lower().translate(self.bytes))
                ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
                found[i] = ids if len(word) == len(c) else ids + self._tail(c[len(word) :])
            else:
                slow.append(i)
        for a in range(0, len(slow), 4096):
            some = slow[a : a + 4096]
            for i, e in zip(some, self.library.encode_batch_fast([lead + chunks[i] for i in some], add_special_tokens=False)):
                found[i] = array("I", e.ids).tobytes()
        for i in missing[: max(0, REMEMBERED - len(self.seen))]:
            self.seen[lead + chunks[i]] = found[i]
        return found

    def _tail(self, marks: str) -> bytes:
        """Ids of marks behind a word, which both kinds of vocabulary part from its letters; long ones aren't remembered."""
        ids = self.tails.get(marks)
        if ids is None:
            ids = array("I", self.library.encode(marks, add_special_tokens=False).ids).tobytes()
            if len(marks) <= 3:
                self.tails[marks] = ids
        return ids

    def _pack(self, found: list[bytes], codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        ids, ends = gather(flat, np.cumsum(lengths) - lengths, lengths, codes)
        return ids, np.concatenate([[0], ends])[offsets]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.spaced:
            codes, offsets, dictionary = words_of(texts)
            return self._pack(self._chunks(dictionary.to_pylist(), ""), codes, offsets)
        odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
        for mark in self.special:
            odd = odd | pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        plain = texts if not odd.any() else pc.if_else(pa.array(odd), "", texts)
        lists = pc.split_pattern(plain, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, names, base = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), len(coded.dictionary)
        first = offsets[:-1] - offsets[0]
        heads, codes[first] = np.unique(codes[first], return_inverse=True)
        codes[first] += base  # a text's first chunk has no space before it
        found = self._chunks(names, " ") + self._chunks([names[i] for i in heads], "")
        ids, ends = self._pack(found, codes, offsets - offsets[0])
        if odd.any():
            whole = self.library.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)
            parts = np.split(ids, ends[1:-1])
            for i, e in zip(np.flatnonzero(odd), whole):
                parts[i] = np.array(e.ids, np.uint32)
            ids, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids.astype(np.uint32, copy=False), ends


def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    n = len(offsets) - 1
    ends = offsets + np.arange(n + 1)
    out = np.full(len(ids) + n, end_id, np.uint32)
    own = np.ones(len(out), bool)
    own[ends[1:] - 1] = False
    out[own] = ids
    return out, ends
