"""SentencePiece encoding and decoding by an Aho-Corasick automaton over the pieces and one Viterbi pass.

The automaton reads a text once; at each place its output links name every piece that ends there, and each relaxes the
best path to that place. For a unigram model the best path has the highest sum of scores. A merge model (BPE) has one
path whose neighbours stay apart under the merges, and that one is the library's: a path is relaxed over a piece only
if the piece and the one before it, merged as a text of their own, stay those two. Characters outside the vocabulary
become byte pieces. Texts are cut before spaces where no piece reaches over; each distinct chunk is encoded once.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspan.llm.tokens import gather

SPACE = "▁"
# Fixed value: what the library decodes the unknown id to.
UNKNOWN = " ⁇ ".encode()
#: Distinct chunks and pairs of pieces that a Python worker remembers.
REMEMBERED, PAIRS = 300_000, 500_000
_MODELS: dict = {}


class Pieces:
    """A vocabulary: pieces with scores, and how its paths are chosen (merges or sums of scores)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], unknown: int, merges: bool, ids: list[int] | None = None, prefix: bool = True):
        ids = list(range(len(pieces))) if ids is None else ids
        self.score = {p: s for p, s in pieces}
        self.id = {p: i for (p, _), i in zip(pieces, ids)}
        self.byte_ids, self.unknown, self.merges, self.prefix = byte_ids, unknown, merges, prefix
        self.low = min((s for _, s in pieces), default=0.0) - 10.0  # of a character without a piece
        self.automaton = ahocorasick.Automaton()
        for p, _ in pieces:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: No piece reaches from before a space over it, so chunks stand alone.
        self.cut = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces)
        self.apart: dict[tuple[str, str], bool] = {}
        self.seen: dict[str, bytes] = {}
        #: Bytes that an id stands for.
        self.bytes_of = {i: p.replace(SPACE, " ").encode() for p, i in self.id.items()}
        self.bytes_of |= {i: bytes([b]) for b, i in byte_ids.items()}
        if unknown >= 0:
            self.bytes_of[unknown] = UNKNOWN

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        pieces = [(m.id_to_piece(i), m.get_score(i)) for i in plain]
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(m.serialized_model_proto())
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only vocabularies that leave texts as they are can be read")
        merges = spec.trainer_spec.model_type == spec.trainer_spec.BPE
        byte_ids = {int(m.id_to_piece(i)[3:5], 16): i for i in range(m.get_piece_size()) if m.is_byte(i)}
        return cls(pieces, byte_ids, m.unk_id(), merges, plain, rules.add_dummy_prefix)

    def merge(self, text: str) -> list[str]:
        """The merges of a short text, best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
            if not scored:
                break
            i = min(scored)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stay(self, a: str, b: str) -> bool:
        """Whether a and b stay apart; a is empty at the start, where b alone has to come out of its own merges."""
        key = (a, b)
        got = self.apart.get(key)
        if got is None:
            got = self.merge(a + b) == ([a, b] if a else [b])
            if len(self.apart) < PAIRS:
                self.apart[key] = got
        return got

    def path(self, text: str) -> list[str]:
        """The pieces of a chunk; a character that no piece gives is a piece of its own."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        back: list[str] = [""] * (n + 1)
        best[0] = 0.0
        done = 0

        def bridge(upto: int) -> None:
            """Relaxes single characters where no piece led to."""
            nonlocal done
            while done < upto:
                done += 1
                if best[done] is None:
                    best[done], back[done] = best[done - 1] + self.low, text[done - 1]

        for end, piece in self.automaton.iter(text):
            bridge(end)
            start = end + 1 - len(piece)
            before = best[start]
            if before is None or self.merges and (best[end + 1] is not None or not self.stay(back[start], piece)):
                continue
            total = before + self.score[piece]
            if best[end + 1] is None or total > best[end + 1]:
                best[end + 1], back[end + 1] = total, piece
        bridge(n)
        out = []
        while n:
            out.append(back[n])
            n -= len(back[n])
        return out[::-1]

    def ids_of(self, text: str) -> list[int]:
        out = []
        for p in self.path(text):
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after one another (uint32) and the texts' offsets in them; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        spaced = pc.replace_substring(texts, " ", SPACE)
        if self.prefix:
            spaced = pc.if_else(pc.equal(pc.binary_length(spaced), 0), "", pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), spaced, pa.scalar("", pa.large_string())))
        odd = pc.match_substring_regex(spaced, f"{SPACE}{SPACE}|{SPACE}$").to_numpy(zero_copy_only=False) | (not self.cut)
        plain = pc.if_else(pa.array(odd), "", spaced) if odd.any() else spaced
        lists = pc.split_pattern(plain, SPACE)  # the first part is empty where the text begins with a space
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        first = offsets[:-1] - offsets[0]
        heads, codes[first] = np.unique(codes[first], return_inverse=True)
        codes[first] += len(names)
        found = [self._chunk(SPACE + c) for c in names] + [self._chunk(names[i]) for i in heads]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, ends = gather(np.frombuffer(b"".join(found), np.uint32), np.cumsum(lengths) - lengths, lengths, codes)
        ends = np.concatenate([[0], ends])[offsets - offsets[0]]
        if odd.any():
            parts = np.split(ids, ends[1:-1])
            for i in np.flatnonzero(odd).tolist():
                text = spaced[i].as_py()
                chunks = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text) if self.cut else [text]
                parts[i] = np.frombuffer(b"".join(self._chunk(c) for c in chunks), np.uint32)
            ids, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, ends

    def _chunk(self, chunk: str) -> bytes:
        got = self.seen.get(chunk)
        if got is None:
            got = array("I", self.ids_of(chunk)).tobytes() if chunk else b""
            if len(self.seen) < REMEMBERED:
                self.seen[chunk] = got
        return got

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that encoding puts first.

        Bytes that are no UTF-8 become U+FFFD, the unknown id the mark that the library writes; control ids and ids
        outside the vocabulary are nothing.
        """
        parts = [x for x in (self.bytes_of.get(i, b"") for i in ids.tolist()) if x]
        if self.prefix and parts and parts[0][:1] == b" " and parts[0] is not UNKNOWN:
            parts[0] = parts[0][1:]
        return b"".join(parts).decode("utf-8", "replace")


def model(path: str) -> Pieces:
    """One for each file and Python worker."""
    if path not in _MODELS:
        _MODELS[path] = Pieces.load(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids, an array, of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 3000):
                some = batch.slice(k, 3000)
                ids, ends = model(path).encode(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids; a null array is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model(path).decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256, same of each row of docs, encoded and decoded again.

    same: the decoded text is the row's (null counts as empty). Rows are not told apart by doc_id: repeated ones and
    those without one return a row each. Other columns of docs are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 3000):
                some, rows = batch.slice(k, 3000), []
                ids, ends = m.encode(some.column(1))
                for a, b, text in zip(ends[:-1].tolist(), ends[1:].tolist(), some.column(1).to_pylist()):
                    back = m.decode(ids[a:b])
                    rows.append((b - a, zlib.crc32(ids[a:b].tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
                n, crc, sha, same = zip(*rows)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "same"])

    schema = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, same boolean"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)
