"""Operator 1: BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the UTF-8 bytes cuts each text where the content itself
says so, hence texts that share a passage share its chunks.  A chunk's inner
words are encoded once per task and looked up by the chunk's 128-bit hash
afterwards.  A cut may fall inside a word, so a chunk keeps the bytes before
its first and after its last white space unencoded: a join is repaired by
re-encoding that stretch, extended over as many chunks as it takes until it
ends at white space on both sides.  There the two encodings agree exactly,
because the tokenizer's own splitting never reaches across ASCII white space.

Null texts count as empty; an empty text has no ids and decodes to the empty
text.  Rows are independent: repeated rows and ties give repeated results, an
empty table an empty one, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import bytes_of, map_arrow, sha256_hex, to_batch

#: Mean chunk length is 2 ** CHUNK_BITS bytes, the least is LEAST_CHUNK.
CHUNK_BITS = 10
LEAST_CHUNK = 256
#: Memo sizes of a worker; half of a full memo goes.
MEMO_WORDS = 300_000
MEMO_CHUNKS = 20_000

_GEAR = np.random.RandomState(20_240_229).randint(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
_SPACES = b" \t\n\r\x0b\x0c"
#: A word that no text of ours holds; texts that hold it are encoded word by word.
_MARK = b"\x01"
_BETWEEN = b" " + _MARK + b" "


class Memo:
    """A map that forgets its older entries, never an answer: what is missing is computed again."""

    def __init__(self, limit: int) -> None:
        self.limit, self.new, self.old = limit // 2, {}, {}

    def get(self, key: bytes):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: bytes, value) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = value


def chunks(data: bytes, bits: int = CHUNK_BITS, least: int = LEAST_CHUNK) -> list[bytes]:
    """Content-defined chunks; their concatenation is ``data`` and no character is split."""
    n = len(data)
    if n <= least:
        return [data] if data else []
    raw = np.frombuffer(data, np.uint8)
    rolled = _GEAR[raw]
    for step in (1, 2, 4, 8):  # after these, position i has hashed bytes i-15..i
        rolled[step:] = rolled[step:] + (rolled[:-step] << np.uint32(step))
    hits = np.flatnonzero((rolled[:-1] >> np.uint32(16)) & np.uint32((1 << bits) - 1) == 0) + 1
    hits = hits[(raw[hits] & 0xC0) != 0x80]
    out, start = [], 0
    for at in hits.tolist():
        if at - start >= least:
            out.append(data[start:at])
            start = at
    out.append(data[start:])
    return out


class ChunkedBpe:
    """Encoder and decoder equal to the tokenizer in ``path``, without special-token insertion."""

    def __init__(self, path: str, bits: int = CHUNK_BITS, least: int = LEAST_CHUNK) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits, self.least = bits, least
        self.mark = self.tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids[0]
        self.words: dict[bytes, bytes] = {}
        self.chunk_memo = Memo(MEMO_CHUNKS)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]

    def _learn(self, words: set[bytes]) -> None:
        if len(self.words) + len(words) > MEMO_WORDS:  # what was met first is met most
            self.words = dict(islice(self.words.items(), MEMO_WORDS // 2))
        todo = list(words)
        plain = [w for w in todo if _MARK not in w]
        for at in range(0, len(plain), 512):  # one call for many words, told apart by a word of their own
            some = plain[at : at + 512]
            ids = np.array(self._ids(_BETWEEN.join(some)), np.uint32)
            ends = np.flatnonzero(ids == self.mark).tolist()
            if len(ends) != len(some) - 1:
                plain = plain[:at]
                break
            for word, a, b in zip(some, [0, *[e + 1 for e in ends]], [*ends, len(ids)], strict=True):
                self.words[word] = ids[a:b].tobytes()
        for word in todo if len(plain) < len(todo) else ():
            if word not in self.words:
                self.words[word] = np.array(self._ids(word), np.uint32).tobytes()

    def _ids(self, data: bytes) -> list[int]:
        return self.tokenizer.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids

    def _encode_words(self, words: list[bytes]) -> bytes:
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            missing = {w for w in words if w not in known}
            if len(known) + len(missing) > MEMO_WORDS:
                missing = set(words)  # some of the known ones are about to go
            self._learn(missing)
            return b"".join([self.words[w] for w in words])

    def _parts(self, chunk: bytes) -> tuple[bytes, bytes, bytes, bool]:
        """Bytes before the first white space, ids of the words between, bytes after the last, and whether there is any."""
        key = xxhash.xxh3_128_digest(chunk)
        if (found := self.chunk_memo.get(key)) is not None:
            return found
        words = chunk.split()
        if not words:
            found = (b"", b"", b"", bool(chunk))
        elif len(words) == 1 and len(words[0]) == len(chunk):
            found = (chunk, b"", b"", False)
        else:
            lead = b"" if chunk[:1] in _SPACES_SET else words[0]
            trail = b"" if chunk[-1:] in _SPACES_SET else words[-1]
            inner = words[bool(lead) : len(words) - bool(trail)]
            found = (lead, self._encode_words(inner), trail, True)
        self.chunk_memo.put(key, found)
        return found

    def encode(self, data: bytes) -> np.ndarray:
        """Ids of a text given as UTF-8 bytes."""
        out, open_end = [], b""
        if b"<|" not in data:  # the tokenizer lower-cases all but its special tokens
            data = data.lower()
        for chunk in chunks(data, self.bits, self.least):
            lead, inner, trail, spaced = self._parts(chunk)
            open_end += lead
            if spaced:  # the repaired stretch ends here: both sides agree from this white space on
                if open_end:
                    out.append(self._encode_words([open_end]))
                out.append(inner)
                open_end = trail
        if open_end:
            out.append(self._encode_words([open_end]))
        return np.frombuffer(b"".join(out), np.uint32)

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """UTF-8 bytes of the decoded text: this tokenizer has no decoder, so pieces are joined by a space."""
        pieces = self.pieces
        return b" ".join([pieces[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])


_SPACES_SET = {bytes([b]) for b in _SPACES}
_made: dict[tuple, ChunkedBpe] = {}


def encoder(path: str) -> ChunkedBpe:
    """The worker's own encoder; its memos live as long as a task."""
    if path not in _made:
        _made[path] = ChunkedBpe(path)
    return _made[path]


def forgetting(bpe: ChunkedBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task, after which the memos are emptied: the worker's next task may be another operator's."""
    try:
        yield from batches
    finally:
        bpe.words, bpe.chunk_memo = {}, Memo(MEMO_CHUNKS)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>, decoded string`` of every row."""
    key = dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in forgetting(bpe, batches):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            offsets = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
            flat = pa.array(np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int32))
            texts = pa.array([bpe.decode(i).decode("utf-8", "replace") for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat), texts], names=[id_col, "ids", "decoded"])

    return map_arrow(docs.select(id_col, bytes_of(text_col).alias("_text")), work, f"`{id_col}` {key}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: the same encoding, without carrying ids and text out of the worker."""
    key = dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        numbers = [str(i).encode() for i in range(len(bpe.pieces))]
        for batch in forgetting(bpe, batches):
            count, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text).tolist()
                count.append(len(ids))
                of_ids.append(sha256_hex(b" ".join([numbers[i] for i in ids])))
                of_text.append(sha256_hex(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *to_batch({"n": count, "a": of_ids, "b": of_text}, {"n": pa.int64(), "a": pa.string(), "b": pa.string()}).columns], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(id_col, bytes_of(text_col).alias("_text")), work, f"`{id_col}` {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")
