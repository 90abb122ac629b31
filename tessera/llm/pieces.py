"""Operator 13: encoding and decoding with a SentencePiece vocabulary of the merge type.

A text's spaces become the mark U+2581 and one mark goes before it.  Each
character is a symbol; an agenda holds the adjacent pairs whose joint text is a
piece, the best score first and of equal scores the leftmost.  The top pair is
merged, its new neighbour pairs join the agenda, and pairs whose symbols have
changed meanwhile are passed over.  Symbols that are no piece in the end are
spelt as byte pieces.

Where two neighbouring characters stand together in no piece, no merge ever
crosses between them: a text is cut there into segments that are encoded apart.
A task keeps what it has encoded in a memo of bounded size, and forgets the older
half where it is full.  The new segments of an Arrow batch are encoded together:
the agendas of short ones are rows of a matrix, of which every round takes each
row's top pair; a long one has an agenda of its own, a heap, in n log n.

In every Arrow batch the segments that the agenda has just encoded are held
against the sentencepiece library, and so is each whole text whose crc32 is a
multiple of ``WHOLE_TEXTS``; a difference raises an error.

Null texts count as empty; an empty text has the end id alone and decodes to the
empty text.  Rows are independent: repeated rows give repeated results, an empty
table an empty one, and columns other than the id and the text are not read,
whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bytes_of, map_arrow, sha256_hex, to_batch

#: The mark that stands for a space.
MARK = "▁"
#: Segments that a task remembers.
MEMO_SEGMENTS = 600_000
#: Segments of at most so many characters share a matrix; rows of one matrix.
ROW_WIDTH = 32
ROWS = 20_000
#: One text in so many is also held against the library as a whole.
WHOLE_TEXTS = 64

_NONE = np.iinfo(np.int32).max


def agenda(text: str, scores: dict[str, float]) -> list[str]:
    """The symbols that are left of ``text`` once no adjacent pair is a piece."""
    symbols: list[str | None] = list(text)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting: list[tuple[float, int, int, str]] = []

    def offer(left: int, right: int) -> None:
        joint = symbols[left] + symbols[right]
        if (score := scores.get(joint)) is not None:
            heapq.heappush(waiting, (-score, left, right, joint))

    for i in range(n - 1):
        offer(i, i + 1)
    while waiting:
        _, left, right, joint = heapq.heappop(waiting)
        if symbols[left] is None or symbols[right] is None or symbols[left] + symbols[right] != joint or after[left] != right:
            continue
        symbols[left], symbols[right] = joint, None
        after[left] = following = after[right]
        if following < n:
            before[following] = left
            offer(left, following)
        if before[left] >= 0:
            offer(before[left], left)
    return [s for s in symbols if s is not None]


class Pieces:
    """Encoder and decoder equal to the sentencepiece model in ``path``, with an end id and without a start id."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = library = SentencePieceProcessor(model_file=path)
        ids = range(library.get_piece_size())
        names = [library.id_to_piece(i) for i in ids]
        kept = [i for i in ids if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        self.id_of = {names[i]: i for i in kept}
        self.scores = {names[i]: library.get_score(i) for i in kept if not library.is_unused(i)}
        self.byte_id = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = library.eos_id()
        self.plain = [b"" if library.is_control(i) else names[i].replace(MARK, " ").encode() for i in ids]
        self.plain[library.unk_id()] = " ⁇ ".encode()
        self.byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_id) if library.is_byte(i)}
        for i, b in self.byte_of.items():
            self.plain[i] = b
        probe = "  a éﬁ İ "
        if library.normalize(probe) != self.marked(probe):
            raise ValueError("the model rewrites texts before it splits them; only identity normalisation with a leading mark is supported")
        if len(self.byte_of) < 256:
            raise ValueError("a vocabulary without byte pieces is not supported")
        self.memo: dict[str, bytes] = {}  # ids of segments as int32
        self._tables()
        if any("\n" in s for s in self.scores):
            raise ValueError("pieces with line ends are not supported")

    def _tables(self) -> None:
        """Which characters stand together in a piece, and which symbols make which piece at which rank, as sorted arrays."""
        letters = sorted({c for s in self.scores for c in s})
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joins = np.zeros((len(letters) + 1) ** 2, bool)
        self.side = len(letters) + 1
        names = [*letters, *(s for s in self.scores if len(s) > 1)]  # symbols by number; the letters keep theirs
        number = {s: i for i, s in enumerate(names, 1)}
        rank = {score: i for i, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        made = []
        for s, score in self.scores.items():
            for k in range(1, len(s)):
                self.joins[number[s[k - 1]] * self.side + number[s[k]]] = True
                if s[:k] in number and s[k:] in number:
                    made.append((number[s[:k]] << 32 | number[s[k:]], rank[score], number[s]))
        made.sort()
        self.pairs = np.array([m[0] for m in made] or [-1], np.int64)
        self.pair_rank = np.array([m[1] for m in made] or [_NONE], np.int32)
        self.pair_makes = np.array([m[2] for m in made] or [0], np.int32)
        self.id_of_symbol = np.array([0, *(self.id_of.get(s, -1) for s in names)], np.int32)  # -1: spelt in bytes

    def _spelt(self, symbol: str) -> bytes:
        known = self.id_of.get(symbol)
        return np.array([known] if known is not None else [self.byte_id[b] for b in symbol.encode()], np.int32).tobytes()

    @staticmethod
    def marked(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def segments(self, texts: list[str]) -> list[list[str]]:
        """Each text, marked and cut where no piece spans two neighbouring characters."""
        marked = [self.marked(t) for t in texts]
        flat = "".join(marked)
        if not flat:
            return [[] for _ in texts]
        letter = self.letter[np.frombuffer(flat.encode("utf-32-le"), np.uint32)]
        ends = np.cumsum([len(m) for m in marked])
        cut = np.append(~self.joins[letter[:-1] * self.side + letter[1:]], True)
        cut[ends[ends > 0] - 1] = True
        at = np.flatnonzero(cut) + 1
        upto = np.searchsorted(at, ends, side="right").tolist()
        bounds = [0, *at.tolist()]
        parts = [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        return [parts[a:b] for a, b in zip([0, *upto], upto, strict=False)]

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols (``_NONE``: no piece) and the symbol it makes."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        known = (self.pairs[at] == key) & (left > 0) & (right > 0)
        return np.where(known, self.pair_rank[at], _NONE), self.pair_makes[at]

    def rows(self, segments: list[str]) -> list[bytes]:
        """Ids of segments of similar, short lengths: an agenda a row, whose top pairs are merged in rounds."""
        width = max(map(len, segments)) + 1
        codes = np.frombuffer("".join(s.ljust(width, "\0") for s in segments).encode("utf-32-le"), np.uint32).reshape(-1, width)
        lengths = np.array([len(s) for s in segments])
        symbols = np.where(np.arange(width) < lengths[:, None], self.letter[codes], 0)
        rank = self._ranked(symbols[:, :-1], symbols[:, 1:])[0]
        alive = np.arange(len(segments))
        places = np.arange(width)
        while alive.size:
            top = rank[alive].argmin(1)  # the leftmost of the best
            more = rank[alive, top] < _NONE
            alive, top = alive[more], top[more]
            if not alive.size:
                break
            joint = self._ranked(symbols[alive, top], symbols[alive, top + 1])[1]
            moved = np.minimum(places + (places > top[:, None]), width - 1)
            now = np.take_along_axis(symbols[alive], moved, 1)
            now[:, -1] = 0
            now[np.arange(len(alive)), top] = joint
            ranks = np.take_along_axis(rank[alive], moved[:, : width - 1].clip(max=width - 2), 1)
            ranks[:, -1] = _NONE
            each = np.arange(len(alive))
            ranks[each, top] = self._ranked(joint, now[each, np.minimum(top + 1, width - 1)])[0]
            before = np.maximum(top - 1, 0)
            ranks[each, before] = np.where(top > 0, self._ranked(now[each, before], joint)[0], ranks[each, before])
            symbols[alive], rank[alive] = now, ranks
        left = symbols > 0
        ids, ends = self.id_of_symbol[symbols[left]], np.cumsum(left.sum(1)).tolist()
        data = ids.tobytes()
        made = [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]
        for i in np.flatnonzero((self.id_of_symbol[symbols] < 0).any(1)).tolist():
            made[i] = self._alone(segments[i])
        return made

    def _alone(self, segment: str) -> bytes:
        return b"".join([self._spelt(x) for x in agenda(segment, self.scores)])

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment by its agenda."""
        made: dict[int, bytes] = {}
        short = []
        for i, s in enumerate(segments):
            if len(s) == 1:
                made[i] = self._spelt(s)
            elif len(s) > ROW_WIDTH:
                made[i] = self._alone(s)
            else:
                short.append(i)
        short.sort(key=lambda i: len(segments[i]))
        for at in range(0, len(short), ROWS):
            some = short[at : at + ROWS]
            made.update(zip(some, self.rows([segments[i] for i in some]), strict=True))
        return [made[i] for i in range(len(segments))]

    def learn(self, segments: list[str]) -> dict[str, bytes]:
        """Encodes new segments and holds them against the library, for which every text begins with a mark.

        A segment without one is asked for after a line end, which no piece holds.
        """
        made = dict(zip(segments, self.encode_segments(segments), strict=True))
        marked = [s for s in segments if s[0] == MARK and len(s) > 1]
        bare = [s for s in segments if s[0] != MARK]
        before = np.array(self.library.encode("\n"), np.int32).tobytes()
        for own, asked, lead in ((marked, [s[1:].replace(MARK, " ") for s in marked], b""), (bare, ["\n" + s for s in bare], before)):
            want = np.fromiter(chain.from_iterable(self.library.encode(asked)), np.int32).tobytes()
            if b"".join([lead + made[s] for s in own]) != want:
                wrong = next(s for s, a in zip(own, asked, strict=True) if np.frombuffer(lead + made[s], np.int32).tolist() != self.library.encode(a))
                raise AssertionError(f"the agenda and the library differ on {wrong!r}")
        return made

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, the end id included."""
        parts = self.segments(texts)
        new = [s for s in set(chain.from_iterable(parts)) if s not in self.memo]
        known = self.memo
        if new:
            fresh = self.learn(new)
            if len(known) + len(fresh) > MEMO_SEGMENTS:
                known = known | fresh  # what this batch needs, whatever is forgotten after it
                self.memo = dict(islice(known.items(), max(0, len(known) - MEMO_SEGMENTS // 2), None))
            else:
                known.update(fresh)
        out, last = [], np.array([self.end], np.int32).tobytes()
        for text, own in zip(texts, parts, strict=True):
            ids = np.frombuffer(b"".join([known[s] for s in own]) + last, np.int32)
            if zlib.crc32(text.encode()) % WHOLE_TEXTS == 0 and ids.tolist() != self.library.encode(text, add_eos=True):
                raise AssertionError(f"the agenda and the library differ on a text of {len(text)} characters")
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 bytes of the text that ids stand for; bytes that make no character become U+FFFD one by one."""
        ids = ids[:-1] if ids and ids[-1] == self.end else ids
        plain = self.plain
        parts = [plain[i] for i in ids]
        data = b"".join(parts)
        if b"" in parts or not _is_text(data):  # a control id stands between bytes, or they are no characters
            data = b"".join(self._runs(ids))
        first = next((i for i in ids if plain[i]), None)
        return data[1:] if first is not None and self.library.id_to_piece(first).startswith(MARK) else data

    def _runs(self, ids: list[int]) -> Iterator[bytes]:
        run = b""
        for i in [*ids, None]:
            if i in self.byte_of:
                run += self.byte_of[i]
                continue
            while run:
                size = next((k for k in range(1, 5) if _is_character(run[:k])), 0)
                yield run[:size] if size else "\ufffd".encode()
                run = run[max(size, 1) :]
            if i is not None:
                yield self.plain[i]


def _is_text(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


_made: dict[str, Pieces] = {}


def _tokenised(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pieces, pa.RecordBatch, list[np.ndarray]]]:
    """Each batch with its texts' ids; the memo is emptied when the task ends, as the worker's next task may be another operator's."""
    if path not in _made:
        _made[path] = Pieces(path)
    pieces = _made[path]
    try:
        for batch in batches:
            yield pieces, batch, pieces.encode_batch([t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()])
    finally:
        pieces.memo = {}


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>, decoded string`` of every row."""
    key = dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces, batch, ids in _tokenised(path, batches):
            offsets = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
            flat = pa.array(np.concatenate([np.empty(0, np.int32), *ids]))
            texts = pa.array([pieces.decode(i.tolist()).decode() for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat), texts], names=[id_col, "ids", "decoded"])

    return map_arrow(docs.select(id_col, bytes_of(text_col).alias("_text")), work, f"`{id_col}` {key}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: the same encoding, without carrying ids and text out of the worker."""
    key = dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: list[bytes] = []
        for pieces, batch, ids in _tokenised(path, batches):
            numbers = numbers or [str(i).encode() for i in range(len(pieces.plain))]
            made: dict[str, list] = {"n": [], "a": [], "b": []}
            for one in ids:
                listed = one.tolist()
                made["n"].append(len(listed))
                made["a"].append(sha256_hex(b" ".join([numbers[i] for i in listed])))
                made["b"].append(sha256_hex(pieces.decode(listed)))
            columns = to_batch(made, {"n": pa.int64(), "a": pa.string(), "b": pa.string()}).columns
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    made = docs.select(id_col, bytes_of(text_col).alias("_text"))
    return map_arrow(made, work, f"`{id_col}` {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")
