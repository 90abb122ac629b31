"""Operator 6: language-model scoring with a causal self-attention model in numpy.

Tokens: words (maximal runs of anything but ASCII white space) with A-Z
lower-cased, then one end.  The base score adds log10((c + 1) / (N + V + 1))
over the tokens, with counts from all training texts.

Counting is distributed: tasks count the 64-bit hashes of their words, the
counts are summed by hash.  Words with at least N / ``FREQUENT`` occurrences -
of which there are at most ``FREQUENT``, whatever the corpus - are broadcast;
the others meet their counts in a join and are summed per text.

The model reads subword ids: a word is split by the first ``MERGES`` merges of
a public vocabulary over its 256 bytes and 256 word-final bytes, so any text
has ids, and ids determine the words.  Texts are read and split once; every
pass, the counts and base scores too, reads the ids (``subwords``).  The next id is predicted by a two-level
softmax (class of ids, id in the class).  Its logits add what the id before
tells - log shares from the counts of all neighbouring ids, interpolated with
the ids' own shares - and what a network tells: one causal attention layer with
relative position biases and one hidden layer.  Windows of ``WINDOW`` ids
overlap by ``WINDOW - STRIDE``: a window scores its last ``STRIDE`` ids, so each
id is scored once, with batched masked attention over 8 to 23 ids before it.
The score is log10 of the probability of the ids and the end.

The model learns from all training texts, as the counts do.  The neighbour
counts set the classes and the first table.  Then every block of every training
text is a training example: tasks fit copies of the network on their own texts,
in ``ROUNDS`` rounds over disjoint parts of the ids, and after a round the copies
are averaged, weighted by their blocks.  A task makes at least ``STEPS`` steps, so
there are more tasks with more text; texts for one task only are read repeatedly
until it has made them.  The result depends on how the rows are dealt over
partitions.  Held out are ids whose crc32 modulo 7 is 2.

The base score gives every unseen word the share 1 / (N + V + 1), however many
there may be, while the model's probabilities of all texts add up to one.  The
two are comparable on the known words.

Null texts count as empty: one token, the end.  Without training texts N and V
are 0 and the model keeps its initial weights.  Null ids stay (their fold is
that of the empty text), repeated rows repeat their result (the model's score up to
float32 rounding), an empty table
gives an empty result, other columns are not read.
"""

from __future__ import annotations

import copy
import json
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, bytes_of, cut, map_arrow

FOLDS, HELD_OUT = 7, 2
FREQUENT = 400_000
MERGES = 1024
WINDOW, STRIDE = 24, 16
WIDTH, HIDDEN = 16, 32
CLASS = 40
STEPS, BATCH_BLOCKS = 1_100, 256
RATE = 0.015
ROUNDS = 8
#: Weights of the wider distribution in the shares after an id: classes by all classes, ids by their class.
CLASS_PRIOR, MEMBER_PRIOR = 5.0, 2.0
#: Logits above this are cut, so that exponentials stay finite.
MOST_LOGIT = np.float32(60)
#: Blocks that are mixed before they are dealt into batches, and neighbours that are counted at once.
MIXED_BLOCKS = 16_384
COUNTED_PAIRS = 1_000_000
#: Blocks whose states are made at once, and blocks whose targets are dealt by class at once.
SCORED_BLOCKS, HELD_BLOCKS = 128, 2_048
MEMO_WORDS = 500_000
SPLIT_WORDS = 1_000
COUNTED = 400_000
#: The hash of the end token; words hash to anything.
_END_HASH = int(np.uint64(xxhash.xxh3_64_intdigest(b" end ")).view(np.int64))


class Remembered(dict):
    """Answers of a function by word; when it is full, half of it goes: what was met first is met most."""

    def __init__(self, answer: Callable[[bytes], object], limit: int = MEMO_WORDS) -> None:
        super().__init__()
        self.answer, self.limit = answer, limit

    def __missing__(self, word: bytes) -> object:
        found = self.answer(word)
        self.add({word: found})
        return found

    def add(self, found: dict[bytes, object]) -> None:
        if len(self) + len(found) > self.limit:
            kept = list(islice(self.items(), self.limit // 2))
            self.clear()
            self.update(kept)
        self.update(islice(found.items(), self.limit // 2))


class Pieces:
    """Words to subword ids, by the first merges of a public vocabulary file."""

    def __init__(self, path: str, merges: int = MERGES) -> None:
        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"][:merges]]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}
        forms = {self.letters[b]: bytes([b]) for b in range(256)}
        forms |= {self.letters[b] + "</w>": bytes([b]) + b" " for b in range(256)}
        for a, b in pairs:
            forms.setdefault(a + b, forms[a] + forms[b])
        vocabulary = {p: n for n, p in enumerate(forms)}
        self.size = len(vocabulary) + 1
        self.end = len(vocabulary)
        #: What each id stands for, with a space behind a word's last one; an end is nothing.
        self.forms = [*forms.values(), b""]
        self.last = np.array([form.endswith(b" ") for form in self.forms])
        self.bpe = BPE(vocab=vocabulary, merges=pairs, end_of_word_suffix="</w>", cache_capacity=0)  # the memo is the cache
        self.several = Tokenizer(self.bpe)
        self.several.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.memo = Remembered(lambda word: self._split([word])[word])

    def _split(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of different words."""
        out: dict[bytes, bytes] = {}
        for at in range(0, len(words), SPLIT_WORDS):
            some = words[at : at + SPLIT_WORDS]
            ids = np.array(self.several.encode(" ".join([w.decode("latin-1").translate(self.letters) for w in some]), add_special_tokens=False).ids, np.uint16)
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.last[ids]) + 1) * 2).tolist()
            out.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends)], strict=True))
        return out

    def __getitem__(self, word: bytes) -> bytes:
        return self.memo[word]

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of the words, framed by ends."""
        end = np.array([self.end], np.uint16).tobytes()
        found = list(map(self.memo.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            made = self._split(list(dict.fromkeys([words[k] for k in new])))
            for k in new:
                found[k] = made[words[k]]
            self.memo.add(made)
        return np.frombuffer(b"".join([end, *found, end]), np.uint16).astype(np.int64)

    def words(self, ids: np.ndarray) -> list[bytes]:
        """The words that have these ids."""
        return b"".join(map(self.forms.__getitem__, ids.tolist())).split()


def windows(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of one text: input windows, targets, which targets count, and which blocks have nothing before them."""
    n = len(ids) - 1
    blocks = max(1, -(-n // STRIDE))
    lead = WINDOW - STRIDE
    padded = np.full(lead + blocks * STRIDE + 1, end, np.int64)
    padded[lead : lead + n + 1] = ids
    at = np.arange(blocks)[:, None] * STRIDE
    scored = np.arange(blocks * STRIDE).reshape(blocks, STRIDE) < n
    return padded[at + np.arange(WINDOW)], padded[at + lead + 1 + np.arange(STRIDE)], scored, np.arange(blocks) == 0


_OFFSET = np.arange(STRIDE)[:, None] + (WINDOW - STRIDE) - np.arange(WINDOW)[None, :]
_FUTURE = _OFFSET < 0
_BEFORE = np.arange(WINDOW) < WINDOW - STRIDE


def _soften(logits: np.ndarray) -> np.ndarray:
    """Exponentials of the logits, in place, and their sums."""
    if logits.size and not logits.max() <= MOST_LOGIT:  # seldom
        np.minimum(logits, MOST_LOGIT, out=logits)
    np.exp(logits, out=logits)
    return _sums(logits)


def _sums(rows: np.ndarray) -> np.ndarray:
    """Sums over the last axis, as a product, which is faster than adding up short rows."""
    width = rows.shape[-1]
    return (rows.reshape(-1, width) @ np.ones(width, rows.dtype)).reshape(rows.shape[:-1])


class AttentionModel:
    """Parameters and numpy passes; ids are permuted so that a class holds ``CLASS`` related ids.

    ``counts`` says how often each id (row) stands behind each other (column).
    """

    def __init__(self, size: int, counts: np.ndarray | None = None, seed: int = 3) -> None:
        rng = np.random.RandomState(seed)
        self.size, self.classes = size, -(-size // CLASS)
        self.place = np.empty(size, np.int64)
        self.place[np.arange(size) if counts is None else related(counts)] = np.arange(size)
        w = lambda *s: (rng.randn(*s) / math.sqrt(s[-2])).astype(np.float32)
        d = WIDTH
        self.p = {
            "e": w(size, d) * np.float32(math.sqrt(size) * 0.3), "qkv": np.concatenate([w(d, d), w(d, d), w(d, d) * np.float32(0.3)], 1), "r": np.zeros(WINDOW, np.float32),
            "w1": w(d, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": w(HIDDEN, d) * np.float32(0.3),
            "c": w(d, self.classes) * np.float32(0.03), "i": w(self.classes, d, CLASS) * np.float32(0.03),
        }
        self._shares(np.zeros((size, size), np.float32) if counts is None else counts)
        self.tables = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}

    def _shares(self, counts: np.ndarray) -> None:
        """Log shares of classes after each id, and of a class's ids after each id and class."""
        own = np.zeros(self.classes * CLASS)
        own[self.place] = counts.sum(1, dtype=np.float64) + 1
        own = own.reshape(self.classes, CLASS)
        of_class = own.sum(1, keepdims=True)
        after = np.zeros((self.classes * CLASS, self.size), np.float32)
        after[self.place] = counts
        after = after.reshape(self.classes, CLASS, self.size).transpose(0, 2, 1)
        n = after.sum(2)
        of_class, own = of_class[:, :, None], own[:, None]
        self.to_class = np.log((n + CLASS_PRIOR * (of_class[:, 0] / of_class.sum())) / (n.sum(0) + CLASS_PRIOR)).T.astype(np.float32, order="C")
        inside = (after + MEMBER_PRIOR * (own / of_class)) / (n[:, :, None] + MEMBER_PRIOR)
        # a class's rows lie together, as targets are looked up class by class; places without an id get nothing
        self.to_member = np.where(own > 0, np.log(np.maximum(inside, 1e-30)), -1e9).astype(np.float32, order="C")

    def _bias(self) -> np.ndarray:
        return np.where(_FUTURE, np.float32(-1e9), self.p["r"][np.maximum(_OFFSET, 0)]).astype(np.float32)

    def _attend(self, q: np.ndarray, k: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Masked attention weights (blocks x STRIDE x WINDOW)."""
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += self._bias()
        a[alone] += np.where(_BEFORE, np.float32(-1e9), np.float32(0))
        a *= (1 / _soften(a))[..., None]
        return a

    def _looked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query (scaled), key and value of each id."""
        q, k, v = np.split(self.p["e"] @ self.p["qkv"], 3, 1)
        return q * np.float32(1 / math.sqrt(WIDTH)), k.copy(), v.copy()

    def hidden(self, inputs: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Last-layer states (blocks x STRIDE x WIDTH) by table lookups and masked attention."""
        p = self.p
        if self.tables is None:
            self.tables = self._looked()
        q, k, v = self.tables
        own = inputs[:, WINDOW - STRIDE :]
        h = np.matmul(self._attend(q.take(own, 0), k.take(inputs, 0), alone), v.take(inputs, 0))
        h += p["e"].take(own, 0)
        h = h.reshape(-1, WIDTH)
        u = h @ p["w1"]
        u += p["b1"]
        h += np.maximum(u, 0, out=u) @ p["w2"]
        return h.reshape(*own.shape, WIDTH)

    def _dealt(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """Class and member of each target, an order of the targets by class, and the places that each class has in it."""
        group, member = np.divmod(self.place.take(targets.ravel()), CLASS)
        order = np.argsort(group.astype(np.uint8) if self.classes < 256 else group, kind="stable")
        bounds = np.searchsorted(group.take(order), np.arange(self.classes + 1)).tolist()
        return group, member, order, [(c, slice(a, b)) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Natural log probability of each target."""
        group, member, order, parts = self._dealt(targets)
        before = inputs[:, WINDOW - STRIDE :].ravel()
        found, total, top = (np.empty((len(group), *w), np.float32) for w in ((), (), (WIDTH,)))
        for at in range(0, len(inputs), SCORED_BLOCKS):  # states and classes: few blocks at once, so that what is made of them stays in the cache
            some, ids = slice(at, at + SCORED_BLOCKS), slice(at * STRIDE, (at + SCORED_BLOCKS) * STRIDE)
            top[ids] = self.hidden(inputs[some], alone[some]).reshape(-1, WIDTH)
            z = top[ids] @ self.p["c"]
            z += self.to_class.take(before[ids], 0)
            found[ids] = np.minimum(z[np.arange(len(z)), group[ids]], MOST_LOGIT)
            total[ids] = _soften(z)
        top, before, member = top.take(order, 0), before.take(order), member.take(order)
        chosen, inside = np.empty_like(found), np.empty_like(total)
        for c, some in parts:  # members: class by class
            y = top[some] @ self.p["i"][c]
            y += self.to_member[c].take(before[some], 0)
            chosen[some] = np.minimum(y[np.arange(len(y)), member[some]], MOST_LOGIT)
            inside[some] = _soften(y)
        chosen -= np.log(inside)
        found -= np.log(total)
        found[order] += chosen
        return found.reshape(targets.shape)

    def _gradients(self, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray, alone: np.ndarray) -> tuple[float, dict]:
        p, g, n = self.p, {}, len(inputs)
        own = inputs[:, WINDOW - STRIDE :]
        tables = self._looked()
        q, k, v = tables[0].take(own, 0), tables[1].take(inputs, 0), tables[2].take(inputs, 0)
        a = self._attend(q, k, alone)
        mixed = np.matmul(a, v).reshape(-1, WIDTH)
        x = p["e"].take(inputs, 0)
        last = x[:, WINDOW - STRIDE :].reshape(-1, WIDTH)
        h = mixed + last
        u = h @ p["w1"]
        u += p["b1"]
        np.maximum(u, 0, out=u)
        top = u @ p["w2"]
        top += h
        group, member, order, parts = self._dealt(targets)
        top, group, member, before = top.take(order, 0), group.take(order), member.take(order), own.ravel().take(order)
        rows = np.arange(len(order))
        weight = (scored.ravel() / max(1, scored.sum())).astype(top.dtype).take(order)
        z = top @ p["c"]
        z += self.to_class.take(before, 0)
        y = np.empty((len(top), CLASS), top.dtype)
        for c, some in parts:
            np.matmul(top[some], p["i"][c], out=y[some])
        y += self.to_member.reshape(-1, CLASS).take(group * self.size + before, 0)
        loss = 0.0
        for logits, choice in ((z, group), (y, member)):
            choice = rows * logits.shape[1] + choice
            flat = logits.ravel()
            picked = flat.take(choice)
            total = _soften(logits)
            loss += float((np.log(total) - picked) @ weight)
            logits *= (weight / total)[:, None]
            flat[choice] -= weight
        g["c"], d = top.T @ z, z @ p["c"].T
        g["i"], inner = np.zeros_like(p["i"]), np.empty_like(d)
        for c, some in parts:
            np.matmul(top[some].T, y[some], out=g["i"][c])
            np.matmul(y[some], p["i"][c].T, out=inner[some])
        d += inner
        dh = np.empty_like(d)
        dh[order] = d
        g["w2"] = u.T @ dh
        du = dh @ p["w2"].T
        du *= u > 0
        g["w1"], g["b1"] = h.T @ du, np.ones(len(du), du.dtype) @ du
        dh += du @ p["w1"].T
        along = _sums(dh * mixed).reshape(n, STRIDE, 1)
        dh = dh.reshape(n, STRIDE, WIDTH)
        dv = np.matmul(a.transpose(0, 2, 1), dh).reshape(-1, WIDTH)
        ds = np.matmul(dh, v.transpose(0, 2, 1))
        ds -= along
        ds *= a
        g["r"] = np.bincount(np.maximum(_OFFSET, 0).ravel(), np.where(_FUTURE, 0, ds.sum(0)).ravel(), minlength=WINDOW).astype(ds.dtype)
        dq = np.matmul(ds, k).reshape(-1, WIDTH)
        dq *= np.float32(1 / math.sqrt(WIDTH))
        dk = np.matmul(ds.transpose(0, 2, 1), q).reshape(-1, WIDTH)
        every = x.reshape(-1, WIDTH)
        g["qkv"] = np.concatenate([last.T @ dq, every.T @ dk, every.T @ dv], 1)
        of_q, of_k, of_v = np.split(p["qkv"], 3, 1)
        dx = dk @ of_k.T
        dx += dv @ of_v.T
        dq = dq @ of_q.T
        dx = dx.reshape(x.shape)
        dx[:, WINDOW - STRIDE :] += dh
        dx[:, WINDOW - STRIDE :] += dq.reshape(dh.shape)
        g["e"] = _by_id(inputs.ravel(), dx.reshape(-1, WIDTH), self.size)
        return loss, g

    def fit(self, texts: list[np.ndarray], end: int, steps: int = STEPS, seed: int = 5) -> list[float]:
        """Adam on random blocks of the texts; returns the losses."""
        if not texts:
            return []
        made = [windows(t, end) for t in texts]
        inputs, targets, scored, alone = (np.concatenate([m[c] for m in made]) for c in range(4))
        rng = np.random.RandomState(seed)
        dealt = (rng.randint(0, len(inputs), BATCH_BLOCKS) for _ in range(steps))
        return self.learn(((inputs[at], targets[at], scored[at], alone[at]) for at in dealt), lambda step: 1 - 0.9 * step / steps)

    def learn(self, batches: Iterable[tuple[np.ndarray, ...]], share: Callable[[int], float]) -> list[float]:
        """Adam, one step a batch, at a share of the full rate; returns the losses."""
        losses = []
        whole = np.concatenate([a.ravel() for a in self.p.values()]).astype(np.float32)  # own copies, changed in place, end to end
        ends = np.cumsum([a.size for a in self.p.values()])
        self.p = {n: part.reshape(a.shape) for (n, a), part in zip(self.p.items(), np.split(whole, ends[:-1]))}
        m, v, change = (np.zeros_like(whole) for _ in range(3))
        for step, batch in enumerate(batches, 1):
            loss, g = self._gradients(*batch)
            losses.append(loss)
            rate, scale = RATE * min(1, step / 20) * share(step), math.sqrt(1 - 0.99**step)
            slope = np.concatenate([g[n].ravel() for n in self.p])
            m *= np.float32(0.9)
            m += np.multiply(slope, np.float32(0.1), out=change)
            v *= np.float32(0.99)
            slope *= slope
            slope *= np.float32(0.01)
            v += slope
            np.sqrt(v, out=slope)
            slope += np.float32(1e-8 * scale)
            np.divide(m, slope, out=change)
            change *= np.float32(rate / (1 - 0.9**step) * scale)
            whole -= change
        self.tables = None
        return losses


def _by_id(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows that have each id."""
    order = np.argsort(ids.astype(np.uint16) if size <= 1 << 16 else ids, kind="stable")
    ids = ids.take(order)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    out[ids[first]] = np.add.reduceat(rows.take(order, 0), first, 0)
    return out


def batches_of(texts: Iterable[np.ndarray], end: int, rng: np.random.RandomState) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches of blocks in which each block of each text is once."""
    held, size = [], 0

    def deal() -> Iterator[tuple[np.ndarray, ...]]:
        whole = [np.concatenate([made[c] for made in held]) for c in range(4)]
        order = rng.permutation(len(whole[0]))
        for at in range(0, len(order), BATCH_BLOCKS):
            yield tuple(x[order[at : at + BATCH_BLOCKS]] for x in whole)

    for t in texts:
        held.append(windows(t, end))
        size += len(held[-1][0])
        if size >= MIXED_BLOCKS:
            yield from deal()
            held, size = [], 0
    if held:
        yield from deal()


def related(counts: np.ndarray, directions: int = 8, rounds: int = 40) -> np.ndarray:
    """Ids in an order in which related ones are neighbours, so that classes hold related ids.

    Ids are placed by the strongest directions of the neighbour counts (id by id
    before it), found by block power iteration, and halved along the widest
    direction of what is left until a class is full.
    """
    table = (counts + 0.5).astype(np.float32)
    after, before = np.log(table.sum(1)), np.log(table.sum(0) / table.sum())
    np.log(table, out=table)
    table -= after[:, None]
    table -= before
    basis = np.random.RandomState(1).randn(len(table), directions).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(table @ (basis.T @ table).T)

    def halved(ids: np.ndarray) -> list[np.ndarray]:
        full = -(-len(ids) // CLASS)
        if full <= 1:
            return [ids]
        x = basis[ids] - basis[ids].mean(0)
        ids = ids[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        return halved(ids[: full // 2 * CLASS]) + halved(ids[full // 2 * CLASS :])

    return np.concatenate(halved(np.arange(len(table))))


class Scorer:
    """What a worker needs to score texts."""

    def __init__(self, model: AttentionModel, end: int) -> None:
        self.model, self.end = model, end

    def log10(self, texts: list[np.ndarray]) -> list[float]:
        """log10 probability of each text, given as ids."""
        out = np.zeros(len(texts))
        held, size = [], 0

        def run() -> None:
            nonlocal size
            if held:
                numbers = np.repeat([n for n, _ in held], [len(w[0]) for _, w in held])
                inputs, targets, scored, alone = (np.concatenate([w[c] for _, w in held]) for c in range(4))
                for at in range(0, len(inputs), HELD_BLOCKS):
                    cut_ = slice(at, at + HELD_BLOCKS)
                    found = (self.model.log_probabilities(inputs[cut_], targets[cut_], alone[cut_]) * scored[cut_]).sum(1, dtype=np.float64)
                    np.add.at(out, numbers[cut_], found)
                held.clear()
                size = 0

        for n, ids in enumerate(texts):
            made = windows(ids.astype(np.int64), self.end)
            held.append((n, made))
            size += len(made[0])
            if size >= HELD_BLOCKS:
                run()
        run()
        return (out / math.log(10)).tolist()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64).view(np.int64)


def held_out(id_col: str):
    return bucket_of(F.col(id_col), FOLDS) == HELD_OUT


def subwords(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, _round, _ids``: every row with its text's ids, which tell its words; written once, as they are read in every pass."""
    made, key = _Made(path), dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = []
            for text in batch.column(3).to_pylist():
                ids = made.pieces.ids(text.lower().split()).astype(np.uint16).tobytes()
                stored.append(len(ids).to_bytes(8, "little") + pa.compress(ids, "zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(stored, pa.binary())], names=[id_col, "held_out", "_round", "_ids"])

    share = F.crc32(F.concat(F.lit("round"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))) % ROUNDS
    rows = docs.select(id_col, held_out(id_col).alias("held_out"), share.alias("_round"), bytes_of(text_col).alias("_text"))
    return cut(map_arrow(rows, work, f"`{id_col}` {key}, held_out boolean, _round bigint, _ids binary"))


def _read(column: pa.Array, pieces: Pieces, stored: bool) -> Iterator[np.ndarray]:
    """Ids of each text of a column of texts, or of ids as ``subwords`` stores them."""
    for x in column.to_pylist():
        if stored:
            yield np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd"), np.uint16).astype(np.int64)
        else:
            yield pieces.ids(x.lower().split())


#: Kinds of counts: hashes of words, and pairs of ids (row x size + column).
WORD, PAIR = 0, 1


def corpus_counts(docs: DataFrame, path: str, size: int, text_col: str = "text") -> DataFrame:
    """``kind, key, c``: how often each token (by hash) occurs and each id stands behind each other, in all of ``docs`` (texts, or rows of ``subwords``)."""
    made, stored = _Made(path), "_ids" in docs.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_in: Counter[bytes] = Counter()
        pairs, held, n, ends = np.zeros(size * size, np.int64), [], 0, 0

        def emit(kind: int, keys: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(c)], names=["kind", "key", "c"])

        def words() -> pa.RecordBatch:
            return emit(WORD, np.append(_hashes(list(words_in)), _END_HASH), np.append(np.fromiter(words_in.values(), np.int64, len(words_in)), ends))

        for batch in batches:
            for t in _read(batch.column(0), made.pieces, stored):
                words_in.update(made.pieces.words(t))
                ends += 1
                held.append(t[1:] * size + t[:-1])
                n += len(t)
                if n >= COUNTED_PAIRS:
                    pairs += np.bincount(np.concatenate(held), minlength=len(pairs))
                    held, n = [], 0
                if len(words_in) >= COUNTED:
                    yield words()
                    words_in.clear()
                    ends = 0
        if ends:
            yield words()
        if held:
            pairs += np.bincount(np.concatenate(held), minlength=len(pairs))
        some = np.flatnonzero(pairs)
        yield emit(PAIR, some, pairs[some])

    return map_arrow(docs.select("_ids" if stored else bytes_of(text_col).alias("_text")), count, "kind tinyint, key bigint, c bigint").groupBy("kind", "key").agg(F.sum("c").alias("c"))


def neighbours(counts: DataFrame, size: int) -> np.ndarray:
    """The pairs of ``corpus_counts`` as a table of fixed size: id by id before it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, c = (np.ascontiguousarray(batch.column(n).to_numpy()).tobytes() for n in range(2))
            yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([c])], names=["pairs", "c"])

    table = np.zeros(size * size, np.float32)
    for row in map_arrow(counts.filter(F.col("kind") == PAIR).select("key", "c"), pack, "pairs binary, c binary", None).toLocalIterator():  # at most size x size pairs, whatever the corpus
        table[np.frombuffer(row.pairs, np.int64)] = np.frombuffer(row.c, np.int64)
    return table.reshape(size, size)


class _Made:
    """The pieces of a worker, made once in it."""

    _held: dict[str, Pieces] = {}

    def __init__(self, path: str) -> None:
        self.path = path

    @property
    def pieces(self) -> Pieces:
        return self._held.get(self.path) or self._held.setdefault(self.path, Pieces(self.path))


def fit_round(texts: DataFrame, path: str, model: AttentionModel, passes: int, share: Callable[[float], float], seed: int, groups: int) -> int:
    """Average of the copies fitted on the partitions of ``texts`` into ``model``; returns the blocks they learned from, once for each pass.

    ``texts`` has ``_text``, or ``_ids`` from ``subwords``.  ``share`` gives the rate's share by the part of the passes that is over.  Copies are summed in ``groups`` before the driver sees them.
    """
    made, sent = _Made(path), texts.sparkSession.sparkContext.broadcast(model)
    shapes, stored = {n: a.shape for n, a in model.p.items()}, "_ids" in texts.columns

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = copy.copy(sent.value)
        part = TaskContext.get().partitionId()
        rng, blocks, steps = np.random.RandomState(seed * 100_003 + part), 0, 0
        texts_in = (t for batch in batches for t in _read(batch.column(0), made.pieces, stored))
        kept = [t.astype(np.uint16) for t in texts_in] if passes > 1 else None

        def dealt() -> Iterator[tuple[np.ndarray, ...]]:
            nonlocal blocks, steps
            for n in range(passes):
                for b in batches_of(texts_in if kept is None else (t.astype(np.int64) for t in kept), made.pieces.end, rng):
                    blocks += len(b[0])
                    yield b
                steps = n + 1

        own.learn(dealt(), lambda _: share(steps / passes))
        if blocks:
            weights = np.concatenate([own.p[n].astype(np.float64).ravel() for n in shapes]) * blocks
            yield pa.RecordBatch.from_arrays([pa.array([part % groups], pa.int32()), pa.array([blocks], pa.int64()), pa.array([weights.tobytes()], pa.binary())], names=["g", "n", "w"])

    def add(rows: pa.Table) -> pa.Table:
        weights = sum(np.frombuffer(w.as_py(), np.float64) for w in rows.column("w"))
        return pa.table({"n": pa.array([sum(rows.column("n").to_pylist())], pa.int64()), "w": pa.array([weights.tobytes()], pa.binary())})

    copies = map_arrow(texts.select("_ids" if stored else "_text"), fit, "g int, n bigint, w binary")
    blocks, total = 0, 0.0
    for row in copies.groupBy("g").applyInArrow(add, "n bigint, w binary").toLocalIterator():
        blocks, total = blocks + row.n, total + np.frombuffer(row.w, np.float64)
    sent.unpersist()
    if blocks:
        at = 0
        for n, shape in shapes.items():
            model.p[n] = (total[at : at + math.prod(shape)] / blocks).astype(np.float32).reshape(shape)
            at += math.prod(shape)
        model.tables = None
    return blocks


def train(made: DataFrame, path: str, counts: DataFrame, steps: int = STEPS) -> Scorer:
    """The model, fitted on every block of every training text of ``subwords``; ``counts`` are their ``corpus_counts``."""
    own = made.filter(~F.col("held_out"))
    pieces = Pieces(path)
    table = neighbours(counts, pieces.size)
    ids = int(table.sum(dtype=np.float64))
    model = AttentionModel(pieces.size, table)
    if ids:
        least = steps * BATCH_BLOCKS * STRIDE  # ids of a task
        tasks = max(1, ids // least)
        if ids < least:
            fit_round(own.coalesce(1), path, model, -(-least // ids), lambda over: 1 - 0.9 * over, 0, 1)
        else:
            for n in range(ROUNDS):
                part = own.filter(F.col("_round") == n).coalesce(tasks)
                fit_round(part, path, model, 1, lambda over, n=n: 1 - 0.9 * n / ROUNDS, n, math.isqrt(tasks))
    return Scorer(model, pieces.end)


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS, frequent: int = FREQUENT) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    key, spark = dict(docs.dtypes)[id_col], docs.sparkSession
    made, pieces = subwords(docs, path, id_col, text_col), _Made(path)
    gathered = cut(corpus_counts(made.filter(~F.col("held_out")), path, pieces.pieces.size))
    counts = gathered.filter(F.col("kind") == WORD).select(F.col("key").alias("h"), "c")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    tokens, distinct = int(total[0]), int(total[1])
    bar = max(1, -(-tokens // frequent))
    often = counts.filter(F.col("c") >= bar).toArrow()  # at most ``frequent`` rows: each stands for tokens / frequent
    known = spark.sparkContext.broadcast(tuple(often.column(n).to_numpy().astype(np.int64) for n in ("h", "c")))
    scorer = spark.sparkContext.broadcast(train(made, path, gathered, steps))
    below = math.log10(tokens + distinct + 1)
    rows_in = made.select(id_col, "held_out", "_ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes = known.value
        frequent_share = dict(zip(names.view(np.uint64).tolist(), (np.log10(sizes + 1.0) - below).tolist()))

        def share(word: bytes) -> float:
            """The logarithm of a frequent word's share, else no number."""
            return frequent_share.get(xxhash.xxh3_64_intdigest(word), math.nan)

        shares, end = Remembered(share), frequent_share.get(_END_HASH & 0xFFFFFFFFFFFFFFFF, math.nan)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            first, counted, seen, sums, ids_in, hs, ns = row, [], [], [], [], [], []
            for ids in _read(batch.column(2), pieces.pieces, True):
                words = pieces.pieces.words(ids)
                own = np.append(np.fromiter(map(shares.__getitem__, words), np.float64, len(words)), end)
                hit = own == own
                found = Counter([words[k] for k in np.flatnonzero(~hit[:-1]).tolist()])
                h, n = _hashes(list(found)), np.fromiter(found.values(), np.int32, len(found))
                if not hit[-1]:
                    h, n = np.append(h, _END_HASH), np.append(n, np.int32(1))
                counted.append(len(own)), seen.append(int(hit.sum()))
                sums.append(float(own[hit].sum()))
                ids_in.append(ids.astype(np.uint16)), hs.append(h), ns.append(n)
                row += 1
            offsets = pa.array(np.cumsum([0, *map(len, hs)]).astype(np.int32))
            rare = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, t), *x]))) for x, t in ((hs, np.int64), (ns, np.int32))]
            more = [pa.array(np.arange(first, row)), pa.array(counted, pa.int64()), pa.array(seen, pa.int64()), pa.array(sums, pa.float64()), pa.array(scorer.value.log10(ids_in), pa.float64()), *rare]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], names=[id_col, "held_out", "k", "n_tokens", "seen", "sums", "score", "hs", "ns"])

    # written once: a row keeps its number k, by which its rare tokens come back
    rows = cut(map_arrow(rows_in, work, f"`{id_col}` {key}, held_out boolean, k bigint, n_tokens bigint, seen bigint, sums double, score double, hs array<bigint>, ns array<int>"))
    looked = rows.select("k", F.inline(F.arrays_zip(F.col("hs").alias("h"), F.col("ns").alias("n")))).join(counts.filter(F.col("c") < bar), "h", "left")
    one = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(1.0)) - F.lit(below)
    rest = looked.groupBy("k").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * one).alias("rest"))
    return rows.drop("hs", "ns").join(rest, "k", "left").select(
        id_col,
        "held_out",
        "n_tokens",
        (F.col("seen") + F.coalesce(F.col("more"), F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce(F.col("rest"), F.lit(0.0))).alias("base_score"),
        "score",
    )
