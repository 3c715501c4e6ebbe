"""Operator 5: byte-level BPE encoding and decoding through a minimal acyclic transducer lexicon.

A Spark job counts the words (pre-tokens) of all documents; the ``lexicon_size`` most frequent ones (a documented,
fixed bound) are merged once and compiled into a minimal acyclic transducer: states with equal continuations are
shared, and the id sequence is the output that accumulates along a word's path (a perfect-hash number into the id
table). Flat arrays of the automaton go to one file, shipped with ``addFile`` and memory-mapped by every worker. A word
outside the lexicon is merged exactly by rank, so results never depend on which words the lexicon holds.

Nulls and empty texts give no ids and decode to ''. Texts are never cut. Repeated rows give repeated results. The
special token's own string in a text becomes its id, as in the library. Extra columns pass through; columns that are
called like a result (``ids``, ``decoded``, ``__bpe``) are replaced.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from string import punctuation

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, forget, shared_dir, small_batches, written

#: Fixed value: the pattern that splits text into words before merging, as the vocabulary's pre-tokenizer defines it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORDS = regex.compile(PATTERN)
_SPACES = re.compile(r"\s\s")
_SINGLE_SPACE = re.compile(r"\S \S")
#: Distinct words that a counting task holds before it hands them on: bounds memory, never results.
COUNTED_WORDS = 120_000
#: What an encoder remembers: so many pieces of at most so many characters, about 32 MB. Bounds memory, never results.
CACHE_ENTRIES, CACHE_PIECE = 150_000, 32
#: Characters that are cut, looked up and merged together; tokens decoded together; words merged together.
BLOCK_CHARS, BLOCK_TOKENS, BLOCK_WORDS = 1 << 20, 1 << 18, 4096


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for shift, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + shift)
    return [names[b] for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {s: b for b, s in enumerate(byte_symbols())}
        raw = lambda token: bytes(back[c] for c in token)
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.span = max(ids.values()) + 1
        self.ranks = {ids[raw(a)] * self.span + ids[raw(b)]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [ids[raw(a + b)] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        keys = np.array(list(self.ranks), np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.ranks.values()), np.int32)[order]
        self.merged_ids, self.of_byte = np.array(self.merged, np.int32), np.array(self.byte_ids, np.int32)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; _LAST where they don't merge. Negative ids merge with nothing."""
        key = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) * self.span + b)
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _LAST) if len(self.pair_keys) else np.full(key.shape, _LAST, np.int32)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many words at once, ids as little-endian 32-bit integers: words of like length make a matrix, and
        each round merges every word's pair of lowest rank, leftmost first. Long words are merged one by one."""
        out = [b""] * len(words)
        order = sorted((k for k, w in enumerate(words) if w), key=lambda k: len(words[k]))
        while order and len(words[order[-1]]) > 64:
            k = order.pop()
            out[k] = np.array(self.merge(words[k]), "<u4").tobytes()
        for lo in range(0, len(order), BLOCK_WORDS):
            row = np.array(order[lo : lo + BLOCK_WORDS])
            size = np.array([len(words[k]) for k in row])
            width = int(size[-1])
            ids = self.of_byte[np.frombuffer(b"".join([words[k].ljust(width, b"\0") for k in row]), np.uint8)].reshape(-1, width)
            ids[np.arange(width) >= size[:, None]] = -1
            ranks = self.ranks_of(ids[:, :-1], ids[:, 1:])
            while len(row):
                each = np.arange(len(row))
                at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
                best = ranks[each, at] if ranks.shape[1] else np.full(len(row), _LAST, np.int32)
                if not (live := best < _LAST).all():
                    done = ids[~live]
                    ends = np.cumsum((done >= 0).sum(axis=1)) * 4
                    data = done[done >= 0].astype("<u4").tobytes()
                    for k, start, end in zip(row[~live].tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                        out[k] = data[start:end]
                    row, ids, ranks, at, best = row[live], ids[live], ranks[live], at[live], best[live]
                    if not len(row):
                        break
                    each = np.arange(len(row))
                ids[each, at] = self.merged_ids[best]
                keep = np.ones(ids.shape, bool)
                keep[each, at + 1] = False
                ids = ids[keep].reshape(len(row), -1)
                keep = np.ones(ranks.shape, bool)
                keep[each, at] = False
                ranks = ranks[keep].reshape(len(row), -1)
                new = ids[each, at]
                if (left := at > 0).any():
                    ranks[each[left], at[left] - 1] = self.ranks_of(ids[each[left], at[left] - 1], new[left])
                if (right := at + 1 < ids.shape[1]).any():
                    ranks[each[right], at[right]] = self.ranks_of(new[right], ids[each[right], at[right] + 1])
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, leftmost first. O(n log n), so long words are no problem."""
        ids = [self.byte_ids[b] for b in word]
        ranks_get, span, merged, n = self.ranks.get, self.span, self.merged, len(ids)
        rank = lambda a, b: ranks_get(a * span + b, _NEVER)
        if n <= 64:
            ranks = list(map(rank, ids, ids[1:]))
            while ranks and (best := min(ranks)) != _NEVER:
                i = ranks.index(best)
                ids[i : i + 2] = [merged[best]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = rank(ids[i], ids[i + 1])
                if i:
                    ranks[i - 1] = rank(ids[i - 1], ids[i])
            return ids
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, p) for i, p in enumerate(zip(ids, ids[1:])) if (r := rank(*p)) != _NEVER]
        heapq.heapify(heap)
        while heap:
            best, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = merged[best], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank(ids[a], ids[b])) != _NEVER:
                    heapq.heappush(heap, (r, a, (ids[a], ids[b])))
        return [x for x in ids if x >= 0]


_NEVER, _LAST = 1 << 60, np.iinfo(np.int32).max


# ---------------------------------------------------------------- the transducer


def compile_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Minimal acyclic transducer of ``words`` -> ids as flat arrays.

    Words are added in sorted order; when a branch is finished its states are looked up by their continuation and equal
    ones are shared, so suffixes are stored once. Every arc carries how many words precede it among its state's
    continuations; summed along a path this is the word's rank, which points into the id table. Arcs are numbers
    ``state * 256 + byte`` in ascending order, so that many words are followed at once by binary search.
    """
    register: dict[tuple, int] = {}
    done: list[tuple] = []  # (final, ((byte, state), ...)) of shared states
    counts: list[int] = []
    path: list[list] = [[False, []]]  # states of the last word that are still open

    def freeze(upto: int, last: bytes) -> None:
        while len(path) > upto + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(done)
                done.append(key)
                counts.append(final + sum(counts[s] for _, s in arcs))
            path[-1][1].append((last[len(path) - 1], register[key]))

    last, ordered = b"", sorted(w for w in words if w)
    for w in ordered:
        same = next((k for k, (a, b) in enumerate(zip(last, w)) if a != b), min(len(last), len(w)))
        freeze(same, last)
        path += [[False, []] for _ in w[same:]]
        path[-1][0] = True
        last = w
    freeze(0, last)
    root = (path[0][0], tuple(path[0][1]))
    states = [*done, root]
    arcs, targets, skips = [], [], []
    for k, (final, out) in enumerate(states):
        before = int(final)
        for label, state in out:
            arcs.append(k << 8 | label)
            targets.append(state)
            skips.append(before)
            before += counts[state]
    sizes = np.array([len(words[w]) for w in ordered], np.int64)
    return {
        "final": np.array([s[0] for s in states], np.uint8), "arc": np.array(arcs, np.int64), "target": np.array(targets, np.int32), "skip": np.array(skips, np.int32),
        "start": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), "ids": np.array([i for w in ordered for i in words[w]], np.uint32),
    }


def write_lexicon(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: a line of JSON (name, type, length, offset), then the arrays, each on a 16-byte boundary."""
    index, at = [], 0
    for name, a in arrays.items():
        index.append([name, a.dtype.str, len(a), at])
        at += -(-a.nbytes // 16) * 16
    head = json.dumps(index).encode()
    head += b" " * (-(len(head) + 1) % 16) + b"\n"
    with open(path, "wb") as f:
        f.write(head)
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 16))


class Lexicon:
    """A memory-mapped transducer."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.readline()
        with open(path, "rb") as f:
            self.mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        for name, kind, n, at in json.loads(head):
            setattr(self, name, np.frombuffer(self.mapped, kind, n, len(head) + at))
        self.root = len(self.final) - 1

    def lookup_many(self, words: list[bytes]) -> list[bytes | None]:
        """Each word's ids as little-endian 32-bit integers, or None if the lexicon does not hold it."""
        out: list[bytes | None] = [None] * len(words)
        order = sorted((k for k, w in enumerate(words) if w), key=lambda k: len(words[k]))
        for lo in range(0, len(order) if len(self.arc) else 0, BLOCK_WORDS):
            row = np.array(order[lo : lo + BLOCK_WORDS])
            size = np.array([len(words[k]) for k in row])
            width = int(size[-1])
            labels = np.frombuffer(b"".join([words[k].ljust(width, b"\0") for k in row]), np.uint8).reshape(-1, width)
            state, rank = np.full(len(row), self.root, np.int64), np.zeros(len(row), np.int64)
            for k in range(width):
                if k >= size[0] and (over := size == k).any():  # ascending lengths: these words end here
                    for j, r in zip(row[over].tolist(), np.where(self.final[state[over]] > 0, rank[over], -1).tolist()):
                        out[j] = None if r < 0 else self.ids[self.start[r] : self.start[r + 1]].tobytes()
                key = state << 8 | labels[:, k]
                arc = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
                on = (self.arc[arc] == key) & (size > k)
                row, size, labels, arc, rank = row[on], size[on], labels[on], arc[on], rank[on]
                if not len(row):
                    break
                rank += self.skip[arc]
                state = self.target[arc].astype(np.int64)
            for j, r, end in zip(row.tolist(), rank.tolist(), self.final[state].tolist() if len(row) else ()):
                out[j] = self.ids[self.start[r] : self.start[r + 1]].tobytes() if end else None
        return out


# ---------------------------------------------------------------- encoding and decoding


class _Pieces(dict):
    """Piece -> ids, made when first asked for; ``old`` is asked before that. Long pieces are not kept."""

    __slots__ = ("make", "old")

    def __init__(self, make: Callable[[str], bytes], old: dict[str, bytes]):
        self.make, self.old = make, old

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= CACHE_PIECE:
            self[piece] = ids
        return ids


class Encoder:
    """Texts -> ids as little-endian 32-bit integers. ``many`` gives the ids of a list of words; with ``aged`` it is asked for one at a time."""

    def __init__(self, many: Callable[[list[bytes]], list[bytes]], special: dict[str, int], split, entries: int | None = None, aged: bool = False):
        self.many, self.special, self.split, self.entries, self.aged = many, special, split, entries or CACHE_ENTRIES, aged
        self.heads: dict[str, bytes] = {}  # pieces before the first space of a line
        self.inner: dict[str, bytes] = {}  # pieces after a space
        self.words: dict[str, bytes] = {}
        if aged:
            self._renew({}, {}, {})

    def _renew(self, *old: dict[str, bytes]) -> None:
        # With ``aged``, half of the entries are those of before: what is met again moves on, the rest goes when the new half is full. Pieces
        # are looked up once and made where they are missing: no sets of a block's pieces, which cost more than the merging.
        for o in old:
            if isinstance(o, _Pieces):
                o.old = {}
        self.heads, self.inner, self.words = map(_Pieces, (self._head, self._inner, self._word), old)

    def _word(self, w: str) -> bytes:
        return self.many([w.encode("utf-8", "surrogatepass")])[0]

    def _head(self, p: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _WORDS.findall(p)))

    def _inner(self, p: str) -> bytes:
        if p.isalpha():
            return self._word(" " + p)
        start = p.rstrip(punctuation)
        if start.isalpha():  # a run of signs is a word of its own
            return self.inner[start] + self.words[p[len(start) :]]
        return b"".join(map(self.words.__getitem__, _WORDS.findall(" " + p)))

    def _parts(self, text: str) -> Iterator[bytes | str]:
        """Special tokens as ids, and the text between them in segments that words never cross."""
        for part in self.split.split(text) if self.split is not None else (text,):
            if part in self.special:
                yield self.special[part].to_bytes(4, "little")
                continue
            at = 0
            while len(part) - at > BLOCK_CHARS and (m := _SINGLE_SPACE.search(part, at + BLOCK_CHARS)):
                yield part[at : m.start() + 1]  # a word always begins at a space between two other characters
                at = m.start() + 1
            if at < len(part):
                yield part[at:]

    @staticmethod
    def _cut(segment: str) -> list:
        # Where white-space characters stand alone, a word starts at each space and after each line end, so pieces
        # between them are independent of each other and can be remembered whole.
        if _SPACES.search(segment):
            return _WORDS.findall(segment)
        return [line.split(" ") for line in segment.split("\n")]

    def _learn(self, cuts: list[list]) -> list[tuple[dict, str]]:
        """Remember all pieces of ``cuts``; returns those that are too long to be kept."""
        heads, inner, words = set(), set(), {"\n"}
        for cut in cuts:
            if isinstance(cut[0], str):
                words.update(cut)
                continue
            for line in cut:
                heads.add(line[0])
                inner.update(line[1:])
        if len(self.heads) + len(self.inner) + len(self.words) > self.entries:
            self.forget()
        for pieces, memo in zip((heads, inner, words), (self.heads, self.inner, self.words)):
            pieces.difference_update(memo)
        whole, ends, other = set(), [], []  # one word after its space; the same and one more character; anything else
        for p in inner:
            if p.isalpha():
                whole.add(p)
            elif p[:-1].isalpha() and p[-1] in ".,;:!?)":
                ends.append(p)
                words.add(p[-1])
            else:
                other.append((self.inner, p, _WORDS.findall(" " + p)))
        whole.update(p[:-1] for p in ends if p[:-1] not in self.inner)
        other += [(self.heads, p, _WORDS.findall(p)) for p in heads]
        words.update(w for _, _, ws in other for w in ws)
        words.difference_update(self.words)
        first, rest = list(whole), list(words)
        ids = self.many([(" " + p).encode() for p in first] + [w.encode("utf-8", "surrogatepass") for w in rest])
        self.inner.update(zip(first, ids))
        self.words.update(zip(rest, ids[len(first) :]))
        self.inner.update([(p, self.inner[p[:-1]] + self.words[p[-1]]) for p in ends])
        for memo, p, ws in other:
            memo[p] = b"".join([self.words[w] for w in ws])
        inner |= whole
        return [(memo, p) for memo, pieces in ((self.heads, heads), (self.inner, inner), (self.words, words)) for p in pieces if len(p) > CACHE_PIECE]

    def forget(self) -> None:
        for memo in (self.heads, self.inner, self.words):
            memo.clear()
        if self.aged:
            self._renew({}, {}, {})

    def encode_many(self, texts: Iterable[str | None]) -> list[bytes]:
        out: list[list] = []
        held: list[tuple[list, int, list]] = []
        chars = 0

        def flush() -> None:
            long = () if self.aged else self._learn([cut for _, _, cut in held])
            if self.aged and len(self.heads) + len(self.inner) + len(self.words) > self.entries // 2:
                self._renew(self.heads, self.inner, self.words)
            head, inner, word, end = self.heads.__getitem__, self.inner.__getitem__, self.words.__getitem__, self.words["\n"]
            for parts, at, cut in held:
                if isinstance(cut[0], str):
                    parts[at] = b"".join(map(word, cut))
                else:
                    parts[at] = end.join([head(line[0]) + b"".join(map(inner, line[1:])) for line in cut])
            for memo, piece in long:
                memo.pop(piece, None)
            held.clear()

        for text in texts:
            out.append(parts := [])
            for part in self._parts(text) if text else ():
                parts.append(part)
                if isinstance(part, str):
                    held.append((parts, len(parts) - 1, self._cut(part)))
                    if (chars := chars + len(part)) >= BLOCK_CHARS:
                        flush()
                        chars = 0
        if held:
            flush()
        return [b"".join(parts) for parts in out]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents: counted inside each task first, then summed by Spark."""

    def count(batches: Iterable) -> Iterator:
        import pyarrow as pa

        def flush(inner: Counter, heads: Counter):
            words: Counter = Counter()
            for lead, pieces in ((" ", inner), ("", heads)):
                for piece, n in pieces.items():
                    if piece.isalpha():
                        words[lead + piece] += n
                        continue
                    for w in _WORDS.findall(lead + piece):
                        words[w] += n
                pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        forget()
        inner: Counter = Counter()
        heads: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                if not (text := t.as_py()):
                    continue
                if _SPACES.search(text):
                    heads.update(_WORDS.findall(text))
                else:
                    for line in text.split("\n"):
                        head, *rest = line.split(" ")
                        heads[head] += 1
                        inner.update(rest)
                    heads["\n"] += text.count("\n")
                if len(inner) + len(heads) > COUNTED_WORDS:
                    yield flush(inner, heads)
        yield flush(inner, heads)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(spark: SparkSession, docs: DataFrame, vocabulary_path: str, text_col: str = "text", lexicon_size: int = 50_000, max_word: int = 64) -> str:
    """Count words over ``docs``, compile the most frequent ones, ship the file; returns its name for SparkFiles.

    ``lexicon_size`` (words) and ``max_word`` (characters) bound the file and what comes to the driver.
    """
    import tempfile
    import uuid

    small_batches(spark)
    counts = written(spark, word_counts(docs, text_col), f"{shared_dir(spark)}/words").where(F.length("word") <= max_word)
    least, room = 1, lexicon_size
    for n, words in counts.groupBy("n").count().orderBy(F.desc("n")).limit(lexicon_size).toLocalIterator():  # one row per distinct count
        if words > room:
            least = n + 1
            break
        room -= words
    rows = counts.where(F.col("n") >= least).select("word").collect()
    v = Vocabulary(vocabulary_path)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = f"{tempfile.mkdtemp(prefix='corpusloom-')}/{name}"
    words = [r.word.encode() for r in rows]
    write_lexicon(compile_lexicon({w: np.frombuffer(ids, "<u4").tolist() for w, ids in zip(words, v.merge_many(words))}), path)
    spark.sparkContext.addFile(path)
    return name


_LOADED: dict = {}
CACHES.append(_LOADED)


def worker_encoder(vocabulary_path: str, lexicon: str | None) -> Encoder:
    """The encoder of this Python worker: kept between tasks, one at a time."""
    key = (vocabulary_path, lexicon)
    if key not in _LOADED:
        _LOADED.clear()
        v = Vocabulary(vocabulary_path)
        held = Lexicon(SparkFiles.get(lexicon)) if lexicon else None

        def many(words: list[bytes]) -> list[bytes]:
            ids = held.lookup_many(words) if held else [None] * len(words)
            unseen = [k for k, x in enumerate(ids) if x is None]
            for k, x in zip(unseen, v.merge_many([words[k] for k in unseen])):
                ids[k] = x
            return ids

        _LOADED[key] = Encoder(many, v.special, v.split), Decoder(v)
    return _LOADED[key][0]


def worker_decoder(vocabulary_path: str) -> Decoder:
    """The decoder of this Python worker, beside whichever encoder it holds for the vocabulary."""
    held = next((k for k in _LOADED if k[0] == vocabulary_path), None)
    if held is None:
        worker_encoder(vocabulary_path, None)
        held = (vocabulary_path, None)
    return _LOADED[held][1]


class Decoder:
    """Ids -> text: bytes of all tokens in one flat table, gathered by numpy."""

    def __init__(self, v: Vocabulary):
        tokens = [v.bytes_of.get(i, b"") for i in range(max(v.bytes_of) + 1)]
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode_many(self, texts: list[bytes]) -> list[str]:
        """Texts of little-endian 32-bit ids, special tokens included; broken UTF-8 becomes U+FFFD as in the library."""
        ids, data = np.frombuffer(b"".join(texts), "<u4"), []
        ends = np.zeros(len(ids) + 1, np.int64)
        for lo in range(0, len(ids), BLOCK_TOKENS):
            i = ids[lo : lo + BLOCK_TOKENS]
            size = self.size[i]
            end = np.cumsum(size)
            at = np.repeat(self.start[i] - end + size, size)
            at += np.arange(len(at))
            data.append(self.flat[at].tobytes())
            ends[lo + 1 : lo + 1 + len(i)] = end + ends[lo]
        whole, cuts = b"".join(data), ends[np.cumsum([0, *(len(t) // 4 for t in texts)])].tolist()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def slices(values, most: int = 2 << 20) -> Iterator[list]:
    """A column in lists of about ``most`` characters or bytes, so that what is made of one list stays small."""
    out, size = [], 0
    for v in values:
        out.append(v)
        size += len(v) if v is not None else 0
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def encode_documents(docs: DataFrame, vocabulary_path: str, lexicon: str | None, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``out_col``: the ids of the whole text as little-endian unsigned 32-bit integers (binary)."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = worker_encoder(vocabulary_path, lexicon)
        for texts in batches:
            yield pd.Series([ids for part in slices(texts) for ids in encoder.encode_many(part)], dtype=object)
        encoder.forget()

    # Declared nondeterministic so that the plan never runs it again for each use of its column.
    return docs.withColumn(out_col, encode.asNondeterministic()(F.col(text_col)))


def decode_documents(docs: DataFrame, vocabulary_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with ``out_col``: the text that ``ids_col`` decodes to (null ids: null)."""

    @F.pandas_udf("string")
    def back(ids: pd.Series) -> pd.Series:
        decoder = worker_decoder(vocabulary_path)
        texts = pd.Series([t for part in slices(ids) for t in decoder.decode_many([x or b"" for x in part])], dtype=object)
        return texts.where(ids.notna().to_numpy(), None)

    return docs.withColumn(out_col, back(F.col(ids_col)))


def encode_and_decode(docs: DataFrame, vocabulary_path: str, lexicon: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ids and decoded, both made by one Python worker per task."""

    @F.pandas_udf("ids binary, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(vocabulary_path, lexicon)
        decoder = worker_decoder(vocabulary_path)
        for texts in batches:
            ids, decoded = [], []
            for part in slices(texts):
                ids += (made := encoder.encode_many(part))
                decoded += decoder.decode_many(made)
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(decoded, dtype=object)})
        encoder.forget()

    return docs.withColumn("__bpe", both.asNondeterministic()(F.col(text_col))).withColumns({"ids": F.col("__bpe.ids"), "decoded": F.col("__bpe.decoded")}).drop("__bpe")


def bpe_roundtrip(spark: SparkSession, docs: DataFrame, vocabulary_path: str, lexicon_size: int = 50_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every whole text encoded and decoded."""
    name = build_lexicon(spark, docs, vocabulary_path, lexicon_size=lexicon_size)
    out = encode_and_decode(docs.select("doc_id", "text"), vocabulary_path, name)
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
