"""Byte-level BPE with a minimal acyclic transducer as lexicon.

The corpus's most frequent pieces and their ids are compiled into an automaton whose states share suffixes; its arcs carry
outputs that add up to a word's rank, under which its ids stand. Pieces that it does not have are merged exactly by the
vocabulary's rules, so the lexicon decides speed and never results.

Texts walk it in the executors' JVM (Ids.java). What that leaves, such as special tokens, characters on which Unicode tables differ
and very long pieces, goes to the same steps in Python, where workers map the file into memory.
"""

from __future__ import annotations

import atexit
import heapq
import json
import os
import re
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.llm import native
from tierstone.llm.common import Scratch, give_back, own_columns, table, tidy

#: Pieces in the lexicon at most; the longest piece in bytes that may enter it, or be merged along with others.
LEXICON, LONGEST = 100_000, 64
#: Bytes of chunks and their ids that a task remembers, and the longest chunk in characters that it does.
REMEMBERED, LONG_CHUNK = 64 << 20, 256
#: Characters that are cut into pieces at once, distinct chunks counted before they are handed on, and bytes of text a batch.
PART, COUNTED, BATCH = 1 << 19, 250_000, 1 << 20
#: How text falls into pieces (fixed by the vocabulary).
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECE = regex.compile(PIECE)
#: Beyond these, the regex module's Unicode tables are newer than the tokenizers library's, which cuts such texts itself.
_SAME = regex.compile("[^\\x00-\\u052f\\u1e00-\\u206f\\u20a0-\\u20bf\\u3040-\\u30ff\\u4e00-\\u9fff\\uac00-\\ud7a3]")
#: Chunks without white space that may be cut end to end with others.
_PLAIN = re.compile("[\x21-\x7e\xa1-\u052f\u1e00-\u1fff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3041-\u30ff\u4e00-\u9fff\uac00-\ud7a3]+")
#: A space before which a piece always ends.
_CUT = regex.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letters by which such vocabularies write bytes: printable ones themselves, the others from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class Vocabulary:
    """A byte-level BPE file of the tokenizers library: ids by bytes, merges by rank, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letter, vocab = byte_letters(), file["model"]["vocab"]
        spelled = {i: bytes(letter[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        spelled |= {i: t.encode() for t, i in self.special.items()}
        #: all ids' bytes end to end, and where each one's begin
        self._starts = np.cumsum([0, *(len(spelled.get(i, b"")) for i in range(max(spelled) + 1))])
        self._bytes = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(max(spelled) + 1)), np.uint8)
        self.single = np.zeros(256, np.int64)
        for t, i in vocab.items():
            if len(t) == 1:
                self.single[letter[t]] = i
        pairs = [p.split(" ") if isinstance(p, str) else p for p in file["model"]["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        key = ids[:, 0] << 32 | ids[:, 1]
        self._ranks = np.argsort(key, kind="stable")
        self._keys, self._merged = key[self._ranks], ids[:, 2]
        self._split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._rules, self._library = json.dumps(file | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}), None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; the number of merges where a pair has none."""
        none = len(self._keys)
        if not none:
            return np.zeros(left.shape, np.int64)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), none - 1)
        return np.where(self._keys[at] == key, self._ranks[at], none)

    def merge(self, piece: bytes) -> np.ndarray:
        """A piece's ids: of all adjacent pairs, that of the lowest rank is merged, leftmost first, until none can be.

        The pairs wait in a heap by rank and place, and the ids are linked both ways, so a piece of n bytes takes n log n steps.
        """
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n, none = len(ids), len(self._keys)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(self.rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()) if r < none] if n > 1 else []
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            pair = ids[i], ids[after[i]]
            if pair not in known:
                known[pair] = int(self.rank(np.array(pair[:1]), np.array(pair[1:]))[0])
            if known[pair] < none:
                heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:  # one of the two has been merged since
                continue
            ids[i], ids[j], after[i] = int(self._merged[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x in ids if x >= 0], "<u4")

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece. Pieces of about one length are merged in step, a pair of each at a time; long ones on their own."""
        out, size = [b""] * len(pieces), np.array([len(p) for p in pieces], np.int64)
        low = 0
        for width in (4, 8, 16, 32, LONGEST):
            at = np.flatnonzero((size > low) & (size <= width))
            low = width
            for i in range(0, len(at), 1 << 14):
                self._in_step(pieces, at[i : i + (1 << 14)], size, width, out)
        for i in np.flatnonzero(size > LONGEST).tolist():
            out[i] = self.merge(pieces[i]).tobytes()
        return out

    def _in_step(self, pieces: list[bytes], at: np.ndarray, size: np.ndarray, width: int, out: list[bytes]) -> None:
        none, place = len(self._keys), np.arange(width)
        packed = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in at.tolist()), np.uint8).reshape(-1, width)
        n = size[at]
        # the column behind the last id is never part of a pair
        ids = np.where(place < n[:, None], self.single[packed], -1)
        ranks = np.full((len(at), width), none, np.int64)
        ranks[:, :-1] = np.where(place[1:] < n[:, None], self.rank(ids[:, :-1], np.maximum(ids[:, 1:], 0)), none)
        while True:
            best = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(at)), best]
            if (done := lowest == none).any():
                for i, row, k in zip(at[done].tolist(), ids[done].astype("<u4"), n[done].tolist(), strict=True):
                    out[i] = row[:k].tobytes()
                at, n, ids, ranks, best, lowest = (x[~done] for x in (at, n, ids, ranks, best, lowest))
            if not len(at):
                return
            rows, shift = np.arange(len(at)), np.minimum(place + (place > best[:, None]), width - 1)
            ids[rows, best] = self._merged[lowest]
            ids, n = np.take_along_axis(ids, shift, 1), n - 1
            ranks = np.take_along_axis(ranks, shift, 1)
            ids[rows, n] = -1
            ranks[rows, n - 1] = none
            for left in (best - 1, best):
                pair = np.flatnonzero((left >= 0) & (left < n - 1))
                ranks[pair, left[pair]] = self.rank(ids[pair, left[pair]], ids[pair, left[pair] + 1])

    def rules(self) -> bytes:
        """What Ids.java needs beside the lexicon: kinds of characters, ids of bytes, merges in their order, special tokens; their lengths come first."""
        order = np.empty_like(self._ranks)
        order[self._ranks] = np.arange(len(order))
        merges = np.stack([self._keys[order] >> 32, self._keys[order] & 0xFFFFFFFF, self._merged], axis=1).ravel()
        arrays = [kinds(), self.single, merges, np.frombuffer(b"".join(t.encode() + b"\0" for t in self.special), np.uint8)]
        return np.concatenate([[len(a) for a in arrays], *arrays]).astype("<i8").tobytes()

    def spell(self, ids: np.ndarray) -> bytes:
        start = self._starts[ids]
        size = self._starts[ids + 1] - start
        return self._bytes[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())].tobytes()

    def chunks(self, text: str) -> list[str] | None:
        """A text cut at its single spaces, each of which begins the chunk behind it, and before its line ends; None if that could part a piece.

        A piece ends where a space stands between two other characters, and a line end there is a piece of its own. Two in a row are
        two pieces before a letter; three, or two before a space or the end, are not. What else has white space at its edge shows in the chunks.
        """
        if not 0 < len(text) <= PART or text[0] in " \n" or "\n\n\n" in text or "\n\n " in text or text.endswith("\n\n") or any(map(text.__contains__, self.special)):
            return None
        cut = text.replace("\n", " \n").split(" ")
        return None if cut[0][-1].isspace() else cut

    def pieces_of(self, chunks: list[str]) -> Iterator[list[str] | None]:
        """The pieces of each chunk, none of them a text's first; None if it has white space at its edge, so that its neighbours matter.

        Plain chunks are cut end to end: a piece that has a space begins the next chunk.
        """
        plain = list(filter(_PLAIN.fullmatch, chunks))
        cut = iter(_PIECE.findall(" ".join(["", *plain])))
        known, piece = {}, next(cut, None)
        for chunk in plain:
            got = [piece]
            for piece in cut:
                if piece[0] == " ":
                    break
                got.append(piece)
            known[chunk] = got
        for chunk in chunks:
            if chunk in known:
                yield known[chunk]
                continue
            body = chunk.removeprefix("\n")
            if body and not body[0].isspace() and not body[-1].isspace():
                yield self._cut(chunk if body is not chunk else " " + chunk)
            else:
                yield ["\n"] if chunk and not body else None

    def parts(self, text: str) -> Iterator[int | list[str]]:
        """Special tokens as ids, and what stands between them as lists of pieces, of about PART characters each."""
        at = 0
        for m in self._split.finditer(text) if self._split else ():
            yield from self._pieces(text[at : m.start()])
            yield self.special[m[0]]
            at = m.end()
        yield from self._pieces(text[at:] if at else text)

    def _pieces(self, text: str) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + PART) if len(text) - at > PART else None
            yield self._cut(text[at : cut.start() if cut else len(text)])
            at = cut.start() if cut else len(text)

    def _cut(self, part: str) -> list[str]:
        if not _SAME.search(part):
            return _PIECE.findall(part)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._rules).pre_tokenizer
        return [part[a:b] for _, (a, b) in self._library.pre_tokenize_str(part)]


def kinds() -> np.ndarray:
    """Of each code point below 65,536: 1 for letters, 2 for numbers, 3 for white space, 4 for others; 0 if only the library may cut a text that has it."""
    out = np.full(1 << 16, 4, np.int64)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(1 << 16))
    for kind, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s"), (0, _SAME.pattern)):
        out[[m.start() for m in regex.finditer(pattern, every)]] = kind
    out[0xD800:0xE000] = 0
    return out


class Lexicon:
    """The transducer as flat arrays in one file: arcs sorted by state and byte, their ends and outputs; final states; ids by rank."""

    NAMES = ("arcs", "ends", "outs", "final", "offsets", "ids")

    @staticmethod
    def build(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
        """Words are added in order; states that no later word can change are replaced by equal ones that exist already."""
        order = sorted(words)
        children: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # (parent, byte, child), of the last word's states not yet registered

        def settle(down_to: int) -> None:
            while len(path) > down_to:
                parent, byte, child = path.pop()
                shape = (final[child], tuple(sorted(children[child].items())))
                children[parent][byte] = register.setdefault(shape, child)

        last = b""
        for word in order:
            common = 0
            while common < min(len(last), len(word)) and last[common] == word[common]:
                common += 1
            settle(common)
            state = path[-1][2] if path else 0
            for byte in word[common:]:
                children.append({})
                final.append(False)
                new = len(children) - 1
                children[state][byte] = new
                path.append((state, byte, new))
                state = new
            final[state] = True
            last = word
        settle(0)
        # depth-first: number the states that stayed, and count the words below each
        number, below, stack = {0: 0}, {}, [(0, False)]
        while stack:
            s, done = stack.pop()
            if done:
                below[s] = final[s] + sum(below[c] for c in children[s].values())
            elif s not in below:
                stack.append((s, True))
                for c in children[s].values():
                    number.setdefault(c, len(number))
                    if c not in below:
                        stack.append((c, False))
        arcs = []
        for s, n in number.items():
            out = int(final[s])
            for byte, c in sorted(children[s].items()):
                arcs.append((n << 8 | byte, number[c], out))
                out += below[c]
        arcs.sort()
        flat = [i for w in order for i in words[w]]
        return {
            "arcs": np.array([a for a, _, _ in arcs], np.int64),
            "ends": np.array([e for _, e, _ in arcs], np.int64),
            "outs": np.array([o for _, _, o in arcs], np.int64),
            "final": np.array([final[s] for s in number], np.int64),
            "offsets": np.cumsum([0, *(len(words[w]) for w in order)]).astype(np.int64),
            "ids": np.array(flat, np.int64),
        }

    @classmethod
    def pack(cls, arrays: dict[str, np.ndarray]) -> bytes:
        return b"".join([np.array([len(arrays[n]) for n in cls.NAMES], np.int64).tobytes(), *(arrays[n].tobytes() for n in cls.NAMES)])

    @classmethod
    def write(cls, path: str, arrays: dict[str, np.ndarray]) -> None:
        with open(path, "wb") as f:
            f.write(cls.pack(arrays))

    def __init__(self, path: str):
        all_ = np.memmap(path, np.int64, "r").view(np.ndarray)  # of the mapped pages still, without the subclass's cost
        at = len(self.NAMES)
        for name, n in zip(self.NAMES, all_[:at], strict=True):
            setattr(self, name, all_[at : at + int(n)])
            at += int(n)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank, or -1: all words walk the automaton together, a byte at a step."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.arcs):
            return out
        size = np.array([len(w) for w in words], np.int64)
        live = np.flatnonzero((size > 0) & (size <= LONGEST))
        padded = np.frombuffer(b"".join(words[i].ljust(LONGEST, b"\0") for i in live.tolist()), np.uint8).reshape(-1, LONGEST)
        rows, state, rank = np.arange(len(live)), np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for step in range(LONGEST):
            key = state << 8 | padded[rows, step]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            found = self.arcs[arc] == key
            rows, arc = rows[found], arc[found]
            state, rank = self.ends[arc], rank[found] + self.outs[arc]
            ended = size[live[rows]] == step + 1
            good = ended & (self.final[state] == 1)
            out[live[rows[good]]] = rank[good]
            rows, state, rank = rows[~ended], state[~ended], rank[~ended]
            if not len(rows):
                break
        return out

    def of(self, rank: int) -> bytes:
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].astype("<u4").tobytes()


class Encoder:
    """Text to packed ids (little-endian unsigned 32-bit), with a memory of chunks over the lexicon that is bounded in bytes."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.known: dict[str, bytes | None] = {}
        self.before: dict[str, bytes | None] = {}
        self.held = 0

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Texts are taken together, of about PART characters, so that what is new to them is looked up at once."""
        out, at = [], 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= PART:
                size += len(texts[end])
                end += 1
            out += self._some(texts[at:end])
            at = end
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        cut = [self.vocabulary.chunks(t) for t in texts]
        met = set().union(*(c[1:] for c in cut if c))
        if self.held > REMEMBERED // 2:
            # what has been met since the last time stays
            self.known, self.before, self.held = {}, self.known, 0
        again = [c for c in met.difference(self.known) if c in self.before]
        self.known |= {c: self.before[c] for c in again}
        self.held += 250 * len(again)
        self._learn(met.difference(self.known))
        out, of = [], self.known.__getitem__
        heads = [self.vocabulary._cut(c[0]) if c else [] for c in cut]
        first = iter(self._ids([p for head in heads for p in head]))
        for text, chunks, head in zip(texts, cut, heads, strict=True):
            start = [next(first) for _ in head]
            try:
                out.append(b"".join([*start, *map(of, chunks[1:])]) if chunks else self._whole(text))
            except (KeyError, TypeError):  # a chunk has white space at its edge, or is too long to be remembered
                out.append(self._whole(text))
        return out

    def _whole(self, text: str) -> bytes:
        return b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(self._ids(p)) for p in self.vocabulary.parts(text))

    def _learn(self, chunks: set[str]) -> None:
        short = [c for c in chunks if len(c) <= LONG_CHUNK]
        cut = list(self.vocabulary.pieces_of(short))
        known = iter(self._ids([p for pieces in cut if pieces for p in pieces]))
        for chunk, pieces in zip(short, cut, strict=True):
            self.known[chunk] = None if pieces is None else b"".join([next(known) for _ in pieces]) if len(pieces) > 1 else next(known)
        self.held += 2 * sum(map(len, short)) + 200 * len(short)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each piece: by the lexicon, or merged."""
        new = list(dict.fromkeys(pieces))
        coded = [p.encode() for p in new]
        found = dict.fromkeys(new, b"")
        if self.lexicon:
            ranks = self.lexicon.ranks(coded)
            found |= {new[i]: self.lexicon.of(ranks[i]) for i in np.flatnonzero(ranks >= 0).tolist()}
        left = [i for i, p in enumerate(new) if not found[p]]
        found |= {new[i]: ids for i, ids in zip(left, self.vocabulary.merge_all([coded[i] for i in left]), strict=True)}
        return [found[p] for p in pieces]


@lru_cache(1)
def _vocabulary(path: str) -> Vocabulary:
    """One for all tasks of a worker: a few MB of arrays, made of a file that takes ten times as much to read."""
    made = Vocabulary(path)
    give_back()
    return made


def _counting(path: str):
    """Pieces and their counts. Those at odd white space are cut more simply than the encoder does, for the counts choose words and no more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        chunks, counts = Counter(), Counter()

        def flush():
            for (chunk, n), pieces in zip(chunks.items(), vocabulary.pieces_of(list(chunks)), strict=True):
                for p in pieces or vocabulary._cut(" " + chunk):
                    counts[p] += n
            pieces = [p for p in counts if len(p.encode()) <= LONGEST]
            out = pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array([counts[p] for p in pieces], pa.int64())], ["piece", "n"])
            chunks.clear()
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                for at in range(0, len(text), PART):
                    chunks.update(text[at : at + PART].replace("\n", " \n").split(" "))
                if len(chunks) > COUNTED:
                    yield flush()
        yield flush()

    return count


#: The bin of a count, in SQL, for an expression needs a session.
_LEVEL = "floor(log2(n) * 64)"


def _least_level(counts: DataFrame, size: int) -> int | None:
    least, left = None, size
    for r in sorted(counts.groupBy(F.expr(_LEVEL).alias("level")).count().collect(), reverse=True):
        if r["count"] > left:
            break
        least, left = r["level"], left - r["count"]
    return least


def frequent(counts: DataFrame, size: int) -> DataFrame:
    """The most frequent pieces, `size` at most. Counts fall into bins of a 64th of a power of two, and whole bins enter while they fit, so the driver gathers a line a bin (some 4,000 at most)."""
    least = _least_level(counts, size)
    return counts.where("false" if least is None else f"{_LEVEL} >= {least}").select("piece")


def most_frequent(counts: DataFrame, size: int) -> list[str]:
    return [r["piece"] for r in frequent(counts, size).collect()]


def _compiling(path: str):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        words = [p.encode() for batch in batches for p in batch.column(0).to_pylist() if p is not None]
        arrays = Lexicon.build({w: np.frombuffer(ids, "<u4").tolist() for w, ids in zip(words, vocabulary.merge_all(words), strict=True)})
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (Lexicon.pack(arrays), vocabulary.rules())], ["lexicon", "rules"])

    return build


def compile_lexicon(docs: DataFrame, vocabulary_path: str, text_col: str = "text", size: int = LEXICON) -> str:
    """Counts the pieces of every text, compiles the most frequent ones, hands the file to the executors, and returns its name there.

    One task compiles them (`size` at most), so the driver holds neither words nor vocabulary: it sees the files, some 7 MB, and no more.
    The rules of the vocabulary go along as a second file, whose name ends in .rules.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lexicon")
    counts = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(tidy(_counting(vocabulary_path)), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts, "counts")
    one = spark.range(1).select(F.lit(None).cast("string").alias("piece"))  # a task runs even if there is no piece
    made = frequent(counts, size).union(one).repartition(1).mapInArrow(tidy(_compiling(vocabulary_path)), "lexicon binary, rules binary").first()
    scratch.drop(counts)
    # Spark's file distribution takes it from the driver whenever an executor starts, so it stays until the driver ends
    folder = tempfile.mkdtemp(prefix="lexicon-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"lexicon-{uuid.uuid4().hex}.bin")
    for to, what in ((path, made["lexicon"]), (f"{path}.rules", made["rules"])):
        with open(to, "wb") as f:
            f.write(what)
        spark.sparkContext.addFile(to)
    return os.path.basename(path)


def _parts_of(batch: pa.RecordBatch, *at: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about BATCH bytes in those columns, so that what is made of them stays small."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in at)
    share = np.cumsum(sizes) // BATCH
    cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _decoded(vocabulary: Vocabulary, ids: list[bytes | None]) -> pa.Array:
    return pa.array([vocabulary.spell(np.frombuffer(i or b"", "<u4").astype(np.int64)).decode("utf-8", "replace") for i in ids], pa.string())


def _finishing(path: str, lexicon: str, decode: bool):
    """Rows of doc_id, text and ids: texts that came without ids are encoded."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, encoder = _vocabulary(path), None
        for whole in batches:
            for batch in _parts_of(whole, 1, 2):
                ids = batch.column(2).to_pylist()
                if left := [i for i, x in enumerate(ids) if x is None]:
                    encoder = encoder or Encoder(vocabulary, Lexicon(SparkFiles.get(lexicon)))
                    for i, x in zip(left, encoder.encode_all([batch.column(1)[i].as_py() or "" for i in left]), strict=True):
                        ids[i] = x
                made = [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*made, *([_decoded(vocabulary, ids)] if decode else [])], ["doc_id", "n_tokens", "ids", *(["decoded"] if decode else [])])

    return finish


def _decoding(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        for whole in batches:
            for batch in _parts_of(whole, 2):
                yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(vocabulary, batch.column(2).to_pylist())], [*batch.schema.names, "decoded"])

    return decode


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon: str | None = None, decode: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit) for each row of docs; with decode, also the text that they give.

    A null text has no ids. Special tokens' strings in a text become their ids. Repeated rows are encoded each. A text of any
    length is encoded whole, and so is a piece without a break. An empty table gives no rows.
    """
    name = lexicon or compile_lexicon(docs, vocabulary_path, text_col)
    rows = own_columns(docs, {"doc_id": id_col, "text": text_col})
    walk = native.function(docs.sparkSession, "Ids", "binary")
    walked = rows.withColumn("ids", F.expr(f"{walk}(CAST(text AS BINARY), '{name}/{name}.rules')")).select("doc_id", F.expr("IF(ids IS NULL, text, NULL)").alias("text"), "ids")
    return walked.mapInArrow(tidy(_finishing(vocabulary_path, name, decode)), f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids binary" + ", decoded string" * decode)


def decode_documents(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """The columns of encode_documents and decoded, the text; bytes that are no UTF-8 become U+FFFD."""
    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(tidy(_decoding(vocabulary_path)), f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids binary, decoded string")


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text that they give. One worker encodes and decodes, so a task has one process beside the JVM."""
    both = encode_documents(docs, vocabulary_path, decode=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
