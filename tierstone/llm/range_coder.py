"""Token ids as a binary table of range-coded blocks.

A block holds at most BLOCK ids and is coded on its own: nothing is carried over from another, so a lost or damaged one costs
no other, and its checksum tells. Predictions of order 0 (the block's own frequencies), order 1 and order 2 (what followed the
last one or two ids before) are mixed, with weights that follow how often each came true, into the interval that an
arithmetic coder narrows. The executors' JVM codes and decodes blocks, an id at a time (Coder.java). encode_blocks and decode_blocks
take the same steps for many blocks at once, to read and write payloads without Spark; the bytes are the same.

Plain chunks of text (ASCII, Latin letters, some punctuation) are cut and merged in the JVM as the vocabulary's file has it
(Words.java). All others, and those with pieces over 256 bytes or what may be a special token, are encoded by the tokenizers library.

File format: Parquet rows (shard, block, first, n, checksum, segments, payload). Payload: little-endian 16-bit words of the coder, and
checksum is the CRC-32 of the block's ids as 32-bit integers. segments tells the documents that the ids belong to, and where theirs begin.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.llm import native
from tierstone.llm.bpe import byte_letters, vocabulary
from tierstone.llm.common import Scratch, let, own_columns, table, tidy

#: Ids a block; blocks coded in step at most; ids between two updates of order 0; weight of a seen id against an unseen one.
BLOCK, LANES, REFRESH, SEEN = 4096, 1024, 1024, 32
#: Entries of the order-1 and order-2 tables of a block (powers of two), and the greatest odds of a prediction, in sixteenths.
ORDER1, ORDER2, ODDS = 2048, 4096, 240
#: Ids are below this; chunks of text that a task remembers, and the longest in characters that it does; documents' end.
IDS, REMEMBERED, LONG_CHUNK, END = 1 << 16, 100_000, 256, 2
#: What stands for a chunk that Words.java left; documents that are completed at once.
HOLE, TOGETHER = 0xFFFF, 256
_WINDOW, _SETTLED, _FLOOR = np.uint64((1 << 48) - 1), np.uint64(32), np.uint64(1 << 28)
_U = np.uint64


class _Model:
    """The adaptive state of many blocks; coder and decoder drive it alike. All arithmetic is on integers."""

    def __init__(self, lanes: int):
        self.at1, self.at2 = np.arange(lanes) * ORDER1, np.arange(lanes) * ORDER2
        #: guessed id and, from bit 16 on, the trust in it
        self.guess = [np.zeros(lanes * n, np.uint32) for n in (ORDER1, ORDER2)]
        self.hits = [np.zeros((lanes, 4), np.int64) for _ in range(2)]
        self.tries = [np.zeros((lanes, 4), np.int64) for _ in range(2)]
        #: how many ids of the block were lower than each, as of the last refresh; what two neighbours differ by is the count of one
        self.lower = np.zeros((lanes, IDS + 1), np.uint16)
        self.seen = np.zeros((lanes, 0), np.int64)  # sorted ids of the block so far, as of the last refresh
        self.last = [np.zeros(lanes, np.int64) for _ in range(2)]

    def refresh(self, ids: np.ndarray) -> None:
        lanes, new = len(ids), ids[:, self.seen.shape[1] :]
        self.seen = np.sort(ids, axis=1)
        if new.shape[1]:
            for lane in range(lanes):
                self.lower[lane, 1:] += np.cumsum(np.bincount(new[lane], minlength=IDS), dtype=np.uint16)
        #: F0 of the k-th seen id, without those equal to it before: strictly rising within a lane
        self.steps = (self.seen + SEEN * np.arange(self.seen.shape[1])[None, :] + (np.arange(lanes) * (IDS + SEEN * BLOCK))[:, None]).ravel()

    def below(self, lanes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order 0: cumulative frequency below each id, and its own."""
        at = lanes * (IDS + 1) + ids
        low = self.lower.reshape(-1)[at].astype(np.int64)
        high = self.lower.reshape(-1)[at + 1].astype(np.int64)
        return SEEN * low + ids, SEEN * (high - low) + 1

    def find(self, lanes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Order 0: the id whose interval has the cumulative frequency `at`."""
        n = self.seen.shape[1]
        if not n:
            return at
        # id x spans [SEEN * below(x) + x, ... + SEEN * count(x)]: k ids are below or at the place if steps[k - 1] <= at
        k = np.searchsorted(self.steps, at + lanes * (IDS + SEEN * BLOCK), "right") - lanes * n
        last = np.where(k > 0, self.seen[lanes, np.maximum(k - 1, 0)], -1)
        return np.maximum(at - SEEN * k, last)

    def predict(self, lanes: np.ndarray):
        """Per order: place in its table, guessed id, trust, and mass against the total of order 0."""
        total = IDS + SEEN * self.seen.shape[1]
        out = []
        one, two = self.last[0][lanes], self.last[1][lanes]
        for k, at in ((0, self.at1[lanes] + (one & (ORDER1 - 1))), (1, self.at2[lanes] + ((one * 40503 + two * 30011 >> 3) & (ORDER2 - 1)))):
            entry = self.guess[k][at]
            trust = (entry >> np.uint32(16)).astype(np.int64)
            h, t = self.hits[k][lanes, trust], self.tries[k][lanes, trust]
            odds = np.minimum(16 * (2 * h + 1) // (2 * (t - h) + 1), ODDS)
            out.append((at, (entry & np.uint32(0xFFFF)).astype(np.int64), trust, np.where(trust > 0, total * odds >> 4, 0)))
        return total, out

    def learn(self, lanes: np.ndarray, ids: np.ndarray, predicted) -> None:
        for k, (at, guess, trust, _) in enumerate(predicted):
            hit = guess == ids
            self.tries[k][lanes, trust] += 1
            self.hits[k][lanes, trust] += hit & (trust > 0)
            weak = ~hit & (trust <= 1)
            now = np.where(hit, np.minimum(trust + 1, 3), np.where(weak, 1, trust - 1))
            self.guess[k][at] = now << 16 | np.where(weak, ids, guess)
        self.last[1][lanes] = self.last[0][lanes]
        self.last[0][lanes] = ids


def _padded(blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for b in blocks], np.int64)
    ids = np.zeros((len(blocks), max(1, sizes.max(initial=0))), np.int64)
    for row, b in enumerate(blocks):
        ids[row, : len(b)] = b
    return ids, sizes


def _unsettled(low: np.ndarray, width: np.ndarray, among: np.ndarray | None) -> np.ndarray:
    """Places whose top word can be shifted out: both ends of the interval agree on it, or the interval is cut until they do."""
    a, w = (low, width) if among is None else (low[among], width[among])
    same = (a ^ (a + w - _U(1))) >> _SETTLED == 0
    thin = np.flatnonzero(~same & (w < _FLOOR))
    if len(thin):
        at = thin if among is None else among[thin]
        width[at] = _FLOOR - (low[at] & (_FLOOR - _U(1)))
        same[thin] = True
    return np.flatnonzero(same) if among is None else among[same]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The payload of each block of ids below 65,536."""
    if not blocks:
        return []
    ids, sizes = _padded(blocks)
    n = len(blocks)
    model = _Model(n)
    low, width = np.zeros(n, _U), np.full(n, _WINDOW)
    out, used = np.zeros((n, ids.shape[1] * 2 + 8), np.uint16), np.zeros(n, np.int64)
    every = np.arange(n)
    for start in range(0, ids.shape[1], REFRESH):
        live = np.flatnonzero(sizes > start)
        model.refresh(ids[:, :start])
        for step in range(start, min(start + REFRESH, ids.shape[1])):
            lanes = live if step == start else lanes[sizes[lanes] > step]
            if not len(lanes):
                break
            x = ids[lanes, step]
            total, predicted = model.predict(lanes)
            below, mass = model.below(lanes, x)
            for _, guess, _, m in predicted:
                total = total + m
                below = below + m * (guess < x)
                mass = mass + m * (guess == x)
            unit = width[lanes] // total.astype(_U)
            a = low[lanes] + unit * below.astype(_U)
            w = unit * mass.astype(_U)
            todo = _unsettled(a, w, None)
            while len(todo):
                rows = lanes[todo]
                out[rows, used[rows]] = (a[todo] >> _SETTLED).astype(np.uint16)
                used[rows] += 1
                a[todo] = (a[todo] << _U(16)) & _WINDOW
                w[todo] <<= _U(16)
                todo = _unsettled(a, w, todo)
            low[lanes], width[lanes] = a, w
            model.learn(lanes, x, predicted)
    for shift in (32, 16, 0):
        out[every, used] = (low >> _U(shift)).astype(np.uint16)
        used += 1
    return [out[i, : used[i]].astype("<u2").tobytes() for i in range(n)]


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each payload, given how many there are."""
    if not payloads:
        return []
    n = len(payloads)
    counts = np.array(sizes, np.int64)
    longest = max(1, int(counts.max(initial=0)))
    words = np.zeros((n, max(len(p) for p in payloads) // 2 + 8), _U)
    for row, p in enumerate(payloads):
        got = np.frombuffer(p, "<u2")
        words[row, : len(got)] = got
    model = _Model(n)
    ids = np.zeros((n, longest), np.int64)
    low, width = np.zeros(n, _U), np.full(n, _WINDOW)
    code = words[:, 0] << _U(32) | words[:, 1] << _U(16) | words[:, 2]
    used = np.full(n, 3, np.int64)
    for start in range(0, longest, REFRESH):
        model.refresh(ids[:, :start])
        lanes = np.flatnonzero(counts > start)
        for step in range(start, min(start + REFRESH, longest)):
            lanes = lanes[counts[lanes] > step]
            if not len(lanes):
                break
            zero, predicted = model.predict(lanes)
            (_, g1, _, m1), (_, g2, _, m2) = predicted
            total = zero + m1 + m2
            a = low[lanes]
            unit = width[lanes] // total.astype(_U)
            at = np.minimum(((code[lanes] - a) // unit).astype(np.int64), total - 1)
            # the guesses' masses stand in front of their ids: take off what is below, or stop inside one
            b1, f1 = model.below(lanes, g1)
            b2, f2 = model.below(lanes, g2)
            s1, e1 = b1 + m2 * (g2 < g1), b1 + f1 + m1 + m2 * (g2 <= g1)
            s2, e2 = b2 + m1 * (g1 < g2), b2 + f2 + m2 + m1 * (g1 <= g2)
            in1, in2 = (at >= s1) & (at < e1), (at >= s2) & (at < e2)
            rest = at - m1 * (at >= e1) - m2 * (at >= e2)
            x = np.where(in1, g1, g2)
            missed = np.flatnonzero(~in1 & ~in2)
            x[missed] = model.find(lanes[missed], np.clip(rest[missed], 0, zero - 1))
            below, mass = model.below(lanes, x)
            for _, guess, _, m in predicted:
                below = below + m * (guess < x)
                mass = mass + m * (guess == x)
            a = a + unit * below.astype(_U)
            w = unit * mass.astype(_U)
            c = code[lanes]
            todo = _unsettled(a, w, None)
            while len(todo):
                rows = lanes[todo]
                c[todo] = ((c[todo] << _U(16)) & _WINDOW) | words[rows, np.minimum(used[rows], words.shape[1] - 1)]
                used[rows] += 1
                a[todo] = (a[todo] << _U(16)) & _WINDOW
                w[todo] <<= _U(16)
                todo = _unsettled(a, w, todo)
            low[lanes], width[lanes], code[lanes] = a, w, c
            ids[lanes, step] = x
            model.learn(lanes, x, predicted)
    return [ids[i, : counts[i]] for i in range(n)]


class _Writer:
    """Ids of consecutive documents into blocks of whole documents where they fit; a longer document spans blocks of its own."""

    def __init__(self):
        self.blocks, self.about, self.ids, self.parts, self.n = [], [], [], [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        if self.n + len(ids) > BLOCK:
            self.close()
        for i in range(0, len(ids), BLOCK):
            piece = ids[i : i + BLOCK]
            self.ids.append(piece)
            self.parts.append({"doc_id": doc_id, "part": i // BLOCK, "parts": -(-len(ids) // BLOCK), "at": self.n, "n": len(piece)})
            self.n += len(piece)
            if len(ids) > BLOCK:
                self.close()

    def close(self) -> None:
        if self.n:
            self.blocks.append(np.concatenate(self.ids))
            self.about.append(self.parts)
        self.ids, self.parts, self.n = [], [], 0


_SEGMENTS = pa.list_(pa.struct([("doc_id", pa.int64()), ("part", pa.int64()), ("parts", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]))
_FILE = "shard int, block long, first long, n long, checksum long, segments array<struct<doc_id:long,part:long,parts:long,at:long,n:long>>, ids binary"


def chunks(text: str) -> list[str]:
    """Pieces of text between blanks, tabs and line ends: the tokenizer's normaliser and splitter treat each on its own."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class WordEncoder:
    """A tokenizer of the tokenizers library, asked once for each chunk it has not met lately."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.forget()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.each(chunks(text))), "<u2")

    def each(self, found: list[str]) -> list[bytes]:
        """Packed ids of each chunk."""
        if len(self.known) > REMEMBERED:
            # what has been met since the last time stays
            self.known, self.before = {"": b""}, self.known
        met = set(found).difference(self.known)
        self.known |= {c: self.before[c] for c in met if c in self.before}
        new = list(met.difference(self.before))
        fresh = {c: np.array(got.ids, "<u2").tobytes() for c, got in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True)} if new else {}
        self.known |= {c: ids for c, ids in fresh.items() if len(c) <= LONG_CHUNK}
        return [fresh[c] if c in fresh else self.known[c] for c in found] if fresh else list(map(self.known.__getitem__, found))

    def complete(self, walked: list[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of texts of which Words.java has encoded what is plain; the library encodes what it left."""
        parts = [(w, 4 + 2 * int.from_bytes(w[:4], "little")) for w in (x or bytes(4) for x in walked)]
        left = iter(self.each([c for w, at in parts if len(w) > at for c in w[at:].decode().split(" ")]))
        for w, at in parts:
            ids = np.frombuffer(w[4:at], "<u2")
            if len(w) > at:
                plain = w[4:at]
                cuts = (2 * np.flatnonzero(ids == HOLE)).tolist()
                pieces = [plain[: cuts[0]]]
                for a, b in zip(cuts, [*cuts[1:], len(plain)], strict=True):
                    pieces += [next(left), plain[a + 2 : b]]
                ids = np.frombuffer(b"".join(pieces), "<u2")
            yield ids

    def forget(self) -> None:
        self.known, self.before = {"": b""}, {}


@cache
def word_encoder(path: str) -> WordEncoder:
    """One library tokenizer for all tasks of a worker. What a task remembers goes with it."""
    return WordEncoder(path)


def _writing(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, shard, first, block = word_encoder(path), _Writer(), TaskContext.get().partitionId(), 0, 0

        def flush():
            nonlocal first, block
            blocks, about = writer.blocks[:LANES], writer.about[:LANES]
            del writer.blocks[:LANES], writer.about[:LANES]
            sizes = [len(b) for b in blocks]
            firsts = [first + s - n for s, n in zip(np.cumsum(sizes).tolist(), sizes, strict=True)]
            sums = [zlib.crc32(b.astype("<u4").tobytes()) for b in blocks]
            out = [[shard] * len(blocks), range(block, block + len(blocks)), firsts, sizes, sums, about, [b.tobytes() for b in blocks]]
            first, block = first + sum(sizes), block + len(blocks)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), _SEGMENTS, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["shard", "block", "first", "n", "checksum", "segments", "ids"])

        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.complete(some.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, np.append(ids, np.uint16(END)))
                    while len(writer.blocks) >= LANES:
                        yield flush()
        writer.close()
        while writer.blocks:
            yield flush()
        encoder.forget()

    return write


def word_rules(path: str) -> bytes:
    """What Words.java needs of a vocabulary: the ids of bytes within a piece and at its end, and the merges in their order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    letters = sorted(byte_letters().items(), key=lambda x: x[1])
    pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
    numbers = [*(vocab[c] for c, _ in letters), *(vocab[c + end] for c, _ in letters), *(i for a, b in pairs for i in (vocab[a], vocab[b], vocab[a + b]))]
    return np.array(numbers, "<i8").tobytes()


def _ruling(path: str):
    def rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([word_rules(path)], pa.binary())], ["rules"])

    return rule


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every text's ids and the end id in ascending order of document ids. A null text has the end id alone; null ids come first, rows of equal ids in the order of their texts. An empty table gives an empty file."""
    rows = own_columns(docs, {"doc_id": id_col, "text": text_col}).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    # a task reads the vocabulary, so the driver's process does not hold it
    rules = native.hand_out(spark, "words", spark.range(1).coalesce(1).mapInArrow(tidy(_ruling(tokenizer_path)), "rules binary").first()["rules"])
    words, coder = native.function(spark, "Words", "binary"), native.function(spark, "Coder", "binary")
    walked = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").select("doc_id", F.expr(f"{words}(CAST(text AS BINARY), '{rules}')").alias("walked"))
    blocks = walked.mapInArrow(tidy(_writing(tokenizer_path)), _FILE)
    blocks.select("shard", "block", "first", "n", "checksum", "segments", F.expr(f"{coder}(ids, -1L)").alias("payload")).write.parquet(path)


def _documents(coder: str) -> Column:
    """Of each block: the documents of its segments with their ids, after its checksum has been compared. A damaged one ends the query."""
    damaged = F.expr("CAST(raise_error(concat('DamagedBlock: shard ', shard, ', block ', block)) AS BINARY)")
    cut = lambda ids, s: F.struct((F.col("first") + s["at"]).alias("at"), s["doc_id"].alias("doc_id"), s["part"].alias("part"), s["parts"].alias("parts"), s["n"].alias("n"), F.substring(ids, (4 * s["at"] + 1).cast("int"), (4 * s["n"]).cast("int")).alias("ids"))
    # let() decodes a block once, however many segments it has
    checked = let(F.expr(f"{coder}(payload, n)"), lambda ids: F.when(F.crc32(ids) == F.col("checksum"), ids).otherwise(damaged))
    return let(checked, lambda ids: F.transform("segments", lambda s: cut(ids, s)))


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (packed little-endian unsigned 32-bit) of each document. Only documents that span blocks are brought together by a shuffle. The driver gathers a sum for each shard."""
    blocks = spark.read.parquet(path)
    totals, sofar, offsets = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()}, 0, {}
    for shard in sorted(totals):
        offsets[shard], sofar = sofar, sofar + totals[shard]
    if offsets:
        offset = F.element_at(F.expr(f"array({','.join(f'{offsets.get(s, 0)}L' for s in range(max(offsets) + 1))})"), F.col("shard") + 1)
    else:
        offset = F.lit(0).cast("long")
    # a document that spans blocks has them to itself, so blocks of either kind are decoded once
    parted = F.col("segments")[0]["parts"] > 1
    documents = _documents(native.function(spark, "Coder", "binary"))
    read = lambda kind: blocks.where(kind).select("shard", "block", F.inline(documents)).withColumn("start", offset + F.col("at"))
    whole = read(~parted).select("doc_id", "start", F.col("n").alias("n_tokens"), "ids")
    first = F.col("block") - F.col("part")
    gathered = read(parted).groupBy("shard", first.alias("head")).agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("p"))
    joined = F.expr("aggregate(transform(p, x -> x.ids), X'', (a, x) -> concat(a, x))")
    return whole.union(gathered.select("doc_id", "start", "n_tokens", joined))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("file")
    write_token_file(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
