"""MinHash near-dedup by a multi-index Hamming join.

Each document's set of word shingles gets a signature of SLOTS b-bit minima. The signature is split into chunks; by the
pigeonhole, two signatures that differ in at most `distance` slots have a chunk that differs in at most distance // chunks, so
a chunk's keys with every allowed choice of slots left out meet in at least one. Sets that are equal are joined before that, so
copies cost one row each. Candidates that pass the distance are confirmed on full sets.

Candidates within a bucket are not all paired: each is first held against a head of the bucket, and what that confirms is one
component. Pairs of one component change nothing, so a last round pairs those members of a bucket that are in different
components then, and nothing else. Buckets draw their heads by HEADS different orders, for near copies of one text are often
less alike than each is to some others: a member that one head misses has as many more to meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.llm.common import Scratch, own_columns, table, tidy

#: Words a shingle, and the similarity in percent that links.
SHINGLE, PERCENT = 5, 80
#: Signature: slots, bits a slot, slots a chunk, slots that may differ. For two sets of similarity 0.8, slots differ in 9.6 of 48
#: on average; more than 23 differ with a probability of about 3e-6. Of 12 chunks of 4, one differs in at most 1 of its slots.
SLOTS, BITS, CHUNK, DISTANCE = 48, 14, 4, 23
#: Slots of two bits in the sketches that the last round compares, and how many may differ. For similarity 0.8, 307 of 2,048 do
#: on average, and more than 380 with a probability of about 3e-6; texts of a similarity below some 0.73 hardly ever pass.
SKETCH, SKETCH_DISTANCE = 2048, 380
#: Members of a bucket in a block on average; the last round compares two blocks at a time.
CELL = 1024
#: Slots stand in lanes of 16 bits, of which the upper two stay free for counting.
_LANE = 16
_LANES = 64 // _LANE
#: Orders in which buckets draw heads; bytes of sets that a confirming task remembers, and pairs whose texts it unpacks at once.
HEADS, REMEMBERED, PAIRS = 24, 32 << 20, 256
_SEED = np.random.default_rng(20240229)
_MUL = _SEED.integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(0, 2**63, SLOTS, dtype=np.uint64)
_SKETCH_MUL = _SEED.integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SKETCH_ADD = _SEED.integers(0, 2**32, SKETCH, dtype=np.uint32)
_FILL, _CARRY = np.uint64(int("3fff" * _LANES, 16)), np.uint64(int("4000" * _LANES, 16))
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct n-word shingles; of fewer words, one of them all; of none, empty. A-Z are lowered; words part at the space and \\t \\n \\v \\f \\r."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if len(words) < n:
        return np.array([digest(b" ".join(words), 7)], np.uint64)
    h = np.array([digest(w) for w in words], np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = _mixed(out) + h[i : len(h) - n + 1 + i]
    return np.unique(_mixed(out))


def signature(shingles: np.ndarray, block: int = 4096) -> np.ndarray:
    """SLOTS minima, of which BITS bits are kept, packed into int64s."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), block):
        part = shingles[i : i + block]
        for s in range(SLOTS):
            least[s] = min(least[s], (part * _MUL[s] + _ADD[s]).min())
    slots = _mixed(least) & np.uint64((1 << BITS) - 1)
    packed = slots.reshape(-1, _LANES) << (np.arange(_LANES, dtype=np.uint64) * np.uint64(_LANE))
    return np.bitwise_or.reduce(packed, axis=1).astype(np.int64)


def sketch(shingles: np.ndarray, rows: int = 2048, columns: int = 64) -> np.ndarray:
    """SKETCH minima, of which two bits are kept, 32 to an int64. The set is taken in blocks, so memory does not grow with it."""
    least = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), rows):
        part = short[i : i + rows, None]
        for s in range(0, SKETCH, columns):
            least[s : s + columns] = np.minimum(least[s : s + columns], (part * _SKETCH_MUL[s : s + columns] + _SKETCH_ADD[s : s + columns]).min(axis=0))
    packed = (_mixed(least.astype(np.uint64)) & np.uint64(3)).reshape(-1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return np.bitwise_or.reduce(packed, axis=1).astype(np.int64)


def sketch_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many slots differ, by rows of two arrays of sketches."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(int("01" * 32, 2))).sum(axis=-1, dtype=np.int64)


def chunks_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many slots of each chunk of two signatures differ. A lane that is not 0 after xor carries into its first free bit."""
    return np.bitwise_count(((a.view(np.uint64) ^ b.view(np.uint64)) + _FILL) & _CARRY)


def first_shared(k: int, apart: np.ndarray) -> np.ndarray:
    """Of pairs, by their chunks_apart: whether k is the first of the keys that they share. A chunk with one slot apart shares one key, one with none all of its keys."""
    assert CHUNK == _LANES and DISTANCE // (SLOTS // CHUNK) == 1
    c, omitted = divmod(k, CHUNK)
    return (apart[:, :c] > 1).all(axis=1) & ((apart[:, c] == 1) | ((apart[:, c] == 0) & (omitted == 0)))


_SIGNED = "doc_id long, n_shingles long, digest binary, sig array<long>"


def _digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _signed(n: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for text in batch.column(1):
                got = shingle_set(text.as_py(), n)
                sizes.append(len(got))
                digests.append(_digest(got))
                sigs.append(signature(got) if len(got) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "sig"])

    return sign


def _sketched(n: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), n) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in found], pa.binary()), pa.array([sketch(x) for x in found], pa.list_(pa.int64()))], ["digest", "sketch"])

    return make


def _confirmed(n: int, percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple[int, bytes], np.ndarray] = {}
        held = 0

        def of(doc_id: int, text: bytes) -> np.ndarray:
            nonlocal held
            key = (doc_id, text)
            if key not in sets:
                if held > REMEMBERED:
                    sets.clear()
                    held = 0
                sets[key] = shingle_set(text, n)
                held += sets[key].nbytes + len(text) + 200
            return sets[key]

        for whole in batches:
            for batch in (whole.slice(i, PAIRS) for i in range(0, whole.num_rows, PAIRS)):
                ok = []
                for u, v, tu, tv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    a, b = of(u, tu), of(v, tv)
                    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                    ok.append(100 * both >= percent * (len(a) + len(b) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return confirm


def bucket_keys(sig: str = "sig", chunk: int = CHUNK, distance: int = DISTANCE) -> Column:
    """An array of a signature's keys: for each chunk and each choice of slots that may differ, a hash of the slots left."""
    chunks = SLOTS // chunk
    errors = distance // chunks
    keys = []
    for c in range(chunks):
        for left in combinations(range(c * chunk, (c + 1) * chunk), chunk - errors):
            slots = [F.shiftrightunsigned(F.element_at(sig, s // _LANES + 1), (s % _LANES) * _LANE).bitwiseAND(F.lit((1 << BITS) - 1)) for s in left]
            keys.append(F.xxhash64(F.lit(len(keys)), *slots))
    return F.array(*keys)


def slots_apart(a: str, b: str) -> str:
    """SQL: how many slots of two signatures differ. A lane that is not 0 after xor carries into its first free bit; no sum leaves its lane or overflows."""
    fill, carry = int("3fff" * _LANES, 16), int("4000" * _LANES, 16)
    return " + ".join(f"bit_count((({a}[{i}] ^ {b}[{i}]) + {fill}L) & {carry}L)" for i in range(SLOTS // _LANES))


_CELL = ("key", "i", "j", "block", "k", "rep", "comp", "n", "sig", "sketch")


def _pairs_of(cell: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a cell that are close in size, signature and sketch, in different components, and at the first key that they share."""
    order = np.argsort(cell["n"], kind="stable")
    rep, comp, n, block, sig, own = (cell[c][order] for c in ("rep", "comp", "n", "block", "sig", "sketch"))
    k, across, us, vs = int(cell["k"][0]), cell["i"][0] != cell["j"][0], [], []
    most = np.searchsorted(n, n * 100 // percent, "right")
    rows = max(1, 80_000 // len(n))
    for a in range(0, len(n) - 1, rows):
        b = min(a + rows, len(n))
        end = int(most[a:b].max())
        apart = chunks_apart(sig[a:b, None], sig[None, a:end])
        good = (apart.sum(axis=2, dtype=np.int64) <= DISTANCE) & (np.arange(a, end) > np.arange(a, b)[:, None]) & (np.arange(a, end) < most[a:b, None]) & (comp[a:end] != comp[a:b, None])
        if across:
            good &= block[a:end] != block[a:b, None]
        x, y = np.nonzero(good)
        first = first_shared(k, apart[x, y])
        x, y = x[first] + a, y[first] + a
        for at in range(0, len(x), 4096):
            u, v = x[at : at + 4096], y[at : at + 4096]
            near = sketch_apart(own[u], own[v]) <= SKETCH_DISTANCE
            us.append(np.maximum(rep[u], rep[v])[near])
            vs.append(np.minimum(rep[u], rep[v])[near])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64),) * 2


def _paired(percent: int):
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; that which a batch ends in waits for the next."""
        held: dict[str, np.ndarray] = {}

        def found(rows: dict[str, np.ndarray], cuts: list[int]) -> pa.RecordBatch:
            got = [_pairs_of({c: x[a:b] for c, x in rows.items()}, percent) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[side] for g in got] or [np.empty(0, np.int64)]), pa.int64()) for side in (0, 1)], ["u", "v"])

        for batch in batches:
            rows = {}
            for c in _CELL:
                column = batch.column(c)
                x = column.flatten().to_numpy().reshape(batch.num_rows, -1) if c in ("sig", "sketch") else column.to_numpy()
                rows[c] = np.concatenate([held[c], x]) if held else x
            if not len(rows["key"]):
                continue
            new = (np.diff(rows["key"]) != 0) | (np.diff(rows["i"]) != 0) | (np.diff(rows["j"]) != 0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
            yield found(rows, cuts)
            held = {c: x[cuts[-1] :] for c, x in rows.items()}
        if held:
            yield found(held, [0, len(held["key"])])

    return pair


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 64) -> DataFrame:
    """node, comp (the smallest node it reaches) for each node of edges (u, v), by large and small stars in turn until nothing changes. Each round is written, so lineage stays short; the driver sees a count and a checksum."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seal = F.struct(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)))
    was = None
    for turn in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        small = scratch.save(small, "small")
        scratch.drop(large, *([now] if turn else []))
        now, last, was = small, was, small.select(seal).first()[0]
        if last == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """Of pairs (u, v), those whose full sets are similar. Only texts of the ids in pairs are shuffled; the ids are broadcast while they are at most BROADCAST_IDS."""
    ids = scratch.save(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), "ids")
    small = ids.count() <= BROADCAST_IDS
    needed = scratch.save(texts.join(F.broadcast(ids) if small else ids, "id", "left_semi").dropDuplicates(["id", "text"]), "texts")
    both = pairs.join(needed.select(F.col("id").alias("v"), F.col("text").alias("tv")), "v").join(needed.select(F.col("id").alias("u"), F.col("text").alias("tu")), "u")
    out = scratch.save(both.select("u", "v", "tu", "tv").mapInArrow(tidy(_confirmed(shingle, percent)), "u long, v long").distinct(), "links")
    scratch.drop(ids, needed)
    return out


#: Ids of candidates that may be broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Documents link if their sets' similarity reaches percent; component_id is the smallest id that links reach, and kept says
    that it is the document's own. Ids are integers. Null and empty texts, and texts without a word, have no shingles and link
    to nothing. A row without an id has no component and is kept, and links nothing. Rows that share an id are one node, which
    has the links of each. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "neardup")
    texts = own_columns(docs, {"id": id_col, "text": text_col}).select(F.col("id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    signed = scratch.save(texts.mapInArrow(tidy(_signed(shingle)), _SIGNED), "signed")
    usable = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    sets = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("x")).select("digest", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n"), F.col("x.sig").alias("sig"))
    sets = scratch.save(sets, "sets")
    keyed = sets.select("rep", "digest", F.posexplode(bucket_keys()).alias("k", "key"))
    head = F.min_by("rep", F.xxhash64(F.pmod("key", F.lit(HEADS)), "rep")).alias("head")
    heads = keyed.groupBy("key").agg(head, F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("key", "head")
    members = scratch.save(keyed.join(heads, "key"), "members")

    close = F.expr(f"100 * least(n, hn) >= {percent} * greatest(n, hn) AND {slots_apart('sig', 'hsig')} <= {DISTANCE}")
    met = members.where("rep <> head").select("rep", "digest", "head").distinct().join(sets.select("digest", "n", "sig"), "digest")
    met = met.join(sets.select(F.col("rep").alias("h"), F.col("n").alias("hn"), F.col("sig").alias("hsig")), F.col("head") == F.col("h")).where(close)
    tried = scratch.save(met.select(F.greatest("rep", "head").alias("u"), F.least("rep", "head").alias("v")).distinct(), "tried")
    links = _confirm(tried, texts, shingle, percent, scratch)
    comps = scratch.save(connected_components(links, scratch), "components")

    # the last round: members of one bucket, close in size, signature and sketch, that are in different components still
    now = members.select("k", "key", "rep", "digest").join(comps, members["rep"] == comps["node"], "left").select("k", "key", "rep", "digest", F.coalesce("comp", "rep").alias("comp"))
    split = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).where("low <> high").select("key", F.ceil(F.col("m") / CELL).cast("int").alias("blocks"))
    mixed = scratch.save(now.join(split, "key"), "mixed")
    crowd = scratch.save(mixed.select(F.col("rep").alias("id")).distinct(), "crowd")
    few = crowd.count() <= BROADCAST_IDS
    crowded = texts.join(F.broadcast(crowd) if few else crowd, "id", "left_semi").dropDuplicates(["id", "text"]).select("text")
    sketches = scratch.save(crowded.mapInArrow(tidy(_sketched(shingle)), "digest binary, sketch array<long>").dropDuplicates(["digest"]), "sketches")
    # a bucket's members are dealt into blocks, and each two blocks meet in a cell of their own: no task takes a whole bucket
    # a row a member is described before its rows of all buckets meet it: one join of them all
    described = sets.select("digest", "n", "sig").join(sketches, "digest")
    sized = mixed.join(described, "digest").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    cells = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rest = cells.select(*_CELL).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(tidy(_paired(percent)), "u long, v long")
    rest = scratch.save(rest.join(tried, ["u", "v"], "left_anti"), "rest")
    last = _confirm(rest, texts, shingle, percent, scratch)

    # ids of several texts join what each of them links to
    placed = scratch.save(usable.select("doc_id", "digest").join(sets.select("digest", "rep"), "digest").select("doc_id", "digest", "rep"), "placed")
    several = placed.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("doc_id")
    same = placed.join(several, "doc_id").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    added = scratch.save(last.union(same), "added")
    # what is known already enters as one link a node
    known = comps.where("node <> comp").select(F.col("node").alias("u"), F.col("comp").alias("v"))
    final = comps if added.isEmpty() else scratch.save(connected_components(known.union(added), scratch), "final")
    named = placed.join(final, placed["rep"] == final["node"], "left").select("doc_id", F.coalesce("comp", "rep").alias("component")).groupBy("doc_id").agg(F.min("component").alias("component"))
    named = scratch.save(named, "named")
    scratch.drop(sets, members, tried, links, comps, mixed, crowd, sketches, rest, last, added, placed, *([] if final is comps else [final]))
    out = signed.select("doc_id", "n_shingles", F.col("digest").isNotNull().alias("some")).join(named, "doc_id", "left")
    component = F.when(F.col("some"), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> ''), []::VARCHAR[]) AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM d
), g AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (na + nb - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) ON a = doc_id
"""
