import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkFiles
from tokenizers import Tokenizer

from tests.conftest import same
from tests.llm.test_native_operators import HARD, frame
from tierstone.llm import bpe, importance, native, near_dup, range_coder, warc
from tierstone.llm.common import Scratch, table, tidy

BYTE, WORD = bpe.vocabulary("byte_bpe_50k.json"), bpe.vocabulary("word_bpe_49k.json")
TEXTS = ["a<|endoftext|>b <|endoftext|>", "Hello  world 's\n\n xոy \U00010940 z", "é" * 5 + " ", "\x1c a　b", "it's 12 3/4 naïve — ok\t\r\n", " " * 9, "\x85x\xa0y"]
CLASHING = [(50 + i, t) for i, t in enumerate(TEXTS)]


# archives


def test_captures_match_sql(spark, sf_dir, duck):
    same(warc.op1_transaction_assembly(spark, sf_dir), duck, warc.OP1_SQL)


def test_captures_hard_rows(spark):
    rows = [(1, "http://a/x", "same"), (5, "http://a/y", "same"), (3, None, "same"), (2, "http://b", None), (7, "http://b/\r\nz", ""), (8, "u", "x\r\n\r\ny"), (9, "u", "é" * 70000), (9, "u", "é" * 70000), (None, "n", "same")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = Scratch(spark, "t").path("warc")
    warc.write_captures(pages, path)
    records = warc.read_records(spark, path)
    got = warc.assemble(records).collect()
    assert sum(len(c["responses"]) for c in got) == len(rows) and all(len(c["requests"]) == len(c["metadata"]) == len(c["responses"]) for c in got)
    kinds = {(r["record_type"], r["payload_bytes"], r["refers_to_page"]) for c in got for r in c["responses"]}
    assert {("response", 4, None), ("revisit", 4, 5), ("response", 0, None), ("revisit", 0, 7), ("response", 6, None), ("response", 140000, None)} == kinds
    assert {bytes(r["payload"]) for c in got for r in c["responses"] if r["record_type"] == "response"} == {b"same", b"", b"x\r\n\r\ny", ("é" * 70000).encode()}
    alone = warc.assemble(records.where("record_type = 'request'"))
    assert alone.count() == len(got) and all(not c["responses"] for c in alone.collect())
    empty = Scratch(spark, "t").path("warc")
    warc.write_captures(pages.limit(0), empty)
    assert warc.assemble(warc.read_records(spark, empty)).count() == 0


def test_damaged_record_is_told():
    import io

    with pytest.raises(warc.BadRecord):
        list(warc.parse_records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
    with pytest.raises(warc.BadRecord):
        warc._row({"warc-type": "response", "content-type": "application/http", "warc-payload-digest": "sha1:X"}, b"HTTP/1.1 200 OK\r\n\r\nabc", True)


# near duplicates


def brute_components(rows, n, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    comp = {i: i for i, _ in rows if i is not None}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and None not in (rows[a][0], rows[b][0]) and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                comp[y] = x
    return sorted(str((i, len(s), root(i) if i is not None and s else i)) for (i, _), s in zip(rows, sets, strict=True))


def test_near_duplicates_match_sql(spark, sf_dir, duck):
    same(near_dup.op2_multi_index_hamming(spark, sf_dir), duck, near_dup.OP2_SQL)


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_hard_rows(spark, n):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = list(HARD)
    for i in range(60):  # near copies that are often less alike than the threshold
        w = list(base)
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, " ".join(base[:40] + [f"y{i}-{j}" for j in range(100)])) for i in range(40)]  # a passage shared
    rows += [(3000, "A b C"), (3001, "a B c"), (3002, "a b"), (3003, "AB c"), (1003, "one text more for this id, of other words than its first")]
    got = near_dup.near_duplicates(frame(spark, rows), shingle=n).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == brute_components(rows, n)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_no_documents(spark):
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 499), (7, 7)], "u long, v long")
    got = {r["node"]: r["comp"] for r in near_dup.connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(201)} | {499: 499, 500: 499}


def test_pigeonhole_keys_meet_within_the_distance(spark):
    rng = np.random.default_rng(5)
    mask = (1 << near_dup.BITS) - 1

    def packed(slots):
        return [int(np.int64(np.uint64(sum(int(s) << (16 * j) for j, s in enumerate(slots[i : i + 4]))))) for i in range(0, len(slots), 4)]

    rows = []
    for i in range(200):
        a = rng.integers(0, mask + 1, near_dup.SLOTS)
        b, d = a.copy(), i % (near_dup.SLOTS + 1)
        at = rng.choice(near_dup.SLOTS, d, replace=False)
        b[at] = (b[at] + 1 + rng.integers(0, mask, d)) & mask
        rows.append((d, packed(a), packed(b)))
    df = spark.createDataFrame(rows, "d int, a array<long>, b array<long>")
    got = df.selectExpr("d", f"{near_dup.slots_apart('a', 'b')} AS apart", "a", "b").withColumn("ka", near_dup.bucket_keys("a")).withColumn("kb", near_dup.bucket_keys("b")).selectExpr("d", "apart", "arrays_overlap(ka, kb) AS meet").collect()
    assert all(r["apart"] == r["d"] for r in got) and all(r["meet"] for r in got if r["d"] <= near_dup.DISTANCE)


def test_sketches_tell_how_similar_sets_are():
    rng = np.random.default_rng(8)
    for i, share in enumerate([1.0, 0.9, 0.8, 0.8, 0.8, 0.6, 0.5, 0.0] * 3):
        n = 3000 if i % 2 else 90
        common = round(2 * n * share / (1 + share))
        pool = rng.integers(0, 2**64, 2 * n - common, dtype=np.uint64)
        apart = int(near_dup.sketch_apart(near_dup.sketch(np.sort(pool[:n])), near_dup.sketch(np.sort(pool[n - common :]))))
        assert abs(apart - 0.75 * near_dup.SKETCH * (1 - common / (2 * n - common))) < 110
        assert share < 0.8 or apart <= near_dup.SKETCH_DISTANCE
        assert share > 0.6 or apart > near_dup.SKETCH_DISTANCE


def test_cells_make_each_close_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pack = lambda s: np.bitwise_or.reduce(s.astype(np.uint64).reshape(-1, 4) << (np.arange(4, dtype=np.uint64) * np.uint64(16)), axis=1).astype(np.int64)
    base = rng.integers(0, 1 << near_dup.BITS, near_dup.SLOTS)
    slots = [np.where(rng.random(near_dup.SLOTS) < rng.random() * 0.5, rng.integers(0, 1 << near_dup.BITS, near_dup.SLOTS), base) for _ in range(90)]
    sketches = [np.where(rng.random(64) < 0.1, rng.integers(0, 2**62, 64), 5) for _ in slots]
    n, comp = rng.integers(80, 120, len(slots)), rng.integers(0, 60, len(slots))
    rows = [(i, pack(s).tolist(), k, key) for i, s in enumerate(slots) for k, key in [(None, None)]]
    keyed = spark.createDataFrame([(i, s) for i, s, _, _ in rows], "rep long, sig array<long>").selectExpr("*").select("rep", "sig", near_dup.F.posexplode(near_dup.bucket_keys()).alias("k", "key")).collect()
    want = set()
    for a in range(len(slots)):
        for b in range(a):
            if (slots[a] != slots[b]).sum() <= near_dup.DISTANCE and comp[a] != comp[b] and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b]):
                if near_dup.sketch_apart(sketches[a], sketches[b]) <= near_dup.SKETCH_DISTANCE:
                    want.add((a, b))
    for blocks in (1, 4):
        got = []
        cells = {}
        for r in keyed:
            mine = r["rep"] * 7 % blocks
            for other in range(blocks):
                cells.setdefault((r["key"], min(mine, other), max(mine, other)), []).append((mine, r["k"], r["rep"]))
        for (key, i, j), members in cells.items():
            at = [m[2] for m in members]
            cell = {"key": [key], "i": [i], "j": [j], "block": [m[0] for m in members], "k": [m[1] for m in members], "rep": at, "comp": comp[at], "n": n[at]}
            cell = {c: np.array(x) for c, x in cell.items()} | {"sig": np.array([pack(slots[x]) for x in at]), "sketch": np.array([sketches[x] for x in at])}
            u, v = near_dup._pairs_of(cell, 80)
            got += zip(u.tolist(), v.tolist(), strict=True)
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_a_loose_group_makes_few_pairs(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):  # copies of which two are about 0.6 alike: close in signature, seldom in sketch
        w = list(base)
        for _ in range(7):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    scratch = Scratch(spark, "t")
    scratch.drop = lambda *frames: None
    saved = {}
    save = scratch.save
    scratch.save = lambda df, name="t": saved.setdefault(f"{name}-{len(saved)}", save(df, name))
    got = near_dup.near_duplicates(frame(spark, rows), shingle=4, scratch=scratch).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == brute_components(rows, 4)
    rest = next(df for name, df in saved.items() if name.startswith("rest"))
    assert rest.count() == rest.distinct().count() < 0.1 * len(rows) * len(rows) / 2


def test_members_of_buckets_meet_their_sketches_in_one_join(spark):
    scratch, plans = Scratch(spark, "t"), {}
    save = scratch.save
    scratch.save = lambda df, name="t": (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), save(df, name))[1]
    near_dup.near_duplicates(frame(spark, [(1, "a b c d e"), (2, "a b c d f")]), scratch=scratch)
    lines = plans["rest"].splitlines()
    depth = [re.search(r"\w", x).start() for x in lines]
    at = next(i for i, x in enumerate(lines) if "Relation [" in x and "blocks#" in x)
    above, least = [], depth[at]
    for i in range(at, -1, -1):
        if depth[i] < least:
            least = depth[i]
            above.append(lines[i])
    assert sum("Join " in x for x in above) == 2  # what describes them, and the pairs that were tried


def test_confirming_unpacks_few_texts_at_once():
    n = 2 * near_dup.PAIRS + 10
    texts = [b"a b c d e f", b"x y z u v w"]
    batch = pa.RecordBatch.from_pydict({"u": list(range(n)), "v": [0] * n, "tu": [texts[i % 2] for i in range(n)], "tv": [texts[0]] * n})
    got = list(near_dup._confirmed(5, 80)(iter([batch])))
    assert len(got) == 3 and [u for b in got for u in b.column(0).to_pylist()] == list(range(0, n, 2))


def _anonymous_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read")
def test_what_a_task_took_goes_back():
    kept = []

    def grow(batches):
        made = [bytes(1000 + i % 7) for i in range(200_000)]
        kept.extend(made[::500])  # between them, the C library keeps what is freed
        yield from batches

    before = _anonymous_mb()
    assert list(tidy(grow)(iter([1, 2]))) == [1, 2] and len(kept) == 400
    assert _anonymous_mb() - before < 60


def test_workers_are_tidied(spark, monkeypatch):
    """Every function that the stages of the pipeline hand to workers gives its memory back."""
    seen, real = [], type(frame(spark, [])).mapInArrow
    monkeypatch.setattr(type(frame(spark, [])), "mapInArrow", lambda df, f, *a, **k: (seen.append(f.__qualname__), real(df, f, *a, **k))[1])
    docs = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f g"), (3, "z")])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 4)], "doc_id long, quality int, toxic int")
    importance.importance_resample(docs, labels)
    near_dup.near_duplicates(docs)
    bpe.decode_documents(bpe.encode_documents(docs, BYTE), BYTE)
    assert len(seen) >= 8 and set(seen) == {"tidy.<locals>.run"}


def test_no_link_at_the_threshold_is_lost(spark, duck):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame(spark, rows), shingle=4).collect()}
    sets = {i: near_dup.shingle_set((t or "").encode(), 4) for i, t in rows}
    held = {}
    for i, s in sets.items():
        for x in s.tolist():
            held.setdefault(x, []).append(i)
    links = 0
    for i in [i for i in sets if i % 7 == 0]:  # every link of one document in seven, found by its shingles
        shared = {}
        for x in sets[i].tolist():
            for j in held[x]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if j != i and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                links += 1
                assert got[i] == got[j]
    assert links > 5


# byte-pair encoding


def test_encoder_matches_the_library(spark, sf_dir):
    library = Tokenizer.from_file(BYTE)
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()] + HARD + CLASHING
    got = bpe.round_trip(frame(spark, rows), BYTE).collect()

    def want(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        return (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())

    assert sorted(str(tuple(r)) for r in got) == sorted(str(want(i, t)) for i, t in rows)


@pytest.mark.parametrize("seed", range(3))
def test_chunks_and_merges_match_the_library(seed):
    library, rng = Tokenizer.from_file(BYTE), random.Random(seed)
    encoder = bpe.Encoder(bpe.Vocabulary(BYTE), None)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r", "a", "b1", "é", "日", "x.", "\x1c", "\xa0", "'s", "<|endoftext|>", " \n", "\U00010940"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(2000)]
    texts += ["".join(rng.choice("abcdeÀ") for _ in range(n)) for n in (3, 30, 63, 64, 65, 66, 300, 5000)]
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_piece_of_a_megabyte_matches_the_library():
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(1_000_000))
    got = bpe.Encoder(bpe.Vocabulary(BYTE), None).encode(text)
    assert np.frombuffer(got, "<u4").tolist() == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 1 << 15)
    monkeypatch.setattr(bpe, "PART", 400)
    encoder, library = bpe.Encoder(bpe.Vocabulary(BYTE), None), Tokenizer.from_file(BYTE)
    texts = [" ".join(f"w{j % 7} u{i}x{j}" for j in range(20)) for i in range(300)]
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) < 400 and len(encoder.before) < 400


def test_driver_holds_no_vocabulary_while_compiling(spark, monkeypatch):
    """A task compiles the lexicon: what the driver's process would take for it stays with it for all later stages of a pipeline."""
    docs = frame(spark, [(i, t) for i, t in enumerate(["a bb ccc a bb", None, "", "naïve 12 " * 9])])

    def refuse(*_):
        raise AssertionError("in the driver")

    monkeypatch.setattr(bpe.Vocabulary, "__init__", refuse)
    name = bpe.compile_lexicon(docs, BYTE)
    lexicon = bpe.Lexicon(SparkFiles.get(name))
    assert (lexicon.ranks([b" bb", " naïve".encode(), b" 12"]) >= 0).all() and lexicon.ranks([b" zz"])[0] == -1
    assert lexicon.of(lexicon.ranks([b" bb"])[0]) == np.array(Tokenizer.from_file(BYTE).encode(" bb", add_special_tokens=False).ids, "<u4").tobytes()
    empty = bpe.Lexicon(SparkFiles.get(bpe.compile_lexicon(docs.where("false"), BYTE)))
    assert not len(empty.arcs)


def test_texts_walk_in_the_jvm(spark):
    """Workers in Python get only what the walk leaves; ids are the library's either way."""
    library, rng = Tokenizer.from_file(BYTE), random.Random(5)
    plain = [*"abtsdmevrl'  \n\n\t\r.,;-_0189éñßЖя中文한\xa0\u2014²½", " ’", "'ll", "'re", "the ", " andreeser"]
    odd = ["\u3000", "\U00010940", "ॐ", "\x1c", "<|endoftext|>"]
    texts = ["".join(rng.choices(plain, k=rng.randint(0, 60))) for _ in range(1500)] + [c + "a" for c in "'sdm"] + ["x" * n for n in (63, 64, 65, 255, 256)] + ["", " ", "'", "a'", " 's's", "é" * 128]
    left = ["".join(rng.choices(plain + odd, k=40)) for _ in range(300)] + ["x" * n for n in (257, 3000)] + TEXTS
    docs = frame(spark, [*enumerate(texts + left)])
    name = bpe.compile_lexicon(docs, BYTE)
    walked = docs.selectExpr("doc_id", f"{native.function(spark, 'Ids', 'binary')}(CAST(text AS BINARY), '{name}/{name}.rules') AS ids").collect()
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts + left, add_special_tokens=False)]
    assert not [(texts + left)[r["doc_id"]] for r in walked if r["ids"] != want[r["doc_id"]] and (r["doc_id"] < len(texts) or r["ids"] is not None)]
    assert any(r["ids"] is None for r in walked)
    assert {r["doc_id"]: r["ids"] for r in bpe.encode_documents(docs, BYTE, lexicon=name).collect()} == dict(enumerate(want))


def test_most_frequent_pieces(spark):
    rng = random.Random(6)
    rows = [(f"p{i}", rng.choice([1, 1, 1, 2, 3, 50, 51, 10**12 + i])) for i in range(2000)]
    counts = spark.createDataFrame(rows, "piece string, n long")
    for size in (0, 1, 100, 700, 5000):
        got = set(bpe.most_frequent(counts, size))
        least = min((n for p, n in rows if p in got), default=2**60)
        assert len(got) <= size and all((n < least * 1.011) for p, n in rows if p not in got) or size == 5000 and len(got) == 2000


def test_op4(spark, sf_dir):
    assert bpe.op4_transducer_bpe(spark, sf_dir).count() == 200


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    vocabulary = bpe.Vocabulary(BYTE)
    text = "word it's  two   spaces\n\nnew é 123 " * 40
    whole = [p for part in vocabulary.parts(text) for p in part]
    monkeypatch.setattr(bpe, "PART", 17)
    assert [p for part in vocabulary.parts(text) for p in part] == whole and len(list(vocabulary.parts(text))) > 10


def test_transducer_is_minimal_and_exact(tmp_path):
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 8))): [rng.randrange(1000) for _ in range(rng.randrange(1, 4))] for _ in range(800)}
    arrays = bpe.Lexicon.build(words)
    bpe.Lexicon.write(str(tmp_path / "l"), arrays)
    lexicon = bpe.Lexicon(str(tmp_path / "l"))
    ranks = lexicon.ranks(sorted(words))
    assert ranks.tolist() == list(range(len(words)))
    assert all(np.frombuffer(lexicon.of(r), "<u4").tolist() == words[w] for r, w in zip(ranks, sorted(words), strict=True))
    assert set(lexicon.ranks([b"", b"zz", b"abcabcabc" * 9, b"abcd"]).tolist()) == {-1}
    # minimal: as many states as there are different sets of endings
    endings = {}
    for w in words:
        for i in range(len(w) + 1):
            endings.setdefault(w[:i], set()).add(w[i:])
    assert len(arrays["final"]) == len({frozenset(e) for e in endings.values()})
    empty = bpe.Lexicon.build({})
    bpe.Lexicon.write(str(tmp_path / "e"), empty)
    assert bpe.Lexicon(str(tmp_path / "e")).ranks([b"a"]).tolist() == [-1]


# classifier


def test_classifier_parts_held_out_labels(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    good = [(i, " ".join(rng.choices(words, k=60))) for i in range(600)]
    toxic = [(i, " ".join([*rng.choices(words, k=55), "vile", "nasty", "awful"])) for i in range(600, 800)]
    labels = spark.createDataFrame([(i, 1, int(i >= 600)) for i in range(800) if i % 2] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    out = importance.importance_resample(frame(spark, good + toxic + HARD), labels).collect()
    kept = {r["doc_id"] for r in out if r["kept"]}
    held = [i for i, _ in good if i % 2 == 0], [i for i, _ in toxic if i % 2 == 0]
    assert sum(i in kept for i in held[0]) >= 0.98 * len(held[0]) and sum(i in kept for i in held[1]) <= 0.02 * len(held[1])
    assert {1, 2, 3} <= kept and len(out) == 800 + len(HARD)
    again = importance.importance_resample(frame(spark, good + toxic), labels, k=100).collect()
    keys = sorted((r["key"] for r in again), reverse=True)
    assert sum(r["kept"] for r in again) == 100 and min(r["key"] for r in again if r["kept"]) == keys[99]


def test_classifier_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert importance.importance_resample(frame(spark, HARD), labels).where("NOT kept").count() == 0
    assert importance.importance_resample(frame(spark, []), labels).count() == 0


def test_classifier_tells_bad_documents_of_a_small_table(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join([*rng.choices(words, k=40), *(["vile"] if i >= 200 else [])])) for i in range(216)]
    labels = spark.createDataFrame([(i, 1, int(i >= 200)) for i in range(216)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in importance.importance_resample(frame(spark, rows), labels).collect() if r["kept"]}
    assert len([i for i in kept if i < 200]) >= 196 and len([i for i in kept if i >= 200]) <= 2


def test_share_of_targets_keeps_its_digits(spark):
    for raw in (100, 30_000, 10**6, 10**10):
        counts = spark.createDataFrame([(b, raw * (b + 1), 3 * (b + 1)) for b in range(5)] + [(9, raw, 0)], "bucket long, raw long, target long")
        assert abs(importance.median_share(counts) / (3 / raw) - 1) < 1e-3
    assert importance.median_share(counts.where("target = 0")) is None


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 9), 3.0, -1e9]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 999, 3000):
        assert importance.kth_largest(df, "x", k, bins=7) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, "x", 0) is None


# token files


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    kinds = (lambda n: rng.integers(0, 65536, n), lambda n: rng.zipf(1.3, n) % 49408, lambda n: np.tile(rng.integers(0, 49408, 50), n // 50 + 1)[:n], lambda n: np.zeros(n, np.int64))
    blocks = [kinds[i % 4](int(rng.integers(0, 1500))) for i in range(16)] + [np.empty(0, np.int64), np.array([65535])]
    payloads = range_coder.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode_blocks(payloads, [len(b) for b in blocks]), strict=True))
    assert len(payloads[2]) < len(blocks[2]) and all(np.array_equal(range_coder.decode_blocks([p], [len(b)])[0], b) for p, b in zip(payloads[:3], blocks, strict=False))
    assert range_coder.encode_blocks([]) == [] == range_coder.decode_blocks([], [])


def test_token_file_matches_the_library(spark, monkeypatch):
    library = Tokenizer.from_file(WORD)
    rows = [*HARD, *CLASHING, (60, "long words " * 6000), (61, "<|startoftext|># # ##"), (62, "Á ΑΣ Σ")]
    path = Scratch(spark, "t").path("file")
    range_coder.write_token_file(frame(spark, rows), path, WORD)
    got = range_coder.read_token_file(spark, path).collect()
    ordered = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    want, start = [], 0
    for i, t in ordered:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"])))) for r in got)


def test_damaged_block_is_told_and_costs_no_other(spark):
    path, bad = Scratch(spark, "t").path("file"), Scratch(spark, "t").path("bad")
    range_coder.write_token_file(frame(spark, [(i, f"text {i} " * 900) for i in range(12)]), path, WORD)
    blocks = spark.read.parquet(path)
    blocks.selectExpr("shard", "block", "first", "n", "if(shard = 0 and block = 0, checksum + 1, checksum) AS checksum", "segments", "payload").write.parquet(bad)
    with pytest.raises(Exception, match="DamagedBlock"):
        range_coder.read_token_file(spark, bad).count()


def test_empty_token_file(spark):
    path = Scratch(spark, "t").path("file")
    range_coder.write_token_file(frame(spark, []), path, WORD)
    assert range_coder.read_token_file(spark, path).count() == 0


def test_op8(spark, sf_dir):
    got = range_coder.op8_context_mixing(spark, sf_dir).orderBy("doc_id").collect()
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))] and len(got) == 200


def test_coder_writes_the_same_bytes(spark):
    rng = np.random.default_rng(2)
    blocks = [b[:n] for b, n in ((rng.zipf(1.3, 4096) % 49408, 4096), (rng.integers(0, 65536, 3000), 2500), (np.tile(rng.integers(0, 49408, 40), 100), 4000), (np.full(4096, 65535), 4096), (np.zeros(1025, np.int64), 1025), (np.array([2]), 1))]
    coder = native.function(spark, "Coder", "binary")
    df = spark.createDataFrame([(i, b.astype("<u2").tobytes(), len(b)) for i, b in enumerate(blocks)], "i int, ids binary, n long").selectExpr("i", "n", f"{coder}(ids, -1L) AS payload").selectExpr("i", "payload", f"{coder}(payload, n) AS ids")
    got = df.orderBy("i").collect()
    assert [bytes(r["payload"]) for r in got] == range_coder.encode_blocks(blocks)
    assert [bytes(r["ids"]) for r in got] == [b.astype("<u4").tobytes() for b in blocks]


def test_words_walk_in_the_jvm(spark):
    library, encoder = Tokenizer.from_file(WORD), range_coder.WordEncoder(WORD)
    plain = ["It's THE ÉTÉ Œuvre don't 'RE!'s we'Ll 3.14 x²", "naïve — “ok”… ¿qué? 5€ ŸŉĿ", "a" * 256 + " " + "é" * 128, "'", "''s 's's'd", "tab\tline\nreturn\r end ", "", " "]
    left = ["İ", "é a", "<|endoftext|>x", "a" * 257, "é" * 129, "x\x0by", "日本 語", "Σ ΑΣ", "\U00010940", "a b ×", "\x00 \x7f"]
    rng = random.Random(3)
    mixed = ["".join(rng.choice("aBé'Ésßt .,-|<>7\n\t–’ re ll İ日") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    rules = native.hand_out(spark, "words", range_coder.word_rules(WORD))
    walk = native.function(spark, "Words", "binary")
    texts = [*plain, *left, *mixed]
    got = [bytes(r[0]) for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i").selectExpr(f"{walk}(CAST(text AS BINARY), '{rules}')").collect()]
    assert [ids.tolist() for ids in encoder.complete(got)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    whole = [len(g) == 4 + 2 * int.from_bytes(g[:4], "little") for g in got]
    assert sum(whole[: len(plain)]) == len(plain) - 1 and not whole[0] and not any(whole[len(plain) : len(plain) + len(left)])


def test_op8_runs_no_model_in_workers(spark):
    path = Scratch(spark, "t").path("file")
    range_coder.write_token_file(frame(spark, [(1, "one"), (2, "two"), (3, "long " * 9000)]), path, WORD)
    plan = range_coder.read_token_file(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "tierstone_coder" in plan


def test_driver_gives_native_memory_back(spark, monkeypatch):
    from tierstone.llm import common

    assert common.give_back_driver(spark)
    saved, own = [], common.give_back_driver
    monkeypatch.setattr(common, "give_back_driver", lambda s: saved.append(own(s)))
    assert Scratch(spark, "t").save(spark.range(3)).count() == 3 and saved == [True]
