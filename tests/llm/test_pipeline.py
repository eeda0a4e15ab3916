import corpus_pipeline
from tests.llm.test_free_operators import brute_components
from tests.llm.test_native_operators import brute_base, brute_contamination, frame
from tierstone.llm import registry
from tierstone.llm.common import Scratch, table


def test_stages_match_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept, scratch = docs, Scratch(spark, "t")
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = scratch.save(stage(spark, kept, sf_dir))
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert kept.columns == docs.columns and set(after) <= set(before)
        if name == "near duplicates":
            rows = sorted(before.items())
            components = brute_components(rows, 5)
            assert set(after) == {i for i, t in rows if any(c.startswith(f"({i}, ") and c.endswith(f", {i})") for c in components)}
        if name == "decontamination":
            judged = {i: brute_contamination(t, items) for i, t in before.items()}
            assert set(after) == {i for i, (n, hit, _) in judged.items() if not (hit > 0 and 20 * hit >= n)}
        if name == "secret scans":
            assert set(after) == set(before)
            assert all((t == before[i]) if not brute_base(before[i]) else ("<SECRET>" in t and not brute_base(t)) for i, t in after.items())
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and {r["doc_id"] for r in final.collect()} == set(after)


def test_hard_rows_pass_through(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (4, "a b c"), (4, "a b c"), (None, "no id"), (5, "x" * 50000)]
    docs = frame(spark, rows)
    once = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(str(r["doc_id"]) for r in once.collect()) == ["1", "2", "3", "5", "None"] and once.columns == docs.columns


def test_examples_of_many_repositories_stay(spark):
    shared, own = "Abcdefghij0123456789xyz", "Zyxwvutsrq9876543210abc"
    rows = [(i, f"key {shared} {own if i == 1 else ''}", f"s{i % 2}", f"l{i}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = corpus_pipeline.secret_scan(spark, docs, "")
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert got.columns == docs.columns and all(shared in t for t in texts.values())
    assert texts[1] == f"key {shared} <SECRET>"


def test_registry():
    queries = registry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries} - {"pipeline"} and "pipeline" in queries
    assert set(registry.oracle_sql()) < set(queries) and [n for n, _ in corpus_pipeline.STAGES]
