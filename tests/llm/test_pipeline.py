"""Each stage of the pipeline on its own input, against plain Python."""

import corpus_pipeline
from conftest import DATA
from frailscope.llm import quality_classifier
from test_native import brute_lines
from test_texts import folded_words


def near_copies(rows):
    """The ids that are not the smallest of their component."""
    sets = {}
    for i, text in rows:
        words = folded_words(text)
        if words:
            sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    index, component = {}, {i: i for i in sets}
    for i, own in sorted(sets.items()):
        for j in {j for gram in own for j in index.get(gram, ())}:
            if 100 * len(own & sets[j]) >= 75 * len(own | sets[j]):
                old, new = max(component[i], component[j]), min(component[i], component[j])
                component = {k: new if c == old else c for k, c in component.items()}
        for gram in own:
            index.setdefault(gram, []).append(i)
    return {i for i, c in component.items() if i != c}


def test_stages(spark, tmp_path):
    sf_dir = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = [" ".join(folded_words(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_dedup", "decontaminate", "encode"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        found = stage(spark, docs, sf_dir)
        found.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "encode":
            rows = after.collect()
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in before)
            assert all(r["round_trip"] for r in rows)
            return
        assert after.columns == docs.columns
        kept = {r["doc_id"]: r["text"] for r in after.select("doc_id", "text").collect()}
        if name == "quality":
            model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            scored = quality_classifier.score(docs, model).filter("predicted = 1").collect()
            assert set(kept) == {r["doc_id"] for r in scored}
        elif name == "lines":
            expected = brute_lines(before)
            assert kept == {i: t for i, t in expected.items() if folded_words(t) or not folded_words(dict(before)[i])}
        elif name == "near_dedup":
            assert set(kept) == {i for i, _ in before} - near_copies(before)
        else:
            leaks = {i for i, t in before if any(f" {b} " in f" {' '.join(folded_words(t))} " for b in benchmark)}
            assert leaks.isdisjoint(kept) and len(leaks) + len(kept) >= len(before) - 2
        docs = after
