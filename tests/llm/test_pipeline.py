"""The pipeline, stage by stage, against brute force on a small folder of tables; and the registered queries."""

import hashlib

import __spark_entry__
import corpus_pipeline
from corpuslens.llm import queries

from .test_text_operators import brute_components, brute_substrings, words


def test_stages_against_brute_force(spark, docs, tmp_path):
    folder = str(tmp_path)
    docs.select(*corpus_pipeline.COLUMNS).where("doc_id IS NOT NULL").write.parquet(f"{folder}/documents.parquet")
    toxic = {i: int(i % 7 == 0) for i in range(40)}
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    before = [(r.doc_id, r.text) for r in at.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "mixing", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, folder).write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        rows = at.collect()
        if name == "byte_bpe":
            got = sorted((r.doc_id, r.text_sha256, r.n_tokens * 4 == len(r.tokens)) for r in rows)
            assert got == sorted((d, hashlib.sha256((t or "").encode()).hexdigest(), True) for d, t in before)
            continue
        assert at.columns == corpus_pipeline.COLUMNS
        after = [(r.doc_id, r.text) for r in rows]
        if name == "toxicity":
            assert set(after) <= set(before) and len(after) > len(before) / 2
        elif name == "near_duplicates":
            keep = {d for d, _, c in brute_components(before, 5, 80) if d == c}
            assert sorted(d for d, _ in after) == sorted(d for d, _ in before if d in keep)
        elif name == "substring_dedup":
            whole = dict(before)
            want = {d: (whole[d] if gone == 0 else text) for d, n, gone, text in brute_substrings(before, 20) if gone == 0 or gone < n}
            assert dict(after) == want
        elif name == "mixing":
            assert set(after) == {r for r in before if words(r[1]) and r in after} and max(after.count(r) for r in after) <= 2
        before = after
    assert before


def test_one_of_alike_whatever_its_id(spark):
    text = lambda key, n=40: " ".join(f"{key}{i}" for i in range(n))
    near = lambda key: text(key) + " tail"
    rows = [(5, text("a")), (None, near("a")), (None, text("b")), (None, text("c")), (None, near("c")), (None, text("d")), (None, text("d"))]
    rows += [(6, text("e")), (6, text("f")), (7, near("f")), (8, text("g")), (8, text("g")), (9, text("h")), (3, near("h")), (None, text("a"))]
    rows += [(None, None), (None, None), (10, " "), (10, " "), (11, "")]
    docs = spark.createDataFrame([(d, t, "en", f"s{i}", 1) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_alike(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    c = [r for r in got if r[1] and r[1].startswith("c0 ")]
    assert len(c) == 1 and c[0][0] is None
    want = [(5, text("a")), (None, text("b")), c[0], (None, text("d")), (6, text("e")), (6, text("f")), (8, text("g")), (3, near("h"))] + rows[-5:]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_repeats_go_row_by_row(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    texts = [(1, f"a  b {passage}"), (2, f"c {passage} d"), (2, f"c {passage} d"), (3, "one  text"), (3, f"other {passage}"), (None, f"null {passage}"), (None, "no  id"), (None, None), (None, None)]
    texts += [(None, f"{' '.join(f'n{i}x{j}' for j in range(25))}  {i}") for i in range(600)]  # of 16 bits some would be equal
    rows = [(d, t, f"l{i}", "s", 7) for i, (d, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.lang, r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.drop_repeats(spark, docs, "").collect())
    less = {1: "c d", 2: "c d", 4: "other", 5: "null"}
    assert got == sorted((r[2], r[0], less.get(i, r[1]), len(less[i]) if i in less else 7) for i, r in enumerate(rows))


def test_all_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names
