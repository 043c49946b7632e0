"""Operators on hand-made rows."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.config import Config, load_config
from corpuslens.functions import labels as L
from corpuslens.functions import text as X
from corpuslens.operators import analysis, clustering, cooccurrence, crosstabs, entities, neighbours, ngrams, outliers, tfidf, topics, vectors
from corpuslens.plans.pipeline import Pipeline, Step
from corpuslens.sources import files

#: Pairs of entities of a published graph of co-occurrences: (texts in common, texts of each, PMI to two decimals).
GOLDEN = [(56, 454, 201, 5.07), (50, 56, 54, 9.82), (33, 53, 288, 6.88), (17, 584, 68, 4.55), (16, 373, 375, 2.64), (8, 13, 11, 11.58), (6, 77, 18, 7.89), (14, 584, 375, 1.8)]


def value(spark, column, **cells):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column).first()[0]


def test_text_scalars(spark):
    t = F.col("t")
    assert value(spark, X.count_tokens(t), t="  la  playa ") == 2
    assert value(spark, X.count_characters(t), t="  la  playa ") == 7
    assert value(spark, X.average_token_length(t), t="  la  playa ") == 3.5
    assert [value(spark, f(t), t=None) for f in (X.count_tokens, X.count_characters, X.average_token_length)] == [0, 0, 0.0]
    assert value(spark, X.remove_light_noise(t), t="a <> b :> c") == "a  b  c"
    assert value(spark, X.remove_noise(t), t="<b>¡Sí!</b> 5/5, ok.") == "Sí 55, ok."
    assert value(spark, X.sanitize(t), t=None) == "."
    assert value(spark, X.sanitize(t), t="a\tb\x00\nc") == "a b c"
    assert value(spark, X.stopword_vote(t, F.lit("en")), t="la") == "mixed"
    assert value(spark, X.stopword_vote(t, F.lit("en")), t="xyz") == "en"
    assert value(spark, X.ascii_fold(t), t=" Ñandú  Ößel ") == "nandu ossel"
    assert value(spark, X.clean_topic_name(t), t="3_playa_entrada_ARENA_mar_sol_luz") == "Playa Arena Mar Sol"
    assert value(spark, X.parameter(t, "k"), t="kmeans|k=9") == "9"


def test_language_decision(spark):
    p = F.create_map(F.lit("es"), F.lit(0.9), F.lit("en"), F.lit(0.1))
    assert value(spark, X.decide_language(p, F.lit(40), F.col("t")), t="xyz") == "es"
    assert value(spark, X.decide_language(p, F.lit(3), F.col("t")), t="xyz") == "mixed"
    assert value(spark, X.decide_language(F.lit(None).cast("map<string,double>"), F.lit(3), F.col("t")), t="xyz") == "unknown"


def test_labels(spark):
    s = F.col("s")
    stars = [(2.5, "positivo", "positivo", 1), (3.0, "neutro", "negativo", 0), (2.0, "negativo", "negativo", -1), (None, "sin_etiqueta", "sin_etiqueta", None)]
    df = spark.createDataFrame([(x[0],) for x in stars], "s double").select("s", L.star_category(s), L.star_binary(s), L.star_number(s))
    assert [tuple(r) for r in df.collect()] == stars
    assert [value(spark, L.normalize_label(F.col("t")), t=x) for x in ("LABEL_1", "XYZ", "POS", "neg")] == ["neutro", "neutro", "positivo", "negativo"]


def test_ngrams_and_idf(spark):
    df = spark.createDataFrame([("el mar y la playa",), (None,), ("",), ("mar",)], "t string")
    assert {r.ngram for r in ngrams.ngram_counts(df, "t", 2).collect()} == {"el mar", "mar la", "la playa"}
    ranked = ngrams.rank_ngrams(df, "t", 1).collect()
    assert sum(r.relative_frequency for r in ranked) == pytest.approx(1)
    assert spark.range(1).select(tfidf.smooth_idf(F.lit(3), F.lit(3))).first()[0] == 1.0


def test_ngrams_travel_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["mar", "sol", "ñu", "a", "\U0001f30a\U0001f30a", "x\0y", "m\u00a0m", '"q"'], rng.integers(0, 12))) for _ in range(150)] + [None, "", "mar", " mar\tsol ", "uno dos tres"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    lists = [[w for w in re.split(r"[ \t]+", t or "") if len(w) >= 2] for t in texts]
    for n in (1, 2, 3, 4):
        want = {}
        for w in lists:
            for i in range(len(w) - n + 1):
                want[" ".join(w[i : i + n])] = want.get(" ".join(w[i : i + n]), 0) + 1
        for words, cells in ((4_000_000, 512), (9, 2)):
            monkeypatch.setattr(ngrams, "WORDS", words)
            monkeypatch.setattr(ngrams, "CELLS", cells)
            out = ngrams.rank_ngrams(df, "t", n)
            assert {(r.ngram, r.total_frequency): r.relative_frequency for r in out.collect()} == {(k, c): c / sum(want.values()) for k, c in want.items()}
        if n in (2, 3):
            assert "hashpartitioning(cell" in plan_of(out) and "hashpartitioning(ngram" not in plan_of(out)
    few, counts = ngrams._counted([np.array([3, 0, 3]), np.array([1, 1, 1])], np.array([1, 2, 3]), 1 << 40)
    assert [f.tolist() for f in few] == [[0, 3], [1, 1]] and counts.tolist() == [2, 4]
    assert ngrams.ngram_counts(df.limit(0), "t", 3).count() == 0


def test_cluster_keywords(spark):
    df = spark.createDataFrame([(1, 0, "sol mar sol"), (2, 0, ""), (3, 1, "rio mar"), (4, -1, "sol sol sol")], "id long, c int, t string")
    rows = {(r.cluster, r.term): (r["rank"], r.score, r.df, r.n_docs) for r in tfidf.cluster_keywords(df, "id", "c", "t", min_frequency=1).collect()}
    assert rows[0, "sol"] == (1, pytest.approx(2 / 3 * (math.log(3 / 2) + 1) / 2), 1, 2)
    assert all(c != -1 for c, _ in rows)


def test_cluster_keywords_without_rows_of_single_texts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [(i, [-1, 1, 2][i % 3], " ".join(rng.choice([f"w{j}" for j in range(200)], rng.integers(0, 20)))) for i in range(80)] + [(90, 1, None), (91, 1, "a\u00a0b\tsolo  x"), (92, 2, "only")]
    df = spark.createDataFrame(texts, "id long, c int, t string").repartition(3)
    for least in (1, 2, 4):
        whole = tfidf.cluster_keywords(df, "id", "c", "t", vocabulary=ngrams.corpus_vocabulary(df, "t", least))
        for terms in (300_000, 10):
            monkeypatch.setattr(tfidf, "TERMS", terms)
            out = tfidf.cluster_keywords(df, "id", "c", "t", min_frequency=least)
            near = lambda rows: {(r.cluster, r["rank"], r.term, round(r.score, 9), r.df, r.n_docs) for r in rows.collect()}
            assert near(out) == near(whole)
    assert "Window [sum" not in plan_of(out)


def test_top_tfidf_terms_without_rows_of_texts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"w{j}" for j in rng.zipf(1.5, rng.integers(0, 30)) if j < 40)) for i in range(150)] + [(200, None), (201, ""), (202, "W1, w1; W2_x a"), (203, "w1")]
    for rows in (texts, [*texts, (203, "w2 w3")], [(i, f"x{i // 2} y{i // 2}") for i in range(30)]):
        df = spark.createDataFrame(rows, "id long, t string").repartition(3)
        whole = tfidf.corpus_tfidf(df, "id", "t").groupBy("term").agg(F.sum("tfidf").alias("score")).collect()
        want = [(-round(r.score, 9), r.term) for r in whole]
        for known, heads, piece in ((2_000_000, 50_000, 500_000), (20, 2, 7), (60, 0, 1)):
            for k, v in (("KNOWN", known), ("HEADS", heads), ("PIECE", piece), ("HASHES", piece)):
                monkeypatch.setattr(tfidf, k, v)
            out = tfidf.top_tfidf_terms(df, "id", "t")
            assert [(-round(r.score, 9), r.term) for r in out.collect()] == sorted(want)[:10]


def test_golden_pmi(spark):
    n = 54618
    df = spark.createDataFrame(GOLDEN, "c long, a long, b long, want double").withColumn("got", F.round(F.round(cooccurrence.pmi(F.col("c"), F.col("a"), F.col("b"), F.lit(n)), 4), 2))
    assert all(r.got == r.want for r in df.collect())


def test_term_pairs_are_counted_by_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i:02}" for i in range(30)]
    texts = [(i, [-1, 1, 2][i % 3], [*rng.choice(words, rng.integers(0, 14))]) for i in range(90)]
    df = spark.createDataFrame(texts, "id long, topic long, w array<string>").repartition(3)
    vocabulary = spark.createDataFrame([(w,) for w in words[:20]], "ngram string")
    n, one = {}, {}
    for _, topic, ws in texts:
        known = sorted({*ws} & {*words[:20]})
        for i, a in enumerate(known):
            one[topic, a] = one.get((topic, a), 0) + 1
            for b in known[i + 1 :]:
                n[topic, a, b] = n.get((topic, a, b), 0) + 1
    want = {(k, c, one[k[0], k[1]], one[k[0], k[2]]) for k, c in n.items() if c >= 3 and k[0] != -1}
    for texts_, tile in ((2048, 1024), (7, 6)):
        monkeypatch.setattr(cooccurrence, "TEXTS", texts_)
        monkeypatch.setattr(cooccurrence, "TILE", tile)
        out = cooccurrence.term_cooccurrence(df, "id", "topic", F.col("w"), vocabulary)
        assert {((r.topic, r.a, r.b), r.n, r.df_a, r.df_b) for r in out.collect()} == want
    assert "Generate" not in plan_of(out)  # no row for a pair of a text


def test_components_and_degrees(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("b", "c", 1), ("d", "e", 2)], "a string, b string, n long")
    assert dict(cooccurrence.component_labels(edges).collect()) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    rows = {r.component: (r.n_nodes, r.central, r.top_nodes) for r in cooccurrence.communities(edges).collect()}
    assert rows == {"a": (3, "b", ["b", "a", "c"]), "d": (2, "e", ["d", "e"])}


def test_entities(spark):
    df = spark.createDataFrame([(1, [("Riviera Maya", "LOC"), ("ab", "LOC"), ("Ana", "PER")]), (2, [("riviera  maya", "GPE")]), (3, [])], "id long, entities array<struct<text:string,label:string>>")
    found = entities.mentions(df, "id")
    assert {(r.id, r.entity, r.label) for r in found.collect()} == {(1, "riviera maya", "LOC"), (2, "riviera maya", "GPE")}
    groups = spark.createDataFrame([("riviera maya", 9), ("riviera mayan", 4), ("rivera maya", 2), ("cancun", 5)], "entity string, mentions long")
    assert dict(entities.merge_similar(groups).collect()) == {"riviera maya": "riviera maya", "riviera mayan": "riviera maya", "rivera maya": "riviera maya", "cancun": "cancun"}
    assert entities.indel_ratio("riviera maya", "riviera mayan") == pytest.approx(96.0)


def test_rare_spellings_are_merged(spark, tmp_path):
    from corpuslens.plans.queries import QUERIES

    names = ["Guanajuato"] * 25 + ["Guanajuatoo", "Guanajuat", "Riviera", "Rivieraa", "Cancun"] + ["Palenque"] * 3 + ["Palenqque"] * 2
    spark.createDataFrame([(i, f"{n} 1") for i, n in enumerate(names)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kinds = sorted({n.lower() for n in names}, key=lambda e: (-sum(n.lower() == e for n in names), e))
    want = {}
    for i, a in enumerate(kinds):
        if a not in want:
            want |= {b: a for b in kinds[i:] if b not in want and (a == b or entities.indel_ratio(a, b) >= 90)}
    assert dict(QUERIES["fuzzy_entity_merge"](spark, str(tmp_path)).collect()) == want
    rng = np.random.default_rng(8)  # all lengths, with letters lost, added and changed
    for ratio in (90.0, 80.0):
        names = ["".join(rng.choice(list("abcde "), rng.integers(1, 34))) for _ in range(60)]
        for n in list(names):
            at = rng.integers(0, len(n), 4)
            names += [n[: at[0]] + n[at[0] + 1 :], n[: at[1]] + "a" + n[at[1] :], n[: at[2]] + "e" + n[at[2] + 1 :], (n[: at[3]] + n[at[3] + 2 :])]
        names = sorted({n for n in names if n})
        groups = spark.createDataFrame([(n, 3) for n in names], "entity string, mentions long")
        brute = {}
        for i, a in enumerate(names):
            if a not in brute:
                brute |= {b: a for b in names[i:] if b not in brute and (a == b or entities.indel_ratio(a, b) >= ratio)}
        assert dict(entities.merge_similar(groups, ratio).collect()) == brute
    assert want["guanajuat"] == "guanajuato" and want["palenqque"] == "palenque"


def test_similar_names_meet_by_length_alone_and_settle_at_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    names = {"".join(rng.choice(list("abcdefghij"), n)) for n in (4, 8, 9, 10, 11, 12, 16, 17, 18, 19, 20, 24, 33, 47, 90) for _ in range(4)}
    for n in list(names):
        for k in (1, 1, 2, 2, 3, 4):
            new = list(n)
            for at in rng.integers(0, len(new), k):
                new[at : at + 1] = [[], ["a", "b"], ["z"]][rng.integers(0, 3)]
            names.add("".join(new))
    groups = [(n, int(rng.integers(1, 4))) for n in sorted(names - {""})]
    df = spark.createDataFrame(groups, "entity string, mentions long")
    for ratio in (90.0, 85.0, 100.0):
        want = {}
        kinds = [n for n, m in sorted(groups, key=lambda g: (-g[1], g[0]))]
        for i, a in enumerate(kinds):
            if a not in want:
                want |= {b: a for b in kinds[i:] if b not in want and entities.indel_ratio(a, b) >= ratio}
        for settled in (9, 1_000_000):
            monkeypatch.setattr(entities, "SETTLED", settled)
            out = entities.merge_similar(df, ratio)
            assert dict(out.collect()) == want
    assert plan_of(out).count("Join") <= 4  # no join of long names on pairs of letters, no state of rounds
    rows = [[0] * 13 for _ in range(14)]
    for i, x in enumerate("riviera mayan"):
        for j, y in enumerate("rivera mayaz"):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    assert entities.indel_ratio("riviera mayan", "rivera mayaz") == 200 * rows[-1][-1] / 25


def test_phrases_of_entities_without_a_row_a_pair(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    texts = [([f"e{k}" for k in range(9) if rng.random() < 0.8 ** (k + 1)], [words[int(j)] for j in rng.zipf(1.3, rng.integers(0, 30)) if j < 60]) for _ in range(200)]
    texts += [(["e1", "e1", "lone"], ["twice", "twice", "w1"]), (["bare"], []), (["bare"], None), ([], ["w1"]), (None, ["w1"])]
    pairs, docs = {}, {}
    for own, phrases in texts:
        for e in set(own or []):
            docs[e] = docs.get(e, 0) + 1
            for w in set(phrases or []):
                pairs[e, w] = pairs.get((e, w), 0) + 1
    df = spark.createDataFrame(texts, "entities array<string>, phrases array<string>").repartition(3)
    for least, head, known, sure, held in ((1, 128, 200_000, 4, 50_000), (2, 3, 7, 1, 1), (20, 0, 0, 2, 50_000), (300, 1, 1, 1, 1)):
        for k, v in (("HEAD", head), ("KNOWN", known), ("SURE", sure), ("HELD", held)):
            monkeypatch.setattr(entities, k, v)
        want = set()
        for e in docs:
            if docs[e] >= least:
                own = sorted((-n, w) for (x, w), n in pairs.items() if x == e)
                want |= {(e, r + 1, w, -n) for r, (n, w) in enumerate(own[:5])}
        out = entities.entity_phrases(df, min_docs=least)
        assert {tuple(r) for r in out.collect()} == want
        assert "explode(p" not in plan_of(out)  # no row for an entity and a phrase of a text


def test_specificity_and_polarization(spark):
    rows = [(i, "A" if i < 3 else "B", 1 if i < 4 else 2, 5.0 if i % 2 else 1.0) for i in range(10)]
    df = spark.createDataFrame([*rows, (99, "A", -1, None)], "id long, location string, topic int, stars double")
    got = {(r.location, r.topic): r for r in crosstabs.topic_place_distribution(df).collect()}
    assert got["A", 1].pct_of_topic == 75 and got["A", 1].specificity == pytest.approx(1.875)
    profile = {r.topic: r for r in crosstabs.topic_sentiment_profile(df).collect()}
    assert profile[1].polarization == pytest.approx(0.25)
    assert crosstabs.topic_sentiment_profile(df.withColumn("stars", F.lit(None).cast("double"))).first().polarization is None


def test_elbow_silhouette_linkage():
    assert clustering.elbow([2, 3, 4, 5, 6], [100, 60, 30, 28, 27]) == 4
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2)), rng.normal((0, 9), 0.1, (20, 2))])
    truth = np.repeat([0, 1, 2], 20)
    for method in ("ward", "complete", "average", "single"):
        assert (clustering.cut_tree(clustering.linkage(x, method), 60, 3) == truth).all()
    labels = clustering.hdbscan(x, 5, 3)
    assert len(set(labels[labels >= 0])) == 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(60):
        own = d[i][(truth == truth[i]) & (np.arange(60) != i)].mean()
        other = min(d[i][truth == k].mean() for k in range(3) if k != truth[i])
        want.append((other - own) / max(own, other))
    assert clustering.silhouette(x, truth) == pytest.approx(np.mean(want))
    assert clustering.hdbscan_score(x, np.array([0] * 55 + [1] * 5)) == 0.0


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (150, 6)), rng.normal(8, 1, (50, 6)), [[40.0] * 6]])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def test_lof_is_the_definition(blobs):
    x, df = blobs
    k = 20
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    at = np.argsort(d, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(d, at, axis=1)
    lrd = 1 / (np.maximum(near, near[:, -1][at]).mean(axis=1) + 1e-10)
    want = lrd[at].mean(axis=1) / lrd
    got = {r.id: r.score for r in outliers.local_outlier_factor(df, "id", "v", k).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(want.tolist(), rel=1e-6)


def test_lof_of_many_rows_takes_all_as_neighbours(spark):
    rng = np.random.default_rng(5)  # groups of near copies larger than k: thinned to a third by a sample of 20,000
    x = np.concatenate([rng.normal(0, 1, (20_900, 4)), *[c + rng.normal(0, 1e-4, (24, 4)) for c in rng.normal(0, 1, (50, 4))]])
    df = spark.createDataFrame(pa.table({"id": range(len(x)), "v": x.tolist()}))
    got = {r.id: r.score for r in outliers.local_outlier_factor(df, "id", "v", 20).where("id >= 20900").collect()}
    for g in range(50):  # a copy's neighbours are copies: the group alone gives its scores
        own = x[20_900 + 24 * g : 20_924 + 24 * g]
        d = np.sqrt(((own[:, None] - own[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        at = np.argsort(d, axis=1)[:, :20]
        near = np.take_along_axis(d, at, axis=1)
        density = 1 / (np.maximum(near, near[:, -1][at]).mean(axis=1) + 1e-10)
        want = density[at].mean(axis=1) / density
        assert [got[20_900 + 24 * g + i] for i in range(24)] == pytest.approx(want.tolist(), rel=1e-5)


def test_hdbscan_of_many_rows(spark):
    rng = np.random.default_rng(6)  # two dense blobs, small ones, and noise that no cluster may take
    x = np.concatenate([rng.normal(0, 0.1, (800, 3)), rng.normal(5, 0.1, (800, 3)), *[rng.uniform(-20, -5, 3) + rng.normal(0, 0.02, (14, 3)) for _ in range(20)], rng.uniform(-30, 30, (120, 3))])
    df = spark.createDataFrame(pa.table({"id": range(len(x)), "v": x.tolist()})).repartition(3)
    got = {r.id: r.label for r in clustering.hdbscan_rows(df, "id", "v", 10, 5).collect()}
    want = clustering.hdbscan(x, 10, 5)
    groups = lambda labels: {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist()) - {-1}}
    found = np.array([got[i] for i in range(len(x))])
    assert groups(found) == groups(want) and len(groups(found)) >= 22 and (found[2 * 800 + 280 :] < 0).sum() > 60
    ranking, best = clustering.hdbscan_grid(df, "id", "v", (10,), (5,))
    assert ranking.first().n_noise == (want < 0).sum() and [b.where("label < 0").count() for b in best.values()] == [(want < 0).sum()]
    assert {r.label for r in clustering.hdbscan_rows(df.limit(1), "id", "v", 10, 5).collect()} == {-1}
    assert clustering.hdbscan_rows(df.limit(0), "id", "v", 10, 5).count() == 0


def test_spanning_tree_is_least(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, (300, 5)), rng.normal(9, 0.01, (200, 5)), np.zeros((30, 5))])
    rows = neighbours.Rows(spark.createDataFrame(pa.table({"id": range(len(x)), "v": x.tolist()})), "id", "v")
    r = {row.id: row.r for row in rows.table.collect()}
    x = x[np.argsort([r[i] for i in range(len(x))])]
    dist, near = neighbours.lists_of(rows, 6)
    w, a, b = neighbours.spanning_tree(rows, dist, near, 5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, 5]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    assert w == pytest.approx(reach[a, b], rel=1e-6, abs=1e-6)
    inside, far = np.zeros(len(x), bool), np.full(len(x), np.inf)
    at, want = 0, []
    for _ in range(len(x) - 1):
        inside[at] = True
        far = np.minimum(far, reach[at])
        at = int(np.where(inside, np.inf, far).argmin())
        want.append(far[at])
    assert sorted(w.tolist()) == pytest.approx(sorted(want), rel=1e-6, abs=1e-6)


def test_outlier_votes(blobs):
    _, df = blobs
    rows = {r.id: r for r in outliers.outlier_votes(df, "id", "v").collect()}
    assert rows[200].is_outlier == 1
    assert all(0 <= r.votes <= 3 for r in rows.values())
    assert outliers.outlier_summary(outliers.outlier_votes(df, "id", "v")).first().n_docs == 201


def test_vectors(spark, blobs):
    x, df = blobs
    z = {r.id: r.vec for r in vectors.standardize(df, "id", "v").collect()}
    want = (x - x.mean(axis=0)) / x.std(axis=0)
    assert z[7] == pytest.approx(want[7].tolist())
    p = vectors.svd(df, "id", "v", 2).where("id = 3").first().vec
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    assert np.abs(p) == pytest.approx(np.abs(axes[:2] @ x[3]).tolist())
    few = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    assert [r.similarity for r in vectors.concept_search(few, "id", "v", [1.0, 0.0]).collect()] == [1.0, 0.0]
    assert all(abs(sum(c * c for c in r.vec) - 1) < 1e-9 for r in vectors.hashed_embedding(spark.createDataFrame([(1, "sol y mar")], "id long, t string"), "id", "t").collect())


def test_topics(spark, blobs):
    _, df = blobs
    rows = df.withColumn("t", F.when(F.col("id") < 150, "playa sol mar").otherwise("museo arte sala")).withColumn("label", F.lit("positivo"))
    method, info, labelled = topics.topics_by_sentiment(rows, "id", "t", "v", "label", "positivo", topics=3, method="kmeans")
    assert method == "kmeans" and labelled.count() == 201
    assert {w for r in info.collect() for w in r.keywords} <= {"playa", "sol", "mar", "museo", "arte", "sala"}
    method, words, none = topics.topics_by_sentiment(rows.limit(10), "id", "t", "v", "label", "positivo")
    assert method == "frequency" and none is None and words.count() > 0
    micro = topics.microtopics(rows.select("id", "v", F.lit("x").alias("location"), F.lit(1).cast("long").alias("topic")), "id", "v")
    assert micro.count() == 201


def test_analysis(spark):
    df = spark.createDataFrame([(1, "Ayer fuimos a Playa Norte y comimos muy bien.", "es"), (2, None, "es"), (3, "", "en")], "id long, t string, lang string")
    rows = {r.id: r for r in analysis.linguistic_analysis(df, "id", "t", "lang").collect()}
    assert [e.text for e in rows[1].entities] == ["Playa Norte"] and rows[2].entities is None and rows[3].entity_density == 0.0

    class Broken:
        def classify(self, texts):
            if len(texts) > 1 or "bien" in texts[0]:
                raise RuntimeError("no")
            return [("POS", 0.9)]

    got = {r.id: (r.label, r.confidence) for r in analysis.model_sentiment(df, "id", "t", Broken).collect()}
    assert got == {1: ("neutro", 0.0), 2: ("positivo", 0.9), 3: ("positivo", 0.9)}
    translated = analysis.translate_where(df, "t", "lang", ("es",), lambda: analysis.DictionaryTranslator({"playa": "beach"}))
    assert "beach" in {r.id: r.t for r in translated.collect()}[1]
    keywords = analysis.keyword_candidates("The coral reef is near. The coral reef shines. Boats pass.")
    assert "coral reef" in [k for k, _ in keywords]
    train = spark.createDataFrame([("el mar azul y la arena", "es"), ("the blue sea and the sand", "en")], "t string, lang string")
    profiles: dict = {}
    for r in analysis.language_profiles(train, "t", "lang").orderBy("rank").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    found = {r.id: r.probabilities for r in analysis.detect_language(spark.createDataFrame([(1, "la arena y el mar"), (2, None)], "id long, t string"), "id", "t", profiles).collect()}
    assert found[1]["es"] > found[1]["en"] and found[2] is None


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_keywords_of_many_texts_at_once(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = ["The", "the", "de", "Reef", "reef", "coral", "Coral", "12", "345", "ab", "Ñandú", "ñandú", "x_y", "İstanbul", "la", "playa", "Mar"]
    texts = ["".join(w + str(rng.choice([" ", " ", " ", ", ", ". ", "!?\n", "\n\n"])) for w in rng.choice(words, rng.integers(0, 60))) for _ in range(120)]
    texts += [None, "", "...", "the la de", "one", "One two", "\0 a. b", "1 2 3", "reef " * 300]
    called = []
    monkeypatch.setattr(analysis, "keyword_candidates", lambda *a, f=analysis.keyword_candidates, **b: called.append(1) or f(*a, **b))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    for n, top in ((2, 5), (1, 3), (3, 4), (4, 100)):
        want = [(i, r + 1, k, s) for i, t in enumerate(texts) for r, (k, s) in enumerate(analysis.keyword_candidates(t, n, top))]
        del called[:]
        at, rank, keywords, scores = analysis._keywords(texts, n, top)
        assert not called and list(zip(at, rank, keywords)) == [w[:3] for w in want]
        assert scores == pytest.approx([w[3] for w in want], rel=1e-13)
        for size in (1, 700):
            monkeypatch.setattr(analysis, "CHARACTERS", size)
            got = sorted(tuple(r) for r in analysis.keywords_of_texts(df, "id", "t", n, top).collect())
            assert [g[:3] for g in got] == [w[:3] for w in want]


def test_language_profiles_count_runs_without_a_row_each(spark, monkeypatch):
    texts = [("La  niña, el mar.", "es"), ("mar", "es"), (None, "es"), ("", "es"), ("The sea 3 \U0001d54f", "en"), ("x", None), ("mar " * 4000, "es")]
    want: dict = {}
    for text, lang in texts:
        if text is not None and lang:
            t = f" {''.join(c if c.isalpha() else '|' for c in text.lower())} "
            while "||" in t:
                t = t.replace("||", "|")
            t = t.replace("|", " ")
            for n in (1, 2, 3):
                for g in (t[i : i + n] for i in range(len(t) - n + 1)):
                    if g.strip():
                        want.setdefault(lang, {}).setdefault(g, 0)
                        want[lang][g] += 1
    places = {(lang, g): r for lang, c in want.items() for r, g in enumerate(sorted(c, key=lambda g: (-c[g], g)), 1)}
    df = spark.createDataFrame(texts, "t string, lang string")
    for at_once in (2_000_000, 30):  # counted by place, and sorted where there are many letters
        monkeypatch.setattr(analysis, "GRAMS_AT_ONCE", at_once)
        profiles = analysis.language_profiles(df, "t", "lang")
        assert {(r.lang, r.gram): r["rank"] for r in profiles.collect()} == places
    assert "Generate" not in plan_of(profiles)
    found = analysis.detect_language(df.withColumn("id", F.lit(1)), "id", "t", {"es": ["a"], "en": ["e"]})
    assert "Exchange" not in plan_of(found.select("id", "text", "probabilities"))


def test_files(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "cancun.csv").write_text('Comentario,Rating,Unnamed: 0\n"una ""gran""\nplaya",5,1\n,3,2\nmala,x,3\n', encoding="utf-8")
    (tmp_path / "web" / "tulum.csv").write_bytes("review_text,stars\nniño,4\n".encode("iso-8859-1"))
    rows = {(r.text, r.stars, r.source, r.location) for r in files.read_review_folders(spark, str(tmp_path)).collect()}
    assert rows == {('una "gran"\nplaya', 5.0, "web", "cancun"), ("mala", None, "web", "cancun"), ("niño", 4.0, "web", "tulum")}
    ids = [r.doc_id for r in files.with_ids(spark.range(100).repartition(7).select(F.col("id").alias("x"))).collect()]
    assert sorted(ids) == list(range(100))
    a, b = (spark.createDataFrame([(1, x), (k, x)], "id long, v string") for k, x in ((2, "a"), (3, "b")))
    assert {(r.id, r.v) for r in files.union_first([a, b], "id").collect()} == {(1, "a"), (2, "a"), (3, "b")}
    made = files.materialize_if_absent(spark, f"{tmp_path}/m", lambda: spark.range(3))
    assert made.count() == 3 and files.materialize_if_absent(spark, f"{tmp_path}/m", lambda: spark.range(9)).count() == 3


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("pair_min: 7\nk_range: [2, 4]\n")
    config = load_config(str(tmp_path / "c.yaml"), pair_min=9)
    assert (config.pair_min, config.k_range, config.seed) == (9, (2, 4), 42)
    with pytest.raises(ValueError, match="unknown"):
        Config().with_values({"nothing": 1})


def test_pipeline_order_and_skip(spark, tmp_path):
    made = []

    def build(name):
        return lambda s, t, c: made.append(name) or s.range(2)

    steps = {n: Step(n, needs, build(n)) for n, needs in {"b": ("a",), "a": ("reviews",), "c": ("b",)}.items()}
    pipeline = Pipeline(spark, str(tmp_path), Config(), steps)
    assert pipeline.order(["c"]) == ["a", "b", "c"]
    pipeline.run(spark.range(1), ["b"])
    pipeline.run(spark.range(1), ["c"])
    assert made == ["a", "b", "c"] and all(pipeline.status().values())
    Pipeline(spark, str(tmp_path), Config(seed=1), steps).run(spark.range(1), ["a"])
    assert made[-1] == "a"
    with pytest.raises(ValueError, match="circle"):
        Pipeline(spark, "", Config(), {"x": Step("x", ("y",), build("x")), "y": Step("y", ("x",), build("y"))}).order()


def test_whole_pipeline(spark, tmp_path):
    rng = np.random.default_rng(2)
    places, words = ["Cancun", "Tulum"], ["playa", "arena", "museo", "comida", "precio", "hermoso", "malo", "servicio", "Hotel", "Riviera"]
    rows = [(i, " ".join(["El viaje a Playa Norte con", *rng.choice(words, 12)]), places[i % 2], float(i % 5 + 1)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, location string, stars double")
    tables = Pipeline(spark, str(tmp_path), Config(k_range=(2, 3), pair_entity_docs=2, pair_min=2)).run(df)
    assert tables["summary"].count() == 2 and tables["features"].count() == 80
    assert tables["keywords"].count() > 0
