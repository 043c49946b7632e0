"""Tokenizer, classifiers, language, toxicity."""

import base64
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm.byte_bpe import Merges, Tokens, decode, encode, read_ranks
from corpuslens.llm.language_ppm import ORDER, code_lengths, identify_language, length_table, train_languages
from corpuslens.llm.quality import quality_scores, train_quality
from corpuslens.llm.toxicity import fold, learn_lexicon, toxicity_filter, toxicity_scores

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return read_ranks(f.read())


@pytest.fixture(scope="module")
def merges(ranks):
    return Merges(ranks)


def by_definition(ranks, piece):
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if best == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc \néß日😀1!'", min_size=1, max_size=40), min_size=1, max_size=20))
def test_replay_is_the_definition(ranks, merges, pieces):
    raw = [p.encode() for p in pieces]
    ids, first = merges.replay(raw)
    for i, piece in enumerate(raw):
        want = by_definition(ranks, piece)
        assert ids[first[i] : first[i + 1]].tolist() == want
        assert merges.alone(piece) == want
    out, _ = Tokens(ranks).decode(ids)
    assert out.tobytes() == b"".join(raw)


def test_long_pieces(merges, library):
    """A piece of a whole text's length takes no more than its length and a logarithm."""
    for piece in ("a" * 30_000, "ab" * 9_000 + "c", "日本" * 4_000, "".join(chr(97 + i * i % 26) for i in range(20_000))):
        want = library.encode_ordinary(piece)
        ids, _ = merges.replay([piece.encode()])
        assert ids.tolist() == want and merges.alone(piece.encode()) == want


def test_encode_is_the_librarys(docs, corpus, library):
    rows = decode(encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    got = sorted((str(r.doc_id), bytes(r.tokens), bytes(r.bytes)) for r in rows)
    want = sorted((str(d), np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for d, t, *_ in corpus)
    assert got == want
    assert encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def labelled(spark, marks):
    rows, labels = [], []
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(200)]
    for i in range(400):
        y = int(rng.random() < 0.3)
        w = [str(x) for x in rng.choice(vocabulary, 40)]
        if y:
            for _ in range(4):
                w[int(rng.integers(40))] = str(rng.choice(marks))
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    return spark.createDataFrame([*rows, (None, None), (900, ""), (901, None)], "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (7000, None)], "doc_id long, y int"), dict(labels)


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_on_held_out_rows(spark):
    df, labels, truth = labelled(spark, ["%%%", "###", "x%%%"])
    train = labels.where("crc32(cast(string(doc_id) AS binary)) % 5 <> 0")
    rows = quality_scores(df, train_quality(df, train, label_col="y")).collect()
    assert len(rows) == 403
    assert all(0 <= r.score <= 1 and r.held_out == held_out(r.doc_id) for r in rows)
    judged = [(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean(judged) > 0.95
    empty = quality_scores(df.limit(0), train_quality(df.limit(0), labels.limit(0), label_col="y"))
    assert empty.count() == 0


def test_toxicity_on_held_out_rows(spark):
    df, labels, truth = labelled(spark, ["grumblo", "grumbla", "idiot"])
    train = labels.where("crc32(cast(string(doc_id) AS binary)) % 5 <> 0")
    model = learn_lexicon(df, train, label_col="y")
    rows = toxicity_scores(df, model).collect()
    assert all(0 <= r.score <= 1 and r.held_out == held_out(r.doc_id) for r in rows)
    assert all((r.score >= 0.5) == (truth[r.doc_id] == 1) for r in rows if r.doc_id in truth)
    kept = {r.doc_id for r in toxicity_filter(df, model).collect()}
    assert kept == {r.doc_id for r in rows if r.score < 0.5}


def test_toxicity_disguises_and_exceptions(spark):
    assert fold("ID1OT") == " idiot "
    assert fold("іdіоt") == " idiot "  # letters of another script
    assert fold("id​iot") == " idiot "
    texts = ["you 1d1ot", "уou are an іdiot", "the clown fish swims", "a trash can stands here", "quiet words", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = learn_lexicon(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    score = {r.doc_id: r.score for r in toxicity_scores(df, model).collect()}
    assert score[0] >= 0.5 and score[1] >= 0.5
    assert all(score[i] < 0.5 for i in range(2, 7))


def test_languages(spark):
    rng = np.random.default_rng(5)
    parts = {"aa": ["lo", "mi", "za", "ré"], "bb": ["kt", "gro", "üsch", "ein"]}
    word = lambda lang: "".join(rng.choice(parts[lang], 3))
    rows = [(i, " ".join(word(lang) for _ in range(30)), lang) for i in range(200) for lang in [("aa", "bb")[i % 2]]]
    rows += [(900, "123 !!", None), (901, None, "aa"), (902, "", "bb"), (903, "日本", None), (None, "lomiza", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_languages(df.where("crc32(cast(string(doc_id) AS binary)) % 5 <> 0"))
    got = {r.doc_id: r for r in identify_language(df, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i is not None and i < 900)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert got[903].lang_pred in ("aa", "bb") and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = train_languages(df.limit(0))
    assert {r.lang_pred for r in identify_language(df, nothing).collect()} == {"und"}


def test_code_lengths_are_probabilities():
    rng = np.random.default_rng(1)
    bits = code_lengths(rng.integers(0, 3, (5, 5, 5)).astype(float))
    assert (np.exp2(-bits.astype(float)).sum(axis=-1) <= 1 + 1e-6).all()


def test_table_of_seen_contexts_is_the_whole_one():
    rng, size = np.random.default_rng(2), 9
    context, symbol, n = rng.integers(0, size**ORDER, 60) // 2, rng.integers(0, size, 60), rng.integers(1, 5, 60).astype(float)
    counts = np.zeros((size**ORDER, size))
    np.add.at(counts, (context, symbol), n)
    row_of, rows = length_table(context, symbol, n, size)
    assert len(rows) < size**ORDER
    assert np.array_equal(rows[row_of], code_lengths(counts.reshape((size,) * (ORDER + 1))).reshape(-1, size))


def by_hand(counts, text, symbols):
    """Bits of a text by partial matching (escape C, exclusion), from counts[context][symbol]; contexts are tuples."""
    total = 0.0
    for i, s in enumerate(text):
        before, out = tuple(([0] * ORDER + text[:i])[-ORDER:]), set()
        for order in range(ORDER, -1, -1):
            seen = {k: v for k, v in counts.get(before[ORDER - order :], {}).items() if k not in out}
            n, kinds = sum(seen.values()), len(seen)
            if s in seen:
                total += np.log2((n + kinds) / seen[s])
                break
            if kinds:
                total += np.log2((n + kinds) / kinds)
                out |= set(seen)
        else:
            total += np.log2(symbols - len(out))
    return total


def test_languages_against_plain_matching(spark):
    from corpuslens.llm.language_ppm import SYMBOL

    rows = [(i, t, lang) for i, (t, lang) in enumerate([("la lila lo", "aa"), ("lola 12 lil", "aa"), ("krk trk", "bb"), ("tkr, kkt r", "bb")] * 3)]
    new = [(100, "lil krk", None), (101, "trkt zz", None), (102, "ola é", None), (103, "lol " * 400, None), (104, "la lila lo", "zz"), (104, "la lila lo", "zz")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_languages(train, sample_texts=10**6)
    fold = lambda t: [0 if SYMBOL[b] == 32 else int(SYMBOL[b]) for b in t.encode()]
    alphabet = {0} | {s for _, t, _ in rows for s in fold(t)}
    number = lambda t: [s if s in alphabet else -1 for s in fold(t)]
    models = {}
    for _, t, lang in rows:
        x = number(t)
        for i, s in enumerate(x):
            before = tuple(([0] * ORDER + x[:i])[-ORDER:])
            for order in range(ORDER + 1):
                of = models.setdefault(lang, {}).setdefault(before[ORDER - order :], {})
                of[s] = of.get(s, 0) + 1
    # columns whose names clash with those of the result, and repeated rows
    df = spark.createDataFrame([(*r, "x", 1) for r in new], "doc_id long, text string, lang string, lang_pred string, score int")
    got = identify_language(df, model).collect()
    assert len(got) == len(new)
    for r in got:
        text = next(t for i, t, _ in new if i == r.doc_id)
        bits = {lang: by_hand(m, number(text), len(alphabet) + 1) for lang, m in models.items()}
        assert r.lang_pred == min(bits, key=bits.get)
        assert r.score == pytest.approx(1 / sum(2.0 ** max(min(bits.values()) - b, -1000) for b in bits.values()), rel=1e-3)
