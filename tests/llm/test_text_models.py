"""Language identification, token counts, quality, toxicity."""

import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.llm import bpe, langid, quality, queries, tokencount, toxicity
from tidewright.llm.bpe import Bounded, Vocabulary, default_path

from .helpers import ODD, SF, docs, frame, real, save

TOKENIZER = default_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(TOKENIZER)


SAMPLES = ["", " ", "a", "  a  b\n\n c\t", "don't I'LL we've", "x" * 3000, "é ñ Ñandú ß", "日本語テキスト 𝒜𝒷 🙂🙂", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|> c", "\x1c\x1d a\x85b\xa0c d e", "²³¹ ½ 12,345.67", "…—“quoted”", "ǅ ɏ ª º µ", "̀á"]


@pytest.mark.parametrize("text", SAMPLES)
def test_counts_equal_the_library(text, counter, library):
    assert counter(text) == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF), st.characters(codec="utf-8", categories=("L", "N", "P", "S", "Zs", "Cc")), st.sampled_from(" \n\t'sdltrv")), max_size=40))
def test_counts_equal_the_library_on_any_text(text):
    from tokenizers import Tokenizer

    import unicodedata

    if any(unicodedata.category(c) == "Cn" for c in text):
        return
    library = test_counts_equal_the_library_on_any_text.__dict__.setdefault("library", Tokenizer.from_file(TOKENIZER))
    counter = test_counts_equal_the_library_on_any_text.__dict__.setdefault("counter", tokencount.Counter(TOKENIZER))
    assert counter(text) == len(library.encode(text, add_special_tokens=False).ids)


@given(st.binary(max_size=60))
@settings(deadline=None)
def test_merges_by_heap_equal_merges_by_search(data):
    v = test_merges_by_heap_equal_merges_by_search.__dict__.setdefault("v", Vocabulary(TOKENIZER))
    symbols, made = list(data), 0
    while True:
        best = min(((v.rank.get(a << 32 | b, math.inf), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))), default=(math.inf, 0))
        if best[0] == math.inf:
            break
        r, i = best
        symbols[i : i + 2] = [256 + r]
        made += 1
    assert v.merges(data) == made


def test_token_counts_of_a_table(spark, tmp_path, library):
    folder = save(docs(spark, [*ODD, *enumerate(SAMPLES, 100)]), tmp_path, "documents")
    got = queries.op2_token_counts(spark, folder).collect()
    assert len(got) == len(ODD) + len(SAMPLES)
    by_id = {r.doc_id: r for r in got if r.doc_id and r.doc_id >= 100}
    for i, t in enumerate(SAMPLES, 100):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (by_id[i].n_tokens, by_id[i].n_bytes, by_id[i].over_limit) == (n, len(t.encode()), n > 512)
    assert all(r.n_tokens == 0 and r.n_bytes == 0 for r in got if r.doc_id in (1, 2))
    assert queries.op2_token_counts(spark, save(docs(spark, []), tmp_path, "documents")).count() == 0


def test_long_texts_are_read_piece_by_piece(counter, library, monkeypatch):
    text = "the quick brown fox " * 200
    monkeypatch.setattr(bpe, "LONG", 100)
    assert counter(text) == len(library.encode(text).ids)


def brute_kneser_ney(words, order=4):
    """Interpolated Kneser-Ney straight from its definition, on strings."""
    grams = {}
    for w, n in words.items():
        s = "\x01" * (order - 1) + w + "\x02"
        for i in range(order - 1, len(s)):
            grams[s[i - order + 1 : i + 1]] = grams.get(s[i - order + 1 : i + 1], 0) + n
    levels = [grams]
    for _ in range(order - 1):
        counts = {}
        for g in levels[-1]:
            counts[g[1:]] = counts.get(g[1:], 0) + 1
        levels.append(counts)
    floor = 1 / (len({g[-1] for g in grams}) + 1)

    def p(g):
        lower = floor if len(g) == 1 else p(g[1:])
        counts = levels[order - len(g)]
        n1, n2 = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        own = {k: c for k, c in counts.items() if k[:-1] == g[:-1]}
        total = sum(own.values())
        return lower if not total else max(0, own.get(g, 0) - d) / total + d * len(own) / total * lower

    return p


def test_model_equals_the_definition():
    words = {"the": 5, "then": 2, "hat": 1, "thé": 1}
    keys, at = langid.packed(list(words))
    keys, n = langid._summed(keys, np.asarray(list(words.values()))[at])
    model = langid.Model({"en": (keys, n)})
    p = brute_kneser_ney(words)
    for run in ("the", "that", "zzz", "hen", "é"):
        k, _ = langid.packed([run])
        s = "\x01\x01\x01" + run + "\x02"
        want = [math.log(p(s[i : i + 4])) for i in range(len(run) + 1)]
        np.testing.assert_allclose(model.resolve(k)[:, 0], want, rtol=1e-9)
        np.testing.assert_allclose(model.score(k)[:, 0], want, rtol=1e-5)


def test_language_query_on_held_out_rows(spark):
    truth = real("documents").set_index("doc_id")
    got = queries.op1_language_id(spark, SF).toPandas()
    assert len(got) == len(truth) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred.to_numpy() == truth.lang[held.doc_id].to_numpy()).mean() > 0.95


def test_languages_of_odd_tables(spark, tmp_path):
    texts = [(i, "the cat and the dog with that hat") for i in range(100, 120)] + [(i, "der hund und die katze mit dem hut") for i in range(120, 140)]
    langs = {i: "en" if i < 120 else "de" for i, _ in texts}
    save(docs(spark, [*ODD, *texts], langs).withColumn("language", F.lit(1)).withColumn("score", F.lit("x")), tmp_path, "documents")
    got = queries.op1_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(ODD) + len(texts)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 6)} == {"und"}
    assert all(r.lang_pred == langs[r.doc_id] for r in got if r.doc_id and r.doc_id >= 100)
    assert next(r for r in got if r.doc_id == 7).rejected
    save(docs(spark, ODD), tmp_path, "documents")  # no language to learn
    assert {r.lang_pred for r in queries.op1_language_id(spark, str(tmp_path)).collect()} == {"und"}
    assert queries.op1_language_id(spark, save(docs(spark, []), tmp_path, "documents")).count() == 0


LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, tmp_path, texts, label):
    save(docs(spark, texts).withColumn("statistics", F.lit(0)), tmp_path, "documents")
    rows = [{"doc_id": i, "quality": label(t), "toxic": label(t)} for i, t in texts if i is not None and t]
    save(frame(spark, [*rows, rows[0], {"doc_id": None, "quality": 1, "toxic": 1}, {"doc_id": 5, "quality": None, "toxic": None}], LABELS), tmp_path, "labels")
    return str(tmp_path)


def test_quality_rules(spark, tmp_path):
    texts = [(i, "Plain words in a row, and so on. " * (1 + i % 7)) for i in range(100, 200)] + [(i, "LOUD!! WORDS!! AGAIN!! " * (1 + i % 7)) for i in range(200, 300)]
    folder = labelled(spark, tmp_path, [*texts, *ODD], lambda t: int("!!" not in t or t.startswith("!!!")))
    got = queries.op3_quality(spark, folder).collect()
    assert len(got) == len(texts) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.predicted == (r.doc_id < 200) for r in got if r.doc_id and r.doc_id >= 100)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)


def test_rules_as_columns_equal_rules_on_arrays(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.random((400, len(quality.STATISTICS))), 2)
    y = ((x[:, 3] > 0.5) & (x[:, 7] < 0.4) | (x[:, 1] > 0.9)).astype(float)
    model = quality.fit(x, y)
    assert 0 < len(model.rules) <= quality.RULES
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATISTICS)).select(F.struct("*").alias("s"))
    got = [r[0] for r in df.select(model.score("s")).collect()]
    np.testing.assert_allclose(sorted(got), sorted(1 / (1 + np.exp(-model.margins(x)))), rtol=1e-9)
    assert ((model.margins(x) > 0) == y).mean() > 0.95


def test_no_labels_or_one_label(spark, tmp_path):
    save(docs(spark, ODD), tmp_path, "documents")
    for rows in ([], [{"doc_id": 5, "quality": 1, "toxic": 0}, {"doc_id": 3, "quality": 1, "toxic": 0}]):
        save(frame(spark, rows, LABELS), tmp_path, "labels")
        for q in (queries.op3_quality, queries.op4_toxicity):
            got = q(spark, str(tmp_path)).collect()
            assert len(got) == len(ODD) and len({r.score for r in got}) == 1
    save(docs(spark, []), tmp_path, "documents")
    assert queries.op3_quality(spark, str(tmp_path)).count() == queries.op4_toxicity(spark, str(tmp_path)).count() == 0


def test_machine_learns_a_pair_of_neutral_words():
    """Toxic is a text with exactly one of two words: each alone has equal shares in both labels."""
    r = np.random.default_rng(3)
    sets, y = [], []
    for _ in range(2000):
        a, b = r.integers(0, 2, 2)
        sets.append(np.unique([*(r.choice(150, 20, replace=False) + 2), *[0] * a, *[1] * b]))
        y.append(float(a != b))
    y = np.asarray(y)
    machine = toxicity.FactorizationMachine(152, scaled=True)
    machine.fit(sets[:1600], y[:1600])
    of = np.repeat(np.arange(400), [len(s) for s in sets[1600:]])
    assert ((machine.margin(np.concatenate(sets[1600:]), None, 400, of) > 0) == y[1600:]).mean() > 0.95


def test_no_language_is_left_out_and_pruned_mass_goes_to_the_back_off():
    r = np.random.default_rng(5)
    words = {f"l{j:03d}": ["".join(chr(97 + c) for c in r.integers(0, 6, 5) + j % 20) for _ in range(30)] for j in range(120)}
    counts = {k: langid._summed(langid.packed(w)[0], np.ones(len(langid.packed(w)[0]), np.int64)) for k, w in words.items()}
    model = langid.Model(counts)
    got = model.decide(model.entropies([" ".join(words[k]) for k in sorted(words)]))
    assert len(model.langs) == 120 and (got["lang_pred"] == sorted(words)).mean() > 0.95
    keys, n = counts["l000"]
    for most in (None, 20):
        level = langid.Level(keys, n + np.arange(len(n)) % 3, most)
        own = np.unique(keys >> np.uint64(16))
        units = np.unique(keys & np.uint64(0xFFFF))
        grams = (own[:, None] << np.uint64(16) | units).ravel()
        p = level.probability(grams, np.full(len(grams), 1 / len(units)))
        np.testing.assert_allclose(p.reshape(len(own), -1).sum(1), 1)


def test_toxicity_learns_a_pair(spark, tmp_path):
    """Neither word alone is toxic; together they are."""
    rng = np.random.default_rng(2)
    texts = []
    for i in range(100, 900):
        words = list(rng.choice(["sun", "rain", "tree", "road", "lake"], 6))
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append((i, " ".join([*words, *["awful"] * a, *["neighbours!"] * b])))
    folder = labelled(spark, tmp_path, [*texts, *ODD], lambda t: int("awful" in t and "neighbours" in t))
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, folder).collect() if r.doc_id and r.doc_id >= 100}
    right = [got[i].predicted == ("awful" in t and "neighbours" in t) for i, t in texts]
    assert np.mean(right) > 0.98
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())


def test_machine_margin_equals_all_pairs():
    m = toxicity.FactorizationMachine(6)
    m.w[:] = np.arange(6) / 10
    sets = [np.array([0, 2, 5]), np.array([], np.int64), np.array([3])]
    of = np.repeat(np.arange(3), [len(s) for s in sets])
    got = m.margin(np.concatenate(sets), None, 3, of)
    want = [m.bias + m.w[s].sum() + sum(m.v[a] @ m.v[b] for i, a in enumerate(s) for b in s[i + 1 :]) for s in sets]
    np.testing.assert_allclose(got, want)


def test_terms_hash_a_word_once_whatever_stands_beside_it():
    text = "Harbour, harbour. (HARBOUR) harbour-master's ΟΔΥΣΣΕΥΣ, Σ' ΑΣ. İstanbul's ǅungla\x1cnaïveté\u2003日本語テキスト処理 x_1 \ud800ab𝒜bcdefgh"
    words = {w for token in text.split() for w in re.findall(r"\w+", token.lower())}
    own = [x for w in words for x in (w, *("^" + w[:k] for k in toxicity.STEMS if len(w) > k))]
    want = {zlib.crc32(x.encode("utf-8", "surrogatepass")) % 2**toxicity.HASH_BITS for x in own}
    asked = []
    memo = Bounded(lambda w: asked.append(w) or toxicity.hashed(w), toxicity.MEMO)
    assert toxicity.terms(text, memo) == want == toxicity.terms(text, memo) and toxicity.terms(None, memo) == set()
    assert sorted(asked) == sorted(words)


def test_numbers_without_a_weight_are_left_out():
    model = toxicity.Model(0.5)
    assert len(model.features(np.array([3, 9]))) == 0
    model = toxicity.Model(0.5)
    model.kept = np.array([3, 7, 2**toxicity.HASH_BITS - 1])
    assert model.features(np.array([9, 7, 2**toxicity.HASH_BITS - 1, 0, 3])).tolist() == [1, 2, 0]
