"""Near copies by five-word shingles, against all pairs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import components, neardup, simhash, toxicity

from .helpers import ODD, docs, frame, save


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def kept_by_all_pairs(texts):
    sets = [grams(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(texts):
        least.setdefault(find(i), []).append((key is None, key or 0))
    return sorted(min(v) for v in least.values())


def edited(rng, words, every):
    out = list(words)
    for i in rng.sample(range(len(out)), max(1, len(out) // every)):
        out[i] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def test_stage_drops_copies_with_one_word_in_fifty_changed(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET", 5)
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts = [*dict(ODD).items()]
    for i in range(40):
        words = text(rng.choice([60, 100, 200, 400]))
        texts += [(100 + 10 * i, " ".join(words)), (101 + 10 * i, edited(rng, words, 50)), (102 + 10 * i, edited(rng, words, 20))]
    base = text(300)
    texts += [(1000 + i, edited(rng, base, 60)) for i in range(30)]
    shared = text(40)
    texts += [(2000 + i, " ".join(shared + text(rng.randint(4, 14)))) for i in range(30)]
    got = corpus_pipeline.drop_near_copies(spark, docs(spark, texts), "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == kept_by_all_pairs(texts)
    assert not {r.doc_id for r in got} & {101 + 10 * i for i in range(40) if len(texts[1 + len(dict(ODD)) + 3 * i][1].split()) >= 200}


def test_only_likely_pairs_have_their_sets_compared(spark, monkeypatch):
    """Texts that share a passage stay out of the costly comparison, which is where the stage's disk went."""
    wanted = []
    real = neardup._sets
    monkeypatch.setattr(neardup, "_sets", lambda docs, rows, fps, text: wanted.append(fps.count()) or real(docs, rows, fps, text))
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passages = [text(12) for _ in range(40)]
    texts = [(i, " ".join(text(90) + passages[i % 40] + text(90))) for i in range(120)]
    words = text(200)
    texts += [(1000, " ".join(words)), (1001, edited(rng, words, 100))]
    for bucket in (64, 2):  # passages in groups of 3, listed or not
        monkeypatch.setattr(neardup, "BUCKET", bucket)
        got = corpus_pipeline.drop_near_copies(spark, docs(spark, texts), "").collect()
        assert sorted((False, r.doc_id) for r in got) == kept_by_all_pairs(texts) == [(False, i) for i in [*range(120), 1000]]
    assert wanted[0] == 2


def test_stage_links_by_simhash_and_checks_what_it_links(spark, monkeypatch):
    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes: seen.extend(r.fp for r in nodes.collect()) or links(nodes))
    rng = random.Random(6)
    words = [f"w{rng.randrange(4000)}" for _ in range(900)]
    texts = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, "one two three"), (4, " ".join(words[:300])), (5, None)]
    rows = neardup.indexed(docs(spark, texts)).collect()
    bits = {t or "": simhash.fingerprint(t, 5, 0) for _, t in texts}
    assert bin(bits[texts[0][1]] ^ bits[texts[1][1]]).count("1") <= simhash.RADIUS
    assert {r.doc_id: r.sim % 2**64 for r in rows} == {i: bits[t or ""] for i, t in texts}
    got = corpus_pipeline.drop_near_copies(spark, docs(spark, texts), "").collect()
    assert {f % 2**64 for f in seen} == set(bits.values()) and sorted(r.doc_id for r in got) == [1, 3, 4, 5]
    # fingerprints that are alike without similar texts link nothing
    far = docs(spark, [(i, " ".join(f"{i}x{rng.random()}" for _ in range(40))) for i in range(6)])
    assert neardup.links(far, neardup.indexed(far).withColumn("sim", F.lit(7).cast("long"))).count() == 0


def test_driver_gives_back_what_the_fit_took(spark, monkeypatch, tmp_path):
    steps, train, score = [], toxicity.train, toxicity.score
    monkeypatch.setattr(toxicity, "train", lambda *a: steps.append("train") or train(*a))
    monkeypatch.setattr(corpus_pipeline, "release", lambda: steps.append("release"))
    monkeypatch.setattr(toxicity, "score", lambda *a, **k: steps.append("score") or score(*a, **k))
    save(frame(spark, [{"doc_id": 1, "toxic": 0}], "doc_id long, toxic int"), tmp_path, "labels")
    assert corpus_pipeline.drop_toxic(spark, docs(spark, [(1, "a b"), (2, None)]), str(tmp_path)).count() == 2
    assert steps == ["train", "release", "score"]


def test_driver_gives_back_the_rows_before_the_fit(spark, monkeypatch):
    steps, fit, sets = [], toxicity.FactorizationMachine.fit, []
    monkeypatch.setattr(toxicity, "release", lambda: steps.append("release"))
    monkeypatch.setattr(toxicity.FactorizationMachine, "fit", lambda self, x, y: steps.append("fit") or sets.append((x, y)) or fit(self, x, y))
    texts = [(1, "aa bb"), (2, "bb cc cc"), (3, "dd"), (4, "aa bb cc"), (5, None)]
    labels = frame(spark, [{"doc_id": i, "toxic": i % 2} for i in range(1, 6)], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, texts).repartition(3), labels, F.lit(True))
    number = {w: toxicity.hashed(w)[0] for w in ("aa", "bb", "cc")}
    assert steps == ["release", "fit"] and model.kept.tolist() == sorted(number.values())
    got = sorted((int(y), sorted(model.kept[x].tolist())) for x, y in zip(*sets[0]))
    want = [(i % 2, sorted(number[w] for w in set((t or "").split()) if w in number)) for i, t in texts]
    assert got == sorted(want)


def test_pairs_of_a_large_group_are_not_listed(spark, monkeypatch):
    """Copies with edits of one text, many of them not similar to any other: few pairs are compared, and no link is lost."""
    monkeypatch.setattr(neardup, "BUCKET", 5)
    pairs, real = [], neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, tag: (out := real(df, tag), pairs.append(out.count()) if tag == "neardup-pairs" else 0)[0])
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    shared, texts = text(90), []
    for group, size in enumerate((90, 60, 40)):  # families of one half, joined by a passage that all hold
        base = shared + text(110)
        for i in range(size):
            words = list(base)
            for at in rng.sample(range(len(base)), rng.choice([1, 2, 3, 4, 5, 6])):
                words[at] = f"new{rng.randrange(10**9)}"
            texts.append((1000 * group + i, " ".join(words)))
    got = corpus_pipeline.drop_near_copies(spark, docs(spark, texts), "").collect()
    assert sorted((False, r.doc_id) for r in got) == kept_by_all_pairs(texts)
    assert 10 < len(got) < len(texts) - 50 and sum(pairs) < 3 * len(texts)


def test_stages_send_small_batches_to_workers(spark):
    name, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", docs(spark, [(1, "a b"), (2, None)])
    before = spark.conf.get(name)
    try:
        for told, want in (("10000", "1024"), ("0", "1024"), ("7", "7")):
            for stage in (corpus_pipeline.drop_copies, corpus_pipeline.pack_sequences):
                spark.conf.set(name, told)
                stage(spark, rows, "")
                assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_few_links_take_no_rounds_in_spark(spark, monkeypatch):
    """Each shuffle of a round has a thread of the driver for a minute, which filled its memory."""
    written, real = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, tag: written.append(tag) or real(df, tag))
    rng = random.Random(9)
    big = 2**62
    pairs = [(big - i, big - i - 1) for i in range(60)] + [(-big + rng.randrange(90), -big + rng.randrange(90)) for _ in range(70)] + [(5, 5), (8, 7), (7, 8)]
    least = {x: x for p in pairs for x in p}
    for _ in least:
        for u, v in pairs:
            least[u] = least[v] = min(least[u], least[v])
    alone = {x for x in least if all(x not in p or p[0] == p[1] for p in pairs)}
    want = {x: r for x, r in least.items() if x not in alone}
    edges = spark.createDataFrame(pairs, "u long, v long")
    got = components.connected_components(edges).collect()
    assert dict(got) == want and len(got) == len(want) and written == ["links"]
    assert components.connected_components(edges.filter("u = 5")).collect() == []
    monkeypatch.setattr(components, "FEW", 0)  # more than the driver takes
    got = components.connected_components(edges).collect()
    assert dict(got) == want and len(got) == len(want) and len(written) > 4


def test_stage_is_the_same_with_more_links_than_the_driver_takes(spark, monkeypatch):
    rng = random.Random(10)
    words = [[f"w{rng.randrange(4000)}" for _ in range(150)] for _ in range(6)]
    texts = [(10 * i + k, edited(rng, w, 150) if k else " ".join(w)) for i, w in enumerate(words) for k in range(4)]
    for few in (components.FEW, 0):
        monkeypatch.setattr(components, "FEW", few)
        got = corpus_pipeline.drop_near_copies(spark, docs(spark, texts), "").collect()
        assert sorted((False, r.doc_id) for r in got) == kept_by_all_pairs(texts)
    assert len(got) == 6
