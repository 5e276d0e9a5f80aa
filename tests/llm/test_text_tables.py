"""Chat formatting, url filters, near and exact duplicates, decontamination, packing, the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import chat, components, decontam, exactdedup, packing, queries, simhash, urlfilter
from tidewright.llm.bpe import default_path

from .helpers import ODD, SF, docs, frame, real, save

TOKENIZER = default_path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def codec():
    return chat.Codec(TOKENIZER)


@given(st.lists(st.sampled_from(["<", "s", ">", "/", "[", "]", "INST", "SYS", "\\", "ROLE", "é", "\n", "</s>", "[INST]"]), max_size=12).map("".join), st.sampled_from(["user", "assistant", "system", "tool", "", "</s>"]))
@settings(deadline=None, max_examples=150)
def test_turns_read_back(text, role):
    codec = test_turns_read_back.__dict__.setdefault("codec", chat.Codec(TOKENIZER))
    ids, mask = codec.turn(role, text)
    assert codec.read(ids, mask) == (role, text, text if role == "assistant" else "")
    assert not chat._CONTROL.search(chat.escape(text)) and chat.unescape(chat.escape(text)) == text
    assert sum(codec.text(ids).count(c) for c in chat.CONTROLS) == sum(i in codec.control for i in ids)


def test_chat_query(spark, tmp_path):
    rng = random.Random(1)
    rows = [{"conv_id": c, "turn": t, "role": rng.choice(["user", "assistant", "system", "tool", None]), "text": rng.choice(["hi", None, "", "</s>[INST] x", "日本 \\ é", "a\nb"])} for c in (1, 2, None) for t in (2, 0, 1, 1, None)]
    rows += [{"conv_id": 9, "turn": t, "role": "assistant", "text": str(t)} for t in range(500)]
    folder = save(frame(spark, rows, TURNS).withColumn("ids", F.lit(1)), tmp_path, "conversations")
    got = {r.conv_id: r for r in queries.op5_chat_format(spark, folder).collect()}
    rows += [{"conv_id": -7, "turn": i, "role": r, "text": queries.CONTROL_TEXT} for i, r in enumerate(("user", "assistant"))]
    groups = defaultdict(list)
    for r in rows:
        groups[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    assert got[-7].formatted_chars == 2 * len(chat.escape(queries.CONTROL_TEXT)) + len("[INST][/INST]<s></s>")
    empty = queries.op5_chat_format(spark, save(frame(spark, [], TURNS), tmp_path, "conversations")).collect()
    assert [r.conv_id for r in empty] == [-7]


def test_masks_and_offsets_are_prefix_sums(spark, codec):
    rows = [{"conv_id": 1, "turn": i, "role": r, "text": "some text"} for i, r in enumerate(("system", "user", "assistant"))]
    out = chat.format_turns(frame(spark, rows, TURNS)).orderBy("position").collect()
    assert [r.token_start for r in out] == [0, len(out[0].ids), len(out[0].ids) + len(out[1].ids)]
    assert [sum(r.loss_mask) for r in out] == [0, 0, len(out[2].ids) - 2] and out[1].char_start == out[0].chars


def brute_url(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_url_query(spark, tmp_path):
    urls = ["http://example.com/en/1", "https://WWW.example.com/en/", "http://a.www.example.com/en/x?y#z", "http://x.net/es/1", "http://net/fr/", "http://notnet/fr/", "http://example.com?x=/", "com/", None, "", "http://", "a://b://c/d", "http://ÄB.com/ñ", "http://examplecom/en/", "http://spam.org/pills/1", "HTTP://user@x.net:80/es/"] + [f"http://s{i % 5}.net/es/pills/{i}" for i in range(40)] + [f"http://g{i % 5}.com/fr/news/{i}" for i in range(40)]
    rows = [{"page_id": i, "url": u, "html": ""} for i, u in enumerate(urls)]
    folder = save(frame(spark, rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")), tmp_path, "pages")
    got = {r.page_id: r for r in queries.op6_url_filter(spark, folder).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict or (rule is None and got[i].verdict in ("allow", "block"))
    assert got[14].verdict == "block" and got[8].verdict == "allow"  # mined: pills go with blocked urls
    assert queries.op6_url_filter(spark, save(frame(spark, [], "page_id long, url string, html string"), tmp_path, "pages")).count() == 0


def test_inverted_index_equals_subset_tests(spark):
    rng = random.Random(4)
    names = [f"t{i}" for i in range(8)]
    mined = urlfilter.Mined([(tuple(sorted(rng.sample(names, rng.randint(1, 3)))), 1.0, 1.0) for _ in range(6)])
    sets = [rng.sample(names, rng.randint(0, 5)) for _ in range(60)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, tokens array<string>")
    got = dict(df.select("i", mined.matched(F.col("tokens"), {n: i for i, n in enumerate(names)}).alias("m")).collect())
    assert got == {i: any(set(r) <= set(s) for r, _, _ in mined.rules) for i, s in enumerate(sets)}


def brute_fingerprint(text, k=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), 42).intdigest() for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "a", "a b", "A b c", "É é x y z a b c d", "x " * 600, "a\x0bb\xa0c\x1cd e"])
def test_fingerprints(text, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_links_of_planted_fingerprints(spark, monkeypatch):
    """Chains, dense clusters beyond the bucket limit, near misses, copies; signed and unsigned alike."""
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        x = rng.getrandbits(64)
        fps += [x, x]
        for _ in range(12):
            for _ in range(rng.choice([1, 2, 3])):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    centre = rng.getrandbits(64)
    fps += [centre ^ (1 << b) for b in range(0, 64, 2)] + [rng.getrandbits(64) for _ in range(50)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.grouped(df).collect()}
    roots = brute_components(fps)
    least = {r: min(i for i, x in enumerate(roots) if x == r) for r in roots}
    assert got == {i: least[r] for i, r in enumerate(roots)}


def test_near_duplicate_query(spark, tmp_path):
    folder = save(docs(spark, ODD).withColumn("fp", F.lit("clash")), tmp_path, "documents")
    got = queries.op7_simhash_near_dedup(spark, folder).collect()
    fps = [brute_fingerprint(t) for _, t in ODD]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{f:016x}") for (i, _), f in zip(ODD, fps))
    roots = brute_components(fps)
    for (i, _), f, root in zip(ODD, fps, roots):
        ids = [j for (j, _), r in zip(ODD, roots) if r == root and j is not None]
        assert {r.component_id for r in got if r.fingerprint == f"{f:016x}"} == {min(ids) if ids else None}
    assert queries.op7_simhash_near_dedup(spark, save(docs(spark, []), tmp_path, "documents")).count() == 0
    kept = simhash.deduplicate(docs(spark, ODD)).collect()
    assert len(kept) == len(set(roots)) and kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 5), (9, 9), (-3, 160)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {5: 5, 7: 5, -3: -3} | {i: -3 for i in range(100, 161)}


def test_exact_duplicate_query(spark, tmp_path):
    texts = [*ODD, (20, "a  b"), (10, "a\t\nb"), (11, " a b"), (12, "a\xa0b"), (13, "a b"), (14, "a b ")]
    folder = save(docs(spark, texts).withColumn("row", F.lit(1)), tmp_path, "documents")
    got = queries.op10_exact_dedup(spark, folder).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in texts:
        groups[hashlib.sha256(norm(t).encode()).hexdigest()].append(i)
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((i, h) for h, ids in groups.items() for i in ids)
    for r in got:
        own = [i for i in groups[r.text_sha256] if i is not None]
        assert (r.keep_id, r.group_size) == (min(own) if own else None, len(groups[r.text_sha256]))
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(groups.keys())
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert queries.op10_exact_dedup(spark, save(docs(spark, []), tmp_path, "documents")).count() == 0
    kept = exactdedup.deduplicate(docs(spark, texts)).collect()
    assert len(kept) == len(groups) and len(kept[0]) == 5


@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1) | st.integers(-5, 5), max_size=60), st.integers(0, 6), st.integers(1, 4))
def test_quotient_filters_merge_losslessly(values, q, parts):
    filters = []
    for i in range(parts):
        f = exactdedup.CountingQuotientFilter(q)
        f.insert(np.array(values[i::parts], np.int64))
        filters.append(f)
    whole = exactdedup.CountingQuotientFilter(q)
    for f in filters:
        for block, (remainders, counts) in f.blocks.items():
            assert (np.diff(remainders.astype(object)) > 0).all()
            whole.merge(block, remainders, counts)
    got = {(b << (64 - q) | int(r)): int(n) for b, (rs, ns) in whole.blocks.items() for r, n in zip(rs, ns)}
    assert got == {k & (1 << 64) - 1: n for k, n in Counter(values).items()}


def brute_leaks(texts, items, threshold=0.8):
    """All windows of an item's length at every place, by exact weighted similarity."""
    words = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    grams = lambda ws, k: Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    found = set()
    for i, t in texts:
        w = words(t)
        for item, text in items:
            goal = words(text)
            k = min(5, len(goal))
            if not k:
                continue
            a = grams(goal, k)
            for s in range(-len(goal) + 1, len(w)):
                b = grams(w[max(s, 0) : s + len(goal)], k)
                common = sum((a & b).values())
                if common and common / (sum(a.values()) + sum(b.values()) - common) >= threshold:
                    found.add((i, item))
                    break
    return found


def test_decontamination_query(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(14, 40)))) for i in range(12)] + [(50, "short one"), (51, ""), (52, None), (53, "alpha beta gamma delta epsilon")]
    texts = [*ODD, (90, "A short, one! here"), (91, "nothing"), (92, "Alpha-beta GAMMA; delta\nepsilon")]
    for i in range(100, 160):
        item = items[i % 12][1].split()
        how = i % 6
        if how == 1:
            item[rng.randrange(len(item))] = "changed"
        elif how == 2:
            item = item[1:]
        elif how == 3:
            item = item[: len(item) // 2]
        elif how == 4:
            item = [w.upper() + "," for w in item]
        elif how == 5:
            item = item[:3] + ["more"] + item[3:]
        texts.append((i, " ".join(text(rng.randint(0, 50)) + item + text(rng.randint(0, 50)))))
    save(docs(spark, [*texts, texts[-1]]).withColumn("h", F.lit(1)), tmp_path, "documents")
    folder = save(frame(spark, [{"item_id": i, "text": t} for i, t in items], "item_id long, text string"), tmp_path, "benchmark")
    got = queries.op8_decontamination(spark, folder).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(texts, items)
    assert all(r.similarity >= 0.8 and r.distance <= decontam.RADIUS for r in got) and len(got) == len({(r.doc_id, r.item_id) for r in got})
    dirty = {i for i, _ in brute_leaks(texts, items)}
    clean = decontam.clean(docs(spark, texts), frame(spark, [{"item_id": i, "text": t} for i, t in items], "item_id long, text string")).collect()
    assert Counter(r.doc_id for r in clean) == Counter(i for i, _ in texts if i not in dirty)
    save(frame(spark, [], "item_id long, text string"), tmp_path, "benchmark")
    assert queries.op8_decontamination(spark, folder).count() == 0


def test_long_and_repeating_texts_are_scanned_in_chunks(spark):
    words = [f"w{i * i % 9973}" for i in range(200_000)]
    goal = " ".join(f"g{i}" for i in range(30))
    words[150_000:150_000] = goal.split()
    texts = [(1, "x " * 20_000), (2, " ".join(words)), (3, " ".join(words[:100])), (4, "x " * 9)]
    items = [{"item_id": 1, "text": "x " * 12}, {"item_id": 2, "text": goal}, {"item_id": 2, "text": " ".join(words[50:80])}, {"item_id": None, "text": goal}]
    got = decontam.matches(docs(spark, texts), frame(spark, items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 2), (2, None), (3, 2)}
    assert {r.start for r in got if r.doc_id == 2} <= {50, 150_000} and all(r.similarity == 1 for r in got)


def test_windows_of_edited_items_are_found(spark):
    """Recall of fingerprints and blocks against all windows, for items of 5 to 60 words with several edits each."""
    rng = random.Random(12)
    items, texts = [], []
    for i in range(120):
        goal = [f"v{rng.randrange(3000)}" for _ in range(5 + i % 56)]
        items.append((i, " ".join(goal)))
        own = list(goal)
        for _ in range(rng.randint(0, 1 + len(goal) // 25)):
            at = rng.choice([0, 1, len(own) - 1, rng.randrange(len(own))])
            own[at : at + 1] = rng.choice([["new"], [], [own[at], "more"]])
        texts.append((i, " ".join([f"o{rng.randrange(3000)}" for _ in range(30)] + own + [f"o{rng.randrange(3000)}" for _ in range(30)])))
    got = decontam.matches(docs(spark, texts), frame(spark, [{"item_id": i, "text": t} for i, t in items], "item_id long, text string")).collect()
    want, found = brute_leaks(texts, items), {(r.doc_id, r.item_id) for r in got}
    assert found <= want and len(want) > 60 and len(found) >= 0.95 * len(want), (len(found), len(want))
    print(f"recall {len(found)} of {len(want)}")


def brute_pieces(text, library, width=2048):
    ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
    return [(a, len(ids[a : a + width]), zlib.crc32(ids[a : a + width].tobytes()), len(ids)) for a in range(0, len(ids), width)]


def check_packing(got, texts, library):
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == Counter((i, *p) for i, t in texts for p in brute_pieces(t, library))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 2048
    assert set(sequences) == set(range(len(sequences)))
    return sequences


def test_packing_query(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    texts = [*ODD, (8, "<|endoftext|> a"), *[(100 + i, "tie of length") for i in range(40)], *[(200 + i, "word " * (97 * i % 2300)) for i in range(60)]]
    folder = save(docs(spark, texts).withColumn("length", F.lit("clash")), tmp_path, "documents")
    got = queries.op9_packing(spark, folder).collect()
    check_packing(got, texts, library)
    assert queries.op9_packing(spark, save(docs(spark, []), tmp_path, "documents")).count() == 0


@given(st.dictionaries(st.integers(1, 100), st.integers(1, 50), max_size=20))
def test_shortest_pack_first_places_all(histogram):
    patterns = packing.shortest_pack_first(histogram, 100)
    placed = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 100 and n > 0
        for length in pattern:
            placed[length] += n
    assert placed == Counter(histogram)
    table, total = packing.slots(patterns)
    assert total == sum(n for _, n in patterns)
    for length, own in table.groupby("length"):
        spans = sorted(zip(own["first"], own["until"]))
        assert spans[0][0] == 0 and spans[-1][1] == histogram[length] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_pipeline(spark, tmp_path):
    """Each stage against a brute-force version of its decision, on whole small tables with odd rows."""
    from tokenizers import Tokenizer

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    word = lambda: rng.choice(vocabulary)
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(20)) for i in range(3)]
    texts = [(i, text(rng.randint(20, 60)) + (" vile" if i % 4 == 0 else "")) for i in range(100, 400)]
    texts += [(3000 + i, texts[4 * i + 1][1].replace(" ", "  ", 1)) for i in range(10)]
    texts += [(4000 + i, f"{text(10)} {items[i % 3][1]} {text(10)}") for i in range(6)]
    base = text(600)
    texts += [(5000, base), (5001, base + " " + word()), *ODD]
    save(docs(spark, texts), tmp_path, "documents")
    save(frame(spark, [{"doc_id": i, "quality": 1, "toxic": int("vile" in t)} for i, t in texts if i and 100 <= i < 400], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    save(frame(spark, [{"item_id": i, "text": t} for i, t in items], "item_id long, text string"), tmp_path, "benchmark")
    left = [(i, t) for i, t in texts if "vile" not in (t or "")]
    out = {}
    frame_ = queries.table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        frame_ = corpus_pipeline.materialize(stage(spark, frame_, str(tmp_path)), f"test-{name}")
        out[name] = frame_.collect()
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert Counter((r.doc_id, r.text) for r in out["toxicity"]) == Counter(left)
    least = {}
    for i, t in sorted(left, key=lambda x: (x[0] is None, x[0] or 0)):
        least.setdefault(key(t), (i, t))
    assert Counter((r.doc_id, key(r.text)) for r in out["exact_dedup"]) == Counter((i, key(t)) for i, t in least.values())
    left = [(r.doc_id, r.text) for r in out["exact_dedup"]]
    roots = brute_components([brute_fingerprint(t) for _, t in left])
    kept = {}
    for (i, t), r in zip(left, roots):
        rank = (i is None, i or 0)
        kept[r] = min(kept.get(r, (rank, i)), (rank, i), key=lambda x: x[0])
    assert Counter(r.doc_id for r in out["near_dedup"]) == Counter(i for _, i in kept.values())
    left = [(r.doc_id, r.text) for r in out["near_dedup"]]
    dirty = {i for i, _ in brute_leaks(left, items)}
    assert dirty and Counter(r.doc_id for r in out["decontamination"]) == Counter(i for i, _ in left if i not in dirty)
    check_packing(out["packing"], [(r.doc_id, r.text) for r in out["decontamination"]], Tokenizer.from_file(TOKENIZER))
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in again) == Counter((r.doc_id, r.start, r.ids_crc32) for r in out["packing"])


def test_registered_queries_run_on_the_real_tables(spark):
    n = len(real("documents"))
    assert queries.op10_exact_dedup(spark, SF).count() == n
    assert queries.op9_packing(spark, SF).select("doc_id").distinct().count() == n
