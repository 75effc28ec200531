"""The numbered operators against brute force, on small tables with nulls, ties, empty and long texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import itq, langid, merkle, mixing, packing, pst, quality, simhash, toxicity, url_rules
from lodestone.llm.common import components, labelled_sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, range int, length string"


def documents(spark, rows):
    """With columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, 0, 1, "x", 2, "y") for i, t, lang, s in rows], DOCS)


def words(n, seed, alphabet="abcdef"):
    g = random.Random(seed)
    return " ".join("".join(g.choices(alphabet, k=g.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, words(5 + i % 40, i), "en" if i % 2 else "de", f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, words(60, 1), "en", "s0") for i in range(5)]  # copies
    rows += [(300, words(60, 1) + " zz", None, None), (301, None, "en", "s1"), (302, "", None, "s1"), (303, " \n\t ", "en", None)]
    rows += [(304, words(20_000, 9), "en", "s2"), (5, words(9, 77), "en", "s2"), (None, "a b c d", "en", "s0"), (6, words(11, 6), "en", "s0")]
    return rows


def test_components(spark):
    g = random.Random(3)
    edges = [(g.randrange(300), g.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(64)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_itq(spark):
    g = np.random.default_rng(0)
    centres = g.normal(size=(40, 24))
    x = np.vstack([centres[i % 40] + g.normal(0, 0.08, 24) for i in range(400)] + [g.normal(size=(300, 24))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist(), 1) for i in range(30)]
    rows += [(2000, None, 0), (2001, [0.0] * 24, 0), (2002, [float("nan")] * 24, 0), (2003, [None, 1.0], 0), (2004, [], 0), (2005, [1.0, 2.0], 0), (2006, [2.0, 4.0], 0), (2006, [2.0, 4.0], 0)]
    got = itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=16).collect()
    assert len(got) == len(rows)
    all_x = np.vstack([x, np.repeat(x[:1], 30, axis=0)]).astype(np.float32).astype(float)
    u = all_x / np.linalg.norm(all_x, axis=1, keepdims=True)
    close = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    ids = [*range(700), *range(1000, 1030)]
    n = {r.vec_id: r.n_links for r in got if r.vec_id < 2000}
    assert all(n[i] <= k for i, k in zip(ids, close.sum(axis=1)))
    assert sum(n.values()) >= 0.95 * close.sum()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if 2000 <= r.vec_id < 2006} == {i: (0, i, True) for i in range(2000, 2005)} | {2005: (2, 2005, True)}
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id == 2006] == [(2, 2005, False)] * 2
    assert next(r.component_id for r in got if r.vec_id == 1007) == next(r.component_id for r in got if r.vec_id == 0)


def test_itq_tables_find_pairs_of_off_centre_vectors():
    """Recall at the least cosine, for vectors whose mean is large too; more vectors, wider substrings."""
    g = np.random.default_rng(1)
    for shift in (0.0, 1.0, 2.0):
        x = itq.unit(g.normal(size=(3000, 32)) + shift)
        model = itq.Codes(x, 100_000, 0.9)
        for a, b in itq.pairs_at(itq.unit(g.normal(size=(500, 32)) + shift), 0.9, seed=9):
            met = (model.substrings(a) == model.substrings(b)).any(axis=1).mean()
            assert met > 0.95, (shift, met)
    d = [np.full(10, 0.14)]
    widths = [itq.choose(d, n)[0] for n in (1000, 100_000, 10_000_000)]
    assert widths == sorted(set(widths))


def test_itq_does_not_depend_on_partitions(spark):
    g = np.random.default_rng(4)
    centres = g.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + g.normal(0, 0.2, 16)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = sorted(map(tuple, itq.near_vectors(df.repartition(7), block=8).collect()))
    assert one == sorted(map(tuple, itq.near_vectors(df.coalesce(1), block=64, sample=5000).collect()))
    assert itq.near_vectors(df.limit(0)).count() == 0


def test_mixing(spark, docs):
    df = documents(spark, docs)
    got = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, *_ in docs)
    by = Counter()
    for _, t, _, s in docs:
        by[s] += size(t)
    order = sorted(k for k in by if k is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, free, left = {}, set(order), 1.5 * sum(by.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * by[s]}
        if not over:
            break
        for s in over:
            goal[s] = 2.0 * by[s]
            left -= goal[s]
            free.discard(s)
    goal |= share
    for s in order:
        rows = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, goal[s]) and r.source_size == by[s] and 0 <= r.taken <= 2 * r.size for r in rows)
        assert sum(r.taken for r in rows) == math.floor(rows[0].target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)


def brute_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, docs):
    rows = [(i, t) for i, t, *_ in docs if i is not None]
    got = simhash.near_duplicates(documents(spark, docs)).where("doc_id IS NOT NULL").collect()
    fp = [(i, brute_fingerprint(t)) for i, t in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{f:016x}") for i, f in fp)
    comp = {f: min(i for i, x in fp if x == f) for _, f in fp}
    changed = True
    while changed:
        changed = False
        for a in comp:
            for b in comp:
                if (a ^ b).bit_count() <= 3 and comp[a] > comp[b]:
                    comp[a] = comp[b]
                    changed = True
    assert {(r.fingerprint, r.component_id) for r in got} == {(f"{f:016x}", c) for f, c in comp.items()}
    one = simhash.keep_one(documents(spark, docs))
    assert one.columns == DOCS.replace(",", "").split()[::2]
    assert simhash.near_duplicates(documents(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize("common", [0, 200_000])
def test_keep_one_against_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(simhash, "COMMON", common, raising=False)
    g = random.Random(7)
    rows = [(None, "lone row without id"), (900, None), (901, " \n"), (902, "a b"), (903, "A  b"), (904, "a b c d")]
    for i in range(60):
        base = [f"{g.choice('abcd')}{g.randrange(400)}" for _ in range(g.choice([6, 25, 90, 300]))]
        tail = ["the", "same", "line", "in", "all", "of", "them"] if i % 2 else []
        for j in range(4):
            copy = [*base, *tail]
            for _ in range(g.randrange(1 + len(base) // 40) if j else 0):
                copy[g.randrange(len(base))] = f"e{g.randrange(10**6)}"
            copy += [f"e{g.randrange(10**6)}"] * j
            rows.append((1000 + 10 * i + j, " ".join(copy)))
    g.shuffle(rows)
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    low, links = list(range(len(rows))), 0
    for a in range(len(rows)):
        for b in range(a):
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                links += sets[a] != sets[b]
                low = [low[b] if x == low[a] else x for x in low]
    assert links > 60
    ids = {}
    for (i, _), c in zip(rows, low):
        ids.setdefault(c, []).append(i)
    want = Counter(min(x, key=lambda i: (i is None, i or 0)) for x in ids.values())
    got = simhash.keep_one(documents(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert Counter(r.doc_id for r in got) == want
    assert all((r.doc_id, r.text) in rows for r in got)


def test_keep_one_begins_with_fingerprints(spark, monkeypatch):
    """Pairs that SimHash links are found by it, and compared exactly."""
    import xxhash

    found, link = [], simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda reps: found.append(link(reps)) or spark.createDataFrame(found[0].collect(), "a long, b long"))
    monkeypatch.setattr(simhash, "forget", lambda *dfs: None)
    base = words(300, 1, "abcd").split()
    rows = [(i, " ".join([*base, f"e{i}"])) for i in range(5)] + [(10 + i, words(300, 50 + i, "abcd")) for i in range(5)]
    got = simhash.keep_one(documents(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert sorted(r.doc_id for r in got) == [0, *range(10, 15)]
    sets = {int(np.uint64(xxhash.xxh64_intdigest(simhash.shingles_of(t).tobytes())).view(np.int64)): i for i, t in rows}
    pairs = {frozenset((sets[r.a], sets[r.b])) for r in found[0].collect()}
    assert pairs and all(max(p) < 5 for p in pairs)


def _left(spark):
    """Columns of the tables that are written and not deleted yet."""
    from lodestone.operators import lineage

    return [set(spark.read.parquet(path).columns) for path in lineage._written if "/lodestone-" in path]


def test_keep_one_deletes_what_it_has_read(spark, monkeypatch):
    """Groups are looked for when first shingles and sets of all documents are gone."""
    before, left, groups = len(_left(spark)), [], simhash.similar_groups
    monkeypatch.setattr(simhash, "similar_groups", lambda *tables: left.append(_left(spark)[before:]) or groups(*tables))
    rows = [(i, words(60, i // 2, "ab"), "en", "s") for i in range(20)]
    assert simhash.keep_one(documents(spark, rows)).count() == 10
    assert not [columns for columns in left[0] if "first" in columns]


def test_simhash_deletes_signatures_and_broadcasts_nothing(spark, monkeypatch):
    from lodestone.llm import common

    plans, write = [], simhash.materialise

    def materialise(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(simhash, "materialise", materialise)
    monkeypatch.setattr(common, "materialise", materialise)
    before = len(_left(spark))
    got = simhash.near_duplicates(documents(spark, [(i, words(40, i // 2, "ab"), "en", "s") for i in range(20)]))
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert got.select("component_id").distinct().count() == 10
    assert any("SortMergeJoin" in p for p in plans) and not [p for p in plans if "Broadcast" in p]
    assert not [columns for columns in _left(spark)[before:] if "sig" in columns]


@pytest.mark.parametrize("bucket", [1, 8])
def test_simhash_cuts_large_buckets_again(spark, bucket):
    g = random.Random(5)
    fps = {g.getrandbits(64) for _ in range(20)}
    for f in list(fps)[:6]:
        for _ in range(25):
            x = f
            for _ in range(g.randint(1, 4)):
                x ^= 1 << g.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket=bucket).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 3 for r in links)

    def parts(edges):
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        groups = {}
        for x in signed:
            groups.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, groups.values()))

    everything = [(a, b) for a in signed for b in signed if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3]
    assert parts((r.a, r.b) for r in links) == parts(everything)


def test_language(spark):
    rows = [(i, words(30, i, "abcdeæ"), "xx", "s") for i in range(80)] + [(100 + i, words(30, i, "uvwxyz"), "yy", "s") for i in range(80)]
    rows += [(500, words(40, 999, "abcdeæ") + " " + words(20, 998, "uvwxyz"), None, None), (501, None, "xx", "s"), (502, "12 34 !!", "xx", "s"), (503, "", None, None), (503, "", None, None), (504, words(30_000, 4, "uvwxyz"), None, None)]
    got = langid.identify(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == ("xx" if i < 100 else "yy") for i, *_ in rows[:160])
    assert by[500].lang_pred == "xx" and by[500].langs == ["xx", "yy"] and 0.5 < by[500].score < 0.9
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (501, 502, 503)) and by[504].lang_pred == "yy"
    assert by[3].held_out == (zlib.crc32(b"3") % 4 == 2)
    assert langid.keep_identified(documents(spark, rows)).count() == len(rows) - 4
    assert langid.identify(documents(spark, rows).limit(0)).count() == 0


def labelled(spark, name):
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        text = words(40, i)
        if name == "toxic" and bad:
            text = text[:60] + " horridword " + text[60:]
        if name == "quality" and bad:
            text = "!! ".join(text.upper().split())
        rows.append((i, text, "en" if i % 2 else "de", "s"))
        labels.append((i, int(not bad), int(bad)))
    rows += [(900, None, "en", "s"), (901, "", None, None), (901, "", None, None), (902, words(20_000, 5), "en", "s")]
    return documents(spark, rows), spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark, "toxic")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
    kept = toxicity.keep_harmless(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert {r.predicted for r in toxicity.toxicity(docs.limit(20), labels.limit(0)).collect()} == {0}


def test_toxicity_learns_from_long_texts_alone(spark):
    """Labelled texts of over 2000 words each, told apart by one word somewhere in them."""
    rows = []
    for i in range(320):
        text = random.Random(i).choices(words(300, 500).split(), k=2101)
        if i % 2:
            text[(i * 37) % 2101] = "zzbad"
        rows.append((i, " ".join(text), "en", "s"))
    got = toxicity.toxicity(documents(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(320)], "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 40 and np.mean([r.predicted == r.doc_id % 2 for r in held]) >= 0.9


def test_toxicity_learns_from_all_labelled_rows(spark):
    """A word that only labelled texts have which the fit doesn't begin with."""
    n, per_class = 3000, 60
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(n)], "doc_id long, toxic int")
    docs = documents(spark, [(i, words(30, i), "en", "s") for i in range(n)])
    first = {r.doc_id for r in labelled_sample(docs, labels, "toxic", toxicity.HELD, per_class).select("doc_id").collect()}
    rows = [(i, words(30, i) + ("" if i % 5 else " zzfirst" if i in first else " zzrest"), "en" if i in first else "de", "s") for i in range(n)]
    model = toxicity.train(documents(spark, rows), labels, per_class)
    clean, bad = (model.scores([words(30, i) + end for i in range(n, n + 100)]) for end in ("", " zzrest"))
    assert np.mean(clean < 0.5) > 0.95 and np.mean(bad >= 0.5) > 0.95 and model.langs == ["de", "en"]
    again = toxicity.train(documents(spark, rows), labels, per_class)
    assert (model.vector() == again.vector()).all() and (model.thresholds == again.thresholds).all()


def test_toxicity_score_written_out():
    """One score from embeddings to the threshold, by loops."""
    texts = ["good day to you", "bad word here", "good word", "you bad bad thing"] * 6
    labels, langs = np.array([0, 1, 0, 1] * 6), ["en", "en", "de", "de"] * 6
    m = toxicity.fit([toxicity.word_features(t) for t in texts], labels, langs, epochs=2)
    for text in ("you bad thing", "good", "", "unseen words in here"):
        ids = [toxicity._hashed(w) for w in text.lower().split()]
        emb = [sum(m.emb[i] for i in one) for one in ids] + [np.zeros(toxicity.DIM)] * toxicity.PAD
        logit = float(m.intercept)
        for w, k in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                at = [sum(emb[t + j] @ m.conv[w][j][:, f] for j in range(k) if t + j < len(emb)) for t in range(len(ids))] + [0.0]
                logit += max(0.0, max(at) + m.bias[w, f]) * m.out[w * toxicity.FILTERS + f]
        sums = [sum(m.word_lang[one[0], i] for one in ids) for i in range(len(m.langs))]
        shift = m.thresholds[int(np.argmax(sums))]
        assert math.isclose(m.scores([text])[0], 1 / (1 + math.exp(shift - logit)), rel_tol=1e-4, abs_tol=1e-5)


def test_toxicity_scores_do_not_depend_on_the_batch():
    model = toxicity.Model()
    texts = [words(10, i) for i in range(9)] + ["", None, "one"]
    alone = np.concatenate([model.scores([t]) for t in texts])
    assert np.allclose(alone, model.scores(texts), atol=1e-6)


def test_toxicity_gradients_are_those_of_differences():
    g = np.random.default_rng(3)
    model = toxicity.Model(3)
    model.emb = model.emb.astype(np.float64)
    model.conv = [c.astype(np.float64) for c in model.conv]
    model.bias = model.bias + g.normal(0, 0.1, model.bias.shape)
    texts = [toxicity.word_features(words(12, i)) for i in range(5)] + [toxicity.word_features("")]
    labels, weight = np.array([0, 1, 1, 0, 1, 0.0]), np.array([1, 2, 1, 1, 0.5, 1])
    batch = toxicity.from_words(texts)

    def loss():
        z = model.logits(batch)
        return float((weight * (np.logaddexp(0, z) - labels * z)).mean())

    grads = toxicity.gradients(model, batch, labels, weight)
    rows, sums = grads.pop("emb")
    model.intercept = 0.0
    dense = np.zeros_like(model.emb)
    dense[rows] = sums
    for name, value, grad in [("out", model.out, grads["out"]), ("bias", model.bias, grads["bias"]), ("emb", model.emb, dense), *((f"conv{i}", c, grads[f"conv{i}"]) for i, c in enumerate(model.conv))]:
        flat, want = value.reshape(-1), np.asarray(grad).reshape(-1)
        for i in np.argsort(-np.abs(want))[:12]:
            old, h = flat[i], 1e-4
            flat[i] = old + h
            up = loss()
            flat[i] = old - h
            down = loss()
            flat[i] = old
            assert math.isclose((up - down) / (2 * h), want[i], rel_tol=2e-2, abs_tol=1e-5), (name, i)


def test_toxicity_pools_the_maximum_over_windows_of_words():
    model = toxicity.Model(5)
    for text in ("a", "a b", "c d e f g a", ""):
        batch = toxicity.tokenised([text])
        got, _ = model.pooled(batch)
        x = [model.emb[toxicity._hashed(w)].sum(axis=0) for w in text.split()] + [np.zeros(toxicity.DIM)] * toxicity.PAD
        want = []
        for k, conv, bias in zip(toxicity.WIDTHS, model.conv, model.bias):
            windows = [sum(x[i + j] @ conv[j] for j in range(k)) + bias for i in range(len(text.split()))] + [bias]
            want.append(np.max(windows, axis=0))
        assert np.allclose(got[0], np.concatenate(want), atol=1e-5)
        assert np.allclose(toxicity.Model.pooled(model, toxicity.from_words([toxicity.word_features(text)]))[0], got, atol=1e-5)


def test_quality(spark):
    docs, labels = labelled(spark, "quality")
    got = quality.quality(docs, labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.9 * len(held)
    assert {r.score for r in quality.quality(docs.limit(20), labels.limit(0)).collect()} == {0.5}


def test_quality_risk_has_both_branches():
    g = np.random.default_rng(2)
    x, y = g.normal(1, 1, (40, quality.FEATURES)), g.normal(0, 1, (60, quality.FEATURES))
    seen = set()
    for prior, sign in ((0.3, 1), (0.95, 1), (0.95, -1)):
        m = quality.Network(1)
        m.w[0] *= 0.2
        m.w[2] *= 3 * sign
        value, grad = m.risk(x, y, prior)

        def losses():
            zp, zu = ((np.tanh(np.clip(v, -8, 8) @ m.w[0] + m.w[1]) @ m.w[2] + m.w[3]) for v in (x, y))
            negative = np.mean(np.log(1 + np.exp(zu))) - prior * np.mean(np.log(1 + np.exp(zp)))  # noqa: B023
            return prior * np.mean(np.log(1 + np.exp(-zp))), negative  # noqa: B023

        positive, negative = losses()
        seen.add(negative < 0)
        assert math.isclose(value, positive + max(0, negative), rel_tol=1e-6)
        for w, d in zip(m.w, grad):
            flat, want = w.reshape(-1), d.reshape(-1)
            for i in np.argsort(-np.abs(want))[:5]:
                old = flat[i]
                at = []
                for h in (1e-5, -1e-5):
                    flat[i] = old + h
                    p, q = losses()
                    at.append(-q if negative < 0 else p + q)
                flat[i] = old
                assert math.isclose((at[0] - at[1]) / 2e-5, want[i], rel_tol=1e-3, abs_tol=1e-7)
    assert seen == {True, False}


def test_quality_prior_of_a_known_mixture():
    g = np.random.default_rng(6)
    for share in (0.3, 0.8):
        positives, negatives = g.normal(3, 1, 4000), g.normal(-3, 1, 8000)
        unlabelled = np.concatenate([g.normal(3, 1, int(8000 * share)), negatives[: int(8000 * (1 - share))]])
        assert abs(quality.estimate_prior(positives, unlabelled) - share) < 0.05


def test_quality_features_are_alike_in_other_scripts():
    latin, greek, cyrillic = "Abc def, ghi.", "Αβγ δεζ, ηθι.", "Абв где, жзи."
    shares = [quality.features_of(t)[: quality.CLASSES] for t in (latin, greek, cyrillic)]
    assert np.allclose(shares[0], shares[1]) and np.allclose(shares[0], shares[2])
    f = quality.features_of("漢字かな交じり文。テスト")
    assert f[2] > 0.9 and np.isclose(np.linalg.norm(f[quality.CLASSES + quality.MEASURES :]), 1, atol=1e-3)
    assert not quality.features_of("").any() and not quality.features_of(None).any()
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        rows.append((i, " ".join(words(1, 7 * i + k, "абвгдежз" if good else "абвгдежз!?#") for k in range(30)), "ru", "s"))
        labels.append((int(good), i))
    x = np.array([quality.features_of(t) for _, t, *_ in rows])
    y = np.array([k for k, _ in labels]) == 1
    model = quality.fit(x[y][:150], x[:250])
    score = model.scores(x)
    assert score[y][150:].mean() > score[~y].mean() + 0.3


def test_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.b", "", "block"), ("x.a.b", "/p", "allow"), ("x.a.b", "/p", "block"), ("", "/", "block"), (None, "/", "block"), ("a.b", None, "allow")]
    urls = ["http://example.net/en/1", "https://WWW.Example.NET/en/", "http://example.net", "http://net/x", "ftp://a.b?q", "s://x.a.b/p/q#f", "s://xa.b/", "s://y.x.a.b/q", "no scheme", None, "", "://", "x:///p", "http://evilnet/", "http://a.b/" + "z" * 50_000]
    pages = [(i, u, "html", "k") for i, u in enumerate(urls * 20)] + [(None, "http://net/x", None, "k")]
    got = url_rules.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string, key string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(pages)

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + (p or "")), len(h), v == "block", h + (p or ""), v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        return (host, path, *(max(fits)[3:] if fits else (None, "allow")))

    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got} == {(i, *judge(u)) for i, u, *_ in pages}


def test_merkle(spark):
    rows = [(i, f"A b{i % 7}. C d.\n\nE f! g{i}\nx" * (i % 4), "en", "s") for i in range(60)] + [(70, None, "en", "s"), (71, "", None, None), (72, "é" * 5001, "en", "s"), (73, "A. " * 30_000, "en", "s")]
    got = {r.doc_id: r for r in merkle.compare_edited(documents(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (i, t, *_), (j, u, *_) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        k = len(t) // 2
        edited = t[: len(t) - k] + u[:k]
        import hashlib

        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (edited == t) and (got[i].fingerprint == got[j].fingerprint) == (t == u)
        assert 0 <= got[i].near_edited <= 1 and (got[i].near_edited == 1 or edited != t) and (got[i].near_next == 1 or t != u)
    tree = lambda c: merkle.merkle_tree(F.col(c))
    trees = spark.createDataFrame([("a. b.\n\nc.\n\nd.", "new.\n\na. b.\n\nx.\n\nd."), ("a. b.\nc.", "c.\na. b."), ("a. a.", "a.")], "a string, b string")
    got = trees.select(F.size(merkle.edited_leaves(tree("a"), tree("b"))).alias("gone"), F.size(merkle.edited_leaves(tree("b"), tree("a"))).alias("came"), merkle.likeness(merkle.nodes(tree("a")), merkle.nodes(tree("b"))).alias("near")).collect()
    assert [(r.gone, r.came) for r in got] == [(1, 2), (0, 0), (1, 0)] and all(0 < r.near < 1 for r in got)
    assert merkle.compare_edited(documents(spark, rows).limit(0)).count() == 0
    hot = [(None, f"x{i}", None, None) for i in range(40)] + [(3, f"z{i}.", None, None) for i in range(40)] + [(4, "q", None, None)]
    got = merkle.with_next(documents(spark, hot)).collect()
    import hashlib

    order = sorted(hot, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    assert {(r.doc_id, r.text, r.next_text) for r in got} == {(i, t, u) for (i, t, *_), (_, u, *_) in zip(order, order[1:] + order[:1])}


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    from lodestone.llm.queries import tokenizer_file

    df = documents(spark, [*docs, (400, " a  b \n c\n\n d <|endoftext|> ", "en", "s")])
    got = packing.pack(df, tokenizer_file()).collect()
    tk = Tokenizer.from_file(tokenizer_file())
    want = Counter()
    for i, t in [(r.doc_id, r.text) for r in df.collect()]:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for s, e in packing.cuts(len(ids), 1024):
            want[i, s, e - s, zlib.crc32(ids[s:e].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 1024
    assert packing.pack(df.limit(0), tokenizer_file()).count() == 0


def test_packing_plan_uses_up_the_histogram():
    g = np.random.default_rng(1)
    hist = Counter(np.minimum(256, np.exp(g.normal(4, 1, 20_000)).astype(int) + 1).tolist())
    plan = packing.plan(dict(hist), 256)
    used = Counter()
    for times, pattern in plan:
        assert sum(k * v for k, v in pattern.items()) <= 256
        used.update({k: v * times for k, v in pattern.items()})
    assert used == hist
    assert sum(t for t, _ in plan) <= 1.02 * sum(k * v for k, v in hist.items()) / 256 + 1


def test_pst(spark, docs):
    rows = [*docs, *((600 + i, " ".join(["the cat sat on the mat"] * 30), "en", "s") for i in range(40))]
    got = pst.score_documents(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    token = [(i, (t or "").encode().lower().split() + [None]) for i, t, *_ in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, x in token if not held(i) for w in x)
    n, v = sum(c.values()), len(c)
    base = Counter((i, len(x), sum(c[w] > 0 for w in x), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), 4)) for i, x in token)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == base
    assert all(r.train_tokens == n and r.held_out == held(r.doc_id) for r in got)
    assert all(r.score > r.base_score for r in got if r.doc_id and r.doc_id >= 600)
    assert pst.score_documents(documents(spark, rows).limit(0)).count() == 0


def brute_scores(token, held):
    """token: id -> tokens; what pst.score_documents does, by dictionaries."""
    train = [x for i, x in token.items() if not held(i)]
    c = Counter(w for x in train for w in x)
    n, v = sum(c.values()), len(c)
    after = Counter((tuple(x[j - k : j]), x[j]) for x in train for j in range(len(x)) for k in range(1, pst.DEPTH + 1) if j >= k)
    size = Counter()
    for (s, _), k in after.items():
        size[s] += k
    size = {s: k for s, k in size.items() if k >= pst.LEAST}
    root = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))

    def unpruned(s, w):
        return (after[s, w] + pst.PARENT * unpruned(s[1:], w)) / (size[s] + pst.PARENT) if s else root(w)

    gains = {s: [0] * len(pst.SMOOTHS) for s in size}
    for (s, w), k in after.items():
        if s in size:
            q = unpruned(s[1:], w)
            for i, m in enumerate(pst.SMOOTHS):
                gains[s][i] += k * round((math.log(k - 1 + m * q) - math.log(size[s] - 1 + m) - math.log(q)) * pst.UNITS)
    kept = {s: pst.SMOOTHS[g.index(max(g))] for s, g in gains.items() if max(g) > 0}
    out = {}
    for i, x in token.items():
        total = 0
        for j, w in enumerate(x):
            p = root(w)
            for k in range(1, pst.DEPTH + 1):
                s = tuple(x[j - k : j])
                if j >= k and s in kept:
                    p = (after[s, w] + kept[s] * p) / (size[s] + kept[s])
            total += math.log10(p)
        out[i] = total
    return out, size, kept


@pytest.mark.parametrize(("block", "part", "bits"), [(8 << 20, 32 << 20, 12), (300, 32 << 20, 12), (900, 60, 12), (900, 400, 6)])
def test_pst_against_brute_force(spark, monkeypatch, block, part, bits):
    """One block and many, salted words and pairs, a filter that is nearly full: the same scores."""
    for name, value in (("LEAST", 5), ("ROOTS", 0), ("BLOCK_BYTES", block), ("PART_BYTES", part), ("FILTER_BITS", (bits, bits))):
        monkeypatch.setattr(pst, name, value)
    g = random.Random(2)
    rows = [(i, " ".join(g.choices(["a", "b", "a b c", "x y z a b", "c", "the of the", f"r{i}"], k=40)), "en", "s") for i in range(60)]
    report = []
    got = {r.doc_id: r.score for r in pst.score_documents(documents(spark, rows), report).collect()}
    token = {i: t.encode().split() + [None] for i, t, *_ in rows}
    want, size, kept = brute_scores(token, lambda i: zlib.crc32(str(i).encode()) % 10 == 0)
    by_depth = Counter(len(s) for s in size if s[-1] is not None)
    assert [x.where("n >= 5").count() for x in report[0]][0] >= by_depth[1] and set(by_depth) == {1, 2, 3, 4}
    assert report[1].select("state").distinct().count() == len(kept)
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_pst_does_not_depend_on_the_order_of_rows(spark, monkeypatch, docs):
    monkeypatch.setattr(pst, "BLOCK_BYTES", 2000)
    df = documents(spark, docs)
    one = sorted((str(r) for r in pst.score_documents(df.repartition(5)).collect()))
    assert one == sorted(str(r) for r in pst.score_documents(df.coalesce(1).sortWithinPartitions("lang", "text")).collect())


TAKEN = "doc_id long, text string, lang string, source string, n_chars long, row long, copies string, copy int, k1 long, K2 long, toxicity double, mixture string"


def pipeline_tables(spark, folder, rows, labels):
    """Documents with columns whose names the stages use themselves."""
    spark.createDataFrame([(i, t, lang, s, len(t or ""), 7, "c", 8, 9, 10, 0.9, "m") for i, t, lang, s in rows], TAKEN).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_keep_the_rows_they_should(spark, tmp_path):
    """Each stage's rows against those expected of what the one before kept."""
    import corpus_pipeline as pipeline

    rows = [(i, words(40, i, "abcdeæ" if i % 2 else "uvwxyz"), "xx" if i % 2 else "yy", f"s{i % 3}") for i in range(240)]
    labels = [(i, 1, int(i % 8 in (0, 3))) for i in range(240)]
    rows = [(i, t + " horridword" if i % 8 in (0, 3) else t, lang, s) for i, t, lang, s in rows]
    copied = words(60, 5000, "abcdeæ")
    rows += [(300 + i, copied, "xx", "s0") for i in range(4)] + [(310, copied + " zz", "xx", "s1"), (311, None, "xx", "s0"), (312, "", None, None), (313, "12 34", "xx", "s1"), (None, words(30, 77, "uvwxyz"), None, None)]
    rows += [(320, words(35, 88, "uvwxyz"), "yy", "s2")] * 2
    pipeline_tables(spark, str(tmp_path), rows, labels)
    docs, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "language", "near_duplicates", "mixing", "packing"]
    kept = [docs]
    for name in list(stages)[:-1]:
        kept.append(pipeline.materialise(stages[name](spark, kept[-1], str(tmp_path))))
        assert kept[-1].columns == docs.columns and kept[-1].where("row = 7 AND copies = 'c' AND copy = 8 AND k1 = 9 AND K2 = 10 AND toxicity = 0.9 AND mixture = 'm'").count() == kept[-1].count() > 0
    bag = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    toxic, language, unique, mix = map(bag, kept[1:])
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    judged = Counter((r.doc_id, r.text) for r in toxicity.with_scores(docs, toxicity.train(docs, labels), "score").where("score < 0.5").collect())
    everything = Counter((i, t) for i, t, *_ in rows)
    assert toxic == judged and all(everything[k] == n for k, n in toxic.items())
    assert language == Counter({k: n for k, n in toxic.items() if k[1] not in (None, "", "12 34")})
    copies = sorted(i for i, _ in language if i in (300, 301, 302, 303, 310))
    assert unique == Counter({k: 1 for k in language if k[0] not in copies[1:]})
    wanted = {(r.doc_id, r.text): r.copies for r in pipeline.mixing.mix(kept[3], carry=("text",)).collect() if r.copies}
    assert mix == Counter(wanted)
    out = pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in out.where("start = 0").collect()) == Counter(i for (i, _), n in mix.items() for _ in range(n))


def test_stages_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    pipeline_tables(spark, str(tmp_path), [], [])
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_operators_on_empty_tables(spark):
    docs, labels = documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for got in (toxicity.toxicity(docs, labels), quality.quality(docs, labels), langid.identify(docs), pst.score_documents(docs), mixing.mix(docs), merkle.compare_edited(docs)):
        assert got.count() == 0
    assert itq.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = "page_id long, url string, html string, key string, pid int"
    assert url_rules.judge_urls(spark.createDataFrame([], pages), none).count() == 0
    got = url_rules.judge_urls(spark.createDataFrame([(1, "http://a.b/c", "", "k", 1)], pages), none).collect()
    assert [(r.page_id, r.rule, r.verdict) for r in got] == [(1, None, "allow")]


def test_language_mixture_of_one_text_by_hand(monkeypatch):
    """Expectation-maximisation written out for two languages; and a text alone as in a batch."""
    g = np.random.default_rng(8)
    log_p = np.log(np.stack([g.dirichlet(np.full(langid.GRAMS, 0.05)) + 1e-9 for _ in range(2)]))
    model = langid.Languages(["a", "b"], log_p)
    texts = [words(n, n, "abcdef") for n in (3, 20, 60)] + ["", None, "q"]
    for text in texts[:3]:
        grams = langid.grams_of(text)
        p = np.exp(log_p[:, grams])
        pi = np.array([0.5, 0.5])
        for _ in range(langid.ROUNDS):
            part = p * pi[:, None]
            pi = (part / part.sum(axis=0)).sum(axis=1) / len(grams)
        best = int(np.argmax(pi))
        one = np.log(p[best]).sum()
        mixed = pi.copy()
        for _ in range(langid.REFINE):
            part = p * mixed[:, None]
            mixed = (part / part.sum(axis=0)).sum(axis=1) / len(grams)
        two = np.log((p * mixed[:, None]).sum(axis=0)).sum() - langid.PENALTY * np.log(max(2, len(grams))) / 2
        name, share, chosen, gain = model.mixtures([text])
        want = 1.0 if one >= two else mixed.max()
        assert name[0] == ("ab"[best] if one >= two else "ab"[int(np.argmax(mixed))]) and np.isclose(share[0], want, atol=1e-6)
        assert len(chosen[0]) == (1 if one >= two else 2)
        assert np.isclose(gain[0], (one if one >= two else np.log((p * mixed[:, None]).sum(axis=0)).sum()) / len(grams) + np.log(langid.GRAMS), atol=1e-6)
    whole = model.mixtures(texts * 3)
    for i, text in enumerate(texts * 3):
        alone = model.mixtures([text])
        assert alone[0][0] == whole[0][i] and np.isclose(alone[1][0], whole[1][i]) and alone[2][0] == whole[2][i]
