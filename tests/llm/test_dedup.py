import hashlib
import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placework import session
from placework.llm import dart_minhash as D
from placework.llm import exact_dedup as E
from placework.llm.common import counted_shingles, keep_rows, link_classes, work_folder


def brute_exact(rows):
    best, size = {}, {}
    for k, (doc_id, text) in enumerate(rows):
        text = text or ""
        size[text] = size.get(text, 0) + 1
        if text not in best or (doc_id is not None and (best[text] is None or doc_id > best[text])):
            best[text] = doc_id
    return best, size


@pytest.mark.parametrize("digests", [E.DIGESTS, (lambda t: F.length(t).cast("string"), *E.DIGESTS)])
def test_exact_groups(spark, hard, empty, digests):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    best, size = brute_exact(rows)
    got = E.exact_groups(hard, digests).collect()
    assert len(got) == len(rows)
    digest = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in rows}
    for r in got:
        assert (r.keep_id, r.group_size) == (best[digest[r.text_sha256]], size[digest[r.text_sha256]])
    assert sum(r.kept for r in got) == len(best)
    assert E.exact_groups(empty, digests).collect() == []
    kept = E.drop_copies(hard)
    assert kept.columns == hard.columns and kept.count() == len(best)
    assert E.drop_copies(empty).collect() == []


def test_state_outlives_a_query(spark, folder):
    keys, state, out = folder("keys"), folder("state"), folder("out")
    row = "doc_id long, digest string, locator string, row long"
    spark.createDataFrame([(1, "a", "f", 0), (2, "b", "f", 1)], row).write.parquet(keys)
    E.stream_keys(spark, keys, state, out)
    spark.createDataFrame([(5, "a", "g", 2), (3, "c", "g", 3)], row).write.mode("append").parquet(keys)
    E.stream_keys(spark, keys, state, out)
    got = {r.digest: (r.keeper.doc_id, r.keeper.locator, r.group_size) for r in E.latest_states(spark, out).collect()}
    assert got == {"a": (5, "g", 2), "b": (2, "f", 1), "c": (3, "g", 1)}


def test_keep_rows_takes_one_of_equal_rows(spark, hard):
    kept = hard.where("doc_id = 9").select("doc_id", F.sha2("text", 256).alias("digest")).distinct()
    assert keep_rows(hard, kept).count() == 1


def near_texts(seed=3):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.choice([8, 60, 300]))]
        for rate in (0, 0, 0.005, 0.01, 0.02, 0.05, 0.2):
            rows.append(" ".join(r.choice(words) if r.random() < rate else w for w in base))
    rows += ["", None, "one two", "one two", "a b c d e", " \n "] + [" ".join(["again and"] * 900)] * 2
    return [(k if k != 5 else None, t) for k, t in enumerate(rows)]


def test_classes_are_those_of_all_pairs(spark):
    rows = near_texts()
    docs = spark.createDataFrame([(*row, "own", 1) for row in rows], "doc_id long, text string, bucket string, uid long").repartition(5)
    texts = [(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    distinct = sorted(set(texts))
    near = {(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if D.similarities([a.encode()], [b.encode()])[0] >= 0.8}
    for a in range(len(rows)):
        for b in range(a):
            if texts[a] == texts[b] or (texts[a], texts[b]) in near or (texts[b], texts[a]) in near:
                root[find(a)] = find(b)
    want = {}
    for k, (doc_id, _) in enumerate(rows):
        want.setdefault(find(k), []).append(doc_id)
    got = {}
    for r in D.near_classes(docs).collect():
        got.setdefault(r.class_id, []).append(r)
    assert sorted(sorted((x.doc_id is None, x.doc_id) for x in g) for g in got.values()) == sorted(sorted((d is None, d) for d in g) for g in want.values())
    for class_id, members in got.items():
        assert sum(m.kept for m in members) == 1 and {m.class_size for m in members} == {len(members)}
        assert class_id == min((m.doc_id for m in members if m.doc_id is not None), default=None)
    kept = D.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)


def test_similarity_counts_how_often_shingles_occur():
    a, b = b"a b c d e a b c d e f", b"a b c d e f"
    # 7 shingles, one twice, against 2 of them.
    assert D.similarities([a], [b])[0] == pytest.approx(2 / 7)
    assert D.similarities([b""], [b""])[0] == 0


def test_sketches_estimate_similarity_whatever_the_weights():
    rng = np.random.default_rng(4)
    elements = rng.integers(1, 1 << 60, 300).astype(np.uint64)
    a, b = rng.gamma(0.5, 40, 300), rng.gamma(0.5, 40, 300)
    both = np.concatenate([elements, elements])
    sketch, some = D.dart_sketches(both, np.concatenate([a, b]), np.repeat([0, 1], 300), 3, 4000)
    assert some.tolist() == [True, True, False]
    assert (sketch[0] == sketch[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_marks_of_similar_sets_are_near():
    rng = np.random.default_rng(6)
    shared, own = rng.integers(1, 1 << 60, 800).astype(np.uint64), rng.integers(1, 1 << 60, 200).astype(np.uint64)
    elements = np.concatenate([np.append(shared, own[:100]), np.append(shared, own[100:]), own])
    sketch, _ = D.dart_sketches(elements, np.ones(len(elements)), np.repeat([0, 1, 2], [900, 900, 200]), 3)
    marks = [[bin(int(v) & (2**64 - 1)) for v in part] for part in D.sketch_marks(sketch)]
    apart = lambda a, b: sum(bin(int(m[a], 2) ^ int(m[b], 2)).count("1") for m in marks)
    assert apart(0, 1) <= D.MARKS_APART < apart(0, 2)


def test_shingles_do_not_depend_on_the_batch():
    texts = [b"a b c d e f a b c d e", b"", b"x y", b" ", b"q " * 50]
    shingles, counts, owner = counted_shingles(texts)
    for k, text in enumerate(texts):
        own = counted_shingles([text])
        assert (shingles[owner == k] == own[0]).all() and (counts[owner == k] == own[1]).all()


def test_hard_rows(spark, hard, empty):
    rows = D.near_classes(hard).collect()
    assert len(rows) == hard.count()
    assert {(r.doc_id, r.class_id, r.class_size) for r in rows} >= {(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2), (5, 5, 1), (None, None, 1), (9, 9, 2)}
    assert D.near_classes(empty).collect() == []
    assert D.drop_near_copies(empty).columns == empty.columns


def test_link_classes(spark):
    r = random.Random(1)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(80)] + [(7, 7)]
    root = {n: n for pair in links for n in pair}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    linked = {n for a, b in links for n in (a, b) if a != b}
    got = {x.id: x.root for x in link_classes(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    assert got == {n: root[n] for n in linked}
    assert link_classes(spark.createDataFrame([], "a long, b long"), "test").collect() == []
    assert work_folder(spark, "x") != work_folder(spark, "x")


def crowd_texts(crowd=2400, planted=40, seed=8):
    """Texts with a common template, 0.75 to 0.79 to each other, and pairs of them at about 0.81 that nothing else links."""
    r = random.Random(seed)
    template = [f"t{k}" for k in range(300)]
    rows = []
    for k in range(crowd):
        own = [f"o{k}-{j}" for j in range(r.randint(39, 44))]
        rows.append(" ".join(template + own))
        if k < planted:
            # 14 more words in common than the template: (296 + 14) / (2 * 335 - 310) and above.
            rows.append(" ".join(template + own[:10] + [f"p{k}-{j}" for j in range(len(own) - 10)]))
    order = list(range(len(rows)))
    r.shuffle(order)
    return [rows[k] for k in order]


def all_links(texts, least=D.SIMILARITY):
    """Links of all pairs, by a matrix of the shingles' weights."""
    from collections import Counter, defaultdict

    bags = [Counter(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    have = defaultdict(list)
    for k, bag in enumerate(bags):
        for shingle, n in bag.items():
            have[shingle].append((k, n))
    shared = np.zeros((len(texts), len(texts)), np.int32)
    crowds = Counter()
    for rows in have.values():
        if len(rows) == len(texts) and all(n == 1 for _, n in rows):
            crowds["all"] += 1
            continue
        ids, counts = np.array([k for k, _ in rows]), np.array([n for _, n in rows], np.int32)
        if len(ids) > 1:
            shared[np.ix_(ids, ids)] += np.minimum.outer(counts, counts)
    shared += crowds["all"]
    total = np.array([sum(b.values()) for b in bags])
    similar = shared / (np.add.outer(total, total) - shared)
    return similar, {(a, b) for a, b in np.argwhere(similar >= least).tolist() if a < b}


@pytest.mark.parametrize("nearest, together", [(D.NEAREST, D.ORDERED_TOGETHER), (1, 50)])
def test_pairs_inside_a_crowd_are_found(spark, monkeypatch, nearest, together):
    monkeypatch.setattr(D, "NEAREST", nearest)
    monkeypatch.setattr(D, "ORDERED_TOGETHER", together)
    texts = crowd_texts()
    similar, links = all_links(texts)
    inside = similar[np.triu_indices(len(texts), 1)]
    assert len(links) == 40 and 0.74 < inside.min() and np.median(inside) < 0.79 and similar[tuple(zip(*links))].max() < 0.85
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in D.near_classes(docs).collect()}
    assert {(a, b) for b, a in got.items() if a != b} == links


def test_rare_pairs_lose_none(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(30):
        base = [r.choice(words) for _ in range(r.choice([3, 12, 80, 200]))]
        for rate in (0, 0.005, 0.01, 0.02, 0.04):
            texts.append(" ".join(r.choice(words) if r.random() < rate else w for w in base + base[: r.randrange(9)]))
    texts = sorted(set(texts))
    root = [k if r.random() < 0.5 else -r.randrange(3) for k in range(len(texts))]
    want = {(a, b) for a in range(len(texts)) for b in range(a) if root[a] != root[b] and D.similarities([texts[a].encode()], [texts[b].encode()])[0] >= D.SIMILARITY}
    assert len(want) > 60
    rows = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    crowded = spark.createDataFrame(list(enumerate(root)), "uid long, root long")
    for counters, apart, together in [(D.COUNTERS, D.TAKEN_APART, D.PAIRED_TOGETHER), (64, 0, 3), (D.COUNTERS, 0, 1)]:
        monkeypatch.setattr(D, "COUNTERS", counters)
        monkeypatch.setattr(D, "TAKEN_APART", apart)
        monkeypatch.setattr(D, "LOOKED_AT", 1 << 20 if apart else 50)
        monkeypatch.setattr(D, "PAIRED_TOGETHER", together)
        got = {(x.a, x.b) for x in D._rare_pairs(crowded, rows, D.SIMILARITY).collect()}
        assert want <= got and all(root[a] != root[b] for a, b in got)


def slotted_texts(n, slots=12, values=20, planted=10, seed=3):
    """Texts of one template of 300 words with slots of some values each, about 0.68 to each other, and pairs that differ in two words."""
    r = random.Random(seed)
    template = [f"t{k}" for k in range(300)]
    rows = []
    for _ in range(n):
        words = list(template)
        for slot in range(slots):
            words[24 * slot + 9] = f"s{slot}v{r.randrange(values)}"
        rows.append(words)
    for k in range(planted):
        words = list(rows[k])
        words[3], words[150] = f"x{k}", f"y{k}"
        rows.append(words)
    return [" ".join(words) for words in rows]


def test_pairs_of_a_slotted_template_grow_with_its_texts(spark):
    made = {}
    for n in (250, 500, 1000):
        texts = slotted_texts(n)
        rows = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").repartition(4)
        got = {(x.a, x.b) for x in D._rare_pairs(rows.selectExpr("uid", "uid as root"), rows, D.SIMILARITY).collect()}
        assert {(n + k, k) for k in range(10)} <= got
        made[n] = len(got)
    # All pairs would be 31,125, 124,750 and 499,500; nearly all that are left are the planted ones and chance likenesses.
    assert made[1000] <= 2 * made[500] + 500 and made[1000] < 3000


def test_classes_of_a_slotted_template_are_those_of_all_pairs(spark):
    texts = slotted_texts(600)
    _, links = all_links(texts)
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not changed:
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in D.near_classes(docs).collect()} == dict(enumerate(root))


def test_parity_bits_never_exceed_the_difference():
    r = random.Random(9)
    for _ in range(200):
        base = [f"w{r.randrange(50)}" for _ in range(r.randrange(1, 400))]
        other = [w if r.random() > r.choice([0.01, 0.2]) else "x" for w in base] + ["y"] * r.randrange(3)
        texts = [" ".join(base).encode(), " ".join(other).encode()]
        shingles, weights, owner = counted_shingles(texts)
        bags = [dict(zip(shingles[owner == k].tolist(), weights[owner == k].tolist())) for k in (0, 1)]
        differ = sum(abs(bags[0].get(s, 0) - bags[1].get(s, 0)) for s in set(bags[0]) | set(bags[1]))
        bits = D.parity_bits(shingles, weights, owner, 2)
        assert np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum() <= differ


def test_plans_do_not_grow_with_the_rounds(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    # Each text is similar to its neighbours only, so that classes are joined in several rounds.
    texts = [" ".join(words[8 * k : 8 * k + 100]) for k in range(36)]
    _, links = all_links(texts)
    assert links == {(k, k + 1) for k in range(35)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    numbers = itertools.count()
    for module in (session, D):
        monkeypatch.setattr(module, "work_folder", lambda _, purpose: str(tmp_path / f"{purpose}-{next(numbers)}"), raising=False)
    assert {r.class_id for r in D.near_classes(docs).collect()} == {0}
    for name in ("near-pairs", "near-links"):
        tables = list(tmp_path.glob(f"{name}-*"))
        assert len(tables) == 1 and len(list(tables[0].glob("part=*"))) > 2


def test_memory_for_a_batch_of_texts_is_bounded():
    rng = random.Random(4)
    texts = [" ".join(f"{rng.randrange(10**5)}" for _ in range(350)) for _ in range(1900)]
    assert 3 << 20 < sum(map(len, texts)) < 4 << 20
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(["d"] * len(texts)), pa.array(texts)], names=["uid", "doc_id", "digest", "content"])
    pairs = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts), pa.array(texts)], names=["a", "b", "text_a", "text_b"])
    for worker, given in ((D._band_rows, batch), (D._compare, pairs)):
        tracemalloc.start()
        rows = sum(out.num_rows for out in worker(iter([given])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == len(texts) and peak < 110 << 20
