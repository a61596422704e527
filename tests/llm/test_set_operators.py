from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from gleanframe.llm import mixing, nearcopies, neighbours, topn
from gleanframe.llm.common import canonical_text, words

random.seed(3)


# ---- top N


def test_top_n_ties_nulls_and_a_hot_group(spark):
    rows = [("hot", f"d{i:04}", float(i % 50)) for i in range(3000)]
    rows += [("q", "b", 1.0), ("q", "a", 1.0), ("q", "a", 0.5), ("q", "c", None), ("q", "d", float("nan")), (None, "a", 1.0), ("q", None, 9.0), ("q", "z", -0.0), ("q", "y", 0.0), ("q", "i", float("inf"))]
    got = {}
    for r in topn.top_per_group(spark.createDataFrame(rows, "query_id string, doc_id string, score double"), "query_id", "doc_id", "score", 10).collect():
        got.setdefault(r.query_id, {})[r.pos] = r.doc_id
    assert [got["q"][k] for k in sorted(got["q"])] == ["i", "a", "b", "y", "z"]
    assert [got["hot"][k] for k in range(1, 11)] == [f"d{i:04}" for i in range(3000) if i % 50 == 49][:10]
    assert set(got) == {"q", "hot"}
    none = spark.createDataFrame([], "query_id string, doc_id string, score double, pos int")
    assert topn.top_per_group(none, "query_id", "doc_id", "score").count() == 0


# ---- near copies


def plain_pairs(items, n, t):
    sets = {}
    for k, x in items:
        if k is not None:
            w = words(x)
            sets[k] = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, canonical_text(x))
    keys = sorted(sets)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a][0], sets[b][0]
            if x and y and len(x & y) >= t * len(x | y) and sets[a][1] != sets[b][1]:
                out.add((a, b))
    return out


def family(size):
    base = [random.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(random.randint(0, 40)) for _ in range(size)]
    for _ in range(random.randint(2, 5)):
        mine = list(base)
        for _ in range(random.randint(0, max(1, size // 6))):
            k = random.randrange(len(mine))
            mine[k : k + random.randint(0, 2)] = [f"new{random.randint(0, 99)}"] * random.randint(0, 2)
            mine = mine or ["x"]
        yield mine


@pytest.mark.parametrize("n, t, bound", [(3, 0.5, None), (3, 0.5, 3), (3, 0.5, 10_000), (5, 0.8, None), (1, 0.5, 12)])
def test_near_copies_are_exact(spark, monkeypatch, n, t, bound):
    random.seed(n * 100 + (bound or 0))
    items = []
    for size in [1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 35, 60, 120] * 3:
        for mine in family(size):
            items.append((f"k{len(items):04}", random.choice([" ", "\n", ", "]).join(mine)))
    items += [("c1", "one two three four five six"), ("c2", "One  two-three four FIVE six"), ("c3", "one two three four five six seven"), ("j1", '{"a b": "c d e f g h"}'), ("j2", '{"a": "b c d e f g h"}'), ("n", None), ("e", ""), (None, "one two three four five six"), items[0], items[5]]
    if bound:
        monkeypatch.setattr(nearcopies, "light_bound", lambda shared, threshold: spark.createDataFrame([(bound,)], "bound bigint"))
    got = [tuple(r) for r in nearcopies.near_copies(spark.createDataFrame(items, "doc_id string, text string"), n=n, threshold=t).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_pairs(items, n, t)


def test_near_copies_of_nothing(spark):
    assert nearcopies.near_copies(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_packed_numbers_come_back():
    for x in ([], [5], [0, 1, 2**40 - 1], sorted(random.sample(range(2**40), 50)), sorted(random.sample(range(2**22), 500))):
        a = np.array(x, np.uint64)
        assert (nearcopies._unpack(nearcopies._pack(a, 5), 5) == a).all()
        assert (nearcopies._unpack_sorted(nearcopies._pack_sorted(a)) == a).all()
        assert (nearcopies._unpack_sorted(nearcopies._pack_sorted(np.concatenate([a, a]))) == np.concatenate([a, a])).all()
        assert (nearcopies._wide(nearcopies._small(a % np.uint64(1 << 20))) == a % np.uint64(1 << 20)).all()


# ---- neighbours


def test_hilbert_keys_walk_to_neighbours():
    for bits, n in ((3, 2), (2, 3), (1, 5)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
        keys = neighbours.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(neighbours, "WINDOW", 64)
    base = rng.standard_normal((150, 128))
    x = np.vstack([base + 0.35 * rng.standard_normal(base.shape) for _ in range(8)]).astype(np.float32)
    x[7] = x[3]
    rows = [(f"h{i:04}", [float(v) for v in r]) for i, r in enumerate(x)]
    equal = [(f"e{i:03}", [1.0] * 128) for i in range(40)]
    bad = [("b1", None), ("b2", [0.0] * 128), ("b3", [float("nan")] + [1.0] * 127), ("b4", [1.0] * 127), (None, [1.0] * 128), ("b5", [None] + [1.0] * 127), rows[0]]
    df = spark.createDataFrame(rows + equal + bad, "content_hash string, vec array<float>")
    got = {}
    for r in neighbours.most_similar(df, "content_hash", "vec", 5).collect():
        got.setdefault(r.key_a, {})[r.key_b] = r.cosine
    assert set(got) == {k for k, _ in rows + equal} and all(len(v) == 5 and k not in v for k, v in got.items())
    assert set(got["e007"]) == {"e000", "e001", "e002", "e003", "e004"} and set(got["e000"]) == {f"e00{i}" for i in range(1, 6)}
    assert got["h0007"]["h0003"] == pytest.approx(1)
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1)[:, None].astype(np.float64)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, j) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.6}
    hit = sum(f"h{j:04}" in got[f"h{i:04}"] for i, j in want)
    assert len(want) > 3000 and hit >= 0.9 * len(want)


def test_a_dense_window_proposes_all_true_neighbours():
    rng = np.random.default_rng(2)
    x = rng.standard_normal(128) + 0.045 * rng.standard_normal((600, 128))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    small = np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)
    i, j = neighbours._window_pairs([bytes(8) + s.tobytes() for s in small], 600, 128, 5, 0.8)
    proposed = set(zip(i.tolist(), j.tolist()))
    s = unit @ unit.T
    assert np.median(s) > 0.99
    for a in range(600):
        for b in a + 1 + np.argsort(-s[a, a + 1 :])[:5]:
            assert (a, int(b)) in proposed
        for b in np.argsort(-s[a, :a])[:5]:
            assert (int(b), a) in proposed


def test_neighbours_do_not_depend_on_the_ranges(spark, monkeypatch):
    """With windows far below the table, in one range and in some hundred."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(neighbours, "WINDOW", 32)
    base = rng.standard_normal((500, 128))
    x = np.vstack([base + 0.5 * rng.standard_normal(base.shape) for _ in range(6)]).astype(np.float32)
    df = spark.createDataFrame([(f"h{i:04}", [float(v) for v in r]) for i, r in enumerate(x)], "content_hash string, vec array<float>")
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1)[:, None].astype(np.float64)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"h{i:04}", f"h{j:04}") for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.7}
    hits = []
    for windows in (10_000, 5):
        monkeypatch.setattr(neighbours, "RANGE_WINDOWS", windows)
        hits.append(len(want & {(r.key_a, r.key_b) for r in neighbours.most_similar(df, "content_hash", "vec", 5, min_cosine=0.7).collect()}))
    assert len(want) > 5000 and min(hits) >= 0.9 * len(want)
    assert hits[1] >= 0.999 * hits[0]


def test_neighbours_of_nothing(spark):
    assert neighbours.most_similar(spark.createDataFrame([], "content_hash string, vec array<float>"), "content_hash", "vec").count() == 0


# ---- mixing

needs_vocab = pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.json"), reason="no vocabulary here")
DOCS, TARGETS = "doc_id bigint, text string, source string, tokens int", "source string, target_share double, max_repeats bigint"


@needs_vocab
def test_mix_meets_its_targets(spark):
    random.seed(4)
    own = {"code": "def return class import self".split(), "news": "today minister said market report".split(), "chat": "hello lol yes thanks bye".split(), "other": "zzz yyy".split()}
    docs = []
    for i in range(1200):
        s = random.choices(list(own), [8, 3, 1, 1])[0]
        docs.append((i, " ".join(random.choices(own[s], k=random.randint(20, 60))), s if i % 20 else None, 0))
    docs += [(5001, None, "code", 0), (5002, "", "news", 0), (None, "def return", "code", 0), (5003, "def class " * 20, "  ", 0)]
    targets = spark.createDataFrame([("code", 0.4, 1), ("news", 0.3, 2), ("chat", 0.2, 3), ("absent", 0.1, 5), (None, 0.5, 1), ("chat", 0.2, None)], TARGETS)
    mix, report = mixing.mix_sources(spark.createDataFrame(docs, DOCS), targets)
    got, shares = mix.collect(), {r.source: r for r in report.collect()}
    caps = {"code": 1, "news": 2, "chat": 1}
    assert {r.source for r in got} <= {"code", "news", "chat", None}
    assert all(1 <= r.repeats <= caps.get(r.source, 2) for r in got) and not {5001, 5002, None} & {r.doc_id for r in got}
    for s, t in (("code", 4 / 9), ("news", 3 / 9), ("chat", 2 / 9)):
        assert shares[s].aim_share == pytest.approx(t) and shares[s].reached_share == pytest.approx(t, abs=0.02)
    assert shares["absent"].reached_share == 0 and shares["absent"].documents == 0


@needs_vocab
def test_mix_of_nothing(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    mix, report = mixing.mix_sources(docs, targets)
    assert mix.count() == 0 and report.first().reached_share == 0
    mix, report = mixing.mix_sources(docs, targets.where("false"))
    assert mix.count() == 0 and report.count() == 0


def members_of(posterior, names, model, caps):
    batch = pa.RecordBatch.from_pydict({"source": pa.array([None], pa.string()), "tokens": pa.array([10], pa.int64()), "posterior": pa.array([posterior], pa.list_(pa.float64()))})
    _, member, cap = mixing._members(batch, names, model, np.array(caps, float))
    return member[0].tolist(), cap[0]


def test_rows_without_a_source_keep_a_cap():
    member, cap = members_of([0.6, 0.3, 0.1], ["a", "b"], ["a", "b", "untargeted"], [2, 1])
    assert member == [0.6, 0.3] and cap == pytest.approx(1.5)
    many = [f"s{i:02}" for i in range(40)]
    assert members_of([1 / 40] * 40, many, many, [1] * 40)[1] == pytest.approx(1)
    assert members_of([0.5, 0.5], ["a", "b"], ["a", "b"], [0, 2])[1] == pytest.approx(1)
    assert members_of([0.6, 0.4], ["a", "b"], ["a", "b"], [1, 5])[1] == 1
    assert members_of([1.0], ["a"], ["untargeted"], [1])[1] == 0


@needs_vocab
def test_mix_uses_rows_without_a_source(spark):
    random.seed(6)
    own = {"code": "def return class".split(), "news": "today minister said".split(), "untargeted": "zzz yyy".split()}
    docs = []
    for i in range(600):
        s = list(own)[i % 3]
        docs.append((i, " ".join(random.choices(own[s] + "the of and to in".split(), k=30)), s if i % 10 else None, 0))
    mix, report = mixing.mix_sources(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("code", 0.5, 1), ("news", 0.5, 1)], TARGETS))
    bare = [r for r in mix.collect() if r.source is None]
    assert len(bare) >= 30 and all(r.repeats == 1 for r in bare)
    assert sum(docs[r.doc_id][1].count("zzz") > 0 for r in bare) <= len(bare) / 4
    assert all(r.reached_share == pytest.approx(0.5, abs=0.03) for r in report.collect())


def test_source_model_on_held_out_rows():
    random.seed(9)
    own = {"a": "red green blue".split(), "b": "one two three".split()}
    rows = [(s, " ".join(random.choices(w + ["the", "of", "and"], k=12))) for s, w in own.items() for _ in range(120)]
    random.shuffle(rows)
    model = mixing.SourceModel.fit(np.stack([mixing._features(t) for _, t in rows[:160]]), [s for s, _ in rows[:160]])
    p = model.posteriors([t for _, t in rows[160:]])
    assert np.allclose(p.sum(axis=1), 1) and np.mean([model.names[k] == s for k, (s, _) in zip(p.argmax(axis=1), rows[160:])]) > 0.95
