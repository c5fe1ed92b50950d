"""Sorted projection passes against brute force."""

import numpy as np
import pytest

from searchloom.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, digest string, unit string"


def brute(ids, vecs, threshold=0.95):
    units = [ed._unit(v) for v in vecs]
    ok = [k for k, u in enumerate(units) if u is not None and ids[k] is not None]
    links, up = {k: 0 for k in range(len(ids))}, {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for p, a in enumerate(ok):
        for b in ok[p + 1 :]:
            if len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = sorted((top(ids[a]), top(ids[b])))
                up[y] = x
    return links, {i: top(i) for i in ids}


def check(spark, ids, vecs, parts=3):
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in zip(ids, vecs)], SCHEMA).repartition(parts)
    out = ed.embedding_dedup(df, window=8).collect()
    assert len(out) == len(ids)
    links, comp = brute(ids, vecs)
    want = sorted(((i, links[k], comp[i], i == comp[i]) for k, i in enumerate(ids)), key=str)
    assert sorted(map(tuple, out), key=str) == want


def test_odd_vectors_and_crowds(spark, monkeypatch):
    monkeypatch.setattr(ed, "ROWS_PER_TASK", 200)
    rng = np.random.default_rng(4)
    vecs = [rng.standard_normal(16).tolist() for _ in range(60)]
    base = rng.standard_normal(16)
    vecs += [(base + 0.05 * rng.standard_normal(16)).tolist() for _ in range(60)]  # a crowd beyond the window
    vecs += [vecs[0]] * 30 + [(2 * np.array(vecs[1])).tolist(), [1.0] * 8, [1.0] * 8]
    vecs += [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15]
    ids = list(range(len(vecs)))
    rng.shuffle(ids)
    ids = [int(i) for i in ids] + [None]
    vecs.append(vecs[0])
    check(spark, ids, vecs)
    assert ed.embedding_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def crowd(rng, n, cosine, dim=64):
    """Vectors of about ``cosine`` to each other."""
    base = rng.standard_normal(dim)
    x = rng.standard_normal((n, dim))
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    return np.sqrt(cosine) * unit(base) + np.sqrt(1 - cosine) * unit(x - np.outer(x @ unit(base), unit(base)))


def test_links_of_a_loose_crowd(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 50, raising=False)
    rng = np.random.default_rng(9)
    vecs = [*rng.standard_normal((100, 64)), *crowd(rng, 250, 0.96)]
    ids = [int(i) for i in rng.permutation(len(vecs))]
    check(spark, [*ids, 999], [v.tolist() for v in [*vecs, vecs[-1]]])


def planted(rng, n, topic, pairs):
    """Vectors of which a third are of one topic at ``topic`` to each other, ``pairs`` of these with a partner at 0.955."""
    vecs = np.concatenate([rng.standard_normal((n - n // 3, 64)), crowd(rng, n // 3, topic)])
    of = vecs[n - pairs :] / np.linalg.norm(vecs[n - pairs :], axis=1, keepdims=True)
    side = rng.standard_normal((pairs, 64))
    side -= (side * of).sum(axis=1, keepdims=True) * of
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return np.concatenate([vecs, 0.955 * of + np.sqrt(1 - 0.955**2) * side]).tolist()


@pytest.mark.parametrize("block", [1024, 60])
def test_pairs_in_a_dense_topic(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    vecs = planted(np.random.default_rng(12), 3000, 0.81, 400)
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in enumerate(vecs)], SCHEMA).repartition(3)
    comp = {r.vec_id: r.component_id for r in ed.embedding_dedup(df, window=8).collect()}
    assert sum(comp[3000 - 400 + k] == comp[3000 + k] for k in range(400)) >= 0.99 * 400


def test_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    out = {r.vec_id: r for r in ed.op10_embedding_near_dedup(spark, sf_dir).collect()}
    links, comp = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    for k, r in enumerate(rows):
        assert (out[r.vec_id].n_links, out[r.vec_id].component_id) == (links[k], comp[r.vec_id])
