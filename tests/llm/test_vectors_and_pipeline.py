"""Embedding near-duplicates and components against brute force; the pipeline end to end."""

import fixtures as fx
import numpy as np
import pytest

from tessera.llm import components, embedding_dedup


def brute(vectors, threshold=0.95):
    ok = {i: np.array(v, float) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _ in vectors if i is not None}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold:
                links[a].add(b)
    label = {i: i for i in links}
    for _ in label:
        for a in links:
            label[a] = min([label[a], *(label[b] for b in links[a])])
    return {i: (len(links[i]), label[i], label[i] == i) for i in links}


def vectors():
    rng = np.random.default_rng(0)
    out = [rng.standard_normal(16) for _ in range(40)]
    out += [out[k] + 0.05 * rng.standard_normal(16) for k in range(20) for _ in range(3)]
    out += [out[0]] * 5 + [3 * out[1]]
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(out)]
    n = len(rows)
    return [*rows, (n, None), (n + 1, [0.0] * 16), (n + 2, [None] + [1.0] * 15), (n + 3, [float("nan")] * 16), (n + 4, [float("inf")] + [1.0] * 15), (n + 5, [1.0, 0.0]), (n + 6, []), (None, [1.0] * 16)]


@pytest.mark.parametrize("block", [4096, 25])
def test_embedding_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors()
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(d).collect()}
    assert got.pop(None) == (0, None, False)
    assert got == brute(rows)


def test_embedding_dedup_of_nothing(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_error_bound_holds():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scale, lost = embedding_dedup.quantise(x)
    near = codes * scale[:, None]
    bound = lost[:, None] + (1 + lost[:, None]) * lost[None, :]
    assert (np.abs(x @ x.T - near @ near.T) <= bound + 1e-12).all()


def test_components_of_a_long_chain(spark):
    rng = np.random.default_rng(2)
    ids = rng.permutation(200).tolist()
    links = spark.createDataFrame(list(zip(ids[:-1], ids[1:], strict=True)) + [(500, 501), (501, 502), (502, 500), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links, "a", "b").collect()}
    assert {got[i] for i in ids} == {0} and got[501] == got[502] == 500


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [r for r in fx.rows() if r[0] is not None][:61]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([r[:5] for r in rows], cols).dropDuplicates(["doc_id"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, int(r[0] % 2)) for r in rows[20:]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_join", "pii", "mixing", "packing"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in cp.STAGES[1:4]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "ngram_join":
            want = fx.components({r.doc_id: fx.shingles(r.text) for r in now.collect()})
            assert sorted(r.doc_id for r in after.collect()) == sorted(k for k, c in want.items() if k == c)
        if name == "pii":
            assert after.count() == now.count() and not after.where("text LIKE '%ann@example.org%'").count()
        now = after
    assert cp.run(spark, str(tmp_path)).count() > 0
