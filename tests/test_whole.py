"""Queries without SQL read whole inputs: small tables where a part of them gives something else."""

import random

import pytest

from cloudloom.plans import registry


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Two classes that differ only in the last of 12 dimensions."""
    d = tmp_path_factory.mktemp("vectors")
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-0.1, 0.1) for _ in range(11)] + [rng.gauss(1.0 if i // 5 % 2 else -1.0, 0.1)], i // 5 % 2) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d), {i: y for i, _, y in rows}


@pytest.mark.parametrize("name", ["svm", "nb", "tree", "logistic", "ada", "lda", "igm"])
def test_classifiers_see_all_dimensions(spark, vectors, name):
    d, truth = vectors
    got = registry.queries()[name](spark, d).collect()
    assert len(got) == 40 and all(r.pred == truth[r.obj_id] for r in got)


def test_vocabulary_and_projection_see_all_dimensions(spark, vectors):
    d, truth = vectors
    assert {len(r.features) for r in registry.queries()["kmeans"](spark, d).collect()} == {12}
    got = registry.queries()["svd_projection"](spark, d).collect()
    assert len({(r.projection[0] > 0) == bool(truth[r.obj_id]) for r in got}) == 1


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """300 parts; those above 120 are larger, so that a mesh of the first ones doesn't reach them."""
    d = tmp_path_factory.mktemp("parts")
    rows = [(k, "a" if k % 2 else "b", 5 + k % 7 if k <= 120 else 30 + k % 17, 900.0 + k % 101) for k in range(1, 301)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{d}/part.parquet")
    return str(d)


def test_meshes_have_all_parts(spark, parts):
    from cloudloom.operators import rays
    from cloudloom.plans import q_features

    vertices, faces, tri = q_features._whole_mesh(spark, parts)
    assert {r.vid for r in vertices.collect()} == set(range(1, 301))
    assert {tuple(r) for r in faces.select("fid", "a", "b", "c").collect()} == {(k - 1, k, k % 300 + 1, k * 7 % 300 + 1) for k in range(1, 301)}
    assert tri.count() == 300
    hits = registry.queries()["scan_views"](spark, parts).collect()
    assert max(r.fid for r in hits) >= 120
    assert max(r.x for r in hits) > 11
    assert max(r.u for r in registry.queries()["mesh_depth"](spark, parts).collect()) > 11
    assert max(r.x for r in registry.queries()["mesh_sample"](spark, parts).collect()) > 11
    r = rays.parallel_rays(spark, (25.0, 18.0, 5.0), 60.0, 60.0, 8, 20)
    assert len(hits) == rays.cast_rays(r, tri).count()


@pytest.mark.parametrize("name, parts_of", [("esf", 3), ("triple_histograms", 1), ("part_histograms", 1)])
def test_histograms_of_all_samples(spark, parts, monkeypatch, name, parts_of):
    from cloudloom.operators import descriptors

    drawn = []
    for f in ("shape_functions", "triple_histogram"):
        real = getattr(descriptors, f)
        monkeypatch.setattr(descriptors, f, lambda *a, samples=20_000, real=real, **k: drawn.append(samples) or real(*a, samples=samples, **k))
    if name == "part_histograms":
        real_parts = descriptors.part_histograms
        monkeypatch.setattr(descriptors, "part_histograms", lambda *a, **k: real_parts(*a, **({"histogram": descriptors.triple_histogram} | k)))
    got = registry.queries()[name](spark, parts).collect()
    assert drawn == [20_000]
    if name == "esf":
        for cloud in "ab":
            assert sum(r.value for r in got if r.cloud_id == cloud and r.bin < 576) == pytest.approx(parts_of)


def test_plane_search_to_its_end(spark, tmp_path, monkeypatch):
    from cloudloom.operators import geometry

    asked = []
    real = geometry.ransac
    monkeypatch.setattr(geometry, "ransac", lambda p, threshold, iterations, ratio, seed: asked.append((iterations, ratio)) or real(p, threshold, iterations, ratio, seed))
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1), rng.uniform(-1, 1), 0.25 if i % 10 < 8 else rng.uniform(-1, 1), 0.0, 0.0, 0.0], 0) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    (best,) = registry.queries()["ransac"](spark, str(tmp_path)).collect()
    assert asked == [(10_000, 0.7)]
    assert best.inliers >= 210
    monkeypatch.setattr(geometry, "candidate_planes", lambda p, k, seed: asked.append(k) or [(0.0, 0.0, 1.0, 5.0)])
    monkeypatch.setattr(geometry, "count_inliers", lambda p, planes, threshold: spark.createDataFrame([(0, 0.0, 0.0, 1.0, 5.0, 0)], "plane int, a double, b double, c double, d double, inliers long"))
    del asked[:]
    registry.queries()["ransac"](spark, str(tmp_path))
    assert sum(asked[1:]) == 10_000
