import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from trackspark.operators import detectors as D

W, H = 128, 96
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


def load(path):
    with open(os.path.dirname(path) + f"/loads-{os.getpid()}", "a") as f:
        f.write("x")
    return np.load(path)


def forward(net, stacks):
    """Heat where the middle frame is brighter than both others."""
    sizes = os.path.dirname(net_path[0]) + f"/sizes-{os.getpid()}"
    with open(sizes, "a") as f:
        f.write(f"{len(stacks)},")
    light = stacks.reshape(*stacks.shape[:3], 3, 3).astype(float).mean(4)
    return np.clip((light[..., 1] - np.maximum(light[..., 0], light[..., 2])) / net[0], 0, 1)


net_path = [""]


@pytest.fixture
def weights(tmp_path, monkeypatch):
    path = str(tmp_path / "net.npy")
    np.save(path, np.full(200_000, 200.0))
    monkeypatch.setattr(D, "MODELS", {})
    net_path[0] = path
    D.register("numpy", D.Model(load, forward))
    return path


def clip(spark, n=23):
    rng, out = np.random.default_rng(1), []
    for f in range(n):
        img = rng.integers(20, 30, (H, W, 3)).astype(np.uint8)
        img[20:22, 2 * f + 4 : 2 * f + 6] = (230, 220, 60)
        out.append(("v", 0, f, H, W, bytearray(img.tobytes())))
    return spark.createDataFrame([*out, ("v", 0, 99, H, W, None), ("v", 0, 98, H, W, bytearray(3))], "video_id string, shot_id int, frame int, h int, w int, rgb binary")


def test_choice(weights, tmp_path):
    short = str(tmp_path / "short.npy")
    np.save(short, np.zeros(3))
    assert D.chosen("auto", weights) == "numpy" and D.chosen("numpy", weights) == "numpy"
    assert D.chosen("auto", short) == D.chosen("auto", str(tmp_path / "none")) == D.chosen("auto") == D.chosen("classical", weights) == "classical"
    for kind, path in (("numpy", short), ("numpy", None), ("other", weights)):
        with pytest.raises(D.DetectorError):
            D.chosen(kind, path)
    with pytest.raises(ValueError):
        D.register("classical", D.Model(load, forward))


def test_a_model_is_loaded_once_a_worker_and_gets_batches(spark, weights, tmp_path):
    frames = clip(spark)
    keys = ["video_id", "shot_id"]
    got = {(r.frame, r.cand_idx): r for r in D.detect(frames, keys, 640.0, 480.0, weights=weights).collect()}
    best = {f: r for (f, k), r in got.items() if k == 0}
    assert set(best) >= set(range(1, 22)) and not {98, 99} & set(best)
    assert all(abs(best[f].x - (2 * f + 4.5) * 5) < 3 and abs(best[f].y - 102) < 3 for f in range(1, 22))
    D.detect(frames, keys, 640.0, 480.0, weights=weights).collect()
    loads = [len((tmp_path / x).read_text()) for x in os.listdir(tmp_path) if x.startswith("loads-")]
    sizes = [int(s) for x in os.listdir(tmp_path) if x.startswith("sizes-") for s in (tmp_path / x).read_text().split(",") if s]
    assert loads and set(loads) == {1} and max(sizes) == D.BATCH and sum(sizes) == 46


def test_classical_is_one_entry(spark, weights):
    from trackspark.operators.pixels import moving_balls

    frames, keys = clip(spark), ["video_id", "shot_id"]
    plain = sorted(map(tuple, moving_balls(frames, keys, 640.0, 480.0).collect()))
    assert plain and sorted(map(tuple, D.detect(frames, keys, 640.0, 480.0, kind="classical").collect())) == plain
