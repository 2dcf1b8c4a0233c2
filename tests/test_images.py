from __future__ import annotations

import numpy as np

from pagelathe.operators import images as M


def page():
    img = np.full((120, 200), 230, np.uint8)
    for y in range(20, 110, 12):
        img[y : y + 4, 20:180:1] = np.where(np.arange(160) % 9 < 6, 30, 230)
    return img


def test_binarise():
    img = page()
    for f in (M.otsu, M.sauvola, M.adaptive_mean):
        out = f(img)
        assert set(np.unique(out)) <= {0, 255} and (out[img == 30] == 0).mean() > 0.95
    assert (M.otsu(img) == np.where(img > 100, 255, 0)).all()


def test_window_means_match_brute_force():
    img = np.random.default_rng(1).integers(0, 256, (9, 11)).astype(np.uint8)
    p = np.pad(img, 2, mode="reflect")
    assert np.allclose(M.box_mean(img, 5), [[p[y : y + 5, x : x + 5].mean() for x in range(11)] for y in range(9)])


def test_noise_lines_and_contrast():
    img = page()
    spot = img.copy()
    spot[5, 5] = 0
    assert M.median(spot)[5, 5] == 230 and M.closed(spot)[5, 5] == 230
    lined = img.copy()
    lined[:, 3], lined[115, :] = 0, 0
    out = M.remove_lines(lined, 60)
    assert out[:, 3].min() == 255 and out[115].min() == 255 and (out[20:24] == lined[20:24])[:, 4:].all()
    assert M.contrast(img, 2, -300).max() == 160 and M.to_gray(np.zeros((2, 2, 4), np.uint8)).shape == (2, 2)
    assert M.flatten_background(np.full((9, 9), 7, np.uint8)).min() == 255


def test_skew():
    for turn in (-4.0, 3.0):
        tilted = M.rotate(page(), turn)
        assert abs(M.skew(tilted) + turn) <= 0.5
        assert abs(M.skew(M.deskew(tilted))) <= 0.5
    assert M.skew(np.full((9, 9), 255, np.uint8)) == 0 and (M.rotate(page(), 0) == page()).all()


def test_process(spark):
    img = page()
    schema = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    df = spark.createDataFrame([(("a", *img.shape, 1, 0, img.tobytes()),), (("b", 0, 0, 1, 0, None),)], schema)
    rows = {r["path"]: r for r in M.process(df, [("median", {}), ("otsu", {})]).collect()}
    assert bytes(rows["a"]["data"]) == M.otsu(M.median(img)).tobytes() and rows["b"]["data"] is None
    first = M.process(df, [("median", {}), ("otsu", {})], stop="median").where("path = 'a'").collect()[0]
    assert bytes(first["data"]) == M.median(img).tobytes()


def test_local_contrast():
    ramp = np.tile(np.linspace(100, 140, 64).astype(np.uint8), (64, 1))
    out = M.clahe(ramp, 4, 2)
    assert out.shape == ramp.shape and np.ptp(out) > np.ptp(ramp)
    whole = M.clahe(ramp, 1e9, 1)
    hist = np.bincount(ramp.ravel(), minlength=256).cumsum() * 255 / ramp.size
    assert (whole == np.rint(hist[ramp])).all()
    assert M.clahe(np.full((5, 3), 9, np.uint8)).shape == (5, 3) and M.clahe(np.zeros((0, 0), np.uint8)).size == 0


def test_nonlocal_means_match_brute_force():
    img = np.random.default_rng(2).integers(0, 256, (9, 10)).astype(np.uint8)
    h, patch, search = 60, 3, 5
    x = np.pad(img.astype(float), 2, mode="reflect")
    want = np.zeros(img.shape)
    for y in range(9):
        for z in range(10):
            ws, vs = [], []
            for dy in range(search):
                for dx in range(search):
                    diff = (img.astype(float) - x[dy : dy + 9, dx : dx + 10]) ** 2
                    d = np.pad(diff, 1, mode="reflect")[y : y + 3, z : z + 3].mean()
                    ws.append(np.exp(-d / h**2))
                    vs.append(x[y + dy, z + dx])
            want[y, z] = np.dot(ws, vs) / sum(ws)
    assert (M.nonlocal_means(img, h, patch, search) == np.rint(want)).all()
    assert (M.nonlocal_means(np.full((30, 30), 80, np.uint8)) == 80).all()


def test_turn_and_dewarp():
    img = page()
    assert (M.turned(M.turned(img, 90), 270) == img).all() and M.turned(img, 90).shape == img.shape[::-1]
    assert M.turned(img, 90)[0, -1] == img[0, 0]

    def broken(x):
        raise RuntimeError

    assert M.flattened(img) is img and M.flattened(img, broken) is img and (M.flattened(img, M.otsu) == M.otsu(img)).all()
    assert M.odd(5) == 5
    for bad in (4, 0, 2.5):
        try:
            M.odd(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
