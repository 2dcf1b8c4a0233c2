"""Page images as grey numpy arrays: binarise, clean, straighten. One image is one row; nothing is gathered.

Sizes are bounded by a page's; each kernel takes and gives uint8 arrays of height by width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.operators import decisions as D
from pagelathe.shipping import in_pandas


def to_gray(img: np.ndarray) -> np.ndarray:
    """Blue, green, red (and alpha) to grey."""
    if img.ndim == 2:
        return img
    if img.shape[2] == 1:
        return img[:, :, 0]
    return np.rint(img[:, :, :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def otsu(gray: np.ndarray) -> np.ndarray:
    """Black and white at the threshold that parts the histogram best."""
    h = np.bincount(gray.ravel(), minlength=256).astype(float)
    n, s = np.cumsum(h), np.cumsum(h * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((s[-1] * n / n[-1] - s) ** 2 / (n * (n[-1] - n)))
    return np.where(gray > between.argmax(), 255, 0).astype(np.uint8)


def _bordered(x: np.ndarray, r: int) -> np.ndarray:
    """An image, or each of a stack, with ``r`` pixels more on all sides, turned back at the edge where it is large enough."""
    return np.pad(x.astype(float), [(0, 0)] * (x.ndim - 2) + [(r, r)] * 2, mode="reflect" if min(x.shape[-2:]) > r else "edge")


def _window_sums(x: np.ndarray, size: int) -> np.ndarray:
    p = np.pad(_bordered(x, size // 2).cumsum(-2).cumsum(-1), [(0, 0)] * (x.ndim - 2) + [(1, 0)] * 2)
    return p[..., size:, size:] - p[..., :-size, size:] - p[..., size:, :-size] + p[..., :-size, :-size]


def box_mean(gray: np.ndarray, size: int) -> np.ndarray:
    return _window_sums(gray, size) / size**2


def sauvola(gray: np.ndarray, size: int = 25, k: float = 0.2) -> np.ndarray:
    """White over mean * (1 + k * (deviation / 128 - 1)) of the window."""
    mean = box_mean(gray, size)
    deviation = np.sqrt(np.maximum(_window_sums(gray.astype(float) ** 2, size) / size**2 - mean**2, 0))
    return np.where(gray > mean * (1 + k * (deviation / 128 - 1)), 255, 0).astype(np.uint8)


def adaptive_mean(gray: np.ndarray, size: int = 31, c: float = 10) -> np.ndarray:
    return np.where(gray > box_mean(gray, size) - c, 255, 0).astype(np.uint8)


def _neighbours(gray: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(gray, r, mode="edge"), (size, size))


def median(gray: np.ndarray, size: int = 3) -> np.ndarray:
    return np.median(_neighbours(gray, size), axis=(2, 3)).astype(np.uint8)


def gaussian(gray: np.ndarray, sigma: float) -> np.ndarray:
    """Two passes of a bell cut at three deviations; floats."""
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    x = np.pad(gray.astype(float), r, mode="edge")
    x = sum(w * x[i : i + gray.shape[0]] for i, w in enumerate(k))
    return sum(w * x[:, i : i + gray.shape[1]] for i, w in enumerate(k))


def erode(gray: np.ndarray, size: int = 3) -> np.ndarray:
    return _neighbours(gray, size).min(axis=(2, 3))


def dilate(gray: np.ndarray, size: int = 3) -> np.ndarray:
    return _neighbours(gray, size).max(axis=(2, 3))


def opened(gray: np.ndarray, size: int = 3) -> np.ndarray:
    return dilate(erode(gray, size), size)


def closed(gray: np.ndarray, size: int = 3) -> np.ndarray:
    return erode(dilate(gray, size), size)


def contrast(gray: np.ndarray, alpha: float = 1.0, beta: float = 0.0) -> np.ndarray:
    return np.clip(np.rint(gray.astype(float) * alpha + beta), 0, 255).astype(np.uint8)


def clahe(gray: np.ndarray, clip: float = 2.0, tile: int = 8) -> np.ndarray:
    """Histograms equalised by tile, bins cut at ``clip`` times the mean, maps blended between tile centres.

    The excess of cut bins is dealt evenly over all bins. The page is padded to whole tiles.
    """
    clip, tile = max(0.1, clip), max(1, tile)
    h, w = gray.shape
    if not h or not w:
        return gray
    th, tw = -(-h // tile), -(-w // tile)
    padded = np.pad(gray, ((0, th * tile - h), (0, tw * tile - w)), mode="symmetric" if min(h, w) > 1 else "edge")
    tiles = padded.reshape(tile, th, tile, tw).swapaxes(1, 2).reshape(tile * tile, -1)
    hist = np.stack([np.bincount(t, minlength=256) for t in tiles]).astype(float)
    top = max(1.0, clip * th * tw / 256)
    excess = np.maximum(hist - top, 0).sum(1, keepdims=True)
    maps = (np.cumsum(np.minimum(hist, top) + excess / 256, axis=1) * 255 / (th * tw)).reshape(tile, tile, 256)

    def between(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pos = (np.arange(n) + 0.5) / size - 0.5
        low = np.floor(pos).astype(int)
        return np.clip(low, 0, tile - 1), np.clip(low + 1, 0, tile - 1), pos - low

    (y0, y1, fy), (x0, x1, fx) = between(h, th), between(w, tw)
    out = np.empty_like(gray)
    for y in range(h):  # one line at a time, so that memory is that of a line
        a, b = (maps[r, x0, gray[y]] * (1 - fx) + maps[r, x1, gray[y]] * fx for r in (y0[y], y1[y]))
        out[y] = np.clip(np.rint(a * (1 - fy[y]) + b * fy[y]), 0, 255)
    return out


def nonlocal_means(gray: np.ndarray, h: float = 10, patch: int = 7, search: int = 21) -> np.ndarray:
    """Each pixel as the mean of its search window, weighted by exp(-d / h^2), d the patches' mean squared difference.

    One shift of the whole page after the other: memory is a few pages, whatever the window. Takes stacks of images too.
    """
    x = _bordered(gray, search // 2)
    own = gray.astype(float)
    total, weight = np.zeros(gray.shape), np.zeros(gray.shape)
    for dy in range(search):
        for dx in range(search):
            other = x[..., dy : dy + gray.shape[-2], dx : dx + gray.shape[-1]]
            w = np.exp(-np.maximum(_window_sums((own - other) ** 2, patch) / patch**2, 0) / max(h, 1) ** 2)
            total += w * other
            weight += w
    return np.clip(np.rint(total / weight), 0, 255).astype(np.uint8)


def turned(gray: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise by the nearest multiple of 90 degrees, as an orientation report tells."""
    return np.ascontiguousarray(np.rot90(gray, -round(degrees / 90) % 4))


def odd(size: float, least: int = 1, most: int = 999) -> int:
    """A kernel's size: odd, within bounds; raises otherwise."""
    n = int(size)
    if n != size or n % 2 == 0 or not least <= n <= most:
        raise ValueError(f"a kernel's size must be odd and from {least} to {most}, not {size}")
    return n


def flattened(gray: np.ndarray, flatten: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Straightening of a page's curve is an outside function; without one, or if it fails, the page stays."""
    try:
        return gray if flatten is None else flatten(gray)
    except Exception:  # noqa: BLE001  an outside function may raise anything; the page as it is serves
        return gray


def flatten_background(gray: np.ndarray, sigma: float = 25) -> np.ndarray:
    """The image over its blurred self, stretched to 0..255."""
    x = gray / np.maximum(gaussian(gray, sigma), 1)
    span = x.max() - x.min()
    return np.rint((x - x.min()) / span * 255).astype(np.uint8) if span else np.full_like(gray, 255)


def _runs(dark: np.ndarray, least: int) -> np.ndarray:
    """Where dark stretches of at least ``least`` along the rows stand."""
    edge = np.diff(np.pad(dark.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (r, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    long = b - a >= least
    marks = np.zeros((dark.shape[0], dark.shape[1] + 1), np.int32)
    np.add.at(marks, (r[long], a[long]), 1)
    np.add.at(marks, (r[long], b[long]), -1)
    return marks.cumsum(1)[:, :-1] > 0


def remove_lines(gray: np.ndarray, least: int = 50) -> np.ndarray:
    """Dark horizontal and vertical stretches of at least ``least`` pixels turn white."""
    dark = gray < 128
    return np.where(_runs(dark, least) | _runs(dark.T, least).T, 255, gray).astype(np.uint8)


def line_mask(gray: np.ndarray, horizontal: bool = True, least: int = 50) -> np.ndarray:
    """White where dark stretches of at least ``least`` pixels lie or stand, black elsewhere."""
    dark = gray < 128
    return np.where(_runs(dark, least) if horizontal else _runs(dark.T, least).T, 255, 0).astype(np.uint8)


def rotate(gray: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Counter-clockwise about the centre on a canvas that holds all of it; linear interpolation."""
    a, (h, w) = np.deg2rad(degrees), gray.shape
    c, s = np.cos(a), np.sin(a)
    nh, nw = int(np.ceil(abs(h * c) + abs(w * s) - 1e-9)), int(np.ceil(abs(w * c) + abs(h * s) - 1e-9))
    y, x = np.mgrid[0:nh, 0:nw]
    dy, dx = y - (nh - 1) / 2, x - (nw - 1) / 2
    sx, sy = c * dx - s * dy + (w - 1) / 2, s * dx + c * dy + (h - 1) / 2
    p = np.pad(gray.astype(float), 1, constant_values=fill)
    sx, sy = np.clip(sx + 1, 0, w + 1), np.clip(sy + 1, 0, h + 1)
    x0, y0 = np.minimum(sx.astype(int), w), np.minimum(sy.astype(int), h)
    fx, fy = sx - x0, sy - y0
    out = (p[y0, x0] * (1 - fx) + p[y0, x0 + 1] * fx) * (1 - fy) + (p[y0 + 1, x0] * (1 - fx) + p[y0 + 1, x0 + 1] * fx) * fy
    return np.rint(out).astype(np.uint8)


def skew(gray: np.ndarray, most: float = 15) -> float:
    """The turn that makes rows of ink sharpest: whole degrees, then tenths about the best. 0 for an empty page."""
    step = max(1, max(gray.shape) // 800)
    ys, xs = np.nonzero(gray[::step, ::step] < 128)
    if not len(ys):
        return 0.0

    def sharpest(degrees: np.ndarray) -> float:
        at = max(1, _PIXELS // len(ys))
        values = [v for i in range(0, len(degrees), at) for v in _sharpness(ys, xs, degrees[i : i + at])]
        return max(zip(values, degrees.tolist(), strict=True), key=lambda x: (x[0], -abs(x[1])))[1]

    best = sharpest(np.arange(-most, most + 1))
    return round(float(sharpest(np.arange(best - 1, best + 1.01, 0.1))), 1) + 0.0


def _sharpness(ys: np.ndarray, xs: np.ndarray, degrees: np.ndarray) -> list[float]:
    """The variance of ink by rows for each turn; whole numbers up to one division, so that equal ones are equal."""
    a = np.deg2rad(degrees)[:, None]
    rows = np.rint(ys * np.cos(a) - xs * np.sin(a)).astype(int)
    rows -= rows.min(1, keepdims=True)
    n = rows.max(1) + 1
    wide = int(n.max())
    ink = np.bincount((rows + np.arange(len(degrees))[:, None] * wide).ravel(), minlength=len(degrees) * wide).reshape(-1, wide)
    return ((n * (ink**2).sum(1) - len(ys) ** 2) / n**2).tolist()


def deskew(gray: np.ndarray, most: float = 15) -> np.ndarray:
    angle = skew(gray, most)
    return rotate(gray, angle) if abs(angle) >= 0.1 else gray


def crop(gray: np.ndarray, left: int, top: int, width: int, height: int, pad: int = 6) -> np.ndarray:
    return gray[max(0, top - pad) : top + height + pad, max(0, left - pad) : left + width + pad]


STEPS: dict[str, Callable[..., np.ndarray]] = {
    "deskew": deskew, "lines": remove_lines, "background": flatten_background, "contrast": contrast, "median": median, "open": opened, "close": closed,
    "clahe": clahe, "nlm": nonlocal_means, "turn": turned, "dewarp": flattened, "gaussian": lambda gray, sigma: np.rint(gaussian(gray, sigma)).astype(np.uint8), "otsu": otsu, "sauvola": sauvola, "adaptive": adaptive_mean,
    "rotate": rotate, "crop": crop, "line_mask": line_mask,
}


#: Kernels that take many small images of one shape at once, and how many pixels are worked on at a time.
STACKED, _PIXELS = {"nlm"}, 1 << 18


def _step(name: str, grays: list[np.ndarray], options: dict) -> list[np.ndarray]:
    """One step over each image; the same bytes, whether images are stacked or not."""
    if name not in STACKED:
        return [STEPS[name](g, **options) for g in grays]
    out: list = [None] * len(grays)
    shapes: dict[tuple, list[int]] = {}
    for i, g in enumerate(grays):
        shapes.setdefault(g.shape, []).append(i)
    for (h, w), at in shapes.items():
        most = max(1, _PIXELS // max(1, h * w))
        for k in range(0, len(at), most):
            for i, g in zip(at[k : k + most], STEPS[name](np.stack([grays[i] for i in at[k : k + most]]), **options), strict=True):
                out[i] = g
    return out


def process(images: DataFrame, steps: list[tuple[str, dict]], stop: str | None = None) -> DataFrame:
    """(path, height, width, data) with ``steps`` of STEPS done in order, up to ``stop`` if given; grey bytes, row by row.

    Takes the rows of ``format("image")`` (column ``image``); rows without data give null data.
    """
    names = [n for n, _ in steps]
    todo = steps[: names.index(stop) + 1] if stop in names else steps

    def batch(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = list(f.itertuples(index=False))
            grays = [to_gray(np.frombuffer(data, np.uint8).reshape(h, w, n)) for _, h, w, n, data in rows if data]
            for name, options in todo:
                grays = _step(name, grays, options)
            done = iter(grays)
            out = [(r[0], *g.shape, g.tobytes()) if r[4] and (g := next(done)) is not None else (r[0], 0, 0, None) for r in rows]
            yield pd.DataFrame(out, columns=["path", "height", "width", "data"])

    flat = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return in_pandas(flat, batch, "path string, height int, width int, data binary")


def skews(images: DataFrame, most: float = 15) -> DataFrame:
    """(path, skew): the turn, in degrees, that makes each image's rows of ink sharpest."""

    def batch(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            angles = [skew(to_gray(np.frombuffer(data, np.uint8).reshape(h, w, n)), most) if data else 0.0 for _, h, w, n, data in f.itertuples(index=False)]
            yield pd.DataFrame({"path": f["origin"], "skew": angles})

    return in_pandas(images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data"), batch, "path string, skew double")


def upright(images: DataFrame, reports: DataFrame, least: float = 1.0) -> DataFrame:
    """(path, height, width, data) of images turned as their orientation reports (path, osd) ask for; others stay as they are."""
    turns = reports.select("path", F.coalesce(D.rotation(F.col("osd"), least), F.lit(0)).alias("turn"))
    flat = images.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data").join(turns, "path", "left")

    def batch(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            out = []
            for path, h, w, n, data, turn in f.itertuples(index=False):
                gray = to_gray(np.frombuffer(data or b"", np.uint8).reshape(h, w, n))
                gray = turned(gray, 0 if turn is None or turn != turn else int(turn))
                out.append((path, *gray.shape, gray.tobytes()))
            yield pd.DataFrame(out, columns=["path", "height", "width", "data"])

    return in_pandas(flat, batch, "path string, height int, width int, data binary")
