"""A stand-in: an image is JSON, {"pixels": [[r, g, b, n], …], "text": …, "lines": …, "chart": …}."""

import json

import numpy as np


class Image:
    def __init__(self, told):
        self.told, self.size = told, None

    def convert(self, mode):
        assert mode == "RGB"
        return self

    def resize(self, size):
        out = Image(self.told)
        out.size = size
        return out

    def __array__(self, dtype=None, copy=None):
        w, h = self.size or (10, 10)
        rows = np.concatenate([np.tile([r, g, b], (n, 1)) for r, g, b, n in self.told["pixels"]])
        return np.resize(rows, (h, w, 3)).astype(dtype or np.uint8)


def open(stream):  # noqa: A001
    return Image(json.loads(stream.read()))
