import contextlib

import numpy as np


class Tensor:
    def __init__(self, values):
        self.values = np.asarray(values, float)

    def double(self):
        return self

    def numpy(self):
        return self.values


@contextlib.contextmanager
def no_grad():
    yield
