COLOR_RGB2GRAY = 1
_last = []


def cvtColor(image, code):  # noqa: N802
    return image


def Canny(image, low, high):  # noqa: N802
    return image


def HoughLinesP(edges, **settings):  # noqa: N802
    """A line for each full step of 50 of the first pixel's red."""
    n = int(edges[0, 0, 0]) // 50
    return [[0, 0, 1, 1]] * n or None
