"""A stand-in: a document is JSON, {"pages": [{"blocks", "images", "info", "rect"}, …]}; an image is its own JSON by xref."""

import contextlib
import io
import json
import os
from types import SimpleNamespace

csRGB = SimpleNamespace(n=3)  # noqa: N816


def told(what):
    """Notes a call in the file that STAND_IN_LOG names, if any."""
    if "STAND_IN_LOG" in os.environ:
        with io.open(os.environ["STAND_IN_LOG"], "a") as log:
            log.write(what + "\n")


class Page:
    def __init__(self, told):
        self.told, self.rect = told, told["rect"]

    def get_text(self, kind):
        assert kind == "dict"
        told("text")
        return {"blocks": self.told["blocks"]}

    def get_image_info(self, xrefs):
        assert xrefs
        return self.told["info"]

    def get_images(self, full):
        assert full
        told("images")
        return [(x, 0, 0) for x in self.told["images"]]


class Document(list):
    def __init__(self, told):
        super().__init__(map(Page, told["pages"]))
        self.xrefs = told.get("xrefs", {})


@contextlib.contextmanager
def open(stream, filetype):  # noqa: A001
    assert filetype == "pdf"
    yield Document(json.loads(stream))


class Pixmap:
    def __init__(self, doc, xref):
        if isinstance(xref, Pixmap):  # to another colour space
            self.told, self.width, self.height, self.alpha, self.colorspace = xref.told, xref.width, xref.height, xref.alpha, doc
        elif isinstance(doc, Pixmap):  # without alpha
            self.told, self.width, self.height, self.alpha, self.colorspace = doc.told, doc.width, doc.height, 0, doc.colorspace
        else:
            self.told = doc.xrefs[str(xref)]
            self.width, self.height = self.told["size"]
            self.alpha, self.colorspace = self.told.get("alpha", 0), SimpleNamespace(n=self.told.get("colours", 3))

    def tobytes(self, kind):
        assert kind == "png" and self.colorspace.n == 3 and not self.alpha
        return json.dumps(self.told).encode()
