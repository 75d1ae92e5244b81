from types import SimpleNamespace

from fitz import told
from torch import Tensor


class CLIPProcessor:
    @classmethod
    def from_pretrained(cls, name):
        if name == "missing":
            raise OSError(name)
        return cls()

    def __call__(self, text=None, images=None, return_tensors=None, padding=None, truncation=None):
        return {"text": text, "images": images}


class CLIPModel:
    from_pretrained = classmethod(CLIPProcessor.from_pretrained.__func__)

    def __call__(self, text, images):
        """Charts are near prompts that speak of them, and of kinds the first."""
        for _ in images:
            told("kinds" if len(text) == 6 else "subtypes")
        near = lambda p, x: 9.0 if ("chart" in p or "graph" in p) == x.told["chart"] else 1.0
        return SimpleNamespace(logits_per_image=Tensor([[near(p, x) - 0.01 * i for i, p in enumerate(text)] for x in images]))

    def get_image_features(self, text, images):
        return Tensor([[3.0, 4.0] for _ in images])

    def get_text_features(self, text, images):
        return Tensor([[0.0, 2.0] for _ in text])


class BlipProcessor:
    from_pretrained = classmethod(CLIPProcessor.from_pretrained.__func__)

    def __call__(self, image, prompt, return_tensors=None):
        return {"image": image, "prompt": prompt}

    def decode(self, out, skip_special_tokens):
        return out


class BlipForConditionalGeneration:
    from_pretrained = classmethod(CLIPProcessor.from_pretrained.__func__)

    def generate(self, image, prompt, max_new_tokens):
        return [f"{prompt} {image.told['text'].split()[0]}"]
