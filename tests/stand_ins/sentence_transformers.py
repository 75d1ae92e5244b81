import numpy as np


class SentenceTransformer:
    def __init__(self, name):
        if name == "missing":
            raise OSError(name)

    def encode(self, texts, batch_size, normalize_embeddings):
        assert normalize_embeddings
        out = np.array([[len(t), 1.0] for t in texts])
        return out / np.linalg.norm(out, axis=1, keepdims=True)
