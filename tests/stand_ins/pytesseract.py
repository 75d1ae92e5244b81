from types import SimpleNamespace

Output = SimpleNamespace(DICT="dict")


def image_to_string(image, lang, config):
    assert lang == "rus+eng+kaz" and "--psm 6" in config
    return f"  {image.told['text']}\n"


def image_to_data(image, lang, output_type):
    words = image.told["text"].split()
    n = range(len(words))
    return {"text": words, "left": list(n), "top": list(n), "width": list(n), "height": list(n), "conf": [str(10 * i) for i in n], "block_num": [1 for _ in n], "line_num": [1 for _ in n]}
