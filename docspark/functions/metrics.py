"""Answer metrics: BLEU-2, ROUGE-L, faithfulness.

BLEU and ROUGE need multiset counts and a longest common subsequence, which nested lambdas would find in quadratic
interpreted steps, so they are Arrow-batched functions; faithfulness is set arithmetic on Columns. The tokenizer of
BLEU takes words and single punctuation marks, that of ROUGE is `unicode` (words) or `ascii` ([a-z0-9]+).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import word_set

# Words that carry no content.
STOP_WORDS = ["и", "в", "на", "с", "по", "к", "а", "но", "не", "что", "это", "the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "with", "and", "or", "да", "от", "из"]

BLEU_TOKEN = re.compile(r"\w+|[^\w\s]")
ROUGE_TOKEN = {"unicode": re.compile(r"\w+"), "ascii": re.compile(r"[a-z0-9]+")}


def bleu_score(reference: str | None, hypothesis: str | None) -> float:
    """Sentence BLEU of word pairs at most; a missing order counts as 0.1 matches."""
    r, h = (BLEU_TOKEN.findall((x or "").lower()) for x in (reference, hypothesis))
    if not r or not h:
        return 0.0
    logs = 0.0
    for n in (1, 2):
        own, given = (Counter(zip(*(x[i:] for i in range(n)), strict=False)) for x in (h, r))
        hits, total = sum((own & given).values()), max(1, len(h) - n + 1)
        if n == 1 and not hits:
            return 0.0
        logs += math.log((hits or 0.1) / total) / 2
    brevity = 1.0 if len(h) > len(r) else math.exp(1 - len(r) / len(h))
    return round(brevity * math.exp(logs), 4)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, a row of the table at a time as the bits of one number."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_score(reference: str | None, hypothesis: str | None, tokenizer: str = "unicode") -> float:
    r, h = (ROUGE_TOKEN[tokenizer].findall((x or "").lower()) for x in (reference, hypothesis))
    common = lcs_length(r, h) if r and h else 0
    if not common:
        return 0.0
    precision, recall = common / len(h), common / len(r)
    return round(2 * precision * recall / (precision + recall), 4)


def bleu(reference: Column, hypothesis: Column) -> Column:
    @F.pandas_udf("double")
    def own(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([bleu_score(x, y) for x, y in zip(r, h, strict=True)], dtype="float64")

    return own(reference, hypothesis)


def rouge_l(reference: Column, hypothesis: Column, tokenizer: str = "unicode") -> Column:
    @F.pandas_udf("double")
    def own(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([rouge_score(x, y, tokenizer) for x, y in zip(r, h, strict=True)], dtype="float64")

    return own(reference, hypothesis)


def faithfulness(answer: Column, context: Column) -> Column:
    """Share of the answer's content words that the context has; 0 without words, 1 without content words."""
    words = word_set(answer)
    content = F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))
    both = F.array_intersect(content, word_set(context))
    return F.when(F.size(words) == 0, 0.0).when(F.size(content) == 0, 1.0).otherwise(F.round(F.size(both) / F.size(content), 4))
