"""Text normalisers and word errors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the tokenizer that holds the spelling map.
SPELLING_MODEL = "openai/whisper-large-v3"

Normalizer = Callable[[Column], Column]


def basic_normalize(text: Column) -> Column:
    """Lower case, without the 32 ASCII punctuation marks, white space collapsed and stripped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\p{Punct}]", ""), r"(?U)\s+", " "))


def build_normalizer(kind: str | Callable[[str], str] = "whisper_en", model_id: str = SPELLING_MODEL) -> Normalizer:
    """A normaliser by name, or one that applies a Python function in Arrow batches. ``whisper_en`` takes its British to
    American spellings from the tokenizer ``model_id``."""
    if callable(kind):

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: kind(t) if t is not None else None)

        return run
    if kind == "basic":
        return basic_normalize
    if kind == "whisper_en":
        try:
            from transformers import WhisperTokenizer
            from transformers.models.whisper.english_normalizer import EnglishTextNormalizer
        except ImportError as e:
            raise ImportError("the normaliser whisper_en needs the optional package transformers; use 'basic' or pass a function") from e
        spellings = getattr(WhisperTokenizer.from_pretrained(model_id), "english_spelling_normalizer", None)
        if not spellings:
            raise RuntimeError(f"the tokenizer {model_id} holds no spelling map; without one error counts would differ, use 'basic' instead")
        english = EnglishTextNormalizer(spellings)
        return build_normalizer(lambda t: english(t))
    raise ValueError(f"unknown normaliser {kind!r}; known: 'basic', 'whisper_en', or a function")


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), "")


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Least number of word edits, in Arrow batches; null counts as the empty text."""

    @F.pandas_udf("long")
    def least(references: pd.Series, hypotheses: pd.Series) -> pd.Series:
        return pd.Series([sum(edit_split((r or "").split(), (h or "").split())) for r, h in zip(references, hypotheses, strict=True)], dtype="int64")

    return least(reference, hypothesis)


def edit_split(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a least alignment; going back, a match or substitution is preferred,
    then a deletion, then an insertion."""
    n, m = len(reference), len(hypothesis)
    names = {w: i for i, w in enumerate(dict.fromkeys([*reference, *hypothesis]))}
    r, h = np.array([names[w] for w in reference], dtype=np.int64), np.array([names[w] for w in hypothesis], dtype=np.int64)
    steps = np.arange(m + 1)
    # One bit a cell says whether the alignment may come from the diagonal, one whether from above.
    across, above = (np.zeros((n + 1, (m + 8) // 8), dtype=np.uint8) for _ in range(2))
    row = steps.copy()
    for i in range(n):
        best = row + 1
        best[1:] = np.minimum(best[1:], row[:-1] + (h != r[i]))
        # A run of insertions from any place to the left.
        new = np.minimum.accumulate(best - steps) + steps
        across[i + 1] = np.packbits(np.concatenate([[False], new[1:] == row[:-1] + (h != r[i])]))
        above[i + 1] = np.packbits(new == row + 1)
        row = new
    held = lambda bits: bool(bits[i, j >> 3] >> (7 - (j & 7)) & 1)
    s = d = ins = 0
    i, j = n, m
    while i or j:
        if held(across):
            s += int(r[i - 1] != h[j - 1])
            i, j = i - 1, j - 1
        elif held(above):
            d, i = d + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return s, d, ins


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """struct(n_sub, n_del, n_ins), in Arrow batches."""

    @F.pandas_udf("n_sub long, n_del long, n_ins long")
    def splits(references: pd.Series, hypotheses: pd.Series) -> pd.DataFrame:
        rows = [edit_split((r or "").split(), (h or "").split()) for r, h in zip(references, hypotheses, strict=True)]
        return pd.DataFrame(rows, columns=["n_sub", "n_del", "n_ins"])

    return splits(reference, hypothesis)
