"""Interfaces of what the engine doesn't compute itself: encoders, tokenizers, word frequencies and text generation.

Providers are ordinary Python objects that can be pickled; they run in Arrow batches on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Encoder(Protocol):
    """Texts to dense vectors of one length."""

    def encode(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class Tokenizer(Protocol):
    """A sentence to morphemes with the fields that ``operators.segmentation`` names."""

    def tokens(self, sentence: str) -> Sequence[Mapping[str, str]]: ...


class Generator(Protocol):
    """A prompt to a reply, or None where no model answers."""

    def reply(self, system: str, user: str) -> str | None: ...


def encoded(df: DataFrame, encoder: Encoder, id_col: str, text_col: str) -> DataFrame:
    """(id, v): the vectors of a text column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "v": [list(map(float, v)) for v in encoder.encode(pdf[text_col].fillna("").tolist())]})

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {dict(df.dtypes)[id_col]}, v array<float>")


def tokenised(df: DataFrame, tokenizer: Tokenizer, id_col: str, text_col: str = "sentence") -> DataFrame:
    """(id, sentence, tokens) for ``operators.segmentation.segment_sentences``."""
    fields = ("surf", "pos", "pos_sub", "pos_sub2", "ctype", "cform", "lemma", "norm", "reading")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "sentence": pdf[text_col], "tokens": [[{k: t.get(k, "") for k in fields} for t in tokenizer.tokens(s)] if isinstance(s, str) else None for s in pdf[text_col]]})

    token = "struct<" + ",".join(f"{k}:string" for k in fields) + ">"
    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {dict(df.dtypes)[id_col]}, sentence string, tokens array<{token}>")


def replies(df: DataFrame, models: Sequence[Generator], id_col: str, system_col: str, user_col: str) -> DataFrame:
    """(id, reply): the first answer along a ladder of models; null if none answers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for system, user in zip(pdf[system_col], pdf[user_col]):
                out.append(next((r for r in (m.reply(system, user) for m in models) if r), None))
            yield pd.DataFrame({id_col: pdf[id_col], "reply": out})

    return df.select(id_col, system_col, user_col).mapInPandas(run, f"{id_col} {dict(df.dtypes)[id_col]}, reply string")


class Answering(Protocol):
    """A prompt and a budget of tokens to (answer, whether it was cut off), or None where the model fails."""

    def answer(self, system: str, user: str, tokens: int) -> tuple[str, bool] | None: ...


#: Fixed value: how much larger the budget of a second try is after an answer was cut off.
GROWTH = 1.5


def answers(df: DataFrame, models: Sequence[Answering], id_col: str, system_col: str, user_col: str, budget_col: str) -> DataFrame:
    """(id, reply, model, tokens, cut) along a ladder of models: an answer that is cut off is asked for once more with a larger budget.

    An answer that is still cut off counts only if no later model has a whole one; ``model`` is the number of the one that answered.
    """

    def ladder(system: str, user: str, budget: int) -> tuple:
        best = (None, None, None, None)
        for n, model in enumerate(models):
            for tokens in (budget, int(budget * GROWTH)):
                got = model.answer(system, user, tokens)
                if got is None:
                    break
                if not got[1]:
                    return (got[0], n, tokens, False)
                best = best if best[0] else (got[0], n, tokens, True)
        return best

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [ladder(s, u, int(b)) for s, u, b in zip(pdf[system_col], pdf[user_col], pdf[budget_col])]
            out = pd.DataFrame(rows, columns=["reply", "model", "tokens", "cut"]).astype({"model": "Int32", "tokens": "Int32", "cut": "boolean"})
            out.insert(0, id_col, pdf[id_col].to_numpy())
            yield out

    return df.select(id_col, system_col, user_col, budget_col).mapInPandas(run, f"{id_col} {dict(df.dtypes)[id_col]}, reply string, model int, tokens int, cut boolean")
