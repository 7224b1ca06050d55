"""What may be plugged in: providers, retrievers, answerers and sinks, as functions of DataFrames.

Each is a structural type, so any object with the method fits; rows are keyed
by ``question_id`` and nothing is called row by row.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EmbeddingProvider(Protocol):
    """``text`` to ``text, vector``."""

    def __call__(self, texts: DataFrame) -> DataFrame: ...


class Retriever(Protocol):
    """``question_id, text`` to ``question_id, chunk_id, rank, score``."""

    def __call__(self, questions: DataFrame) -> DataFrame: ...


class Answerer(Protocol):
    """Rows with ``question_id`` and a context to ``question_id, answer``."""

    def __call__(self, contexts: DataFrame) -> DataFrame: ...


class Controller(Protocol):
    """``question_id, text, context_text`` to ``question_id, query``; a null query ends the run."""

    def __call__(self, seen: DataFrame) -> DataFrame: ...


class Resolver(Protocol):
    """Sentence, title and previous sentence to a struct of text and method."""

    def __call__(self, sentence: Column, title: Column, previous: Column) -> Column: ...


class TokenCounter(Protocol):
    """A text to its number of tokens."""

    def __call__(self, text: Column) -> Column: ...


class EventSink(Protocol):
    """Takes a batch of events; taking one again changes nothing."""

    def ingest(self, batch: DataFrame) -> int: ...


class ReadRepository(Protocol):
    """What the read functions of the experiment store need."""

    def runs(self) -> DataFrame: ...

    def run_questions(self) -> DataFrame: ...

    def events(self) -> DataFrame: ...


def file_token_counter(path: str) -> TokenCounter:
    """Counts by a tokenizer file, in Arrow batches; without one use ``functions.text.estimated_tokens``."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return pd.Series([len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)])

    return count
