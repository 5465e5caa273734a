"""What exchangeable parts must offer, as protocols, and the error that operations raise."""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame

#: Types of errors (fixed values).
ERROR_TYPES = ("syntax", "structure", "size", "path", "memory", "corruption", "filesystem", "circular")


class ProcessingError(Exception):
    """A failure of an operation, with its type (one of ERROR_TYPES) and whatever it was about."""

    def __init__(self, message: str, error_type: str, context: Any = None):
        if error_type not in ERROR_TYPES:
            raise ValueError(f"unknown error type: {error_type}")
        super().__init__(message)
        self.error_type, self.context = error_type, context


@runtime_checkable
class Transformer(Protocol):
    """Cuts corpora of documents into shards, and joins them again."""

    def unflatten(self, corpus: DataFrame, limit: int) -> DataFrame: ...

    def flatten(self, shards: DataFrame) -> DataFrame: ...


@runtime_checkable
class Engine(Protocol):
    """Sizes values and decides where a new shard begins."""

    def file_size(self, value: object) -> int: ...

    def opens_new(self, current: int, new: int, limit: int) -> bool: ...


@runtime_checkable
class Processor(Protocol):
    """Cuts one document by its structure."""

    def cut(self, value: object, structure: str | None = None) -> list: ...


@runtime_checkable
class ErrorHandler(Protocol):
    """Judges input and advises on errors."""

    def validate_input(self, corpus: DataFrame) -> DataFrame: ...

    def advise_errors(self, log: DataFrame) -> DataFrame: ...

    def recover(self, records: DataFrame, shards: DataFrame) -> DataFrame: ...
