"""Exceptions with stable codes."""

from __future__ import annotations


class StoreError(Exception):
    """Base class; ``code`` is stable across releases."""

    code = "STORE_ERROR"


class QueryError(StoreError, ValueError):
    code = "QUERY_ERROR"


class ValidationError(StoreError, ValueError):
    code = "VALIDATION_ERROR"


class DocumentNotFoundError(StoreError):
    code = "ENOENT"


class DocumentReadError(StoreError):
    code = "READ_ERROR"


class DocumentWriteError(StoreError):
    code = "WRITE_ERROR"


class DocumentRemoveError(StoreError):
    code = "REMOVE_ERROR"


class DirectoryError(StoreError):
    code = "DIRECTORY_ERROR"


class ListFilesError(StoreError):
    code = "LIST_ERROR"


class FormatError(StoreError):
    code = "FORMAT_ERROR"


class MarkdownPathError(StoreError):
    code = "E_MD_PATH"


class MarkdownMissingError(StoreError):
    code = "E_MD_MISSING"


class MarkdownIntegrityError(StoreError):
    code = "E_MD_SHA"
