"""Schemas, fixed values and errors of the quantile engine."""

from __future__ import annotations

MAX_VALUE = 4294967295
EPSILON = 0.015
#: Values of one stored histogram row, and of one task that ranks them: 4096 spans cover 32 bits.
SPAN = 1 << 20
KLL_K = 200

#: Age limit of a window's start in seconds, and the width its windows get below that limit.
TIERS = ((300, 1), (86_400, 10), (604_800, 60), (2_419_200, 600), (31_536_000, 3600))
GROUP_SECONDS = {"seconds": 1, "hours": 3600, "days": 86_400}

OBSERVATION_SCHEMA = "metric string, ts long, value long"
HIST = "array<struct<value:bigint,weight:bigint>>"
EXACT_SCHEMA = f"metric string, window_start long, window_end long, n long, vmin long, vmax long, hist {HIST}"
KLL_SCHEMA = "metric string, window_start long, window_end long, n long, vmin long, vmax long, kll binary"
METRIC_SCHEMA = "metric string"
QUANTILE_COLUMNS = ("window_start", "window_end", "phi", "count", "approx", "lower", "upper")


class QueryError(Exception):
    """A query that cannot be planned."""


class TokenizeError(QueryError):
    """Text that is no token."""


class UnexpectedChar(TokenizeError):
    """A character that no token begins with."""


class InvalidNumber(TokenizeError):
    """Digits that are no number, or one beyond 64 unsigned bits."""


class InvalidSymbol(TokenizeError):
    """A name that goes on with a character it can't have."""


class UnterminatedString(TokenizeError):
    """A string without its closing quote."""


class ParseError(QueryError):
    """Tokens that are no query."""


class InvalidExpressionType(QueryError):
    """The query is not a function call."""


class UnrecognizedFunction(QueryError):
    """No function has this name."""


class InvalidInput(QueryError):
    """A function got rows of a kind that it doesn't take."""


class InvalidOutputType(QueryError):
    """The query ends in sketches, which are no result."""


class MissingArg(QueryError):
    """Too few arguments."""


class InvalidArgType(QueryError):
    """An argument of another type than asked for."""


class InvalidArgValue(QueryError):
    """An argument out of its set of values."""


class PhiOutOfRange(QueryError):
    """A quantile outside the open interval from 0 to 1."""


class StorageError(QueryError):
    """The store can't answer."""


class InvalidMetricName(StorageError):
    """A name that no stored metric can have."""


class StoreConflict(StorageError):
    """Others changed the store faster than this writer could commit."""


class CodecError(Exception):
    """Bytes that are no encoding of what is asked for."""
