"""Errors of the library, one class for each cause."""

from __future__ import annotations


class NetweaveError(Exception):
    """Base of all errors raised here."""


class UnsupportedValue(NetweaveError):
    """A value or type that MMDB cannot hold."""


class RejectedInserts(NetweaveError):
    """A log in FAILFAST mode held inserts that may not be made; ``codes`` counts them by code."""

    def __init__(self, codes: dict[str, int]):
        super().__init__(", ".join(f"{k}: {v}" for k, v in sorted(codes.items())))
        self.codes = codes


class TreeTooLarge(NetweaveError):
    """A record does not fit the record size."""


class LoadError(NetweaveError):
    """Bytes that are not a readable MMDB file."""


#: Codes of rejected inserts.
IPV6_IN_IPV4 = "Ipv6InIpv4Tree"
INVALID_RANGE = "InvalidRange"
ALIASED = "AliasedNetwork"
RESERVED = "ReservedNetwork"
UNREADABLE = "UnreadableNetwork"
UNSUPPORTED = "UnsupportedValue"
