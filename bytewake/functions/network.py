"""Direction and scope of one observed transfer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bytewake.config import EGRESS, EGRESS_HOOKS, EXTERNAL, INGRESS, INGRESS_HOOKS, LOOPBACK

# Address families and the loopback address ranges as bytes.
AF_INET = 2
AF_INET6 = 10
V4_LOOPBACK_NET = bytes([127])
V4_ANY = bytes(4)
V6_LOOPBACK = bytes(15) + bytes([1])
V4_MAPPED_LOOPBACK_NET = bytes(10) + bytes([255, 255, 127])


def _bytes(value: bytes) -> Column:
    return F.lit(bytearray(value))


def _starts_with(address: Column, prefix: bytes) -> Column:
    return F.substring(address, 1, len(prefix)) == _bytes(prefix)


def direction_of_hook(hook: Column) -> Column:
    """Ingress or egress; NULL for an observation point we do not know."""
    return F.when(hook.isin(*EGRESS_HOOKS), EGRESS).when(hook.isin(*INGRESS_HOOKS), INGRESS)


def scope_of(family: Column, daddr: Column, saddr: Column) -> Column:
    """Loopback or external.

    A connected IPv4 socket talking to its own address is loopback as well;
    IPv6 has no such rule.  Any other family is external.
    """
    v4 = _starts_with(daddr, V4_LOOPBACK_NET) | ((daddr != _bytes(V4_ANY)) & (daddr == saddr))
    v6 = (daddr == _bytes(V6_LOOPBACK)) | _starts_with(daddr, V4_MAPPED_LOOPBACK_NET)
    return (
        F.when((family == AF_INET) & v4, LOOPBACK)
        .when((family == AF_INET6) & v6, LOOPBACK)
        .otherwise(EXTERNAL)
    )
