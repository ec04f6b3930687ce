"""Fixed values and settings shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

# Sentinels that end up inside stored identities.
UNRESOLVED = "<unresolved>"
NO_PROJECT = "<none>"
UNKNOWN_UID = 4294967295
# Stands for a missing process number, which is never negative.
UNKNOWN_TGID = -1

# Files whose presence makes a directory a project root.
PROJECT_MARKERS = (".git", "package.json", "pyproject.toml", "Cargo.toml")

# Scopes, and the observation points on each side of a socket.
EXTERNAL = "external"
LOOPBACK = "loopback"
ALL_SCOPES = "all"
SCOPES = (EXTERNAL, LOOPBACK)
INGRESS = "ingress"
EGRESS = "egress"
BOTH = "both"
EGRESS_HOOKS = ("tcp_sendmsg", "udp_sendmsg", "udpv6_sendmsg")
INGRESS_HOOKS = ("tcp_cleanup_rbuf", "udp_recvmsg", "udpv6_recvmsg")

# Tiers from fine to coarse; each one is rolled up from the one before it.
TIERS = ("minute", "hour", "day", "month")
FINER = {"hour": "minute", "day": "hour", "month": "day"}
COARSER = {finer: tier for tier, finer in FINER.items()}

NATURAL_KEY = ("host", "uid", "unit_or_cgroup", "exe", "project_root", "normalized_cmdline")
DISPLAY = ("comm", "raw_cmdline", "username")
TIER_KEY = ("bucket", "identity_id", "scope")
PROCESS = ("host", "tgid")

DEFAULT_LIMIT = 20

# A snapshot and a capture of one process are taken within this time of each other.
CAPTURE_TOLERANCE = timedelta(seconds=10)


@dataclass(frozen=True)
class Settings:
    """What a deployment may change; the defaults are the documented ones."""

    tz: str = "UTC"
    retention: dict[str, timedelta | None] = field(
        default_factory=lambda: {
            "minute": timedelta(hours=48),
            "hour": timedelta(days=90),
            "day": timedelta(days=730),
            "month": None,
        }
    )
    default_scope: str = EXTERNAL
    # roll days up from minutes, for zones whose offset is no whole hour
    exact_days: bool = False
    admin_uids: tuple[int, ...] = (0,)
