"""The verbs over a store, for one caller."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from bytewake import session
from bytewake.config import BOTH, TIERS, Settings
from bytewake.operators import tiers, verbs
from bytewake.plans.attribution import Feeds
from bytewake.sources.store import Store
from bytewake.staging import Stage
from bytewake.streaming import live


@dataclass(frozen=True)
class Asked:
    """Which stretch of history: one of since, preset, or start (and end)."""

    now: datetime
    since: timedelta | None = None
    preset: str | None = None
    start: datetime | None = None
    end: datetime | None = None
    tier: str | None = None


@dataclass(frozen=True)
class Answer:
    """Counters, the identities they refer to, and the window that is really answered."""

    counters: DataFrame
    identities: DataFrame
    window: tuple[datetime, datetime] | None = None


class Reader:
    """Every verb sees the dimension through ``identities``, and facts only through it."""

    def __init__(
        self, store: Store, settings: Settings, caller_uid: int, is_admin: bool = False, uid: int | None = None,
        caller_host: str | None = None,
    ):
        self.store = store
        self.settings = settings
        self.caller_uid = caller_uid
        self.is_admin = is_admin
        self.uid = uid
        self.caller_host = caller_host

    @property
    def _sees_all(self) -> bool:
        return verbs.sees_all(self.caller_uid, self.settings, self.is_admin) and self.uid is None

    def _visible(self, identity: DataFrame) -> DataFrame:
        return verbs.visible(identity, self.caller_uid, self.settings, self.is_admin, self.uid, self.caller_host)

    def identities(self) -> DataFrame:
        return self._visible(self.store.identities())

    def window(self, asked: Asked) -> tuple[str, tuple[datetime, datetime]]:
        """Tier and half-open window that answer a question."""
        window = verbs.time_window(
            asked.now, self.settings.tz, asked.since, asked.preset, asked.start, asked.end
        )
        return verbs.pick_tier(window, asked.now, self.settings, asked.preset, asked.tier), window

    def pieces(self, asked: Asked) -> list[verbs.Piece]:
        """Where the bytes of the window are read from, finer tiers at its edges."""
        tier, window = self.window(asked)
        marks = self.store.marks()
        rolled = {t: marks.get(("add", t)) for t in TIERS[1:]}
        pruned = {t: marks.get(("prune", t)) for t in TIERS[:-1]}
        return verbs.window_pieces(window, tier, self.settings, rolled, pruned)

    def effective(self, asked: Asked) -> tuple[datetime, datetime] | None:
        """The window that is answered: wider than asked where only coarse buckets are left."""
        pieces = self.pieces(asked)
        return (pieces[0][1], pieces[-1][2]) if pieces else None

    def _deltas(self, asked: Asked) -> DataFrame:
        return self.store.read(self.pieces(asked))

    def top(
        self, asked: Asked, by: str = "identity", limit: int | None = 0, scope: str | None = None,
        direction: str = BOTH, project: str | None = None, exe: str | None = None, user: str | None = None,
    ) -> DataFrame:
        identity = verbs.dimension_filter(self.identities(), project, exe, user)
        narrowed = (project, exe, user) != (None, None, None) or not self._sees_all
        facts = self._deltas(asked)
        if narrowed:
            facts = verbs.of_few(facts, identity, session.FEW)
        return verbs.top(facts, identity, by, limit, scope or self.settings.default_scope, direction, narrowed)

    def top_answer(self, asked: Asked, by: str = "identity", limit: int | None = 0, **narrow) -> Answer:
        """The ranking with the visible identities that its groups are made of."""
        ranked = self.top(asked, by, limit, **narrow)
        identity = verbs.dimension_filter(self.identities(), **{k: narrow.get(k) for k in ("project", "exe", "user")})
        of = identity.withColumn("group_key", F.col(verbs.GROUP_COLUMNS[by]).cast("string"))
        used = of.join(ranked.select("host", "group_key"), ["host", "group_key"], "left_semi").select(identity.columns)
        return Answer(ranked, used, self.effective(asked))

    def series(self, identity_id: int, asked: Asked, scope: str | None = None) -> Answer:
        """History by buckets of the tier that fits the window, the first and last one with what the window holds of them."""
        tier, _ = self.window(asked)
        identity, window = self.identities(), self.effective(asked)
        one = self._deltas(asked).where(F.col("identity_id") == identity_id)
        rolled = tiers.roll(one, tier, self.settings.tz)
        visible = verbs.of_identities(verbs.in_scope(rolled, scope or self.settings.default_scope), identity)
        counters = verbs.counter_rows(visible.orderBy("bucket", "scope"))
        return Answer(counters, verbs.referenced_identities(counters, identity), window)

    def list(self, text: str = "") -> DataFrame:
        return verbs.list_identities(self.identities(), text)

    def show(self, identity_id: int):
        """The identity's row; LookupError when there is none to see."""
        return verbs.require_identity(self.identities(), identity_id)

    def unresolved_share(self, asked: Asked, by: str = "user", scope: str | None = None) -> DataFrame:
        return verbs.unresolved_share(
            self._deltas(asked), self.identities(), by, scope or self.settings.default_scope
        )

    def watch(
        self, samples: DataFrame, load: Callable[[], Feeds], emit: Callable[[DataFrame, int], None],
        delay: timedelta, by: str = "identity", limit: int | None = 0, scope: str | None = None,
        closed: bool = False,
    ) -> DataStreamWriter:
        """Live ranking over a sample stream; ``emit`` gets one set of rows per trigger.

        With ``closed`` every minute is ranked once, when nothing can be added to it any more.
        """
        everyone = live.identify_with(self.store, load)

        def identify(folds: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
            facts, identity = everyone(folds, stage)
            return facts, self._visible(identity)

        return live.stream_watch(
            samples, identify, emit, delay, by, limit, scope or self.settings.default_scope, closed
        )
