"""Run parameters: the date window, campaign (order) ids, optional line items,
the models to compare and the test level.

Values are parsed once at the edge (text as typed into a form) and then passed
as typed Python values; Spark receives them as literals so the filters reach
the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field, replace

from liftlens.constants import DEFAULT_ALPHA, USER_ID_KEY


def parse_id_list(text: str | None, *, required: bool) -> tuple[int, ...]:
    """Comma separated integers; spaces are tolerated.

    An empty text is an error when ``required`` and means "no filter" otherwise.
    """
    if text is None or not str(text).strip():
        if required:
            raise ValueError("an id list is required, got an empty value")
        return ()
    return tuple(int(part.strip()) for part in str(text).split(","))


def _as_date(value: str | _dt.date) -> _dt.date:
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    return _dt.date.fromisoformat(str(value).strip())


@dataclass(frozen=True)
class Params:
    """Typed parameters of one analysis.

    ``models`` holds the model ids (``tid``) to score; the first two are
    "model 1" and "model 2" of the pairwise reports (z-test, overlap). It may
    be empty for log-only work (the user-day rollup).
    """

    start_date: _dt.date
    end_date: _dt.date
    order_ids: tuple[int, ...]
    models: tuple[str, ...]
    line_item_ids: tuple[int, ...] = field(default=())
    alpha: float = DEFAULT_ALPHA
    user_key: str = USER_ID_KEY  # key of the targeting map that carries the user id

    def __post_init__(self) -> None:
        object.__setattr__(self, "start_date", _as_date(self.start_date))
        object.__setattr__(self, "end_date", _as_date(self.end_date))
        object.__setattr__(self, "order_ids", tuple(int(x) for x in self.order_ids))
        object.__setattr__(self, "line_item_ids", tuple(int(x) for x in self.line_item_ids))
        object.__setattr__(self, "models", tuple(str(m) for m in self.models))
        if not self.order_ids:
            raise ValueError("at least one order id is required")
        if any(not m.strip() for m in self.models):
            raise ValueError(f"model ids must be non-empty, got {self.models!r}")
        if self.start_date > self.end_date:
            raise ValueError(f"start date {self.start_date} is after end date {self.end_date}")
        if not self.user_key:
            raise ValueError("the user key must not be empty")
        if not 0.0 < self.alpha < 1.0:
            raise ValueError(f"alpha must be in (0, 1), got {self.alpha}")

    @property
    def model1(self) -> str:
        if not self.models:
            raise ValueError("no model ids given")
        return self.models[0]

    @property
    def model2(self) -> str:
        return self.models[1] if len(self.models) > 1 else self.models[0]

    @classmethod
    def from_text(
        cls,
        start_date: str,
        end_date: str,
        order_ids: str,
        model1: str,
        model2: str,
        line_item_ids: str = "",
        alpha: float = DEFAULT_ALPHA,
        user_key: str = USER_ID_KEY,
    ) -> "Params":
        """Build from the six text inputs of the dashboard form."""
        return cls(
            start_date=_as_date(start_date),
            end_date=_as_date(end_date),
            order_ids=parse_id_list(order_ids, required=True),
            models=(model1.strip(), model2.strip()),
            line_item_ids=parse_id_list(line_item_ids, required=False),
            alpha=alpha,
            user_key=user_key,
        )

    def with_line_items(self, ids: tuple[int, ...]) -> "Params":
        return replace(self, line_item_ids=tuple(ids))
