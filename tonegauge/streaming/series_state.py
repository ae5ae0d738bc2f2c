"""The daily series of each entity as keyed state: a batch touches its own rows and its entities' state.

Entities are dealt over a fixed number of groups, and a group keeps a map from entity to state: a call per
entity that a batch names, one frame in and one out per group. State per entity is one row per open day, the
`window_rows` days in front of them that later frames look back to, and the totals of all older days. A day is open until the entity's newest day is `keep_days`
further on, so late rows within that time land in the middle of the series and everything behind them
is corrected; later ones come out as `late` and change nothing. State does not grow with history.

What comes out of a batch: the current sums, statistics and flag of every day it changed (`day`), and the
current totals of every entity it touched (`entity`). Rows for the table of scored headlines (`scored`) may
travel along; they are dealt over the groups by their own hash and pass through.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import asdict
from datetime import date, datetime, timedelta, timezone
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tonegauge.config import RiskProfile
from tonegauge.schemas import columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

DAY, ENTITY, LATE, SCORED = "day", "entity", "late", "scored"
EPOCH = date(1970, 1, 1)
GROUPS = 256  # belongs to the state: a stream keeps the number it was started with
SUMS = ("headlines", "negatives", "value_sum", "value_count")
PARTIAL = columns(grp="integer", passes="boolean", entity="string", date="date", headlines="long", negatives="long", value_sum="double", value_count="long")
SERIES = columns(
    kind="string",
    entity="string",
    date="date",
    headlines="long",
    negatives="long",
    value_sum="double",
    value_count="long",
    daily_avg_sentiment="double",
    rolling_mean="double",
    rolling_std="double",
    z_score="double",
    anomaly_flag="boolean",
    anomaly_days="long",
    total_days="long",
)
# One value per entity: a row per kept day as parallel arrays, and the totals of all older days.
STATE = (
    "day array<int>, headlines array<bigint>, negatives array<bigint>, value_sum array<double>, value_count array<bigint>, "
    "flagged array<boolean>, closed_headlines bigint, closed_negatives bigint, closed_sum double, closed_count bigint, "
    "closed_anomaly_days bigint, closed_days bigint, as_of int"
)
DAY_PARTS = 6


def window_values(values: list[float | None], i: int, profile: RiskProfile):
    """Rolling mean, sample deviation, z-score and flag of the i-th day of a series."""
    first, end = (i + 1 - profile.window_rows, i + 1) if profile.frame_includes_today else (i - profile.window_rows, i)
    frame = [v for v in values[max(first, 0) : end] if v is not None]
    mean = std = z = None
    if len(frame) >= profile.min_periods:
        mean = math.fsum(frame) / len(frame)
        if len(frame) > 1:
            # A flat frame has deviation 0, whatever its mean was rounded to.
            flat = min(frame) == max(frame)
            std = 0.0 if flat else math.sqrt(math.fsum((v - mean) ** 2 for v in frame) / (len(frame) - 1))
    if mean is not None and std and values[i] is not None:
        z = (values[i] - mean) / std
    elif profile.null_z_as_zero:
        z = 0.0
    return mean, std, z, z is not None and abs(z) > profile.z_threshold


class Series:
    """The state of one entity between reading and writing it."""

    def __init__(self, profile: RiskProfile, keep_days: int, as_of: int, state: tuple | None):
        self.profile, self.keep_days, self.as_of = profile, keep_days, as_of
        kept = zip(*state[:DAY_PARTS]) if state else ()
        self.days: dict[int | None, list] = {day: held for day, *held in kept}
        self.closed = list(state[DAY_PARTS:]) if state else [0, 0, 0.0, 0, 0, 0, as_of]
        # Closed days lie in the past, so a later `as_of` takes the same share off all of them.
        self.closed[2] *= 0.5 ** (max(as_of - self.closed[6], 0) / profile.half_life_days)
        self.closed[6] = as_of

    def dated(self) -> list[int]:
        return sorted(d for d in self.days if d is not None)

    def horizon(self) -> float:
        """Newest closed day."""
        return max(self.dated(), default=-math.inf) - self.keep_days

    def add(self, rows: Iterator[tuple]) -> tuple[set, list[tuple]]:
        """Add partial sums; the days that changed, and the rows that came too late."""
        touched, late, horizon = set(), [], self.horizon()
        for day, *sums in rows:
            if day is not None and day <= horizon:
                late.append((day, *sums))
                continue
            held = self.days.setdefault(day, [0, 0, 0.0, 0, False])
            for k, value in enumerate(sums):
                held[k] += value
            touched.add(day)
        return touched, late

    def weight(self, day: int) -> float:
        return 0.5 ** (max(self.as_of - day, 0) / self.profile.half_life_days)

    def changed(self, touched: set) -> list[tuple]:
        """Sums and statistics of the touched days and of those whose frame holds one of them."""
        order = self.dated()
        means = [h[2] / h[3] if h[3] else None for h in map(self.days.get, order)]
        weighted = [None if m is None else m * self.weight(d) for d, m in zip(order, means)]
        out, last = [], -math.inf
        for i, day in enumerate(order):
            if day in touched:
                last = i
            if i - last <= self.profile.window_rows:
                held = self.days[day]
                held[4] = window_values(weighted, i, self.profile)[3]
                out.append((day, *held[:4], means[i], *window_values(means, i, self.profile)))
        if None in touched:
            out.append((None, *self.days[None][:4], None, None, None, None, False))
        return out

    def totals(self) -> tuple:
        """Headlines, negatives, weighted sum and count of values, anomaly days and days, of all time."""
        total = self.closed[:6]
        for day, (headlines, negatives, value_sum, value_count, flagged) in self.days.items():
            total[0] += headlines
            total[1] += negatives
            if day is not None:
                total[2] += value_sum * self.weight(day)
                total[3] += value_count
                total[4] += flagged
                total[5] += 1
        return tuple(total)

    def close(self) -> None:
        """Fold the closed days into the totals, but for those that later frames look back to."""
        horizon = self.horizon()
        old = [d for d in self.dated() if d <= horizon]
        for day in old[: -self.profile.window_rows or None]:
            headlines, negatives, value_sum, value_count, flagged = self.days.pop(day)
            added = (headlines, negatives, value_sum * self.weight(day), value_count, int(flagged), 1)
            self.closed[:6] = [a + b for a, b in zip(self.closed[:6], added)]

    def state(self) -> tuple:
        rows = [(day, *held) for day, held in self.days.items()]
        return (*map(list, zip(*rows)), *self.closed)


class EntitySeries(StatefulProcessor):
    """Keyed by group; the rows of a group are sums of its entities and rows that only pass through."""

    def __init__(self, profile: RiskProfile, as_of: date | None, keep_days: int, idle_ttl_ms: int | None, schema: StructType):
        # Plain values travel without the class they come from.
        self.profile = SimpleNamespace(**asdict(profile))
        self.as_of, self.keep_days, self.ttl, self.schema = as_of, keep_days, idle_ttl_ms, schema
        # A row of the series has nothing in the columns that only pass through.
        self.beyond = [None] * (len(schema) - len(SERIES))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("series", "entity string", STATE, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sums: dict[str, list[tuple]] = {}
        for part in rows:
            passes = part["passes"].astype(bool)
            if passes.any():
                # As objects: a column without any value would count as numbers and not turn into text.
                yield part[passes].assign(kind=SCORED).reindex(columns=self.schema.names).astype(object)
            own = part[~passes]
            for entity, day, headlines, negatives, value_sum, value_count in zip(*(own[c] for c in ("entity", "date", *SUMS))):
                number = None if day is None or pd.isna(day) else (day - EPOCH).days
                value_sum = 0.0 if pd.isna(value_sum) else float(value_sum)
                sums.setdefault(entity, []).append((number, int(headlines), int(negatives), value_sum, int(value_count)))
        as_of = ((self.as_of or datetime.now(timezone.utc).date()) - EPOCH).days
        out: list[tuple] = []
        for entity, partial in sums.items():
            out += self.updated(entity, partial, as_of)
        if out:
            yield pd.DataFrame(out, columns=self.schema.names, dtype=object)

    def updated(self, entity: str, partial: list[tuple], as_of: int) -> list[tuple]:
        """Bring an entity's state up to date; its rows for the output."""
        state = self.held.getValue((entity,)) if self.held.containsKey((entity,)) else None
        series = Series(self.profile, self.keep_days, as_of, state)
        touched, late = series.add(iter(partial))
        rows = [(DAY, *row, None, None) for row in series.changed(touched)]
        rows += [(LATE, *row, *[None] * 7) for row in late]
        if touched:
            headlines, negatives, value_sum, value_count, anomaly_days, total_days = series.totals()
            rows.append((ENTITY, None, headlines, negatives, value_sum, value_count, *[None] * 5, anomaly_days, total_days))
            series.close()
            self.held.updateValue((entity,), series.state())
        return [(kind, entity, None if day is None else EPOCH + timedelta(days=day), *rest, *self.beyond) for kind, day, *rest in rows]

    def close(self) -> None:
        pass


def partial_days(scored: DataFrame, passing: StructType | None = None) -> DataFrame:
    """Sums per entity and day of each Arrow batch: what is shuffled is no more than that, also for an entity
    that holds most of the rows. With `passing` the scored rows travel along, with a hash of their own."""
    carried = passing or StructType([])
    label = F.col("predicted_label").eqNullSafe(F.lit("negative")).cast("long")
    rows = scored.filter(F.col("entity").isNotNull()).select(
        F.col("entity").alias("__entity"),
        F.to_date("date").alias("__date"),
        F.col("sentiment_score").cast("double").alias("__value"),
        label.alias("__negative"),
        F.hash(*(carried.names or ["entity"])).alias("__hash"),
        *[F.col(n) for n in carried.names],
    )
    own = [f for f in carried if f.name not in ("entity", "date")]
    schema = StructType([*PARTIAL.fields, *own])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ones = pa.array([1] * len(batch), pa.int64())
            keyed = pa.table([table["__entity"], table["__date"], ones, table["__negative"], table["__value"]], names=["entity", "date", "one", "negative", "value"])
            sums = keyed.group_by(["entity", "date"]).aggregate([("one", "sum"), ("negative", "sum"), ("value", "sum"), ("value", "count")])
            n = len(sums)
            named = {
                "grp": pa.nulls(n, pa.int32()),
                "passes": pa.array([False] * n, pa.bool_()),
                "entity": sums["entity"],
                "date": sums["date"],
                "headlines": sums["one_sum"],
                "negatives": sums["negative_sum"],
                "value_sum": sums["value_sum"],
                "value_count": sums["value_count"],
            }
            kinds = {f.name: table.schema.field(f.name).type for f in own}
            parts = [pa.table({**named, **{name: pa.nulls(n, kind) for name, kind in kinds.items()}})]
            if carried.names:
                through = {name: pa.nulls(len(batch), parts[0].schema.field(name).type) for name in named}
                passes = pa.array([True] * len(batch), pa.bool_())
                through |= {"grp": table["__hash"], "passes": passes, "entity": table["__entity"], "date": table["__date"]}
                parts.append(pa.table({**through, **{name: table[name] for name in kinds}}))
            for part in parts:
                yield from part.combine_chunks().to_batches()

    return rows.mapInArrow(summed, schema)


def series_rows(
    scored: DataFrame,
    profile: RiskProfile,
    as_of: date | None,
    keep_days: int,
    idle_ttl_ms: int | None = None,
    passing: StructType | None = None,
    groups: int = GROUPS,
) -> DataFrame:
    """The stream of changed days and entities (`SERIES`, and the columns of `passing`) of scored headlines."""
    own = [f for f in passing or [] if f.name not in SERIES.names]
    schema = StructType([*SERIES.fields, *own])
    keyed = partial_days(scored, passing).withColumn("grp", F.pmod(F.coalesce("grp", F.hash("entity")), F.lit(groups)))
    return keyed.groupBy("grp").transformWithStateInPandas(
        statefulProcessor=EntitySeries(profile, as_of, keep_days, idle_ttl_ms, schema),
        outputStructType=schema,
        outputMode="Append",
        timeMode="ProcessingTime" if idle_ttl_ms else "None",
    )


def totals_with_shares(entities: DataFrame, profile: RiskProfile) -> DataFrame:
    """The `entity` rows in the shape from which a summary is finished; flags count from enough history on."""
    days = F.col("total_days")
    enough = days >= profile.min_history_days

    def counted(c: Column) -> Column:
        return F.when(enough, c).otherwise(F.lit(0).cast("long"))

    return entities.select(
        "entity",
        F.col("headlines").alias("total_headlines"),
        (F.col("negatives").cast("double") / F.col("headlines")).alias("negative_share"),
        counted(F.col("anomaly_days")).alias("anomaly_days"),
        F.greatest(counted(days), F.lit(1).cast("long")).alias("total_days"),
        F.try_divide("value_sum", "value_count").alias("avg_sentiment"),
    )
