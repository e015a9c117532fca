"""History features: what was known of a runner before the row.

Rows are ordered by (date, id) inside a key and only earlier rows are read. Each family
returns a feature table keyed by ``res_id``; the ``add_*`` forms keep the input columns, so
that several families share one pass (see ``plans.features``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake import schema
from formlake.functions import parsing
from formlake.operators.skew import (
    KeyScan,
    chunked_totals,
    dealt,
    running_totals,
    split_hot,
    with_group_values,
    with_lookback,
)

ORDER = ("date", "id")
_SOLO = "_solo"

Previous = Callable[[str, int], Column]


@dataclass(frozen=True)
class Lookback:
    """A family that reads a fixed number of earlier rows of the key.

    ``fields`` gives the values remembered of a row and how many rows back they are read;
    ``outputs`` builds the features from ``previous(field, rows_back)``, NULL where there is
    no such row; 0 rows back is the row itself.
    """

    fields: dict[str, tuple[Column, int]]
    outputs: Callable[[Previous], dict[str, Column]]


def _position(df: DataFrame) -> Column:
    return F.col("pos_num") if "pos_num" in df.columns else parsing.position_number("pos")


def _mean(values: Sequence[Column], digits: int) -> Column:
    """Mean of the values that are there, oldest first so sums round the same way everywhere."""
    total, count = F.lit(0.0), F.lit(0)
    for value in reversed(values):
        total = total + F.coalesce(value, F.lit(0.0))
        count = count + value.isNotNull().cast("int")
    return F.when(count > 0, F.round(total / F.nullif(count, F.lit(0)), digits))


def form_family(df: DataFrame, short: int = 3, long: int = 5, fill: float = 20.0) -> Lookback:
    margin = parsing.to_number("btn") if dict(df.dtypes)["btn"] == "string" else F.col("btn")

    def outputs(previous: Previous) -> dict[str, Column]:
        margins = [previous("btn", k) for k in range(1, long + 1)]
        return {
            f"avg_btn_{short}": _mean(margins[:short], 2),
            f"avg_btn_{long}": _mean(margins, 2),
            "days_since_last": F.datediff("date", previous("day", 1)),
            "last_pos": previous("pos", 1),
        }

    return Lookback(
        {
            "btn": (F.coalesce(margin.cast("double"), F.lit(fill)), long),
            "pos": (F.coalesce(_position(df).cast("double"), F.lit(fill)), 1),
            "day": (F.col("date"), 1),
        },
        outputs,
    )


def class_family(df: DataFrame, window: int = 3) -> Lookback:
    """Class 0 wipes the memory, so reading back stops at the first zero."""
    def outputs(previous: Previous) -> dict[str, Column]:
        now = previous("class", 0)
        alive = now > 0
        kept = []
        for k in range(1, window + 1):
            alive = alive & (previous("class", k) > 0)
            kept.append(F.when(alive, previous("class", k)))
        return {
            "class_diff": F.coalesce((now - kept[0]).try_cast("int"), F.lit(0)),
            f"avg_class_{window}": F.coalesce(_mean(kept, 2), F.lit(0.0)),
        }

    return Lookback({"class": (parsing.extract_class("class"), window)}, outputs)


def gear_family(key: str = "horse") -> Lookback:
    def outputs(previous: Previous) -> dict[str, Column]:
        worn, before = F.coalesce("hg", F.lit("")), F.coalesce(previous("hg", 1), F.lit(""))
        known = F.when(F.col(key).isNotNull(), before).otherwise("")
        return {"gear_change": ((worn != known) & (worn != "")).cast("int")}

    return Lookback({"hg": (F.col("hg"), 1)}, outputs)


def rating_family(key: str = "horse") -> Lookback:
    def outputs(previous: Previous) -> dict[str, Column]:
        change = F.when(F.col(key).isNotNull(), F.col("official_rating") - previous("rating", 1))
        return {"or_change": F.coalesce(change.try_cast("int"), F.lit(0))}

    return Lookback({"rating": (F.col("official_rating"), 1)}, outputs)


def horse_families(df: DataFrame) -> list[Lookback]:
    """All families that read back along the horse's runs."""
    return [form_family(df), class_family(df), gear_family(), rating_family()]


def _solo_nulls(df: DataFrame, keys: Sequence[str], null_keys: str) -> tuple[DataFrame, list[str]]:
    """With ``no_history`` every row with a NULL key becomes a key of its own."""
    if null_keys == "shared":
        return df, list(keys)
    if null_keys != "no_history":
        raise ValueError(f"null_keys is 'shared' or 'no_history', not {null_keys!r}")
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.withColumn(_SOLO, F.when(missing, F.col("id"))), [*keys, _SOLO]


def add_lookbacks(
    df: DataFrame,
    key: str,
    families: Sequence[Lookback],
    scan: KeyScan | None = None,
    null_keys: str = "shared",
    observed: str | None = None,
) -> DataFrame:
    """Adds the features of several families in one pass over the key's rows.

    ``observed`` names a boolean column; rows where it is false get features but are nobody's
    history.
    """
    fields = {name: spec for family in families for name, spec in family.fields.items()}
    depths = {name: depth for name, (_, depth) in fields.items()}
    depth = max(depths.values())
    rows, keys = _solo_nulls(df, [key], null_keys)
    rows = rows.withColumns({f"_now_{name}": value for name, (value, _) in fields.items()})
    if observed:
        memory = F.struct(*[F.col(f"_now_{name}").alias(name) for name in fields])
        rows = rows.withColumn("_memory", F.when(F.col(observed), memory))
    carried = ["_memory", observed] if observed else [f"_now_{name}" for name in fields]

    def previous(name: str, back: int) -> Column:
        if back == 0:
            return F.col(f"_now_{name}")
        return F.col(f"_back_{back}")[name] if observed else F.col(f"_back_{back}_{name}")

    def apply(part_rows: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*ORDER)
        if observed:
            spec = f"over (partition by {', '.join(f'`{p}`' for p in part)} order by {', '.join(ORDER)})"
            backs = {
                f"_back_{k}": F.expr(f"lag(_memory, {k}) ignore nulls {spec}") for k in range(1, depth + 1)
            }
        else:
            backs = {
                f"_back_{k}_{name}": F.lag(f"_now_{name}", k).over(w)
                for name, deepest in depths.items()
                for k in range(1, deepest + 1)
            }
        found = part_rows.withColumns(backs)
        for family in families:
            found = found.withColumns(family.outputs(previous))
        return found.drop(*backs)

    done = with_lookback(
        rows, keys, ORDER, depth, carried, apply, scan if keys == [key] else None,
        F.col(observed) if observed else None,
    )
    return done.drop(*[f"_now_{name}" for name in fields], "_memory", _SOLO)


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only what a family reads: chunks of over-full keys are written out, and an optimizer
    cannot prune columns behind that."""
    wanted = {"id", *columns}
    if "pos" in wanted and "pos_num" in df.columns:
        wanted = wanted - {"pos"} | {"pos_num"}
    return df.select(*[c for c in df.columns if c in wanted])


def deal(df: DataFrame, keys: Sequence[str], scan: KeyScan, null_keys: str = "shared") -> DataFrame:
    """Rows dealt by key so that no window spills; over-full keys are split anyway, and NULLs that are keys of their own
    mustn't meet in one task."""
    plain = null_keys == "shared" and scan.hot(keys) is None
    return dealt(df, keys, scan.rows) if plain else df


def _table(df: DataFrame, columns: Sequence[str], id_name: str = "res_id") -> DataFrame:
    return df.select(F.col("id").alias(id_name), *columns)


def recent_form(
    df: DataFrame, key: str = "horse", short: int = 3, long: int = 5, fill: float = 20.0,
    null_keys: str = "shared",
) -> DataFrame:
    """Mean margin of the last 3 and 5 runs, days since the last run and its position."""
    runs = narrow(df, "date", key, "pos", "btn")
    scan = KeyScan(runs)
    out = add_lookbacks(
        deal(runs, [key], scan, null_keys), key, [form_family(runs, short, long, fill)], scan, null_keys)
    return _table(out, [f"avg_btn_{short}", f"avg_btn_{long}", "days_since_last", "last_pos"])


def class_moves(
    df: DataFrame, key: str = "horse", window: int = 3, null_keys: str = "shared"
) -> DataFrame:
    """Class change against the previous run and the mean of up to three previous classes."""
    runs = narrow(df, "date", key, "class")
    scan = KeyScan(runs)
    out = add_lookbacks(deal(runs, [key], scan, null_keys), key, [class_family(runs, window)], scan, null_keys)
    return _table(out, ["class_diff", f"avg_class_{window}"])


def gear_change(df: DataFrame, key: str = "horse") -> DataFrame:
    runs = narrow(df, "date", key, "hg")
    return _table(add_lookbacks(runs, key, [gear_family(key)]), ["gear_change"], "id")


def rating_change(df: DataFrame, key: str = "horse") -> DataFrame:
    runs = narrow(df, "date", key, "official_rating")
    return _table(add_lookbacks(runs, key, [rating_family(key)]), ["or_change"], "id")


def true_weight_of(df: DataFrame) -> Column:
    weight = F.col("wgt_lbs") if "wgt_lbs" in df.columns else parsing.parse_weight("wgt")
    return (weight - F.coalesce("jockey_allowance", F.lit(0))).cast("int")


def true_weight(df: DataFrame) -> DataFrame:
    return df.select("id", true_weight_of(df).alias("true_wgt"))


def add_race_value(df: DataFrame, group: str = "race_id", scan: KeyScan | None = None) -> DataFrame:
    prized = df.withColumn("_prize", parsing.parse_prize("prize"))
    out = with_group_values(prized, [group], {"race_value": F.max("_prize")}, scan).drop("_prize")
    value = F.when(F.col(group).isNotNull(), F.col("race_value"))
    return out.withColumn("race_value", value).withColumn("log_prize", F.log1p("race_value"))


def race_value(df: DataFrame, group: str = "race_id") -> DataFrame:
    """Largest prize of the race, the same for all its runners, and its log1p."""
    return add_race_value(narrow(df, group, "prize"), group).select("id", "race_value", "log_prize")


def micro_features(df: DataFrame, key: str = "horse", group: str = "race_id") -> DataFrame:
    """Gear change, rating change, true weight and log prize, one row per result."""
    runs = narrow(
        df, "date", key, group, "hg", "official_rating", "prize", "wgt", "wgt_lbs", "jockey_allowance"
    )
    scan = KeyScan(runs)
    out = add_race_value(deal(runs.withColumn("true_wgt", true_weight_of(runs)), [group], scan), group, scan)
    out = add_lookbacks(deal(out, [key], scan), key, [gear_family(key), rating_family(key)], scan)
    return out.select("id", *schema.MICRO_COLUMNS)


def _flags(df: DataFrame, places: int, observed: str | None) -> dict[str, Column]:
    ran = F.col(observed).cast("int") if observed else F.lit(1)
    pos = _position(df)
    return {"_n": ran, "_w": ran * parsing.is_win(pos), "_p": ran * parsing.is_place(pos, places)}


def _percent(part: str, whole: str) -> Column:
    rate = F.col(part) / F.nullif(F.col(whole), F.lit(0))
    return F.coalesce(F.round(rate, 3), F.lit(0.0))


def add_place_stats(
    df: DataFrame,
    keys: Sequence[str] = ("horse", "course"),
    places: int = 3,
    scan: KeyScan | None = None,
    null_keys: str = "shared",
    observed: str | None = None,
) -> DataFrame:
    rows, part = _solo_nulls(df, keys, null_keys)
    out = running_totals(
        rows, part, [F.col(c) for c in ORDER],
        {f"_sum{k}": v for k, v in _flags(df, places, observed).items()},
        scan if part == list(keys) else None,
    )
    return out.withColumns({
        "h_course_runs": F.col("_sum_n"),
        "h_course_wins": F.col("_sum_w"),
        "h_course_place_pc": _percent("_sum_p", "_sum_n"),
    }).drop("_sum_n", "_sum_w", "_sum_p", _SOLO)


def entity_place_stats(
    df: DataFrame, keys: Sequence[str] = ("horse", "course"), places: int = 3, null_keys: str = "shared"
) -> DataFrame:
    """Earlier runs, wins and place rate of the entity at the place, over its whole life."""
    runs = narrow(df, "date", *keys, "pos")
    scan = KeyScan(runs)
    out = add_place_stats(deal(runs, keys, scan, null_keys), keys, places, scan, null_keys)
    return _table(out, schema.COURSE_COLUMNS)


def _trailing_plain(df, keys, days, same_day, flags) -> DataFrame:
    """Rows before this one minus rows that have left the window.

    Both frames start at the first row, so each is computed by adding every row once; a frame
    with two moving ends would be summed again for every row.
    """
    by_row = Window.partitionBy(*keys).orderBy("_day", "id").rowsBetween(Window.unboundedPreceding, -1)
    by_day = Window.partitionBy(*keys).orderBy("_day")
    seen = by_row if same_day == "earlier_rows" else by_day.rangeBetween(Window.unboundedPreceding, -1)
    gone = by_day.rangeBetween(Window.unboundedPreceding, -(days + 1))
    out = df.withColumns({f"_seen{k}": F.coalesce(F.sum(v).over(seen), F.lit(0)) for k, v in flags.items()})
    out = out.withColumns({f"_gone{k}": F.coalesce(F.sum(v).over(gone), F.lit(0)) for k, v in flags.items()})
    return out.withColumns({f"_sum{k}": F.col(f"_seen{k}") - F.col(f"_gone{k}") for k in flags}).drop(
        *[f"_seen{k}" for k in flags], *[f"_gone{k}" for k in flags]
    )


def _trailing_split(df, keys, days, same_day, flags, scan, hot) -> DataFrame:
    """Over-full keys: the window becomes plain running totals of dated changes.

    Daily totals leave as negative changes ``days + 1`` later (and, when the day itself does
    not count, enter as positive ones a day later); the rows themselves are the other changes.
    """
    daily = df.groupBy(*keys, "_day").agg(*[F.sum(v).alias(k) for k, v in flags.items()])
    leave = daily.select(
        *keys, (F.col("_day") + days + 1).alias("_day"), *[(-F.col(k)).alias(k) for k in flags]
    )
    enter = daily.withColumn("_day", F.col("_day") + 1)
    counted = same_day == "earlier_rows"
    changes = leave if counted else leave.unionByName(enter)
    rows = df.withColumns({k: v if counted else F.lit(0) for k, v in flags.items()})
    stream = rows.withColumn("_row", F.lit(1)).unionByName(
        changes.withColumn("_row", F.lit(0)), allowMissingColumns=True
    )
    # A key here has all its rows plus at most two changes per day, and every key is over-full.
    out = chunked_totals(
        stream, keys, [F.col("_day"), F.col("_row"), F.col("id")],
        {f"_sum{k}": F.col(k) for k in flags}, hot.n_rows, scan.policy,
    )
    return out.where("_row = 1").drop("_row", *flags)


def add_pair_stats(
    df: DataFrame,
    keys: Sequence[str] = ("trainer", "jockey"),
    days: int = 365,
    same_day: str = "earlier_rows",
    scan: KeyScan | None = None,
    null_keys: str = "shared",
    observed: str | None = None,
) -> DataFrame:
    if same_day not in ("earlier_rows", "exclude"):
        raise ValueError(f"same_day is 'earlier_rows' or 'exclude', not {same_day!r}")
    flags = _flags(df, 3, observed)
    rows, part = _solo_nulls(df.withColumn("_day", F.unix_date("date")), keys, null_keys)
    if scan is None or part != list(keys):
        scan = KeyScan(rows)
    hot = scan.hot(part)
    if hot is None:
        out = _trailing_plain(rows, part, days, same_day, flags)
    else:
        cold_rows, hot_rows = split_hot(rows, hot)
        out = _trailing_plain(cold_rows, part, days, same_day, flags).unionByName(
            _trailing_split(hot_rows, part, days, same_day, flags, scan, hot)
        )
    return out.withColumns({
        "combo_runs": F.col("_sum_n"),
        "combo_wins": F.col("_sum_w"),
        "combo_win_pc": _percent("_sum_w", "_sum_n"),
        "combo_place_pc": _percent("_sum_p", "_sum_n"),
    }).drop("_sum_n", "_sum_w", "_sum_p", "_day", _SOLO)


def pair_trailing_stats(
    df: DataFrame,
    keys: Sequence[str] = ("trainer", "jockey"),
    days: int = 365,
    same_day: str = "earlier_rows",
    null_keys: str = "shared",
) -> DataFrame:
    """Runs, wins, win rate and place rate of the pair in the ``days`` before the row.

    A run exactly ``days`` old still counts. Earlier rows of the same day count unless
    ``same_day='exclude'``.
    """
    runs = narrow(df, "date", *keys, "pos")
    scan = KeyScan(runs)
    out = add_pair_stats(deal(runs, keys, scan, null_keys), keys, days, same_day, scan, null_keys)
    return _table(out, schema.SYNERGY_COLUMNS)
