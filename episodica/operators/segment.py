"""Segmentation of episodes from their signals: holds of grippers, and spells of little drift.

Frames are brought together by episode once; moving sums are windows over them, and all that depends
on what was found before are expressions over an episode's arrays. One exchange, by episode.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions import arrays, signal

#: Where points go, as shares of the episode, if what was found is out of order.
SHARES = (0.12, 0.20, 0.34, 0.52, 0.62, 0.90)
EGO_SHARES = (0.20, 0.37, 0.45, 0.77, 0.91)


class _Smoothed:
    """Of what has the seconds over which speeds (raw) and positions (carrier) are smoothed."""

    def widths(self) -> tuple[int, int]:
        """The frames of both, odd numbers."""
        return int(self.raw * self.fps) | 1, int(self.carrier * self.fps) | 1


@dataclass(frozen=True)
class Hold(_Smoothed):
    """Fixed values of the two-gripper task; times are seconds."""

    fps: float = 30
    closed: float = 0.35
    gap: float = 0.4
    least: float = 0.3
    raw: float = 0.3
    carrier: float = 1.0
    onset_gap: float = 0.5
    onset_percentile: float = 0.45
    grind_percentile: float = 0.40
    grind_raw: int = 12  # per cent of the largest speed
    grind_gap: float = 1.2
    grind_least: float = 0.8
    first_part: float = 0.75


@dataclass(frozen=True)
class Wipe(_Smoothed):
    """Fixed values of the wiping task; times are seconds."""

    fps: float = 60
    closed: float = 0.45
    gap: float = 0.30
    least: float = 0.30
    raw: float = 0.15
    carrier: float = 0.60
    wipe_raw: int = 15
    wipe_percentile: float = 0.45
    wipe_gap: float = 0.50
    wipe_least: float = 0.4
    otherwise: float = 0.25


def whole(x: Column) -> Column:
    return F.round(x).cast("long")


def motion(frames: DataFrame, dims: list[str], raw_width: int, carrier_width: int, zscore: bool = True) -> DataFrame:
    """frames (ep, f, ...) with raw, the smoothed length of steps over dims, and drift, that of the smoothed signal.

    Sums instead of means, of whole numbers (1e-4 of a standard deviation, or of the signal's own unit), so that results
    do not depend on the order of additions; both are compared with their own percentiles and maxima only.
    """
    z = {f"_{d}": whole(signal.zscore(F.col(d)) * 10000) if zscore else F.col(d).cast("long") for d in dims}
    rows = frames.withColumns(z).withColumns({f"_s{d}": signal.smooth_sum(F.col(f"_{d}"), carrier_width) for d in dims})
    long = lambda cs: whole(signal.length(*(signal.step(F.col(c)).cast("double") for c in cs)))
    rows = rows.withColumns({"_raw": long([f"_{d}" for d in dims]), "_drift": long([f"_s{d}" for d in dims])})
    rows = rows.withColumns({"raw": signal.smooth_sum(F.col("_raw"), raw_width), "drift": signal.smooth_sum(F.col("_drift"), raw_width)})
    return rows.drop("_raw", "_drift", *(f"{p}{d}" for d in dims for p in ("_", "_s")))


def _arrays(rows: DataFrame, names: list[str]) -> DataFrame:
    """A row per episode: n and the array of each name, in order of frames."""
    held = rows.groupBy("ep").agg(F.sort_array(F.collect_list(F.struct("f", *names))).alias("rows"))
    return held.select("ep", F.size("rows").cast("long").alias("n"), *(F.col(f"rows.{c}").alias(c) for c in names))


def _away(values: Column, limit: float, one_sided: bool = False) -> Column:
    """Where a normalised signal is away from rest, or below it."""

    def mask(g: Column) -> Column:
        on = (lambda x, r: x < r - limit) if one_sided else (lambda x, r: F.abs(x - r) > limit)
        return arrays.let(arrays.rest(g), lambda r: F.transform(g, lambda x: on(x, r)))

    return arrays.let(arrays.norm01(values), mask)


def _between(mask: Column, low: Column, high: Column) -> Column:
    return F.transform(mask, lambda on, i: on & (i >= low) & (i < high))


def _part(values: Column, low: Column, high: Column) -> Column:
    """values[low:high]."""
    return F.slice(values, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))


def held_tasks(frames: DataFrame, p: Hold = Hold()) -> DataFrame:
    """Six points of each episode of frames (ep, f, tube, pestle, raw, drift), what they come from, and flags.

    e1, e2: the tube's hold; onset: where little drift begins in it; f1, f2: the pestle's hold; s, e: the grinding.
    """
    frame = lambda seconds: int(seconds * p.fps)
    n, c = F.col("n"), F.col
    rows = _arrays(frames, ["tube", "pestle", "raw", "drift"])
    rows = rows.withColumns({"tube_on": _away(c("tube"), p.closed), "pestle_on": _away(c("pestle"), p.closed)})
    rows = rows.withColumn("h", arrays.hold(_between(c("tube_on"), F.lit(0), arrays.share(n, p.first_part)), frame(p.gap)))
    rows = rows.withColumn("no_tube", (c("h.e") - 1 <= c("h.s")) | (c("h.e") - 1 - c("h.s") < p.least * p.fps))
    rows = rows.withColumn("e1", F.when(c("no_tube"), arrays.share(n, SHARES[0])).otherwise(c("h.s")))
    rows = rows.withColumn("e2", F.when(c("no_tube"), arrays.share(n, SHARES[2])).otherwise(c("h.e") - 1))
    part = _part(c("drift"), c("e1"), c("e2") + 1)
    low = arrays.let(part, lambda d: arrays.let(arrays.percentile(d, p.onset_percentile), lambda limit: F.transform(d, lambda x: x < limit)))
    onset = F.when(F.size(part) >= 3, c("e1") + arrays.hold(low, frame(p.onset_gap))["s"]).otherwise(c("e1") + arrays.share(c("e2") - c("e1"), 0.4))
    rows = rows.withColumn("onset", F.least(F.greatest(onset, c("e1") + 1), c("e2") - 1))
    rows = rows.withColumn("h", arrays.hold(_between(c("pestle_on"), c("e2") + 1, n), frame(p.gap)))
    rows = rows.withColumn("no_pestle", (c("h.e") - 1 <= c("h.s")) | (c("h.e") - 1 - c("h.s") < p.least * p.fps))
    rows = rows.withColumn("f1", F.when(c("no_pestle"), arrays.share(n, 0.58)).otherwise(c("h.s")))
    rows = rows.withColumn("f2", F.when(c("no_pestle"), arrays.share(n, 0.92)).otherwise(c("h.e") - 1))
    limits = F.struct(arrays.percentile(c("drift"), p.grind_percentile).alias("drift"), (F.array_max("raw") * p.grind_raw).alias("raw"))
    busy = arrays.let(limits, lambda k: F.zip_with("drift", "raw", lambda d, r: (d < k["drift"]) & (r * 100 > k["raw"])))
    rows = rows.withColumn("h", arrays.hold(_between(busy, c("f1") + 1, n), frame(p.grind_gap)))
    rows = rows.withColumn("no_grind", ~(c("h.e") - c("h.s") > p.grind_least * p.fps))
    rows = rows.withColumn("s", F.when(c("no_grind"), (c("f1") + F.lit(0.1) * n).cast("long")).otherwise(c("h.s")))
    rows = rows.withColumn("e", F.when(c("no_grind"), c("f2")).otherwise(c("h.e") - 1))
    found = [c("e1"), c("onset"), c("e2") + 1, c("f1"), c("s"), F.least(c("e") + 1, c("f2"))]
    return _ordered(rows, found, SHARES, ["no_tube", "no_pestle", "no_grind"]).select("ep", "n", "cps", "flags", "e1", "e2", "onset", "f1", "f2", "s", "e")


def _ordered(rows: DataFrame, found: list[Column], shares: tuple[float, ...], flags: list[str]) -> DataFrame:
    """rows with cps, what was found if it increases strictly inside the episode, else the shares, and with flags."""
    n = F.col("n")
    ok = (found[0] > 0) & (found[-1] < n - 1)
    for x, y in zip(found, found[1:]):
        ok = ok & (x < y)
    rows = rows.withColumn("order", ~ok)
    points = F.when(ok, F.array(*found)).otherwise(F.array(*(arrays.share(n, p) for p in shares)))
    named = F.array_compact(F.array(*(F.when(F.col(x), F.lit(x)) for x in [*flags, "order"])))
    return rows.withColumns({"cps": points, "flags": named})


def wiped(frames: DataFrame, p: Wipe = Wipe()) -> DataFrame:
    """Five points of each episode of frames (ep, f, left, right, left_raw, left_drift, right_raw, right_drift), and flags.

    The hand that holds longer, left if equal, is the holder, the other one the wiper.
    """
    frame = lambda seconds: int(seconds * p.fps)
    n, c = F.col("n"), F.col
    rows = _arrays(frames, ["left", "right", "left_raw", "left_drift", "right_raw", "right_drift"])
    rows = rows.withColumns({f"{x}_run": arrays.hold(_away(c(x), p.closed, one_sided=True), frame(p.gap)) for x in ("left", "right")})
    length = lambda x: c(f"{x}_run.e") - c(f"{x}_run.s")
    rows = rows.withColumns({f"no_{x}": length(x) < p.least * p.fps for x in ("left", "right")})
    left = length("left") >= length("right")
    rows = rows.withColumns({"holder": F.when(left, "left").otherwise("right"), "wiper": F.when(left, "right").otherwise("left")})
    rows = rows.withColumns({"tube": F.when(left, c("left_run")).otherwise(c("right_run")), "cloth": F.when(left, c("right_run")).otherwise(c("left_run"))})
    rows = rows.withColumns({k: F.when(left, c(f"right_{k}")).otherwise(c(f"left_{k}")) for k in ("raw", "drift")})
    low, high = c("cloth.s"), c("cloth.e")
    parts = {k: _part(c(k), low, high) for k in ("raw", "drift")}
    rows = rows.withColumns({f"part_{k}": x for k, x in parts.items()})
    limits = F.struct(arrays.percentile(c("part_drift"), p.wipe_percentile).alias("drift"), (F.array_max("part_raw") * p.wipe_raw).alias("raw"))
    busy = arrays.let(limits, lambda k: F.zip_with("part_drift", "part_raw", lambda d, r: (d < k["drift"]) & (r * 100 > k["raw"])))
    rows = rows.withColumn("run", arrays.hold(busy, frame(p.wipe_gap)))
    short = (high - low < frame(p.wipe_least)) | (F.size("part_raw") < 3) | ~F.coalesce(F.array_max("part_raw") > 0, F.lit(False))
    rows = rows.withColumn("no_wipe", short | (c("run.e") - c("run.s") < frame(p.wipe_least)))
    start = F.when(c("no_wipe"), low + arrays.share(high - low, p.otherwise)).otherwise(low + c("run.s"))
    found = [c("tube.s"), low, start, high, c("tube.e")]
    return _ordered(rows, found, EGO_SHARES, ["no_left", "no_right", "no_wipe"]).select("ep", "n", "cps", "flags", "holder", "wiper")
