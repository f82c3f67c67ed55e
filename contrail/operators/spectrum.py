"""Power spectra, peaks and vibration reports for many series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.functions.geometry import vibration_level
from contrail.operators.series import exact_quantile, open_series

DB_FLOOR = 1e-20
LEVELS = ["GOOD", "ACCEPTABLE", "WARNING", "CRITICAL"]


def sample_rates(df: DataFrame, keys: Sequence[str], order: Sequence[str], lo: float = 50.0, hi: float = 2000.0,
                 max_rows: int | None = None) -> DataFrame:
    """(keys, fs, n): rate from the median time step, clipped to [lo, hi]; series without one drop out."""
    keys, ts = list(keys), order[0]
    s = open_series(df.select(*keys, *order), keys, order, max_rows).shift({"_t0": ts})
    steps = s.df.select(*keys, (F.col(ts) - F.col("_t0")).alias("_dt"))
    mid = exact_quantile(steps, keys, "_dt", 0.5, max_rows, [df]).where("_dt > 0")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    fs = F.least(F.greatest(F.lit(1e6) / F.col("_dt"), F.lit(lo)), F.lit(hi))
    return mid.join(n, keys).select(*keys, fs.alias("fs"), "n")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _segment_psd(values: pd.Series, fs: pd.Series) -> pd.Series:
    """One-sided Hann periodogram (density) of each segment after removing its mean."""
    out = []
    for v, rate in zip(values, fs):
        x = np.asarray(v, dtype=float)
        n = len(x)
        win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        p = np.abs(np.fft.rfft((x - x.mean()) * win)) ** 2 / (rate * np.sum(win**2))
        p[1 : -1 if n % 2 == 0 else None] *= 2
        out.append(p)
    return pd.Series(out)


def welch(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], channels: dict[str, str], max_segment: int = 512,
    min_segment: int = 16, rate_bounds: tuple[float, float] = (50.0, 2000.0), max_rows: int | None = None,
) -> DataFrame:
    """Welch spectrum per series and channel, long form: (keys, axis, bin, hz, psd, psd_db).

    Segments of min(max_segment, n // 4) rows overlap by half.  Rows are numbered, sent to the one
    or two segments they lie in, and each segment is transformed on its own; bins are averaged with
    partial aggregation.  No group grows beyond a segment."""
    keys, ts = list(keys), order[0]
    rates = sample_rates(df, keys, order, *rate_bounds, max_rows)
    values = F.array(*[F.col(c).cast("double") for c in channels.values()])
    s = open_series(df.select(*keys, *order, values.alias("_v")), keys, order, max_rows).number("_i")
    seg = F.least(F.lit(max_segment), F.floor(F.col("n") / 4)).cast("long")
    rows = s.df.join(rates, keys).withColumn("_seg", seg).where(F.col("_seg") >= min_segment)
    pos = F.col("_i") - 1
    hop = F.col("_seg") - F.floor(F.col("_seg") / 2)
    first = F.greatest(F.lit(0).cast("long"), F.floor((pos - F.col("_seg")) / hop) + 1)
    last = F.least(F.floor(pos / hop), F.floor((F.col("n") - F.col("_seg")) / hop))
    placed = rows.where(first <= last).select(
        *keys, "fs", "_seg", pos.alias("_p"), "_v", F.explode(F.sequence(first, last)).alias("_k")
    )
    gathered = placed.groupBy(*keys, "_k").agg(
        F.max("fs").alias("fs"), F.max("_seg").alias("_seg"),
        F.array_sort(F.collect_list(F.struct("_p", "_v"))).alias("_rows"),
    )

    def channel(i: int) -> Column:
        return F.transform("_rows", lambda r: r["_v"][i])

    axes = F.array(*[F.struct(F.lit(a).alias("axis"), channel(i).alias("x")) for i, a in enumerate(channels)])
    spectra = gathered.select(*keys, "fs", "_seg", F.explode(axes).alias("a")).where(
        ~F.exists("a.x", lambda v: v.isNull())
    ).select(*keys, "fs", "_seg", "a.axis", _segment_psd("a.x", "fs").alias("_psd"))
    bins = spectra.select(*keys, "axis", "fs", "_seg", F.posexplode("_psd").alias("bin", "_pw"))
    out = bins.groupBy(*keys, "axis", "bin").agg(
        F.avg("_pw").alias("psd"), F.max("fs").alias("fs"), F.max("_seg").alias("_seg")
    )
    return out.select(
        *keys, "axis", "bin", (F.col("bin") * F.col("fs") / F.col("_seg")).alias("hz"), "psd",
        (F.log10(F.greatest("psd", F.lit(DB_FLOOR))) * 10).alias("psd_db"), "fs",
    )


def _prominent_peaks(y: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """Local maxima, thinned to ``distance`` bins (higher ones win), then filtered by prominence."""
    cand, i, n = [], 1, len(y)
    while i < n - 1:
        if y[i] > y[i - 1]:
            j = i
            while j < n - 1 and y[j + 1] == y[i]:
                j += 1
            if j < n - 1 and y[j + 1] < y[i]:
                cand.append((i + j) // 2)
            i = j
        i += 1
    keep = dict.fromkeys(cand, True)
    for p in sorted(cand, key=lambda k: (y[k], k), reverse=True):
        if keep[p]:
            for q in cand:
                if q != p and abs(q - p) < distance:
                    keep[q] = False
    out = []
    for p in (c for c in cand if keep[c]):
        higher = np.flatnonzero(y[:p] > y[p])
        left = y[(higher[-1] + 1 if len(higher) else 0) : p + 1].min()
        higher = np.flatnonzero(y[p + 1 :] > y[p])
        right = y[p : (p + 1 + higher[0] if len(higher) else n)].min()
        if y[p] - max(left, right) >= prominence:
            out.append(p)
    return np.array(out, dtype=int)


def spectral_peaks(
    spectrum: DataFrame, keys: Sequence[str], low_hz: float = 5.0, high_hz: float = 500.0,
    prominence_db: float = 6.0, spacing_hz: float = 5.0,
) -> DataFrame:
    """Peaks per series and axis, ranked by power: (keys, axis, rank, hz, db).

    A spectrum has at most max_segment / 2 + 1 bins, so a group is small whatever the series."""
    keys = list(keys)
    fields = [spectrum.schema[k] for k in keys]
    schema = T.StructType([
        *fields, T.StructField("axis", T.StringType()), T.StructField("rank", T.LongType()),
        T.StructField("hz", T.DoubleType()), T.StructField("db", T.DoubleType()),
    ])

    def peaks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        hz, db, fs = pdf["hz"].to_numpy(), pdf["psd_db"].to_numpy(), float(pdf["fs"].iloc[0])
        inside = (hz >= low_hz) & (hz <= min(fs / 2, high_hz))
        gap = max(1, int(spacing_hz / (hz[1] - hz[0]))) if len(hz) > 1 else 1
        at = _prominent_peaks(db[inside], gap, prominence_db)
        f, p = hz[inside][at], db[inside][at]
        by_power = np.argsort(p)[::-1]
        head = {k: np.full(len(at), pdf[k].iloc[0], dtype=object) for k in [*keys, "axis"]}
        return pd.DataFrame({**head, "rank": np.arange(1, len(at) + 1), "hz": f[by_power], "db": p[by_power]})

    return spectrum.groupBy(*keys, "axis").applyInPandas(peaks, schema)


def label_peaks(peaks: DataFrame, keys: Sequence[str], expected_hz: Column | None = None) -> DataFrame:
    """All peaks with the axis fundamental (strongest peak in 20-200 Hz) and harmonic order."""
    part = [*keys, "axis"]
    motor = F.min_by("hz", F.when(F.col("hz").between(20, 200), F.col("rank")))
    base = peaks.groupBy(*part).agg(motor.alias("motor_hz"))
    if expected_hz is not None:
        base = base.withColumn("motor_hz", expected_hz)
    rows = peaks.join(base, part)
    orders = F.filter(
        F.sequence(F.lit(1), F.lit(7)),
        lambda n: F.abs(F.col("hz") - F.col("motor_hz") * n) < F.col("motor_hz") * 0.05,
    )
    rows = rows.withColumn("harmonic_order", F.when(F.col("motor_hz").isNotNull() & (F.size(orders) > 0), F.array_min(orders)))
    label = F.when(
        F.col("harmonic_order").isNotNull(),
        F.format_string("%dP motor harmonic (%.1f Hz fund.)", "harmonic_order", "motor_hz"),
    ).when(F.col("motor_hz").isNotNull(), F.format_string("Unidentified peak @ %.1f Hz", "hz")).otherwise("")
    return rows.withColumns({"is_motor_harmonic": F.col("harmonic_order").isNotNull(), "label": label})


def axis_levels(df: DataFrame, keys: Sequence[str], channels: dict[str, str]) -> DataFrame:
    """RMS around the mean per axis, long form, with its level; under 64 rows counts as no data."""
    rms = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.stddev_pop(c).alias(f"_{a}") for a, c in channels.items()]
    )
    each = F.array(*[
        F.struct(F.lit(a).alias("axis"),
                 F.when(F.col("_n") >= 64, F.coalesce(F.col(f"_{a}"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("rms"))
        for a in channels
    ])
    out = rms.select(*keys, F.explode(each).alias("a")).select(*keys, "a.*")
    return out.withColumn("severity", vibration_level(F.col("rms")))


def vibration_report(
    imu: DataFrame, keys: Sequence[str], order: Sequence[str], channels: dict[str, str],
    clips: DataFrame | None = None, start_us: int | None = None, end_us: int | None = None,
    expected_hz: Column | None = None, max_rows: int | None = None,
) -> DataFrame:
    """One row per series: axis RMS, dominant frequency, motor fundamental, worst level, notches, note."""
    keys, ts = list(keys), order[0]
    for bound, op in ((start_us, "__ge__"), (end_us, "__le__")):
        if bound is not None:
            imu = imu.where(getattr(F.col(ts), op)(bound))
            clips = None if clips is None else clips.where(getattr(F.col(ts), op)(bound))
    levels = axis_levels(imu, keys, channels)
    peaks = spectral_peaks(welch(imu, keys, order, channels, max_rows=max_rows), keys)
    labelled = label_peaks(peaks, keys, expected_hz)
    per_axis = labelled.groupBy(*keys, "axis").agg(
        F.max("motor_hz").alias("_motor"), F.min_by("hz", "rank").alias("dominant_hz"),
        F.sort_array(F.collect_list(F.when(~F.col("is_motor_harmonic") & (F.col("db") > -40), F.col("hz")))).alias("_loose"),
        F.count_if(~F.col("is_motor_harmonic")).alias("_unknown"),
    )
    axes = levels.join(per_axis, [*keys, "axis"], "left")
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("severity"))
    names = list(channels)
    one = axes.groupBy(*keys).agg(
        F.median("_motor").alias("motor_fundamental_hz"),
        F.max_by("severity", rank).alias("overall_severity"),
        F.coalesce(F.sum("_unknown"), F.lit(0)).alias("_unknown"),
        F.max(F.when(F.col("axis") == names[-1], F.col("_loose"))).alias("_loose"),
        *[F.max(F.when(F.col("axis") == a, F.col("rms"))).alias(f"rms_{a.lower()}") for a in names],
        *[F.max(F.when(F.col("axis") == a, F.col("dominant_hz"))).alias(f"dominant_{a.lower()}_hz") for a in names],
    )
    motor = F.col("motor_fundamental_hz")
    notch = F.array_distinct(F.concat(F.when(motor.isNotNull(), F.array(motor)).otherwise(F.array().cast("array<double>")),
                                      F.coalesce("_loose", F.array().cast("array<double>"))))
    notes = [
        F.when(vibration_level(F.col(f"rms_{a.lower()}")).isin("WARNING", "CRITICAL"),
               F.format_string(f"{a} vibrates at %.1f m/s² (%s)", f"rms_{a.lower()}", vibration_level(F.col(f"rms_{a.lower()}"))))
        for a in names
    ]
    notes.append(F.when(motor.isNotNull(), F.format_string("shaft rate near %.1f Hz", motor)))
    notes.append(F.when(F.col("_unknown") > 0, F.format_string(
        "%d peaks fit no multiple of the shaft rate", "_unknown")))
    note = F.concat_ws("; ", *notes)
    out = one.withColumns({
        "notch_frequencies_hz": F.sort_array(notch),
        "analysis_note": F.when(note == "", "nothing unusual").otherwise(note),
    })
    out = out.withColumn(
        "notch_filter_recommended",
        F.col("overall_severity").isin("WARNING", "CRITICAL") | (F.size("notch_frequencies_hz") > 0),
    )
    if clips is not None:
        total = clips.groupBy(*keys).agg(*[F.sum(f"clip{i}").alias(f"clips_{a.lower()}") for i, a in enumerate(names)])
        out = out.join(total, keys, "left")
    return out.drop("_unknown", "_loose")


def control_oscillation(
    att: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "roll_deg", max_rows: int | None = None
) -> DataFrame:
    """Series of more than 100 rows whose strongest 2-10 Hz bin exceeds the 90th percentile of the spectrum."""
    keys, ts = list(keys), order[0]
    rows = att.where(F.col(value).isNotNull())
    spec = welch(rows, keys, order, {"a": value}, 256, 1, (0.0, float("inf")), max_rows)
    band = F.max(F.when(F.col("hz").between(2.0, 10.0), F.col("psd")))
    g = spec.groupBy(*keys).agg(band.alias("osc_power"), F.percentile("psd", F.lit(0.9)).alias("_p90"))
    long_ones = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias(ts)).where("_n > 100")
    return g.where(F.col("osc_power") > F.col("_p90")).join(long_ones, keys).drop("_p90", "_n")
