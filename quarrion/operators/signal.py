"""Signal operators: a clip is a row (clip, rate, samples), so clips are spread over tasks and each is worked on whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.functions import signal as S
from quarrion.shipping import shipped


def per_clip(clips: DataFrame, f: Callable[[np.ndarray, float], dict], schema: str, key: str = "clip") -> DataFrame:
    """key and the columns of f(samples, rate) for each clip; a clip without samples is left out."""
    names = [c.split()[0] for c in schema.split(", ")]

    def mapped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            rows = [(k, *(f(np.asarray(x, float), float(r))[n] for n in names)) for k, r, x in zip(df[key], df["rate"], df["samples"], strict=True) if x is not None and len(x)]
            yield pd.DataFrame(rows, columns=[key, *names])

    kind = clips.schema[key].dataType.simpleString()
    return shipped(clips).select(key, "rate", "samples").mapInPandas(mapped, f"{key} {kind}, {schema}")


def envelopes(clips: DataFrame, low: float, high: float, ms: float = 5.0) -> DataFrame:
    return per_clip(clips, lambda x, r: {"envelope": S.envelope(S.band_pass(x, r, low, high), r, ms)}, "envelope array<double>")


def fm_stats(clips: DataFrame, low: float, high: float) -> DataFrame:
    def f(x: np.ndarray, r: float) -> dict:
        d = S.fm_deviation(S.band_pass(x, r, low, high), r, (low + high) / 2)
        return {"mean": d.mean(), "std": d.std(), "low": d.min(), "high": d.max()}

    return per_clip(clips, f, "mean double, std double, low double, high double")


def psk_rate(clips: DataFrame, carrier: float) -> DataFrame:
    def f(x: np.ndarray, r: float) -> dict:
        jumps = S.psk_jumps(x, r, carrier)
        return {"jumps": len(jumps), "per_second": len(jumps) * r / len(x)}

    return per_clip(clips, f, "jumps int, per_second double")


def band_images(clips: DataFrame, low: float, high: float, size: int = 1024, hop: int = 512) -> DataFrame:
    """The band's spectrogram stretched to 0 to 255, its edges, and the share of pixels above the middle."""

    def f(x: np.ndarray, r: float) -> dict:
        image = S.stretched(S.stft_db(x, r, size, hop, low, high))
        return {"image": image.astype(np.int32).tolist(), "edge_mean": float(S.edges(image).mean()), "bright": float((image > 127).mean())}

    return per_clip(clips, f, "image array<array<int>>, edge_mean double, bright double")


def band_energy(clips: DataFrame, bands: Sequence[tuple[float, float]], suspicious: float = 0.01, strong: float = 0.05) -> DataFrame:
    """Share of power per band, and whether the last (ultrasonic) band stands out."""

    def f(x: np.ndarray, r: float) -> dict:
        return {"ratios": S.band_ratios(x, r, tuple(bands))}

    last = F.element_at("ratios", -1)
    level = F.when(last > strong, "strong").when(last > suspicious, "suspicious").otherwise("normal")
    return per_clip(clips, f, "ratios array<double>").withColumn("level", level)


def segments(clips: DataFrame, seconds: int = 10, most: int = 6) -> DataFrame:
    """Clips cut into segments (clip, segment, rate, samples)."""
    n = (F.col("rate") * seconds).cast("int")
    count = F.least(F.lit(most), F.ceil(F.size("samples") / n).cast("int"))
    rows = clips.filter(F.size("samples") > 0).withColumn("segment", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.withColumn("samples", F.slice("samples", F.col("segment") * n + 1, n))


def phase_coherence(clips: DataFrame, key: str = "clip") -> DataFrame:
    return per_clip(clips, lambda x, r: {"coherence": S.phase_coherence(x)}, "coherence double", key)


def spike_counts(clips: DataFrame, factor: float = 2.0) -> DataFrame:
    return per_clip(clips, lambda x, r: {"spikes": len(S.spikes(np.abs(x), factor))}, "spikes int")


def bits_text(clips: DataFrame, per_bit: int) -> DataFrame:
    """Text of the bits that a clip's sign gives, averaged over so many samples a bit."""

    def f(x: np.ndarray, r: float) -> dict:
        whole = x[: len(x) // per_bit * per_bit].reshape(-1, per_bit).mean(1) if len(x) >= per_bit else np.empty(0)
        return {"text": S.ascii_from_bits(whole > 0)}

    return per_clip(clips, f, "text string")


def envelope_periods(clips: DataFrame, most_lag: int) -> DataFrame:
    def f(x: np.ndarray, r: float) -> dict:
        return {"autocorrelation": S.autocorrelation(S.envelope(x, r), most_lag)}

    return per_clip(clips, f, "autocorrelation array<double>")


def morse(clips: DataFrame, bands: Sequence[tuple[float, float]], factors: Sequence[float] = (0.5, 1.0), speeds: Sequence[float] = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)) -> DataFrame:
    """Text of each clip for every band, threshold and speed, with the number of known characters; the grid is a cross join with its parameters."""
    grid = clips.sparkSession.createDataFrame([(float(a), float(b), float(k)) for a, b in bands for k in factors], "low double, high double, factor double")
    rows = clips.crossJoin(F.broadcast(grid))

    def mapped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for k, r, x, low, high, factor in zip(df["clip"], df["rate"], df["samples"], df["low"], df["high"], df["factor"], strict=True):
                timed = S.marks(S.envelope(S.band_pass(np.asarray(x, float), r, low, high), r), r, factor)
                for speed in speeds:
                    text = S.morse_text(S.morse_symbols(timed, speed))
                    out.append((k, low, high, factor, speed, text, sum(c.isalnum() for c in text) - 2 * text.count("[")))
            yield pd.DataFrame(out, columns=["clip", "low", "high", "factor", "speed", "text", "known"])

    kind = clips.schema["clip"].dataType.simpleString()
    return shipped(rows).mapInPandas(mapped, f"clip {kind}, low double, high double, factor double, speed double, text string, known int")


def morse_decoded(symbols: Column) -> Column:
    """Text of Morse symbols as a column expression; unknown ones stay in brackets, a slash parts words."""
    table = F.create_map(*(F.lit(x) for kv in S.MORSE.items() for x in kv))
    letters = F.transform(F.split(symbols, r"\s*/\s*"), lambda w: F.array_join(F.transform(F.filter(F.split(w, r"\s+"), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(table, c), F.concat(F.lit("["), c, F.lit("]")))), ""))
    return F.array_join(letters, " ")


def islands(rows: DataFrame, keys: Sequence[str], order: str, flag: str) -> DataFrame:
    """Stretches of equal flags per key, with their first and last place and length."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (F.lag(flag).over(w).isNull() | (F.lag(flag).over(w) != F.col(flag))).cast("int")
    marked = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_run").agg(F.first(flag).alias(flag), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def regular(rows: DataFrame, keys: Sequence[str], at: str, share: float = 0.3) -> DataFrame:
    """Mean and population deviation of the gaps between events of a key; regular if the deviation is small."""
    w = Window.partitionBy(*keys).orderBy(at)
    gaps = rows.withColumn("gap", F.col(at) - F.lag(at).over(w)).filter("gap is not null")
    per = gaps.groupBy(*keys).agg(F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap"), F.count("*").alias("n"))
    return per.withColumn("is_regular", F.col("std_gap") < share * F.col("mean_gap"))
