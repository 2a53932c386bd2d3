"""Signal processing of one clip in numpy; the operators apply these per clip."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd

# The Morse code.
MORSE = {
    ".-": "A", "-...": "B", "-.-.": "C", "-..": "D", ".": "E", "..-.": "F", "--.": "G", "....": "H", "..": "I", ".---": "J", "-.-": "K", ".-..": "L", "--": "M",
    "-.": "N", "---": "O", ".--.": "P", "--.-": "Q", ".-.": "R", "...": "S", "-": "T", "..-": "U", "...-": "V", ".--": "W", "-..-": "X", "-.--": "Y", "--..": "Z",
    ".----": "1", "..---": "2", "...--": "3", "....-": "4", ".....": "5", "-....": "6", "--...": "7", "---..": "8", "----.": "9", "-----": "0",
    ".-.-.-": ".", "--..--": ",", "..--..": "?", ".----.": "'", "-.-.--": "!", "-..-.": "/", "-.--.": "(", "-.--.-": ")", ".-...": "&", "---...": ":", "-.-.-.": ";",
    "-...-": "=", ".-.-.": "+", "-....-": "-", "..--.-": "_", ".-..-.": '"', "...-..-": "$", ".--.-.": "@", "...---...": "SOS",
}


def wav_samples(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in parts:
        rows = []
        for path, content in zip(df["path"], df["content"], strict=True):
            with wave.open(io.BytesIO(content)) as w:
                x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
                rows.append((path, w.getframerate(), x.reshape(-1, w.getnchannels()).mean(1)))
        yield pd.DataFrame(rows, columns=["path", "rate", "samples"])


def band_pass(x: np.ndarray, rate: float, low: float, high: float, order: int = 4) -> np.ndarray:
    """Zero-phase band pass: the spectrum times the squared gain of a Butterworth filter, as forward and backward filtering gives."""
    f = np.fft.rfftfreq(len(x), 1 / rate)
    centre, width = np.sqrt(low * high), high - low
    with np.errstate(divide="ignore", invalid="ignore"):
        detune = np.where(f > 0, (f * f - centre * centre) / (f * width), np.inf)
    return np.fft.irfft(np.fft.rfft(x) / (1 + np.abs(detune) ** (2 * order)), len(x))


def low_pass(x: np.ndarray, rate: float, cut: float, order: int = 4) -> np.ndarray:
    f = np.fft.rfftfreq(len(x), 1 / rate)
    return np.fft.irfft(np.fft.rfft(x) / (1 + (f / cut) ** (2 * order)), len(x))


def analytic(x: np.ndarray) -> np.ndarray:
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def smoothed(x: np.ndarray, width: int, gaussian: bool = True) -> np.ndarray:
    """Gaussian smoothing with a standard deviation of so many samples, or a running mean over so many."""
    width = max(1, width)
    k = np.exp(-0.5 * (np.arange(-4 * width, 4 * width + 1) / width) ** 2) if gaussian else np.ones(width)
    return np.convolve(x, k / k.sum(), "same")[: len(x)]


def envelope(x: np.ndarray, rate: float, ms: float = 5.0, gaussian: bool = True) -> np.ndarray:
    return smoothed(np.abs(analytic(x)), int(rate * ms / 1000), gaussian)


def fm_deviation(x: np.ndarray, rate: float, centre: float) -> np.ndarray:
    """Instantaneous frequency less the centre, in Hz."""
    return np.diff(np.unwrap(np.angle(analytic(x)))) * rate / (2 * np.pi) - centre


def psk_jumps(x: np.ndarray, rate: float, carrier: float, cut: float = 500.0, least: float = np.pi / 4) -> np.ndarray:
    """Samples at which the phase against the carrier jumps by more than least."""
    t = np.arange(len(x)) / rate
    i, q = (low_pass(2 * x * g(2 * np.pi * carrier * t), rate, cut) for g in (np.cos, lambda a: -np.sin(a)))
    step = np.angle(np.exp(1j * np.diff(np.arctan2(q, i))))
    return np.flatnonzero(np.abs(step) > least)


def stft_db(x: np.ndarray, rate: float, size: int = 1024, hop: int = 512, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Decibels by frequency (rows) and frame, in a band."""
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hanning(size)
    f = np.fft.rfftfreq(size, 1 / rate)
    inside = (f >= low) & (f <= (high or rate / 2))
    return 20 * np.log10(np.abs(np.fft.rfft(frames, axis=1)).T[inside] + 1e-10)


def stretched(image: np.ndarray, low: float = 2, high: float = 98) -> np.ndarray:
    """Values between two percentiles as 0 to 255."""
    a, b = np.percentile(image, (low, high))
    return np.clip((image - a) / max(b - a, 1e-12) * 255, 0, 255).astype(np.uint8)


def edges(image: np.ndarray) -> np.ndarray:
    """Size of the gradient by Sobel's kernels."""
    p = np.pad(image.astype(float), 1, mode="edge")
    across = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    down = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    return np.hypot(across, down)


def band_ratios(x: np.ndarray, rate: float, bands: tuple[tuple[float, float], ...]) -> list[float]:
    """Each band's share of the power."""
    power, f = np.abs(np.fft.rfft(x)) ** 2, np.fft.rfftfreq(len(x), 1 / rate)
    whole = max(power.sum(), 1e-30)
    return [float(power[(f >= a) & (f < b)].sum() / whole) for a, b in bands]


def spikes(x: np.ndarray, factor: float = 2.0) -> np.ndarray:
    return np.flatnonzero(x > x.mean() + factor * x.std())


def phase_coherence(x: np.ndarray) -> float:
    return float(np.abs(np.exp(1j * np.angle(analytic(x))).mean()))


def runs(on: np.ndarray) -> list[tuple[bool, int]]:
    """Lengths of the stretches of equal values."""
    if not len(on):
        return []
    cuts = np.flatnonzero(np.diff(on.astype(np.int8))) + 1
    return [(bool(on[a]), int(b - a)) for a, b in zip([0, *cuts], [*cuts, len(on)], strict=True)]


def marks(env: np.ndarray, rate: float, factor: float = 1.0) -> list[tuple[bool, float]]:
    """Marks and spaces in seconds, by a threshold above the mean."""
    return [(on, n / rate) for on, n in runs(env > env.mean() + factor * env.std())]


def morse_symbols(timed: list[tuple[bool, float]], speed: float = 1.0) -> str:
    """Dots, dashes and gaps from marks and spaces: a dot is the first quartile of the marks (the median of few)."""
    lengths = [s for on, s in timed if on]
    if not lengths:
        return ""
    dot = float(np.percentile(lengths, 25) if len(lengths) > 10 else np.median(lengths)) * speed
    out = ""
    for on, s in timed:
        out += ("-" if s > 2.5 * dot else ".") if on else (" / " if s > 6 * dot else " " if s > 3 * dot else "")
    return out.strip(" /")


def morse_text(symbols: str) -> str:
    words = [[MORSE.get(c, f"[{c}]") for c in w.split()] for w in symbols.split("/")]
    return " ".join("".join(w) for w in words)


def ascii_from_bits(bits: np.ndarray) -> str:
    """Printable characters of whole bytes, first bit highest."""
    whole = np.packbits(bits[: len(bits) // 8 * 8].astype(np.uint8))
    return "".join(chr(c) if 32 <= c <= 126 else "." for c in whole)


def autocorrelation(x: np.ndarray, most: int) -> np.ndarray:
    x = x - x.mean()
    f = np.fft.rfft(x, 2 * len(x))
    r = np.fft.irfft(f * np.conj(f))[: most + 1]
    return r / max(r[0], 1e-30)
