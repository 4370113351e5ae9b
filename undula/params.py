"""Parameters of a measurement, validated on the driver before a plan is built."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

ANALYSIS_VERSION = 1

# Window names, channel modes, axis scales, and the band rules' constants.
WINDOWS = ("hann", "hamming", "blackman", "bartlett", "rect")
CHANNELS = ("mix", "left", "right", "mid", "side", "all")
SCALES = ("linear", "log", "mel")
REFERENCE_NFFT = 4096
NEAR_NYQUIST = 0.94
OCTAVES = (0, 60, 120, 250, 500, 1000, 2000, 4000, 8000, 16000)
LOSSLESS = (
    "flac", "alac", "wavpack", "ape", "tta", "tak", "shorten", "mlp", "truehd",
    "pcm_s16le", "pcm_s24le", "pcm_s32le", "pcm_f32le", "pcm_f64le",
    "pcm_s16be", "pcm_s24be", "pcm_s32be", "dsd_lsbf", "dsd_msbf", "dsd_lsbf_planar",
)
SOURCE_RATES = (44100, 48000, 88200)
NOMINAL_TONES = (315.0, 1000.0, 3000.0, 3150.0, 400.0, 500.0, 100.0, 1200.0)
EDGE_HINTS = ((17.5, "hint.low"), (19.5, "hint.mid"), (99.0, "hint.high"))


class ParamError(ValueError):
    pass


#: Ranges that numbers are brought into.
CLAMPED = {"max_cols": (100, 20000), "rows": (16, 4000), "db_range": (10.0, 200.0)}
RULES = (
    (lambda p: p.window in WINDOWS, f"window must be one of {', '.join(WINDOWS)}"),
    (lambda p: p.channel in CHANNELS, f"channel must be one of {', '.join(CHANNELS)}"),
    (lambda p: p.scale in SCALES, f"scale must be one of {', '.join(SCALES)}"),
    (lambda p: p.nfft >= 32 and p.nfft.bit_count() == 1, "nfft must be a power of two from 32 on"),
    (lambda p: 0.0 <= p.overlap <= 0.95, "overlap must be from 0 to 0.95"),
    (lambda p: p.sr is None or 1000 <= p.sr <= 768000, "sr must be from 1000 to 768000"),
    (lambda p: p.fmax is None or p.fmax - p.fmin >= 1.0, "fmin and fmax must be at least 1 Hz apart"),
)


@dataclass(frozen=True)
class Params:
    nfft: int = 2048
    overlap: float = 0.75
    window: str = "hann"
    channel: str = "mix"
    scale: str = "linear"
    start: float | None = None
    duration: float | None = None
    fmin: float = 0.0
    fmax: float | None = None
    db_range: float = 100.0
    db_top: float = 0.0
    normalize: bool = True
    max_cols: int = 4000
    rows: int = 550
    sr: int | None = None
    lang: str = "de"

    def validated(self) -> Params:
        """Numbers clamped to CLAMPED, frequency bounds put right; what breaks a rule of RULES raises."""
        given = {n: v for n, v in self.__dict__.items() if isinstance(v, float)}
        if odd := [n for n, v in given.items() if not math.isfinite(v)]:
            raise ParamError(f"{', '.join(odd)} must be finite")
        low, high = sorted((max(self.fmin or 0.0, 0.0), self.fmax)) if self.fmax and self.fmax > 0 else (max(self.fmin or 0.0, 0.0), None)
        positive = lambda v: v if v and v > 0 else None
        made = replace(
            self, fmin=low, fmax=high, start=None if self.start is None else max(self.start, 0.0), duration=positive(self.duration),
            **{n: min(max(getattr(self, n), lo), hi) for n, (lo, hi) in CLAMPED.items()},
        )
        for holds, reason in RULES:
            if not holds(made):
                raise ParamError(reason)
        return made

    @property
    def hop(self) -> int:
        return max(1, round(self.nfft * (1 - self.overlap)))
