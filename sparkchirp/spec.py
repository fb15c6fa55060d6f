"""Description of an observation, limits, flags and errors."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field

import numpy as np

# Fixed values -----------------------------------------------------------------------------------
DISPERSION = 4.15e3  # seconds MHz^2 per pc cm^-3
MAX_CHANNELS = 8192
GULP_SIZE = 65536
MIN_SEGMENT = 16384
IN_NBITS = (1, 2, 4, 8, 16, 32)
OUT_NBITS = (8, 16, 32)


class Code(enum.IntEnum):
    """Result codes, in their fixed order."""

    NO_ERROR = 0
    MEM_ALLOC_FAILED = 1
    MEM_COPY_FAILED = 2
    NCHANS_EXCEEDS_LIMIT = 3
    INVALID_PLAN = 4
    INVALID_POINTER = 5
    INVALID_STRIDE = 6
    NO_DM_LIST_SET = 7
    TOO_FEW_NSAMPS = 8
    INVALID_FLAG_COMBINATION = 9
    UNSUPPORTED_IN_NBITS = 10
    UNSUPPORTED_OUT_NBITS = 11
    INVALID_DEVICE_INDEX = 12
    DEVICE_ALREADY_SET = 13
    PRIOR_GPU_ERROR = 14
    INTERNAL_GPU_ERROR = 15
    UNKNOWN_ERROR = 16


#: Fixed texts of the codes, in order.
MESSAGES = (
    "No error",
    "Memory allocation failed",
    "Memory copy failed",
    "No. channels exceeds internal limit",
    "Invalid plan",
    "Invalid pointer",
    "Invalid stride",
    "No DM list has been set",
    "No. samples < maximum delay",
    "Invalid flag combination",
    "Unsupported in_nbits value",
    "Unsupported out_nbits value",
    "Invalid device index",
    "Device is already set and cannot be changed",
    "Prior GPU error.",
    "Internal GPU error. Please contact the author(s).",
    "Unknown error. Please contact the author(s).",
)
BAD_CODE = "Invalid error code"


def message(code: int) -> str:
    """The text of a result code."""
    return MESSAGES[code] if 0 <= code < len(MESSAGES) else BAD_CODE


class SearchError(Exception):
    """An error with a result code."""

    def __init__(self, code: Code):
        super().__init__(message(code))
        self.code = code


class Flag(enum.IntFlag):
    """Execution flags; only their combination is checked."""

    DEFAULT = 0
    HOST_POINTERS = 1 << 1
    DEVICE_POINTERS = 1 << 2
    WAIT = 1 << 3
    ASYNC = 1 << 4


def f32(x) -> float:
    """The nearest 32-bit float, as a Python number."""
    return float(np.float32(x))


@dataclass(frozen=True)
class ObservationSpec:
    """``f0`` is the highest frequency (MHz) and ``df`` the channel step, always negative; ``dt`` in seconds."""

    nchans: int
    dt: float
    f0: float
    df: float
    killmask: tuple[int, ...] = field(default=())

    def __post_init__(self):
        if not 0 < self.nchans <= MAX_CHANNELS:
            raise SearchError(Code.NCHANS_EXCEEDS_LIMIT)
        if self.killmask and len(self.killmask) != self.nchans:
            raise SearchError(Code.INVALID_POINTER)
        object.__setattr__(self, "dt", f32(self.dt))
        object.__setattr__(self, "f0", f32(self.f0))
        object.__setattr__(self, "df", -abs(f32(self.df)))
        object.__setattr__(self, "killmask", tuple(int(bool(k)) for k in self.killmask) or (1,) * self.nchans)

    def with_killmask(self, mask) -> ObservationSpec:
        """The same observation with another mask (None: all channels count)."""
        return ObservationSpec(self.nchans, self.dt, self.f0, self.df, tuple(mask) if mask is not None else ())

    # Tables as arrays: a few thousand numbers at most, rounded as 32-bit floats at each step.
    def frequencies(self) -> np.ndarray:
        return np.float32(self.f0) + np.arange(self.nchans, dtype=np.float32) * np.float32(self.df)

    def delays(self) -> np.ndarray:
        """Samples of delay for one unit of dispersion measure, by channel."""
        a = (1.0 / self.frequencies().astype(np.float64)).astype(np.float32)
        b = np.float32(1.0 / np.float64(np.float32(self.f0)))
        return (DISPERSION / np.float64(np.float32(self.dt)) * (a * a - b * b).astype(np.float64)).astype(np.float32)

    def shifts(self, dms) -> np.ndarray:
        """Whole-sample shifts (trial, channel), halves to even."""
        return np.rint(np.asarray(dms, np.float32)[:, None] * self.delays()[None, :]).astype(np.int64)

    def max_delay(self, dms) -> int:
        """Largest delay of any trial in the last channel, halves up."""
        if not len(dms):
            raise SearchError(Code.NO_DM_LIST_SET)
        top = np.max(np.asarray(dms, np.float32) * self.delays()[-1])
        return int(np.float64(top) + 0.5)

    def dm_delay(self, dms, trial: int) -> int:
        """Delay of one trial in the last channel; 0 for an unknown trial."""
        if not 0 <= trial < len(dms):
            return 0
        return int(np.float64(np.float32(dms[trial]) * self.delays()[-1]) + 0.5)


def linear_dms(start: float, step: float, count: int | None = None, end: float | None = None) -> list[float]:
    """start + step * i as 32-bit floats; ``count`` trials, or up to ``end``."""
    if count is None:
        count = max(0, int(np.ceil((end - start) / step)))
    i = np.arange(count, dtype=np.float32)
    return [float(x) for x in np.float32(start) + np.float32(step) * i]


def adaptive_dms(spec: ObservationSpec, start: float, end: float, pulse_width: float, tol: float) -> list[float]:
    """Trials spaced so that a pulse between two of them is smeared by at most ``tol`` times what cannot be avoided.

    At dispersion D a pulse of width w (``pulse_width``, in microseconds) is smeared by the sample, itself and the
    sweep inside a channel, s(D)^2 = dt^2 + w^2 + (inside * D)^2 with inside = 8.3 |df| / f^3 microseconds (f: middle of the
    band in GHz, df in MHz); a trial off by d adds the sweep over a quarter of the channels, (across * d)^2 with
    across = inside * n / 4.  The next trial D' after D is the one at which the whole has grown by the tolerance:

        w^2 + dt^2 + (inside * D')^2 + (across * (D' - D))^2 = tol^2 * s(D)^2,

    the larger root of a quadratic in D'.  Each trial is rounded to a 32-bit float before the next; the last one may lie
    beyond ``end``.
    """
    n = spec.nchans
    ghz = (spec.f0 + ((n // 2) - 0.5) * spec.df) * 1e-3
    least = (spec.dt * 1e6) ** 2 + f32(pulse_width) ** 2
    tolerated = f32(tol) ** 2
    inside = (8.3 * spec.df / ghz**3) ** 2
    across = inside * (n * n / 16.0)
    trials = [f32(start)]
    while (here := trials[-1]) < f32(end):
        room = least * (tolerated - 1.0) + tolerated * inside * here**2
        # fixed: the order of these operations decides the last bits of the root
        trials.append(f32((across * here + np.sqrt((inside + across) * room - inside * across * here**2)) / (inside + across)))
    return trials
