"""Constants and options of the detector; fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
Q_PEAK, Q_CHARGE, Q_PEAK_COMPATIBILITY = 215.781, 1593.51, 163.235
RATE_JOB_Q_PEAK, RATE_JOB_Q_CHARGE = 215.934, 1606.467
BIN_SECONDS, TRACE_BINS = 8.3e-9, 2048
ACCIDENTAL_HZ = 4665.0
WINDOW, STEP = 120, 10
TRAIN_SHARE, PRIOR = 0.8, 0.5
LATCH_SHARE = 0.333
CLIP_LOW, CLIP_HIGH = -100.0, 4095.0
ENERGY_EDGES = (1e16, 10**16.5, 1e17, 10**17.5, 1e18, 10**18.5, 1e19, 10**19.5)
ZENITH_EDGES = (0.0, 33.56, 44.42, 51.32, 56.25, 65.37)
FIR_TAPS = (5, 0, 12, 22, 0, -61, -96, 0, 256, 551, 681, 551, 256, 0, -96, -61, 0, 22, 12, 0, 5)
FIR_SHIFT = 11
DISTANCE_CUT = {16: 500, 17: 800, 18: 1100, 19: 1700}
T2_BY_PMTS, T1_BY_PMTS = (5.0, 3.6, 3.2), (2.85, 2.0, 1.75)
DECAY_TAU_BINS = 67.0 / 25.0
TH1, TH2 = 1.7, 3.2
TOT_LEVEL, TOT_BINS, TOT_PMTS = 0.2, 13, 2
DEAD_BINS, CUT_BEFORE = 49, 20
SATURATED_RATIO = 1593.51 / 215.781


@dataclass(frozen=True)
class TraceOptions:
    """How a trace is built; :func:`dataclasses.replace` makes a variant."""

    window: int = WINDOW
    step: int = STEP
    downsample: bool = False
    phase: int = 0
    clip_low: float = CLIP_LOW
    clip_high: float = CLIP_HIGH
    q_peak: float = Q_PEAK
    q_charge: float = Q_CHARGE
    ignore_low_charge: float = 0.0
    ignore_particles: int = 0
    prior: float = PRIOR
    seed: int = 0
