"""The signal generators for bars that arrive one after the other.

A rule sees the newest bars of a series behind those that it may look back at, as arrays, and a few numbers that it keeps
itself (exponential means, where the lifecycle stands). It never sees the whole history, and its rows are those of the
generator of the same name over whole tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from tidemark.operators.lifecycle import ADVANCING, CROWDED, FAILING, RISK, START, STATES, UNSTABLE, Lifecycle, moved, moves

FIELDS = ("open", "high", "low", "close", "volume")
SIDES = ("enter_long", "exit_long", "enter_short", "exit_short")
#: Exit modes that a stream can run; a protective stop inside the bar needs fills.
EXIT_MODES = ("own", "opposite_signal_only", "continuation_failure", "trend_failure", "trend_structure")


def deviation(windows: np.ndarray) -> np.ndarray:
    """Sample deviation of each row, value after value as an aggregate over whole tables takes them, so that equal windows tie alike."""
    mean, square = np.zeros(len(windows)), np.zeros(len(windows))
    for n, x in enumerate(windows.T, 1):
        delta = x - mean
        mean = mean + delta / n
        square = square + delta * (delta - delta / n)
    return np.sqrt(square / max(1, windows.shape[1] - 1))


@dataclass
class Run:
    """Bars of a series: `start` of them lie behind, the others are new. `kept` has a rule's numbers before and after the newest bar.

    Arrays that the methods return have a value for each new bar; NaN where the window isn't full, as at the start of a series.
    """

    bars: dict[str, np.ndarray]
    start: int
    before: dict
    last: dict = field(default_factory=dict)
    after: dict = field(default_factory=dict)

    @property
    def new(self) -> int:
        return len(self.bars["close"]) - self.start

    def lag(self, x: np.ndarray, k: int = 1) -> np.ndarray:
        """Of an array over all bars, the value k bars before each new one."""
        at = np.arange(self.start, len(x)) - k
        return np.where(at >= 0, x[np.maximum(at, 0)], np.nan)

    def windows(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n values up to each new bar of an array over all bars; NaN before the first."""
        view = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n, np.nan), x]), n)
        return view[self.start + 1 :][: self.new]

    def mean(self, x: np.ndarray, n: int) -> np.ndarray:
        return self.windows(x, n).mean(1)

    def change(self, x: np.ndarray, k: int = 1) -> np.ndarray:
        now, then = x[self.start :], self.lag(x, k)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(then == 0, np.nan, now / then - 1)

    def scan(self, name: str, values: np.ndarray, first, step: Callable):
        """Results of step(kept, value), which gives the next kept value and a result; what is kept goes on with the next run."""
        kept, out = self.before.get(name, first), []
        for v in values:
            self.last[name] = kept
            kept, result = step(kept, v)
            out.append(result)
        self.after[name] = kept
        return out

    def ema(self, name: str, values: np.ndarray, span: float) -> np.ndarray:
        """The exponential mean of the new bars' values, which starts with the first value that isn't NaN."""
        a = 2 / (span + 1)

        def step(y, x):
            y = y if x != x else x if y is None else a * x + (1 - a) * y
            return y, np.nan if y is None else y

        return np.array(self.scan(name, values.tolist(), None, step), dtype=float)

    def true_range(self) -> np.ndarray:
        """Over all bars; the first has high - low alone."""
        h, low, c = (self.bars[k] for k in ("high", "low", "close"))
        before = np.concatenate([[np.nan], c[:-1]])
        return np.fmax(np.fmax(h - low, np.abs(h - before)), np.abs(low - before))

    def adverse(self, n: int, falling: bool) -> np.ndarray:
        """Whether each of the last n closes was lower (or higher) than the one before it."""
        d = np.diff(self.bars["close"], prepend=np.nan)
        return (self.windows(np.where(d < 0 if falling else d > 0, 1.0, 0.0), n) == 1).all(1)


@dataclass(frozen=True)
class Rule:
    """A generator: `reach` bars back, no rows in the first `warmup` bars, and four flags (or `level`, `state` and `features`) of each new bar."""

    reach: int
    warmup: int
    compute: Callable[[Run], dict[str, np.ndarray]]


def _four(long_entry, long_exit, short_entry, short_exit, shorts: bool = True) -> dict[str, np.ndarray]:
    return dict(zip(SIDES, (long_entry, long_exit, short_entry & shorts, short_exit)))


def _pattern(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Two falling bars and then a rising one, and the mirror image."""
    sign = np.sign(run.bars["close"] - run.bars["open"])
    three = run.lag(sign, 2), run.lag(sign), sign[run.start :]
    return tuple((three[0] == -s) & (three[1] == -s) & (three[2] == s) for s in (1, -1))


def turnaround_v1(allow_shorts: bool = True, warmup: int = 4000) -> Rule:
    def compute(run):
        up, down = _pattern(run)
        down = down & allow_shorts
        return _four(up, down, down, up)

    return Rule(3, warmup, compute)


def turnaround_v2(trend: int = 200, extension: int = 20, low: float = 0.99, high: float = 1.01, allow_shorts: bool = True, warmup: int = 4000) -> Rule:
    def compute(run):
        up, down = _pattern(run)
        c = run.bars["close"][run.start :]
        t, e = run.ema("trend", c, trend), run.ema("extension", c, extension)
        long, short = up & (c > t) & (c < e * low), down & (c < t) & (c > e * high) & allow_shorts
        return _four(long, short, short, long)

    return Rule(3, warmup, compute)


def sma_pullback(span: int = 40, most: float = 1.2, warmup: int = 40) -> Rule:
    def compute(run):
        up, _ = _pattern(run)
        c, m = run.bars["close"][run.start :], run.mean(run.bars["close"], span)
        off = np.zeros(run.new, bool)
        return _four(up & (c > m) & (c < m * most), off, off, off)

    return Rule(max(3, span), warmup, compute)


def trend_rider(span: int = 40, period: int = 26, atr: int = 14, most: float = 0.10, failure: int = 3, allow_shorts: bool = False, warmup: int = 40) -> Rule:
    def compute(run):
        up, down = _pattern(run)
        closes = run.bars["close"]
        c, m, r = closes[run.start :], run.mean(closes, span), run.change(closes, period)
        calm = run.ema("atr", run.true_range()[run.start :], atr) / c < most
        long, short = up & (c > m) & calm, down & ~(c > m) & calm & allow_shorts
        return _four(long, short | run.adverse(failure, True) | (c < m) | (r < 0), short, long | run.adverse(failure, False) | ~(c < m) | ~(r < 0))

    return Rule(max(3, span, period + 1, failure + 1), warmup, compute)


def tsmom(lookback: int = 96, allow_shorts: bool = True) -> Rule:
    def compute(run):
        r = run.change(run.bars["close"], lookback)
        return _four(r > 0, r < 0, r < 0, r > 0, allow_shorts)

    return Rule(lookback + 1, lookback, compute)


def ema_cross(fast: int = 48, slow: int = 192, allow_shorts: bool = True, warmup: int | None = None) -> Rule:
    def compute(run):
        c = run.bars["close"][run.start :]
        f, s = run.ema("fast", c, fast), run.ema("slow", c, slow)
        return _four(f > s, f < s, f < s, f > s, allow_shorts)

    return Rule(1, 20 * max(fast, slow) if warmup is None else warmup, compute)


def donchian(entry: int = 96, leave: int = 48, allow_shorts: bool = True) -> Rule:
    def compute(run):
        c, h, low = (run.bars[k] for k in ("close", "high", "low"))
        now = c[run.start :]
        before = lambda x, n: run.windows(np.concatenate([[np.nan], x[:-1]]), n)
        return _four(now > before(h, entry).max(1), now < before(low, leave).min(1), now < before(low, entry).min(1), now > before(h, leave).max(1), allow_shorts)

    return Rule(max(entry, leave) + 1, max(entry, leave), compute)


def multi_horizon(lookbacks: tuple[int, ...] = (24, 48, 96, 192), vol: int = 96, threshold: float = 0.0, allow_shorts: bool = True) -> Rule:
    if not lookbacks or threshold < 0:
        raise ValueError("lookbacks must not be empty and the threshold not negative")

    def compute(run):
        c = run.bars["close"]
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.concatenate([[np.nan], c[1:] / np.where(c[:-1] == 0, np.nan, c[:-1]) - 1])
            sd = deviation(run.windows(r, vol))
            score = sum(run.change(c, n) / np.where(sd == 0, np.nan, sd * n**0.5) for n in lookbacks) / len(lookbacks)
        return _four(score > threshold, score < -threshold, score < -threshold, score > threshold, allow_shorts)

    return Rule(max(*lookbacks, vol) + 1, max(*lookbacks, vol), compute)


def _rank(values: np.ndarray) -> np.ndarray:
    """Share of each row's values below its last, ties at their middle rank; NaN where one is missing."""
    last = values[:, -1:]
    share = ((values < last).sum(1) + ((values == last).sum(1) + 1) / 2) / values.shape[1]
    return np.where(np.isnan(values).any(1), np.nan, share)


def lifecycle_features(run: Run, seen: int, fast: int, slow: int, atr: int, span: int, rank: int, vol: int) -> dict[str, np.ndarray]:
    """direction, strength, stability, crowding and energy of the new bars; `seen` bars lie behind them. Ranks are over `rank` raw values."""
    c, v = run.bars["close"], np.lib.stride_tricks.sliding_window_view
    tr, ln = run.true_range(), np.log(c)
    now = c[run.start :]
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = tr / np.where(c == 0, np.nan, c)
        trf = run.mean(ratio, atr)
        spread = (run.ema("fast", now, fast) - run.ema("slow", now, slow)) / now / trf
    direction = np.tanh(np.where(trf == 0, 0.0, spread) / ((abs(slow - fast) / 2) ** 0.5 or 1.0))
    number = seen - run.start + 1 + np.arange(len(c))  # of each bar in its series, from 1
    direction = np.where(number[run.start :] > 5 * max(fast, slow), direction, np.nan)

    # raw values of the new bars and of the rank - 1 before them
    first = max(0, run.start - rank + 1)
    ago = lambda x, n: np.concatenate([np.full(n - 1, np.nan), x]) if n > 1 else x
    step = np.abs(np.diff(c, prepend=np.nan))
    path = v(ago(step, span), span)[first:].sum(1)
    then = np.concatenate([np.full(min(span, len(c)), np.nan), c])[: len(c)][first:]
    with np.errstate(divide="ignore", invalid="ignore"):
        strength = np.where(path == 0, 0.0, np.abs(c[first:] - then) / path)
    y = v(ago(ln, span), span)[first:]
    t = np.arange(span) - (span - 1) / 2
    sd, cov = deviation(y), ((y - y.mean(1, keepdims=True)) * t).sum(1) / (span - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = np.where(sd == 0, 0.0, np.clip(cov * cov / (span * (span + 1) / 12 * sd * sd), 0, 1))
        trf_span = v(ago(ratio, span), span)[first:].mean(1)
        scatter = np.where(trf_span == 0, 0.0, np.clip(sd * np.sqrt(1 - r2) / (trf_span * span**0.5), 0, 1))
    ready = number[first:] > span
    strength, stability = np.where(ready, strength, np.nan), np.where(ready, 1 - scatter, np.nan)
    rv = deviation(v(ago(np.diff(ln, prepend=np.nan), vol), vol)[first:])
    ranked = lambda x: _rank(v(np.concatenate([np.full(rank, np.nan), x]), rank)[-run.new :]) if run.new else x[:0]
    energy = np.where(number[run.start :] > vol + rank - 1, ranked(rv), np.nan)
    return {"direction": direction, "strength": ranked(strength), "stability": ranked(stability), "crowding": np.full(run.new, 0.5), "energy": energy}


def row_bits(f: dict[str, np.ndarray], m: Lifecycle) -> tuple[np.ndarray, np.ndarray]:
    """The bits of each row as the table of moves reads them, and the sign that counts; a row that can't be measured fails."""
    ok = ~np.any([np.isnan(x) for x in f.values()], axis=0)
    if m.enter_energy is None:
        entering, leaving = f["strength"] >= m.enter_strength, f["strength"] < m.exit_strength
    else:
        entering, leaving = f["energy"] <= m.enter_energy, f["energy"] > m.exit_energy
    bits = ADVANCING * (entering & (np.abs(f["direction"]) >= m.direction_floor) & (f["energy"] <= m.energy_ceiling))
    bits = bits + FAILING * (~ok | leaving) + UNSTABLE * (f["stability"] < m.stability_floor) + CROWDED * (np.abs(f["crowding"] - 0.5) >= m.crowding_extreme)
    return bits, np.where(f["direction"] >= m.direction_floor, 1, np.where(f["direction"] <= -m.direction_floor, -1, 0))


def target_level(state: list[str], f: dict[str, np.ndarray], follow: float = 2 / 3, noise: float = 1 / 3, penalty: float = 0.5) -> np.ndarray:
    """The signed level of each row: high strength follows the lean, middling fades it, low or unknown is flat."""
    lean, crowd = np.sign(f["direction"]), f["crowding"] - 0.5
    side = np.where(f["strength"] >= follow, lean, np.where(f["strength"] >= noise, -lean, 0.0))
    pressure = np.where(side == np.sign(crowd), np.minimum(2 * np.abs(crowd), 1.0), 0.0)
    known = ~np.isnan(f["direction"]) & ~np.isnan(f["strength"]) & ~np.isnan(f["crowding"])
    return np.where(known & (side != 0), side * np.array([RISK[s] for s in state]) * (1 - penalty * pressure), 0.0)


def _machine(m: Lifecycle, level: bool, band: float, allow_shorts: bool, warmup: int, fast: int, slow: int, atr: int, span: int, rank: int, vol: int) -> Rule:
    table = moves(m)

    def compute(run):
        seen = run.before.get("seen", 0)
        f = lifecycle_features(run, seen, fast, slow, atr, span, rank, vol)
        bits, lean = row_bits(f, m)

        def walk(at, row):
            at = moved(table, tuple(at), *row)
            return list(at), STATES[at[0]]

        state = run.scan("stands", list(zip(bits.tolist(), lean.tolist(), (f["direction"] > 0).tolist())), list(START), walk)
        target = target_level(state, f)
        target = target if allow_shorts else np.maximum(target, 0.0)
        number = seen + 1 + np.arange(run.new)
        out = {"state": np.array(state, dtype=object), "features": f}
        if level:
            target = np.where(number > warmup, target, 0.0)

            def submit(held, x):
                return (x, (x, held)) if abs(x - held) >= band else (held, None)

            out |= {"level": target, "submitted": run.scan("held", target.tolist(), 0.0, submit)}
        else:
            side = np.sign(target)
            before = np.array(run.scan("side", side.tolist(), 0.0, lambda b, s: (s, b)))
            new = side != before
            out |= _four(new & (side > 0), new & (before > 0), new & (side < 0), new & (before < 0))
        return out

    return Rule(max(rank + max(span, vol) + 1, 2), warmup, compute)


_WINDOWS = {"fast": 24, "slow": 96, "atr": 24, "span": 96, "rank": 480, "vol": 24}


def state_machine_v1(machine: dict | None = None, allow_shorts: bool = True, warmup: int = 0, **windows: int) -> Rule:
    return _machine(Lifecycle(**(machine or {})), False, 0.0, allow_shorts, warmup, **(_WINDOWS | windows))


def state_machine_v2(machine: dict | None = None, band: float = 0.05, allow_shorts: bool = True, warmup: int = 0, **windows: int) -> Rule:
    if band < 0:
        raise ValueError("the band must not be negative")
    return _machine(Lifecycle(**(machine or {})), True, band, allow_shorts, warmup, **(_WINDOWS | windows))


#: Every generator, by the name that it has over whole tables.
RULES: dict[str, Callable[..., Rule]] = {f.__name__: f for f in (turnaround_v1, turnaround_v2, sma_pullback, trend_rider, tsmom, ema_cross, donchian, multi_horizon, state_machine_v1, state_machine_v2)}


def with_exits(rule: Rule, mode: str = "own", failure_bars: int = 4, sma: int = 40, trend_span: int | None = None) -> Rule:
    """The rule with the exits of a mode beside (or, in trend_structure, in place of) its own."""
    if mode not in EXIT_MODES:
        raise ValueError(f"a stream's exit mode must be one of {EXIT_MODES}, not {mode!r}")
    if mode in ("own", "opposite_signal_only"):
        return rule
    if mode == "trend_failure" and trend_span is None:
        raise ValueError("trend_failure needs the span of the strategy's EMA")
    if failure_bars < 1:
        raise ValueError("failure_bars must be 1 at least")

    def compute(run):
        out = rule.compute(run)
        if "level" in out:
            raise ValueError("exit modes are for rules with entries and exits, not for levels")
        c = run.bars["close"][run.start :]
        if mode == "trend_failure":
            e = run.ema("exit_trend", c, trend_span)
            return out | {"exit_long": out["exit_long"] | (c < e), "exit_short": out["exit_short"] | (c > e)}
        falls, rises = run.adverse(failure_bars, True), run.adverse(failure_bars, False)
        if mode == "continuation_failure":
            return out | {"exit_long": out["exit_long"] | falls, "exit_short": out["exit_short"] | rises}
        if out["enter_short"].any():
            raise ValueError("trend_structure has no short exits: turn shorts off")
        return out | {"exit_long": (c < run.mean(run.bars["close"], sma)) | falls, "exit_short": np.zeros(run.new, bool)}

    return Rule(max(rule.reach, failure_bars + 1, sma), rule.warmup, compute)


def make(strategy: str, options: str | dict | None = None, exits: str | dict | None = None) -> Rule:
    """A rule by its name, options and exit mode, both as JSON or as dicts; an unknown name is refused."""
    if strategy not in RULES:
        raise ValueError(f"unknown strategy {strategy!r}")
    options, exits = (json.loads(x) if isinstance(x, str) and x else x or {} for x in (options, exits))
    return with_exits(RULES[strategy](**{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()}), **exits)
