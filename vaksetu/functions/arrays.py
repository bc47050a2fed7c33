"""Array columns: entropies, losses, padding, waveforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean_token_entropy(steps: Column) -> Column:
    """Mean entropy (nats) of renormalised steps of log-probabilities; steps without mass are left out; 0 if none is left."""
    probs = F.transform(steps, lambda s: F.transform(s, lambda lp: F.exp(lp.cast("double"))))
    used = F.filter(probs, lambda p: total(p) > 0)
    entropy = lambda p: let(total(p), lambda z: -total(F.transform(F.filter(p, lambda x: x > 0), lambda x: x / z * F.log(x / z))))
    return let(used, lambda u: F.when(F.size(u) > 0, total(F.transform(u, entropy)) / F.size(u)).otherwise(0.0))


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    scaled = F.transform(logits, lambda x: x.cast("double") / F.lit(float(temperature)))

    def of(x: Column) -> Column:
        norm = let(F.array_max(x), lambda top: top + F.log(total(F.transform(x, lambda v: F.exp(v - top)))))
        return let(norm, lambda z: F.transform(x, lambda v: v - z))

    return let(scaled, of)


def kl_terms(teacher: Column, student: Column) -> Column:
    """Sum of p_t (log p_t - log p_s) over arrays of log-probabilities; terms with p_t = 0 are 0."""
    each = F.zip_with(teacher, student, lambda t, s: F.when(t == F.lit(float("-inf")), 0.0).otherwise(F.exp(t) * (t - s)))
    return total(each)


def select_ids(values: Column, ids: Column) -> Column:
    """The entries of an array at ids from 0."""
    return F.transform(ids, lambda i: F.get(values, i))


def cross_entropy(logits: Column, label: Column, smoothing: float = 0.0) -> Column:
    """Negative log-likelihood of one position, with label smoothing over the vocabulary."""
    own = lambda logp: -F.get(logp, label)
    smooth = lambda logp: own(logp) * (1 - smoothing) - total(logp) / F.size(logp) * smoothing
    return let(log_softmax(logits), smooth if smoothing else own)


def feature_floor(mel: Column, offset: float = 2.0) -> Column:
    """The value of silence for a clip's features: its maximum less ``offset``."""
    return F.array_max(F.transform(mel, lambda row: F.array_max(row))) - F.lit(offset)


def pad_features(mel: Column, width: int, value: Column | None = None) -> Column:
    """Rows filled up on the right to ``width`` with the clip's floor (or ``value``); full rows stay as they are."""
    fill = feature_floor(mel) if value is None else value
    return let(F.struct(mel.alias("mel"), fill.cast("double").alias("fill")), lambda p: F.transform(p.mel, lambda row: F.concat(row, F.array_repeat(p.fill, F.greatest(F.lit(width) - F.size(row), F.lit(0))))))


def pad_tokens(ids: Column, width: int, pad: int = -100) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(width) - F.size(ids), F.lit(0))))


def crop_features(mel: Column, width: int) -> Column:
    return F.transform(mel, lambda row: F.slice(row, 1, width))


def speech_frames(duration_s: Column, n_frames: int, per_second: int = 100) -> Column:
    return F.least(F.lit(n_frames), F.rint(duration_s * per_second).cast("int"))


def to_mono(channels: Column) -> Column:
    """Array of arrays to one: the mean over the shorter axis (over rows' items if square)."""
    rows, cols = F.size(channels), F.size(F.get(channels, 0))
    down = F.transform(F.sequence(F.lit(0), cols - 1), lambda i: F.aggregate(channels, F.lit(0.0), lambda a, r: a + F.get(r, i)) / rows)
    across = F.transform(channels, lambda r: total(r) / F.size(r))
    return F.when(rows < cols, down).otherwise(across)


def resample(wave: Column, rate_in: int, rate_out: int) -> Column:
    """Linear interpolation at round(n * out / in) points from the first to the last sample; unchanged if the rates are equal."""
    if rate_in == rate_out:
        return wave
    return let(wave, lambda w: _resampled(w, rate_in, rate_out))


def _resampled(wave: Column, rate_in: int, rate_out: int) -> Column:
    n = F.size(wave)
    m = F.rint(n * F.lit(float(rate_out)) / F.lit(float(rate_in))).cast("int")
    step = F.when(m > 1, (n - 1) / (m - 1)).otherwise(0.0)

    def at(i: Column) -> Column:
        x = i * step
        low = F.least(F.floor(x).cast("int"), n - 1)
        high = F.least(low + 1, n - 1)
        return F.get(wave, low) + (F.get(wave, high) - F.get(wave, low)) * (x - low)

    return F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), at)).otherwise(F.array().cast("array<double>"))


def top_values(values: Column, k: int) -> Column:
    return F.slice(F.sort_array(values, asc=False), 1, k)


def top_entries(values: Column, k: int) -> Column:
    """The k largest entries as struct(value, id), ties to the smaller id."""
    pairs = F.transform(values, lambda v, i: F.struct(v.alias("value"), (-i).alias("minus")))
    return F.transform(F.slice(F.sort_array(pairs, asc=False), 1, k), lambda p: F.struct(p.value.alias("value"), (-p.minus).alias("id")))


def spaced_indices(n_from: Column, n_to: Column) -> Column:
    """``n_to`` of ``n_from`` places, evenly spread with both ends, rounded half to even and kept strictly increasing."""
    rounded = F.transform(F.sequence(F.lit(0), n_to - 1), lambda i: F.rint(i * (n_from - 1) / (n_to - 1)).cast("int"))
    pushed = F.aggregate(rounded, F.array().cast("array<int>"), lambda out, x: F.concat(out, F.array(F.when((F.size(out) > 0) & (x <= F.element_at(out, -1)), F.element_at(out, -1) + 1).otherwise(x))))
    bad = (n_to < 1) | (n_to > n_from)
    return F.when(bad, F.raise_error(F.lit("cannot keep so many places")).cast("array<int>")).when(n_to == 1, F.array(F.lit(0))).otherwise(pushed)
