"""Text tables of collected results; every input has a few rows (buckets, types, conditions, windows)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _pct(x: float) -> str:
    return f"{100 * x:6.2f}%"


def render_report(report: DataFrame, bucket: str = "bucket") -> str:
    """Pooled rates: all utterances first, then buckets from least to most code-mixing, then any others by name."""
    known = ("hindi_dominant", "balanced", "dense")
    rows = sorted(report.collect(), key=lambda r: (r[bucket] is not None, known.index(r[bucket]) if r[bucket] in known else len(known), str(r[bucket])))
    lines = [f"{r[bucket] or 'all':<16} n={r.n:<7} WER {_pct(r.wer)}  punctuated {_pct(r.punctuated_wer)}  CER {_pct(r.cer)}" for r in rows]
    return "\n".join(lines)


def render_entities(scores: DataFrame) -> str:
    rows = sorted(scores.collect(), key=lambda r: (r.type is not None, str(r.type)))
    return "\n".join(f"{r.type or 'all':<10} {r.hits:>6}/{r.total:<6} {_pct(r.accuracy)}" for r in rows)


def render_false_triggers(rates: DataFrame, examples: DataFrame | None = None) -> str:
    rows = sorted(rates.collect(), key=lambda r: (r.condition is not None, str(r.condition)))
    lines = [f"{r.condition or 'all':<16} {r.triggered:>6}/{r.n:<6} {_pct(r.rate)}" for r in rows]
    if examples is not None:
        lines += [f"  {r.condition}: {r.text[:80]!r}" for r in examples.orderBy("condition", "place").collect()]
    return "\n".join(lines)


def render_windows(truncated: DataFrame, segmented: DataFrame, shares: DataFrame | None = None, baseline_s: float = 10.0) -> str:
    lines = [] if shares is None else [f"{r.source:<48} mean {r.mean_s:5.2f} s  {_pct(r.step_share)} of steps" for r in shares.orderBy("source").collect()]
    mark = lambda w: "  baseline" if abs(w - baseline_s) < 1e-9 else ""
    lines.append("truncated: window, padding, clips cut, speech lost, compute, speech per compute")
    lines += [f"{r.window_s:5.1f} s {_pct(r.padding)} {_pct(r.cut)} {_pct(r.lost)} {r.compute:5.2f}x {r.speech_per_compute:6.2f}{mark(r.window_s)}" for r in truncated.orderBy("window_s").collect()]
    lines.append("segmented: window, padding, speech dropped, windows per clip, compute of a pass")
    lines += [f"{r.window_s:5.1f} s {_pct(r.padding)} {_pct(r.dropped)} {r.windows_per_clip:6.2f} {r.compute:5.2f}x{mark(r.window_s)}" for r in segmented.orderBy("window_s").collect()]
    return "\n".join(lines)


def render_verdicts(verdicts: DataFrame) -> str:
    return "\n".join(f"meter {r.delta:6.1f} min (wall clock {r.wall:.1f}, by GPU {r.per_gpu:.1f}): {r.billing}, {r.quota_hours:.0f} quota hours, {r.weeks:.1f} weeks" for r in verdicts.collect())
