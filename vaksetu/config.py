"""Constants of the corpus plan, as plain frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Audio:
    """Sampling and feature geometry."""

    sample_rate: int = 16_000
    hop_length: int = 160
    encoder_stride: int = 2
    n_mels: int = 80
    window_s: float = 10.0
    max_tokens: int = 448
    pad_token: int = -100
    floor_offset: float = 2.0

    @property
    def frames_per_second(self) -> int:
        return self.sample_rate // self.hop_length

    def n_frames(self, window_s: float | None = None) -> int:
        return int((self.window_s if window_s is None else window_s) * self.frames_per_second)

    def n_positions(self, window_s: float | None = None) -> int:
        return self.n_frames(window_s) // self.encoder_stride

    @property
    def bytes_per_clip(self) -> int:
        return self.n_mels * self.n_frames() * 2

    def cache_bytes(self, clips: int) -> int:
        return clips * self.bytes_per_clip

    def require_bins(self, n_mels: int) -> None:
        if n_mels != self.n_mels:
            raise ValueError(f"features have {n_mels} mel bins; the teacher takes {self.n_mels}")


@dataclass(frozen=True)
class Source:
    dataset: str
    hours: float


@dataclass(frozen=True)
class Corpus:
    """Filters, clip bounds and source weights."""

    sources: tuple[Source, ...] = (Source("ARTPARK-IISc/Vaani-transcription-part", 120.0), Source("ai4bharat/IndicVoices", 50.0))
    unsourced_hours: float = 30.0
    max_teacher_wer: float = 0.20
    max_mean_entropy: float = 2.5
    min_clip_s: float = 1.0
    max_clip_s: float = 10.0
    max_gap_s: float = 0.6
    shard_bytes: int = 4 << 30
    max_files: int = 50


@dataclass(frozen=True)
class Distillation:
    """Student size and loss weights."""

    decoder_layers: int = 4
    vocabulary: int = 16_000
    ce_weight: float = 1.0
    kl_weight: float = 0.8
    temperature: float = 2.0
    top_k: int = 64


@dataclass(frozen=True)
class Quota:
    """Metering of a two-GPU session."""

    gpus_per_session: int = 2
    tolerance: float = 0.35
    gpu_hours_needed: float = 108.0
    hours_per_week: float = 30.0


@dataclass(frozen=True)
class Settings:
    audio: Audio = field(default_factory=Audio)
    corpus: Corpus = field(default_factory=Corpus)
    distillation: Distillation = field(default_factory=Distillation)
    quota: Quota = field(default_factory=Quota)


DEFAULT = Settings()
