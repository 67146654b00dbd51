"""Settings of a search: immutable, validated as a whole, read from Spark's configuration where asked.

Spark keeps any `strandloom.*` key that is SET but checks nothing, so checks run
when a configuration is made; a refused change leaves the old object as it was.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

PREFIX = "strandloom."


class SettingError(ValueError):
    """A setting outside its range, or two that do not go together."""


#: Name, default, least and most.
RANGES: dict[str, tuple[Any, float, float]] = {
    "max_appearance_rate": (0.5, 0, 1),
    "max_appearance_nrow": (0, 0, 2**31 - 1),
    "min_score": (1, 0, 2**31 - 1),
    "occur_bitlen": (8, 0, 16),
    "kmer_size": (16, 4, 32),
    "min_shared_kmer_rate": (0.5, 0, 1),
    "preclude_highfreq_kmer": (False, 0, 1),
    "force_use_parallel_highfreq_kmer_cache": (False, 0, 1),
    "force_simd_capability": (-1, -1, 100),
    "query_kmer_cache_max_entries": (50000, 1000, 10000000),
    "actual_min_score_cache_max_entries": (50000, 1000, 10000000),
    "highfreq_kmer_cache_load_batch_size": (10000, 1000, 1000000),
    "highfreq_analysis_hashtable_size": (1000000, 10000, 100000000),
}


@dataclass(frozen=True)
class KmerConfig:
    max_appearance_rate: float = 0.5
    max_appearance_nrow: int = 0
    min_score: int = 1
    occur_bitlen: int = 8
    kmer_size: int = 16
    min_shared_kmer_rate: float = 0.5
    preclude_highfreq_kmer: bool = False
    force_use_parallel_highfreq_kmer_cache: bool = False
    force_simd_capability: int = -1
    query_kmer_cache_max_entries: int = 50000
    actual_min_score_cache_max_entries: int = 50000
    highfreq_kmer_cache_load_batch_size: int = 10000
    highfreq_analysis_hashtable_size: int = 1000000

    def __post_init__(self):
        for name, (_, low, high) in RANGES.items():
            value = getattr(self, name)
            if not low <= value <= high:
                raise SettingError(f'{value} is outside the valid range for parameter "{PREFIX}{name}" ({low} .. {high})')
        if self.total_bits > 64:
            raise SettingError(
                f"invalid {PREFIX}kmer_size value: total bit length (kmer_size * 2 + occur_bitlen) = "
                f"({self.kmer_size} * 2 + {self.occur_bitlen}) = {self.total_bits} exceeds maximum of 64 bits"
            )

    @property
    def total_bits(self) -> int:
        return 2 * self.kmer_size + self.occur_bitlen

    @property
    def key_width(self) -> int:
        """Bytes that a key needs: 2, 4 or 8. Keys are always stored as bigint."""
        return 2 if self.total_bits <= 16 else 4 if self.total_bits <= 32 else 8

    @property
    def occurrences(self) -> int:
        """How many occurrences of a k-mer within one sequence count."""
        return 1 << self.occur_bitlen

    def with_(self, **changes: Any) -> KmerConfig:
        return dataclasses.replace(self, **changes)

    @classmethod
    def from_spark(cls, spark: SparkSession) -> KmerConfig:
        given: dict[str, Any] = {}
        for name, (default, _, _) in RANGES.items():
            text = spark.conf.get(PREFIX + name, None)
            if text is None:
                continue
            try:
                given[name] = text.strip().lower() in ("true", "on", "1", "t", "yes") if isinstance(default, bool) else type(default)(text)
            except ValueError:
                raise SettingError(f'invalid value for parameter "{PREFIX}{name}": "{text}"') from None
        return cls(**given)


def check_key_width(declared: int, config: KmerConfig) -> None:
    """An index may declare its key width (2, 4 or 8 bytes); it must be the one that the settings need."""
    if config.total_bits > declared * 8:
        raise SettingError(
            f"key width {declared} cannot store current configuration: required bits {config.total_bits} "
            f"(kmer_size={config.kmer_size} * 2 + occur_bitlen={config.occur_bitlen}), capacity {declared * 8}; use width {config.key_width}"
        )
    if declared != config.key_width:
        raise SettingError(f"key width {declared} is not optimal for current configuration, which requires {config.total_bits} bits; use width {config.key_width}")
