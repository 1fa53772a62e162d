"""Spark-native pairwise association analytics over allele matrices."""

from lociloom.config import GenomeConfig, HighOrderConfig, VpConfig
from lociloom.session import build_session

__all__ = ["GenomeConfig", "HighOrderConfig", "VpConfig", "build_session"]
