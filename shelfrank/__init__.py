"""Retail recommendation analytics on Spark: cleaning, windowed features, labelled
training sets, candidate scoring, score stacking and ranking metrics, all as DataFrame plans."""

from shelfrank.params import RecoParams

__all__ = ["RecoParams"]
