"""Scalar expressions over names, numbers and rasters."""

from pixelweave.functions.scalar import align_offset, half_up, probability_colour, rescaled, sigmoid, stem, tier_colour, tier_rank, tier_style

__all__ = ["align_offset", "half_up", "probability_colour", "rescaled", "sigmoid", "stem", "tier_colour", "tier_rank", "tier_style"]
