"""Column functions."""

from .columns import bin_of, box_from_center, clipped_logit, clipped_sigmoid, keyed_uniform, missing, r6, stable_id, stable_rank

__all__ = ["bin_of", "box_from_center", "clipped_logit", "clipped_sigmoid", "keyed_uniform", "missing", "r6", "stable_id", "stable_rank"]
