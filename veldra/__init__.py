"""Dense-feature analytics on Spark: bases, ranges, seeds, masks, fidelity, planning and catalog operators."""
