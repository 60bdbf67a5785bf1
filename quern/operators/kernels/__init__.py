"""Dense inner loops in NumPy, run on Arrow batches or groups; everything around them is a plan."""
