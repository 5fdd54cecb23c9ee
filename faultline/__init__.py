"""Log-signal detection on Spark: normalise, align, detect, report."""
