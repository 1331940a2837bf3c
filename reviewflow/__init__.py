"""Review scoring on Spark: contracts, calibrated decisions, history, evaluation."""
