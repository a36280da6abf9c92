"""Message scoring on Spark: text, HTML, image and link signals, correlated into verdicts."""
