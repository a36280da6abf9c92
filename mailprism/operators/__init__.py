"""DataFrame operators: intake, decoding, correlation, verdicts, corpora, metrics."""
