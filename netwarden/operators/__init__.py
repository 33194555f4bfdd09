"""DataFrame operators: cleaning, encoding, detection, resampling, evaluation."""
