"""Column expressions: arrays, spectra, text answers, labels."""
