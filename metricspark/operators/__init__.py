"""Part of the metrics engine; see the package README."""
