"""Column expressions (all JVM-side): tolerant VARIANT readers, text and date
rules, vector arithmetic, reason sentences."""
