"""foliant: cleaning, restructuring and profiling of document corpora on Spark."""
