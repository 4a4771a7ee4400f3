"""assayframe: set-oriented analytics over semi-structured laboratory reports on Spark."""
