"""placework: build and reconcile a catalogue of places with Spark DataFrames."""
