"""End-to-end batch jobs composed of the operators."""
