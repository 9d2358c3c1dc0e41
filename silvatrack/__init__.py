"""Spark jobs that segment many related signal tracks with a tree-structured hidden Markov model."""
