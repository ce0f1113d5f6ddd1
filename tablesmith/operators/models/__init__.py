"""Classifiers: Gaussian naive Bayes and exact k-NN (custom), Spark ML wrappers, catalogue."""
